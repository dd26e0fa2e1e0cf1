"""Operators for preparing training data: fingerprints, de-duplication, classifiers, search, mixing, tokens.

Nothing outside this folder imports it.
"""
