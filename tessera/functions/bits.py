"""Fingerprints as packed 64-bit words: packing, counting, Tanimoto similarity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD_BITS = 64


def pack(bits: Column) -> Column:
    """An array of 0/1 as an array of longs, bit i in word i div 64; null for null."""
    word = lambda part: F.aggregate(F.transform(part, lambda b, i: F.when(b > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    words = F.sequence(F.lit(0), F.floor((F.size(bits) - 1) / WORD_BITS).cast("int"))
    return F.when(F.size(bits) > 0, F.transform(words, lambda w: word(F.slice(bits, w * WORD_BITS + 1, F.lit(WORD_BITS))))).otherwise(F.array().cast("array<bigint>"))


def sign_bits(vector: Column) -> Column:
    return pack(F.transform(vector, lambda x: (x > 0).cast("int")))


def unpack(words: Column, n: int) -> Column:
    """The first n bits as an array of 0/1."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(F.get(words, F.floor(i / WORD_BITS).cast("int")), (i % WORD_BITS).cast("int")).cast("int"))


def ones(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.bit_count(w))


def common(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda n, c: n + c)


def tanimoto(a: Column, b: Column, a_ones: Column, b_ones: Column) -> Column:
    """Common bits by bits of either, 1 at least. Counted in 32 bits: dense fingerprints don't overflow."""
    both = common(a, b)
    return both.cast("double") / F.greatest(a_ones + b_ones - both, F.lit(1)).cast("double")
