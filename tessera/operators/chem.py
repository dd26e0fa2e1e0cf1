"""Molecules: fingerprints, graphs and embeddings through a provider. None is bundled, and none is imitated.

A provider is a function from a list of structure texts to values, made once for each task by a factory (so that heavy
generators are built there). ``rdkit_fingerprints`` makes one where RDKit is installed.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.bits import pack, unpack
from tessera.sources.files import MissingDependency

#: Names and lengths of the fingerprints.
FINGERPRINTS = {"avalon": 2048, "morgan": 2048, "maccs": 167}
COLUMN_NAMES = {"avalon": "Avalon_FP_", "morgan": "Morgan_FP_", "maccs": "MACCS_FP_"}
MOST_ATOMIC_NUMBER = 100

#: For each structure None (not parseable) or the bits by name.
Provider = Callable[[Sequence[str]], list[dict[str, list[int]] | None]]


def need(module: str, what: str) -> None:
    if importlib.util.find_spec(module) is None:
        raise MissingDependency(f"{what} needs {module}, which is not installed")


def rdkit_fingerprints() -> Provider:
    need("rdkit", "computing fingerprints")
    from rdkit import Chem
    from rdkit.Avalon import pyAvalonTools
    from rdkit.Chem import MACCSkeys, rdFingerprintGenerator

    morgan = rdFingerprintGenerator.GetMorganGenerator(radius=2, fpSize=FINGERPRINTS["morgan"])

    def bits(text: str) -> dict[str, list[int]] | None:
        mol = Chem.MolFromSmiles(text) if text else None
        if mol is None:
            return None
        return {"avalon": list(pyAvalonTools.GetAvalonFP(mol, FINGERPRINTS["avalon"])), "morgan": list(morgan.GetFingerprint(mol)), "maccs": list(MACCSkeys.GenMACCSKeys(mol))}

    return lambda texts: [bits(t) for t in texts]


def add_fingerprints(df: DataFrame, structure: str, factory: Callable[[], Provider] = rdkit_fingerprints) -> DataFrame:
    """Adds avalon, morgan, maccs (packed words; all zero where the structure can't be read) and fp_valid."""
    if factory is rdkit_fingerprints:
        need("rdkit", "computing fingerprints")
    sizes = dict(FINGERPRINTS)

    @F.pandas_udf("valid boolean, avalon array<int>, morgan array<int>, maccs array<int>")
    def compute(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for texts in parts:
            found = provider(texts.fillna("").tolist())
            yield pd.DataFrame({"valid": [x is not None for x in found], **{n: [x[n] if x else [0] * size for x in found] for n, size in sizes.items()}})

    made = df.withColumn("_fp", compute(F.col(structure)))
    return made.withColumns({n: pack(F.col(f"_fp.{n}")) for n in sizes} | {"fp_valid": F.col("_fp.valid")}).drop("_fp")


def wide(df: DataFrame, names: Sequence[str] = tuple(FINGERPRINTS)) -> DataFrame:
    """One 0/1 column for each bit in place of the packed ones: for files at the edge only."""
    out: list[Column] = [F.col(c) for c in df.columns if c not in names]
    for n in names:
        df = df.withColumn(f"_{n}", unpack(F.col(n), FINGERPRINTS[n]))
        out += [F.col(f"_{n}")[i].alias(f"{COLUMN_NAMES[n]}{i}") for i in range(FINGERPRINTS[n])]
    return df.select(*out)


def graphs(df: DataFrame, structure: str, factory: Callable[[], Callable[[str], tuple[list[int], list[tuple[int, int]]] | None]]) -> DataFrame:
    """Adds graph: atomic numbers (0 to MOST_ATOMIC_NUMBER - 1) and edges in both directions; one atom 0 where unreadable."""
    @F.pandas_udf("atoms array<int>, heads array<int>, tails array<int>")
    def compute(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parse = factory()
        for texts in parts:
            found = [parse(t) if t else None for t in texts]
            found = [x or ([0], []) for x in found]
            both = [[*e, *((b, a) for a, b in e)] for _, e in found]
            yield pd.DataFrame({"atoms": [[min(MOST_ATOMIC_NUMBER - 1, z) for z in a] for a, _ in found], "heads": [[a for a, _ in e] for e in both], "tails": [[b for _, b in e] for e in both]})

    return df.withColumn("graph", compute(F.col(structure)))


def embeddings(df: DataFrame, structure: str, factory: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 64) -> DataFrame:
    """Adds embedding by an encoder that is loaded once for each task; computed once, folds share it."""
    @F.pandas_udf("array<float>")
    def compute(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for texts in parts:
            t = texts.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(t), batch) for v in encode(t[i : i + batch])], dtype=object)

    return df.withColumn("embedding", compute(F.col(structure)))
