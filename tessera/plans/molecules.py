"""Queries on molecules. The given tables have no structure texts, so Spark writes one for each part: four pieces chosen by its key,
broken for some sizes. What the pieces hold says what the parser, the graphs and the keys must find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.bits import ones, unpack
from tessera.operators import models, similarity, structures
from tessera.sources.files import read_table
from tessera.sources.shared import written

#: Pieces of the texts: (text, atoms, bonds).
PIECES = (
    (("C", 1, 0), ("CC(C)", 3, 2), ("OC(=O)", 3, 2), ("N#C", 2, 1), ("c1ccccc1", 6, 6)),
    (("", 0, 0), ("CC", 2, 1), ("C(=O)N", 3, 2), ("CO", 2, 1), ("OP(=O)(O)O", 5, 4)),
    (("C1CCCCC1", 6, 6), ("c1ccncc1", 6, 6), ("C1CC1", 3, 3), ("c1ccc2ccccc2c1", 10, 11), ("C1OCCOC1", 6, 6)),
    (("", 0, 0), ("O", 1, 0), ("C(=O)O", 3, 2), ("N(C)C", 3, 2), ("Cl", 1, 0), ("C(F)(F)F", 4, 3), ("S(=O)(=O)N", 4, 3), ("[N+](=O)[O-]", 3, 2)),
)
STEPS = (1, 5, 25, 125)
#: Keys by which pieces have them: (name, how often, by kind of piece).
EXPECTED = {
    "hydroxyl": {0: {2: 1}, 1: {4: 1}, 3: {1: 1, 2: 1}},
    "carboxyl": {0: {2: 1}, 3: {2: 1}},
    "benzene": {0: {4: 1}, 2: {3: 2}},
    "pyridine": {2: {1: 1}},
    "nitrile": {0: {3: 1}},
    "trifluoromethyl": {3: {5: 1}},
    "ring_3": {2: {2: 1}},
    "phosphate": {1: {4: 1}},
    "sulfonamide": {3: {6: 1}},
}


def texts(spark: SparkSession, d: str) -> DataFrame:
    parts = read_table(spark, d, "part").select("p_partkey", "p_size")
    piece = lambda k: F.element_at(F.array(*(F.lit(t) for t, *_ in PIECES[k])), (F.floor(F.col("p_partkey") / STEPS[k]) % len(PIECES[k]) + 1).cast("int"))
    whole = F.concat(*(piece(k) for k in range(4)))
    return parts.select("p_partkey", F.when(F.col("p_size") % 13 == 0, F.concat(whole, F.lit("("))).when(F.col("p_size") % 13 != 1, whole).alias("smiles"))


def structure_counts(spark, d):
    """Atoms and bonds of each text, and of its graph (one atom where it can't be read)."""
    made = structures.graphs(structures.parsed(texts(spark, d), "smiles"))
    size = lambda c: F.size(c).cast("bigint")
    return made.select("p_partkey", F.col("molecule.valid").alias("valid"), size("molecule.atoms").alias("atoms"), size("molecule.bonds").alias("bonds"), size("graph.atoms").alias("graph_atoms"), size("graph.heads").alias("edges"))


def element_counts(spark, d):
    """How many atoms of each element there are, from rows of atoms."""
    made = structures.parsed(texts(spark, d), "smiles")
    names = F.element_at(F.array(F.lit("*"), *map(F.lit, structures.ELEMENTS)), F.col("number") + 1)
    return structures.atom_rows(made, "p_partkey").groupBy(names.alias("element")).agg(F.count(F.lit(1)).alias("atoms"))


def structure_keys(spark, d):
    """Which of some substructures each text has."""
    names = [k.name for k in structures.KEYS]
    made = structures.substructures(texts(spark, d), "smiles")
    return made.select("p_partkey", *(F.get("keys", F.lit(names.index(k))).alias(k) for k in EXPECTED))


def circular_similarity(spark, d):
    """Each part's bits, and its largest Tanimoto similarity to parts of size 7."""
    made = structures.add_fingerprints(read_table(spark, d, "part").select("p_partkey", "p_size").join(texts(spark, d), "p_partkey"), "smiles")
    made = made.select("p_partkey", "p_size", "fp_valid", "circular", ones(F.col("circular")).alias("bits"), F.array_max(unpack(F.col("keys"), len(structures.KEYS))).alias("any_key"))
    near = similarity.max_tanimoto(made, made.filter("p_size = 7 AND fp_valid"), "p_partkey", "circular", "max_tanimoto")
    return near.select("p_partkey", "fp_valid", "bits", "any_key", "max_tanimoto")


def graph_network_scores(spark, d):
    """Scores of all parts by a graph network that learns from four fifths of them who has a hydroxyl group; held_out are the others."""
    made = structures.substructures(structures.graphs(structures.parsed(texts(spark, d), "smiles")), "smiles")
    at = [k.name for k in structures.KEYS].index("hydroxyl")
    rows = made.select("p_partkey", "graph", F.get("keys", F.lit(at)).cast("int").alias("label"), (F.crc32(F.col("p_partkey").cast("string")) % 5 == 0).alias("held_out"))
    rows = written(rows)
    model = models.fit(models.structure_registry()["GraphNetwork"], rows.filter("NOT held_out"))
    return models.score_column(model.transform(rows)).select("p_partkey", "label", "held_out", "score")


QUERIES = {f.__name__: f for f in (structure_counts, element_counts, structure_keys, circular_similarity, graph_network_scores)}


def _pick(k: int, values) -> str:
    return f"list_element([{', '.join(map(str, values))}], p_partkey // {STEPS[k]} % {len(PIECES[k])} + 1)"


_OK = "p_size % 13 NOT IN (0, 1)"
_ATOMS = " + ".join(_pick(k, [a for _, a, _ in PIECES[k]]) for k in range(4))
# Pieces are joined by a bond each; an empty one has none.
_BONDS = " + ".join(_pick(k, [b + (k > 0 and a > 0) for _, a, b in PIECES[k]]) for k in range(4))
_ELEMENTS = "C N O F P S Cl".split()


def _elements(text: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for a in structures.read(text).atoms if text else ():
        found[a.symbol] = found.get(a.symbol, 0) + 1
    return found


def _key_sql(name: str) -> str:
    times = " + ".join(_pick(k, [EXPECTED[name][k].get(i, 0) for i in range(len(PIECES[k]))]) for k in EXPECTED[name])
    return f"CAST({_OK} AND {times} > 0 AS INT) AS {name}"


ORACLES = {
    "structure_counts": f"SELECT p_partkey, {_OK} AS valid, CAST(CASE WHEN {_OK} THEN {_ATOMS} ELSE 0 END AS BIGINT) AS atoms, CAST(CASE WHEN {_OK} THEN {_BONDS} ELSE 0 END AS BIGINT) AS bonds, CAST(CASE WHEN {_OK} THEN {_ATOMS} ELSE 1 END AS BIGINT) AS graph_atoms, CAST(CASE WHEN {_OK} THEN 2 * ({_BONDS}) ELSE 0 END AS BIGINT) AS edges FROM part",
    "element_counts": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{e}' AS element, CAST(sum({' + '.join(_pick(k, [_elements(t).get(e, 0) for t, *_ in PIECES[k]]) for k in range(4))}) AS BIGINT) AS atoms FROM part WHERE {_OK}" for e in _ELEMENTS) + ") WHERE atoms > 0",
    "structure_keys": f"SELECT p_partkey, {', '.join(map(_key_sql, EXPECTED))} FROM part",
}
