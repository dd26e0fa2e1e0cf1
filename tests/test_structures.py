"""The structure parser, graphs, circular fingerprints and keys against plain versions on small molecules."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.bits import ones
from tessera.operators import similarity, structures as S

MOLECULES = [
    "CCO", "c1ccccc1", "O=C(O)c1ccccc1OC(C)=O", "Cn1cnc2c1c(=O)n(C)c(=O)n2C", "C[N+](C)(C)CC([O-])=O", "[Na+].[Cl-]", "F/C=C/F", "C1CC1C2CC2", "[nH]1cccc1", "N[C@@H](C)C(=O)O", "[13CH4]",
    "c1ccccc1c1ccccc1", "CC(C)(C)OC(=O)N1CCCC1", "C%12CCC%12", "C#CC#N", "OP(=O)(O)OCC", "CS(=O)(=O)Cl", "c1ccc2ccccc2c1", "C1CC2CCC1C2", "O",
]
BROKEN = ["", " ", None, "C(", "C)", "C()C", "C1CC", "CC(C)(C)(C)C", "cc", "C==C", "=C", "C=", "(C)C", "C11", "C12CC12", "[Xx]", "[C", "C=1CC#1", "C~C", "hello", "C..C", "F=C", "1CC1", "C(1)CC1"]


def written(g, r):
    """The same molecule as another text: atoms are visited from another start, in another order."""
    near, out, seen, numbers = g.around(), [], set(), {}
    sign = {S.SINGLE: "-", S.DOUBLE: "=", S.TRIPLE: "#", S.AROMATIC_BOND: ":", S.QUADRUPLE: "$", S.UNSAID: ""}

    def name(a):
        x = g.atoms[a]
        s = x.symbol.lower() if x.aromatic else x.symbol
        if x.hydrogens is None:
            return s
        charge = "" if not x.charge else ("+" if x.charge > 0 else "-") * abs(x.charge)
        return f"[{x.isotope or ''}{s}{'H' + str(x.hydrogens) if x.hydrogens else ''}{charge}]"

    # Bonds that close rings are found first, so that both of their ends can say the number.
    tree, closing, order = set(), [], []

    def visit(a, by):
        seen.add(a)
        order.append(a)
        todo = [x for x in near[a] if x[2] != by]
        r.shuffle(todo)
        kids = []
        for b, o, i in todo:
            if b not in seen:
                tree.add(i)
                kids.append((b, o, i))
                visit(b, i)
            elif i not in tree and i not in [c[2] for c in closing]:
                closing.append((a, b, i, o))
        children[a] = [k for k in kids]

    children = {}
    starts = list(range(len(g.atoms)))
    r.shuffle(starts)
    pieces = []
    for s in starts:
        if s not in seen:
            pieces.append(s)
            visit(s, -1)
    for n, (a, b, i, o) in enumerate(closing):
        for end in (a, b):
            numbers.setdefault(end, []).append(f"{sign[o]}%{n + 10}")

    def spell(a):
        text = name(a) + "".join(numbers.get(a, []))
        kids = children[a]
        for k, (b, o, _) in enumerate(kids):
            inner = sign[o] + spell(b)
            text += f"({inner})" if k < len(kids) - 1 else inner
        return text

    out = ".".join(spell(p) for p in pieces)
    return out


def plain_environments(m, radius=2):
    """How many different surroundings there are: codes as nested tuples in place of hashes, the same rule for those of equal bonds."""
    near = m["around"]
    codes = [(a[0], len(near[i]), a[2], a[1], a[3], a[5]) for i, a in enumerate(m["atoms"])]
    said, known, grows, bonds = {("0", c) for c in codes}, set(), [True] * len(codes), [frozenset()] * len(codes)
    for r in range(1, radius + 1):
        now = [(codes[i], tuple(sorted((o, repr(codes[b])) for b, o, _ in n))) for i, n in enumerate(near)]
        wide = [bonds[i] | {k for _, _, k in n} | frozenset().union(*(bonds[b] for b, _, _ in n)) for i, n in enumerate(near)]
        sets = {}
        for i, w in enumerate(wide):
            if grows[i] and w and w not in known:
                sets.setdefault(w, []).append(i)
        keep = {i for own in sets.values() for i in own}
        yield_ = {w: {now[i] for i in own} for w, own in sets.items()}
        said |= {(r, w) for w in yield_}
        known |= set(sets)
        grows, codes, bonds = [g and i in keep for i, g in enumerate(grows)], now, wide
    return said


def test_readable_and_broken(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*MOLECULES, *BROKEN])], "id int, smiles string")
    made = S.graphs(S.parsed(df, "smiles")).collect()
    assert [r["id"] for r in made if r["molecule"]["valid"]] == list(range(len(MOLECULES)))
    bad = [r for r in made if r["id"] >= len(MOLECULES)]
    assert all(r["graph"]["atoms"] == [0] and r["graph"]["heads"] == r["graph"]["tails"] == [] and not r["molecule"]["atoms"] for r in bad)
    for r in made[: len(MOLECULES)]:
        edges = list(zip(r["graph"]["heads"], r["graph"]["tails"]))
        assert sorted(edges) == sorted((b, a) for a, b in edges) and len(edges) == 2 * len(r["molecule"]["bonds"])


def test_drawn_molecules():
    """Hand-counted: atoms with (number, hydrogens), orders of bonds in halves."""
    look = lambda t: ([(a[0], a[2]) for a in S.molecule(t)["atoms"]], sorted(b[2] for b in S.molecule(t)["bonds"]))
    assert look("CC(=O)O") == ([(6, 3), (6, 0), (8, 0), (8, 1)], [2, 2, 4])
    assert look("c1ccncc1") == ([(6, 1), (6, 1), (6, 1), (7, 0), (6, 1), (6, 1)], [3] * 6)
    assert look("C[N+](=O)[O-]") == ([(6, 3), (7, 0), (8, 0), (8, 0)], [2, 2, 4])
    assert sorted(b[2] for b in S.molecule("c1ccccc1c1ccccc1")["bonds"]) == [2] + [3] * 12
    assert [a[5] for a in S.molecule("CC1CC1")["atoms"]] == [False, True, True, True]
    assert S.molecule("CS(=O)(=O)C")["atoms"][1][2] == 0 and S.molecule("CSC")["atoms"][1][2] == 0 and S.molecule("CN")["atoms"][1][2] == 2
    long = S.molecule("C" * 5000 + "O")
    assert long["valid"] and len(long["atoms"]) == 5001


@pytest.fixture(scope="module")
def variants(spark):
    r = random.Random(4)
    rows = []
    for i, t in enumerate(MOLECULES):
        rows.append((i, t))
        rows += [(i, written(S.read(t), r)) for _ in range(5)]
    return spark.createDataFrame(rows, "id int, smiles string").cache()


def test_bits_do_not_depend_on_the_order_of_atoms(variants):
    made = S.add_fingerprints(variants, "smiles")
    seen = made.groupBy("id").agg(F.countDistinct("circular").alias("c"), F.countDistinct("keys").alias("k"), F.count("*").alias("n"), F.bool_and("fp_valid").alias("ok"))
    assert all((r["c"], r["k"], r["n"], r["ok"]) == (1, 1, 6, True) for r in seen.collect())
    assert made.select("circular").distinct().count() == len(MOLECULES)


def test_environments_equal_plain_ones(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(MOLECULES)], "id int, smiles string")
    made = S.parsed(df, "smiles").select("smiles", F.size(F.array_distinct(S.environments(F.col("molecule")))).alias("n"))
    for r in made.collect():
        plain = plain_environments(S.molecule(r["smiles"]))
        # Surroundings at different places that look alike share a code; plain ones are counted by place, so they are no fewer.
        assert 0 < r["n"] <= len(plain), r
    got = {r["smiles"]: r["n"] for r in made.collect()}
    assert (got["CCO"], got["c1ccccc1"], got["O"], got["[Na+].[Cl-]"]) == (6, 3, 1, 2)


def test_nearest_by_bits(spark):
    df = spark.createDataFrame([(1, "OCC"), (2, "c1ccccc1C"), (3, "broken("), (4, None)], "row_id int, smiles string")
    ref = spark.createDataFrame([(9, "CCO"), (8, "Cc1ccccc1O")], "row_id int, smiles string")
    near = similarity.max_tanimoto(S.add_fingerprints(df, "smiles"), S.add_fingerprints(ref, "smiles"), "row_id", "circular", "near")
    got = {r["row_id"]: r["near"] for r in near.collect()}
    assert got[1] == 1.0 and 0.2 < got[2] < 1 and got[3] == got[4] == 0.0


def brute(m, pattern, least):
    p = S.plan(pattern)
    edges = {(a, b): o for i, n in enumerate(m["around"]) for b, o, _ in n for a in [i]}
    wanted = [(at, k + 1, o) for k, (at, o, _) in enumerate(p.steps)] + [(i, k + 1, o) for k, (_, _, more) in enumerate(p.steps) for i, o in more]
    sets = set()
    for met in itertools.permutations(range(len(m["atoms"])), len(p.atoms)):
        if all(S.fits(p.atoms[k], p.explicit[k], m["atoms"][a]) for k, a in enumerate(met)) and all((met[x], met[y]) in edges and S.bonded(o, edges[met[x], met[y]]) for x, y, o in wanted):
            sets.add(frozenset(met))
    return len(sets) >= least


def test_keys_equal_brute_force(spark):
    small = [t for t in MOLECULES if len(S.molecule(t)["atoms"]) <= 9]
    keys = [k for k in S.KEYS if len(S.plan(k.pattern).atoms) <= 5]
    df = spark.createDataFrame([(t,) for t in small], "smiles string")
    for r in S.substructures(df, "smiles", tuple(keys)).collect():
        m = S.molecule(r["smiles"])
        assert r["keys"] == [int(brute(m, k.pattern, k.least)) for k in keys], r["smiles"]


def test_known_keys():
    has = lambda t: {k.name for k in S.KEYS if S.has(S.molecule(t), S.plan(k.pattern), k.least)}
    assert {"carboxyl", "benzene", "aryl_ether", "two_carbonyls"} <= has("O=C(O)c1ccccc1OC(C)=O") and "two_benzenes" not in has("O=C(O)c1ccccc1OC(C)=O")
    assert {"two_benzenes", "ring_6"} <= has("c1ccc2ccccc2c1") and "biaryl" in has("c1ccccc1c1ccccc1")
    assert {"choline_like", "carboxylate", "cation", "anion"} <= has("C[N+](C)(C)CC([O-])=O") and has("bad(") == set()


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "smiles string, keys int, molecule int")
    assert S.add_fingerprints(df.drop("keys"), "smiles").count() == 0
    rows = spark.createDataFrame([("CC", 1, 2), ("CC", 1, 2)], "smiles string, graph int, atoms int")
    made = S.add_fingerprints(rows, "smiles")
    assert made.columns == ["smiles", "graph", "atoms", "circular", "keys", "fp_valid"] and made.distinct().count() == 1
    assert made.select(ones(F.col("circular"))).first()[0] == 2


def test_each_text_is_parsed_once(spark):
    """Many rows of few texts, a null among them: every row has its molecule, and the parser sees each text once."""
    seen = spark.sparkContext.accumulator(0)

    def counted(texts):
        count = F.udf(lambda t: seen.add(1) or len(t or ""), "int")
        return texts.withColumn("size", count("_text"))

    rows = spark.createDataFrame([(i, ["CCO", "c1ccccc1", None, "C("][i % 4]) for i in range(200)], "id int, smiles string")
    got = S.by_text(rows, "smiles", counted).collect()
    assert len(got) == 200 and all(g["size"] == len(g["smiles"] or "") for g in got) and seen.value == 4
    made = S.parsed(rows, "smiles").collect()
    assert all(g["molecule"]["valid"] == (g["id"] % 4 < 2) for g in made) and len(made) == 200


def test_similarity_asks_equal_fingerprints_once(spark, monkeypatch):
    """Copies on both sides: the most common bits of two different fingerprints are counted once."""
    asked = spark.sparkContext.accumulator(0)
    plain = similarity.most_common

    def counted(batches):
        for out in plain(batches):
            asked.add(out.num_rows)
            yield out

    monkeypatch.setattr(similarity, "most_common", counted)
    rows = spark.createDataFrame([(i, [[7, 0], [3, -1], None][i % 3]) for i in range(90)], "id int, w array<bigint>")
    got = {r["id"]: r["s"] for r in similarity.max_tanimoto(rows, rows.filter("id < 60 AND w[1] = 0"), "id", "w", "s").collect()}
    assert got == {i: (1.0, 2 / 67, 0.0)[i % 3] for i in range(90)} and asked.value == 2
