"""Networks: slopes against differences, tasks, order of atoms, what they learn."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import models, networks, structures
from tessera.operators.networks import Dense, GraphNetwork, Graphs, Perceptron, slopes

GRAPHS = pa.table({
    "atoms": pa.array([[6, 6, 8], [0], [7, 6, 6, 6]], pa.list_(pa.int32())),
    "heads": pa.array([[0, 1, 1, 2], [], [0, 1, 1, 2, 2, 3, 3, 1]], pa.list_(pa.int32())),
    "tails": pa.array([[1, 0, 2, 1], [], [1, 0, 2, 1, 3, 2, 1, 3]], pa.list_(pa.int32())),
})


@pytest.mark.parametrize("dropout", [0.0, 0.3, None])
def test_slopes_equal_differences(dropout):
    rng, y, w = np.random.default_rng(1), np.array([1.0, 0.0, 1.0]), np.array([2.0, 1.0, 0.5])
    net = Dense([4, 5, 3]) if dropout is None else Graphs(9, 5, 2, dropout)
    table = pa.table({"x": pa.array(list(rng.normal(size=(3, 4))), pa.list_(pa.float64()))}) if dropout is None else GRAPHS
    params = [p + rng.normal(size=p.shape) / 10 for p in net.start(3)]
    picked = net.pick(net.load(table), np.array([2, 0, 1]), np.array([5, 6, 7], np.uint64))
    _, found = slopes(net, params, picked, y, w)
    for i, p in enumerate(params):
        for at in np.ndindex(p.shape):
            ends = []
            for step in (1e-6, -1e-6):
                moved = [q.copy() for q in params]
                moved[i][at] += step
                ends.append(slopes(net, moved, picked, y, w)[0])
            assert found[i][at] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-5)


def rows(spark, n=300):
    x = [(F.pmod(F.hash("id", F.lit(k)), F.lit(1000)) / 500.0 - 1).alias(f"x{k}") for k in range(3)]
    df = spark.range(n).select("id", *x).repartition(2, "id")
    return df.select("id", ((F.col("x0") * F.col("x1")) > 0).cast("int").alias("label"), array_to_vector(F.array("x0", "x1", "x2")).alias("features"))


def test_perceptron_learns_a_product_whatever_the_tasks(spark):
    df = rows(spark).cache()
    one, four = (Perceptron((40,), epochs=60, batch=50, rate=0.01, tasks=t).fit(df) for t in (1, 4))
    assert np.allclose(one.losses, four.losses, atol=1e-6) and one.losses[-1] < 0.25 < one.losses[0]
    said = models.score_column(four.transform(df))
    assert said.filter("(score > 0.5) = (label = 1)").count() > 270
    weighed = Perceptron((10,), epochs=30, rate=0.01).fit(df.withColumn("weight", F.when(F.col("label") == 1, 50.0).otherwise(1.0)))
    assert models.score_column(weighed.transform(df)).agg(F.avg("score")).first()[0] > 0.7


def test_perceptron_stops_and_bears_little(spark):
    same = rows(spark, 40).withColumn("label", F.lit(1))
    assert len(Perceptron((5,), rate=0.1).fit(same).losses) < 500
    none = Perceptron((5,)).fit(same.limit(0).cache())
    assert none.losses == [] and none.transform(same.limit(0)).count() == 0


def drawn(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, smiles string")
    return structures.graphs(structures.parsed(df, "smiles"))


def test_graph_network_learns_a_motif_and_forgets_the_order(spark):
    texts = [a + "C" * i + b for i in range(1, 11) for a in ("C", "CC", "N", "O", "CO") for b in ("", "C(=O)O", "N", "C(F)(F)F")]
    df = drawn(spark, texts).withColumn("label", F.col("smiles").endswith("C(=O)O").cast("int")).cache()
    net = GraphNetwork(hidden=16, epochs=25, batch=16, rate=0.01, tasks=2).fit(df)
    assert net.losses[-1] < net.losses[0] / 2
    said = {r["smiles"]: (r["score"], r["label"]) for r in models.score_column(net.transform(df)).collect()}
    pos, neg = ([s for s, y in said.values() if y == k] for k in (1, 0))
    assert sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) > 0.95
    got = [r["score"] for r in models.score_column(net.transform(drawn(spark, ["NCC(=O)O", "OC(=O)CN", "C(N)C(O)=O"]))).collect()]
    assert got == pytest.approx([got[0]] * 3)
    odd = models.score_column(net.transform(drawn(spark, ["C(", None, ""]).withColumn("graph", F.when(F.col("id") > 0, F.col("graph"))))).collect()
    assert len({round(r["score"], 12) for r in odd}) == 1


def test_more_rows_have_more_learners(spark, monkeypatch):
    """Beyond LEARNER_ROWS the steps that follow one another don't grow with the rows, and the tasks' number changes nothing."""
    monkeypatch.setattr(networks, "LEARNER_ROWS", 300)
    monkeypatch.setattr(networks, "ROUND", 4)
    df = rows(spark, 1500).cache()
    one, three = (Perceptron((40,), epochs=60, batch=50, rate=0.01, tasks=t).fit(df) for t in (1, 3))
    assert np.allclose(one.losses, three.losses, atol=1e-6) and one.losses[-1] < 0.25 < one.losses[0]
    assert models.score_column(three.transform(df)).filter("(score > 0.5) = (label = 1)").count() > 1350


def test_equal_graphs_are_learned_once(spark, monkeypatch):
    """Copies weigh; they don't add rows to a training set."""
    seen = []
    real = networks.trained
    monkeypatch.setattr(networks, "trained", lambda rows, *a, **k: seen.append(rows.agg(F.count(F.lit(1)), F.sum("_n"), F.sum("_w")).first()) or real(rows, *a, **k))
    df = drawn(spark, ["CCO", "CCN", "CCO", "c1ccccc1"] * 50).withColumn("label", F.col("smiles").contains("O").cast("int"))
    net = GraphNetwork(hidden=8, epochs=2, batch=16).fit(df.withColumn("weight", F.lit(2.0)))
    assert [tuple(x) for x in seen] == [(3, 200.0, 400.0)]
    got = {(r["smiles"], round(r["score"], 9)) for r in models.score_column(net.transform(df)).collect()}
    assert len(got) == 3
