"""K-means from several starts, and the kernel machine, against plain numpy versions."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array

from tessera.operators import kernel, lloyd, models


def frame(spark, x, y=None, w=None, parts=3):
    n = len(x)
    rows = [(i, x[i].tolist(), float(0 if y is None else y[i]), float(1 if w is None else w[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id int, x array<double>, label double, weight double").select("id", array_to_vector("x").alias("features"), "label", "weight").repartition(parts)


def test_all_starts_move_as_plain_ones(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(c, 0.4, (40, 3)) for c in (0, 3, 6, 9)])
    df = frame(spark, x)
    make = lloyd.Starts(4, 6, rounds=8, tolerance=0.0)
    from pyspark.sql import functions as F

    centres = make.first_centres(df.select(vector_to_array("features").alias("x")).withColumn("x", F.col("x")))
    model = make.fit(df)
    for s in range(6):
        c = centres[s].copy()
        for _ in range(8):
            own = lloyd.gaps(x, c).argmin(1)
            c = np.array([x[own == k].mean(0) if (own == k).any() else c[k] for k in range(4)])
        assert abs(lloyd.gaps(x, c).min(1).sum() - model.costs[s]) < 1e-5 * model.costs[s]
    assert model.cost == min(model.costs) and model.scans <= 9  # one scan a round for all starts, and one for the cost
    got = np.array([q["cluster"] for q in model.transform(df).orderBy("id").collect()])
    assert all(len(set(got[i * 40 : (i + 1) * 40])) == 1 for i in range(4)) and len(set(got)) == 4


def test_starts_do_not_depend_on_tasks_and_survive_odd_tables(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(50, 2))
    one = lloyd.Starts(3, 2, rounds=4)
    start = np.stack([x[:3], x[10:13]])
    scans = [one.scan(frame(spark, x, parts=p).select(vector_to_array("features").alias("x")), start, 2.0**-30) for p in (1, 4)]
    assert np.array_equal(scans[0][0], scans[1][0]) and np.array_equal(scans[0][1], scans[1][1])
    assert lloyd.Starts(3, 2).fit(frame(spark, np.zeros((5, 2)))).cost == 0.0
    assert lloyd.Starts(3, 2).fit(frame(spark, x).filter("id < 0")).centres.size == 0


def exact_machine(x, y, w, cost, gamma):
    """Hinge loss over the whole kernel by sub-gradient steps in its own space, averaged until it stands still."""
    k = np.exp(-gamma * lloyd.gaps(x, x))
    values, vectors = np.linalg.eigh(k)
    keep = values > 1e-10 * values.max()
    f = np.hstack([vectors[:, keep] * np.sqrt(values[keep])])
    s, lam = np.where(y > 0, 1.0, -1.0), 1 / (cost * w.sum())
    v, b, best = np.zeros(f.shape[1]), 0.0, None
    lost = lambda v, b: (w * np.maximum(0, 1 - s * (f @ v + b))).sum() / w.sum() + lam / 2 * v @ v
    for t in range(1, 6001):
        hit = s * (f @ v + b) < 1
        step = 1 / (lam * (t + 1000))
        v = v - step * (lam * v - (f[hit] * (s * w)[hit][:, None]).sum(0) / w.sum())
        b = b + 0.05 * step * lam * 50 * ((s * w)[hit].sum() / w.sum())
        now = lost(v, b)
        if best is None or now < best[0]:
            best = (now, v.copy(), b)
    return best[0], lost, f, best[1], best[2]


def test_near_the_exact_machine(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 3))
    y = ((x**2).sum(1) + 0.5 * r.normal(size=200) > 2.5).astype(float)
    w = np.where(y > 0, 1.5, 0.8)
    df = frame(spark, x, y, w)
    exact = kernel.KernelMachine(landmarks=200).fit(df)
    gamma = 1 / (3 * x.var())
    assert abs(exact.mapping.gamma - gamma) < 1e-9
    least, lost, f, v, b = exact_machine(x, y, w, 1.0, gamma)
    margins = exact.margins(x)
    # What the machine loses over the whole kernel: its margins as a function of that kernel.
    k = np.exp(-gamma * lloyd.gaps(x, x))
    alpha = np.linalg.lstsq(k, margins - exact.linear[1], rcond=1e-10)[0]
    own = (w * np.maximum(0, 1 - np.where(y > 0, 1, -1) * margins)).sum() / w.sum() + alpha @ k @ alpha / (2 * w.sum())
    assert own <= least * 1.02
    few = kernel.KernelMachine(landmarks=40).fit(df)
    agree = np.mean((few.margins(x) > 0) == (margins > 0))
    assert agree > 0.93 and len(few.mapping.landmarks) == 40


def test_probabilities_are_calibrated_on_held_out_rows(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(600, 2))
    p = 1 / (1 + np.exp(-2 * x[:, 0] * x[:, 1]))
    y = (r.random(600) < p).astype(float)
    model = kernel.KernelMachine(landmarks=60).fit(frame(spark, x[:400], y[:400]))
    got = np.array([q["p"] for q in model.transform(frame(spark, x[400:])).select("id", vector_to_array("probability")[1].alias("p")).orderBy("id").collect()])
    assert np.mean((got - y[400:]) ** 2) < 0.24 and abs(got.mean() - y[400:].mean()) < 0.12 and np.corrcoef(got, p[400:])[0, 1] > 0.7


def test_one_class_and_the_registry(spark):
    x = np.random.default_rng(5).normal(size=(20, 2))
    one = kernel.KernelMachine().fit(frame(spark, x, np.ones(20)))
    assert {q["p"] for q in one.transform(frame(spark, x)).select(vector_to_array("probability")[1].alias("p")).collect()} == {1.0}
    made = models.fit(models.registry()["SVM_RBF"], frame(spark, x, np.arange(20) % 2).drop("weight"))
    assert type(made).__name__ == "Machine"
    clustered = models.clusters(frame(spark, np.random.default_rng(6).normal(size=(60, 4))), 3, 4)
    assert {q["_cluster"] for q in clustered.collect()} == {0, 1, 2} and "_axes" not in clustered.columns


@pytest.mark.parametrize("k", [1, 3])
def test_starting_rows_are_rows(k):
    x = np.arange(12.0).reshape(6, 2)
    got = lloyd.spread_out(x, k, np.random.default_rng(1))
    assert len(got) == k and all(any((g == r).all() for r in x) for g in got)
