"""Extremely randomised trees: against a plain forest of the same draws, and on real-valued features."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array

from tessera.operators import models, randomtrees
from tessera.operators.randomtrees import ExtraTrees


def frame(spark, x, y, w=None, parts=3):
    rows = [(i, [float(v) for v in x[i]], float(y[i]), float(1 if w is None else w[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "id int, x array<double>, label double, weight double").select("id", array_to_vector("x").alias("features"), "label", "weight").repartition(parts)


def shares(model, df):
    rows = model.transform(df).select("id", vector_to_array("probability").alias("p"), "prediction").collect()
    return np.array([r["p"] for r in sorted(rows, key=lambda r: r["id"])])


def data(n=150, seed=2):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 9))
    x[:, 6:] = x[:, 6:] > 0
    return x, ((x[:, 0] > 0.3) + (x[:, 1] + x[:, 6] > 0.8)).astype(int)


def plain(x, y, w, make, ask):
    """The same trees, grown one by one from the same draws by recursion over arrays of rows."""
    classes, k, out = y.max() + 1, make.tried_features(x.shape[1]), np.zeros((len(ask), y.max() + 1))
    for t in range(make.trees):
        left, value, rule, number = {}, {}, {}, 1
        waiting = [(0, np.arange(len(x)), 0, 0)]
        while waiting:  # nodes get their numbers round by round; one whose draws were all constant waits for the next
            now, waiting = waiting, []
            for node, rows, depth, tried in now:
                value[node] = np.array([w[rows][y[rows] == c].sum() for c in range(classes)])
                if (value[node] > 0).sum() < 2 or len(rows) < make.min_split or depth >= make.depth or tried * k >= x.shape[1]:
                    continue
                f = np.resize(np.random.default_rng([make.seed, t, node]).permutation(x.shape[1])[tried * k : (tried + 1) * k], k)
                lo, hi = x[rows][:, f].min(0), x[rows][:, f].max(0)
                cut = lo + np.random.default_rng([make.seed, t, node, tried + 1]).random(k) * (hi - lo)
                cut = np.where(cut >= hi, lo, cut)
                best = None
                for j in np.flatnonzero(hi > lo):
                    a = rows[x[rows, f[j]] <= cut[j]]
                    l_ = np.array([w[a][y[a] == c].sum() for c in range(classes)])
                    r_ = value[node] - l_
                    s = (l_**2).sum() / l_.sum() + (r_**2).sum() / r_.sum()
                    if best is None or s > best[0] + 1e-9:
                        best = (s, f[j], cut[j])
                if best is None:
                    waiting.append((node, rows, depth, tried + 1))
                    continue
                rule[node], left[node] = best[1:], number
                go = x[rows, best[1]] <= best[2]
                waiting += [(number, rows[go], depth + 1, 0), (number + 1, rows[~go], depth + 1, 0)]
                number += 2
        for i, row in enumerate(ask):
            node = 0
            while node in left:
                node = left[node] + int(row[rule[node][0]] > rule[node][1])
            out[i] += value[node] / value[node].sum()
    return out / make.trees


@pytest.mark.parametrize("min_split", [2, 7])
def test_equal_to_plain_forest(spark, min_split):
    x, y = data()
    w = np.where(y == 1, 2.0, 1.0)
    make = ExtraTrees(4, min_split=min_split)
    model = make.fit(frame(spark, x, y, w))
    assert np.allclose(shares(model, frame(spark, x, y)), plain(x, y, w, make, x), atol=1e-6)
    if min_split == 2:
        assert (shares(model, frame(spark, x, y)).argmax(1) == y).all()


@pytest.mark.parametrize("parts", [1, 3])
def test_equal_to_plain_forest_on_bits(spark, parts):
    x, y = data()
    x = (x > 0.1).astype(float)
    make = ExtraTrees(3)
    assert np.allclose(shares(make.fit(frame(spark, x, y, parts=parts)), frame(spark, x, y)), plain(x, y, np.ones(len(x)), make, x), atol=1e-6)


def test_number_of_tasks_changes_nothing(spark):
    x, y = data(80)
    one, many = (shares(ExtraTrees(3).fit(frame(spark, x, y, parts=p)), frame(spark, x, y)) for p in (1, 4))
    assert np.array_equal(one, many)


def test_held_out_accuracy_on_real_values(spark):
    x, y = data(900, 5)
    train, test = frame(spark, x[:600], y[:600]), frame(spark, x[600:], y[600:])
    assert (shares(ExtraTrees(25).fit(train), test).argmax(1) == y[600:]).mean() > 0.85


def test_odd_tables(spark):
    x, y = data(30)
    assert (shares(ExtraTrees(2).fit(frame(spark, x, np.ones(30))), frame(spark, x, y))[:, 1] == 1).all()
    same = ExtraTrees(2).fit(frame(spark, np.zeros((30, 4)), y))
    assert np.allclose(shares(same, frame(spark, np.zeros((30, 4)), y)), np.bincount(y) / 30)
    one = np.zeros((30, 9))
    one[:, 4] = y  # all but one feature constant: further ones are drawn until it is met
    assert (shares(ExtraTrees(2).fit(frame(spark, one, y)), frame(spark, one, y)).argmax(1) == y).all()
    x[::4] = np.nan
    assert np.isfinite(shares(ExtraTrees(2).fit(frame(spark, x, y)), frame(spark, x, y))).all()
    assert ExtraTrees(2).fit(frame(spark, x, y).filter("id < 0")).trees == []


def test_registry_uses_them(spark):
    x, y = data(60)
    df = frame(spark, x, (y > 0).astype(int)).drop("weight")
    for name in ("ExtraTrees", "SourceTrees"):
        model = models.fit(models.registry(3)[name], df)
        assert type(model).__name__ == "RandomisedTrees" and models.score_column(model.transform(df)).filter("score between 0 and 1").count() == 60


def test_driver_holds_tops_alone(spark, monkeypatch):
    """What is below nodes of few rows is a table, which rows meet when they are asked; leaves are as pure, whatever the tasks."""
    x, y = data(900, 5)
    y[::3] = np.random.default_rng(1).integers(0, 2, 300)
    x[1:] += np.random.default_rng(2).normal(size=(899, 9)) / 1000  # no two rows are equal
    monkeypatch.setattr(randomtrees, "LOCAL_ROWS", 100)
    monkeypatch.setattr(randomtrees, "ASKED_ROWS", 40)
    one, four = (ExtraTrees(6, seed=3).fit(frame(spark, x, y, parts=p)) for p in (1, 4))
    assert 6 < sum(len(t.left) for t in one.trees) < 6 * 100 < 6 * 300 < sum(len(r["left"]) // 4 for r in one.below.collect())
    both = [shares(m, frame(spark, x, y)) for m in (one, four)]
    assert np.array_equal(*both) and (both[0][np.arange(900), y] == 1).all()
    x, y = data(900, 5)
    assert (shares(ExtraTrees(25).fit(frame(spark, x[:600], y[:600])), frame(spark, x[600:], y[600:])).argmax(1) == y[600:]).mean() > 0.85


def test_whole_trees_are_grown_in_groups(spark, monkeypatch):
    """Where each tree has all rows in one task, rows are dealt out once a group and not once a tree; trees and shares stay the same."""
    x, y = data(120)
    met, routed = [], randomtrees.routed
    monkeypatch.setattr(randomtrees, "routed", lambda *a: met.append(1) or routed(*a))
    by_group = []
    for groups in (2, 7):
        monkeypatch.setattr(randomtrees, "GROUPS", groups)
        monkeypatch.setattr(randomtrees, "ASKED_ROWS", 50 * groups)
        by_group.append(shares(ExtraTrees(7).fit(frame(spark, x, y)), frame(spark, x, y)))
    assert not met and np.array_equal(*by_group)
    assert np.allclose(by_group[0], plain(x, y, np.ones(len(x)), ExtraTrees(7), x), atol=1e-6)
