"""Boosted trees against plain numpy ones, and what must hold for each way of growing."""

import numpy as np
import pytest
from pyspark.ml import classification as C
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tessera.operators import boosting as B

ALL = {"row_share": 1.0, "column_share": 1.0}


def data(n=400, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 6))
    x[:, 3:] = x[:, 3:] > 0
    y = ((x[:, 0] * x[:, 1] > 0) * 1.2 + x[:, 3] + r.normal(size=n) * 0.7 > 1.1).astype(float)
    return x, y


def frame(spark, x, y, w=None, parts=3):
    rows = [(i, [float(v) for v in x[i]], float(y[i]), float(1 if w is None else w[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "id int, x array<double>, label double, weight double").select("id", array_to_vector("x").alias("features"), "label", "weight").repartition(parts)


def scores(model, df):
    rows = model.transform(df).select("id", vector_to_array("probability")[1].alias("p")).collect()
    return np.array([r["p"] for r in sorted(rows, key=lambda r: r["id"])])


def plain_split(x, g, h, rules, cuts):
    best = None
    for j in range(x.shape[1]):
        for b, c in enumerate(cuts[j]):
            go = x[:, j] <= c
            hl, hr = h[go].sum(), h[~go].sum()
            if hl < rules.least_hessian or hr < rules.least_hessian:
                continue
            gain = g[go].sum() ** 2 / (hl + rules.l2) + g[~go].sum() ** 2 / (hr + rules.l2) - g.sum() ** 2 / (h.sum() + rules.l2)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-7):
                best = (gain, j, c)
    return best


def plain_boost(x, y, w, rules):
    """Margins of the same trees, without bins, sums by task or whole units."""
    cuts = [np.unique(c)[:-1] for c in x.T]
    w = w / w.mean()
    margin = np.full(len(x), np.log((w * y).sum() / (w * (1 - y)).sum()))
    sizes = []
    for _ in range(rules.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        leaves = [np.arange(len(x))]
        if rules.growth == "level":
            for _ in range(rules.depth):
                after = []
                for rows in leaves:
                    s = plain_split(x[rows], g[rows], h[rows], rules, cuts)
                    after += [rows] if s is None else [rows[x[rows, s[1]] <= s[2]], rows[x[rows, s[1]] > s[2]]]
                leaves = after
        else:
            splits = [plain_split(x[r], g[r], h[r], rules, cuts) for r in leaves]
            while len(leaves) < rules.leaves and any(splits):
                i = max((k for k in range(len(leaves)) if splits[k]), key=lambda k: splits[k][0])
                rows, s = leaves.pop(i), splits.pop(i)
                for part in (rows[x[rows, s[1]] <= s[2]], rows[x[rows, s[1]] > s[2]]):
                    leaves.append(part)
                    splits.append(plain_split(x[part], g[part], h[part], rules, cuts))
        sizes.append(len(leaves))
        for rows in leaves:
            margin[rows] -= rules.rate * g[rows].sum() / (h[rows].sum() + rules.l2)
    return margin, sizes


@pytest.mark.parametrize("growth", ["level", "leaf"])
def test_equal_to_plain_trees(spark, growth):
    x, y = data(60)
    x = np.round(x, 1)
    w = np.where(y == 1, 2.0, 1.0)
    rules = B.Rules(growth, 3, 0.3, depth=3, leaves=7, **ALL)
    model = B.HistogramBooster(rules).fit(frame(spark, x, y, w))
    margin, sizes = plain_boost(x, y, w, rules)
    assert np.allclose(scores(model, frame(spark, x, y)), 1 / (1 + np.exp(-margin)), atol=1e-5)
    assert [len(t.left) // 2 + 1 for t in model.trees] == sizes


@pytest.mark.parametrize("make", [B.level_wise, B.leaf_wise, B.ordered])
def test_learns_as_well_as_first_order_boosting(spark, make):
    x, y = data(1200)
    df = frame(spark, x, y, np.where(y == 1, 3.0, 1.0))
    train, test = df.filter("id % 4 > 0").cache(), df.filter("id % 4 = 0").cache()
    judge = BinaryClassificationEvaluator(rawPredictionCol="probability")
    model = make(12, rate=0.3, depth=4, leaves=12).fit(train)
    theirs = judge.evaluate(C.GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, weightCol="weight", seed=1).fit(train).transform(test))
    assert judge.evaluate(model.transform(test)) > theirs - 0.03
    codes, labels = np.array([r["features"].toArray() for r in train.select("features", "label").collect()]), np.array([r["label"] for r in train.select("features", "label").collect()])
    w, lost = np.where(labels == 1, 3.0, 1.0), []
    for k in range(len(model.trees) + 1):
        m = B.BoostedTrees(model.cuts, model.base, model.trees[:k]).margins(codes)
        lost.append(float((w * (np.log1p(np.exp(m)) - labels * m)).sum()))
    assert lost[-1] < 0.85 * lost[0] and all(b < a for a, b in zip(lost, lost[1:]))
    assert all(len(t.left) // 2 + 1 <= (12 if make is B.leaf_wise else 16) for t in model.trees)


def test_number_of_tasks_changes_nothing(spark):
    x, y = data(200)
    for growth in ("level", "leaf"):
        rules = B.Rules(growth, 11, 0.3, depth=2, leaves=4, **ALL)  # more trees than are added up at once
        one, many = (scores(B.HistogramBooster(rules).fit(frame(spark, x, y, parts=p)), frame(spark, x, y)) for p in (1, 4))
        assert np.array_equal(one, many)


def test_symmetric_trees_split_all_leaves_alike(spark):
    x, y = data(300)
    model = B.ordered(3, depth=3, rate=0.3).fit(frame(spark, x, y))
    for t in model.trees:
        level = [0]
        while t.left[level[0]] >= 0:
            assert len({(t.feature[n], t.bin[n]) for n in level}) == 1
            level = [c for n in level for c in (t.left[n], t.left[n] + 1)]
        assert all(t.left[n] < 0 for n in level) and t.value.shape[1] == 12


def test_ordered_rows_are_scored_by_models_without_them():
    rules = B.Rules("symmetric", prefixes=4)
    ids = np.arange(4000)
    u, last = B.mixed(ids, rules.seed), B.prefix_of(ids, rules)
    for m in range(1, 5):  # what model m learns from lies before 2**-m, what it scores does not
        assert (u[last > m] < 2.0**-m).all() and (u[last == m] >= 2.0**-m).all()
    assert last.min() == 1 and last.max() == 5 and abs((last == 1).mean() - 0.5) < 0.05


def test_odd_tables(spark):
    x, y = data(40)
    ones = B.level_wise(2).fit(frame(spark, x, np.ones(40)))
    assert scores(ones, frame(spark, x, y)).min() > 0.99
    constant = B.leaf_wise(2, **ALL).fit(frame(spark, np.zeros((40, 2)), y))
    assert not constant.trees and np.allclose(scores(constant, frame(spark, np.zeros((40, 2)), y)), y.mean())
    x[::3, 0] = np.nan
    model = B.level_wise(2, least_hessian=0.1).fit(frame(spark, x, y))
    assert np.isfinite(scores(model, frame(spark, x, y))).all()
    empty = B.level_wise(2).fit(frame(spark, x, y).filter("id < 0"))
    assert not empty.trees
