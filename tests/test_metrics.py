import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import running
from tessera.operators import hardness, ingest, metrics, similarity
from tessera.sources.shared import written


def brute(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, tp, seen = 0.0, 0, 0
    for s in sorted({s for _, s in rows}, reverse=True):
        p, k = sum(1 for y, x in rows if x == s and y), sum(1 for _, x in rows if x == s)
        tp, seen = tp + p, seen + k
        ap += p / len(pos) * tp / seen
    return auc, ap


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    return [(i, int(r.random() < 0.3), round(r.random(), 1)) for i in range(120)]


def test_areas(spark, rows):
    df = spark.createDataFrame(rows, "id int, y int, s double")
    auc, ap = brute([r[1:] for r in rows])
    assert metrics.roc_auc(df).first()[0] == pytest.approx(auc)
    assert metrics.average_precision(df).first()[0] == pytest.approx(ap)
    assert metrics.roc_auc(df.selectExpr("id", "y", "-s as s")).first()[0] == pytest.approx(1 - auc)
    assert metrics.roc_auc(df.filter("y = 1")).first()[0] is None


def test_early_enrichment(spark, rows):
    df = spark.createDataFrame(rows, "id int, y int, s double")
    got = metrics.early_enrichment(df).first()
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    n, k = len(rows), sum(r[1] for r in rows)
    top = max(1, math.ceil(n * 0.05))
    assert got["ef_5pct"] == pytest.approx(sum(r[1] for r in order[:top]) / top / (k / n))
    w = [math.exp(-20 * (i + 1) / n) for i in range(n)]
    have = sum(x for x, r in zip(w, order, strict=True) if r[1])
    assert got["bedroc_20"] == pytest.approx((have - sum(w[-k:])) / (sum(w[:k]) - sum(w[-k:])))
    assert 0 <= got["bedroc_80"] <= 1
    none = metrics.early_enrichment(df.filter("y = 0")).first()
    assert none["bedroc_20"] is None and none["ef_1pct"] is None
    assert metrics.early_enrichment(df.filter("y = 1")).first()["bedroc_20"] == 1.0


def test_threshold_outside_unit_interval(spark):
    df = spark.createDataFrame([(1, 3.0), (0, -1.0), (1, 1.0), (0, 2.0)], "y int, s double")
    got = metrics.threshold_metrics(df).first()
    scaled = [(1, 1.0), (0, 0.0), (1, 0.5), (0, 0.75)]
    assert got["brier"] == pytest.approx(sum((s - y) ** 2 for y, s in scaled) / 4)
    assert (got["precision"], got["recall"]) == (pytest.approx(2 / 3), 1.0)


def test_bootstrap_bounds_hold_the_value(spark, rows):
    df = spark.createDataFrame(rows, "id int, y int, s double")
    got = metrics.bootstrap(df, times=40, batch=7).first()
    assert got["roc_auc_lo"] <= got["roc_auc"] <= got["roc_auc_hi"] and got["ap_lo"] < got["ap_hi"]


@pytest.mark.parametrize("block", [7, 20_000])
def test_bootstrap_by_counts_has_the_law_of_drawn_rows(spark, rows, block):
    import numpy as np

    got = metrics.bootstrap_blocks(spark.createDataFrame(rows, "id int, y int, s double"), times=1500, block_scores=block).first()
    rng, classes = np.random.default_rng(0), [np.array([r[2] for r in rows if r[1] == k]) for k in (0, 1)]
    areas = []
    for _ in range(1500):
        neg, pos = (rng.choice(c, len(c)) for c in classes)
        areas.append(((pos[:, None] > neg).mean() + (pos[:, None] >= neg).mean()) / 2)
    want = np.quantile(areas, [0.025, 0.975])
    assert [got["roc_auc_lo"], got["roc_auc_hi"], got["auc_boot_mean"]] == pytest.approx([*want, np.mean(areas)], abs=0.02)
    drawn = metrics.bootstrap(spark.createDataFrame(rows, "id int, y int, s double"), times=400).first()
    assert (got["roc_auc"], got["ap"]) == pytest.approx((drawn["roc_auc"], drawn["ap"]))
    assert [got["ap_lo"], got["ap_hi"]] == pytest.approx([drawn["ap_lo"], drawn["ap_hi"]], abs=0.06)


def test_bootstrap_by_counts_of_plain_groups(spark):
    data = [("apart", k % 2, float(k % 2 * 100 + k)) for k in range(40)] + [(None, k % 4 // 3, 1.0) for k in range(40)] + [("one", 1, float(k)) for k in range(5)]
    found = {r["g"]: r for r in metrics.bootstrap_blocks(spark.createDataFrame(data, "g string, y int, s double").withColumn("g", F.coalesce("g", F.lit("tied"))), ["g"], times=50, block_scores=3).collect()}
    assert (found["apart"]["roc_auc_lo"], found["apart"]["ap_hi"]) == (1.0, 1.0)
    assert (found["tied"]["roc_auc_lo"], found["tied"]["roc_auc_hi"], found["tied"]["ap_lo"]) == (0.5, 0.5, 0.25)
    assert found["one"]["roc_auc_lo"] is None and found["one"]["ap_lo"] == 1.0


def test_largest_similarity_equals_all_pairs(spark):
    import random

    r = random.Random(5)
    words = [(i, None if i == 3 else [r.getrandbits(20) & r.getrandbits(20) if i % 7 else 0, r.getrandbits(r.choice([3, 30]))]) for i in range(150)]
    ask, ref = words, [w for w in words if w[0] % 3 == 0]
    df = spark.createDataFrame(words, "id int, w array<bigint>")
    got = {x["id"]: x["max_tanimoto"] for x in similarity.max_tanimoto(df, df.filter("id % 3 = 0"), "id", "w").collect()}

    def like(a, b):
        both = sum((x & y).bit_count() for x, y in zip(a, b))
        return both / max(1, sum(x.bit_count() for x in (*a, *b)) - both)

    assert got == {i: 0.0 if a is None else max(like(a, b) for _, b in ref if b is not None) for i, a in ask}


def test_weights():
    assert metrics.normal_weights(2, [3, 1]) == [0.75, 0.25]
    assert metrics.normal_weights(2, [-1, 0]) == [0.5, 0.5]
    with pytest.raises(ValueError):
        metrics.normal_weights(2, [1])


def test_entropy(spark):
    df = spark.createDataFrame([("a", "x")] * 5 + [("a", "y")] * 5 + [("b", "x")] * 10, "c string, s string")
    assert {r["c"]: r["entropy"] for r in hardness.source_entropy(df, "c", "s").collect()} == {"a": pytest.approx(1.0), "b": 0.0}


def test_best_row(spark):
    df = spark.createDataFrame([(1, "k", None, "a"), (2, "k", "b", "c"), (3, "k", "d", "e"), (4, None, None, None), (5, None, "x", None)], "id int, key string, p string, q string")
    assert sorted(r["id"] for r in ingest.best_row(df, "key", ["p", "q"], ["id"]).collect()) == [2, 4, 5]


def test_similarity_to_nothing_is_zero(spark):
    df = spark.createDataFrame([(1, [7])], "id int, w array<bigint>")
    assert similarity.max_tanimoto(df, df.limit(0), "id", "w").first()["max_tanimoto"] == 0.0
    assert similarity.max_tanimoto(df, df, "id", "w").first()["max_tanimoto"] == 1.0


def test_weights_text_rounds_as_sql(spark):
    """Halves: 0.03125 is exact (to even), 0.12345 and 0.00135 are not."""
    r = random.Random(11)
    values = [k / 32 for k in range(33)] + [0.12345, 0.00135, 5e-5, 0.0, 1e-300] + [(2 * r.randrange(10_000) + 1) / 20_000 for _ in range(500)] + [r.random() for _ in range(500)]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", metrics.weights_text([F.col("x"), 0.03125])).collect()
    assert [g[1] for g in got] == [f"{g[0]:.4f},0.0312" for g in got]


def test_nearest_rows_by_products():
    """Far from the origin, where products lose digits: the same rows and distances as by differences, and ties by id."""
    rng = np.random.default_rng(4)
    q, r = rng.integers(0, 3, (50, 6)) * 1e-3 + 1e4, rng.integers(0, 3, (300, 6)) * 1e-3 + 1e4
    own, ids = np.arange(50), rng.permutation(300)
    got = list(zip(*similarity.nearest_rows(q, own, r, ids, 5)))
    want = []
    for i in range(50):
        gaps = ((q[i] - r) ** 2).sum(axis=1)
        want += [(i, j, gaps[j]) for j in sorted((j for j in range(300) if ids[j] != own[i]), key=lambda j: (gaps[j], ids[j]))[:5]]
    assert got == want


def test_bootstrap_makes_its_draws_once(spark, monkeypatch):
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().analyzed().toString())
        return written(df)

    monkeypatch.setattr(metrics, "written", noted)
    monkeypatch.setattr(running, "written", noted)
    df = spark.range(60).select("id", (F.col("id") % 2).alias("y"), (F.col("id") % 7 / 7.0).alias("s"))
    assert metrics.bootstrap(df, times=20).count() == 1
    assert sum("explode(sequence(" in p for p in plans) == 1
