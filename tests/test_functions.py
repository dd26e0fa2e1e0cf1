import pytest
from pyspark.sql import functions as F

from tessera.functions import bits, columns, running
from tessera.functions.running import ranked, running_sums


def test_keys_are_cleaned(spark):
    rows = [(" x ",), ("",), ("nan",), ("None",), ("NaN",), ("\tb\n",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "k string").select(columns.clean_key(F.col("k"))).collect()]
    assert got == ["x", None, None, None, "NaN", "b", None]


def test_numbers_and_bits(spark):
    rows = [(" 1 ",), ("True",), ("0.5",), ("0.6",), ("-3",), ("NaN",), (None,)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "k string").select(columns.to_number(F.col("k")), columns.to_bit(F.col("k"))).collect()]
    assert got == [(1.0, 1), (None, 0), (0.5, 0), (0.6, 1), (-3.0, 0), (None, 0), (None, 0)]


def test_columns_are_chosen(spark):
    df = spark.createDataFrame([(1, 2.0, "a", 3)], "label int, f1 double, smiles string, _x int")
    assert columns.numeric_features(df) == ["f1", "_x"]
    assert columns.without_internal(df).columns == ["label", "f1", "smiles"]
    assert columns.keep_present(df, ["smiles", "gone", "label"]).columns == ["smiles", "label"]
    assert columns.with_prefix(df, "f") == ["f1"]
    assert columns.first_of(df, columns.STRUCTURE_COLUMNS) == "smiles"
    assert columns.split_list(" a, ,b ") == ["a", "b"]
    with pytest.raises(columns.MissingColumns):
        columns.require(df, ["label", "gone"])
    with pytest.raises(columns.EmptyInput):
        columns.require_rows(df.limit(0), "x")


def test_dense_fingerprints_do_not_overflow(spark):
    df = spark.createDataFrame([(1, [1] * 300 + [0] * 1748), (2, [0] * 2048)], "id int, b array<int>").withColumn("w", bits.pack(F.col("b")))
    a, b = df.filter("id = 1").first()["w"], df.filter("id = 2").first()["w"]
    both = spark.createDataFrame([(a, a), (a, b), (b, b)], "x array<bigint>, y array<bigint>")
    got = both.select(bits.tanimoto(F.col("x"), F.col("y"), bits.ones(F.col("x")), bits.ones(F.col("y")))).collect()
    assert [r[0] for r in got] == [1.0, 0.0, 0.0]
    assert df.select(bits.unpack(F.col("w"), 2048).alias("u"), "b").filter("u <> b").count() == 0


def test_running_sums_match_one_window(spark):
    rows = [(i % 2, (i * 37 % 101) / 10 - 5 if i % 9 else None, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, s double, id int")
    got = {r["id"]: r["rank"] for r in ranked(df, ["g"], "s", "id").collect()}
    for g in (0, 1):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [got[r[2]] for r in order] == list(range(1, len(order) + 1))
    up = {r["id"]: r["t"] for r in running_sums(df, ["g"], "s", {"t": "id"}, ties=["id"]).collect()}
    order = sorted((r for r in rows if r[0] == 1), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
    total = 0
    for r in order:
        total += r[2]
        assert up[r[2]] == total


def test_min_max_of_constant_is_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0)], "g string, s double")
    assert sorted(r["x"] for r in columns.min_max(df, "s", ["g"], "x").collect()) == [0.0, 0.0, 0.0, 1.0]


def test_min_max_ignores_nan(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", 3.0), (None, 5.0), (None, None), (None, 6.0)], "g string, s double")
    got = {(r["g"], repr(r["s"])): r["x"] for r in columns.min_max(df, "s", ["g"], "x").collect()}
    assert got["a", "1.0"] == 0 and got["a", "3.0"] == 1 and got["a", "nan"] != got["a", "nan"] and got[None, "6.0"] == 1 and got[None, "5.0"] == 0 and got[None, "None"] is None and len(got) == 6


@pytest.mark.parametrize("score", ["id * 1e-9", "id * 1000.0", "0.25", "CASE WHEN id % 3 = 0 THEN 0.0 ELSE id * 1.0 END"])
def test_no_range_holds_much_more_than_its_share(spark, score):
    """Narrow, wide, tied and skewed scores: rows of a range, as running_sums deals them, and the ranks."""
    df = spark.range(20000, numPartitions=4).selectExpr("id", f"CAST({score} AS DOUBLE) AS s")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(8, F.desc_nulls_last("s"), "id", "_row")
        held = [r["n"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert max(held) <= 2 * 20000 / 8
        got = sorted((r["rank"], r["id"], r["s"]) for r in ranked(df, [], "s", "id").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [g[0] for g in got] == list(range(1, 20001)) and [g[1] for g in got] == [i for _, i in sorted((-s, i) for _, i, s in got)]


def test_running_sums_deal_more_tasks_to_more_rows(spark, monkeypatch):
    monkeypatch.setattr(running, "RANGE_ROWS", 50)
    df = spark.range(2000).select("id", (F.col("id") % 3 > 0).alias("g"), (F.col("id") % 7).alias("s"), F.lit(1).alias("one"))
    got = running.ranked(df, ["g"], "s", "id").withColumn("task", F.spark_partition_id()).collect()
    for g in (False, True):
        rows = sorted((r for r in got if r["g"] == g), key=lambda r: (-r["s"], r["id"]))
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    tasks = [r["task"] for r in got]
    assert len(got) == 2000 and max(map(tasks.count, set(tasks))) < 400  # four tasks would have 500 each
