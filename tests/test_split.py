from hypothesis import given, settings, strategies as st

from tessera.operators import split


def test_allocation_is_greedy_in_the_order_of_names():
    assert split.allocate(12, {"a": 2, "b": 10, "c": 10}) == {"a": 2, "b": 6, "c": 4}
    assert split.allocate(12, {"a": 2, "b": 10, "c": 10}, mode="waterfill") == {"a": 2, "b": 5, "c": 5}
    assert split.allocate(100, {"a": 2, "b": 3}) == {"a": 2, "b": 3}
    assert split.allocate(9, {"a": 5, "b": 5, "c": 5}, cap=2) == {"a": 2, "b": 2, "c": 2}
    assert split.allocate(0, {"a": 2}) == {"a": 0}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 60), st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 20), min_size=1), st.sampled_from(["greedy", "waterfill"]))
def test_allocation_gives_what_there_is(total, available, mode):
    got = split.allocate(total, available, mode=mode)
    assert all(0 <= got[n] <= available[n] for n in available)
    assert sum(got.values()) == min(total, sum(available.values()))


def test_positives_round_half_to_even():
    assert [split.test_positives(n, 0.2) for n in (1, 2, 3, 10, 12)] == [1, 1, 1, 2, 2]
    assert split.test_positives(25, 0.1) == 2 and split.test_positives(35, 0.1) == 4


def test_split_is_a_partition(spark):
    rows = [(i, f"d{i % 4}", 1 if i % 5 == 0 else 0) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id int, domain string, label int")
    test, train, report = split.quota_split(df, "label", "domain", ["d1", "d2"], "row_id")
    a, b = {r["row_id"] for r in test.collect()}, {r["row_id"] for r in train.collect()}
    assert not a & b and a | b == {r[0] for r in rows}
    assert report["n_test_pos"] == 8 and report["n_test_neg"] == len(a) - 8
    assert all(r[1] in ("d1", "d2") or r[2] for r in rows if r[0] in a)


def test_folds_are_even(spark):
    df = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(103)], "id int, y int")
    counts = split.stratified_folds(df, "y", "id").groupBy("y", "fold").count().collect()
    for y in (0, 1):
        c = [r["count"] for r in counts if r["y"] == y]
        assert len(c) == 5 and max(c) - min(c) <= 1
