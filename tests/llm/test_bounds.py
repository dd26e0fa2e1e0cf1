"""Likeness of fingerprints, vectors of several lengths, and the bound of labelled samples."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import ann, fingerprint
from tessera.llm.labelled import labelled_sample


def words(r, n):
    return " ".join(f"w{r.randrange(500)}" for _ in range(n))


def test_one_word_more_leaves_the_likeness(spark):
    r = random.Random(1)
    base = words(r, 300)
    texts = [base, "new " + base, words(r, 300), base[:700] + " new " + base[701:]]
    got = {x["doc_id"]: x for x in fingerprint.op1_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got[0]["near_next"] > 0.9 and got[1]["near_next"] < 0.4 and got[2]["near_next"] < 0.4 and got[3]["near_next"] > 0.9


def test_likeness_follows_the_shared_part(spark):
    """Against the exact share of runs, which brute force counts."""
    r = random.Random(2)
    lines = [words(r, 12) for _ in range(80)]
    docs = [(i, "\n".join(lines[: 80 - 8 * i] + [words(r, 12) for _ in range(8 * i)])) for i in range(10)]
    states = {x["doc_id"]: np.frombuffer(bytes(x["state"])[2 * fingerprint.EQUAL_LANES :], np.int32) for x in fingerprint.fingerprints(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    for i in range(10):
        near = fingerprint.likeness(states[0][None], states[i][None])[0]
        assert abs(near - (1 - i / 10)) < 0.15


def test_vectors_meet_their_own_length(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=4).tolist()) for i in range(60)] + [(100 + i, r.normal(size=3).tolist()) for i in range(50)] + [(50, r.normal(size=4).tolist())]
    got = {}
    for x in ann.op5_nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("label", F.lit(1))).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    assert set(got) == {0, 50, 100} and all(len(v) == 5 for v in got.values())
    for q, found in got.items():
        own = [np.array(v) for i, v in rows if i == q]
        best = {}
        for i, v in rows:
            if i != q:
                for o in own:
                    if len(v) == len(o):
                        best[i] = max(best.get(i, -2), float(np.dot(o, v) / np.linalg.norm(o) / np.linalg.norm(v)))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [i for _, i, _ in sorted(found)] == [i for i, _ in want] and np.allclose([s for *_, s in sorted(found)], [s for _, s in want])


def test_a_sample_of_one_has_one_row(spark):
    docs = spark.createDataFrame([(1, f"t{i:04}") for i in range(1000)] + [(2, "x")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1)], "doc_id bigint, y int")
    got = labelled_sample(docs, labels, "y", F.lit(True), {0: 1, 1: 5}).collect()
    assert sorted((r["doc_id"], r["text"], r["label"]) for r in got) == [(1, "t0000", 1), (2, "x", 0)]
