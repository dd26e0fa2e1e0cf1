"""Operator 7 - toxicity: a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

N-grams of ``SIZES`` characters (lower case, any white space as a space) are hashed to ``BUCKETS`` and count once for a
document. On at most ``SAMPLE`` labelled rows of each label the log ratio of an n-gram's share of toxic and of clean
documents is taken, smoothed towards no difference; it is signed: n-grams may speak for either. The ``FEATURES`` with the
largest size of it, weighted by the root of how many documents have them, are kept. A logistic regression with a ridge
penalty is fitted on features scaled by their ratios, with rows weighted so that the labels have their shares among all
training rows, a toxic one ``TOXIC_WEIGHT`` times.

Counts are summed by bucket on the executors; the regression is fitted in one task, which holds FEATURES numbers a row of
the sample. The bounds on labelled rows are the only sample; every document is scored on its whole text (a very long one
alone in its slice). A null or empty text has the score of no n-gram at all. Without labelled rows of both kinds the score
is 0.5. Repeated rows stay, an empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.blocks import U, slices
from tessera.llm.common import Scratch, map_arrow, split_fold, with_texts
from tessera.llm.labelled import fitted, label_counts, labelled_sample

SIZES = (5, 6, 7)
BITS = 20
BUCKETS = 1 << BITS
SAMPLE = {0: 2000, 1: 1000}
FEATURES = 4096
SMOOTHING = 3.0
RIDGE = 1e-3
TOXIC_WEIGHT = 3
STEPS = 200
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
FACTOR = U(0x9E3779B97F4A7C15)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Document and bucket of every n-gram, for each size."""
    texts = [t.lower() for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((codes == 32) | (codes >= 9) & (codes <= 13), 32, codes).astype(U)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    h = codes.copy()
    for n in range(2, max(SIZES) + 1):
        if len(codes) < n:
            return
        h = h[:-1] * FACTOR + codes[n - 1 :]
        if n in SIZES:
            whole = owner[: len(h)] == owner[n - 1 :]
            mixed = (h ^ (h >> U(32))) * U(0xBF58476D1CE4E5B9 + 2 * n)
            yield owner[: len(h)][whole], (mixed >> U(64 - BITS)).astype(np.int32)[whole]


class Linear:
    """Which feature a bucket is (-1: none), the features' weights, and the intercept.

    chosen are the features' buckets, ratio their log ratios, rows those of the sample: the features of each.
    """

    def __init__(self, chosen: np.ndarray, ratio: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, totals: dict[int, int]):
        k = len(chosen)
        self.place, self.weights, self.intercept = places(chosen), np.zeros(k), 0.0
        ones, n = int(labels.sum()), len(labels)
        if not 0 < ones < n:
            return
        x = np.zeros((n, k + 1), np.float32)
        for i, own in enumerate(rows):
            x[i, own] = 1
        x[:, :k] *= ratio
        x[:, k] = 1
        weight = np.where(labels == 1, TOXIC_WEIGHT * totals[1] / ones, totals[0] / (n - ones))
        weight = (weight / weight.sum()).astype(np.float32)
        # Accelerated gradient steps; the step length is from the largest curvature.
        v = np.ones(k + 1, np.float32)
        for _ in range(20):
            v = x.T @ (weight * (x @ v))
            top = np.linalg.norm(v)
            v /= top
        rate = 1 / (0.25 * 1.05 * top + RIDGE)
        now = before = np.zeros(k + 1, np.float32)
        for step in range(STEPS):
            ahead = now + np.float32(step / (step + 3)) * (now - before)
            error = weight * (1 / (1 + np.exp(-(x @ ahead))) - labels)
            before, now = now, ahead - np.float32(rate) * (x.T @ error.astype(np.float32) + np.float32(RIDGE) * np.append(ahead[:-1], np.float32(0)))
        self.weights, self.intercept = (now[:-1] * ratio).astype(np.float64), float(now[-1])

    def score(self, texts: list[str]) -> np.ndarray:
        seen = []
        for doc, bucket in grams(texts):
            at = self.place[bucket]
            hit = at >= 0
            seen.append(doc[hit].astype(np.int64) * len(self.weights) + at[hit])
        seen = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
        k = max(len(self.weights), 1)
        z = self.intercept + np.bincount(seen // k, self.weights[seen % k] if len(seen) else None, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def places(chosen: np.ndarray) -> np.ndarray:
    out = np.full(BUCKETS, -1, np.int32)
    out[chosen] = np.arange(len(chosen))
    return out


def own_buckets(text: str) -> np.ndarray:
    found = [b for _, b in grams([text])]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def gram_counts(rows: DataFrame) -> DataFrame:
    """bucket, toxic, clean: in how many rows (label, text) of either label it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int32)
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text"), strict=True):
                counts[label, own_buckets(text.as_py())] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (at, counts[1, at], counts[0, at])], names=["bucket", "toxic", "clean"])

    parts = rows.select("label", "text").mapInArrow(run, "bucket bigint, toxic bigint, clean bigint")
    return parts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Linear:
    train = split_fold(F.col("doc_id"), FOLDS) != HELD_OUT
    rows = labelled_sample(docs, labels.filter(F.col("toxic").isin(0, 1)), "toxic", train, sample)
    rows = Scratch(docs.sparkSession).keep(rows.select("doc_id", F.col("label").cast("int").alias("label"), "text"))
    ones, n = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    totals = label_counts(labels, "toxic", train)
    none = np.zeros(0, np.int64)
    if not 0 < ones < n:
        return Linear(none, none, [], none, totals)
    log_share = lambda c, share, m: F.log((F.col(c) + SMOOTHING * share) / (m + SMOOTHING))
    ratio = log_share("toxic", ones / n, ones) - log_share("clean", 1 - ones / n, n - ones)
    weighed = gram_counts(rows).withColumn("ratio", ratio)
    found = weighed.orderBy(F.desc(F.abs("ratio") * F.sqrt(F.col("toxic") + F.col("clean"))), "bucket").limit(FEATURES).select("bucket", "ratio").collect()
    chosen, ratios = np.array([r[0] for r in found]), np.array([r[1] for r in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = places(chosen)
        for batch in batches:
            at = [place[own_buckets(t.as_py())] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([a[a >= 0].tobytes() for a in at], pa.binary())], names=["doc_id", "label", "features"])

    made = lambda held: Linear(chosen, ratios, [np.frombuffer(r["features"], np.int32) for r in held], np.array([r["label"] for r in held], np.int64), totals)
    return fitted(rows.mapInArrow(run, "doc_id bigint, label int, features binary"), made)


def score(docs: DataFrame, model: Linear) -> DataFrame:
    """doc_id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.score(part.column("text").to_pylist()))], names=["doc_id", "score"])

    return map_arrow(with_texts(docs), ["doc_id", "text"], "doc_id bigint, score double", run)


def op7_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (split_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
