"""Operator 3 - quality classifier by nearest-neighbour voting in a latent semantic space.

Terms of a text are its words, runs of four character classes (letters of one case are alike, marks are themselves) and
one for words that repeat the word before, all hashed to ``DIMENSIONS`` columns and weighted by log counts and inverse
document frequency. A truncated singular value decomposition of at most ``SAMPLE`` labelled documents gives the latent
space. Their vectors and labels are broadcast (a size fixed by parameters), and every document's cosine to each of them
is computed in blocks; the ``NEIGHBOURS`` nearest vote with the ``POWER``-th power of their similarity as weight.

The bound on labelled rows is the only sample; every document is scored on its whole text. A null or empty text is near
to none and gets the share of label 1 in the sample, as does every document if no row is labelled (0.5 then). Rows are
scored one by one: repeated rows stay. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.blocks import LOWER, SPACE, U, block, mix, prefix, slices, span_hash, words
from tessera.llm.common import map_arrow, split_fold
from tessera.llm.labelled import fitted, labelled_sample

WORD_TERMS = 2048
CLASS_TERMS = 2048
DIMENSIONS = WORD_TERMS + CLASS_TERMS + 1
REPEAT_WEIGHT = 8
SAMPLE = 4000
RANK = 64
NEIGHBOURS = 15
POWER = 8
PRIOR = 0.5
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Bytes of text hashed at once; arrays of some 80 bytes a byte are made of them.
SLICE = 1 << 18

CLASS = np.arange(256, dtype=U)
CLASS[ord("a") : ord("z") + 1] = 1
CLASS[ord("A") : ord("Z") + 1] = 2
CLASS[ord("0") : ord("9") + 1] = 3
CLASS[128:] = 1
CLASS[SPACE] = 32


def term_counts(texts: pa.Array) -> np.ndarray:
    """A row of term counts for each text."""
    data, offsets = block(texts)
    n = len(offsets) - 1
    out = np.zeros(n * DIMENSIONS, np.float32)
    start, end, doc = words(data, offsets)
    if len(start):
        h = span_hash(prefix(LOWER[data]), start, end)
        out += np.bincount(doc * DIMENSIONS + (h % U(WORD_TERMS)).astype(np.int64), minlength=len(out))
        again = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        out += REPEAT_WEIGHT * np.bincount((doc[1:][again] + 1) * DIMENSIONS - 1, minlength=len(out))
    if len(data) > 3:
        kind, m = CLASS[data], len(data) - 3
        run = mix(kind[:m] | kind[1 : m + 1] << U(8) | kind[2 : m + 2] << U(16) | kind[3:] << U(24))
        owner = np.repeat(np.arange(n), np.diff(offsets))
        whole = owner[:m] == owner[3:]
        out += np.bincount(owner[:m][whole] * DIMENSIONS + WORD_TERMS + (run[whole] % U(CLASS_TERMS)).astype(np.int64), minlength=len(out))
    return out.reshape(n, DIMENSIONS)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Voter:
    """The fitted space with the labelled vectors."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        """counts is overwritten."""
        self.labels = labels.astype(np.float64)
        self.base = float(self.labels.mean()) if len(labels) else 0.5
        self.weight = (np.log((1 + len(labels)) / (1 + (counts > 0).sum(axis=0))) + 0.2).astype(np.float32)
        a = np.log1p(counts, out=counts)  # in place: the task that fits has no room for copies
        a *= self.weight
        a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
        rank = min(RANK, len(labels))
        # Subspace iteration: the sample is bounded, and so is this.
        q = a @ np.random.default_rng(0).standard_normal((DIMENSIONS, rank + 8)).astype(np.float32)
        for _ in range(3):
            q = a @ (a.T @ np.linalg.qr(q)[0])
        q = np.linalg.qr(q)[0]
        self.axes = np.linalg.svd(q.T @ a, full_matrices=False)[2][:rank].T.copy() if len(labels) else np.zeros((DIMENSIONS, 0), np.float32)
        self.vectors = unit(a @ self.axes)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.base)
        near = unit((np.log1p(counts) * self.weight) @ self.axes) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** POWER
        return ((votes * self.labels[best]).sum(axis=1) + PRIOR * self.base) / (votes.sum(axis=1) + PRIOR)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Voter:
    """Learn from labelled rows of the training folds, at most sample of them in the shares of the labels."""
    train = split_fold(F.col("doc_id"), FOLDS) != HELD_OUT
    known = labels.filter(F.col("quality").isin(0, 1) & train)
    share = known.agg(F.avg("quality"), F.count(F.lit(1))).first()
    ones = round((share[0] or 0.0) * sample)
    rows = labelled_sample(docs, labels, "quality", train, {0: sample - ones, 1: ones})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                terms = []
                for row in term_counts(part.column("text")):
                    at = np.flatnonzero(row)
                    terms.append(np.concatenate([at.astype(np.float32), row[at]]).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(terms, pa.binary())], names=["doc_id", "label", "terms"])

    def made(found: list[dict]) -> Voter:
        counts = np.zeros((len(found), DIMENSIONS), np.float32)
        for i, r in enumerate(found):
            pairs = np.frombuffer(r["terms"], np.float32).reshape(2, -1)
            counts[i, pairs[0].astype(np.int64)] = pairs[1]
        return Voter(counts, np.array([r["label"] for r in found]))

    return fitted(map_arrow(rows, ["doc_id", F.col("label").cast("int").alias("label"), "text"], "doc_id bigint, label int, terms binary", run), made)


def score(docs: DataFrame, voter: Voter, whole: bool = False) -> DataFrame:
    """doc_id and score of every document; if whole, its columns by number (c0, c1 and so on) and score."""
    shared = docs.sparkSession.sparkContext.broadcast(voter)
    kept = docs if whole else docs.select("doc_id", "text")
    at, names = kept.columns.index("text"), [f"c{i}" for i in range(len(kept.columns))]
    given = kept.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, names[at], SLICE):
                scores = pa.array(own.score(term_counts(part.column(at))))
                yield pa.RecordBatch.from_arrays([*part.columns, scores] if whole else [part.column(0), scores], names=[*names, "score"] if whole else ["doc_id", "score"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in given.schema) if whole else "doc_id bigint, "
    return given.mapInArrow(run, kinds + "score double")


def op3_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (split_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
