"""Operator 1 - document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (line) is hashed to a wide vector, and a document's state is the sum of its paragraphs' vectors. So the order
of paragraphs doesn't matter, and a paragraph is added or taken away by adding or subtracting its vector. The vector has
two parts: ``EQUAL_LANES`` lanes modulo 2**16 of an extendable hash of the whole paragraph, which tell unequal multisets
apart, and ``LIKE_LANES`` lanes modulo 2**32 that sum random signs of the paragraph's runs of some ``RUN_WORDS`` words (cut by content), whose
inner products estimate how much two documents share. The fingerprint is a digest of the state.

The neighbour in the order of doc_id is met without one global sort: rows are dealt to ranges of doc_id, each range gets
a copy of the row that follows it, and a task walks its ranges in order.

Texts are taken whole; a very long one needs some 40 bytes of memory a byte. Null text is empty; the empty text's state is zero. Null doc_ids come first, equal doc_ids are ordered by text. A lone
document follows itself. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from tessera.llm.blocks import U, block, mix, prefix, slices, span_hash, words
from tessera.llm.common import map_arrow, with_texts

EQUAL_LANES = 1024
LIKE_LANES = 256
RUN_WORDS = 4
SIGN_KEYS = mix(np.arange(1, LIKE_LANES // 64 + 1, dtype=U) * U(0xA24BAED4963EE407))


def equal_part(paragraphs: list[bytes]) -> np.ndarray:
    raw = b"".join(hashlib.shake_128(p).digest(2 * EQUAL_LANES) for p in paragraphs)
    return np.frombuffer(raw, np.uint16).reshape(-1, EQUAL_LANES).sum(axis=0, dtype=np.uint16)


def states(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two parts of each text's state."""
    equal = np.array([equal_part(t.split(b"\n")) if t else np.zeros(EQUAL_LANES, np.uint16) for t in texts], np.uint16).reshape(-1, EQUAL_LANES)
    like = np.zeros((len(texts), LIKE_LANES), np.int32)
    data, offsets = block(pa.array(texts, pa.large_binary()))
    start, end, doc = words(data, offsets)
    if not len(start):
        return equal, like
    # Runs of words begin anew with each paragraph, and after each word that says so itself: what is put in changes its own run alone.
    line, sums = np.cumsum(data == 10)[start] + doc, prefix(data)
    cut = span_hash(sums, start, end) % U(RUN_WORDS) == 0
    head = np.flatnonzero((np.diff(line, prepend=-1) != 0) | np.append(True, cut[:-1]))
    last = np.append(head[1:], len(start)) - 1
    hashes = span_hash(sums, start[head], end[last])
    signs = np.unpackbits(mix(hashes[:, None] ^ SIGN_KEYS).view(np.uint8).reshape(len(hashes), -1), axis=1)
    owner = doc[head]
    there, begins = np.unique(owner, return_index=True)
    counts = np.diff(np.append(begins, len(owner)))
    like[there] = 2 * np.add.reduceat(signs, begins, axis=0, dtype=np.int32) - counts[:, None]
    return equal, like


def digest(equal: np.ndarray, like: np.ndarray) -> str:
    return hashlib.sha256(equal.tobytes() + like.tobytes()).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of like parts: twice the inner product by the sum of squares, an estimate of the shared part, from 0 to 1."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    both = (a * a).sum(axis=1) + (b * b).sum(axis=1)
    return np.where(both > 0, np.clip(2 * (a * b).sum(axis=1) / np.maximum(both, 1), 0, 1), 1.0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, state binary, fingerprint string. States of parts add up: see combine()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                equal, like = states([t.as_py().encode() for t in part.column("text")])
                raw = [e.tobytes() + x.tobytes() for e, x in zip(equal, like, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(raw, pa.binary()), pa.array([hashlib.sha256(r).hexdigest() for r in raw])], names=["doc_id", "state", "fingerprint"])

    return map_arrow(with_texts(docs), ["doc_id", "text"], "doc_id bigint, state binary, fingerprint string", run)


def combine(a: bytes, b: bytes, sign: int = 1) -> bytes:
    """The state of a's paragraphs with those of b (sign 1) or without them (sign -1)."""
    cut = 2 * EQUAL_LANES
    parts = []
    for kind, x, y in ((np.uint16, a[:cut], b[:cut]), (np.uint32, a[cut:], b[cut:])):
        x, y = np.frombuffer(x, kind), np.frombuffer(y, kind)
        parts.append((x + y if sign > 0 else x - y).tobytes())
    return b"".join(parts)


def in_ranges(docs: DataFrame) -> DataFrame:
    """bucket, tail, doc_id, text: rows in ranges of doc_id, each range followed by a copy (tail) of the row after it."""
    ranges = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Bounds and firsts are a few numbers for each range; how many there are is a setting, not a matter of the data.
    bounds = docs.select("doc_id").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.5 / ranges)
    splits = [float("-inf"), *(sorted(set(bounds)) or [0.0]), float("inf")]
    place = Bucketizer(splits=splits, inputCol="at", outputCol="bucket")
    filed = place.transform(docs.withColumn("at", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))))
    filed = filed.select(F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("bucket").cast("int")).alias("bucket"), "doc_id", "text")
    firsts = sorted(tuple(r) for r in filed.groupBy("bucket").agg(F.min("doc_id")).collect())
    follows = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    tails = docs.sparkSession.createDataFrame(follows, "first bigint, before int")
    rows = filed.join(F.broadcast(tails), filed["doc_id"].eqNullSafe(tails["first"]), "left")
    both = F.array(F.struct("bucket", F.lit(False).alias("tail")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("tail")))
    return rows.withColumn("at", F.explode(F.filter(both, lambda x: x["bucket"].isNotNull()))).select("at.bucket", "at.tail", "doc_id", "text")


def op1_fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of the contract."""
    rows = in_ranges(with_texts(docs))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row seen: bucket, tail, doc_id, text, state
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                keys = [(None, True, None), *zip(*(part.column(c).to_pylist() for c in ("bucket", "tail", "doc_id")), strict=True)]
                equal, like = states([t.encode() for t in texts])
                if held:
                    keys[0], texts = held[0], [held[1], *texts]
                    equal, like = np.vstack([held[2], equal]), np.vstack([held[3], like])
                else:
                    texts, equal, like = ["", *texts], np.vstack([np.zeros_like(equal[:1]), equal]), np.vstack([np.zeros_like(like[:1]), like])
                held = (keys[-1], texts[-1], equal[-1:], like[-1:])
                at = [i for i in range(len(keys) - 1) if not keys[i][1] and keys[i][0] == keys[i + 1][0]]
                if not at:
                    continue
                changed = [len(texts[i]) // 2 for i in at]
                edited = [(texts[i][: len(texts[i]) - m] + texts[i + 1][:m]).encode() for i, m in zip(at, changed, strict=True)]
                edited_equal, edited_like = states(edited)
                after = [i + 1 for i in at]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([keys[i][2] for i in at], pa.int64()),
                        "n_chars": pa.array([len(texts[i]) for i in at], pa.int64()),
                        "edited_sha256": [hashlib.sha256(t).hexdigest() for t in edited],
                        "fingerprint": [digest(equal[i], like[i]) for i in at],
                        "edited_fingerprint": [digest(e, x) for e, x in zip(edited_equal, edited_like, strict=True)],
                        "near_edited": likeness(like[at], edited_like),
                        "near_next": likeness(like[at], like[after]),
                    }
                )

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(run, schema)
