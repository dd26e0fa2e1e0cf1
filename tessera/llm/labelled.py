"""A bounded, deterministic sample of labelled documents, which the classifiers are fitted on."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, sizes: dict[int, int]) -> DataFrame:
    """doc_id, text, label of at most sizes[value] rows of each label value where train holds, least hashes of doc_id first.

    Rows of labels with a null doc_id or label are left out; of several rows for a document the largest label counts, and
    of several documents with one id the least text.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.max(label).alias("label"))
    parts = [known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for value, n in sizes.items()]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionAll(part)
    # As many rows as sizes says, whatever the input.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def label_counts(labels: DataFrame, label: str, train: Column) -> dict[int, int]:
    rows = labels.filter(F.col(label).isin(0, 1) & train).groupBy(label).count().collect()
    return {0: 0, 1: 0} | {int(r[0]): r[1] for r in rows}


def fitted(rows: DataFrame, fit: Callable[[list[dict]], object]) -> object:
    """fit of the rows, which are a bounded sample (in the order of their columns), in one task: the driver gets the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for batch in batches for row in batch.to_pylist()]
        names = list(held[0]) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sorted(held, key=lambda r: [r[c] for c in names])))], pa.binary())], names=["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([])
