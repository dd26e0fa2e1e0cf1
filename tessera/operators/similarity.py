"""Fingerprint similarity against a stated set: largest Tanimoto, nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.bits import ones
from tessera.sources.shared import written

BLOCK_ROWS = 512


def in_blocks(df: DataFrame, row_id: str, values: list[Column], rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """(block, items): the set in arrays of about rows items each, and how many blocks there are."""
    blocks = max(1, -(-df.count() // rows))
    filed = df.withColumn("_block", F.pmod(F.xxhash64(row_id), F.lit(blocks)).cast("int"))
    return filed.groupBy("_block").agg(F.collect_list(F.struct(F.col(row_id).alias("id"), *values)).alias("_items")), blocks


def bit_matrix(rows: pa.ListArray) -> np.ndarray:
    """A row of zeros and ones for each list of words."""
    words = np.ascontiguousarray(rows.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(rows), -1)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.float32)


def most_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row (_of, _asked, _items): each list of words in _asked, and the most bits that it has in common with one of _items."""
    for batch in batches:
        for i in range(batch.num_rows):
            asked = batch.column("_asked")[i].values
            # Counts below 2**24 are exact in single precision.
            most = (bit_matrix(asked) @ bit_matrix(batch.column("_items")[i].values).T).max(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asked), batch.column("_of")[i].as_py(), np.int32)), asked, pa.array(most)], ["_of", "_w", "_both"])


def max_tanimoto(queries: DataFrame, reference: DataFrame, row_id: str, words: str, out: str = "max_tanimoto") -> DataFrame:
    """Adds the largest Tanimoto similarity of each query to a row of reference; 0 if there is none.

    Equal fingerprints are asked, and held, once. The reference is kept in blocks of fingerprints with equally many bits; of these
    the one with most bits in common is the most similar, and common bits of two blocks are a product of matrices. Similarity is at most the
    smaller number of bits by the larger, so a query meets the blocks of the most promising number first, and then only those that could
    still hold a larger value; the result is exact. All words arrays are equally long.
    """
    held = reference.filter(F.col(words).isNotNull()).select(F.col(words).alias("w")).distinct().select("w", ones(F.col("w")).alias("n"))
    sizes = sorted(held.groupBy("n").count().collect())  # at most a row for each number of bits
    if not sizes:
        return queries.withColumn(out, F.lit(0.0))
    numbers, blocks = F.lit([r[0] for r in sizes]), F.lit([-(-r[1] // BLOCK_ROWS) for r in sizes])
    # get gives null for a number that isn't there; Spark may ask it of rows that a filter leaves out.
    blocks_of = lambda n: F.get(blocks, (F.array_position(numbers, n) - 1).cast("int"))
    items = held.withColumn("_block", F.pmod(F.xxhash64("w"), blocks_of(F.col("n"))).cast("int")).groupBy(F.col("n").alias("_of"), "_block").agg(F.collect_list("w").alias("_items"))
    bound = lambda c: F.least(F.col("_n"), c).cast("double") / F.greatest(F.col("_n"), c, F.lit(1)).cast("double")
    asked = written(queries.filter(F.col(words).isNotNull()).select(F.col(words).alias("_w")).distinct().withColumn("_n", ones(F.col("_w"))))
    lots = max(1, -(-asked.count() // BLOCK_ROWS))
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def met(rows: DataFrame) -> DataFrame:
        """_w and the largest similarity to the blocks of the numbers in _worth."""
        rows = rows.select("_w", F.explode("_worth").alias("_of")).groupBy("_of", F.pmod(F.xxhash64("_w"), F.lit(lots)).alias("_lot")).agg(F.collect_list("_w").alias("_asked"))
        rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), blocks_of(F.col("_of")) - 1)))
        pairs = rows.repartition(parts, "_of", "_block", "_lot").join(items, ["_of", "_block"]).select("_of", "_asked", "_items")
        both, n = F.col("_both"), ones(F.col("_w"))
        similarity = both.cast("double") / F.greatest(n + F.col("_of") - both, F.lit(1)).cast("double")
        return pairs.mapInArrow(most_common, "_of int, _w array<bigint>, _both int").groupBy("_w").agg(F.max(similarity).alias(out))

    nearest = F.array_max(F.transform(numbers, lambda c: F.struct(bound(c).alias("s"), c.alias("c"))))["c"]
    asked = asked.withColumn("_first", nearest)
    first = written(met(asked.withColumn("_worth", F.array("_first"))))
    rest = asked.join(first.withColumnRenamed(out, "_least"), "_w")
    rest = rest.withColumn("_worth", F.filter(numbers, lambda c: (c != F.col("_first")) & (bound(c) > F.col("_least"))))
    best = first.unionByName(met(rest)).groupBy("_w").agg(F.max(out).alias(out))
    return queries.join(best, F.col(words) == F.col("_w"), "left").drop("_w").withColumn(out, F.coalesce(out, F.lit(0.0)))


#: Numbers in a block of queries, which meets blocks of the reference in a row each, and in such a block; the larger these are, the
#: fewer times the queries are dealt out.
BLOCK_CELLS, HELD_CELLS = 1 << 17, 1 << 19
#: Rows of either side of one product of matrices.
TILE = 2048


def nearest_rows(q: np.ndarray, own: np.ndarray, r: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of r, squared distance) of the k nearest of r to each of q, ties by id; rows of the same id are left out."""
    sizes, held = (q**2).sum(axis=1), (r**2).sum(axis=1)
    gap = sizes[:, None] + held[None, :] - 2 * (q @ r.T)
    gap[own[:, None] == ids[None, :]] = np.inf
    most = np.partition(gap, min(k, len(r)) - 1, axis=1)[:, min(k, len(r)) - 1]
    # More than products and sums of this width can be off by.
    slack = 8 * (q.shape[1] + 2) * np.finfo(np.float64).eps * (sizes + held.max())
    row, at = np.nonzero((gap <= (most + slack)[:, None]) & np.isfinite(gap))
    exact = ((q[row] - r[at]) ** 2).sum(axis=1)
    order = np.lexsort((ids[at], exact, row))
    row, at, exact = row[order], at[order], exact[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], at[place < k], exact[place < k]


def nearest_share(queries: DataFrame, reference: DataFrame, row_id: str, vector: str, label: str, k: int = 5) -> DataFrame:
    """row_id, score: share of rows with label 1 among the k nearest of the reference (squared distance, ties by id), itself left out.

    Both sides are dealt into blocks; each pair of blocks is one row, whose distances are products of matrices in Arrow batches and
    leave k rows a query. Products only choose rows that may be among the k: their distances are then computed from differences.
    Whole numbers below 2**26 give exact distances.
    """
    width = reference.agg(F.max(F.size(vector))).first()[0] or 1
    number = F.col(vector).cast("array<double>")
    items, blocks = in_blocks(reference, row_id, [number.alias("v"), F.col(label).cast("double").alias("y")], max(16, HELD_CELLS // width))
    asked, _ = in_blocks(queries, row_id, [number.alias("v")], max(16, BLOCK_CELLS // width))
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.select(F.col("_block").alias("_lot"), F.col("_items").alias("_asked"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    asked = asked.repartition(parts, "_block", "_lot")  # few blocks would be few tasks

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = lambda s: s.field("v").flatten().to_numpy().reshape(len(s), -1)
        for batch in batches:
            for i in range(batch.num_rows):
                near, far = batch.column("_asked")[i].values, batch.column("_items")[i].values
                q, own, r = matrix(near), near.field("id").to_numpy(), matrix(far)
                ids, y = far.field("id").to_numpy(), far.field("y").to_numpy(zero_copy_only=False)
                for lo in range(0, len(q), TILE):
                    for at in range(0, len(r), TILE):
                        row, j, gap = nearest_rows(q[lo : lo + TILE], own[lo : lo + TILE], r[at : at + TILE], ids[at : at + TILE], k)
                        columns = (pa.array(own[lo + row], pa.int64()), pa.array(gap), pa.array(ids[at + j], pa.int64()), pa.array(y[at + j]))
                        yield pa.RecordBatch.from_arrays(list(columns), [row_id, "d", "i", "y"])

    local = asked.join(items, "_block").select("_asked", "_items").mapInArrow(compare, f"`{row_id}` bigint, d double, i bigint, y double")
    order = Window.partitionBy(row_id).orderBy("d", "i")
    best = local.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).groupBy(row_id).agg(F.avg("y").alias("score"))
    return best.withColumn(row_id, F.col(row_id).cast(queries.schema[row_id].dataType))
