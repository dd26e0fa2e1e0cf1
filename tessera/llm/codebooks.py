"""Product codes of vectors: integer codebooks for each part of a vector, trained by exact rounds.

All arithmetic is in whole numbers, so sums don't depend on the order in which tasks meet, and reruns agree to the bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import Scratch

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Rows whose distances are held at once: ROWS * ENTRIES numbers.
ROWS = 2048


def limit(width: int) -> int:
    """The largest component, by amount, with which no sum of squared differences over a vector leaves 64 bits."""
    return int(np.sqrt(2.0**61 / max(width, 1)))


def whole(vectors: pa.Array, width: int) -> np.ndarray:
    """The components of equally long vectors as floor(SCALE * x), cut at limit(); padded to full parts."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), width)
    most = limit(width)
    x = np.clip(np.floor(flat * SCALE), -most, most).astype(np.int64)
    return np.pad(x, ((0, 0), (0, -width % PARTS)))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the nearest entries of each row, and its squared distance: |x|^2 - 2xc + |c|^2 in 64-bit integers."""
    entry, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    norms, across = (book * book).sum(1), np.ascontiguousarray(book.T)
    for i in range(0, len(x), ROWS):
        part = x[i : i + ROWS]
        gaps = norms - 2 * (part @ across)
        entry[i : i + ROWS] = gaps.argmin(1)
        far[i : i + ROWS] = gaps.min(1) + (part * part).sum(1)
    return entry, far


class Codec:
    """Codebooks (parts, entries, components) for vectors of one width; ``books`` is a broadcast of some
    ENTRIES * width * 8 bytes, whatever the number of rows."""

    def __init__(self, spark, width: int, books: np.ndarray):
        self.width, self.books = width, spark.sparkContext.broadcast(books)

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, PARTS, axis=1)

    def sums(self, vectors: DataFrame) -> DataFrame:
        """part, entry, count and s0, s1, ...: how many parts each entry is nearest to, and their sums."""
        width, books, split = self.width, self.books, self.parts
        names = [f"s{i}" for i in range(books.value.shape[2])]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros((*books.value.shape[:2], len(names) + 1), np.int64)
            for batch in batches:
                x = whole(batch.column(0), width)
                for p, rows in enumerate(split(x)):
                    entry, _ = nearest(rows, books.value[p])
                    order = np.argsort(entry, kind="stable")
                    met, start = np.unique(entry[order], return_index=True)
                    if len(met):
                        found[p, met, 0] += np.diff(np.append(start, len(rows)))
                        found[p, met, 1:] += np.add.reduceat(rows[order], start, axis=0)
            p, e = np.nonzero(found[:, :, 0])
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), *(pa.array(found[p, e, i]) for i in range(len(names) + 1))], ["part", "entry", "count", *names])

        schema = ", ".join(["part int", "entry int", "count bigint", *(f"{n} bigint" for n in names)])
        each = vectors.mapInArrow(task, schema)
        return each.groupBy("part", "entry").agg(*(F.sum(n).alias(n) for n in ("count", *names)))

    def better(self, vectors: DataFrame) -> Codec:
        """The codec after one round: each entry that has parts becomes their mean, rounded down."""
        books = self.books.value.copy()
        for r in self.sums(vectors).collect():  # PARTS * ENTRIES rows at most
            books[r[0], r[1]] = np.array(r[3:], np.int64) // r[2]
        spark = vectors.sparkSession
        self.books.unpersist()
        return Codec(spark, self.width, books)

    def encode(self, rows: DataFrame, vector: str, *carried: str) -> DataFrame:
        """The carried columns, code (two hex digits a part) and error (squared distance) of each row."""
        width, books, split = self.width, self.books, self.parts

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hexes = np.array([f"{i:02x}" for i in range(ENTRIES)], object)
            for batch in batches:
                code, error = np.full(batch.num_rows, "", object), np.zeros(batch.num_rows, np.int64)
                for p, x in enumerate(split(whole(batch.column(0), width))):
                    entry, far = nearest(x, books.value[p])
                    code, error = code + hexes[entry], error + far
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(code, pa.string()), pa.array(error)], [*batch.schema.names[1:], "code", "error"])

        kept = rows.select(vector, *carried)
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:]), "code string", "error bigint"])
        return kept.mapInArrow(task, schema)

    def text(self) -> str:
        """All components, by part, entry and position."""
        return ",".join(map(str, self.books.value.ravel().tolist()))


def finite(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col(vector).isNotNull() & ~odd)


def train(rows: DataFrame, vector: str, order: str, width: int, rounds: int = ROUNDS) -> Codec:
    """Codebooks of the finite vectors of that width. They begin as the ENTRIES first rows' parts by order (nulls last, ties by the vectors)."""
    first = rows.orderBy(F.asc_nulls_last(order), vector).limit(ENTRIES).select(vector).toArrow()
    x = whole(first.column(0).combine_chunks(), width)
    codec = Codec(rows.sparkSession, width, np.stack(np.split(x, PARTS, axis=1)))
    for _ in range(rounds):
        codec = codec.better(rows.select(vector))
    return codec


def op13_codes(table: DataFrame) -> DataFrame:
    """Each vector's code, its error, the errors of its label's rows together, and a digest of the codebooks.

    Vectors that are null or hold a null or non-finite component are left out. Vectors of each length have codebooks of their
    own; lengths that 4 doesn't divide are filled up with zeros, an empty vector has code 00000000 and error 0. With fewer than
    256 rows there are as many entries as rows. Repeated rows count each; of equal vec_ids the smaller vector comes first,
    null ones come last. Components beyond limit() (some 190,000 for 64 components) are cut there, since squares would leave
    64 bits; a label's sum that does is null. An empty table gives no rows. Other columns take no part.
    """
    scratch = Scratch(table.sparkSession)
    rows = finite(table.select(F.col("embedding").cast("array<double>").alias("v"), "vec_id", "label"), "v")
    widths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())  # a row for each length
    parts = []
    for width in widths:
        own = rows.filter(F.size("v") == width)
        codec = train(own, "v", "vec_id", width)
        parts.append(codec.encode(own, "v", "vec_id", "label").withColumn("codebooks_sha256", F.sha2(F.lit(codec.text()), 256)))
    out = parts[0] if parts else rows.select("vec_id", "label").withColumns({"code": F.lit(""), "error": F.lit(0).cast("bigint"), "codebooks_sha256": F.lit("")})
    for p in parts[1:]:
        out = out.unionByName(p)
    coded = scratch.keep(out)
    errors = coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    return coded.join(errors, coded["label"].eqNullSafe(errors["_label"])).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """The same for vectors of one length that 4 divides, with all distances in doubles that hold whole numbers."""
    out = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r FROM kept)",
        "parts AS (SELECT r, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM numbered, range(4) AS t(p))",
        f"c0 AS (SELECT p, r AS e, x AS c FROM parts WHERE r < {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        far = "list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c)"
        out.append(f"n{k} AS (SELECT r, p, any_value(x) AS x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT r, parts.p, x, e, {far} AS d FROM parts JOIN c{k} ON parts.p = c{k}.p) GROUP BY r, p)")
        if k < ROUNDS:
            mean = f"SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(x[i]) / count(*)) AS m FROM n{k}, range(1, len(x) + 1) AS t(i) GROUP BY p, e, i) GROUP BY p, e"
            out.append(f"c{k + 1} AS (SELECT c{k}.p, c{k}.e, coalesce(m.c, c{k}.c) AS c FROM c{k} LEFT JOIN ({mean}) m ON m.p = c{k}.p AND m.e = c{k}.e)")
    out.append(f"coded AS (SELECT vec_id, label, code, error FROM numbered JOIN (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM n{ROUNDS} GROUP BY r) USING (r))")
    out.append(f"books AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})")
    return "WITH " + ",\n".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in out) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, books"


OP13_SQL = _sql()
