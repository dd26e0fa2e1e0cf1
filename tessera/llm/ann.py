"""Operator 5 - approximate nearest neighbours by balanced posting lists.

Index: centroids are fitted on a bounded sample of the unit vectors by k-means with a penalty on full clusters. Every
vector is posted to its nearest centroid and, near a boundary, to each further one within ``BOUNDARY`` times that distance
(up to ``REPLICAS``) that isn't nearer to a centroid already chosen than to the vector. The centroids, whose number is
bounded, are linked in a neighbour graph in memory and searched greedily with a beam. A query reads the lists whose
centroids are within ``PRUNE`` times the distance of its nearest one, ``LEAST_LISTS`` at least.

Equal vectors are one entry with its ``k + 1`` smallest ids: ties go to smaller ids, so no more can be in a result (one
may be the query itself). A list longer than ``LIST_ROWS`` is read in parts by several tasks. Scores are cosines in
double precision of the original vectors.

Null and zero vectors and those with null or non-finite components take no part, nor do null ids. Vectors meet those of their
own length. Rows of one id are one candidate and one query, whose nearest pair counts. With fewer candidates than
k, all found are returned. If the lists read hold fewer than k, the query reads all lists. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.common import Scratch

NEAREST = 5
SAMPLE = 20_000
LIST_TARGET = 256
MAX_CENTROIDS = 2048
ROUNDS = 8
BOUNDARY = 1.15
REPLICAS = 4
GRAPH_LINKS = 16
BEAM = 64
PRUNE = 1.25
LEAST_LISTS = 8
MOST_LISTS = 48
LIST_ROWS = 4096


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Lists:
    """Centroids and the graph over them."""

    def __init__(self, sample: np.ndarray, total: int):
        x = unit(sample.astype(np.float64)).astype(np.float32)
        k = int(min(MAX_CENTROIDS, max(1, total // LIST_TARGET), len(x)))
        rng = np.random.default_rng(0)
        c = x[rng.choice(len(x), k, replace=False)]
        held = np.full(k, len(x) / k)
        for _ in range(ROUNDS if k > 1 else 0):
            # A cluster above its share looks farther away by up to a fifth of the mean distance for each time its share.
            tax, own = np.log2(1 + held * k / len(x)), []
            for part in np.array_split(x, -(-len(x) // 1024)):
                far = np.sqrt(np.maximum(2 - 2 * (part @ c.T), 0))
                own.append(np.argmin(far + 0.2 * far.min(axis=1).mean() * tax, axis=1))
            own = np.concatenate(own)
            held = np.bincount(own, minlength=k)
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            empty = held == 0
            sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), c)
        self.centroids = c
        links = min(GRAPH_LINKS, k - 1)
        self.graph = np.argsort(-(c @ c.T), axis=1)[:, 1 : links + 1] if links else np.zeros((k, 0), np.int64)
        # Entries spread over the graph, so that a greedy walk begins near.
        self.entries = np.unique(np.linspace(0, k - 1, min(k, 32)).astype(int))

    def search(self, q: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Centroids near q, nearest first, and their distances: best-first walk over the graph."""
        seen = set(self.entries.tolist())
        first = np.maximum(2 - 2 * (self.centroids[self.entries] @ q), 0)
        ahead = [(float(d), int(i)) for d, i in zip(first, self.entries, strict=True)]
        heapq.heapify(ahead)
        best = [(-d, i) for d, i in ahead]
        heapq.heapify(best)
        while len(best) > beam:
            heapq.heappop(best)
        while ahead:
            d, i = heapq.heappop(ahead)
            if len(best) >= beam and d > -best[0][0]:
                break
            new = [j for j in self.graph[i].tolist() if j not in seen]
            seen.update(new)
            for j, e in zip(new, np.maximum(2 - 2 * (self.centroids[new] @ q), 0).tolist() if new else [], strict=True):
                if len(best) < beam or e < -best[0][0]:
                    heapq.heappush(ahead, (e, j))
                    heapq.heappush(best, (-e, j))
                    if len(best) > beam:
                        heapq.heappop(best)
        found = sorted((-d, i) for d, i in best)
        return np.array([i for _, i in found]), np.sqrt([d for d, _ in found])

    def post(self, q: np.ndarray) -> list[int]:
        """Lists that a vector is posted to."""
        at, far = self.search(q)
        chosen = [int(at[0])]
        for i, d in zip(at[1:], far[1:], strict=True):
            if d > BOUNDARY * far[0] or len(chosen) == REPLICAS:
                break
            if all(np.linalg.norm(self.centroids[i] - self.centroids[c]) > d for c in chosen):
                chosen.append(int(i))
        return chosen

    def probe(self, q: np.ndarray) -> list[int]:
        """Lists that a query reads."""
        at, far = self.search(q)
        keep = np.flatnonzero((far <= PRUNE * far[0]) | (np.arange(len(at)) < LEAST_LISTS))[:MOST_LISTS]
        return [int(at[i]) for i in keep]


def usable(vectors: DataFrame) -> DataFrame:
    """id, vector array<double> of rows that take part."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    return v.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).filter(fine)


def assigned(rows: DataFrame, lists, method: str) -> DataFrame:
    """rows with list, one row for each list of post() or probe()."""
    names = rows.columns
    fields = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = getattr(lists.value, method)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(np.array(batch.column("vector").to_pylist(), np.float64)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pick(q) for q in x], pa.list_(pa.int32()))], names=[*names, "lists"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(run, kinds + ", lists array<int>").withColumn("list", F.explode("lists")).drop("lists")


def nearest(vectors: DataFrame, is_query, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: k nearest of each id for which is_query holds.

    Vectors are compared with those of their own length: each length has lists of its own. Rows of one id are one vector with
    several places: the nearest of them counts.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.keep(usable(vectors))
    lengths = sorted(r[0] for r in rows.select(F.size("vector")).distinct().collect())  # a row for each length
    found = [_nearest_alike(scratch, rows.filter(F.size("vector") == n) if len(lengths) > 1 else rows, is_query, k) for n in lengths]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    every = found[0]
    for f in found[1:]:
        every = every.unionAll(f)
    best = every.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _nearest_alike(scratch: Scratch, rows: DataFrame, is_query, k: int) -> DataFrame:
    """query_id, vec_id, score: candidates, the k nearest among them, for rows of one length."""
    spark = rows.sparkSession
    by_id = F.array_sort(F.collect_set("id"))
    # k + 1 smallest ids of equal vectors; ids are numbered in two steps so that no group is gathered whole.
    keyed = rows.withColumn("same", F.xxhash64("vector"))
    least = Window.partitionBy("same", "vector", F.pmod("id", F.lit(64))).orderBy("id")
    few = keyed.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= k + 1)
    entries = scratch.keep(few.groupBy("same", "vector").agg(F.slice(by_id, 1, k + 1).alias("ids")).select("same", "vector", "ids"))
    total = entries.count()
    sample = entries.orderBy("same").limit(SAMPLE).select("vector").collect()
    lists = spark.sparkContext.broadcast(Lists(np.array([r[0] for r in sample]), total))
    posted = scratch.keep(assigned(entries.select("vector", "ids"), lists, "post"))
    asked = scratch.keep(assigned(rows.filter(is_query(F.col("id"))).select("id", "vector"), lists, "probe"))
    parts = scratch.keep(posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).cast("int").alias("parts")))
    found = scratch.keep(_answers(posted, asked, parts, k))
    # A query whose lists held too few candidates reads every list.
    short = asked.select("id", "vector").distinct().join(found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")), F.col("id") == F.col("query_id"), "left")
    short = scratch.keep(short.filter(F.coalesce("n", F.lit(0)) < k).select("id", "vector"))
    if not short.isEmpty():
        every = F.explode(F.sequence(F.lit(0), F.lit(len(lists.value.centroids) - 1)))
        found = found.unionAll(_answers(posted, short.withColumn("list", every), parts, k))
    return found


def _answers(posted: DataFrame, asked: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k + 1 nearest entries, with all ties, in each part of a list that a query reads."""
    part_of = F.pmod(F.xxhash64("vector"), F.col("parts")).cast("int")
    data = posted.join(parts, "list").select("list", part_of.alias("part"), F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("id"), "vector", "ids")
    questions = asked.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "id", "vector", F.lit(None).cast("array<bigint>").alias("ids"))
    met = data.unionAll(questions).repartition("list", "part").sortWithinPartitions("list", "part", "side")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def block(ids: list, x: np.ndarray, norms: np.ndarray, asked: list) -> pa.RecordBatch:
        q = np.array([v for _, v in asked])
        q_norms = np.linalg.norm(q, axis=1)
        sims = (q / q_norms[:, None]) @ (x / norms[:, None]).T
        top = min(k + 1, sims.shape[1])
        least = -np.partition(-sims, top - 1, axis=1)[:, top - 1]
        out = []
        for n, (query, _) in enumerate(asked):
            near = np.flatnonzero(sims[n] >= least[n] - 1e-9)
            # Each pair by itself, so that a score doesn't depend on the block it was found in.
            exact = (x[near] * q[n]).sum(axis=1) / (norms[near] * q_norms[n])
            out += [{"query_id": query, "vec_id": i, "score": float(s)} for e, s in zip(near, exact, strict=True) for i in ids[e] if i != query]
        return pa.RecordBatch.from_pylist(out, schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a part come first (about LIST_ROWS), then the queries that read it, in blocks."""
        here, ids, held, x, norms, asked = None, [], [], None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                new = (r["list"], r["part"]) != here
                if asked and (new or len(asked) == 256):
                    yield block(ids, x, norms, asked)
                    asked = []
                if new:
                    here, ids, held, x = (r["list"], r["part"]), [], [], None
                if not r["side"]:
                    ids.append(r["ids"])
                    held.append(r["vector"])
                elif held:
                    if x is None:
                        x = np.array(held)
                        norms = np.linalg.norm(x, axis=1)
                    asked.append((r["id"], r["vector"]))
        if asked:
            yield block(ids, x, norms, asked)

    return met.mapInArrow(compare, "query_id bigint, vec_id bigint, score double")


def op5_nearest(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, lambda i: i % 50 == 0)
