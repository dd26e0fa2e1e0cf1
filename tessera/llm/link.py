"""Candidate pairs by shared keys without all pairs of a group of copies, and connected components. DataFrame functions only.

Rows (ids) are posted under keys; two that share a key may be linked. A group of n copies would make n * n pairs, so each
posting list elects a leader and n pairs are judged. Rows near their leader leave the list, the others elect a leader
again: each round costs as much as the lists are long. What lists still hold after ``ROUNDS`` rounds is unlike the leaders,
and meets in all pairs (``all_pairs``), in blocks. So of two rows that share a key, both were judged against a leader of
which one at least is near, or they meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import Scratch

#: Elections in a list before its rows meet in all pairs.
ROUNDS = 2
#: Rows of a block of a list; each two blocks meet in a group of their own.
BLOCK_ROWS = 128


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step of connected components by alternating stars: neighbours are tied to the least one known."""
    around = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("least"))
    joined = around.join(least, around["a"] == least["node"])
    if large:
        made = joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        made = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionAll(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return made.filter("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id, root (least id reachable) of every id with an edge (a, b) to a smaller root. Stars are tied until nothing changes."""
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = scratch.keep(edges.select("a", "b").filter("a <> b").distinct())
    before = mark(now)
    while before[0]:
        after = scratch.keep(_stars(_stars(now, large=True), large=False))
        scratch.drop(now)
        now, last = after, before
        if (before := mark(now)) == last:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("root"))


def merged(roots: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """What components() gives for the edges (a, b) beside those that roots, its result so far, came from: only roots are tied."""
    root = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
    tied = edges.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    more = scratch.keep(components(tied, scratch))
    moved = roots.join(more.select(F.col("id").alias("root"), F.col("root").alias("least")), "root", "left")
    return scratch.keep(moved.select("id", F.coalesce("least", "root").alias("root")).unionAll(more))


def elections(postings: DataFrame, judge: Callable[[DataFrame], DataFrame], scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """(what judge gave in each round, key and id of rows that are left in lists), for postings (key, id, weight, facts), all
    distinct; a list's leader is the row of most weight.

    facts is what judge needs to know of a row, of a few bytes; it gets pairs lead, id, lead_facts, id_facts, and gives lead,
    id and near: whether the row leaves the lists that this leader has. It may leave out pairs, whose rows stay in their lists.
    Leaders leave their lists, since all rows of these were judged against them.
    """
    given: list[DataFrame] = []
    row = ("id", "weight", "facts")
    left = scratch.keep(postings.select("key", *row))
    for _ in range(ROUNDS):
        best = F.min_by(F.struct("id", "facts"), F.struct(-F.col("weight"), "id"))
        lists = left.groupBy("key").agg(F.count(F.lit(1)).alias("held"), best.alias("best")).filter("held > 1")
        shared = left.join(lists.select("key", F.col("best.id").alias("lead"), F.col("best.facts").alias("lead_facts")), "key").filter("id <> lead")
        shared = scratch.keep(shared.select("key", *row, "lead", "lead_facts"))
        scratch.drop(left)
        if shared.isEmpty():
            return given, shared.select("key", "id")
        pairs = shared.groupBy("lead", "id").agg(F.first("lead_facts").alias("lead_facts"), F.first("facts").alias("id_facts"))
        judged = scratch.keep(judge(pairs))
        given.append(judged)
        left = scratch.keep(shared.join(judged.filter("near").select("lead", "id"), ["lead", "id"], "left_anti").select("key", *row))
        scratch.drop(shared)
    return given, left.select("key", "id")


def all_pairs(lists: DataFrame, items: DataFrame, linked: Callable[[str, str], Column]) -> DataFrame:
    """a, b: rows that share a list of lists (key, id), and are linked.

    items has a row for each id; linked gets the prefixes of the two rows' columns (``x_`` and ``y_``) and is the condition of the
    join, so that pairs aren't written. A list is dealt into blocks, and each two of them are a group: no list is one task. Rows that
    share several lists are judged in that of the least key alone. Tasks are as many as there are shuffle partitions: what they read
    is little, and judging takes the time.
    """
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = lists.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"), F.count(F.lit(1)).alias("held")).filter("held > 1").drop("held")
    own = lists.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    of_row = own.groupBy("id").agg(F.collect_list("key").alias("keys"))
    met = own.select("key", "id", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("key", "id", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    met = met.join(items.join(of_row, "id"), "id").repartition(parts, "key", "i", "j")
    side = lambda p: met.select("key", "i", "j", *(F.col(c).alias(f"{p}{c}") for c in met.columns if c not in ("key", "i", "j")))
    apart = ((F.col("i") == F.col("j")) & (F.col("x_id") < F.col("y_id"))) | ((F.col("x_block") == F.col("i")) & (F.col("y_block") == F.col("j")) & (F.col("i") < F.col("j")))
    once = F.array_min(F.array_intersect("x_keys", "y_keys")) == F.col("key")
    both = side("x_").join(side("y_"), ["key", "i", "j"]).filter(apart & once & linked("x_", "y_"))
    return both.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()
