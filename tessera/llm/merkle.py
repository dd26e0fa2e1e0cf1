"""Merkle manifests of a data set: a tree of digests for each group of rows, and a tree over the groups' roots.

Leaves are ordered by range partitions, never in one task. Fixed blocks of them become arrays that higher-order functions
collapse level by level; the blocks' roots are the leaves of the next round, so each round has a block's size fewer rows.
Paths go the other way: each block takes the path of its own root and hands it on to its leaves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.common import Scratch

#: Nodes of a run.
FAN = 3
#: Levels that a block collapses at once: FAN**LEVELS leaves are in one array.
LEVELS = 5
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Path = "array<struct<before:string,after:string>>"


def field(c: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def placed(scratch: Scratch, rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """rows with place (from 0) and n (how many there are) inside their tree, in the order of the named columns, nulls first.

    Rows are dealt by ranges of (tree, order) and counted range by range. A large tree lies in many ranges, and equal rows
    may, too: they are told apart by their row numbers in the input, which says nothing about their digests.
    """
    keys = [F.asc_nulls_first(c) for c in (tree, *order)]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys, F.asc("_row"))
    number = dealt.sortWithinPartitions(*keys, F.asc("_row")).drop("_row").withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    kept = scratch.keep(number)
    ranges = kept.groupBy(F.col(tree).alias("_tree"), F.col("_range").alias("_in")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_count"))
    whole = Window.partitionBy("_tree")  # a row for each range
    before = F.coalesce(F.sum("_count").over(whole.orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumns({"_before": before, "n": F.sum("_count").over(whole)})
    found = kept.join(ranges, kept[tree].eqNullSafe(ranges["_tree"]) & (kept["_range"] == ranges["_in"]))
    return found.withColumn("place", F.col("_at") - F.col("_first") + F.col("_before")).drop("_tree", "_in", "_range", "_at", "_first", "_count", "_before")


def collapsed(leaves: Column, n: Column) -> Column:
    """All levels of a block, its leaves first, of a tree of n nodes: LEVELS more, or as many as leave one node."""
    steps = F.filter(F.array(*(F.lit(FAN**k).cast("bigint") for k in range(LEVELS))), lambda p: p < n)
    last = lambda levels: F.element_at(levels, -1)

    def up(levels: Column, _) -> Column:
        runs = F.sequence(F.lit(0), F.ceil(F.size(last(levels)) / FAN).cast("int") - 1)
        above = F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(last(levels), r * FAN + 1, F.lit(FAN)), ""), 256))
        return F.concat(levels, F.array(above))

    return F.aggregate(steps, F.array(leaves), up)


def siblings(levels: Column, i: Column) -> Column:
    """The path of leaf i of a block: for each level the run's digests before and after its node."""
    def at(level: Column, k: Column) -> Column:
        place = F.floor(i / F.element_at(F.array(*(F.lit(FAN**j) for j in range(LEVELS))), k + 1)).cast("int")
        inside = place % FAN
        return F.struct(F.array_join(F.slice(level, place - inside + 1, inside), "").alias("before"), F.array_join(F.slice(level, place + 2, F.lit(FAN - 1) - inside), "").alias("after"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), at)


def rounds(scratch: Scratch, nodes: DataFrame) -> list[DataFrame]:
    """Blocks of each round, from nodes (tree, place, n, digest, kept) up to one block a tree.

    Columns: tree, block, n, kept (what came with each leaf, in order), levels, top (the block's root).
    """
    out = []
    while True:
        filed = nodes.withColumn("block", F.floor(F.col("place") / BLOCK))
        blocks = filed.groupBy("tree", "block", "n").agg(F.sort_array(F.collect_list(F.struct("place", "digest", "kept"))).alias("_nodes"))
        blocks = blocks.withColumn("levels", collapsed(F.transform("_nodes", lambda x: x["digest"]), F.col("n")))
        top = F.element_at(F.element_at("levels", -1), 1)
        out.append(scratch.keep(blocks.select("tree", "block", "n", F.transform("_nodes", lambda x: x["kept"]).alias("kept"), "levels", top.alias("top"))))
        if out[-1].filter(F.col("n") > BLOCK).isEmpty():
            return out
        nodes = out[-1].select("tree", F.col("block").alias("place"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("digest"), F.lit(None).cast("int").alias("kept"))


def roots(blocks: list[DataFrame]) -> DataFrame:
    """tree, root."""
    return blocks[-1].select("tree", F.col("top").alias("root"))


def with_crown(blocks: DataFrame, crown: DataFrame, *keys: str) -> DataFrame:
    above = crown.toDF(*(f"_{c}" if c in keys else c for c in crown.columns))
    same = [blocks[k].eqNullSafe(above[f"_{k}"]) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return blocks.join(above, on).drop(*(f"_{k}" for k in keys))


def descend(blocks: list[DataFrame], crown: DataFrame) -> DataFrame:
    """kept, path, subroot, root of every leaf; crown has tree, path and root of what lies above each tree's root."""
    above = crown.withColumn("block", F.lit(0).cast("bigint"))
    for k, level in reversed(list(enumerate(blocks))):
        joined = with_crown(level, above, "tree", "block")
        if k == len(blocks) - 1:
            joined = joined.withColumn("subroot", F.col("top"))
        if k:
            leaves = F.transform(F.sequence(F.lit(0), F.size("kept") - 1), lambda i: F.struct((F.col("block") * BLOCK + i).alias("block"), F.concat(siblings(F.col("levels"), i), "path").alias("path")))
            above = joined.select("tree", "root", "subroot", F.inline(leaves))
        else:
            leaves = F.transform("kept", lambda x, i: F.struct(x.alias("kept"), F.concat(siblings(F.col("levels"), i), "path").alias("path")))
            return joined.select("root", "subroot", F.inline(leaves))
    raise AssertionError("there is one round at least")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, run: F.sha2(F.concat(run["before"], node, run["after"]), 256))


def proof(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda run: F.concat(run["before"], run["after"])), ""), 256)


def manifest(rows: DataFrame, tree: str, order: Sequence[str], leaf: str, carried: Sequence[str] = ()) -> DataFrame:
    """carried, leaf, path, subroot and root of each row of rows.

    rows has a digest in the column leaf. Trees hold the rows of one value of the column tree, ordered by the columns order
    and, where those are equal, by the digest; rows that are equal in all of these are alike, so any order of them gives the
    same trees. One tree more stands over the roots, ordered by value, null first. An empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession)
    # Columns go by number, so that no name of the caller's clashes.
    facts = F.struct(F.col(leaf).alias("leaf"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carried)))
    names = [f"o{i}" for i in range(len(order))]
    slim = rows.select(F.col(tree).alias("tree"), *(F.col(c).alias(n) for c, n in zip(order, names)), F.col(leaf).alias("digest"), facts.alias("kept"))
    blocks = rounds(scratch, placed(scratch, slim, "tree", [*names, "digest"]).select("tree", "place", "n", "digest", "kept"))
    tops = roots(blocks).select(F.lit(0).alias("all"), F.col("tree").alias("value"), F.col("root").alias("digest"))
    over = placed(scratch, tops, "all", ["value"]).select(F.col("all").alias("tree"), "place", "n", "digest", F.struct("value").alias("kept"))
    over = rounds(scratch, over)
    crown = descend(over, roots(over).withColumn("path", F.array().cast(Path)))
    trees = scratch.keep(crown.select(F.col("kept.value").alias("tree"), "path", "root"))
    found = descend(blocks, trees)
    return found.select(*(F.col(f"kept.c{i}").alias(c) for i, c in enumerate(carried)), F.col("kept.leaf").alias("leaf"), "path", "subroot", "root")


def op12_manifest(docs: DataFrame) -> DataFrame:
    """Each document's leaf, its roots and proof, and whether its tampered text still proves itself.

    Null columns are ``-`` in a leaf, empty texts ``0:``; the groups of null and of empty source are two. Rows of one source
    with one doc_id follow by their leaves; a null doc_id comes first and counts as empty text for crc32 (so it is tampered
    with). Equal rows have proofs of their own, at neighbouring places. Texts of any length are hashed whole, in a few
    copies of one text. Other columns take no part. An empty table gives no rows.
    """
    text = F.col("text")
    leaf = lambda t: digest(*(field(F.col(c)) for c in FIELDS[:-1]), field(t))
    chosen = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0) & text.contains("\n")
    rows = docs.select("doc_id", "source", leaf(text).alias("leaf"), F.when(chosen, leaf(F.replace(text, F.lit("\n"), F.lit("")))).alias("tampered"))
    found = manifest(rows, "source", ["doc_id"], "leaf", ["doc_id", "tampered"])
    out = found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(most: int = 14) -> str:
    """The same in SQL by whole levels and self joins, for up to FAN**most rows a source."""
    piece = lambda c: f"coalesce(octet_length(encode(({c})::VARCHAR))::VARCHAR || ':' || ({c})::VARCHAR, '-')"
    leaf = lambda t: "sha256(" + " || ".join([*(piece(c) for c in FIELDS[:-1]), piece(t)]) + ")"
    # The reflected polynomial of crc32, one step a bit; its complement's parity is asked for.
    bits = "flatten(list_transform(range(1, len(d) + 1), lambda i: [ascii(d[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"list_reduce({bits}, lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384), 4294967295::BIGINT)"
    out = [
        f"docs AS (SELECT {', '.join(FIELDS)}, coalesce(doc_id::VARCHAR, '') AS d, {leaf('text')} AS leaf FROM documents)",
        f"rows_ AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, leaf) AS r, CASE WHEN ({crc} & 1) = 1 THEN {leaf("replace(text, chr(10), '')")} ELSE leaf END AS tampered FROM docs)",
        "a0 AS (SELECT r, source, row_number() OVER (PARTITION BY source ORDER BY r) - 1 AS p, count(*) OVER (PARTITION BY source) AS n, leaf AS h FROM rows_)",
        *_levels("a", "source", most),
        f"subs AS (SELECT source, h AS subroot FROM a{most})",
        "b0 AS (SELECT source, 0 AS one, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, count(*) OVER () AS n, subroot AS h FROM subs)",
        *_levels("b", "one", most),
        "w0 AS (SELECT rows_.r, rows_.doc_id, leaf, rows_.source, a0.p, a0.n, '' AS said, tampered AS t FROM rows_ JOIN a0 ON rows_.r = a0.r)",
    ]
    keep = "w.r, w.doc_id, w.leaf, w.source"
    for k in range(most):
        out.append(_climb(f"w{k}", f"w{k + 1}", f"a{k}", "b.source IS NOT DISTINCT FROM w.source", keep))
    out.append(f"v0 AS (SELECT {keep}, b0.p, b0.n, w.said, w.t FROM w{most} w JOIN b0 ON b0.source IS NOT DISTINCT FROM w.source)")
    for k in range(most):
        out.append(_climb(f"v{k}", f"v{k + 1}", f"b{k}", "true", keep))
    last = f"SELECT v.doc_id, v.leaf, s.subroot, t.h AS root, sha256(v.said) AS proof_sha256, v.t AS folded_root, v.t = t.h AS verified FROM v{most} v JOIN subs s ON s.source IS NOT DISTINCT FROM v.source, b{most} t"
    return "WITH " + ",\n".join(f"{x.partition(' AS ')[0]} AS MATERIALIZED {x.partition(' AS ')[2]}" for x in out) + "\n" + last


def _levels(name: str, tree: str, most: int) -> list[str]:
    up = "SELECT {t}, p // 3 AS p, any_value(n + 2) // 3 AS n, sha256(string_agg(h, '' ORDER BY p)) AS h FROM {a} WHERE n > 1 GROUP BY {t}, p // 3"
    return [f"{name}{k + 1} AS (SELECT {tree}, p, n, h FROM {name}{k} WHERE n = 1 UNION ALL {up.format(t=tree, a=f'{name}{k}')})" for k in range(most)]


def _climb(at: str, to: str, level: str, same: str, keep: str) -> str:
    before, after = (f"coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (WHERE b.p {x} w.p), '')" for x in "<>")
    run = f"SELECT {keep}, w.p, w.n, w.said, w.t, {before} AS x, {after} AS y FROM {at} w LEFT JOIN {level} b ON {same} AND b.p // 3 = w.p // 3 AND w.n > 1 GROUP BY ALL"
    return f"{to} AS (SELECT r, doc_id, leaf, source, p // 3 AS p, CASE WHEN n > 1 THEN (n + 2) // 3 ELSE n END AS n, said || x || y AS said, CASE WHEN n > 1 THEN sha256(x || t || y) ELSE t END AS t FROM ({run}))"


OP12_SQL = _sql()
