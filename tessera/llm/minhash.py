"""Operator 4 - MinHash near-duplicates by a signature-coordinate inverted join.

1. A text's set of word shingles gives a signature of ``COORDINATES`` minima. Documents with equal sets are one class.
2. Classes are posted under coordinates and their values, ``ROWS`` coordinates to a key: word pairs are so common that a
   list of a single coordinate grows with the corpus and holds mostly texts that are unlike (on five times the rows, 34
   times as many). A pair at the threshold of 0.8 shares no key once in 20 million times. Keys that one class has alone
   are skipped.
3. Lists elect leaders (``link.elections``): collisions of all coordinates are counted for pairs of a leader and a row
   of its lists. Rows with ``NEAR`` or more leave the lists; pairs with ``MET`` or more are retained. Both are low: texts
   that have no more than a passage in common are few in a list, and step 5 does the rest. What lists hold after their elections
   meets in all pairs, and those with ``NEAR`` or more are retained too (a pair at the threshold has 102 in the mean).
4. Retained pairs meet as texts, at the leader, in parts if it has many. Their full sets decide whether they are linked,
   and give the difference of the row's set from the leader's (what either has alone).
5. Two rows of one leader, at least one not linked with it (a stray): they can be similar only if their differences have
   an element in common, since similarity to each other would otherwise be less than that to the leader. They are joined
   by prefixes of their differences, whose lengths follow from how much must be common, unless they are in one component
   already, and confirmed exactly: the size of the symmetric difference of their sets is that of their differences'.

Step 5 finds each pair that shares a key and of which one leaves that list, since both are then rows of one leader. A
group of n near copies makes about n pairs.

Words are runs of anything but ASCII white space, A-Z lower-cased. With fewer words than ``width`` the whole sequence is
the one shingle; a text without words, or null, has an empty set and is linked with nothing. Repeated rows are in one
class. A null doc_id is no representative and its row is linked by equal sets alone. Of an empty table the result is
empty. Other columns are left out. Texts are hashed in slices of 1 MB, and one longer than that by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.blocks import U, mix, shingle_sets, slices
from tessera.llm.common import Scratch, map_arrow, with_texts
from tessera.llm.link import all_pairs, components, elections

COORDINATES = 128
ROWS = 4
#: Of COORDINATES. If one of two similar texts agrees with a leader on NEAR, the other does on 21 of these, and on fewer than
#: MET once in a million times.
MET, NEAR = 10, 26
PERCENT = 80
#: Rows of a leader that meet it in one part.
PART_ROWS = 256
KEYS = mix(np.arange(1, COORDINATES + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F))


def minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Signatures (a row each) of sets laid end to end, none of them empty; starts has where each begins."""
    out = np.empty((len(starts), COORDINATES), np.uint32)
    for k, key in enumerate(KEYS):
        x = (values ^ key) * (key | U(1))
        out[:, k] = np.minimum.reduceat(((x ^ (x >> U(29))) * U(0x9FB21C651E98DF25)) >> U(32), starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A key for each ROWS coordinates of signatures."""
    out = np.empty((len(signature), COORDINATES // ROWS), U)
    for i in range(out.shape[1]):
        h = np.full(len(signature), i + 1, U)
        for column in signature[:, i * ROWS : (i + 1) * ROWS].T:
            h = mix(h * U(0xFF51AFD7ED558CCD) + column.astype(U))
        out[:, i] = h
    return out


def digest_of(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def lists_of(rows: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists; none of the rows is null."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).ravel()))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), signature, keys; the last three null if the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, offsets = shingle_sets(part.column("text"), width)
                sizes = np.diff(offsets)
                there = np.flatnonzero(sizes)
                found = minima(values, offsets[there]) if len(there) else np.zeros((0, COORDINATES), np.uint32)
                place = np.full(len(sizes), -1)
                place[there] = np.arange(len(there))
                at = pa.array(place, mask=place < 0)
                digests = pa.array([digest_of(values[offsets[i] : offsets[i + 1]]) for i in there], pa.binary())
                columns = (digests, lists_of(found.view(np.int32)), lists_of(band_keys(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes.astype(np.int64)), *(c.take(at) for c in columns)], names=["doc_id", "n_shingles", "digest", "signature", "keys"])

    return map_arrow(with_texts(docs), ["doc_id", "text"], "doc_id bigint, n_shingles bigint, digest binary, signature array<int>, keys array<bigint>", run)


def _compare(width: int, percent: int):
    """For texts in the order of (lead, part, role), the leader's own (role 0) before its rows': whether a row is linked, sizes, the difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, own = None, np.zeros(0, U)
        for batch in batches:
            for part in slices(batch, "text"):
                values, offsets = shingle_sets(part.column("text"), width)
                out: list[tuple] = []
                keys = (part.column(c).to_pylist() for c in ("lead", "part", "role", "id", "digest"))
                for i, (lead, place, role, row, digest) in enumerate(zip(*keys, strict=True)):
                    held = values[offsets[i] : offsets[i + 1]]
                    if digest != digest_of(held):
                        continue  # another text of this doc_id
                    if role == 0:
                        here, own = (lead, place), held.copy()
                    elif here == (lead, place):
                        common = np.intersect1d(own, held, assume_unique=True)
                        extra, missing = np.setdiff1d(held, common, assume_unique=True), np.setdiff1d(own, common, assume_unique=True)
                        union = len(own) + len(held) - len(common)
                        # Elements of the row alone are odd, those of the leader alone are even.
                        delta = np.concatenate([extra | U(1), missing & ~U(1)]).view(np.int64)
                        out.append((lead, row, len(common) * 100 >= union * percent, len(own), len(held), delta))
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=["lead", "id", "linked", "n_lead", "n", "delta"])

    return run


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, digest, component_id of every row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = scratch.keep(signatures(docs, width))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "n_shingles", "signature", "keys"))
    classes = signed.filter("digest is not null").groupBy("digest").agg(least.alias("row"))
    classes = scratch.keep(classes.select(F.monotonically_increasing_id().alias("id"), "digest", F.col("row.doc_id").alias("doc_id"), "row.n_shingles", "row.signature", "row.keys"))
    known = classes.filter("doc_id is not null")

    each = known.select("id", F.explode("keys").alias("key"))
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("often")).filter("often > 1").select("key")
    met = scratch.keep(each.join(often, "key"))
    # The more keys a class shares, the more central it is among its copies: lists are led by such a one.
    postings = met.join(met.groupBy("id").agg(F.count(F.lit(1)).alias("weight")), "id").withColumn("facts", F.lit(0))
    size_fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent

    def judge(pairs: DataFrame) -> DataFrame:
        side = lambda n: known.select(F.col("id").alias(n), F.col("signature").alias(f"{n}_signature"))
        agree = F.aggregate(F.zip_with("lead_signature", "id_signature", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
        counted = pairs.join(side("id"), "id").join(side("lead"), "lead").select("lead", "id", agree.alias("agree"))
        return counted.filter(F.col("agree") >= MET).select("lead", "id", (F.col("agree") >= NEAR).alias("near"))

    judged, left = elections(postings, judge, scratch)
    if not judged:
        return _named(signed, classes, None, scratch)
    agree = lambda x, y: F.aggregate(F.zip_with(f"{x}signature", f"{y}signature", lambda s, t: (s == t).cast("int")), F.lit(0), lambda n, c: n + c) >= NEAR
    sizes = lambda x, y: size_fits(F.col(f"{x}n_shingles"), F.col(f"{y}n_shingles"))
    retained = all_pairs(left, known.select("id", "signature", "n_shingles"), lambda x, y: F.when(sizes(x, y), agree(x, y)).otherwise(False)).select(F.col("a").alias("lead"), F.col("b").alias("id"))
    for more in judged:
        retained = retained.unionAll(more.select("lead", "id"))
    retained = scratch.keep(retained.distinct())
    held = retained.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    leads = held.select(F.col("lead").alias("id"), "lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    rows = retained.join(held, "lead").select("id", "lead", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
    places = leads.unionAll(rows).join(known.select("id", "doc_id", "digest"), "id")
    texts = with_texts(docs).join(places, "doc_id").select("lead", "part", "role", "id", "digest", "text")
    compared = texts.repartition(parts, "lead", "part").sortWithinPartitions("lead", "part", "role").mapInArrow(_compare(width, percent), "lead bigint, id bigint, linked boolean, n_lead bigint, n bigint, delta array<bigint>")
    compared = scratch.keep(compared)  # repeated rows of docs give a pair again
    links = compared.filter("linked").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    roots = components(links, scratch)
    more = _beside_leaders(compared, roots, percent, size_fits, scratch)
    if not more.isEmpty():
        roots = components(links.unionAll(more), scratch)
    return _named(signed, classes, roots, scratch)


def _beside_leaders(compared: DataFrame, roots: DataFrame, percent: int, size_fits, scratch: Scratch) -> DataFrame:
    """a, b: similar rows of one leader in different components, by an element that their differences have in common.

    Sets of s and m elements whose differences from their leader have x and y elements are similar if these have at least
    (x + y - (s + m) * (100 - percent) / (100 + percent)) / 2 elements in common. Elements are ordered by how many rows of the
    leader have them, rare ones first, so the first common one is at most that number from the end of either's. The least
    values of this bound, over all rows that may be met, give the prefixes.
    """
    of = lambda name: roots.select(F.col("id").alias(name), F.col("root").alias(f"{name}_root"))
    rooted = compared.join(of("id"), "id", "left").join(of("lead"), "lead", "left")
    rooted = rooted.withColumns({"id_root": F.coalesce("id_root", "id"), "lead_root": F.coalesce("lead_root", "lead"), "differ": F.size("delta")})
    stray = ~F.col("linked") & (F.col("id_root") != F.col("lead_root"))
    rooted = scratch.keep(rooted.withColumn("stray", stray).select("lead", "id", "id_root", "n_lead", "n", "differ", "delta", "stray").dropDuplicates(["lead", "id"]))
    context = rooted.join(rooted.filter("stray").select("lead").distinct(), "lead", "left_semi")
    low, high = 100 - percent, 100 + percent
    of_stray = F.greatest(F.lit(1), F.ceil(F.col("differ") - F.col("n") * low * (1 + 100 / percent) / high - 1e-9))
    of_row = F.greatest(of_stray, F.ceil((F.col("differ") * high + (F.col("n_lead") - F.col("n")) * low) / (2 * high) - 1e-9))
    cells = context.select("lead", "id", F.explode("delta").alias("element"))
    often = cells.groupBy("lead", "element").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    ranked = cells.join(often, ["lead", "element"]).groupBy("lead", "id").agg(F.array_sort(F.collect_list(F.struct("often", "element"))).alias("shared"))
    facts = context.select("lead", "id", "id_root", "n_lead", "n", "differ", "stray")
    ranked = scratch.keep(ranked.select("lead", "id", F.col("shared.element").alias("shared")).join(facts, ["lead", "id"]))

    def side(df: DataFrame, name: str, least) -> DataFrame:
        """Rows of the prefix; elements that no other row has are before all others, and need no row."""
        alone = F.col("differ") - F.size("shared")
        cut = F.slice("shared", F.lit(1), F.greatest(F.col("differ") - least + 1 - alone, F.lit(0)).cast("int"))
        placed = F.transform(cut, lambda e, i: F.struct(e.alias("element"), (alone + i).alias("at")))
        rows = df.select("lead", "id", "id_root", "n", "differ", F.explode(placed).alias("e"))
        return rows.select("lead", "e.element", *(F.col(c).alias(f"{name}_{c}") for c in ("id", "id_root", "n", "differ")), F.col("e.at").alias(f"{name}_at"))

    met = scratch.keep(side(ranked.filter("stray"), "s", of_stray)).join(side(ranked, "m", of_row), ["lead", "element"])
    common = (F.col("s_differ") + F.col("m_differ")) * high - (F.col("s_n") + F.col("m_n")) * low
    placed = F.least(F.col("s_differ") - F.col("s_at"), F.col("m_differ") - F.col("m_at")) * (2 * high) >= common
    tried = met.filter((F.col("s_id_root") != F.col("m_id_root")) & size_fits("s_n", "m_n") & placed)
    tried = scratch.keep(tried.groupBy(F.col("s_id").alias("s"), F.col("m_id").alias("m")).agg(F.min("lead").alias("lead")))
    whole = lambda name: rooted.select("lead", F.col("id").alias(name), F.col("n").alias(f"{name}_n"), F.col("delta").alias(f"{name}_delta"))
    both = tried.join(whole("s"), ["lead", "s"]).join(whole("m"), ["lead", "m"])
    apart = F.size("s_delta") + F.size("m_delta") - 2 * F.size(F.array_intersect("s_delta", "m_delta"))
    return scratch.keep(both.filter(apart * high <= (F.col("s_n") + F.col("m_n")) * low).select(F.col("s").alias("a"), F.col("m").alias("b")))


def _named(signed: DataFrame, classes: DataFrame, roots: DataFrame | None, scratch: Scratch) -> DataFrame:
    """The smallest doc_id of each row's component; classes with a null doc_id have none."""
    named = classes.select("id", "digest", "doc_id")
    if roots is not None:
        rooted = named.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        # Written, so that both sides of the join are dealt out for it and Spark can split a root with many classes.
        named = rooted.join(scratch.keep(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))), "root")
    else:
        named = named.withColumn("component_id", F.col("doc_id"))
    # An empty set has no class: its rows keep their own digest (null), which no key of the join is.
    out = signed.filter("digest is not null").select("doc_id", "n_shingles", "digest").join(named.select("digest", "component_id"), "digest")
    out = out.select("doc_id", "n_shingles", "digest", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionAll(signed.filter("digest is null").select("doc_id", "n_shingles", "digest", F.col("doc_id").alias("component_id")))


def kept_documents(docs: DataFrame, width: int) -> DataFrame:
    """Rows of docs but for those with a smaller doc_id in their component. Rows without words or with a null doc_id stay."""
    found = near_duplicates(docs.select("doc_id", "text"), width).filter("digest is not null").select("doc_id", "component_id")
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op4_minhash(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    found = near_duplicates(docs, width=2)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                               ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w
), e AS (SELECT doc_id, unnest(s) AS x FROM s),
n AS (SELECT doc_id, len(s) AS n FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c * 100 >= (na.n + nb.n - c) * 80),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.id),
comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, comp.root AS component_id, n.doc_id = comp.root AS kept FROM n JOIN comp ON comp.id = n.doc_id
"""
