"""Operator 8 - mixing sources to target weights, with DataFrame functions only.

1. Sizes (words) are summed by source, and targets found by filling each source up to ``max_epochs`` times its size.
2. The documents of a source are packed end to end into blocks of ``block_words`` words. Offsets are prefix sums in two
   levels (hashed buckets, then inside a bucket), so that a source with a third of all rows is not one task.
3. Each source gets its target's number of slots. The mix has as many places, in output shards of ``SHARD_SLOTS``. A
   pseudorandom permutation draws a slot for each place without replacement, so a shard's source counts are a multinomial
   draw conditioned on the totals: those hit the targets to within two blocks (the last block of a source is short).
4. A slot is mapped to a block by the source's own pseudorandom permutation; a further round over the blocks begins
   when each has been taken. Places and blocks meet in a join by (source, block).

Both permutations are swap-or-not shuffles: keyed, without state, on any range, and so the same in each run, and made by
as many tasks as the session has partitions. ``mix`` gives the shards themselves.

Null text has size 0 and takes part with nothing; a null source is a source, the last. Repeated rows are packed one by
one. Of an empty table the result is empty. Other columns are left out (``mixed_documents`` keeps them, in a struct, so that
names can't clash). A text of any length is cut into pieces of a block; its words are split once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.common import SPACE_CLASS, WORD, Scratch, bound

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2
BLOCK_WORDS = 64
SHARD_SLOTS = 1024
SEED = 42
ROUNDS = 24
BUCKETS = 1 << 16
SLOT_CHUNK = 8192


def shuffled(index: Column, n: Column, *key: Column) -> Column:
    """The place of index in a keyed pseudorandom permutation of 0 to n - 1 (swap-or-not shuffle)."""

    def swap(x: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit("pivot"), i, *key), n) - x, n)
        return F.when(F.xxhash64(F.lit("swap"), i, F.greatest(x, partner), *key).bitwiseAND(1) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("bigint"), swap)


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, number (by code point, null last), source_size, weight, target of a frame with source and size."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    numbered = sources.withColumn("number", F.row_number().over(by_name) - 1)
    numbered = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("double"))
    numbered = numbered.withColumns({"full": F.col("source_size") * float(max_epochs), "budget": F.sum("source_size").over(everything) * budget, "all_weight": F.sum("weight").over(everything)})
    # Sources fill up in the order of full / weight; one is full if what the earlier ones leave reaches it.
    earlier = Window.orderBy(F.col("full") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("full").over(earlier), F.lit(0.0))
    share = F.col("weight") / (F.col("all_weight") - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    filled = numbered.withColumn("is_full", F.col("full") <= left * share)
    rest = F.col("budget") - F.sum(F.when(F.col("is_full"), F.col("full")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("is_full"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("is_full"), F.col("full")).otherwise(rest * F.col("weight") / open_weight)
    return filled.select("source", "number", "source_size", "weight", target.alias("target"))


def slots(targets: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """shard, place, number, block, epoch: one row for each place of the mix."""
    spark = targets.sparkSession
    plan = targets.filter("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block_words))
    plan = plan.withColumn("wanted", F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("bigint"))
    in_order = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumn("before", F.coalesce(F.sum("wanted").over(in_order), F.lit(0))).filter("wanted > 0")
    total = plan.agg(F.coalesce(F.sum("wanted"), F.lit(0))).first()[0]
    # A source's slots are a range of all; ranges meet draws by the chunks that they are in.
    chunks = F.sequence(F.floor(F.col("before") / SLOT_CHUNK), F.floor((F.col("before") + F.col("wanted") - 1) / SLOT_CHUNK))
    ranges = plan.select("number", "blocks", "before", (F.col("before") + F.col("wanted")).alias("after"), F.explode(chunks).alias("chunk"))
    places = spark.range(0, total, 1, int(spark.conf.get("spark.sql.shuffle.partitions"))).withColumn("drawn", shuffled(F.col("id"), F.lit(max(total, 1)), F.lit(seed)))
    drawn = places.withColumn("chunk", F.floor(F.col("drawn") / SLOT_CHUNK)).join(ranges, "chunk").filter("drawn >= before AND drawn < after").withColumn("k", F.col("drawn") - F.col("before"))
    return drawn.select(
        F.floor(F.col("id") / SHARD_SLOTS).alias("shard"),
        (F.col("id") % SHARD_SLOTS).alias("place"),
        "number",
        shuffled(F.col("k") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("number")).alias("block"),
        F.floor(F.col("k") / F.col("blocks")).alias("epoch"),
    )


def packed(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows of sized (doc_id, source, size, text_key) with number, bucket, row and offset: where each begins in its source."""
    rows = sized.join(targets.select("source", "number", "source_size", "target"), sized["source"].eqNullSafe(targets["source"]), "left").drop(targets["source"])
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(BUCKETS)))
    sums = rows.groupBy("number", "bucket").agg(F.sum("size").alias("held"))
    sums = sums.withColumn("start", F.coalesce(F.sum("held").over(Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("held")
    inside = Window.partitionBy("number", "bucket").orderBy("doc_id", "text_key")
    rows = rows.withColumns({"row": F.row_number().over(inside), "inner": F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return rows.join(sums, ["number", "bucket"]).withColumn("offset", F.col("start") + F.col("inner")).drop("start", "inner")


def pieces(rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """packed() cut at block boundaries: block, and first and last word of the piece in its document (from 0, last excluded)."""
    blocks = F.sequence(F.floor(F.col("offset") / block_words), F.floor((F.col("offset") + F.col("size") - 1) / block_words))
    cut = rows.filter("size > 0").withColumn("block", F.explode(blocks))
    return cut.withColumns({"first": F.greatest(F.lit(0), F.col("block") * block_words - F.col("offset")), "last": F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("offset"))})


def sized_documents(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, source, size, text_key of every row; written, since words are counted for several uses."""
    return scratch.keep(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64("text").alias("text_key")))


def taken_pieces(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """pieces() of the blocks that the mix takes, with times and the shards that they are in."""
    times = slots(targets).groupBy("number", "block").agg(F.count(F.lit(1)).alias("times"), F.collect_set("shard").alias("shards"))
    # Slots are made from a few rows, by whose size Spark would take them for small enough to broadcast: they grow with the corpus.
    return pieces(rows).join(times.hint("merge"), ["number", "block"])


def op8_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_shards (of the mix, that hold some of it) for every row of docs."""
    sized = sized_documents(docs, scratch := Scratch(docs.sparkSession))
    targets = scratch.keep(source_targets(sized))
    rows = packed(sized, targets)
    taken = taken_pieces(rows, targets).groupBy("number", "bucket", "row")
    taken = taken.agg(F.sum((F.col("last") - F.col("first")) * F.col("times")).alias("taken"), F.size(F.array_distinct(F.flatten(F.collect_list("shards")))).alias("n_shards"))
    out = rows.join(taken.hint("merge"), ["number", "bucket", "row"], "left")
    return out.select("doc_id", "size", "source_size", "target", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("taken", "n_shards")))


def _copies(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs and packed rows with the same key: rows with one doc_id and one text are told apart by a number."""
    over = lambda *order: Window.partitionBy("doc_id", "text_key").orderBy(*order)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"), F.struct(*docs.columns).alias("whole"))
    texts = texts.withColumn("copy", F.row_number().over(over(F.col("whole.source").isNull(), "whole.source")))
    return texts, rows.withColumn("copy", F.row_number().over(over(F.col("source").isNull(), "source", "number", "bucket", "row")))


def _with_texts(texts: DataFrame, spans: DataFrame) -> DataFrame:
    same = texts["doc_id"].eqNullSafe(spans["doc_id"]) & (texts["text_key"] == spans["text_key"]) & (texts["copy"] == spans["copy"])
    return texts.join(spans.hint("merge"), same).drop(spans["doc_id"], spans["text_key"], spans["copy"])


def words_of(text: Column) -> Column:
    """Words, each with the white space after it."""
    return F.regexp_extract_all(text, F.lit(rf"{WORD}[{SPACE_CLASS}]*"), F.lit(0))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: shard, place, epoch, doc_id, first (word of the document that the piece begins with), text of each piece of each place."""
    sized = sized_documents(docs, scratch := Scratch(docs.sparkSession))
    targets = scratch.keep(source_targets(sized))
    texts, rows = _copies(docs, packed(sized, targets))
    cut = pieces(rows).select("doc_id", "text_key", "copy", "number", "block", "first", "last")
    placed = cut.join(slots(targets).hint("merge"), ["number", "block"])
    spans = placed.groupBy("doc_id", "text_key", "copy").agg(F.collect_list(F.struct("shard", "place", "epoch", "first", "last")).alias("spans"))
    each = bound(words_of(F.col("text")), lambda w: F.transform("spans", lambda s: F.struct(s["shard"].alias("shard"), s["place"].alias("place"), s["epoch"].alias("epoch"), s["first"].alias("first"), F.array_join(F.slice(w, (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int")), "").alias("text"))))
    return _with_texts(texts, spans).select("doc_id", F.explode(each).alias("s")).select("s.shard", "s.place", "s.epoch", "doc_id", "s.first", "s.text")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each epoch a row of each document that has words in it, with those words and the white space after them."""
    sized = sized_documents(docs, scratch := Scratch(docs.sparkSession))
    targets = scratch.keep(source_targets(sized))
    texts, rows = _copies(docs, packed(sized, targets))
    taken = taken_pieces(rows, targets)
    spans = taken.groupBy("doc_id", "text_key", "copy").agg(F.array_sort(F.collect_list(F.struct("first", "last", "times"))).alias("spans"))
    chosen = lambda epoch: F.filter("spans", lambda s: s["times"] >= epoch)
    made = lambda words, epoch: F.array_join(F.flatten(F.transform(chosen(epoch), lambda s: F.slice(words, (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int")))), "")
    rounds = F.sequence(F.lit(1), F.array_max(F.col("spans.times")).cast("int"))
    out = _with_texts(texts, spans).select("whole", F.explode(bound(words_of(F.col("text")), lambda words: F.transform(rounds, lambda epoch: made(words, epoch)))).alias("mixed"))
    changed = {"text": F.col("mixed"), "n_chars": F.length("mixed").cast("bigint")}
    return out.select(*(changed[c].alias(c) if c in changed else F.col("whole").getField(c).alias(c) for c in docs.columns))
