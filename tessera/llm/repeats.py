"""Operator 9 - removal of long repeats with run-length indexes (run-compressed Burrows-Wheeler transforms).

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (smaller doc_id, or earlier in the text).

1. Each window of LENGTH bytes belongs to its minimizer (anchor), the position of its least-hashed ``GRAM`` bytes. Equal
   windows have equal anchors at equal places. The consecutive windows of one anchor make a region. Regions are met by
   the hash of their anchor: of equal regions all but the first are repeats as a whole (first inside a batch of
   documents, so that a passage that a third of all texts holds becomes a few rows, then over the corpus); regions whose
   anchor occurs with other surroundings too are contested; the great rest, anchors that occur once, is done.
2. The bytes of contested regions are gathered by anchor into texts of about ``INDEX_BYTES``, in the order of the corpus.
   Of each the Burrows-Wheeler transform is built and reduced to its runs with a sample at each run's head: the suffix
   there, the one before it in suffix order, and how long they agree. From these samples the matching statistics of
   all positions are streamed in the order of the text: between two samples the match moves along with the position and
   gets a byte shorter at each step. Matches of LENGTH or more tie equal windows; all but the first of each tie are
   marked.
3. An anchor with more than ``MOST_REGIONS`` different surroundings would make one text too long. Its regions are cut
   again, by another minimizer of their windows, and go through 1 and 2 as before: equal windows stay together. What is as
   frequent after ``LEVELS`` cuts is dealt out by the 128-bit hashes of its windows, and all but the first are marked.
4. The marks of a document meet its text, and the bytes they cover go.

Texts are UTF-8 bytes, null is empty, matches never cross documents. Rows with equal doc_id and text are one document and
get the same result; of equal doc_ids with different texts the position decides. Null doc_ids come first, by the hash
of the text. A text is scanned in pieces of ``PIECE`` bytes, however long it is. An empty table
gives no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.blocks import U, block, mix, prefix, slices, span_hash
from tessera.llm.common import Scratch

LENGTH = 100
GRAM = 24
INDEX_BYTES = 1 << 19
MOST_REGIONS = 20_000
LEVELS = 4
PIECE = 1 << 22
PLACE_BITS = 24
#: Null doc_ids are numbered from here, by text.
NO_ID = -(2**63)
#: A place in one long: start of the windows, 24 bits of the text's hash, and how many windows.
VERSION_BITS, COUNT_BITS = 24, 7


def place(start: np.ndarray, version: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << (VERSION_BITS + COUNT_BITS)) | (version.astype(np.int64) << COUNT_BITS) | count


def start_of(places: np.ndarray) -> np.ndarray:
    return places >> (VERSION_BITS + COUNT_BITS)


def count_of(places: np.ndarray) -> np.ndarray:
    return places & ((1 << COUNT_BITS) - 1)


def version_of(places: np.ndarray) -> np.ndarray:
    return (places >> COUNT_BITS) & ((1 << VERSION_BITS) - 1)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each width consecutive values: running minima inside blocks, from either side."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def regions(data: np.ndarray, ends: np.ndarray, level: int = 0) -> tuple[np.ndarray, ...]:
    """start, count, anchor hash, region hash of the windows in data; ends has the end of its document for each byte."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U))
    if len(data) < LENGTH:
        return none
    sums = prefix(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = span_hash(sums, at, at + GRAM)
    ranked = (mix(grams ^ mix(np.array([level], U))) & ~U((1 << PLACE_BITS) - 1)) | at.astype(U)
    anchor = (sliding_least(ranked, LENGTH - GRAM + 1) & U((1 << PLACE_BITS) - 1)).astype(np.int64)
    starts = np.arange(len(anchor))
    fits = starts + LENGTH <= ends[: len(anchor)]
    begins = np.flatnonzero(fits & np.append(True, (anchor[1:] != anchor[:-1]) | ~fits[:-1] | (ends[1 : len(anchor)] != ends[: len(anchor) - 1])))
    if not len(begins):
        return none
    # A region ends before the next one, or where windows no longer fit.
    stop = np.append(begins[1:], len(anchor))
    count = np.minimum(stop, ends[begins] - LENGTH + 1) - begins
    return begins, count, grams[anchor[begins]], span_hash(sums, begins, begins + count + LENGTH - 1)


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a block small enough for regions(): bytes, ends, document of each byte, and its position in the document."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for at in range(0, len(data), PIECE):
        # The next part begins with the windows that don't fit here.
        cut = slice(at, min(len(data), at + PIECE + LENGTH - 1))
        own = owner[cut]
        yield data[cut], np.minimum(offsets[own + 1], cut.stop) - at, own, np.arange(cut.start, cut.stop) - offsets[own]


def firsts(key: np.ndarray, doc: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, document and place; and which of those in order are not their key's first (nor equal to it)."""
    order = np.lexsort((places, doc, key))
    k, d, p = key[order], doc[order], places[order]
    head = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(head, np.arange(len(k)), 0)) if len(k) else np.zeros(0, np.int64)
    return order, (d != d[first]) | (p != p[first])


def _batch(h, sig, doc, places) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(h).view(np.int64)), pa.array(np.asarray(sig).view(np.int64)), pa.array(doc), pa.array(places)], names=["h", "sig", "doc", "place"])


ROWS = "h bigint, sig bigint, doc bigint, place bigint"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions of texts (h, sig, doc, place); repeats inside a batch come as marks (sig 0)."""
    for batch in batches:
        found: list[tuple] = []
        for part in slices(batch, "text"):
            data, offsets = block(part.column("text"))
            ids, versions = part.column("doc").to_numpy(zero_copy_only=False), part.column("version").to_numpy(zero_copy_only=False)
            for chunk, ends, owner, inside in pieces(data, offsets):
                start, count, h, sig = regions(chunk, ends)
                who = owner[start]
                found.append((h, sig | U(1), ids[who], place(inside[start], versions[who], count)))
        if found:
            h, sig, doc, places = (np.concatenate(x) for x in zip(*found, strict=True))
            order, again = firsts(sig, doc, places)
            h, sig = h[order], np.where(again, U(0), sig[order])
            h = np.where(again, mix(doc[order].view(U)), h)  # marks are dealt out by document
            yield _batch(h, sig, doc[order], places[order])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of h, sig, doc, place. Gives marks (sig 0), and contested firsts with their h (sig 1)."""
    # Of the last h seen: h, its last sig, the first doc and place of that sig, and whether that first was given already.
    last: tuple | None = None
    for batch in batches:
        h, sig, doc, places = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "sig", "doc", "place"))
        real = sig != 0
        marks = [(doc[~real], places[~real])]
        h, sig, doc, places = h[real], sig[real], doc[real], places[real]
        contested: tuple = (h[:0], doc[:0], places[:0])
        if len(h):
            if last:
                h, sig, doc, places = (np.append(np.int64(v), x) for v, x in zip(last[:4], (h, sig, doc, places), strict=True))
            new_h = np.append(True, h[1:] != h[:-1])
            new_sig = new_h | np.append(True, sig[1:] != sig[:-1])
            first = np.maximum.accumulate(np.where(new_sig, np.arange(len(h)), 0))
            again = (doc != doc[first]) | (places != places[first])
            marks.append((doc[again], places[again]))
            heads = np.flatnonzero(new_sig)
            same = h[heads][1:] == h[heads][:-1]  # another sig of the same h is beside it
            side = np.append(same, False) | np.append(False, same)
            if last:
                side[0] = side[0] or last[4]  # of an h that began in an earlier batch
                give = side.copy()
                give[0] = side[0] and not last[4]
            else:
                give = side
            at = heads[give]
            contested = (h[at], doc[at], places[at])
            tail = first[-1]
            last = (h[tail], sig[tail], doc[tail], places[tail], bool(side[-1]))
        d, p = (np.concatenate(x) for x in zip(*marks, strict=True))
        yield _batch(np.append(np.zeros(len(d), np.int64), contested[0]), np.append(np.zeros(len(d), np.int64), np.ones(len(contested[0]), np.int64)), np.append(d, contested[1]), np.append(p, contested[2]))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a text with unique end marks, by prefix doubling."""
    n = len(symbols)
    rank, reach = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
    while True:
        wide = max(1, int(rank.max()).bit_length() + 1)
        steps = max(1, min(3, 63 // wide - 1))
        key = rank + 1
        for s in range(1, steps + 1):
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - s * reach)] = rank[s * reach :] + 1
            key = (key << wide) | ahead
        order = np.argsort(key, kind="stable")
        changed = np.append(False, key[order][1:] != key[order][:-1])
        rank[order] = np.cumsum(changed)
        reach *= steps + 1
        if rank[order[-1]] == n - 1:
            return order


class RunIndex:
    """Runs of the Burrows-Wheeler transform of a text, with samples at their heads.

    at: text positions of the suffixes at run heads, ascending. other: the suffixes before those in suffix order. agree: for
    how many bytes both agree, up to an end mark.
    """

    def __init__(self, symbols: np.ndarray):
        order = suffix_array(symbols)
        bwt = symbols[order - 1]
        # End marks all differ, so that each is a run of its own.
        heads = np.flatnonzero(np.append(False, bwt[1:] != bwt[:-1]))
        self.runs = len(heads) + 1
        at, other = order[heads], order[heads - 1]
        # Whole regions agree for some hundred bytes at most: compare byte by byte, those left over only.
        agree, left = np.zeros(len(at), np.int64), np.arange(len(at))
        while len(left):
            a, b = at[left] + agree[left], other[left] + agree[left]
            left = left[symbols[a] == symbols[b]] if len(left) else left
            agree[left] += 1
        by_text = np.argsort(at)
        self.at, self.other, self.agree = at[by_text], other[by_text], agree[by_text]

    def matching_statistics(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each position: how long it agrees with the suffix before it in suffix order, and where that one is."""
        sample = np.searchsorted(self.at, np.arange(n), "right") - 1
        past = np.arange(n) - self.at[np.maximum(sample, 0)]
        length = np.where(sample >= 0, self.agree[np.maximum(sample, 0)] - past, 0)
        return np.maximum(length, 0), np.where(length > 0, self.other[np.maximum(sample, 0)] + past, -1)


def repeated_windows(texts: list[bytes]) -> list[np.ndarray]:
    """For regions in the order of the corpus: which of each one's windows occur in an earlier one."""
    sizes = np.array([len(t) for t in texts])
    symbols = np.empty(int(sizes.sum()) + len(texts), np.int64)
    is_end = np.zeros(len(symbols), bool)
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    is_end[offsets[1:] - 1] = True
    symbols[~is_end] = np.frombuffer(b"".join(texts), np.uint8)
    symbols[is_end] = 256 + np.arange(len(texts))
    n = len(symbols)
    length, other = RunIndex(symbols).matching_statistics(n)
    tied = np.flatnonzero(length >= LENGTH)
    root = np.arange(n)
    root[tied] = other[tied]
    while (root[root] != root).any():  # the top of each tie, by jumps
        root = root[root]
    least = np.arange(n)
    np.minimum.at(least, root, np.arange(n))
    again = least[root] < np.arange(n)
    return [np.flatnonzero(again[a : b - LENGTH]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contested regions in order of h, doc, place (columns h, doc, place, bytes): marks."""
    held: list[tuple] = []
    size = 0

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[1], r[2]))
        doc, places = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        again = repeated_windows([r[3] for r in rows])
        who = np.repeat(np.arange(len(rows)), [len(a) for a in again])
        inner = np.concatenate(again) if again else np.zeros(0, np.int64)
        head = np.flatnonzero(np.append(True, (np.diff(who) != 0) | (np.diff(inner) != 1)))[: len(inner)]
        count = np.diff(np.append(head, len(inner)))
        marks = place(start_of(places[who[head]]) + inner[head], version_of(places[who[head]]), count)
        return _batch(np.zeros(len(head), np.int64), np.zeros(len(head), np.int64), doc[who[head]], marks)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("h", "doc", "place", "bytes")), strict=True):
            if held and row[:3] == held[-1][:3]:
                continue  # a repeated row of the table
            if size >= INDEX_BYTES and row[0] != held[-1][0]:
                yield flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield flush(held)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the regions wanted of each text (columns doc, version, text, wanted)."""
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = block(part.column("text"))
            out: list[tuple] = []
            for i, (doc, version, wanted) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc", "version", "wanted")), strict=True)):
                own = data[offsets[i] : offsets[i + 1]]
                for w in wanted:
                    p = np.int64(w["place"])
                    if version_of(p) == version:
                        out.append((w["h"], doc, int(p), own[int(start_of(p)) : int(start_of(p) + count_of(p)) + LENGTH - 1].tobytes(), w["hot"]))
            names = ["h", "doc", "place", "bytes", "hot"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()), strict=True)], names=names)


def _cut_again(level: int):
    """Regions of contested regions (h, doc, place, bytes) by the minimizers of this level; their h also depends on the old one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for old, doc, p, raw in zip(*(batch.column(c).to_pylist() for c in ("h", "doc", "place", "bytes")), strict=True):
                start, count, h, sig = regions(np.frombuffer(raw, np.uint8), np.full(len(raw), len(raw)), level)
                p = np.int64(p)
                found.append((mix(h ^ mix(np.array([old], np.int64).view(U))), sig | U(1), np.full(len(h), doc), place(start_of(p) + start, np.full(len(h), version_of(p)), count)))
            if found:
                yield _batch(*(np.concatenate(x) for x in zip(*found, strict=True)))

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of regions of hot anchors as a row, by two hashes; repeats inside a batch come as marks."""
    for batch in batches:
        found: list[tuple] = []
        for doc, p, raw in zip(*(batch.column(c).to_pylist() for c in ("doc", "place", "bytes")), strict=True):
            at = np.arange(len(raw) - LENGTH + 1)
            data = np.frombuffer(raw, np.uint8)
            p = np.int64(p)
            found.append((span_hash(prefix(data), at, at + LENGTH), span_hash(prefix(data ^ 0x5A), at, at + LENGTH) | U(1), np.full(len(at), doc), place(start_of(p) + at, np.full(len(at), version_of(p)), np.ones(len(at), np.int64))))
        if found:
            h, sig, doc, places = (np.concatenate(x) for x in zip(*found, strict=True))
            order, again = firsts(h ^ mix(sig), doc, places)
            h = np.where(again, mix(doc[order].view(U)), h[order])
            yield _batch(h, np.where(again, U(0), sig[order]), doc[order], places[order])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, kept bytes, n_bytes, n_removed, n_spans of texts (columns doc_id, version, text, marks)."""
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = block(part.column("text"))
            rows = []
            for i, (version, marks) in enumerate(zip(part.column("version").to_pylist(), part.column("marks").to_pylist(), strict=True)):
                own = data[offsets[i] : offsets[i + 1]]
                places = np.array(marks or [], np.int64)
                places = places[version_of(places) == version]
                cover = np.zeros(len(own) + 1, np.int32)
                np.add.at(cover, start_of(places), 1)
                np.add.at(cover, start_of(places) + count_of(places) + LENGTH - 1, -1)
                gone = np.cumsum(cover[:-1]) > 0
                rows.append((own[~gone].tobytes(), len(own), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, n_spans (maximal removed runs) of every row of docs."""
    scratch = Scratch(docs.sparkSession)
    version = F.pmod(F.xxhash64("text"), F.lit(1 << VERSION_BITS))
    texts = docs.select("doc_id", F.coalesce("doc_id", NO_ID + F.xxhash64("text").bitwiseAND(2**62 - 1)).alias("doc"), F.coalesce("text", F.lit("")).alias("text")).withColumn("version", version)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def resolved(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "h").sortWithinPartitions("h", "sig", "doc", "place").mapInArrow(_resolve, ROWS)

    rows, level, marks = texts.select("doc", "version", "text").mapInArrow(_scan, ROWS), 0, None
    while rows is not None:
        found = scratch.keep(resolved(rows))
        contested = found.filter("sig = 1").select("h", "doc", "place")
        hot = scratch.keep(contested.groupBy("h").count().filter(F.col("count") > MOST_REGIONS).select(F.col("h").alias("hot_h")))
        flagged = contested.join(hot, F.col("h") == F.col("hot_h"), "left").select("h", "doc", "place", F.col("hot_h").isNotNull().alias("hot"))
        wanted = flagged.groupBy("doc").agg(F.collect_list(F.struct("h", "place", "hot")).alias("wanted"))
        fetched = scratch.keep(texts.join(wanted, "doc").select("doc", "version", "text", "wanted").mapInArrow(_fetch, "h bigint, doc bigint, place bigint, bytes binary, hot boolean"))
        indexed = fetched.filter("not hot").select("h", "doc", "place", "bytes").repartition(parts, "h").sortWithinPartitions("h", "doc", "place").mapInArrow(_index, ROWS)
        more = found.filter("sig = 0").unionAll(indexed)
        marks, level, rows = more if marks is None else marks.unionAll(more), level + 1, None
        if not hot.isEmpty():
            left = fetched.filter("hot").select("h", "doc", "place", "bytes")
            if level <= LEVELS:
                rows = left.mapInArrow(_cut_again(level), ROWS)
            else:
                marks = marks.unionAll(resolved(left.select("doc", "place", "bytes").mapInArrow(_windows, ROWS)).filter("sig = 0"))
    marks = marks.groupBy("doc").agg(F.collect_list("place").alias("marks"))
    return texts.join(marks, "doc", "left").select("doc_id", "version", "text", "marks").mapInArrow(_cut, "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")


def op9_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs."""
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
