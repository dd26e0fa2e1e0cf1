"""Operator 6 - byte-pair encoding and decoding by a contiguous rank array.

A word is a list of parts with the rank of each adjacent pair beside it. The lowest rank is found by a scan, its
boundary is deleted and the two neighbouring ranks are looked up anew, until no pair has a rank. Words are short, so
the scan beats a heap; beyond ``SHORT`` parts the same merges are drawn from a heap, so that a long run of letters
costs n log n. The vocabulary file (format of the public ``tokenizers`` library) is read on the driver and broadcast;
its size is fixed by the tokenizer. Each worker keeps a bounded cache of encoded words.

Null text is empty; an empty text has no tokens and decodes to an empty text. Rows are mapped one by one: repeated
rows and ties stay, other columns are left out.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.llm.blocks import slices
from tessera.llm.common import map_arrow, with_texts

NONE = 1 << 60
ID_BITS = 20
ID_MASK = (1 << ID_BITS) - 1
SHORT = 128
CACHED_WORDS = 50_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable Latin-1, else 256 and up in turn."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Words(dict):
    """Encoded pieces; a missing one is encoded, and kept unless it is long. When full, a generation goes."""

    def __init__(self, word):
        self.word, self.old = word, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece) or array("i", self.word(piece)).tobytes()
        if len(piece) <= SHORT:
            self[piece] = ids
        return ids


#: What the supported files split words by, and an equal pattern for the re module, with the classes to fill in.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
FAST_PIECE = "[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^{spaces}{letters}{numbers}]+"


def character_class(pattern: str) -> str:
    """The characters of the basic plane that a pattern of the regex module matches, as ranges for the re module."""
    hits = [x.span() for x in regex.finditer(f"{pattern}+", "".join(map(chr, range(0xD800))))]
    high = [(a + 0xE000, b + 0xE000) for a, b in (x.span() for x in regex.finditer(f"{pattern}+", "".join(map(chr, range(0xE000, 0x10000)))))]
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in hits + high)


class Encoder:
    """The tokenizer described by a file of the supported shape; anything else in the file is refused."""

    def __init__(self, spec: dict):
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"] or spec["decoder"] or spec["post_processor"] or model["type"] != "BPE":
            raise ValueError("this tokenizer's shape is not supported")
        if steps[0]["pattern"]["Regex"] != PIECE or spec["normalizer"]["normalizers"][1] != {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}:
            raise ValueError("this tokenizer's patterns are not supported")
        # No piece holds white space, so that replacing runs of it by a space changes no piece and is left out.
        self.pieces = regex.compile(PIECE).findall
        self.fast_pieces = re.compile(FAST_PIECE.format(letters=character_class(r"\p{L}"), numbers=character_class(r"\p{N}"), spaces=character_class(r"\s"))).findall
        self.astral = re.compile("[\U00010000-\U0010ffff]").search
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.letters = byte_letters()
        # By a pair of ids in one integer: the rank and the id of the merged token in one integer, so that the least is the next merge.
        self.merges: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges.setdefault(self.vocab[a] << ID_BITS | self.vocab[b], rank << ID_BITS | self.vocab[a + b])
        names = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.cache = Words(self.word)

    def word(self, piece: str) -> list[int]:
        """Token ids of one piece of the pre-tokenizer."""
        symbols = [self.letters[b] for b in piece.encode()]
        symbols[-1] += self.suffix
        parts = [self.vocab[s] for s in symbols if s in self.vocab]
        return self.scan(parts) if len(parts) <= SHORT else self.heap(parts)

    def scan(self, parts: list[int]) -> list[int]:
        rank_of = self.merges.get
        ranks = [rank_of(a << ID_BITS | b, NONE) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while ranks and (least := min(ranks)) != NONE:
            i = ranks.index(least)
            parts[i] = least & ID_MASK
            del parts[i + 1], ranks[i]  # the boundary goes
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << ID_BITS | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] << ID_BITS | parts[i + 1], NONE)
        return parts

    def heap(self, parts: list[int]) -> list[int]:
        """The merges of scan(), least rank first and leftmost among equals."""
        n = len(parts)
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        merge_at = lambda i, j: self.merges.get(parts[i] << ID_BITS | parts[j])
        heap = [(m, i, i + 1) for i in range(n - 1) if (m := merge_at(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, j = heapq.heappop(heap)
            if not (alive[i] and alive[j]) or after[i] != j or merge_at(i, j) != m:
                continue
            parts[i], alive[j] = m & ID_MASK, False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (m := merge_at(left, right)) is not None:
                    heapq.heappush(heap, (m, left, right))
        return [p for p, there in zip(parts, alive, strict=True) if there]

    def plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # letter by letter: a capital sigma never becomes the final form
        return b"".join(map(self.cache.__getitem__, (self.pieces if self.astral(text) else self.fast_pieces)(text)))

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers, one after the other. Strings of the added tokens are single tokens."""
        if not self.split or not any(a in text for a in self.added):
            return self.plain(text)
        return b"".join(np.int32(self.added[x]).tobytes() if x in self.added else self.plain(x) for x in self.split.split(text))


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder, and so one cache, for each worker process and broadcast."""
    if shared.value["key"] not in _encoders:
        _encoders.clear()
        _encoders[shared.value["key"]] = Encoder(shared.value["spec"])
    return _encoders[shared.value["key"]]


def encode(docs: DataFrame, path: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids array<int> for every whole text of docs; carry names further columns of docs to keep."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({"key": path, "spec": load(path)})
    kept = docs.select("doc_id", *carry).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(shared)
        for batch in batches:
            for part in slices(batch, "text"):
                coded = [own.encode(t.as_py() or "") for t in part.column("text")]
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept.names), ids], names=[*kept.names, "ids"])

    schema = T.StructType([*kept.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return map_arrow(docs, [*kept.names, F.coalesce("text", F.lit("")).alias("text")], schema, run)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """Replaces ids by text: the tokens' own strings with a space between, as a tokenizer without a decoder gives them."""
    spark = coded.sparkSession
    names = spark.sparkContext.broadcast(Encoder(load(path)).names)
    kept = coded.drop("ids").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(names.value, pa.large_string())
        for batch in batches:
            step = 1000
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = part.column("ids")
                flat = ids.flatten()
                offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                tokens = pa.LargeListArray.from_arrays(pa.array(offsets), vocabulary.take(flat))
                text = pc.binary_join(tokens, pa.scalar(" ", pa.large_string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept.names), text], names=[*kept.names, "text"])

    return coded.mapInArrow(run, T.StructType([*kept.fields, T.StructField("text", T.StringType())]))


def op6_bpe(docs: DataFrame, path: str) -> DataFrame:
    """The digests of the contract, from the tokens of encode() and the texts of decode()."""
    coded = encode(with_texts(docs), path)
    coded = coded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"))
    return decode(coded, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))
