"""Vectorised text primitives over Arrow buffers: words, hashes and n-grams of a whole block of documents at once.

A block is (data, offsets): the UTF-8 bytes of its documents, one after the other, and where each begins.
Hashes are polynomial in the bytes modulo 2**64 (a prefix sum gives that of any substring), mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n at least; grown as needed and kept by the worker."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _powers[:] = [np.cumprod(np.concatenate([[U(1)], np.full(size - 1, U(b))]).astype(U)) for b in (BASE, INVERSE)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random value for each byte, so that the sums don't depend on small differences of codes.
BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def block(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_binary())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20, most: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most that many rows whose texts hold about limit bytes (one long text may be more)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit or i - start == most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the bytes' values times powers; entry i is for the first i bytes."""
    up, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, U)
    out[0] = 0
    np.cumsum(BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] for arrays of bounds."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word; words never cross documents."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_or(~solid[:-1], edge[1:n], out=before[1:])
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_or(~solid[1:], edge[1:n], out=after[:-1])
    start, end = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text, lower-cased (A-Z), one text after the other, and where each begins.

    A text with fewer words than width has its whole sequence as one shingle, one without words has none.
    """
    data, offsets = block(texts)
    n = len(offsets) - 1
    start, end, doc = words(data, offsets)
    if not len(start):
        return np.zeros(0, U), np.zeros(n + 1, np.int64)
    h = span_hash(prefix(LOWER[data]), start, end)
    first = np.searchsorted(doc, np.arange(n + 1))
    count = np.diff(first)
    rolled = np.zeros(len(h), U)
    inside = np.ones(len(h), bool)
    for k in range(width if len(h) >= width else 0):
        rolled[: len(h) - k] = rolled[: len(h) - k] * U(0xFF51AFD7ED558CCD | 1) + h[k:]
    inside[max(0, len(h) - width + 1) :] = False
    inside[:-1][doc[:-1] != doc[1:]] = width == 1
    for k in range(2, min(width, len(h))):
        inside[: len(h) - k][doc[: len(h) - k] != doc[k:]] = False
    values, owner = [mix(rolled[inside])], [doc[inside]]
    for d in np.flatnonzero((count > 0) & (count < width)):
        x = U(0)
        with np.errstate(over="ignore"):
            for v in h[first[d] : first[d + 1]]:
                x = x * U(0xFF51AFD7ED558CCD | 1) + v
            values.append(mix(np.array([x + U(count[d])], U)))
        owner.append(np.array([d]))
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(n + 1))
