"""Word and shingle hashing over Arrow string columns, vectorised with numpy.

A word is a longest run of bytes other than space and U+0009..U+000D; A-Z count
as a-z. Both classes are ASCII, so the work is done on UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

CHUNK = 1 << 15  # so that what a step works on stays in the cache
SLICE_BYTES, SLICE_ROWS = 4 << 20, 4096
BUCKETS = 1 << 17

ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x + np.uint64((0x632BE59BD9B4E019 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


BYTE = mix(np.arange(1, 257, dtype=np.uint64), 7)
_TABLES = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK * 2
    while size < n:
        size *= 2
    if size not in _TABLES:
        _TABLES.clear()
        _TABLES[size] = (_powers(ODD, size + 1), _powers(_INVERSE, size + 1))
    return _TABLES[size]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and len(raw) else np.zeros(0, dtype=np.uint8)
    return data, offsets


def slices(batches: Iterator[pa.RecordBatch], column: str, rows: int = SLICE_ROWS) -> Iterator[tuple]:
    """(batch slice, bytes, offsets from 0) of bounded size; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = utf8(batch.column(column))
        low = 0
        while low < batch.num_rows:
            high = int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, side="right")) - 1
            high = min(max(high, low + 1), low + rows, batch.num_rows)
            yield (batch.slice(low, high - low), data[offsets[low]: offsets[high]],
                   offsets[low: high + 1] - offsets[low])
            low = high


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; spans are in order and disjoint."""
    out = np.empty(len(starts), dtype=np.uint64)
    low = 0
    while low < len(starts):
        high = max(int(np.searchsorted(ends, starts[low] + CHUNK, side="right")), low + 1)
        first, last = int(starts[low]), int(ends[high - 1])
        up, down = _tables(last - first + 1)
        sums = np.zeros(last - first + 1, dtype=np.uint64)
        np.cumsum(np.take(BYTE, data[first:last], mode="clip") * up[: last - first], out=sums[1:])
        s, e = starts[low:high] - first, ends[low:high] - first
        out[low:high] = (sums[e] - sums[s]) * down[s]
        low = high
    return mix(out ^ (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a text's bounds always end a word."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of words before each text."""
    starts, ends = word_spans(data, offsets)
    return span_hashes(LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of all n-word shingles; fewer words give one of them all."""
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(hashes))
    full = at + n <= bounds[1:][owner]
    short = np.flatnonzero((counts > 0) & (counts < n))
    begin = np.concatenate([at[full], bounds[:-1][short]])
    owner = np.concatenate([owner[full], short])
    length = np.concatenate([np.full(int(full.sum()), n), counts[short]])
    out = length.astype(np.uint64)
    whole = len(begin) - len(short)
    for k in range(n):
        m = whole if not len(short) else len(begin)
        if m == whole:
            out = mix(out * ODD + hashes[begin + k])
        else:
            take = k < length
            out[take] = mix(out[take] * ODD + hashes[begin[take] + k])
    return owner, out


def order_of(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Order by owner, then value."""
    order = np.argsort(values)
    small = np.uint16 if not len(owner) or owner.max() < 1 << 16 else np.int64
    return order[np.argsort(owner[order].astype(small), kind="stable")]


def distinct_sorted(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value), sorted."""
    order = order_of(owner, values)
    owner, values = owner[order], values[order]
    keep = np.ones(len(owner), dtype=bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return owner[keep], values[keep]


def set_keys(owner: np.ndarray, values: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Order-free 64-bit key of each owner's set."""
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(values, seed), dtype=np.uint64)])
    bounds = np.searchsorted(owner, np.arange(n + 1))
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64), seed).view(np.int64)


def parity(owner: np.ndarray, values: np.ndarray, n: int, longs: int) -> list[np.ndarray]:
    """Bit i tells whether an odd number of the set's values hash to i.

    Two sets differ in at least as many values as their bits differ.
    """
    bits = 64 * longs
    slot = owner.astype(np.int64) * bits + (mix(values, 3) & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(slot, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return list(np.packbits(odd, axis=1).view(np.int64).T)


def parity_bytes(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """:func:`parity` with a number of bits that goes with the set's size: a power of two from 64, two a value or more.

    The bits of a shorter row are those of a longer one, cut into pieces of its length and combined by XOR.
    """
    size = np.bincount(owner, minlength=n)
    width = np.int64(1) << np.maximum(np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64), 6)
    begin = np.concatenate([[0], np.cumsum(width)])
    slot = begin[owner] + (mix(values, 3).view(np.int64) & (width[owner] - 1))
    odd = (np.bincount(slot, minlength=int(begin[-1])) & 1).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), n, [
        None, pa.py_buffer((begin // 8).astype(np.int32).tobytes()), pa.py_buffer(np.packbits(odd).tobytes())])


def bucket(values: np.ndarray) -> np.ndarray:
    """Slot of each value in the table of corpus frequencies."""
    return (mix(values, 5) & np.uint64(BUCKETS - 1)).view(np.int64)


def rarity_class(counts: np.ndarray) -> np.ndarray:
    """0 (rare) to 255: eight steps for each doubling of the count, relative to the mean."""
    return np.clip(8 * np.log2(np.maximum(counts, 1) / max(counts.mean(), 1)) + 128, 0, 255).astype(np.uint8)


def ranked(values: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Tokens whose numeric order is rare first: class byte, then 56 bits of hash."""
    return (classes[bucket(values)].astype(np.uint64) << np.uint64(56)) | (values >> np.uint64(8))
