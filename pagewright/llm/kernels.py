"""Vectorised text kernels over Arrow buffers: word spans, word fingerprints, rolling hashes.

All work on bytes of UTF-8. A batch is cut into slices of whole rows, so that memory is bounded by the slice
(or by the longest single text) and not by the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
# Odd 64-bit multipliers and their inverses modulo 2**64.
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xD6E8FEB86659FD93 | 1
SLICE_BYTES = 1 << 20
#: The low bytes of a piece that belong to a span, by their number.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
_POWERS: dict = {}

SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = True
ALNUM_WORDS[0x61:0x7B] = True
ALNUM_WORDS[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i below n (at least)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, U(base)), np.full(size, U(pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if size <= 1 << 22:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, so that the low and high bits of a polynomial hash are usable."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def column_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column without nulls, and its row offsets."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, ends


def slices(column: pa.Array, most: int = SLICE_BYTES):
    """Runs of whole rows with at most ``most`` bytes (a longer single row stands alone): (first row, bytes, offsets)."""
    raw, ends = column_buffers(column)
    at, rows = 0, len(ends) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        to = min(to, rows)
        yield at, raw[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


class Words:
    """Words of some rows: byte spans, row of each word, and 64-bit fingerprints."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = alphabet[data]
        # a word also ends where its row ends
        turn = np.empty(len(data) + 1, dtype=bool)
        turn[0] = turn[-1] = True
        np.not_equal(inside[1:], inside[:-1], out=turn[1:-1])
        turn[offsets] = True
        edges = np.flatnonzero(turn)
        opens = inside[edges[:-1]] if len(data) else np.zeros(0, bool)
        self.starts, self.ends = edges[:-1][opens], edges[1:][opens]
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self._row = self._hash = self._eight = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def row(self) -> np.ndarray:
        if self._row is None:
            self._row = np.repeat(np.arange(len(self.counts), dtype=np.int64), self.counts)
        return self._row

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.hash_of()
        return self._hash

    @property
    def eight(self) -> np.ndarray:
        """The eight bytes from each place on, as a view."""
        if self._eight is None:
            self._eight = np.ndarray((len(self.data) + 1,), np.dtype("<u8"), np.concatenate([self.data, np.zeros(8, np.uint8)]), strides=(1,))
        return self._eight

    def hash_of(self, seed: int = 0) -> np.ndarray:
        return span_hash(self.eight, self.starts, self.ends, seed)


def same_spans(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Whether each span of ``a`` has the bytes of its span of ``b`` (both as ``Words.eight``)."""
    sizes = a_ends - a_starts
    out = sizes == b_ends - b_starts
    at, open_ = 0, np.flatnonzero(out)
    while len(open_):
        mask = _MASKS[np.minimum(sizes[open_] - at, 8)]
        same = ((a[a_starts[open_] + at] ^ b[b_starts[open_] + at]) & mask) == 0
        out[open_[~same]] = False
        at += 8
        open_ = open_[same & (sizes[open_] > at)]
    return out


def same_words(a: Words, x: np.ndarray, b: Words, y: np.ndarray) -> np.ndarray:
    """Whether words ``x`` of ``a`` have the bytes of words ``y`` of ``b``."""
    return same_spans(a.eight, a.starts[x], a.ends[x], b.eight, b.starts[y], b.ends[y])


def span_hash(eight: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Fingerprints of byte spans of one byte or more (``eight``: see ``Words``): the mixed sum of their mixed eight-byte pieces, each with a key of its place.

    The pieces go through ``mix`` one by one, so no arrangement of equal bytes can cancel out as in a polynomial; another
    ``seed`` gives an independent fingerprint.
    """
    if not len(starts):
        return np.zeros(0, U)
    key = U((seed * 2 + 1) * WORD_BASE & ((1 << 64) - 1))
    sizes = ends - starts
    out = mix((eight[starts] & _MASKS[np.minimum(sizes, 8)]) + key) + sizes.astype(U)
    long = np.flatnonzero(sizes > 8)
    for a in range(0, len(long), step := 1 << 16):
        part = long[a : a + step]
        more = (sizes[part] - 1) >> 3
        for b, c in runs_of(more, 1 << 18):
            some, count = part[b:c], more[b:c]
            first = np.cumsum(count) - count
            place = np.arange(int(count.sum())) - np.repeat(first, count) + 1
            left = np.repeat(sizes[some], count) - 8 * place
            piece = eight[np.repeat(starts[some], count) + 8 * place] & _MASKS[np.minimum(left, 8)]
            out[some] += np.add.reduceat(mix(piece + key * (2 * place + 1).astype(U)), first)
    return mix(out)


def runs_of(counts: np.ndarray, most: int):
    """Ranges of ``counts`` that sum up to about ``most``; a larger one stands alone."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def prefix_sums(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and inverse powers, from which ``run_hash`` takes the hash of any run of words."""
    up, down = powers(WORD_BASE, len(h) + 1)
    sums = np.zeros(len(h) + 1, dtype=U)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return sums, down


def run_hash(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    if len(x) < width:
        return x[:0]
    span, cur = 1, x
    while span * 2 <= width:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    rest = width - span
    return np.minimum(cur[: len(cur) - rest], cur[rest:]) if rest else cur


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: int | None = None) -> np.ndarray:
    """Bytes of the spans one after another, each followed by the byte ``gap`` if given; a bounded number of them at a time."""
    sizes = ends - starts
    step = sizes + (gap is not None)
    edge = np.append(0, np.cumsum(step))
    out = np.empty(int(edge[-1]), np.uint8)
    for a, b in runs_of(step, 1 << 20):
        at = edge[a:b] - edge[a]
        index = np.arange(int(edge[b] - edge[a]), dtype=np.int64)
        index += np.repeat(starts[a:b] - at, step[a:b])
        if gap is None:
            out[edge[a] : edge[b]] = data[index]
            continue
        last = at + sizes[a:b]
        index[last] = 0
        piece = data[index]
        piece[last] = gap
        out[edge[a] : edge[b]] = piece
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + n)``."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
