"""Vectorised scanning of UTF-8 text columns.

Arrow string columns are read as flat byte buffers and cut into blocks of whole documents. Within a
block every step (decoding, case folding, word segmentation, hashing) is a pass over flat numpy
arrays, so no per-word Python objects are made. Memory is bounded by the block size, or by the
longest single document.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once.
BLOCK_BYTES = 1 << 20

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def _char_codes() -> np.ndarray:
    return mix(np.arange(1, 0x10001, dtype=U64) * U64(0xD1342543DE82EF95))


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE for every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """Simple lower case of the code points below 0x10000; those that map to several stay as they are."""
    out = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


class _Powers:
    def __init__(self) -> None:
        self.pow = np.ones(1, U64)
        self.inv = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pow) < n:
            size = max(n, 2 * len(self.pow), BLOCK_BYTES)
            up, down = np.full(size, U64(_BASE)), np.full(size, U64(pow(_BASE, -1, 1 << 64)))
            up[0] = down[0] = U64(1)
            self.pow, self.inv = np.cumprod(up), np.cumprod(down)
        return self.pow, self.inv


_POWERS = _Powers()


class Rolling:
    """Hashes of any stretches of a sequence of 64-bit codes, each in constant time."""

    def __init__(self, codes: np.ndarray) -> None:
        self.pow, self.inv = _POWERS.upto(len(codes) + 1)
        self.sums = np.empty(len(codes) + 1, U64)
        self.sums[0] = 0
        np.cumsum(codes * self.pow[: len(codes)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inv[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Never zero."""
        return mix(self.raw(start, end)) | U64(1)


def codes_of(cp: np.ndarray) -> np.ndarray:
    if len(cp) and cp.max() >= 0x10000:
        return mix((cp.astype(U64) + U64(1)) * U64(0xD1342543DE82EF95))
    return _char_codes()[cp]


def decode(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points, and the byte at which each starts."""
    high = buf >= 0x80
    if not high.any():
        return buf.astype(np.uint32), np.arange(len(buf))
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    cp = buf[at].astype(np.uint32)
    wide = np.flatnonzero(cp >= 0xC0)
    p, lead = at[wide], cp[wide]
    last = len(buf) - 1
    tail = [(buf[np.minimum(p + k, last)] & 0x3F).astype(np.uint32) for k in (1, 2, 3)]
    out = ((lead & 0x1F) << 6) | tail[0]
    three, four = lead >= 0xE0, lead >= 0xF0
    if three.any():
        out = np.where(three, ((lead & 0x0F) << 12) | (tail[0] << 6) | tail[1], out)
        out = np.where(four, ((lead & 0x07) << 18) | (tail[0] << 12) | (tail[1] << 6) | tail[2], out)
    cp[wide] = np.minimum(out, 0x10FFFF)
    return cp, at


class Block:
    """Whole documents, one after the other. byte_off and char_off have one entry more than there are documents."""

    def __init__(self, first: int, buf: np.ndarray, byte_off: np.ndarray) -> None:
        self.first, self.buf, self.byte_off, self.n = first, buf, byte_off, len(byte_off) - 1
        self._chars: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def chars(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points, their byte positions, and the documents' character offsets."""
        if self._chars is None:
            cp, at = decode(self.buf)
            off = self.byte_off if len(cp) == len(self.buf) else np.searchsorted(at, self.byte_off)
            self._chars = cp, at, off
        return self._chars


def column(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; nulls are empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    off = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64) if len(values) else np.zeros(1, np.int64)
    data = values.buffers()[2] if len(values) else None
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if values.null_count:
        gone = np.asarray(values.is_null())
        if (np.diff(off)[gone] > 0).any():
            return column(values.fill_null(""))
    return buf, off


def blocks(values: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    buf, off = column(values)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Block(i, buf[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def runs(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True within documents, and the first run of each document."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    change = np.empty(len(member), bool)
    change[0] = member[0]
    np.logical_and(member[1:], ~member[:-1], out=change[1:])
    heads = off[:-1][np.diff(off) > 0]
    change[heads] = member[heads]
    start = np.flatnonzero(change)
    stop = np.empty(len(member), bool)
    stop[-1] = member[-1]
    np.logical_and(member[:-1], ~member[1:], out=stop[:-1])
    tails = heads[1:] - 1
    stop[tails] = member[tails]
    return start, np.flatnonzero(stop) + 1, np.searchsorted(start, off)


def words(block: Block, digits: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, Rolling, np.ndarray]:
    """Lower-cased words (runs of letters, and of digits and underscores if asked for): starts, ends, the first word of
    each document, a hasher, and the lower-cased code points."""
    cp, _, off = block.chars()
    if len(cp) and cp.max() >= 0x10000:
        low = np.where(cp < 0x10000, lower_table()[np.minimum(cp, 0xFFFF)], cp)
    else:
        low = lower_table()[cp]
    kind = char_classes()[low]
    member = (kind <= NUMBER) | (low == 95) if digits else kind == LETTER
    start, end, first = runs(member, off)
    return start, end, first, Rolling(codes_of(low)), low


class Table:
    """A map from non-zero 64-bit keys to 32-bit values, looked up and filled many keys at a time (open addressing)."""

    def __init__(self, bits: int = 16) -> None:
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.vals = np.zeros(1 << bits, U64), np.zeros(1 << bits, np.int32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """-1 where a key is absent."""
        slot = self._slot(h)
        k = self.keys[slot]
        out = np.where(k == h, self.vals[slot], -1)
        left = np.flatnonzero((k != h) & (k != 0))
        mask = len(self.keys) - 1
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            s, want = slot[left], h[left]
            k = self.keys[s]
            hit = k == want
            out[left[hit]] = self.vals[s[hit]]
            left = left[~hit & (k != 0)]
        return out

    def add(self, h: np.ndarray, vals: np.ndarray) -> None:
        """The keys are distinct and absent."""
        if self.n + len(h) > 0.6 * len(self.keys):
            used = np.flatnonzero(self.keys)
            keys, old = self.keys[used], self.vals[used]
            bits = self.bits
            while len(keys) + len(h) > 0.4 * (1 << bits):
                bits += 1
            self._make(bits)
            self._put(keys, old)
        self._put(h, vals)

    def _put(self, h: np.ndarray, vals: np.ndarray) -> None:
        self.n += len(h)
        slot, mask = self._slot(h), len(self.keys) - 1
        left = np.arange(len(h))
        while len(left):
            s = slot[left]
            free = left[self.keys[s] == 0]
            self.keys[slot[free]] = h[free]
            done = self.keys[s] == h[left]
            self.vals[s[done]] = vals[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & mask


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the place of one occurrence of each."""
    order = np.argsort(h)
    s = h[order]
    keep = np.empty(len(s), bool)
    keep[:1] = True
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep], order[keep]


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]]."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
