"""Best-fit packing by exact-complement hashing.

Documents become token ids; those longer than a sequence are cut. Only the number of pieces of each
length (at most as many numbers as a sequence has tokens) reaches the driver, which plans patterns of
lengths and how often each is used: for each length, longest first, the gap it leaves is looked up
among the available single lengths, sums of pairs and sums of triples, and whatever fills it exactly is
consumed as often as the availability counts allow (an index of sums finds them, ``Sums``); what is left goes best-fit, longest first. Pieces
of one length are interchangeable, so a piece's rank among those of its length decides its place.
Ranks come from a prefix sum over (partition, length) counts; no group is gathered.

Cases: a null or empty text is one piece of one token (the separator); very long texts are cut to pieces, whole; ties between
pieces of equal length go by partition and position; repeated rows, and rows without doc_id, are packed each; other columns,
whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import unicodedata
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from . import textscan as ts
from .base import written

#: Distinct words kept per worker before the table starts afresh.
KNOWN_WORDS = 400_000
SEPARATOR = 0


def agreed(library) -> np.ndarray:
    """Whether a code point is its own composed form, never joins a neighbour, and has the lower case and the class that the
    library gives it. The library's tables of characters may be of another edition than Python's, so it is asked."""
    out = np.zeros(0x110000, bool)
    kind, low = ts.char_classes(), ts.lower_table()
    some = []
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and not 0x1100 <= c < 0x1200:
            x = chr(c)
            if unicodedata.combining(x) == 0 and unicodedata.category(x)[0] != "M" and len(x.lower()) == 1 and unicodedata.normalize("NFC", x) == x:
                some.append(c)
    lower = library.normalizer.normalize_str
    out[[c for c in some if kind[c] == ts.SPACE and lower(chr(c)) == " "]] = True
    some = [c for c in some if kind[c] != ts.SPACE]
    # Many at once, a line each; one by one where the lines don't come back
    for i in range(0, len(some), 512):
        part = some[i : i + 512]
        got = lower("\n".join(map(chr, part))).split(" ")
        if len(got) != len(part):
            got = [lower(chr(c)) for c in part]
        out[[c for c, x in zip(part, got) if x == chr(low[c])]] = True
    some = [c for c in some if out[c]]
    for around, alone in (("a", ts.LETTER), ("!", ts.OTHER)):
        # Between two of its class a character makes one piece with them, else three pieces.
        found = library.pre_tokenizer.pre_tokenize_str("\n".join(around + chr(low[c]) + around for c in some))
        pieces = np.bincount(np.array([at[0] for _, at in found], np.int64) // 4, minlength=len(some))
        out[np.array(some)[pieces != np.where(kind[low[some]] == alone, 1, 3)]] = False
    return out


class Encoder:
    """Token ids of whole texts for a lower-casing word vocabulary; equal to the tokenizers library's, without special
    tokens at the ends. Texts that need composition or a longer lower case, or hold special tokens or characters on which
    Python's tables and the library's differ, go through the library."""

    def __init__(self, path: str) -> None:
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.special = sorted(t.content for t in self.library.get_added_tokens_decoder().values())
        self.machine, self.splitter = bpe.Automaton(path), bpe.Splitter(spaced=False)
        self.simple = agreed(self.library)
        self._forget()

    def _forget(self) -> None:
        self.known = ts.Table(16)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 1  # the first entry is the separator
        self.first, self.size, self.n = np.zeros(1 << 14, np.int64), np.ones(1 << 14, np.int32), 1
        self.pool[0] = SEPARATOR

    def _learn(self, keys: np.ndarray, flat: np.ndarray, off: np.ndarray) -> None:
        ids, size = self.machine.ids(flat, off)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.n + len(keys) > len(self.first):
            self.first, self.size = np.concatenate([self.first, np.zeros_like(self.first)]), np.concatenate([self.size, np.zeros_like(self.size)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[self.n : self.n + len(keys)] = self.used + np.cumsum(size) - size
        self.size[self.n : self.n + len(keys)] = size
        self.known.add(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.used += len(ids)
        self.n += len(keys)

    def texts(self, values: pa.Array) -> Iterator[np.ndarray]:
        """For each text its ids and the separator."""
        values = values.fill_null("")
        odd = np.zeros(len(values), bool)
        for s in self.special:
            odd |= np.asarray(pyarrow.compute.match_substring(values, s))
        for block in ts.blocks(values):
            slow = odd[block.first : block.first + block.n].copy()
            cp, _, off = block.chars()
            if len(cp):
                hard = np.flatnonzero(~self.simple[cp])
                slow[np.searchsorted(off, hard, "right") - 1] = True
            ids, first = self._block(block)
            for i in range(block.n):
                if slow[i]:
                    got = self.library.encode(values[block.first + i].as_py(), add_special_tokens=False).ids
                    yield np.array([*got, SEPARATOR], np.uint32)
                else:
                    yield ids[first[i] : first[i + 1]]

    def _block(self, block: ts.Block) -> tuple[np.ndarray, np.ndarray]:
        cp, at, off = block.chars()
        low = ts.lower_table()[np.minimum(cp, 0xFFFF)]
        start = self.splitter.starts(low, off)
        if len(start):
            # A piece ends where the next starts, or before the white space that follows it.
            end = np.append(start[1:], len(low))
            space = ts.char_classes()[low] == ts.SPACE
            solid_end = ts.runs(~space, off)[1]
            end = np.minimum(end, solid_end[np.minimum(np.searchsorted(solid_end, start, "right"), len(solid_end) - 1)])
            h = ts.Rolling(ts.codes_of(low)).of(start, end)
            idx = self.known.find(h)
            new = np.flatnonzero(idx < 0)
            if len(new):
                if self.known.n > KNOWN_WORDS:
                    self._forget()
                    new = np.arange(len(h))
                keys, one = ts.distinct(h[new])
                one = new[one]
                flat, flat_off = _utf8(low, start[one], end[one])
                self._learn(keys, flat, flat_off)
                idx[new] = self.known.find(h[new])
        else:
            idx = np.zeros(0, np.int32)
        where = np.searchsorted(start, off[1:])  # a separator after each document's words
        idx = np.insert(idx, where, 0)
        size = self.size[idx]
        total = np.zeros(len(idx) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.pool[np.repeat(self.first[idx] - total[:-1], size) + np.arange(total[-1])].astype(np.uint32)
        first = np.zeros(block.n + 1, np.int64)
        first[1:] = total[where + np.arange(1, block.n + 1)]
        return ids, first


def _utf8(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of stretches of code points."""
    size = end - start
    first = np.cumsum(size) - size
    chars = cp[np.repeat(start - first, size) + np.arange(size.sum())]
    wide = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
    off = np.zeros(len(start) + 1, np.int64)
    total = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(wide, out=total[1:])
    off[1:] = total[first + size]
    text = chars.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8")
    return np.frombuffer(text, np.uint8), off


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and each piece's partition and rank among that partition's pieces of its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            doc, piece, start, length, crc, nth = [], [], [], [], [], []
            for d, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).texts(batch.column(1))):
                raw = memoryview(ids.astype("<u4").tobytes())
                for k, at in enumerate(range(0, len(ids), capacity)):
                    n = min(capacity, len(ids) - at)
                    doc.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                    nth.append(seen[n])
                    seen[n] += 1
            if doc:
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(doc), pa.int32()), pa.array(nth, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


class Sums:
    """The available sums of one, two and three lengths. For each sum a pointer tells the longest member of the first pair (or
    triple) with that sum that may still be available. Availability only falls, so pointers only move on, and all lookups
    together take as many steps as there are (sum, length) pairs."""

    def __init__(self, count: np.ndarray) -> None:
        self.count = count.tolist()
        self.lengths = [n for n in range(len(self.count) - 1, 0, -1) if self.count[n]]
        self.two = [0] * len(self.count)
        self.three = [0] * len(self.count)

    def has(self, *lengths: int) -> bool:
        return all(self.count[n] >= lengths.count(n) for n in set(lengths))

    def pair(self, total: int, *taken: int) -> tuple[int, int] | None:
        """The available a >= b with a + b = total besides the taken lengths, with the longest a."""
        at, moving = self.two[total], True
        while at < len(self.lengths):
            a = self.lengths[at]
            b = total - a
            if b > a:
                break
            if b > 0 and self.has(a, b):
                moving = False
                if self.has(a, b, *taken):
                    return a, b
            at += 1
            if moving:
                self.two[total] = at
        return None

    def triple(self, total: int, *taken: int) -> tuple[int, int, int] | None:
        """Likewise a with a pair that makes up the rest."""
        at, moving = self.three[total], True
        while at < len(self.lengths):
            a = self.lengths[at]
            if total - a >= 2 and self.count[a]:
                if rest := self.pair(total - a, a):
                    moving = False
                    if self.has(a, *rest, *taken):
                        return a, *rest
                    if rest := self.pair(total - a, a, *taken):
                        return a, *rest
            at += 1
            if moving:
                self.three[total] = at
        return None


def plan(available: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, and how many sequences follow each."""
    c = np.zeros(capacity + 1, np.int64)
    for k, v in available.items():
        c[k] = v
    sums = Sums(c)
    out: list[tuple[tuple[int, ...], int]] = []

    def use(*lengths: int) -> None:
        times = min(sums.count[x] // lengths.count(x) for x in set(lengths))
        for x in lengths:
            sums.count[x] -= times
        out.append((lengths, times))

    for n in range(capacity, 0, -1):
        gap = capacity - n
        if sums.count[n] and not gap:
            use(n)
        if gap and sums.has(n, gap):
            use(n, gap)
        while sums.count[n] and gap >= 2 and (two := sums.pair(gap, n)):
            use(n, *two)
        while sums.count[n] and gap >= 3 and (three := sums.triple(gap, n)):
            use(n, *three)
    c = sums.count
    # Best fit: sequences of one pattern are handled together, by the gap that they leave.
    open_: dict[int, list[list]] = {}

    def put(gap: int, lengths: tuple[int, ...], times: int) -> None:
        if gap:
            open_.setdefault(gap, []).append([lengths, times])
        else:
            out.append((lengths, times))

    for n in range(capacity, 0, -1):
        left = int(c[n])
        while left:
            gap = min((g for g in open_ if g >= n), default=None)
            if gap is None:
                k = capacity // n
                if left >= k:
                    put(capacity - k * n, (n,) * k, left // k)
                if left % k:
                    put(capacity - (left % k) * n, (n,) * (left % k), 1)
                break
            lengths, times = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
            fit = min(gap // n, max(1, left // times)) if left >= times else 1
            filled = times if left >= times else left
            put(gap - fit * n, lengths + (n,) * fit, filled)
            if filled < times:
                put(gap, lengths, times - filled)
            left -= fit * filled
    out += [(x, t) for group in open_.values() for x, t in group]
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """For stretches of ranks of pieces of one length: the length and first rank (as one sorted key), the first sequence, and the offset."""
    used: dict[int, int] = {}
    key, sequence, offset, base = [], [], [], 0
    for lengths, times in patterns:
        at = 0
        for n in lengths:
            rank = used.get(n, 0)
            key.append((n << 44) | rank)
            sequence.append(base)
            offset.append(at)
            used[n] = rank + times
            at += n
        base += times
    order = np.argsort(np.array(key, np.int64))
    return np.array(key, np.int64)[order], np.array(sequence, np.int64)[order], np.array(offset, np.int64)[order]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, capacity), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    available = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    known = spark.sparkContext.broadcast(slots(plan(available, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, sequence, offset = known.value
        want = (batch.column(3).to_numpy() << 44) | batch.column(5).to_numpy()
        at = np.searchsorted(key, want, "right") - 1
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[at] + want - key[at]), pa.array(offset[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    from .base import per_batch

    return ranked.mapInArrow(per_batch(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
