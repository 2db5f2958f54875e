"""Removal of repeated byte strings by blockwise suffix sorting.

Every window of ``width`` bytes (a suffix, cut at that depth) belongs to one bucket: that of the least
hash among its ``SEED``-byte substrings, which depends on the window's bytes alone. Neighbouring windows
mostly share it, so stretches of text are sent to buckets as whole strings, compressed; of those that are equal in one flush
(``FLUSH_BYTES`` of text) one is sent, with the least and the largest doc_id that hold it, while all their places go home in one
row for each flush. Buckets are as many as the table's bytes ask for (``BUCKET_BYTES`` each). A seed that very many strings share
(a common line) is split further, by the second least hash, so its strings are dealt to many buckets. In a bucket

1. seeds that occur in one document only are dropped; strings whose bytes are equal are merged;
2. the strings are joined to texts of about ``SORT_ROWS`` windows; in each the ranks of
   a difference-cover sample (residues 0, 1, 3 modulo 7) of its suffixes are computed once, and its
   windows are sorted one suffix bucket at a time: by eight leading bytes, then, for the long ties, by
   the ranks of cover samples a few bytes further on, merging the seven residue classes;
3. neighbours in that order whose ``width`` bytes are equal share their smallest doc_id.

These smallest doc_ids go back to the flushes that sent a string, and meet its places there: a byte goes if it lies in a window
that also starts in a document of smaller doc_id. Hashes choose buckets; only bytes decide what is equal.

Cases: null text is empty; rows without doc_id keep their text and remove nothing; rows with one doc_id
never remove each other, and are expected to hold one text; texts shorter than ``width`` stay whole; very long texts are handled
whole, one at a time; matches never cross documents; an empty table gives no rows; other columns stay, but for kept, n_bytes,
n_removed and n_spans, which are replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan as ts
from .base import partitions, per_batch, written

U64 = np.uint64
SEED = 16
#: Bytes of text whose strings are sent on together.
FLUSH_BYTES = 6 << 20
#: Suffixes sorted at once.
SORT_ROWS = 1 << 18
#: Bytes of the table's text to a bucket.
BUCKET_BYTES = 4 << 20
#: Strings of one seed beyond which it is split (as told by one document in SAMPLED: it decides where strings go, and no result).
HOT, SAMPLED = 50_000, 64
_COVER = (0, 1, 3)
_IN_COVER = np.array([0, 1, -1, 2, -1, -1, -1])
_SHIFT = np.array([[next(d for d in range(7) if (a + d) % 7 in _COVER and (b + d) % 7 in _COVER) for b in range(7)] for a in range(7)])


def leading(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as big-endian numbers; zeros follow the end."""
    n = len(text)
    w = np.zeros(n + 8, U64)
    w[:n] = text
    w[:-1] = (w[:-1] << U64(8)) | w[1:]
    w[:-2] = (w[:-2] << U64(16)) | w[2:]
    w[:-4] = (w[:-4] << U64(32)) | w[4:]
    return w[:n]


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    s = keys[order]
    step = np.zeros(len(s), np.int64)
    np.cumsum(s[1:] != s[:-1], out=step[1:])
    out = np.empty(len(s), np.int64)
    out[order] = step + 1
    return out


class CoverSample:
    """Ranks of the sampled suffixes of a text, right to a depth of at least ``depth`` bytes."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        sevens = len(text) // 7 + 2
        w = np.zeros(sevens * 7, U64)
        w[: len(text)] = leading(text)
        self.w = w
        rank = _dense(w.reshape(-1, 7)[:, _COVER].ravel())
        reach, step = 8, 1
        while reach < depth and rank.max() < len(rank):
            nxt = np.zeros(len(rank), np.int64)
            nxt[: -3 * step or None] = rank[3 * step :]
            rank = _dense(((rank << 32) | nxt).astype(U64))
            reach, step = reach + 7 * step, 2 * step
        self.rank = rank

    def at(self, position: np.ndarray) -> np.ndarray:
        """The rank of the suffix at a sampled position."""
        return self.rank[3 * (position // 7) + _IN_COVER[position % 7]]

    def order(self, start: np.ndarray) -> np.ndarray:
        """Suffix starts in an order in which those that agree to the depth stand together."""
        head = self.w[start]
        order = np.argsort(head)
        s = head[order]
        fresh = np.ones(len(s), bool)
        fresh[1:] = s[1:] != s[:-1]
        tie = ~fresh
        tie[:-1] |= tie[1:]
        at = np.flatnonzero(tie)
        if not len(at):
            return start[order]
        group = np.cumsum(fresh)[at]
        p = start[order[at]]
        residue = p % 7
        classes = []
        for c in range(7):
            mine = np.flatnonzero(residue == c)
            far = int(_SHIFT[c].max())
            far = far if (c + far) % 7 in _COVER else int(_SHIFT[c, c])
            mine = mine[np.argsort((group[mine] << 32) | self.at(p[mine] + far), kind="stable")]
            classes.append(mine)
        place = np.empty(len(p), np.int64)
        for c, mine in enumerate(classes):
            total = np.arange(len(mine))
            for d, other in enumerate(classes):
                if d != c and len(other) and len(mine):
                    shift = int(_SHIFT[c, d])
                    a = (group[mine] << 32) | self.at(p[mine] + shift)
                    b = (group[other] << 32) | self.at(p[other] + shift)
                    total = total + np.searchsorted(b, a, "right" if d < c else "left")
            place[mine] = total
        out = start[order]
        out[at] = p[np.argsort(place, kind="stable")]
        return out

    def same(self, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
        """Whether two suffixes agree on ``width`` bytes."""
        ok = self.w[a] == self.w[b]
        last = len(self.w) - 1
        for k in [*range(8, width - 8, 8), width - 8]:
            left = np.flatnonzero(ok)
            ok[left] = self.w[np.minimum(a[left] + k, last)] == self.w[np.minimum(b[left] + k, last)]
        return ok


def least_owner(text: np.ndarray, start: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """For each window its smallest owner among the windows with the same bytes. start ascends."""
    sample = CoverSample(text, width)
    out = np.empty(len(start), np.int64)
    parts = -(-len(start) // SORT_ROWS)
    which = (ts.mix(sample.w[start]) % U64(parts)).astype(np.int64) if parts > 1 else None
    for k in range(parts):
        mine = np.flatnonzero(which == k) if parts > 1 else np.arange(len(start))
        if not len(mine):
            continue
        ordered = sample.order(start[mine])
        row = mine[np.searchsorted(start[mine], ordered)]
        cut = np.ones(len(ordered), bool)
        cut[1:] = ~sample.same(ordered[1:], ordered[:-1], width)
        heads = np.flatnonzero(cut)
        out[row] = np.repeat(np.minimum.reduceat(owner[row], heads), np.diff(np.append(heads, len(row))))
    return out


def stretches(block: ts.Block, width: int, hot: np.ndarray = np.zeros(0, U64)) -> tuple[np.ndarray, ...]:
    """Runs of windows with one least seed: document (in the block), byte in the block, number of windows, seed. Of windows whose
    seed is one of ``hot`` (ascending) the second least hash is taken too."""
    buf, off, n = block.buf, block.byte_off, len(block.buf)
    span = width - SEED + 1
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, np.zeros(0, U64)
    w = np.zeros(n + SEED, U64)
    w[:n] = leading(buf)
    h = w[:n] * U64(0x9E3779B97F4A7C15)
    h ^= (w[8 : n + 8] + U64(0x632BE59BD9B4E019)) * U64(0xC2B2AE3D27D4EB4F)
    h ^= h >> U64(29)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(32)
    m, reach = h, 1
    while 2 * reach <= span:
        m = np.minimum(m[:-reach], m[reach:])
        reach *= 2
    if reach < span:
        m = np.minimum(m[: len(m) - (span - reach)], m[span - reach :])
    if len(hot):
        at = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, m), len(hot) - 1)] == m)
        for lo in range(0, len(at), 1 << 16):
            some = at[lo : lo + (1 << 16)]
            near = h[np.minimum(some[:, None] + np.arange(span), len(h) - 1)]
            second = np.where(near == m[some, None], ~U64(0), near).min(axis=1)
            m[some] = ts.mix(m[some] ^ ts.mix(second))
    size = np.diff(off)
    ok = np.zeros(n + 1, np.int32)
    long = size >= width
    np.add.at(ok, off[:-1][long], 1)
    np.add.at(ok, off[1:][long] - width + 1, -1)
    ok = np.cumsum(ok[:n]) > 0
    m = m[: n - width + 1]
    ok = ok[: len(m)]
    fresh = np.ones(len(m), bool)
    np.not_equal(m[1:], m[:-1], out=fresh[1:])
    heads = off[:-1][long]
    fresh[heads] = True
    cut = fresh.copy()
    cut[1:] |= ok[1:] != ok[:-1]
    at = np.flatnonzero(cut)
    count = np.diff(np.append(at, len(m)))
    good = ok[at]
    at, count = at[good], count[good]
    return np.searchsorted(off, at, "right") - 1, at, count, m[at]


class Codec:
    """Compresses columns of numbers and a text, with the help of some sample text, which only makes the blobs smaller."""

    def __init__(self, sample: bytes) -> None:
        more = {"dict_data": zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if len(sample) >= 8 else {}
        self.compress = zstandard.ZstdCompressor(level=6, **more).compress
        self.decompress = zstandard.ZstdDecompressor(**more).decompress

    def pack(self, columns: list[np.ndarray], text: np.ndarray = np.zeros(0, np.uint8)) -> bytes:
        """Each column as differences from its least number: their lowest bytes, then the next, and so on, which compress apart."""
        out = [struct.pack("<q", len(columns))]
        for x in columns:
            x = x.astype(np.int64)
            least = int(x.min()) if len(x) else 0
            x = (x - least).view(U64)
            width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
            out += [struct.pack("<qqq", len(x), least, width), x.view(np.uint8).reshape(len(x), 8)[:, :width].T.tobytes()]
        return self.compress(b"".join([*out, text.tobytes()]))

    def unpack(self, blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
        raw = np.frombuffer(self.decompress(blob), np.uint8)
        (count,), at, out = struct.unpack_from("<q", raw), 8, []
        for _ in range(count):
            n, least, width = struct.unpack_from("<qqq", raw, at)
            at += 24
            x = np.zeros((n, 8), np.uint8)
            x[:, :width] = raw[at : at + n * width].reshape(width, n).T
            out.append(x.view(np.int64).ravel() + least)
            at += n * width
        return out, raw[at:]


def gather(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches text[start:start+size], one after the other."""
    first = np.cumsum(size) - size
    step = 1 << 12
    out = [text[np.repeat(start[i : i + step] - first[i : i + step] + first[i], size[i : i + step]) + np.arange(size[i : i + step].sum())] for i in range(0, len(start), step)]
    return np.concatenate(out) if out else np.zeros(0, text.dtype)


def _names(text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the strings that stand in the text one after the other, a part of the text at a time."""
    end = np.cumsum(size)
    out = np.empty(len(size), U64)
    i = 0
    while i < len(size):
        lo = end[i] - size[i]
        j = max(i + 1, int(np.searchsorted(end, lo + ts.BLOCK_BYTES, "right")))
        out[i:j] = ts.Rolling(ts._char_codes()[text[lo : end[j - 1]]]).of(end[i:j] - size[i:j] - lo, end[i:j] - lo)
        i = j
    return out


def _merged(text: np.ndarray, at: np.ndarray, size: np.ndarray, major: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by ``major`` in which strings with equal bytes stand together, and where a new string starts in it. Their
    hashes (``name``) bring them together, their bytes are compared."""
    order = np.lexsort((name, major))
    fresh = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    again = np.flatnonzero((name[a] == name[b]) & (major[a] == major[b]) & (size[a] == size[b]))
    step = 1 << 14
    for k in range(0, len(again), step):
        x, y = a[again[k : k + step]], b[again[k : k + step]]
        other = gather(text, at[x], size[x]) != gather(text, at[y], size[x])
        fresh[again[k : k + step] + 1] = np.logical_or.reduceat(other, np.cumsum(size[x]) - size[x])
    return order, fresh


def _send(width: int, buckets: int, sample: bytes, hot):
    """Rows (bucket, flush, blob): strings for their buckets, and, under bucket numbers beyond, a flush's places for its home."""

    def flush(name: int, held: list, codec: Codec) -> Iterator[tuple[int, int, bytes]]:
        base = np.cumsum([0, *(len(x[0]) for x in held)])
        text = np.concatenate([x[0] for x in held])
        doc, at, pos, count, seed, name_of = (np.concatenate([x[i] + base[j] if i == 2 else x[i] for j, x in enumerate(held)]) for i in range(1, 7))
        held.clear()
        size = count + (width - 1)
        bucket = ((ts.mix(seed) >> U64(33)) % U64(buckets)).astype(np.int64)
        seed = (seed & U64(0x7FFFFFFF)).astype(np.int64)
        order, fresh = _merged(text, at, size, (bucket << 31) | seed, name_of)
        doc, pos = doc[order], pos[order]
        heads = np.flatnonzero(fresh)
        times = np.diff(np.append(heads, len(order)))
        yield buckets + int(ts.mix(np.array([name], U64))[0] % U64(buckets)), name, codec.pack([times, doc, pos])
        low, high = np.minimum.reduceat(doc, heads), np.maximum.reduceat(doc, heads)
        one = order[heads]
        bucket, seed, at, size = bucket[one], seed[one], at[one], size[one]
        edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(one)]):
            yield int(bucket[i]), name, codec.pack([np.array([i]), np.diff(seed[i:j], prepend=0), size[i:j], low[i:j], high[i:j] - low[i:j]], gather(text, at[i:j], size[i:j]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, often = Codec(sample), hot.value
        name = TaskContext.get().partitionId() << 32
        held, held_bytes = [], 0

        def out() -> pa.RecordBatch:
            rows = list(flush(name, held, codec))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "flush", "blob"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for b in ts.blocks(batch.column(1), ts.BLOCK_BYTES // 2):
                doc, at, count, seed = stretches(b, width, often)
                if len(at):
                    name_of = ts.Rolling(ts._char_codes()[b.buf]).of(at, at + count + (width - 1))
                    held.append((b.buf, ids[b.first + doc].astype(np.int64), at, at - b.byte_off[doc], count, seed, name_of))
                    held_bytes += len(b.buf)
                if held_bytes >= FLUSH_BYTES:
                    yield out()
                    held_bytes, name = 0, name + 1
        if held:
            yield out()

    return send


def settle(flushes: list[int], blobs: list[bytes], width: int, codec: Codec | None = None) -> Iterator[tuple[int, bytes]]:
    """A bucket's strings that some document may have to give up, for each flush that sent them: number of the string in the
    flush, and runs of windows with one smallest doc_id."""
    codec = codec or Codec(b"")
    parts = [codec.unpack(b) for b in blobs]
    blobs.clear()
    rows = [len(c[1]) for c, _ in parts]
    flush = np.repeat(flushes, rows)
    index = np.concatenate([c[0] + np.arange(n) for (c, _), n in zip(parts, rows)])
    seed = np.concatenate([np.cumsum(c[1]) for c, _ in parts])
    size, low, high = (np.concatenate([c[i] for c, _ in parts]) for i in (2, 3, 4))
    high += low
    text = np.concatenate([t for _, t in parts])
    del parts
    at = np.cumsum(size) - size
    # 1. Seeds in several documents; strings with equal bytes
    order = np.argsort(seed, kind="stable")
    heads = np.flatnonzero(np.append(True, seed[order][1:] != seed[order][:-1]))
    many = np.minimum.reduceat(low[order], heads) < np.maximum.reduceat(high[order], heads)
    kept = order[np.repeat(many, np.diff(np.append(heads, len(order))))]
    if not len(kept):
        return
    flush, index, seed, size, low, high, at = (x[kept] for x in (flush, index, seed, size, low, high, at))
    text = gather(text, at, size)
    at = np.cumsum(size) - size
    order, fresh = _merged(text, at, size, seed, _names(text, size))
    string = np.empty(len(order), np.int64)  # of each row
    string[order] = np.cumsum(fresh) - 1
    heads = np.flatnonzero(fresh)
    one = order[heads]  # a row for each string
    s_low, s_seed, s_at, s_size = np.minimum.reduceat(low[order], heads), seed[one], at[one], size[one]
    # 2. and 3. The least owner of each window, whole seeds at a time
    windows = s_size - (width - 1)
    first = np.append(0, np.cumsum(windows))
    least = np.empty(first[-1], np.int64)
    i = 0
    while i < len(s_seed):
        j = int(np.searchsorted(first, first[i] + SORT_ROWS, "right")) - 1
        j = int(np.searchsorted(s_seed, s_seed[min(max(j, i + 1), len(s_seed)) - 1], "right"))
        joined = gather(text, s_at[i:j], s_size[i:j])
        n = windows[i:j]
        begin = np.cumsum(s_size[i:j]) - s_size[i:j]
        least[first[i] : first[j]] = least_owner(joined, np.repeat(begin - (first[i:j] - first[i]), n) + np.arange(n.sum()), np.repeat(s_low[i:j], n), width)
        i = j
    # Runs of windows with one owner
    cut = np.append(True, least[1:] != least[:-1])
    cut[first[:-1]] = True
    run = np.flatnonzero(cut)
    run_size = np.diff(np.append(run, len(least)))
    run_first = np.searchsorted(run, first)
    wanted = np.flatnonzero(high > np.minimum.reduceat(least, first[:-1])[string])
    wanted = wanted[np.lexsort((index[wanted], flush[wanted]))]
    edge = np.flatnonzero(np.append(True, flush[wanted][1:] != flush[wanted][:-1]))[: len(wanted)]
    for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(wanted)]):
        mine = wanted[i:j]
        s = string[mine]
        n = run_first[s + 1] - run_first[s]
        runs = np.repeat(run_first[s] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield int(flush[mine[0]]), codec.pack([index[mine], n, run_size[runs], least[run[runs]]])


def _settle_all(width: int, buckets: int, sample: bytes):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, flushes, blobs, codec = None, [], [], Codec(sample)

        def rows(flush: list[int], home: bool, blob: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(flush, pa.int64()), pa.array([home] * len(flush)), pa.array(blob, pa.binary())], names=["flush", "home", "blob"])

        def done() -> Iterator[pa.RecordBatch]:
            if blobs:
                found = list(settle(flushes, blobs, width, codec))
                flushes.clear()
                if found:
                    yield rows([f for f, _ in found], False, [b for _, b in found])

        for batch in batches:
            for bucket, flush, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if bucket != now:
                    yield from done()
                    now = bucket
                if bucket >= buckets:
                    yield rows([flush], True, [blob])
                else:
                    flushes.append(flush)
                    blobs.append(blob)
        yield from done()

    return each


def removed(places: tuple[np.ndarray, ...], found: list[list[np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A flush's removed stretches: doc_id, first byte, end. places: times, doc, pos; found: what its strings' buckets say."""
    times, doc, pos = places
    first = np.cumsum(times) - times
    string, n, run, least = (np.concatenate([f[i] for f in found]) for i in range(4))
    begin = np.cumsum(run) - run
    begin -= np.repeat(begin[np.cumsum(n) - n], n)  # in the string
    # Each place of a string with each of its runs
    t = times[string]
    pairs = t * n
    k = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    wide = np.repeat(n, pairs)
    place, r = np.repeat(first[string], pairs) + k // wide, np.repeat(np.cumsum(n) - n, pairs) + k % wide
    hit = np.flatnonzero(least[r] < doc[place])
    place, r = place[hit], r[hit]
    if not len(hit):
        return doc[:0], pos[:0], pos[:0]
    fresh = np.append(True, (place[1:] != place[:-1]) | (r[1:] != r[:-1] + 1))
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(hit)) - 1
    return doc[place[heads]], pos[place[heads]] + begin[r[heads]], pos[place[tails]] + begin[r[tails]] + run[r[tails]] + width - 1


def _bring_home(width: int, sample: bytes):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now, found = Codec(sample), None, []
        for batch in batches:
            for flush, home, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if flush != now:
                    now, found = flush, []
                if not home:
                    found.append(codec.unpack(blob)[0])
                elif found:
                    doc, start, end = removed(codec.unpack(blob)[0], found, width)
                    for i in range(0, len(doc), 1 << 17):
                        yield pa.RecordBatch.from_arrays([pa.array(doc[i : i + (1 << 17)]), pa.array(((start << 32) | end)[i : i + (1 << 17)])], names=["doc_id", "span"])

    return each


def _hot_seeds(docs: DataFrame, width: int, strings: int) -> np.ndarray:
    """Seeds of more than ``strings`` strings, by the count in one document of SAMPLED; their number is at most that of all strings
    over ``strings``."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seeds = [stretches(b, width)[3] for b in ts.blocks(batch.column(0), ts.BLOCK_BYTES // 2)]
        keys, n = np.unique(np.concatenate(seeds), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["seed", "n"])

    some = docs.filter(F.xxhash64("doc_id") % SAMPLED == 0).select("text").mapInArrow(per_batch(count), "seed long, n long")
    found = some.groupBy("seed").agg(F.sum("n").alias("n")).filter(F.col("n") * SAMPLED > strings).select("seed").toArrow()
    return np.sort(found["seed"].to_numpy().view(U64))


def spans(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id and the spans (start << 32 | end, in bytes; they may overlap) that documents of smaller doc_id hold too."""
    spark = docs.sparkSession
    docs = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * partitions(spark), -(-total // BUCKET_BYTES))
    tasks = max(partitions(spark), buckets // 4)
    # Each string is a byte longer than ``width`` at least, so a table of fewer bytes has no seed to split.
    hot = _hot_seeds(docs, width, max(HOT, total // (SEED << 20))) if total > HOT else np.zeros(0, U64)
    # Some text for the compressor to start from; no result depends on it.
    sample = "\n".join(r[0] for r in docs.filter(F.col("text").isNotNull()).select(F.substring("text", 1, 400)).limit(500).collect()).encode()[:200_000]
    sent = docs.mapInArrow(_send(width, buckets, sample, spark.sparkContext.broadcast(hot)), "bucket long, flush long, blob binary")
    dealt = lambda df, to: df.withColumn("task", F.pmod(to, F.lit(tasks)).cast("int")).repartitionById(tasks, "task").drop("task")  # noqa: E731  tasks of as many buckets each
    settled = dealt(sent, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_settle_all(width, buckets, sample), "flush long, home boolean, blob binary")
    number = F.shiftright("flush", 32) * 7919 + F.col("flush").bitwiseAND(0xFFFFFFFF)
    return written(dealt(settled, number).sortWithinPartitions("flush", "home").mapInArrow(_bring_home(width, sample), "doc_id long, span long"), "spans")


def cut(docs: DataFrame, width: int = 50, text: bool = False) -> DataFrame:
    """docs with ``kept`` (the remaining bytes; as text, parts of characters that were cut are left out), n_bytes, n_removed and n_spans."""
    names = [c for c in docs.columns if c not in ("kept", "n_bytes", "n_removed", "n_spans")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    fresh = "s" * (max(map(len, names)) + 1)  # longer than any column's name
    found = spans(docs, width).groupBy(F.col("doc_id").alias(f"{fresh}_doc")).agg(F.collect_list("span").alias(fresh))
    both = docs.join(found, F.col("doc_id") == F.col(f"{fresh}_doc"), "left").drop(f"{fresh}_doc")
    at = names.index("text")

    def remove(batch: pa.RecordBatch) -> pa.RecordBatch:
        listed = batch.column(len(names))
        kept, n_bytes, n_removed, n_spans = [], [], [], []
        for b in ts.blocks(batch.column(at)):
            mine = listed.slice(b.first, b.n)
            if mine.null_count:
                mine = mine.fill_null([])
            flat, size = mine.flatten().to_numpy(), np.diff(mine.offsets.to_numpy())
            base = np.repeat(b.byte_off[:-1], size)
            stop = np.repeat(b.byte_off[1:], size)
            depth = np.zeros(len(b.buf) + 1, np.int32)
            np.add.at(depth, np.minimum(base + (flat >> 32), stop), 1)
            np.add.at(depth, np.minimum(base + (flat & 0xFFFFFFFF), stop), -1)
            gone = np.cumsum(depth[:-1]) > 0
            _, _, first = ts.runs(gone, b.byte_off)
            total = np.zeros(len(gone) + 1, np.int64)
            np.cumsum(gone, out=total[1:])
            left = b.buf[~gone].tobytes()
            edge = b.byte_off - total[b.byte_off]
            kept += [left[i:j] for i, j in zip(edge[:-1].tolist(), edge[1:].tolist())]
            n_bytes.append(np.diff(b.byte_off))
            n_removed.append(np.diff(total[b.byte_off]))
            n_spans.append(np.diff(first))
        more = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (n_bytes, n_removed, n_spans)]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if text else pa.array(kept, pa.binary()), *more], names=[*names, "kept", "n_bytes", "n_removed", "n_spans"])

    out = T.StructType([*docs.schema.fields, T.StructField("kept", T.StringType() if text else T.BinaryType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]])
    return both.mapInArrow(per_batch(remove), out)
