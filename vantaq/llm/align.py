"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

A block of whole texts is encoded by a byte-level tokenizer (A) and a piece tokenizer (B). The last bytes of each one's tokens are bits of
packed 64-bit words, a bit for each byte of the block. From these words alone:

* A AND B are the shared cuts: where both end, a group of tokens ends.
* A OR B are the links: between two neighbouring ends lies exactly one overlap of an A token with a B token, and each overlap lies so.
* Popcounts (``Bits.rank``) tell how many tokens end up to a byte, and so map cuts and links to token ranges (``Bits.select``).

How many documents hold a pair of ids is counted over the corpus by Spark: a document's row keeps its distinct pairs, and these are exploded and
grouped, with partial sums on the map side. To bring the counts back, pairs that more documents hold than any other, ``HOT_PAIRS`` of them at
most, are broadcast and looked up where the documents are; all others are joined, and none of those is in many documents, so no key of
the join is hot. Rows have numbers of their own, so repeated doc_ids stay apart.

Cases: null and empty texts, and texts whose bytes the tokens don't give back (B writes U+2581 as a space), have no tokens: zeros and an empty groups text; texts
of any length are handled whole; repeated rows, and rows without doc_id, are counted each; ties for the highest count are all best;
other columns, whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, pieces
from . import textscan as ts
from .base import per_batch, written

U64 = np.uint64
#: A pair of ids is a << SHIFT | b.
SHIFT = 20
#: Pairs that are broadcast at most (17 bytes each).
HOT_PAIRS = 1_000_000
#: Distinct pieces of text kept per worker before the table starts afresh.
KNOWN_PIECES = 800_000


class Bits:
    """A set of places as packed 64-bit words."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-max(size, 1) // 64) * 64, bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def rank(self, place: np.ndarray) -> np.ndarray:
        """How many members are at ``place`` or before it."""
        word = place >> 6
        upto = (U64(2) << (place & 63).astype(U64)) - U64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & upto)

    def has(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(U64)) & U64(1) > 0

    def select(self) -> np.ndarray:
        """All members in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class ByteLevel:
    """Ids of a byte-level vocabulary without special tokens, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        step = known.get("pre_tokenizer") or {}
        if known.get("normalizer") or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or not step.get("use_regex", True):
            raise ValueError("not a byte-level tokenizer that takes texts as they are")
        letters, vocab = bpe.byte_letters(), known["model"]["vocab"]
        special = {t["content"] for t in known.get("added_tokens") or []}
        spelled = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            spelled[i] = b"" if token in special else bytes(letters[c] for c in token)
        self.spelled_size = np.array([len(x) for x in spelled], np.int64)
        self.spelled_first = np.cumsum(self.spelled_size) - self.spelled_size
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.n = len(spelled)
        self.machine, self.splitter, self.kept = bpe.Automaton(path), bpe.Splitter(spaced=True), pieces.Kept()

    def block(self, block: ts.Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block's texts, and where each text's start (one entry more)."""
        cp, at, off = block.chars()
        start = self.splitter.starts(cp, off)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(block.n + 1, np.int64)
        end = np.append(start[1:], len(cp))
        h = ts.Rolling(ts.codes_of(cp)).of(start, end)
        which = self.kept.table.find(h)
        new = np.flatnonzero(which < 0)
        if len(new):
            if self.kept.n > KNOWN_PIECES:
                self.kept = pieces.Kept()
                new = np.arange(len(h))
            keys, one = ts.distinct(h[new])
            one = new[one]
            byte = np.append(at, len(block.buf))
            size = byte[end[one]] - byte[start[one]]
            flat_off = np.zeros(len(one) + 1, np.int64)
            np.cumsum(size, out=flat_off[1:])
            ids, count = self.machine.ids(block.buf[pieces.spread(byte[start[one]], size)], flat_off)
            self.kept.add(keys, ids, count)
            which[new] = self.kept.table.find(h[new])
        ids, total = self.kept.gather(which)
        return ids, total[np.searchsorted(start, off)]


class Tokens:
    """One tokenizer's tokens of a block's texts."""

    def __init__(self, machine: ByteLevel | pieces.Model, ids: np.ndarray, first: np.ndarray) -> None:
        self.machine, self.ids, self.first = machine, ids, first
        self.size = machine.spelled_size[ids]
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.size, out=total[1:])
        self.ends, self.byte_off = total[1:], total[first]

    def joined(self) -> np.ndarray:
        return self.machine.spelled[pieces.spread(self.machine.spelled_first[self.ids], self.size)]

    def only(self, keep: np.ndarray) -> Tokens:
        """Those of some of the texts."""
        if keep.all():
            return self
        count = np.diff(self.first)
        first = np.zeros(int(keep.sum()) + 1, np.int64)
        np.cumsum(count[keep], out=first[1:])
        return Tokens(self.machine, self.ids[np.repeat(keep, count)], first)


def spaced(block: ts.Block) -> ts.Block:
    """The block with a space before each text that is not empty."""
    full = np.diff(block.byte_off) > 0
    return ts.Block(block.first, np.insert(block.buf, block.byte_off[:-1][full], 32), block.byte_off + np.concatenate([[0], np.cumsum(full)]))


def same_texts(text: ts.Block, a: Tokens, b: Tokens) -> np.ndarray:
    """Which texts are not empty, and equal to their joined tokens on both sides."""
    size = np.diff(text.byte_off)
    good = (size > 0) & (np.diff(a.byte_off) == size) & (np.diff(b.byte_off) == size)
    ours = text.buf if good.all() else text.buf[np.repeat(good, size)]
    off = np.concatenate([[0], np.cumsum(size[good])])
    wrong = np.flatnonzero((a.only(good).joined() != ours) | (b.only(good).joined() != ours))
    if len(wrong):
        good[np.flatnonzero(good)[np.searchsorted(off, wrong, "right") - 1]] = False
    return good


@lru_cache(maxsize=2)
def digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of the numbers below n, with room for a separator, and how many there are."""
    width = len(str(max(n - 1, 0)))
    text = np.char.mod("%d", np.arange(n)).astype(f"S{width + 1}")
    return np.frombuffer(text.tobytes(), np.uint8).reshape(n, width + 1), np.char.str_len(text).astype(np.int64)


class Aligned:
    """The alignment of a block's texts. ``first``: where each text's groups start; ``group_a``, ``group_b``: how many tokens end with each
    group or before it; ``link_first``, ``pair``: each text's links as id pairs."""

    def __init__(self, a: Tokens, b: Tokens) -> None:
        self.a, self.b = a, b
        n = int(a.byte_off[-1])
        in_a, in_b = Bits.of(a.ends - 1, n), Bits.of(b.ends - 1, n)
        shared, either = Bits(in_a.words & in_b.words), Bits(in_a.words | in_b.words)
        cuts, links = shared.select(), either.select()
        self.group_a, self.group_b = in_a.rank(cuts), in_b.rank(cuts)
        last = a.byte_off[1:] - 1
        self.first = np.concatenate([[0], shared.rank(last)])
        self.link_first = np.concatenate([[0], either.rank(last)])
        left, right = in_a.rank(links) - in_a.has(links), in_b.rank(links) - in_b.has(links)
        self.pair = (a.ids[left].astype(np.int64) << SHIFT) | b.ids[right]

    def text(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text its groups as `a1,a2|b1;a3|b2,b3`: the bytes, and where each text's start."""
        groups = len(self.group_a)
        size_a, size_b = np.diff(self.group_a, prepend=0), np.diff(self.group_b, prepend=0)
        at_a = np.arange(len(self.a.ids)) + np.repeat(self.group_b - size_b, size_a)
        at_b = np.arange(len(self.b.ids)) + np.repeat(self.group_a, size_b)
        ids, mark = np.empty(len(at_a) + len(at_b), np.int64), np.full(len(at_a) + len(at_b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a.ids, self.b.ids
        ends = self.group_a + self.group_b
        mark[ends - size_b - 1] = ord("|")
        mark[ends - 1] = ord(";")
        mark[ends[self.first[1:] - 1] - 1] = 0  # the last of a text
        table, width = digits(max(self.a.machine.n, self.b.machine.n))
        rows = table[ids]
        rows[np.arange(len(ids)), width[ids]] = mark
        total = np.concatenate([[0], np.cumsum(width[ids] + (mark > 0))])
        return rows[rows > 0], total[np.concatenate([[0], ends])[self.first]] if groups else np.zeros(len(self.first), np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's distinct pairs, how often each is linked there, and where each text's start."""
        owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.link_first))
        keys = np.sort((owner.astype(np.int64) << (2 * SHIFT)) | self.pair)
        head = np.flatnonzero(np.diff(keys, prepend=-1) != 0)
        times = np.diff(np.append(head, len(keys)))
        first = np.searchsorted(keys[head] >> (2 * SHIFT), np.arange(len(self.first)))
        return keys[head] & ((1 << (2 * SHIFT)) - 1), times, first


@lru_cache(maxsize=2)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """For every row of ``docs``: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`: ids in
    order), pairs (its distinct linked id pairs, a << 20 | b) and times (how often each is linked)."""

    def one(block: ts.Block) -> dict[str, np.ndarray]:
        text = spaced(block)
        left, right = Tokens(byte_level(a), *byte_level(a).block(text)), Tokens(pieces.model(b), *pieces.model(b).block(block))
        good = same_texts(text, left, right)
        out = {k: np.zeros(block.n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links", "text", "pair")}
        out |= {"texts": np.zeros(0, np.uint8), "pairs": np.zeros(0, np.int64), "times": np.zeros(0, np.int64)}
        if good.any():
            got = Aligned(left.only(good), right.only(good))
            out["texts"], text_off = got.text()
            out["pairs"], out["times"], pair_off = got.pairs()
            for k, first in (("n_a", got.a.first), ("n_b", got.b.first), ("n_groups", got.first), ("n_links", got.link_first), ("text", text_off), ("pair", pair_off)):
                out[k][good] = np.diff(first)
        return out

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [one(x) for x in ts.blocks(batch.column(1))]
        if not parts:
            return None
        whole = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}

        def off(key: str) -> pa.Array:
            return pa.array(np.concatenate([[0], np.cumsum(whole[key])]).astype(np.int32))

        text = pa.Array.from_buffers(pa.string(), batch.num_rows, [None, off("text").buffers()[1], pa.py_buffer(whole["texts"])])
        lists = [pa.ListArray.from_arrays(off("pair"), pa.array(whole["pairs"])), pa.ListArray.from_arrays(off("pair"), pa.array(whole["times"].astype(np.int32)))]
        counts = [pa.array(whole[k]) for k in ("n_a", "n_b", "n_groups", "n_links")]
        return pa.RecordBatch.from_arrays([batch.column(0), *counts, text, *lists], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(per_batch(run), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>")
    return found.withColumn("row", F.monotonically_increasing_id())


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, documents (that hold it), best (no pair of the same A id is in more documents)."""
    counts = written(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents")), "pairs")
    left = F.shiftright("pair", SHIFT)
    most = counts.groupBy(left.alias("left")).agg(F.max("documents").alias("most"))
    return counts.join(most, left == F.col("left")).select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def _hot_from(counts: DataFrame, limit: int) -> int:
    """The least power of two so that at most ``limit`` pairs are in so many documents."""
    sizes = dict(counts.groupBy(F.floor(F.log2("documents")).cast("int").alias("size")).count().collect())  # 63 rows at most
    total, power = 0, max(sizes, default=0) + 1
    while power > 0 and total + sizes.get(power - 1, 0) <= limit:
        power -= 1
        total += sizes.get(power, 0)
    return 1 << power


def with_counts(aligned: DataFrame, limit: int = HOT_PAIRS) -> DataFrame:
    """``aligned`` (a written table) with n_best (its links whose pair is in most documents of all pairs with the A id, ties included) and count_sum
    (the documents that hold each link's pair, summed over links) instead of pairs and times."""
    spark = aligned.sparkSession
    counts = written(pair_counts(aligned), "counts")
    least = _hot_from(counts, limit)
    hot = counts.filter(F.col("documents") >= least).toPandas().sort_values("pair")
    table = spark.sparkContext.broadcast((hot["pair"].to_numpy(np.int64), hot["documents"].to_numpy(np.int64), hot["best"].to_numpy(bool)))
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    schema = ", ".join(f"{c} {aligned.schema[c].dataType.simpleString()}" for c in kept) + ", n_best long, count_sum long, pairs array<long>, times array<int>"

    def look_up(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, documents, best = table.value
        lists = batch.column("pairs")
        pair, times = np.asarray(lists.flatten()), np.asarray(batch.column("times").flatten()).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))])
        place = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
        known = keys[place] == pair if len(keys) else np.zeros(len(pair), bool)
        place = np.where(known, place, 0)
        n_best = ts.sums_by(np.where(known & best[place], times, 0) if len(keys) else times * 0, first)
        total = ts.sums_by(np.where(known, documents[place] * times, 0) if len(keys) else times * 0, first)
        rest = np.concatenate([[0], np.cumsum(~known)])[first].astype(np.int32)
        left = [pa.ListArray.from_arrays(pa.array(rest), pa.array(x)) for x in (pair[~known], times[~known].astype(np.int32))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n_best), pa.array(total), *left], names=[*kept, "n_best", "count_sum", "pairs", "times"])

    found = aligned.select(*kept, "pairs", "times").mapInArrow(per_batch(look_up), schema)
    if least <= 1:
        return found.drop("pairs", "times")
    found = written(found, "looked-up")
    rare = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    rare = rare.join(counts.filter(F.col("documents") < least), F.col("pairs") == F.col("pair"))
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times").cast("long")).otherwise(0)).alias("more_best"), F.sum(F.col("documents") * F.col("times")).alias("more_sum"))
    joined = found.drop("pairs", "times").join(rare, "row", "left")
    return joined.select(*kept, *((F.col(x) + F.coalesce(y, F.lit(0))).alias(x) for x, y in (("n_best", "more_best"), ("count_sum", "more_sum"))))
