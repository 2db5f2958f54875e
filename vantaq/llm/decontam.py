"""Benchmark decontamination.

Test items are indexed by BM25: for each term the items that hold it with their impacts, scaled so that
an item's own text scores 1 against it. Posting lists are cut into blocks of items; each term keeps its largest impact on any
item and on those of each block. Every text is cut into overlapping passages that cover any stretch of an item's length whole; each is a
query. As in block-max WAND, a passage is searched only if the sum of its terms' largest impacts reaches the threshold, and then a block is
opened only if the sum of its terms' largest impacts in that block does; of open blocks alone postings are read, and every item that
reaches the threshold is retrieved, however many there are (scores are kept for the items of open blocks only). A retrieved pair is verified on stretches of the passage of at most
twice the item's length: of the item's question (all but its last
part) and of its answer, the share of ``GRAM``-word sequences found there must reach the overlap.

The number of items, the documents of each term and the mean length are counted by Spark over the whole benchmark. The benchmark is indexed PART_BYTES of its
text at a time with these figures; of a larger one each part is searched, its results written and its broadcast dropped before the next is made, so one part
at a time is with the driver and in a worker, and the results don't depend on the parts. A part has an index for each length class of items (up to 2, 4, 8, ... words), and
passages are as long as the class asks, so a long item doesn't widen the passages of short ones. Texts are processed whole.

Cases: null texts and those without words yield nothing; items without words match nothing; items of
fewer than ``GRAM`` words need all of their words in sequence; of the passages of a pair the one with the best score counts, then
the best overlaps; repeated items and rows count as often as they stand there; very long texts are one block each; empty tables give no rows
(an empty benchmark leaves all documents); other columns, whatever their names, are not looked at by ``matches`` and stay in ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .base import per_batch, written

U64 = np.uint64
K1, B = 1.2, 0.75
#: Items to a block.
BLOCK_ITEMS = 16
#: Bytes of the benchmark's text that are indexed and broadcast at once.
PART_BYTES = 64 << 20
GRAM = 3
#: Block postings that are added up at once.
AT_ONCE = 1 << 19
#: The share of an item's words that count as its answer.
ANSWER = 0.25


@dataclass
class Index:
    item: np.ndarray  # item_id of each item
    null: np.ndarray  # whether it has none
    term: np.ndarray  # sorted keys of terms
    top: np.ndarray  # each term's largest impact
    first: np.ndarray  # block postings of each term: block, ceiling, and the place of their first posting
    block: np.ndarray
    ceiling: np.ndarray
    at: np.ndarray
    posting_item: np.ndarray
    posting_impact: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]
    size: np.ndarray  # words of each item


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    if not len(h):
        return np.zeros(0, U64)
    size = min(size, len(h))
    out = np.zeros(len(h) - size + 1, U64)
    for j in range(size):
        out = ts.mix(out + h[j : j + len(out)] * U64(2 * j + 3))
    return out


@dataclass
class Statistics:
    """Of the whole benchmark: items, their mean length, and the items of each term (keys ascending)."""

    n: int
    mean: float
    term: np.ndarray
    items: np.ndarray


def item_words(texts: list[str | None] | pa.Array) -> list[np.ndarray]:
    """The hashes of each text's words in order."""
    words: list[np.ndarray] = []
    for b in ts.blocks(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())):
        start, end, first, hasher, _ = ts.words(b)
        h = hasher.of(start, end)
        words += [h[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
    return words


def build(ids: list[int | None], texts: list[str | None], known: Statistics | None = None) -> Index:
    """One index of all these items, with the figures of the whole benchmark; without such, with their own."""
    words = item_words(texts)
    return _build(ids, words, known or _statistics_of(words))


def by_class(ids: list[int | None], texts: list[str | None], known: Statistics) -> list[Index]:
    """An index for each length class of the items: classes end at powers of two."""
    words = item_words(texts)
    classes: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        classes.setdefault(max(0, len(w) - 1).bit_length(), []).append(i)
    return [_build([ids[i] for i in some], [words[i] for i in some], known) for _, some in sorted(classes.items())]


def _statistics_of(words: list[np.ndarray]) -> Statistics:
    term, items = np.unique(np.concatenate([np.unique(w) for w in words] or [np.zeros(0, U64)]), return_counts=True)
    return Statistics(len(words), sum(map(len, words)) / max(1, len(words)), term, items)


def _build(ids: list[int | None], words: list[np.ndarray], known: Statistics) -> Index:
    n = len(ids)
    size = np.array([len(w) for w in words], np.int64)
    term = np.unique(np.concatenate(words)) if n else np.zeros(0, U64)
    item = np.repeat(np.arange(n), size)
    code = np.searchsorted(term, np.concatenate(words)) if n else np.zeros(0, np.int64)
    key, tf = np.unique(code * max(n, 1) + item, return_counts=True)
    t, d = key // max(n, 1), key % max(n, 1)
    df = known.items[np.searchsorted(known.term, term)]
    idf = np.log1p((known.n - df + 0.5) / (df + 0.5))
    impact = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[d] / max(1.0, known.mean)))
    own = np.bincount(d, impact, n)
    impact = (impact / np.maximum(own[d], 1e-12)).astype(np.float32)
    block = d // BLOCK_ITEMS
    heads = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (block[1:] != block[:-1])))[: len(t)]
    ceiling = np.maximum.reduceat(impact, heads) if len(heads) else impact
    first = np.searchsorted(t[heads], np.arange(len(term) + 1))
    top = np.maximum.reduceat(impact, np.searchsorted(t, np.arange(len(term)))) if len(term) else impact
    cut = [len(w) - max(1, round(ANSWER * len(w))) if len(w) >= 2 * GRAM else 0 for w in words]
    return Index(
        np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], bool), term, top, first, block[heads], ceiling, np.append(heads, len(t)), d, impact,
        [np.unique(_grams(w[:c], GRAM)) for w, c in zip(words, cut)], [np.unique(_grams(w[max(0, c - GRAM + 1) :] if c else w, GRAM if c else len(w))) for w, c in zip(words, cut)], size,
    )


class Searcher:
    def __init__(self, index: Index, threshold: float, overlap: float) -> None:
        self.index, self.threshold, self.overlap = index, threshold, overlap
        self.terms = ts.Table(12)
        self.terms.add(index.term, np.arange(len(index.term), dtype=np.int32))
        self.stride = 1 << int(index.size.max(initial=1) - 1).bit_length()

    def retrieved(self, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items (by number) that reach the threshold for a passage of these terms (distinct, ascending), and their scores."""
        _, items, score = self.hits(np.zeros(len(mine), np.int64), mine)
        return items, score

    def hits(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for many passages: rows of passage (numbers from 0, ascending) and term in, passage, item and score out. Passages are taken together up to ``AT_ONCE`` block
        postings, or one at a time."""
        x, out = self.index, []
        count = x.first[term + 1] - x.first[term]
        heads = np.searchsorted(passage, np.arange(int(passage[-1]) + 2)) if len(passage) else np.zeros(1, np.int64)
        size = ts.sums_by(count, heads)
        blocks = len(x.item) // BLOCK_ITEMS + 1
        k = 0
        while k < len(size):
            n = max(1, min(int(np.searchsorted(np.cumsum(size[k : k + AT_ONCE // blocks + 1]), AT_ONCE, "right")), AT_ONCE // blocks))
            some = slice(heads[k], heads[min(k + n, len(size))])
            post = _ranges(x.first[term[some]], count[some])
            owner = np.repeat(passage[some] - k, count[some])
            cell = owner * blocks + x.block[post]
            open_ = (np.bincount(cell, x.ceiling[post], n * blocks) >= self.threshold - 1e-4)[cell]
            post, owner = post[open_], owner[open_]
            each = x.at[post + 1] - x.at[post]
            at = _ranges(x.at[post], each)
            cell, place = np.unique(np.repeat(owner, each) * len(x.item) + x.posting_item[at], return_inverse=True)
            score = np.bincount(place, x.posting_impact[at], len(cell))
            good = np.flatnonzero(score >= self.threshold)
            out.append((cell[good] // max(1, len(x.item)) + k, cell[good] % max(1, len(x.item)), score[good]))
            k += n
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([o[j] for o in out] or [none]) for j in range(3))

    def overlaps(self, i: int, words: np.ndarray) -> tuple[float, float]:
        """The best question and answer overlap (least of both first) of item i with a stretch of the words of at most twice its length."""
        x, size = self.index, int(self.index.size[i])
        best = (0.0, 0.0)
        for lo in range(0, max(1, len(words) - size), size):
            text = words[lo : lo + 2 * size]
            if len(x.question[i]):
                grams = _grams(text, GRAM) if len(text) >= GRAM else np.zeros(0, U64)
                got = float(np.isin(x.question[i], grams).mean()), float(np.isin(x.answer[i], grams).mean())
            else:
                share = float(np.isin(x.answer[i], _grams(text, size) if len(text) >= size else np.zeros(0, U64)).mean())
                got = share, share
            best = max(best, got, key=lambda o: (min(o), max(o), o))
        return best

    def block(self, block: ts.Block) -> list[tuple[int, int, float, float, float]]:
        start, end, first, hasher, _ = ts.words(block)
        h = hasher.of(start, end)
        term = self.terms.find(h)
        at = np.flatnonzero(term >= 0)
        return self.words(h, first, at, np.searchsorted(first, at, "right") - 1, term[at])

    def words(self, h: np.ndarray, first: np.ndarray, at: np.ndarray, doc: np.ndarray, term: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """document (in the block), item (by number), score, question and answer overlap of the best passage of each pair. ``h``: the words' hashes; ``first``: where each
        document's start; ``at``, ``doc``, ``term``: the words that are terms, in order."""
        x = self.index
        # A document's strides are numbered from base on, and at least one number after them is free; passage q holds strides q - 1 and q.
        base = np.zeros(len(first), np.int64)
        np.cumsum(np.diff(first) // self.stride + 2, out=base[1:])
        stride = base[doc] + (at - first[doc]) // self.stride
        # At first repeated terms count as often as they stand there, so that nothing is sorted for most passages.
        most = np.bincount(stride, x.top[term], base[-1] + 1) if len(at) else np.zeros(1)
        some = np.flatnonzero(most + np.append(0, most[:-1]) >= self.threshold - 1e-4)
        lo, hi = np.searchsorted(stride, some - 1), np.searchsorted(stride, some, "right")
        key = (np.repeat(some, hi - lo) << 32) | term[_ranges(lo, hi - lo)]
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
        if not len(key):
            return []
        passage, t = key >> 32, key & 0xFFFFFFFF
        heads = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        reach = np.add.reduceat(x.top[t], heads) >= self.threshold - 1e-4
        held = np.repeat(reach, np.diff(np.append(heads, len(key))))
        numbers = passage[heads[reach]]
        for r, i, s in zip(*(o.tolist() for o in self.hits(np.searchsorted(numbers, passage[held]), t[held]))):
            q = int(numbers[r])
            d = int(np.searchsorted(base, q, "right") - 1)
            lo = max(first[d], first[d] + (q - base[d] - 1) * self.stride)
            words = h[lo : min(first[d + 1], first[d] + (q - base[d] + 1) * self.stride)]
            asked, answered = self.overlaps(i, words)
            if asked >= self.overlap and answered >= self.overlap:
                best = (s, asked, answered)
                found[d, i] = max(found.get((d, i), best), best)
        return [(d, i, *v) for (d, i), v in sorted(found.items())]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Part:
    """Some items of the benchmark, with a searcher for each length class."""

    def __init__(self, indexes: list[Index], threshold: float, overlap: float) -> None:
        self.searchers = [Searcher(x, threshold, overlap) for x in indexes]
        keys = np.unique(np.concatenate([x.term for x in indexes] or [np.zeros(0, U64)]))
        self.terms = ts.Table(12)
        self.terms.add(keys, np.arange(len(keys), dtype=np.int32))
        self.own = []  # of each class, the terms' numbers there
        for x in indexes:
            own = np.full(len(keys), -1, np.int64)
            own[np.searchsorted(keys, x.term)] = np.arange(len(x.term))
            self.own.append(own)

    def block(self, block: ts.Block) -> Iterator[tuple[int, int | None, float, float, float]]:
        """document (in the block), item_id, score, question and answer overlap of every verified pair."""
        start, end, first, hasher, _ = ts.words(block)
        h = hasher.of(start, end)
        term = self.terms.find(h)
        at = np.flatnonzero(term >= 0)
        doc, term = np.searchsorted(first, at, "right") - 1, term[at]
        for s, own in zip(self.searchers, self.own):
            mine = own[term]
            held = mine >= 0
            for d, i, *rest in s.words(h, first, at[held], doc[held], mine[held]):
                yield d, None if s.index.null[i] else int(s.index.item[i]), *rest


def parts(benchmark: DataFrame) -> Iterator[tuple[list[Index], int]]:
    """The benchmark's indexes and how many parts there are, about PART_BYTES of text at most at a time; one passes through the driver after the other."""

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = item_words(batch.column(1))
        terms = [np.unique(w).view(np.int64) for w in found]
        off = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(terms or [np.zeros(0, np.int64)])))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(w) for w in found], pa.int64()), lists], names=["item_id", "text", "size", "terms"])

    read = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = written(read.mapInArrow(per_batch(words), "item_id long, text string, size long, terms array<long>"), "items")
    whole = items.agg(F.count(F.lit(1)), F.coalesce(F.avg("size"), F.lit(0.0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    frequency = items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("items"))
    n = max(1, -(-whole[2] // PART_BYTES))
    if n > 1:
        frequency = written(frequency, "frequency")
    for k in range(n):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = some.select("item_id", "text").orderBy("item_id", "text").collect()
        known = frequency.join(some.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi").toPandas() if n > 1 else frequency.toPandas()
        term = known["term"].to_numpy(np.int64).view(U64)
        order = np.argsort(term)
        yield by_class([r[0] for r in rows], [r[1] for r in rows], Statistics(whole[0], whole[1], term[order], known["items"].to_numpy(np.int64)[order])), n


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.6) -> DataFrame:
    """doc_id, item_id, score (1 for the item's own text), question_overlap and answer_overlap of every verified pair."""

    def searched(index) -> DataFrame:
        state: list[Part] = []

        def search(batch: pa.RecordBatch) -> pa.RecordBatch:
            if not state:
                state.append(Part(index.value, threshold, overlap))
            ids = batch.column(0)
            rows = [(ids[b.first + d].as_py(), *rest) for b in ts.blocks(batch.column(1)) for d, *rest in state[0].block(b)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k < 2 else pa.float64()) for k in range(5)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return read.mapInArrow(per_batch(search), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")

    found = []
    for indexes, n in parts(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(indexes)
        found.append(searched(index))
        if n > 1:
            found[-1] = written(found[-1], "matches")
            index.destroy()
    return reduce(DataFrame.union, found)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.6) -> DataFrame:
    """The rows of docs without a verified pair."""
    at = docs.columns.index("text")

    def kept(left: DataFrame, index) -> DataFrame:
        state: list[Part] = []

        def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
            if not state:
                state.append(Part(index.value, threshold, overlap))
            good = np.ones(batch.num_rows, bool)
            for b in ts.blocks(batch.column(at)):
                good[[b.first + d for d, *_ in state[0].block(b)]] = False
            return batch.filter(pa.array(good))

        return left.mapInArrow(per_batch(keep), left.schema)

    for indexes, n in parts(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(indexes)
        docs = kept(docs, index)
        if n > 1:
            docs = written(docs, "clean")
            index.destroy()
    return docs
