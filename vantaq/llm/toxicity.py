"""Toxicity scores from the nearest labelled examples.

Texts are vectors over all words that an example holds: (1 + log of the count) x IDF x the word's evidence, made one long.
IDF counts all documents; the evidence is 1 + a quarter of the word's log-likelihood ratio between the examples' labels, so
telling words weigh more and none is left out. Similarity is the exact cosine. The examples are indexed by posting lists cut
into blocks of ``BLOCK`` examples, similar ones together, with the largest weight of each word in each block; lists that hold more
than one example in ``COMMON`` are kept at full length, with zeros. A text adds up its words' block maxima, visits the blocks with the largest sums first, and goes on while a block's sum reaches
the similarity of the last of its ``NEIGHBOURS`` nearest so far. Blocks that are skipped cannot hold a nearer example, so the
neighbours are exact. Their labels vote, each with 1 / (0.1 + distance)^2; a logistic curve, fitted on the examples themselves
(each left out of its own vote), turns the vote to a probability. The nearest examples are the evidence.

The model is fitted on a bounded sample of labelled rows: about ``sample`` of them and about ``text_bytes`` of text, drawn
by a hash of doc_id, whole texts each; this bounds what is broadcast. Everything else covers all rows and whole texts.

Cases: null and empty texts, and texts of words that no example holds, have no neighbours, no evidence and the score of
examples without words; with no labelled rows every score is 0; ties between examples of equal similarity go to the smaller
doc_id; labels that repeat a doc_id count by the largest; repeated rows are scored alike, and repeated labelled rows are examples
each; very long texts are handled whole, one at a time; empty tables give no rows; other columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .base import per_batch, written

U64 = np.uint64
NEIGHBOURS = 7
BLOCK = 32
#: Posting lists of more than 1 / COMMON of the examples are kept at full length.
COMMON = 16
#: Texts whose common words are added up at once.
TEXTS = 256
#: Blocks visited before any is ruled out.
FIRST = 4
#: doc_ids of evidence for each text.
EVIDENCE = 3
#: What makes two similarities, or a bound and a similarity, equal.
EQUAL = 1e-8


@dataclass
class Index:
    """Posting lists in blocks. Of term t: block postings first[t]:first[t + 1]; of block posting b: postings at[b]:at[b + 1].
    Of a term with a slot (else -1): the row of that number in ``full``."""

    term: np.ndarray  # keys, ascending
    weight: np.ndarray  # of a term: IDF x evidence
    first: np.ndarray
    block: np.ndarray
    ceiling: np.ndarray
    at: np.ndarray
    example: np.ndarray
    impact: np.ndarray
    slot: np.ndarray
    full: np.ndarray  # impacts on all examples, up to the last block's end
    label: np.ndarray
    doc: np.ndarray
    bare: float = 0.0  # the score of a text without terms
    curve: tuple[float, float] = (0.0, 0.0)  # intercept and slope of the log odds over the vote

    @property
    def blocks(self) -> int:
        return -(-len(self.label) // BLOCK)


def vectors(block: ts.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, word key and count of the distinct words in each document, ascending."""
    start, end, first, hasher, _ = ts.words(block)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, U64), none
    keys = hasher.of(start, end)
    doc = np.searchsorted(first, np.arange(len(keys)), "right") - 1
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    heads = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])))
    return doc[heads], keys[heads], np.diff(np.append(heads, len(keys)))


def distinct_known(block: ts.Block, table: ts.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, number in the table and count of the distinct words that the table holds, ascending."""
    start, end, first, hasher, _ = ts.words(block)
    term = table.find(hasher.of(start, end))
    at = np.flatnonzero(term >= 0)
    key = ((np.searchsorted(first, at, "right") - 1) << 32) | term[at]
    key.sort()
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
    key, count = key[heads], np.diff(np.append(heads, len(key)))
    return key >> 32, key & 0xFFFFFFFF, count


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def weights(doc: np.ndarray, term: np.ndarray, count: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    w = (1 + np.log(count)) * weight[term]
    norm = np.sqrt(np.bincount(doc, w * w, n))
    return w / norm[doc]


def evidence(toxic: np.ndarray, all_: np.ndarray, t: int, n: int) -> np.ndarray:
    """1 + a quarter of the log-likelihood ratio of each word's share of toxic examples against the share among all."""

    def part(k: np.ndarray, share: float) -> np.ndarray:
        return k * np.log(np.maximum(k, 1) / np.maximum(all_ * share, 1e-12))

    if not 0 < t < n:
        return np.ones(len(all_))
    return 1 + np.maximum(part(toxic, t / n) + part(all_ - toxic, 1 - t / n), 0) / 2


def build(ids: np.ndarray, label: np.ndarray, doc: np.ndarray, keys: np.ndarray, count: np.ndarray, term: np.ndarray, df: np.ndarray, total: int) -> Index:
    """Examples (ids, label) with their words (doc: example, key, count); term: all keys, ascending; df, total: their documents
    in the corpus, and its size."""
    n = len(ids)
    code = np.searchsorted(term, keys)
    idf = np.log((1 + total) / (1 + np.minimum(df, total))) + 1
    weight = idf * evidence(np.bincount(code, label[doc], len(term)), np.bincount(code, minlength=len(term)).astype(float), int(label.sum()), n)
    some = np.flatnonzero(np.bincount(doc, minlength=n))
    w = weights(doc, code, count, weight, n)
    # Similar examples into one block: those with the same commonest word (texts of a language), by the size of their vectors
    df_here = np.bincount(code, minlength=len(term))
    norm = np.bincount(doc, ((1 + np.log(count)) * weight[code]) ** 2, n)
    often = np.flatnonzero(df_here[code] * 32 > n)
    often = often[np.lexsort((code[often], count[often]))]
    lead = np.full(n, -1)
    lead[doc[often]] = code[often]
    some = some[np.lexsort((ids[some], norm[some], lead[some]))]
    place = np.full(n, -1)
    place[some] = np.arange(len(some))
    example = place[doc]
    order = np.lexsort((example, code))
    code, example, w = code[order], example[order], w[order]
    # Long lists at full length
    blocks = -(-len(some) // BLOCK)
    common = np.flatnonzero(df_here * COMMON > n)
    slot = np.full(len(term), -1)
    slot[common] = np.arange(len(common))
    full = np.zeros((len(common), blocks * BLOCK))
    mine = slot[code] >= 0
    full[slot[code[mine]], example[mine]] = w[mine]
    code, example, w = code[~mine], example[~mine], w[~mine]
    heads = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (example[1:] // BLOCK != example[:-1] // BLOCK)))[: len(code)]
    ceiling = np.maximum.reduceat(w, heads) if len(heads) else w
    bare = np.delete(label, some)
    x = Index(
        term, weight, np.searchsorted(code[heads], np.arange(len(term) + 1)), example[heads] // BLOCK, ceiling, np.append(heads, len(code)),
        example, w, slot, full, label[some].astype(float), ids[some],
    )
    x.bare = float((bare.sum() + (label.mean() if n else 0)) / (len(bare) + 1))
    return x


def common(x: Index, doc: np.ndarray, term: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Of n texts, their similarities to all examples by common terms alone."""
    mine = x.slot[term] >= 0
    by_slot = np.zeros((n, len(x.full)))
    by_slot[doc[mine], x.slot[term[mine]]] = w[mine]
    return by_slot @ x.full


def nearest(x: Index, term: np.ndarray, w: np.ndarray, base: np.ndarray, skip: int | None = None, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
    """The nearest examples (by place in the index) of one text, nearest first, and their similarities. ``base``: its
    similarities by common terms. Examples of doc_id ``skip`` are left out."""
    mine = x.slot[term] < 0
    term, w = term[mine], w[mine]
    size = x.first[term + 1] - x.first[term]
    post = _ranges(x.first[term], size)
    w = np.repeat(w, size)
    block = x.block[post]
    base = base.reshape(-1, BLOCK)
    bound = base.max(axis=1) + np.bincount(block, w * x.ceiling[post], x.blocks)
    open_ = np.argsort(-bound, kind="stable")[:FIRST]
    open_ = open_[bound[open_] > EQUAL]
    best, score = np.zeros(0, np.int64), np.zeros(0)
    for last in (False, True):
        visited = np.zeros(x.blocks, bool)
        visited[open_] = True
        mine = np.flatnonzero(visited[block])
        lo = x.at[post[mine]]
        long = x.at[post[mine] + 1] - lo
        at = _ranges(lo, long)
        sim = np.bincount(x.example[at], np.repeat(w[mine], long) * x.impact[at], x.blocks * BLOCK).astype(float)
        sim.reshape(-1, BLOCK)[open_] += base[open_]
        sim = np.round(sim, 8)
        hit = np.flatnonzero(sim > EQUAL)
        if skip is not None:
            hit = hit[x.doc[hit] != skip]
        if len(hit) > k:
            near = sim[hit]
            hit = hit[near >= np.partition(near, len(near) - k)[len(near) - k]]
        best, score = np.concatenate([best, hit]), np.concatenate([score, sim[hit]])
        top = np.lexsort((x.doc[best], -score))[:k]
        best, score = best[top], score[top]
        if last:
            break
        rest = bound >= max(score[k - 1] - EQUAL if len(score) >= k else 0.0, EQUAL)
        rest[open_] = False
        open_ = np.flatnonzero(rest)
        if not len(open_):
            break
    return best, score


def vote(x: Index, best: np.ndarray, score: np.ndarray) -> float:
    w = 1 / (1.1 - np.minimum(score, 1.0)) ** 2
    return float((w * x.label[best]).sum() / w.sum())


class Scorer:
    def __init__(self, x: Index) -> None:
        self.x, self.table = x, ts.Table(12)
        self.table.add(x.term, np.arange(len(x.term), dtype=np.int32))

    def known(self, block: ts.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, term and weight, terms ascending in each document."""
        doc, term, count = distinct_known(block, self.table)
        return doc, term, weights(doc, term, count, self.x.weight, block.n)

    def texts(self, values: pa.Array, skip: np.ndarray | None = None) -> tuple[np.ndarray, list[list[int]]]:
        """Votes (-1 without neighbours), and the doc_ids of the examples that they rest on."""
        out, found = np.full(len(values), -1.0), [[] for _ in range(len(values))]
        for b in ts.blocks(values):
            doc, term, w = self.known(b)
            heads = np.searchsorted(doc, np.arange(b.n + 1))
            seen: dict[bytes, tuple[float, list[int]]] = {}
            for lo in range(0, b.n, TEXTS):
                hi = min(b.n, lo + TEXTS)
                part = slice(heads[lo], heads[hi])
                base = common(self.x, doc[part] - lo, term[part], w[part], hi - lo)
                for d in range(lo, hi):
                    mine = slice(heads[d], heads[d + 1])
                    if heads[d] == heads[d + 1]:
                        continue
                    name = term[mine].tobytes() + w[mine].tobytes()
                    if skip is not None or name not in seen:
                        best, sim = nearest(self.x, term[mine], w[mine], base[d - lo], None if skip is None else int(skip[b.first + d]))
                        seen[name] = (vote(self.x, best, sim) if len(best) else -1.0), self.x.doc[best[:EVIDENCE]].tolist()
                    out[b.first + d], found[b.first + d] = seen[name]
        return out, found

    def scores(self, votes: np.ndarray) -> np.ndarray:
        return np.where(votes < 0, self.x.bare, 1 / (1 + np.exp(-(self.x.curve[0] + self.x.curve[1] * votes))))


def _corpus_frequencies(docs: DataFrame, term: np.ndarray) -> tuple[np.ndarray, int]:
    """The documents that hold each term, and the number of all documents. A task adds up its own; as many sums as there are
    terms reach the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(term)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows = ts.Table(12), 0
        table.add(shared.value, np.arange(len(shared.value), dtype=np.int32))
        df = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            rows += batch.num_rows
            for b in ts.blocks(batch.column(0)):
                df += np.bincount(distinct_known(b, table)[1], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], rows))], names=["t", "n"])

    got = docs.select(F.col("text").cast("string")).mapInArrow(each, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toPandas()
    out, total = np.zeros(len(term), np.int64), 0
    for t, n in zip(got["t"].to_numpy(), got["n"].to_numpy()):
        if t < 0:
            total = int(n)
        else:
            out[t] = n
    return out, total


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample: int = 2500, text_bytes: int = 64 << 20) -> Index:
    """docs: doc_id, text; labels: doc_id, toxic; ``train`` is over doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.filter(train & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))

    def thinned(df: DataFrame, share: float) -> DataFrame:
        return df.filter(F.xxhash64("doc_id").bitwiseAND((1 << 30) - 1) < int(share * (1 << 30))) if share < 1 else df

    share = sample / max(1, known.count())
    rows = written(docs.filter(F.col("text").isNotNull()).join(F.broadcast(thinned(known, share)), "doc_id"), "examples")  # about ``sample`` rows
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > text_bytes:
        rows = thinned(rows, min(share, 1.0) * text_bytes / size)

    def vectorise(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, keys, count = [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for b in ts.blocks(batch.column(2)):
            d, w, c = vectors(b)
            doc.append(d + b.first)
            keys.append(w)
            count.append(c)
        off = np.searchsorted(np.concatenate(doc), np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(x)) for x in (np.concatenate(keys).view(np.int64), np.concatenate(count))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "toxic", "keys", "count"])

    # As many rows as the sample has
    got = rows.select("doc_id", "toxic", "text").mapInArrow(per_batch(vectorise), "doc_id long, toxic int, keys array<long>, count array<long>").toArrow()
    ids, label = got["doc_id"].to_numpy(), got["toxic"].to_numpy()
    keys, count = (got[c].combine_chunks() for c in ("keys", "count"))
    doc = np.repeat(np.arange(len(ids)), np.diff(keys.offsets.to_numpy())) if len(ids) else np.zeros(0, np.int64)
    keys, count = keys.flatten().to_numpy().view(U64), count.flatten().to_numpy()
    term = np.unique(keys)
    if not len(ids) or not label.any():
        none = np.zeros(0, np.int64)
        return build(none, none, none, np.zeros(0, U64), none, np.zeros(0, U64), none, 0)
    x = build(ids, label, doc, keys, count, term, *_corpus_frequencies(docs, term))
    return calibrated(rows, x)


def calibrated(rows: DataFrame, x: Index) -> Index:
    """x with the curve of votes of the examples, each left out of its own."""
    shared = rows.sparkSession.sparkContext.broadcast(x)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            votes, _ = scorer.texts(batch.column(2), batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(votes), batch.column(1)], names=["vote", "toxic"])

    got = rows.select("doc_id", "toxic", "text").mapInArrow(each, "vote double, toxic int").filter("vote >= 0").toArrow()
    x.curve = logistic(got["vote"].to_numpy(), got["toxic"].to_numpy().astype(float))
    return x


def logistic(v: np.ndarray, y: np.ndarray, prior: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope (not below 0) of the log odds of a label over the vote, by Newton's method; ``prior`` keeps them finite."""
    x, fit_ = np.stack([np.ones(len(v)), v], 1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ fit_))
        fit_ = fit_ + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + prior * np.eye(2), x.T @ (y - p) - prior * fit_)
    if fit_[1] < 0:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return float(np.log(share / (1 - share))), 0.0
    return float(fit_[0]), float(fit_[1])


def score(docs: DataFrame, fitted: Index, at: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from ``at`` on) and evidence (doc_ids of the nearest examples)."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    state: dict[str, Scorer] = {}

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "it" not in state:
            state["it"] = Scorer(shared.value)
        votes, found = state["it"].texts(batch.column(1))
        s = state["it"].scores(votes)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= at).astype(np.int32)), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "score", "predicted", "evidence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(per_batch(judge), "doc_id long, score double, predicted int, evidence array<long>")
