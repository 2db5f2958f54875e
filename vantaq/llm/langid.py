"""Language identification by word-first backoff.

A word that the training rows hold is scored by its frequency in each language. A word that they do
not hold is scored by character n-grams: at each of its positions by the longest known n-gram that
starts there, from ``LONGEST`` characters (with marks for the word's ends) down to one. A text's score
is the sum over its words.

The model is fitted on a bounded sample of labelled rows: about ``sample`` documents and about ``text_bytes`` of text, in equal
parts of each language, drawn by a hash of doc_id, whole texts each. All their words and n-grams are kept; the sample bounds what is
broadcast. Everything else covers all rows and whole texts.

Cases: a null text, or one without letters, is ``und`` with score 0; ties between languages go to the
first in alphabetical order; with no labelled rows everything is ``und``; rows without doc_id are judged but not
learned from; repeated rows are judged alike; very long texts are judged whole, one at a time; an empty table gives no rows; other
columns stay as they are, but for lang_pred and score, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan as ts
from .base import per_batch

LONGEST = 5
UND = "und"
#: What marks the ends of a word among its characters' codes.
_HEAD, _TAIL = np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x5A5A5A5A5A5A5A5B)
#: A word of n-gram scores weighs as much as this many n-grams.
_WEIGHT = 1.5


@dataclass
class Model:
    langs: list[str]
    word_keys: np.ndarray
    word_scores: np.ndarray
    gram_keys: np.ndarray
    gram_scores: np.ndarray


class Scorer:
    def __init__(self, model: Model) -> None:
        self.langs, self.word_scores = model.langs, model.word_scores
        self.words, self.grams = ts.Table(18), ts.Table(18)
        self.words.add(model.word_keys, np.arange(len(model.word_keys), dtype=np.int32))
        self.grams.add(model.gram_keys, np.arange(len(model.gram_keys), dtype=np.int32))
        self.gram_scores = np.vstack([model.gram_scores, np.full((1, len(self.langs)), np.log(1e-7))])

    def unseen(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Scores of words by backing off from long n-grams to short ones."""
        n, k = len(start), len(self.langs)
        codes, off = marked(low, start, end)
        gram = np.full(len(codes), -1, np.int32)
        r = ts.Rolling(codes)
        size = np.diff(off)
        at = np.arange(len(codes))
        left = np.repeat(off[1:], size) - at
        for width in range(LONGEST, 0, -1):
            lane = at[(gram < 0) & (left >= width)]
            gram[lane] = self.grams.find(r.of(lane, lane + width))
        out = np.empty((n, k))
        for j in range(k):
            out[:, j] = ts.sums_by(self.gram_scores[:, j][gram], off)
        return out / size[:, None] * _WEIGHT

    def texts(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The best language's number (-1 for none) and its score."""
        best, score = [], []
        for b in ts.blocks(values):
            start, end, first, hasher, low = ts.words(b, digits=False)
            total = np.zeros((b.n, len(self.langs)))
            if len(start):
                h = hasher.of(start, end)
                row = self.words.find(h)
                known = row >= 0
                new = np.flatnonzero(~known)
                each = np.where(known, row, 0)
                if len(new):
                    keys, one = ts.distinct(h[new])
                    backed = self.unseen(low, start[new[one]], end[new[one]])
                    each[new] = len(self.word_scores) + np.searchsorted(keys, h[new])
                    rows = np.vstack([self.word_scores, backed])
                else:
                    rows = self.word_scores
                for j in range(len(self.langs)):
                    total[:, j] = ts.sums_by(rows[:, j][each], first)
            n = np.diff(first)
            top = total.argmax(axis=1)
            mean = (total - total.max(axis=1, keepdims=True)) / np.maximum(n, 1)[:, None]
            sure = 1 / np.exp(mean * np.minimum(n, 12)[:, None]).sum(axis=1)
            best.append(np.where(n > 0, top, -1))
            score.append(np.where(n > 0, sure, 0.0))
        return np.concatenate(best or [np.zeros(0, np.int64)]), np.concatenate(score or [np.zeros(0)])


def marked(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of words' characters with a mark before and after each word."""
    size = end - start + 2
    off = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    src = np.repeat(start - off[:-1] - 1, size) + np.arange(off[-1])
    codes = ts.codes_of(low[np.clip(src, 0, len(low) - 1)])
    codes[off[:-1]], codes[off[1:] - 1] = _HEAD, _TAIL
    return codes, off


def fit(docs: DataFrame, train: Column, sample: int = 2000, text_bytes: int = 32 << 20) -> Model:
    """docs: text and lang, and the columns that ``train`` needs, doc_id among them."""
    rows = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()  # a row for each language
    if not sizes:
        return model([], [], [])
    shares = {r["lang"]: min(1.0, sample / len(sizes) / r["n"], text_bytes / len(sizes) / max(1, r["size"])) for r in sizes}
    drawn = F.create_map(*[F.lit(x) for lang, share in shares.items() for x in (lang, int(share * (1 << 30)))])
    words = (
        rows.filter(F.xxhash64("doc_id").bitwiseAND((1 << 30) - 1) < drawn[F.col("lang")])
        .select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word"))
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
        .toArrow()  # as many rows as the sample has words
        .sort_by([("lang", "ascending"), ("word", "ascending")])
    )
    return model(*(words[c].to_pylist() for c in ("lang", "word", "n")))


def model(langs: list[str], words: list[str], counts: list[int]) -> Model:
    """Each (language, word) pair with the number of its uses."""
    names = sorted(set(langs))
    k = len(names)
    if not words:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros(0, np.uint64), np.zeros((0, 0)))
    number = {x: i for i, x in enumerate(names)}
    lang = np.array([number[x] for x in langs])
    n = np.array(counts, np.float64)
    hashes, keys, tables = [], [], []
    cut = []
    for b in ts.blocks(pa.array(words, pa.string())):
        cp, _, off = b.chars()
        hashes.append(ts.Rolling(ts.codes_of(cp)).of(off[:-1], off[1:]))
        cut.append((b, *marked(cp, off[:-1], off[1:])))
    for width in range(1, LONGEST + 1):  # a width at a time, to hold less
        grams, gram_lang, gram_n = [], [], []
        for b, codes, off in cut:
            size = np.diff(off)
            at = np.flatnonzero(np.repeat(off[1:], size) - np.arange(len(codes)) >= width)
            owner = b.first + np.repeat(np.arange(b.n), size)[at]
            grams.append(ts.Rolling(codes).of(at, at + width))
            gram_lang.append(lang[owner])
            gram_n.append(n[owner] ** 0.5)  # between counting words and counting their uses
        h, table = _counted(np.concatenate(grams), np.concatenate(gram_lang), np.concatenate(gram_n), k)
        keys.append(h)
        tables.append(table)
    gram_keys, one = np.unique(np.concatenate(keys), return_index=True)
    word_keys, table = _counted(np.concatenate(hashes), lang, n, k)
    return Model(names, word_keys, _scores(table), gram_keys, _scores(np.concatenate(tables)[one]))


def _counted(h: np.ndarray, lang: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts in each language."""
    keys, at = np.unique(h, return_inverse=True)
    return keys, np.bincount(at * k + lang, weights=n, minlength=len(keys) * k).reshape(-1, k)


def _scores(table: np.ndarray) -> np.ndarray:
    """Smoothed log frequencies in each language."""
    return np.log((table + 0.1) / (table.sum(axis=0) + 0.1 * len(table))).astype(np.float32)


def predict(docs: DataFrame, fitted: Model) -> DataFrame:
    """Adds lang_pred and score, judged by the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    source = docs.select(*[F.col(f"`{c}`") for c in keep])
    text_at = keep.index("text")
    state: dict[str, Scorer] = {}

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        texts = batch.column(text_at)
        if not m.langs:
            lang, score = pa.array([UND] * batch.num_rows), np.zeros(batch.num_rows)
        else:
            if "scorer" not in state:
                state["scorer"] = Scorer(m)
            best, score = state["scorer"].texts(texts)
            lang = pa.array([UND, *m.langs]).take(pa.array(best + 1))
        return pa.RecordBatch.from_arrays([*batch.columns, lang, pa.array(score)], names=[*keep, "lang_pred", "score"])

    schema = T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(per_batch(judge), schema)
