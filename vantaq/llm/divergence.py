"""Source divergence audit: how far the sources of a language are from each other, and which terms set a source apart.

Texts are read as bytes: a table of 256 entries tells letters (A-Z, a-z and every byte of a character beyond ASCII) from the rest, so the
boundaries of terms are changes in one flat buffer of a few MB of whole texts. Slices are grouped by their 64-bit xxhash, and each is compared with
its group's first slice byte by byte; what differs gets a group of its own. A document x term matrix in compressed rows follows from one sort,
and sums over its rows give counts and numbers of documents by (lang, source, term). Spark adds these up; terms in fewer than ``LEAST_DOCS``
documents of a language go. The kept counts are dealt by (lang, share of the terms), and each share is a sparse source x term matrix from which
``reduceat`` sums give the divergences of all pairs of sources and the share's most distinctive terms.

All arithmetic is on whole numbers. A share p = 1 + floor(UNIT * (count + 1) / (N + V)); a divergence floor((p - q)^2 / q).

A flush holds at most ``FLUSH_BYTES`` of text (or the longest text), a share about ``SHARE_ENTRIES`` counts. A term that is in all texts has a row for each source and
flush when counts are added up. Pairs of sources are in the output, so the output itself grows with the square of a language's sources.

Cases: null text, lang and source are empty ones, which are values like others; texts of any length are handled whole; repeated rows, and rows without doc_id, are
documents each; ties of values go by the item's bytes; a language without kept terms has its pairs, with value 0, and no term rows; a
language with one source has no pairs; an empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan as ts
from .base import partitions, per_batch, written
from .pieces import spread

U64 = np.uint64
UNIT = 1_000_000_000
LEAST_DOCS = 3
TOP_TERMS = 200
FLUSH_BYTES = 8 << 20
SHARE_ENTRIES = 250_000

#: Bytes of terms, and bytes with A-Z lower-cased.
MEMBER = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Fixed values of the hash.
P1, P2, P3, P4, P5 = (U64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U64(n)) | (x >> U64(64 - n))


def _at(buf: np.ndarray, dtype: str) -> np.ndarray:
    """buf, padded, as numbers that start at each byte."""
    return np.ndarray(len(buf) - 7, dtype, buf, 0, (1,))


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The 64-bit xxhash of each slice of buf, which has 8 bytes more than the slices use. Slices of up to 31 bytes many at once, longer ones by the library."""
    size = end - start
    out = size.astype(U64) + P5
    eight, four = _at(buf, "<u8"), _at(buf, "<u4")
    for k in range(0, 24, 8):
        on = np.flatnonzero((size >= k + 8) & (size < 32))
        if len(on):
            lane = eight[start[on] + k]
            out[on] = _turned(out[on] ^ (_turned(lane * P2, 31) * P1), 27) * P1 + P4
    at = start + (size & ~7)
    on = np.flatnonzero((size & 4 > 0) & (size < 32))
    out[on] = _turned(out[on] ^ (four[at[on]].astype(U64) * P1), 23) * P2 + P3
    at += size & 4
    for k in range(3):
        on = np.flatnonzero((size & 3 > k) & (size < 32))
        out[on] = _turned(out[on] ^ (buf[at[on] + k].astype(U64) * P5), 11) * P1
    out = (out ^ (out >> U64(33))) * P2
    out = (out ^ (out >> U64(29))) * P3
    out ^= out >> U64(32)
    for i in np.flatnonzero(size >= 32).tolist():
        out[i] = xxhash.xxh64_intdigest(buf[start[i] : end[i]].tobytes())
    return out


def grouped(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each slice, equal for equal slices alone, and for each number one of its slices."""
    h = hashes(buf, start, end)
    order = np.argsort(h)
    head = np.ones(len(h), bool)
    head[1:] = h[order[1:]] != h[order[:-1]]
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(head) - 1
    first = order[head]
    # Verified byte by byte, eight at once
    size, other = end - start, first[group]
    wrong = size != size[other]
    eight = _at(buf, "<u8")
    on = np.flatnonzero(~wrong)
    k = 0
    while len(on):
        left = np.minimum(size[on] - k, 8)
        mask = ~U64(0) >> (U64(64) - U64(8) * left.astype(U64))
        wrong[on] |= ((eight[start[on] + k] ^ eight[start[other[on]] + k]) & mask) > 0
        k += 8
        on = on[size[on] > k]
    if wrong.any():
        known: dict[bytes, int] = {}
        more = []
        for i in np.flatnonzero(wrong).tolist():
            text = buf[start[i] : end[i]].tobytes()
            if text not in known:
                known[text] = len(first) + len(more)
                more.append(i)
            group[i] = known[text]
        first = np.concatenate([first, more])
    return group, first


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = pc.fill_null(values, "").dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary


def counted(block: ts.Block, lang: pa.Array, source: pa.Array) -> pa.RecordBatch | None:
    """lang, source, term, count and docs of a block of texts."""
    member = MEMBER[block.buf]
    start, end, first = ts.runs(member, block.byte_off)
    if not len(start):
        return None
    buf = np.concatenate([FOLD[block.buf], np.zeros(8, np.uint8)])
    term, one = grouped(buf, start, end)
    langs, lang_names = _codes(lang)
    sources, source_names = _codes(source)
    both = langs * len(source_names) + sources
    # Documents are numbered by their (lang, source), so one sort puts each term's documents, and its sources, side by side.
    by_source = np.argsort(both, kind="stable")
    number = np.empty(block.n, np.int64)
    number[by_source] = np.arange(block.n)
    key = np.sort(term * block.n + np.repeat(number, np.diff(first)))
    cell = np.flatnonzero(np.diff(key, prepend=-1))  # document x term, compressed by terms
    times = np.add.reduceat(np.ones(len(key), np.int64), cell)
    term, group = key[cell] // block.n, both[by_source][key[cell] % block.n]
    row = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0))
    count = np.add.reduceat(times, row)
    docs = np.diff(np.append(row, len(cell)))
    size = (end - start)[one]
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    names = pa.Array.from_buffers(pa.string(), len(one), [None, pa.py_buffer(off), pa.py_buffer(buf[spread(start[one], size)])])
    columns = [lang_names.take(pa.array(group[row] // len(source_names))), source_names.take(pa.array(group[row] % len(source_names))), names.take(pa.array(term[row]))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(count), pa.array(docs)], names=["lang", "source", "term", "count", "docs"])


def term_counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, count and head (true in one row of each kept term) for terms in at least ``least`` documents of their language."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = [counted(x, batch.column(1).slice(x.first, x.n), batch.column(2).slice(x.first, x.n)) for x in ts.blocks(batch.column(0), FLUSH_BYTES)]
        parts = [x for x in parts if x is not None]
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None

    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    found = read.mapInArrow(per_batch(count), "lang string, source string, term string, count long, docs long")
    # One exchange serves the sums and the windows.
    dealt = found.repartition(partitions(docs.sparkSession), "lang", "term")
    summed = dealt.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    whole = summed.withColumn("head", F.row_number().over(term.orderBy("source")) == 1).withColumn("lang_docs", F.sum("docs").over(term))
    return whole.filter(F.col("lang_docs") >= least).select("lang", "source", "term", "count", "head")


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), by long division, so that no product leaves 64 bits."""
    rest, out = count + 1, np.zeros(len(count), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1, np.int64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[full])
    return out


def pair_values(row: np.ndarray, term: np.ndarray, count: np.ndarray, terms: int, total: np.ndarray) -> np.ndarray:
    """For sources s and t the divergence of s from t over ``terms`` terms: a matrix. Entries are in order of row (source); ``total`` is each source's N + V."""
    n = len(total)
    first = np.searchsorted(row, np.arange(n + 1))
    p, none = shares(count, total[row]), shares(np.zeros(n, np.int64), total)
    out = np.zeros((n, n), np.int64)
    there, held = np.zeros(terms, np.int64), np.zeros(terms, bool)
    size = np.diff(first)
    for t in range(n):
        own = slice(first[t], first[t + 1])
        there[:], held[:] = none[t], False
        there[term[own]], held[term[own]] = p[own], True
        q, both = there[term], held[term]
        # Terms of s; terms of t alone; terms of neither
        of_s = _by_row(apart(p, q), first)
        shared = _by_row(np.where(both, apart(none[row], q), 0), first)
        of_t = np.array([apart(none[s], p[own]).sum() for s in range(n)], np.int64) if size[t] else np.zeros(n, np.int64)
        neither = terms - size - size[t] + _by_row(both.astype(np.int64), first)
        out[:, t] = of_s + of_t - shared + neither * apart(none, none[t])
    return out


def _share(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    """lang, source, part, item and value of one language's share of the terms; pairs are to be added up."""
    lang, share = key[0].as_py(), key[1].as_py()
    right = right.sort_by("source")
    sources = right["source"].combine_chunks()
    total = np.asarray(right["n"]).astype(np.int64) + np.asarray(right["v"]).astype(np.int64)
    n, out = len(sources), []

    def rows(part: str, source: np.ndarray, item: pa.Array, value: np.ndarray) -> None:
        names = [pa.array([x] * len(value), pa.string()) for x in (lang, part)]
        out.append(pa.table({"lang": names[0], "source": sources.take(pa.array(source)), "part": names[1], "item": item, "value": pa.array(value)}))

    value = np.zeros((n, n), np.int64)
    if len(left):
        coded = left["term"].combine_chunks().dictionary_encode()
        term, row = np.asarray(coded.indices).astype(np.int64), np.asarray(pc.index_in(left["source"].combine_chunks(), sources)).astype(np.int64)
        order = np.lexsort((term, row))
        term, row, count = term[order], row[order], np.asarray(left["count"])[order].astype(np.int64)
        value = pair_values(row, term, count, len(coded.dictionary), total)
        by_term = np.argsort(term, kind="stable")
        of_lang = np.add.reduceat(count[by_term], np.searchsorted(term[by_term], np.arange(len(coded.dictionary))))
        lang_n = int(np.asarray(right["lang_n"])[0]) + int(np.asarray(right["v"])[0])
        p, q = shares(count, total[row]), shares(of_lang, lang_n)[term]
        # The share's first terms of each source
        rank = np.argsort(np.asarray(pc.array_sort_indices(coded.dictionary.cast(pa.binary()))))
        more = np.flatnonzero((p > q) & (count > 0))
        far = apart(p[more], q[more])
        best = np.lexsort((rank[term[more]], -far, row[more]))
        place = np.arange(len(best)) - np.searchsorted(row[more][best], row[more][best])
        best = best[place < TOP_TERMS]
        rows("term", row[more][best], coded.dictionary.take(pa.array(term[more][best])), far[best])
    if len(left) or share == 0:
        s, t = np.nonzero(~np.eye(n, dtype=bool))
        rows("pair", s, sources.take(pa.array(t)), value[s, t])
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    return pa.concat_tables([schema.empty_table(), *(x.cast(schema) for x in out)])


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank (module's docstring). ``top``: term rows of a source, TOP_TERMS at most."""
    if top > TOP_TERMS:
        raise ValueError(f"top is {TOP_TERMS} at most")
    kept = written(term_counts(docs, least), "terms")
    shares_ = max(1, -(-kept.count() // SHARE_ENTRIES))
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.sum(F.col("head").cast("long")).alias("heads"))
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct().join(sums, ["lang", "source"], "left")
    lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.sum("heads").over(lang), F.lit(0)).alias("v"), F.coalesce(F.sum("n").over(lang), F.lit(0)).alias("lang_n"))
    right = groups.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares_ - 1))))
    left = kept.select("lang", "source", "term", "count", F.pmod(F.xxhash64("term"), F.lit(shares_)).cast("int").alias("share"))
    found = written(left.groupBy("lang", "share").cogroup(right.groupBy("lang", "share")).applyInArrow(_share, "lang string, source string, part string, item string, value long"), "shares")
    group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(group)).filter(F.col("rank") <= top)
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(group))
    return terms.unionByName(pairs.select(terms.columns))


def oracle() -> str:
    """The same rows in SQL. Every sum of a pair is over all kept terms."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_count FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(lang_count) AS lang_n FROM kept GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT g.lang, g.source, coalesce(s.n, 0) + coalesce(v.v, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {UNIT}::HUGEINT * (coalesce(c.n, 0) + 1) // g.total AS p, 1 + {UNIT}::HUGEINT * (k.lang_count + 1) // (v.lang_n + v.v) AS of_lang
      FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - of_lang) * (p - of_lang) // of_lang FROM p WHERE n > 0 AND p > of_lang),
ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
