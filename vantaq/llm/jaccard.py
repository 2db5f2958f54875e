"""N-gram Jaccard join by chosen paths.

A document's set holds its distinct word ``SHINGLE``-grams. Documents with equal sets are one
representative with a count. Each of ``runs`` independent runs sends a representative down one path:
at every level the token with the least hash under the path so far is chosen, so two sets stay together
with their Jaccard similarity as the chance. Buckets are paths of two tokens; those with more members
than ``limit`` are split further, up to ``DEPTH`` tokens. The number of runs follows from the target recall at the threshold
similarity and full depth; shallower buckets do better. Inside a bucket all pairs are compared exactly.
A bucket of more than ``PART`` members is compared block against block, in as many groups as there are pairs of
blocks, so no group much exceeds two blocks. A pair that shares several buckets counts in the one of least number.

Cases: texts of one to four words have one shingle, all their words; null texts and those without words
have none and link to nothing; rows without doc_id link to nothing, and have no set_id and class_id; rows that repeat a doc_id are one
document, of the least of their texts, and have a row each; equal sets are linked whatever their number; ties cannot arise, a class's id
is its smallest doc_id; very long texts are sets like others; an empty table gives no rows; other columns, whatever their names, are
not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .base import partitions, per_batch, shared_dir, written

U64 = np.uint64
SHINGLE = 5
LEVELS, DEPTH = 2, 4
#: A vertex with more edges than this, and than one edge in HOT of all, is dealt to SALTS tasks.
HOT, SALTS = 1000, 64
#: Members of a bucket that are compared in one group; larger buckets go block against block.
PART = 256


def runs_for(threshold: float, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**DEPTH))


def shingles(block: ts.Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingles in ascending order, and the first of each document."""
    start, end, first, hasher, _ = ts.words(block)
    n = np.diff(first)
    if not len(start):
        return np.zeros(0, U64), np.zeros(block.n + 1, np.int64)
    h = hasher.of(start, end)
    k = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    off = np.zeros(block.n + 1, np.int64)
    np.cumsum(k, out=off[1:])
    at = np.repeat(first[:-1] - off[:-1], k) + np.arange(off[-1])
    stop = np.repeat(first[1:], k)
    s = np.zeros(len(at), U64)
    padded = np.append(h, np.zeros(size, U64))
    for j in range(size):
        s = (s + np.where(at + j < stop, padded[at + j], U64(0))) * U64(0xD6E8FEB86659FD93)
        s ^= s >> U64(32)
    s = ts.mix(s)
    for i, j in zip(off[:-1].tolist(), off[1:].tolist()):
        s[i:j].sort()
    keep = np.ones(len(s), bool)
    keep[1:] = s[1:] != s[:-1]
    keep[off[:-1][k > 0]] = True
    total = np.zeros(len(s) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return s[keep], total[off]


def descend(tokens: np.ndarray, heads: np.ndarray, size: np.ndarray, path: np.ndarray, levels: int) -> np.ndarray:
    """The paths of sets (none of them empty) after some more levels."""
    for _ in range(levels):
        v = (tokens ^ np.repeat(path, size)) * U64(0x9E3779B97F4A7C15)
        v ^= v >> U64(32)
        v *= U64(0xD6E8FEB86659FD93)
        path = ts.mix(path + np.minimum.reduceat(v, heads))
    return path


def _signatures(runs: int):
    start = ts.mix(np.arange(1, runs + 1, dtype=U64))

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, a, b, keys = [], [], [], []
        for block in ts.blocks(batch.column(1)):
            tokens, off = shingles(block)
            n = np.diff(off)
            some = np.flatnonzero(n)
            heads, k = off[:-1][some], n[some]
            x, y = np.zeros(block.n, U64), np.zeros(block.n, U64)
            each = np.zeros((block.n, runs), U64)
            if len(some):
                x[some], y[some] = np.add.reduceat(ts.mix(tokens), heads), np.add.reduceat(ts.mix(tokens ^ U64(0xABCDEF)), heads)
                for r in range(runs):
                    each[some, r] = descend(tokens, heads, k, np.full(len(some), start[r]), LEVELS)
            size.append(n)
            a.append(x)
            b.append(y)
            keys.append(each)
        n = np.concatenate(size)
        each = np.concatenate(keys)[n > 0].ravel().view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, runs, 0))]).astype(np.int32)), pa.array(each))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64)), lists], names=["doc_id", "n", "a", "b", "keys"])

    return sign


def _buckets(rows: DataFrame, limit: int | None) -> DataFrame:
    """rows: rep, key. Buckets of two members or more, one of those with the same members: rep, bucket, c. Buckets of more than
    ``limit`` members all stay, as each is split along its own path."""
    stats = rows.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("c > 1")
    own = F.lit(None).cast("long") if limit is None else F.when(F.col("c") > limit, F.col("key"))
    one = stats.groupBy("c", "x", "lo", "hi", own.alias("own")).agg(F.min("key").alias("key")).select("key", "c")
    return rows.join(one, "key").select("rep", F.col("key").alias("bucket"), "c")


def _refine(batch: pa.RecordBatch) -> pa.RecordBatch:
    rep, keys = [], []
    for block in ts.blocks(batch.column(1)):
        tokens, off = shingles(block)
        listed = batch.column(2).slice(block.first, block.n)
        times = np.diff(listed.offsets.to_numpy())
        path = listed.flatten().to_numpy().view(U64)
        owner = np.repeat(np.arange(block.n), times)
        ids = batch.column(0).to_numpy()[block.first : block.first + block.n]
        for d in range(block.n):
            mine = path[owner == d]
            t = tokens[off[d] : off[d + 1]]
            for p in mine:
                keys.append(descend(t, np.array([0]), np.array([len(t)]), np.array([p]), 1)[0])
                rep.append(ids[d])
    return pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(np.array(keys, U64).view(np.int64))], names=["rep", "key"])


def _ship():
    def ship(batch: pa.RecordBatch) -> pa.RecordBatch:
        """A row for each group that a representative takes part in."""
        group, side, rep, copies, size, buckets, sets = [], [], [], [], [], [], []
        for block in ts.blocks(batch.column(1)):
            tokens, off = shingles(block)
            for d in range(block.n):
                i = block.first + d
                listed = batch.column(3)[i].as_py()
                mine = sorted(x["bucket"] for x in listed)
                raw = tokens[off[d] : off[d + 1]].tobytes()
                r = batch.column(0)[i].as_py()
                for x in listed:
                    parts = -(-x["c"] // PART)
                    at = int(ts.mix(np.array([r], np.int64).view(U64))[0] % U64(parts))
                    for other in range(parts):
                        pair = np.array([x["bucket"], min(at, other), max(at, other)], np.int64).view(U64)
                        g = ts.mix(ts.mix(pair[0] + pair[1]) + pair[2]) if parts > 1 else pair[0]
                        group.append((x["bucket"], int(np.array([g], U64).view(np.int64)[0])))
                        side.append(2 if at == other or parts == 1 else int(at > other))
                        rep.append(r)
                        copies.append(batch.column(2)[i].as_py())
                        size.append(int(off[d + 1] - off[d]))
                        buckets.append(mine)
                        sets.append(raw)
        return pa.RecordBatch.from_arrays(
            [pa.array([g[1] for g in group], pa.int64()), pa.array([g[0] for g in group], pa.int64()), pa.array(side, pa.int32()), pa.array(rep, pa.int64()), pa.array(copies, pa.int64()), pa.array(size, pa.int64()), pa.array(buckets, pa.list_(pa.int64())), pa.array(sets, pa.binary())],
            names=["group", "bucket", "side", "rep", "copies", "size", "buckets", "tokens"],
        )

    return ship


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairs' intersections."""
    m = len(sets)
    if m == 2:
        s = np.sort(np.concatenate(sets))
        k = int((s[1:] == s[:-1]).sum())
        return np.array([[len(sets[0]), k], [k, len(sets[1])]])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(flat)
    s, owner = flat[order], owner[order]
    fresh = np.append(True, s[1:] != s[:-1])
    column = np.cumsum(fresh) - 1
    several = np.bincount(column)[column] > 1
    owner, column = owner[several], column[several]
    out = np.zeros((m, m), np.float32)
    if len(column):
        column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1
        width = max(1, 4_000_000 // m)
        for lo in range(0, int(column[-1]) + 1, width):
            i, j = np.searchsorted(column, [lo, lo + width])
            a = np.zeros((m, min(width, int(column[j - 1]) + 1 - lo)), np.float32)
            a[owner[i:j], column[i:j] - lo] = 1
            out += a @ a.T
    return np.rint(out).astype(np.int64)


def compare(bucket: int, rows: list[tuple], threshold: float) -> list[tuple[int, int, int]]:
    """rows: side, rep, copies, size, buckets, tokens. For each representative with a link: it, the documents that it links
    to by pairs counted here, and the smallest representative that it is connected to here."""
    m = len(rows)
    side = np.array([r[0] for r in rows])
    rep, copies, size = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
    both = shared_counts([np.frombuffer(r[5], U64) for r in rows])
    link = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    if (side != 2).any():
        link &= side[:, None] != side[None, :]
    np.fill_diagonal(link, False)
    i, j = np.nonzero(np.triu(link))
    if not len(i):
        return []
    most = max(len(r[4]) for r in rows)
    other = np.full((m, most), np.iinfo(np.int64).max)
    for k, r in enumerate(rows):
        other[k, : len(r[4])] = r[4]
    mine = np.ones(len(i), bool)
    for a in range(most):
        x = other[i, a]
        for b in range(most):
            mine &= ~((x < bucket) & (x == other[j, b]))
    links = np.bincount(i[mine], copies[j[mine]], m) + np.bincount(j[mine], copies[i[mine]], m)
    root = rep.copy()
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        if (low == root).all():
            break
        root = low
    some = link.any(axis=1)
    return [(int(rep[k]), int(links[k]), int(root[k])) for k in np.flatnonzero(some)]


def _compare_all(threshold: float):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = (None, None), []
        out: list[tuple[int, int, int]] = []

        def emit() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["rep", "links", "root"])
            out.clear()
            return made

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(8)]
            for group, bucket, *row in zip(*columns):
                if (group, bucket) != now:
                    if len(rows) > 1:
                        out += compare(now[1], rows, threshold)
                    now, rows = (group, bucket), []
                rows.append(tuple(row))
            if len(out) > 10_000:
                yield emit()
        if len(rows) > 1:
            out += compare(now[1], rows, threshold)
        if out:
            yield emit()

    return each


def _with_least(both: DataFrame, edges: int) -> DataFrame:
    """both (u, v) with m, the least v of u. Edges of a hub are dealt to SALTS tasks, as its m is; hubs have one edge in HOT of all
    at least, so there are no more than 2 x HOT of them."""
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    hubs = low.filter(F.col("c") > max(HOT, edges // HOT)).select("u", F.lit(SALTS).alias("salts"))
    hubs = F.broadcast(hubs)
    salted = both.join(hubs, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    spread = low.join(hubs, "u", "left").select("u", "m", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    return salted.join(spread, ["u", "salt"]).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v. The smallest member of each vertex's component: u, root (vertices that are their own root are left out).
    Alternates large and small stars until nothing changes; every round is checkpointed in the shared folder."""
    shared_dir(edges.sparkSession)
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct().checkpoint()
    n, seen = e.count(), None
    while True:
        large = _with_least(e.union(e.select("v", "u")), n).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.filter("u != v").distinct()
        # u has larger numbers only on its left now, so its least neighbour is its root's candidate.
        least = _with_least(large, n)
        small = least.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = small.filter("u != v").distinct().checkpoint()
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return e.select("u", F.col("v").alias("root"))
        n, seen = now[0], now


def _one_text_each(docs: DataFrame) -> DataFrame:
    """Rows that repeat a doc_id get the least of its texts. Only such rows are shuffled with their texts."""
    repeated = docs.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return docs
    least = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return docs.join(repeated, "doc_id", "left_anti").unionByName(docs.select("doc_id").join(least, "doc_id"))


def join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, set_id (the smallest document with the same shingles), n_copies (documents with that
    set), n_links (other documents at the threshold or above, copies among them) and class_id."""
    spark = docs.sparkSession
    runs = runs_for(threshold, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nameless = docs.filter("doc_id IS NULL").select("doc_id")
    docs = _one_text_each(docs.filter("doc_id IS NOT NULL"))
    signed = written(docs.mapInArrow(per_batch(_signatures(runs)), "doc_id long, n long, a long, b long, keys array<long>"), "signatures")
    sets = signed.filter("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))  # rows that repeat a doc_id count each
    reps = sets.select("rep", "copies")
    rows = signed.filter("n > 0").join(reps.select("rep"), signed["doc_id"] == F.col("rep")).select("rep", F.explode(F.array_distinct("keys")).alias("key")).distinct()
    found = written(_buckets(rows, limit), "buckets")
    for level in range(LEVELS + 1, DEPTH + 1):
        big = found.filter(F.col("c") > limit)
        if big.isEmpty():
            break
        need = big.groupBy("rep").agg(F.collect_list("bucket").alias("paths"))
        deeper = docs.join(need, docs["doc_id"] == need["rep"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "paths").mapInArrow(per_batch(_refine), "rep long, key long")
        found = written(found.filter(F.col("c") <= limit).unionByName(_buckets(deeper, limit if level < DEPTH else None)), "buckets")
    need = found.groupBy("rep").agg(F.collect_list(F.struct("bucket", "c")).alias("buckets")).join(reps, "rep")
    shipped = docs.join(need, docs["doc_id"] == need["rep"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "copies", "buckets")
    shipped = shipped.mapInArrow(per_batch(_ship()), "group long, bucket long, side int, rep long, copies long, size long, buckets array<long>, tokens binary")
    linked = shipped.repartition(partitions(spark), "group").sortWithinPartitions("group", "bucket").mapInArrow(_compare_all(threshold), "rep long, links long, root long")
    linked = written(linked, "links")
    roots = components(linked.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    known = sets.join(links, "rep", "left").join(roots, F.col("rep") == F.col("u"), "left").select("a", "b", "n", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("root"))
    named = signed.drop("keys").join(known, ["a", "b", "n"], "left").select(
        "doc_id",
        F.coalesce("rep", "doc_id").alias("set_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        F.coalesce("root", "doc_id").alias("class_id"),
    )
    return named.unionByName(nameless.select("doc_id", F.lit(None).cast("long").alias("set_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("class_id")))
