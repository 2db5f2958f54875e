"""Suffix dedup, Jaccard join, decontamination and the pipeline against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vantaq.llm import decontam, jaccard, suffixdedup
from vantaq.llm import textscan as ts

WIDTH = 50


def repeated(docs: list[tuple[int | None, str | None]], width: int = WIDTH) -> list[np.ndarray]:
    least: dict[bytes, int] = {}
    for d, t in docs:
        t = (t or "").encode()
        if d is not None:
            for i in range(len(t) - width + 1):
                least[t[i : i + width]] = min(d, least.get(t[i : i + width], d))
    out = []
    for d, t in docs:
        t = (t or "").encode()
        gone = np.zeros(len(t), bool)
        if d is not None:
            for i in range(len(t) - width + 1):
                if least[t[i : i + width]] < d:
                    gone[i : i + width] = True
        out.append(gone)
    return out


def patchwork(seed: int, n: int = 50, alphabet: str = "abc\x00é") -> list[str]:
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 300))) for _ in range(6)]
    out = []
    for _ in range(n):
        x = ""
        for _ in range(rnd.randint(0, 4)):
            b = rnd.choice(base)
            i = rnd.randint(0, len(b))
            x += b[i : i + rnd.randint(0, 200)]
            if rnd.random() < 0.3:
                x += "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60)))
            if rnd.random() < 0.2:
                x += "a" * rnd.randint(40, 130)
        out.append(x)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_least_owner_is_brute_force(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 99, 700).astype(np.uint8)
    text[300:450] = text[100:250]
    start = np.sort(rng.choice(len(text) - WIDTH, 400, replace=False))
    owner = rng.integers(0, 50, 400)
    seen: dict[bytes, int] = {}
    for s, o in zip(start, owner):
        k = text[s : s + WIDTH].tobytes()
        seen[k] = min(o, seen.get(k, o))
    want = [seen[text[s : s + WIDTH].tobytes()] for s in start]
    assert suffixdedup.least_owner(text, start, owner, WIDTH).tolist() == want


def by_hand(docs: list[tuple[int, str | None]], hot: np.ndarray) -> dict[int, np.ndarray]:
    """The removed bytes of documents that are a flush each and meet in one bucket."""
    codec, flushes, blobs, places = suffixdedup.Codec(b"sample text"), [], [], {}
    for k, (d, t) in enumerate(docs):
        block = next(ts.blocks(pa.array([t or ""])))
        _, at, count, seed = suffixdedup.stretches(block, WIDTH, hot)
        if len(at):
            seed = (seed & np.uint64(0x7FFFFFFF)).astype(np.int64)
            size = count + WIDTH - 1
            order, fresh = suffixdedup._merged(block.buf, at, size, seed, ts.Rolling(ts._char_codes()[block.buf]).of(at, at + size))
            one = order[fresh]
            places[k] = [np.diff(np.append(np.flatnonzero(fresh), len(at))), np.full(len(at), d), at[order]]
            flushes.append(k)
            blobs.append(codec.pack([np.array([0]), np.diff(seed[one], prepend=0), size[one], np.full(len(one), d), np.zeros(len(one), np.int64)], suffixdedup.gather(block.buf, at[one], size[one])))
    gone = {k: np.zeros(len((t or "").encode()), bool) for k, (_, t) in enumerate(docs)}
    for k, blob in suffixdedup.settle(flushes, blobs, WIDTH, codec):
        for _, i, j in zip(*suffixdedup.removed(places[k], [codec.unpack(blob)[0]], WIDTH)):
            gone[k][i:j] = True
    return gone


@pytest.mark.parametrize("rows", [64, 1 << 19])
@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("hashes", [True, False])
def test_settling(monkeypatch, rows, hot, hashes):
    docs = [(i * 3 % 61, t) for i, t in enumerate(patchwork(7))] + [(200 + i, f"{i * 7919} " + "one common line that stands in every one of these documents, word for word" + f" {i * 104729}") for i in range(40)]
    seeds = np.unique(np.concatenate([suffixdedup.stretches(b, WIDTH)[3] for b in ts.blocks(pa.array([t for _, t in docs]))]))
    monkeypatch.setattr(suffixdedup, "SORT_ROWS", rows)
    if not hashes:  # what is equal is told by bytes: all strings of a seed under one hash change nothing
        monkeypatch.setattr(ts.Rolling, "of", lambda self, start, end: np.ones(len(start), np.uint64))
    got = by_hand(docs, seeds if hot else seeds[:0])
    assert all((got[k] == gone).all() for k, gone in enumerate(repeated(docs)))


@given(st.lists(st.lists(st.integers(-(2**40), 2**40), max_size=20), max_size=4), st.binary(max_size=50))
@settings(max_examples=60, deadline=None)
def test_codec(columns, text):
    codec = suffixdedup.Codec(b"")
    back, rest = codec.unpack(codec.pack([np.array(c, np.int64) for c in columns], np.frombuffer(text, np.uint8)))
    assert [b.tolist() for b in back] == columns and rest.tobytes() == text


@pytest.mark.parametrize("hot", [50_000, 3])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    monkeypatch.setattr(suffixdedup, "SAMPLED", 1)
    docs = [(i * 3 % 61, t) for i, t in enumerate(patchwork(7))] + [(100, None), (101, ""), (102, "x" * 49), (103, "x" * 20_000), (104, "x" * 50), (None, "y" * 120), (105, "y" * 120), (106, "y" * 120), (106, "y" * 120)]
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in docs], "doc_id long, text string, n_bytes int, listed string").withColumn("_spans", F.lit(1)).withColumn("_doc", F.lit(2))
    if hot == 3:
        assert len(suffixdedup._hot_seeds(df, WIDTH, hot))
    out = suffixdedup.cut(df).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed, r.n_spans, bytes(r.kept)) for r in out)
    want = []
    for (d, t), gone in zip(docs, repeated(docs)):
        t = (t or "").encode()
        want.append((d is None, d or 0, int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    assert got == sorted(want) and {(r.listed, r._spans, r._doc) for r in out} == {("z", 1, 2)}
    assert suffixdedup.cut(df.limit(0)).count() == 0


def shingle_set(t: str | None, size: int = 5) -> frozenset:
    w = re.findall(r"\w+", (t or "").lower())
    return frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])


def near(docs: list[tuple[int, str | None]], threshold: float = 0.8) -> dict[int, tuple[int, int]]:
    sets = [(d, shingle_set(t)) for d, t in docs]
    links, root = {d: 0 for d, _ in docs}, {d: d for d, _ in docs}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and len(a & b) / len(a | b) >= threshold - 1e-12:
                links[d] += 1
                links[e] += 1
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return {d: (links[d], find(d)) for d, _ in docs}


def edited(seed: int) -> list[tuple[int, str | None]]:
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    out: list[tuple[int, str | None]] = []
    shared = [word() for _ in range(30)]
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(60, 200))] + (shared if rnd.random() < 0.5 else [])
        for _ in range(rnd.randint(1, 12)):
            w = list(base)
            for _ in range(rnd.randint(0, 5)):
                w[rnd.randrange(len(w))] = word()
            out.append((len(out), " ".join(w)))
    out += [(1000, None), (1001, ""), (1002, "one two"), (1003, "One, two!"), (1004, "..."), (1005, "one two three four five")]
    return out


@pytest.mark.parametrize("limit,part", [(2048, 256), (4, 3)])
def test_jaccard_join(spark, monkeypatch, limit, part):
    monkeypatch.setattr(jaccard, "PART", part)
    docs = edited(3)
    got = {r.doc_id: (r.n_links, r.class_id) for r in jaccard.join(spark.createDataFrame(docs, "doc_id long, text string"), limit=limit, recall=0.9999).collect()}
    assert got == near(docs)


def test_a_large_bucket_is_split_along_every_run(spark):
    """Families of 16 texts of a template with four two-valued slots: the farthest pairs are at exactly 0.8 and share only buckets that
    hold the whole family, in most of the 14 runs."""
    docs: list[tuple[int, str | None]] = []
    for family in range(8):
        for values in range(16):
            w = [f"f{family}w{k}" for k in range(184)]
            for slot, at in enumerate((20, 60, 100, 140)):
                w[at] += "ab"[values >> slot & 1]
            docs.append((len(docs), " ".join(w)))
    got = {r.doc_id: (r.n_links, r.class_id) for r in jaccard.join(spark.createDataFrame(docs, "doc_id long, text string"), limit=8).collect()}
    assert got == near(docs) == {d: (15, d // 16 * 16) for d, _ in docs}


def test_repeated_and_nameless_rows(spark):
    long_text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, "b " + long_text, 1), (1, "a " + long_text, 2), (2, "a " + long_text, 3), (None, "a " + long_text, 4), (None, None, 5), (3, "other words entirely", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keys int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.set_id, r.n_copies, r.n_links, r.class_id) for r in jaccard.join(df).collect())
    assert got == [(False, 1, 1, 3, 2, 1), (False, 1, 1, 3, 2, 1), (False, 2, 1, 3, 2, 1), (False, 3, 3, 1, 0, 3), (True, 0, None, 1, 0, None), (True, 0, None, 1, 0, None)]


def test_recall_at_the_registered_parameters(spark):
    """Near pairs of the documents table found by the query, with its own parameters, against all pairs."""
    from vantaq.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = near(docs)
    got = {r.doc_id: (r.n_links, r.class_id) for r in queries.op6_jaccard_join(spark, sf).collect()}
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values()) > 0 and set(got) == set(want)


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 3)
    edges = [(0, i) for i in range(1, 40)] + [(40 + i, i) for i in range(1, 40)] + [(500, 501)]
    got = {r.u: r.root for r in jaccard.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 80) if i != 40}, 501: 500}


def test_jaccard_join_of_nothing(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_compare_counts_each_pair_once():
    s = np.arange(20, dtype=np.uint64).tobytes()
    rows = [(2, i, 1, 20, [5, 9], s) for i in range(3)]
    assert jaccard.compare(5, rows, 0.8) == [(0, 2, 0), (1, 2, 0), (2, 2, 0)]
    assert jaccard.compare(9, rows, 0.8) == [(0, 0, 0), (1, 0, 0), (2, 0, 0)]


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101)]
    got = {r.u: r.root for r in jaccard.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


ITEMS = [(1, "What is the name of the tallest tower in the northern city? It is the Grey Lantern tower."), (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (3, "tiny item"), (4, None), (5, "")]


def test_decontamination(spark):
    rnd = random.Random(1)
    noise = lambda n: " ".join("".join(rnd.choice("qwrtz") for _ in range(5)) for _ in range(n))
    docs = [
        (0, noise(300)), (1, noise(70) + " " + ITEMS[0][1].upper() + " " + noise(90)), (2, ITEMS[1][1] + "."), (3, "alpha beta gamma delta " + noise(30)), (4, None), (5, ""), (6, noise(5) + " a tiny, item here"), (7, "item tiny"),
        (8, "What is the name of the tallest tower in the northern city? " + noise(40)), (9, ITEMS[0][1] + " " + ITEMS[1][1]), (9, ITEMS[1][1]),
    ]
    df = spark.createDataFrame([(d, t, 2) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontam.matches(df, bench).collect())
    assert got == [(1, 1), (2, 2), (6, 3), (9, 1), (9, 2), (9, 2)]
    assert sorted(r.doc_id for r in decontam.clean(df, bench).collect()) == [0, 3, 4, 5, 7, 8]
    assert decontam.matches(df, bench.limit(0)).count() == 0


def test_block_bounds_lose_nothing():
    rnd = random.Random(5)
    words = ["w%d" % i for i in range(60)]
    items = [" ".join(rnd.choice(words) for _ in range(rnd.randint(6, 20))) for _ in range(150)]
    index = decontam.build(list(range(150)), items)
    searcher = decontam.Searcher(index, 0.5, 0.6)
    texts = [" ".join(rnd.choice(words) for _ in range(30)) + " " + rnd.choice(items) + " " + " ".join(rnd.choice(words) for _ in range(25)) for _ in range(40)]
    found = {(b.first + d, i) for b in ts.blocks(pa.array(texts)) for d, i, *_ in searcher.block(b)}
    for k, t in enumerate(texts):
        for i, item in enumerate(items):
            if item in t:
                assert (k, i) in found


def bm25_by_hand(items: list[list[str]], query: set[str], only: int | None = None, df: dict[str, int] | None = None) -> list[float]:
    """Each item's score for a query (or that of one item alone), its own text's score being 1."""
    n, mean = len(items), sum(map(len, items)) / len(items)
    df = df or {w: sum(w in i for i in items) for w in {w for i in items for w in i}}
    part = lambda w, i: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * i.count(w) * 2.2 / (i.count(w) + 1.2 * (0.25 + 0.75 * len(i) / mean))
    return [sum(part(w, i) for w in set(i) & query) / sum(part(w, i) for w in set(i)) if i else 0.0 for i in (items if only is None else [items[only]])]


def test_retrieved_items_are_those_of_brute_force():
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(80)]
    items = [[rnd.choice(words[: rnd.choice((10, 80))]) for _ in range(rnd.randint(0, 25))] for _ in range(120)]
    index = decontam.build(list(range(120)), [" ".join(i) for i in items])
    hashes = dict(zip(words, (lambda b: (lambda w: w[3].of(w[0], w[1]))(ts.words(b)))(next(ts.blocks(pa.array([" ".join(words)]))))))
    for threshold in (0.2, 0.5, 0.9):
        searcher = decontam.Searcher(index, threshold, 0.6)
        for _ in range(40):
            query = set(rnd.sample(words, rnd.randint(1, 30))) | set(rnd.choice(items))
            terms = np.array(sorted(t for t in searcher.terms.find(np.array([hashes[w] for w in query], np.uint64)).tolist() if t >= 0), np.int64)
            if not len(terms):
                continue
            want = {i: s for i, s in enumerate(bm25_by_hand(items, query)) if s >= threshold}
            hits, score = searcher.retrieved(terms)
            assert {i for i, s in want.items() if s > threshold + 1e-5} <= set(hits.tolist()) <= {i for i, s in enumerate(bm25_by_hand(items, query)) if s > threshold - 1e-5}
            assert all(abs(want.get(i, threshold) - s) < 1e-4 for i, s in zip(hits.tolist(), score.tolist()))
            # No posting list beyond the sums of largest impacts
            assert index.top[terms].sum() >= max(score, default=0) - 1e-4


def test_question_and_answer_must_stand_together(spark):
    """A long item makes passages long; a short item's halves far apart in one are no match."""
    rnd = random.Random(3)
    noise = lambda n: " ".join("".join(rnd.choice("qwrtz") for _ in range(5)) for _ in range(n))
    bench = spark.createDataFrame([*ITEMS[:2], (9, " ".join(f"long{k}" for k in range(400)))], "item_id long, text string")
    question, answer = ITEMS[0][1].split("? ")
    df = spark.createDataFrame([(1, question + " " + noise(150) + " " + answer), (2, noise(50) + ITEMS[0][1] + noise(100)), (3, " ".join(f"long{k}" for k in range(400)))], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.matches(df, bench).collect()) == [(2, 1), (3, 9)]


def matched_by_hand(items: list[str], text: str, threshold: float, overlap: float) -> dict[int, tuple[float, float, float]]:
    """The verified items of a text: its best passage's score and overlaps, with all statistics over all items."""
    words = [i.lower().split() for i in items]
    text_words, found = text.lower().split(), {}
    df = Counter(w for i in words for w in set(i))
    for i, item in enumerate(words):
        if not item:
            continue
        stride = 1 << (len(item) - 1).bit_length()
        for k in range(-1, len(text_words) // stride + 1):
            passage = text_words[max(0, k * stride) : (k + 2) * stride]
            score = bm25_by_hand(words, set(passage), i, df)[0]
            if score < threshold:
                continue
            cut = len(item) - max(1, round(0.25 * len(item))) if len(item) >= 6 else 0
            grams = lambda w, n: {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
            best = (0.0, 0.0)
            for lo in range(0, max(1, len(passage) - len(item)), len(item)):
                part = passage[lo : lo + 2 * len(item)]
                if cut:
                    asked, answered = grams(item[:cut], 3), grams(item[max(0, cut - 2) :], 3)
                    got = len(asked & grams(part, 3)) / len(asked), len(answered & grams(part, 3)) / len(answered)
                else:
                    got = (float(bool(grams(item, len(item)) & grams(part, len(item)))),) * 2
                best = max(best, got, key=lambda o: (min(o), max(o), o))
            if min(best) >= overlap:
                found[i] = max(found.get(i, (score, *best)), (score, *best))
    return found


@pytest.mark.parametrize("part_bytes", [64 << 20, 700])
def test_decontamination_is_the_definition_whatever_the_parts(spark, monkeypatch, part_bytes):
    """Items in part and in whole, of many lengths, in noise and side by side; one part and several give the same."""
    rnd = random.Random(11)
    vocabulary = ["w%d" % i for i in range(150)]
    items = [" ".join(rnd.choice(vocabulary[: rnd.choice((30, 150))]) for _ in range(n)) for n in [0, 1, 2, 3, 5, 6, 7, 8, 9, 16, 17, 20, 33] + [rnd.randint(6, 40) for _ in range(30)]]
    texts: list[str | None] = [None, "", "w1"]
    for _ in range(60):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        for item in rnd.sample(items, 2):
            kept = [w if rnd.random() > rnd.choice((0, 0, 0.05, 0.2)) else rnd.choice(vocabulary) for w in item.split()]
            at = rnd.randint(0, len(words))
            words[at:at] = kept[rnd.choice((0, 0, 2)) :]
        texts.append(" ".join(words))
    monkeypatch.setattr(decontam, "PART_BYTES", part_bytes)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(list(decontam.parts(bench))) == (1 if part_bytes > 1000 else 5)
    got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in decontam.matches(df, bench).collect()}
    want = {(d, i): v for d, t in enumerate(texts) for i, v in matched_by_hand(items, t or "", 0.5, 0.6).items()}
    assert set(got) == set(want) and len(want) > 40 and sum(v[1] < 1 for v in want.values()) > 5
    assert all(abs(x - y) < 1e-4 for k in want for x, y in zip(got[k], want[k]))
    assert sorted(r.doc_id for r in decontam.clean(df, bench).collect()) == sorted({d for d in range(len(texts))} - {d for d, _ in want})


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(9)
    de, en = ["der", "und", "nicht", "schule", "haus", "licht", "über"], ["the", "and", "house", "light", "with", "over", "school"]
    word = lambda vocabulary: rnd.choice(vocabulary) if rnd.random() < 0.6 else rnd.choice(vocabulary)[:3] + "".join(rnd.choice("aeioust") for _ in range(4))
    texts = [" ".join(word(de if i % 2 else en) for _ in range(rnd.randint(30, 90))) for i in range(40)]
    texts += [texts[0], texts[1] + " end", "12345 !!!", None, "", " ".join(word(en) for _ in range(30)) + " " + ITEMS[1][1], texts[3][:150] + " " + " ".join(word(de) for _ in range(40))]
    docs = [(i, t, ("de" if i % 2 else "en") if i % 5 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, df, str(tmp_path))
    kept = sorted((r.doc_id, r.text) for r in one.collect())
    assert one.columns == df.columns and [d for d, _ in kept] == [i for i, t in enumerate(texts) if re.search("[a-z]", t or "")]
    two = stages["ngram_jaccard_join"](spark, one, str(tmp_path))
    classes = near(kept)
    left = [(d, t) for d, t in kept if classes[d][1] == d]
    assert sorted((r.doc_id, r.text) for r in two.collect()) == left
    three = stages["suffix_array_dedup"](spark, two, str(tmp_path))
    want = []
    for (d, t), gone in zip(left, repeated(left)):
        rest = bytes(np.frombuffer(t.encode(), np.uint8)[~gone]).decode("utf-8", "ignore")
        if rest.strip() or not gone.any():
            want.append((d, rest, len(rest)))
    assert sorted((r.doc_id, r.text, r.n_chars) for r in three.collect()) == want
    four = stages["benchmark_decontamination"](spark, three, str(tmp_path))
    clean = [(d, t) for d, t, _ in want if ITEMS[1][1] not in t]
    assert sorted((r.doc_id, r.text) for r in four.collect()) == clean and len(clean) < len(want)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in packed}) == [d for d, _ in clean]


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, n_removed int, keys string"


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_at_the_edges(spark, stage):
    """Empty tables, repeated and missing doc_ids, nulls everywhere, a very long text, columns that operators use themselves."""
    import corpus_pipeline

    rnd = random.Random(4)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghilmnorstu") for _ in range(rnd.randint(2, 7))) for _ in range(n))
    whole, long_text = text(60), text(30_000)
    rows = [(1, whole, "en", "s", 5, "x", 1, "y"), (1, "zz " + whole, "en", "s", 5, "x", 1, "y"), (1, whole, "en", "a", 5, "x", 1, "y"), (None, text(20), None, None, None, None, None, None), (2, None, None, None, None, None, None, None), (3, "", "de", "s", 0, None, None, None), (4, long_text, "en", "s", len(long_text), None, None, None), (5, text(40), "en", None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    name, call = corpus_pipeline.STAGES[stage]
    empty = call(spark, df.limit(0), "/root/testdata/sf0.001")
    assert empty.count() == 0
    out = call(spark, df, "/root/testdata/sf0.001")
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    once = [(False, k) for k in (1, 2, 3, 4, 5)] + [(True, 0)]
    if stage < 4:
        assert out.columns == df.columns == empty.columns
    want = {
        "language_id": [(False, 1), (False, 1), (False, 1), (False, 4), (False, 5), (True, 0)],
        "ngram_jaccard_join": once,
        "suffix_array_dedup": sorted((r[0] is None, r[0] or 0) for r in rows),
        "benchmark_decontamination": sorted((r[0] is None, r[0] or 0) for r in rows),
    }
    assert got == want[name] if stage < 4 else sorted(set(got)) == sorted(set((r[0] is None, r[0] or 0) for r in rows))
    if name == "ngram_jaccard_join":
        assert [(r.text, r.source) for r in out.filter("doc_id = 1").collect()] == [(whole, "a") if whole < "zz " + whole else ("zz " + whole, "s")]
