"""Piece models, token alignment and source divergences against the libraries and plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vantaq.llm import align, bpe, divergence, pieces, queries
from vantaq.llm import textscan as ts
from vantaq.llm.base import written

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EDGES = [
    None, "", " ", "  ", "a", "▁a ▁▁ b", " " * 50, "   hello" + " " * 37 + "the", "<s>x</s> <unk> <0x0A>", "日本語 テキスト", "🙂\U0010ffff x", "\x00\n\n\t a",
    "a" * 500, "é" * 100, "thethethe" * 30, "<|endoftext|> x", "word " * 3000,
]


def texts(n: int, seed: int) -> list[str | None]:
    rnd = random.Random(seed)
    parts = ["the ", "tion", "é", "\n", "  ", "'s", "ß", "%%%", "12", "_x", "Word", ", ", "日", "\t", "🙂", " ing", "==", "ae"]
    return EDGES + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def encoded(values: list[str | None]) -> tuple[list[list[int]], list[str]]:
    ids, decoded = [], []
    for seq, first in pieces._sequences(pa.array(values, pa.string()), B):
        flat, off = pieces.model(B).decoded(seq, first)
        ids += [seq[i:j].tolist() for i, j in zip(first[:-1], first[1:])]
        decoded += [flat[i:j].tobytes().decode() for i, j in zip(off[:-1], off[1:])]
    return ids, decoded


def test_pieces_are_the_librarys():
    library, rnd = sentencepiece.SentencePieceProcessor(model_file=B), random.Random(1)
    names = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    some = texts(1500, 2) + ["".join(rnd.choice(names) for _ in range(rnd.randint(0, 20))) for _ in range(3000)]
    ids, decoded = encoded(some)
    want = [library.encode(t or "", add_bos=True, add_eos=True) for t in some]
    assert ids == want
    assert decoded == [library.decode(x) for x in want]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text_is_encoded_as_by_the_library(text):
    library = sentencepiece.SentencePieceProcessor(model_file=B)
    ids, decoded = encoded([text])
    assert ids[0] == library.encode(text, add_bos=True, add_eos=True) and decoded[0] == library.decode(ids[0])


def test_compatible_is_merging_anew():
    machine, rnd = pieces.model(B), random.Random(4)
    library = machine.library
    names = {library.id_to_piece(i): i for i in range(259, machine.n)}
    spaces = [i for p, i in names.items() if set(p) == {"▁"}]
    pick = [(rnd.choice(spaces), rnd.choice(spaces)) for _ in range(100)] + [(rnd.randrange(259, machine.n), rnd.randrange(259, machine.n)) for _ in range(300)]
    pick += [(names[p[:k]], names[p[k:]]) for p in rnd.sample(list(names), 400) for k in range(1, len(p)) if p[:k] in names and p[k:] in names]

    def merged(text: str) -> list[int]:
        parts = list(text)
        while True:
            found = [(-library.get_score(names[a + b]), k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in names]
            if not found:
                return [names[p] for p in parts]
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    left, right = np.array(pick).T
    got = machine.remerged(left, right)
    want = [merged(library.id_to_piece(a) + library.id_to_piece(b)) == [a, b] for a, b in pick]
    assert got.tolist() == want and True in want and False in want


def test_any_ids_are_decoded_as_by_the_library(spark):
    library, rnd = sentencepiece.SentencePieceProcessor(model_file=B), random.Random(5)
    some = [[rnd.choice([0, 1, 2, 3 + 0xE2, 3 + 0x96, 3 + 0x81, 3 + rnd.randint(0, 255), rnd.randint(259, 31999), 259]) for _ in range(rnd.randint(0, 8))] for _ in range(800)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(some)] + [(-1, None)], "doc_id long, ids array<int>")
    got = dict(map(tuple, pieces.decode(rows, B).collect()))
    assert got == {i: library.decode(x) for i, x in enumerate(some)} | {-1: ""}


def test_encode_and_round_trip_keep_rows(spark):
    rows = spark.createDataFrame([(i % 7 if i % 5 else None, t, "x") for i, t in enumerate(texts(40, 6))], "doc_id long, text string, ids string")
    library = sentencepiece.SentencePieceProcessor(model_file=B)
    want = Counter((d, tuple(library.encode(t or "", add_bos=True, add_eos=True))) for d, t, _ in rows.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in pieces.encode(rows, B).collect()) == want
    got = pieces.round_trip(rows, B).collect()
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert all(r.decoded == library.decode(np.frombuffer(r.ids, "<u4").tolist()) and r.n_tokens * 4 == len(r.ids) for r in got)
    assert pieces.round_trip(rows.limit(0), B).count() == 0 and pieces.encode(rows.limit(0), B).count() == 0


def test_other_models_are_refused(tmp_path):
    wrong = tmp_path / "x.json"
    wrong.write_text('{"normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "ByteLevel"}, "model": {"vocab": {}}}')
    with pytest.raises(ValueError):
        align.ByteLevel(str(wrong))


# Alignment


def aligned_by_hand(rows):
    left, right = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    left.encode_special_tokens = True
    letters = bpe.byte_letters()
    out, links, docs = [], [], Counter()
    for d, t in rows:
        want = (" " + (t or "")).encode()
        got = left.encode(" " + (t or ""), add_special_tokens=False)
        sides = [[(i, bytes(letters[c] for c in x)) for i, x in zip(got.ids, got.tokens)], []]
        for i in right.encode(t or ""):
            p = right.id_to_piece(i)
            sides[1].append((i, bytes([int(p[1:-1], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode()))
        if not t or any(b"".join(x for _, x in s) != want for s in sides):
            out.append([d, 0, 0, 0, 0, ""])
            links.append([])
            continue
        ranges = []
        for side in sides:
            at, r = 0, []
            for i, x in side:
                r.append((i, at, at + len(x)))
                at += len(x)
            ranges.append(r)
        cuts = sorted({e for _, _, e in ranges[0]} & {e for _, _, e in ranges[1]})
        groups, at = [], [0, 0]
        for hi in cuts:
            found = [[], []]
            for k, r in enumerate(ranges):
                while at[k] < len(r) and r[at[k]][2] <= hi:
                    found[k].append(str(r[at[k]][0]))
                    at[k] += 1
            groups.append("|".join(map(",".join, found)))
        covers = [[i for i, s, e in r for _ in range(s, e)] for r in ranges]  # the token of each byte
        starts = {s for r in ranges for _, s, _ in r}
        link = [(covers[0][k], covers[1][k]) for k in sorted(starts)]  # each overlap begins where a token does
        out.append([d, len(ranges[0]), len(ranges[1]), len(groups), len(link), hashlib.sha256(";".join(groups).encode()).hexdigest()])
        links.append(link)
        docs.update(set(link))
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    return sorted((tuple([*o, sum(docs[p] == most[p[0]] for p in l), sum(docs[p] for p in l)]) for o, l in zip(out, links)), key=str)


def test_bits_rank_and_select():
    places = np.unique(np.random.default_rng(0).integers(0, 1000, 300))
    bits = align.Bits.of(places, 1000)
    assert (bits.select() == places).all()
    assert bits.rank(np.arange(1000)).tolist() == [int((places <= i).sum()) for i in range(1000)]
    assert bits.has(np.arange(1000)).tolist() == np.isin(np.arange(1000), places).tolist()


@pytest.mark.parametrize("limit", [10**6, 60, 0])
def test_alignment_is_the_definition(spark, limit):
    rows = [(i % 50 if i % 7 else None, t) for i, t in enumerate(texts(120, 7))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, pairs string")
    got = align.with_counts(written(align.align(docs, A, B), "aligned"), limit)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    got = got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "n_best", "count_sum")
    assert sorted(map(tuple, got.collect()), key=str) == aligned_by_hand(rows)


def test_alignment_query_and_nothing(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_token_alignment(spark, path).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    assert sorted(map(tuple, got.collect()), key=str) == aligned_by_hand(rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align.with_counts(written(align.align(empty, A, B), "aligned")).count() == 0


# Divergences


def test_hashes_are_xxhash_and_groups_are_exact(monkeypatch):
    rnd = random.Random(8)
    words = [bytes(rnd.randrange(256) for _ in range(rnd.randint(1, 70) if i % 3 else rnd.randint(1, 4))) for i in range(2000)] * 2
    off = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    buf = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
    assert divergence.hashes(buf, off[:-1], off[1:]).tolist() == [xxhash.xxh64_intdigest(w) for w in words]

    def check():
        group, first = divergence.grouped(buf, off[:-1], off[1:])
        assert len({(g, w) for g, w in zip(group.tolist(), words)}) == len(set(words)) == len(set(group.tolist()))
        assert all(words[first[g]] == w for g, w in zip(group.tolist(), words))

    check()
    monkeypatch.setattr(divergence, "hashes", lambda buf, start, end: (end - start).astype(np.uint64) // np.uint64(3))
    check()


def audited_by_hand(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs, count = Counter(), defaultdict(Counter)
        for (_, l, s), words in zip(rows, terms):
            if l == lang:
                docs.update(set(words))
                count[s].update(words)
        kept = [t for t in docs if docs[t] >= least]
        whole = Counter({t: sum(c[t] for c in count.values()) for t in kept})

        def share(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + floor(Fraction(10**9 * (c[t] + 1), total)) for t in kept}

        q, p = share(whole), {s: share(c) for s, c in count.items()}
        for s in count:
            f = lambda a, b: floor(Fraction((a - b) ** 2, b))
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in count if o != s]
            mine = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(mine)[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("share,flush", [(250_000, 8 << 20), (5, 200)])
def test_audit_is_the_definition(spark, monkeypatch, share, flush):
    monkeypatch.setattr(divergence, "SHARE_ENTRIES", share)
    rnd = random.Random(9)
    words = ["The", "the", "é", "Éa", "日本", "x", "y_z", "a" * 60, "12", "don't", "🙂"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(None if i % 11 == 0 else " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))), rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", None, "é", "z"])) for i in range(120)]
    rows += [("lonely", "fr", "s1"), (None, "it", "s1"), ("", "it", "s2"), ("one", "pt", "s1"), ("two", "pt", "s3")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, term int")
    got = sorted(tuple(r) for r in divergence.audit(docs, top=15).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == audited_by_hand(rows, 3, 15)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_long_division_stays_exact():
    count, total = np.array([0, 5, 10**15 - 1, 3 * 10**15]), 4 * 10**15
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * (c + 1) // total for c in count.tolist()]
