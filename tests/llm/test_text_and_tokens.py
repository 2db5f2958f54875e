"""Scanning, tokenizer automata and packing against plain Python and the library."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import tokenizers

from vantaq.llm import bpe, packing, tokencount
from vantaq.llm import textscan as ts

EDGES = [
    None, "", " ", "\n\n", "a", "don't I'LL we've", "x's't're''ll '", "  two  spaces\tand\n\nlines ", "İstanbul ΣΑΣ ﬁ é", "日本語 テキスト 123 ١٢", "🙂🙃 e\u0301", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>",
    "<|startoftext|>hi", "a" * 300 + " " + "=" * 500, "\x00\x01 nul", "word " * 4000, "Ａ가각 ǅ", "\u00a0nbsp\u2003em", "1234567 12.5%",
]


def texts(n: int, seed: int) -> list[str | None]:
    rnd = random.Random(seed)
    parts = ["the ", "tion", "é", "\n", "  ", "'s", "ß", "%%%", "12", "_x", "Word", ", ", "日", "\t"]
    return EDGES + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 120))) for _ in range(n)]


def test_words_are_python_words():
    column = pa.array(texts(200, 1), pa.string())
    got = []
    for b in ts.blocks(column, 300):
        start, end, first, _, low = ts.words(b)
        got += ["|".join("".join(map(chr, low[s:e])) for s, e in zip(start[i:j], end[i:j])) for i, j in zip(first[:-1], first[1:])]
    simple = [re.sub("[\u0300-\u036f]", " ", t or "") for t in column.to_pylist()]
    want = ["|".join(w.lower() if len(w.lower()) == len(w) else w for w in re.findall(r"\w+", t)) for t in simple]
    keep = [i for i, t in enumerate(simple) if "İ" not in t and "Σ" not in t and "ǅ" not in t and "\U0001f642" not in t]
    assert [got[i] for i in keep] == [want[i] for i in keep]


def test_table_finds_what_it_holds():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(1, 1 << 62, 50_000).astype(np.uint64))
    table = ts.Table(8)
    for part in np.array_split(keys, 7):
        table.add(part, np.searchsorted(keys, part).astype(np.int32))
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_splitter_is_the_pre_tokenizer(name):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(name))
    split = bpe.Splitter(spaced=name.startswith("byte"))
    for t in texts(300, 2):
        t = (t or "") if name.startswith("byte") else (t or "").lower()
        cp = np.array([ord(c) for c in t], np.uint32)
        assert split.starts(cp, np.array([0, len(cp)]), width=8).tolist() == [o[0] for _, o in library.pre_tokenizer.pre_tokenize_str(t)]


def test_token_counts_are_the_library_s():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, column = tokenizers.Tokenizer.from_file(path), pa.array(texts(300, 3), pa.string())
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in column.to_pylist()]
    assert tokencount.Counter(path).texts(column).tolist() == want


def test_small_table_of_pieces_changes_nothing(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    column = pa.array(texts(100, 4), pa.string())
    want = tokencount.Counter(path).texts(column)
    monkeypatch.setattr(tokencount, "KNOWN_PIECES", 10)
    assert (tokencount.Counter(path).texts(column) == want).all()


def test_word_ids_are_the_library_s():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, column = tokenizers.Tokenizer.from_file(path), pa.array(texts(300, 5), pa.string())
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in column.to_pylist()]
    assert [x.tolist() for x in packing.Encoder(path).texts(column)] == want


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(64, rng.geometric(0.05, 3000))
    available = dict(Counter(lengths.tolist()))
    plan = packing.plan(available, 64)
    used: Counter = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 64 and times > 0
        for n in pattern:
            used[n] += times
    assert used == Counter(available)
    assert sum(t for _, t in plan) <= -(-int(lengths.sum()) // 64) * 1.02 + 1


def test_ids_are_the_library_s_for_every_character():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    encoder = packing.Encoder(path)
    every = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    for before, after in (("a", "a"), ("! ", "!"), ("1'", "s")):
        column = pa.array([before + c + after for c in every if encoder.simple[ord(c)]], pa.string())
        want = library.encode_batch(column.to_pylist(), add_special_tokens=False)
        assert [x.tolist() for x in encoder.texts(column)] == [[*w.ids, 0] for w in want]
    assert not encoder.simple[[0x1C89, 0x1C8A, 0xA7CB, 0xA7CC, 0xA7CD, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA, 0xA7DB, 0xA7DC, 0x301, 0x130]].any() and encoder.simple.sum() > 55_000
    column = pa.array([f"x{c} y" for c in "\ua7cb\u1c89\ua7dc"])
    assert [x.tolist() for x in encoder.texts(column)] == [[*library.encode(x.as_py(), add_special_tokens=False).ids, 0] for x in column]


@given(st.lists(st.integers(0, 3), min_size=13, max_size=13), st.lists(st.tuples(st.integers(0, 12), st.lists(st.integers(1, 12), max_size=2), st.booleans()), max_size=30))
@settings(max_examples=200, deadline=None)
def test_sums_are_what_search_finds(counts, asked):
    sums = packing.Sums(np.array([0, *counts[1:]]))

    def first(total: int, k: int, taken: list[int]) -> tuple[int, ...] | None:
        heads = sorted(itertools.product(range(12, 0, -1), repeat=k), reverse=True)
        ordered = lambda x: list(x[-2:]) == sorted(x[-2:], reverse=True)
        return next((x for x in heads if sum(x) == total and ordered(x) and sums.has(*x, *taken)), None)

    for total, taken, use in asked:
        two, three = sums.pair(total, *taken), sums.triple(total, *taken)
        assert two == first(total, 2, taken) and three == first(total, 3, taken)
        if use:
            for n in three or two or ():
                sums.count[n] -= 1


def test_plan_of_nothing():
    assert packing.plan({}, 8) == [] and packing.plan({8: 3}, 8) == [((8,), 3)]


def test_packing_end_to_end(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = [(i, t, "x") for i, t in enumerate(texts(150, 6))] + [(3, "again", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    out = packing.pack(docs, path, 100).collect()
    places: dict[int, list] = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in places.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 100
    want = []
    for i, t, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, 100 * k, len(ids[100 * k : 100 * k + 100]), zlib.crc32(ids[100 * k : 100 * k + 100].tobytes())) for k in range(-(-len(ids) // 100))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=key) == sorted(want, key=key)
    assert packing.pack(docs.limit(0), path).count() == 0


def test_token_counts_end_to_end(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = [(i, t, "x") for i, t in enumerate(texts(60, 3))] + [(None, "no id", "x"), (3, "again", "x"), (900, "=-" * 40_000, "x")]
    out = tokencount.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), path, 20).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 20) for i, t, _ in rows]
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)
    assert tokencount.token_counts(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_special_tokens_with_conditions_are_refused(tmp_path):
    import json

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        known = json.load(f)
    known["added_tokens"][0]["lstrip"] = True
    wrong = tmp_path / "t.json"
    wrong.write_text(json.dumps(known))
    with pytest.raises(ValueError, match="conditions"):
        tokencount.Counter(str(wrong))
