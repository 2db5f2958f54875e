"""Language ID, toxicity, media archives, URL filters, chat formatting, and the registered queries."""

from __future__ import annotations

import fnmatch
import hashlib
import itertools
import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vantaq.llm import chat, langid, media, toxicity, urlfilter
from vantaq.llm import textscan as ts

DATA = "/root/testdata/sf0.001"


def test_language_id(spark):
    rnd = random.Random(0)
    vocab = {"de": ["der", "und", "schule", "licht", "über"], "en": ["the", "and", "school", "light", "over"], "fr": ["le", "et", "école", "lumière", "sur"]}
    rows = [(i, " ".join(rnd.choice(vocab[lang]) for _ in range(rnd.randint(1, 40))), lang) for i, lang in enumerate(rnd.choice(list(vocab)) for _ in range(300))]
    df = spark.createDataFrame(rows + [(900, None, "de"), (901, "", "en"), (902, "123 !!", "en"), (903, "schulen", None), (904, "écoles", None), (905, "SCHOOL " * 5000, None)], "doc_id long, text string, score string")
    df = df.withColumnRenamed("score", "lang").withColumn("score", F.lit("x"))
    fitted = langid.fit(df, F.col("doc_id") < 200)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, fitted).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows)
    assert [got[i] for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert [got[i][0] for i in (903, 904, 905)] == ["de", "fr", "en"] and all(0 <= s <= 1 for _, s in got.values())
    none = langid.fit(df, F.lit(False))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}


def test_every_word_of_the_sample_is_learned(spark):
    rows = [(i, f"{lang}w{chr(97 + i % 26)}{chr(97 + i // 26)} once", lang) for i, lang in enumerate(["aa"] * 600 + ["bb"] * 6)] + [(None, "unseen", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit(df, F.lit(True))
    assert m.langs == ["aa", "bb"] and len(m.word_keys) == 607
    small = langid.fit(df, F.lit(True), sample=12)  # in equal parts: the rare language keeps all its rows
    assert 6 < len(small.word_keys) < 40 and langid.predict(df, small).filter("lang = 'bb' AND lang_pred != 'bb'").count() == 0
    assert langid.predict(df.limit(0), langid.fit(df.limit(0), F.lit(True))).count() == 0


def test_scores_are_what_the_definition_says():
    rnd = random.Random(1)
    vocab = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    pairs = sorted({(rnd.choice("xy"), rnd.choice(vocab)): rnd.randint(1, 9) for _ in range(50)}.items())
    m = langid.model([p[0][0] for p in pairs], [p[0][1] for p in pairs], [p[1] for p in pairs])
    words, grams = Counter(), Counter()
    for (lang, w), n in pairs:
        words[w, lang] += n
        marked = f"<{w}>"
        for i, k in itertools.product(range(len(marked)), range(1, langid.LONGEST + 1)):
            if i + k <= len(marked):
                grams[marked[i : i + k], lang] += n**0.5

    def logs(table: Counter) -> dict[str, list[float]]:
        keys = {k for k, _ in table}
        total = {x: sum(v for (_, y), v in table.items() if y == x) for x in "xy"}
        return {k: [math.log((table[k, x] + 0.1) / (total[x] + 0.1 * len(keys))) for x in "xy"] for k in keys}

    by_word, by_gram = logs(words), logs(grams)

    def unseen(w: str) -> list[float]:
        marked, total = f"<{w}>", [0.0, 0.0]
        for i in range(len(marked)):
            known = next((by_gram[marked[i : i + k]] for k in range(langid.LONGEST, 0, -1) if i + k <= len(marked) and marked[i : i + k] in by_gram), [math.log(1e-7)] * 2)
            total = [a + b for a, b in zip(total, known)]
        return [1.5 * t / len(marked) for t in total]

    texts = [" ".join(rnd.choice([*vocab, "zzz", "abca", "éa"]) for _ in range(rnd.randint(1, 30))) for _ in range(80)]
    best, score = langid.Scorer(m).texts(pa.array(texts))
    for text, b, s in zip(texts, best, score):
        each = [by_word.get(w) or unseen(w) for w in text.split()]
        total = [sum(e[k] for e in each) for k in (0, 1)]
        top = int(total[1] > total[0])
        assert b == top or abs(total[0] - total[1]) < 1e-3
        assert abs(s - 1 / sum(math.exp((t - max(total)) / len(each) * min(len(each), 12)) for t in total)) < 1e-3


def test_backoff_takes_the_longest_known_gram():
    m = langid.model(["a", "b"], ["xyz", "xyw"], [5, 5])
    scorer = langid.Scorer(m)
    best, _ = scorer.texts(pa.array(["xyzz", "xyww"]))
    assert [m.langs[k] for k in best] == ["a", "b"]


def test_held_out_accuracy_on_the_tables(spark):
    from vantaq.llm import queries

    sf = "/root/testdata/sf0.01"
    got = queries.op1_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").filter("held_out").select((F.col("lang") == F.col("lang_pred")).alias("ok")).agg(F.avg(F.col("ok").cast("int"))).first()[0]
    assert got > 0.98


def examples(rng: np.random.Generator, n: int, terms: int) -> toxicity.Index:
    held = [np.unique(rng.zipf(1.4, rng.integers(1, 14)) % terms) for _ in range(n)]
    doc = np.repeat(np.arange(n), [len(h) for h in held])
    keys = np.concatenate(held).astype(np.uint64)
    term, df = np.unique(keys, return_counts=True)
    return toxicity.build(np.arange(n) * 3, np.array([int(3 in h) for h in held]), doc, keys, rng.integers(1, 5, len(keys)), term, df, n)


@pytest.mark.parametrize(("n", "terms"), [(1, 40), (31, 40), (65, 40), (256, 40), (700, 40), (900, 4000)])
def test_neighbours_are_exact(n, terms):
    rng = np.random.default_rng(n)
    x = examples(rng, n, terms)
    dense = np.zeros((len(x.term), x.blocks * toxicity.BLOCK))
    for t in range(len(x.term)):
        if x.slot[t] >= 0:
            dense[t] = x.full[x.slot[t]]
        for b in range(x.first[t], x.first[t + 1]):
            at = slice(x.at[b], x.at[b + 1])
            assert x.impact[at].max() == x.ceiling[b] and (x.example[at] // toxicity.BLOCK == x.block[b]).all()
            dense[t, x.example[at]] = x.impact[at]
    assert np.allclose((dense**2).sum(axis=0)[: len(x.doc)], 1)
    for _ in range(60):
        term = np.unique(rng.integers(0, len(x.term), 5))
        w = toxicity.weights(np.zeros(len(term), np.int64), term, np.ones(len(term), np.int64), x.weight, 1)
        sim = np.round(w @ dense[term], 8)[: len(x.doc)]
        want = [i for i in sorted(range(len(x.doc)), key=lambda i: (-sim[i], x.doc[i])) if sim[i] > toxicity.EQUAL][: toxicity.NEIGHBOURS]
        best, score = toxicity.nearest(x, term, w, toxicity.common(x, np.zeros(len(term), np.int64), term, w, 1)[0])
        assert x.doc[best].tolist() == x.doc[want].tolist() and np.allclose(score, sim[want])


def brute_force_toxicity(texts: dict[int, str | None], toxic: dict[int, int], train: set[int]) -> dict[int, tuple[float, list[int]]]:
    """Scores and evidence by the definition, text against text."""

    def words(text: str | None) -> Counter:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text or "")
        return Counter("".join(c if c == "_" or unicodedata.category(c)[0] in "LN" else " " for c in low).split())

    bags = {d: words(t) for d, t in texts.items()}
    examples = [d for d in sorted(texts) if d in train and d in toxic and texts[d] is not None]
    n, t = len(examples), sum(toxic[d] for d in examples)
    seen = Counter(w for d in examples for w in bags[d])
    bad = Counter(w for d in examples if toxic[d] for w in bags[d])
    df = Counter(w for b in bags.values() for w in b)
    part = lambda k, all_, share: k * math.log(k / (all_ * share)) if k else 0.0
    weight = {w: (math.log((1 + len(texts)) / (1 + df[w])) + 1) * (1 + max(part(bad[w], k, t / n) + part(k - bad[w], k, 1 - t / n), 0) / 2) for w, k in seen.items()}

    def vector(bag: Counter) -> dict[str, float]:
        v = {w: (1 + math.log(k)) * weight[w] for w, k in bag.items() if w in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    known = {d: vector(bags[d]) for d in examples}

    def vote(v: dict[str, float], skip: int | None) -> tuple[float, list[int]]:
        near = sorted((-round(sum(x * known[d].get(w, 0.0) for w, x in v.items()), 8), d) for d in examples if d != skip)
        near = [(-s, d) for s, d in near if -s > 1e-8][:7]
        far = [(1 / (1.1 - min(s, 1.0)) ** 2, toxic[d]) for s, d in near]
        return (sum(a * b for a, b in far) / sum(a for a, _ in far) if far else -1.0), [d for _, d in near][:3]

    own = [(vote(known[d], d)[0], toxic[d]) for d in examples if known[d]]
    a, b = toxicity.logistic(np.array([v for v, _ in own if v >= 0]), np.array([y for v, y in own if v >= 0], float))
    none = [toxic[d] for d in examples if not known[d]]
    bare = (sum(none) + t / n) / (len(none) + 1)
    out = {}
    for d, bag in bags.items():
        v, evidence = vote(vector(bag), None)
        out[d] = (bare if v < 0 else 1 / (1 + math.exp(-(a + b * v))), evidence)
    return out


def test_the_toxicity_query_is_what_brute_force_says(spark):
    from vantaq.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    want = brute_force_toxicity(texts, toxic, {d for d in texts if zlib.crc32(str(d).encode()) % 3 != 1})
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, DATA).collect()}
    assert set(got) == set(want) and len({round(r.score, 6) for r in got.values()}) > 10
    for d, (score, evidence) in want.items():
        assert abs(got[d].score - score) < 1e-5 and got[d].evidence == evidence and got[d].predicted == int(got[d].score >= 0.7) and got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1)


def test_the_curve_is_logistic():
    rng = np.random.default_rng(0)
    v = rng.random(4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(4 - 8 * v))).astype(float)
    a, b = toxicity.logistic(v, y)
    assert abs(a + 4) < 0.6 and abs(b - 8) < 1
    assert toxicity.logistic(np.array([0.1, 0.9]), np.array([1.0, 0.0]))[1] == 0


def test_held_out_toxicity(spark):
    from vantaq.llm import queries

    sf = "/root/testdata/sf0.1"
    got = queries.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.85 and n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) > 0.95


def test_toxicity(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(600):
        bad = i % 5 == 0
        w = ["".join(rnd.choice("abcdef") for _ in range(3)) for _ in range(30)] + (rnd.sample(["vile", "scum", "trash"], 2) if bad else [])
        rnd.shuffle(w)
        rows.append((i, " ".join(w), int(bad)))
    more = [(1000, None), (1001, ""), (1002, "vile scum " * 30_000), (1002, "vile scum " * 30_000), (1003, "zzzz")]
    docs = spark.createDataFrame([(i, t, "x", "y", 1.0) for i, t, *_ in rows + more], "doc_id long, text string, label string, toxic string, score double")
    labels = spark.createDataFrame([(i, b, "z") for i, _, b in rows if i % 2 == 0] + [(2, 0, "z"), (4, None, "z"), (None, 1, "z"), (1000, 0, "z"), (1001, 0, "z"), (5000, 1, "z")], "doc_id long, toxic int, text string")
    fitted = toxicity.fit(docs, labels, F.col("doc_id") < 1500)
    got = {r.doc_id: r for r in toxicity.score(docs, fitted).collect()}
    assert sum(got[i].predicted != b for i, _, b in rows) <= 3 and got[1002].predicted == 1
    assert got[1000].score == got[1001].score == got[1003].score < 0.2 and got[0].evidence and not got[1000].evidence
    assert toxicity.score(docs, fitted).count() == len(rows) + len(more)
    assert all(r.score == 0 for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0), F.lit(True))).collect())
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels, F.lit(True))).count() == 0
    assert len(toxicity.fit(docs, labels, F.col("doc_id") < 500, text_bytes=5000).doc) < 100


@given(st.binary(max_size=300))
@settings(max_examples=60, deadline=None)
def test_media_round_trip(data):
    samples = media.pad(data)
    assert len(samples) % 64 == 0 and len(samples) >= 64 and samples.tobytes()[: len(data)] == data
    assert (media.decode(media.encode(samples)) == samples).all()


def test_filtered_images_are_read():
    rng = np.random.default_rng(0)
    want = rng.integers(0, 256, (5, 64)).astype(np.uint8)
    rows = bytearray()
    above = np.zeros(64, np.int64)
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        line = want[y].astype(np.int64)
        left, corner = np.append(0, line[:-1]), np.append(0, above[:-1])
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        rows += bytes([kind]) + ((line - (0, left, above, (left + above) // 2, paeth)[kind]) & 255).astype(np.uint8).tobytes()
        above = line
    png = b"\x89PNG\r\n\x1a\n" + media._chunk(b"IHDR", b"\x00\x00\x00\x40\x00\x00\x00\x05\x08\x00\x00\x00\x00") + media._chunk(b"IDAT", zlib.compress(bytes(rows))) + media._chunk(b"IEND", b"")
    assert (media.decode(png).reshape(5, 64) == want).all()


def test_archives(spark, tmp_path):
    rows = [(i, ("x%d " % i) * (i * 7 % 500)) for i in range(200)] + [(None, "no key"), (7, "again"), (500, None), (501, "é" * 100_000)]
    df = spark.createDataFrame(rows, "key long, text string").select("key", F.col("text").cast("binary").alias("payload")).repartition(3)
    path = f"file://{tmp_path}/archive"
    media.store(df, path)
    back = media.load(spark, path, split=4096)
    assert back.rdd.getNumPartitions() > 5
    got = sorted((r.key is None, r.key or 0, r.carried, media.decode(bytes(r.media)).tobytes()) for r in back.collect())
    want = sorted((k is None, k or 0, len((t or "").encode()), media.pad((t or "").encode()).tobytes()) for k, t in rows)
    assert got == want
    assert media.load(spark, f"file://{tmp_path}/nothing").count() == 0


def test_members_fail_and_recover_alone(spark, tmp_path):
    media.store(spark.createDataFrame([(i, b"abc" * 200) for i in range(20)], "key long, payload binary").coalesce(1), f"file://{tmp_path}/a")
    reader = media.Reader(f"file://{tmp_path}/a", 1 << 30)
    part = reader.partitions()[0]
    file = tmp_path / "a" / part.path
    raw = bytearray(file.read_bytes())
    whole = [r[0] for b in reader.read(part) for r in zip(b.column(0).to_pylist())]
    raw[len(raw) // 2] ^= 255
    file.write_bytes(bytes(raw))
    rows = [r for b in reader.read(part) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert len(rows) == 20 and sum(r[3] is not None for r in rows) == 1
    assert all(r[0] == k or (r[3] is not None and r[0] is None) for r, k in zip(rows, whole))
    body = file.read_bytes().index(raw[4:20], 200) + 16 + media._MEMBER.size + media._CHECK.size + 3  # of some member
    raw[len(raw) // 2] ^= 255
    raw[body] ^= 255
    file.write_bytes(bytes(raw))
    rows = [r for b in reader.read(part) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert [r[0] for r in rows] == whole and [r[2] is None for r in rows] == [r[3] is not None for r in rows] and sum(r[2] is None for r in rows) == 1
    raw[body] ^= 255
    file.write_bytes(bytes(raw))

    class Flaky(media.Reader):
        tries = 0

        def member(self, f, sync, at):
            Flaky.tries += 1
            if Flaky.tries % 2:
                raise OSError("lost")
            return media.Reader.member(f, sync, at)

    flaky = Flaky(f"file://{tmp_path}/a", 1 << 30)
    rows = [r for b in flaky.read(part) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert [r[0] for r in rows] == whole and all(r[3] is None for r in rows)

    class Lost(media.Reader):
        tries = 0

        def find(self, f, sync, start, end):
            Lost.tries += 1
            if Lost.tries % 2:
                raise OSError("lost")
            return media.Reader.find(f, sync, start, end)

    assert [r[0] for b in Lost(f"file://{tmp_path}/a", 1 << 30).read(part) for r in zip(*(c.to_pylist() for c in b.columns))] == whole


GLOBS = st.lists(st.text(alphabet="ab*?", min_size=1, max_size=6).filter(lambda p: p.strip("*")), min_size=1, max_size=30)


@given(GLOBS, st.lists(st.text(alphabet="abc", max_size=12), max_size=12))
@settings(max_examples=150, deadline=None)
def test_globs(patterns, texts):
    machine = urlfilter.Automaton([[urlfilter.LOOP if c == "*" else urlfilter.ANY if c == "?" else ord(c) for c in p] for p in patterns])
    symbols = [np.frombuffer(t.encode(), np.uint8).astype(np.int16) for t in texts]
    want = [[fnmatch.fnmatchcase(t, p) for p in patterns] for t in texts]
    got = machine.run(symbols)
    assert got.tolist() == want and [machine.one(s).tolist() for s in symbols] == want


def test_url_rules(spark):
    urls = [
        (1, "http://NET/x"), (2, "https://a.b.net/y?q#f"), (3, "http://net"), (4, "http://xnet/"), (5, "http://example.net/en/1"), (6, "http://www.example.net/de/1"), (7, "http://example.com/de/"), (8, "http://example.com/de"), (9, "http://x.org/fr/a"),
        (10, None), (11, "no scheme"), (12, ""), (13, "http://spam-farm.org/x"), (14, "http://spam-farm.org/fr/x"), (15, "://net/"), (16, "http://Ä.NET/" + "é" * 5000), (17, "http://a.net?x/"), (1, "http://NET/x"), (18, "http://.net/"),
    ]
    got = sorted((r.page_id, r.host, r.path[:8], r.rule, r.verdict) for r in urlfilter.judged(spark.createDataFrame([(i, u, "z") for i, u in urls], "page_id long, url string, rule string")).collect())
    want = []
    for i, u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.name), default=None)
        want.append((i, host, path[:8], best and best.name, best.verdict if best else "block" if "spam-farm" in host else "allow"))
    assert got == sorted(want)


@given(st.text(alphabet="\\<>/|s[]INSTend i", max_size=60) | st.lists(st.sampled_from([*chat.CONTROL, "\\", "a", "<", "|>"]), max_size=8).map("".join))
@settings(max_examples=300, deadline=None)
def test_escapes(text):
    broken = chat.escape(text)
    assert chat.unescape(broken) == text and not any(c in broken for c in chat.CONTROL)


def test_parts_are_flattened_in_order():
    f = chat.Flattener()
    f.turn("user", [chat.Text("see "), chat.Image("s3://i", 56, 29), chat.Text(" and "), chat.Audio("a.wav", 2.0), chat.Document("d.pdf", 3)])
    f.turn("assistant", [chat.Text("fine <|end|>"), chat.Image("out.png", 28, 28)])
    out = f.done()
    assert [(a.kind, a.uri, a.position, a.tokens) for a in out.attachments] == [("image", "s3://i", 0, 5), ("audio", "a.wav", 1, 25), ("document", "d.pdf", 2, 1536), ("image", "out.png", 3, 2)]
    assert all(out.text[a.char :].startswith(f"<|{a.kind}|>") for a in out.attachments)
    assert [out.text[s:e] for s, e in out.loss] == ["fine <\\|end|><|image|>"]
    one, two, three, four = out.attachments
    assert chat.parse(out.text, out.attachments) == [("user", [chat.Text("see "), one, chat.Text(" and "), two, three]), ("assistant", [chat.Text("fine <|end|>"), four])]


PIECE = st.text(alphabet="\\<>/|s[]INSTend i", max_size=12) | st.sampled_from([*chat.CONTROL, "\\", "<", "<|", "turn|>", "|end|>", "[", "INST]"])
PARTS = st.lists(st.one_of(st.builds(chat.Text, PIECE), st.builds(chat.Image, PIECE, st.integers(0, 99), st.integers(0, 99)), st.builds(chat.Audio, PIECE, st.just(1.5)), st.builds(chat.Document, PIECE, st.integers(0, 3))), max_size=6)


@given(st.lists(st.tuples(PIECE, PARTS), max_size=4))
@settings(max_examples=300, deadline=None)
def test_parts_come_back(turns):
    f = chat.Flattener()
    for role, parts in turns:
        f.turn(role, parts)
    out = f.done()
    kinds = {chat.Image: "image", chat.Audio: "audio", chat.Document: "document"}
    plain = lambda p: p.text if isinstance(p, chat.Text) else (p.kind if isinstance(p, chat.Attachment) else kinds[type(p)], p.uri)
    got = chat.parse(out.text, out.attachments)
    assert [(r, [plain(p) for p in parts]) for r, parts in got] == [(r, [plain(p) for p in parts if not isinstance(p, chat.Text) or p.text]) for r, parts in turns]
    # No control string but the template's own, in their places
    own = len(turns) * 3 + len(out.attachments) + sum(max(0, sum(1 for a, b in zip(k, k[1:]) if a == b == chat.Text)) for k in ([type(p) for p in parts if not isinstance(p, chat.Text) or p.text] for _, parts in turns))
    assert sum(out.text.count(c) for c in chat.CONTROL) == own


def test_typed_content_column(spark):
    text = lambda t: {"kind": "text", "text": t}
    rows = [
        (1, 0, "user", "unused", [text("<|"), text("turn|>"), {"kind": "image", "uri": "i.png", "width": 56, "height": 28}, text("<|image|>")]),
        (1, 1, "assistant", None, [{"kind": "audio", "uri": "a.wav", "seconds": 2.0}, text("done"), {"kind": "document", "uri": None, "pages": 2}, {"kind": "video", "text": "odd"}, None]),
        (1, 2, "user", "plain", None),
        (2, 0, "user", "no parts", []),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, content {chat.CONTENT}").withColumn("formatted", F.lit("x"))
    got = {r.conv_id: r for r in chat.conversations(df).collect()}
    assert got[1].formatted == "<|turn|>user<|body|><|<|part|>turn|><|image|><\\|image|><|end|><|turn|>assistant<|body|><|audio|>done<|document|>odd<|end|><|turn|>user<|body|>plain<|end|>"
    assert [(a.kind, a.uri, a.position, a.tokens) for a in got[1].attachments] == [("image", "i.png", 0, 3), ("audio", "a.wav", 1, 25), ("document", "", 2, 1024)] and got[1].attachment_tokens == 1052
    assert all(got[1].formatted[a.char :].startswith(f"<|{a.kind}|>") for a in got[1].attachments) and got[2].formatted.endswith("<|body|><|end|>") and got[2].attachments == []
    d = {r.conv_id: r for r in chat.digests(chat.conversations(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert d[1].turns_sha256 == sha("user\n<|turn|><|image|>\nassistant\ndoneodd\nuser\nplain\n") and d[1].loss_sha256 == sha("doneodd")
    assert chat.digests(chat.conversations(df.limit(0))).count() == 0


def test_conversations(spark):
    rows = [(1, 0, "user", "hi\\"), (1, 1, "assistant", "</s>[INST] ok"), (1, 1, "assistant", None), (2, None, None, "é🙂"), (None, 0, "user", ""), (3, 5, "assistant", "y" * 100_000), (3, 2, "assistant", "first")]
    got = {r.conv_id: r for r in chat.digests(chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\nhi\\\nassistant\n\nassistant\n</s>[INST] ok\n") and got[1].loss_sha256 == sha("</s>[INST] ok") and got[1].n_turns == 3
    assert got[3].loss_sha256 == sha("first" + "y" * 100_000) and got[2].loss_chars == 0 and got[None].n_turns == 1


def test_queries_and_sql_are_named_alike():
    from vantaq.llm import queries

    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.queries()}
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", ["op2_media_columns", "op4_url_filters", "op7_chat_formatting"])
def test_small_queries_run(spark, name):
    from vantaq.llm import queries

    assert queries.queries()[name](spark, DATA).count() > 0


def test_media_query_is_what_the_text_says(spark):
    from vantaq.llm import queries

    got = {r.doc_id: r for r in queries.op2_media_columns(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        raw = (r.text or "").encode()
        payload = media.pad(raw).tobytes()
        g = got[r.doc_id]
        assert (g.media_bytes, g.media_sha256, g.feature) == (len(stored := media.encode(media.pad(raw))), hashlib.sha256(stored).hexdigest(), media.feature(media.pad(raw)))
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) and g.error is None


def test_url_filters_ignore_other_columns(spark):
    from vantaq.llm import urlfilter

    rows = spark.createDataFrame([(1, "http://a.net/x", "r", 1), (2, None, "r", 2), (2, "x", "r", 2)], "page_id long, url string, rule string, host int")
    got = urlfilter.judged(rows)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(str, got.collect())) == sorted(map(str, urlfilter.judged(rows.select("page_id", "url")).collect())) and got.count() == 3
