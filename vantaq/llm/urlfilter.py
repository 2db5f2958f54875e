"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one multiword Shift-And automaton: a bit for each literal or ``?`` of each rule; a ``*`` is a
self-loop on the bit before it, or on the rule's start. Reading one symbol advances every rule at once:
shift, mask by the symbol, keep the looping bits. URLs of a batch run in parallel as rows of a matrix of words; very
long ones run singly, on one big integer.

A URL's canonical form is ``.host`` + a mark that no byte can be + ``path``, so a rule for a host and its
subdomains is the glob ``*.host<mark>path*``. The longest matching rule decides; between rules of equal length
allow wins. URLs that no rule matches are judged by glob patterns over the host (block), and are allowed otherwise.

Cases: a null URL, or one without ``://``, has an empty host and path, which no rule with a path matches; very long URLs are
run whole; repeated rows are judged each; of rules that fit the longest decides, of equally long ones the allowing; an empty table gives no
rows; only page_id and url are read, and other columns, whatever their names, are not in the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import per_batch

U64 = np.uint64
MARK, ANY, LOOP = 256, -1, -2
#: URLs longer than this run singly.
LONG = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def symbols(self) -> list[int]:
        return [LOOP, *f".{self.host}".encode(), MARK, *self.path.encode(), LOOP]


#: The contract's rules.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: Hosts that are blocked where no rule speaks.
BLOCKED_HOSTS = ("*spam-farm*", "*casino*")


def host_glob(pattern: str) -> list[int]:
    return [LOOP, ord("."), *(LOOP if c == 42 else ANY if c == 63 else c for c in pattern.encode()), MARK, LOOP]


class Automaton:
    def __init__(self, patterns: list[list[int]]) -> None:
        at, self.first, self.last = 0, [], []
        start = entry = loop = 0
        masks = [0] * 257
        for p in patterns:
            literals = [k for k, x in enumerate(p) if x != LOOP]
            if not literals:
                raise ValueError("a pattern needs something besides *")
            self.first.append(at)
            start |= 1 << at
            if p[0] == LOOP:
                entry |= 1 << at
            for k in literals:
                for c in range(257) if p[k] == ANY else (p[k],):
                    masks[c] |= 1 << at
                if k + 1 < len(p) and p[k + 1] == LOOP:
                    loop |= 1 << at
                at += 1
            self.last.append(at - 1)
        self.words = -(-at // 64)
        self.start, self.entry, self.loop, self.masks = start, entry, loop, masks
        split = lambda x: np.array([(x >> (64 * w)) & ((1 << 64) - 1) for w in range(self.words)], U64)
        self.start_w, self.entry_w, self.loop_w = split(start), split(entry), split(loop)
        self.masks_w = np.array([split(m) for m in masks])
        self.last_word, self.last_bit = np.array(self.last) // 64, (np.array(self.last) % 64).astype(U64)

    def one(self, symbols: np.ndarray) -> np.ndarray:
        d, enter = 0, self.start
        for c in symbols.tolist():
            d = ((((d << 1) & ~self.start) | enter) & self.masks[c]) | (d & self.loop)
            enter = self.entry
        return np.array([(d >> b) & 1 for b in self.last], bool)

    def run(self, texts: list[np.ndarray]) -> np.ndarray:
        """Which patterns match each whole sequence of symbols."""
        out = np.zeros((len(texts), len(self.last)), bool)
        size = np.array([len(t) for t in texts])
        for i in np.flatnonzero(size > LONG):
            out[i] = self.one(texts[i])
        rows = np.flatnonzero(size <= LONG)
        rows = rows[np.argsort(-size[rows], kind="stable")]
        if not len(rows):
            return out
        size = size[rows]
        table = np.zeros((int(size[0]), len(rows)), np.int16)
        for k, i in enumerate(rows.tolist()):
            table[: len(texts[i]), k] = texts[i]
        d = np.zeros((len(rows), self.words), U64)
        inner, one, top = ~self.start_w, U64(1), U64(63)
        live = np.searchsorted(-size, -np.arange(1, len(table) + 1), "right")  # rows longer than t
        for t, n in enumerate(live.tolist()):
            now = d[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= inner
            moved |= self.entry_w if t else self.start_w
            moved &= self.masks_w[table[t, :n]]
            now &= self.loop_w
            now |= moved
        out[rows] = ((d[:, self.last_word] >> self.last_bit) & one).astype(bool)
        return out


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, blocked: tuple[str, ...] = BLOCKED_HOSTS) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of ``pages``."""
    machine = Automaton([r.symbols() for r in rules] + [host_glob(g) for g in blocked])
    names = pa.array([*(r.name for r in rules), None], pa.string())
    # The longest first, allow before block
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k].name), rules[k].verdict != "allow", k))
    blocks = np.array([r.verdict == "block" for r in rules] + [False])
    host, path = parts(F.col("url"))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            h, p = h.encode(), p.encode()
            s = np.empty(len(h) + len(p) + 2, np.int16)
            s[0], s[1 + len(h)] = ord("."), MARK
            s[1 : 1 + len(h)], s[2 + len(h) :] = np.frombuffer(h, np.uint8), np.frombuffer(p, np.uint8)
            texts.append(s)
        hit = machine.run(texts)
        rule = np.full(len(texts), len(rules))
        for k in reversed(order):
            rule[hit[:, k]] = k
        block = np.where(rule < len(rules), blocks[rule], hit[:, len(rules) :].any(axis=1))
        return pa.RecordBatch.from_arrays([*batch.columns, names.take(pa.array(rule)), pa.array(np.where(block, "block", "allow").tolist(), pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    source = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    schema = T.StructType([T.StructField("page_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]])
    return source.mapInArrow(per_batch(judge), schema)


def oracle(rules: tuple[Rule, ...] = RULES, blocked: tuple[str, ...] = BLOCKED_HOSTS) -> str:
    """The same as DuckDB SQL, for patterns that only have * at their ends."""
    order = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "allow"))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in order)
    verdict = " ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in order)
    other = " OR ".join(f"contains(host, '{b.strip('*')}')" for b in blocked)
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT *, CASE {rule} END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE {verdict} WHEN {other} THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
