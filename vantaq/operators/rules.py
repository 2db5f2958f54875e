"""Rule tables of users against texts: many literals and expressions in one pass.

Each rule has literals that its matches must hold: itself, or all that its expression cannot do without. An Aho-Corasick automaton of these literals reads each
text once, and only rules all of whose literals were met are tried; expressions without such a literal are tried on every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from re import _constants, _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import settled

#: Bytes of rules that are broadcast at once; a larger table is taken a part at a time.
RULE_BYTES = 8 << 20
KINDS = ("literal", "regex")
HITS = "rule string, n long, first long"
#: A-Z alone are folded, in texts and in patterns alike.
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def required_literals(pattern: str) -> list[str]:
    """The literals that every match of an expression holds, the longest first."""
    found, run = [], ""

    def walk(items) -> None:
        nonlocal run
        for op, value in items:
            if op is _constants.LITERAL:
                run += chr(value)
                continue
            if op is _constants.SUBPATTERN and not value[1] and not value[2]:
                walk(value[3])
                continue
            found.append(run)
            run = ""
            if op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT, _constants.POSSESSIVE_REPEAT) and value[0] > 0:
                walk(value[2])
                found.append(run)
                run = ""

    walk(_parser.parse(pattern))
    return sorted({x for x in (*found, run) if x}, key=lambda x: (-len(x), x))


class Matcher:
    """Compiled rules: (rule, group, kind, pattern, ignore_case)."""

    def __init__(self, rules: list[tuple[str, str | None, str, str, bool]]) -> None:
        import ahocorasick

        self.rules, self.always = [], []
        by_literal: dict[tuple[bool, str], list[tuple[int, tuple[str, ...]]]] = {}
        for rule, group, kind, pattern, ignore in rules:
            if kind not in KINDS:
                raise ValueError(f"rule {rule}: kind {kind} is none of {KINDS}")
            try:
                compiled = re.compile(re.escape(pattern) if kind == "literal" else pattern, re.ASCII | re.IGNORECASE if ignore else 0)
            except re.error as e:
                raise ValueError(f"rule {rule}: {e}") from e
            k = len(self.rules)
            self.rules.append((rule, group, compiled, pattern if kind == "literal" and not ignore else None))
            literals = [pattern] if kind == "literal" else required_literals(pattern)
            literals = [x.translate(FOLD) for x in literals] if ignore else literals
            # A rule waits at its longest literal for all others.
            for x in literals:
                by_literal.setdefault((ignore, x), [])
            if literals:
                by_literal[ignore, literals[0]].append((k, tuple(literals[1:])))
            else:
                self.always.append(k)
        self.machines = []
        for ignore in (False, True):
            machine = ahocorasick.Automaton()
            for (folded, literal), found in by_literal.items():
                if folded == ignore:
                    machine.add_word(literal, (literal, tuple(found)))
            if len(machine):
                machine.make_automaton()
                self.machines.append((ignore, machine))

    def of(self, text: str | None, group: str | None) -> list[tuple[str, int, int]]:
        """rule, how often it matches (apart from one another, from the left) and where first, counted from 1."""
        if not text:
            text = ""
        tried = set(self.always)
        for ignore, machine in self.machines:
            met = dict(value for _, value in machine.iter(text.translate(FOLD) if ignore else text))
            for found in met.values():
                tried.update(k for k, others in found if all(x in met for x in others))
        out = []
        for k in sorted(tried):
            rule, only, compiled, plain = self.rules[k]
            if only is not None and only != group:
                continue
            if plain:
                n = text.count(plain)
                if n:
                    out.append((rule, n, text.index(plain) + 1))
                continue
            first, n = -1, 0
            for m in compiled.finditer(text):
                first = m.start() if first < 0 else first
                n += 1
            if n:
                out.append((rule, n, first + 1))
        return out


def hits(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """The columns of ``texts`` but text, and rule, n (matches apart from one another) and first (the first one's place, from 1): a row for each rule that matches a text. texts: text, and
    group if rules have one. rules: rule, kind (literal or regex), pattern, and optionally group (the rule is for texts of that group alone; null: for all) and ignore_case (A-Z
    alone; null: no).

    Cases: a null text is an empty one; an empty literal matches no text, rules without a pattern are none, an expression that cannot be read or an unknown kind ends the job with its
    name; equal rules match each; an empty table on either side gives no rows."""
    spark = texts.sparkSession
    optional = lambda c, kind: (F.col(c) if c in rules.columns else F.lit(None)).cast(kind).alias(c)
    read = rules.select(F.col("rule").cast("string"), optional("group", "string"), "kind", "pattern", optional("ignore_case", "boolean")).filter("pattern IS NOT NULL AND (kind <> 'literal' OR pattern <> '')")
    size = read.agg(F.coalesce(F.sum(F.octet_length("pattern") + F.octet_length("rule") + 16), F.lit(0))).first()[0]
    n = max(1, -(-size // RULE_BYTES))
    kept = [c for c in texts.columns if c != "text"]
    clash = {"rule", "n", "first"} & set(kept)
    if clash:
        raise ValueError(f"the texts have columns of the result: {sorted(clash)}")
    schema = ", ".join([*(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in kept), HITS])
    place = texts.columns.index("text")
    groups = texts.columns.index("group") if "group" in texts.columns else None
    carried = [texts.columns.index(c) for c in kept]

    def part(k: int) -> DataFrame:
        rows = [(r[0], r[1], r[2], r[3], bool(r[4])) for r in read.filter(F.pmod(F.xxhash64("rule", "pattern"), F.lit(n)) == k).orderBy("rule", "pattern").collect()]
        known = spark.sparkContext.broadcast(rows)
        state: list[Matcher] = []

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not state:
                state.append(Matcher(known.value))
            for batch in batches:
                owner, found = [], []
                for i, text in enumerate(batch.column(place)):
                    got = state[0].of(text.as_py(), batch.column(groups)[i].as_py() if groups is not None else None)
                    owner += [i] * len(got)
                    found += got
                at = pa.array(owner, pa.int64())
                made = [pa.array([f[j] for f in found], pa.string() if j == 0 else pa.int64()) for j in range(3)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in carried), *made], names=[*kept, "rule", "n", "first"])

        return texts.mapInArrow(match, schema)

    found = [part(k) if n == 1 else settled(part(k), "hits") for k in range(n)]
    return reduce(DataFrame.union, found)


def likely_false(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """``findings`` (ord, cwe_id, code_snippet) with indicators: the literals of their weakness (rules: group is the weakness, pattern) that stand in their code, in order; empty for none."""
    texts = findings.select(F.col("ord").alias("_ord"), F.col("cwe_id").alias("group"), F.col("code_snippet").alias("text"))
    known = rules.filter("group IS NOT NULL").select(F.col("pattern").alias("rule"), "group", F.lit("literal").alias("kind"), "pattern")
    found = hits(texts, known).groupBy("_ord").agg(F.array_sort(F.collect_set("rule")).alias("indicators"))  # at most the rules of a weakness
    return findings.join(found, F.col("ord") == F.col("_ord"), "left").drop("_ord").withColumn("indicators", F.coalesce("indicators", F.array().cast("array<string>")))
