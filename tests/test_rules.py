"""Rule tables against trying every rule on every text."""

from __future__ import annotations

import random
import re

import pytest

from vantaq.operators import rules


@pytest.mark.parametrize(
    "pattern,literal",
    [("abc", "abc"), ("ab+c", "a"), (r"add_action\(\s*['\"](?P<hook>\w+)['\"]", "add_action("), ("a|bcd", ""), (r"\w+", ""), ("x(?:yz)w", "xyzw"), ("(abc)?de", "de"), ("q{0,3}rst", "rst"), ("(?:ab){2}", "ab"), ("ab+cd", "cd"), ("", ""), ("(?i:abc)de", "de"), ("a.cd", "cd")],
)
def test_required_literals(pattern, literal):
    assert (rules.required_literals(pattern) or [""])[0] == literal


def test_all_required_literals():
    assert rules.required_literals(r"foo[ ,]+ba(?:r|z)qux.") == ["foo", "qux", "ba"] and rules.required_literals("a*|b") == []


def table(spark, rows):
    return spark.createDataFrame(rows, "rule string, group string, kind string, pattern string, ignore_case boolean")


@pytest.mark.parametrize("limit", [8 << 20, 400])
def test_hits_are_those_of_every_rule_on_every_text(spark, monkeypatch, limit):
    rnd = random.Random(limit)
    monkeypatch.setattr(rules, "RULE_BYTES", limit)
    parts = ["add_action(", "'init'", "\"save\"", ", cb)", "eval", "EVAL(", "x", "é", "\n", " ", "foo", "bar", "aaa"]
    texts = [(k, rnd.choice(["php", "js", None]), "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))) for k in range(60)] + [(60, "php", None), (60, "php", "eval")]
    known = [
        ("1", None, "literal", "eval", False), ("2", "php", "literal", "eval(", True), ("3", "js", "regex", r"add_action\(\s*['\"](\w+)['\"]", False), ("4", None, "regex", "fo+bar|xx", False), ("5", None, "literal", "aa", None),
        ("6", None, "regex", "(?:foo)+", True), ("7", None, "regex", r"^\w", False), ("8", None, "literal", "", False), ("9", None, "literal", None, False), ("9", None, "literal", "é", False), ("9", None, "literal", "é", False), ("10", None, "regex", "a*", False),
    ]
    got = sorted((r.id, r.rule, r.n, r["first"]) for r in rules.hits(spark.createDataFrame(texts, "id long, group string, text string"), table(spark, known)).collect())
    want = []
    for k, group, text in texts:
        for rule, only, kind, pattern, ignore in known:
            if pattern and (only is None or only == group):
                found = list(re.finditer(re.escape(pattern) if kind == "literal" else pattern, text or "", re.ASCII | re.I if ignore else 0))
                if found:
                    want.append((k, rule, len(found), found[0].start() + 1))
    assert got == sorted(want)


def test_faulty_rules_are_named(spark):
    texts = spark.createDataFrame([("a",)], "text string")
    for kind, pattern in (("regex", "(a"), ("glob", "a")):
        with pytest.raises(Exception, match="rule bad"):
            rules.hits(texts, table(spark, [("bad", None, kind, pattern, False)])).collect()
    assert rules.hits(texts, table(spark, [("r", None, "literal", "a", False)]).limit(0)).count() == 0
    assert rules.hits(texts.limit(0), table(spark, [("r", None, "literal", "a", False)])).count() == 0
    with pytest.raises(ValueError):
        rules.hits(spark.createDataFrame([("a", 1)], "text string, n int"), table(spark, [("r", None, "literal", "a", False)]))
