"""Lexical scanners of source code."""

from __future__ import annotations

from vantaq.operators import code
from pyspark.sql import functions as F

PHP = """<?php
add_action('wp_ajax_nopriv_save', 'save');
add_action( 'init', [ $this, 'boot' ] );
add_action('init', array($this, 'boot'));
add_action('admin', 'elsewhere');
function save($x) { $s = "}"; // }
  /* } */ store(clean($x), 'a{'); }
function store($a, $b): void { deep($a); }
function deep($a) { if (1) { check_nonce($a); } }
function boot() { run(); }
function boot() { check_nonce(1); }
"""


def test_call_sites():
    assert code.call_sites("f(a, g(b), [1, 2]) h () ns::m(x{1,2}) _z(") == [("_z", 0), ("f", 3), ("g", 1), ("h", 0), ("ns::m", 1)]
    assert code.call_sites("") == [] and code.call_sites("x = 1") == []


def test_function_bodies():
    got = {n: (line, body) for n, line, body in code.function_bodies(PHP)}
    assert list(got) == ["save", "store", "deep", "boot"]
    assert got["save"][1].endswith("'a{'); }") and got["save"][0] == 6 and got["boot"][1] == "{ run(); }"


def test_hooks():
    assert code.hook_registrations(PHP, [r"add_action\(\s*'(?P<hook>[^']+)'\s*,"]) == [("wp_ajax_nopriv_save", "save"), ("init", "boot"), ("admin", "elsewhere")]
    assert code.hook_registrations("on( 'h')", [r"on\("], "ev") == [("ev_h", "h")]


def test_unprotected_hooks(spark):
    files = spark.createDataFrame([("a.php", PHP), ("b.php", None)], "path string, text string")
    pattern = [r"add_action\(\s*'(?P<hook>[^']+)'\s*,"]
    rows = lambda depth: sorted((r.hook, r.handler, r.unauthenticated) for r in code.unprotected_hooks(files, pattern, ["check_nonce", ""], depth).collect())
    assert rows(2) == [("init", "boot", False)]
    assert rows(1) == [("init", "boot", False), ("wp_ajax_nopriv_save", "save", True)]
    assert code.unprotected_hooks(files, pattern, [""]).count() == 0


def test_categories(spark):
    files = spark.createDataFrame([("a.c", "strcpy(a, b); my_sql(x); aes_go(); foo(); printf(1)")], "path string, text string")
    got = {r.category: r.callees for r in code.abstraction(code.calls(files)).collect()}
    assert got == {"memory": ["strcpy"], "database": ["my_sql"], "crypto": ["aes_go"], "other": ["foo"], "I/O": ["printf"]}
    assert spark.range(1).select(code.weakness_tag(F.lit("FREE")), code.weakness_tag(F.lit("x"))).first() == ("double_free:CWE-415", None)
