"""Source code read lexically: call sites, function bodies, hook registrations, and hooks that no check protects.

The scanners are plain Python over one file's text and run in Arrow batches; what relates files or functions is joins.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What callees do.
CATEGORIES = {
    "I/O": ("fopen", "fclose", "fread", "fwrite", "open", "close", "read", "write", "printf", "fprintf", "sprintf", "scanf", "fscanf", "fgets", "fputs", "puts", "getchar", "putchar", "getline"),
    "memory": ("memcpy", "memset", "memmove", "strcpy", "strncpy", "strcat", "strncat", "strlen", "strcmp", "strncmp", "malloc", "calloc", "realloc", "free", "alloca"),
    "string": ("strtok", "strstr", "strchr", "strrchr", "sscanf", "snprintf", "vsnprintf"),
    "control_flow": ("system", "execve", "execl", "execvp", "popen", "fork", "exec", "eval"),
}
CRYPTO_PARTS, DATABASE_PARTS = ("crypt", "hash", "hmac", "aes", "rsa", "sign", "verify"), ("db", "query", "sql")
#: Callees that go with a weakness.
TAGS = {
    ("buffer_overflow", "CWE-120"): ("strcpy", "strcat", "gets", "sprintf", "vsprintf"),
    ("command_injection", "CWE-78"): ("system", "execve", "execl", "execvp", "popen"),
    ("buffer_overflow", "CWE-119"): ("memcpy", "memmove"),
    ("mem_mgmt", "CWE-416"): ("malloc", "calloc", "realloc"),
    ("double_free", "CWE-415"): ("free",),
    ("off_by_one", "CWE-193"): ("strncpy", "strncat"),
}
HANDLER_WINDOW = 200
CALL_DEPTH = 2
_CALL = re.compile(r"([^\W\d][\w:]*)\s*\(")
_PIECE = re.compile(r"[()\[\]{},]|[^\s()\[\]{},]+")
#: What a brace can hide in: a string, a comment; or a brace.
BRACE = re.compile(r"(?P<quiet>'(?:\\.|[^'\\])*(?:'|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)|(?://|#)[^\n]*|/\*.*?(?:\*/|\Z))|[{}]", re.S)


class _Cursor:
    """Reads a text from a place on; each step returns what it read, or nothing and stays."""

    def __init__(self, source: str, at: int = 0) -> None:
        self.source, self.at = source, at

    def space(self, kinds: str = " \t\n\r\f\v") -> bool:
        start = self.at
        while self.at < len(self.source) and self.source[self.at] in kinds:
            self.at += 1
        return self.at > start

    def mark(self, *options: str) -> str:
        for o in options:
            if self.source.startswith(o, self.at):
                self.at += len(o)
                return o
        return ""

    def name(self, more: str = "") -> str:
        """An ASCII identifier; ``more`` may stand in it as well."""
        start = self.at
        while self.at < len(self.source) and (c := self.source[self.at]).isascii() and (c.isalpha() or c == "_" or c in more or (self.at > start and c.isdigit())):
            self.at += 1
        return self.source[start : self.at]


def call_sites(source: str) -> list[tuple[str, int]]:
    """Distinct (callee, number of arguments), nested calls included; strings are not told apart."""
    names = {m.end() - 1: m[1].rstrip(":") for m in _CALL.finditer(source)}
    found: set[tuple[str, int]] = set()
    frames: list[list] = []  # of each open bracket: its place, commas, whether anything stands directly in it

    def close() -> None:
        at, commas, content = frames.pop()
        if at in names:
            found.add((names[at], commas + 1 if commas else int(content)))

    for m in _PIECE.finditer(source):
        c = m[0]
        if c in ("(", "[", "{"):
            frames.append([m.start(), 0, False])
        elif frames:
            if c in (")", "]", "}"):
                close()
            elif c == ",":
                frames[-1][1] += 1
            else:
                frames[-1][2] = True
    while frames:
        close()
    return sorted(found)


def _declarations(source: str) -> Iterator[tuple[str, int]]:
    """Names of declared functions, and the places of their opening braces: function, a name, parameters up to the first closing
    bracket, perhaps a colon and a type, and the brace."""
    at = source.find("function")
    while at >= 0:
        c = _Cursor(source, at + len("function"))
        if c.space() and (name := c.name()):
            c.space()
            if c.mark("(") and (close := source.find(")", c.at)) >= 0:
                c.at = close + 1
                c.space()
                if c.mark(":"):
                    c.space()
                    c.name("\\")
                    c.space()
                if c.mark("{"):
                    yield name, c.at - 1
                    at = c.at - len("function")
        at = source.find("function", at + len("function"))


def function_bodies(source: str) -> list[tuple[str, int, str]]:
    """(name, line of the opening brace, body) of each function; the first of a name. Braces in strings and comments don't count."""
    ends = [m.start() for m in re.finditer("\n", source)]
    out: dict[str, tuple[str, int, str]] = {}
    for name, start in _declarations(source):
        if name in out:
            continue
        depth, end = 0, len(source)
        for m in BRACE.finditer(source, start):  # no further than the body's end
            if m["quiet"] is None:
                depth += 1 if m[0] == "{" else -1
                if not depth:
                    end = m.end()
                    break
        before = bisect.bisect_left(ends, start)
        line = before + (start > 0 and source[start - 1] != "\n")
        out[name] = (name, max(1, line), source[start:end])
    return list(out.values())


def handler(window: str) -> str | None:
    """The handler at the start of a text: a quoted name, or the quoted method of an object in an array."""
    c = _Cursor(window)
    c.space(" \t")

    def quoted() -> str | None:
        if c.mark("'", '"') and (name := c.name()) and c.mark("'", '"'):
            return name
        return None

    if window[c.at : c.at + 1] in ("'", '"'):
        return quoted()
    closing = "]"
    if not c.mark("["):
        if not c.mark("array"):
            return None
        c.space()
        if not c.mark("("):
            return None
        closing = ")"
    c.space()
    if not (c.mark("$") and c.name()):
        return None
    c.space()
    if not c.mark(","):
        return None
    c.space()
    name = quoted()
    c.space()
    return name if c.mark(closing) else None


def hook_registrations(source: str, patterns: list[str], label: str = "hook", handlers: tuple[str, ...] | None = None) -> list[tuple[str, str]]:
    """Distinct (hook, handler) in order: a registration matches a pattern (its group ``hook`` is the name) and a handler follows it, as one
    of the expressions ``handlers`` has it (its first group), by default as ``handler`` does."""
    out: dict[tuple[str, str], None] = {}
    for p in patterns:
        for m in re.finditer(p, source):
            window = source[m.end() : m.end() + HANDLER_WINDOW]
            found = handler(window) if handlers is None else next((h[1] for h in (re.search(x, window) for x in handlers) if h), None)
            if found:
                out.setdefault(((m.groupdict().get("hook") or f"{label}_{found}"), found))
    return list(out)


def _exploded(files: DataFrame, scan: Callable[[str], list[tuple]], fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *r) for path, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in scan(source or "")]
            kinds = [pa.string(), *(t for _, t, _ in fields)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["path", *(n for n, _, _ in fields)])

    return files.select("path", "text").mapInArrow(each, "path string, " + ", ".join(f"{n} {t}" for n, _, t in fields))


def calls(files: DataFrame) -> DataFrame:
    """path, text -> path, callee, args."""
    return _exploded(files, call_sites, [("callee", pa.string(), "string"), ("args", pa.int64(), "long")])


def functions(files: DataFrame) -> DataFrame:
    """path, text -> path, name, line, body."""
    return _exploded(files, function_bodies, [("name", pa.string(), "string"), ("line", pa.int64(), "long"), ("body", pa.string(), "string")])


def hooks(files: DataFrame, patterns: list[str], label: str = "hook") -> DataFrame:
    """path, text -> path, hook, handler."""
    return _exploded(files, lambda s: hook_registrations(s, patterns, label), [("hook", pa.string(), "string"), ("handler", pa.string(), "string")])


def category(callee: Column) -> Column:
    low = F.lower(callee)
    out = None
    for name, members in CATEGORIES.items():
        out = F.when(low.isin(*members), name) if out is None else out.when(low.isin(*members), name)
    return out.when(low.rlike("|".join(CRYPTO_PARTS)), "crypto").when(low.rlike("|".join(DATABASE_PARTS)), "database").otherwise("other")


def weakness_tag(callee: Column) -> Column:
    """tag:weakness, or null."""
    out = F.lit(None).cast("string")
    for (tag, cwe), members in TAGS.items():
        out = F.when(F.lower(callee).isin(*members), f"{tag}:{cwe}").otherwise(out)
    return out


def abstraction(sites: DataFrame) -> DataFrame:
    """Per file: category, its callees in order, and how many."""
    return sites.withColumn("category", category(F.col("callee"))).groupBy("path", "category").agg(F.array_sort(F.collect_set("callee")).alias("callees"), F.count("*").alias("n"))


def unauthenticated(hook: Column) -> Column:
    return F.contains(hook, F.lit("wp_ajax_nopriv_")) | F.contains(hook, F.lit("admin_post_nopriv_"))


def with_hooks(files: DataFrame, registered: DataFrame) -> DataFrame:
    """files (path) with ``hooked``: whether a hook is registered in them. registered: path, once or more."""
    return files.join(registered.select("path", F.lit(True).alias("hooked")).distinct(), "path", "left").withColumn("hooked", F.coalesce("hooked", F.lit(False)))


def unprotected_hooks(files: DataFrame, patterns: list[str], primitives: list[str], depth: int = CALL_DEPTH) -> DataFrame:
    """path, hook, handler, line, unauthenticated: hooks whose handler is declared in their file and reaches none of the primitives, in its own body
    or in those of the functions it calls, ``depth`` levels down. Bodies and calls are tables; every level is an equi join."""
    wanted = [p for p in primitives if p]
    bodies = functions(files)
    if not wanted:
        return hooks(files, patterns).join(bodies.withColumnRenamed("name", "handler"), ["path", "handler"]).filter("false").select("path", "hook", "handler", "line", F.lit(False).alias("unauthenticated"))
    holds = F.lit(False)
    for p in wanted:
        holds = holds | F.contains(F.col("body"), F.lit(p))
    marked = bodies.withColumn("safe", holds)
    edges = calls(bodies.select(F.concat_ws("\x1f", "path", "name").alias("path"), F.col("body").alias("text"))).select(F.split("path", "\x1f").alias("k"), "callee").select(F.col("k")[0].alias("path"), F.col("k")[1].alias("name"), "callee").distinct()
    safe = marked.filter("safe").select("path", "name")
    reached = safe
    for _ in range(depth):
        step = edges.join(safe.withColumnRenamed("name", "callee"), ["path", "callee"], "left_semi").select("path", "name")
        safe = step.distinct()
        reached = reached.union(safe)
    asked = hooks(files, patterns).join(bodies.select("path", F.col("name").alias("handler"), "line"), ["path", "handler"])
    left = asked.join(reached.distinct().withColumnRenamed("name", "handler"), ["path", "handler"], "left_anti")
    return left.select("path", "hook", "handler", "line", unauthenticated(F.col("hook")).alias("unauthenticated"))
