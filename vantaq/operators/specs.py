"""Security specifications from patches, and their retrieval for findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: What removed and added code tell of a weakness. All words of a group, one word of a group (any), in order.
WEAKNESSES = (
    ("CWE-89", ("execute", "format"), (), (), ("prepare", "parameter"), ()),
    ("CWE-79", (), ("innerhtml", "write"), (), ("textcontent", "escape"), ()),
    ("CWE-120", (), ("strcpy", "sprintf"), (), ("strncpy", "snprintf"), ()),
    ("CWE-416", ("free",), (), ("null",), (), ()),
    ("CWE-22", ("join",), (), (), ("absolute", "canonicalize"), ("sanitize",)),
)
OTHER_WEAKNESS = "CWE-787"
#: What added code tells of the safe behaviour.
BEHAVIOURS = (
    (("sanitize", "escape"), "Input sanitization/escaping applied"),
    (("validate", "check"), "Input validation performed"),
    (("parameter", "prepared"), "Parameterized queries used"),
    (("bound", "length"), "Boundary checking implemented"),
    (("canonicalize", "absolute"), "Path canonicalization performed"),
)
NULLIFIED = "Pointer nullified after deallocation"
#: Words of a patched path and its domain.
DOMAINS = ((("crypto", "cipher"), "crypto"), (("db.rs", "database", "sql"), "database"), (("http", "web", "api"), "web-server"), (("network", "socket"), "network"), (("auth", "login"), "authentication"))
GENERAL_WEAKNESSES = ("CWE-79", "CWE-89", "CWE-125", "CWE-416", "CWE-22")
UNIVERSAL = ("sanitize", "validate", "parameterized", "bound check", "escape")
#: What a weakness is called.
NAMES = {
    "CWE-79": "Cross-site scripting (XSS) vulnerability", "CWE-89": "SQL injection vulnerability", "CWE-120": "Buffer copy without boundary checking", "CWE-416": "Use-after-free vulnerability",
    "CWE-22": "Path traversal vulnerability", "CWE-787": "Out-of-bounds write vulnerability",
}


def _any(value: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(value, F.lit(w))
    return out


def _all(value: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & F.contains(value, F.lit(w))
    return out


def hunks(patches: DataFrame) -> DataFrame:
    """patches: ord, patch. ord, hunk_no, removed, added (code, without its marks) of the hunks that remove and add."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.col("patch"), F.lit("\n")), r"\n(?=@@)"), lambda x: F.length(x) > 0)
    body = lambda x: F.filter(F.split(F.regexp_replace(x, "\n$", ""), "\r?\n"), lambda line: ~line.startswith("@@"))
    listed = F.filter(F.transform(parts, body), lambda lines: F.exists(lines, lambda x: x != ""))
    code = lambda mark, head: F.transform(F.filter("lines", lambda x: x.startswith(mark) & ~x.startswith(head)), lambda x: F.substring(x, F.lit(2), F.length(x)))
    out = patches.select("ord", F.posexplode(listed).alias("hunk_no", "lines")).select("ord", "hunk_no", code("-", "---").alias("gone"), code("+", "+++").alias("new"))
    return out.filter((F.size("gone") > 0) & (F.size("new") > 0)).select("ord", "hunk_no", F.array_join("gone", "\n").alias("removed"), F.array_join("new", "\n").alias("added"))


def weakness(removed: Column, added: Column) -> Column:
    r, a = F.lower(removed), F.lower(added)
    out = None
    for cwe, all_r, any_r, all_a, any_a, none_a in WEAKNESSES:
        hit = _all(r, all_r) & _all(a, all_a)
        hit = hit & _any(r, any_r) if any_r else hit
        hit = hit & _any(a, any_a) if any_a else hit
        hit = hit & ~_any(a, none_a) if none_a else hit
        out = F.when(hit, cwe) if out is None else out.when(hit, cwe)
    return out.otherwise(OTHER_WEAKNESS)


def safe_behaviour(removed: Column, added: Column) -> Column:
    r, a = F.lower(removed), F.lower(added)
    found = [F.when(_any(a, words), F.lit(what)) for words, what in BEHAVIOURS] + [F.when(_any(a, ("null",)) & _any(r, ("free",)), F.lit(NULLIFIED))]
    listed = F.array_compact(F.array(*found))
    plain = F.when(added == "", "").otherwise(F.concat(F.lit("Code modified to address security concern: "), text.ellipsis(added, 100)))
    return F.when(F.size(listed) > 0, F.array_join(listed, "; ")).otherwise(plain)


def domain(patch: Column) -> Column:
    path = F.lower(F.regexp_extract(patch, r"(--- a/\S+)", 1))
    out = None
    for words, name in DOMAINS:
        out = F.when(_any(path, words), name) if out is None else out.when(_any(path, words), name)
    return out.otherwise("general")


def specifications(patches: DataFrame) -> DataFrame:
    """patches: ord, patch. A specification for each hunk that removes and adds: ord, hunk_no, vuln_type, description,
    safe_behavior_pattern, project_domain, category (general, or the domain)."""
    out = hunks(patches).join(patches.select("ord", domain(F.col("patch")).alias("project_domain")), "ord")
    out = out.withColumn("vuln_type", weakness(F.col("removed"), F.col("added"))).withColumn("safe_behavior_pattern", safe_behaviour(F.col("removed"), F.col("added"))).filter("safe_behavior_pattern != ''")
    name = None
    for cwe, what in NAMES.items():
        name = F.when(F.col("vuln_type") == cwe, what) if name is None else name.when(F.col("vuln_type") == cwe, what)
    described = F.concat(name.otherwise("Security vulnerability"), F.lit(" detected. Vulnerable code pattern: "), text.ellipsis(F.col("removed"), 150))
    general = F.col("vuln_type").isin(*GENERAL_WEAKNESSES) & _any(F.lower("safe_behavior_pattern"), UNIVERSAL)
    return out.select("ord", "hunk_no", "vuln_type", described.alias("description"), "safe_behavior_pattern", "project_domain", F.when(general, "general").otherwise(F.col("project_domain")).alias("category"))


def best_specs(scored: DataFrame, k: int, within_domain: bool = False) -> DataFrame:
    """The k best specifications of each finding, with rank. scored: query, spec, score; for ``within_domain`` domain (of the query) and
    category (of the specification) too: then, of the 2k best, those of the domain and general ones."""
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "spec")
    top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= (2 * k if within_domain else k))
    if not within_domain:
        return top
    kept = top.drop("rank").filter((F.col("category") == F.col("domain")) | (F.col("category") == "general"))
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def first_of_class(specs: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k first specifications (spec) of each class (keys). Where a score depends on a specification's class alone, the k best of any finding are among these, as equal scores go by spec;
    so findings of one class too meet them once, and pairs don't grow with either table."""
    order = Window.partitionBy(*keys).orderBy("spec")
    return specs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def with_spec_evidence(findings: DataFrame, best: DataFrame, key: str = "ord") -> DataFrame:
    """findings (ord) with spec_evidence: their specifications' texts, best first. best: query (what findings have as ``key``: ord, or a class of findings), rank, description."""
    listed = best.groupBy(F.col("query").alias(key)).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "description"))), lambda x: F.concat(F.lit("Matched known vulnerability specification: "), x["description"])).alias("spec_evidence"))
    return findings.join(listed, key, "left")


def similar_variants(lines: DataFrame, pattern: str, keywords: list[str], least: float = 0.5) -> DataFrame:
    """``lines`` (text) that are similar enough to a known case, with similarity: whether the case's pattern matches, and how many of its keywords stand there, case aside."""
    from ..functions import scoring

    low = F.lower("text")
    hits = sum((F.contains(low, F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))
    return lines.withColumn("similarity", scoring.variant_similarity(F.col("text").rlike(pattern), hits)).filter(F.round("similarity", 6) >= least)
