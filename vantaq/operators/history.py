"""Commit history and vulnerability feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import top_k

#: Words of a security commit.
SECURITY_WORDS = (
    "security", "vulnerability", "vulnerable", "exploit", "injection", "xss", "csrf", "cors", "authentication", "authorization", "encryption", "cryptography", "hash", "password",
    "credential", "token", "secret", "key", "sanitize", "escape", "validate", "verify", "permission", "access control", "broken", "bypass", "cwe", "cve",
)
#: Patterns of commit messages, with their kind.
VULNERABILITY_PATTERNS = (
    (r"(?i)CWE-\d+", "security_vulnerability"),
    (r"(?i)CVE-\d{4}-\d+", "security_vulnerability"),
    (r"(?i)(?:fix|patch|repair)\s+(?:for\s+)?(?:the\s+)?(?:security\s+)?(?:vulnerability|issue|bug|flaw)", "security_fix"),
    (r"(?i)xss|cross[_-]site[_-]scripting", "injection_risk"),
    (r"(?i)(?:sql|sqli)[_-]?injection", "injection_risk"),
    (r"(?i)(?:command|cmd|shell|code)\s+injection", "injection_risk"),
    (r"(?i)(?:path|directory)\s+traversal", "injection_risk"),
    (r"(?i)(?:auth(?:entication|orization)?\s+(?:bypass|broken|fail))", "auth_issue"),
    (r"(?i)(?:weak\s+encryption|insecure\s+crypto|broken\s+crypto|cryptographic\s+(?:flaw|bug|issue))", "crypto_misuse"),
    (r"(?i)(?:deprecat|obsolete).*(?:security|crypt|auth)", "security_deprecation"),
    (r"(?i)(?:TODO|FIXME|HACK|XXX).*(?:security|vulnerability|injection|XSS|SQL|CWE)", "security_todo"),
)
#: Risky messages, their kind and score.
RISKY_PATTERNS = (
    (r"(?i)(?:emergency|hotfix|urgent|critical\s+fix|asap)", "emergency_commit", 0.3),
    (r"(?i)(?:bypass|skip|disable|ignore).*(?:security|auth|check|validation)", "security_bypass", 0.5),
    (r"(?i)^(?:revert|reverted).*", "revert", 0.2),
    (r"(?i)(?:merge\s+conflict|resolved\s+conflict)", "merge_with_conflicts", 0.15),
)
LARGE_COMMIT = 500
#: What a vulnerability's description names, the first that applies.
CVE_PATTERNS = (
    (("sql injection",), "SQL Injection"),
    (("xss", "cross-site scripting"), "Cross-Site Scripting"),
    (("rce", "remote code execution", "code execution"), "Remote Code Execution"),
    (("path traversal", "directory traversal"), "Path Traversal"),
    (("deserialization",), "Deserialization"),
    (("xxe", "xml external entity"), "XXE"),
    (("ssrf", "server-side request forgery"), "SSRF"),
    (("authentication", "auth bypass"), "Authentication Bypass"),
    (("privilege", "escalation"), "Privilege Escalation"),
    (("information disclosure", "information leak"), "Information Disclosure"),
)


def security_fix(message: Column) -> Column:
    return F.lower(message).rlike("|".join(SECURITY_WORDS))


def cwe_references(message: Column) -> Column:
    return F.regexp_extract_all(message, F.lit(r"(CWE-\d+)"), 1)


def analysed(commits: DataFrame) -> DataFrame:
    """Adds security_fix, cwe_refs, patterns (kinds) and risks (kinds), and risk (the sum of their scores)."""
    m = F.col("message")
    patterns = F.array_compact(F.array(*[F.when(m.rlike(p), F.lit(kind)) for p, kind in VULNERABILITY_PATTERNS]))
    risks = F.array_compact(F.array(*[F.when(m.rlike(p), F.lit(kind)) for p, kind, _ in RISKY_PATTERNS]))
    risk = sum((F.when(m.rlike(p), s).otherwise(0.0) for p, _, s in RISKY_PATTERNS), F.lit(0.0))
    return commits.withColumn("security_fix", security_fix(m)).withColumn("cwe_refs", cwe_references(m)).withColumn("patterns", patterns).withColumn("risks", risks).withColumn("risk", risk)


def pattern_confidence(age_days: Column, fix: Column, n_cwe: Column, kind: Column) -> Column:
    score = F.lit(0.5) + F.when(age_days < 30, 0.2).when(age_days < 90, 0.1).otherwise(0.0) + F.when(fix, 0.2).otherwise(0.0) + F.when(n_cwe > 0, 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), score + F.when(kind.isin("security_vulnerability", "security_fix"), 0.15).otherwise(0.0))


def confidence(commits: DataFrame, by: str, as_of: str) -> DataFrame:
    """Per group: commits, modifiers and the overall confidence. commits: analysed, with ``day``."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("day"))
    g = commits.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if("security_fix").alias("n_security"), F.count_if(F.size("cwe_refs") > 0).alias("n_cwe"), F.sum(F.size("patterns")).alias("n_patterns"), F.sum("risk").alias("risk"),
        F.count_if((age < 30) & F.col("security_fix")).alias("n_recent"),
    )
    capped = lambda n, unit, most: F.least(F.col(n) * unit, F.lit(most))
    overall = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + capped("n_security", 0.05, 0.2) + capped("n_cwe", 0.05, 0.15) + capped("n_patterns", 0.03, 0.15) - F.least(F.col("risk") * 0.1, F.lit(0.3))))
    return g.select(
        by, "n", "n_security", "n_cwe", capped("n_security", 0.05, 0.2).alias("security_modifier"), capped("n_cwe", 0.05, 0.15).alias("cwe_modifier"), F.when(F.col("n_recent") > 0, 0.1).otherwise(0.0).alias("recent_modifier"),
        F.when(F.col("n") > 10, 0.05).otherwise(0.0).alias("activity_modifier"), overall.alias("overall"),
    )


def file_stats(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Per file: commits, security commits, lines added and deleted."""
    return files.join(commits.select("commit_id", "security_fix"), "commit_id").groupBy("path").agg(F.count_distinct("commit_id").alias("total_commits"), F.count_distinct(F.when(F.col("security_fix"), F.col("commit_id"))).alias("security_commits"), F.sum("lines_added").alias("total_additions"), F.sum("lines_deleted").alias("total_deletions"))


def cve_pattern(description: Column) -> Column:
    low = F.lower(description)
    out = None
    for parts, name in CVE_PATTERNS:
        hit = F.contains(low, F.lit(parts[0]))
        for p in parts[1:]:
            hit = hit | F.contains(low, F.lit(p))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Other")


def preferred_cves(cves: DataFrame) -> DataFrame:
    """One row per id: the known-exploited one if there is one, else the first of the other feed."""
    best = cves.groupBy("cve_id").agg(F.min(F.struct(F.when(F.col("src") == "KEV", 0).otherwise(1).alias("r"), F.col("ord"))).alias("b"))
    return cves.join(best.select(F.col("cve_id").alias("_id"), F.col("b.ord").alias("_ord")), (F.col("cve_id") == F.col("_id")) & (F.col("ord") == F.col("_ord")), "left_semi")


def cve_clusters(cves: DataFrame, examples: int = 5) -> DataFrame:
    """pattern, cve_count, and the first few ids, by count and name."""
    named = cves.select(cve_pattern(F.col("description")).alias("pattern"), "cve_id", "ord")
    grouped = named.groupBy("pattern").agg(F.count("*").alias("cve_count"))
    listed = top_k(named, ["pattern"], examples, "ord").groupBy("pattern").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "cve_id"))), lambda x: x["cve_id"]).alias("examples"))
    return grouped.join(listed, "pattern").orderBy(F.desc("cve_count"), "pattern")


def with_cve_evidence(findings: DataFrame, cves: DataFrame) -> DataFrame:
    """Adds cve_ids: the vulnerabilities of the finding's weakness. They are listed once per weakness, not per finding."""
    listed = cves.filter("cwe_id IS NOT NULL").groupBy("cwe_id").agg(F.array_sort(F.collect_set("cve_id")).alias("cve_ids"))
    return findings.join(listed, "cwe_id", "left")


def with_cve_counts(findings: DataFrame, cves: DataFrame) -> DataFrame:
    """Adds n_cves of the finding's weakness; ``cves_by_weakness`` is the table that a report looks them up in."""
    return findings.join(cves_by_weakness(cves).select("cwe_id", F.size("cve_ids").alias("n_cves")), "cwe_id", "left")


def cves_by_weakness(cves: DataFrame) -> DataFrame:
    return cves.filter("cwe_id IS NOT NULL").groupBy("cwe_id").agg(F.array_sort(F.collect_set("cve_id")).alias("cve_ids"))


def cve_items(cves: DataFrame) -> DataFrame:
    """cwe_id, ord, cve_id and item of each vulnerability with a weakness: source (cwe_spec, the weakness), weight 0.5 and a detail with id and severity. cves: ord, cve_id, cwe_id, severity."""
    source = F.struct(F.lit("cwe_spec").alias("kind"), F.col("cwe_id").alias("label"))
    detail = F.concat(F.lit("Related CVE: "), "cve_id", F.lit(" (severity: "), F.coalesce(F.initcap("severity"), F.lit("unknown")), F.lit(")"))
    item = F.struct(source.alias("source"), F.lit(0.5).alias("weight"), detail.alias("detail"), F.lit(None).cast("timestamp").alias("ts"))
    return cves.filter("cwe_id IS NOT NULL AND cve_id IS NOT NULL").select("cwe_id", "ord", "cve_id", item.alias("item"))


def with_cve_items(findings: DataFrame, cves: DataFrame) -> DataFrame:
    """``findings`` with an item appended to evidence for each vulnerability of their weakness, in the order of ord: those of ``cve_items``. Items are built once
    a weakness and joined late, so findings carry none through earlier steps. cves: ord, cve_id, cwe_id, severity; a vulnerability of several weaknesses has a row for each.

    Cases: findings without a weakness, or with one that no vulnerability has, keep their evidence, null evidence too; a null severity is written as unknown; repeated rows of cves are items each."""
    listed = cve_items(cves).groupBy("cwe_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "cve_id", "item"))), lambda x: x["item"]).alias("_items"))
    kind = findings.schema["evidence"].dataType
    both = findings.join(listed, "cwe_id", "left")
    more = F.concat(F.coalesce("evidence", F.array().cast(kind)), F.col("_items"))
    return both.withColumn("evidence", F.when(F.col("_items").isNotNull(), more).otherwise(F.col("evidence"))).select(findings.columns)
