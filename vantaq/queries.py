"""The engine's registered queries over the driver's tables, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import ctes, view
from .functions import ids, scoring, text, verdict
from .operators import code, evaluation, findings, history, planning, retrieval
from .registry import query
from .schema import at_least, severity_rank
from .sinks import reports, writers
from .sources import readers

#: The day that ages are counted to.
AS_OF = "1998-08-02"
RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


def joined(c: Column | str) -> Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, ",")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


FIND = ctes("findings")
KINDS = "list_distinct(list_transform(evidence, lambda x: CASE WHEN x IN ('semgrep','cpg_slice') THEN 'static' WHEN x IN ('llm_analysis','rule_synthesis') THEN 'llm' WHEN x = 'cwe_spec' THEN 'specification' ELSE 'verifier' END))"
TIER = f"CASE WHEN len({KINDS}) >= 2 AND list_contains({KINDS}, 'verifier') THEN 'verified' WHEN len(evidence) >= 2 OR round(confidence_score, 6) > 0.8 THEN 'supported' ELSE 'unverified' END"


def tiered(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "findings").withColumn("verification_tier", scoring.tier(F.col("evidence"), F.col("confidence_score")))


@query("a31_evidence_tier", f"{FIND} SELECT ord, {TIER} AS tier FROM findings")
def a31(spark, sf):
    return tiered(spark, sf).select("ord", F.col("verification_tier").alias("tier"))


@query("p1_evidence_gate", f"{FIND} SELECT ord, {TIER} AS tier FROM findings WHERE {TIER} <> 'unverified'")
def p1(spark, sf):
    return tiered(spark, sf).filter(F.col("verification_tier").isin("verified", "supported")).select("ord", F.col("verification_tier").alias("tier"))


@query("p3_verification_split", f"{FIND} SELECT ord, CASE WHEN verification_status = 'false_positive' THEN 'rejected' ELSE 'kept' END AS side, CASE WHEN verification_status = 'false_positive' THEN coalesce(verification_notes, 'false positive') END AS reason FROM findings")
def p3(spark, sf):
    wrong = F.coalesce(F.col("verification_status") == "false_positive", F.lit(False))
    return view(spark, sf, "findings").select("ord", F.when(wrong, "rejected").otherwise("kept").alias("side"), F.when(wrong, F.coalesce("verification_notes", F.lit("false positive"))).alias("reason"))


@query("p4_discovery_split", f"{FIND} SELECT ord, NOT list_contains(evidence, 'llm_analysis') AS needs_discovery FROM findings")
def p4(spark, sf):
    return view(spark, sf, "findings").select("ord", (~F.exists("evidence", lambda e: e == "llm_analysis")).alias("needs_discovery"))


@query("p5_poc_predicate", f"{FIND} SELECT ord, (verification_status IS NULL OR verification_status = 'confirmed') AND severity IN ('critical','high') AS wanted, severity IN ('critical','high') AS relevant FROM findings")
def p5(spark, sf):
    return view(spark, sf, "findings").select("ord", verdict.wants_proof_of_concept(F.col("verification_status"), F.col("severity")).alias("wanted"), at_least(F.col("severity"), "high").alias("relevant"))


@query("p12_early_termination", f"{FIND} SELECT count(*) AS n, count(*) > 1000 AS terminate FROM findings WHERE severity IN ('critical','high','medium')")
def p12(spark, sf):
    return planning.medium_or_worse(view(spark, sf, "findings"))


@query("p14_blind_judge", f"{FIND} SELECT ord, trim(coalesce(code_snippet, '')) = '' AND line_number IS NULL AS blind, CASE WHEN trim(coalesce(code_snippet, '')) = '' AND line_number IS NULL AND verification_status = 'confirmed' THEN 'needs_review' ELSE verification_status END AS capped FROM findings")
def p14(spark, sf):
    return view(spark, sf, "findings").select("ord", verdict.saw_no_code(F.col("code_snippet"), F.col("line_number")).alias("blind"), verdict.blind_cap(F.col("verification_status"), F.col("code_snippet"), F.col("line_number")).alias("capped"))


@query("p15_sensitive_mutation", f"{FIND} SELECT ord, regexp_matches(lower(title || ' ' || description), '{'|'.join(verdict.SENSITIVE)}') AS sensitive FROM findings")
def p15(spark, sf):
    return view(spark, sf, "findings").select("ord", verdict.sensitive_mutation(F.col("title"), F.col("description")).alias("sensitive"))


@query("p11_diff_scope", f"{ctes('findings', 'files')} SELECT ord FROM findings WHERE list_extract(string_split(file_path, '/'), -1) IN (SELECT list_extract(string_split(path, '/'), -1) FROM (SELECT 'a/b/f' || CAST(ord AS STRING) || '.py' AS path FROM files WHERE ord % 3 = 0))")
def p11(spark, sf):
    changed = view(spark, sf, "files").filter("ord % 3 = 0").select(F.concat(F.lit("a/b/f"), F.col("ord").cast("string"), F.lit(".py")).alias("path"))
    return planning.diff_scope(view(spark, sf, "findings"), changed).select("ord")


@query("a1_severity_histogram", f"{FIND} SELECT severity, count(*) AS n FROM findings GROUP BY severity")
def a1(spark, sf):
    return planning.histogram(view(spark, sf, "findings"))


@query("a2_severity_by_tier", f"{FIND}, t AS (SELECT severity, {TIER} AS tier FROM findings) SELECT coalesce(severity, 'all') AS severity, coalesce(tier, 'all') AS tier, count(*) AS n FROM t GROUP BY CUBE (severity, tier)")
def a2(spark, sf):
    return planning.severity_by_tier(tiered(spark, sf))


@query("a3_tier_counts", f"{FIND}, t AS (SELECT {TIER} AS tier FROM findings) SELECT tier, count(*) AS n FROM t GROUP BY tier")
def a3(spark, sf):
    return tiered(spark, sf).groupBy(F.col("verification_tier").alias("tier")).agg(F.count("*").alias("n"))


ISLANDS = f"""{FIND},
l AS (SELECT *, coalesce(line_number, 0) AS ln, row_number() OVER w AS pos, CASE WHEN coalesce(line_number, 0) - lag(coalesce(line_number, 0)) OVER w > 2 THEN 1 ELSE 0 END AS cut FROM findings WINDOW w AS (PARTITION BY file_path, cwe_id ORDER BY coalesce(line_number, 0), ord)),
i AS (SELECT *, sum(cut) OVER (PARTITION BY file_path, cwe_id ORDER BY pos) AS island FROM l),
s AS (SELECT file_path, cwe_id, island, pos, unnest(sources) AS src, unnest(range(len(sources))) AS k FROM i),
u AS (SELECT file_path, cwe_id, island, src, min(pos * 100 + k) AS place FROM s GROUP BY ALL),
j AS (SELECT file_path, cwe_id, island, string_agg(src, ',' ORDER BY place) AS sources FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY file_path, cwe_id, island ORDER BY len(sources) DESC, confidence_score DESC, pos) AS rk, count(*) OVER (PARTITION BY file_path, cwe_id, island) AS island_size FROM i)
SELECT r.ord, r.island_size, j.sources FROM r JOIN j ON r.file_path = j.file_path AND r.cwe_id IS NOT DISTINCT FROM j.cwe_id AND r.island = j.island WHERE rk = 1"""


@query("w1_structural_dedup", ISLANDS)
def w1(spark, sf):
    return findings.structural_dedup(view(spark, sf, "findings")).select("ord", "island_size", joined("sources").alias("sources"))


ROOT = "sha256(concat_ws('|', lower(title), file_path, regexp_replace(coalesce(code_snippet, ''), '\\s', '', 'g')))"
LOC = "CASE WHEN line_number IS NULL THEN file_path ELSE file_path || ':' || CAST(line_number AS STRING) END"


@query("a4_root_cause_groups", f"{FIND} SELECT {ROOT} AS root_id, count(*) AS n, arg_min(title, ord) AS title, arg_min(severity, ord) AS severity, string_agg(id, ',' ORDER BY ord) AS finding_ids, string_agg({LOC}, ',' ORDER BY ord) AS locations FROM findings GROUP BY 1")
def a4(spark, sf):
    return findings.root_cause_groups(view(spark, sf, "findings")).withColumn("finding_ids", joined("finding_ids")).withColumn("locations", joined("locations"))


@query("a5_merged_groups", f"{FIND} SELECT {ROOT} AS root_id, count(*) AS n, min(title) AS title, string_agg(DISTINCT {LOC}, ',' ORDER BY {LOC}) AS locations FROM findings GROUP BY 1")
def a5(spark, sf):
    f = view(spark, sf, "findings")
    both = findings.root_cause_groups(f.filter("ord % 2 = 0")).unionByName(findings.root_cause_groups(f.filter("ord % 2 = 1")))
    return findings.merge_groups(both).select("root_id", "n", "title", joined("locations").alias("locations"))


@query("a6_location_groups", f"{FIND} SELECT file_path || ':' || coalesce(CAST(line_number AS STRING), '') AS location, count(*) AS n, count(DISTINCT severity) AS severities FROM findings GROUP BY 1")
def a6(spark, sf):
    return view(spark, sf, "findings").groupBy(F.concat_ws(":", "file_path", F.coalesce(F.col("line_number").cast("string"), F.lit(""))).alias("location")).agg(F.count("*").alias("n"), F.count_distinct("severity").alias("severities"))


@query(
    "a7_conflicts",
    f"""{FIND}, g AS (SELECT file_path || ':' || coalesce(CAST(line_number AS STRING), '') AS location, count(*) AS n, count(DISTINCT severity) AS ns, count(DISTINCT cwe_id) AS nc, max(confidence_score) - min(confidence_score) AS rg, avg(confidence_score) AS mean,
arg_max(severity, CAST({RANK} AS BIGINT) * 1000000000 - ord) AS sev, arg_min(cwe_id, TRY_CAST(replace(cwe_id, 'CWE-', '') AS BIGINT) * 1000000000 + ord) AS cwe FROM findings GROUP BY 1),
k AS (SELECT *, CASE WHEN ns > 1 THEN 'severity' WHEN nc > 1 THEN 'cwe' WHEN round(rg, 6) > 0.3 THEN 'confidence' END AS kind FROM g WHERE n > 1)
SELECT location, n, kind, CASE kind WHEN 'severity' THEN sev WHEN 'cwe' THEN cwe ELSE CAST(CAST(round(mean, 6) AS DECIMAL(10,6)) AS STRING) END AS resolved FROM k WHERE kind IS NOT NULL""",
)
def a7(spark, sf):
    return findings.conflicts(view(spark, sf, "findings"))


@query("a11_aggregation_statistics", f"{FIND} SELECT count(*) AS total, count(*) FILTER (WHERE verification_status = 'false_positive') AS false_positives, count(*) FILTER (WHERE verification_status = 'needs_review') AS needs_review, count(*) FILTER (WHERE round(confidence_score, 6) >= 0.7) AS high, round(avg(confidence_score), 6) AS mean, count(*) FILTER (WHERE cross_ref) AS cross_file FROM findings")
def a11(spark, sf):
    c = F.col("confidence_score")
    s = F.col("verification_status")
    return view(spark, sf, "findings").agg(F.count("*").alias("total"), F.count_if(s == "false_positive").alias("false_positives"), F.count_if(s == "needs_review").alias("needs_review"), F.count_if(F.round(c, 6) >= 0.7).alias("high"), r6(F.avg(c)).alias("mean"), F.count_if("cross_ref").alias("cross_file"))


@query("m6_risk_level", f"{FIND}, g AS (SELECT file_path, count(*) AS n, count(*) FILTER (WHERE verification_status = 'false_positive') AS fp, count(*) FILTER (WHERE severity IN ('critical','high')) AS hi, avg(confidence_score) AS mean FROM findings GROUP BY 1) SELECT file_path, CASE WHEN fp > n // 2 THEN 'LOW' WHEN hi > n // 2 THEN 'CRITICAL' WHEN round(mean, 6) > 0.7 THEN 'HIGH' ELSE 'MODERATE' END AS risk FROM g")
def m6(spark, sf):
    g = view(spark, sf, "findings").groupBy("file_path").agg(F.count("*").alias("n"), F.count_if(F.col("verification_status") == "false_positive").alias("fp"), F.count_if(at_least(F.col("severity"), "high")).alias("hi"), F.avg("confidence_score").alias("mean"))
    return g.select("file_path", scoring.risk_level(F.col("n"), F.col("fp"), F.col("hi"), F.col("mean")).alias("risk"))


def _refine_sql() -> str:
    q = lambda s: s.replace("'", "''")
    hit = lambda table: " OR ".join(f"(cwe_id = '{c}' AND regexp_matches(code_snippet, '{q('|'.join(p))}'))" for c, p in table.items())
    n = lambda groups: " + ".join(f"CAST(contains(lower(code_snippet), '{q(x.lower())}') AS INT)" for words in groups.values() for x in words)
    has = lambda c, *p: "(" + " OR ".join(f"contains({c}, '{x}')" for x in p) + ")"
    path, note = "lower(file_path)", "verification_notes"
    wrong, sound = has(note, "false_positive", "False positive"), has(note, "sound", "validated")
    steps = [
        ("verification_status = 'confirmed'", 0.15), ("verification_status = 'false_positive'", -0.3), ("verification_status = 'failed'", -0.1), ("len(sources) > 1", 0.1), ("cross_ref", 0.08),
        (hit(scoring.FALSE_POSITIVE_PATTERNS), -0.2), (f"coalesce({hit(scoring.HIGH_CONFIDENCE_PATTERNS)}, FALSE) AND NOT coalesce({hit(scoring.FALSE_POSITIVE_PATTERNS)}, FALSE)", 0.1),
        (f"({n(scoring.SUPPORT)}) > ({n(scoring.CONTRADICT)})", 0.05), (f"({n(scoring.SUPPORT)}) < ({n(scoring.CONTRADICT)})", -0.15), ("severity IN ('critical','high') AND round(confidence_score, 6) > 0.7", 0.05),
        (has(path, "test", "mock"), -0.1), (has(path, "vendor", "node_modules", "third_party"), -0.15), ("list_contains(sources, 'bandit') OR list_contains(sources, 'gosec')", -0.05),
        (f"{has(note, 'triage', 'Triage')} AND {wrong}", -0.25), (f"{has(note, 'triage', 'Triage')} AND NOT {wrong} AND {has(note, 'true_positive', 'True positive')}", 0.1),
        (f"{has(note, 'rationale', 'Rationale')} AND {sound}", 0.1), (f"{has(note, 'rationale', 'Rationale')} AND NOT {sound} AND {has(note, 'flawed', 'invalid')}", -0.2),
    ]
    ctes_, last = "s0 AS (SELECT *, confidence_score AS s FROM findings)", "s0"
    for k, (when, by) in enumerate(steps, 1):
        moved = f"least(1.0, s + CAST({by} AS DOUBLE))" if by > 0 else f"greatest(0.0, s - CAST({-by} AS DOUBLE))"
        ctes_ += f",\ns{k} AS (SELECT * EXCLUDE (s), CASE WHEN coalesce({when}, FALSE) THEN {moved} ELSE s END AS s FROM s{k - 1})"
        last = f"s{k}"
    never = " OR ".join(f"regexp_matches(lower(title || ' ' || description || ' ' || coalesce(cwe_id, '')), '{p}')" for p in scoring.NEVER_SUBMIT.values())
    return f"{FIND},\n{ctes_}\nSELECT ord, round(CASE WHEN {never} THEN s * 0.1 ELSE s END, 6) AS refined FROM {last}"


def refined(spark: SparkSession, sf: str) -> DataFrame:
    f = view(spark, sf, "findings")
    names = ("confidence_score", "verification_status", "sources", "code_snippet", "cwe_id", "severity", "file_path", "verification_notes", "title", "description")
    score, factors = scoring.refinement({c: F.col(c) for c in names} | {"cross_file": F.col("cross_ref")})
    return f.withColumn("refined", score).withColumn("factors", factors)


@query("m2_refined_confidence", _refine_sql())
def m2(spark, sf):
    return refined(spark, sf).select("ord", r6("refined").alias("refined"))


@query("m2_factors")
def m2f(spark, sf):
    return refined(spark, sf).select("ord", joined("factors").alias("factors"))


@query("a13_baseline", f"{FIND} SELECT count(*) AS n, round(avg(confidence_score), 6) AS mean, round(sqrt(var_pop(confidence_score)), 6) AS deviation, round(CAST(count(*) FILTER (WHERE verification_status = 'false_positive') AS DOUBLE) / count(*), 6) AS false_positive_rate FROM findings")
def a13(spark, sf):
    return planning.baseline(view(spark, sf, "findings")).select("n", r6("mean").alias("mean"), r6("deviation").alias("deviation"), r6("false_positive_rate").alias("false_positive_rate"))


@query("a13_merged_baseline", f"{FIND} SELECT count(*) AS n, round(avg(confidence_score), 6) AS mean, round(var_pop(confidence_score) * count(*), 4) AS squares FROM findings")
def a13m(spark, sf):
    f = view(spark, sf, "findings")
    return planning.merged_baselines(planning.baseline(f.filter("ord % 3 = 0")).unionByName(planning.baseline(f.filter("ord % 3 <> 0")))).select("n", r6("mean").alias("mean"), F.round("squares", 4).alias("squares"))


@query("m3_normalisation", f"{FIND}, b AS (SELECT count(*) AS n, avg(confidence_score) AS mean, stddev_pop(confidence_score) AS sd, CAST(count(*) FILTER (WHERE verification_status = 'false_positive') AS DOUBLE) / count(*) AS rate FROM findings) SELECT ord, round(CASE WHEN rate > 0.3 THEN confidence_score * (1 - rate / 2) WHEN rate < 0.1 THEN least(1.0, confidence_score * (1 + 2 * (0.1 - rate))) ELSE confidence_score END, 6) AS by_rate, round(greatest(0.0, least(1.0, 0.5 * (confidence_score - mean) / sd + 0.5)), 6) AS by_z FROM findings, b")
def m3(spark, sf):
    f = view(spark, sf, "findings")
    both = f.crossJoin(F.broadcast(planning.baseline(f)))  # one row
    c = F.col("confidence_score")
    return both.select("ord", r6(scoring.by_false_positive_rate(c, F.col("false_positive_rate"))).alias("by_rate"), r6(scoring.by_z_score(c, F.col("mean"), F.col("deviation"), F.col("n"))).alias("by_z"))


CONS = "CASE WHEN y + no = 0 THEN confidence_score ELSE CAST(y AS DOUBLE) / (y + no) END"
CONSENSUS = f"{FIND}, c0 AS (SELECT *, CAST(coalesce(verification_status = 'confirmed', FALSE) AS INT) + CAST(round(confidence_score, 6) >= 0.8 AS INT) AS y, CAST(coalesce(verification_status = 'false_positive', FALSE) AS INT) AS no FROM findings), c1 AS (SELECT *, {CONS} AS cs FROM c0), c2 AS (SELECT *, no = 1 OR (no > y AND cs < 0.3) AS wrong FROM c1)"


def consensus(spark: SparkSession, sf: str) -> DataFrame:
    f = view(spark, sf, "findings")
    return f.withColumns(scoring.consensus(F.col("verification_status"), F.col("confidence_score")))


@query("m4_consensus", f"{CONSENSUS} SELECT ord, y AS agreement, greatest(y + no, 1) AS total_sources, round(cs, 6) AS consensus_score, wrong AS is_false_positive, CASE WHEN wrong THEN 'exclude' WHEN round(cs, 6) >= 0.7 THEN 'include' WHEN round(cs, 6) >= 0.4 THEN 'needs_review' ELSE 'manual_review' END AS recommendation FROM c2")
def m4(spark, sf):
    return consensus(spark, sf).select("ord", "agreement", "total_sources", r6("consensus_score").alias("consensus_score"), "is_false_positive", "recommendation")


@query("m5_ai_confidence", f"{CONSENSUS} SELECT ord, round(0.25 * CASE WHEN list_contains(evidence, 'llm_analysis') THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END + 0.35 * CASE verification_status WHEN 'confirmed' THEN CAST(0.9 AS DOUBLE) WHEN 'false_positive' THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END + 0.15 * CASE WHEN cross_ref THEN CAST(0.85 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END + 0.25 * cs, 6) AS ai_confidence FROM c2")
def m5(spark, sf):
    return consensus(spark, sf).select("ord", r6(scoring.ai_confidence(F.exists("evidence", lambda e: e == "llm_analysis"), F.col("verification_status"), F.col("cross_ref"), F.col("consensus_score"))).alias("ai_confidence"))


@query("m13_severity_rubric", f"{FIND}, x AS (SELECT ord, confidence_score * (CAST(ord % 11 AS DOUBLE) / 10) * CASE WHEN ord % 3 = 0 THEN 0.5 ELSE 1.0 END * CASE ord % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.8 ELSE 1.0 END * CASE ord % 4 WHEN 0 THEN 0.3 WHEN 1 THEN 0.6 WHEN 2 THEN 0.85 ELSE 1.0 END AS s FROM findings) SELECT ord, round(s, 8) AS score, CASE WHEN round(s, 6) >= 0.8 THEN 'critical' WHEN round(s, 6) >= 0.5 THEN 'high' WHEN round(s, 6) >= 0.2 THEN 'medium' ELSE 'low' END AS severity FROM x")
def m13(spark, sf):
    k = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("ord") % n + 1).cast("int"))
    s = scoring.rubric(F.col("confidence_score"), (F.col("ord") % 11).cast("double") / 10, F.lit(1.0), F.col("ord") % 3 == 0, k(3, "read", "write", "both"), k(4, "low", "medium", "high", "critical"))
    return view(spark, sf, "findings").withColumn("s", s).select("ord", F.round("s", 8).alias("score"), scoring.rubric_severity(F.col("s")).alias("severity"))


@query("f1_finding_ids", f"{FIND} SELECT ord, sha256(CAST(file_path || coalesce(CAST(line_number AS STRING), '') || coalesce(cwe_id, '') || title AS BLOB) || unhex(sha256(CASE WHEN code_snippet IS NULL THEN '\\x00'::BLOB ELSE '\\x01'::BLOB || CAST(code_snippet AS BLOB) END))) AS finding_id FROM findings")
def f1(spark, sf):
    return view(spark, sf, "findings").select("ord", ids.finding_id(F.col("file_path"), F.col("line_number").cast("string"), F.col("cwe_id"), F.col("title"), F.col("code_snippet")).alias("finding_id"))


def _domain_sql(table: dict, other: str) -> str:
    return "CASE " + " ".join(f"WHEN cwe_id IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in table.items()) + f" ELSE {other} END"


@query("f3_stable_keys", f"{FIND} SELECT ord, substr(sha256({_domain_sql(ids.RUN_DOMAINS, repr('uncategorized'))} || '/' || coalesce(cwe_id, 'none') || chr(0) || regexp_replace(trim(lower(coalesce(code_snippet, title))), '\\s+', ' ', 'g') || chr(0) || file_path), 1, 12) AS stable_key FROM findings")
def f3(spark, sf):
    return view(spark, sf, "findings").select("ord", ids.stable_key(F.col("cwe_id"), F.col("code_snippet"), F.col("title"), F.col("file_path")).alias("stable_key"))


@query("f37_domains", f"{FIND} SELECT ord, {_domain_sql(ids.HUNT_DOMAINS, 'NULL')} AS hunt_domain, {_domain_sql(ids.RUN_DOMAINS, repr('uncategorized'))} || '/' || coalesce(cwe_id, 'none') AS taxonomy FROM findings")
def f37(spark, sf):
    return view(spark, sf, "findings").select("ord", ids.domain_of(F.col("cwe_id"), ids.HUNT_DOMAINS).alias("hunt_domain"), ids.taxonomy(F.col("cwe_id")).alias("taxonomy"))


@query("f34_cwe_numbers", f"{FIND} SELECT ord, CASE WHEN contains(cwe_id, '-') THEN substr(cwe_id, strpos(cwe_id, '-') + 1) END AS suffix, coalesce(TRY_CAST(replace(cwe_id, 'CWE-', '') AS INT), -1) AS number FROM findings")
def f34(spark, sf):
    return view(spark, sf, "findings").select("ord", text.cwe_number(F.col("cwe_id")).alias("suffix"), F.coalesce(text.cwe_int(F.col("cwe_id")), F.lit(-1)).alias("number"))


@query("f35_paths", f"{ctes('files')} SELECT ord, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, list_extract(string_split(path, '/'), -1) AS name, regexp_extract(path, '\\.([^.]*)$', 1) AS ext, language AS lang FROM files")
def f35(spark, sf):
    p = F.col("path")
    return view(spark, sf, "files").select("ord", text.directory(p).alias("dir"), text.basename(p).alias("name"), text.extension(p).alias("ext"), text.language_of(p).alias("lang"))


@query("f27_functions_in_titles", f"{FIND} SELECT ord, array_to_string(regexp_extract_all(title, '([A-Za-z_]\\w*) *\\(', 1), ',') AS names FROM findings")
def f27(spark, sf):
    return view(spark, sf, "findings").select("ord", joined(text.functions_in(F.col("title"))).alias("names"))


@query("f24_sink_calls", f"{FIND} SELECT ord, array_to_string(list_filter([{', '.join(repr(s) for s in text.SINKS)}], lambda x: contains(lower(code_snippet), lower(x))), ',') AS sinks FROM findings WHERE code_snippet IS NOT NULL")
def f24(spark, sf):
    return view(spark, sf, "findings").filter("code_snippet IS NOT NULL").select("ord", joined(text.sink_calls(F.col("code_snippet"))).alias("sinks"))


@query("f45_ticket_queries", f"{FIND} SELECT ord, 'Possible ' || split_part(title, ' ', 2) AS q FROM findings")
def f45(spark, sf):
    return view(spark, sf, "findings").select("ord", text.ticket_query(F.col("title")).alias("q"))


J3 = "(a.cwe_id = b.cwe_id OR (a.severity = b.severity AND list_has_any(a.sources, b.sources)))"
SMALL = ctes("findings", "findings_small")


@query("j3_cross_file_pairs", f"{SMALL} SELECT a.ord, b.ord AS other FROM findings_small a JOIN findings_small b ON a.file_path <> b.file_path AND {J3}")
def j3(spark, sf):
    return findings.cross_file_pairs(view(spark, sf, "findings_small"))


@query("j3_cross_file_counts", f"{SMALL} SELECT a.ord, count(*) AS n FROM findings_small a JOIN findings_small b ON a.file_path <> b.file_path AND {J3} GROUP BY a.ord")
def j3n(spark, sf):
    return findings.cross_file_counts(view(spark, sf, "findings_small")).filter("n > 0")


@query("j3_cross_file_pairs_whole")
def j3_whole(spark, sf):
    f = view(spark, sf, "findings")
    return findings.cross_file_pairs(f, f.filter("ord % 20 = 0"))


#: Partners are counted without pairs: those of the weakness, and those of the severity that share a source (by inclusion and exclusion over the sets of up to two sources), less those of both; each
#: less those of the own file.
J3_COUNTS = f"""{FIND}, s AS (SELECT ord, file_path, cwe_id, severity, unnest(CASE WHEN len(sources) = 1 THEN [sources] ELSE [[sources[1]], [sources[2]], list_sort(sources)] END) AS part FROM findings),
k AS (SELECT ord, CASE len(part) WHEN 1 THEN 1 ELSE -1 END * (count(*) OVER (PARTITION BY severity, part) - count(*) OVER (PARTITION BY severity, part, file_path)
  - CASE WHEN cwe_id IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY severity, part, cwe_id) - count(*) OVER (PARTITION BY severity, part, cwe_id, file_path) END) AS n FROM s),
c AS (SELECT ord, CASE WHEN cwe_id IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY cwe_id) - count(*) OVER (PARTITION BY cwe_id, file_path) END AS n FROM findings),
t AS (SELECT ord, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM k UNION ALL SELECT * FROM c) GROUP BY ord)
SELECT ord, n FROM t WHERE n > 0"""


@query("j3_cross_file_counts_whole", J3_COUNTS)
def j3n_whole(spark, sf):
    return findings.cross_file_counts(view(spark, sf, "findings")).filter("n > 0")


CHAIN_SQL = f"""{FIND}, p(kind, x, y) AS (VALUES {', '.join(f'({k!r},{a!r},{b!r}),({k!r},{b!r},{a!r})' for k, v in findings.CHAINS.items() for a, b in v)}), f AS (SELECT ord, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir, substr(cwe_id, 5) AS c FROM findings),
j AS (SELECT a.dir, p.kind, a.ord AS primary_, b.ord AS partner FROM f a JOIN p ON a.c = p.x JOIN f b ON b.dir = a.dir AND b.c = p.y AND b.ord > a.ord), r AS (SELECT *, row_number() OVER (PARTITION BY dir, kind ORDER BY primary_, partner) AS rn FROM j),
ch AS (SELECT dir, kind AS chain_type, primary_ AS "primary", partner FROM r WHERE rn = 1)"""


@query("j4_attack_chains", f"{CHAIN_SQL} SELECT * FROM ch")
def j4(spark, sf):
    return findings.chains(view(spark, sf, "findings"))


@query(
    "v12_chain_partners",
    f"{CHAIN_SQL}, b AS (SELECT chain_type, dir, \"primary\" AS ord, partner AS other FROM ch UNION ALL SELECT chain_type, dir, partner, \"primary\" FROM ch), pp AS (SELECT b.ord, string_agg(f.id, ',' ORDER BY chain_type, f.id) AS partners FROM b JOIN findings f ON f.ord = b.other GROUP BY 1) SELECT findings.ord, partners FROM findings LEFT JOIN pp USING (ord)",
)
def v12(spark, sf):
    f = view(spark, sf, "findings")
    return findings.with_chain_partners(f, findings.chains(f)).select("ord", joined("chain_partners").alias("partners"))


@query("j7_near_duplicates", f"{FIND} SELECT a.ord AS a, b.ord AS b FROM findings a JOIN findings b ON a.file_path = b.file_path AND a.ord < b.ord AND abs(a.line_number - b.line_number) <= 3")
def j7(spark, sf):
    return findings.near_duplicate_pairs(view(spark, sf, "findings"))


@query("o9_best_of_location", f"{FIND} SELECT {LOC} AS location, arg_max(ord, CAST(NOT coalesce(verification_status = 'false_positive', FALSE) AS BIGINT) * 100000000000000 + CAST({RANK} AS BIGINT) * 10000000000000 + CAST(round(confidence_score * 100) AS BIGINT) * 10000000000 + ord) AS ord, count(*) AS n FROM findings GROUP BY 1")
def o9(spark, sf):
    return findings.best_of_location(view(spark, sf, "findings"))


EVAL = ctes("eval_findings", "expected", "suppressed_rows", "suppressed")
SCORES = f"""{EVAL}, fl AS (SELECT f.* FROM eval_findings f SEMI JOIN suppressed s ON f.target = s.target AND f.file_path = s.file_path), us AS (SELECT f.* FROM eval_findings f ANTI JOIN suppressed s ON f.target = s.target AND f.file_path = s.file_path),
m AS (SELECT e.*, EXISTS (SELECT 1 FROM us WHERE us.target = e.target AND us.file_path = e.file_path AND us.cwe_id = e.cwe_id AND abs(us.line_number - e.line) <= 5) AS hit FROM expected e),
t AS (SELECT target FROM expected UNION SELECT target FROM suppressed UNION SELECT target FROM eval_findings),
n AS (SELECT t.target, (SELECT count(*) FROM m WHERE m.target = t.target) AS expected, (SELECT count(*) FROM m WHERE m.target = t.target AND hit) AS matched, (SELECT count(*) FROM fl WHERE fl.target = t.target) AS false_flags, (SELECT count(*) FROM suppressed s WHERE s.target = t.target) AS sup, (SELECT count(*) FROM suppressed s WHERE s.target = t.target AND NOT EXISTS (SELECT 1 FROM fl WHERE fl.target = s.target AND fl.file_path = s.file_path)) AS clean FROM t)"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.score(view(spark, sf, "eval_findings"), view(spark, sf, "expected"), view(spark, sf, "suppressed"))


@query("a25_oracle_scores", f"{SCORES} SELECT target, expected, matched, expected - matched AS missed, false_flags, clean, round(CASE WHEN expected > 0 THEN matched / expected ELSE 1.0 END, 6) AS recall, round(CASE WHEN matched + false_flags > 0 THEN matched / (matched + false_flags) ELSE 1.0 END, 6) AS precision, round(CASE WHEN sup > 0 THEN clean / sup ELSE 1.0 END, 6) AS silence FROM n")
def a25(spark, sf):
    return scores(spark, sf).select("target", "expected", "matched", "missed", "false_flags", "clean", *[r6(c).alias(c) for c in ("recall", "precision", "silence")])


@query("a26_suite", f"{SCORES} SELECT count(*) AS targets, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(false_flags) AS BIGINT) AS false_flags, round(sum(matched) / sum(expected), 6) AS aggregate, sum(matched) / sum(expected) > 0.7 AS passed FROM n")
def a26(spark, sf):
    return evaluation.suite(scores(spark, sf)).withColumn("aggregate", r6("aggregate"))


@query("a27_confusion", f"{FIND}, x AS (SELECT round(confidence_score, 6) >= 0.5 AS p, coalesce(verification_status, '') = 'confirmed' AS a FROM findings), n AS (SELECT count(*) FILTER (WHERE p AND a) AS tp, count(*) FILTER (WHERE p AND NOT a) AS fp, count(*) FILTER (WHERE NOT p AND a) AS fn, count(*) FILTER (WHERE NOT p AND NOT a) AS tn FROM x) SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM n")
def a27(spark, sf):
    rows = view(spark, sf, "findings").select((F.round("confidence_score", 6) >= 0.5).alias("predicted"), (F.coalesce("verification_status", F.lit("")) == "confirmed").alias("actual"))
    return evaluation.confusion(rows).select("tp", "fp", "fn", "tn", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("j8_citations", f"{FIND}, f AS (SELECT DISTINCT file_path AS path, CAST(user_k % 200 + 50 AS INT) AS n_lines FROM (SELECT file_path, CAST(regexp_extract(file_path, '(\\d+)\\.py$', 1) AS BIGINT) AS user_k FROM findings) WHERE user_k % 5 <> 0) SELECT ord, CASE WHEN n_lines IS NULL THEN 'unreadable' WHEN line_number = 0 THEN 'line_zero' WHEN line_number > n_lines THEN 'past_end' ELSE 'passed' END AS state FROM findings LEFT JOIN f ON f.path = file_path")
def j8(spark, sf):
    f = view(spark, sf, "findings")
    k = F.regexp_extract("file_path", r"(\d+)\.py$", 1).cast("long")
    files = f.select(F.col("file_path").alias("path"), k.alias("k")).distinct().filter("k % 5 <> 0").select("path", (F.col("k") % 200 + 50).cast("int").alias("n_lines"))
    return findings.with_citation_verdict(findings.citations(f, files)).select("ord", "state")


TOK = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
BM = f"""WITH d AS (SELECT doc_id AS doc, {TOK('text')} AS tk FROM documents), q0 AS (SELECT item_id AS query, {TOK('text')} AS tk FROM benchmark),
p AS (SELECT doc, len(tk) AS len, unnest(tk) AS term FROM d), ix AS (SELECT doc, len, term, count(*) AS tf FROM p GROUP BY ALL), st AS (SELECT count(*) AS n, avg(len(tk)) AS mean FROM d),
df AS (SELECT term, count(*) AS df FROM ix GROUP BY term), qt AS (SELECT query, unnest(tk) AS term FROM q0), q AS (SELECT query, term, count(*) AS times FROM qt GROUP BY ALL)"""
BM_A = f"{BM}, s AS (SELECT query, doc, sum(times * (n - df.df + 0.5) / (df.df + 0.5) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))) AS score FROM q JOIN df USING (term) JOIN ix USING (term), st GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM s WHERE score > 0)"


def _bm_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    return readers.spread(docs.select(F.col("doc_id").alias("doc"), "text")), items.select(F.col("item_id").alias("query"), "text")


@query("m7_bm25_top10", f"{BM_A} SELECT query, doc, round(score, 4) AS score, rank FROM r WHERE rank <= 10")
def m7(spark, sf):
    docs, asked = _bm_inputs(spark, sf)
    scored = retrieval.bm25_best(docs, asked, text.words(F.col("text")), text.words(F.col("text")), 10)
    return retrieval.ranked(scored, 10).select("query", "doc", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


IDENT = lambda c: f"list_filter(list_transform(regexp_extract_all({c}, '[a-zA-Z0-9_]+'), lambda x: lower(x)), lambda x: length(x) > 2)"
BM_B = BM.replace(TOK("text"), IDENT("text")) + ", s AS (SELECT query, doc, sum(times * (ln((n - df.df + 0.5) / (df.df + 0.5)) + 1) / (1 - 0.75 + 0.75 * len / mean)) AS score FROM q JOIN df USING (term) JOIN ix USING (term), st GROUP BY ALL), a AS (SELECT q0.query, d.doc, coalesce(s.score, 0) AS score FROM q0 CROSS JOIN d LEFT JOIN s ON s.query = q0.query AND s.doc = d.doc), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM a)"


@query("m8_bm25_presence_top10", f"{BM_B} SELECT query, doc, round(score, 4) AS score, rank FROM r WHERE rank <= 10")
def m8(spark, sf):
    docs, asked = _bm_inputs(spark, sf)
    scored = retrieval.bm25_best(docs, asked, text.identifiers(F.col("text")), text.identifiers(F.col("text")), 10, presence=True)
    return retrieval.ranked(scored, 10).select("query", "doc", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "m9_byte_embeddings",
    """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), b AS (SELECT doc_id, unnest(range(length(x) // 2)) AS i, x FROM h), v AS (SELECT doc_id, i % 768 AS d, sum(CAST('0x' || substr(x, 2 * i + 1, 2) AS INT) / 255) AS s FROM b GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(s * s)) AS norm, sum(s * (d + 1)) AS moment, max(s) AS top FROM v GROUP BY ALL) SELECT h.doc_id, 768 AS dim, round(coalesce(moment / norm, 0), 4) AS moment, round(coalesce(top / norm, 0), 6) AS top FROM h LEFT JOIN n USING (doc_id)""",
)
def m9(spark, sf):
    v = retrieval.byte_embeddings(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    moment = F.aggregate(F.zip_with("v", F.sequence(F.lit(1), F.lit(768)), lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    return v.select("doc_id", F.size("v").alias("dim"), F.round(moment, 4).alias("moment"), r6(F.array_max("v")).alias("top"))


@query("a29_corpus_statistics", f"{BM} SELECT (SELECT n FROM st) AS docs, (SELECT round(mean, 6) FROM st) AS mean_len, count(*) AS terms, CAST(sum(df) AS BIGINT) AS postings FROM df")
def a29(spark, sf):
    docs, _ = _bm_inputs(spark, sf)
    tokens = text.words(F.col("text"))
    terms = retrieval.document_frequency(retrieval.postings(docs, tokens)).agg(F.count("*").alias("terms"), F.sum("df").alias("postings"))
    return retrieval.corpus_statistics(docs, tokens).crossJoin(terms).select(F.col("n").alias("docs"), r6("mean_len").alias("mean_len"), "terms", "postings")


VEC = "WITH v AS (SELECT vec_id AS doc, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT doc AS query, e AS qe FROM v WHERE doc < 5), c AS (SELECT query, doc, list_cosine_similarity(e, qe) AS similarity FROM v, q), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, doc) AS rank FROM c)"


def nearest(spark: SparkSession, sf: str, k: int) -> DataFrame:
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc"), "embedding")
    return retrieval.nearest(v, v.filter("doc < 5").select(F.col("doc").alias("query"), "embedding"), k)


@query("o2_cosine_top10", f"{VEC} SELECT query, doc, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 10")
def o2(spark, sf):
    return nearest(spark, sf, 10).select("query", "doc", r6("similarity").alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("w7_rank_fusion", f"{VEC}, other AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY abs(doc - query), doc) AS rank FROM c), b AS (SELECT query, doc, rank FROM r WHERE rank <= 20 UNION ALL SELECT query, doc, rank FROM other WHERE rank <= 20), f AS (SELECT query, doc, sum(1.0 / (60 + rank)) AS score FROM b GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM f) SELECT query, doc, round(score, 6) AS score, rank FROM g WHERE rank <= 10")
def w7(spark, sf):
    near = nearest(spark, sf, 20)
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc"))
    other = v.crossJoin(F.broadcast(v.filter("doc < 5").select(F.col("doc").alias("query")))).withColumn("score", -F.abs(F.col("doc") - F.col("query")))
    return retrieval.fused([near, retrieval.ranked(other, 20)], 10).select("query", "doc", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


def nearest_whole(spark: SparkSession, sf: str, k: int) -> DataFrame:
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc"), "embedding")
    return retrieval.nearest_in_blocks(v, v.filter("doc % 20 = 0").select(F.col("doc").alias("query"), "embedding"), k)


@query("o2_cosine_top10_whole", VEC.replace("doc < 5", "doc % 20 = 0") + " SELECT query, doc, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 10")
def o2_whole(spark, sf):
    return nearest_whole(spark, sf, 10).select("query", "doc", r6("similarity").alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("w7_rank_fusion_whole")
def w7_whole(spark, sf):
    """Cosine of the vectors and BM25 of the documents with the same ids."""
    ids_ = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc"))
    docs = _bm_inputs(spark, sf)[0].join(ids_, "doc", "left_semi")
    scored = retrieval.bm25(docs, docs.filter("doc % 20 = 0").select(F.col("doc").alias("query"), "text"), text.words(F.col("text")), text.words(F.col("text")))
    return retrieval.fused([nearest_whole(spark, sf, 20), retrieval.ranked(scored, 20)], 10).select("query", "doc", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "f12_keywords",
    f"SELECT item_id, array_to_string(list_filter(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), lambda x: strlen(x) > 2 AND NOT list_contains([{', '.join(repr(w) for w in text.CODE_STOP_WORDS)}], x) AND NOT regexp_full_match(x, '\\p{{N}}+')), ' ') AS keywords FROM benchmark",
)
def f12(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", text.keywords(F.col("text")).alias("keywords"))


@query("f13_meaningful_words", f"SELECT item_id, array_to_string(list_slice(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: strlen(w) > 3 AND NOT list_contains([{', '.join(repr(w) for w in text.TICKET_STOP_WORDS)}], lower(w))), 1, 4), ' ') AS words FROM benchmark")
def f13(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", text.meaningful(F.col("text"), 4).alias("words"))


COMMITS = ctes("commits", "commit_files")
_sqlre = lambda p: p.replace("'", "''")
ANALYSED = f"""{COMMITS}, c AS (SELECT *, regexp_matches(lower(message), '{'|'.join(history.SECURITY_WORDS)}') AS security_fix, regexp_extract_all(message, 'CWE-\\d+') AS cwe_refs, {' + '.join(f"CAST(regexp_matches(message, '{_sqlre(p)}') AS INT)" for p, _ in history.VULNERABILITY_PATTERNS)} AS n_patterns, {' + '.join(f"CASE WHEN regexp_matches(message, '{_sqlre(p)}') THEN CAST({s} AS DOUBLE) ELSE 0 END" for p, _, s in history.RISKY_PATTERNS)} AS risk FROM commits)"""


def analysed(spark: SparkSession, sf: str) -> DataFrame:
    return history.analysed(view(spark, sf, "commits"))


@query("f42_commit_messages", f"{ANALYSED} SELECT commit_id, security_fix, array_to_string(cwe_refs, ',') AS cwe_refs, n_patterns, round(risk, 6) AS risk FROM c")
def f42(spark, sf):
    return analysed(spark, sf).select("commit_id", "security_fix", joined("cwe_refs").alias("cwe_refs"), F.size("patterns").alias("n_patterns"), r6("risk").alias("risk"))


@query("a20_git_confidence", f"{ANALYSED}, g AS (SELECT author_id, count(*) AS n, count(*) FILTER (WHERE security_fix) AS ns, count(*) FILTER (WHERE len(cwe_refs) > 0) AS nc, sum(n_patterns) AS np, sum(risk) AS risk, count(*) FILTER (WHERE date_diff('day', day, DATE '{AS_OF}') < 30 AND security_fix) AS recent FROM c GROUP BY 1) SELECT author_id, n, ns AS n_security, nc AS n_cwe, round(least(ns * 0.05, 0.2), 6) AS security_modifier, round(least(nc * 0.05, 0.15), 6) AS cwe_modifier, round(CASE WHEN recent > 0 THEN 0.1 ELSE 0.0 END, 6) AS recent_modifier, round(CASE WHEN n > 10 THEN 0.05 ELSE 0.0 END, 6) AS activity_modifier, round(greatest(0.0, least(1.0, 0.5 + least(ns * 0.05, 0.2) + least(nc * 0.05, 0.15) + least(np * 0.03, 0.15) - least(risk * 0.1, 0.3))), 6) AS overall FROM g")
def a20(spark, sf):
    out = history.confidence(analysed(spark, sf), "author_id", AS_OF)
    return out.select("author_id", "n", "n_security", "n_cwe", *[r6(c).alias(c) for c in ("security_modifier", "cwe_modifier", "recent_modifier", "activity_modifier", "overall")])


@query("a19_file_commit_stats", f"{ANALYSED} SELECT path, count(DISTINCT commit_id) AS total_commits, count(DISTINCT CASE WHEN security_fix THEN commit_id END) AS security_commits, CAST(sum(lines_added) AS BIGINT) AS total_additions, CAST(sum(lines_deleted) AS BIGINT) AS total_deletions FROM commit_files JOIN c USING (commit_id) GROUP BY path")
def a19(spark, sf):
    return history.file_stats(analysed(spark, sf), view(spark, sf, "commit_files"))


@query("o7_recent_commits", f"{COMMITS}, r AS (SELECT path, commit_id, row_number() OVER (PARTITION BY path ORDER BY day DESC, commit_id) AS rank FROM (SELECT DISTINCT path, commit_id FROM commit_files) JOIN commits USING (commit_id)) SELECT * FROM r WHERE rank <= 20")
def o7(spark, sf):
    touched = view(spark, sf, "commit_files").select("path", "commit_id").distinct().join(view(spark, sf, "commits").select("commit_id", "day"), "commit_id")
    return findings.top_k(touched, ["path"], 20, F.desc("day"), "commit_id").select("path", "commit_id", F.col("rank").cast("long").alias("rank"))


@query("f43_pattern_confidence", f"{ANALYSED} SELECT commit_id, round(least(1.0, 0.5 + CASE WHEN date_diff('day', day, DATE '{AS_OF}') < 30 THEN 0.2 WHEN date_diff('day', day, DATE '{AS_OF}') < 90 THEN 0.1 ELSE 0 END + CASE WHEN security_fix THEN 0.2 ELSE 0 END + CASE WHEN len(cwe_refs) > 0 THEN 0.15 ELSE 0 END + 0.15), 6) AS confidence FROM c")
def f43(spark, sf):
    c = analysed(spark, sf)
    return c.select("commit_id", r6(history.pattern_confidence(F.datediff(F.lit(AS_OF).cast("date"), F.col("day")), F.col("security_fix"), F.size("cwe_refs"), F.lit("security_fix"))).alias("confidence"))


CVES = ctes("cves")
CVE_CASE = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(description), {p!r})' for p in parts)} THEN '{name}'" for parts, name in history.CVE_PATTERNS) + " ELSE 'Other' END"


@query("u2_preferred_cves", f"{CVES}, r AS (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY CASE src WHEN 'KEV' THEN 0 ELSE 1 END, ord) AS rn FROM cves) SELECT cve_id, src, ord, severity FROM r WHERE rn = 1")
def u2(spark, sf):
    return history.preferred_cves(view(spark, sf, "cves")).select("cve_id", "src", "ord", "severity")


@query("a18_cve_clusters", f"{CVES}, k AS (SELECT {CVE_CASE} AS pattern, cve_id, ord FROM cves), r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY ord) AS rn FROM k) SELECT pattern, count(*) AS cve_count, string_agg(cve_id, ',' ORDER BY ord) FILTER (WHERE rn <= 5) AS examples FROM r GROUP BY pattern")
def a18(spark, sf):
    return history.cve_clusters(view(spark, sf, "cves")).withColumn("examples", joined("examples"))


@query("j2_cve_enrichment", f"{ctes('findings', 'cves')}, e AS (SELECT cwe_id, count(DISTINCT cve_id) AS k, min(cve_id) AS first_cve FROM cves WHERE cwe_id IS NOT NULL GROUP BY 1) SELECT ord, coalesce(k, 0) AS n_cves, first_cve FROM findings LEFT JOIN e USING (cwe_id)")
def j2(spark, sf):
    out = history.with_cve_evidence(view(spark, sf, "findings"), view(spark, sf, "cves"))
    return out.select("ord", F.coalesce(F.size("cve_ids"), F.lit(0)).cast("long").alias("n_cves"), F.get("cve_ids", F.lit(0)).alias("first_cve")).withColumn("n_cves", F.greatest("n_cves", F.lit(0)))


FILES = ctes("files")


@query("a22_file_totals", f"{FILES} SELECT language, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(size // 4) AS BIGINT) AS tokens, count(*) FILTER (WHERE regexp_matches(lower(path), '{'|'.join(planning.HIGH_RISK)}')) AS high_risk FROM files GROUP BY language")
def a22(spark, sf):
    return planning.file_totals(view(spark, sf, "files"))


@query("w3_budgeted_selection", f"{FILES}, r AS (SELECT ord, ord % 10 = 0 AS high_risk, row_number() OVER (ORDER BY ord) AS rn FROM files), k AS (SELECT *, row_number() OVER (PARTITION BY high_risk AND rn > 300 ORDER BY ord) AS k FROM r) SELECT ord, high_risk FROM k WHERE rn <= 300 OR (high_risk AND k <= 20)")
def w3(spark, sf):
    return planning.budget(view(spark, sf, "files").select("ord", (F.col("ord") % 10 == 0).alias("high_risk")), 300, 320)


@query("m11_file_priority", f"{FILES} SELECT ord, round(CASE WHEN regexp_matches(list_extract(string_split(path, '/'), -1), '^(main|index|app|server|__init__|__main__)\\.') THEN 2.0 ELSE 1.0 END * CASE WHEN ord % 7 = 0 THEN 2.0 ELSE 1.0 END * CASE WHEN ord % 5 = 0 AND size <= 1048576 THEN 2.0 ELSE 1.0 END * CASE WHEN ord % 20 < 7 THEN 1.5 ELSE 1.0 END * CASE WHEN size < 10240 THEN 1.2 ELSE 1.0 END, 6) AS priority FROM files")
def m11(spark, sf):
    o = F.col("ord")
    return view(spark, sf, "files").select("ord", r6(scoring.priority(F.col("path"), F.col("size"), o % 7 == 0, o % 5 == 0, o % 20)).alias("priority"))


@query("w6_batches", f"{FIND} SELECT ord, (row_number() OVER (PARTITION BY file_path ORDER BY ord) - 1) // 8 AS batch_no FROM findings")
def w6(spark, sf):
    return planning.batches(view(spark, sf, "findings"), ["file_path"], ["ord"], 8).select("ord", "batch_no")


@query("w8_round_robin", f"{FIND} SELECT ord, list_extract(['small','large','tiny'], CAST((row_number() OVER (PARTITION BY file_path ORDER BY ord) - 1) % 3 + 1 AS INT)) AS chosen_model FROM findings")
def w8(spark, sf):
    return planning.round_robin(view(spark, sf, "findings"), ["file_path"], ["ord"], ["small", "large", "tiny"]).select("ord", "chosen_model")


@query("w11_outermost_ranges", f"{FIND}, g AS (SELECT DISTINCT file_path AS path, CAST(line_number AS BIGINT) AS s, CAST(line_number + ord % 30 AS BIGINT) AS e FROM findings WHERE line_number IS NOT NULL), m AS (SELECT *, max(e) OVER (PARTITION BY path ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM g) SELECT path, s AS \"start\", e AS \"end\" FROM m WHERE seen IS NULL OR s >= seen")
def w11(spark, sf):
    f = view(spark, sf, "findings").filter("line_number IS NOT NULL")
    return planning.outermost(f.select(F.col("file_path").alias("path"), F.col("line_number").cast("long").alias("start"), (F.col("line_number") + F.col("ord") % 30).cast("long").alias("end")).distinct())


LINES = ctes("lines")


@query("w4_snippets", f"{LINES}, n AS (SELECT doc_id, max(line_no) AS k FROM lines GROUP BY 1), t AS (SELECT doc_id, doc_id % 13 + 1 AS line, k FROM n), p AS (SELECT t.*, least(line, k) AS place FROM t) SELECT p.doc_id, p.line, string_agg(CASE WHEN l.line_no = p.line THEN '>> ' ELSE '   ' END || CAST(l.line_no AS STRING) || ': ' || l.text, chr(10) ORDER BY l.line_no) AS snippet FROM p JOIN lines l ON l.doc_id = p.doc_id AND l.line_no BETWEEN p.place - 2 AND p.place + 2 GROUP BY 1, 2")
def w4(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", (F.col("doc_id") % 13 + 1).alias("line"))
    return planning.snippets(docs, view(spark, sf, "lines"), 2)


@query("w5_neighbour_lines", f"{LINES} SELECT doc_id, line_no, concat_ws(chr(10), lag(text) OVER w, text, lead(text) OVER w) AS snippet FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)")
def w5(spark, sf):
    return planning.neighbours(view(spark, sf, "lines"))


@query("w12_chunks")
def w12(spark, sf):
    return planning.chunks(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), "text"))


@query("a16_call_metrics", f"{ctes('calls')} SELECT CASE WHEN model IS NOT NULL THEN 'model:' || model WHEN operation IS NOT NULL THEN operation || ':' || phase ELSE 'all' END AS scope, count(*) AS calls, count(*) FILTER (WHERE NOT success) AS failures, count(*) FILTER (WHERE cached) AS cached, round(avg(latency_ms), 6) AS mean_latency FROM calls GROUP BY GROUPING SETS ((), (model), (operation, phase))")
def a16(spark, sf):
    return planning.call_metrics(view(spark, sf, "calls")).withColumn("mean_latency", r6("mean_latency"))


@query("j21_batch_verdicts", f"{ctes('verdicts')}, b AS (SELECT batch, bool_or(idx IS NOT NULL) AS indexed FROM verdicts GROUP BY 1), a AS (SELECT batch, CASE WHEN indexed THEN coalesce(idx, position) ELSE position END AS place, position, CASE WHEN status IN ('confirmed','false_positive','needs_review') THEN status ELSE 'needs_review' END AS s FROM verdicts JOIN b USING (batch)), l AS (SELECT batch, place, arg_max(s, position) AS verdict FROM a GROUP BY ALL) SELECT v.batch, v.position, coalesce(verdict, 'needs_review') AS verdict, verdict IS NULL AS missing FROM verdicts v LEFT JOIN l ON l.batch = v.batch AND l.place = v.position")
def j21(spark, sf):
    v = view(spark, sf, "verdicts")
    return planning.batch_verdicts(v, v)


@query("v2_seven_question_gate", f"{FIND} SELECT ord, CASE WHEN coalesce(verification_status, '') <> 'confirmed' THEN verification_status WHEN ord % 9 = 0 THEN 'needs_review' WHEN ord % 4 = 1 OR ord % 5 = 1 THEN 'needs_review' WHEN ord % 6 = 1 OR ord % 7 = 1 THEN 'false_positive' WHEN ord % 8 = 1 OR ord % 10 = 1 OR ord % 11 = 1 THEN 'needs_review' WHEN ord % 2 = 0 AND (ord % 3 = 0 OR ord % 12 = 2) THEN 'needs_review' ELSE verification_status END AS verdict FROM findings")
def v2(spark, sf):
    o = F.col("ord")
    no = lambda n: F.when(o % n == 1, "No").otherwise("yes, it is")
    answers = dict(zip(verdict.QUESTIONS, (no(4), no(5), F.when(o % 6 == 1, "Yes").otherwise("no"), no(7), no(8), no(10), no(11))))
    out = verdict.gate(F.col("verification_status"), answers, F.when(o % 3 == 0, " ").otherwise("network"), o % 12 == 2, o % 9 != 0, o % 2 == 0)
    return view(spark, sf, "findings").select("ord", out.alias("verdict"))


@query("j25_call_graph_paths", f"{ctes('edges').replace('WITH ', 'WITH RECURSIVE ', 1)}, p(v, d) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT b, d + 1 FROM p JOIN edges ON v = a WHERE d < 25) SELECT v AS vertex, CAST(min(d) AS INT) AS depth FROM p GROUP BY v")
def j25(spark, sf):
    return planning.reachable(view(spark, sf, "edges"), 0)


@query("f46_url_parts", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def f46(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))


@query("f4_content_hashes", "SELECT doc_id, sha256(text) AS hash, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents")
def f4(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("hash"))
    return d.join(d.groupBy("hash").agg(F.count("*").alias("copies")), "hash").select("doc_id", "hash", "copies")


@query("s3_s4_language_scan", f"{FILES} SELECT ord, language AS lang FROM files WHERE language IN ('python','php') AND NOT regexp_matches(lower(path), '^(?:src/src1(?:/.*)?|(?:.*/)?main\\.[^/]*)$')")
def s3(spark, sf):
    f = view(spark, sf, "files")
    return f.filter(~readers.excluded(F.col("path"), ["src/src1", "**/main.*"])).select("ord", text.language_of(F.col("path"), ("python", "php")).alias("lang")).filter("lang IS NOT NULL")


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    """Scanner reports made of the findings view, one JSON text for each 50 rows: rules with and without a severity in their names and a
    prefix, labels of all kinds, several results of one place with different ones."""
    f = view(spark, sf, "findings")
    rule = F.concat(F.when(F.col("ord") % 3 == 0, "tmp1-").otherwise(""), F.when(F.col("user") % 3 == 0, "rules.high.").otherwise("rules.plain."), F.coalesce("cwe_id", F.lit("none")))
    label = F.when(F.col("ord") % 4 == 0, "ERROR").when(F.col("ord") % 4 == 1, "WARNING").when(F.col("ord") % 4 == 2, "INFO").otherwise("ODD")
    f = f.withColumn("user", F.regexp_extract("file_path", r"(\d+)\.py$", 1).cast("long"))
    row = F.struct("ord", rule.alias("check_id"), F.col("file_path").alias("path"), F.struct((F.coalesce("line_number", F.lit(0)) % 10).alias("line")).alias("start"), F.struct(F.col("title").alias("message"), label.alias("severity"), F.struct(F.array(F.col("cwe_id")).alias("cwe")).alias("metadata")).alias("extra"))
    return f.groupBy(F.floor(F.col("ord") / 50).alias("ord")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(row)).alias("results"))).alias("json"))


SEMGREP = f"""{FIND}, s AS (SELECT ord, file_path AS path, CAST(coalesce(line_number, 0) % 10 AS INT) AS line, title, cwe_id, TRY_CAST(regexp_extract(file_path, '(\\d+)[.]py$', 1) AS BIGINT) AS u, ord % 4 AS k FROM findings),
l AS (SELECT *, CASE WHEN u % 3 = 0 THEN 'rules.high.' ELSE 'rules.plain.' END || coalesce(cwe_id, 'none') AS check_id, CASE k WHEN 0 THEN 'high' WHEN 1 THEN CASE WHEN u % 3 = 0 THEN 'high' ELSE 'medium' END WHEN 2 THEN CASE WHEN u % 3 = 0 THEN 'high' ELSE 'low' END ELSE CASE WHEN u % 3 = 0 THEN 'high' ELSE 'info' END END AS sev FROM s),
g AS (SELECT check_id, path, line, count(*) AS n, arg_min(title, ord) AS message, arg_min(sev, ord) AS severity, min(cwe_id) AS cwe_id FROM l GROUP BY 1, 2, 3)"""


@query("a12_semgrep_groups", f"{SEMGREP} SELECT check_id, path, line, n, message, severity, cwe_id FROM g")
def a12(spark, sf):
    return readers.semgrep(_reports(spark, sf), stems=["tmp1"]).drop("end_line")


@query(
    "f33_semgrep_texts",
    f"""{SEMGREP} SELECT check_id AS title, path AS file_path, line AS line_number, CASE WHEN n = 1 THEN message ELSE message || ' (and ' || (n - 1) || CASE WHEN n = 2 THEN ' other location)' ELSE ' other locations)' END END AS description,
CASE WHEN n = 1 THEN '' ELSE 'Found in ' || n || ' files:' || chr(10) || array_to_string(list_transform(range(n), lambda i: path || ':' || line), chr(10)) END AS code_snippet, CASE WHEN n > 1 THEN sha256(check_id || 'aggregated') END AS aggregated_id FROM g""",
)
def f33(spark, sf):
    g = readers.semgrep_findings(readers.semgrep(_reports(spark, sf), stems=["tmp1"]))
    return g.select("title", "file_path", "line_number", "description", "code_snippet", F.when(F.col("cross_file_references").isNotNull(), F.col("id")).alias("aggregated_id"))


@query("k1_json_rows", f"{FIND} SELECT ord, id, title, severity, file_path, CAST(line_number AS STRING) AS line_number, array_to_string(sources, ',') AS sources FROM findings")
def k1(spark, sf):
    out = writers.json_lines(view(spark, sf, "findings").select(F.col("ord").alias("k"), "id", "title", "severity", "file_path", "line_number", "sources"))
    value = lambda c: F.get_json_object("value", f"$.{c}")
    return out.select(value("k").cast("long").alias("ord"), *[value(c).alias(c) for c in ("id", "title", "severity", "file_path", "line_number")], F.array_join(F.from_json(value("sources"), "array<string>"), ",").alias("sources"))


@query("k1_json_summary", f"{FIND} SELECT count(*) AS total_findings, {', '.join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ('critical', 'high', 'medium', 'low', 'info'))} FROM findings")
def k1_summary(spark, sf):
    return reports.summary(view(spark, sf, "findings"))


@query("k2_sarif_levels", f"{FIND} SELECT CASE WHEN severity IN ('critical','high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, count(*) AS n FROM findings GROUP BY 1")
def k2(spark, sf):
    return view(spark, sf, "findings").groupBy(writers.sarif_level(F.col("severity")).alias("level")).agg(F.count("*").alias("n"))


def _proofs(spark, sf):
    return view(spark, sf, "findings").withColumn("poc_code", F.when(F.col("ord") % 4 == 0, F.concat(F.lit("run()\nstep "), F.col("ord").cast("string"))))


@query(
    "k2_sarif_results",
    f"{FIND} SELECT ord, id AS rule_id, description AS message, CASE WHEN severity IN ('critical','high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, file_path AS uri, CAST(line_number AS STRING) AS start_line, CASE WHEN ord % 4 = 0 THEN 'Proof of Concept (text)' END AS related, CASE WHEN ord % 4 = 0 THEN CAST(11 + length(CAST(ord AS STRING)) AS STRING) END AS bytes, 'https://cwe.mitre.org/data/definitions/' || coalesce(replace(cwe_id, 'CWE-', ''), '0') || '.html' AS help FROM findings",
)
def k2_results(spark, sf):
    f = _proofs(spark, sf)
    out = f.select("ord", reports.sarif_result(f).alias("j"), reports.sarif_rule(f).alias("r"))
    at = lambda path: F.get_json_object("j", path)
    return out.select(
        "ord", at("$.ruleId").alias("rule_id"), at("$.message.text").alias("message"), at("$.level").alias("level"), at("$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"), at("$.locations[0].physicalLocation.region.startLine").alias("start_line"),
        at("$.relatedLocations[0].location.message.text").alias("related"), at("$.relatedLocations[0].location.physicalLocation.region.byteLength").alias("bytes"), F.get_json_object("r", "$.helpUri").alias("help"),
    )


@query(
    "k3_markdown_document",
    f"""{FIND}, t AS (SELECT *, {TIER} AS tier, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS rk, upper(severity[1]) || severity[2:] AS sev FROM findings),
m AS (SELECT rk, ord, tier, '### [' || severity || '] ' || title || coalesce(' (' || cwe_id || ')', '') || chr(10) || chr(10) || '**Location:** `' || {LOC} || '`' || chr(10) || chr(10) || '**Description:** ' || description || chr(10) || chr(10) || '**Confidence:** ' || printf('%.1f', confidence_score * 100) || '%' || chr(10) || chr(10)
 || '**Evidence Tier:** ' || upper(tier[1]) || tier[2:] || chr(10) || chr(10) || CASE WHEN code_snippet IS NULL THEN '' ELSE '**Code:**' || chr(10) || chr(10) || '```text' || chr(10) || code_snippet || chr(10) || '```' || chr(10) || chr(10) END || CASE WHEN len(sources) > 0 THEN '**Sources:** ' || array_to_string(sources, ', ') || chr(10) || chr(10) ELSE '' END AS part FROM t),
c AS (SELECT rk, sev, count(*) FILTER (WHERE tier = 'verified') AS v, count(*) FILTER (WHERE tier = 'supported') AS s, count(*) FILTER (WHERE tier = 'unverified') AS u, count(*) AS n FROM t GROUP BY ALL)
SELECT 2 AS section, rk AS rank, 0 AS ord, '| **' || sev || '** | ' || v || ' | ' || s || ' | ' || u || ' | ' || n || ' |' AS part FROM c
UNION ALL SELECT 3, 0, 0, chr(10) || '**Totals:** ' || sum(v) || ' verified | ' || sum(s) || ' supported | ' || sum(u) || ' unverified' || chr(10) FROM c
UNION ALL SELECT 4, rk, -1, '## ' || sev || ' Findings (' || n || ')' || chr(10) FROM c UNION ALL SELECT 4, rk, ord, part FROM m UNION ALL SELECT 5, 0, ord, part FROM m WHERE tier = 'unverified'""",
)
def k3(spark, sf):
    f = view(spark, sf, "findings")
    return reports.markdown_document(f, "p", "today").filter("section BETWEEN 2 AND 5 AND NOT (section = 5 AND ord < 0)")


@query(
    "k4_html_rows",
    f"{FIND} SELECT ord, '<strong>Verification:</strong> ' || verification_status AS verification, CASE WHEN cwe_id IS NULL THEN 0 ELSE 1 END + CASE WHEN verification_status IS NULL THEN 0 ELSE 1 END + CASE WHEN verification_notes IS NULL THEN 0 ELSE 1 END AS n FROM findings",
)
def k4(spark, sf):
    f = view(spark, sf, "findings")
    rows = reports.metadata_rows(f)
    return f.select("ord", F.try_element_at(F.filter(rows, lambda x: x.startswith("<strong>Verification:")), F.lit(1)).alias("verification"), F.size(rows).alias("n"))


@query("u5_rule_difference", f"{FIND} SELECT DISTINCT cwe_id AS rule FROM findings WHERE cwe_id IS NOT NULL AND cwe_id NOT IN ('CWE-79', 'CWE-89')")
def u5(spark, sf):
    explicit = spark.createDataFrame([("CWE-79",), ("CWE-89",)], "rule string")
    return view(spark, sf, "findings").filter("cwe_id IS NOT NULL").select(F.col("cwe_id").alias("rule")).distinct().join(explicit, "rule", "left_anti")


@query("w2_keep_first", f"{FIND} SELECT file_path, min(ord) AS ord FROM findings GROUP BY 1")
def w2(spark, sf):
    return findings.keep_first(view(spark, sf, "findings"), ["file_path"], "ord").select("file_path", "ord")


@query("w13_last_writer", f"{FIND} SELECT file_path, arg_max(title, ord) AS title FROM findings GROUP BY 1")
def w13(spark, sf):
    return findings.keep_last(view(spark, sf, "findings"), ["file_path"], "title", "ord")


@query("a15_weakness_counters", f"{FIND} SELECT cwe_id, count(*) AS n, count(*) FILTER (WHERE verification_status = 'confirmed') AS confirmed, count(*) FILTER (WHERE verification_status = 'false_positive') AS false_positives FROM findings WHERE cwe_id IS NOT NULL GROUP BY 1")
def a15(spark, sf):
    return view(spark, sf, "findings").filter("cwe_id IS NOT NULL").groupBy("cwe_id").agg(F.count("*").alias("n"), F.count_if(F.col("verification_status") == "confirmed").alias("confirmed"), F.count_if(F.col("verification_status") == "false_positive").alias("false_positives"))


@query("a28_votes", f"{FIND} SELECT verification_status AS verdict, count(*) AS votes FROM findings WHERE verification_status IS NOT NULL GROUP BY 1")
def a28(spark, sf):
    return view(spark, sf, "findings").filter("verification_status IS NOT NULL").groupBy(F.col("verification_status").alias("verdict")).agg(F.count("*").alias("votes"))


@query("a30_distinct_collections", f"{FIND} SELECT count(DISTINCT cwe_id) AS weaknesses, count(DISTINCT file_path) AS files, string_agg(DISTINCT cwe_id, ',' ORDER BY cwe_id) AS listed FROM findings")
def a30(spark, sf):
    return view(spark, sf, "findings").agg(F.count_distinct("cwe_id").alias("weaknesses"), F.count_distinct("file_path").alias("files"), joined(F.array_sort(F.collect_set("cwe_id"))).alias("listed"))


@query("o6_worst_of_file", f"{FIND}, r AS (SELECT file_path, ord, row_number() OVER (PARTITION BY file_path ORDER BY {RANK} DESC, ord) AS rank FROM findings) SELECT * FROM r WHERE rank <= 3")
def o6(spark, sf):
    f = view(spark, sf, "findings").withColumn("_s", severity_rank(F.col("severity")))
    return findings.top_k(f, ["file_path"], 3, F.desc("_s"), "ord").select("file_path", "ord", F.col("rank").cast("long").alias("rank"))


@query("f40_never_submit", f"{FIND} SELECT ord, CASE {' '.join(f'''WHEN regexp_matches(lower(title || ' ' || description || ' ' || coalesce(cwe_id, '')), '{p}') THEN '{k}' ''' for k, p in scoring.NEVER_SUBMIT.items())} END AS label FROM findings")
def f40(spark, sf):
    return view(spark, sf, "findings").select("ord", scoring.never_submit(F.col("title"), F.col("description"), F.col("cwe_id")).alias("label"))


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as PHP files: a hook, its handler, which calls run and b, and b, which checks a nonce in every third file."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("n"), (F.col("doc_id") % 3 == 0).alias("safe"))
    source = F.concat(F.lit("<?php\nadd_action('wp_ajax_nopriv_save', 'a"), "n", F.lit("');\nfunction a"), "n", F.lit("($x) { $s = '}'; // }\n run(b"), "n", F.lit("($x), strcpy($y)); }\nfunction b"), "n", F.lit("($y): int { "), F.when(F.col("safe"), "check_nonce($y); ").otherwise(""), F.lit("return $y; }\n"))
    return d.select(F.col("n").alias("path"), source.alias("text"))


PHP = "WITH d AS (SELECT CAST(doc_id AS STRING) AS n, doc_id % 3 = 0 AS safe FROM documents)"
CALLED = f"{PHP}, k AS (SELECT n AS path, unnest(['add_action', 'a' || n, 'run', 'b' || n, 'strcpy'] || CASE WHEN safe THEN ['check_nonce'] ELSE [] END) AS callee, unnest([2, 1, 2, 1, 1] || CASE WHEN safe THEN [1] ELSE [] END) AS args FROM d), c AS (SELECT *, CASE callee WHEN 'strcpy' THEN 'memory' ELSE 'other' END AS category FROM k)"


@query("f56_call_sites", f"{CALLED} SELECT path, callee, CAST(args AS BIGINT) AS args, category FROM c")
def f56(spark, sf):
    return code.calls(_sources(spark, sf)).select("path", "callee", "args", code.category(F.col("callee")).alias("category"))


@query("a33_callee_groups", f"{CALLED} SELECT path, category, string_agg(callee, ',' ORDER BY callee) AS callees, count(*) AS n FROM c GROUP BY 1, 2")
def a33(spark, sf):
    return code.abstraction(code.calls(_sources(spark, sf))).withColumn("callees", joined("callees"))


@query("f58_function_bodies", f"{PHP} SELECT n AS path, 'a' || n AS name, CAST(3 AS BIGINT) AS line, CAST(length('{{ $s = ''}}''; // }}') + 1 + length(' run(b($x), strcpy($y)); }}') + length(n) AS INT) AS size FROM d UNION ALL SELECT n, 'b' || n, 5, CAST(length('{{ return $y; }}') + CASE WHEN safe THEN length('check_nonce($y); ') ELSE 0 END AS INT) FROM d")
def f58(spark, sf):
    return code.functions(_sources(spark, sf)).select("path", "name", "line", F.length("body").alias("size"))


@query("j11_unprotected_hooks", f"{PHP} SELECT n AS path, 'wp_ajax_nopriv_save' AS hook, 'a' || n AS handler, CAST(3 AS BIGINT) AS line, TRUE AS unauthenticated FROM d WHERE NOT safe")
def j11(spark, sf):
    return code.unprotected_hooks(_sources(spark, sf), [r"add_action\(\s*'(?P<hook>[^']+)'\s*,"], ["check_nonce"])


@query("j12_hooked_files", f"{ctes('files')} SELECT ord, ord % 4 = 0 AS hooked FROM files")
def j12(spark, sf):
    f = view(spark, sf, "files").withColumn("path", F.concat_ws("/", "path", F.col("ord").cast("string")))
    return code.with_hooks(f, f.filter("ord % 4 = 0").select("path")).select("ord", "hooked")
