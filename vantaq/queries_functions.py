"""Queries of single functions over whole tables; what they give is typed by hand in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import ctes, view
from .functions import ids, responses, scoring, text, verdict
from .operators import specs
from .registry import query
from .sinks import reports

FIND = ctes("findings")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


TITLE = """CASE WHEN p_size < 10 THEN 'SQL Injection in Python' WHEN p_size < 20 THEN 'stored XSS CVE-2024-' || CAST(p_partkey AS {text}) || ' in the parser' WHEN p_size < 30 THEN 'race condition in Rust CVE:2024-1 CVE-2'
 WHEN p_size < 40 THEN 'a b' WHEN p_size < 45 THEN 'Memory corruption while parsing headers' ELSE ' PHP  deserialization ' END"""


@query(
    "f45_mixed_titles",
    """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'injection python state:open' WHEN p_size < 20 THEN 'CVE-2024-' || p_partkey || ' xss state:open' WHEN p_size < 30 THEN 'CVE:2024-1 CVE-2 race condition rust state:open'
 WHEN p_size < 40 THEN 'vulnerability a state:open' WHEN p_size < 45 THEN 'Memory corruption' ELSE 'deserialization php state:open' END AS q FROM part""",
)
def f45_mixed_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", text.ticket_query(F.expr(TITLE.format(text="STRING"))).alias("q"))


CUT = "left(text, n) || '...' || chr(10) || '[truncated - ' || (length(text) - n) || ' chars omitted]'"


@query(
    "f16_cut_texts",
    f"""SELECT doc_id, CASE WHEN strlen(text) <= 8000 THEN text ELSE (SELECT arg_max({CUT}, n) FROM (SELECT unnest(range(greatest(0, 7950 - strlen(text) + length(text)), 7970)) AS n) WHERE strlen(left(text, n)) + 32 + length(CAST(length(text) - n AS VARCHAR)) <= 8000) END AS cut FROM documents""",
)
def f16_cut_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", responses.cut_code(F.col("text")).alias("cut"))


@query("f17_removed_markers", r"SELECT doc_id, regexp_replace(text, '(?s)\. .*?,', '', 'g') AS rest FROM documents")
def f17_removed_markers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.remove_between(F.col("text"), ". ", ",").alias("rest"))


@query("f18_stripped_fences", r"SELECT conv_id, turn, CASE role WHEN 'user' THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE trim(text) END AS inner_text FROM conversations")
def f18_stripped_fences(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("role") == "user", F.concat(F.lit(" ```json\n"), "text", F.lit("\n``` "))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.strip_fences(said).alias("inner_text"))


@query("f19_rendered_templates", "SELECT conv_id, turn, 'As ' || role || ' (' || turn || '):' || chr(10) || text || ' {{other}} ' || role AS said FROM conversations")
def f19_rendered_templates(spark: SparkSession, sf: str) -> DataFrame:
    values = {"role": F.col("role"), "turn": F.col("turn").cast("string"), "text": F.col("text")}
    return table(spark, sf, "conversations").select("conv_id", "turn", text.render("As {{role}} ({{turn}}):\n{{text}} {{other}} {{role}}", values).alias("said"))


@query("f67_appended_notes", f"{FIND} SELECT ord, CASE WHEN verification_notes IS NULL THEN 'checked ' || ord ELSE verification_notes || chr(10) || 'checked ' || ord END AS notes FROM findings")
def f67_appended_notes(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "findings").select("ord", text.append_note(F.col("verification_notes"), F.concat(F.lit("checked "), F.col("ord").cast("string"))).alias("notes"))


@query("f7_wrapping_hashes", "SELECT p_partkey, list_reduce(list_transform(range(1, length(n) + 1), lambda i: CAST(ascii(n[i]) AS BIGINT)), lambda h, x: (h * 31 + x) % 4294967296, CAST(0 AS BIGINT)) AS hash FROM (SELECT p_partkey, p_name || ' ' || p_brand || p_partkey AS n FROM part)")
def f7_wrapping_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", ids.wrapping_hash(F.concat("p_name", F.lit(" "), "p_brand", F.col("p_partkey").cast("string"))).alias("hash"))


@query("f15_short_names", "SELECT p_partkey, CASE WHEN length(n) > 20 THEN left(n, 17) || '...' ELSE n END AS short FROM (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS n FROM part)")
def f15_short_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", text.ellipsis(F.concat_ws(" ", "p_name", "p_type", "p_brand"), 20).alias("short"))


@query(
    "p17_variant_lines",
    f"""{ctes('lines')}, s AS (SELECT doc_id, line_no, least(1.0, 0.4 + CASE WHEN regexp_matches(text, 'tion (de|la|the)') THEN 0.3 ELSE 0 END + 0.15 * (CASE WHEN contains(lower(text), 'que') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'with') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'und') THEN 1 ELSE 0 END)) AS s FROM lines)
SELECT doc_id, line_no, round(CAST(s AS DOUBLE), 6) AS similarity FROM s WHERE round(CAST(s AS DOUBLE), 6) >= 0.5""",
)
def p17_variant_lines(spark: SparkSession, sf: str) -> DataFrame:
    found = specs.similar_variants(view(spark, sf, "lines"), "tion (de|la|the)", ["que", "with", "und"])
    return found.select("doc_id", "line_no", F.round("similarity", 6).alias("similarity"))


@query(
    "m15_retries",
    f"""{ctes('calls')} SELECT conv_id, turn, least(30000.0, latency_ms * pow(2, turn)) AS wait, CASE WHEN latency_ms % 700 IN (400, 401, 403) THEN 'fail_fast' WHEN latency_ms % 700 = 429 OR latency_ms % 700 >= 500 THEN 'retry' ELSE 'final' END AS class FROM calls""",
)
def m15_retries(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "calls").select("conv_id", "turn", scoring.backoff(F.col("latency_ms"), F.col("turn")).alias("wait"), scoring.retry_class(F.col("latency_ms") % 700).alias("class"))


@query("m16_abstraction_levels", "SELECT doc_id, CASE WHEN n_chars < 500 THEN 'syntactic' WHEN n_chars < 2000 THEN 'functional' ELSE 'semantic' END AS level FROM documents")
def m16_abstraction_levels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", scoring.abstraction_level(F.col("n_chars")).alias("level"))


@query("v6_after_batch_errors", f"{FIND} SELECT ord, CASE WHEN verification_status = 'confirmed' THEN 'confirmed' ELSE 'needs_review' END AS status FROM findings")
def v6_after_batch_errors(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "findings").select("ord", verdict.after_batch_error(F.col("verification_status")).alias("status"))


SAID = """CASE lang WHEN 'en' THEN '{"verdict": "false_positive", "why": "' || source || '"}' WHEN 'de' THEN 'This is a FALSE POSITIVE in ' || source WHEN 'fr' THEN 'I have confirmed ' || source ELSE source || '?' END"""


@query("v9_agent_verdicts", "SELECT doc_id, CASE lang WHEN 'en' THEN 'false_positive' WHEN 'de' THEN 'false_positive' WHEN 'fr' THEN 'confirmed' ELSE 'needs_review' END AS verdict FROM documents")
def v9_agent_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", verdict.agent_verdict(F.expr(SAID)).alias("verdict"))


@query(
    "f51_presentation",
    f"""{FIND} SELECT ord, printf('%.1f%%', confidence_score * 100) AS percent, CASE WHEN confidence_score >= 0.8 THEN 'confidence-high' WHEN confidence_score >= 0.5 THEN 'confidence-medium' ELSE 'confidence-low' END AS confidence, 'severity-' || severity AS severity_class,
 CASE WHEN code_snippet IS NULL THEN '' ELSE '**Code:**' || chr(10) || chr(10) || '```py' || chr(10) || code_snippet || chr(10) || '```' || chr(10) || chr(10) END AS code, file_path || coalesce(':' || line_number, '') AS location FROM findings""",
)
def f51_presentation(spark: SparkSession, sf: str) -> DataFrame:
    score = F.col("confidence_score")
    return view(spark, sf, "findings").select(
        "ord", reports.percent(score).alias("percent"), reports.confidence_class(score).alias("confidence"), reports.severity_class(F.col("severity")).alias("severity_class"), reports.fenced("Code", F.lit("py"), F.col("code_snippet")).alias("code"),
        text.location(F.col("file_path"), F.col("line_number")).alias("location"),
    )
