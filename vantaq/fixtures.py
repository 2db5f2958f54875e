"""Views that give the driver's tables the shapes of findings, files, commits and so on.

Each view is a list of expressions that Spark and DuckDB read alike, so that a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: view: (table, filter, {column: expression})
VIEWS: dict[str, tuple[str, str, dict[str, str]]] = {
    "findings": (
        "events",
        "TRUE",
        {
            "ord": "CAST(event_id AS BIGINT)",
            "seed": "CAST(event_id AS STRING) || '|' || event_type",
            "title": "'Possible ' || event_type || ' issue in handle_' || event_type || '()'",
            "description": "CASE WHEN event_id % 23 = 0 THEN 'Missing security header' WHEN event_id % 29 = 0 THEN 'privilege escalation by role change' ELSE 'User input reaches a sink' END",
            "file_path": "'mod' || CAST(user_id % 7 AS STRING) || '/' || CASE WHEN user_id % 11 = 0 THEN 'test_' ELSE 'f' END || CAST(user_id AS STRING) || '.py'",
            "line_number": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(event_id % 211 + 1 AS INT) END",
            "cwe_id": "CASE event_type WHEN 'click' THEN 'CWE-79' WHEN 'purchase' THEN 'CWE-89' WHEN 'error' THEN 'CWE-78' WHEN 'signup' THEN 'CWE-287' ELSE CASE WHEN event_id % 2 = 0 THEN 'CWE-269' ELSE NULL END END",
            "severity": "CASE event_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END",
            "confidence_score": "CAST(event_id % 101 AS DOUBLE) / CAST(100 AS DOUBLE)",
            "sources_csv": "CASE event_id % 3 WHEN 0 THEN 'semgrep' WHEN 1 THEN 'llm_analysis' ELSE 'semgrep,llm_analysis' END",
            "verification_status": "CASE event_id % 7 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'false_positive' WHEN 2 THEN 'needs_review' WHEN 3 THEN 'failed' ELSE NULL END",
            "verification_notes": "CASE event_id % 9 WHEN 0 THEN 'triage: true_positive' WHEN 1 THEN 'Triage: false_positive' WHEN 2 THEN 'rationale sound' WHEN 3 THEN 'rationale flawed' ELSE NULL END",
            "code_snippet": "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'el.innerHTML = request.param' WHEN 2 THEN 'escape_html(name)' WHEN 3 THEN 'execute(sql + param)' WHEN 4 THEN 'prepare a statement; validate(x)' ELSE 'x = 1' END",
            "cross_ref": "event_id % 13 = 0",
            "evidence_csv": "CASE event_id % 4 WHEN 0 THEN 'semgrep' WHEN 1 THEN 'semgrep,independent_verifier' WHEN 2 THEN 'llm_analysis,rule_synthesis' ELSE 'cpg_slice,cwe_spec,security_agent_verification' END",
        },
    ),
    "files": (
        "documents",
        "TRUE",
        {
            "ord": "CAST(doc_id AS BIGINT)",
            "path": "'src/' || source || '/' || CASE WHEN doc_id % 13 = 0 THEN 'main.' ELSE 'd' || CAST(doc_id AS STRING) || '.' END || CASE lang WHEN 'en' THEN 'py' WHEN 'de' THEN 'php' WHEN 'fr' THEN 'js' ELSE 'c' END",
            "size": "CAST(n_chars AS BIGINT)",
            "language": "CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'php' WHEN 'fr' THEN 'javascript' ELSE 'c' END",
        },
    ),
    "expected": (
        "labels",
        "quality = 1",
        {
            "target": "'t' || CAST(doc_id % 10 AS STRING)",
            "file_path": "'f' || CAST(doc_id % 40 AS STRING) || '.py'",
            "line": "CAST(doc_id % 97 + 1 AS BIGINT)",
            "cwe_id": "CASE doc_id % 3 WHEN 0 THEN 'CWE-79' WHEN 1 THEN 'CWE-89' ELSE 'CWE-78' END",
            "ord": "CAST(doc_id AS BIGINT)",
        },
    ),
    "suppressed_rows": ("labels", "toxic = 1", {"target": "'t' || CAST(doc_id % 10 AS STRING)", "file_path": "'safe' || CAST(doc_id % 40 AS STRING) || '.py'"}),
    "eval_findings": (
        "documents",
        "TRUE",
        {
            "ord": "CAST(doc_id AS BIGINT)",
            "target": "'t' || CAST(doc_id % 10 AS STRING)",
            "file_path": "CASE WHEN doc_id % 12 = 0 THEN 'safe' ELSE 'f' END || CAST(doc_id % 40 AS STRING) || '.py'",
            "line_number": "CAST(greatest(1, doc_id % 97 + 1 + (doc_id % 9 - 4) * 2) AS BIGINT)",
            "cwe_id": "CASE WHEN doc_id % 6 = 5 THEN 'CWE-22' ELSE CASE doc_id % 3 WHEN 0 THEN 'CWE-79' WHEN 1 THEN 'CWE-89' ELSE 'CWE-78' END END",
        },
    ),
    "commits": (
        "orders",
        "TRUE",
        {
            "commit_id": "CAST(o_orderkey AS BIGINT)",
            "author_id": "CAST(o_custkey AS BIGINT)",
            "day": "CAST(o_orderdate AS DATE)",
            "message": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Emergency security fix for CWE-' || CAST(o_orderkey % 900 AS STRING) WHEN '2' THEN 'Fix for the XSS issue, see CVE-2024-' || CAST(1000 + o_orderkey % 9000 AS STRING) WHEN '3' THEN 'Revert: skip the auth check' WHEN '4' THEN 'Refactor module ' || CAST(o_custkey % 10 AS STRING) ELSE 'Update the docs' END",
        },
    ),
    "commit_files": (
        "lineitem",
        "TRUE",
        {"commit_id": "CAST(l_orderkey AS BIGINT)", "path": "'mod/f' || CAST(l_partkey % 50 AS STRING) || '.py'", "lines_added": "CAST(CAST(l_quantity AS INT) AS BIGINT)", "lines_deleted": "CAST(l_linenumber AS BIGINT)"},
    ),
    "cves": (
        "part",
        "TRUE",
        {
            "ord": "CAST(p_partkey AS BIGINT)",
            "cve_id": "'CVE-2024-' || CAST(p_partkey % 1500 AS STRING)",
            "src": "CASE WHEN p_size % 2 = 0 THEN 'KEV' ELSE 'NVD' END",
            "description": "CASE split_part(p_type, ' ', 1) WHEN 'PROMO' THEN 'SQL injection in the login form' WHEN 'LARGE' THEN 'Stored XSS in comments' WHEN 'MEDIUM' THEN 'Improper resource shutdown' WHEN 'STANDARD' THEN 'Directory traversal' ELSE 'Privilege escalation' END",
            "cwe_id": "CASE WHEN p_size % 2 = 0 THEN NULL ELSE CASE p_partkey % 3 WHEN 0 THEN 'CWE-79' WHEN 1 THEN 'CWE-89' ELSE 'CWE-22' END END",
            "severity": "CASE p_size % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END",
        },
    ),
    "calls": (
        "conversations",
        "TRUE",
        {
            "conv_id": "CAST(conv_id AS BIGINT)",
            "turn": "CAST(turn AS BIGINT)",
            "model": "CASE conv_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'tiny' END",
            "operation": "role",
            "phase": "CASE WHEN turn % 2 = 0 THEN 'discovery' ELSE 'verification' END",
            "latency_ms": "CAST(length(text) AS BIGINT)",
            "success": "turn % 5 <> 3",
            "cached": "turn % 4 = 2",
        },
    ),
    "functions": (
        "customer",
        "TRUE",
        {
            "file_path": "'mod' || CAST(c_custkey % 7 AS STRING) || '/' || CASE WHEN c_custkey % 11 = 0 THEN 'test_' ELSE 'f' END || CAST(c_custkey AS STRING) || '.py'",
            "name": "'handle_' || CASE c_custkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'purchase' WHEN 2 THEN 'error' WHEN 3 THEN 'signup' ELSE 'view' END",
            "first_line": "CAST(c_custkey % 120 + 1 AS INT)",
            "last_line": "CAST(c_custkey % 120 + 61 AS INT)",
            "body": "CASE c_custkey % 4 WHEN 0 THEN 'x = escape(param)' WHEN 1 THEN 'check_permission(user); run()' WHEN 2 THEN 'verify_nonce(x); check_permission(y)' ELSE 'return x' END",
            "c_custkey": "c_custkey",
        },
    ),
    "hunks": (
        "customer",
        "TRUE",
        {
            "file_path": "'mod' || CAST(c_custkey % 7 AS STRING) || '/' || CASE WHEN c_custkey % 11 = 0 THEN 'test_' ELSE 'f' END || CAST(c_custkey AS STRING) || '.py'",
            "first_line": "CAST(c_custkey % 30 + 1 AS INT)",
            "line_count": "CAST(c_custkey % 90 + 40 AS INT)",
            "commit_id": "CAST(c_custkey * 3 AS BIGINT)",
        },
    ),
    "sources": (
        "customer",
        "TRUE",
        {
            "path": "'mod' || CAST(c_custkey % 7 AS STRING) || '/' || CASE WHEN c_custkey % 11 = 0 THEN 'test_' ELSE 'f' END || CAST(c_custkey AS STRING) || '.py'",
            "text": "'import os' || chr(10) || 'x = 1' || chr(10) || '  execute(sql + param)' || chr(10) || repeat('y = ' || CAST(c_custkey AS STRING) || chr(10), CAST(c_custkey % 90 AS INT))",
        },
    ),
    "replies": (
        "documents",
        "TRUE",
        {
            "ord": "CAST(doc_id AS BIGINT)",
            "content": """CASE doc_id % 12
                WHEN 0 THEN '{"verification_status": "confirmed", "verification_notes": "ok"}'
                WHEN 1 THEN '```json' || chr(10) || '{"verification_status": "false_positive"}' || chr(10) || '```'
                WHEN 2 THEN '[{"verification_status": "confirmed", "verification_notes": "first"}, {"verification_status": "false_positive"}]'
                WHEN 3 THEN '[{"triage_verdict": "false_positive"}]'
                WHEN 4 THEN 'not json at all'
                WHEN 5 THEN '{"verification_status": 5}'
                WHEN 6 THEN '{"verification_notes": "no status"}'
                WHEN 7 THEN '[]'
                WHEN 8 THEN '["text"]'
                WHEN 9 THEN '{"verification_status": "odd", "verification_notes": null}'
                WHEN 10 THEN '{"verification_status": "confirmed", "verification_notes": 7}'
                ELSE '[{"verification_status": 3, "triage_verdict": "confirmed", "verification_notes": "x"}]' END""",
        },
    ),
    "triage_files": (
        "documents",
        "TRUE",
        {
            "batch": "CAST(floor(doc_id / 8) AS BIGINT)",
            "path": "'d' || CAST(doc_id AS STRING) || '.py'",
            "analysed": "doc_id % 9 = 0",
            "suspicion": "CAST(CASE WHEN doc_id % 3 = 0 OR (doc_id >= 80 AND doc_id < 160 AND doc_id % 8 < 6) THEN NULL ELSE (doc_id % 11) / 10.0 END AS DOUBLE)",
            "broken": "floor(doc_id / 8) % 7 = 3",
        },
    ),
    "patches": (
        "part",
        "TRUE",
        {
            "ord": "CAST(p_partkey AS BIGINT)",
            "patch": """'--- a/' || CASE p_partkey % 6 WHEN 0 THEN 'src/crypto/aes.c' WHEN 1 THEN 'lib/database.py' WHEN 2 THEN 'web/http.js' WHEN 3 THEN 'net/socket.c' WHEN 4 THEN 'login.php' ELSE 'main.c' END
                || chr(10) || '+++ b/x' || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || CASE p_partkey % 7
                WHEN 0 THEN '-cursor.execute(format(sql))' || chr(10) || '+cursor.prepare(sql, parameter)'
                WHEN 1 THEN '-el.innerHTML = x' || chr(10) || '+el.textContent = escape(x)'
                WHEN 2 THEN '-strcpy(a, b)' || chr(10) || '+strncpy(a, b, length)'
                WHEN 3 THEN '-free(p)' || chr(10) || '+free(p); p = NULL'
                WHEN 4 THEN '-path.join(base, name)' || chr(10) || '+canonicalize(base)'
                WHEN 5 THEN '-old line number ' || CAST(p_partkey AS STRING) || chr(10) || '+new line number ' || CAST(p_partkey AS STRING) || repeat(' more', CAST(p_size AS INT))
                ELSE '+only added' END
                || CASE WHEN p_partkey % 4 = 0 THEN chr(10) || '@@ -9,1 +9,1 @@' || chr(10) || ' context' || chr(10) || '-check nothing' || chr(10) || '+validate(x); sanitize(x)' ELSE '' END""",
        },
    ),
    "rule_lines": (
        "part",
        "TRUE",
        {
            "ord": "CAST(p_partkey AS BIGINT)",
            "line": "CASE p_partkey % 8 WHEN 0 THEN 'PATTERN p1 CWE-89 return -> query[0] HIGH' WHEN 1 THEN '  PATTERN p2  CWE-79 param[1] -> echo[1] MEDIUM trailing' WHEN 2 THEN 'PATTERN p3 CWE-78 param[x] -> exec[0] LOW' WHEN 3 THEN 'PATTERN p4 CWE-78 return exec[0] LOW' WHEN 4 THEN 'PATTERN p5 CWE-78 param[0] -> exec CRITICAL' WHEN 5 THEN 'PATTERN p6 CWE-22 param[0] -> open[2] CRITICAL' WHEN 6 THEN 'PATTERN p7 CWE-22 param[0] -> open[0] SEVERE' ELSE 'pattern p8 CWE-22 return -> open[0] LOW' END",
            "code": "CASE p_size % 7 WHEN 0 THEN 'query(a, b)' WHEN 1 THEN 'echo ( x )' WHEN 2 THEN 'echo(a, b, c)' WHEN 3 THEN 'open()' WHEN 4 THEN 'open( name )' WHEN 5 THEN 'echo(a' ELSE 'nothing here' END",
        },
    ),
    "verdicts": (
        "conversations",
        "TRUE",
        {
            "batch": "CAST(conv_id AS BIGINT)",
            "position": "CAST(turn AS BIGINT)",
            "idx": "CASE WHEN conv_id % 4 = 0 THEN NULL ELSE CAST((turn * 2) % 5 AS BIGINT) END",
            "status": "CASE (conv_id + turn) % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'false_positive' WHEN 2 THEN 'needs_review' ELSE '' END",
        },
    ),
}
_ON_SPARK = {"findings": {"sources": "split(sources_csv, ',')", "evidence": "split(evidence_csv, ',')", "id": "sha2(seed, 256)"}, "findings_small": {}}
_ON_DUCK = {"findings": {"sources": "string_split(sources_csv, ',')", "evidence": "string_split(evidence_csv, ',')", "id": "sha256(seed)"}}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "findings_small":
        return view(spark, sf_dir, "findings").filter("ord % 20 = 0")
    if name == "suppressed":
        return view(spark, sf_dir, "suppressed_rows").distinct()
    if name == "lines":
        return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text")).select("doc_id", (F.col("k") + 1).cast("long").alias("line_no"), "text")
    if name == "edges":
        n = spark.read.parquet(f"{sf_dir}/nation.parquet")
        a = n.selectExpr("CAST(n_nationkey AS BIGINT) AS a", "CAST((3 * n_nationkey + 1) % 25 AS BIGINT) AS b")
        return a.union(n.selectExpr("CAST(n_nationkey AS BIGINT) AS a", "CAST((n_nationkey + n_regionkey + 2) % 25 AS BIGINT) AS b")).distinct()
    table, where, columns = VIEWS[name]
    out = spark.read.parquet(f"{sf_dir}/{table}.parquet").filter(where).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
    for c, e in _ON_SPARK.get(name, {}).items():
        out = out.withColumn(c, F.expr(e))
    return out


def ctes(*names: str) -> str:
    """The views as common table expressions for DuckDB, WITH included."""
    out = []
    for name in names:
        if name == "findings_small":
            out.append("findings_small AS (SELECT * FROM findings WHERE ord % 20 = 0)")
        elif name == "suppressed":
            out.append("suppressed AS (SELECT DISTINCT * FROM suppressed_rows)")
        elif name == "lines":
            out.append("lines AS (SELECT doc_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS BIGINT) AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents)")
        elif name == "edges":
            out.append("edges AS (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST((3 * n_nationkey + 1) % 25 AS BIGINT) AS b FROM nation UNION SELECT CAST(n_nationkey AS BIGINT), CAST((n_nationkey + n_regionkey + 2) % 25 AS BIGINT) FROM nation)")
        else:
            table, where, columns = VIEWS[name]
            out.append(f"{name}_0 AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table} WHERE {where})")
            more = "".join(f", {e} AS {c}" for c, e in _ON_DUCK.get(name, {}).items())
            out.append(f"{name} AS (SELECT *{more} FROM {name}_0)")
    return "WITH " + ",\n".join(out)
