"""Queries of projects, proofs, routes, reports, dependencies, feeds, health and the rest of enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fixtures import ctes, view
from .functions import project, scoring, verdict
from .operators import enrichment, history
from .queries import AS_OF, ANALYSED, TIER, analysed
from .registry import query

FIND = ctes("findings")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def first_of(column: str, kinds) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(column, words)} THEN {quoted(kind)}" for kind, words in kinds) + " END"


MANIFEST = "CASE doc_id % 9 WHEN 0 THEN '[dependencies] CLAP = 4' WHEN 1 THEN 'axum = 1' WHEN 2 THEN '[lib] name' WHEN 3 THEN 'nothing' WHEN 4 THEN 'stm32 and tauri' ELSE NULL END"
PACKAGE = "CASE doc_id % 5 WHEN 0 THEN '{\"bin\": 1}' WHEN 1 THEN '{\"react\": 1, \"main\": 2}' WHEN 2 THEN '{\"types\": 1}' WHEN 3 THEN '{}' ELSE NULL END"


@query("f63_project_types", f"SELECT doc_id, coalesce({first_of('c', project.CARGO_KINDS)}, {first_of('p', project.PACKAGE_KINDS)}, 'unknown') AS kind FROM (SELECT doc_id, lower({MANIFEST}) AS c, {PACKAGE} AS p FROM documents)")
def f63(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", project.project_type(F.expr(MANIFEST), F.expr(PACKAGE)).alias("kind"))


EXPECT = "CASE doc_id % 6 WHEN 0 THEN 'Reads a FILE' WHEN 1 THEN 'leaks a token' WHEN 2 THEN 'crash or shell' WHEN 3 THEN '' WHEN 4 THEN 'network request' ELSE 'root' END"
OUTPUT = "CASE doc_id % 7 WHEN 0 THEN 'No such file' WHEN 1 THEN 'api_key=1' WHEN 2 THEN 'SIGSEGV' WHEN 3 THEN 'bash: x' WHEN 4 THEN 'listening :8080' WHEN 5 THEN 'uid=0' ELSE 'fine' END"
SHOWN = " OR ".join(f"({any_of('e', project.EXPECTED[k])} AND regexp_matches(o, {quoted('|'.join(v))}))" for k, v in project.SHOWN.items())


@query(
    "f60_behaviours",
    f"""SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {any_of('e', words)} THEN '{k}' END" for k, words in project.EXPECTED.items())}], lambda x: x IS NOT NULL), ',') AS categories, NOT ({' OR '.join(any_of('e', w) for w in project.EXPECTED.values())}) OR {SHOWN} AS shown FROM (SELECT doc_id, lower({EXPECT}) AS e, lower({OUTPUT} || ' ') AS o FROM documents)""",
)
def f60(spark, sf):
    e = F.expr(EXPECT)
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.array_join(project.expected_categories(e), ",").alias("categories"), project.shows_expected(F.expr(OUTPUT), F.lit(None).cast("string"), e).alias("shown"))


LANGS = "CASE doc_id % 6 WHEN 0 THEN 'c,Rust' WHEN 1 THEN 'PHP' WHEN 2 THEN 'typescript,python' WHEN 3 THEN 'cobol' WHEN 4 THEN 'Java,go' ELSE '' END"
HUNT = " || ".join(f"CASE WHEN len(list_intersect(l, [{', '.join(map(quoted, langs))}])) > 0 THEN [{', '.join(map(quoted, domains))}] ELSE [] END" for langs, domains in project.HUNTED)


@query("f38_hunt_domains", f"SELECT doc_id, array_to_string(list_sort(CASE WHEN len(d) > 0 THEN list_distinct(d) ELSE ['injection', 'auth'] END), ',') AS domains FROM (SELECT doc_id, {HUNT} AS d FROM (SELECT doc_id, string_split(lower({LANGS}), ',') AS l FROM documents))")
def f38(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.array_join(project.hunt_domains(F.split(F.expr(LANGS), ",")), ",").alias("domains"))


TITLE = "CASE ord % 10 WHEN 0 THEN 'SQL in login' WHEN 1 THEN 'Shell call' WHEN 2 THEN 'Stored XSS' WHEN 3 THEN 'Heap overflow' WHEN 4 THEN 'UAF in free' WHEN 5 THEN 'NULL pointer' WHEN 6 THEN 'Bad format' WHEN 7 THEN 'fn parse( & x )' WHEN 8 THEN ' ( lead' ELSE title END"
ADVISED = "CASE " + " ".join(f"WHEN {any_of('low', words)} THEN {quoted(advice)}" for words, advice in project.ADVICE) + " WHEN contains(about, 'user') AND contains(about, 'input') THEN 'Validate and sanitize all user input before use' WHEN contains(about, 'untrusted') THEN 'Treat all external data as untrusted. Apply strict validation and encoding' ELSE 'Review and fix this ' || t || ' vulnerability. Follow secure coding practices for this category' END"


@query("f47_recommendations", f"{FIND} SELECT ord, {ADVISED} AS advice FROM (SELECT ord, {TITLE} AS t, lower({TITLE}) AS low, lower(description) AS about FROM findings)")
def f47(spark, sf):
    return view(spark, sf, "findings").select("ord", project.recommendation(F.expr(TITLE), F.col("description")).alias("advice"))


@query("f29_entry_points", f"{FIND} SELECT ord, list_filter(list_transform(regexp_split_to_array(t, '[( ]'), lambda x: trim(x)), lambda x: x <> '' AND x <> '&')[1] AS token FROM (SELECT ord, {TITLE} AS t FROM findings)")
def f29(spark, sf):
    return view(spark, sf, "findings").select("ord", project.entry_point(F.expr(TITLE)).alias("token"))


@query(
    "f28_function_names",
    f"{FIND} SELECT ord, coalesce({', '.join(f'''CASE WHEN regexp_extract(t, '{p}', 1) NOT IN ('', {', '.join(map(quoted, project.NO_NAMES))}) THEN regexp_extract(t, '{p}', 1) END''' for p in project.NAMED)}) AS name FROM (SELECT ord, coalesce(code_snippet, {TITLE}) AS t FROM findings)",
)
def f28(spark, sf):
    return view(spark, sf, "findings").select("ord", project.function_name(F.col("code_snippet"), F.expr(TITLE)).alias("name"))


CWES = "CASE ord % 5 WHEN 0 THEN ' CWE-79 ' WHEN 1 THEN '89' WHEN 2 THEN 'cwe-78' WHEN 3 THEN 'Other 5' ELSE '' END"


@query("f36_normal_cwes", f"{FIND} SELECT ord, CASE WHEN regexp_full_match(c, '[0-9]*') THEN 'cwe-' || c ELSE c END AS cwe FROM (SELECT ord, lower(trim({CWES})) AS c FROM findings)")
def f36(spark, sf):
    return view(spark, sf, "findings").select("ord", project.normal_cwe(F.expr(CWES)).alias("cwe"))


PATHS = "CASE ord % 7 WHEN 0 THEN 'src/a.PNG' WHEN 1 THEN 'node_modules/x.js' WHEN 2 THEN 'a/dist/b.py' WHEN 3 THEN 'src/main.rs' WHEN 4 THEN 'Cargo.lock' WHEN 5 THEN '.git/config' ELSE 'distx/y.c' END"


@query("p16_variant_files", f"{ctes('files')} SELECT ord FROM (SELECT ord, {PATHS} AS p FROM files) WHERE lower(regexp_extract(p, '[^/][.]([^./]*)$', 1)) NOT IN ({', '.join(map(quoted, project.BINARY_EXTENSIONS))}) AND NOT regexp_matches(p, '(^|/)(target|node_modules|[.]git|dist|build)/')")
def p16(spark, sf):
    return view(spark, sf, "files").filter(project.searched_for_variants(F.expr(PATHS))).select("ord")


@query("p17_similar_variants", f"{ctes('files')} SELECT ord FROM files WHERE round((ord % 21) / 20.0, 6) >= 0.5")
def p17(spark, sf):
    return view(spark, sf, "files").filter(F.round((F.col("ord") % 21) / 20.0, 6) >= 0.5).select("ord")


@query(
    "f62_variant_patterns",
    r"SELECT ord, p AS pattern, regexp_matches(c, p) AS hit FROM (SELECT ord, code AS c, replace(replace(replace(replace(replace(replace(replace(replace(code, '.', '\.'), '*', '.*'), '+', '\+'), '?', '\?'), '(', '\('), ')', '\)'), '[', '\['), ']', '\]') AS p FROM (SELECT p_partkey AS ord, CASE p_partkey % 4 WHEN 0 THEN 'f(a[0])' WHEN 1 THEN 'x.y + z?' WHEN 2 THEN 'a*b' ELSE 'plain' END AS code FROM part))",
)
def f62(spark, sf):
    code = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'f(a[0])' WHEN 1 THEN 'x.y + z?' WHEN 2 THEN 'a*b' ELSE 'plain' END")
    out = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("ord"), project.variant_pattern(code).alias("pattern"), code.alias("c"))
    return out.select("ord", "pattern", F.rlike("c", F.col("pattern")).alias("hit"))


URLS = "CASE ord % 6 WHEN 0 THEN 'git@host.org:own/er.git' WHEN 1 THEN 'https://host.org/a/b.GIT?x=1#f' WHEN 2 THEN 'http://h/a/b/c' WHEN 3 THEN 'ssh://x/y' WHEN 4 THEN 'https://host/only' ELSE NULL END"


@query(
    "f46_owner_repo",
    f"""{FIND}, u AS (SELECT ord, CAST(ord AS STRING) || 'abcdef123' AS c, regexp_replace({URLS}, '[?#].*$', '') AS u FROM findings), o AS (SELECT ord, c, CASE WHEN u LIKE 'git@%' THEN regexp_extract(u, '^git@[^:]*:([^/]*)/(.*)$', 1) ELSE regexp_extract(u, '^https?://[^/]*/([^/]*)/([^/]*)', 1) END AS owner,
regexp_replace(CASE WHEN u LIKE 'git@%' THEN regexp_extract(u, '^git@[^:]*:([^/]*)/(.*)$', 2) ELSE regexp_extract(u, '^https?://[^/]*/([^/]*)/([^/]*)', 2) END, '(?i)[.]git$', '') AS repo FROM u)
SELECT ord, nullif(owner, '') AS owner, CASE WHEN owner <> '' THEN repo END AS repo, CASE WHEN owner <> '' THEN 'https://github.com/' || owner || '/' || repo || '/commit/' || substr(c, 1, 7) ELSE c || ':me:msg' END AS reference FROM o""",
)
def f46(spark, sf):
    url = F.expr(URLS)
    commit = F.concat(F.col("ord").cast("string"), F.lit("abcdef123"))
    o = project.owner_repo(url)
    return view(spark, sf, "findings").select("ord", o["owner"].alias("owner"), o["repo"].alias("repo"), project.commit_reference(url, commit, F.lit("me"), F.lit("msg")).alias("reference"))


SIGNALS = "CASE ord % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail,pass' WHEN 2 THEN 'sanitizer_crash' WHEN 3 THEN 'coverage_increase' ELSE '' END"
CHANNELS = "CASE ord % 3 WHEN 0 THEN 'coverage' WHEN 1 THEN 'text' ELSE 'outcome,text' END"


@query(
    "v13_rewrites",
    f"{FIND} SELECT ord, ord % 4 = 0 OR contains(s, 'fail') OR (regexp_matches(c, 'coverage|sanitizer|outcome') AND NOT contains(s, 'pass') AND NOT contains(s, 'sanitizer_crash')) AS rewrite FROM (SELECT ord, {SIGNALS} AS s, {CHANNELS} AS c FROM findings)",
)
def v13(spark, sf):
    return view(spark, sf, "findings").select("ord", project.should_rewrite(F.col("ord") % 4 != 0, F.split(F.expr(SIGNALS), ","), F.split(F.expr(CHANNELS), ",")).alias("rewrite"))


@query("v10_confirmed_exploits", f"{FIND} SELECT ord, CASE WHEN ord % 3 = 0 THEN 'kill' ELSE 'pass' END AS triage FROM findings")
def v10(spark, sf):
    return view(spark, sf, "findings").select("ord", verdict.exploit_confirmed(F.when(F.col("ord") % 3 == 0, "kill")).alias("triage"))


@query("v11_compiled_proofs", f"{FIND} SELECT ord, CASE WHEN ord % 3 = 0 THEN 'confirmed' ELSE 'failed' END AS status, CASE WHEN ord % 3 = 0 THEN 'PoC compiled successfully' ELSE 'PoC compilation failed: ' || CASE WHEN ord % 2 = 0 THEN 'bad' ELSE '' END END AS note FROM findings")
def v11(spark, sf):
    return view(spark, sf, "findings").select("ord", verdict.compiled(F.col("ord") % 3 == 0, F.when(F.col("ord") % 2 == 0, "bad")).alias("v")).select("ord", "v.*")


@query("m14_adjusted_confidence", f"{FIND} SELECT ord, round(greatest(0, least(1, confidence_score + (ord % 9 - 4) / 10.0)), 6) AS score FROM findings")
def m14(spark, sf):
    return view(spark, sf, "findings").select("ord", F.round(enrichment.adjusted(F.col("confidence_score"), (F.col("ord") % 9 - 4) / 10.0), 6).alias("score"))


@query("p2_tagged_tiers", f"{FIND} SELECT ord, CASE WHEN ord % 4 = 0 THEN 'verified' ELSE {TIER} END AS tier FROM findings")
def p2(spark, sf):
    f = view(spark, sf, "findings").withColumn("verification_tier", F.when(F.col("ord") % 4 == 0, "verified"))
    return enrichment.tagged(f, scoring.tier(F.col("evidence"), F.col("confidence_score"))).select("ord", F.col("verification_tier").alias("tier"))


@query("p3_kept_and_rejected", f"{FIND} SELECT ord, CASE WHEN verification_status = 'false_positive' THEN 'rejected' ELSE 'kept' END AS side, CASE WHEN verification_status = 'false_positive' THEN coalesce(verification_notes, 'false positive') END AS reason FROM findings")
def p3(spark, sf):
    return enrichment.split(view(spark, sf, "findings")).select("ord", "side", "reason")


@query("j15_proofs", f"{FIND}, p AS (SELECT 'x' || CAST(ord % 500 AS STRING) AS fid, arg_max('code ' || CAST(ord AS STRING), ord) AS code, arg_max(CASE WHEN ord % 2 = 0 THEN 'python' ELSE 'go' END, ord) AS fmt FROM findings WHERE ord % 3 <> 0 GROUP BY 1) SELECT ord, code AS poc_code, fmt AS poc_format FROM findings LEFT JOIN p ON fid = 'x' || CAST(ord AS STRING)")
def j15(spark, sf):
    f = view(spark, sf, "findings")
    proofs = f.filter("ord % 3 <> 0").select(F.concat(F.lit("x"), (F.col("ord") % 500).cast("string")).alias("finding_id"), "ord", F.concat(F.lit("code "), F.col("ord").cast("string")).alias("code"), F.when(F.col("ord") % 2 == 0, "Python").otherwise("Go").alias("format"))
    return enrichment.with_proofs(f.withColumn("id", F.concat(F.lit("x"), F.col("ord").cast("string"))), proofs).select("ord", "poc_code", "poc_format")


TEMPLATES = [("CWE-79", "Python", "t1"), ("CWE-79", "Rust", "t2"), ("CWE-89", "Python", "t3"), ("CWE-89", "Rust", "t4"), ("CWE-121", "Go", "t5"), ("CWE-287", "Rust", "t6")]


@query(
    "j16_templates",
    f"""{FIND}, t(cwe, fmt, code) AS (VALUES {', '.join(str(t) for t in TEMPLATES)}), f AS (SELECT ord, cwe_id, CASE ord % 3 WHEN 0 THEN 'injection' WHEN 1 THEN 'memory_corruption' ELSE 'other' END AS cat FROM findings), a AS (SELECT ord, cwe_id, unnest(['Rust', 'Go']) AS asked FROM f WHERE cwe_id IS NOT NULL)
SELECT ord, coalesce(x.fmt, y.fmt) AS format, coalesce(x.code, y.code) AS code FROM a LEFT JOIN t x ON x.cwe = cwe_id AND x.fmt = asked LEFT JOIN t y ON y.cwe = cwe_id AND y.fmt = 'Python' WHERE coalesce(x.code, y.code) IS NOT NULL
UNION ALL SELECT ord, fmt, code FROM f JOIN t ON fmt = 'Rust' AND cwe = CASE cat WHEN 'injection' THEN 'CWE-89' WHEN 'memory_corruption' THEN 'CWE-121' END WHERE cwe_id IS NULL""",
)
def j16(spark, sf):
    f = view(spark, sf, "findings").withColumn("category", F.when(F.col("ord") % 3 == 0, "injection").when(F.col("ord") % 3 == 1, "memory_corruption").otherwise("other"))
    return enrichment.templated(f, spark.createDataFrame(TEMPLATES, "cwe_id string, format string, code string"), ["Rust", "Go"])


@query("j18_routes", f"{FIND} SELECT ord, CASE ord % 4 WHEN 0 THEN 'own' WHEN 1 THEN 'small' ELSE 'any' END AS model FROM findings")
def j18(spark, sf):
    f = view(spark, sf, "findings").withColumn("domain", F.when(F.col("ord") % 4 == 0, "crypto").when(F.col("ord") % 4 == 1, "web").otherwise("x"))
    return enrichment.routed(f, {"crypto": "large", "web": "small"}, spark.createDataFrame([("crypto", "own")], "domain string, model string"), "any").select("ord", "model")


@query("j27_originals", f"{FIND} SELECT u.ord, string_agg(f.id, ',' ORDER BY f.ord) AS originals FROM findings u JOIN findings f ON f.file_path = u.file_path AND f.line_number IS NOT DISTINCT FROM u.line_number GROUP BY 1")
def j27(spark, sf):
    f = view(spark, sf, "findings")
    return enrichment.originals(f.select("ord", "file_path", "line_number"), f).select("ord", F.array_join("originals", ",").alias("originals"))


DEPS = "CASE s_suppkey % 3 WHEN 0 THEN 'v' || CAST(s_suppkey % 10 AS STRING) || '/p' || CAST(s_suppkey % 5 AS STRING) WHEN 1 THEN 'v' || CAST(s_suppkey % 10 AS STRING) || '-x' ELSE 'solo' END"


@query(
    "j24_dependency_cves",
    f"""{ctes('cves')}, d AS (SELECT DISTINCT {DEPS} AS name FROM supplier), k AS (SELECT name, CASE WHEN contains(name, '/') THEN split_part(name, '/', 1) ELSE split_part(name, '-', 1) END AS vendor, CASE WHEN contains(name, '/') THEN split_part(name, '/', 2) ELSE name END AS product FROM d),
c AS (SELECT cve_id, ord, 'v' || CAST(ord % 10 AS STRING) AS vendor, CASE WHEN ord % 2 = 0 THEN 'p' || CAST(ord % 5 AS STRING) ELSE 'v' || CAST(ord % 10 AS STRING) || '-x' END AS product FROM cves), r AS (SELECT name, cve_id, row_number() OVER (PARTITION BY name ORDER BY ord) AS n FROM k JOIN c USING (vendor, product)) SELECT name, cve_id FROM r WHERE n <= 20""",
)
def j24(spark, sf):
    vendor = F.concat(F.lit("v"), (F.col("ord") % 10).cast("string"))
    cves = view(spark, sf, "cves").select("cve_id", "ord", vendor.alias("vendor"), F.when(F.col("ord") % 2 == 0, F.concat(F.lit("p"), (F.col("ord") % 5).cast("string"))).otherwise(F.concat(vendor, F.lit("-x"))).alias("product"))
    return enrichment.dependency_cves(spark.read.parquet(f"{sf}/supplier.parquet").select(F.expr(DEPS).alias("name")), cves, 20)


@query("s14_nvd_feed", f"{ctes('cves')} SELECT cve_id, description, CASE WHEN ord % 5 = 0 THEN 'medium' ELSE severity END AS severity, CASE WHEN cwe_id IS NULL THEN '' ELSE cwe_id END AS cwe_ids FROM (SELECT *, row_number() OVER (PARTITION BY ord // 300 ORDER BY ord) AS n FROM cves WHERE ord // 300 <> 2) WHERE n <= 100")
def s14(spark, sf):
    c = view(spark, sf, "cves").withColumn("k", F.floor(F.col("ord") / 300))
    severity = F.array(F.struct(F.when(F.col("ord") % 5 == 0, "odd").otherwise(F.upper("severity")).alias("severity")))
    entry = F.struct("ord", F.col("cve_id").alias("id"), F.array(F.struct(F.col("description").alias("value"))).alias("descriptions"), F.struct(severity.alias("cvssMetricV31")).alias("metrics"), F.array(F.struct(F.array(F.struct(F.col("cwe_id").alias("value")), F.struct(F.lit("other").alias("value"))).alias("descriptions"))).alias("problemTypes"))
    feed = c.groupBy("k").agg(F.when(F.col("k") == 2, "broken {").otherwise(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("vulnerabilities")))).alias("json"))
    return enrichment.nvd_rows(feed).select("cve_id", "description", "severity", F.array_join("cwe_ids", ",").alias("cwe_ids"))


@query("s13_kev_feed", f"{ctes('cves')} SELECT cve_id, description, '2024-01-01' AS published FROM cves WHERE src = 'KEV'")
def s13(spark, sf):
    entry = F.struct(F.col("cve_id").alias("cveID"), F.col("description").alias("shortDescription"), F.lit("2024-01-01").alias("dateAdded"))
    feed = view(spark, sf, "cves").filter("src = 'KEV'").agg(F.to_json(F.struct(F.collect_list(entry).alias("vulnerabilities"))).alias("json"))
    return enrichment.kev_rows(feed).select("cve_id", "description", "published")


@query("s16_stacks", f"{ctes('files')} SELECT CASE WHEN bool_or(path = 'package.json') THEN 'JavaScript,' ELSE '' END || CASE WHEN bool_or(path LIKE '%.php') THEN 'PHP' ELSE '' END AS languages, CASE WHEN bool_or(path LIKE 'wp-content/%') THEN 'WordPress' ELSE '' END AS frameworks FROM (SELECT CASE WHEN ord = 7 THEN 'package.json' WHEN ord = 8 THEN 'wp-content/x.css' ELSE path END AS path FROM files)")
def s16(spark, sf):
    f = view(spark, sf, "files").withColumn("path", F.when(F.col("ord") == 7, "package.json").when(F.col("ord") == 8, "wp-content/x.css").otherwise(F.col("path")))
    return enrichment.stack(f).select(F.array_join("languages", ",").alias("languages"), F.array_join("frameworks", ",").alias("frameworks"))


SOME = f"SELECT {', '.join(f'coalesce(bool_or({any_of(chr(108), tuple(w.lower() for w in words))}), FALSE) AS {name}' for name, words in project.COMPONENTS.items())} FROM (SELECT lower(text) AS l FROM (SELECT text, 'd' || CAST(doc_id AS STRING) AS path FROM documents ORDER BY path LIMIT 100))"


@query("a35_components", SOME)
def a35(spark, sf):
    return enrichment.component_flags(spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text"))


@query(
    "a17_scan_health",
    f"{ctes('calls', 'triage_files')}, p AS (SELECT phase, arg_max(status, ord) AS status FROM (SELECT 'llm_' || phase AS phase, CASE WHEN success THEN 'run' WHEN turn % 2 = 0 THEN 'failed' ELSE 'skipped' END AS status, conv_id * 1000 + turn AS ord FROM calls) GROUP BY 1) SELECT (SELECT count(*) FILTER (WHERE status = 'run') FROM p) AS run, (SELECT count(*) FILTER (WHERE status = 'skipped') FROM p) AS skipped, (SELECT count(*) FILTER (WHERE status = 'failed') FROM p) AS failed, FALSE AS all_llm_skipped, count(*) AS indexed, count(*) FILTER (WHERE analysed) AS analyzed, count(*) FILTER (WHERE analysed) = 0 AS blind FROM triage_files",
)
def a17(spark, sf):
    calls = view(spark, sf, "calls").select(F.concat(F.lit("llm_"), "phase").alias("phase"), F.when(F.col("success"), "run").when(F.col("turn") % 2 == 0, "failed").otherwise("skipped").alias("status"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    return enrichment.health(calls, view(spark, sf, "triage_files"))


MODIFIED = f"""{ANALYSED}, g AS (SELECT author_id, count(*) AS n, count(*) FILTER (WHERE security_fix) AS ns, count(*) FILTER (WHERE len(cwe_refs) > 0) AS nc, count(*) FILTER (WHERE date_diff('day', day, DATE '{AS_OF}') < 30 AND security_fix) AS nr, sum(n_patterns) AS np, sum(risk) AS risk FROM c GROUP BY 1), w AS (SELECT c_custkey AS author_id, g.* EXCLUDE (author_id) FROM customer LEFT JOIN g ON g.author_id = c_custkey)"""


@query(
    "a21_git_modifiers",
    f"""{MODIFIED} SELECT author_id, 'git_history' AS source, CAST(-0.1 AS DOUBLE) AS modifier, 'No git history available' AS reason FROM w WHERE n IS NULL UNION ALL SELECT author_id, 'security_commits', round(least(ns * 0.05, 0.2), 6), 'Found ' || ns || ' security-related commits' FROM w WHERE ns > 0
UNION ALL SELECT author_id, 'recent_security_fixes', 0.1, 'Recent security fixes indicate active security maintenance' FROM w WHERE nr > 0 UNION ALL SELECT author_id, 'cwe_references', round(least(nc * 0.05, 0.15), 6), 'Commits reference CWE vulnerabilities' FROM w WHERE nc > 0
UNION ALL SELECT author_id, 'active_development', 0.05, 'Active development history (good for finding related fixes)' FROM w WHERE n > 10""",
)
def a21(spark, sf):
    groups = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("author_id"))
    return enrichment.git_modifiers(analysed(spark, sf), groups, "author_id", AS_OF).withColumn("modifier", F.round("modifier", 6))


@query("a20_git_confidence_of_all", f"{MODIFIED} SELECT author_id, CASE WHEN n IS NULL THEN CAST(0.3 AS DOUBLE) ELSE round(greatest(0.0, least(1.0, 0.5 + least(ns * 0.05, 0.2) + least(nc * 0.05, 0.15) + least(np * 0.03, 0.15) - least(risk * 0.1, 0.3))), 6) END AS overall FROM w")
def a20_all(spark, sf):
    groups = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("author_id"))
    known = history.confidence(analysed(spark, sf), "author_id", AS_OF)
    return groups.join(known, "author_id", "left").select("author_id", F.coalesce(F.round("overall", 6), F.lit(0.3)).alias("overall"))


@query("u4_merged_threats", "SELECT CAST(n_nationkey AS BIGINT) AS project, CAST(greatest(n_nationkey % 7, CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey * 2 END) AS BIGINT) AS total_threats, array_to_string(list_sort(list_distinct(['a' || n_regionkey, 'z'] || CASE WHEN n_nationkey % 3 = 0 THEN ['m', 'z'] ELSE [] END)), ',') AS areas FROM nation")
def u4(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    area = F.concat(F.lit("a"), F.col("n_regionkey").cast("string"))
    new = n.select(F.col("n_nationkey").cast("long").alias("project"), (F.col("n_nationkey") % 7).cast("long").alias("total_threats"), F.array(area, F.lit("z")).alias("high_risk_areas"))
    old = n.filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").cast("long").alias("project"), (F.col("n_regionkey") * 2).cast("long").alias("total_threats"), F.array(F.lit("m"), F.lit("z")).alias("high_risk_areas"))
    return enrichment.merged_threats(new, old).select("project", "total_threats", F.array_join("high_risk_areas", ",").alias("areas"))


@query("u7_more_findings", f"{FIND} SELECT ord, title, file_path FROM findings UNION ALL SELECT ord + 1000000, 'Variant of ' || title, NULL FROM findings WHERE ord % 50 = 0")
def u7(spark, sf):
    f = view(spark, sf, "findings").select("ord", "title", "file_path")
    more = f.filter("ord % 50 = 0").select((F.col("ord") + 1000000).alias("ord"), F.concat(F.lit("Variant of "), "title").alias("title"))
    return enrichment.with_more(f, more)


@query("a34_findings_per_file", f"{FIND} SELECT file_path, count(*) AS n, string_agg(DISTINCT CASE WHEN severity IN ('low', 'info') THEN 'low' ELSE severity END, ',' ORDER BY CASE WHEN severity IN ('low', 'info') THEN 'low' ELSE severity END) AS classes FROM findings GROUP BY 1")
def a34(spark, sf):
    return view(spark, sf, "findings").groupBy("file_path").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("severity").isin("low", "info"), "low").otherwise(F.col("severity")))), ",").alias("classes"))


@query("o12_breakdown", f"{FIND}, c AS (SELECT severity, count(*) AS n FROM findings GROUP BY 1) SELECT severity, n, CAST(row_number() OVER (ORDER BY n DESC, severity) AS INT) AS rank FROM c")
def o12(spark, sf):
    from pyspark.sql import Window

    c = view(spark, sf, "findings").groupBy("severity").agg(F.count("*").alias("n"))  # a row for each severity
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "severity")))


@query("j20_first_of_groups", f"{FIND} SELECT file_path, min(ord) AS ord, string_agg(array_to_string(evidence, ','), ',' ORDER BY ord) AS evidence FROM findings GROUP BY 1")
def j20(spark, sf):
    return enrichment.first_of_groups(view(spark, sf, "findings"), ["file_path"]).select("file_path", "ord", F.array_join("evidence", ",").alias("evidence"))


@query(
    "v8_agent_results",
    f"{FIND} SELECT ord, CASE WHEN ord % 3 = 0 THEN 'bin/x' WHEN ord % 3 = 1 THEN 'test/y' WHEN ord % 4 > 0 THEN CAST(ord % 4 AS STRING) || ' turns, 2 tools' END AS path, coalesce(verification_notes, CASE WHEN ord % 2 = 0 THEN 'log' END, 'scaffold') AS notes, CASE WHEN verification_notes IS NULL THEN 'scaffold' ELSE 'Agent verification failed: lost' END AS failed_notes FROM findings",
)
def v8(spark, sf):
    k = F.col("ord")
    f = view(spark, sf, "findings")
    done = enrichment.agent_result(F.col("verification_notes"), F.when(k % 3 == 0, "bin/x"), F.when(k % 3 == 1, "test/y"), k % 4, F.lit(2), F.when(k % 2 == 0, "log"), F.lit("scaffold"))
    return f.select("ord", done.alias("d"), enrichment.agent_failure(F.col("verification_notes"), F.lit("lost"), F.lit("scaffold"))["notes"].alias("failed_notes")).select("ord", "d.*", "failed_notes")


@query("o10_slices", f"{FIND} SELECT file_path AS slice, min(line_number) AS first_line, max(line_number) AS last_line, string_agg(DISTINCT line_number, ',' ORDER BY line_number) AS lines FROM findings WHERE line_number IS NOT NULL GROUP BY 1")
def o10(spark, sf):
    s = enrichment.slices(view(spark, sf, "findings").filter("line_number IS NOT NULL").select(F.col("file_path").alias("slice"), F.col("line_number").alias("line")))
    return s.withColumn("lines", F.array_join(F.transform("lines", lambda x: x.cast("string")), ","))


@query("u8_contexts", f"{FIND} SELECT ord, CASE WHEN title = description THEN title ELSE title || ',' || description END AS context FROM findings")
def u8(spark, sf):
    return view(spark, sf, "findings").select("ord", F.array_join(enrichment.with_context(F.array("title"), F.array("description", "title")), ",").alias("context"))
