"""Findings and what goes with them: proofs, templates, routes, reports, dependencies and their CVEs, stacks, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import project, text

#: The weakness whose template stands for a category.
CATEGORY_WEAKNESS = {"injection": "CWE-89", "memory_corruption": "CWE-121", "authentication_bypass": "CWE-287", "cryptographic_misuse": "CWE-327"}
#: The phases that ask a model.
LLM_PHASES = ("llm_static_analysis", "llm_discovery", "llm_verification", "security_agent_verification")
#: Manifests and the language that they speak of.
MANIFESTS = {"Cargo.toml": "Rust", "package.json": "JavaScript", "requirements.txt": "Python", "go.mod": "Go", "composer.json": "PHP"}
PHP_EXTENSIONS = ("php", "phtml", "php5", "inc")
STACK_DEPTH = 3
UNSCANNED = ("node_modules", "vendor", ".git")


def with_proofs(findings: DataFrame, proofs: DataFrame) -> DataFrame:
    """findings with poc_code and poc_format of their last proof. proofs: finding_id, ord, code, format."""
    last = proofs.groupBy(F.col("finding_id").alias("id")).agg(F.max_by(F.struct("code", "format"), "ord").alias("_p"))
    keep = [c for c in findings.columns if c not in ("poc_code", "poc_format")]
    return findings.select(*keep).join(last, "id", "left").select(*keep, F.col("_p.code").alias("poc_code"), F.lower("_p.format").alias("poc_format"))


def templated(findings: DataFrame, templates: DataFrame, formats: list[str]) -> DataFrame:
    """ord, format, code of the proofs that templates give. templates: cwe_id, format, code. A finding with a weakness takes, for each format, its
    template, else that for Python, else none; one without takes the first format's template of its category's weakness."""
    spark = findings.sparkSession
    wanted = F.explode(F.array(*[F.lit(f) for f in formats])).alias("asked")
    t = templates.select(F.col("cwe_id").alias("t_cwe"), F.col("format").alias("t_format"), F.col("code").alias("t_code"))
    known = findings.filter("cwe_id IS NOT NULL").select("ord", "cwe_id", wanted)
    hits = known.join(t, (F.col("cwe_id") == F.col("t_cwe")) & F.col("t_format").isin(*{*formats, "Python"}))
    fit = F.when(F.col("t_format") == F.col("asked"), 0).when(F.col("t_format") == "Python", 1)
    by_cwe = hits.withColumn("fit", fit).filter("fit IS NOT NULL").groupBy("ord", "asked").agg(F.min_by(F.struct("t_format", "t_code"), "fit").alias("t")).select("ord", F.col("t.t_format").alias("format"), F.col("t.t_code").alias("code"))
    table = F.broadcast(spark.createDataFrame(list(CATEGORY_WEAKNESS.items()), "category string, t_cwe string"))  # four rows
    other = findings.filter("cwe_id IS NULL").select("ord", "category").join(table, "category").join(t.filter(F.col("t_format") == formats[0]), "t_cwe")
    return by_cwe.unionByName(other.select("ord", F.col("t_format").alias("format"), F.col("t_code").alias("code")))


def routed(findings: DataFrame, defaults: dict[str, str], overrides: DataFrame, fallback: str) -> DataFrame:
    """findings (with domain) and the model for them: the override of their domain, else its default, else ``fallback``. overrides: domain, model."""
    spark = findings.sparkSession
    own = spark.createDataFrame(list(defaults.items()) or [("", "")], "domain string, _default string")
    both = findings.join(F.broadcast(own), "domain", "left").join(overrides.select("domain", F.col("model").alias("_model")), "domain", "left")
    return both.withColumn("model", F.coalesce("_model", "_default", F.lit(fallback))).drop("_model", "_default")


def originals(unified: DataFrame, findings: DataFrame) -> DataFrame:
    """ord and the ids of all findings at the same file and line (no line equals no line), in order. unified: ord, file_path, line_number. Findings
    are gathered once for each place."""
    at = findings.groupBy("file_path", "line_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("originals"))
    u, p = unified.alias("u"), at.alias("p")
    same = (F.col("u.file_path") == F.col("p.file_path")) & F.col("u.line_number").eqNullSafe(F.col("p.line_number"))
    return u.join(p, same, "left").select("u.ord", "p.originals")


def dependency_cves(dependencies: DataFrame, cves: DataFrame, most: int = 100) -> DataFrame:
    """name, cve_id: for each dependency the first ``most`` CVEs whose vendor and product it is. dependencies: name; cves: cve_id, vendor, product,
    ord. The vendor is what stands before a slash, else before the first dash."""
    from .findings import top_k

    parts = F.split("name", "/")
    scoped = F.size(parts) >= 2
    keyed = dependencies.select("name").distinct().select("name", F.when(scoped, parts[0]).otherwise(F.split("name", "-")[0]).alias("vendor"), F.when(scoped, parts[1]).otherwise(F.col("name")).alias("product"))
    return top_k(keyed.join(cves, ["vendor", "product"]), ["name"], most, "ord").select("name", "cve_id")


def nvd_rows(responses: DataFrame, most: int = 100) -> DataFrame:
    """responses: a column json of the feed. cve_id, description, severity, cwe_ids, published of the first ``most`` entries each; broken
    responses have none."""
    kind = "struct<vulnerabilities: array<struct<id: string, published: string, descriptions: array<struct<value: string>>, metrics: struct<cvssMetricV31: array<struct<severity: string>>>, problemTypes: array<struct<descriptions: array<struct<value: string>>>>>>>"
    v = responses.select(F.explode(F.slice(F.from_json("json", kind)["vulnerabilities"], 1, most)).alias("v"))
    label = F.lower(F.col("v.metrics.cvssMetricV31")[0]["severity"])
    values = F.transform(F.flatten(F.coalesce("v.problemTypes.descriptions", F.array().cast("array<array<struct<value:string>>>"))), lambda d: d["value"])
    return v.select(
        F.col("v.id").alias("cve_id"), F.coalesce(F.col("v.descriptions")[0]["value"], F.lit("")).alias("description"), F.when(label.isin("critical", "high", "low"), label).otherwise("medium").alias("severity"),
        F.filter(values, lambda x: x.startswith("CWE-")).alias("cwe_ids"), F.col("v.published").alias("published"), F.lit("NVD").alias("src"),
    )


def kev_rows(responses: DataFrame) -> DataFrame:
    """responses: a column json of the catalogue. cve_id, description, published; broken responses have none."""
    kind = "struct<vulnerabilities: array<struct<cveID: string, shortDescription: string, dateAdded: string>>>"
    v = responses.select(F.explode(F.from_json("json", kind)["vulnerabilities"]).alias("v"))
    return v.select(F.col("v.cveID").alias("cve_id"), F.col("v.shortDescription").alias("description"), F.col("v.dateAdded").alias("published"), F.array().cast("array<string>").alias("cwe_ids"), F.lit("KEV").alias("src"))


def stack(files: DataFrame) -> DataFrame:
    """One row: languages (of the manifests at the root, and PHP where its sources lie at most three folders deep) and whether the
    folders of WordPress are there. files: path, relative."""
    path = F.col("path")
    depth = F.size(F.split("path", "/")) - 1
    source = text.extension(path).isin(*PHP_EXTENSIONS) & (depth <= STACK_DEPTH) & ~path.rlike(r"(^|/)(" + "|".join(d.replace(".", r"\.") for d in UNSCANNED) + ")/")
    flags = files.agg(*[F.bool_or(path == m).alias(m.replace(".", "_")) for m in MANIFESTS], F.bool_or(source).alias("_php"), F.bool_or(path.rlike("^(wp-includes|wp-content)/")).alias("_wp"))
    found = F.array_compact(F.array(*[F.when(F.col(m.replace(".", "_")), F.lit(lang)) for m, lang in MANIFESTS.items()], F.when(F.col("_php"), F.lit("PHP"))))
    return flags.select(F.array_distinct(found).alias("languages"), F.when(F.col("_wp"), F.array(F.lit("WordPress"))).otherwise(F.array().cast("array<string>")).alias("frameworks"))


def component_flags(files: DataFrame, most: int = 100) -> DataFrame:
    """One row: whether the first ``most`` files (as the component report takes them, in order of path) speak HTTP, to a database, to the file
    system, of authentication. files: path, text."""
    some = files.orderBy("path").limit(most)
    return some.select(*project.components(F.col("text"))).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in project.COMPONENTS])


def health(phases: DataFrame, files: DataFrame) -> DataFrame:
    """One row: phases run, skipped and failed, files indexed and analysed, whether the scan analysed nothing, and whether all phases that ask
    a model were skipped. phases: phase, ord, status (run, skipped, failed; the last of a phase counts); files: analysed."""
    last = phases.groupBy("phase").agg(F.max_by("status", "ord").alias("status"))
    p = last.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("run", "skipped", "failed")], (F.count_if(F.col("phase").isin(*LLM_PHASES) & (F.col("status") == "skipped")) == len(LLM_PHASES)).alias("all_llm_skipped"))
    f = files.agg(F.count("*").alias("indexed"), F.count_if("analysed").alias("analyzed"))
    return p.crossJoin(f).withColumn("blind", (F.col("indexed") > 0) & (F.col("analyzed") == 0))


def git_modifiers(commits: DataFrame, groups: DataFrame, by: str, as_of: str) -> DataFrame:
    """by, source, modifier, reason: what a group's history adds to confidence. groups: all of them; one without commits has that as its modifier.
    commits: analysed, with ``day``."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("day"))
    g = commits.groupBy(by).agg(F.count("*").alias("n"), F.count_if("security_fix").alias("fixes"), F.count_if(F.size("cwe_refs") > 0).alias("cwes"), F.count_if((age < 30) & F.col("security_fix")).alias("recent"))
    one = lambda when, source, modifier, reason: F.when(when, F.struct(F.lit(source).alias("source"), modifier.cast("double").alias("modifier"), reason.alias("reason")))
    there = F.col("n").isNotNull()
    listed = F.array_compact(
        F.array(
            one(~there, "git_history", F.lit(-0.1), F.lit("No git history available")),
            one(there & (F.col("fixes") > 0), "security_commits", F.least(F.col("fixes") * 0.05, F.lit(0.2)), F.concat(F.lit("Found "), F.col("fixes").cast("string"), F.lit(" security-related commits"))),
            one(there & (F.col("recent") > 0), "recent_security_fixes", F.lit(0.1), F.lit("Recent security fixes indicate active security maintenance")),
            one(there & (F.col("cwes") > 0), "cwe_references", F.least(F.col("cwes") * 0.05, F.lit(0.15)), F.lit("Commits reference CWE vulnerabilities")),
            one(there & (F.col("n") > 10), "active_development", F.lit(0.05), F.lit("Active development history (good for finding related fixes)")),
        )
    )
    return groups.select(by).distinct().join(g, by, "left").select(by, F.explode(listed).alias("m")).select(by, "m.*")


def merged_threats(new: DataFrame, old: DataFrame) -> DataFrame:
    """project, total_threats (the larger), high_risk_areas (of both, in order): threat models of two scans as one. Both: project, total_threats,
    high_risk_areas."""
    o = old.select("project", F.col("total_threats").alias("_total"), F.col("high_risk_areas").alias("_areas"))
    none = F.array().cast("array<string>")
    return new.join(o, "project", "left").select("project", F.greatest("total_threats", "_total").alias("total_threats"), F.array_sort(F.array_union("high_risk_areas", F.coalesce("_areas", none))).alias("high_risk_areas"))


def with_more(findings: DataFrame, more: DataFrame) -> DataFrame:
    """findings and those that a later phase adds, columns that one lacks left null."""
    return findings.unionByName(more, allowMissingColumns=True)


def split(findings: DataFrame) -> DataFrame:
    """findings with ``side`` (kept, rejected) and the reason of a rejection."""
    wrong = F.coalesce(F.col("verification_status") == "false_positive", F.lit(False))
    return findings.withColumn("side", F.when(wrong, "rejected").otherwise("kept")).withColumn("reason", F.when(wrong, F.coalesce("verification_notes", F.lit("false positive"))))


def location_groups(findings: DataFrame) -> DataFrame:
    """location, n, severities."""
    at = F.concat_ws(":", "file_path", F.coalesce(F.col("line_number").cast("string"), F.lit("")))
    return findings.groupBy(at.alias("location")).agg(F.count("*").alias("n"), F.count_distinct("severity").alias("severities"))


def tagged(findings: DataFrame, tier: Column) -> DataFrame:
    """findings with a tier where they have none."""
    return findings.withColumn("verification_tier", F.coalesce("verification_tier", tier))


def adjusted(score: Column, by: Column) -> Column:
    """A confidence after a rationale's adjustment."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + by))


def first_of_groups(findings: DataFrame, by: list[str]) -> DataFrame:
    """The first finding (by ord) of each group, with the evidence of all of them, in order."""
    row = F.struct(*[F.col(f"`{c}`") for c in findings.columns])
    g = findings.groupBy(*by).agg(F.min_by(row, "ord").alias("_first"), F.array_sort(F.collect_list(F.struct("ord", "evidence"))).alias("_all"))
    every = F.flatten(F.transform("_all", lambda x: F.coalesce(x["evidence"], F.array().cast(findings.schema["evidence"].dataType))))
    return g.select(*[(every if c == "evidence" else F.col(f"_first.`{c}`")).alias(c) for c in findings.columns])


def agent_result(notes: Column, compile_path: Column, test_path: Column, turns: Column, tools: Column, log: Column, scaffold: Column) -> Column:
    """struct(path, notes) of a finding after an agent's result: where its evidence is, and notes where there were none."""
    worked = F.when(turns > 0, F.concat(turns.cast("string"), F.lit(" turns, "), tools.cast("string"), F.lit(" tools")))
    return F.struct(F.coalesce(compile_path, test_path, worked).alias("path"), F.coalesce(notes, log, scaffold).alias("notes"))


def agent_failure(notes: Column, error: Column, scaffold: Column) -> Column:
    """struct(error, notes) after an agent failed."""
    kept = F.when(scaffold.isNotNull() & notes.isNull(), scaffold).otherwise(F.concat(F.lit("Agent verification failed: "), error))
    return F.struct(error.alias("error"), kept.alias("notes"))


def slices(nodes: DataFrame) -> DataFrame:
    """slice, first_line, last_line, lines (in order, each once) of the nodes of code slices. nodes: slice, line."""
    return nodes.groupBy("slice").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.array_sort(F.collect_set("line")).alias("lines"))


def with_context(findings_so_far: Column, more: Column) -> Column:
    """Context strings of before, and those that are new."""
    return F.array_union(findings_so_far, more)


def execution_order(nodes: int, edges: list[tuple[int, int]]) -> list[int] | None:
    """A topological order of an agent flow's steps, the last that became ready first; null for a cycle. A flow has a handful of steps, so
    this runs on the driver."""
    need = [0] * nodes
    for _, b in edges:
        need[b] += 1
    ready, out = [k for k in range(nodes) if not need[k]], []
    while ready:
        k = ready.pop()
        out.append(k)
        for a, b in edges:
            if a == k:
                need[b] -= 1
                if not need[b]:
                    ready.append(b)
    return out if len(out) == nodes else None
