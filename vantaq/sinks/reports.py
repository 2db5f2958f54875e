"""Whole report documents: JSON, SARIF, Markdown, HTML.

A document is a table of parts (section, rank, ord, part), which are its lines in that order. Parts are made by native expressions and
sorted by range, so the part files of the written table, one after the other, are the document; ``bind`` copies them to one file as a stream.
Only counts and the first rows' places are looked up on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown, scoring, text
from ..schema import SEVERITIES, severity_rank
from .writers import sarif_level

SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
PARTS = "section int, rank int, ord long, part string"


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _parts(df: DataFrame, section: int, rank: Column, part: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), rank.cast("int").alias("rank"), F.col("ord").cast("long").alias("ord"), part.alias("part"))


def _fixed(spark: SparkSession, section: int, *lines: str) -> DataFrame:
    return spark.createDataFrame([(section, 0, k, x) for k, x in enumerate(lines)], PARTS)


def _listed(df: DataFrame, section: int, element: Column) -> DataFrame:
    """Elements of a JSON array, all but the first after a comma."""
    first = F.broadcast(df.agg(F.min("ord").alias("first")))  # one row
    return _parts(df.crossJoin(first), section, F.lit(0), F.concat(F.when(F.col("ord") == F.col("first"), "").otherwise(","), element))


def summary(findings: DataFrame) -> DataFrame:
    """One row: total_findings, and one count for each severity."""
    return findings.agg(F.count("*").alias("total_findings"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def _object(df: DataFrame, *without: str) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in without]))


def json_document(findings: DataFrame, rejected: DataFrame | None = None, gate: bool = False) -> DataFrame:
    """An array of findings; with ``rejected`` (findings with rejection_reason) an object of findings, rejected and summary. ``gate`` gives findings
    without a tier theirs."""
    spark = findings.sparkSession
    counts = summary(findings)
    if gate:
        tier = scoring.tier(F.col("evidence"), F.col("confidence_score"))
        findings = findings.withColumn("verification_tier", F.coalesce("verification_tier", tier) if "verification_tier" in findings.columns else tier)
    if rejected is None:
        return _fixed(spark, 0, "[").unionByName(_listed(findings, 1, _object(findings, "ord"))).unionByName(_fixed(spark, 2, "]"))
    whole = rejected.select("ord", F.to_json(F.struct(F.struct(*[F.col(f"`{c}`") for c in rejected.columns if c not in ("ord", "rejection_reason")]).alias("finding"), "rejection_reason")).alias("_json"))
    total = counts.select(F.lit(5).alias("section"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("ord"), F.to_json(F.struct(*counts.columns)).alias("part"))
    out = _fixed(spark, 0, '{"findings": [').unionByName(_listed(findings, 1, _object(findings, "ord"))).unionByName(_fixed(spark, 2, '], "rejected": ['))
    return out.unionByName(_listed(whole, 3, F.col("_json"))).unionByName(_fixed(spark, 4, '], "summary":')).unionByName(total).unionByName(_fixed(spark, 6, "}"))


def sarif_rule(df: DataFrame) -> Column:
    number = F.coalesce(F.regexp_replace(_col(df, "cwe_id"), "CWE-", "").try_cast("int"), F.lit(0))
    described = F.struct(F.coalesce(_col(df, "description"), F.lit("")).alias("text"))
    help_ = F.format_string("https://cwe.mitre.org/data/definitions/%d.html", number)
    return F.to_json(F.struct(F.col("id"), F.col("title").alias("name"), described.alias("shortDescription"), described.alias("fullDescription"), help_.alias("helpUri"), F.struct(F.col("severity")).alias("properties")))


def _attached(code: Column, message: Column, what: str, with_size: bool) -> Column:
    region = [F.struct(F.lit(0).alias("byteOffset"), F.octet_length(code).alias("byteLength")).alias("region")] if with_size else [F.lit(None).cast("struct<byteOffset int, byteLength int>").alias("region")]
    place = F.struct(F.struct(F.struct(F.lit(what).alias("text")).alias("description")).alias("artifactLocation"), *region)
    notes = F.array(F.struct(F.lit(1).alias("startLine"), F.size(F.split(F.regexp_replace(code, "\n$", ""), "\n")).alias("endLine"), F.struct(code.alias("text")).alias("message")))
    return F.when(code.isNotNull(), F.struct(F.struct(F.struct(message.alias("text")).alias("message"), place.alias("physicalLocation")).alias("location"), notes.alias("annotations")))


def sarif_result(df: DataFrame) -> Column:
    """A result: rule, message, level, its place (a line only where there is one), and the proof and mitigation as related locations."""
    artifact = F.when(F.col("file_path") != "", F.struct(F.col("file_path").alias("uri"), F.lit("file://").alias("uriBaseId")))
    region = F.struct(F.when(F.col("line_number") > 0, F.col("line_number")).alias("startLine"))
    place = F.array(F.struct(F.struct(artifact.alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    proof, mitigation = _col(df, "poc_code"), _col(df, "mitigation_code")
    proof_name = F.concat(F.lit("Proof of Concept ("), F.coalesce(_col(df, "poc_format"), F.lit("text")), F.lit(")"))
    related = F.array_compact(F.array(_attached(proof, proof_name, "PoC Code", True), _attached(mitigation, F.lit("Mitigation Example"), "Mitigation Code", False)))
    message = F.struct(F.coalesce(_col(df, "description"), F.lit("")).alias("text"))
    return F.to_json(F.struct(F.col("id").alias("ruleId"), message.alias("message"), place.alias("locations"), sarif_level(F.col("severity")).alias("level"), F.when(F.size(related) > 0, related).alias("relatedLocations")))


def sarif_document(findings: DataFrame, gate: bool = False, version: str = "1.0") -> DataFrame:
    """A SARIF 2.1.0 document: rules and results of the findings; with ``gate`` only of verified and supported ones."""
    spark = findings.sparkSession
    if gate:
        findings = findings.filter(scoring.tier(F.col("evidence"), F.col("confidence_score")).isin("verified", "supported"))
    head = f'{{"$schema": "{SARIF_SCHEMA}", "version": "2.1.0", "runs": [{{"tool": {{"driver": {{"name": "vantaq", "version": "{version}", "rules": ['
    middle = ']}}, "originalUriBaseIds": {"file://": {"uri": "file:///"}}, "results": ['
    out = _fixed(spark, 0, head).unionByName(_listed(findings, 1, sarif_rule(findings))).unionByName(_fixed(spark, 2, middle))
    return out.unionByName(_listed(findings, 3, sarif_result(findings))).unionByName(_fixed(spark, 4, "]}]}"))


def percent(score: Column, decimals: int = 1) -> Column:
    return F.format_string(f"%.{decimals}f%%", score * 100)


def fenced(label: str, language: Column, code: Column) -> Column:
    """A labelled block of code; empty without code."""
    return F.coalesce(F.concat(F.lit(f"**{label}:**\n\n```"), language, F.lit("\n"), code, F.lit("\n```\n\n")), F.lit(""))


def markdown_finding(df: DataFrame, tier: Column) -> Column:
    line = lambda label, value: F.concat(F.lit(f"**{label}:** "), value, F.lit("\n\n"))
    cwe = F.coalesce(F.concat(F.lit(" ("), _col(df, "cwe_id"), F.lit(")")), F.lit(""))
    sources = F.when(F.size("sources") > 0, line("Sources", F.array_join("sources", ", "))).otherwise("") if "sources" in df.columns else F.lit("")
    place = F.concat(F.lit("`"), text.location(F.col("file_path"), F.col("line_number")), F.lit("`"))
    advice = F.coalesce(F.concat(F.lit("**Recommendation:**\n\n"), _col(df, "recommendation"), F.lit("\n\n")), F.lit(""))
    language = F.coalesce(text.language_of(F.col("file_path")), F.lit("text"))
    return F.concat(
        F.lit("### ["), F.col("severity"), F.lit("] "), F.col("title"), cwe, F.lit("\n\n"), line("Location", place), line("Description", F.coalesce(_col(df, "description"), F.lit(""))), line("Confidence", percent(F.col("confidence_score"))),
        line("Evidence Tier", F.initcap(tier)), fenced("Code", F.lit("text"), _col(df, "code_snippet")), fenced("Diff", F.lit("diff"), _col(df, "diff_hunk")), advice,
        fenced("Proof of Concept", F.coalesce(_col(df, "poc_format"), F.lit("text")), _col(df, "poc_code")), fenced("Mitigation", language, _col(df, "mitigation_code")), sources,
    )


def markdown_document(findings: DataFrame, project: str, date: str, version: str = "1.0") -> DataFrame:
    """Summary table by severity and tier, a section for each severity, unverified findings again in an appendix."""
    spark = findings.sparkSession
    f = findings.withColumn("_tier", scoring.tier(F.col("evidence"), F.col("confidence_score"))).withColumn("_rank", 4 - severity_rank(F.col("severity")))
    severities = spark.createDataFrame([(k, s) for k, s in enumerate(SEVERITIES)], "rank int, name string")
    per = lambda by: F.count_if(F.col("_tier") == by)
    counts = f.groupBy(F.col("_rank").alias("rank")).agg(*[per(t).alias(t) for t in ("verified", "supported", "unverified")], F.count("*").alias("total"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    table = F.broadcast(severities).join(counts, "rank", "left")
    row = F.concat(F.lit("| **"), F.initcap("name"), F.lit("** | "), n("verified"), F.lit(" | "), n("supported"), F.lit(" | "), n("unverified"), F.lit(" | "), n("total"), F.lit(" |"))
    rows = table.select(F.lit(2).alias("section"), "rank", F.lit(0).cast("long").alias("ord"), row.alias("part"))
    totals = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("verified", "supported", "unverified", "total")])
    title = totals.select(F.lit(0).alias("section"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit(f"# Security Vulnerability Report\n\n**Project:** {project} | **Scan Date:** {date} | **Total Findings:** "), n("total"), F.lit("\n")).alias("part"))
    sums = totals.select(F.lit(3).alias("section"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit("\n**Totals:** "), n("verified"), F.lit(" verified | "), n("supported"), F.lit(" supported | "), n("unverified"), F.lit(" unverified\n")).alias("part"))
    heads = table.filter("total > 0").select(F.lit(4).alias("section"), "rank", F.lit(-1).cast("long").alias("ord"), F.concat(F.lit("## "), F.initcap("name"), F.lit(" Findings ("), n("total"), F.lit(")\n")).alias("part"))
    none = totals.filter("total = 0").select(F.lit(4).alias("section"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("ord"), F.lit("## No Findings\n\nNo security issues detected.\n").alias("part"))
    body = _parts(f, 4, F.col("_rank"), markdown_finding(findings, F.col("_tier")))
    unsure = f.filter("_tier = 'unverified'")
    appendix = totals.filter("unverified > 0").select(F.lit(5).alias("section"), F.lit(0).alias("rank"), F.lit(-1).cast("long").alias("ord"), F.lit("## Appendix: Unverified Findings\n\nThe following findings lack sufficient evidence for inclusion in the main report.\n").alias("part"))
    out = title.unionByName(_fixed(spark, 1, "## Executive Summary\n", "| Severity | Verified | Supported | Unverified | Total |", "|----------|----------|-----------|------------|-------|")).unionByName(rows).unionByName(sums)
    out = out.unionByName(heads).unionByName(none).unionByName(body).unionByName(appendix).unionByName(_parts(unsure, 5, F.lit(0), markdown_finding(findings, F.col("_tier"))))
    return out.unionByName(_fixed(spark, 6, f"---\n\n*Generated by vantaq {version}*"))


def metadata_rows(df: DataFrame) -> Column:
    """The labelled facts of a finding, those that there are, as HTML."""
    esc = text.escape_html
    bold = lambda label, value: F.concat(F.lit(f"<strong>{label}:</strong> "), value)
    cwe = esc(_col(df, "cwe_id"))
    some = lambda name: F.when(F.size(F.col(name)) > 0, esc(F.array_join(name, ", "))) if name in df.columns else F.lit(None).cast("string")
    span = F.when(~F.coalesce(F.col("line_number") == F.col("statement_range.start"), F.lit(False)), F.concat(F.lit("lines "), F.col("statement_range.start").cast("string"), F.lit("-"), F.col("statement_range.end").cast("string"))) if "statement_range" in df.columns else F.lit(None).cast("string")
    triage = F.initcap(F.replace(F.col("triage_verdict.kind"), F.lit("_"), F.lit(" "))) if "triage_verdict" in df.columns else F.lit(None).cast("string")
    return F.array_compact(
        F.array(
            bold("CWE", F.concat(F.lit('<a href="https://cwe.mitre.org/data/definitions/'), cwe, F.lit('.html" target="_blank">'), cwe, F.lit("</a>"))), bold("Verification", _col(df, "verification_status")),
            bold("Priority", F.format_string("%.1f", _col(df, "priority_score", "double") * 100)) if "priority_score" in df.columns else F.lit(None).cast("string"), bold("Cross-file refs", some("cross_file_references")), bold("Related findings", some("related_finding_ids")),
            bold("Ticket", esc(_col(df, "ticket_reference"))), bold("Statement range", span), bold("Verification notes", esc(_col(df, "verification_notes"))),
            bold("Verification error", F.concat(F.lit('<span class="verification-error">'), esc(_col(df, "verification_error")), F.lit("</span>"))), bold("Commit", esc(_col(df, "commit_reference"))), bold("Triage", triage),
        )
    )


def severity_class(severity: Column) -> Column:
    return F.concat(F.lit("severity-"), severity)


def confidence_class(score: Column) -> Column:
    return F.when(score >= 0.8, "confidence-high").when(score >= 0.5, "confidence-medium").otherwise("confidence-low")


def html_finding(df: DataFrame) -> Column:
    esc = text.escape_html
    code = F.coalesce(F.concat(F.lit("<pre><code>"), esc(_col(df, "code_snippet")), F.lit("</code></pre>")), F.lit(""))
    return F.concat(
        F.lit("<article class=\""), severity_class(F.col("severity")), F.lit(" "), confidence_class(F.col("confidence_score")), F.lit("\"><h3>"), esc(F.col("title")), F.lit("</h3><p>"), esc(text.location(F.col("file_path"), F.col("line_number"))), F.lit("</p><p>"),
        F.array_join(metadata_rows(df), " | "), F.lit("</p>"), code, F.lit("</article>"),
    )


def html_texts(df: DataFrame) -> Column:
    """Description and recommendation of a finding, from markdown."""
    part = lambda name, title: F.coalesce(F.concat(F.lit(f'<div class="{name}"><h4>{title}</h4>'), markdown.html(_col(df, name)), F.lit("</div>")), F.lit(""))
    return F.concat(part("description", "Description"), part("recommendation", "Recommendation"))


def appendix_entry(df: DataFrame, kind: str, reason: Column) -> Column:
    """An entry of the appendix. Its wording and classes, for unverified findings and for dismissed ones."""
    title, label = {"unverified": ("Unverified", "Reason"), "rejected": ("Dismissed", "Rejection Reason")}[kind]
    esc = text.escape_html
    line = F.coalesce(F.col("line_number").cast("string"), F.lit("N/A"))
    return F.concat(
        F.lit(f'<div class="finding {kind}">\n<div class="finding-header">\n<h3>'), esc(F.col("title")), F.lit(f'</h3>\n<span class="severity {kind}">{title}</span>\n</div>\n<div class="meta">\n<strong>File:</strong> '), esc(F.col("file_path")),
        F.lit(" | <strong>Line:</strong> "), line, F.lit(f'\n</div>\n<div class="finding-details">\n<p><strong>{label}:</strong> '), esc(reason), F.lit("</p>\n</div>\n</div>"),
    )


def appendices(unverified: DataFrame, rejected: DataFrame) -> DataFrame:
    """section, rank, ord, part of both appendices; one without entries is left out. unverified: findings with ``reason`` (null: none is told); rejected: the same. The headings."""

    def whole(df: DataFrame, section: int, kind: str, head: str, counted: str) -> DataFrame:
        reason = F.coalesce("reason", F.lit("No evidence detail available"))
        entries = df.select(F.lit(section).alias("section"), F.lit(1).alias("rank"), F.col("ord").cast("long").alias("ord"), appendix_entry(df, kind, reason).alias("part"))
        n = df.agg(F.count("*").alias("n")).filter("n > 0")
        opening = F.concat(F.lit(f'<section class="{kind}-appendix"><h2>{head}</h2>\n<p class="finding-count">'), F.col("n").cast("string"), F.lit(f" {counted}</p>"))
        ends = n.select(F.lit(section).alias("section"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("ord"), opening.alias("part")).union(n.select(F.lit(section), F.lit(2), F.lit(0).cast("long"), F.lit("</section>")))
        return ends.union(entries)

    return whole(unverified, 1, "unverified", "Appendix: Unverified Findings", "unverified findings excluded from main report").union(whole(rejected, 2, "rejected", "Investigated & Dismissed", "findings were investigated and dismissed"))


def html_document(findings: DataFrame, project: str) -> DataFrame:
    """Cards by severity, the priority section (critical and high), then all findings by file, then unverified ones."""
    spark = findings.sparkSession
    f = findings.withColumn("_rank", 4 - severity_rank(F.col("severity"))).withColumn("_tier", scoring.tier(F.col("evidence"), F.col("confidence_score")))
    cards = f.groupBy("_rank", "severity").agg(F.count("*").alias("n")).select(F.lit(1).alias("section"), F.col("_rank").cast("int").alias("rank"), F.lit(0).cast("long").alias("ord"), F.format_string('<div class="card %s"><h3>%d</h3><p>%s</p></div>', F.col("severity"), F.col("n"), F.initcap("severity")).alias("part"))
    part = html_finding(findings)
    top = _parts(f.filter("_rank < 2"), 3, F.col("_rank"), part)
    by_file = f.groupBy("file_path").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    heads = by_file.select(F.lit(5).alias("section"), F.lit(0).alias("rank"), F.col("ord").cast("long").alias("ord"), F.format_string("<h2>%s (%d)</h2>", text.escape_html(F.col("file_path")), F.col("n")).alias("part"), F.col("ord").cast("long").alias("group"))
    members = f.join(by_file.select("file_path", F.col("ord").alias("group")), "file_path")
    listed = members.select(F.lit(5).alias("section"), F.lit(1).alias("rank"), F.col("ord").cast("long").alias("ord"), part.alias("part"), F.col("group").cast("long").alias("group"))
    grouped = heads.unionByName(listed).orderBy("group", "rank", "ord")
    flat = lambda d: d.withColumn("group", F.lit(0).cast("long"))
    head = f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{project}</title></head><body><h1>{project}</h1>"
    out = flat(_fixed(spark, 0, head)).unionByName(flat(cards)).unionByName(flat(_fixed(spark, 2, "<section id=\"priority\">"))).unionByName(flat(top)).unionByName(flat(_fixed(spark, 4, "</section><section id=\"files\">"))).unionByName(grouped)
    unsure = _parts(f.filter("_tier = 'unverified'"), 7, F.lit(0), part)
    return out.unionByName(flat(_fixed(spark, 6, "</section><section id=\"unverified\">"))).unionByName(flat(unsure)).unionByName(flat(_fixed(spark, 8, "</section></body></html>"))).select("section", "group", "rank", "ord", "part")


def write_document(parts: DataFrame, path: str) -> None:
    """A directory of part files that are the document, one after the other in the order of their names."""
    keys = [c for c in ("section", "group", "rank", "ord") if c in parts.columns]
    parts.repartitionByRange(*keys).sortWithinPartitions(*keys).select("part").write.mode("overwrite").text(path)


def bind(spark: SparkSession, path: str, to: str) -> None:
    """The part files of a written document copied to one file, as a stream."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    fs, out_fs = source.getFileSystem(conf), target.getFileSystem(conf)
    out = out_fs.create(target, True)
    try:
        for name in sorted(str(s.getPath().getName()) for s in fs.listStatus(source) if str(s.getPath().getName()).startswith("part-")):
            part = fs.open(jvm.org.apache.hadoop.fs.Path(source, name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            finally:
                part.close()
    finally:
        out.close()
