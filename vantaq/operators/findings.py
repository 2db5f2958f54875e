"""Operators over findings: dedup, grouping, cross references, chains, conflicts, citations.

All keep Spark's own execution: windows, equi joins and aggregates with map-side combination. Order is carried by ``ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..schema import severity_rank

#: Pairs of weaknesses that make a chain, by chain type, in the order in which types are tried.
CHAINS = {
    "injection_to_execution": (("89", "78"), ("89", "94"), ("78", "94"), ("91", "78")),
    "auth_bypass_to_privilege_escalation": (("287", "269"), ("287", "284"), ("639", "269"), ("287", "427")),
    "file_access_to_rce": (("22", "98"), ("22", "78"), ("73", "98"), ("23", "98")),
    "data_exfiltration": (("918", "200"), ("918", "532"), ("918", "209"), ("502", "200")),
}


def structural_dedup(findings: DataFrame, gap: int = 2) -> DataFrame:
    """One finding of each island of lines (neighbours at most ``gap`` apart) of a file and weakness: most sources, then highest
    confidence, then earliest; its sources become the island's, in order. Adds island_size."""
    line = F.coalesce("line_number", F.lit(0))
    order = Window.partitionBy("file_path", "cwe_id").orderBy(line, "ord")
    cut = F.coalesce((line - F.lag(line).over(order) > gap).cast("int"), F.lit(0))
    marked = findings.withColumn("_cut", cut).withColumn("_island", F.sum("_cut").over(order)).withColumn("_pos", F.row_number().over(order))
    # Islands are aggregated, so no window carries a whole island's sources in each row; the rows that are best come back as structs.
    row = F.struct(*[F.col(f"`{c}`") for c in findings.columns])
    best = F.max_by(row, F.struct(F.size("sources"), "confidence_score", -F.col("_pos")))
    islands = marked.groupBy("file_path", "cwe_id", "_island").agg(best.alias("_best"), F.count("*").alias("island_size"), F.array_sort(F.collect_list(F.struct("_pos", "sources"))).alias("_members"))
    joined = F.array_distinct(F.flatten(F.transform("_members", lambda m: m["sources"])))
    columns = [F.col(f"_best.`{c}`").alias(c) if c != "sources" else F.when(F.col("island_size") > 1, joined).otherwise(F.col("_best.sources")).alias(c) for c in findings.columns]
    return islands.select(*columns, "island_size")


def root_cause_groups(findings: DataFrame) -> DataFrame:
    """root_id, n, and title and severity of the first member, members' ids and locations in order."""
    keyed = findings.withColumn("root_id", ids.root_cause(F.col("title"), F.col("file_path"), F.col("code_snippet")))
    member = F.struct("ord", "id", "file_path", "line_number")
    grouped = keyed.groupBy("root_id").agg(F.count("*").alias("n"), F.min_by("title", "ord").alias("title"), F.min_by("severity", "ord").alias("severity"), F.array_sort(F.collect_list(member)).alias("members"))
    return grouped.withColumn("finding_ids", F.transform("members", lambda m: m["id"])).withColumn("locations", F.transform("members", lambda m: text.location(m["file_path"], m["line_number"]))).drop("members")


def merge_groups(groups: DataFrame) -> DataFrame:
    """Groups of one root cause from several runs as one."""
    return groups.groupBy("root_id").agg(F.sum("n").alias("n"), F.min("title").alias("title"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("finding_ids")))).alias("finding_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("locations")))).alias("locations"))


def cross_file_pairs(findings: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(ord, other): findings in other files with the same weakness, or the same severity and a common source. ``asked``: the findings
    whose partners are wanted, among all; all of them by default. The disjunction is two equi joins without pairs in common, so it
    never becomes a nested loop, and pairs need not be made distinct. Sources are unique in a row."""
    columns = ["ord", "file_path", "cwe_id", "severity", "sources"]
    a = (findings if asked is None else asked).select(*columns)
    b = findings.select(*[F.col(c).alias(f"b_{c}") for c in columns])
    differs = F.col("file_path") != F.col("b_file_path")
    by_cwe = a.join(b, (F.col("cwe_id") == F.col("b_cwe_id")) & differs).select("ord", F.col("b_ord").alias("other"))
    ax, bx = a.withColumn("source", F.explode("sources")), b.withColumn("b_source", F.explode("b_sources"))
    new = ~F.coalesce(F.col("cwe_id") == F.col("b_cwe_id"), F.lit(False)) & (F.col("source") == F.array_intersect("sources", "b_sources")[0])
    by_source = ax.join(bx, (F.col("severity") == F.col("b_severity")) & (F.col("source") == F.col("b_source")) & differs & new).select("ord", F.col("b_ord").alias("other"))
    return by_cwe.union(by_source)


def cross_file_counts(findings: DataFrame) -> DataFrame:
    """ord and the number of its cross-file partners, without making the pairs: counts of groups, by inclusion and exclusion
    over sources, minus the finding's own file. Linear in the findings, whatever the groups' sizes. Sources are unique in a row
    and at most a handful, so subsets of them are enumerated."""
    subsets = F.expr("filter(aggregate(array_sort(sources), array(cast(array() as array<string>)), (acc, s) -> concat(acc, transform(acc, a -> concat(a, array(s))))), a -> size(a) > 0)")
    base = findings.select("ord", "file_path", "cwe_id", "severity", F.explode(subsets).alias("subset")).withColumn("subset_key", F.concat_ws("\x1f", "subset")).withColumn("sign", F.when(F.size("subset") % 2 == 1, 1).otherwise(-1)).drop("subset")
    out = None
    # same severity and source, plus same weakness, minus both at once
    for keys, part, signs in ((["severity", "subset_key"], base, True), (["cwe_id"], findings.filter("cwe_id IS NOT NULL").select("ord", "file_path", "cwe_id", F.lit(1).alias("sign")), True), (["cwe_id", "severity", "subset_key"], base.filter("cwe_id IS NOT NULL").withColumn("sign", -F.col("sign")), True)):
        whole = part.groupBy(*keys).agg(F.count("*").alias("n_all"))
        own = part.groupBy(*keys, "file_path").agg(F.count("*").alias("n_own"))
        got = part.join(whole, keys).join(own, [*keys, "file_path"]).select("ord", (F.col("sign") * (F.col("n_all") - F.col("n_own"))).alias("k"))
        out = got if out is None else out.union(got)
    return out.groupBy("ord").agg(F.sum("k").alias("n"))


def with_cross_references(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """related_finding_ids in input order; untouched where there are none."""
    other = findings.select(F.col("ord").alias("other"), F.col("id").alias("other_id"))
    related = pairs.join(other, "other").groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("other", "other_id"))), lambda x: x["other_id"]).alias("_related"))
    return findings.join(related, "ord", "left").withColumn("related_finding_ids", F.col("_related")).drop("_related")


def chains(findings: DataFrame) -> DataFrame:
    """The first pair of each directory and chain type: dir, chain_type, primary (ord), partner (ord)."""
    spark = findings.sparkSession
    rows = [(kind, k, a, b) for k, (kind, pairs) in enumerate(CHAINS.items()) for x, y in pairs for a, b in ((x, y), (y, x))]
    table = F.broadcast(spark.createDataFrame(rows, "chain_type string, type_rank int, cwe_a string, cwe_b string"))  # 32 rows
    f = findings.select("ord", text.directory(F.col("file_path")).alias("dir"), text.cwe_number(F.col("cwe_id")).alias("cwe"))
    f = f.filter("cwe IS NOT NULL")
    # A pair's first member is the first of its weakness there, or it would not be the first pair; so only those are joined.
    b = f.select("dir", F.col("ord").alias("partner"), F.col("cwe").alias("cwe_b"))
    least = f.groupBy("dir", "cwe").agg(F.min("ord").alias("primary"))
    a = least.join(table, least["cwe"] == table["cwe_a"]).select("dir", "primary", "chain_type", "type_rank", "cwe_b")
    later = a.join(b, ["dir", "cwe_b"]).filter("partner > primary").groupBy("dir", "chain_type", "primary").agg(F.min("partner").alias("partner"))
    return later.groupBy("dir", "chain_type").agg(F.min(F.struct("primary", "partner")).alias("p")).select("dir", "chain_type", "p.primary", "p.partner")


def with_chain_partners(findings: DataFrame, found: DataFrame) -> DataFrame:
    """chain_partners: for findings in a chain the partners' ids, once per chain; null for others."""
    both = found.select("chain_type", "dir", F.col("primary").alias("ord"), F.col("partner").alias("other")).union(found.select("chain_type", "dir", F.col("partner").alias("ord"), F.col("primary").alias("other")))
    named = both.join(findings.select(F.col("ord").alias("other"), F.col("id").alias("other_id")), "other")
    partners = named.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("chain_type", "other_id"))), lambda x: x["other_id"]).alias("chain_partners"))
    return findings.join(partners, "ord", "left")


def near_duplicate_pairs(findings: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b) by ord: same file, both with a line, at most ``distance`` apart. Lines go to bins, so hot files don't pair up whole."""
    f = findings.filter("line_number IS NOT NULL").select("ord", "file_path", "line_number")
    width = distance + 1
    a = f.select(F.col("ord").alias("a"), "file_path", F.col("line_number").alias("la"), F.floor(F.col("line_number") / width).alias("bin"))
    b = f.select(F.col("ord").alias("b"), "file_path", F.col("line_number").alias("lb"), F.explode(F.array(*[F.floor(F.col("line_number") / width) + k for k in (-1, 0, 1)])).alias("bin"))
    return a.join(b, ["file_path", "bin"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("la") - F.col("lb")) <= distance)).select("a", "b")


def best_of_location(findings: DataFrame) -> DataFrame:
    """Of each location the finding that is not a false positive, worst, surest; the last of equals."""
    key = F.struct((~F.coalesce(F.col("verification_status") == "false_positive", F.lit(False))).alias("ok"), severity_rank(F.col("severity")).alias("rank"), F.col("confidence_score"), F.col("ord"))
    return findings.groupBy(text.location(F.col("file_path"), F.col("line_number")).alias("location")).agg(F.max_by("ord", key).alias("ord"), F.count("*").alias("n"))


def conflicts(findings: DataFrame, spread: float = 0.3) -> DataFrame:
    """location, n, kind (severity, cwe or confidence: the first that differs) and how it is resolved. A weakness that has no number ends the
    location without a row; a finding without a weakness is passed over where weaknesses differ."""
    f = findings.withColumn("location", F.concat_ws(":", "file_path", F.coalesce(F.col("line_number").cast("string"), F.lit(""))))
    number = F.regexp_replace("cwe_id", "^(CWE-)+", "").try_cast("int")
    g = f.groupBy("location").agg(
        F.count("*").alias("n"), F.count_distinct("severity").alias("n_sev"), F.count_distinct("cwe_id").alias("n_cwe"), (F.max("confidence_score") - F.min("confidence_score")).alias("range"),
        F.max_by("severity", F.struct(severity_rank(F.col("severity")), -F.col("ord"))).alias("severity"), F.min_by("cwe_id", F.when(number.isNotNull(), F.struct(number, F.col("ord")))).alias("cwe"),
        F.bool_or(F.col("cwe_id").isNotNull() & number.isNull()).alias("bad"), F.avg("confidence_score").alias("mean"),
    )
    kind = F.when(F.col("n_sev") > 1, "severity").when(F.col("n_cwe") > 1, "cwe").when(F.round("range", 6) > spread, "confidence")
    out = g.filter("n > 1").withColumn("kind", kind).filter(F.col("kind").isNotNull() & ~((F.col("kind") == "cwe") & F.coalesce(F.col("bad"), F.lit(False))))
    resolved = F.when(F.col("kind") == "severity", F.col("severity")).when(F.col("kind") == "cwe", F.col("cwe")).otherwise(F.round("mean", 6).cast("decimal(10,6)").cast("string"))
    return out.select("location", "n", "kind", resolved.alias("resolved"))


def citations(findings: DataFrame, files: DataFrame) -> DataFrame:
    """files: path, n_lines. ord and state: unchecked, escaped, unreadable, line_zero, past_end or passed."""
    both = findings.join(files.select(F.col("path").alias("file_path"), "n_lines"), "file_path", "left")
    path = F.col("file_path")
    state = (
        F.when((F.trim(F.coalesce(path, F.lit(""))) == "") | (path == "multiple_files"), "unchecked")
        .when(path.rlike(r"(^|[/\\])\.\.([/\\]|$)"), "escaped")
        .when(F.col("n_lines").isNull(), "unreadable")
        .when(F.col("line_number") == 0, "line_zero")
        .when(F.col("line_number") > F.col("n_lines"), "past_end")
        .otherwise("passed")
    )
    return both.withColumn("state", state)


def with_citation_verdict(cited: DataFrame) -> DataFrame:
    failed = F.col("state").isin("escaped", "unreadable", "line_zero", "past_end")
    note = F.concat(F.lit("citation: "), F.col("state"))
    return cited.withColumn("verification_status", F.when(failed, "failed").otherwise(F.col("verification_status"))).withColumn("verification_notes", F.when(failed, text.append_note(F.col("verification_notes"), note)).otherwise(F.col("verification_notes")))


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def keep_last(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column | str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
