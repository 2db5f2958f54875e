"""Findings held against the files and functions that they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Lines of a snippet that a prompt added.
CONTEXT_HEAD, CODE_MARK = "--- Context", ">>> VULNERABLE CODE <<<"
#: Lines of a bin of blame hunks.
BIN = 64


def anchored(findings: DataFrame, functions: DataFrame) -> DataFrame:
    """findings with ``anchor`` (inside, moved, no_name, unknown), and line_number and code_location moved to the named function where
    the line lies outside of it: the first name( in the title that the file declares. functions: file_path, name, start, end; the last of a
    name counts. One join on the file; a file's functions travel as a map."""
    span = F.max_by(F.struct("start", "end"), "start")
    by_file = functions.groupBy("file_path", "name").agg(span.alias("span")).groupBy("file_path").agg(F.map_from_entries(F.collect_list(F.struct("name", "span"))).alias("_functions"))
    names = text.functions_in(F.col("title"))
    known = F.filter(F.transform(names, lambda n: F.try_element_at(F.col("_functions"), n)), lambda s: s.isNotNull())
    out = findings.join(by_file, "file_path", "left").withColumn("_span", F.try_element_at(known, F.lit(1)))
    inside = F.coalesce(F.col("line_number").between(F.col("_span.start"), F.col("_span.end")), F.lit(False))
    anchor = F.when(F.col("_functions").isNull() | (F.size(names) == 0), "no_name").when(F.col("_span").isNull(), "unknown").when(inside, "inside").otherwise("moved")
    moved = F.col("anchor") == "moved"
    out = out.withColumn("anchor", anchor)
    out = out.withColumn("code_location", F.when(moved, F.concat_ws(":", "file_path", F.col("_span.start").cast("string"))).otherwise(F.col("code_location") if "code_location" in findings.columns else F.lit(None).cast("string")))
    return out.withColumn("line_number", F.when(moved, F.col("_span.start").cast("int")).otherwise(F.col("line_number"))).drop("_functions", "_span")


def primitives(findings: DataFrame, functions: DataFrame, files: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """findings with ``primitive``, the first required check of the file's language in the body of the function that the title names
    first, and ``fault``, why that could not be told: the file is not among ``files`` (path). functions: file_path, name, body."""
    language = text.language_of(F.col("file_path"))
    name = F.try_element_at(text.functions_in(F.col("title")), F.lit(1))
    bodies = functions.select("file_path", F.col("name").alias("_name"), F.col("body").alias("_body"))
    there = files.select(F.col("path").alias("file_path"), F.lit(True).alias("_there")).distinct()
    out = findings.withColumn("_name", name).join(bodies, ["file_path", "_name"], "left").join(there, "file_path", "left")
    asked, found = F.lit(False), F.lit(None).cast("string")
    for lang, checks in required.items():
        checks = [c for c in checks if c]
        if checks:
            first = F.try_element_at(F.filter(F.array(*[F.lit(c) for c in checks]), lambda c: F.contains(F.col("_body"), c)), F.lit(1))
            asked, found = asked | F.coalesce(language == lang, F.lit(False)), F.when(language == lang, first).otherwise(found)
    asked = asked & F.col("_name").isNotNull()
    fault = F.when(asked & F.col("_there").isNull(), "cannot read file")
    return out.withColumn("fault", fault).withColumn("primitive", F.when(F.col("fault").isNull(), found)).drop("_name", "_body", "_there")


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def restated(findings: DataFrame, files: DataFrame) -> DataFrame:
    """findings with code_snippet taken from the file where a claimed line is not in it (three lines before, three after; null where there is no
    line to go by), and ``restated``. files: path, text; findings of other files stay as they are. The planner takes texts for as small
    as the columns that they are made of; files are sorted, never broadcast."""
    lines = F.when(F.col("_text") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("_text", "\n$", ""), "\r?\n"))
    out = findings.join(files.select(F.col("path").alias("file_path"), F.col("text").alias("_text")).hint("merge"), "file_path", "left").withColumn("_lines", lines)
    claimed = F.filter(F.transform(F.split(_trimmed(F.col("code_snippet")), "\r?\n"), _trimmed), lambda x: (x != "") & ~x.startswith(CONTEXT_HEAD) & (x != CODE_MARK))
    actual = F.transform("_lines", _trimmed)
    present = F.forall(claimed, lambda x: F.array_contains(actual, x))
    n = F.size("_lines")
    first, last = F.greatest(F.col("line_number") - 3, F.lit(0)), F.least(F.col("line_number") + 4, n)
    own = F.array_join(F.transform(F.sequence(first + 1, last), lambda i: F.concat(F.lpad(i.cast("string"), 5, " "), F.lit(": "), F.get("_lines", i - 1), F.lit("\n"))), "")
    known = F.col("_text").isNotNull() & F.col("code_snippet").isNotNull()
    wrong = known & (F.size(claimed) > 0) & ~present
    out = out.withColumn("restated", F.coalesce(wrong, F.lit(False)))
    snippet = F.when(known & (F.size(claimed) == 0), F.lit(None)).when(F.col("restated"), F.when((F.col("line_number") > 0) & (first < last), own)).otherwise(F.col("code_snippet"))
    return out.withColumn("code_snippet", snippet).drop("_text", "_lines")


def blamed(findings: DataFrame, hunks: DataFrame) -> DataFrame:
    """findings with the commit_id of the blame hunk that holds their line. hunks: file_path, start, lines, commit_id; hunks of a file do not
    overlap. The interval join is an equi join on file and bin."""
    h = hunks.select("file_path", F.col("start").alias("_start"), (F.col("start") + F.col("lines") - 1).alias("_end"), "commit_id")
    h = h.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_start") / BIN), F.floor(F.col("_end") / BIN))))
    f = findings.withColumn("_bin", F.floor(F.col("line_number") / BIN))
    hit = (f["file_path"] == h["file_path"]) & (f["_bin"] == h["_bin"]) & f["line_number"].between(h["_start"], h["_end"])
    return f.join(h, hit, "left").select(*[f[c] for c in findings.columns], h["commit_id"])


def related_commits(findings: DataFrame, hunks: DataFrame, commits: DataFrame, touched: DataFrame, most: int) -> DataFrame:
    """ord, commit_id, rank: the commit of the blamed line; for findings without one the newest commits of their file. commits: commit_id, day;
    touched: commit_id, path. Commits are ranked once for each file, not for each finding."""
    from ..operators.findings import top_k

    by_line = blamed(findings.select("ord", "file_path", "line_number"), hunks)
    newest = top_k(touched.select("path", "commit_id").distinct().join(commits.select("commit_id", "day"), "commit_id"), ["path"], most, F.desc("day"), "commit_id")
    rest = by_line.filter("commit_id IS NULL").select("ord", "file_path").join(newest.select(F.col("path").alias("file_path"), "commit_id", "rank"), "file_path")
    return by_line.filter("commit_id IS NOT NULL").select("ord", "commit_id", F.lit(1).alias("rank")).unionByName(rest.select("ord", "commit_id", F.col("rank").cast("int")))


def diff_counts(patch: Column) -> Column:
    """struct(insertions, deletions) of a patch, file headers apart."""
    return F.struct(F.regexp_count(patch, F.lit(r"(?m)^\+(?!\+\+)")).alias("insertions"), F.regexp_count(patch, F.lit(r"(?m)^-(?!--)")).alias("deletions"))


def revspec(value: str) -> str:
    """A revision that cannot be taken for an option."""
    if value.startswith("-"):
        raise ValueError(f"invalid revspec '{value}': cannot start with '-'")
    return value
