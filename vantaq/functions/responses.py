"""What model responses and prompts hold: fences, verdicts, diffs, lines of chunks, rule patterns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The budget of code in a prompt, in bytes, and the longest prompt override, in bytes.
CODE_BYTES, OVERRIDE_BYTES = 8000, 10_000
#: What an overriding prompt must not hold, in the order in which it is looked for.
SQL_PATTERNS = ("'; DROP", '"; DROP', "'; DELETE", '"; DELETE', "'; INSERT", '"; INSERT', "'; UPDATE", '"; UPDATE')
SHELL_PATTERNS = ("; rm -rf", "| rm -rf", "&& rm -rf", "`rm -rf`", "$(rm -rf)")


def unfenced_verdict(text: Column) -> Column:
    """Without code fences and a leading ``json``, as verdicts come."""
    for pattern in ("^(```)+", "(```)+$", "^(json)+"):
        text = F.regexp_replace(text, pattern, "")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def unfenced_triage(text: Column) -> Column:
    for pattern in ("^(```json)+", "^(```)+", "(```)+$", "(~~~)+$"):
        text = F.regexp_replace(text, pattern, "")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _string(v: Column, path: str) -> Column:
    """The string there; null for anything else."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(v, path, "string"))


def verdict(content: Column) -> Column:
    """struct(status, notes) of a verification response: an object, or the first object of an array; anything else needs
    review, with the whole response as its notes."""
    v = F.try_parse_json(unfenced_verdict(content))
    kind = F.schema_of_variant(v)
    status, notes = _string(v, "$.verification_status"), _string(v, "$.verification_notes")
    odd = F.try_variant_get(v, "$.verification_notes", "variant").isNotNull() & notes.isNull() & ~F.is_variant_null(F.try_variant_get(v, "$.verification_notes", "variant"))
    strict = kind.startswith("OBJECT") & status.isNotNull() & ~odd
    head = F.try_variant_get(v, "$[0]", "variant")
    in_array = kind.startswith("ARRAY") & F.coalesce(F.schema_of_variant(head).startswith("OBJECT"), F.lit(False))
    has_status = F.try_variant_get(v, "$[0].verification_status", "variant").isNotNull()
    first = F.when(has_status, _string(v, "$[0].verification_status")).otherwise(_string(v, "$[0].triage_verdict"))
    said = F.when(F.coalesce(strict, F.lit(False)), status).when(F.coalesce(in_array, F.lit(False)), F.coalesce(first, F.lit("")))
    what = F.when(F.coalesce(strict, F.lit(False)), F.coalesce(notes, F.lit(""))).when(F.coalesce(in_array, F.lit(False)), F.coalesce(_string(v, "$[0].verification_notes"), F.lit(""))).otherwise(content)
    return F.struct(F.when(said.isin("confirmed", "false_positive"), said).otherwise("needs_review").alias("status"), what.alias("notes"))


def suspicious(suspicion: Column, threshold: float) -> Column:
    return suspicion >= threshold


def distrusted(classified: Column, submitted: Column, most: float = 0.5) -> Column:
    """Whether a triage left more than that share unclassified."""
    return F.when(submitted == 0, F.lit(False)).otherwise((submitted - classified) / submitted > most)


def chunk_line(reported: Column, start: Column, end: Column) -> Column:
    """A line that a model reports for a chunk, as a line of the file: absolute if it lies in the chunk, else relative, else null."""
    relative = reported + start - 1
    return F.when((reported >= start) & (reported <= end), F.greatest(reported, F.lit(1))).when((reported >= 1) & (relative <= end), relative)


def range_fits(start: Column, end: Column, lines: Column) -> Column:
    """Whether a statement range can be one of a file of so many lines; no range fits any."""
    return F.when(start.isNull() | end.isNull(), True).otherwise((start > 0) & (start <= end) & (end <= lines))


def _cut_bytes(text: str | None, most: int) -> str | None:
    raw = (text or "").encode()
    if text is None or len(raw) <= most:
        return text
    at = most
    while True:
        while at and raw[at] & 0xC0 == 0x80:
            at -= 1
        notice = f"...\n[truncated - {len(raw[at:].decode())} chars omitted]"
        if at + len(notice) <= most or not at:
            return raw[:at].decode() + notice
        at -= 1


def cut_code(text: Column, most: int = CODE_BYTES) -> Column:
    """At most that many bytes, whole characters, with a notice of how many characters are missing."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _cut_bytes(t, most), na_action="ignore")

    return F.when(F.octet_length(text) <= most, text).otherwise(cut(text))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that f names more than once, worked out once: the optimizer would repeat it at every place, and what it is made of again at every place therein."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def imports(code: Column) -> Column:
    """Import lines among the first 50."""
    t = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    # Most lines hold none of these words, and are not trimmed.
    may = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in ("import ", "require ", "use ", "#include", "const ")])
    is_import = lambda x: x.rlike(r"^(import |require |use |#include)") | (x.startswith("const ") & F.contains(x, F.lit(" = require(")))
    return F.filter(F.transform(F.filter(F.slice(_lines(code), 1, 50), may), t), is_import)


def retrieval_query(path: Column, sinks: Column, imported: Column, cwes: Column, code: Column) -> Column:
    """What to search specifications for: sinks, imports and weaknesses; the first 20 lines where there are none."""
    part = lambda head, items, sep: _once(items, lambda x: F.when(F.size(F.coalesce(x, F.array().cast("array<string>"))) > 0, F.concat(F.lit(head), F.array_join(x, sep))))
    found = F.array_compact(F.array(part("sinks: ", sinks, ", "), part("imports: ", imported, "; "), part("suspected CWEs: ", cwes, ", ")))
    head = F.array_join(F.slice(_lines(code), 1, 20), " ")
    return F.concat_ws(" ", path, _once(found, lambda parts: F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(head)))


def _lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, "\n$", ""), "\r?\n"))


def unified_diff(response: Column, path: Column) -> Column:
    """The diff of that file in a response: from its header to the end or to a code fence; null without a header or a hunk."""
    at = lambda lines, test: F.array_position(F.transform(lines, test), True).cast("int")
    head = F.concat(F.lit("--- a/"), path)
    tail = _once(_lines(response), lambda lines: _once(at(lines, lambda x: F.startswith(F.ltrim(x), head)), lambda start: F.when(start > 0, F.slice(lines, start, F.size(lines)))))
    cut = lambda rest: _once(at(rest, lambda x: x.startswith("```")), lambda stop: F.when(stop > 0, F.slice(rest, F.lit(1), stop - 1)).otherwise(rest))
    return _once(F.array_join(_once(tail, cut), "\n"), lambda diff: F.when(F.contains(diff, F.lit("@@")), diff))


def plain_ascii(text: Column) -> Column:
    """ASCII characters that print, and white space."""
    return F.regexp_replace(text, r"[^\x21-\x7e \t\n\r\f]", "")


def override_fault(text: Column) -> Column:
    """Why a prompt override is refused; null if it is not."""
    low = F.lower(text)
    out = F.when(F.octet_length(text) > OVERRIDE_BYTES, f"Prompt override exceeds maximum length of {OVERRIDE_BYTES} characters").when(F.contains(text, F.lit("\0")), "Null bytes not allowed in prompt override")
    for p in SQL_PATTERNS:
        out = out.when(F.contains(low, F.lit(p.lower())), f"Potential SQL injection pattern detected: {p}")
    out = out.when(F.contains(low, F.lit("<script")) & F.contains(low, F.lit("</script>")), "Script tags not allowed in prompt override")
    for p in SHELL_PATTERNS:
        out = out.when(F.contains(low, F.lit(p)), f"Potential shell injection pattern detected: {p}")
    return out


def resolved(template: Column, outputs: dict[str, Column]) -> Column:
    """{{ role.out }} by that role's output, roles in order."""
    for role in sorted(outputs):
        template = F.replace(template, F.lit("{{ " + role + ".out }}"), F.coalesce(outputs[role], F.lit("")))
    return template


def placeholder_roles(template: Column) -> Column:
    """The roles of all {{role.field}} in order, as often as they stand there."""
    found = F.transform(F.regexp_extract_all(template, F.lit(r"(?s)\{\{(.*?)\}\}"), 1), lambda x: F.regexp_replace(F.split(x, r"\.")[0], r"^\s+|\s+$", ""))
    return F.filter(found, lambda x: x != "")


def rule_pattern(line: Column) -> Column:
    """PATTERN <id> <weakness> <return|param[n]> -> <sink>[<n>] <SEVERITY> as a struct(id, cwe, param, sink, position,
    severity); param is -1 for a returned value; null for anything else."""
    parts = F.filter(F.split(line, r"\s+"), lambda x: x != "")
    at = lambda k: F.try_element_at(parts, F.lit(k))
    param = F.when(at(4) == "return", F.lit(-1)).otherwise(F.regexp_extract(at(4), r"^param\[\+?(\d+)\]$", 1).try_cast("int"))
    opening = F.instr(at(6), "[")
    closing = F.instr(at(6), "]")
    position = F.when((opening > 0) & (closing > opening), F.regexp_extract(F.substring(at(6), opening + 1, closing - opening - 1), r"^\+?(\d+)$", 1)).try_cast("int")
    ok = (F.size(parts) >= 7) & (at(1) == "PATTERN") & param.isNotNull() & (at(5) == "->") & position.isNotNull() & at(7).isin("LOW", "MEDIUM", "HIGH", "CRITICAL")
    return F.when(ok, F.struct(at(2).alias("id"), at(3).alias("cwe"), param.alias("param"), F.substring(at(6), F.lit(1), opening - 1).alias("sink"), position.alias("position"), at(7).alias("severity")))


def rule_matches(pattern: Column, code: Column) -> Column:
    """Whether code names the sink and, for a parameter, calls it with more arguments than the parameter's number."""
    sink = pattern["sink"]
    after = F.when(F.instr(code, F.concat(sink, F.lit("("))) > 0, F.substring(code, F.instr(code, F.concat(sink, F.lit("("))) + F.length(sink) + 1, F.length(code)))
    args = F.when(F.instr(after, ")") > 0, F.regexp_replace(F.substring(after, F.lit(1), F.instr(after, ")") - 1), r"^\s+|\s+$", ""))
    n = F.when(args == "", 0).otherwise(F.size(F.split(args, ",")))
    return F.contains(code, sink) & ((pattern["param"] < 0) | F.coalesce(n > pattern["param"], F.lit(False)))


def rule_yaml(pattern: Column) -> Column:
    """A taint rule for the scanner, as YAML."""
    returned = pattern["param"] < 0
    number = pattern["param"].cast("string")
    source = F.when(returned, "pattern: $FN = ...").otherwise(F.concat(F.lit("pattern: $FN(..., $ARG"), number, F.lit(", ...)")))
    label = F.when(returned, "return value").otherwise(F.concat(F.lit("parameter "), number))
    rows = [
        F.lit("rules:"), F.concat(F.lit("  - id: "), pattern["id"]), F.lit("    mode: taint"), F.lit("    pattern-sources:"), F.lit("      - patterns:"), F.concat(F.lit("          - "), source),
        F.lit("    pattern-sinks:"), F.lit("      - patterns:"), F.concat(F.lit("          - pattern: "), pattern["sink"], F.lit("($X, ...)")),
        F.concat(F.lit('    message: "Potential '), pattern["cwe"], F.lit(" vulnerability: taint flows from "), label, F.lit(" to "), pattern["sink"], F.lit('"')),
        F.concat(F.lit("    severity: "), pattern["severity"]), F.lit("    metadata:"), F.concat(F.lit("      cwe: "), pattern["cwe"]), F.lit("      mocq_generated: true"), F.lit(""),
    ]
    return F.concat_ws("\n", *rows)
