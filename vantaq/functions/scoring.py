"""Row-wise scores: evidence tiers, refined confidence, normalisation, consensus, priorities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import at_least

#: Which kind a source of evidence is of.
EVIDENCE_KINDS = {"semgrep": "static", "cpg_slice": "static", "llm_analysis": "llm", "rule_synthesis": "llm", "independent_verifier": "verifier", "security_agent_verification": "verifier", "cwe_spec": "specification"}
#: Code that speaks against, and for, a weakness; patterns that are never worth a report.
FALSE_POSITIVE_PATTERNS = {
    "CWE-79": ("html_escape", "escape_html", "sanitize.*html", "textContent", "innerText"),
    "CWE-89": ("ORM", "ActiveRecord", "prepare.*statement", "parameterized", "find_by"),
    "CWE-22": ("basename.*path", "normalize.*path", "realpath"),
}
HIGH_CONFIDENCE_PATTERNS = {
    "CWE-79": ("innerHTML", "dangerouslySetInnerHTML", r"document\.write"),
    "CWE-89": (r"execute.*\(.*\+", r"query.*\+.*param", "raw.*sql"),
}
NEVER_SUBMIT = {
    "CWE-693": "(?i)missing.*header|content\\.security\\.policy|x-frame-options|hsts",
    "CWE-601": "open.redirect",
    "self-xss": "self.xss|reflected.*same.origin",
    "CWE-918": "ssrf.*dns.*callback|ssrf.*without.*oob",
}
#: Code words that support and contradict a weakness.
SUPPORT = {
    "user_input": ("request", "param", "query", "input", "body"),
    "unsafe_sinks": (".exec(", "eval", "system", "shell"),
    "direct_access": ("readFile", "read_file", "open(", ".read()"),
}
CONTRADICT = {
    "validation": ("validate", "sanitize", "escape", "check", "verify"),
    "safe_api": ("preparedStatement", "parameterized", "bindParam", "placeholder"),
    "auth_check": ("requireAuth", "isAuthenticated", "checkAuth", "authorized"),
}
LOW_CONFIDENCE_SOURCES = ("bandit", "gosec")


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def has(text: Column, *parts: str) -> Column:
    """Whether any part occurs; false for null."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return F.coalesce(out, F.lit(False))


def evidence_kinds(sources: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in EVIDENCE_KINDS.items() for x in kv])
    return F.array_distinct(F.transform(sources, lambda s: kinds[s]))


def tier(sources: Column, confidence: Column) -> Column:
    """sources: where the items of evidence come from, one each."""
    kinds = evidence_kinds(sources)
    return F.when((F.size(kinds) >= 2) & F.array_contains(kinds, "verifier"), "verified").when((F.size(sources) >= 2) | (F.round(confidence, 6) > 0.8), "supported").otherwise("unverified")


def pattern_hit(cwe: Column, code: Column, patterns: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit(False)
    for c, rules in patterns.items():
        out = out | ((cwe == c) & code.rlike("|".join(rules)))
    return F.coalesce(out, F.lit(False))


def never_submit(title: Column, description: Column, cwe: Column) -> Column:
    """The label of the first pattern that matches."""
    text = F.lower(F.concat_ws(" ", title, description, F.coalesce(cwe, F.lit(""))))
    return F.coalesce(*[F.when(text.rlike(p), F.lit(label)) for label, p in NEVER_SUBMIT.items()])


def code_context(code: Column) -> Column:
    """1 if more words support than contradict, -1 the other way, else 0."""
    low = F.lower(code)
    count = lambda groups: sum((F.contains(low, F.lit(w.lower())).cast("int") for words in groups.values() for w in words), F.lit(0))
    return F.signum(count(SUPPORT) - count(CONTRADICT)).cast("int")


def refinement(row: dict[str, Column], multiplier: float = 0.1) -> tuple[Column, Column]:
    """The refined confidence and the factors at work. row: confidence_score, verification_status, sources, cross_file (boolean), code_snippet,
    cwe_id, severity, file_path, verification_notes, title, description. Every step is clamped on the side it moves to."""
    code, notes, path = row["code_snippet"], row["verification_notes"], F.lower(row["file_path"])
    steps: list[tuple[Column, float, str | None]] = []

    def step(when: Column, by: float, factor: str | None) -> None:
        steps.append((F.coalesce(when, F.lit(False)), by, factor))

    status = row["verification_status"]
    step(status == "confirmed", 0.15, "verified_by_llm")
    step(status == "false_positive", -0.3, "false_positive_detected")
    step(status == "failed", -0.1, None)
    step(F.size(row["sources"]) > 1, 0.1, "multi_source_confirmation")
    step(row["cross_file"], 0.08, "cross_file_reachability")
    known = pattern_hit(row["cwe_id"], code, FALSE_POSITIVE_PATTERNS)
    step(known, -0.2, "false_positive_pattern")
    step(~known & pattern_hit(row["cwe_id"], code, HIGH_CONFIDENCE_PATTERNS), 0.1, "historical_pattern_match")
    step(code_context(code) > 0, 0.05, "supports_vulnerability")
    step(code_context(code) < 0, -0.15, "contradicts_vulnerability")
    step(at_least(row["severity"], "high") & (F.round(row["confidence_score"], 6) > 0.7), 0.05, "severity_boost")
    step(has(path, "test", "mock"), -0.1, "test_code_related")
    step(has(path, "vendor", "node_modules", "third_party"), -0.15, "third_party_code")
    step(F.arrays_overlap(row["sources"], F.array(*[F.lit(s) for s in LOW_CONFIDENCE_SOURCES])), -0.05, "low_confidence_source")
    triage, rationale = has(notes, "triage", "Triage"), has(notes, "rationale", "Rationale")
    wrong = has(notes, "false_positive", "False positive")
    step(triage & wrong, -0.25, "triage_false_positive")
    step(triage & ~wrong & has(notes, "true_positive", "True positive"), 0.1, "triage_true_positive")
    sound = has(notes, "sound", "validated")
    step(rationale & sound, 0.1, "rationale_validated")
    step(rationale & ~sound & has(notes, "flawed", "invalid"), -0.2, "rationale_validated")
    # A fold over the moves: nesting one step in the next would double the expression each time.
    moves = F.array(*[F.when(when, F.lit(float(by))).otherwise(F.lit(0.0)) for when, by, _ in steps])
    score = F.aggregate(moves, row["confidence_score"], lambda s, d: F.when(d > 0, F.least(F.lit(1.0), s + d)).when(d < 0, F.greatest(F.lit(0.0), s + d)).otherwise(s))
    never = never_submit(row["title"], row["description"], row["cwe_id"])
    score = F.when(never.isNotNull(), F.greatest(F.lit(0.0), score * multiplier)).otherwise(score)
    factors = F.array_compact(F.array(*[F.when(when, F.lit(f)) for when, _, f in steps if f], F.when(never.isNotNull(), F.lit("never_submit_match"))))
    return unit(score), factors


def by_false_positive_rate(confidence: Column, rate: Column) -> Column:
    return F.when(rate > 0.3, confidence * (1 - rate / 2)).when(rate < 0.1, F.least(F.lit(1.0), confidence * (1 + 2 * (0.1 - rate)))).otherwise(confidence)


def by_z_score(confidence: Column, mean: Column, deviation: Column, n: Column, least: int = 10) -> Column:
    return F.when((n >= least) & (deviation != 0), unit(0.5 * (confidence - mean) / deviation + 0.5)).otherwise(confidence)


def consensus(status: Column, confidence: Column) -> dict[str, Column]:
    yes = F.coalesce((status == "confirmed").cast("int"), F.lit(0)) + (F.round(confidence, 6) >= 0.8).cast("int")
    no = F.coalesce((status == "false_positive").cast("int"), F.lit(0))
    score = F.when(yes + no == 0, confidence).otherwise(yes / (yes + no))
    wrong = F.coalesce(status == "false_positive", F.lit(False)) | ((no > yes) & (score < 0.3))
    advice = F.when(wrong, "exclude").when(F.round(score, 6) >= 0.7, "include").when(F.round(score, 6) >= 0.4, "needs_review").otherwise("manual_review")
    return {"agreement": yes, "total_sources": F.greatest(yes + no, F.lit(1)), "consensus_score": score, "is_false_positive": wrong, "recommendation": advice}


def ai_confidence(discovered: Column, status: Column, cross_file: Column, consensus_score: Column) -> Column:
    semantic = F.when(discovered, 0.8).otherwise(0.5)
    verification = F.when(status == "confirmed", 0.9).when(status == "false_positive", 0.1).otherwise(0.5)
    context = F.when(cross_file, 0.85).otherwise(0.6)
    return unit(0.25 * semantic + 0.35 * verification + 0.15 * context + 0.25 * consensus_score)


def risk_level(total: Column, false_positives: Column, high: Column, mean: Column) -> Column:
    half = F.floor(total / 2)
    return F.when(false_positives > half, "LOW").when(high > half, "CRITICAL").when(F.round(mean, 6) > 0.7, "HIGH").otherwise("MODERATE")


def rubric(reach: Column, control: Column, preconditions: Column, auth_required: Column, access: Column, blast: Column) -> Column:
    """The product of the rubric's weights."""
    return unit(unit(reach) * unit(control) * unit(preconditions) * F.when(auth_required, 0.5).otherwise(1.0) * F.when(access == "read", 0.5).when(access == "write", 0.8).otherwise(1.0) * F.when(blast == "low", 0.3).when(blast == "medium", 0.6).when(blast == "high", 0.85).otherwise(1.0))


def rubric_severity(score: Column) -> Column:
    s = F.round(score, 6)
    return F.when(s >= 0.8, "critical").when(s >= 0.5, "high").when(s >= 0.2, "medium").otherwise("low")


def priority(path: Column, size: Column, hooked: Column, has_sink: Column, age_days: Column, entry: float = 2.0, recent: float = 1.5, small: float = 1.2) -> Column:
    """Boosts of entry points, hooks, sinks, recent and small files, multiplied."""
    name = F.element_at(F.split(path, "/"), -1)
    first = name.rlike(r"^(main|index|app|server|__init__|__main__)\.")
    out = F.when(first, entry).otherwise(1.0) * F.when(hooked, entry).otherwise(1.0) * F.when(has_sink & (size <= 1 << 20), entry).otherwise(1.0)
    return out * F.when(age_days < 7, recent).otherwise(1.0) * F.when(size < 10 * 1024, small).otherwise(1.0)


def variant_similarity(matched: Column, keyword_hits: Column) -> Column:
    return F.least(F.lit(1.0), 0.4 + F.when(matched, 0.3).otherwise(0.0) + 0.15 * keyword_hits)


def backoff(base_ms: Column, attempt: Column) -> Column:
    return F.least(F.lit(30_000.0), base_ms * F.pow(F.lit(2.0), attempt))


def retry_class(status: Column) -> Column:
    return F.when(status.isin(400, 401, 403), "fail_fast").when((status == 429) | (status >= 500), "retry").otherwise("final")


def abstraction_level(budget: Column, low: int = 500, high: int = 2000) -> Column:
    return F.when(budget < low, "syntactic").when(budget < high, "functional").otherwise("semantic")
