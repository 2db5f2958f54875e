"""The finding row and its companions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from the worst to the least.
SEVERITIES = ("critical", "high", "medium", "low", "info")
#: What verification says.
STATUSES = ("confirmed", "false_positive", "needs_review", "failed")
TIERS = ("verified", "supported", "unverified")

EVIDENCE = "source struct<kind string, label string>, weight double, detail string, ts timestamp"

FINDING = (
    """
    id string, title string, description string, severity string, confidence_score double, cwe_id string,
    file_path string, line_number int, code_snippet string, diff_hunk string, recommendation string, code_location string,
    sources array<string>, commit_reference string, ticket_reference string, priority_score double,
    cross_file_references array<string>, related_finding_ids array<string>,
    verification_status string, verification_notes string, verification_error string, agent_evidence_path string,
    security_issue struct<category string, cwe_id string, owasp_category string, mitre_attack string, custom_tags array<string>>,
    poc_code string, mitigation_code string, poc_format string, llm_model string, agent_mode boolean,
    statement_range struct<start int, end int>, triage_verdict struct<kind string, adjusted_severity string, chain_partner_ids array<string>>,
    evidence array<struct<source struct<kind string, label string>, weight double, detail string, ts timestamp>>, verification_tier string,
    verification_gate_answers array<struct<question string, answer boolean>>
    """
)


def severity_rank(severity: Column) -> Column:
    """4 for critical down to 0 for info; null for anything else."""
    out = F.when(severity == SEVERITIES[0], 4)
    for k, name in enumerate(SEVERITIES[1:], 1):
        out = out.when(severity == name, 4 - k)
    return out


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in reversed(SEVERITIES)]), rank + 1)


def worse(a: Column, b: Column) -> Column:
    """The raise-only merge of two severities."""
    return severity_name(F.greatest(severity_rank(a), severity_rank(b)))


def at_least(severity: Column, least: str) -> Column:
    return F.coalesce(severity_rank(severity), F.lit(-1)) >= 4 - SEVERITIES.index(least)
