"""The verdict state machine, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import at_least

#: The gate's questions in the order in which they decide.
QUESTIONS = ("reachability", "controllability", "preconditions", "context", "impact", "evidence", "confidence")
#: Words of a sensitive change of state.
SENSITIVE = ("privilege", "escalat", "role", "permission", "auth", "session", "capability", "csrf", "nonce", "token")


def answer(text: Column) -> Column:
    """True, false, or null for neither."""
    t = F.lower(F.trim(text))
    return F.when(t.rlike("^(yes|true|confirmed)"), True).when(t.rlike("^(no|false)"), False)


def known_status(status: Column) -> Column:
    return F.when(status.isin("confirmed", "false_positive", "needs_review", "failed"), status).otherwise("needs_review")


def gate(status: Column, answers: dict[str, Column] | None, attack_vector: Column, theoretical: Column, has_gate: Column, has_proof: Column) -> Column:
    """The status after the seven questions and the impact proof; only confirmed findings are questioned."""
    a = {q: answer(c) for q, c in (answers or {}).items()}
    no = lambda q: F.coalesce(~a[q], F.lit(False))
    out = F.when(~F.coalesce(status == "confirmed", F.lit(False)), status).when(~has_gate, "needs_review")
    out = out.when(no("reachability") | no("controllability"), "needs_review").when(F.coalesce(a["preconditions"], F.lit(False)) | no("context"), "false_positive")
    out = out.when(no("impact") | no("evidence") | no("confidence"), "needs_review")
    return out.when(has_proof & ((F.trim(F.coalesce(attack_vector, F.lit(""))) == "") | F.coalesce(theoretical, F.lit(False))), "needs_review").otherwise(status)


def saw_no_code(snippet: Column, line: Column) -> Column:
    return (F.trim(F.coalesce(snippet, F.lit(""))) == "") & line.isNull()


def blind_cap(status: Column, snippet: Column, line: Column) -> Column:
    return F.when(saw_no_code(snippet, line) & (status == "confirmed"), "needs_review").otherwise(status)


def sensitive_mutation(title: Column, description: Column) -> Column:
    return F.lower(F.concat_ws(" ", title, description)).rlike("|".join(SENSITIVE))


def by_primitive(status: Column, required_present: Column, sensitive: Column) -> Column:
    """A required check in the named function refutes a confirmed finding; its absence corroborates a sensitive one."""
    return F.when(required_present & (status == "confirmed"), "needs_review").when(~required_present & sensitive & (status == "needs_review"), "confirmed").otherwise(status)


def _noted(notes: Column, reason: Column) -> Column:
    return F.when(F.trim(F.coalesce(notes, F.lit(""))) == "", reason).otherwise(F.concat(notes, F.lit(" ("), reason, F.lit(")")))


def refuted(status: Column, notes: Column, primitive: Column, fault: Column, path: Column) -> Column:
    """struct(status, notes): a confirmed finding whose named function holds a required check is a false positive; where the file
    cannot be read it needs review. primitive and fault: of ``anchors.primitives``."""
    confirmed = F.coalesce(status == "confirmed", F.lit(False))
    found, unread = confirmed & primitive.isNotNull(), confirmed & fault.isNotNull()
    reason = F.when(found, F.concat(F.lit("not confirmed: "), primitive, F.lit(" found in the body of the function this finding names"))).when(unread, F.concat(fault, F.lit(": "), path))
    return F.struct(F.when(found, "false_positive").when(unread, "needs_review").otherwise(status).alias("status"), F.when(reason.isNotNull(), _noted(notes, reason)).otherwise(notes).alias("notes"))


def by_absence(status: Column, notes: Column, primitive: Column, fault: Column, path: Column, sensitive: Column, enabled: bool = True) -> Column:
    """struct(status, notes): for a sensitive change of state the absence of a required check confirms or corroborates; its
    presence leaves review, or asks for it; a file that cannot be read changes nothing but the notes."""
    was = status == "confirmed"
    asked = F.coalesce(status.isin("confirmed", "needs_review") & sensitive, F.lit(False)) & F.lit(enabled)
    here = F.lit(" found in the body of the function this finding names")
    reason = (
        F.when(primitive.isNotNull() & was, F.concat(F.lit("downgraded from confirmed: "), primitive, here, F.lit(" — primitive may be a mitigation")))
        .when(primitive.isNotNull(), F.concat(F.lit("not confirmed by absence: "), primitive, here))
        .when(fault.isNotNull(), F.concat(F.lit("not confirmed by absence: cannot read file to check for primitive ("), fault, F.lit(": "), path, F.lit(")")))
        .when(was, "corroborated by absence: no security primitive found in the body of the function this finding names")
        .otherwise("confirmed by absence: no security primitive found in the body of the function this finding names")
    )
    new = F.when(primitive.isNotNull(), "needs_review").when(fault.isNotNull(), status).otherwise("confirmed")
    return F.struct(F.when(asked, new).otherwise(status).alias("status"), F.when(asked, _noted(notes, reason)).otherwise(notes).alias("notes"))


def exploit_confirmed(triage: Column) -> Column:
    """A confirmed exploit passes triage where nothing was decided."""
    return F.coalesce(triage, F.lit("pass"))


def compiled(compiles: Column, error: Column) -> Column:
    """struct(status, note) of a proof of concept's compilation."""
    return F.struct(F.when(compiles, "confirmed").otherwise("failed").alias("status"), F.when(compiles, "PoC compiled successfully").otherwise(F.concat(F.lit("PoC compilation failed: "), F.coalesce(error, F.lit("")))).alias("note"))


def after_batch_error(status: Column) -> Column:
    return F.when(status == "confirmed", status).otherwise("needs_review")


def wants_proof_of_concept(status: Column, severity: Column) -> Column:
    return (status.isNull() | (status == "confirmed")) & at_least(severity, "high")


def agent_verdict(text: Column) -> Column:
    """From JSON if it is some, else from words."""
    found = F.try_variant_get(F.try_parse_json(text), "$.verdict", "string")
    low = F.lower(text)
    return F.when(found.isNotNull(), known_status(found)).when(F.contains(low, F.lit("false positive")), "false_positive").when(F.contains(low, F.lit("confirmed")), "confirmed").otherwise("needs_review")
