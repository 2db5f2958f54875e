"""Identities: finding ids, root causes, stable keys, content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weakness to hunt domain, as prompts use it.
HUNT_DOMAINS = {
    "injection": ("CWE-89", "CWE-78", "CWE-90", "CWE-119"),
    "xss": ("CWE-79", "CWE-80"),
    "auth": ("CWE-287", "CWE-285", "CWE-290"),
    "path_traversal": ("CWE-22", "CWE-23", "CWE-36"),
    "crypto": ("CWE-327", "CWE-328", "CWE-757"),
    "resource": ("CWE-400", "CWE-770", "CWE-190"),
    "deserialization": ("CWE-502", "CWE-503", "CWE-20"),
}
#: Weakness to domain, as stored runs use it.
RUN_DOMAINS = {
    "injection": ("CWE-78", "CWE-89", "CWE-90", "CWE-119", "CWE-564"),
    "xss": ("CWE-79", "CWE-80"),
    "auth": ("CWE-287", "CWE-285", "CWE-290", "CWE-384", "CWE-613"),
    "authz_absence": ("CWE-284", "CWE-862", "CWE-863", "CWE-639"),
    "path_traversal": ("CWE-22", "CWE-23", "CWE-35", "CWE-29"),
    "crypto": ("CWE-327", "CWE-326", "CWE-328", "CWE-757"),
    "resource": ("CWE-400", "CWE-770"),
    "deserialization": ("CWE-502", "CWE-503", "CWE-20"),
    "memory_safety": ("CWE-120", "CWE-787", "CWE-125", "CWE-190", "CWE-416", "CWE-476"),
}


def _bytes(c: Column) -> Column:
    return c.cast("binary")


def domain_of(cwe: Column, domains: dict[str, tuple[str, ...]]) -> Column:
    """Null for weaknesses outside the table."""
    out = F.lit(None).cast("string")
    for name, members in domains.items():
        out = F.when(cwe.isin(*members), name).otherwise(out)
    return out


def taxonomy(cwe: Column) -> Column:
    """domain/weakness of a stored run."""
    domain = F.coalesce(domain_of(cwe, RUN_DOMAINS), F.lit("uncategorized"))
    return F.when(cwe == "", "uncategorized/none").otherwise(F.concat(domain, F.lit("/"), F.coalesce(cwe, F.lit("none"))))


def squeeze(text: Column) -> Column:
    """Lower case, and one space for each run of white space."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"^\s+|\s+$", ""), r"\s+", " ")


def finding_id(path: Column, line_text: Column, cwe: Column, rule: Column, snippet: Column) -> Column:
    """The parts one after the other; an absent part adds nothing, and a missing snippet differs from an empty one."""
    nothing = F.lit("")
    tagged = F.when(snippet.isNull(), F.lit(bytearray(b"\x00"))).otherwise(F.concat(F.lit(bytearray(b"\x01")), _bytes(snippet)))
    return F.sha2(F.concat(_bytes(path), _bytes(F.coalesce(line_text, nothing)), _bytes(F.coalesce(cwe, nothing)), _bytes(F.coalesce(rule, nothing)), F.unhex(F.sha2(tagged, 256))), 256)


def root_cause(title: Column, path: Column, snippet: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lower(title), path, F.regexp_replace(F.coalesce(snippet, F.lit("")), r"\s", "")), 256)


def stable_key(cwe: Column, snippet: Column, title: Column, path: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x00", taxonomy(cwe), squeeze(F.coalesce(snippet, title)), path), 256), 1, 12)


def cache_key(model: Column, url: Column, temperature: Column, max_tokens: Column, messages: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", model, url, temperature.cast("string"), max_tokens.cast("string"), F.to_json(messages)), 256)


def wrapping_hash(text: Column) -> Column:
    """h = 31 h + byte, modulo 2^32."""
    codes = F.transform(F.split(F.regexp_replace(F.hex(_bytes(text)), "(..)", "$1 "), " "), lambda x: F.conv(x, 16, 10).cast("long"))
    return F.aggregate(F.filter(codes, lambda x: x.isNotNull()), F.lit(0).cast("long"), lambda h, x: (h * 31 + x) % (1 << 32))
