"""Tokenizers, paths, identifiers and short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions and their languages.
EXTENSIONS = {
    "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "hh": "cpp", "cxx": "cpp", "hxx": "cpp", "rs": "rust", "py": "python", "pyw": "python",
    "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "cs": "csharp", "rb": "ruby", "php": "php", "phtml": "php",
}
#: Words that are no keywords of code.
CODE_STOP_WORDS = ("the", "and", "for", "with", "this", "that", "from", "have", "has", "int", "void", "char", "struct", "return", "if", "else", "while", "do", "switch", "case", "break", "continue", "goto")
#: Words that carry no meaning in a ticket query.
TICKET_STOP_WORDS = ("the", "a", "an", "is", "are", "in", "on", "with", "for", "to", "of", "and", "or", "no", "missing", "lack")
#: What a sink call looks like.
SINKS = (
    "eval", "exec", "system", "popen", "query", "execute", "innerHTML", "dangerouslySetInnerHTML", "unserialize", "strcpy", "memcpy", "sprintf", "gets", "$wpdb->", "Runtime.exec", "child_process",
    "subprocess", "shell_exec", "passthru", "proc_open", "popen", "curl_exec", "file_get_contents", "include", "require", "eval(", "exec(", "system(",
)
#: Ticket queries name the first of these kinds and languages.
TICKET_KINDS = ("injection", "xss", "xxe", "sql", "path traversal", "overflow", "deserialization", "buffer", "race condition", "privilege", "authentication", "authorization", "csrf", "ssrf", "xml", "yaml")
TICKET_LANGUAGES = ("python", "javascript", "rust", "c++", "java", "go", "ruby", "php")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def identifiers(text: Column) -> Column:
    """Lower-cased ASCII identifiers of more than two bytes."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("([a-zA-Z0-9_]+)"), 1), F.lower), lambda x: F.octet_length(x) > 2)


def keywords(code: Column) -> Column:
    return F.concat_ws(" ", F.filter(words(code), lambda x: (F.octet_length(x) > 2) & ~x.isin(*CODE_STOP_WORDS) & ~x.rlike(r"^\p{N}+$")))


def meaningful(text: Column, n: int) -> Column:
    return F.concat_ws(" ", F.slice(F.filter(F.split(F.trim(text), r"\s+"), lambda w: (F.octet_length(w) > 3) & ~F.lower(w).isin(*TICKET_STOP_WORDS)), 1, n))


def ellipsis(text: Column, n: int) -> Column:
    """At most n bytes; longer texts keep n - 3 characters, and an ellipsis."""
    return F.when(F.octet_length(text) > n, F.concat(F.substring(text, 1, max(0, n - 3)), F.lit("..."))).otherwise(text)


def sink_calls(code: Column) -> Column:
    """The sink tokens that occur in the code, case aside, in their listed order."""
    low = F.lower(code)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(s.lower())), F.lit(s)) for s in SINKS]))


def ticket_query(title: Column) -> Column:
    """What to search for: CVE words, the first known kind, the first known language; else two meaningful words."""
    low = F.lower(title)
    cves = F.filter(F.split(F.trim(title), r"\s+"), lambda w: w.startswith("CVE-") | w.startswith("CVE:"))
    first = lambda options: F.coalesce(*[F.when(F.contains(low, F.lit(o)), F.lit(o)) for o in options])
    parts = F.array_compact(F.concat(cves, F.array(first(TICKET_KINDS), first(TICKET_LANGUAGES))))
    query = F.when(F.size(parts) > 0, F.concat(F.array_join(parts, " "), F.lit(" state:open"))).otherwise(meaningful(title, 2))
    head = F.coalesce(F.nullif(F.element_at(F.split(F.trim(title), r"\s+"), 1), F.lit("")), F.lit("security"))
    return F.when(F.octet_length(query) < 5, F.concat(F.lit("vulnerability "), head, F.lit(" state:open"))).otherwise(query)


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(".")


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]*)$", 1))


def language_of(path: Column, only: tuple[str, ...] | None = None) -> Column:
    """Null for unknown extensions and, if languages are given, for others."""
    ext = extension(path)
    out = F.lit(None).cast("string")
    for e, lang in EXTENSIONS.items():
        if only is None or lang in {x.lower() for x in only}:
            out = F.when(ext == e, lang).otherwise(out)
    return out


def cwe_number(cwe: Column) -> Column:
    """The text after the first dash."""
    return F.when(F.contains(cwe, F.lit("-")), F.regexp_extract(cwe, r"^[^-]*-(.*)$", 1))


def cwe_int(cwe: Column) -> Column:
    return F.regexp_replace(cwe, "^(CWE-)+", "").try_cast("int")


def functions_in(title: Column) -> Column:
    return F.regexp_extract_all(title, F.lit(r"([A-Za-z_]\w*) *\("), 1)


def location(path: Column, line: Column) -> Column:
    return F.concat_ws(":", path, line.cast("string"))


def append_note(notes: Column, note: Column) -> Column:
    return F.concat_ws("\n", F.nullif(notes, F.lit("")), note)


def strip_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def remove_between(text: Column, start: str, end: str) -> Column:
    import re

    quote = lambda s: re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", s)
    return F.regexp_replace(text, f"(?s){quote(start)}.*?{quote(end)}", "")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def render(template: str, values: dict[str, Column]) -> Column:
    """{{name}} by its value."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{{" + k + "}}"), F.coalesce(v, F.lit("")))
    return out
