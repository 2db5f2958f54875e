"""What projects, titles and outputs tell: stacks, types, domains, components, behaviours, advice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a Cargo manifest and the kind of project, in order; the manifest is lower-cased first.
CARGO_KINDS = (
    ("cli", ("clap", "structopt", "docopt", "atty")),
    ("web", ("actix", "axum", "rocket", "warp", "express", "next", "react", "koa", "hono")),
    ("embedded", ("no_std", "cortex-m", "xtensa", "thumbv", "rtic")),
    ("firmware", ("esp32", "esp-idf", "stm32", "teensy", "embedded-hal", "panic-halt")),
    ("desktop", ("electron", "tauri", "iced", "egui", "rustdesk")),
    ("game", ("bevy", "gloo", "pygame", "sdl2", "krom", "kiss3d", "rodio", "ggez")),
    ("library", ("[lib]",)),
)
#: The same for a package manifest, as it stands.
PACKAGE_KINDS = (
    ("cli", ('"bin"', '"commander"', '"yargs"', '"/cli"', '"meow"', '"inquirer"', "chalk", "figlet")),
    ("web", ('"react"', '"next"', '"vue"', '"svelte"', '"nuxt"', '"sugarss"', "express", "nest", "nestjs", "angular", "remix")),
    ("embedded", ('"nikoajs"', '"esim"', '"native-audio"')),
    ("firmware", ('"esp-idf"', '"arduino"', '"platformio"')),
    ("desktop", ('"electron"', '"tauri"', '"nativefier"')),
    ("game", ('"three"', '"babylonjs"', '"phaser"', '"playcanvas"', '"cannon"', '"pixi"', "pixi.js", "pixijs")),
    ("library", ('"main"', '"types"')),
)
#: Words that show a component.
COMPONENTS = {
    "has_http": ("HTTP", "endpoint", "router", "axum", "actix", "warp", "rocket", "tower", "express", "flask", "django", "fastapi", "spring", "gin", "echo", "http::", "actix_web", "axum::"),
    "has_db": ("sqlite", "postgres", "mysql", "mongodb", "redis", "database", "data store", "Repository", "Entity", "migration", "sqlx", "diesel", "orm", "prisma"),
    "has_files": ("fs::read", "fs::write", "File::open", "File::create", "tempfile", "file upload", "filesystem", "std::fs", "read_to_string"),
    "has_auth": ("auth", "session", "token", "jwt", "password", "credential", "oauth", "bearer", "authentication", "authorization"),
}
#: What an expected behaviour is called, and the patterns of an output that shows it.
EXPECTED = {
    "file_access": ("file", "access", "read", "write", "open", "directory", "path"),
    "network": ("network", "connect", "socket", "http", "request", "server"),
    "privilege_change": ("privilege", "root", "sudo", "uid", "gid", "permission"),
    "data_leak": ("leak", "secret", "token", "key", "credential", "password"),
    "code_execution": ("execute", "command", "system", "code", "shell", "eval"),
    "crash": ("crash", "error", "fail", "panic", "exception", "segmentation"),
}
SHOWN = {
    "file_access": (r"open\(", "fopen", r"read\(", r"write\(", "permission denied", "no such file", "access denied", r"\.txt", r"\.py", r"\.sh", "/etc/", "/proc/", r"\.\./"),
    "network": ("connect", "bind", "socket", "get /", "post ", "http/", r"127\.0\.0\.1", "localhost", r":\d{2,5}", "response", "status"),
    "privilege_change": ("uid=", "gid=", "root", "sudo", "permission", "euid=", "egid="),
    "data_leak": ("secret", "token", "api[_-]?key", "password", "credential", "private[_-]?key", "bearer ", "sk[_-]", "pk[_-]", "-----begin"),
    "code_execution": (r"exec\(", r"system\(", "subprocess", r"cmd\s*=", "bash", r"sh\s+-c", "/bin/(ba)?sh", r"uid=\d+", "process", "pid=", "command executed", "executed:"),
    "crash": ("sigsegv", "segmentation fault", "panic", "abort", "fatal", "traceback", "exception", "error:", "exit code [1-9]"),
}
#: Languages and the domains that are hunted in them.
HUNTED = (
    (("c", "cpp", "h"), ("injection", "crypto", "resource", "memory_safety")),
    (("rust",), ("injection", "crypto", "memory_safety")),
    (("javascript", "typescript"), ("xss", "injection", "auth", "path_traversal")),
    (("php",), ("xss", "injection", "path_traversal", "deserialization")),
    (("python",), ("injection", "auth", "path_traversal")),
    (("java", "csharp"), ("injection", "auth", "crypto", "deserialization")),
    (("go",), ("injection", "crypto", "resource")),
)
HUNTED_ANYWAY = ("injection", "auth")
#: Words of a title and the advice for it, in order.
ADVICE = (
    (("sql",), "Use parameterized queries or prepared statements instead of string concatenation"),
    (("command", "shell"), "Avoid shell command execution with user input. Use safe APIs or validate/sanitize input rigorously"),
    (("xss", "cross-site scripting"), "Escape user output properly. Use context-aware encoding (HTML, JS, URL)"),
    (("buffer", "overflow"), "Use bounds checking and safe string functions. Validate input lengths before operations"),
    (("use after free", "uaf"), "Ensure proper lifetime management. Use smart pointers (Rust) or explicit nullification after free"),
    (("null", "dereference"), "Check for null pointers before dereferencing. Use Option types where appropriate"),
    (("format", "string"), "Use format specifiers correctly. Never pass user input directly as format string"),
)
#: Extensions and folders that a search for variants leaves out.
BINARY_EXTENSIONS = ("bin", "so", "dll", "dylib", "exe", "png", "jpg", "jpeg", "gif", "ico", "pdf", "zip", "tar", "gz", "rar", "lock", "sum", "md5", "sha")
SKIPPED_FOLDERS = ("target", "node_modules", ".git", "dist", "build")
#: Words that are no function's name.
NO_NAMES = ("if", "for", "while", "match", "let", "const", "var")
#: How code names a function, in the order in which it is looked for.
NAMED = (r"function\s+([a-zA-Z_][a-zA-Z0-9_]*)", r"def\s+([a-zA-Z_][a-zA-Z0-9_]*)", r"fn\s+([a-zA-Z_][a-zA-Z0-9_]*)", r"([a-zA-Z_][a-zA-Z0-9_]*)\s*\(")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return F.coalesce(out, F.lit(False))


def _first(text: Column, kinds) -> Column:
    out = None
    for kind, words in kinds:
        out = F.when(_any(text, words), kind) if out is None else out.when(_any(text, words), kind)
    return out


def project_type(cargo: Column, package: Column) -> Column:
    """Of the texts of the two manifests (null where there is none): the first decides if it can."""
    return F.coalesce(_first(F.lower(cargo), CARGO_KINDS), _first(package, PACKAGE_KINDS), F.lit("unknown"))


def components(text: Column) -> list[Column]:
    """has_http, has_db, has_files, has_auth of one file's text."""
    return [_any(F.lower(text), tuple(w.lower() for w in words)).alias(name) for name, words in COMPONENTS.items()]


def expected_categories(expected: Column) -> Column:
    low = F.lower(expected)
    return F.array_compact(F.array(*[F.when(_any(low, words), F.lit(name)) for name, words in EXPECTED.items()]))


def shows_expected(stdout: Column, stderr: Column, expected: Column) -> Column:
    """Whether an output shows one of the behaviours that are expected; true where none is."""
    out, low = F.lower(F.concat_ws(" ", F.coalesce(stdout, F.lit("")), F.coalesce(stderr, F.lit("")))), F.lower(expected)
    hit, any_ = F.lit(False), F.lit(False)
    for name, words in EXPECTED.items():
        asked = _any(low, words)
        any_, hit = any_ | asked, hit | (asked & out.rlike("|".join(SHOWN[name])))
    return ~any_ | hit


def hunt_domains(languages: Column) -> Column:
    """The domains of these languages in order of name."""
    lower = F.transform(languages, F.lower)
    found = F.array_distinct(F.flatten(F.array(*[F.when(F.arrays_overlap(lower, F.array(*[F.lit(x) for x in langs])), F.array(*[F.lit(d) for d in domains])).otherwise(F.array().cast("array<string>")) for langs, domains in HUNTED])))
    return F.array_sort(F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(d) for d in HUNTED_ANYWAY])))


def recommendation(title: Column, description: Column) -> Column:
    low, about = F.lower(title), F.lower(description)
    out = None
    for words, advice in ADVICE:
        out = F.when(_any(low, words), advice) if out is None else out.when(_any(low, words), advice)
    out = out.when(_any(about, ("user",)) & _any(about, ("input",)), "Validate and sanitize all user input before use").when(_any(about, ("untrusted",)), "Treat all external data as untrusted. Apply strict validation and encoding")
    return out.otherwise(F.concat(F.lit("Review and fix this "), title, F.lit(" vulnerability. Follow secure coding practices for this category")))


def function_name(snippet: Column, title: Column) -> Column:
    """The function that a finding is about: of its snippet, or of its title without one; keywords are no names."""
    text = F.coalesce(snippet, title)
    return F.coalesce(*[F.when((name := F.regexp_extract(text, pattern, 1)) != "", F.when(~name.isin(*NO_NAMES), name)) for pattern in NAMED])


def entry_point(title: Column) -> Column:
    """The first token of a title, cut at brackets and blanks."""
    return F.try_element_at(F.filter(F.transform(F.split(title, r"[( ]"), F.trim), lambda x: (x != "") & (x != "&")), F.lit(1))


def normal_cwe(cwe: Column) -> Column:
    low = F.lower(F.trim(cwe))
    return F.when(low.rlike(r"^\d*$"), F.concat(F.lit("cwe-"), low)).otherwise(low)


def searched_for_variants(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r".\.([^.]*)$", 1))
    return ~ext.isin(*BINARY_EXTENSIONS) & ~path.rlike(r"(^|/)(" + "|".join(d.replace(".", r"\.") for d in SKIPPED_FOLDERS) + ")/")


def variant_pattern(sample: Column) -> Column:
    """A code sample as a regular expression, its stars standing for anything."""
    for a, b in ((".", "\\."), ("*", ".*"), ("+", "\\+"), ("?", "\\?"), ("(", "\\("), (")", "\\)"), ("[", "\\["), ("]", "\\]")):
        sample = F.replace(sample, F.lit(a), F.lit(b))
    return sample


def owner_repo(url: Column) -> Column:
    """struct(owner, repo) of a remote; null for anything else."""
    plain = F.regexp_replace(F.trim(url), r"[?#].*$", "")
    ssh, web = r"^(?:git@)+[^:]*:([^/]*)/(.*)$", r"^(?:https://|http://)+[^/]*/([^/]*)/([^/]*).*$"
    at = lambda k: F.when(plain.startswith("git@"), F.regexp_extract(plain, ssh, k)).otherwise(F.regexp_extract(plain, web, k))
    fits = (plain.startswith("git@") & plain.rlike(ssh)) | plain.rlike(web)
    return F.when(fits, F.struct(at(1).alias("owner"), F.regexp_replace(at(2), r"(?i)\.git$", "").alias("repo")))


def commit_reference(url: Column, commit: Column, author: Column, message: Column) -> Column:
    o = owner_repo(url)
    return F.when(o.isNotNull(), F.concat(F.lit("https://github.com/"), o["owner"], F.lit("/"), o["repo"], F.lit("/commit/"), F.substring(commit, 1, 7))).otherwise(F.concat(commit, F.lit(":"), author, F.lit(":"), message))


def should_rewrite(succeeded: Column, signals: Column, channels: Column) -> Column:
    """Whether an agent flow is to be rewritten. signals: kinds (sanitizer_crash, coverage_increase, pass, fail); channels: coverage,
    sanitizer, outcome, or others."""
    has = lambda kind: F.array_contains(signals, kind)
    watched = F.arrays_overlap(channels, F.array(F.lit("coverage"), F.lit("sanitizer"), F.lit("outcome")))
    return ~succeeded | has("fail") | (watched & ~has("pass") & ~has("sanitizer_crash"))
