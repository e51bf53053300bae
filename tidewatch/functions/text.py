"""Column helpers for audited text and paths. Patterns are Unicode-aware: (?U)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and extensions that decide what is read and what a file is for.
IGNORED_DIRS = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "env", ".env.d", "dist", "build", "target", ".next", ".nuxt", ".cache", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", "vendor", "site-packages", ".gradle", ".idea", ".vscode", "coverage", ".nyc_output")
SOURCE_EXTENSIONS = (".py", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".sh", ".bash", ".zsh", ".rb", ".go", ".rs", ".java", ".php", ".ps1", ".pl", ".lua")
CONFIG_EXTENSIONS = (".json", ".toml", ".yaml", ".yml", ".cfg", ".ini", ".md", ".txt")
NOTABLE_NAMES = ("Dockerfile", "Makefile", "makefile", "Procfile", ".npmrc", ".pypirc")
LOCKFILES = ("package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "bun.lock", "uv.lock", "poetry.lock", "pdm.lock", "pipfile.lock", "requirements.lock", "cargo.lock", "go.sum", "gemfile.lock", "composer.lock")
DOC_EXTENSIONS = (".md", ".mdx", ".rst", ".txt", ".adoc")
TEST_DIRS = ("test", "tests", "testing", "__tests__", "spec", "specs", "fixture", "fixtures", "testdata", "test_data", "e2e", "conftest")
DEV_DIRS = (".github", ".gitlab", ".circleci", "scripts", "script", "tools", "hack", "ci", "build-tools", "devtools", "examples", "example", "samples", "sample", "demo", "demos", "benchmarks", "benchmark")
TEST_NAME = r"(?i)(^|[._-])(test|tests|spec|conftest|fixtures?)([._-]|$)|(^|/)test_[^/]*$"
MAX_BYTES = 512 * 1024

# Sequences that could mislead a reader or a terminal, in the order in which they are removed.
ESCAPES = r"\x1B\[[0-9;?]*[ -/]*[@-~]|\x1B\][^\x07\x1B]*(?:\x07|\x1B\\)|\x1B[@-Z\\\-_]"
INVISIBLE = r"[‪-‮⁦-⁩​-‏؜﻿  ]"
CONTROLS = r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]"
HIDDEN = CONTROLS[:-1] + INVISIBLE[1:]  # a sign that each of them has; most texts have none


def decoded(content: Column) -> Column:
    """Bytes as text; what is not UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def once(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value) with value computed once, however often made names it."""
    return F.element_at(F.transform(F.array(value), made), 1)


def sanitize(text: Column) -> Column:
    def clean(x: Column) -> Column:
        out = x
        for pattern in (ESCAPES, INVISIBLE, CONTROLS):
            out = F.regexp_replace(out, pattern, "")
        return F.when(x.rlike(HIDDEN), out).otherwise(x)

    return once(F.coalesce(text, F.lit("")), clean)


def strip(text: Column) -> Column:
    """Without any Unicode white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def snippet(text: Column, limit: int = 200) -> Column:
    """One safe, bounded line."""
    clean = strip(F.translate(sanitize(text), "\t", " "))
    return F.when(F.length(clean) > limit, F.concat(F.left(clean, F.lit(limit - 1)), F.lit("…"))).otherwise(clean)


def lines_array(text: Column) -> Column:
    """Lines of sanitized text, without a phantom last one."""
    return once(F.split(text, "\r\n|[\n\r\u0085]"), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def normal_text(text: Column) -> Column:
    """Sanitized text with line feeds between its lines, without one at the end."""
    return F.regexp_replace(F.regexp_replace(F.replace(sanitize(text), F.lit("\r\n"), F.lit("\n")), "[\r\u0085]", "\n"), r"\n\z", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_extension(path: Column) -> Column:
    """Lower-case extension with its dot; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.].*?(\.[^.]*)$", 1))


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def file_role(path: Column) -> Column:
    """docs, test, dev or shipped: documents first, then tests, then development directories."""
    clean = F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", "")
    base = F.lower(basename(clean))
    dirs = directories(F.lower(clean))
    return (
        F.when(file_extension(base).isin(*DOC_EXTENSIONS), "docs")
        .when(F.arrays_overlap(dirs, F.array(*map(F.lit, TEST_DIRS))) | base.rlike(TEST_NAME), "test")
        .when(F.arrays_overlap(dirs, F.array(*map(F.lit, DEV_DIRS))), "dev")
        .otherwise("shipped")
    )


def is_shipped(path: Column) -> Column:
    """Null and empty paths count as shipped: nothing may fall out of the verdict unseen."""
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit(True)).otherwise(file_role(path) == "shipped")


def is_lockfile(path: Column) -> Column:
    return F.lower(basename(path)).isin(*LOCKFILES)


def is_scannable(path: Column) -> Column:
    """Known extension or notable name, and no ignored directory (case counts) on the way."""
    known = file_extension(path).isin(*SOURCE_EXTENSIONS, *CONFIG_EXTENSIONS) | basename(path).isin(*NOTABLE_NAMES)
    return known & ~F.arrays_overlap(directories(path), F.array(*map(F.lit, IGNORED_DIRS)))


def readability(content: Column, size: Column) -> Column:
    """large, unreadable, binary or ok, in the order in which a reader would find out."""
    return F.when(size > MAX_BYTES, "large").when(content.isNull(), "unreadable").when(F.position(F.lit(b"\x00"), F.substring(content, 1, 8192)) > 0, "binary").otherwise("ok")


def walk_key(path: Column) -> Column:
    """Orders paths as a walk meets them: a directory's files before its subdirectories, each sorted."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda x, i: F.concat(F.when(i == F.size(parts) - 1, "0").otherwise("1"), x))


def path_uri(path: Column, prefix: str = "") -> Column:
    """Percent-encoded, relative, forward slashes."""
    joined = F.regexp_replace(F.translate(path, "\\", "/"), "^/+", "")
    if prefix:
        joined = F.concat(F.lit(prefix.rstrip("/") + "/"), joined)
    out = F.url_encode(joined)
    for sign, plain in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return out


def fingerprint(rule_id: Column, uri: Column, text: Column) -> Column:
    """The same for a rule at the same place, whatever its line number."""
    return F.substring(F.sha2(F.concat_ws("\x1f", rule_id, F.coalesce(uri, F.lit("")), strip(F.coalesce(text, F.lit("")))), 256), 1, 32)


def markdown_escape(text: Column) -> Column:
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ")
    for sign, plain in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return F.regexp_replace(out, r"([\\`*_{}\[\]()#+!|~-])", r"\\$1")


def safe_json(text: Column, schema: str) -> Column:
    """A JSON object by its schema; null if it is malformed or no object."""
    whole = (F.substring(strip(text), 1, 1) == "{") & F.get_json_object(text, "$").isNotNull()
    return F.when(whole, F.from_json(text, schema, {"mode": "PERMISSIVE"}))


def age_text(seconds: Column) -> Column:
    return F.when(seconds < 60, "under a minute old").when(seconds < 7200, F.format_string("%d minutes old", F.floor(seconds / 60))).otherwise(F.format_string("%.1f hours old", seconds / 3600.0))


def normalize_repo(url: Column) -> Column:
    """host/owner/name in lower case, or null."""
    text = F.regexp_replace(strip(url), "/+$", "")
    text = F.regexp_replace(F.regexp_replace(text, r"^git\+", ""), r"\.git$", "")
    pattern = r"(?:https?://|git@)([^/:]+)[/:]([^/]+)/([^/]+)$"  # fixed value
    return F.when(text.rlike(pattern), F.lower(F.concat_ws("/", *[F.regexp_extract(text, pattern, i) for i in (1, 2, 3)])))


def search_terms(owner: Column, name: Column) -> Column:
    """The name without its ecosystem's affixes, the name, the owner; three terms of three letters at least."""
    # Fixed value: the affixes of server names.
    bare = F.regexp_replace(F.regexp_replace(name, r"(?:^mcp[-_])|(?:[-_]mcp$)|(?:[-_]?server$)", ""), "^[-_]+|[-_]+$", "")
    terms = F.array_compact(F.array(F.when((bare != "") & (bare != name) & (bare != owner), bare), name, owner))
    return F.slice(F.filter(terms, lambda t: F.length(t) > 2), 1, 3)


def parse_iso(text: Column) -> Column:
    """A timestamp from Z, offset or naive (UTC) forms; null for others. The session's time zone has to be UTC."""
    return F.try_to_timestamp(strip(text))


def age_days(created: Column, now: Column) -> Column:
    """Whole periods of 24 hours."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(created)) / 86400)
