"""Facts read from texts by patterns, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from millrace.functions import tokens

# A trailer that names a person, an address, and how a reference to an issue is declared.
TRAILER = r"(?s)^[A-Za-z][A-Za-z-]{1,40}: .*@"
ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
FIXES = r"(?i)\b(?:fix(?:e[sd])?|close[sd]?|resolve[sd]?)\s*:?\s+(?:#|GH-)(\d{1,7})\b"
MENTION = r"(?:^|[^\w/#])#(\d{1,7})\b"
MERGES, SQUASHED = r"^Merge pull request #(\d{1,7})", r"\(#(\d{1,7})\)\s*$"
URL_REFERENCE = r"https?://[^\s/]+/([\w.-]+/[\w.-]+)/(?:issues|pull)/(\d{1,7})"
#: Kinds of references, the weakest first.
LINKS = ("mentions", "squashed", "merges", "declares_fix")
# Kinds of path by folder, name and ending; the first that fits counts.
TEST = r"(^|/)(tests?|__tests__)/|(^|/)test_[^/]*$|(\.test|\.spec|_test)\.[^/]*$"
MANIFEST = r"(^|/)(package\.json|pyproject\.toml|requirements\.txt|go\.mod|Cargo\.toml|Gemfile|composer\.json|Makefile|CMakeLists\.txt)$"
WORKFLOW, MIGRATION, SCHEMA = r"(?i)\.github/workflows/", r"(?i)migration", r"(?i)schema[^/]*$"
DOC, CONFIG = r"(?i)\.(md|rst|txt)$", r"(?i)\.(json|toml|yaml|yml|ini|cfg)$|config[^/]*$"
SOURCE = r"(?i)\.(py|js|ts|tsx|jsx|vue|svelte|go|rs|java|rb|c|h|cpp|cs|swift|css|scss|sh)$"
KINDS = (("test", TEST), ("manifest", MANIFEST), ("workflow", WORKFLOW), ("migration", MIGRATION), ("schema", SCHEMA), ("doc", DOC), ("config", CONFIG), ("source", SOURCE))
# Folders, lock files and names that are never read, with the reason.
SKIPPED_FOLDERS = (
    r"\.git|node_modules|vendor|dist|build|out|\.next|target|coverage|__pycache__|\.venv|venv|Pods|\.terraform|__snapshots__|\.cache|\.tox|"
    r"\.mypy_cache|\.pytest_cache|generated|generated-clients"
)
LOCK_FILES = r"package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|Cargo\.lock|Gemfile\.lock|uv\.lock|composer\.lock|bun\.lockb?"
SKIPPED = rf"(^|/)({SKIPPED_FOLDERS})(/|$)|(^|/)({LOCK_FILES})$"
MINIFIED = r"(?i)\.(map|snap)$|\.min\.[^/]*$"
CREDENTIAL = r"(?i)(^|/)(\.env|credentials|secrets)[^/]*$|(^|/)(\.npmrc|\.pypirc|\.netrc|id_rsa|id_ed25519|id_ecdsa)$|\.(pem|key|p12|pfx|keystore)$"
REASONS = (("generated", SKIPPED), ("minified", MINIFIED), ("credential", CREDENTIAL))
# What a review of a package looks for, by severity.
REVIEW = (("high", r"(?i)\b(curl|wget)\b[^\n]*\|\s*(ba)?sh"), ("high", r"(?i)\brm\s+-rf\b"), ("medium", r"(?i)https?://"), ("low", r"(?i)\btoken\b"))


def sanitized(message: Column, most_subject: int = 200, most_body: int = 1500) -> Column:
    """(subject, body) of a message without control characters, trailers that name people, addresses and credentials.

    The subject is the first line that is no trailer. The bounds are the feature; what crosses one is blanked before the
    cut. A null message gives nulls.
    """
    blank = F.lit(" \t\n")
    clean = F.regexp_replace(message, r"[\x00-\x08\x0B-\x1F\x7F]", "")
    lines = F.filter(F.transform(F.split(clean, "\n"), lambda x: F.rtrim(x, blank)), lambda x: ~F.rlike(F.btrim(x, blank), F.lit(TRAILER)))
    lines = F.transform(lines, lambda x: F.regexp_replace(x, ADDRESS, "<redacted>"))
    told = lambda text, most: F.substring(tokens.redact(F.btrim(text, blank)), 1, most)

    def parted(held: Column) -> Column:
        subject = F.when(held.isNotNull(), F.coalesce(F.get(held, F.lit(0)), F.lit("")))
        body = F.array_join(F.slice(held, F.lit(2), F.greatest(F.size(held), F.lit(1))), "\n")
        return F.struct(told(subject, most_subject).alias("subject"), told(body, most_body).alias("body"))

    return F.get(F.transform(F.array(lines), parted), F.lit(0))  # the lines are made once


def references(message: Column) -> Column:
    """An array of (repository, number, strength), where strength is a place in LINKS. A number can occur more than once;
    repository is null but for addresses. Merges and squashes are read from the first line."""
    subject, none = F.get(F.split(message, "\n"), 0), F.lit(None).cast("string")

    def found(text: Column, pattern: str, link: str) -> Column:
        numbers = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return F.transform(numbers, lambda n: F.struct(none.alias("repository"), n.alias("number"), F.lit(LINKS.index(link)).alias("strength")))

    places, numbers = (F.regexp_extract_all(message, F.lit(URL_REFERENCE), F.lit(i)) for i in (1, 2))
    linked = F.zip_with(places, numbers, lambda r, n: F.struct(r.alias("repository"), n.alias("number"), F.lit(0).alias("strength")))
    return F.concat(found(subject, MERGES, "merges"), found(subject, SQUASHED, "squashed"), found(message, FIXES, "declares_fix"), linked, found(message, MENTION, "mentions"))


def _first(path: Column, table: tuple[tuple[str, str], ...], otherwise: str | None) -> Column:
    return F.coalesce(*[F.when(F.rlike(path, F.lit(pattern)), name) for name, pattern in table], F.lit(otherwise))


def path_kind(path: Column) -> Column:
    return _first(path, KINDS, "other")


def skip_reason(path: Column) -> Column:
    """Why a path is not read; null for one that is."""
    return _first(path, REASONS, None)


def test_counts(output: Column) -> Column:
    """(passed, failed, skipped) of the last line of a test run; null if that line is no summary."""
    last = F.element_at(F.split(F.rtrim(output), "\n"), -1)
    count = lambda w: F.coalesce(F.nullif(F.regexp_extract(last, rf"(\d+) {w}", 1), F.lit("")).cast("int"), F.lit(0)).alias(w)
    return F.when(F.rlike(last, F.lit(r"(\d+ (passed|failed|skipped)[, ]*)+ in [0-9.]+s")), F.struct(count("passed"), count("failed"), count("skipped")))


def review_hits(text: Column) -> Column:
    """An array of (severity, hits) by the review patterns, one entry for each pattern."""
    return F.array(*[F.struct(F.lit(s).alias("severity"), F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias("hits")) for s, p in REVIEW])
