"""Text expressions over file contents: counts, headings, excerpts, redaction, licences. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases by which a licence text is told.
LICENSE_NEEDLES = (("apache license", "Apache-2.0"), ("mit license", "MIT"), ("gnu general public license", "GPL"), ("gnu lesser general public license", "LGPL"), ("mozilla public license", "MPL-2.0"), ("bsd", "BSD"), ("unencumbered software released into the public domain", "Unlicense"))
_SECRET_NAMES = "api[_-]?key|secret|token|password|passwd|credential"


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def token_estimate(text: Column) -> Column:
    """About four characters to a token."""
    return F.floor(F.length(text) / 4).cast("long")


def headings(text: Column, most: int = 25) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit(r"(?m)^#{1,3}[ \t]+(.+)$"), F.lit(1)), 1, most)


def excerpt(text: Column, most: int = 280) -> Column:
    """Running text: without code fences, headings and tags, on one line, cut at a word."""
    plain = F.regexp_replace(text, r"(?s)```.*?```", " ")
    plain = F.regexp_replace(plain, r"(?m)^#.*$", " ")
    plain = F.regexp_replace(plain, r"<[^>]+>", " ")
    plain = F.trim(F.regexp_replace(plain, r"\s+", " "))
    cut = F.regexp_replace(F.substring(plain, 1, most), r"\s+\S*$", "")
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(cut, F.lit("…")))


def tag_count(text: Column, head: int = 50_000) -> Column:
    return F.regexp_count(F.substring(text, 1, head), F.lit(r"</?[a-zA-Z][^>]*>")).cast("long")


def looks_like_html(text: Column) -> Column:
    start = F.lower(F.substring(F.trim(text), 1, 200))
    return F.startswith(start, F.lit("<!doctype html")) | F.startswith(start, F.lit("<html")) | (tag_count(text) >= 8)


def redact_secrets(text: Column) -> Column:
    """Values of secret-looking assignments and known token shapes give way to a mark; keys stay."""
    out = F.regexp_replace(text, r"\b(ghp|gho|ghs|github_pat|sk|xoxb|xoxp|AKIA)[-_A-Za-z0-9]{16,}\b", "[redacted]")
    return F.regexp_replace(out, rf"(?i)\b({_SECRET_NAMES})(\s*[:=]\s*[\"']?)([A-Za-z0-9_\-./+]{{16,}})", "$1$2[redacted]")


def redact_url(url: Column) -> Column:
    """A URL without user information, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/@]*@", "$1")


def detect_license(text: Column) -> Column:
    """Licences named in a text, in order of name, joined by OR; null if there is none."""
    low = F.lower(text)
    found = F.filter(F.array(*[F.when(F.contains(low, F.lit(n)), F.lit(s)) for n, s in LICENSE_NEEDLES]), lambda x: x.isNotNull())
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(found)), " OR "), F.lit(""))


def csv_cell(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula, quoted where needed."""
    guarded = F.when(F.rlike(value, F.lit(r"^[=+\-@\t\r]")), F.concat(F.lit("'"), value)).otherwise(value)
    return F.when(F.rlike(guarded, F.lit('[",\n\r]')), F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(guarded)


def content_type(path: Column) -> Column:
    """The language of a file by its ending (a few common ones)."""
    pairs = [x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


#: Languages by file ending.
LANGUAGES = {"c": "C", "cc": "C++", "cpp": "C++", "cs": "C#", "css": "CSS", "dart": "Dart", "ex": "Elixir", "go": "Go", "hs": "Haskell", "html": "HTML", "java": "Java", "js": "JavaScript", "jsx": "JavaScript", "kt": "Kotlin", "php": "PHP", "pl": "Perl", "ps1": "PowerShell", "py": "Python", "r": "R", "rb": "Ruby", "rs": "Rust", "scala": "Scala", "sh": "Shell", "sql": "SQL", "swift": "Swift", "tf": "HCL", "ts": "TypeScript", "tsx": "TypeScript", "vue": "Vue"}
