"""Column functions on text: terms, normal forms, token counts, extraction patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = "[ \\t\\n\\f\\r]+"


def collapsed(text: Column) -> Column:
    """Lower-cased, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), BLANKS, " "))


def words(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), BLANKS), lambda w: w != "")


def query_terms(query: str) -> list[str]:
    """The distinct lower-cased terms of a query; commas separate like spaces."""
    return sorted({t for t in query.replace(",", " ").lower().split() if t})


def term_matches(haystack: Column, terms: Sequence[str]) -> Column:
    """How many terms occur anywhere in the text, as the scorer counts them."""
    hits = [F.when(F.contains(haystack, F.lit(t)), 1).otherwise(0) for t in terms]
    return sum(hits, F.lit(0))


def edge_stripped(word: Column) -> Column:
    """A word without punctuation at its edges."""
    return F.regexp_replace(word, '^[.,!?;:"()\\[\\]{}]+|[.,!?;:"()\\[\\]{}]+$', "")


def word_tokens(text: Column) -> Column:
    """The prompt counter: words times 1.3, rounded up."""
    return F.ceil(F.size(words(text)) * F.lit(1.3)).cast("long")


def byte_tokens(text: Column) -> Column:
    """The fast counter: UTF-8 bytes over 3.5, rounded up."""
    return F.ceil(F.octet_length(text) / F.lit(3.5)).cast("long")


def char_tokens(text: Column) -> Column:
    """The fallback counter of the budget: a quarter of the length, rounded up, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(4))).cast("long")


def ngrams(text: Column) -> Column:
    """Distinct single words and pairs of neighbouring words of the normalised text."""
    w = F.filter(F.split(collapsed(text), " "), lambda x: x != "")
    # Whole arrays side by side, not one place after another: a lambda would split the text anew for each.
    pairs = F.when(
        F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda x, y: F.concat_ws(" ", x, y))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(w, pairs))


def sentences(text: Column) -> Column:
    """Pieces after a full stop, exclamation or question mark and white space, trimmed."""
    marked = F.regexp_replace(text, "([.!?])[ \\t\\n\\f\\r]+", "$1\u0001")
    return F.transform(F.split(marked, "\u0001"), F.trim)


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the normalised parts joined by bars."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def canonical_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\\r\\n?", "\n")


def classified(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first kind one of whose keywords occurs in the lower-cased text (within words too)."""
    low, out = F.lower(text), None
    for kind, keywords in rules:
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.contains(low, F.lit(k))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return F.lit(default) if out is None else out.otherwise(default)


#: The kinds in order of precedence and the keywords that show each.
KIND_RULES = (
    ("decision", ("decided", "decision", "chose", "chosen")),
    ("preference", ("prefer", "like", "want", "favorite")),
    ("instruction", ("plan", "roadmap", "milestone", "sprint")),
    ("artifact", ("bug", "issue", "error", "fix")),
    ("fact", ("learned", "found", "discovered", "realized")),
)

#: Words that negate.
NEGATIONS = (
    "not", "never", "no", "don't", "doesn't", "isn't", "wasn't", "aren't", "won't", "can't", "cannot",
)

#: Names of two or more capitalised words.
NAMES = "[A-Z][a-z]+(?:[ \\t\\n\\f\\r]+[A-Z][a-z]+)+"

#: Patterns of credentials that records must not hold, matched in either case.
CREDENTIALS = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"\bsk-(?:proj-|ant-api\d+-)?[A-Za-z0-9_-]{16,}\b",
    r"\bsk_[A-Za-z0-9_-]{16,}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    r"\bglpat-[A-Za-z0-9_-]{16,}\b",
    r"\bsk_live_[A-Za-z0-9]{16,}\b",
    r"\bAIza[A-Za-z0-9_-]{30,}\b",
    r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    r"\b[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s/@]+@",
    r"\b(?:password|passwd|token|secret|api[_-]?key)[\"']?\s*[:=]\s*[\"']?[^\s\"',}]{8,}",
)


def has_credential(text: Column, patterns: Sequence[str] = CREDENTIALS) -> Column:
    return F.coalesce(text.rlike("(?i)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"), F.lit(False))


def pronouns_rewritten(sentence: Column, subject: str, possessive: str) -> Column:
    """First-person wording told of ``subject``; the pronoun "I" only as a capital."""
    out = sentence
    for pattern, to in (
        (r"(?i)\bI'm\b", f"{subject} is"),
        (r"(?i)\bI've\b", f"{subject} has"),
        (r"(?i)\bI'll\b", f"{subject} will"),
        (r"(?i)\bI'd\b", f"{subject} would"),
        (r"\bI\b", subject),
        (r"(?i)\bmy\b", possessive),
        (r"(?i)\bme\b", subject),
    ):
        out = F.regexp_replace(out, pattern, to)
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1 << 30))
