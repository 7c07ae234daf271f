"""Tokenisers and small text functions as Column expressions; all stay inside the JVM.

Positions and lengths named "bytes" count UTF-8 bytes, as the scoring rules they serve do.
Null in, null out, unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of a query of several words.
QUERY_STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "the", "to", "what", "where", "which", "with", "why")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unicode_tokens(c) -> Column:
    """Lower-cased runs of letters and numbers."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def index_tokens(c) -> Column:
    """Runs of letters, numbers and underscores of at least two bytes."""
    return F.filter(F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda t: F.octet_length(t) >= 2)


def ascii_tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([a-z0-9]+)"), F.lit(1))


def content_tokens(c) -> Column:
    """Distinct words of at least four bytes that are no query stop word."""
    words = F.filter(unicode_tokens(c), lambda t: (F.octet_length(t) >= 4) & ~t.isin(*QUERY_STOP_WORDS))
    return F.array_distinct(words)


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query in order; stop words go unless all are, one-word queries are untouched."""
    import re

    tokens = [t for t in re.findall(r"[^\W_]+", query.lower())]
    kept = [t for t in tokens if t not in QUERY_STOP_WORDS] if len(tokens) > 1 else tokens
    return list(dict.fromkeys(kept or tokens))


def query_term_list(c) -> Column:
    """``query_terms`` of a column of questions, as an array."""
    tokens = unicode_tokens(c)
    kept = F.filter(tokens, lambda t: ~t.isin(*QUERY_STOP_WORDS))
    return F.array_distinct(F.when((F.size(tokens) <= 1) | (F.size(kept) == 0), tokens).otherwise(kept))


def fact_sentences(c) -> Column:
    """At most five sentences of twelve bytes or more that hold a digit or an identifier."""
    parts = F.transform(F.split(_col(c), r"[.!?\n]"), lambda s: F.trim(s))
    return F.slice(F.filter(parts, lambda s: (F.octet_length(s) >= 12) & s.rlike(r"[0-9]|[A-Za-z]+_[A-Za-z]+|[a-z]+[A-Z]")), 1, 5)


def normal_stem(path) -> Column:
    """File stem without dots, dashes and underscores, lower-cased."""
    base = F.regexp_replace(F.lower(_col(path)), r"^.*/", "")
    return F.regexp_replace(F.regexp_replace(base, r"\.[^.]*$", ""), r"[._-]", "")


def language_of(path) -> Column:
    ext = F.lower(F.regexp_extract(_col(path), r"\.([A-Za-z0-9]+)$", 1))
    known = {"go": "go", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "rs": "rust", "java": "java", "md": "markdown"}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), ext), F.lit("unknown"))


def heading_level(line) -> Column:
    """1-6 for markdown headings, the depth of numbered ones, 1 for short Title Case lines, else 0."""
    t = F.trim(_col(line))
    numbered = F.size(F.split(F.regexp_extract(t, r"^(\d+(?:\.\d+)*)[.)]?\s+\S", 1), r"\."))
    return (
        F.when(t.rlike(r"^#{1,6}\s+\S"), F.length(F.regexp_extract(t, r"^(#{1,6})", 1)))
        .when(t.rlike(r"^\d+(\.\d+)*[.)]?\s+[A-Z]") & (F.length(t) <= 80), numbered)
        .when(t.rlike(r"^([A-Z][a-z]+ ){1,6}[A-Z][a-z]+$") & (F.length(t) <= 60), F.lit(1))
        .otherwise(F.lit(0))
    )


def estimated_tokens(c) -> Column:
    """A quarter of the bytes."""
    return F.floor(F.octet_length(_col(c)) / 4)


def clip_bytes(text: Column, most: int) -> Column:
    """At most ``most`` UTF-8 bytes, cut between characters: of the four possible cuts the first that leaves no broken character."""
    raw = F.encode(text, "UTF-8")
    cuts = [F.substring(raw, 1, max(most - k, 0)).cast("string") for k in range(4)]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*[F.when(F.is_valid_utf8(c), c) for c in cuts]))
