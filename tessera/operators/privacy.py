"""Findings of personal data and secrets by class, their status and their masking, as Column expressions.

A class is a pattern and, where the pattern alone says too little, a check of what it matched. Other detectors are added to a
registry by name (``detector``) and run over whole batches.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the classes.
CLASSES = {
    "private_key": r"(?s)-----BEGIN[ \t]+[A-Z0-9 \t]*PRIVATE KEY-----(?:.*?-----END[ \t]+[A-Z0-9 \t]*PRIVATE KEY-----|.*)",
    "password_assignment": r"(?i)\b(?:password|passwd|pwd|secret)[ \t]*[:=][ \t]*[^\s,;]+",
    "bearer_token": r"(?i)\bBearer[ \t]+[A-Za-z0-9._~+/\-]{12,}=*",
    "api_key": r"\b(?:AKIA[0-9A-Z]{16}|(?:sk|api|key)_[A-Za-z0-9_\-]{12,}|sk-(?:proj-|ant-|or-)?[A-Za-z0-9_\-]{16,}|gh[pousr]_[A-Za-z0-9]{16,}|github_pat_[A-Za-z0-9_]{20,}|xox[baprs]-[A-Za-z0-9\-]{10,}|AIza[0-9A-Za-z_\-]{30,}|glpat-[A-Za-z0-9_\-]{16,}|(?:r8_|hf_)[A-Za-z0-9]{16,})\b",
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,63}",
    "credit_card": r"\b(?:[0-9][ -]?){12,18}[0-9]\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "phone": r"(?:\+?[0-9][0-9 .()\-]{7,}[0-9])",
}
#: What a find of a class asks for, strongest last in SEVERITY; a parameter of ``status``.
POLICY = {
    "email": "redact", "phone": "redact", "credit_card": "quarantine", "api_key": "quarantine", "bearer_token": "quarantine", "password_assignment": "quarantine",
    "private_key": "tombstone", "ssn": "tombstone",
}
SEVERITY = ("clean", "redact", "quarantine", "tombstone")


def valid_card(number: Column) -> Column:
    """13 to 19 digits that pass the Luhn check; other characters do not count."""
    digits = F.regexp_replace(number, r"[^0-9]", "")
    return digits.rlike(r"^\d{13,19}$") & F.call_function("luhn_check", digits)


def matches(text: Column, name: str) -> Column:
    """What a class finds in a text, in order."""
    found = F.regexp_extract_all(text, F.lit(CLASSES[name]), F.lit(0))
    return F.filter(found, valid_card) if name == "credit_card" else found


def counts(text: Column, classes: Sequence[str] = tuple(CLASSES)) -> dict[str, Column]:
    """Finds of each class; every class is one pass over the text."""
    return {name: F.size(matches(text, name)) for name in classes}


def masked(text: Column, classes: Sequence[str] = tuple(CLASSES)) -> Column:
    """Finds replaced by as many ``*`` as they have bytes. Classes are masked one after another in the order given, widest first;
    what one has masked the next no longer matches."""
    for name in classes:
        parts, found = F.split(text, CLASSES[name]), F.regexp_extract_all(text, F.lit(CLASSES[name]), F.lit(0))
        stars = lambda m: F.repeat(F.lit("*"), F.octet_length(m))
        hidden = (lambda m: F.when(valid_card(m), stars(m)).otherwise(m)) if name == "credit_card" else stars  # noqa: B023
        text = F.array_join(F.zip_with(parts, found, lambda p, m: F.concat(F.coalesce(p, F.lit("")), F.coalesce(hidden(m), F.lit("")))), "")  # noqa: B023
    return text


def status(found: Mapping[str, Column], policy: Mapping[str, str] = POLICY) -> Column:
    """The strongest action that the classes found ask for; clean without finds."""
    level = F.greatest(F.lit(0), F.lit(0), *[F.when(n > 0, SEVERITY.index(policy[name])).otherwise(0) for name, n in found.items() if name in policy])
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), level + 1)


DETECTORS: dict[str, Callable[[pd.Series], pd.Series]] = {}


def detector(name: str):
    """Register a detector: a function of a batch of texts to a batch of lists of (cls, start, end) with byte offsets."""

    def add(f: Callable[[pd.Series], pd.Series]):
        DETECTORS[name] = f
        return f

    return add


@detector("local")
def _local(texts: pd.Series) -> pd.Series:
    import re

    rules = [(name, re.compile(rx, re.A)) for name, rx in CLASSES.items()]

    def luhn(value: str) -> bool:
        digits = [int(c) for c in value if c.isdigit()]
        twice = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(twice) % 10 == 0

    out = []
    for text in texts:
        spans = [(name, m.start(), m.end()) for name, rx in rules for m in rx.finditer(text or "") if name != "credit_card" or luhn(m[0])]
        if spans and not text.isascii():
            at = [0]
            for c in text:
                at.append(at[-1] + len(c.encode("utf-8", "surrogatepass")))
            spans = [(n, at[a], at[b]) for n, a, b in spans]
        out.append([{"cls": n, "start": a, "end": b} for n, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0]))])
    return pd.Series(out)


def detect(rows: DataFrame, id_col: str, text_col: str, name: str = "local", classes: Sequence[str] | None = None) -> DataFrame:
    """(doc, cls, start, end): findings of a registered detector with byte offsets; a span outside its text is an error."""
    udf = F.pandas_udf(DETECTORS[name], "array<struct<cls:string,start:bigint,end:bigint>>")
    found = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.octet_length(text_col).alias("size"), F.explode(udf(F.col(text_col))).alias("f"))
    found = found.select("doc", "size", "f.cls", "f.start", "f.end")
    if classes is not None:
        found = found.where(F.col("cls").isin(*classes))
    bad = (F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.col("size"))
    return found.select("doc", "cls", F.when(bad, F.raise_error(F.lit("a detector's span lies outside its text")).cast("bigint")).otherwise(F.col("start")).alias("start"), "end")


def evaluate(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: exact-span precision and recall of spans (doc, cls, start, end), and the counts behind them."""
    p = predicted.select("doc", "cls", "start", "end").distinct().withColumn("p", F.lit(1))
    e = expected.select("doc", "cls", "start", "end").distinct().withColumn("e", F.lit(1))
    j = p.join(e, ["doc", "cls", "start", "end"], "full_outer")
    s = j.agg(F.count_if(F.col("p").isNotNull() & F.col("e").isNotNull()).alias("hit"), F.count("p").alias("predicted"), F.count("e").alias("expected"))
    ratio = lambda d: F.when(F.col(d) > 0, F.col("hit") / F.col(d)).otherwise(F.lit(1.0))
    return s.select("hit", "predicted", "expected", ratio("predicted").alias("precision"), ratio("expected").alias("recall"))
