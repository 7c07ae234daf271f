"""Query-side helpers (driver only: a query is one short text): variants, decomposition, inferred plan, enrichment lines.

These work on single strings and are used to build Columns or term lists; ``question_lines`` and
``hash_embedding`` also come as vectorised UDFs over whole tables.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import QUERY_STOP_WORDS

IDENTIFIER = re.compile(r"`[^`]+`|\"[^\"]{2,60}\"|\b[a-z]+(?:_[a-z0-9]+)+\b|\b[a-z]+(?:[A-Z][a-z0-9]+)+\b|\b[\w-]+/[\w./-]+\b|\b[A-Z]{2,}-\d+\b")
_CONJUNCTIONS = (" and also ", " as well as ", " in addition to ", " versus ", " compared to ", " compared with ", " and ", " or ")


def identifiers(question: str) -> list[str]:
    """Quoted, snake, camel, path-like and ticket-like parts, in order, each once."""
    return list(dict.fromkeys(m.group(0).strip("`\"") for m in IDENTIFIER.finditer(question)))


def variants(question: str, most: int = 4) -> list[str]:
    """The question, its content words (at most ten), its identifiers; distinct, at most ``most``."""
    words = [w for w in re.findall(r"[^\W_]+", question.lower()) if w not in QUERY_STOP_WORDS and len(w) > 2][:10]
    out = [question.strip(), " ".join(words), " ".join(identifiers(question))]
    return list(dict.fromkeys(v for v in out if v))[:most]


def decompose(question: str, several: bool) -> list[str]:
    """Parts ending in a question mark of at least twelve bytes; for questions of several facts also cut at the first conjunction that leaves two parts over fifteen."""
    parts = [p.strip() + "?" for p in question.split("?") if len(p.strip().encode()) >= 12] or [question.strip()]
    if several and len(parts) == 1:
        low = parts[0].lower()
        for c in _CONJUNCTIONS:
            at = low.find(c)
            if at > 15 and len(low) - at - len(c) > 15:
                return [parts[0][:at].strip(), parts[0][at + len(c) :].strip()]
    return parts


def infer_plan(question: str) -> dict[str, object]:
    """Feature flags of a question and the type of plan they select, the first rule that holds."""
    q = question.lower()
    words = re.findall(r"[^\W_]+", q)
    flags = {
        "identifier": bool(identifiers(question)),
        "temporal": bool(re.search(r"\b(?:when|latest|current|before|after|since|as of|20\d\d)\b", q)),
        "comparative": bool(re.search(r"\b(?:versus|vs|compared|difference|between)\b", q)),
        "aggregate": bool(re.search(r"\b(?:how many|list|all|every|count)\b", q)),
        "short": len(words) <= 3,
    }
    order = (("identifier", "exact"), ("comparative", "multi"), ("aggregate", "wide"), ("temporal", "as_of"), ("short", "keyword"))
    return {**flags, "type": next((t for f, t in order if flags[f]), "semantic")}


def identifier_list(question: Column) -> Column:
    """``identifiers`` of a column of questions, as an array."""
    found = F.regexp_extract_all(question, F.lit(f"({IDENTIFIER.pattern})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.btrim(x, F.lit("`\""))))


def question_plan(question: Column, several: bool = True) -> Column:
    """(variants, parts, type) of a column of questions, by batches."""

    @F.pandas_udf("variants array<string>, parts array<string>, type string")
    def plan(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"variants": [variants(t) for t in texts], "parts": [decompose(t, several) for t in texts], "type": [infer_plan(t)["type"] for t in texts]})

    return plan(question)


# Wording that tells what a question wants.
PLAN_CUES = {
    "lists": r"(?i)\b(list|enumerate|every|all of|complete (required|list)|each of)\b", "kinds": r"(?i)\b(which|what)\s+(customers?|partners?|teams?|channels?|exceptions?|steps?|fields?|metrics?|actions?)\b",
    "choice": r"(?i)\b(or|rather than|instead of|as opposed to)\b", "dispute": r"(?i)\b(correction|corrected|supersed|actually|telemetry review|conflicting|wrongly|initially (said|noted)|earlier note)\b",
    "several": r"(?i)\b(and also|as well as|in addition|both .+ and|across (docs?|documents?|teams?))\b", "project": r"(?i)\b(how (do|should|can) we|what is the (recommended|suggested)|remediation|rollout|runbook|playbook|process for)\b",
    "bound": r"(?i)\b(only for|limited to|in (us|eu|ap)-|for the .+ tier|under the .+ plan|when using)\b", "absent": r"(?i)\b(is there any|are there any|does .+ (exist|support)|has anyone|any customer other than)\b", "asks": r"(?i)^(what|who|when|where|how many|how much)\b",
}


def effective_type(question: Column) -> Column:
    """What kind of answer a question wants, the first rule that holds: info_not_found or completeness (by 'other than', 'besides'), conflicting_info,
    completeness, project_related, constrained, semantic (long and no short fact), basic (a short fact), else semantic. Length counts content
    words (12) or bytes (120)."""
    from tessera.functions.text import content_tokens

    q, low = F.trim(question), F.lower(F.trim(question))
    cue = {k: q.rlike(rx) for k, rx in PLAN_CUES.items()}
    words = F.size(content_tokens(q))
    lists = cue["lists"] | cue["kinds"]
    conflict = cue["choice"] & (cue["dispute"] | low.contains("oom") | low.contains("stall") | low.contains("was it") | low.contains("is it"))
    long = (words >= 12) | (F.octet_length(q) >= 120)
    short = cue["asks"] & (words <= 14) & ~lists & ~conflict
    wide = long & ~short
    several = lists | conflict | cue["several"] | cue["project"] | wide
    other = low.contains("other than") | low.contains("besides")
    return (
        F.when(q == "", "basic").when(cue["absent"] & ~lists & other, "completeness").when(cue["absent"] & ~lists, "info_not_found").when(conflict, "conflicting_info").when(lists, "completeness")
        .when(cue["project"] & several, "project_related").when(cue["bound"] & several, "constrained").when(wide, "semantic").when(short, "basic").otherwise("semantic")
    )


def question_lines(text: Column, most: int = 5) -> Column:
    """Up to five templated questions from the first eight content words of a text's first 400 bytes, one string per line set."""

    @F.pandas_udf("array<string>")
    def lines(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            head = (t or "").encode()[:400].decode("utf-8", "ignore")
            words = list(dict.fromkeys(w for w in re.findall(r"[^\W_]{4,}", head.lower()) if w not in QUERY_STOP_WORDS))[:8]
            forms = ("what is {}", "how does {} work", "where is {} used", "why does {} matter", "what changed in {}")
            out.append([f.format(w) for f, w in zip(forms, words)][:most])
        return pd.Series(out)

    return lines(text)


def hash_embedding(tokens: Column, dim: int = 256) -> Column:
    """Bag of hashed tokens of at least three characters: h = 31 h + code point in wrapping 64-bit integers, bin |h| mod dim."""

    @F.pandas_udf("array<float>")
    def embed(rows: pd.Series) -> pd.Series:
        out = []
        for ts in rows:
            v = np.zeros(dim, np.float32)
            for t in ts if ts is not None else ():
                if len(t) >= 3:
                    h = 0
                    for c in t:
                        h = (h * 31 + ord(c)) & 0xFFFFFFFFFFFFFFFF
                    h = h - (1 << 64) if h >> 63 else h
                    v[abs(h) % dim] += 1
            out.append(v)
        return pd.Series(out)

    return embed(tokens)
