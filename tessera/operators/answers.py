"""From a pool of passages to an answer's evidence: dates, validity, rerankings by kind of question, recall, clips, verdicts.

A pool is (query, item, source, text, score, orig): what a query retrieved, in retrieval order ``orig`` from 0. Rerankings only
reorder: they give (query, item, place) for every row. Where an operator works row by row in pandas, it sees one query's pool,
cut to ``POOL`` rows before, which is the window that is reranked; rows behind it keep their order.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import clip_bytes
from tessera.operators.ranking import authority, currency

POOL = 64
# Wording of dates and of validity windows.
EFFECTIVE = r"(?i)(?:effective|updated|goes live|published)[^\d]{0,24}(20\d{2}-\d{2}-\d{2})"
ISO_DATE, YEAR = r"\b20\d{2}-\d{2}-\d{2}\b", r"\b(20[12]\d)\b"
VALID_FROM = r"(?i)(?:valid[ _-]+from|effective(?:[ _-]+from)?|goes[ _-]+live|starts)[^\d]{0,24}(20[12]\d-\d{2}-\d{2})"
VALID_UNTIL = r"(?i)(?:valid[ _-]+until|valid[ _-]+through|through|expires|ends)[^\d]{0,24}(20[12]\d-\d{2}-\d{2})"
# Weights of (currency, authority, base score) in the soft score by kind of question.
SOFT = {"conflict": (0.50, 0.35, 0.15), "medium": (0.30, 0.30, 0.40), "other": (0.30, 0.25, 0.45)}
# Labels of qualifiers and words that are none.
LABELS = "tier|region|product|tenant|environment"
QUALIFIER_NOISE = ("the", "this", "that", "which", "what", "whose", "each", "any", "all", "our", "your", "their", "in", "for", "of", "is")


def _date(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("date")


def document_date(text: Column) -> Column:
    """The date a text says it took effect, else the first ISO date of its first 800 bytes, else the latest of its first 4,000, else
    the first of January of the latest year there; null without any."""
    body, head = clip_bytes(text, 4_000), clip_bytes(text, 800)
    dates = F.transform(F.regexp_extract_all(body, F.lit(f"({ISO_DATE})"), F.lit(1)), lambda d: d.try_cast("date"))
    years = F.array_max(F.regexp_extract_all(body, F.lit(YEAR), F.lit(1)))
    return F.coalesce(_date(F.regexp_extract(body, EFFECTIVE, 1)), _date(F.regexp_extract(head, f"({ISO_DATE})", 1)), F.array_max(dates), F.concat(years, F.lit("-01-01")).try_cast("date"))


def validity_at(text: Column, anchor: str) -> Column:
    """1 where a text's own window holds a date, -1 where it does not, 0 where it states none."""
    day, lo, hi = F.lit(anchor).cast("date"), _date(F.regexp_extract(text, VALID_FROM, 1)), _date(F.regexp_extract(text, VALID_UNTIL, 1))
    outside = F.coalesce(day < lo, F.lit(False)) | F.coalesce(day > hi, F.lit(False))
    return F.when(lo.isNull() & hi.isNull(), 0).when(outside, -1).otherwise(1)


def signals(pool: DataFrame, kind: str, anchor: str | None = None) -> DataFrame:
    """The pool with turn, dated, day, auth, cur, base, soft and validity."""
    blob = F.concat_ws(" ", "item", "source", F.substring("text", 1, 500))
    base = F.when((F.col("score") <= 0) | (F.col("score") > 1), 1 / (F.col("orig") + 1.0)).otherwise(F.col("score"))
    c, a, b = SOFT[kind]
    out = pool.withColumn("turn", F.col("item").startswith("turn:")).withColumn("day", document_date(F.col("text"))).withColumn("auth", authority(blob)).withColumn("cur", currency(F.col("text"))).withColumn("base", base)
    valid = validity_at(F.concat_ws(" ", "source", "text"), anchor) if anchor else F.lit(0)
    return out.withColumn("validity", valid).withColumn("soft", c * F.col("cur") + a * F.col("auth") + b * F.col("base"))


def authority_recency(pool: DataFrame, kind: str = "other", anchor: str | None = None) -> DataFrame:
    """(query, item, place): turns first, then by validity at the anchor, then by kind of question.

    conflict: dated before undated, newest first, then currency, authority, base score (undated ones by the soft score);
    medium: dated before undated, newest first, then the soft score; other: newest first where all rows of the query are dated,
    else the soft score. Last the retrieval order."""
    s = signals(pool, kind, anchor)
    dated = F.col("day").isNotNull()
    lead = [F.desc("turn"), F.when(F.col("turn"), F.col("orig")), F.desc("validity")]
    soft = F.desc(F.round("soft", 9))
    if kind == "conflict":
        tail = [F.desc(dated), F.desc("day"), F.desc(F.when(dated, F.round("cur", 9)).otherwise(F.round("soft", 9))), F.desc(F.when(dated, F.col("auth"))), F.desc(F.when(dated, F.round("base", 9)))]
    elif kind == "medium":
        tail = [F.desc(dated), F.desc("day"), soft]
    else:
        s = s.withColumn("all_dated", F.min(dated.cast("int")).over(Window.partitionBy("query")))
        tail = [F.desc(F.when(F.col("all_dated") == 1, F.col("day"))), soft]
    w = Window.partitionBy("query").orderBy(*lead, *tail, "orig")
    return s.select("query", "item", F.row_number().over(w).alias("place"))


def qualifiers(question: str) -> list[tuple[str, str]]:
    """(label, value) pairs that a question asks for, such as ('region', 'eu'), each once."""
    found = [(m[2], m[1]) for m in re.finditer(rf"(?i)\b([a-z][a-z0-9._/-]{{1,31}})\s+({LABELS})\b", question)]
    found += [(m[1], m[2]) for m in re.finditer(rf"(?i)\b({LABELS})\s*(?:[:=]\s*|\bis\s+)([a-z][a-z0-9._/-]{{1,31}})\b", question)]
    clean = [(k.lower(), v.lower().strip("?.,;:/ ")) for k, v in found]
    return list(dict.fromkeys((k, v) for k, v in clean if v and v not in QUALIFIER_NOISE))


def rerank_constrained(pool: DataFrame, question: str) -> DataFrame:
    """(query, item, place, matches, conflicts): passages that hold the most of the question's qualifiers, then the fewest that name
    another value for one of its labels, then valid ones at the question's date; without qualifiers the order stays."""
    want = qualifiers(question)
    day = re.search(r"\b20[12]\d-\d{2}-\d{2}\b", question)
    blob = F.lower(F.concat_ws(" ", "item", "source", "text"))
    has = {v: blob.rlike(rf"(^|[^a-z0-9]){re.escape(v)}([^a-z0-9]|$)") for _, v in want}
    names = {k: blob.rlike(rf"\b[a-z][a-z0-9._/-]{{1,31}}\s+{k}\b|\b{k}\s*(?:[:=]\s*|\bis\s+)[a-z][a-z0-9._/-]{{1,31}}\b") for k, _ in want}
    matches = sum((has[v].cast("int") for _, v in want), F.lit(0))
    conflicts = sum(((~has[v] & names[k]).cast("int") for k, v in want), F.lit(0))
    valid = validity_at(F.concat_ws(" ", "source", "text"), day[0]) if day else F.lit(0)
    s = _cut(pool).withColumn("matches", matches).withColumn("conflicts", conflicts).withColumn("validity", valid)
    w = Window.partitionBy("query").orderBy(F.desc("matches"), "conflicts", F.desc("validity"), "orig")
    return s.select("query", "item", F.row_number().over(w).alias("place"), "matches", "conflicts")


def rerank_intra(pool: DataFrame, question: str, names: Sequence[str]) -> DataFrame:
    """(query, item, place): passages with the most of the question's identifiers, then those whose date stands in the asked relation
    (after, before, as of) to the question's date, the nearest first; without a date those of the best passage's document (source)."""
    day = re.search(r"\b20[12]\d-\d{2}-\d{2}\b", question)
    low = question.lower()
    blob = F.lower(F.concat_ws(" ", "item", "source", "text"))
    s = _cut(pool).withColumn("hits", sum((blob.contains(n.lower()).cast("int") for n in names), F.lit(0))).withColumn("day", document_date(F.col("text")))
    if day:
        at = F.lit(day[0]).cast("date")
        rel = F.col("day") > at if "after" in low or "since" in low else F.col("day") < at if "before" in low or "prior to" in low else F.col("day") <= at
        s = s.withColumn("relates", F.coalesce(rel, F.lit(False))).withColumn("far", F.when(F.col("relates"), F.abs(F.datediff("day", at))))
    else:
        best = Window.partitionBy("query").orderBy(F.desc("hits"), "orig")
        s = s.withColumn("target", F.first("source").over(best)).withColumn("relates", F.col("source").eqNullSafe(F.col("target"))).withColumn("far", F.lit(0))
    w = Window.partitionBy("query").orderBy(F.desc("hits"), F.desc("relates"), F.asc_nulls_last("far"), "orig")
    return s.select("query", "item", F.row_number().over(w).alias("place"))


def _cut(pool: DataFrame) -> DataFrame:
    return pool.where(F.col("orig") < POOL)


def similar_heads(pool: DataFrame, least: float = 0.55) -> DataFrame:
    """(query, a, b): items of one query's window (orig of a before b) with equal heads, or with eight words or more each and at least
    ``least`` of their words of four bytes or more in common."""
    head = F.trim(F.substring(F.lower(F.regexp_replace(clip_bytes(F.col("text"), 1_120), r"\s+", " ")), 1, 280))
    h = _cut(pool).select("query", "item", "orig", head.alias("head")).where("head <> ''")
    words = F.array_distinct(F.filter(F.split("head", " "), lambda t: F.octet_length(t) >= 4))
    h = h.withColumn("n", F.size(F.split("head", " "))).withColumn("words", words)
    a, b = h.alias("a"), h.alias("b")
    j = a.join(b, (F.col("a.query") == F.col("b.query")) & (F.col("a.orig") < F.col("b.orig")))  # at most POOL rows a query
    union = F.size(F.array_union("a.words", "b.words"))
    near = (F.col("a.n") >= 8) & (F.col("b.n") >= 8) & (union > 0) & (F.size(F.array_intersect("a.words", "b.words")) >= least * union)
    return j.where((F.col("a.head") == F.col("b.head")) | near).select(F.col("a.query").alias("query"), F.col("a.item").alias("a"), F.col("b.item").alias("b"))


def near_duplicate_heads(pool: DataFrame, least: float = 0.55) -> DataFrame:
    """(query, item, leader): groups of similar heads, greedy in retrieval order: an item joins the first leader before it that is similar
    to it, and only items that joined nobody lead."""
    pairs = similar_heads(pool, least).join(_cut(pool).select("query", F.col("item").alias("b"), F.col("orig").alias("at")), ["query", "b"]).join(_cut(pool).select("query", F.col("item").alias("a"), F.col("orig").alias("before")), ["query", "a"])

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        leader: dict = {}
        for _, rows in pdf.sort_values(["at", "before"]).groupby("at", sort=True):
            item = rows["b"].iloc[0]
            free = [a for a in rows["a"] if leader.get(a, a) == a]
            leader[item] = free[0] if free else item
        out = [(pdf["query"].iloc[0], i, a) for i, a in leader.items() if i != a]
        out += [(pdf["query"].iloc[0], a, a) for a in dict.fromkeys(a for _, _, a in out)]
        return pd.DataFrame(out, columns=["query", "item", "leader"])

    types = dict(pool.dtypes)
    return pairs.groupBy("query").applyInPandas(group, f"query {types['query']}, item {types['item']}, leader {types['item']}")


def supersede(pool: DataFrame, anchor: str | None = None) -> DataFrame:
    """(query, item, leader, leads): in each group of similar heads the valid, newest, most current, most authoritative item leads."""
    g = near_duplicate_heads(pool).join(signals(pool, "conflict", anchor), ["query", "item"])
    dated = F.col("day").isNotNull()
    w = Window.partitionBy("query", "leader").orderBy(F.desc("validity"), F.desc(dated), F.desc("day"), F.desc(F.round("cur", 9)), F.desc("auth"), "orig")
    return g.select("query", "item", "leader", (F.row_number().over(w) == 1).alias("leads"))


def rerank_conflicting(pool: DataFrame, anchor: str | None = None) -> DataFrame:
    """(query, item, place): of each group of similar heads the leading item and its first rival come first, pair by pair in the order of the
    groups (unless they are of one day and hardly differ in currency); the rest by validity, date, currency and authority."""
    s = signals(_cut(pool), "conflict", anchor)
    dated = F.col("day").isNotNull()
    by = [F.desc("validity"), F.desc(dated), F.desc("day"), F.desc(F.round("cur", 9)), F.desc("auth"), F.asc("orig")]
    g = near_duplicate_heads(pool).join(s, ["query", "item"]).withColumn("n", F.row_number().over(Window.partitionBy("query", "leader").orderBy(*by)))
    first = Window.partitionBy("query", "leader")
    top = g.where("n <= 2")
    pick = lambda c, i: F.max(F.when(F.col("n") == i, F.col(c))).over(first)
    top = top.withColumn("same", F.coalesce((pick("day", 1) == pick("day", 2)) & (F.round(pick("cur", 1) - pick("cur", 2), 9) < 0.15), F.lit(False)))
    top = top.where(~F.col("same")).withColumn("lead_at", F.min("orig").over(first))
    pairs = top.select("query", "item", "lead_at", F.col("n").alias("side"))
    j = s.join(pairs, ["query", "item"], "left")
    w = Window.partitionBy("query").orderBy(F.asc_nulls_last("lead_at"), "side", *by)
    return j.select("query", "item", F.row_number().over(w).alias("place"))


def merge_passages(lists: Sequence[DataFrame], most: int) -> DataFrame:
    """(query, item, score, list): each item once, from the first list that has it, in the order of lists and scores, ``most`` a query."""
    rows = None
    for i, x in enumerate(lists):
        part = x.select("query", "item", "score", F.lit(i).alias("list"))
        rows = part if rows is None else rows.unionByName(part)
    once = rows.groupBy("query", "item").agg(F.min_by("score", F.struct("list", -F.col("score"))).alias("score"), F.min("list").alias("list"))
    w = Window.partitionBy("query").orderBy("list", F.desc("score"), "item")
    return once.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def merge_structure(base: DataFrame, structure: DataFrame, most: int, lift: float = 1.15) -> DataFrame:
    """(query, item, score): the union of both lists; what both have is raised to the better score times ``lift``."""
    rows = base.select("query", "item", "score", F.lit(1).alias("k")).unionByName(structure.select("query", "item", "score", F.lit(2).alias("k")))
    both = rows.groupBy("query", "item").agg(F.max("score").alias("score"), F.count_distinct("k").alias("n"))
    s = both.select("query", "item", F.when(F.col("n") == 2, F.col("score") * lift).otherwise(F.col("score")).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "item")
    return s.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def progressive_window(pool: DataFrame, k: int, per_doc: int, protect: DataFrame | None = None) -> DataFrame:
    """(query, item, place): a wide window of 3 k rows (16 to 36; at most ``per_doc`` + 2, six at least, of a document), shrunk to the k best
    with protected documents (query, source) first; k grows to hold every protected document that the wide window has."""
    wide = min(max(3 * k, 16), 36)
    p = pool.withColumn("keep", F.lit(False)) if protect is None else pool.join(protect.select("query", "source").distinct().withColumn("keep", F.lit(True)), ["query", "source"], "left").withColumn("keep", F.coalesce("keep", F.lit(False)))
    doc = Window.partitionBy("query", "source").orderBy(F.desc("score"), "orig")
    every = Window.partitionBy("query").orderBy(F.desc("keep"), F.desc("score"), "orig")
    p = p.withColumn("d", F.row_number().over(doc)).where(F.col("d") <= max(per_doc + 2, 6)).withColumn("n", F.row_number().over(every)).where(F.col("n") <= wide)
    held = p.where("keep").groupBy("query").agg(F.count_distinct("source").alias("held"))
    size = F.greatest(F.lit(k), F.coalesce("held", F.lit(0)), F.when(F.coalesce("held", F.lit(0)) >= 2, k + 2).otherwise(k))
    return p.join(held, "query", "left").where(F.col("n") <= F.least(size, F.lit(wide))).select("query", "item", F.col("n").alias("place"))


def stem_diversity(rows: DataFrame, weight: float = 0.7) -> DataFrame:
    """(query, path, place, gain): greedy marginal relevance over file stems. Taking the best of each stem first makes the n-th row of a
    stem worth weight x score - (1 - weight)(n - 1), so that one sort gives the greedy order."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    s = rows.withColumn("stem", stem)
    n = F.row_number().over(Window.partitionBy("query", "stem").orderBy(F.desc("score"), "path"))
    s = s.withColumn("gain", F.round(weight * F.col("score") - (1 - weight) * (n - 1), 9))
    w = Window.partitionBy("query").orderBy(F.desc("gain"), "path")
    return s.select("query", "path", F.row_number().over(w).alias("place"), "gain")


def fts_rank(tokens: Column, terms: Sequence[str], weight: float = 0.1) -> Column:
    """Rank of a text for any of the terms as databases score it: each term adds weight x (1 + 1/4 + ... + 1/n^2) / (pi^2 / 6) for n
    occurrences, over the number of terms."""
    terms = list(dict.fromkeys(terms))

    def part(t: str) -> Column:
        n = F.size(F.filter(tokens, lambda x: x == t))
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / (i * i))).otherwise(0.0)

    return weight * sum((part(t) for t in terms), F.lit(0.0)) / 1.64493406685 / len(terms)


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """The rows, or an error where there are more than ``most``: the guard of an exact scan."""
    n = rows.agg(F.count("*").alias("_n")).select(F.when(F.col("_n") > most, F.raise_error(F.lit(f"more than {most} rows to scan")).cast("boolean")).otherwise(True).alias("_ok"))
    return rows.crossJoin(F.broadcast(n)).where("_ok").drop("_ok")  # one row


def recall(events: DataFrame, query: str, k: int = 5, least_confidence: float = 0.5, least_relevance: float = 0.35, superseded: bool = False) -> DataFrame:
    """(id, relevance, confidence): remembered events (id, symbol, path, handle, text, repository, tree, confidence, freshness) that answer
    a query. Superseded ones stay out, so do those without a source (repository or tree) and a locator (path, symbol or handle);
    no confidence counts as 0.25. An empty result is an abstention."""
    from tessera.operators.metrics import recall_relevance

    filled = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    known = (filled("repository") | filled("tree")) & (filled("path") | filled("symbol") | filled("handle"))
    fresh = F.lit(True) if superseded else F.coalesce(F.col("freshness") != "superseded", F.lit(True))
    s = events.where(known & fresh).select("id", recall_relevance(F.col("symbol"), F.col("path"), F.col("handle"), F.col("text"), query).alias("relevance"), F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.25)).alias("confidence"))
    return s.where((F.col("relevance") >= least_relevance) & (F.col("confidence") >= least_confidence)).orderBy(F.desc("relevance"), "id").limit(k)


def session_summary(events: DataFrame, most: int = 64) -> DataFrame:
    """One row per session of events (session, seq, time, kind, path, start, end, text, freshness): times, counts by kind, ranges read,
    files changed, the first failures, whether it began and ended, and the last freshness. It is the same for any order of the rows."""
    kind = F.col("kind")
    base = events.groupBy("session").agg(
        F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.count("*").alias("events"),
        F.count_distinct(F.when(F.col("path").isNotNull() & F.col("start").isNotNull(), F.struct("path", "start", "end"))).alias("ranges_read"),
        F.count_distinct(F.when(kind.isin("edit", "refresh"), F.col("path"))).alias("files_changed"),
        F.bool_or(kind == "task_start").alias("started"), F.bool_or(kind == "completion").alias("completed"),
        F.max_by("freshness", F.when((kind != "compaction") & F.col("freshness").isNotNull(), F.col("seq"))).alias("last_freshness"),
    )
    kinds = events.groupBy("session", "kind").agg(F.count("*").alias("n")).groupBy("session").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("counts"))
    failed = events.where((kind == "failure") & (F.coalesce("text", F.lit("")) != "")).withColumn("i", F.row_number().over(Window.partitionBy("session").orderBy("seq"))).where(F.col("i") <= most)
    failed = failed.groupBy("session").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("failures"))
    return base.join(kinds, "session").join(failed, "session", "left").withColumn("failures", F.coalesce("failures", F.array().cast("array<string>")))


# What a clip keeps of the part it cuts: ISO dates, sums of money, durations and words of correction.
FACTS = r"(?i)(?:20\d{2}-\d{2}-\d{2}|[$€£]\s?\d[\d,.]*|\b\d+\s+(?:days?|weeks?|months?|years?|hours?)\b|corrected|correction|supersed|no sustained)"


def clip_passage(text: Column, most: int) -> Column:
    """At most ``most`` characters: whole where it fits, else 70 % of them from the start and, behind an ellipsis, the surroundings (90
    characters to each side) of dates, sums, durations and corrections of the rest, in order."""
    head = most * 70 // 100
    rest = F.substring(text, head + 1, 1 << 30)
    near = F.regexp_extract_all(rest, F.lit(rf"(?s)(.{{0,90}}{FACTS}.{{0,90}})"), F.lit(1))
    with_facts = F.concat(F.substring(text, 1, head), F.lit("\n…\n"), F.array_join(F.transform(near, lambda x: F.trim(x)), "\n"))
    return F.when(F.length(text) <= most, text).when(F.size(near) == 0, F.substring(text, 1, most)).otherwise(F.substring(with_facts, 1, most))


def faithfulness(claims: DataFrame, evidence: DataFrame, least: int = 600) -> DataFrame:
    """(answer, claims, supported, illegal, outcome): verdict on answers whose claims (answer, claim, doc, tokens) cite documents
    (answer, doc, tokens). A claim is safe if the document it cites is in the evidence and holds ``least`` thousandths of its tokens."""
    from tessera.operators.metrics import support_per_mille

    e = evidence.select("answer", "doc", F.col("tokens").alias("support"))
    j = claims.join(e, ["answer", "doc"], "left")
    safe = F.col("support").isNotNull() & (support_per_mille(F.col("tokens"), F.col("support")) >= least)
    n = j.groupBy("answer").agg(F.count("*").alias("claims"), F.count_if(safe).alias("supported"), F.count_if(F.col("support").isNull()).alias("illegal"))
    outcome = F.when((F.col("supported") == F.col("claims")) & (F.col("illegal") == 0), "supported").when(F.col("supported") == 0, "insufficient_context").otherwise("unsupported")
    return n.withColumn("outcome", outcome)
