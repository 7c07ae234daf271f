"""Claims with two time axes: extraction, as-of reads, conflict groups and the resolution ladder, utility.

A claim is a row (id, subject, predicate, object, valid_from, valid_to, observed_at, expired_at, status,
quality, documents, supersedes, superseded_by); open ends are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Predicates that take several objects at once and therefore never conflict.
MULTI_VALUED = ("tags", "aliases", "keywords", "related_to")

#: predicate -> pattern with a subject and an object group; extend or replace to extract other claims.
PATTERNS = {
    "replaced": r"(?i)\b([A-Za-z_][\w]{2,40}) replaced ([A-Za-z_][\w]{2,40})\b",
    "depends_on": r"(?i)\b([A-Za-z_][\w]{2,40}) depends on ([A-Za-z_][\w]{2,40})\b",
    "imports": r"(?i)\b([\w./]{3,80}) still imports ([A-Za-z_][\w]{2,40})\b",
    "prefers": r"(?i)\b([A-Za-z_][\w]{2,40}) prefers ([A-Za-z_][\w]{2,40})\b",
}


_WHO = r"\b([A-Za-z][\w\s\-]{1,40}?)"
# Forms of objects: one name up to its first word end, a word, a sum, a number, a phrase up to the end of its sentence.
OBJECTS = {
    "name": r"([A-Za-z][\w\s\-]{1,40}?)\b", "word": r"([A-Za-z][\w\-]{2,30})\b", "sum": r"(\$?\d[\d,]*(?:\.\d+)?(?:\s*(?:USD|usd|dollars?))?)\b",
    "phrase": r"([A-Za-z0-9][\w\s\.\-%$]{1,50}?)(?:[.!?;,\n]|$)", "version": r"(v?\d[\w\.\-]{0,20})\b", "percent": r"(\d{1,3}%|\d+\s*nines?)\b",
}
# Fixed values: (predicate, what stands between a subject and an object, form of the object, a word without which nothing is found).
STATEMENTS = (
    ("price", r"price\s+is", "sum", "price"), ("costs", "costs", "sum", "costs"), ("role", r"has\s+role", "name", "role"), ("role", r"role\s+is", "name", "role"),
    ("color", r"(?:are|is)\s+painted", "word", "painted"), ("color", r"(?:color|colour)\s+is", "word", "colo"), ("located_in", r"(?:is\s+)?(?:located|based|headquartered)\s+in", "name", "ed"),
    ("owns", r"(?:owns|acquired|acquired by)", "name", "o"), ("founded", r"(?:was\s+)?founded\s+(?:in|by)", "name", "founded"), ("works_at", r"(?:works|worked)\s+at", "name", "work"),
    ("requires", "requires", "phrase", "requires"), ("supports", "supports", "phrase", "supports"), ("uses", "uses", "phrase", "uses"), ("version", r"version(?:\s+is)?", "version", "version"),
    ("sla", r"SLA(?:\s+is)?", "percent", "sla"), ("depends_on", r"depends\s+on", "phrase", "depends"), ("provides", "provides", "phrase", "provides"), ("integrates_with", r"integrates\s+with", "phrase", "integrates"),
    ("owned_by", r"(?:is\s+)?owned\s+by", "phrase", "owned"), ("reports_to", r"reports\s+to", "phrase", "reports"), ("powered_by", r"(?:is\s+)?powered\s+by", "phrase", "powered"), ("manages", "manages", "phrase", "manages"),
    ("responsible_for", r"(?:is\s+)?responsible\s+for", "phrase", "responsible"), ("announced", "announced", "phrase", "announced"), ("has", "has", "phrase", "has"), ("is", "is", "phrase", "is"),
)
# Statements of three parts, recovery objectives, and lines of the form "subject: object".
OF_IS = r"(?i)\b([A-Za-z][\w\-]{2,30})\s+of\s+([A-Za-z][\w\s\-]{1,40}?)\s+is\s+([A-Za-z0-9][\w\s\.\-%$]{0,40}?)(?:[.!?;,\n]|$)"
BETWEEN = r"(?i)\b([A-Za-z][\w\s\-]{1,30}?)\s+between\s+([A-Za-z][\w\s\-]{1,30}?)\s+and\s+([A-Za-z][\w\s\-]{1,30}?)\b"
RECOVERY = {"rpo": r"(?i)\b(?:RPO|recovery\s+point\s+objective)\s+(?:is|of|=)\s*(\d[\d\s]*(?:hours?|days?|minutes?|h|d|m)?)\b", "rto": r"(?i)\b(?:RTO|recovery\s+time\s+objective)\s+(?:is|of|=)\s*(\d[\d\s]*(?:hours?|days?|minutes?|h|d|m)?)\b"}
COLON = r"^([A-Za-z][\w\s\-]{1,40}?):\s*([A-Za-z0-9][\w\s\.\-%$]{1,60})$"
# Subjects and objects that say nothing.
EMPTY_SUBJECTS = "it this that there here what which who they he she we one some any all each every the a an these those".split()
EMPTY_OBJECTS = "a an the it this that true false important possible available".split()


def _groups(text_col: str, rx: str, n: int) -> Column:
    """Structs (g1, .. gn) of the groups of each match; the text is searched once, and the groups are read off the short matches."""
    return F.transform(F.regexp_extract_all(text_col, F.lit(f"({rx})" if not rx.startswith("(?i)") else f"(?i)({rx[4:]})"), F.lit(1)), lambda m: F.struct(*[F.regexp_extract(m, rx, i).alias(f"g{i}") for i in range(1, n + 1)]))


def extract_statements(docs: DataFrame, id_col: str, text_col: str, rules=STATEMENTS) -> DataFrame:
    """(doc, predicate, subject, object): distinct statements of each document, lower-cased and with single blanks: 'subject verb object' by a table of
    verbs, 'X of Y is Z', 'X between Y and Z', recovery objectives and lines 'subject: object'. Empty subjects and objects are left out, and so are objects of more than eight words; a pattern runs only over texts that hold its word."""
    part = lambda predicate, subject, object_: F.struct(predicate.alias("predicate"), F.lower(subject).alias("subject"), F.lower(object_).alias("object"))
    none = F.array().cast("array<struct<predicate:string,subject:string,object:string>>")
    found = []
    for predicate, between, form, word in rules:
        rx = rf"(?i){_WHO}\s+{between}\s+{OBJECTS[form]}"
        has = F.lower(F.col(text_col)).contains(word)
        pairs = F.when(has, _groups(text_col, rx, 2))
        found.append(F.coalesce(F.transform(pairs, lambda p: part(F.lit(predicate), p["g1"], p["g2"])), none))  # noqa: B023
    low = F.lower(F.col(text_col))
    found.append(F.when(low.contains(" of "), F.transform(_groups(text_col, OF_IS, 3), lambda p: part(F.lower(p["g1"]), p["g2"], p["g3"]))).otherwise(none))
    found.append(F.when(low.contains("between"), F.transform(_groups(text_col, BETWEEN, 3), lambda p: part(F.lit("between"), p["g1"], F.concat(p["g2"], F.lit(" and "), p["g3"])))).otherwise(none))
    found += [F.transform(F.regexp_extract_all(text_col, F.lit(rx), F.lit(1)), lambda v: part(F.lit("is"), F.lit(name), v)) for name, rx in RECOVERY.items()]
    lines = F.filter(F.transform(F.split(text_col, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: (F.octet_length(x) <= 100) & x.rlike(COLON))
    found.append(F.transform(lines, lambda x: part(F.lit("is"), F.regexp_extract(x, COLON, 1), F.regexp_extract(x, COLON, 2))))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.explode(F.concat(*found)).alias("c"))
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    s = rows.select("doc", "c.predicate", tidy("c.subject").alias("subject"), tidy("c.object").alias("object")).distinct()
    return s.where((F.length("subject") > 1) & (F.col("object") != "") & ~F.col("subject").isin(*EMPTY_SUBJECTS) & ~F.col("object").isin(*EMPTY_OBJECTS) & (F.size(F.split("object", " ")) <= 8))


def extract_claims(docs: DataFrame, id_col: str, text_col: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """(doc, predicate, subject, object, mentions): distinct claims of each document, lower-cased."""
    patterns = patterns or PATTERNS
    rows = []
    for name, rx in patterns.items():
        pair = F.arrays_zip(F.regexp_extract_all(text_col, F.lit(rx), F.lit(1)).alias("subject"), F.regexp_extract_all(text_col, F.lit(rx), F.lit(2)).alias("object"))
        rows.append(_as_claims(pair, name))
    found = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.explode(F.concat(*rows)).alias("c"))
    return found.groupBy("doc", "c.predicate", "c.subject", "c.object").agg(F.count("*").alias("mentions"))


def _as_claims(pairs: Column, predicate: str) -> Column:
    return F.transform(pairs, lambda p: F.struct(F.lit(predicate).alias("predicate"), F.lower(p["subject"]).alias("subject"), F.lower(p["object"]).alias("object")))


def valid_at(t: Column) -> Column:
    """Valid at a time; the end is inclusive."""
    return (F.col("status") != "tombstoned") & (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t <= F.col("valid_to")))


def known_at(t: Column | None) -> Column:
    """Known to the store at a time (the end is exclusive); without a time, not expired."""
    if t is None:
        return (F.col("status") != "tombstoned") & F.col("expired_at").isNull()
    return (F.col("status") != "tombstoned") & (F.col("observed_at") <= t) & (F.col("expired_at").isNull() | (t < F.col("expired_at")))


def as_of(claims: DataFrame, valid: Column, known: Column | None, status: tuple[str, ...] = ("active",)) -> DataFrame:
    return claims.where(F.col("status").isin(*status) & valid_at(valid) & known_at(known))


def overlaps(claims: DataFrame) -> DataFrame:
    """(a, b): claims of one subject and predicate, different objects, whose half-open validity intervals overlap.

    A self-join on subject and predicate with range conditions: its cost is quadratic in the claims of a group, as the result may be.
    """
    far = F.lit("9999-01-01").cast("timestamp")
    c = claims.select("id", "subject", "predicate", "object", "valid_from", F.coalesce("valid_to", far).alias("valid_end"))
    a, b = c.alias("a"), c.alias("b")
    on = (
        (F.col("a.subject") == F.col("b.subject")) & (F.col("a.predicate") == F.col("b.predicate")) & (F.col("a.id") < F.col("b.id"))
        & (F.col("a.object") != F.col("b.object")) & (F.col("a.valid_from") < F.col("b.valid_end")) & (F.col("b.valid_from") < F.col("a.valid_end"))
    )
    return a.join(b, on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def contested(claims: DataFrame) -> DataFrame:
    """(subject, predicate, objects, claims): groups with at least two distinct objects."""
    g = claims.groupBy("subject", "predicate").agg(F.count_distinct("object").alias("objects"), F.count("*").alias("claims"))
    return g.where("objects >= 2")


def resolve(claims: DataFrame, group: list[str]) -> DataFrame:
    """(group.., outcome, reason, winner): one row per group.

    Single claims win; multi-valued predicates have no winner; then an unsuperseded superseder, the best
    evidence quality, the most documents, the tightest closed validity window; several superseders or a
    remaining tie stay contested. Set-based: claims of one standing are counted first, and only the standings of a group meet.
    """
    c = claims.withColumn("docs", F.size("documents")).withColumn(
        "tight", F.when(F.col("valid_to") > F.col("valid_from"), F.unix_micros("valid_to") - F.unix_micros("valid_from")).otherwise(F.lit(1 << 62))
    )
    # rung 1: who supersedes someone of the same group, and is not superseded inside it; both directions are joins on the ids
    ids = c.select(*group, "id", "supersedes", "superseded_by")
    other = ids.select(*group, F.col("id").alias("other")).distinct()
    down = ids.join(other.withColumnRenamed("other", "supersedes"), [*group, "supersedes"]).select(*group, "id", F.col("supersedes").alias("beaten"))
    up = ids.join(other.withColumnRenamed("other", "superseded_by"), [*group, "superseded_by"]).select(*group, F.col("superseded_by").alias("id"), F.col("id").alias("beaten"))
    inside = up.select(*group, F.col("beaten").alias("id")).distinct()
    beats = down.union(up).where("id <> beaten").select(*group, "id").distinct().join(inside, [*group, "id"], "left_anti").groupBy(*group).agg(F.count("*").alias("n_super"), F.min("id").alias("super"))
    # the other rungs: claims of one standing are one row, so a group's rows are its distinct standings
    s = c.groupBy(*group, "quality", "docs", "tight").agg(F.count("*").alias("k"), F.min("id").alias("first"))
    w = Window.partitionBy(*group)
    s = s.withColumn("q", F.col("quality") == F.max("quality").over(w))
    s = s.withColumn("d", F.col("q") & (F.col("docs") == F.max(F.when(F.col("q"), F.col("docs"))).over(w)))
    s = s.withColumn("mt", F.min(F.when(F.col("d"), F.col("tight"))).over(w)).withColumn("t", F.col("d") & (F.col("tight") == F.col("mt")))
    g = s.groupBy(*group).agg(
        F.sum("k").alias("n"), F.max("mt").alias("mt"), F.min("first").alias("only"),
        *[F.sum(F.when(F.col(x), F.col("k")).otherwise(0)).alias(f"n{x}") for x in "qdt"],
        *[F.min(F.when(F.col(x), F.col("first"))).alias(f"w{x}") for x in "qdt"],
    ).join(beats, group, "left")
    predicate = F.col("predicate") if "predicate" in group else F.lit("")
    reason = (
        F.when(F.col("n") == 1, "single").when(predicate.isin(*MULTI_VALUED), "multi_valued_predicate").when(F.col("n_super") > 1, "multiple_supersession")
        .when(F.col("n_super") == 1, "supersession").when(F.col("nq") == 1, "evidence_quality").when(F.col("nd") == 1, "document_count")
        .when((F.col("nt") == 1) & (F.col("mt") < (1 << 62)), "tighter_valid_window").otherwise("tie")
    )
    g = g.withColumn("reason", reason)
    winner = (
        F.when(F.col("reason") == "single", F.col("only")).when(F.col("reason") == "supersession", F.col("super")).when(F.col("reason") == "evidence_quality", F.col("wq"))
        .when(F.col("reason") == "document_count", F.col("wd")).when(F.col("reason") == "tighter_valid_window", F.col("wt"))
    )
    outcome = F.when(F.col("reason") == "multi_valued_predicate", "none").when(F.col("reason").isin("multiple_supersession", "tie"), "contested").otherwise("winner")
    return g.select(*group, outcome.alias("outcome"), "reason", winner.alias("winner"))


def decayed(score: Column, seconds: Column, short_days: float = 7, long_days: float = 365, floor: float = 0.01) -> Column:
    """Half-life decay: a week for scores under 1, a year for others; never under the floor."""
    half = F.when(score < 1, short_days * 86400.0).otherwise(long_days * 86400.0)
    return F.greatest(F.lit(floor), score * F.pow(F.lit(0.5), F.greatest(seconds, F.lit(0.0)) / half))


def reinforced(score: Column, boost: Column, cap: float = 5.0) -> Column:
    return F.least(score + boost, F.lit(cap))


def sessions(events: DataFrame, key: str, time: str, gap_seconds: int) -> DataFrame:
    """(key, session, start, end, events): runs of a key's events no further apart than the gap."""
    w = Window.partitionBy(key).orderBy(time)
    new = F.coalesce(F.unix_micros(time) - F.unix_micros(F.lag(time).over(w)) > gap_seconds * 1_000_000, F.lit(True))
    s = events.withColumn("session", F.sum(new.cast("int")).over(w))
    return s.groupBy(key, "session").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("events"))
