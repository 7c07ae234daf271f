"""Evidence handling: exact occurrences, boosts, cards, quarantine, term pruning, relations, claim links, adjudication, packs, audit chains, extension points."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import clip_bytes, normal_stem

# ---- filters -------------------------------------------------------------------------------------


# What the path of a test, a fixture or a mock holds.
TEST_PATH = r"/tests?/|/__tests__/|\.test\.|\.spec\.|_test\.|/fixtures?/|/mocks/|/__mocks__/"


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike(TEST_PATH)


def interface_boost(score: Column, path: Column, query: str) -> Column:
    """For a query of three characters or more that may name an interface: its stem (without the I before a second capital) in the path
    counts 1.8 x, the stem without the word service, if four characters are left, in the file name 1.5 x."""
    query = query.strip()
    stem = (query[1:] if len(query) > 2 and query[0] == "I" and "A" <= query[1] <= "Z" else query).lower()
    short = stem.replace("service", "")
    file = F.substring_index(F.lower(path), "/", -1)
    factor = F.when(F.lower(path).contains(stem), 1.8).when(F.lit(len(short) >= 4) & file.contains(short), 1.5).otherwise(1.0)
    return score * (factor if len(query) >= 3 else F.lit(1.0))


def exact_occurrences(occurrences: DataFrame, text: str, kind: str | None = None) -> DataFrame:
    """Occurrences (path, kind, text, line) of a text; both predicates reach the scan."""
    hit = occurrences.where(F.col("text") == text)
    return hit.where(F.col("kind") == kind) if kind else hit


def card_filter(tenant: str, region: str, allowed: Sequence[str] = ()) -> Column:
    """Cards (card, tenant, region) that apply; an empty field of a card is a wildcard, an empty allow-list allows all."""
    wild = lambda c, v: F.coalesce(F.col(c), F.lit("")).isin("", v)
    rule = wild("tenant", tenant) & wild("region", region)
    return rule & F.col("card").isin(*allowed) if allowed else rule


def card_rank(topics: Column, docs: Column, cost: Column, wanted: Sequence[str]) -> Column:
    """Matching topics + 0.001 x documents - cost."""
    return F.size(F.array_intersect(topics, F.array(*[F.lit(t) for t in wanted]))) + 0.001 * docs - cost


def not_quarantined(rows: DataFrame, quarantine: DataFrame, key: str) -> DataFrame:
    return rows.join(quarantine.select(key).distinct(), key, "left_anti")


def prune_terms(frequencies: DataFrame, most: int) -> DataFrame:
    """Query terms (token, df) without the too frequent ones; identifiers stay."""
    return frequencies.where((F.col("df") <= most) | F.col("token").rlike(r"_|[0-9]|[a-z][A-Z]"))


# ---- relations and claims ------------------------------------------------------------------------


def import_stem_edges(edges: DataFrame, stem: str) -> DataFrame:
    """Unresolved import edges (file, to, resolved) whose target holds a stem."""
    return edges.where(~F.col("resolved") & F.lower("to").contains(stem.lower()))


def citing(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (id, doc) of claims or relations that cite one of the documents (doc): no list of documents is gathered."""
    cited = links.join(docs.select("doc").distinct(), "doc", "left_semi").select("id").distinct()
    return links.join(cited, "id", "left_semi").distinct()


def expand_relations(relations: DataFrame, seeds: DataFrame) -> DataFrame:
    """(entity): other ends of relations (src, dst) that touch a seed (entity); case does not count."""
    s = seeds.select(F.lower("entity").alias("e")).distinct()
    ends = relations.select(F.lower("src").alias("a"), F.lower("dst").alias("b"))
    both = ends.union(ends.select("b", "a"))
    return both.join(s, both.a == s.e, "left_semi").select(F.col("b").alias("entity")).distinct().join(s.withColumnRenamed("e", "entity"), "entity", "left_anti")


def claim_walk(links: DataFrame, seeds: DataFrame, depth: int = 2, most: int = 128) -> DataFrame:
    """(doc, hops): documents reached from seed documents (doc) through claims (id, doc) that cite both, each hop cut to its first ``most`` documents."""
    links = links.select("id", "doc").distinct()
    seen = seeds.select("doc").distinct().withColumn("hops", F.lit(0))
    for i in range(depth):
        ids = links.join(seen, "doc", "left_semi").select("id").distinct()
        step = links.join(ids, "id", "left_semi").select("doc").distinct().join(seen, "doc", "left_anti")
        seen = seen.union(step.orderBy("doc").limit(most).withColumn("hops", F.lit(i + 1)))
    return seen


def shared_token_documents(tokens: DataFrame, seeds: DataFrame, most: int = 8) -> DataFrame:
    """(doc, shared): documents that share a structure token (doc, token) with the seeds, over tokens of at most ``most`` documents."""
    rare = tokens.groupBy("token").agg(F.count_distinct("doc").alias("n")).where(F.col("n") <= most)
    s = seeds.select("doc").distinct()
    own = tokens.join(s, "doc", "left_semi").select("token").distinct().join(rare, "token", "left_semi")
    return tokens.join(own, "token", "left_semi").join(s, "doc", "left_anti").groupBy("doc").agg(F.count_distinct("token").alias("shared"))


def adjudicate(rows: DataFrame, group: str) -> DataFrame:
    """Rows (group, doc, dated) with ``leads``: the newest dated row of each group, the smallest id on ties; undated ones never lead a dated one."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last("dated"), "doc")
    return rows.withColumn("leads", F.row_number().over(w) == 1)


def verify_audit(log: DataFrame) -> DataFrame:
    """(tenant, rows, broken): rows (tenant, sequence, previous, digest) whose previous digest is not that of the row before, or whose sequence has a gap."""
    w = Window.partitionBy("tenant").orderBy("sequence")
    before, seq = F.lag("digest").over(w), F.lag("sequence").over(w)
    bad = (before.isNotNull() & ~F.col("previous").eqNullSafe(before)) | (seq.isNotNull() & (F.col("sequence") != seq + 1))
    return log.select("tenant", bad.alias("bad")).groupBy("tenant").agg(F.count("*").alias("rows"), F.count_if("bad").alias("broken"))


def head_words(text: Column) -> Column:
    """Distinct words of four or more bytes of a text's first 280 characters, white space collapsed, case ignored."""
    head = F.substring(F.lower(F.regexp_replace(text, r"\s+", " ")), 1, 280)
    return F.array_distinct(F.filter(F.regexp_extract_all(head, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda t: F.octet_length(t) >= 4))


def equal_heads(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, leader): documents of equal heads and the first of them."""
    head = F.substring(F.lower(F.regexp_replace(text_col, r"\s+", " ")), 1, 280)
    d = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.md5(head).alias("h"))
    first = d.groupBy("h").agg(F.min("doc").alias("leader"), F.count("*").alias("n")).where("n > 1")
    return d.join(first, "h").select("doc", "leader")


def support_sentences(docs: DataFrame, id_col: str, text_col: str, claim_tokens: Sequence[str]) -> DataFrame:
    """(doc, sentence, overlap): the sentence of each document that holds most of a claim's tokens, the first on ties."""
    s = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.regexp_replace(text_col, r"([.!?])\s+", "$1\u0001"), "\u0001")).alias("i", "sentence"))
    want = F.array(*[F.lit(t) for t in claim_tokens])
    n = F.size(F.array_intersect(want, F.regexp_extract_all(F.lower("sentence"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))))
    best = s.withColumn("overlap", n).where("overlap > 0").groupBy("doc").agg(F.max_by(F.struct("sentence", "overlap"), F.struct("overlap", -F.col("i"))).alias("b"))
    return best.select("doc", "b.sentence", "b.overlap")


def page_index_search(nodes: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(doc, line, score): heading nodes (doc, line, title, text) by the query terms in their title, plus 0.25 for each in their text."""
    score = sum(((F.lower("title").contains(t)).cast("double") + 0.25 * F.lower(F.coalesce("text", F.lit(""))).contains(t).cast("double") for t in terms), F.lit(0.0))
    return nodes.select("doc", "line", score.alias("score")).where("score > 0")


# ---- packs ---------------------------------------------------------------------------------------


def render(text: Column, mode: str) -> Column:
    """full, declarations (lines that declare something) or no_comments."""
    lines = F.split(text, "\n")
    if mode == "declarations":
        lines = F.filter(lines, lambda x: x.rlike(r"^\s*(?:def|func|type|class|struct|import|export|package|public|interface|const|var)\b"))
    elif mode == "no_comments":
        lines = F.filter(lines, lambda x: ~x.rlike(r"^\s*(?://|#|/\*|\*)"))
    return F.array_join(lines, "\n")


def pack(items: DataFrame, limit: int) -> DataFrame:
    """Items (pack, item, score, size) kept in score order while their running size stays within the limit."""
    w = Window.partitionBy("pack").orderBy(F.desc("score"), "item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return items.withColumn("used", F.sum("size").over(w)).where(F.col("used") <= limit)


def whole_lines(text: Column, most: Column) -> Column:
    """The first whole lines of a text that take at most ``most`` bytes; the text itself where it fits."""
    raw = F.encode(text, "UTF-8")
    # one byte more than allowed: what then stands behind the last line end did not fit
    cut = F.substring(raw, F.lit(1), (most + 1).cast("int"))
    at = F.length(F.regexp_extract(F.decode(cut, "ISO-8859-1"), r"(?s)^(.*)\n", 1))
    kept = F.when(F.locate("\n", F.decode(cut, "ISO-8859-1")) > 0, F.decode(F.substring(raw, F.lit(1), at), "UTF-8")).otherwise("")
    return F.when(text.isNull() | (F.octet_length(text) <= most), text).otherwise(kept)


def packed(sources: DataFrame, limit: int, floor_share: float = 0.5, mode: str = "full") -> DataFrame:
    """(pack, item, content, bytes, truncated, outcome): sources (pack, item, path, start, end, score, direct, text) rendered, given shares of a
    byte budget, cut at whole lines, and told apart: kept, budget (not one line fits) or duplicate (a better source of the pack has the same
    path, lines and content)."""
    from tessera.operators.relations import allocate_budget

    r = sources.withColumn("shown", render(F.col("text"), mode)).withColumn("size", F.octet_length("shown"))
    r = r.join(allocate_budget(r.select("pack", "item", "size", "score", "direct"), limit, floor_share), ["pack", "item"])
    r = r.withColumn("content", whole_lines(F.col("shown"), F.col("granted")))
    truncated = F.col("content") != F.col("shown")
    same = Window.partitionBy("pack", "path", "start", "end", F.md5("content")).orderBy(F.desc("score"), "path", "start", "end", "item")
    outcome = F.when(truncated & (F.col("content") == ""), "budget").when(F.row_number().over(same) > 1, "duplicate").otherwise("kept")
    kept = F.when(outcome == "kept", F.col("content")).otherwise("")
    return r.select("pack", "item", kept.alias("content"), F.octet_length(kept).alias("bytes"), (truncated & (outcome == "kept")).alias("truncated"), outcome.alias("outcome"))


def identifier_floor(ranked: DataFrame, defining: DataFrame, k: int) -> DataFrame:
    """(query, doc, score, defines): the k best of each query, files that define the identifier before all others."""
    d = defining.select("query", "doc").distinct().withColumn("defines", F.lit(True))
    r = ranked.join(d, ["query", "doc"], "left").withColumn("defines", F.coalesce("defines", F.lit(False)))
    w = Window.partitionBy("query").orderBy(F.desc("defines"), F.desc("score"), "doc")
    return r.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def tier_order(memories: DataFrame) -> DataFrame:
    """Memories (principal, tier, created, item) with their place: stm before mtm before ltm, newest first."""
    rank = F.when(F.col("tier") == "stm", 0).when(F.col("tier") == "mtm", 1).otherwise(2)
    return memories.withColumn("place", F.row_number().over(Window.partitionBy("principal").orderBy(rank, F.desc("created"), "item")))


# ---- sinks and extension points ------------------------------------------------------------------


def receipts(batch: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """(outcome, rows): what an upsert of a batch does: inserted, updated or unchanged."""
    j = batch.select(key, F.col(digest).alias("new")).join(stored.select(key, F.col(digest).alias("old")), key, "left")
    outcome = F.when(F.col("old").isNull(), "inserted").when(F.col("old") == F.col("new"), "unchanged").otherwise("updated")
    return j.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("rows"))


def reconcile(local: DataFrame, remote: DataFrame, key: str, revision: str) -> DataFrame:
    """(key, action): fetch what is new or newer at a connector, drop what is gone there, keep the rest."""
    j = local.select(key, F.col(revision).alias("l")).join(remote.select(key, F.col(revision).alias("r")), key, "full_outer")
    action = F.when(F.col("l").isNull() | (F.col("r") > F.col("l")), "fetch").when(F.col("r").isNull(), "drop").otherwise("keep")
    return j.select(key, action.alias("action"))


def rerank_with(pool: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series], name: str = "custom") -> DataFrame:
    """(query, doc, text, score, reranker): a pluggable vectorised reranker over (query, text) pairs; nulls from it fall back to the old score."""
    udf = F.pandas_udf(score, "double")
    return pool.withColumn("score", F.coalesce(udf("query", "text"), "score")).withColumn("reranker", F.lit(name))


WORKERS: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}


def worker(kind: str):
    """Register a worker: a function of a frame of jobs to a frame (doc, output)."""

    def add(f):
        WORKERS[kind] = f
        return f

    return add


def run_workers(jobs: DataFrame, kind: str) -> DataFrame:
    """(doc, kind, output) of the jobs of a kind, by its worker, batch by batch."""
    f = WORKERS[kind]

    def run(batches):
        for b in batches:
            yield f(b).assign(kind=kind)[["doc", "kind", "output"]]

    return jobs.where(F.col("kind") == kind).mapInPandas(run, "doc string, kind string, output string")


@worker("context_header")
def _header(jobs: pd.DataFrame) -> pd.DataFrame:
    text = jobs["text"].fillna("").str.split("\n").str[0].str.slice(0, 120)
    return pd.DataFrame({"doc": jobs["doc"], "output": "From " + jobs["doc"].astype(str) + ": " + text})


def missing_embeddings(wanted: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose embedding is not in the cache under the same identity, tenant and generation."""
    return wanted.join(cache.select(*keys).distinct(), list(keys), "left_anti")


def fill_embeddings(wanted: DataFrame, cache: DataFrame, keys: Sequence[str], embed: Callable[[Column], Column]) -> DataFrame:
    """The cache (keys.., embedding) with the embeddings of the wanted rows (keys.., text) it lacked; what it has is not computed again."""
    new = missing_embeddings(wanted, cache, keys).dropDuplicates(list(keys)).select(*keys, embed(F.col("text")).alias("embedding"))
    return cache.select(*keys, "embedding").unionByName(new)


def stems(path: Column) -> Column:
    return normal_stem(path)
