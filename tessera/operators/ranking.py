"""Scoring and ranking operators. Each takes and gives DataFrames; ties are always broken by a stated key.

Query-side relations (terms, seeds, weights) are literals of a query and therefore bounded; they are
broadcast. Corpus statistics are one-row aggregates joined by broadcast. Top-k is an ordered limit,
which Spark runs as a bounded heap per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import clip_bytes, normal_stem
from tessera.operators import index
from tessera.runtime import materialise

MAX_TERMS = 256


def terms_table(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    terms = list(dict.fromkeys(terms))
    if not 0 < len(terms) <= MAX_TERMS:
        raise ValueError(f"a query has 1 to {MAX_TERMS} distinct terms")
    return F.broadcast(df.sparkSession.createDataFrame([(t,) for t in terms], "token string"))


def query_hits(docs: DataFrame, id_col: str, tokens: Column, terms: Sequence[str]) -> DataFrame:
    """(doc, dl, hit): length and matching tokens of every document, as a narrow written table.

    Texts are read and tokenised once; every score of a query, and the corpus statistics, come from this table.
    """
    terms = list(dict.fromkeys(terms))
    d = docs.select(F.col(id_col).alias("doc"), tokens.alias("ts"))
    return materialise(d.select("doc", F.size("ts").alias("dl"), F.filter("ts", lambda t: t.isin(*terms)).alias("hit")), label="hits")


def bm25(docs: DataFrame, id_col: str, tokens: Column, terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc, score): BM25 with idf ln(1 + (N - df + 0.5) / (df + 0.5)); documents without a term are left out."""
    return bm25_of(query_hits(docs, id_col, tokens, terms), k1, b)


def bm25_of(hits: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 of a table of query hits."""
    stats = hits.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    post = hits.where(F.size("hit") > 0).select("doc", "dl", F.explode("hit").alias("token")).groupBy("doc", "dl", "token").agg(F.count("*").alias("tf"))
    df = post.groupBy("token").agg(F.count("*").alias("df"))
    scored = post.join(F.broadcast(df), "token").crossJoin(F.broadcast(stats))  # one row of statistics
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("doc").agg(F.sum(idf * gain).alias("score"))


def coverage_tfidf(docs: DataFrame, id_col: str, tokens: Column, terms: Sequence[str]) -> DataFrame:
    """(doc, score, matched): sum of log1p(tf) log1p(N / (df + 1)), demoted by the share of the terms that are missing."""
    terms = list(dict.fromkeys(terms))
    return coverage_of(index.query_postings(docs, id_col, tokens, terms), docs.agg(F.count("*").alias("n")), terms)


def coverage_of(post: DataFrame, n: DataFrame, terms: Sequence[str]) -> DataFrame:
    """``coverage_tfidf`` of the terms' postings (doc, token, tf) and one row with the number of documents."""
    df = post.groupBy("token").agg(F.count("*").alias("df"))
    scored = post.join(F.broadcast(df), "token").crossJoin(F.broadcast(n))
    each = F.log1p("tf") * F.log1p(F.col("n") / (F.col("df") + 1))
    out = scored.groupBy("doc").agg(F.sum(each).alias("raw"), F.count("*").alias("matched"))
    cover = 0.10 + 0.90 * F.col("matched") / len(terms) if len(terms) > 1 else F.lit(1.0)
    return out.select("doc", (F.col("raw") * cover).alias("score"), "matched")


# Fixed values: (what a lower-cased path or its file name looks like, factor); of a group the first that fits counts.
PATH_RULES = (
    ("path", ((r"/tests?/|/__tests__/|\.test\.|\.spec\.|_test\.|/fixtures?/|perf-data|\.snap|/mocks/|/__mocks__/", 0.10), (r"/test|testing", 0.30))),
    ("path", ((r"extensions/copilot/|/util/vs/|node_modules/", 0.25),)),
    ("path", ((r"^src/", 1.15),)),
    ("file", ((r"^i.*service", 1.25),)),
    ("file", ((r"configuration|configservice", 1.2),)),
)
# Bonus for where sources lie; points of a query term for the file's stem and for the path.
DEPTH_RULES = ((r"^src/", 3.0), (r"/src/", 1.5))
STEM_POINTS, PATH_POINTS = (28.0, 10.0, 3.0), (8.0, 1.0)


def _first_fit(text: Column, rules: Sequence[tuple[str, float]], otherwise: float) -> Column:
    out = F.lit(otherwise)
    for rx, value in reversed(rules):
        out = F.when(text.rlike(rx), value).otherwise(out)
    return out


def path_multiplier(path: Column) -> Column:
    """Demotes tests, fixtures and vendored copies, prefers sources and service interfaces."""
    p = F.lower(path)
    at = {"path": p, "file": F.substring_index(p, "/", -1)}
    return reduce(lambda a, b: a * b, [_first_fit(at[where], rules, 1.0) for where, rules in PATH_RULES])


def depth_bonus(path: Column) -> Column:
    return _first_fit(F.lower(path), DEPTH_RULES, 0.0)


def path_term_bonus(path: Column, terms: Sequence[str]) -> Column:
    """Per term: 28 for the file stem, 10 for its start or end, 3 inside it; 8 for a whole path part, 1 anywhere in the path."""
    p, stem = F.lower(path), normal_stem(path)
    file = F.substring_index(p, "/", -1)
    bare = F.regexp_replace(file, r"\.[^.]*$", "")

    def points(t: str) -> Column:
        fits = ((stem == t) | (bare == t) | (file == t), stem.startswith(t) | stem.endswith(t), stem.contains(t) | file.contains(t))
        whole = p.contains(f"/{t}.") | p.contains(f"/{t}/")
        grade = lambda tests, values: F.coalesce(*[F.when(c, v) for c, v in zip(tests, values)], F.lit(0.0))
        return grade(fits, STEM_POINTS) + grade((whole, p.contains(t)), PATH_POINTS)

    return sum((points(t) for t in dict.fromkeys(terms)), F.lit(0.0))


def code_search(files: DataFrame, path_col: str, tokens: Column, terms: Sequence[str], definitions: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(path, score): term score times path multiplier, plus path, definition and depth boosts; ties by depth, then path.

    ``definitions`` (path, name) are joined once, restricted to the terms beforehand.
    """
    return code_search_of(coverage_tfidf(files, path_col, tokens, terms), terms, definitions, k)


def code_search_of(score: DataFrame, terms: Sequence[str], definitions: DataFrame | None = None, k: int = 10) -> DataFrame:
    """``code_search`` of term scores (doc, score), such as those of saved postings."""
    score = score.withColumnRenamed("doc", "path")
    path = F.col("path")
    boosted = F.col("score") * path_multiplier(path) + path_term_bonus(path, terms) + depth_bonus(path)
    if definitions is not None:
        defines = definitions.where(F.lower("name").isin(*terms)).select("path").distinct().withColumn("defines", F.lit(14.0))
        score = score.join(defines, "path", "left")
        boosted = boosted + F.coalesce("defines", F.lit(0.0))
    depth = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return score.select("path", boosted.alias("score")).orderBy(F.desc("score"), depth, "path").limit(k)


def summed_tf(docs: DataFrame, id_col: str, tokens: Column, terms: Sequence[str], sidecars: DataFrame | None = None) -> DataFrame:
    """(doc, score): sum of term frequencies, plus 0.5 for each occurrence of a term in the document's sidecar texts (doc, tokens)."""
    base = index.query_postings(docs, id_col, tokens, terms).groupBy("doc").agg(F.sum("tf").cast("double").alias("score"))
    if sidecars is None:
        return base
    extra = sidecars.select("doc", F.size(F.filter("tokens", lambda t: t.isin(*terms))).alias("n")).groupBy("doc").agg((0.5 * F.sum("n")).alias("extra"))
    return base.join(extra, "doc", "left").select("doc", (F.col("score") + F.coalesce("extra", F.lit(0.0))).alias("score"))


def bag_cosine(docs: DataFrame, id_col: str, tokens: Column, terms: Sequence[str]) -> DataFrame:
    """(doc, score): cosine of term-frequency vectors, the query's included; only positive scores."""
    q: dict[str, int] = {}
    for t in terms:
        q[t] = q.get(t, 0) + 1
    qn = sum(v * v for v in q.values()) ** 0.5
    post = index.postings(docs, id_col, tokens)
    weight = F.create_map(*[F.lit(x) for kv in q.items() for x in kv])
    part = post.groupBy("doc").agg(
        F.sum(F.col("tf") * F.coalesce(F.element_at(weight, F.col("token")), F.lit(0))).alias("dot"), F.sum(F.col("tf") * F.col("tf")).alias("sq")
    )
    return part.where("dot > 0").select("doc", (F.col("dot") / (F.sqrt("sq") * qn)).alias("score"))


def lexical_rerank(docs: DataFrame, tokens: Column, terms: Sequence[str]) -> Column:
    """Share of the distinct query terms that the text holds."""
    q = F.array(*[F.lit(t) for t in dict.fromkeys(terms)])
    return F.size(F.array_intersect(q, tokens)) / F.size(q)


def top(scored: DataFrame, k: int, score: str = "score", tie: str = "doc") -> DataFrame:
    """The k best; scores that differ in the tenth digit, as sums in another order do, are ties."""
    return scored.orderBy(F.desc(F.round(score, 9)), F.asc(tie)).limit(k)


def ranked(scored: DataFrame, k: int, score: str = "score", tie: str = "doc") -> DataFrame:
    """The k best rows with their rank from 1. The limit comes first, so the one-task window sees k rows."""
    return top(scored, k, score, tie).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round(score, 9)), F.asc(tie))))


def rrf(lists: Sequence[DataFrame], constant: int = 60) -> DataFrame:
    """(doc, score, first_list, first_rank): sum of 1 / (constant + rank) over ranked lists (doc, rank); tie by first appearance, then doc."""
    union = None
    for i, ranked_list in enumerate(lists):
        part = ranked_list.select("doc", "rank", F.lit(i).alias("list"))
        union = part if union is None else union.unionByName(part)
    seen = F.min(F.struct("list", "rank"))
    return union.groupBy("doc").agg(F.sum(1 / (F.lit(constant) + F.col("rank"))).alias("score"), seen.alias("f")).select("doc", "score", F.col("f.list").alias("first_list"), F.col("f.rank").alias("first_rank"))


def rank_fusion(signals: DataFrame) -> DataFrame:
    """(doc, fused) from (doc, lexical, defines, pagerank, degree, path_weight): fixed weights over the best lexical score."""
    best = signals.agg(F.max("lexical").alias("best"))
    s = signals.crossJoin(F.broadcast(best))  # one row
    lex = F.when(F.col("best") > 0, F.col("lexical") / F.col("best")).otherwise(0.0)
    return s.select("doc", (0.6 * lex + 0.15 * F.col("defines") + 0.15 * F.col("pagerank") + 0.05 * F.col("degree") + 0.05 * F.col("path_weight")).alias("fused"))


def min_max_prior(scored: DataFrame, prior: DataFrame, weight: float = 0.15) -> DataFrame:
    """(doc, score): score times 1 + weight x the min-max normalised prior; a flat prior normalises to 1, a missing one to 0."""
    span = prior.agg(F.min("prior").alias("lo"), F.max("prior").alias("hi"))
    j = scored.join(prior, "doc", "left").crossJoin(F.broadcast(span))
    flat = (F.col("hi") - F.col("lo")) < 1e-12
    part = F.when(F.col("prior").isNull(), 0.0).when(flat, 1.0).otherwise((F.col("prior") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return j.select("doc", (F.col("score") * (1 + weight * part)).alias("score"))


def utility_weighted(scored: DataFrame, utility: DataFrame) -> DataFrame:
    return scored.join(utility, "doc", "left").select("doc", (F.col("score") * F.coalesce("utility", F.lit(1.0))).alias("score"))


# Authority of a source by its name.
SOURCE_AUTHORITY = {"confluence": 1.0, "notion": 0.95, "google_drive": 0.9, "gdrive": 0.9, "github": 0.85, "linear": 0.8, "jira": 0.8, "slack": 0.55, "gmail": 0.5, "email": 0.5, "fireflies": 0.45, "video": 0.45, "meeting": 0.45}
# Wording of current and of outdated policy.
CURRENT = r"(?i)\b(supersed(?:es|ed|ing)?|current\s+policy|updated\s+policy|goes\s+live|effective\s+20|the\s+newest\s+version|revised\s+policy|now\s+provides|company-?wide\s+policy)\b"
OUTDATED = r"(?i)\b(draft\s+note|earlier\s+note|an\s+older\s+version|old\s+policy|superseded\s+by|obsolete|mistaken|wrongly|pilot\s+only|suggested)\b"


def authority(blob: Column) -> Column:
    b = F.lower(blob)
    best = F.greatest(F.lit(0.5), *[F.when(b.contains(k), v).otherwise(0.0) for k, v in SOURCE_AUTHORITY.items()])
    return F.when(b.rlike(r"policy|handbook|effective |confluence"), F.greatest(best, F.lit(0.85))).otherwise(best)


def currency(text: Column) -> Column:
    """0.5 + 0.12 for each sign of a current text - 0.15 for each of an outdated one in its first 2,500 bytes, within 0 and 1."""
    text = clip_bytes(text, 2_500)
    v = 0.5 + 0.12 * F.regexp_count(text, F.lit(CURRENT)) - 0.15 * F.regexp_count(text, F.lit(OUTDATED))
    return F.when(text.isNull() | (text == ""), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)))


def coverage_rerank(pool: DataFrame, k: int, pool_limit: int = 64) -> DataFrame:
    """Greedy diversity order of each query's pool (query, doc, chunk, tokens, relevance): 0.7 x relevance - 0.3 x the largest
    Jaccard overlap with what was taken - 0.35 for a document seen. Pools are cut to their best rows before they gather."""
    w = Window.partitionBy("query").orderBy(F.desc("relevance"), "chunk")
    cut = pool.withColumn("n", F.row_number().over(w)).where(F.col("n") <= pool_limit).drop("n")

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["relevance", "chunk"], ascending=[False, True]).reset_index(drop=True)
        sets = [set(t) for t in pdf["tokens"]]
        left, taken, rows = list(range(len(pdf))), [], []
        while left and len(taken) < k:
            def gain(i: int) -> float:
                worst = max((len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 0.0 for j in taken), default=0.0)
                seen = 0.35 if any(pdf["doc"][i] == pdf["doc"][j] for j in taken) else 0.0
                return 0.7 * pdf["relevance"][i] - 0.3 * worst - seen

            best = max(left, key=lambda i: (gain(i), -i))
            rows.append((pdf["query"][best], pdf["doc"][best], pdf["chunk"][best], len(taken) + 1, float(gain(best))))
            taken.append(best)
            left.remove(best)
        return pd.DataFrame(rows, columns=["query", "doc", "chunk", "place", "gain"])

    types = dict(pool.dtypes)
    return cut.groupBy("query").applyInPandas(order, f"query {types['query']}, doc {types['doc']}, chunk {types['chunk']}, place int, gain double")
