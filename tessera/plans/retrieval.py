"""Retrieval queries over documents, chunks and embeddings."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import index, ranking
from tessera.plans import registry
from tessera.plans.registry import query
from tessera.runtime import shared_dir, table
from tessera.sources import readers

TERMS = ["retired", "cursor", "snapshot", "report", "file"]
_IN = ", ".join(f"'{t}'" for t in TERMS)
_BY_TOKEN = r"[\p{L}\p{N}_]+"
_TOK = rf"""
  docs AS (SELECT doc_id, text, list_filter(regexp_extract_all(lower(text), '{_BY_TOKEN}'), lambda x: strlen(x) >= 2) AS ts FROM documents WHERE text IS NOT NULL),
  tok AS (SELECT doc_id AS doc, unnest(ts) AS token FROM docs),
  post AS (SELECT doc, token, count(*) AS tf FROM tok GROUP BY doc, token),
  dfs AS (SELECT token, count(*) AS df FROM post GROUP BY token)"""


def _docs(spark, sf):
    return table(spark, sf, "documents").where(F.col("text").isNotNull())


@query(f"WITH {_TOK} SELECT doc, token, tf FROM post")
def term_frequency(spark, sf):
    return index.postings(_docs(spark, sf), "doc_id", T.index_tokens("text"))


@query(f"WITH {_TOK} SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY token")
def document_frequency(spark, sf):
    return index.document_frequency(index.postings(_docs(spark, sf), "doc_id", T.index_tokens("text")))


@query(f"WITH {_TOK} SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_tokens, round(avg(len(ts)), 6) AS avgdl FROM docs")
def corpus_statistics(spark, sf):
    s = index.statistics(index.lengths(_docs(spark, sf), "doc_id", T.index_tokens("text")))
    return s.select("n_docs", "n_tokens", F.round("avgdl", 6).alias("avgdl"))


_BM25 = f"""WITH {_TOK},
  st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM docs),
  hit AS (SELECT p.doc, p.token, p.tf, d.df, len(x.ts) AS dl FROM post p JOIN dfs d USING (token) JOIN docs x ON x.doc_id = p.doc WHERE p.token IN ({_IN})),
  bm AS (SELECT doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM hit, st GROUP BY doc)"""


@query(f"{_BM25} SELECT doc, round(score, 6) AS score FROM bm ORDER BY round(bm.score, 9) DESC, doc LIMIT 20")
def bm25_topk(spark, sf):
    s = ranking.bm25(_docs(spark, sf), "doc_id", T.index_tokens("text"), TERMS)
    return ranking.top(s, 20).select("doc", F.round("score", 6).alias("score"))


@query(f"{_BM25} SELECT doc, round(score, 6) AS score FROM bm")
def bm25_scores(spark, sf):
    s = ranking.bm25(_docs(spark, sf), "doc_id", T.index_tokens("text"), TERMS)
    return s.select("doc", F.round("score", 6).alias("score"))


_TFIDF = f"""WITH {_TOK}, st AS (SELECT count(*) AS n FROM docs),
  cov AS (SELECT doc, sum(ln(1 + tf) * ln(1 + n / (df + 1))) * (0.10 + 0.90 * count(*) / {len(TERMS)}) AS score, count(*) AS matched
          FROM post JOIN dfs USING (token), st WHERE token IN ({_IN}) GROUP BY doc)"""


@query(f"{_TFIDF} SELECT doc, round(score, 6) AS score, matched FROM cov")
def coverage_tfidf(spark, sf):
    s = ranking.coverage_tfidf(_docs(spark, sf), "doc_id", T.index_tokens("text"), TERMS)
    return s.select("doc", F.round("score", 6).alias("score"), "matched")


@query(f"WITH {_TOK} SELECT doc, CAST(sum(tf) AS DOUBLE) AS score FROM post WHERE token IN ({_IN}) GROUP BY doc")
def summed_tf(spark, sf):
    return ranking.summed_tf(_docs(spark, sf), "doc_id", T.index_tokens("text"), TERMS)


@query(f"""WITH dedup AS (SELECT chunk_id, dsid, text_content FROM product_chunk_metadata WHERE text_content IS NOT NULL),
  d AS (SELECT DISTINCT chunk_id, dsid, text_content FROM dedup),
  t AS (SELECT chunk_id AS doc, any_value(dsid) AS dsid, list_filter(regexp_extract_all(lower(text_content), '{_BY_TOKEN}'), lambda x: x IN ({_IN})) AS hit FROM d GROUP BY chunk_id, text_content),
  b AS (SELECT doc, dsid, len(hit) AS n FROM t WHERE len(hit) > 0),
  s AS (SELECT document_id, sum(len(list_filter(regexp_extract_all(lower(text), '{_BY_TOKEN}'), lambda x: x IN ({_IN})))) AS m
        FROM (SELECT DISTINCT document_id, kind, text FROM product_sidecars WHERE text IS NOT NULL) GROUP BY document_id)
  SELECT b.doc, CAST(b.n + 0.5 * coalesce(s.m, 0) AS DOUBLE) AS score FROM b LEFT JOIN s ON s.document_id = b.dsid""")
def summed_tf_with_sidecars(spark, sf):
    chunks = table(spark, sf, "product_chunk_metadata").where(F.col("text_content").isNotNull()).select("chunk_id", "dsid", "text_content").distinct()
    side = table(spark, sf, "product_sidecars").where(F.col("text").isNotNull()).select("document_id", "kind", "text").distinct()
    hits = F.size(F.filter(T.index_tokens("text_content"), lambda t: t.isin(*TERMS)))
    base = chunks.select(F.col("chunk_id").alias("doc"), "dsid", hits.alias("n")).where("n > 0")
    extra = side.select("document_id", F.size(F.filter(T.index_tokens("text"), lambda t: t.isin(*TERMS))).alias("m")).groupBy("document_id").agg(F.sum("m").alias("m"))
    joined = base.join(extra, base.dsid == extra.document_id, "left")
    return joined.select("doc", (F.col("n") + 0.5 * F.coalesce("m", F.lit(0))).cast("double").alias("score"))


_BAG = f"""WITH {_TOK}, q(token, qtf) AS (VALUES {", ".join(f"('{t}', 1)" for t in TERMS)}),
  n AS (SELECT doc, sqrt(sum(tf * tf)) AS norm FROM post GROUP BY doc)
  SELECT doc, round(sum(tf * qtf) / (any_value(norm) * sqrt({len(TERMS)})), 6) AS score FROM post JOIN q USING (token) JOIN n USING (doc) GROUP BY doc"""


@query(_BAG)
def bag_cosine(spark, sf):
    s = ranking.bag_cosine(_docs(spark, sf), "doc_id", T.index_tokens("text"), TERMS)
    return s.select("doc", F.round("score", 6).alias("score"))


@query(rf"""WITH d AS (SELECT doc_id AS doc, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS ts FROM documents WHERE text IS NOT NULL)
  SELECT doc, round(len(list_filter([{_IN}], lambda t: list_contains(ts, t))) / {len(TERMS)}, 6) AS score FROM d""")
def lexical_rerank(spark, sf):
    return _docs(spark, sf).select(F.col("doc_id").alias("doc"), F.round(ranking.lexical_rerank(None, T.ascii_tokens("text"), TERMS), 6).alias("score"))


_FUSE = f"""{_BM25},
  cov AS (SELECT doc, sum(ln(1 + tf) * ln(1 + n / (df + 1))) * (0.10 + 0.90 * count(*) / {len(TERMS)}) AS score FROM hit, st GROUP BY doc),
  sm AS (SELECT doc, CAST(sum(tf) AS DOUBLE) AS score FROM hit GROUP BY doc),
  r AS (SELECT doc, row_number() OVER (ORDER BY round(score, 9) DESC, doc) AS rank, 0 AS list FROM bm
        UNION ALL SELECT doc, row_number() OVER (ORDER BY round(score, 9) DESC, doc), 1 FROM cov
        UNION ALL SELECT doc, row_number() OVER (ORDER BY round(score, 9) DESC, doc), 2 FROM sm)"""


@query(f"""{_FUSE} SELECT doc, round(sum(1.0 / (60 + rank)), 9) AS score, CAST(arg_min(list, list * 1000 + rank) AS INT) AS first_list, CAST(arg_min(rank, list * 1000 + rank) AS INT) AS first_rank
  FROM r WHERE rank <= 50 GROUP BY doc""")
def rrf_fused(spark, sf):
    hits = ranking.query_hits(_docs(spark, sf), "doc_id", T.index_tokens("text"), TERMS)  # one pass over the texts for three lists
    hit = F.col("hit")
    lists = [ranking.bm25_of(hits), ranking.coverage_tfidf(hits, "doc", hit, TERMS), ranking.summed_tf(hits, "doc", hit, TERMS)]
    fused = ranking.rrf([ranking.ranked(s, 50) for s in lists])
    return fused.select("doc", F.round("score", 9).alias("score"), "first_list", "first_rank")


_PATH = "lower(coalesce(source, 'none') || '/' || kind || '/src/' || replace(lower(coalesce(title, 'untitled')), ' ', '_') || '_' || doc_id || '.md')"


def _paths(spark, sf):
    title = F.replace(F.lower(F.coalesce("title", F.lit("untitled"))), F.lit(" "), F.lit("_"))
    path = F.lower(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("kind"), F.lit("/src/"), title, F.lit("_"), F.col("doc_id"), F.lit(".md")))
    return _docs(spark, sf).withColumn("path", path)


#: A file defines the words of its title.
_DEFINED = f"(CASE WHEN path IN (SELECT {_PATH} FROM documents WHERE text IS NOT NULL AND list_has_any(string_split(lower(title), ' '), [{_IN}])) THEN 14 ELSE 0 END)"


def _multiplier_sql(p: str) -> str:
    base = f"regexp_replace({p}, '^.*/', '')"
    return rf"""((CASE WHEN regexp_matches({p}, '/tests?/|/__tests__/|\.test\.|\.spec\.|_test\.|/fixtures?/|perf-data|\.snap|/mocks/|/__mocks__/') THEN 0.10 WHEN regexp_matches({p}, '/test|testing') THEN 0.30 ELSE 1.0 END)
    * (CASE WHEN regexp_matches({p}, 'extensions/copilot/|/util/vs/|node_modules/') THEN 0.25 ELSE 1.0 END) * (CASE WHEN starts_with({p}, 'src/') THEN 1.15 ELSE 1.0 END)
    * (CASE WHEN starts_with({base}, 'i') AND contains({base}, 'service') THEN 1.25 ELSE 1.0 END) * (CASE WHEN contains({base}, 'configuration') OR contains({base}, 'configservice') THEN 1.2 ELSE 1.0 END))"""


def _term_bonus_sql(p: str) -> str:
    base = f"regexp_replace({p}, '^.*/', '')"
    raw = rf"regexp_replace({base}, '\.[^.]*$', '')"
    stem = f"regexp_replace({raw}, '[._-]', '', 'g')"
    parts = []
    for t in TERMS:
        parts.append(f"(CASE WHEN {stem} = '{t}' OR {raw} = '{t}' OR {base} = '{t}' THEN 28 WHEN starts_with({stem}, '{t}') OR ends_with({stem}, '{t}') THEN 10 WHEN contains({stem}, '{t}') OR contains({base}, '{t}') THEN 3 ELSE 0 END)")
        parts.append(f"(CASE WHEN contains({p}, '/{t}.') OR contains({p}, '/{t}/') THEN 8 WHEN contains({p}, '{t}') THEN 1 ELSE 0 END)")
    return " + ".join(parts)


@query(f"""WITH src AS (SELECT {_PATH} AS path, text, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda x: true) AS ts FROM documents WHERE text IS NOT NULL),
  tok AS (SELECT path, unnest(ts) AS token FROM src), post AS (SELECT path, token, count(*) AS tf FROM tok WHERE token IN ({_IN}) GROUP BY ALL),
  dfs AS (SELECT token, count(*) AS df FROM post GROUP BY token), st AS (SELECT count(*) AS n FROM src),
  s AS (SELECT path, sum(ln(1 + tf) * ln(1 + n / (df + 1))) * (0.10 + 0.90 * count(*) / {len(TERMS)}) AS base FROM post JOIN dfs USING (token), st GROUP BY path)
  SELECT path, round(base * {_multiplier_sql('path')} + {_term_bonus_sql('path')} + (CASE WHEN starts_with(path, 'src/') THEN 3.0 WHEN contains(path, '/src/') THEN 1.5 ELSE 0 END) + {_DEFINED}, 6) AS score
  FROM s ORDER BY base * {_multiplier_sql('path')} + {_term_bonus_sql('path')} + (CASE WHEN starts_with(path, 'src/') THEN 3.0 WHEN contains(path, '/src/') THEN 1.5 ELSE 0 END) + {_DEFINED} DESC, path LIMIT 50""")
def code_search(spark, sf):
    docs = _paths(spark, sf)
    defined = docs.select("path", F.explode(F.split(F.lower("title"), " ")).alias("name"))
    hits = ranking.code_search(docs, "path", T.unicode_tokens("text"), TERMS, defined, k=50)
    return hits.select("path", F.round("score", 6).alias("score"))


def saved_index(spark, sf):
    """(postings by path and token, titles, one row of counts) of the documents, saved in the shared folder under the stamps of the table's files: built
    where there is none for these stamps, else opened."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/documents.parquet")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [fs.getFileStatus(place)] if not fs.getFileStatus(place).isDirectory() else list(fs.listStatus(place))
    stamp = hashlib.sha256("|".join(sorted(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}" for f in files)).encode()).hexdigest()[:24]
    root = f"{shared_dir(spark)}/index-{stamp}"
    parts = {k: readers.VersionedTable(spark, f"{root}-{k}") for k in ("names", "counts")}
    if parts["counts"].current() is None:  # written last
        d = _paths(spark, sf)
        readers.save_postings(index.row_postings(d, "path", T.unicode_tokens("text")), f"{root}-postings")
        parts["names"].publish(d.select("path", F.explode(F.split(F.lower("title"), " ")).alias("name")))
        parts["counts"].publish(d.agg(F.count("*").alias("n")))
    return f"{root}-postings", parts["names"].load(), parts["counts"].load()


@query(registry.SQL["code_search"])
def code_search_saved(spark, sf):
    """``code_search`` over the saved index: only the buckets of the query's tokens are read."""
    post, names, counts = saved_index(spark, sf)
    hits = ranking.code_search_of(ranking.coverage_of(readers.load_postings(spark, post, TERMS), counts, TERMS), TERMS, names, 50)
    return hits.select("path", F.round("score", 6).alias("score"))


@query(f"SELECT DISTINCT source_uri, CAST(round({_multiplier_sql('lower(source_uri)')}, 6) AS DOUBLE) AS multiplier FROM product_chunk_metadata WHERE source_uri IS NOT NULL")
def path_multiplier(spark, sf):
    uris = table(spark, sf, "product_chunk_metadata").where(F.col("source_uri").isNotNull()).select("source_uri").distinct()
    return uris.select("source_uri", F.round(ranking.path_multiplier(F.col("source_uri")), 6).alias("multiplier"))


@query(f"""{_FUSE.replace("sm AS", "best AS (SELECT max(score) AS top FROM bm), sm AS")},
  sig AS (SELECT bm.doc, bm.score / top AS lex, sm.score AS tf FROM bm JOIN sm USING (doc), best)
  SELECT doc, round(0.6 * lex + 0.15 * (tf >= 3)::INT + 0.15 * (doc % 10) / 10 + 0.05 * (doc % 7) / 7 + 0.05 * (doc % 3), 6) AS fused FROM sig""")
def rank_fusion(spark, sf):
    hits = ranking.query_hits(_docs(spark, sf), "doc_id", T.index_tokens("text"), TERMS)
    lex = ranking.bm25_of(hits).withColumnRenamed("score", "lexical")
    tf = ranking.summed_tf(hits, "doc", F.col("hit"), TERMS)
    part = lambda n: F.col("doc") % n / n
    signals = lex.join(tf, "doc").select("doc", "lexical", F.when(F.col("score") >= 3, 1).otherwise(0).alias("defines"), part(10).alias("pagerank"), part(7).alias("degree"), (F.col("doc") % 3).alias("path_weight"))
    return ranking.rank_fusion(signals).select("doc", F.round("fused", 6).alias("fused"))


_AUTH = """CASE WHEN contains(b, 'confluence') THEN 1.0 WHEN contains(b, 'notion') THEN 0.95 WHEN contains(b, 'google_drive') OR contains(b, 'gdrive') THEN 0.9 WHEN contains(b, 'github') THEN 0.85
  WHEN contains(b, 'linear') OR contains(b, 'jira') THEN 0.8 WHEN contains(b, 'slack') THEN 0.55 WHEN contains(b, 'gmail') OR contains(b, 'email') THEN 0.5 WHEN contains(b, 'fireflies') OR contains(b, 'video') OR contains(b, 'meeting') THEN 0.45 ELSE 0 END"""


@query(f"""WITH x AS (SELECT doc_id AS doc, lower(coalesce(source, '') || ' ' || coalesce(title, '') || ' ' || substr(text, 1, 500)) AS b FROM documents WHERE text IS NOT NULL),
  y AS (SELECT doc, b, greatest(0.5, {_AUTH}) AS best FROM x)
  SELECT doc, CAST(CASE WHEN regexp_matches(b, 'policy|handbook|effective |confluence') THEN greatest(best, 0.85) ELSE best END AS DOUBLE) AS authority FROM y""")
def source_authority(spark, sf):
    blob = F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("title", F.lit("")), F.substring("text", 1, 500))
    return _docs(spark, sf).select(F.col("doc_id").alias("doc"), ranking.authority(blob).alias("authority"))


# Written out once more for the SQL.
_NOW = r"(?i)\b(supersed(?:es|ed|ing)?|current\s+policy|updated\s+policy|goes\s+live|effective\s+20|the\s+newest\s+version|revised\s+policy|now\s+provides|company-?wide\s+policy)\b"
_PAST = r"(?i)\b(draft\s+note|earlier\s+note|an\s+older\s+version|old\s+policy|superseded\s+by|obsolete|mistaken|wrongly|pilot\s+only|suggested)\b"


@query(f"""SELECT doc_id AS doc, CAST(round(CASE WHEN text = '' THEN 0.5 ELSE least(1.0, greatest(0.0, 0.5 + 0.12 * len(regexp_extract_all(t, '{_NOW}')) - 0.15 * len(regexp_extract_all(t, '{_PAST}')))) END, 6) AS DOUBLE) AS currency
  FROM (SELECT doc_id, text, CASE WHEN strlen(text) <= 2500 THEN text ELSE list_aggregate(list_transform(list_filter(generate_series(1, length(text)), lambda i: i <= 2500), lambda i: CASE WHEN i <= 2500 AND strlen(left(text, i)) <= 2500 THEN text[i] ELSE '' END), 'string_agg', '') END AS t FROM documents WHERE text IS NOT NULL)""")
def currency_score(spark, sf):
    return _docs(spark, sf).select(F.col("doc_id").alias("doc"), F.round(ranking.currency(F.col("text")), 6).alias("currency"))


@query(f"""{_BM25}, u AS (SELECT doc_id AS doc, CASE WHEN kind = 'code' THEN 1.5 WHEN kind = 'chat' THEN 0.5 END AS utility FROM documents)
  SELECT doc, round(score * coalesce(utility, 1.0), 6) AS score FROM bm LEFT JOIN u USING (doc)""")
def utility_weighted(spark, sf):
    docs = _docs(spark, sf)
    utility = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.when(F.col("kind") == "code", 1.5).when(F.col("kind") == "chat", 0.5).alias("utility")).where("utility IS NOT NULL")
    scored = ranking.bm25(docs, "doc_id", T.index_tokens("text"), TERMS)
    return ranking.utility_weighted(scored, utility).select("doc", F.round("score", 6).alias("score"))


@query(f"""{_BM25}, pr AS (SELECT doc_id AS doc, n_chars AS prior FROM documents WHERE n_chars IS NOT NULL), sp AS (SELECT min(prior) AS lo, max(prior) AS hi FROM pr)
  SELECT doc, round(score * (1 + 0.15 * coalesce((prior - lo) / (hi - lo), 0)), 6) AS score FROM bm LEFT JOIN pr USING (doc), sp""")
def prior_weighted(spark, sf):
    docs = table(spark, sf, "documents")
    prior = docs.where(F.col("n_chars").isNotNull()).select(F.col("doc_id").alias("doc"), F.col("n_chars").cast("double").alias("prior"))
    scored = ranking.bm25(_docs(spark, sf), "doc_id", T.index_tokens("text"), TERMS)
    return ranking.min_max_prior(scored, prior).select("doc", F.round("score", 6).alias("score"))


@query(f"""WITH d AS (SELECT doc_id AS doc, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) >= 4 AND t NOT IN ({", ".join(f"'{w}'" for w in T.QUERY_STOP_WORDS)})) AS ts FROM documents WHERE text IS NOT NULL),
  q AS (SELECT list_distinct(ts) AS ts, doc FROM d)
  SELECT doc, len(ts) AS n_content, round(len(list_filter([{_IN}], lambda t: NOT list_contains(ts, t))) / {len(TERMS)}, 6) AS gap FROM q""")
def coverage_gap(spark, sf):
    q = F.array(*[F.lit(t) for t in TERMS])
    ts = T.content_tokens("text")
    return _docs(spark, sf).select(F.col("doc_id").alias("doc"), F.size(ts).alias("n_content"), F.round(F.size(F.array_except(q, ts)) / len(TERMS), 6).alias("gap"))


@query(f"""WITH s AS (SELECT doc_id AS doc, unnest(list_slice(list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]'), lambda x: trim(x, ' ')), lambda x: strlen(x) >= 12 AND regexp_matches(x, '[0-9]|[A-Za-z]+_[A-Za-z]+|[a-z]+[A-Z]')), 1, 5)) AS fact
    FROM documents WHERE text IS NOT NULL)
  SELECT doc, count(*) AS facts, CAST(sum(len(list_filter([{_IN}], lambda t: contains(lower(fact), t)))) AS BIGINT) AS score FROM s GROUP BY doc""")
def fact_search(spark, sf):
    s = _docs(spark, sf).select(F.col("doc_id").alias("doc"), F.explode(T.fact_sentences("text")).alias("fact"))
    hits = sum((F.lower("fact").contains(t).cast("int") for t in TERMS), F.lit(0))
    return s.groupBy("doc").agg(F.count("*").alias("facts"), F.sum(hits).alias("score"))


_QUERY_VEC = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


@query(f"""WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
  SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), 6) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]) DESC, vec_id LIMIT 20""")
def dense_exact_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    probe = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("qe"))  # one query vector
    scored = e.crossJoin(F.broadcast(probe)).select("vec_id", V.cosine(F.col("embedding"), F.col("qe")).alias("s"))
    return scored.orderBy(F.desc("s"), "vec_id").limit(20).select("vec_id", F.round("s", 6).alias("similarity"))


@query("SELECT vec_id, label, round(sqrt(list_aggregate(list_transform(embedding::DOUBLE[], lambda x: x * x), 'sum')), 5) AS norm FROM embeddings")
def vector_norms(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.round(V.norm(F.col("embedding")), 5).alias("norm"))


@query()
def coverage_mmr(spark, sf):
    """Greedy diversity order of the pools of two queries; no SQL: each step depends on those before it."""
    docs = _docs(spark, sf)
    pools = None
    for name, terms in (("storage", TERMS[:3]), ("reports", TERMS[3:])):
        s = ranking.top(ranking.bm25(docs, "doc_id", T.index_tokens("text"), terms), 64)
        part = s.join(docs.select(F.col("doc_id").alias("doc"), T.content_tokens("text").alias("tokens")), "doc")
        part = part.select(F.lit(name).alias("query"), "doc", F.col("doc").alias("chunk"), "tokens", F.col("score").alias("relevance"))
        pools = part if pools is None else pools.union(part)
    return ranking.coverage_rerank(pools, 10)


@query(f"""{_BM25} SELECT doc, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9), doc DESC) AS position
  FROM (SELECT doc, score FROM bm ORDER BY round(score, 9) DESC, doc LIMIT 12)""")
def best_last(spark, sf):
    """The best hit comes last, as a prompt wants it."""
    s = ranking.ranked(ranking.bm25(_docs(spark, sf), "doc_id", T.index_tokens("text"), TERMS), 12)
    return s.select("doc", F.round("score", 6).alias("score"), F.row_number().over(Window.orderBy(F.desc("rank"))).cast("long").alias("position"))
