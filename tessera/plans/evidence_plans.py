"""Queries of rerankings, recall, arms, code edges and incremental work, each with SQL that spells out its own constants."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import questions as Q
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import answers, arms, chunking, claims, code, dense, evidence, graph, metrics, privacy, ranking, relations, work
from tessera.plans.knowledge import _CLAIM_SQL, _EV, _RARE, _SYMBOLS, _event_claims, _rare_edges, symbols
from tessera.plans.registry import query
from tessera.plans.retrieval import TERMS
from tessera.runtime import shared_dir, table
from tessera.sources import readers

_IN = ", ".join(f"'{t}'" for t in TERMS)


def _docs(spark, sf):
    return table(spark, sf, "documents").where(F.col("text").isNotNull())


# ---- pools and rerankings ------------------------------------------------------------------------

_POOL = rf"""s AS (SELECT kind AS query, CAST(doc_id AS VARCHAR) AS item, coalesce(source, 'none') AS source, text, len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda t: t IN ({_IN}))) / 10.0::DOUBLE AS score FROM documents WHERE text IS NOT NULL),
  pool AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) - 1 AS orig FROM s)"""


def _pool(spark, sf):
    hits = F.size(F.filter(T.unicode_tokens("text"), lambda t: t.isin(*TERMS)))
    s = _docs(spark, sf).select(F.col("kind").alias("query"), F.col("doc_id").cast("string").alias("item"), F.coalesce("source", F.lit("none")).alias("source"), "text", (hits / 10).alias("score"))
    return s.withColumn("orig", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item")) - 1)


def _clip(t: str, n: int) -> str:
    """The whole characters of the first n bytes."""
    return f"(CASE WHEN strlen({t}) <= {n} THEN {t} ELSE list_aggregate(list_transform(generate_series(1, {n}), lambda i: CASE WHEN strlen(left({t}, i)) <= {n} THEN {t}[i] ELSE '' END), 'string_agg', '') END)"


_ISO = r"\b20\d{2}-\d{2}-\d{2}\b"
_DAY = rf"""coalesce(try_cast(nullif(regexp_extract(body, '(?i)(?:effective|updated|goes live|published)[^\d]{{0,24}}(20\d{{2}}-\d{{2}}-\d{{2}})', 1), '') AS DATE), try_cast(nullif(regexp_extract(head, '{_ISO}'), '') AS DATE),
    list_max(list_transform(regexp_extract_all(body, '{_ISO}'), lambda d: try_cast(d AS DATE))), try_cast(list_max(regexp_extract_all(body, '\b(20[12]\d)\b', 1)) || '-01-01' AS DATE))"""


@query(f"SELECT doc, {_DAY} AS day FROM (SELECT doc_id AS doc, {_clip('text', 4000)} AS body, {_clip('text', 800)} AS head FROM documents WHERE text IS NOT NULL)")
def document_dates(spark, sf):
    return _docs(spark, sf).select(F.col("doc_id").alias("doc"), answers.document_date(F.col("text")).alias("day"))


_SIGNALS = rf"""{_POOL}, x AS (SELECT *, {_clip('text', 4000)} AS body, {_clip('text', 800)} AS head, {_clip('text', 2500)} AS t25, lower(item || ' ' || source || ' ' || left(text, 500)) AS b FROM pool),
  y AS (SELECT *, {_DAY} AS day, CASE WHEN score <= 0 OR score > 1 THEN 1 / (orig + 1.0::DOUBLE) ELSE score END AS base,
    CASE WHEN contains(b, 'confluence') THEN 1.0 WHEN contains(b, 'notion') THEN 0.95 WHEN contains(b, 'google_drive') OR contains(b, 'gdrive') THEN 0.9 WHEN regexp_matches(b, 'github|policy|handbook|effective ') THEN 0.85 WHEN contains(b, 'linear') OR contains(b, 'jira') THEN 0.8 WHEN contains(b, 'slack') THEN 0.55 ELSE 0.5 END AS auth,
    CASE WHEN text = '' THEN 0.5 ELSE least(1.0, greatest(0.0, 0.5 + 0.12 * len(regexp_extract_all(t25, '(?i)\b(supersed(?:es|ed|ing)?|current\s+policy|updated\s+policy|goes\s+live|effective\s+20|the\s+newest\s+version|revised\s+policy|now\s+provides|company-?wide\s+policy)\b'))
      - 0.15 * len(regexp_extract_all(t25, '(?i)\b(draft\s+note|earlier\s+note|an\s+older\s+version|old\s+policy|superseded\s+by|obsolete|mistaken|wrongly|pilot\s+only|suggested)\b')))) END AS cur FROM x)"""


@query(f"""WITH {_SIGNALS} SELECT query, item, CAST(row_number() OVER (PARTITION BY query ORDER BY day IS NOT NULL DESC, day DESC NULLS LAST, CASE WHEN day IS NOT NULL THEN round(cur, 9) ELSE round(0.5 * cur + 0.35 * auth + 0.15 * base, 9) END DESC,
  CASE WHEN day IS NOT NULL THEN auth END DESC NULLS LAST, CASE WHEN day IS NOT NULL THEN round(base, 9) END DESC NULLS LAST, orig) AS INT) AS place FROM y""")
def authority_recency_conflict(spark, sf):
    return answers.authority_recency(_pool(spark, sf), "conflict")


@query(f"""WITH {_SIGNALS}, z AS (SELECT *, min((day IS NOT NULL)::INT) OVER (PARTITION BY query) AS all_dated FROM y)
  SELECT query, item, CAST(row_number() OVER (PARTITION BY query ORDER BY CASE WHEN all_dated = 1 THEN day END DESC NULLS LAST, round(0.3 * cur + 0.25 * auth + 0.45 * base, 9) DESC, orig) AS INT) AS place FROM z""")
def authority_recency_other(spark, sf):
    return answers.authority_recency(_pool(spark, sf), "other")


_LABELLED = r"'\b[a-z][a-z0-9._/-]{1,31}\s+tenant\b|\btenant\s*(?:[:=]\s*|\bis\s+)[a-z][a-z0-9._/-]{1,31}\b'"


@query(rf"""WITH {_POOL}, b AS (SELECT *, lower(item || ' ' || source || ' ' || text) AS blob FROM pool WHERE orig < 64),
  m AS (SELECT *, regexp_matches(blob, '(^|[^a-z0-9])staging([^a-z0-9]|$)')::INT AS matches, (NOT regexp_matches(blob, '(^|[^a-z0-9])staging([^a-z0-9]|$)') AND regexp_matches(blob, {_LABELLED}))::INT AS conflicts FROM b)
  SELECT query, item, CAST(row_number() OVER (PARTITION BY query ORDER BY matches DESC, conflicts, orig) AS INT) AS place, matches, conflicts FROM m""")
def rerank_constrained(spark, sf):
    return answers.rerank_constrained(_pool(spark, sf), "How are snapshots retired for the staging tenant?")


@query(f"""WITH {_POOL}, h AS (SELECT *, contains(lower(item || ' ' || source || ' ' || text), 'snapshot')::INT + contains(lower(item || ' ' || source || ' ' || text), 'cursor')::INT AS hits FROM pool WHERE orig < 64),
  t AS (SELECT *, first_value(source) OVER (PARTITION BY query ORDER BY hits DESC, orig) AS target FROM h) SELECT query, item, CAST(row_number() OVER (PARTITION BY query ORDER BY hits DESC, source = target DESC, orig) AS INT) AS place FROM t""")
def rerank_intra(spark, sf):
    return answers.rerank_intra(_pool(spark, sf), "What follows the snapshot in this cursor?", ["snapshot", "cursor"])


_HEADS = rf"""{_POOL}, h AS (SELECT query, item, orig, trim(left(lower(regexp_replace({_clip('text', 1120)}, '\s+', ' ', 'g')), 280), ' ') AS head FROM pool WHERE orig < 64),
  w AS (SELECT *, len(string_split(head, ' ')) AS n, list_distinct(list_filter(string_split(head, ' '), lambda t: strlen(t) >= 4)) AS words FROM h WHERE head <> ''),
  near AS (SELECT a.query, a.item AS a, b.item AS b FROM w a JOIN w b ON a.query = b.query AND a.orig < b.orig WHERE a.head = b.head OR (a.n >= 8 AND b.n >= 8 AND len(list_distinct(list_concat(a.words, b.words))) > 0
    AND len(list_intersect(a.words, b.words)) >= 0.55 * len(list_distinct(list_concat(a.words, b.words)))))"""


@query(f"WITH {_HEADS} SELECT query, a, b FROM near")
def similar_heads(spark, sf):
    return answers.similar_heads(_pool(spark, sf))


@query()
def supersession_heads(spark, sf):
    """Who leads each group of similar heads; no SQL: the groups are greedy. Tested on hand-made pools."""
    return answers.supersede(_pool(spark, sf))


@query()
def rerank_conflicting(spark, sf):
    """Rival versions side by side in front; no SQL: the groups are greedy. Tested on hand-made pools."""
    return answers.rerank_conflicting(_pool(spark, sf))


_TWO = f"""{_POOL}, l0 AS (SELECT query, item, score FROM pool WHERE orig < 20), l1 AS (SELECT query, item, length(text) / 1000.0::DOUBLE AS score FROM pool WHERE contains(lower(text), 'snapshot'))"""


def _two(spark, sf):
    p = _pool(spark, sf)
    return p.where("orig < 20").select("query", "item", "score"), p.where(F.lower("text").contains("snapshot")).select("query", "item", (F.length("text") / 1000).alias("score"))


@query(f"""WITH {_TWO}, u AS (SELECT *, 0 AS list FROM l0 UNION ALL SELECT *, 1 FROM l1 WHERE (query, item) NOT IN (SELECT (query, item) FROM l0))
  SELECT query, item, round(score, 6) AS score, list FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY list, score DESC, item) AS n FROM u) WHERE n <= 30""")
def passage_merge(spark, sf):
    return answers.merge_passages(_two(spark, sf), 30).select("query", "item", F.round("score", 6).alias("score"), "list")


@query(f"""WITH {_TWO}, u AS (SELECT query, item, max(score) * CASE WHEN count(*) = 2 THEN 1.15 ELSE 1 END AS score FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1) GROUP BY ALL)
  SELECT query, item, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS n FROM u) WHERE n <= 30""")
def structure_merge(spark, sf):
    return answers.merge_structure(*_two(spark, sf), 30).select("query", "item", F.round("score", 6).alias("score"))


@query(f"""WITH {_POOL}, pr AS (SELECT DISTINCT query, source FROM pool WHERE CAST(item AS BIGINT) % 50 = 0), k AS (SELECT pool.*, pr.source IS NOT NULL AS keep FROM pool LEFT JOIN pr ON pr.query = pool.query AND pr.source = pool.source),
  d AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY score DESC, orig) AS d FROM k), w AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY keep DESC, score DESC, orig) AS n FROM d WHERE d <= 6), t AS (SELECT * FROM w WHERE n <= 24),
  g AS (SELECT query, count(DISTINCT source) AS held FROM t WHERE keep GROUP BY query)
  SELECT t.query, item, CAST(n AS INT) AS place FROM t LEFT JOIN g ON g.query = t.query WHERE n <= least(24, greatest(8, coalesce(held, 0), CASE WHEN coalesce(held, 0) >= 2 THEN 10 ELSE 8 END))""")
def progressive_window(spark, sf):
    p = _pool(spark, sf)
    return answers.progressive_window(p, 8, 3, p.where(F.col("item").cast("bigint") % 50 == 0))


@query("""WITH r AS (SELECT coalesce(kind, 'none') AS query, source_uri AS path, max(length(text_content)) / 1000.0::DOUBLE AS score FROM product_chunk_metadata WHERE source_uri IS NOT NULL AND text_content IS NOT NULL GROUP BY ALL),
  s AS (SELECT *, row_number() OVER (PARTITION BY query, regexp_replace(list_last(string_split(path, '/')), '\\.[^.]*$', '') ORDER BY score DESC, path) AS n FROM r), g AS (SELECT *, round(0.7 * score - 0.3 * (n - 1), 9) AS gain FROM s)
  SELECT query, path, CAST(row_number() OVER (PARTITION BY query ORDER BY gain DESC, path) AS INT) AS place, round(gain, 6) AS gain FROM g""")
def stem_diversity(spark, sf):
    c = table(spark, sf, "product_chunk_metadata").where(F.col("source_uri").isNotNull() & F.col("text_content").isNotNull())
    r = c.groupBy(F.coalesce("kind", F.lit("none")).alias("query"), F.col("source_uri").alias("path")).agg((F.max(F.length("text_content")) / 1000).alias("score"))
    return answers.stem_diversity(r).select("query", "path", "place", F.round("gain", 6).alias("gain"))


@query(rf"""WITH d AS (SELECT doc_id AS doc, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ts FROM documents WHERE text IS NOT NULL)
  SELECT doc, round(0.1 * list_sum(list_transform([{_IN}], lambda q: coalesce(list_sum(list_transform(range(1, len(list_filter(ts, lambda t: t = q)) + 1), lambda i: 1.0::DOUBLE / (i * i))), 0))) / 1.64493406685 / {len(TERMS)}, 6) AS score FROM d""")
def fts_rank(spark, sf):
    return _docs(spark, sf).select(F.col("doc_id").alias("doc"), F.round(answers.fts_rank(T.unicode_tokens("text"), TERMS), 6).alias("score"))


@query("""WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = (SELECT max(vec_id) FROM embeddings))
  SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), 6) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]) DESC, vec_id LIMIT 10""")
def bounded_dense_topk(spark, sf):
    """Exact scan that refuses more than ten million vectors."""
    e = answers.bounded(table(spark, sf, "embeddings").select("vec_id", "embedding"), 10_000_000)
    probe = e.orderBy(F.desc("vec_id")).limit(1).select(F.col("embedding").alias("qe"))  # one query vector
    s = e.crossJoin(F.broadcast(probe)).select("vec_id", V.cosine(F.col("embedding"), F.col("qe")).alias("s"))
    return s.orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 6).alias("similarity"))


@query(rf"""WITH p AS (SELECT doc_id AS doc, len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda t: t IN ({_IN}))) AS cheap, text FROM documents WHERE text IS NOT NULL), c AS (SELECT * FROM p ORDER BY cheap DESC, doc LIMIT 100)
  SELECT doc, CAST(length(text) AS DOUBLE) / 1000 AS score, 'length' AS reranker FROM c""")
def rerank_prefilter(spark, sf):
    """The hundred best by a cheap bound go to a pluggable reranker."""
    cheap = F.size(F.filter(T.unicode_tokens("text"), lambda t: t.isin(*TERMS)))
    pool = ranking.top(_docs(spark, sf).select(F.col("doc_id").alias("doc"), F.lit("q").alias("query"), "text", cheap.cast("double").alias("score")), 100)

    def length(query: pd.Series, text: pd.Series) -> pd.Series:
        return text.str.len() / 1000.0

    return evidence.rerank_with(pool, length, "length").select("doc", "score", "reranker")


# ---- recall, summaries, clips, verdicts ----------------------------------------------------------

_EVENTS = """e AS (SELECT event_id AS id, 'u' || (user_id % 97) AS session, event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS time, CASE event_id % 7 WHEN 0 THEN 'task_start' WHEN 1 THEN 'read' WHEN 2 THEN 'edit' WHEN 3 THEN 'refresh' WHEN 4 THEN 'failure' WHEN 5 THEN 'compaction' ELSE 'completion' END AS kind,
    CASE WHEN event_id % 5 > 0 THEN 'src/' || event_type || '/f' || (event_id % 40) || '.py' END AS path, CASE WHEN event_id % 7 = 1 THEN event_id % 90 END AS start, CASE WHEN event_id % 7 = 1 THEN event_id % 90 + 20 END AS "end",
    'note ' || event_id || ' of ' || event_type AS text, CASE event_id % 4 WHEN 0 THEN 'superseded' WHEN 1 THEN 'live' WHEN 2 THEN 'as_of' END AS freshness FROM events)"""


def _events(spark, sf):
    i = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("task_start", "read", "edit", "refresh", "failure", "compaction", "completion")]), (i % 7 + 1).cast("int"))
    return table(spark, sf, "events").select(
        i.alias("id"), F.concat(F.lit("u"), (F.col("user_id") % 97).cast("string")).alias("session"), i.alias("seq"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("time"), kind.alias("kind"),
        F.when(i % 5 > 0, F.concat(F.lit("src/"), "event_type", F.lit("/f"), (i % 40).cast("string"), F.lit(".py"))).alias("path"), F.when(i % 7 == 1, i % 90).alias("start"), F.when(i % 7 == 1, i % 90 + 20).alias("end"),
        F.concat(F.lit("note "), i.cast("string"), F.lit(" of "), "event_type").alias("text"), F.when(i % 4 == 0, "superseded").when(i % 4 == 1, "live").when(i % 4 == 2, "as_of").alias("freshness"),
    )


@query(f"""WITH {_EVENTS}, r AS (SELECT id, lower(coalesce(path, '')) AS p, lower(text) AS t, CASE WHEN id % 3 = 0 THEN 0.25 ELSE (id % 10) / 10.0 END AS c, path, freshness FROM e),
  s AS (SELECT id, greatest(CASE WHEN contains(p, 'click f7') THEN 0.6 ELSE 0 END, CASE WHEN contains(t, 'click f7') THEN 0.4 ELSE 0 END, 0.3 * (list_contains(regexp_split_to_array('  ' || p || '  ' || t, '[\\s/._\\-]+'), 'click')::INT + list_contains(regexp_split_to_array('  ' || p || '  ' || t, '[\\s/._\\-]+'), 'f7')::INT) / 2) AS relevance,
    CASE WHEN c = 0 THEN 0.25 ELSE c END AS confidence FROM r WHERE path IS NOT NULL AND freshness IS DISTINCT FROM 'superseded')
  SELECT id, CAST(relevance AS DOUBLE) AS relevance, CAST(confidence AS DOUBLE) AS confidence FROM s WHERE relevance >= 0.15 AND confidence >= 0.5 ORDER BY relevance DESC, id LIMIT 25""")
def session_recall(spark, sf):
    e = _events(spark, sf).select("id", F.lit(None).cast("string").alias("symbol"), "path", F.lit(None).cast("string").alias("handle"), "text", F.lit("repo").alias("repository"), F.lit(None).cast("string").alias("tree"),
                                  F.when(F.col("id") % 3 == 0, F.lit(0.0)).otherwise(F.col("id") % 10 / 10).alias("confidence"), "freshness")
    return answers.recall(e, "click f7", 25, 0.5, 0.15)


@query(f"""WITH {_EVENTS}, k AS (SELECT session, string_agg(kind || ':' || n, ',' ORDER BY kind) AS counts FROM (SELECT session, kind, count(*) AS n FROM e GROUP BY ALL) GROUP BY session),
  f AS (SELECT session, md5(string_agg(text, '|' ORDER BY seq)) AS failures FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS i FROM e WHERE kind = 'failure') WHERE i <= 64 GROUP BY session)
  SELECT session, min(time) AS first_time, max(time) AS last_time, count(*) AS events, count(DISTINCT CASE WHEN path IS NOT NULL AND start IS NOT NULL THEN (path, start, "end") END) AS ranges_read, count(DISTINCT CASE WHEN kind IN ('edit', 'refresh') THEN path END) AS files_changed,
    bool_or(kind = 'task_start') AS started, bool_or(kind = 'completion') AS completed, arg_max(freshness, seq) FILTER (kind <> 'compaction' AND freshness IS NOT NULL) AS last_freshness, any_value(counts) AS counts, coalesce(any_value(f.failures), md5('')) AS failures
  FROM e JOIN k USING (session) LEFT JOIN f USING (session) GROUP BY session""")
def session_summaries(spark, sf):
    s = answers.session_summary(_events(spark, sf))
    counts = F.array_join(F.transform(F.map_entries("counts"), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return s.withColumn("counts", counts).withColumn("failures", F.md5(F.array_join("failures", "|")))


_FACTS = r"(?i)(?:20\d{2}-\d{2}-\d{2}|[$€£]\s?\d[\d,.]*|\b\d+\s+(?:days?|weeks?|months?|years?|hours?)\b|corrected|correction|supersed|no sustained)"


@query(rf"""WITH d AS (SELECT doc_id AS doc, text, regexp_extract_all(substr(text, 561), '(?s)(.{{0,90}}{_FACTS}.{{0,90}})') AS near FROM documents WHERE text IS NOT NULL)
  SELECT doc, md5(CASE WHEN length(text) <= 800 THEN text WHEN len(near) = 0 THEN left(text, 800) ELSE left(left(text, 560) || chr(10) || '…' || chr(10) || array_to_string(list_transform(near, lambda x: trim(x, ' ')), chr(10)), 800) END) AS digest FROM d""")
def passage_clips(spark, sf):
    return _docs(spark, sf).select(F.col("doc_id").alias("doc"), F.md5(answers.clip_passage(F.col("text"), 800)).alias("digest"))


@query(r"""WITH c AS (SELECT item_id AS answer, unnest(regexp_split_to_array(text, '[.?!]\s+')) AS claim, item_id FROM benchmark WHERE text IS NOT NULL), e AS (SELECT doc_id AS doc, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS support FROM documents WHERE text IS NOT NULL),
  t AS (SELECT answer, list_distinct(regexp_extract_all(lower(claim), '[\p{L}\p{N}]+')) AS ts, answer % 997 AS doc FROM c), j AS (SELECT t.*, support, CASE WHEN len(ts) = 0 THEN 0 ELSE floor(1000 * len(list_intersect(ts, support)) / len(ts)) END AS pm FROM t LEFT JOIN e USING (doc)),
  n AS (SELECT answer, count(*) AS claims, count(*) FILTER (support IS NOT NULL AND pm >= 200) AS supported, count(*) FILTER (support IS NULL) AS illegal FROM j GROUP BY answer)
  SELECT *, CASE WHEN supported = claims AND illegal = 0 THEN 'supported' WHEN supported = 0 THEN 'insufficient_context' ELSE 'unsupported' END AS outcome FROM n""")
def faithfulness_verdicts(spark, sf):
    b = table(spark, sf, "benchmark").where(F.col("text").isNotNull()).select(F.col("item_id").alias("answer"), F.posexplode(F.split("text", r"[.?!]\s+")).alias("claim", "said"))
    c = b.select("answer", "claim", (F.col("answer") % 997).alias("doc"), T.unicode_tokens("said").alias("tokens"))
    e = _docs(spark, sf).select(F.col("doc_id").alias("doc"), F.array_distinct(T.unicode_tokens("text")).alias("tokens"))
    cited = c.select("answer", "doc").distinct().join(e, "doc")
    return answers.faithfulness(c, cited, 200)


# ---- arms ----------------------------------------------------------------------------------------

_CLAIMS = f"c AS ({_CLAIM_SQL})"


def _claims(spark, sf):
    return claims.extract_claims(table(spark, sf, "documents"), "doc_id", "text")


def _names(spark, sf) -> list[str]:
    """Three subjects of claims, in order: the query's tokens."""
    return [r[0] for r in _claims(spark, sf).select("subject").distinct().orderBy("subject").limit(3).collect()]


_NAMES = "names AS (SELECT DISTINCT subject AS s FROM c ORDER BY subject LIMIT 3)"


@query(f"WITH {_CLAIMS}, {_NAMES} SELECT DISTINCT doc FROM c WHERE subject IN (SELECT s FROM names)")
def entity_arm(spark, sf):
    return arms.entity_documents(_claims(spark, sf).select(F.col("subject").alias("entity"), "doc"), _names(spark, sf))


@query(f"WITH {_CLAIMS} SELECT DISTINCT doc FROM c WHERE subject IN (SELECT subject FROM c WHERE predicate = 'prefers')")
def fact_arm(spark, sf):
    c = _claims(spark, sf)
    return arms.fact_documents(c.select("subject", F.col("predicate").alias("attribute")), c.select(F.col("subject").alias("entity"), "doc"), ["prefers"])


_SEEDS = "seeds AS (SELECT DISTINCT doc FROM c ORDER BY doc LIMIT 12)"


@query(f"""WITH {_CLAIMS}, {_SEEDS}, ends AS (SELECT subject AS e FROM c WHERE doc IN (SELECT doc FROM seeds) UNION SELECT object FROM c WHERE doc IN (SELECT doc FROM seeds))
  SELECT DISTINCT doc FROM c WHERE (subject IN (SELECT e FROM ends) OR object IN (SELECT e FROM ends)) AND doc NOT IN (SELECT doc FROM seeds)""")
def relationship_arm(spark, sf):
    c = _claims(spark, sf)
    return arms.relationship_documents(c.select(F.col("subject").alias("src"), F.col("object").alias("dst"), "doc"), c.select("doc").distinct().orderBy("doc").limit(12))


@query(f"""WITH {_EV} SELECT DISTINCT id AS doc FROM ev WHERE (subject IN ('1', '2', '3') OR object IN ('1', '2', '3')) AND status = 'active' AND valid_from <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR TIMESTAMP '2024-01-15' <= valid_to) AND observed_at <= TIMESTAMP '2024-01-16' AND (expired_at IS NULL OR TIMESTAMP '2024-01-16' < expired_at)""")
def relation_documents(spark, sf):
    seeds = spark.createDataFrame([("1",), ("2",), ("3",)], "entity string")
    day = lambda d: F.lit(d).cast("timestamp")
    return arms.relation_documents(_event_claims(spark, sf), seeds, day("2024-01-15"), day("2024-01-16"))


@query(f"""WITH {_EV}, c AS (SELECT id, lower(subject) AS src, lower(predicate) AS rel, lower(object) AS dst, quality FROM ev WHERE status = 'active'), old AS (SELECT * FROM c WHERE id % 6 = 0),
  n AS (SELECT * FROM c WHERE id NOT IN (SELECT id FROM old) AND (src, rel, dst) NOT IN (SELECT (src, rel, dst) FROM old)) SELECT min(id) AS claim, src, rel, dst, arg_min(quality, id) AS quality, 1.0::DOUBLE AS weight FROM n GROUP BY src, rel, dst""")
def relations_from_claims(spark, sf):
    c = _event_claims(spark, sf)
    old = c.where("status = 'active' AND id % 6 = 0").select(F.col("id").alias("claim"), F.col("subject").alias("src"), F.col("predicate").alias("rel"), F.col("object").alias("dst"))
    return arms.relations_from_claims(c, old)


@query(f"""WITH {_CLAIMS}, l AS (SELECT DISTINCT predicate || ':' || subject || ':' || object AS claim, subject, doc FROM c),
  p AS (SELECT a.doc AS src, b.doc AS dst, 1.2 AS w FROM l a JOIN l b ON a.claim = b.claim AND a.doc < b.doc UNION ALL SELECT a.doc, b.doc, 1.0 FROM l a JOIN l b ON a.subject = b.subject AND a.doc < b.doc)
  SELECT src, dst, CAST(max(w) AS DOUBLE) AS weight FROM p GROUP BY src, dst ORDER BY src, dst LIMIT 64""")
def claim_document_links(spark, sf):
    c = _claims(spark, sf)
    return arms.claim_document_links(c.select(F.concat_ws(":", "predicate", "subject", "object").alias("claim"), "subject", "doc").distinct())


@query(f"""WITH {_EV} SELECT subject, predicate, count(DISTINCT object) AS objects, count(*) AS claims FROM ev GROUP BY ALL HAVING count(DISTINCT object) >= 2""")
def contested_cliques(spark, sf):
    return claims.contested(_event_claims(spark, sf))


_MENTIONED = r"list_filter(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_.\-]+'), lambda t: strlen(t) >= 3 AND regexp_matches(t, '\p{{N}}|[._\-]|\p{{Ll}}\p{{Lu}}'))"


@query(rf"""WITH d AS (SELECT doc_id AS doc, {_clip('text', 4000)} AS t FROM documents WHERE text IS NOT NULL), f AS (SELECT *, {_clip("string_split(t, chr(10))[1]", 200)} AS first, {_clip('t', 2000)} AS body FROM d),
  k AS (SELECT doc, 'cites' AS kind, unnest(list_distinct(list_concat(list_transform(regexp_extract_all(t, '(?i)\b(?:dsid_|doc[_-]?)[A-Za-z0-9_./-]{{6,}}\b'), lambda x: lower(x)), list_concat(list_transform(regexp_extract_all(t, '\b([A-Z]{{2,10}}-\d{{2,7}})\b', 1), lambda x: upper(x)), [CAST(doc AS VARCHAR)])))) AS term FROM f
    UNION ALL SELECT doc, 'same_thread', unnest(list_distinct(list_transform(regexp_extract_all(t, '(?i)\b(?:thread|conversation|channel)[:\s#]*([A-Za-z0-9_./-]{{6,}})\b', 1), lambda x: lower(x)))) FROM f
    UNION ALL SELECT doc, 'co_project', unnest(list_distinct(list_transform(list_concat(list_filter(regexp_extract_all(first, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){{1,3}})\b', 1), lambda x: length(x) >= 6), list_filter(regexp_extract_all(body, '\b([A-Z]{{3,}}(?:[_\s-][A-Z0-9]{{2,}}){{0,3}})\b', 1), lambda x: length(trim(x)) BETWEEN 3 AND 40)), lambda x: lower(trim(x, ' '))))) FROM f
    UNION ALL SELECT doc, 'mentions', unnest(list_distinct(list_filter(list_transform({_MENTIONED.format('body')}, lambda x: lower(x)), lambda x: strlen(x) >= 4))) FROM f)
  SELECT doc, kind, term FROM k""")
def typed_terms(spark, sf):
    return arms.typed_terms(table(spark, sf, "documents"), "doc_id", "text", body=4_000)


@query(rf"""SELECT doc_id AS doc, list_slice(list_transform(list_filter(list_transform(range(1, len(ts) + 1), lambda i: [CAST(i AS VARCHAR), ts[i]]), lambda x: list_position(ts, x[2]) = CAST(x[1] AS BIGINT)), lambda x: x[2]), 1, 12) AS tokens
  FROM (SELECT doc_id, list_transform({_MENTIONED.format('text')}, lambda x: lower(x)) AS ts FROM documents WHERE text IS NOT NULL)""")
def structure_tokens(spark, sf):
    return _docs(spark, sf).select(F.col("doc_id").alias("doc"), arms.structure_tokens(F.col("text")).alias("tokens"))


@query(f"""WITH n AS (SELECT DISTINCT 'phrase:' || lower(title) AS node FROM documents WHERE title IS NOT NULL), s AS (SELECT node, {" + ".join(f"contains(substr(node, 8), '{t}')::INT" for t in TERMS)} AS score FROM n) SELECT node, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0""")
def phrase_seeds(spark, sf):
    d = table(spark, sf, "documents").where(F.col("title").isNotNull())
    node = F.concat(F.lit("phrase:"), F.lower("title"))
    return arms.phrase_seeds(d.select(node.alias("src"), F.col("doc_id").cast("string").alias("dst")), TERMS)


_COMMUNITY = f"""{_RARE}, b AS (SELECT DISTINCT src, dst FROM ed UNION SELECT dst, src FROM ed), reach(node, seen) AS (SELECT src, src FROM b UNION SELECT b.dst, reach.seen FROM reach JOIN b ON b.src = reach.node),
  comp AS (SELECT node, min(seen) AS c FROM reach GROUP BY node), own AS (SELECT doc_id AS doc, text, coalesce(c, doc_id) AS c FROM documents LEFT JOIN comp ON node = doc_id WHERE text IS NOT NULL),
  size AS (SELECT c, count(*) AS docs, row_number() OVER (ORDER BY count(*) DESC, c) - 1 AS community FROM own GROUP BY c ORDER BY docs DESC, c LIMIT 8),
  pick AS (SELECT community, docs, '[' || doc || '] ' || trim({_clip('text', 80)}, ' ') || '; ' AS line, row_number() OVER (PARTITION BY c ORDER BY doc) AS i FROM own JOIN size USING (c) WHERE docs > 1 OR community < 2),
  summary AS (SELECT community, docs, 'Community ' || community || ' (' || docs || ' docs): ' || string_agg(line, '' ORDER BY i) || CASE WHEN docs > 3 THEN '…' ELSE '' END AS text FROM pick WHERE i <= 3 GROUP BY community, docs)"""


@query(f"WITH RECURSIVE {_COMMUNITY} SELECT CAST(community AS INT) AS community, docs, text FROM summary")
def community_summaries(spark, sf):
    return arms.community_summaries(_docs(spark, sf).select(F.col("doc_id").alias("doc"), "text"), _rare_edges(spark, sf))


_HITS = " + ".join(f"contains(lower(text), '{t}')::INT" for t in TERMS)


@query(f"""WITH RECURSIVE {_COMMUNITY}, m AS (SELECT *, {_HITS} AS n FROM summary), g AS (SELECT community, text, CASE WHEN n = 0 THEN 0.1 ELSE n + 0.05 * floor(strlen(text) / 200) END AS score FROM m), best AS (SELECT * FROM g ORDER BY score DESC, community LIMIT 6)
  SELECT 'map-' || community AS id, 'map' AS kind, CAST(round(score, 6) AS DOUBLE) AS score, text FROM best UNION ALL SELECT 'reduce', 'reduce', NULL, 'reduce over ' || count(*) || ' communities: ' || string_agg({_clip('text', 240)}, ' | ' ORDER BY score DESC, community) FROM best""")
def map_reduce_answer(spark, sf):
    s = arms.community_summaries(_docs(spark, sf).select(F.col("doc_id").alias("doc"), "text"), _rare_edges(spark, sf))
    return arms.map_reduce_answer(s, TERMS)


# ---- code ----------------------------------------------------------------------------------------

_LINES = r"""files AS (SELECT CAST(doc_id AS VARCHAR) AS path, string_split(text, chr(10)) AS ls FROM documents WHERE kind = 'code' AND text IS NOT NULL),
  lines AS (SELECT path, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS code FROM files), src AS (SELECT * FROM lines WHERE NOT regexp_matches(code, '^\s*(?://|#|/?\*|--)') OR regexp_matches(code, '^\s*#include'))"""
_DEFINES = r"^\s*(?:export\s+|default\s+|pub(?:\([a-z]+\))?\s+|public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+|async\s+)*(?:def|class|func(?:\s+\([^)]*\))?|function|fn|type|interface|struct|enum|trait|impl|record|const|let)\s+([A-Za-z_]\w{2,})"
_IMPORTS = r"""^\s*(?:import|from|use|require|#include)\s+["''<({]*\s*([\w./:@\-]{3,})"""
_STOP = ", ".join(f"'{w}'" for w in "import from use as package export require include type const static pub crate super self mod extern with select default".split())
_NO_CALL = ", ".join(f"'{w}'" for w in "if for while switch return catch def func function class and not with elif print".split())
_OCC = rf"""{_LINES}, a AS (SELECT path, line, code, list_filter([regexp_extract(code, '{_DEFINES}', 1)], lambda x: x <> '') AS d, list_filter([regexp_extract(code, '{_IMPORTS}', 1)], lambda x: x <> '' AND lower(x) NOT IN ({_STOP})) AS i,
    list_distinct(regexp_extract_all(code, '(?:\bextends\s+|\bimplements\s+|^\s*class\s+\w+\s*\(\s*)([A-Za-z_]\w{{2,}})', 1)) AS h, regexp_matches(code, '^\s*(?:import|from|use|require|#include)\s') AS is_import FROM src),
  b AS (SELECT *, list_filter(list_distinct(regexp_extract_all(code, '\b([A-Za-z_]\w{{2,}})\s*\(', 1)), lambda x: x NOT IN ({_NO_CALL}) AND NOT list_contains(d, x) AND NOT list_contains(h, x)) AS c FROM a),
  r AS (SELECT *, CASE WHEN is_import THEN [] ELSE list_filter(list_distinct(regexp_extract_all(code, '\b([A-Za-z_]\w{{2,}})\b', 1)), lambda x: NOT list_contains(d, x) AND NOT list_contains(c, x) AND NOT list_contains(h, x)) END AS n FROM b),
  occ AS (SELECT path, line, kind, name, instr(code, name) AS "at" FROM (SELECT path, line, code, 'definition' AS kind, unnest(d) AS name FROM r UNION ALL SELECT path, line, code, 'import', unnest(i) FROM r UNION ALL SELECT path, line, code, 'inheritance', unnest(h) FROM r
    UNION ALL SELECT path, line, code, 'call', unnest(c) FROM r UNION ALL SELECT path, line, code, 'reference', unnest(n) FROM r))"""
_EDGES = f"""{_OCC}, e0 AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'definition' THEN name END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line, CASE WHEN kind = 'definition' THEN 0 ELSE 1 END, "at", name ROWS UNBOUNDED PRECEDING), '<file>') AS inside, row_number() OVER (PARTITION BY path ORDER BY line, "at", kind, name) AS position FROM occ),
  edges AS (SELECT path AS file, line, position, CASE WHEN kind = 'definition' THEN '<file>' ELSE inside END AS "from", name AS "to", kind, CASE WHEN kind = 'reference' THEN 'lexical' ELSE 'heuristic' END AS authority,
    CAST(CASE kind WHEN 'definition' THEN 0.9 WHEN 'call' THEN 0.7 WHEN 'inheritance' THEN 0.7 WHEN 'import' THEN 0.6 ELSE 0.4 END AS DOUBLE) AS confidence FROM e0 WHERE position <= 512)"""


def _files(spark, sf):
    return _docs(spark, sf).where("kind = 'code'").select(F.col("doc_id").cast("string").alias("path"), "text")


@query(f"""WITH {_OCC} SELECT path, CAST(line AS INT) AS line, kind, name, CAST("at" AS INT) AS "at" FROM occ""")
def code_occurrences(spark, sf):
    return code.occurrences(_files(spark, sf), "path", "text")


@query(f"""WITH {_EDGES} SELECT file, CAST(line AS INT) AS line, CAST(position AS INT) AS position, "from", "to", kind, authority, confidence FROM edges""")
def typed_edges(spark, sf):
    return code.typed_edges(_files(spark, sf), "path", "text")


_BUSY = """busy AS (SELECT "to" AS s FROM edges WHERE kind = 'call' GROUP BY "to" ORDER BY count(*) DESC, "to" LIMIT 1)"""


def _busy(edges) -> str:
    row = edges.where("kind = 'call'").groupBy("to").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "to").first()
    return row["to"] if row else ""


@query(f"""WITH {_EDGES}, {_BUSY} SELECT file, CAST(position AS INT) AS position, "from", "to", kind FROM edges, busy WHERE kind IN ('call', 'reference', 'lexical') AND "to" = s AND "from" <> s ORDER BY file, position LIMIT 24""")
def callers(spark, sf):
    e = code.typed_edges(_files(spark, sf), "path", "text")
    return relations.callers(e, _busy(e), 24).select("file", "position", "from", "to", "kind")


@query(f"""WITH {_EDGES}, most AS (SELECT "from" AS s FROM edges WHERE kind = 'call' AND "from" <> '<file>' GROUP BY "from" ORDER BY count(*) DESC, "from" LIMIT 1)
  SELECT file, CAST(position AS INT) AS position, "from", "to", kind FROM edges, most WHERE kind IN ('call', 'reference', 'lexical') AND "from" = s AND "to" <> s ORDER BY file, position LIMIT 24""")
def callees(spark, sf):
    e = code.typed_edges(_files(spark, sf), "path", "text")
    row = e.where("kind = 'call' AND from <> '<file>'").groupBy("from").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "from").first()
    return relations.callees(e, row["from"] if row else "", 24).select("file", "position", "from", "to", "kind")


@query(f"""WITH {_EDGES} SELECT file, CAST(line AS INT) AS line, "to" FROM edges WHERE kind IN ('call', 'import') AND "to" NOT IN (SELECT "to" FROM edges WHERE kind = 'definition') AND contains(lower("to"), 'snapshot')""")
def import_stem_edges(spark, sf):
    """Edges to what no file defines, by a stem of the target."""
    e = code.typed_edges(_files(spark, sf), "path", "text")
    known = e.where("kind = 'definition'").select("to", F.lit(True).alias("resolved")).distinct()
    out = e.where("kind IN ('call', 'import')").join(known, "to", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    return evidence.import_stem_edges(out, "snapshot").select("file", "line", "to")


def _hop_sql(name: str, seeds: str, found: str) -> str:
    """Up to forty files that share a symbol with the seeds, less what was found."""
    near = f"SELECT path, name, CASE WHEN kind = 'def' THEN 0 ELSE 1 END AS k FROM symbols WHERE name IN (SELECT name FROM symbols WHERE path IN (SELECT path FROM {seeds})) AND path NOT IN (SELECT path FROM {seeds})"
    return f"{name}_n AS (SELECT path FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY name, k) AS n FROM ({near})) WHERE n = 1 ORDER BY name, k, path LIMIT 40), {name} AS (SELECT path FROM {name}_n WHERE path NOT IN (SELECT path FROM {found}))"


@query(f"""WITH {_SYMBOLS}, {_EDGES}, nm AS (SELECT name AS s FROM symbols GROUP BY name ORDER BY count(*) DESC, name LIMIT 1), de AS (SELECT DISTINCT path FROM symbols, nm WHERE kind = 'def' AND lower(name) = lower(s)),
  rf AS (SELECT DISTINCT path FROM symbols, nm WHERE kind = 'ref' AND name IN (s, lower(s)) AND path NOT IN (SELECT path FROM de) ORDER BY path LIMIT 24), f1 AS (SELECT path FROM de UNION SELECT path FROM rf),
  im AS (SELECT file AS path, min(de.path) AS definer FROM edges JOIN de ON contains(lower("to"), lower(de.path)) WHERE kind = 'import' AND file NOT IN (SELECT path FROM f1) GROUP BY file ORDER BY definer, file LIMIT 16), f2 AS (SELECT path FROM f1 UNION SELECT path FROM im),
  c0 AS (SELECT file FROM edges, nm WHERE kind IN ('call', 'reference', 'lexical') AND "to" = s AND "from" <> s ORDER BY file, position LIMIT 24), c1 AS (SELECT file FROM edges, nm WHERE s <> lower(s) AND kind IN ('call', 'reference', 'lexical') AND "to" = lower(s) AND "from" <> lower(s) ORDER BY file, position LIMIT 24),
  ca AS (SELECT file AS path, min(i) AS i FROM (SELECT file, 0 AS i FROM c0 UNION ALL SELECT file, 1 FROM c1) WHERE file NOT IN (SELECT path FROM f2) GROUP BY file ORDER BY i, file LIMIT 24), h0 AS (SELECT path FROM f2 UNION SELECT path FROM ca),
  {_hop_sql('h1', 'h0', 'h0')}, f3 AS (SELECT path FROM h0 UNION SELECT path FROM h1), {_hop_sql('h2', 'h1', 'f3')}, every AS (SELECT path, 0 AS hops FROM h0 UNION ALL SELECT path, 1 FROM h1 UNION ALL SELECT path, 2 FROM h2)
  SELECT path, hops, CASE WHEN (SELECT count(*) FROM every) <= 4 THEN 'low' WHEN (SELECT count(*) FROM every) <= 16 THEN 'medium' ELSE 'high' END AS severity FROM every""")
def impact_closure(spark, sf):
    """Files that a change of the most frequent symbol may touch, to two hops."""
    s, e = symbols(spark, sf), code.typed_edges(_files(spark, sf), "path", "text")
    name = s.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").first()["name"]
    return relations.impact(s, name, imports=e.where("kind = 'import'").select(F.col("file").alias("path"), F.col("to").alias("target")), edges=e)


_STARTS = r"^(?:def |class |function |fn |func |pub fn |export (?:function|const|class|interface|type|default) |type |interface |const |let |struct |impl |enum |async def )"


@query(rf"""WITH {_LINES}, w AS (SELECT path, lower(trim(code, ' ')) AS low, unnest(list_filter(list_distinct(regexp_extract_all(code, '[\p{{L}}\p{{N}}_]+')), lambda x: strlen(x) >= 3)) AS name FROM lines),
  f AS (SELECT path, name, bool_or(regexp_matches(low, '{_STARTS}') OR contains(low, ' implements ')) AS d, bool_or(regexp_matches(low, '^(?:import|from|use) ') AND lower(name) NOT IN ({_STOP})) AS i FROM w GROUP BY ALL)
  SELECT path, name, CASE WHEN d THEN 'def' ELSE 'ref' END AS kind FROM f UNION ALL SELECT path, name, 'import' FROM f WHERE i""")
def heuristic_symbols(spark, sf):
    return code.heuristic_symbols(_files(spark, sf), "path", "text")


@query(f"""WITH {_OCC} SELECT path, 'mixed' AS language, name AS symbol, CASE kind WHEN 'definition' THEN 'definition' WHEN 'import' THEN 'import' ELSE 'reference' END AS kind, CAST(line AS INT) AS line, CAST("at" AS INT) AS "column" FROM occ""")
def symbol_index_import(spark, sf):
    """Occurrences written as symbol-index documents of JSON and decoded again."""
    o = code.occurrences(_files(spark, sf), "path", "text")
    role = F.when(F.col("kind") == "definition", 1).when(F.col("kind") == "import", 2).otherwise(0)
    one = F.struct(F.array(F.col("line").cast("int"), F.col("at").cast("int")).alias("range"), F.col("name").alias("symbol"), role.alias("symbol_roles"))
    doc = F.struct(F.col("path").alias("relative_path"), F.lit("mixed").alias("language"), F.array(one).alias("occurrences"))  # one occurrence a document: nothing is gathered
    return readers.decode_symbol_index(o.select(F.to_json(F.struct(F.array(doc).alias("documents"))).alias("j")), "j")


# ---- incremental work ----------------------------------------------------------------------------

_JOBS = """jobs AS (SELECT event_id AS job, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN 'pending' WHEN event_id % 3 = 1 THEN 'running' ELSE 'done' END AS state, event_id % 5 AS attempts, CAST(value AS BIGINT) % 10 AS priority, ts AS created, CASE WHEN event_id % 3 = 1 THEN ts + INTERVAL 10 DAY END AS lease_until FROM events)"""


def _jobs(spark, sf):
    i, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    state = F.when(i % 3 == 0, "pending").when(i % 3 == 1, "running").otherwise("done")
    return table(spark, sf, "events").select(i.alias("job"), F.col("event_type").alias("kind"), state.alias("state"), (i % 5).alias("attempts"), (F.rint("value").cast("bigint") % 10).alias("priority"), ts.alias("created"), F.when(i % 3 == 1, ts + F.expr("INTERVAL 10 DAY")).alias("lease_until"))


@query(f"""WITH {_JOBS} SELECT job, attempts + 1 AS attempts, epoch_us(TIMESTAMP '2024-01-20' + INTERVAL 300 SECOND) AS until_us FROM jobs WHERE state = 'pending' OR state = 'running' AND lease_until < TIMESTAMP '2024-01-20' ORDER BY priority DESC, created, job LIMIT 200""")
def claimed_jobs(spark, sf):
    got = work.claim_jobs(_jobs(spark, sf), F.lit("2024-01-20").cast("timestamp"), 300, 200)
    return got.select("job", "attempts", F.unix_micros("lease_until").alias("until_us"))


@query(f"WITH {_JOBS} SELECT kind, job, CAST(floor((row_number() OVER (PARTITION BY kind ORDER BY priority DESC, job) - 1) / 50) AS BIGINT) AS wave FROM jobs")
def job_waves(spark, sf):
    return work.waves(_jobs(spark, sf), 50)


@query("""WITH c AS (SELECT 'f' || (event_id % 700) AS path, event_id AS at FROM events) SELECT DISTINCT path, false AS rescan FROM c WHERE (SELECT count(DISTINCT path) FROM c) <= 4096 UNION ALL SELECT NULL, true WHERE (SELECT count(DISTINCT path) FROM c) > 4096""")
def refresh_queue(spark, sf):
    return work.refresh_queue(table(spark, sf, "events").select(F.concat(F.lit("f"), (F.col("event_id") % 700).cast("string")).alias("path"), F.col("event_id").alias("at")))


_SNAP = """snap AS (SELECT 'f' || c_custkey AS path, md5(CAST(c_custkey AS VARCHAR)) AS digest, c_custkey AS k FROM customer), ch AS (SELECT CASE k % 8 WHEN 0 THEN 'modify' WHEN 1 THEN 'delete' ELSE 'rename' END AS op, CASE WHEN k % 8 = 2 THEN 'moved/' || path ELSE path END AS path, CASE WHEN k % 8 = 2 THEN path END AS old_path, CASE WHEN k % 8 = 0 THEN md5(digest) END AS digest FROM snap WHERE k % 8 < 3
    UNION ALL SELECT 'add', 'new/' || path, NULL, digest FROM snap WHERE k % 9 = 0)"""


@query(f"""WITH {_SNAP}, gone AS (SELECT path FROM ch UNION SELECT old_path FROM ch WHERE op = 'rename') SELECT path, digest FROM snap WHERE path NOT IN (SELECT path FROM gone) UNION ALL SELECT ch.path, coalesce(ch.digest, s.digest) FROM ch LEFT JOIN snap s ON s.path = ch.old_path WHERE op <> 'delete'""")
def applied_changes(spark, sf):
    k = F.col("c_custkey")
    snap = table(spark, sf, "customer").select(F.concat(F.lit("f"), k.cast("string")).alias("path"), F.md5(k.cast("string")).alias("digest"), k.alias("k"))
    m = F.col("k") % 8
    ch = snap.where(m < 3).select(
        F.when(m == 0, "modify").when(m == 1, "delete").otherwise("rename").alias("op"), F.when(m == 2, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(m == 2, F.col("path")).alias("old_path"), F.when(m == 0, F.md5("digest")).alias("digest"),
    )
    ch = ch.union(snap.where("k % 9 = 0").select(F.lit("add"), F.concat(F.lit("new/"), "path"), F.lit(None).cast("string"), "digest"))
    return work.apply_changes(snap.select("path", "digest"), ch)


_STORED = """f AS (SELECT CAST(doc_id AS VARCHAR) AS path, md5(text) AS digest, doc_id AS k FROM documents WHERE text IS NOT NULL), st AS (SELECT path, CASE WHEN k % 5 = 0 THEN md5(digest) ELSE digest END AS digest FROM f WHERE k % 3 > 0 UNION ALL SELECT 'old' || path, digest FROM f WHERE k % 50 = 0)"""


def _stored(spark, sf):
    f = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("digest"), F.col("doc_id").alias("k"))
    kept = f.where("k % 3 > 0").select("path", F.when(F.col("k") % 5 == 0, F.md5("digest")).otherwise(F.col("digest")).alias("digest"))
    return f.select("path", "digest"), kept.union(f.where("k % 50 = 0").select(F.concat(F.lit("old"), "path"), "digest"))


@query(f"""WITH {_STORED}, p AS (SELECT path FROM f UNION SELECT path FROM st WHERE starts_with(path, 'old') UNION SELECT 'nowhere') SELECT p.path, CASE WHEN f.digest IS NULL AND st.digest IS NULL THEN 'ignore' WHEN f.digest IS NULL THEN 'remove' WHEN st.digest IS NULL THEN 'add' WHEN f.digest = st.digest THEN 'keep' ELSE 'update' END AS action FROM p LEFT JOIN f USING (path) LEFT JOIN st USING (path)""")
def ingested_paths(spark, sf):
    files, stored = _stored(spark, sf)
    paths = files.select("path").union(stored.where(F.col("path").startswith("old")).select("path")).union(spark.createDataFrame([("nowhere",)], "path string"))
    return work.paths_to_ingest(files, paths, stored)


@query(f"WITH {_STORED} SELECT coalesce(f.path, st.path) AS path, CASE WHEN f.path IS NULL THEN 'delete' ELSE 'upsert' END AS op FROM f FULL JOIN st ON f.path = st.path WHERE f.path IS NULL OR st.path IS NULL OR f.digest <> st.digest")
def continual_changes(spark, sf):
    files, stored = _stored(spark, sf)
    return work.changed_rows(stored, files, "path", "digest")


@query(f"""WITH {_EVENTS} SELECT session, seq, kind, path FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS n FROM e) WHERE n <= 20""")
def event_log(spark, sf):
    """Events appended in two batches with retention, and replayed strictly."""
    at = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    e = _events(spark, sf)
    work.append_events(e.where("seq % 2 = 0"), at)
    work.append_events(e.where("seq % 2 = 1"), at, retain=20)
    return work.replay(spark, at).select("session", "seq", "kind", "path")


@query("""WITH r AS (SELECT event_type AS category, event_id AS step, CAST(value AS BIGINT) AS saved, event_id % 7 AS spent, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events)
  SELECT category, CASE WHEN n <= 30 THEN step END AS step, CAST(sum(saved) AS BIGINT) AS saved, CAST(sum(spent) AS BIGINT) AS spent FROM r GROUP BY ALL""")
def savings_ledger(spark, sf):
    """Steps appended in two batches; a ledger keeps thirty steps a category and adds up the older ones."""
    s = table(spark, sf, "events").select(F.col("event_type").alias("category"), F.col("event_id").alias("step"), F.rint("value").cast("bigint").alias("saved"), (F.col("event_id") % 7).alias("spent"))
    half = table(spark, sf, "events").agg((F.max("event_id") / 2).alias("h"))
    s = s.crossJoin(F.broadcast(half))  # one row
    first = work.roll_up(s.where("false"), s.where("step <= h"), 30)
    return work.roll_up(first, s.where("step > h"), 30)


@query(r"""WITH d AS (SELECT doc_id AS doc, regexp_extract_all(text, '\S+|\s+') AS rs FROM documents WHERE text IS NOT NULL), u AS (SELECT doc, unnest(range(1, len(rs) + 1)) AS i, unnest(rs) AS token FROM d),
  o AS (SELECT doc, i, token, sum(strlen(token)) OVER (PARTITION BY doc ORDER BY i) AS e FROM u) SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY i) - 1 AS INT) AS position, token, CAST(e - strlen(token) AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM o WHERE NOT regexp_matches(token, '^\s')""")
def byte_tokens(spark, sf):
    return work.byte_tokens(_docs(spark, sf), "doc_id", "text")


# ---- measures, spans, small functions -------------------------------------------------------------


@query("""WITH f AS (SELECT DISTINCT source_uri AS path, length(source_uri) * 100 AS size FROM product_chunk_metadata WHERE source_uri IS NOT NULL), e AS (SELECT DISTINCT list_last(string_split(path, '/')) AS suffix FROM f WHERE size % 300 = 0),
  g AS (SELECT path, size FROM f WHERE EXISTS (SELECT 1 FROM e WHERE suffix <> '' AND ends_with(path, suffix))) SELECT CAST((SELECT sum(size) FROM g) AS BIGINT) AS gold_bytes, CAST(sum(size) AS BIGINT) AS tree_bytes, round(1 - (SELECT sum(size) FROM g) / sum(size), 6) AS ratio FROM f""")
def gold_baseline(spark, sf):
    f = table(spark, sf, "product_chunk_metadata").where(F.col("source_uri").isNotNull()).select(F.col("source_uri").alias("path")).distinct().withColumn("size", (F.length("path") * 100).cast("bigint"))
    return metrics.gold_baseline(f, f.where("size % 300 = 0").select(F.substring_index("path", "/", -1).alias("suffix"))).select("gold_bytes", "tree_bytes", F.round("ratio", 6).alias("ratio"))


@query(rf"""WITH r AS (SELECT len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')), [{_IN}])) / {len(TERMS)} AS recall FROM documents WHERE text IS NOT NULL) SELECT count(*) AS probes, round(avg(1 - recall), 6) AS error FROM r""")
def prediction_error(spark, sf):
    want = F.array(*[F.lit(t) for t in TERMS])
    r = _docs(spark, sf).select(metrics.probe_recall(T.unicode_tokens("text"), want).alias("recall"))
    return metrics.prediction_error(r).select("probes", F.round("error", 6).alias("error"))


@query("""WITH q AS (SELECT event_id, CASE WHEN event_id % 4 > 0 THEN event_id % 12 + 1 END AS first_rank, event_id % 6 AS hits, event_id % 11 AS returned, value AS latency FROM events), o AS (SELECT latency, row_number() OVER (ORDER BY latency) - 1 AS i, count(*) OVER () AS n FROM q)
  SELECT count(*) AS queries, avg((coalesce(first_rank, 99) <= 1)::INT)::DOUBLE AS hit_at_1, avg((coalesce(first_rank, 99) <= 5)::INT)::DOUBLE AS hit_at_5, avg((coalesce(first_rank, 99) <= 10)::INT)::DOUBLE AS hit_at_10, round(avg(CASE WHEN returned > 0 THEN hits / returned ELSE 0 END), 6) AS precision,
    round(avg(latency), 6) AS latency, (SELECT max(latency) FROM o WHERE i = floor((n - 1) * 0.95)) AS p95_latency FROM q""")
def qa_aggregates(spark, sf):
    i = F.col("event_id")
    q = table(spark, sf, "events").select(i.alias("query"), F.when(i % 4 > 0, i % 12 + 1).alias("first_rank"), (i % 6).alias("hits"), (i % 11).alias("returned"), F.col("value").alias("latency"))
    return metrics.qa_aggregates(q).withColumn("precision", F.round("precision", 6)).withColumn("latency", F.round("latency", 6))


@query(r"""WITH t AS (SELECT 'email' AS cls, len(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,63}')) AS n FROM product_sidecars WHERE text IS NOT NULL UNION ALL SELECT 'ssn', len(regexp_extract_all(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b')) FROM product_sidecars WHERE text IS NOT NULL)
  SELECT cls, CAST(sum(n) AS BIGINT) AS finds FROM t GROUP BY cls""")
def detected_spans(spark, sf):
    s = table(spark, sf, "product_sidecars")
    key = F.concat_ws("|", "brain_id", "document_id", "kind", "updated_at")
    return privacy.detect(s.withColumn("key", key), "key", "text", classes=["email", "ssn"]).groupBy("cls").agg(F.count("*").alias("finds"))


@query(r"""WITH x AS (SELECT doc_id AS doc, text FROM documents WHERE text IS NOT NULL), p AS (SELECT doc, len(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,63}')) AS n FROM x)
  SELECT CAST(sum(CASE WHEN doc % 4 > 0 THEN n ELSE 0 END) AS BIGINT) AS hit, CAST(sum(n) AS BIGINT) AS predicted, CAST(sum(CASE WHEN doc % 4 > 0 THEN n ELSE 0 END) AS BIGINT) AS expected,
    CASE WHEN sum(n) > 0 THEN sum(CASE WHEN doc % 4 > 0 THEN n ELSE 0 END) / sum(n) ELSE 1.0 END AS precision, 1.0::DOUBLE AS recall FROM p""")
def privacy_evaluation(spark, sf):
    """Detected addresses against an expected set that lacks those of every fourth document."""
    found = privacy.detect(table(spark, sf, "documents"), "doc_id", "text", classes=["email"])
    return privacy.evaluate(found, found.where("doc % 4 > 0"))


_SPANS = """sp AS (SELECT l_orderkey AS doc, l_linenumber * 10 AS start, l_linenumber * 10 + CAST(l_quantity AS INT) AS "end" FROM lineitem)"""


def _spans(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.rint("l_quantity").cast("int")).alias("end"))


@query(f"""WITH {_SPANS}, m AS (SELECT *, max("end") OVER (PARTITION BY doc ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sp WHERE start < "end") SELECT doc, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end" FROM m WHERE before IS NULL OR "end" > before""")
def distinct_spans(spark, sf):
    return relations.drop_contained(_spans(spark, sf))


@query(f"""WITH {_SPANS}, bad AS (SELECT l_orderkey AS doc, 30 AS s, 40 AS e FROM lineitem WHERE l_linenumber = 3) SELECT doc, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end" FROM sp WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.doc = sp.doc AND sp.start < e AND s < sp."end")""")
def clean_citations(spark, sf):
    """Citations no part of which was found to be sensitive."""
    bad = table(spark, sf, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("doc"), F.lit(30).alias("start"), F.lit(40).alias("end"))
    return relations.overlapping(_spans(spark, sf), bad, keep=False)


@query("""SELECT DISTINCT chunk_id FROM product_chunk_metadata WHERE dsid IN (SELECT document_id FROM product_sidecars)""")
def pruned_missing(spark, sf):
    """Chunks of documents that are not in the live set are purged."""
    c = table(spark, sf, "product_chunk_metadata").where(F.col("dsid").isNotNull())
    live = table(spark, sf, "product_sidecars").select(F.col("document_id").alias("dsid")).distinct()
    gone = c.select("dsid").distinct().join(live, "dsid", "left_anti")
    return relations.purge({"chunks": (c, "dsid")}, gone)["chunks"].select("chunk_id").distinct()


_STOPS = ", ".join(f"'{w}'" for w in "a an and are as at be by for from how in is it of on or the to what where which with why".split())


@query(rf"""WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ts FROM benchmark WHERE text IS NOT NULL), k AS (SELECT item_id, ts, list_filter(ts, lambda t: t NOT IN ({_STOPS})) AS kept FROM t)
  SELECT item_id, CAST(len(list_distinct(CASE WHEN len(ts) <= 1 OR len(kept) = 0 THEN ts ELSE kept END)) AS INT) AS terms FROM k""")
def question_terms(spark, sf):
    b = table(spark, sf, "benchmark").where(F.col("text").isNotNull())
    return b.select("item_id", F.size(T.query_term_list("text")).alias("terms"))


@query(r"""SELECT item_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '`[^`]+`|"[^"]{2,60}"|\b[a-z]+(?:_[a-z0-9]+)+\b|\b[a-z]+(?:[A-Z][a-z0-9]+)+\b|\b[\w-]+/[\w./-]+\b|\b[A-Z]{2,}-\d+\b'), lambda x: trim(x, '`"')))) AS names FROM benchmark WHERE text IS NOT NULL""")
def question_identifiers(spark, sf):
    b = table(spark, sf, "benchmark").where(F.col("text").isNotNull())
    return b.select("item_id", F.sort_array(Q.identifier_list(F.col("text"))).alias("names"))


@query()
def question_plans(spark, sf):
    """Variants, parts and plan type of each item; no SQL: ordered rules over single strings, tested one by one."""
    b = table(spark, sf, "benchmark").where(F.col("text").isNotNull())
    return b.select("item_id", Q.question_plan(F.col("text")).alias("p")).select("item_id", "p.*")


@query("""SELECT DISTINCT source_uri, CASE lower(regexp_extract(source_uri, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' WHEN 'md' THEN 'markdown' ELSE 'unknown' END AS language FROM product_chunk_metadata WHERE source_uri IS NOT NULL""")
def source_languages(spark, sf):
    u = table(spark, sf, "product_chunk_metadata").where(F.col("source_uri").isNotNull()).select("source_uri").distinct()
    return u.select("source_uri", T.language_of("source_uri").alias("language"))


@query("""SELECT doc_id AS doc, md5(list_aggregate(list_transform(generate_series(1, 100), lambda i: CASE WHEN strlen(left(text, i)) <= 100 THEN coalesce(text[i], '') ELSE '' END), 'string_agg', '')) AS digest FROM documents WHERE text IS NOT NULL AND text <> ''""")
def clipped_heads(spark, sf):
    return _docs(spark, sf).where("text <> ''").select(F.col("doc_id").alias("doc"), F.md5(T.clip_bytes(F.col("text"), 100)).alias("digest"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS name, CAST(strlen(text) + 1 AS BIGINT) AS size, md5(text || chr(10)) AS digest FROM documents WHERE kind = 'code' AND text IS NOT NULL AND NOT contains(text, chr(13)) AND doc_id % 2 = 0""")
def crawled_tree(spark, sf):
    """Code documents written as a tree of text files, crawled with an ignore rule for every odd one."""
    at = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    d = _docs(spark, sf).where((F.col("kind") == "code") & ~F.col("text").contains("\r")).select("doc_id", F.when(F.col("doc_id") % 2 == 1, "vendor").otherwise("src").alias("part"), F.col("text").alias("value"))
    d.repartition(8, "doc_id").write.partitionBy("part", "doc_id").text(at)
    c = readers.crawl(spark, at, extensions=("txt",), ignore=["part=vendor/"])
    return c.select(F.regexp_extract("path", r"doc_id=(\d+)", 1).alias("name"), "size", F.md5("text").alias("digest"))


# ---- packs, imports, caches ----------------------------------------------------------------------


@query(r"""WITH s AS (SELECT kind AS pack, doc_id AS item, coalesce(title, '') AS path, CAST(doc_id % 3 AS INT) AS start, CAST(coalesce(n_chars, 0) % 97 AS DOUBLE) AS score, doc_id % 9 = 0 AS direct,
    array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\s*(?://|#|/\*|\*)')), chr(10)) AS shown FROM documents WHERE text IS NOT NULL),
  f AS (SELECT *, strlen(shown) AS size, CASE WHEN direct THEN least(strlen(shown), floor(60000 * 0.5 / sum(direct::INT) OVER (PARTITION BY pack))) ELSE 0 END AS fl FROM s),
  g AS (SELECT *, least(size, fl + CASE WHEN sum(score) OVER w > 0 THEN floor((60000 - sum(fl) OVER w) * score / sum(score) OVER w) ELSE floor((60000 - sum(fl) OVER w) / count(*) OVER w) END)::BIGINT AS granted FROM f WINDOW w AS (PARTITION BY pack)),
  l AS (SELECT *, string_split(shown, chr(10)) AS ls FROM g), c AS (SELECT *, CASE WHEN size <= granted THEN shown ELSE array_to_string(list_transform(list_filter(list_zip(ls, generate_series(1, len(ls))), lambda x: list_sum(list_transform(ls[1 : x[2]], lambda y: strlen(y) + 1)) - 1 <= granted), lambda x: x[1]), chr(10)) END AS content FROM l),
  o AS (SELECT *, CASE WHEN content <> shown AND content = '' THEN 'budget' WHEN row_number() OVER (PARTITION BY pack, path, start, md5(content) ORDER BY score DESC, path, start, item) > 1 THEN 'duplicate' ELSE 'kept' END AS outcome FROM c)
  SELECT pack, item, outcome, CAST(CASE WHEN outcome = 'kept' THEN strlen(content) ELSE 0 END AS BIGINT) AS bytes, content <> shown AND outcome = 'kept' AS truncated FROM o""")
def packed_sources(spark, sf):
    i = F.col("doc_id")
    s = _docs(spark, sf).select(F.col("kind").alias("pack"), i.alias("item"), F.coalesce("title", F.lit("")).alias("path"), (i % 3).cast("int").alias("start"), (i % 3).cast("int").alias("end"), (F.coalesce("n_chars", F.lit(0)) % 97).cast("double").alias("score"), (i % 9 == 0).alias("direct"), "text")
    return evidence.packed(s, 60_000, 0.5, "no_comments").select("pack", "item", "outcome", F.col("bytes").cast("bigint").alias("bytes"), "truncated")


@query("""WITH d AS (SELECT CASE WHEN doc_id % 50 = 0 THEN NULL ELSE CAST(doc_id // 2 AS VARCHAR) END AS id, text FROM documents), p AS (SELECT CASE WHEN trim(coalesce(id, ''), ' ') = '' THEN 'missing_id' WHEN trim(coalesce(text, ''), ' ') = '' THEN 'missing_text' WHEN strlen(text) > 6000 THEN 'too_large'
  WHEN row_number() OVER (PARTITION BY id ORDER BY text NULLS FIRST) > 1 THEN 'repeated_id' ELSE 'good' END AS problem FROM d) SELECT problem, count(*) AS n FROM p GROUP BY problem""")
def import_problems(spark, sf):
    raw = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 50 == 0, F.lit(None)).otherwise(F.floor(F.col("doc_id") / 2).cast("string")).alias("document_id"), F.col("text").alias("body"))
    return readers.validated_documents(raw, 6_000).groupBy(F.coalesce("problem", F.lit("good")).alias("problem")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT DISTINCT document_id AS id FROM dense_vectors WHERE document_id IS NOT NULL), w AS (SELECT DISTINCT chunk_id AS id FROM product_chunk_metadata WHERE text_content IS NOT NULL) SELECT id, id IN (SELECT id FROM c) AS cached FROM (SELECT id FROM c UNION SELECT id FROM w)""")
def filled_cache(spark, sf):
    """Embeddings of chunks that the vector table lacks are computed, the others taken from it."""
    cache = table(spark, sf, "dense_vectors").where(F.col("document_id").isNotNull()).groupBy(F.col("document_id").alias("id")).agg(F.first("embedding").alias("embedding"))
    wanted = table(spark, sf, "product_chunk_metadata").where(F.col("text_content").isNotNull()).select(F.col("chunk_id").alias("id"), F.col("text_content").alias("text"))
    full = evidence.fill_embeddings(wanted, cache, ["id"], lambda t: Q.hash_embedding(T.unicode_tokens(t)))
    return full.join(cache.select("id", F.lit(True).alias("cached")), "id", "left").select("id", F.coalesce("cached", F.lit(False)).alias("cached"))


@query("""SELECT chunk_id, digest FROM (SELECT chunk_id, md5(coalesce(text_content, '')) AS digest, row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC, md5(coalesce(text_content, ''))) AS n FROM product_chunk_metadata) WHERE n = 1""")
def delta_appends(spark, sf):
    """Chunks appended in four deltas, compacted once on the way; a read takes the latest row of each id."""
    c = table(spark, sf, "product_chunk_metadata").select("chunk_id", "updated_at", F.md5(F.coalesce("text_content", F.lit(""))).alias("digest"))
    t = readers.DeltaTable(spark, f"{shared_dir(spark)}/delta-{uuid.uuid4().hex}", ["chunk_id"], [F.desc("updated_at"), F.asc("digest")])
    part = F.pmod(F.xxhash64("chunk_id", "updated_at"), F.lit(4))
    for i in range(4):
        t.append(c.where(part == i))
        if i == 1:
            t.compact()
    return t.load().select("chunk_id", "digest")


@query("""WITH u AS (SELECT DISTINCT source_uri AS path FROM product_chunk_metadata WHERE source_uri IS NOT NULL) SELECT path FROM u WHERE contains(path, '/snapshot') ORDER BY path LIMIT 5""")
def resolved_seeds(spark, sf):
    u = table(spark, sf, "product_chunk_metadata").where(F.col("source_uri").isNotNull()).select(F.col("source_uri").alias("path")).distinct()
    return relations.resolve_seeds(u, code.heuristic_symbols(_files(spark, sf), "path", "text"), "/snapshot")


@query()
def chunk_receipts(spark, sf):
    """Parents and children along the blocks; no SQL: the splitter is a state machine. Tested on hand-made texts."""
    return chunking.chunk_receipts(table(spark, sf, "documents"), "doc_id", "text", "kind")


def _prior_sql(steps: int) -> str:
    parts = [f"{_RARE}, b AS (SELECT DISTINCT src, dst FROM ed UNION SELECT dst, src FROM ed), nodes AS (SELECT DISTINCT src AS node FROM b), n AS (SELECT count(*) AS n FROM nodes), k AS (SELECT src, count(*) AS k FROM b GROUP BY src), r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM nodes, n)"]
    for i in range(steps):
        parts.append(f"r{i + 1} AS (SELECT nodes.node, 0.15::DOUBLE / n + 0.85 * coalesce(f, 0) AS rank FROM nodes LEFT JOIN (SELECT dst, sum(rank / k) AS f FROM b JOIN k USING (src) JOIN r{i} ON r{i}.node = src GROUP BY dst) x ON x.dst = nodes.node, n)")
    return ", ".join(parts)


@query(rf"""WITH {_prior_sql(3)}, s AS (SELECT doc_id AS doc, len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda t: t IN ({_IN}))) / 10.0::DOUBLE AS score FROM documents WHERE text IS NOT NULL), m AS (SELECT min(rank) AS lo, max(rank) AS hi FROM r3)
  SELECT doc, round(score * (1 + 0.15 * CASE WHEN rank IS NULL THEN 0 WHEN hi - lo < 1e-12 THEN 1 ELSE (rank - lo) / (hi - lo) END), 6) AS score FROM s LEFT JOIN r3 ON node = doc, m""")
def pagerank_prior(spark, sf):
    """Lexical scores raised by the PageRank of documents that share rare words."""
    e = _rare_edges(spark, sf)
    both = e.union(e.select("dst", "src")).distinct()
    rank = graph.pagerank(both, both.select(F.col("src").alias("node")).distinct(), 3).select(F.col("node").alias("doc"), F.col("rank").alias("prior"))
    hits = F.size(F.filter(T.unicode_tokens("text"), lambda t: t.isin(*TERMS))) / 10
    return ranking.min_max_prior(_docs(spark, sf).select(F.col("doc_id").alias("doc"), hits.alias("score")), rank).select("doc", F.round("score", 6).alias("score"))


@query("""SELECT event_type AS suite, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type""")
def latency_percentiles(spark, sf):
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("suite")).agg(at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"))


@query("""WITH m AS (SELECT doc_id AS doc, lower(coalesce(source, '')) AS tenant, [CAST(doc_id % 7 AS VARCHAR)] AS deny, CASE WHEN doc_id % 3 = 0 THEN ['1', '2'] WHEN doc_id % 3 = 1 THEN [] END AS allow FROM documents)
  SELECT doc, CASE WHEN tenant <> 'wiki' THEN 'tenant' WHEN list_contains(deny, '1') THEN 'principal_denied' WHEN NOT coalesce(list_contains(allow, '1') OR len(allow) = 0, true) THEN 'principal_not_allowed' END AS reason FROM m""")
def governed_access(spark, sf):
    i = F.col("doc_id")
    m = table(spark, sf, "documents").select(i.alias("doc"), F.coalesce("source", F.lit("")).alias("tenant"), F.array((i % 7).cast("string")).alias("deny_principals"), F.when(i % 3 == 0, F.array(F.lit("1"), F.lit("2"))).when(i % 3 == 1, F.array().cast("array<string>")).alias("allow_principals"))
    return m.select("doc", relations.deny_reason(**relations.normalise_filter({"tenant": " Wiki", "principal": "1"})).alias("reason"))


@query("""WITH q AS (SELECT vec_id AS query, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), 9) AS similarity FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS place FROM s)
  SELECT query, id, CAST(place AS INT) AS place FROM r WHERE place <= 5""")
def vector_search(spark, sf):
    """Every twentieth vector against all, exactly."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return dense.search(e, e.where("id % 20 = 0").select(F.col("id").alias("query"), "embedding"), 5, "exact").select("query", "id", "place")


@query()
def vector_search_ann(spark, sf):
    """The same by random projections; no SQL: an approximation. Its recall is tested."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return dense.search(e, e.where("id % 20 = 0").select(F.col("id").alias("query"), "embedding"), 5, "ann").select("query", "id", "place")


_FORMS = {
    "name": r"([A-Za-z][\w\s\-]{1,40}?)\b", "word": r"([A-Za-z][\w\-]{2,30})\b", "sum": r"(\$?\d[\d,]*(?:\.\d+)?(?:\s*(?:USD|usd|dollars?))?)\b", "phrase": r"([A-Za-z0-9][\w\s\.\-%$]{1,50}?)(?:[.!?;,\n]|$)",
    "version": r"(v?\d[\w\.\-]{0,20})\b", "percent": r"(\d{1,3}%|\d+\s*nines?)\b",
}
_VERBS = [
    ("price", r"price\s+is", "sum"), ("costs", "costs", "sum"), ("role", r"has\s+role", "name"), ("role", r"role\s+is", "name"), ("color", r"(?:are|is)\s+painted", "word"), ("color", r"(?:color|colour)\s+is", "word"),
    ("located_in", r"(?:is\s+)?(?:located|based|headquartered)\s+in", "name"), ("owns", r"(?:owns|acquired|acquired by)", "name"), ("founded", r"(?:was\s+)?founded\s+(?:in|by)", "name"), ("works_at", r"(?:works|worked)\s+at", "name"),
    *[(v, v, "phrase") for v in ("requires", "supports", "uses", "provides", "manages", "announced", "has", "is")], ("version", r"version(?:\s+is)?", "version"), ("sla", r"SLA(?:\s+is)?", "percent"),
    ("depends_on", r"depends\s+on", "phrase"), ("integrates_with", r"integrates\s+with", "phrase"), ("owned_by", r"(?:is\s+)?owned\s+by", "phrase"), ("reports_to", r"reports\s+to", "phrase"), ("powered_by", r"(?:is\s+)?powered\s+by", "phrase"),
    ("responsible_for", r"(?:is\s+)?responsible\s+for", "phrase"),
]
_SAID = " UNION ALL ".join(
    rf"SELECT doc_id AS doc, '{p}' AS predicate, unnest(regexp_extract_all(text, '(?i)\b([A-Za-z][\w\s\-]{{1,40}}?)\s+{v}\s+{_FORMS[f]}', 1)) AS s, unnest(regexp_extract_all(text, '(?i)\b([A-Za-z][\w\s\-]{{1,40}}?)\s+{v}\s+{_FORMS[f]}', 2)) AS o FROM documents WHERE text IS NOT NULL" for p, v, f in _VERBS
)
_OF = r"(?i)\b([A-Za-z][\w\-]{2,30})\s+of\s+([A-Za-z][\w\s\-]{1,40}?)\s+is\s+([A-Za-z0-9][\w\s\.\-%$]{0,40}?)(?:[.!?;,\n]|$)"
_MID = r"(?i)\b([A-Za-z][\w\s\-]{1,30}?)\s+between\s+([A-Za-z][\w\s\-]{1,30}?)\s+and\s+([A-Za-z][\w\s\-]{1,30}?)\b"
_GOAL = r"(?i)\b(?:{0}|recovery\s+{1}\s+objective)\s+(?:is|of|=)\s*(\d[\d\s]*(?:hours?|days?|minutes?|h|d|m)?)\b"
_PAIR = r"^([A-Za-z][\w\s\-]{1,40}?):\s*([A-Za-z0-9][\w\s\.\-%$]{1,60})$"
_SAID += "".join(f" UNION ALL SELECT doc_id, 'is', unnest(list_transform(regexp_extract_all(text, '{_GOAL.format(a, b)}', 1), lambda x: '{a}')), unnest(regexp_extract_all(text, '{_GOAL.format(a, b)}', 1)) FROM documents WHERE text IS NOT NULL" for a, b in (("rpo", "point"), ("rto", "time")))
_SAID += f""" UNION ALL SELECT doc_id, lower(unnest(regexp_extract_all(text, '{_OF}', 1))), unnest(regexp_extract_all(text, '{_OF}', 2)), unnest(regexp_extract_all(text, '{_OF}', 3)) FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, 'between', g1, g2 || ' and ' || g3 FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_MID}', 1)) AS g1, unnest(regexp_extract_all(text, '{_MID}', 2)) AS g2, unnest(regexp_extract_all(text, '{_MID}', 3)) AS g3 FROM documents WHERE text IS NOT NULL)
  UNION ALL SELECT doc_id, 'is', regexp_extract(x, '{_PAIR}', 1), regexp_extract(x, '{_PAIR}', 2) FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS x FROM documents WHERE text IS NOT NULL) WHERE strlen(x) <= 100 AND regexp_matches(x, '{_PAIR}')"""
_NO_S = ", ".join(f"'{w}'" for w in "it this that there here what which who they he she we one some any all each every the a an these those".split())
_NO_O = ", ".join(f"'{w}'" for w in "a an the it this that true false important possible available".split())


@query(rf"""WITH u AS ({_SAID}), t AS (SELECT DISTINCT doc, predicate, trim(regexp_replace(lower(s), '\s+', ' ', 'g'), ' ') AS subject, trim(regexp_replace(lower(o), '\s+', ' ', 'g'), ' ') AS object FROM u)
  SELECT * FROM t WHERE length(subject) > 1 AND object <> '' AND subject NOT IN ({_NO_S}) AND object NOT IN ({_NO_O}) AND len(string_split(object, ' ')) <= 8""")
def extract_statements(spark, sf):
    return claims.extract_statements(table(spark, sf, "documents"), "doc_id", "text")


_ASKED = "['what is ', 'how does ', 'where is ', 'why does ', 'what changed in ']"
_ENDS = "['', ' work', ' used', ' matter', '']"


@query(rf"""WITH w AS (SELECT doc_id AS doc, list_filter(regexp_extract_all(lower({_clip('text', 400)}), '[\p{{L}}\p{{N}}]{{4,}}'), lambda x: x NOT IN ({_STOPS})) AS ws FROM documents WHERE text IS NOT NULL),
  d AS (SELECT doc, list_transform(list_filter(list_zip(ws, generate_series(1, len(ws))), lambda x: list_position(ws, x[1]) = x[2]), lambda x: x[1]) AS ws FROM w)
  SELECT doc, {_ASKED}[i] || ws[i] || {_ENDS}[i] AS question FROM d, generate_series(1, 5) t(i) WHERE i <= least(len(ws), 8)""")
def question_lines(spark, sf):
    """Templated questions of each document by a vectorised UDF."""
    return _docs(spark, sf).select(F.col("doc_id").alias("doc"), F.explode(Q.question_lines(F.col("text"))).alias("question"))


@query(rf"""WITH t AS (SELECT doc_id AS doc, unnest(list_distinct(list_transform({_MENTIONED.format('text')}, lambda x: lower(x)))) AS token FROM documents WHERE text IS NOT NULL AND kind <> 'prose'), c AS (SELECT doc, token FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY doc) AS i FROM t) WHERE i <= 8)
  SELECT DISTINCT a.doc AS src, b.doc AS dst FROM c a JOIN c b ON a.token = b.token AND a.doc <> b.doc""")
def structure_edges(spark, sf):
    """Code, tables and chats that share an identifier-like token."""
    d = _docs(spark, sf).where("kind <> 'prose'")
    return graph.structure_edges(d.select(F.col("doc_id").alias("doc"), F.explode(arms.structure_tokens(F.col("text"), 1 << 20)).alias("token")))


_WANTS = {
    "lists": r"(?i)\b(list|enumerate|every|all of|complete (required|list)|each of)\b", "kinds": r"(?i)\b(which|what)\s+(customers?|partners?|teams?|channels?|exceptions?|steps?|fields?|metrics?|actions?)\b",
    "choice": r"(?i)\b(or|rather than|instead of|as opposed to)\b", "dispute": r"(?i)\b(correction|corrected|supersed|actually|telemetry review|conflicting|wrongly|initially (said|noted)|earlier note)\b",
    "multi": r"(?i)\b(and also|as well as|in addition|both .+ and|across (docs?|documents?|teams?))\b", "project": r"(?i)\b(how (do|should|can) we|what is the (recommended|suggested)|remediation|rollout|runbook|playbook|process for)\b",
    "bound": r"(?i)\b(only for|limited to|in (us|eu|ap)-|for the .+ tier|under the .+ plan|when using)\b", "absent": r"(?i)\b(is there any|are there any|does .+ (exist|support)|has anyone|any customer other than)\b", "asks": r"(?i)^(what|who|when|where|how many|how much)\b",
}
_CUES = ", ".join(f"regexp_matches(q, '{rx}') AS {k}" for k, rx in _WANTS.items())


@query(rf"""WITH s AS (SELECT doc_id AS doc, trim(unnest(regexp_split_to_array(text, '[?.!]')), ' ') AS q FROM documents WHERE text IS NOT NULL AND kind <> 'prose' UNION SELECT item_id, trim(text, ' ') FROM benchmark WHERE text IS NOT NULL),
  c AS (SELECT DISTINCT doc, q, lower(q) AS low, {_CUES}, len(list_distinct(list_filter(regexp_extract_all(lower(q), '[\p{{L}}\p{{N}}]+'), lambda t: strlen(t) >= 4 AND t NOT IN ({_STOPS})))) AS n FROM s),
  f AS (SELECT *, lists OR kinds AS listed, choice AND (dispute OR contains(low, 'oom') OR contains(low, 'stall') OR contains(low, 'was it') OR contains(low, 'is it')) AS conflict, n >= 12 OR strlen(q) >= 120 AS long FROM c),
  g AS (SELECT *, asks AND n <= 14 AND NOT listed AND NOT conflict AS short FROM f), w AS (SELECT *, long AND NOT short AS wide FROM g), p AS (SELECT *, listed OR conflict OR multi OR project OR wide AS several FROM w),
  e AS (SELECT CASE WHEN q = '' THEN 'basic' WHEN absent AND NOT listed AND (contains(low, 'other than') OR contains(low, 'besides')) THEN 'completeness' WHEN absent AND NOT listed THEN 'info_not_found' WHEN conflict THEN 'conflicting_info' WHEN listed THEN 'completeness'
    WHEN project AND several THEN 'project_related' WHEN bound AND several THEN 'constrained' WHEN wide THEN 'semantic' WHEN short THEN 'basic' ELSE 'semantic' END AS kind FROM p) SELECT kind, count(*) AS n FROM e GROUP BY kind""")
def question_types(spark, sf):
    """Kinds of the sentences of documents and of the benchmark items, read as questions."""
    d = _docs(spark, sf).where("kind <> 'prose'").select(F.col("doc_id").alias("doc"), F.explode(F.split("text", "[?.!]")).alias("q"))
    b = table(spark, sf, "benchmark").where(F.col("text").isNotNull()).select(F.col("item_id"), "text")
    q = d.union(b).select("doc", F.trim("q").alias("q")).distinct()
    return q.groupBy(Q.effective_type(F.col("q")).alias("kind")).agg(F.count("*").alias("n"))
