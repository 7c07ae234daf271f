"""Further operators over the test tables: evidence, relations, packs, audits, extension points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import questions as Q
from tessera.functions import text as T
from tessera.operators import chunking, evidence, index, metrics, ranking
from tessera.operators import claims as C
from tessera.plans.knowledge import _CLAIM_SQL, _POST, _SYMBOLS, _post, symbols
from tessera.plans.registry import query
from tessera.plans.retrieval import _IN, _TOK, TERMS
from tessera.runtime import table


def _docs(spark, sf):
    return table(spark, sf, "documents").where(F.col("text").isNotNull())


@query(f"WITH {_SYMBOLS} SELECT path, kind FROM symbols WHERE name = (SELECT min(name) FROM symbols WHERE kind = 'def')")
def exact_occurrences(spark, sf):
    s = symbols(spark, sf)
    name = s.where("kind = 'def'").agg(F.min("name")).first()[0]
    return evidence.exact_occurrences(s.withColumnRenamed("name", "text"), name).select("path", "kind")


@query("SELECT DISTINCT source_uri, list_bool_or(list_transform(['/test/', '/tests/', '/__tests__/', '.test.', '.spec.', '_test.', '/fixtures/', '/fixture/', '/mocks/', '/__mocks__/'], lambda x: contains(lower(source_uri), x))) AS is_test FROM product_chunk_metadata WHERE source_uri IS NOT NULL")
def test_paths(spark, sf):
    u = table(spark, sf, "product_chunk_metadata").where(F.col("source_uri").isNotNull()).select("source_uri").distinct()
    return u.select("source_uri", evidence.is_test_path(F.col("source_uri")).alias("is_test"))


@query("""SELECT DISTINCT source_uri, CAST(CASE WHEN contains(lower(source_uri), 'cursorservice') THEN 1.8 WHEN contains(list_last(string_split(lower(source_uri), '/')), 'cursor') THEN 1.5 ELSE 1 END AS DOUBLE) AS boost
  FROM product_chunk_metadata WHERE source_uri IS NOT NULL""")
def interface_boost(spark, sf):
    u = table(spark, sf, "product_chunk_metadata").where(F.col("source_uri").isNotNull()).select("source_uri").distinct()
    return u.select("source_uri", evidence.interface_boost(F.lit(1.0), F.col("source_uri"), "ICursorService").alias("boost"))


@query("""WITH c AS (SELECT s_suppkey AS card, CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE 'n' || s_nationkey END AS tenant, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'eu' END AS region, ['t' || (s_suppkey % 5), 't' || (s_suppkey % 3)] AS topics, s_suppkey * 3 AS docs, s_suppkey % 7 / 10.0 AS cost FROM supplier)
  SELECT card, CAST(round(len(list_intersect(topics, ['t1', 't2'])) + 0.001 * docs - cost, 6) AS DOUBLE) AS score FROM c WHERE tenant IN ('', 'n4') AND coalesce(region, '') IN ('', 'eu')""")
def card_ranking(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    t = lambda m: F.concat(F.lit("t"), (k % m).cast("string"))
    c = s.select(
        k.alias("card"), F.when(F.col("s_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("tenant"), F.when(k % 4 == 0, F.lit(None)).otherwise("eu").alias("region"),
        F.array_distinct(F.array(t(5), t(3))).alias("topics"), (k * 3).alias("docs"), (k % 7 / 10).alias("cost"),
    ).where(evidence.card_filter("n4", "eu"))
    return c.select("card", F.round(evidence.card_rank(F.col("topics"), F.col("docs"), F.col("cost"), ["t1", "t2"]), 6).alias("score"))


@query("""WITH q AS (SELECT DISTINCT dsid FROM product_chunk_metadata WHERE text_content LIKE '%quarantine%') SELECT DISTINCT chunk_id FROM product_chunk_metadata WHERE dsid IS NOT NULL AND dsid NOT IN (SELECT dsid FROM q WHERE dsid IS NOT NULL)""")
def not_quarantined(spark, sf):
    c = table(spark, sf, "product_chunk_metadata")
    q = c.where(F.col("text_content").contains("quarantine") & F.col("dsid").isNotNull())
    return evidence.not_quarantined(c.where(F.col("dsid").isNotNull()), q, "dsid").select("chunk_id").distinct()


@query(f"WITH {_TOK} SELECT token, df FROM dfs WHERE df <= 20 OR regexp_matches(token, '_|[0-9]|[a-z][A-Z]')")
def prune_terms(spark, sf):
    post = index.postings(_docs(spark, sf), "doc_id", T.index_tokens("text"))
    return evidence.prune_terms(index.document_frequency(post), 20).select("token", "df")


# Claims that cite documents: the documents of each extracted (predicate, subject).
_CL = f"c AS ({_CLAIM_SQL}), g AS (SELECT predicate || ':' || subject AS id, list_sort(list_distinct(list(doc))) AS documents FROM c GROUP BY ALL)"


def _citations(spark, sf):
    """(id, doc): one row per claim and document that cites it."""
    c = C.extract_claims(table(spark, sf, "documents"), "doc_id", "text")
    return c.select(F.concat_ws(":", "predicate", "subject").alias("id"), "doc").distinct()


@query(f"WITH {_CL}, s AS (SELECT DISTINCT doc FROM c WHERE doc % 3 = 0) SELECT id, len(documents) AS n FROM g WHERE list_has_any(documents, (SELECT list(doc) FROM s))")
def claims_citing(spark, sf):
    c = _citations(spark, sf)
    return evidence.citing(c, c.where("doc % 3 = 0").select("doc")).groupBy("id").agg(F.count("*").alias("n"))


@query(f"""WITH {_POST}, l AS (SELECT doc, token AS id FROM post WHERE token IN (SELECT token FROM post GROUP BY token HAVING count(*) BETWEEN 2 AND 6)), s AS (SELECT min(doc) AS doc FROM l),
  h1 AS (SELECT DISTINCT doc FROM l WHERE id IN (SELECT id FROM l WHERE doc IN (SELECT doc FROM s)) AND doc NOT IN (SELECT doc FROM s) ORDER BY doc LIMIT 128),
  h2 AS (SELECT DISTINCT doc FROM l WHERE id IN (SELECT id FROM l WHERE doc IN (SELECT doc FROM s UNION SELECT doc FROM h1)) AND doc NOT IN (SELECT doc FROM s UNION SELECT doc FROM h1) ORDER BY doc LIMIT 128)
  SELECT doc, 0 AS hops FROM s UNION ALL SELECT doc, 1 FROM h1 UNION ALL SELECT doc, 2 FROM h2""")
def claim_walk(spark, sf):
    p = _post(spark, sf)
    few = p.groupBy("token").agg(F.count("*").alias("n")).where("n BETWEEN 2 AND 6")
    links = p.join(few, "token", "left_semi").select(F.col("token").alias("id"), "doc")
    return evidence.claim_walk(links, links.agg(F.min("doc").alias("doc")))


@query(f"""WITH {_POST}, r AS (SELECT token FROM post GROUP BY token HAVING count(*) <= 8), s AS (SELECT doc FROM (SELECT DISTINCT doc FROM post) ORDER BY doc LIMIT 5)
  SELECT doc, count(DISTINCT token) AS shared FROM post WHERE token IN (SELECT token FROM r) AND token IN (SELECT token FROM post WHERE doc IN (SELECT doc FROM s)) AND doc NOT IN (SELECT doc FROM s) GROUP BY doc""")
def entity_fanout(spark, sf):
    p = _post(spark, sf)
    return evidence.shared_token_documents(p, p.select("doc").distinct().orderBy("doc").limit(5))


@query("""WITH r AS (SELECT n_name AS src, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey), s AS (SELECT lower(n_name) AS e FROM nation WHERE n_nationkey < 3 UNION SELECT lower(r_name) FROM region WHERE r_regionkey = 0),
  b AS (SELECT lower(src) AS a, lower(dst) AS b FROM r UNION ALL SELECT lower(dst), lower(src) FROM r) SELECT DISTINCT b AS entity FROM b WHERE a IN (SELECT e FROM s) AND b NOT IN (SELECT e FROM s)""")
def relation_expansion(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rel = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    seeds = n.where("n_nationkey < 3").select(F.col("n_name").alias("entity")).union(r.where("r_regionkey = 0").select("r_name"))
    return evidence.expand_relations(rel, seeds)


@query("""SELECT doc_id AS doc, row_number() OVER (PARTITION BY md5(lower(text)) ORDER BY updated_at DESC NULLS LAST, doc_id) = 1 AS leads FROM documents WHERE text IS NOT NULL""")
def supersession(spark, sf):
    d = _docs(spark, sf).select(F.md5(F.lower("text")).alias("g"), F.col("doc_id").alias("doc"), F.col("updated_at").alias("dated"))
    return evidence.adjudicate(d, "g").select("doc", "leads")


@query("""WITH l AS (SELECT user_id % 5 AS tenant, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) + CASE WHEN event_id > 9000 THEN 1 ELSE 0 END AS sequence, md5(CAST(event_id AS VARCHAR)) AS digest, event_id FROM events),
  m AS (SELECT tenant, sequence, digest, CASE WHEN event_id % 500 = 0 THEN 'x' ELSE lag(digest) OVER (PARTITION BY tenant ORDER BY sequence) END AS previous FROM l),
  v AS (SELECT tenant, coalesce(lag(digest) OVER w IS NOT NULL AND previous IS DISTINCT FROM lag(digest) OVER w, false) OR coalesce(sequence <> lag(sequence) OVER w + 1, false) AS bad FROM m WINDOW w AS (PARTITION BY tenant ORDER BY sequence))
  SELECT tenant, count(*) AS rows, count(*) FILTER (bad) AS broken FROM v GROUP BY tenant""")
def audit_chain(spark, sf):
    w = Window.partitionBy("tenant").orderBy("event_id")
    e = table(spark, sf, "events").select((F.col("user_id") % 5).alias("tenant"), "event_id")
    e = e.withColumn("sequence", F.row_number().over(w).cast("bigint") + F.when(F.col("event_id") > 9000, 1).otherwise(0)).withColumn("digest", F.md5(F.col("event_id").cast("string")))
    e = e.withColumn("previous", F.when(F.col("event_id") % 500 == 0, "x").otherwise(F.lag("digest").over(Window.partitionBy("tenant").orderBy("sequence"))))
    return evidence.verify_audit(e)


@query("""WITH h AS (SELECT doc_id AS doc, md5(substr(lower(regexp_replace(text, '\\s+', ' ', 'g')), 1, 280)) AS h FROM documents WHERE text IS NOT NULL), f AS (SELECT h, min(doc) AS leader FROM h GROUP BY h HAVING count(*) > 1) SELECT doc, leader FROM h JOIN f USING (h)""")
def equal_heads(spark, sf):
    return evidence.equal_heads(table(spark, sf, "documents"), "doc_id", "text")


@query(rf"""WITH s AS (SELECT doc_id AS doc, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents WHERE text IS NOT NULL), u AS (SELECT doc, unnest(ss) AS sentence, unnest(range(len(ss))) AS i FROM s),
  o AS (SELECT *, len(list_filter([{_IN}], lambda t: list_contains(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}]+'), t))) AS overlap FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY overlap DESC, i) AS n FROM o WHERE overlap > 0)
  SELECT doc, sentence, CAST(overlap AS INT) AS overlap FROM r WHERE n = 1""")
def quote_recovery(spark, sf):
    """Best supporting sentence of each document, the first on ties."""
    return evidence.support_sentences(table(spark, sf, "documents"), "doc_id", "text", TERMS)


@query(rf"""WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL),
  h AS (SELECT doc, line, trim(t, ' ') AS title FROM l WHERE regexp_matches(trim(t, ' '), '^#{{1,6}}\s+\S') OR (regexp_matches(trim(t, ' '), '^\d+(\.\d+)*[.)]?\s+[A-Z]') AND length(trim(t, ' ')) <= 80) OR (regexp_matches(trim(t, ' '), '^([A-Z][a-z]+ ){{1,6}}[A-Z][a-z]+$') AND length(trim(t, ' ')) <= 60)),
  n AS (SELECT h.doc, h.line, title, string_agg(l.t, chr(10) ORDER BY l.line) AS text FROM h LEFT JOIN l ON l.doc = h.doc AND l.line > h.line AND l.line < coalesce((SELECT min(x.line) FROM h x WHERE x.doc = h.doc AND x.line > h.line), 1000000000) GROUP BY ALL)
  SELECT doc, CAST(line AS INT) AS line, CAST(score AS DOUBLE) AS score FROM (SELECT doc, line, {" + ".join(f"contains(lower(title), '{t}')::INT + 0.25 * contains(lower(coalesce(text, '')), '{t}')::INT" for t in TERMS)} AS score FROM n) WHERE score > 0""")
def page_index_search(spark, sf):
    """Heading nodes with the lines up to the next heading."""
    d = _docs(spark, sf)
    h = chunking.headings(d, "doc_id", "text").select("doc", "line", "title")
    h = h.withColumn("next", F.coalesce(F.lead("line").over(Window.partitionBy("doc").orderBy("line")), F.lit(1_000_000_000)))
    body = d.select(F.col("doc_id").alias("doc"), F.split("text", "\n").alias("ls"))
    part = F.array_join(F.slice("ls", F.col("line") + 2, F.greatest(F.least(F.col("next"), F.size("ls")) - F.col("line") - 1, F.lit(0))), "\n")
    return evidence.page_index_search(h.join(body, "doc").select("doc", "line", "title", part.alias("text")), TERMS)


@query(r"""SELECT doc_id AS doc, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\s*(?://|#|/\*|\*)')), chr(10))) AS digest FROM documents WHERE text IS NOT NULL AND kind = 'code'""")
def render_without_comments(spark, sf):
    return _docs(spark, sf).where("kind = 'code'").select(F.col("doc_id").alias("doc"), F.md5(evidence.render(F.col("text"), "no_comments")).alias("digest"))


@query("""WITH i AS (SELECT kind AS pack, doc_id AS item, n_chars AS score, strlen(text) // 4 AS size FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL),
  u AS (SELECT pack, item, sum(size) OVER (PARTITION BY pack ORDER BY score DESC, item ROWS UNBOUNDED PRECEDING) AS used FROM i) SELECT pack, item, CAST(used AS BIGINT) AS used FROM u WHERE used <= 20000""")
def context_pack(spark, sf):
    d = _docs(spark, sf).where(F.col("n_chars").isNotNull())
    i = d.select(F.col("kind").alias("pack"), F.col("doc_id").alias("item"), F.col("n_chars").alias("score"), T.estimated_tokens("text").alias("size"))
    return evidence.pack(i, 20_000).select("pack", "item", "used")


@query(f"""WITH s AS (SELECT kind AS query, doc_id AS doc, title, CAST(len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda t: t IN ({_IN}))) AS INT) AS score FROM documents WHERE text IS NOT NULL),
  d AS (SELECT query, doc, score, contains(lower(coalesce(title, '')), 'cursor') AS defines FROM s)
  SELECT query, doc, score, defines FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY defines DESC, score DESC, doc) AS n FROM d) WHERE n <= 10""")
def identifier_floor(spark, sf):
    d = _docs(spark, sf)
    s = d.select(F.col("kind").alias("query"), F.col("doc_id").alias("doc"), F.size(F.filter(T.index_tokens("text"), lambda t: t.isin(*TERMS))).alias("score"))
    defining = d.where(F.lower("title").contains("cursor")).select(F.col("kind").alias("query"), F.col("doc_id").alias("doc"))
    return evidence.identifier_floor(s, defining, 10)


@query("""SELECT user_id AS principal, event_id AS item, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, ts DESC, event_id) AS INT) AS place FROM events""")
def tier_order(spark, sf):
    e = table(spark, sf, "events")
    tier = F.when(F.col("event_id") % 3 == 0, "stm").when(F.col("event_id") % 3 == 1, "mtm").otherwise("ltm")
    return evidence.tier_order(e.select(F.col("user_id").alias("principal"), F.col("event_id").alias("item"), tier.alias("tier"), F.col("ts").alias("created"))).select("principal", "item", "place")


@query("""WITH b AS (SELECT doc_id, md5(text || CASE WHEN doc_id % 4 = 0 THEN '!' ELSE '' END) AS d FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, md5(text) AS d FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 0)
  SELECT CASE WHEN s.d IS NULL THEN 'inserted' WHEN s.d = b.d THEN 'unchanged' ELSE 'updated' END AS outcome, count(*) AS rows FROM b LEFT JOIN s USING (doc_id) GROUP BY 1""")
def upsert_receipts(spark, sf):
    d = _docs(spark, sf)
    b = d.select("doc_id", F.md5(F.concat("text", F.when(F.col("doc_id") % 4 == 0, "!").otherwise(""))).alias("d"))
    return evidence.receipts(b, d.where("doc_id % 5 <> 0").select("doc_id", F.md5("text").alias("d")), "doc_id", "d")


@query("""WITH l AS (SELECT c_custkey AS k, c_custkey % 4 AS rev FROM customer WHERE c_custkey % 6 <> 0), r AS (SELECT c_custkey AS k, c_custkey % 3 AS rev FROM customer WHERE c_custkey % 7 <> 0)
  SELECT coalesce(l.k, r.k) AS k, CASE WHEN l.k IS NULL OR r.rev > l.rev THEN 'fetch' WHEN r.k IS NULL THEN 'drop' ELSE 'keep' END AS action FROM l FULL JOIN r ON l.k = r.k""")
def connector_reconcile(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return evidence.reconcile(c.where("k % 6 <> 0").withColumn("rev", F.col("k") % 4), c.where("k % 7 <> 0").withColumn("rev", F.col("k") % 3), "k", "rev")


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc, 'context_header' AS kind, 'From ' || doc_id || ': ' || substr(string_split(text, chr(10))[1], 1, 120) AS output FROM documents WHERE text IS NOT NULL""")
def context_headers(spark, sf):
    jobs = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("doc"), F.lit("context_header").alias("kind"), "text")
    return evidence.run_workers(jobs, "context_header")


@query(r"""WITH t AS (SELECT doc_id AS doc, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: length(x) >= 3) AS ts FROM documents WHERE text IS NOT NULL), u AS (SELECT doc, unnest(ts) AS token FROM t),
  w AS (SELECT DISTINCT token FROM u), h AS (SELECT token, list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(token, ''), lambda c: ord(c)::HUGEINT)), lambda a, b: (a * 31 + b) % 18446744073709551616) AS h FROM w),
  b AS (SELECT token, CAST(CASE WHEN h >= 9223372036854775808 THEN 18446744073709551616 - h ELSE h END % 256 AS INT) AS bin FROM h), n AS (SELECT doc, bin, count(*) AS n FROM u JOIN b USING (token) GROUP BY ALL), m AS (SELECT doc, map(list(bin), list(n)) AS m FROM n GROUP BY doc)
  SELECT t.doc, list_transform(range(256), lambda i: CAST(coalesce(m[CAST(i AS INT)], 0) AS FLOAT)) AS embedding FROM t LEFT JOIN m ON m.doc = t.doc""")
def hash_embeddings(spark, sf):
    """Hashed bag embeddings with wrapping 64-bit arithmetic."""
    return _docs(spark, sf).select(F.col("doc_id").alias("doc"), Q.hash_embedding(T.unicode_tokens("text")).alias("embedding"))


@query("""SELECT chunk_id, dsid FROM product_chunk_metadata WHERE chunk_id NOT IN (SELECT document_id FROM dense_vectors WHERE document_id IS NOT NULL) GROUP BY ALL""")
def missing_embeddings(spark, sf):
    c = table(spark, sf, "product_chunk_metadata").select(F.col("chunk_id").alias("document_id"), "dsid").distinct()
    return evidence.missing_embeddings(c, table(spark, sf, "dense_vectors"), ["document_id"]).select(F.col("document_id").alias("chunk_id"), "dsid")


@query(f"""WITH d AS (SELECT doc_id AS doc, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS ts FROM documents WHERE text IS NOT NULL)
  SELECT doc, CAST(round(len(list_intersect(ts, [{_IN}])) / {len(TERMS)}, 6) AS DOUBLE) AS recall FROM d""")
def probe_recall(spark, sf):
    want = F.array(*[F.lit(t) for t in TERMS])
    return _docs(spark, sf).select(F.col("doc_id").alias("doc"), F.round(metrics.probe_recall(T.unicode_tokens("text"), want), 6).alias("recall"))


@query(f"""WITH t AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents WHERE text IS NOT NULL), p AS (SELECT doc, token, count(*) AS tf FROM t GROUP BY ALL)
  SELECT doc, round(sum(CASE WHEN token IN ({_IN}) THEN tf ELSE 0 END) / (sqrt(sum(tf * tf)) * sqrt({len(TERMS)})), 6) AS score FROM p GROUP BY doc HAVING sum(CASE WHEN token IN ({_IN}) THEN tf ELSE 0 END) > 0""")
def ascii_bag_cosine(spark, sf):
    s = ranking.bag_cosine(_docs(spark, sf), "doc_id", T.ascii_tokens("text"), TERMS)
    return s.select("doc", F.round("score", 6).alias("score"))
