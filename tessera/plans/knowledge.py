"""Claims, symbols and graphs: queries over documents, events and code."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import claims, graph, index, relations
from tessera.plans.registry import query
from tessera.runtime import table

# ---- symbols of code documents -------------------------------------------------------------------

_DEF = r"(?:def|func|function|type|struct|class|as|range)\s+([A-Za-z_]\w{2,})"
_REF = r"\b([a-z]{6,14})\b"
_SYMBOLS = rf"""code AS (SELECT CAST(doc_id AS VARCHAR) AS path, text FROM documents WHERE kind = 'code' AND text IS NOT NULL),
  defs AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '{_DEF}', 1)) AS name FROM code),
  refs AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '{_REF}', 1)) AS name FROM code),
  symbols AS (SELECT path, name, 'def' AS kind FROM defs UNION ALL (SELECT path, name, 'ref' FROM refs EXCEPT SELECT path, name, 'ref' FROM defs))"""


def symbols(spark, sf):
    code = table(spark, sf, "documents").where((F.col("kind") == "code") & F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("path"), "text")
    defs = code.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_DEF), F.lit(1)))).alias("name"))
    refs = code.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_REF), F.lit(1)))).alias("name"))
    refs = refs.join(defs, ["path", "name"], "left_anti")
    return defs.withColumn("kind", F.lit("def")).union(refs.withColumn("kind", F.lit("ref"))).distinct()


@query(f"WITH {_SYMBOLS} SELECT path, name, kind FROM symbols")
def code_symbols(spark, sf):
    return symbols(spark, sf)


@query(f"WITH {_SYMBOLS} SELECT count(DISTINCT CASE WHEN kind = 'def' THEN name END) AS defs, count(DISTINCT CASE WHEN kind = 'ref' THEN name END) AS refs FROM symbols")
def symbol_statistics(spark, sf):
    s = symbols(spark, sf)
    return s.agg(F.count_distinct(F.when(F.col("kind") == "def", F.col("name"))).alias("defs"), F.count_distinct(F.when(F.col("kind") == "ref", F.col("name"))).alias("refs"))


_SEEDS = "seeds AS (SELECT path FROM code ORDER BY path LIMIT 3)"


def _seeds(spark, sf):
    code = table(spark, sf, "documents").where((F.col("kind") == "code") & F.col("text").isNotNull())
    return code.select(F.col("doc_id").cast("string").alias("path")).orderBy("path").limit(3)


_HOP = f"""{_SYMBOLS}, {_SEEDS},
  near AS (SELECT s.path, s.name, CASE WHEN kind = 'def' THEN 0 ELSE 1 END AS k FROM symbols s WHERE name IN (SELECT name FROM symbols WHERE path IN (SELECT path FROM seeds)) AND path NOT IN (SELECT path FROM seeds)),
  hop AS (SELECT path, name, k FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY name, k) AS n FROM near) WHERE n = 1 ORDER BY name, k, path LIMIT 20)"""


@query(f"WITH {_HOP} SELECT path, name FROM hop")
def symbol_hop(spark, sf):
    return relations.symbol_hop(symbols(spark, sf), _seeds(spark, sf), 20)


@query(f"WITH {_HOP} SELECT path, 2.0::DOUBLE AS score FROM seeds UNION ALL SELECT path, 1.0::DOUBLE FROM hop")
def expand_seeds(spark, sf):
    return relations.expand_seeds(symbols(spark, sf), _seeds(spark, sf), F.lit(1.0), 20)


@query(f"""WITH {_SYMBOLS}, ends AS (SELECT min(path) AS a, max(path) AS b FROM code), low AS (SELECT DISTINCT path, lower(name) AS name FROM symbols),
  common AS (SELECT name FROM low, ends WHERE path = a INTERSECT SELECT name FROM low, ends WHERE path = b), top AS (SELECT name FROM common ORDER BY name LIMIT 8)
  SELECT path, count(*) AS shared FROM low JOIN top USING (name), ends WHERE path NOT IN (a, b) GROUP BY path ORDER BY shared DESC, path LIMIT 10""")
def route_bridges(spark, sf):
    s = symbols(spark, sf)
    ends = table(spark, sf, "documents").where((F.col("kind") == "code") & F.col("text").isNotNull()).agg(F.min(F.col("doc_id").cast("string")).alias("a"), F.max(F.col("doc_id").cast("string")).alias("b")).first()
    return relations.route_bridges(s, ends["a"], ends["b"], 10)


_LINKS = f"""{_SYMBOLS}, links AS (SELECT r.path AS src, d.path AS dst FROM symbols r JOIN symbols d USING (name) WHERE r.kind = 'ref' AND d.kind = 'def' AND r.path <> d.path)"""


@query(f"WITH {_LINKS}, e AS (SELECT src AS node, 0.5 AS w FROM links UNION ALL SELECT dst, 1.0 FROM links), d AS (SELECT node, sum(w) AS d FROM e GROUP BY node) SELECT node, CAST(round(d / (SELECT max(d) FROM d), 6) AS DOUBLE) AS degree FROM d")
def degree_centrality(spark, sf):
    return graph.degree_by_name(symbols(spark, sf)).select("node", F.round("degree", 6).alias("degree"))


def _rank_sql(steps: int, teleport: str, lost: str) -> str:
    ctes = [f"{_LINKS}, nodes AS (SELECT path AS node FROM code WHERE path IN (SELECT path FROM symbols)), n AS (SELECT count(*) AS n FROM nodes), {_SEEDS}, base AS (SELECT node, {teleport} AS t FROM nodes, n), outd AS (SELECT src, count(*) AS k FROM links GROUP BY src), r0 AS (SELECT node, t AS rank FROM base)"]
    for i in range(steps):
        ctes.append(f"i{i} AS (SELECT dst, sum(rank / k) AS f FROM links JOIN outd USING (src) JOIN r{i} ON node = src GROUP BY dst), l{i} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{i} WHERE node NOT IN (SELECT src FROM outd)), "
                    f"r{i + 1} AS (SELECT node, 0.15 * t + 0.85 * (coalesce(f, 0) + lost * {lost}) AS rank FROM base LEFT JOIN i{i} ON dst = node, l{i}, n)")
    return "WITH " + ", ".join(ctes) + f" SELECT node, round(rank, 9) AS rank FROM r{steps}"


def _nodes(spark, sf):
    return symbols(spark, sf).select(F.col("path").alias("node")).distinct()


@query(_rank_sql(4, "1.0 / n", "1.0 / n"))
def pagerank_global(spark, sf):
    return graph.pagerank_by_name(symbols(spark, sf), _nodes(spark, sf), 4).select("node", F.round("rank", 9).alias("rank"))


@query(_rank_sql(4, "CASE WHEN node IN (SELECT path FROM seeds) THEN 1.0 / (SELECT count(*) FROM seeds WHERE path IN (SELECT node FROM nodes)) ELSE 0 END", "t"))
def pagerank_personal(spark, sf):
    return graph.pagerank_by_name(symbols(spark, sf), _nodes(spark, sf), 4, seeds=_seeds(spark, sf).withColumnRenamed("path", "node"), dangling="seeds").select("node", F.round("rank", 9).alias("rank"))


@query(_rank_sql(8, "1.0 / n", "1.0 / n").replace("SELECT node, round(rank, 9) AS rank FROM r8", """, wt AS (SELECT path, name, sum(CASE WHEN kind = 'def' THEN 2 ELSE 1 END) AS w FROM symbols GROUP BY ALL),
  nm AS (SELECT path, list(name ORDER BY i) AS names FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY w DESC, name) AS i FROM wt) WHERE i <= 5 GROUP BY path)
  SELECT path, round(rank / (SELECT max(rank) FROM r8), 6) AS rank, array_to_string(names, ',') AS names FROM r8 JOIN nm ON path = node"""))
def repo_map(spark, sf):
    m = graph.repo_map(symbols(spark, sf), 8)
    return m.select("path", F.round("rank", 6).alias("rank"), F.array_join("names", ",").alias("names"))


# ---- graphs over shared tokens -------------------------------------------------------------------

_POST = r"""post AS (SELECT DISTINCT doc_id AS doc, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda t: strlen(t) >= 4)) AS token FROM documents WHERE text IS NOT NULL)"""


def _post(spark, sf):
    docs = table(spark, sf, "documents").where(F.col("text").isNotNull())
    tokens = F.array_distinct(F.filter(T.unicode_tokens("text"), lambda t: F.octet_length(t) >= 4))
    return index.token_rows(docs, "doc_id", tokens)


@query(f"""WITH {_POST}, c AS (SELECT doc, token FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY doc) AS i FROM post) WHERE i <= 12)
  SELECT a.doc AS src, b.doc AS dst, count(*) AS shared FROM c a JOIN c b ON a.token = b.token AND a.doc < b.doc GROUP BY a.doc, b.doc""")
def cooccurrence_edges(spark, sf):
    return graph.cooccurrence_edges(_post(spark, sf))


_WEIGHTED = f"""{_POST}, n AS (SELECT token, count(*) AS n FROM post GROUP BY token HAVING count(*) BETWEEN 2 AND 80),
  m AS (SELECT doc, n, row_number() OVER w AS i, first_value(doc) OVER w AS hub, lag(doc) OVER w AS prev FROM post JOIN n USING (token) WINDOW w AS (PARTITION BY token ORDER BY doc)),
  e AS (SELECT hub AS a, doc AS b, 1 / ln(greatest(2, n)) AS w FROM m WHERE i > 1 UNION ALL SELECT prev, doc, 0.8 / ln(greatest(2, n)) FROM m WHERE i > 1),
  g AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, max(w) AS weight FROM e GROUP BY ALL)"""


@query(f"WITH {_WEIGHTED} SELECT src, dst, round(weight, 6) AS weight FROM g")
def weighted_graph(spark, sf):
    return graph.weighted_graph(_post(spark, sf)).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"WITH {_WEIGHTED} SELECT src, dst, round(weight, 6) AS weight FROM g WHERE weight >= 0.5")
def prune_weak_edges(spark, sf):
    return graph.prune_weak(graph.weighted_graph(_post(spark, sf)), 0.5).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_POST}, top AS (SELECT token, count(*) AS n FROM post GROUP BY token HAVING count(*) <= 4 ORDER BY n DESC, token LIMIT 256),
  k AS (SELECT 'doc:' || doc AS d, 'phrase:' || token AS t FROM post WHERE token IN (SELECT token FROM top)) SELECT d AS src, t AS dst FROM k UNION ALL SELECT t, d FROM k""")
def phrase_edges(spark, sf):
    return graph.phrase_edges(_post(spark, sf))


@query(f"""WITH {_POST}, d AS (SELECT token, count(*) AS df FROM post GROUP BY token), top AS (SELECT token, row_number() OVER (ORDER BY df DESC, token) AS cluster FROM d ORDER BY df DESC, token LIMIT 24)
  SELECT doc, CAST(min(cluster) AS INT) AS cluster, arg_min(token, cluster) AS token FROM post JOIN top USING (token) GROUP BY doc""")
def seed_clusters(spark, sf):
    return graph.seed_clusters(_post(spark, sf), 24)


_RARE = f"""{_POST}, r AS (SELECT token FROM post GROUP BY token HAVING count(*) = 2), ed AS (SELECT min(doc) AS src, max(doc) AS dst FROM post WHERE token IN (SELECT token FROM r) GROUP BY token)"""


def _rare_edges(spark, sf):
    return _post(spark, sf).groupBy("token").agg(F.count("*").alias("n"), F.min("doc").alias("src"), F.max("doc").alias("dst")).where("n = 2").select("src", "dst").distinct()


@query(f"""WITH RECURSIVE {_RARE}, b AS (SELECT DISTINCT src, dst FROM ed UNION SELECT dst, src FROM ed), reach(node, seen) AS (SELECT src, src FROM b UNION SELECT b.dst, reach.seen FROM reach JOIN b ON b.src = reach.node)
  SELECT node, min(seen) AS component FROM reach GROUP BY node""")
def communities(spark, sf):
    return graph.components(_rare_edges(spark, sf))


@query(f"""WITH {_RARE}, b AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), s AS (SELECT min(src) AS node FROM ed),
  h1 AS (SELECT DISTINCT dst AS node FROM b JOIN s ON b.src = s.node WHERE dst NOT IN (SELECT node FROM s)), h2 AS (SELECT DISTINCT dst AS node FROM b JOIN h1 ON b.src = h1.node WHERE dst NOT IN (SELECT node FROM s) AND dst NOT IN (SELECT node FROM h1))
  SELECT node, 0 AS hops FROM s UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""")
def graph_neighbours(spark, sf):
    e = _rare_edges(spark, sf)
    return graph.neighbours(e, e.agg(F.min("src").alias("node")), 2)


# ---- claims --------------------------------------------------------------------------------------

_CLAIM_SQL = " UNION ALL ".join(
    f"SELECT doc_id AS doc, '{n}' AS predicate, lower(unnest(regexp_extract_all(text, '{rx}', 1))) AS subject, lower(unnest(regexp_extract_all(text, '{rx}', 2))) AS object FROM documents WHERE text IS NOT NULL" for n, rx in claims.PATTERNS.items()
)


@query(f"WITH c AS ({_CLAIM_SQL}) SELECT doc, predicate, subject, object, count(*) AS mentions FROM c GROUP BY ALL")
def extract_claims(spark, sf):
    return claims.extract_claims(table(spark, sf, "documents"), "doc_id", "text")


# Events as claims: the user is the subject, the event type the predicate, the value's tier the object.
_EV = """ev AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS subject, event_type AS predicate, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS object, ts AS valid_from,
    CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 2 DAY END AS valid_to, ts + INTERVAL 1 HOUR AS observed_at, CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 5 DAY END AS expired_at,
    CASE WHEN event_id % 11 = 0 THEN 'tombstoned' ELSE 'active' END AS status, event_id % 4 AS quality, CASE WHEN event_id % 7 = 0 THEN event_id - 7 END AS supersedes FROM events)"""


def _event_claims(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    i, ts = F.col("event_id"), F.col("ts")
    after = lambda text: ts + F.expr(f"INTERVAL {text}")
    return e.select(
        i.alias("id"), F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("predicate"), F.floor(F.col("value") / 10).cast("string").alias("object"), ts.alias("valid_from"),
        F.when(i % 3 == 0, after("2 DAY")).alias("valid_to"), after("1 HOUR").alias("observed_at"), F.when(i % 5 == 0, after("5 DAY")).alias("expired_at"),
        F.when(i % 11 == 0, "tombstoned").otherwise("active").alias("status"), (i % 4).alias("quality"), F.when(i % 7 == 0, i - 7).alias("supersedes"),
        F.lit(None).cast("bigint").alias("superseded_by"), F.array(i).alias("documents"),
    )


@query(f"WITH {_EV} SELECT id, subject, predicate, object FROM ev WHERE status = 'active' AND valid_from <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR TIMESTAMP '2024-01-15' <= valid_to) AND observed_at <= TIMESTAMP '2024-01-16' AND (expired_at IS NULL OR TIMESTAMP '2024-01-16' < expired_at)")
def claims_as_of(spark, sf):
    t = lambda d: F.lit(d).cast("timestamp")
    c = _event_claims(spark, sf)
    return claims.as_of(c, t("2024-01-15"), t("2024-01-16")).select("id", "subject", "predicate", "object")


@query(f"WITH {_EV} SELECT subject, predicate, count(DISTINCT object) AS objects, count(*) AS claims FROM ev WHERE status = 'active' GROUP BY ALL HAVING count(DISTINCT object) >= 2")
def contested_claims(spark, sf):
    return claims.contested(_event_claims(spark, sf).where("status = 'active'"))


@query(f"""WITH {_EV}, c AS (SELECT *, coalesce(valid_to, TIMESTAMP '9999-01-01') AS ve FROM ev WHERE valid_to IS NOT NULL)
  SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.subject = b.subject AND a.predicate = b.predicate AND a.id < b.id AND a.object <> b.object AND a.valid_from < b.ve AND b.valid_from < a.ve""")
def overlapping_claims(spark, sf):
    return claims.overlaps(_event_claims(spark, sf).where("valid_to IS NOT NULL"))


_LADDER = f"""{_EV}, x AS (SELECT *, CASE WHEN valid_to > valid_from THEN epoch_us(valid_to) - epoch_us(valid_from) ELSE 4611686018427387904 END AS tight FROM ev),
  sup AS (SELECT l.subject, l.predicate, count(*) AS k, min(l.id) AS w FROM (SELECT DISTINCT a.subject, a.predicate, a.id FROM x a JOIN x b ON a.subject = b.subject AND a.predicate = b.predicate AND a.supersedes = b.id AND a.id <> b.id) l GROUP BY ALL),
  g AS (SELECT subject, predicate, count(*) AS n, max(quality) AS mq, min(id) AS only_id FROM x GROUP BY ALL),
  q AS (SELECT x.subject, x.predicate, count(*) AS nq, min(id) AS wq, min(tight) AS mt FROM x JOIN g ON x.subject = g.subject AND x.predicate = g.predicate AND quality = mq GROUP BY ALL),
  t AS (SELECT x.subject, x.predicate, count(*) AS nt, min(id) AS wt FROM x JOIN g ON x.subject = g.subject AND x.predicate = g.predicate AND quality = mq JOIN q ON x.subject = q.subject AND x.predicate = q.predicate AND tight = mt GROUP BY ALL),
  r AS (SELECT g.*, k, w, nq, wq, mt, nt, wt, CASE WHEN n = 1 THEN 'single' WHEN k > 1 THEN 'multiple_supersession' WHEN k = 1 THEN 'supersession' WHEN nq = 1 THEN 'evidence_quality' WHEN nt = 1 AND mt < 4611686018427387904 THEN 'tighter_valid_window' ELSE 'tie' END AS reason
    FROM g LEFT JOIN sup USING (subject, predicate) LEFT JOIN q USING (subject, predicate) LEFT JOIN t USING (subject, predicate))"""


@query(f"""WITH {_LADDER} SELECT subject, predicate, CASE WHEN reason IN ('multiple_supersession', 'tie') THEN 'contested' ELSE 'winner' END AS outcome, reason,
  CASE reason WHEN 'single' THEN only_id WHEN 'supersession' THEN w WHEN 'evidence_quality' THEN wq WHEN 'tighter_valid_window' THEN wt END AS winner FROM r""")
def claim_ladder(spark, sf):
    return claims.resolve(_event_claims(spark, sf), ["subject", "predicate"])


@query("""SELECT event_id, round(greatest(0.01, (value / 100) * pow(0.5, (epoch(TIMESTAMP '2024-02-01') - epoch(ts)) / CASE WHEN value / 100 < 1 THEN 7 * 86400.0 ELSE 365 * 86400.0 END)), 6) AS utility,
  round(least(value / 100 + 0.3, 5.0), 6) AS reinforced FROM events""")
def utility_decay(spark, sf):
    e = table(spark, sf, "events")
    score = F.col("value") / 100
    age = F.lit(1706745600.0) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select("event_id", F.round(claims.decayed(score, age), 6).alias("utility"), F.round(claims.reinforced(score, F.lit(0.3)), 6).alias("reinforced"))


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 21600000000 THEN 0 ELSE 1 END AS new FROM events),
  b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM a)
  SELECT user_id, CAST(session AS BIGINT) AS session, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS events FROM b GROUP BY user_id, session""")
def event_sessions(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = claims.sessions(e, "user_id", "ts", 6 * 3600)
    return s.select("user_id", "session", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


@query(f"""WITH {_RARE}, e AS (SELECT DISTINCT src, dst, 1.0 AS weight FROM ed), c AS ({_CLAIM_SQL}), s AS (SELECT DISTINCT doc, subject FROM c WHERE strlen(subject) >= 3),
  both_ends AS (SELECT DISTINCT src, dst FROM e JOIN s a ON a.doc = src JOIN s b ON b.doc = dst AND a.subject = b.subject)
  SELECT e.src, e.dst, CAST(CASE WHEN k.src IS NOT NULL THEN least(weight + 0.2, 2.0) ELSE weight * 0.5 END AS DOUBLE) AS weight FROM e LEFT JOIN both_ends k ON e.src = k.src AND e.dst = k.dst""")
def edge_hypotheses(spark, sf):
    edges = _rare_edges(spark, sf).withColumn("weight", F.lit(1.0))
    return graph.hypothesise(edges, claims.extract_claims(table(spark, sf, "documents"), "doc_id", "text"))
