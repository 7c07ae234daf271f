"""Chunking, filtering, redaction, deltas and windows over documents and chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking, index, metrics, privacy, relations
from tessera.plans.registry import query
from tessera.plans.retrieval import TERMS
from tessera.runtime import checked_broadcast, table

_IN = ", ".join(f"'{t}'" for t in TERMS)


def _docs(spark, sf):
    return table(spark, sf, "documents").where(F.col("text").isNotNull())


# ---- chunks --------------------------------------------------------------------------------------

_SPACE = r"\s+"
_FIXED = rf"""w AS (SELECT doc_id AS doc, list_filter(string_split(trim(regexp_replace(text, '{_SPACE}', ' ', 'g'), ' '), ' '), lambda t: t <> '') AS w FROM documents WHERE text IS NOT NULL),
  s AS (SELECT doc, w, unnest(range(0, 1 + CAST(greatest(0, ceil((len(w) - 200) / 180.0)) AS BIGINT))) AS seq FROM w WHERE len(w) > 0),
  c AS (SELECT doc, CAST(seq AS INT) AS seq, w[seq * 180 + 1 : seq * 180 + 200] AS part FROM s)"""


@query(f"WITH {_FIXED} SELECT doc, seq, CAST(len(part) AS INT) AS tokens, sha256(array_to_string(part, ' ')) AS digest FROM c")
def fixed_chunks(spark, sf):
    return chunking.fixed_chunks(table(spark, sf, "documents"), "doc_id", "text", 200, 20).select("doc", "seq", "tokens", "digest")


@query()
def structure_chunks(spark, sf):
    """Chunks along natural blocks; no SQL: the splitter is a state machine. Tested against hand-made texts."""
    return chunking.structure_chunks(table(spark, sf, "documents"), "doc_id", "text", "kind")


@query(f"""WITH {_FIXED}, ch AS (SELECT doc, seq AS id, seq * 180 AS a, seq * 180 + len(part) AS b FROM c), p AS (SELECT doc, a, b, id FROM ch WHERE id % 3 = 0)
  SELECT doc, child, parent FROM (SELECT ch.doc, ch.id AS child, p.id AS parent, row_number() OVER (PARTITION BY ch.doc, ch.id ORDER BY least(ch.b, p.b) - greatest(ch.a, p.a) DESC, p.a) AS n
    FROM ch JOIN p ON ch.doc = p.doc AND ch.a < p.b AND p.a < ch.b) WHERE n = 1""")
def parent_links(spark, sf):
    c = chunking.fixed_chunks(table(spark, sf, "documents"), "doc_id", "text", 200, 20)
    spans = c.select("doc", F.col("seq").alias("id"), (F.col("seq") * 180).alias("start"), (F.col("seq") * 180 + F.col("tokens")).alias("end"))
    return relations.parent_links(spans, spans.where("id % 3 = 0"))


@query(r"""WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL),
  h AS (SELECT doc, line, trim(t, ' ') AS title, CASE WHEN regexp_matches(trim(t, ' '), '^#{1,6}\s+\S') THEN length(regexp_extract(trim(t, ' '), '^(#{1,6})', 1))
      WHEN regexp_matches(trim(t, ' '), '^\d+(\.\d+)*[.)]?\s+[A-Z]') AND length(trim(t, ' ')) <= 80 THEN len(string_split(regexp_extract(trim(t, ' '), '^(\d+(?:\.\d+)*)[.)]?\s+\S', 1), '.'))
      WHEN regexp_matches(trim(t, ' '), '^([A-Z][a-z]+ ){1,6}[A-Z][a-z]+$') AND length(trim(t, ' ')) <= 60 THEN 1 ELSE 0 END AS level FROM l)
  SELECT doc, CAST(line AS INT) AS line, CAST(level AS INT) AS level, title, CAST((SELECT max(x.line) FROM h x WHERE x.doc = h.doc AND x.line < h.line AND x.level BETWEEN 1 AND least(6, h.level - 1)) AS INT) AS parent_line FROM h WHERE level > 0""")
def headings(spark, sf):
    return chunking.headings(table(spark, sf, "documents"), "doc_id", "text").select("doc", "line", "level", "title", "parent_line")


# ---- filters and searches ------------------------------------------------------------------------

_META = """m AS (SELECT doc_id AS doc, coalesce(lower(source), '') AS tenant, kind AS scope, lower(coalesce(lang, 'und')) AS source_type, [kind, coalesce(lower(lang), 'und')] AS tags,
    updated_at AS valid_from, updated_at + INTERVAL 90 DAY AS valid_to FROM documents)"""


@query(f"""WITH {_META}, r AS (SELECT doc, CASE WHEN scope NOT IN ('prose', 'code') THEN 'scope' WHEN source_type NOT IN ('en', 'de') THEN 'source_type' WHEN NOT list_has_all(tags, ['prose']) THEN 'tags'
    WHEN NOT coalesce(valid_from < TIMESTAMP '2025-06-01' AND valid_to > TIMESTAMP '2025-01-01', false) THEN 'validity' END AS deny_reason FROM m)
  SELECT coalesce(deny_reason, 'allowed') AS outcome, count(*) AS n FROM r GROUP BY 1""")
def metadata_filter(spark, sf):
    d = table(spark, sf, "documents").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    lang = F.coalesce(F.lower("lang"), F.lit("und"))
    m = d.select(
        F.col("doc_id").alias("doc"), F.coalesce(F.lower("source"), F.lit("")).alias("tenant"), F.col("kind").alias("scope"), lang.alias("source_type"), F.array("kind", lang).alias("tags"),
        F.col("updated_at").alias("valid_from"), (F.col("updated_at") + F.expr("INTERVAL 90 DAY")).alias("valid_to"),
    )
    asked = relations.normalise_filter({"Scopes": ["prose", " code", "prose"], "source_types": ("EN", "de"), "tags": "prose", "valid_from": "2025-01-01", "valid_to": "2025-06-01 "})
    reason = relations.deny_reason(**asked)
    return m.groupBy(F.coalesce(reason, F.lit("allowed")).alias("outcome")).agg(F.count("*").alias("n"))


@query(r"""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS path, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE kind = 'code' AND text IS NOT NULL),
  h AS (SELECT path, line, substr(t, 1, 200) AS excerpt, row_number() OVER (PARTITION BY path ORDER BY line) AS n FROM l WHERE regexp_matches(t, 'with\ [A-Za-z_][A-Za-z0-9_]*\([0-9]*'))
  SELECT path, CAST(line AS INT) AS line, excerpt FROM h WHERE n <= 50""")
def structural_search(spark, sf):
    code = _docs(spark, sf).where("kind = 'code'").select(F.col("doc_id").cast("string").alias("path"), "text")
    return relations.structural_search(code, "path", "text", "with $NAME(").select("path", "line", "excerpt")


@query("""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS path, list_slice(string_split(text, chr(10)), 2, 6) AS p FROM documents WHERE kind = 'code' AND text IS NOT NULL)
  SELECT path, unnest(p) AS text, CAST(generate_subscripts(p, 1) + 1 AS INT) AS line FROM l""")
def read_lines(spark, sf):
    code = _docs(spark, sf).where("kind = 'code'").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("body"))
    return relations.read_lines(code, "path", "body", 2, 5)


# ---- privacy -------------------------------------------------------------------------------------

# The patterns are written out here once more, so that a changed one in the operator shows.
_RX = {
    "private_key": r"(?s)-----BEGIN[ \t]+[A-Z0-9 \t]*PRIVATE KEY-----(?:.*?-----END[ \t]+[A-Z0-9 \t]*PRIVATE KEY-----|.*)",
    "password_assignment": r"(?i)\b(?:password|passwd|pwd|secret)[ \t]*[:=][ \t]*[^\s,;]+",
    "bearer_token": r"(?i)\bbearer[ \t]+[A-Za-z0-9._~+/\-]{12,}=*",
    "api_key": r"\b(?:AKIA[0-9A-Z]{16}|(?:sk|api|key)_[A-Za-z0-9_\-]{12,}|sk-(?:proj-|ant-|or-)?[A-Za-z0-9_\-]{16,}|gh[pousr]_[A-Za-z0-9]{16,}|github_pat_[A-Za-z0-9_]{20,}|xox[baprs]-[A-Za-z0-9\-]{10,}|AIza[0-9A-Za-z_\-]{30,}|glpat-[A-Za-z0-9_\-]{16,}|(?:r8_|hf_)[A-Za-z0-9]{16,})\b",
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,63}",
    "credit_card": r"\b(?:[0-9][ -]?){12,18}[0-9]\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "phone": r"(?:\+?[0-9][0-9 .()\-]{7,}[0-9])",
}


def _luhn_sql(v: str) -> str:
    """Whether the digits of a value number 13 to 19 and their Luhn sum ends in 0."""
    d = f"reverse(regexp_replace({v}, '[^0-9]', '', 'g'))"
    twice = f"list_sum(list_transform(range(1, strlen({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN ({d}[i])::INT WHEN ({d}[i])::INT > 4 THEN 2 * ({d}[i])::INT - 9 ELSE 2 * ({d}[i])::INT END))"
    return f"(strlen({d}) BETWEEN 13 AND 19 AND {twice} % 10 = 0)"


def _found_sql(name: str, text: str = "text") -> str:
    found = f"regexp_extract_all({text}, '{_RX[name]}')"
    return f"list_filter({found}, lambda m: {_luhn_sql('m')})" if name == "credit_card" else found


_CNT = ", ".join(f"len({_found_sql(n)}) AS {n}" for n in _RX)


@query(f"SELECT doc_id AS doc, {_CNT} FROM documents WHERE text IS NOT NULL")
def pii_counts(spark, sf):
    return _docs(spark, sf).select(F.col("doc_id").alias("doc"), *[c.cast("bigint").alias(n) for n, c in privacy.counts(F.col("text")).items()])


@query(f"""WITH c AS (SELECT text_content AS text FROM product_chunk_metadata WHERE text_content IS NOT NULL), n AS (SELECT {_CNT} FROM c)
  SELECT CASE WHEN ssn + private_key > 0 THEN 'tombstone' WHEN credit_card + api_key + bearer_token + password_assignment > 0 THEN 'quarantine' WHEN email + phone > 0 THEN 'redact' ELSE 'clean' END AS status, count(*) AS n FROM n GROUP BY 1""")
def redaction_status(spark, sf):
    chunks = table(spark, sf, "product_chunk_metadata").where(F.col("text_content").isNotNull())
    return chunks.groupBy(privacy.status(privacy.counts(F.col("text_content"))).alias("status")).agg(F.count("*").alias("n"))


def _masked_sql() -> str:
    steps, last = ["s0 AS (SELECT document_id, kind, text FROM product_sidecars WHERE text IS NOT NULL)"], 0
    for n, rx in _RX.items():
        hide = f"CASE WHEN {_luhn_sql('x[2]')} THEN repeat('*', strlen(x[2])) ELSE x[2] END" if n == "credit_card" else "repeat('*', strlen(x[2]))"
        zipped = f"list_zip(string_split_regex(text, '{rx}'), regexp_extract_all(text, '{rx}'))"
        steps.append(f"s{last + 1} AS (SELECT document_id, kind, CASE WHEN regexp_matches(text, '{rx}') THEN array_to_string(list_transform({zipped}, lambda x: x[1] || CASE WHEN x[2] IS NULL THEN '' ELSE {hide} END), '') ELSE text END AS text FROM s{last})")
        last += 1
    return f"WITH {', '.join(steps)} SELECT document_id, kind, md5(text) AS masked_digest FROM s{last}"


@query(_masked_sql())
def masked_sidecars(spark, sf):
    s = table(spark, sf, "product_sidecars").where(F.col("text").isNotNull())
    return s.select("document_id", "kind", F.md5(privacy.masked(F.col("text"))).alias("masked_digest"))


# ---- deltas, sets --------------------------------------------------------------------------------

_SNAP = """old AS (SELECT coalesce(source, 'none') || '/' || doc_id AS path, md5(text) AS blob, kind AS mode FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 3),
  new AS (SELECT CASE WHEN doc_id % 10 = 4 THEN 'moved/' || doc_id ELSE coalesce(source, 'none') || '/' || doc_id END AS path, CASE WHEN doc_id % 10 = 5 THEN md5(text || '!') ELSE md5(text) END AS blob, kind AS mode
    FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 6)"""


def _snapshots(spark, sf):
    d = _docs(spark, sf)
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"))
    i = F.col("doc_id") % 10
    old = d.where(i != 3).select(path.alias("path"), F.md5("text").alias("blob"), F.col("kind").alias("mode"))
    new = d.where(i != 6).select(
        F.when(i == 4, F.concat(F.lit("moved/"), F.col("doc_id").cast("string"))).otherwise(path).alias("path"), F.when(i == 5, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("blob"), F.col("kind").alias("mode")
    )
    return old, new


@query(f"""WITH {_SNAP}, g AS (SELECT *, row_number() OVER (PARTITION BY blob, mode ORDER BY path) AS i FROM old WHERE path NOT IN (SELECT path FROM new)),
  c AS (SELECT *, row_number() OVER (PARTITION BY blob, mode ORDER BY path) AS i FROM new WHERE path NOT IN (SELECT path FROM old))
  SELECT CASE WHEN g.path IS NULL THEN 'add' WHEN c.path IS NULL THEN 'delete' ELSE 'rename' END AS op, coalesce(c.path, g.path) AS path, CASE WHEN g.path IS NOT NULL AND c.path IS NOT NULL THEN g.path END AS old_path
    FROM g FULL JOIN c ON g.blob = c.blob AND g.mode = c.mode AND g.i = c.i
  UNION ALL SELECT 'modify', new.path, NULL FROM old JOIN new USING (path) WHERE old.blob <> new.blob OR old.mode <> new.mode""")
def snapshot_delta(spark, sf):
    return relations.snapshot_delta(*_snapshots(spark, sf))


@query("""WITH m AS (SELECT doc_id AS path, length(text) AS size, n_chars AS mtime FROM documents WHERE doc_id % 7 <> 0), d AS (SELECT doc_id AS path, length(text) AS size, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE n_chars END AS mtime FROM documents WHERE doc_id % 11 <> 0),
  j AS (SELECT m.path AS mp, d.path AS dp, m.size IS NOT DISTINCT FROM d.size AND m.mtime IS NOT DISTINCT FROM d.mtime AS same FROM m FULL JOIN d ON m.path = d.path)
  SELECT count(*) FILTER (mp IS NOT NULL AND dp IS NOT NULL AND same) AS stamp_match, count(*) FILTER (mp IS NOT NULL AND dp IS NOT NULL AND NOT same) AS stamp_mismatch, count(*) FILTER (mp IS NULL) AS missing_in_index,
    count(*) FILTER (dp IS NULL) AS deleted_on_disk, false AS fresh FROM j""")
def index_freshness(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.length("text").alias("size"), F.col("n_chars").alias("mtime"))
    disk = d.where("path % 11 <> 0").withColumn("mtime", F.when(F.col("path") % 5 == 0, -1).otherwise(F.col("mtime")))
    return relations.freshness(d.where("path % 7 <> 0"), disk)


@query("""SELECT chunk_id, dsid, md5(coalesce(text_content, '')) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC, md5(coalesce(text_content, '')), coalesce(source_uri, '')) AS n FROM product_chunk_metadata) WHERE n = 1""")
def latest_chunks(spark, sf):
    c = table(spark, sf, "product_chunk_metadata").select("chunk_id", "dsid", "source_uri", "updated_at", F.md5(F.coalesce("text_content", F.lit(""))).alias("digest"))
    return relations.latest_wins(c, ["chunk_id"], [F.desc("updated_at"), F.asc("digest"), F.coalesce("source_uri", F.lit("")).asc()]).select("chunk_id", "dsid", "digest")


@query("""WITH gone AS (SELECT DISTINCT dsid FROM product_chunk_metadata WHERE dsid LIKE '%7')
  SELECT 'chunks' AS "table", count(*) AS n FROM product_chunk_metadata WHERE dsid IS NULL OR dsid NOT IN (SELECT dsid FROM gone)
  UNION ALL SELECT 'sidecars', count(*) FROM product_sidecars WHERE document_id NOT IN (SELECT dsid FROM gone)""")
def purge_documents(spark, sf):
    chunks, side = table(spark, sf, "product_chunk_metadata"), table(spark, sf, "product_sidecars")
    gone = chunks.where("dsid LIKE '%7'").select("dsid").distinct()
    kept = relations.purge({"chunks": (chunks, "dsid"), "sidecars": (side, "document_id")}, gone)
    a, b = (kept[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("table"), "n") for k in ("chunks", "sidecars"))
    return a.union(b)


@query("""WITH gone AS (SELECT DISTINCT dsid AS id FROM product_chunk_metadata WHERE dsid LIKE '%7') SELECT DISTINCT 'sidecars' AS "table", document_id AS id FROM product_sidecars WHERE document_id IN (SELECT id FROM gone)""")
def residual_documents(spark, sf):
    chunks, side = table(spark, sf, "product_chunk_metadata"), table(spark, sf, "product_sidecars")
    return relations.residual({"sidecars": (side, "document_id")}, chunks.where("dsid LIKE '%7'").select("dsid").distinct())


@query("SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text")
def first_seen_texts(spark, sf):
    return relations.first_seen(_docs(spark, sf), "text", "doc_id")


@query("""SELECT dsid, min(chunk_id) AS chunk_id FROM product_chunk_metadata WHERE dsid IS NOT NULL GROUP BY dsid""")
def first_passages(spark, sf):
    c = table(spark, sf, "product_chunk_metadata").where(F.col("dsid").isNotNull()).select("dsid", "chunk_id")
    return relations.first_per_key(c, "dsid", "chunk_id")


@query("""WITH c AS (SELECT DISTINCT dsid AS doc, chunk_id AS chunk FROM product_chunk_metadata WHERE dsid IS NOT NULL), s AS (SELECT * FROM c WHERE chunk LIKE '%#0')
  SELECT doc, chunk FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY chunk) AS n FROM c WHERE doc IN (SELECT doc FROM s) AND chunk NOT IN (SELECT chunk FROM s)) WHERE n <= 4""")
def sibling_chunks(spark, sf):
    c = table(spark, sf, "product_chunk_metadata").where(F.col("dsid").isNotNull()).select(F.col("dsid").alias("doc"), F.col("chunk_id").alias("chunk")).distinct()
    return relations.siblings(c, c.where("chunk LIKE '%#0'"))


# ---- windows and budgets -------------------------------------------------------------------------


@query("SELECT event_id, epoch_us(ts) AS ts_us FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-10', 0) ORDER BY ts, event_id LIMIT 51")
def history_page(spark, sf):
    import datetime

    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    page = relations.page_after(e, ["ts", "event_id"], (datetime.datetime(2024, 1, 10, tzinfo=datetime.timezone.utc), 0), 50)
    return page.select("event_id", F.unix_micros("ts").alias("ts_us"))


@query("""WITH s AS (SELECT kind AS pack, doc_id AS item, CAST(length(text) AS BIGINT) AS size, CAST(n_chars % 17 AS DOUBLE) AS score, doc_id % 9 = 0 AS direct FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL),
  w AS (SELECT *, count(*) FILTER (direct) OVER p AS nd, count(*) OVER p AS n, sum(greatest(score, 0)) OVER p AS total FROM s WINDOW p AS (PARTITION BY pack)),
  f AS (SELECT *, CASE WHEN direct THEN least(size, floor(100000 * 0.4 / nd)) ELSE 0 END AS f FROM w), r AS (SELECT *, 100000 - sum(f) OVER (PARTITION BY pack) AS rest FROM f)
  SELECT pack, item, CAST(least(size, f + CASE WHEN total > 0 THEN floor(rest * greatest(score, 0) / total) ELSE floor(rest / n) END) AS BIGINT) AS granted FROM r""")
def context_budget(spark, sf):
    d = _docs(spark, sf).where(F.col("n_chars").isNotNull())
    s = d.select(F.col("kind").alias("pack"), F.col("doc_id").alias("item"), F.length("text").cast("bigint").alias("size"), (F.col("n_chars") % 17).cast("double").alias("score"), (F.col("doc_id") % 9 == 0).alias("direct"))
    return relations.allocate_budget(s, 100_000, 0.4)


@query("""WITH RECURSIVE i AS (SELECT user_id AS session, event_id AS item, 'L' || (event_id % 4) AS tier, length(props) AS size, row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY event_id) AS n FROM events),
  g(session, tier, n, left_over, item, took) AS (SELECT DISTINCT session, tier, 0::BIGINT, CASE tier WHEN 'L0' THEN 400 WHEN 'L1' THEN 300 WHEN 'L2' THEN 200 ELSE 100 END::BIGINT, NULL::BIGINT, false FROM i
    UNION ALL SELECT i.session, i.tier, i.n, CASE WHEN size <= left_over THEN left_over - size ELSE left_over END, i.item, size <= left_over FROM g JOIN i ON i.session = g.session AND i.tier = g.tier AND i.n = g.n + 1)
  SELECT i.session, i.item, i.tier, i.item AS position, CAST(i.size AS BIGINT) AS size FROM g JOIN i USING (session, tier, n) WHERE took""")
def tier_budgets(spark, sf):
    """Greedy byte budgets of a session's tiers: an item that does not fit is skipped, later ones may."""
    e = table(spark, sf, "events")
    items = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("item"), F.concat(F.lit("L"), (F.col("event_id") % 4).cast("string")).alias("tier"), F.col("event_id").alias("position"), F.length("props").cast("bigint").alias("size"))
    return relations.tier_budgets(items, {"L0": 400, "L1": 300, "L2": 200, "L3": 100})


@query(f"""WITH post AS (SELECT doc_id AS doc, kind, len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda t: t IN ({_IN}))) AS score FROM documents WHERE text IS NOT NULL),
  a AS (SELECT *, row_number() OVER (PARTITION BY kind, doc ORDER BY score DESC, doc) AS a, substr(CAST(doc AS VARCHAR), 1, 2) AS pre FROM post WHERE score > 0),
  b AS (SELECT *, row_number() OVER (PARTITION BY kind, pre ORDER BY score DESC, doc) AS b FROM a WHERE a <= 1), c AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, doc) AS place FROM b WHERE b <= 3)
  SELECT kind AS query, doc, CAST(place AS INT) AS place FROM c WHERE place <= 20""")
def retain_window(spark, sf):
    hits = F.size(F.filter(T.index_tokens("text"), lambda t: t.isin(*TERMS)))
    pool = _docs(spark, sf).select(F.col("kind").alias("query"), F.col("doc_id").alias("doc"), F.col("doc_id").alias("chunk"), hits.alias("score"), F.lit(False).alias("protected")).where("score > 0")
    return relations.retain_window(pool, 20, 1, 3, prefix=2).select("query", "doc", "place")


@query("""WITH r AS (SELECT kind AS pack, doc_id AS item, coalesce(source, '') AS path, n_chars AS line, row_number() OVER (PARTITION BY kind ORDER BY doc_id) - 1 AS rank FROM documents WHERE n_chars IS NOT NULL)
  SELECT pack, item, CAST(row_number() OVER (PARTITION BY pack ORDER BY CASE WHEN rank % 2 = 0 THEN 0 ELSE 1 END, CASE WHEN rank % 2 = 0 THEN rank ELSE -rank END) AS INT) AS place FROM r""")
def evidence_head_tail(spark, sf):
    d = table(spark, sf, "documents").where(F.col("n_chars").isNotNull())
    r = d.select(F.col("kind").alias("pack"), F.col("doc_id").alias("item"), F.coalesce("source", F.lit("")).alias("path"), F.col("n_chars").alias("line"), (F.row_number().over(Window.partitionBy("kind").orderBy("doc_id")) - 1).alias("rank"))
    return relations.evidence_order(r, "head_tail")


# ---- metrics -------------------------------------------------------------------------------------

_EVAL = r"""b AS (SELECT item_id AS query, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ts FROM benchmark WHERE text IS NOT NULL), d AS (SELECT doc_id AS doc, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ts FROM documents WHERE text IS NOT NULL),
  qt AS (SELECT query, unnest(list_distinct(ts)) AS token FROM b), p AS (SELECT doc, unnest(list_distinct(ts)) AS token FROM d),
  w AS (SELECT token, ln(1 + (SELECT count(*) FROM d) / count(*)) AS idf FROM p WHERE token IN (SELECT token FROM qt) GROUP BY token), s AS (SELECT query, doc, round(sum(idf), 9) AS score FROM qt JOIN w USING (token) JOIN p USING (token) GROUP BY query, doc),
  r AS (SELECT * FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 100),
  bg AS (SELECT DISTINCT query, unnest(list_transform(range(1, len(ts) - 8), lambda k: array_to_string(ts[k : k + 9], ' '))) AS gram FROM b WHERE len(ts) >= 10), dg AS (SELECT DISTINCT doc, unnest(list_transform(range(1, len(ts) - 8), lambda k: array_to_string(ts[k : k + 9], ' '))) AS gram FROM d WHERE len(ts) >= 10),
  g AS (SELECT DISTINCT query, doc FROM bg JOIN dg USING (gram))"""


@query(f"""WITH {_EVAL}, n AS (SELECT query, count(*) AS n FROM g GROUP BY query), i AS (SELECT query, (SELECT sum(1 / log2(k + 1)) FROM range(1, 11) t(k) WHERE k <= n) AS ideal FROM n),
  h AS (SELECT query, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM r JOIN g USING (query, doc) GROUP BY query)
  SELECT count(*) AS queries, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS hit_at_1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS hit_at_5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS hit_at_10,
    round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(coalesce(dcg, 0) / ideal), 6) AS ndcg FROM i LEFT JOIN h USING (query)""")
def retrieval_metrics(spark, sf):
    """How well words weighted by rarity find, for each benchmark item, the documents that hold ten of its words in a row.

    All words of all items meet all documents; the items' words and runs are a stated set, which is broadcast after its size is checked.
    Ranks are kept to 100, on the map side first."""
    bench = table(spark, sf, "benchmark").where(F.col("text").isNotNull()).select(F.col("item_id").alias("query"), T.unicode_tokens("text").alias("ts"))
    docs = _docs(spark, sf).select(F.col("doc_id").alias("doc"), T.unicode_tokens("text").alias("ts"))
    size = bench.agg(F.coalesce(F.sum(F.size("ts")), F.lit(0)).alias("n")).first()["n"]
    asked = checked_broadcast(bench.select("query", F.explode(F.array_distinct("ts")).alias("token")), size, 64)
    words = docs.select("doc", F.explode(F.array_distinct("ts")).alias("token"))
    tokens = checked_broadcast(bench.select(F.explode("ts").alias("token")).distinct(), size, 48)
    df = words.join(tokens, "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1 + F.col("n") / F.col("df"))
    weighted = asked.join(df, "token").crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select("query", "token", idf.alias("idf"))  # one row
    s = words.join(checked_broadcast(weighted, size, 72), "token").groupBy("query", "doc").agg(F.round(F.sum("idf"), 9).alias("score"))
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))).where("rank <= 100")
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("ts") - 9), lambda i: F.array_join(F.slice("ts", i, 10), " ")))
    grams = lambda rows, key: rows.where(F.size("ts") >= 10).select(key, F.explode(runs).alias("gram"))
    gold = grams(docs, "doc").join(checked_broadcast(grams(bench, "query"), size, 120), "gram").select("query", "doc").distinct()
    m = metrics.retrieval(r.select("query", "doc", "rank"), gold)
    return m.select("queries", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


@query("""WITH s AS (SELECT event_type AS projection, 'p' || (user_id % 3) AS propagation, event_id % 13 <> 0 AS admitted, CAST(floor(value * 10) AS BIGINT) AS lag FROM events),
  t AS (SELECT projection, propagation, 900 AS lim FROM (SELECT DISTINCT projection, propagation FROM s) UNION ALL SELECT 'absent', 'p0', 900),
  o AS (SELECT projection, propagation, count(*) FILTER (admitted) AS admitted, count(*) FILTER (NOT admitted) AS rejected, quantile_disc(CASE WHEN admitted THEN lag END, 0.5) AS p50, quantile_disc(CASE WHEN admitted THEN lag END, 0.95) AS p95 FROM s GROUP BY ALL)
  SELECT t.projection, t.propagation, coalesce(admitted, 0) AS admitted, coalesce(rejected, 0) AS rejected, CAST(p50 AS DOUBLE) AS p50, CAST(p95 AS DOUBLE) AS p95, CASE WHEN coalesce(admitted, 0) = 0 THEN 'unverified' WHEN p95 <= lim THEN 'met' ELSE 'missed' END AS verdict FROM t LEFT JOIN o USING (projection, propagation)""")
def slo_verdicts(spark, sf):
    e = table(spark, sf, "events")
    s = e.select(F.col("event_type").alias("projection"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("propagation"), (F.col("event_id") % 13 != 0).alias("admitted"), F.floor(F.col("value") * 10).alias("lag"))
    t = s.select("projection", "propagation").distinct().union(spark.createDataFrame([("absent", "p0")], "projection string, propagation string")).withColumn("p95_limit", F.lit(900))
    return metrics.slo_verdicts(s, t)


@query("""SELECT l_returnflag AS category, count(*) AS steps, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS saved, CAST(sum(l_linenumber) AS BIGINT) AS spent FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def savings_rollup(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("category"), F.col("l_quantity").cast("bigint").alias("saved"), F.col("l_linenumber").alias("spent"))
    return metrics.savings(l)


@query(rf"""WITH q AS (SELECT ['cursor', 'snapshot', 'retired', 'update'] AS q), d AS (SELECT doc_id AS doc, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS ts FROM documents WHERE text IS NOT NULL),
  s AS (SELECT doc, len(list_intersect(ts, q)) AS n, len(ts) AS m FROM d, q)
  SELECT doc, CAST(round(CASE WHEN m + 4 - n = 0 THEN 0 ELSE n / (m + 4 - n) END, 6) AS DOUBLE) AS jaccard, CAST(floor(1000 * n / 4) AS INT) AS per_mille,
    CASE WHEN floor(1000 * n / 4) <= 399 THEN 143 WHEN floor(1000 * n / 4) <= 599 THEN 375 WHEN floor(1000 * n / 4) <= 799 THEN 778 ELSE 857 END AS calibrated FROM s""")
def support_scores(spark, sf):
    q = F.array(*[F.lit(t) for t in ("cursor", "snapshot", "retired", "update")])
    ts = F.array_distinct(T.unicode_tokens("text"))
    pm = metrics.support_per_mille(q, ts)
    return _docs(spark, sf).select(F.col("doc_id").alias("doc"), F.round(metrics.jaccard(q, ts), 6).alias("jaccard"), pm.alias("per_mille"), metrics.calibrated(pm).alias("calibrated"))


@query(r"""WITH q AS (SELECT ['which', 'cursors', 'retired', 'manifest'] AS q), d AS (SELECT meeting_id, start_millis, speaker_label, text, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS ts FROM fixture_meeting WHERE text IS NOT NULL)
  SELECT DISTINCT meeting_id, text, CAST(round(len(list_intersect(ts, q)) / 4, 6) AS DOUBLE) AS score FROM d, q WHERE len(list_intersect(ts, q)) >= 2""")
def turn_grep(spark, sf):
    q = F.array(*[F.lit(t) for t in ("which", "cursors", "retired", "manifest")])
    m = table(spark, sf, "fixture_meeting").where(F.col("text").isNotNull())
    n = F.size(F.array_intersect(q, F.array_distinct(T.unicode_tokens("text"))))
    return m.withColumn("n", n).where("n >= 2").select("meeting_id", "text", F.round(F.col("n") / 4, 6).alias("score")).distinct()
