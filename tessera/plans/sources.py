"""Queries that go through the readers, the versioned tables and the streaming jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import index
from tessera.plans.registry import query
from tessera.plans.retrieval import TERMS, _TOK
from tessera.runtime import shared_dir, table
from tessera.sources import readers
from tessera.streaming import jobs


def _place(spark, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query("SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS digest, title, source AS uri FROM documents WHERE text IS NOT NULL")
def jsonl_documents(spark, sf):
    """Documents written as JSON lines under alias keys and read back by them."""
    at = _place(spark, "jsonl")
    d = table(spark, sf, "documents")
    d.select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("body"), F.col("title").alias("name"), F.col("source").alias("source_uri")).write.json(at)
    return readers.read_documents(spark, at).select("id", F.md5("text").alias("digest"), "title", "uri")


@query("SELECT meeting_id, count(*) AS segments, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM fixture_meeting GROUP BY meeting_id")
def transcript_import(spark, sf):
    """Segments nested into JSON transcripts and imported again. A meeting's segments come in bounded parts of 1,000."""
    at = _place(spark, "transcripts")
    m = table(spark, sf, "fixture_meeting").withColumn("part", F.pmod(F.xxhash64("text", "start_millis"), F.lit(16)))
    seg = F.struct("start_millis", "end_millis", "text", "speaker_label")
    m.groupBy("meeting_id", "title", "started_at_ms", "ended_at_ms", "part").agg(F.collect_list(seg).alias("segments")).drop("part").write.json(at)
    s = readers.read_transcripts(spark, at)
    return s.groupBy("meeting_id").agg(F.count("*").alias("segments"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


_IN = ", ".join(f"'{t}'" for t in TERMS)


@query(f"WITH {_TOK} SELECT doc, token, tf FROM post WHERE token IN ({_IN})")
def postings_snapshot(spark, sf):
    """Postings saved in token buckets; the query's tokens read their buckets only."""
    at = _place(spark, "postings")
    readers.save_postings(index.row_postings(table(spark, sf, "documents").where(F.col("text").isNotNull()), "doc_id", T.index_tokens("text")), at)
    return readers.load_postings(spark, at, TERMS)


@query("SELECT CAST(epoch_us(date_trunc('hour', ts)) AS BIGINT) AS start_us, event_type, count(*) AS events FROM events GROUP BY ALL")
def stream_windows(spark, sf):
    """Hourly event counts by a stream in complete mode."""
    e = jobs.table_stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    r = jobs.collect_versions(jobs.windowed_counts(e, "ts", "event_type"), "complete")
    return r.select(F.unix_micros("start").alias("start_us"), "event_type", "events")


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 21600000000 THEN 0 ELSE 1 END AS new FROM events),
  b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
  SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS events FROM b GROUP BY user_id, s""")
def stream_sessions(spark, sf):
    """Sessions of users by a stream with session windows."""
    e = jobs.table_stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    r = jobs.collect_versions(jobs.windowed_sessions(e, "ts", "user_id", "6 hours"), "complete")
    return r.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


@query("""SELECT chunk_id, digest FROM (SELECT chunk_id, md5(coalesce(text_content, '')) AS digest, row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC, md5(coalesce(text_content, ''))) AS n FROM product_chunk_metadata) WHERE n = 1""")
def stream_upsert(spark, sf):
    """Chunks merged batch by batch into a versioned table, the latest row of each id winning."""
    s = jobs.table_stream(spark, sf, "product_chunk_metadata").select("chunk_id", "updated_at", F.md5(F.coalesce("text_content", F.lit(""))).alias("digest"))
    t = jobs.upsert_stream(s, _place(spark, "upsert"), ["chunk_id"], [F.desc("updated_at"), F.asc("digest")])
    return t.load().select("chunk_id", "digest")
