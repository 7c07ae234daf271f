"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bagminhash, bytepair, credentials, leakage, neighbours, pii, reading, splitting, turns
from tessera.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of which at least half of the three-word sequences of either occur in both."""
    chunks = table(spark, sf_dir, "product_chunk_metadata")
    members, links = bagminhash.class_links(chunks, "chunk_id", "text_content", bagminhash.STATED)
    pairs = bagminhash.record_pairs(members, links)
    return pairs.select(F.col("record_a").alias("chunk_id_a"), F.col("record_b").alias("chunk_id_b"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of each chunk, five-word bags with multiplicities at 0.8."""
    chunks = table(spark, sf_dir, "product_chunk_metadata")
    return bagminhash.near_duplicate_classes(chunks, "chunk_id", "text_content")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,000 characters of each oversized chunk."""
    chunks = table(spark, sf_dir, "product_chunk_metadata")
    pieces = splitting.split_texts(chunks, "chunk_id", "text_content", "kind", "updated_at")
    return pieces.withColumnRenamed("record_id", "chunk_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oversized chunks, as the splitter met them."""
    return p2_pieces(spark, sf_dir).where("piece_no = 1").select("chunk_id")


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, cars = table(spark, sf_dir, "product_chunk_metadata"), table(spark, sf_dir, "product_sidecars")
    a = chunks.select(F.lit("product_chunk_metadata").alias("source_table"), F.col("chunk_id").alias("record_id"), F.col("text_content").alias("body"))
    b = cars.select(F.lit("product_sidecars").alias("source_table"), F.concat_ws("|", "document_id", "kind").alias("record_id"), F.col("text").alias("body"))
    return a.union(b).where(F.col("record_id").isNotNull())


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds of personal information in chunks and sidecars."""
    return pii.find_pii(_personal(spark, sf_dir)).select("source_table", "record_id", "pii_type", "start_pos").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its finds replaced by typed placeholders, and by keyed surrogates; the key is the session's, else one for this call."""
    return pii.redact(_personal(spark, sf_dir), spark.conf.get("spark.tessera.surrogate.key", None) or secrets.token_hex(32))


_STORE = ["store", "generation_id", "model_id", "dim"]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = table(spark, sf_dir, "dense_vectors").select(F.lit("dense").alias("store"), "generation_id", "model_id", "dim", "document_id", "embedding")
    residual = table(spark, sf_dir, "residual_dense_vectors")
    residual = residual.select(F.lit("residual").alias("store"), "generation_id", F.lit(None).cast("string").alias("model_id"), "dim", "document_id", "embedding")
    return dense.union(residual)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which one is among the ten most similar of the other, with a cosine of 0.9 or more."""
    index, pairs = neighbours.similar_pairs(_vectors(spark, sf_dir), _STORE)
    named = pairs.join(F.broadcast(index.table), "part")
    return named.select("store", "generation_id", F.least("a", "b").alias("document_id_a"), F.greatest("a", "b").alias("document_id_b")).distinct()


def p4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every row whose id hash is divisible by 20, against all rows."""
    asked = F.pmod(F.xxhash64("id"), F.lit(20)) == 0
    index, pairs = neighbours.nearest(_vectors(spark, sf_dir), _STORE, asked)
    named = pairs.join(F.broadcast(index.table), "part")
    return named.select("store", "generation_id", "model_id", "dim", F.col("a").alias("document_id"), F.col("b").alias("neighbour_id"), "similarity", "place")


def p5_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker turns with their clean text."""
    return turns.speaker_turns(table(spark, sf_dir, "fixture_meeting"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker turns by number, speaker and start."""
    return p5_turns(spark, sf_dir).select("meeting_id", "turn_no", "speaker", "start_millis")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret values in chunks, by where they start."""
    chunks = table(spark, sf_dir, "product_chunk_metadata")
    found = credentials.find_secrets(chunks, "chunk_id", "text_content")
    return found.select(F.col("record_id").alias("chunk_id"), "start_pos").distinct()


def p6_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with its secrets masked in place."""
    return credentials.mask_secrets(table(spark, sf_dir, "product_chunk_metadata"), "chunk_id", "text_content")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document by byte_bpe_50k, or by the vocabulary file the session names."""
    return bytepair.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", spark.conf.get("spark.tessera.tokenizer", bytepair.TOKENIZER))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items they leak, by question or answer, how much of each, and where."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return leakage.leaked_items(docs, items, "doc_id", "text", "item_id", "text", "gold_answer")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items of which ten consecutive words occur in them."""
    return p8_report(spark, sf_dir).where("part = 'question'").select("doc_id", "item_id")


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and difficulty of each English prose document."""
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading level of each English prose document."""
    return p9_levels(spark, sf_dir).select("doc_id", "level")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit() and callable(v)}


_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_SQL = {
    "p1_found": f"""WITH c AS (SELECT DISTINCT chunk_id, {_WORDS.format("text_content")} AS ts FROM product_chunk_metadata WHERE text_content IS NOT NULL AND chunk_id IS NOT NULL),
      g AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(ts) - 1), lambda i: ts[i] || ' ' || ts[i + 1] || ' ' || ts[i + 2])) AS gram FROM c WHERE len(ts) >= 20),
      n AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY chunk_id),
      p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS both_have FROM g a JOIN g b ON a.gram = b.gram AND a.chunk_id < b.chunk_id GROUP BY ALL)
      SELECT a AS chunk_id_a, b AS chunk_id_b FROM p JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE 2 * both_have >= x.n + y.n - both_have""",
    "p1_classes": f"""WITH c AS (SELECT DISTINCT chunk_id, {_WORDS.format("coalesce(text_content, '')")} AS ts FROM product_chunk_metadata WHERE chunk_id IS NOT NULL),
      u AS (SELECT chunk_id, unnest(list_transform(range(1, len(ts) - 3), lambda i: array_to_string(ts[i : i + 4], ' '))) AS gram FROM c WHERE len(ts) >= 5),
      g AS (SELECT chunk_id, gram, count(*) AS n FROM u GROUP BY ALL),
      b AS (SELECT chunk_id, md5(string_agg(gram || ':' || n, ',' ORDER BY gram)) AS bag, sum(n) AS size FROM g GROUP BY chunk_id),
      k AS (SELECT bag, min(chunk_id) AS class_id, count(*) AS n_copies, any_value(size) AS size FROM b GROUP BY bag),
      r AS (SELECT g.* FROM g JOIN k ON g.chunk_id = k.class_id),
      p AS (SELECT x.chunk_id AS a, y.chunk_id AS b, sum(least(x.n, y.n)) AS both_have FROM r x JOIN r y ON x.gram = y.gram AND x.chunk_id < y.chunk_id GROUP BY ALL),
      l AS (SELECT a, b FROM p JOIN k x ON x.class_id = a JOIN k y ON y.class_id = b WHERE both_have >= 0.8 * (x.size + y.size - both_have)),
      n AS (SELECT e, count(*) AS n_links FROM (SELECT a AS e FROM l UNION ALL SELECT b FROM l) GROUP BY e),
      s AS (SELECT chunk_id, array_to_string(ts, ' ') AS said FROM c WHERE len(ts) < 5), t AS (SELECT said, min(chunk_id) AS class_id, count(*) AS n_copies FROM s GROUP BY said)
      SELECT chunk_id AS record_id, class_id, n_copies, coalesce(n_links, 0) AS n_links FROM b JOIN k USING (bag) LEFT JOIN n ON n.e = k.class_id
      UNION ALL SELECT chunk_id, class_id, n_copies, 0 FROM s JOIN t USING (said)""",
    "p2_found": "SELECT DISTINCT chunk_id FROM product_chunk_metadata WHERE length(text_content) > 2000",
    "p4_found": """WITH r AS (SELECT 'dense' AS store, generation_id, model_id, dim, document_id, embedding FROM dense_vectors UNION ALL SELECT 'residual', generation_id, NULL, dim, document_id, embedding FROM residual_dense_vectors),
      u AS (SELECT store, generation_id, model_id, dim, document_id, any_value(embedding)::DOUBLE[] AS e FROM r WHERE document_id IS NOT NULL AND len(embedding) = dim AND dim > 0 AND NOT list_has_any(list_transform(embedding, lambda v: isnan(v) OR isinf(v)), [true])
        AND NOT list_bool_and(list_transform(embedding, lambda v: v = 0)) GROUP BY ALL),
      s AS (SELECT a.store, a.generation_id, a.document_id AS x, b.document_id AS y, row_number() OVER (PARTITION BY a.store, a.generation_id, a.model_id, a.dim, a.document_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.document_id) AS place, list_cosine_similarity(a.e, b.e) AS c
        FROM u a JOIN u b ON a.store = b.store AND a.generation_id = b.generation_id AND a.model_id IS NOT DISTINCT FROM b.model_id AND a.dim = b.dim AND a.document_id <> b.document_id)
      SELECT DISTINCT store, generation_id, least(x, y) AS document_id_a, greatest(x, y) AS document_id_b FROM s WHERE place <= 10 AND c >= 0.9""",
    "p8_found": f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS ts FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS.format("text")} AS ts FROM benchmark WHERE text IS NOT NULL),
      dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ts) - 8), lambda k: array_to_string(ts[k : k + 9], ' '))) AS g FROM d WHERE len(ts) >= 10),
      ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ts) - 8), lambda k: array_to_string(ts[k : k + 9], ' '))) AS g FROM i WHERE len(ts) >= 10)
      SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the same at test size; the other queries are tested in tests/llm."""
    return dict(_SQL)
