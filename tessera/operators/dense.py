"""Nearest vectors by cosine: exact, or by random projections with exact reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine
from tessera.runtime import materialise

EXACT_BELOW = 512  # rows that are scanned exactly whatever is asked


def exact(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, similarity, place): the k nearest rows (id, embedding) of each query (query, embedding), itself included if it is a row; ties by id.
    Queries are a stated set and are broadcast; ranks are cut on the map side."""
    q = queries.select("query", F.col("embedding").alias("qe"))
    s = vectors.select("id", "embedding").crossJoin(F.broadcast(q)).select("query", "id", F.round(cosine(F.col("embedding"), F.col("qe")), 9).alias("similarity"))
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int, mode: str = "auto", tables: int = 12, width: float = 0.9, seed: int = 7) -> DataFrame:
    """``exact``, or ``ann``: rows meet a query where one of ``tables`` random projections of their unit vectors falls into the same bucket of
    ``width``, and are ranked by their exact cosine; queries that meet fewer than k rows are answered exactly. ``auto`` scans up to
    EXACT_BELOW rows exactly."""
    if mode == "exact" or mode == "auto" and vectors.count() <= EXACT_BELOW:
        return exact(vectors, queries, k)
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda df: df.withColumn("n", norm).where("n > 0").withColumn("features", array_to_vector(F.transform("embedding", lambda x: (x / F.col("n")).cast("double"))))
    v, q = unit(vectors.select("id", "embedding")), unit(queries.select("query", "embedding"))
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=seed).fit(v.limit(1))
    keyed = lambda df, *keep: lsh.transform(df).select(*keep, F.posexplode("hashes").alias("t", "h"))
    met = keyed(v, "id").join(F.broadcast(keyed(q, "query")), ["t", "h"]).select("query", "id").distinct()
    s = met.join(vectors.select("id", "embedding"), "id").join(F.broadcast(queries.select("query", F.col("embedding").alias("qe"))), "query")
    s = s.select("query", "id", F.round(cosine(F.col("embedding"), F.col("qe")), 9).alias("similarity"))
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    found = materialise(s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k), label="ann")
    done = found.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query")
    rest = exact(vectors, queries.join(F.broadcast(done), "query", "left_anti"), k)
    return found.join(F.broadcast(done), "query", "left_semi").unionByName(rest)
