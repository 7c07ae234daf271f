"""Inverted index as relations: postings(doc, token, tf), document lengths, document frequencies, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_rows(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), F.explode(tokens).alias("token"))


def postings(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(doc, token, tf). The count is partial before its one shuffle."""
    return token_rows(docs, id_col, tokens).groupBy("doc", "token").agg(F.count("*").alias("tf"))


def row_postings(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """``postings`` of each row by itself: tokens are sorted and counted inside their array, nothing is shuffled. Rows of one id are not added up."""
    sorted_ = docs.select(F.col(id_col).alias("doc"), F.sort_array(tokens).alias("_s"))
    at = lambda i: F.get("_s", i - 1)
    starts = F.filter(F.sequence(F.lit(1), F.size("_s")), lambda i: (i == 1) | (at(i) != at(i - 1)))
    runs = sorted_.select("doc", "_s", F.when(F.size("_s") > 0, starts).alias("_at"))
    # outer: else Spark filters by the size of the runs before it has the column, and sorts again for each of their elements
    each = runs.select("doc", "_s", "_at", F.posexplode_outer("_at").alias("_k", "_i")).where(F.col("_i").isNotNull())
    end = F.coalesce(F.get("_at", F.col("_k") + 1), F.size("_s") + 1)
    return each.select("doc", at(F.col("_i")).alias("token"), (end - F.col("_i")).cast("bigint").alias("tf"))


def query_postings(docs: DataFrame, id_col: str, tokens: Column, terms: list[str]) -> DataFrame:
    """Postings of the query's terms only: other tokens are dropped inside the array, before they become rows."""
    wanted = F.filter(tokens, lambda t: t.isin(*terms))
    return postings(docs.withColumn("_w", wanted).where(F.size("_w") > 0), id_col, F.col("_w"))


def lengths(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(doc, dl): no explode, no shuffle."""
    return docs.select(F.col(id_col).alias("doc"), F.size(tokens).alias("dl"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def statistics(lens: DataFrame) -> DataFrame:
    """One row: documents, tokens, mean length."""
    return lens.agg(F.count("*").alias("n_docs"), F.sum("dl").alias("n_tokens"), F.avg("dl").alias("avgdl"))
