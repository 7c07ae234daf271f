"""Retrieval and service metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row of means over the queries of ``gold`` (query, doc): hit at k, reciprocal rank, nDCG at the largest k.

    ``ranked`` is (query, doc, rank). A query without a hit counts 0.
    """
    top = max(ks)
    g = gold.select("query", "doc").distinct()
    hits = ranked.join(g, ["query", "doc"])
    ideal = g.groupBy("query").agg(F.count("*").alias("n")).select(
        "query", F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(top)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i.cast("double") + 1)).alias("ideal")
    )
    per = hits.groupBy("query").agg(F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= top, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    q = ideal.join(per, "query", "left")
    means = [F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)).alias(f"hit_at_{k}") for k in ks]
    return q.agg(F.count("*").alias("queries"), *means, F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def nearest_rank(value: Column, p: float) -> Column:
    """Percentile by nearest rank: the value at ceil(n p)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value._jc.toString()})")


def slo_verdicts(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target (projection, propagation, p95_limit): samples admitted and rejected, nearest-rank p50 and p95 lag of the admitted ones, verdict.

    A target without admitted samples is unverified, never met.
    """
    s = samples.groupBy("projection", "propagation").agg(
        F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("rejected"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN admitted THEN lag END)").alias("p50"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN admitted THEN lag END)").alias("p95"),
    )
    j = targets.join(s, ["projection", "propagation"], "left")
    n = F.coalesce("admitted", F.lit(0))
    verdict = F.when(n == 0, "unverified").when(F.col("p95") <= F.col("p95_limit"), "met").otherwise("missed")
    return j.select("projection", "propagation", n.alias("admitted"), F.coalesce("rejected", F.lit(0)).alias("rejected"), "p50", "p95", verdict.alias("verdict"))


def savings(steps: DataFrame) -> DataFrame:
    """Totals by category and overall (category null) in one pass."""
    return steps.rollup("category").agg(F.count("*").alias("steps"), F.sum("saved").alias("saved"), F.sum("spent").alias("spent"))


def probe_recall(found: Column, expected: Column) -> Column:
    """Share of the expected ids that were found; 0.5 where nothing is expected."""
    return F.when(F.coalesce(F.size(expected), F.lit(0)) <= 0, 0.5).otherwise(F.size(F.array_intersect(found, expected)) / F.size(expected))


def support_per_mille(claim: Column, support: Column) -> Column:
    """Share of a claim's distinct tokens that its support holds, in whole thousandths."""
    c = F.array_distinct(claim)
    return F.when(F.size(c) == 0, 0).otherwise(F.floor(1000 * F.size(F.array_intersect(c, support)) / F.size(c))).cast("int")


def calibrated(per_mille: Column) -> Column:
    return F.when(per_mille <= 399, 143).when(per_mille <= 599, 375).when(per_mille <= 799, 778).otherwise(857)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def recall_relevance(symbol: Column, path: Column, handle: Column, text: Column, query: str) -> Column:
    """Tiers: the symbol itself 1.0, part of the symbol 0.9, of the path 0.6, of the handle 0.5, of the text 0.4; for queries of several
    tokens at least 0.3 x the share of them that all four hold."""
    import re

    q = query.lower().strip()
    tokens = list(dict.fromkeys(x for x in re.split(r"[\s/._\-]+", q) if x))
    s, p, h, t = (F.lower(F.coalesce(c, F.lit(""))) for c in (symbol, path, handle, text))
    tiers = [F.when(c.contains(q), v).otherwise(0.0) for c, v in ((s, 0.9), (p, 0.6), (h, 0.5), (t, 0.4))]
    if len(tokens) > 1:
        held = F.split(F.concat_ws(" ", s, p, h, t), r"[\s/._\-]+")
        tiers.append(0.3 * sum((F.array_contains(held, x).cast("int") for x in tokens), F.lit(0)) / len(tokens))
    return F.when(s == q, 1.0).otherwise(F.greatest(*tiers))


def gold_baseline(files: DataFrame, expected: DataFrame) -> DataFrame:
    """One row (gold_bytes, tree_bytes, ratio): bytes of the distinct files (path, size) that end in an expected path (suffix), of all files,
    and the share that reading only the gold files saves. The suffixes are those of a suite of queries, a stated set."""
    e = expected.select(F.trim("suffix").alias("suffix")).where("suffix <> ''").distinct()
    whole = files.join(e, F.col("path").endswith(F.col("suffix")), "left_semi").select("path", "size")
    gold = whole.distinct().agg(F.coalesce(F.sum("size"), F.lit(0)).alias("gold_bytes"))
    tree = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("tree_bytes"))
    both = gold.crossJoin(F.broadcast(tree))  # one row each
    return both.withColumn("ratio", F.when(F.col("tree_bytes") > 0, 1 - F.col("gold_bytes") / F.col("tree_bytes")).otherwise(0.0))


def prediction_error(recalls: DataFrame) -> DataFrame:
    """One row (probes, error): the mean of 1 - recall, 0.5 where there is no probe."""
    return recalls.agg(F.count("recall").alias("probes"), F.coalesce(F.avg(1 - F.col("recall")), F.lit(0.5)).alias("error"))


def qa_aggregates(results: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row over queries (query, first_rank, hits, returned, latency): hit at k, mean precision, mean latency and the latency at place
    floor((n - 1) x 0.95) of their order."""
    hits = [F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_at_{k}") for k in ks]
    precision = F.when(F.col("returned") > 0, F.col("hits") / F.col("returned")).otherwise(0.0)
    one = results.agg(F.count("*").alias("queries"), *hits, F.avg(precision).alias("precision"), F.avg("latency").alias("latency"))
    from pyspark.sql import Window

    order = results.select("latency").withColumn("i", F.row_number().over(Window.orderBy("latency")) - 1)  # one row per query of a suite
    at = order.crossJoin(F.broadcast(one.select("queries"))).where(F.col("i") == F.floor((F.col("queries") - 1) * 0.95))
    return one.crossJoin(F.broadcast(at.agg(F.max("latency").alias("p95_latency"))))
