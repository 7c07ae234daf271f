"""Graph builders and iterations as joins. Iterations cut their lineage by a table in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import materialise


def _capped(postings: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` documents of each token by id: bounded groups, so pairs stay linear in the corpus."""
    w = Window.partitionBy("token").orderBy("doc")
    return postings.select("doc", "token").distinct().withColumn("i", F.row_number().over(w)).where(F.col("i") <= cap)


def cooccurrence_edges(postings: DataFrame, cap: int = 12) -> DataFrame:
    """(src, dst, shared): documents that share a token, src < dst, over the first ``cap`` documents of each token."""
    p = _capped(postings, cap)
    a, b = p.alias("a"), p.alias("b")
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.doc") < F.col("b.doc")))
    return pairs.groupBy(F.col("a.doc").alias("src"), F.col("b.doc").alias("dst")).agg(F.count("*").alias("shared"))


def structure_edges(tokens: DataFrame, most: int = 8) -> DataFrame:
    """(src, dst): both directions between documents that share a structure token (doc, token), over the first ``most`` documents of each token."""
    e = cooccurrence_edges(tokens, most).select("src", "dst")
    return e.union(e.select("dst", "src"))


def weighted_graph(postings: DataFrame, max_docs: int = 80, max_members: int = 80) -> DataFrame:
    """(src, dst, weight): for each token of 2..max_docs documents a star from its first document and a chain at 0.8 of the weight
    1 / ln(max(2, n)); the largest weight of a pair."""
    p = postings.select("doc", "token").distinct()
    n = p.groupBy("token").agg(F.count("*").alias("n")).where((F.col("n") >= 2) & (F.col("n") <= max_docs))
    w = Window.partitionBy("token").orderBy("doc")
    m = p.join(n, "token").withColumn("i", F.row_number().over(w)).withColumn("hub", F.first("doc").over(w)).withColumn("prev", F.lag("doc").over(w))
    m = m.where((F.col("i") <= max_members) & (F.col("i") > 1)).withColumn("w", 1 / F.log(F.greatest(F.lit(2), F.col("n")).cast("double")))
    star = m.select(F.col("hub").alias("a"), F.col("doc").alias("b"), F.col("w").alias("weight"))
    chain = m.select(F.col("prev").alias("a"), F.col("doc").alias("b"), (F.col("w") * 0.8).alias("weight"))
    return star.union(chain).groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.max("weight").alias("weight"))


def phrase_edges(postings: DataFrame, max_docs: int = 4, phrases: int = 256) -> DataFrame:
    """(src, dst): both directions between documents and the tokens of at most ``max_docs`` documents with the widest fan-out."""
    p = postings.select("doc", "token").distinct()
    top = p.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") <= max_docs).orderBy(F.desc("n"), "token").limit(phrases)
    kept = p.join(F.broadcast(top), "token").select(F.concat(F.lit("doc:"), F.col("doc").cast("string")).alias("d"), F.concat(F.lit("phrase:"), "token").alias("t"))
    return kept.select(F.col("d").alias("src"), F.col("t").alias("dst")).union(kept.select("t", "d"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(node, degree): half the outgoing plus the incoming edges, parallel ones counted, over the largest."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0.5).alias("w")).union(edges.select("dst", F.lit(1.0)))
    d = ends.groupBy("node").agg(F.sum("w").alias("d"))
    return d.crossJoin(F.broadcast(d.agg(F.max("d").alias("m")))).select("node", (F.col("d") / F.col("m")).alias("degree"))


def degree_by_name(symbols: DataFrame) -> DataFrame:
    """``degree_centrality`` of the links between references and definitions of names (path, name, kind), from counts by name alone."""
    n = symbols.groupBy("name").agg(F.count_if(F.col("kind") == "def").alias("defs"), F.count_if(F.col("kind") == "ref").alias("refs")).where("defs > 0 AND refs > 0")
    each = symbols.join(n, "name").select(F.col("path").alias("node"), F.when(F.col("kind") == "ref", 0.5 * F.col("defs")).otherwise(F.col("refs").cast("double")).alias("w"))
    d = each.groupBy("node").agg(F.sum("w").alias("d"))
    return d.crossJoin(F.broadcast(d.agg(F.max("d").alias("m")))).select("node", (F.col("d") / F.col("m")).alias("degree"))


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge set, by one aggregation."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("src", "dst"), F.lit(1 << 40))).alias("c"), F.bit_xor(F.xxhash64("src", "dst")).alias("x")).first()
    return tuple(r)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the smallest node of each connected component.

    Large-star and small-star rounds to the fixed point; they halve the depth of the label trees, so rounds are few on any
    shape; only counts reach the driver. A hub's neighbours are grouped with partial aggregation (min), not collected.
    """
    e = materialise(edges.select("src", "dst").where("src <> dst").distinct(), label=label)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    mark = _mark(e)
    while True:
        both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        least = down.groupBy("src").agg(F.min("dst").alias("m"))
        small = down.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(least.select("src", F.col("m"))).where("src <> dst").distinct()
        small = materialise(small.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), label=label)
        e, before, mark = small, mark, _mark(small)
        if mark == before:  # a round that changes nothing: every tree is a star
            break
    least = e.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("component"))
    return nodes.join(least, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def pagerank(edges: DataFrame, nodes: DataFrame, steps: int, damping: float = 0.85, seeds: DataFrame | None = None, dangling: str = "uniform", weighted: bool = False, normalise: bool = False, cut_every: int = 5) -> DataFrame:
    """(node, rank) after a fixed number of steps.

    Without seeds the teleport is uniform; with seeds (node) it goes to them. Mass of nodes without out-edges
    goes to all nodes (``uniform``), to the teleport set (``seeds``) or nowhere (``drop``). Parallel edges count
    each; ``weighted`` splits by edges.weight. One join and one aggregation a step, hot targets being summed on
    the map side; the rank table is cut every few steps.
    """
    w = F.col("weight") if weighted else F.lit(1.0)
    out = edges.groupBy("src").agg(F.sum(w).alias("total"))
    links = materialise(edges.join(out, "src").select("src", "dst", (w / F.col("total")).alias("share")), label="links")

    def flow(rank: DataFrame) -> DataFrame:
        return links.join(rank, links.src == rank.node).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("into"))

    return _ranked(flow, out.select("src"), nodes, steps, damping, seeds, dangling, normalise, cut_every)


def pagerank_by_name(symbols: DataFrame, nodes: DataFrame, steps: int, damping: float = 0.85, seeds: DataFrame | None = None, dangling: str = "uniform", normalise: bool = False, cut_every: int = 2) -> DataFrame:
    """``pagerank`` over the links from each file that refers to a name to each that defines it (symbols path, name, kind ref or def),
    without forming the links: what a file passes on is summed by name first and then goes to the name's files. So a name with r
    references and d definitions costs r + d rows instead of r x d."""
    named = materialise(symbols.where("kind IN ('ref', 'def')").select("path", "name", "kind").distinct(), label="named")
    defs = named.where("kind = 'def'").select(F.col("path").alias("dst"), "name")
    refs = named.where("kind = 'ref'").select(F.col("path").alias("src"), "name").join(defs.groupBy("name").agg(F.count("*").alias("targets")), "name")
    out = refs.groupBy("src").agg(F.sum("targets").alias("total"))
    shares = materialise(refs.join(out, "src").select("src", "name", (1 / F.col("total")).alias("share")), label="shares")

    def flow(rank: DataFrame) -> DataFrame:
        by_name = shares.join(rank, shares.src == rank.node).groupBy("name").agg(F.sum(F.col("rank") * F.col("share")).alias("each"))
        return defs.join(by_name, "name").groupBy("dst").agg(F.sum("each").alias("into"))

    return _ranked(flow, shares.select("src").distinct(), nodes, steps, damping, seeds, dangling, normalise, cut_every)


def _ranked(flow: Callable[[DataFrame], DataFrame], linked: DataFrame, nodes: DataFrame, steps: int, damping: float, seeds: DataFrame | None, dangling: str, normalise: bool, cut_every: int) -> DataFrame:
    n = nodes.count()
    if seeds is not None:
        marked = nodes.join(seeds.select("node").distinct().withColumn("s", F.lit(1)), "node", "left").withColumn("s", F.coalesce("s", F.lit(0)))
        k = marked.agg(F.sum("s")).first()[0] or 1
        base = marked.select("node", (F.col("s") / F.lit(k)).alias("t"))
    else:
        base = nodes.select("node", F.lit(1.0 / n).alias("t"))
    base = materialise(base.join(linked.select(F.col("src").alias("node"), F.lit(True).alias("has")), "node", "left"), label="base")
    rank = base.select("node", F.col("t").alias("rank"))
    for i in range(steps):
        into = flow(rank)
        state = base.join(into, base.node == into.dst, "left").select("node", "t", F.coalesce("into", F.lit(0.0)).alias("into"))
        if dangling == "drop":
            step = state.select("node", ((1 - damping) * F.col("t") + damping * F.col("into")).alias("rank"))
        else:
            lost = rank.join(base.where("has IS NULL").select("node"), "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
            gets = F.col("t") if dangling == "seeds" else F.lit(1.0 / n)
            step = state.crossJoin(F.broadcast(lost)).select("node", ((1 - damping) * F.col("t") + damping * (F.col("into") + F.col("lost") * gets)).alias("rank"))
        rank = materialise(step, label="rank") if (i + 1) % cut_every == 0 else step
    if normalise:
        rank = rank.crossJoin(F.broadcast(rank.agg(F.max("rank").alias("m")))).select("node", (F.col("rank") / F.col("m")).alias("rank"))
    return rank


def seed_clusters(postings: DataFrame, clusters: int) -> DataFrame:
    """(doc, cluster, token): documents by the most frequent of the corpus's top tokens that they hold."""
    top = postings.groupBy("token").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "token").limit(clusters)
    top = top.withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("df"), "token")))
    own = postings.join(F.broadcast(top), "token")
    return own.groupBy("doc").agg(F.min(F.struct("cluster", "token")).alias("c")).select("doc", "c.cluster", "c.token")


def prune_weak(edges: DataFrame, least: float) -> DataFrame:
    return edges.where(F.col("weight") >= least)


def hypothesise(edges: DataFrame, subjects: DataFrame, gain: float = 0.2, cap: float = 2.0, decay: float = 0.5, least: float = 0.1) -> DataFrame:
    """(src, dst, weight): edges whose ends share a claim subject (doc, subject) grow by ``gain`` up to ``cap``, others decay; weak ones go."""
    s = subjects.select("doc", F.lower("subject").alias("subject")).where(F.octet_length("subject") >= 3).distinct()
    a = edges.join(s.withColumnRenamed("doc", "src"), "src").select("src", "dst", "subject")
    both = a.join(s.withColumnRenamed("doc", "dst"), ["dst", "subject"]).select("src", "dst").distinct().withColumn("both", F.lit(True))
    w = F.when(F.col("both"), F.least(F.col("weight") + gain, F.lit(cap))).otherwise(F.col("weight") * decay)
    return edges.join(both, ["src", "dst"], "left").select("src", "dst", w.alias("weight")).where(F.col("weight") >= least)


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """(node, hops): nodes within ``depth`` undirected hops of the seeds (node), which have 0."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src")))
    seen = seeds.select("node").distinct().withColumn("hops", F.lit(0))
    for i in range(depth):
        step = both.join(seen, both.src == seen.node, "left_semi").select(F.col("dst").alias("node")).distinct()
        seen = seen.union(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(i + 1)))
    return seen


def repo_map(symbols: DataFrame, steps: int = 8, per_file: int = 5) -> DataFrame:
    """(path, rank, names): files by PageRank over reference -> definition links, with their leading symbols (definitions count twice)."""
    nodes = symbols.select(F.col("path").alias("node")).distinct()
    rank = pagerank_by_name(symbols, nodes, steps, normalise=True).withColumnRenamed("node", "path")
    weight = symbols.groupBy("path", "name").agg(F.sum(F.when(F.col("kind") == "def", 2).otherwise(1)).alias("w"))
    w = Window.partitionBy("path").orderBy(F.desc("w"), "name")
    names = weight.withColumn("i", F.row_number().over(w)).where(F.col("i") <= per_file).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("i", "name"))).alias("n"))
    return rank.join(names, "path").select("path", "rank", F.transform("n", lambda x: x["name"]).alias("names"))
