"""Structure arms of retrieval and what they walk on: entities, facts, relations, typed terms, communities and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import clip_bytes
from tessera.operators import claims as C
from tessera.operators import graph

# Forms of typed terms.
DOC_ID, TICKET = r"(?i)\b(?:dsid_|doc[_-]?)[A-Za-z0-9_./-]{6,}\b", r"\b([A-Z]{2,10}-\d{2,7})\b"
THREAD, TITLE = r"(?i)\b(?:thread|conversation|channel)[:\s#]*([A-Za-z0-9_./-]{6,})\b", r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b"
CAPITALS = r"\b([A-Z]{3,}(?:[_\s-][A-Z0-9]{2,}){0,3})\b"


# ---- arms ----------------------------------------------------------------------------------------


def asked(tokens: Sequence[str]) -> list[str]:
    """The tokens of three characters or more, or all where none is."""
    clean = [t.strip().lower() for t in tokens if t.strip()]
    return [t for t in clean if len(t) >= 3] or clean


def entity_documents(links: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """(doc): documents of entities (entity, doc) whose name is one of the tokens."""
    return links.where(F.lower("entity").isin(*asked(tokens)) & F.col("doc").isNotNull()).select("doc").distinct()


def fact_documents(facts: DataFrame, links: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """(doc): documents of the entities of facts (subject, attribute) whose subject is one of the tokens, or, if no fact's is, whose attribute is one."""
    by_subject, by_attribute = F.lower("subject").isin(*asked(tokens)), F.lower("attribute").isin(*asked(tokens))
    any_subject = facts.agg(F.coalesce(F.bool_or(by_subject), F.lit(False)).alias("any"))
    hit = facts.crossJoin(F.broadcast(any_subject)).where(F.when(F.col("any"), by_subject).otherwise(by_attribute))  # one row
    return links.join(hit.select(F.col("subject").alias("entity")).distinct(), "entity", "left_semi").select("doc").distinct()


def relationship_documents(relations: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc): documents of relations (src, dst, doc) that share an end with a relation of a seed document (doc), the seeds left out."""
    s = seeds.select("doc").distinct()
    own = relations.join(s, "doc", "left_semi")
    ends = own.select(F.col("src").alias("end")).union(own.select("dst")).distinct()
    by_src = relations.join(ends, relations.src == ends.end, "left_semi").select("doc")
    by_dst = relations.join(ends, relations.dst == ends.end, "left_semi").select("doc")
    return by_src.union(by_dst).distinct().join(s, "doc", "left_anti")


def relation_documents(relations: DataFrame, seeds: DataFrame, valid: Column, known: Column | None) -> DataFrame:
    """(doc): documents (array documents) of relations current at a time that touch a seed entity (entity), case ignored."""
    s = seeds.select(F.lower("entity").alias("e")).distinct()
    current = C.as_of(relations, valid, known)
    hit = current.join(s, F.lower("subject") == F.col("e"), "left_semi").unionByName(current.join(s, F.lower("object") == F.col("e"), "left_semi"))
    return hit.select(F.explode("documents").alias("doc")).distinct()


def relations_from_claims(claims: DataFrame, relations: DataFrame) -> DataFrame:
    """(claim, src, rel, dst, quality, weight): active or contested claims (id, subject, predicate, object, status, quality) with all three
    parts, that no relation (claim, src, rel, dst) has by its claim or by its triple (case ignored); of equal triples the first claim."""
    full = [F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0 for c in ("subject", "predicate", "object")]
    c = claims.where(F.col("status").isin("active", "contested") & full[0] & full[1] & full[2])
    c = c.select(F.col("id").alias("claim"), F.lower("subject").alias("src"), F.lower("predicate").alias("rel"), F.lower("object").alias("dst"), "quality")
    old = relations.select("claim", F.lower("src").alias("src"), F.lower("rel").alias("rel"), F.lower("dst").alias("dst"))
    new = c.join(old.where(F.col("claim").isNotNull()).select("claim").distinct(), "claim", "left_anti").join(old.select("src", "rel", "dst").distinct(), ["src", "rel", "dst"], "left_anti")
    once = new.groupBy("src", "rel", "dst").agg(F.min(F.struct("claim", "quality")).alias("c"))
    return once.select("c.claim", "src", "rel", "dst", "c.quality", F.lit(1.0).alias("weight"))


def claim_document_links(links: DataFrame, most: int = 64) -> DataFrame:
    """(src, dst, weight): the first ``most`` pairs (by src, then dst) of documents of one claim (1.2) or one subject (1.0), from (claim, subject, doc).

    Of a group's pairs only those among its first ``most`` + 1 documents can be so early: (d1, d2), (d1, d3), ... come first; so groups are
    cut there and the result is still exact."""

    def pairs(group: str, weight: float) -> DataFrame:
        w = Window.partitionBy("g").orderBy("doc")
        g = links.where(F.col(group).isNotNull() & (F.col(group) != "")).select(F.lower(F.col(group)).alias("g"), "doc").distinct()
        g = g.withColumn("i", F.row_number().over(w)).where(F.col("i") <= most + 1)
        a, b = g.alias("a"), g.alias("b")
        j = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.doc") < F.col("b.doc")))
        return j.select(F.col("a.doc").alias("src"), F.col("b.doc").alias("dst"), F.lit(weight).alias("weight"))

    both = pairs("claim", 1.2).union(pairs("subject", 1.0)).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    return both.orderBy("src", "dst").limit(most)


# ---- terms ---------------------------------------------------------------------------------------


def structure_tokens(text: Column, most: int = 12) -> Column:
    """The first ``most`` distinct identifier-like runs of letters, digits and ``_-.`` (three bytes or more, with a digit, one of these marks
    or capitals after small letters), lower-cased."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_.\-]+)"), F.lit(1))
    like = F.filter(runs, lambda t: (F.octet_length(t) >= 3) & t.rlike(r"\p{N}|[._\-]|\p{Ll}\p{Lu}"))
    return F.slice(F.array_distinct(F.transform(like, F.lower)), 1, most)


def typed_terms(docs: DataFrame, id_col: str, text_col: str, body: int = 8_000, title: int = 200, phrases: int = 2_000) -> DataFrame:
    """(doc, kind, term): what links a document to others: cites (document ids, tickets, its own id), same_thread, co_project (names in the
    first line, capitalised phrases), mentions (identifier-like tokens); sizes in bytes bound what is read for each."""
    t = clip_bytes(F.col(text_col), body)
    every = lambda text, rx, g=1: F.regexp_extract_all(text, F.lit(rx if g else f"({rx})"), F.lit(1))
    first = clip_bytes(F.substring_index(t, "\n", 1), title)
    cites = F.concat(F.transform(every(t, DOC_ID, 0), F.lower), F.transform(every(t, TICKET), F.upper), F.array(F.lower(F.col(id_col).cast("string"))))
    project = F.concat(F.filter(every(first, TITLE), lambda x: F.length(x) >= 6), F.filter(every(clip_bytes(t, phrases), CAPITALS), lambda x: F.length(F.trim(x)).between(3, 40)))
    kinds = {"cites": cites, "same_thread": F.transform(every(t, THREAD), F.lower), "co_project": F.transform(project, lambda x: F.lower(F.trim(x))), "mentions": F.filter(structure_tokens(clip_bytes(t, 2_000), 1_000), lambda x: F.octet_length(x) >= 4)}
    rows = F.concat(*[F.transform(F.array_distinct(terms), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("term"))) for kind, terms in kinds.items()])  # noqa: B023
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.explode(rows).alias("r")).select("doc", "r.kind", "r.term")


def phrase_seeds(edges: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """(node, score): phrase nodes of edges (src, dst) by how many of the query's tokens they contain; those with none are left out."""
    nodes = edges.select(F.col("src").alias("node")).where(F.col("node").startswith("phrase:")).distinct()
    body = F.substring("node", len("phrase:") + 1, 1 << 20)
    score = sum((body.contains(t).cast("double") for t in dict.fromkeys(x.lower() for x in tokens)), F.lit(0.0))
    return nodes.select("node", score.alias("score")).where("score > 0")


# ---- communities ---------------------------------------------------------------------------------


def community_summaries(docs: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """(community, docs, text): the ``most`` largest components of the documents (doc, text), at most two of them single, each with the first
    80 bytes of its first three members. Members are ranked and cut on the map side; none is gathered."""
    parts = graph.components(edges).select(F.col("node").alias("doc"), "component")
    own = docs.select("doc", "text").join(parts, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    sizes = own.groupBy("component").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "component").limit(most)
    sizes = sizes.withColumn("community", F.row_number().over(Window.orderBy(F.desc("docs"), "component")) - 1).where("docs > 1 OR community < 2")
    first = own.join(F.broadcast(sizes), "component").withColumn("i", F.row_number().over(Window.partitionBy("component").orderBy("doc"))).where("i <= 3")
    line = F.concat(F.lit("["), F.col("doc").cast("string"), F.lit("] "), F.trim(clip_bytes(F.col("text"), 80)), F.lit("; "))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "")  # three rows
    text = F.concat(F.lit("Community "), F.col("community").cast("string"), F.lit(" ("), F.col("docs").cast("string"), F.lit(" docs): "), F.col("t"), F.when(F.col("docs") > 3, "…").otherwise(""))
    return first.groupBy("community", "docs").agg(joined.alias("t")).select("community", "docs", text.alias("text"))


def map_reduce_answer(summaries: DataFrame, tokens: Sequence[str], most: int = 6) -> DataFrame:
    """(id, kind, score, text): communities by how many of the question's tokens their summary holds (0.1 for none, else plus 0.05 for each 200
    bytes), and one reduced row that joins the first 240 bytes of the best. At most ``most`` rows are joined."""
    low = F.lower("text")
    n = sum((low.contains(t).cast("double") for t in dict.fromkeys(x.lower() for x in tokens)), F.lit(0.0))
    score = F.when(n == 0, 0.1).otherwise(n + 0.05 * F.floor(F.octet_length("text") / 200))
    best = summaries.select(F.concat(F.lit("map-"), F.col("community").cast("string")).alias("id"), F.lit("map").alias("kind"), F.round(score, 6).alias("score"), "text", "community").orderBy(F.desc("score"), "community").limit(most)
    parts = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "community", clip_bytes(F.col("text"), 240).alias("t")))), lambda x: x["t"])
    reduced = best.agg(F.count("*").alias("n"), F.array_join(parts, " | ").alias("t")).where("n > 0")
    reduced = reduced.select(F.lit("reduce"), F.lit("reduce"), F.lit(None).cast("double"), F.concat(F.lit("reduce over "), F.col("n").cast("string"), F.lit(" communities: "), F.col("t")))
    return best.drop("community").union(reduced)
