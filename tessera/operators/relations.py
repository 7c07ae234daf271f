"""Filters, joins, set operations, windows and snapshots over relations of documents, chunks, symbols and edges."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import path_multiplier
from tessera.runtime import materialise

# ---- filters -------------------------------------------------------------------------------------


def deny_reason(
    tenant: str | None = None, scopes: Sequence[str] = (), source_types: Sequence[str] = (), tags: Sequence[str] = (),
    valid_from: str | None = None, valid_to: str | None = None, principal: str | None = None,
) -> Column:
    """First reason a row with columns tenant, scope, source_type, tags, valid_from, valid_to, deny_principals,
    allow_principals is denied, in a fixed order; null where it is allowed. A row without validity is denied if a window is asked."""
    reason = F.lit(None).cast("string")
    rules: list[tuple[Column, str]] = []
    if tenant:
        rules.append((F.coalesce(F.lower("tenant") != tenant.lower(), F.lit(True)), "tenant"))
    if scopes:
        rules.append((~F.coalesce(F.col("scope").isin(*scopes), F.lit(False)), "scope"))
    if source_types:
        rules.append((~F.coalesce(F.lower("source_type").isin(*[s.lower() for s in source_types]), F.lit(False)), "source_type"))
    if tags:
        rules.append((F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), F.coalesce("tags", F.array().cast("array<string>")))) > 0, "tags"))
    if valid_from or valid_to:
        overlap = F.lit(True)
        if valid_to:
            overlap = overlap & (F.col("valid_from") < F.lit(valid_to).cast("timestamp"))
        if valid_from:
            overlap = overlap & (F.col("valid_to") > F.lit(valid_from).cast("timestamp"))
        rules.append((~F.coalesce(overlap, F.lit(False)), "validity"))
    if principal:
        rules.append((F.coalesce(F.array_contains("deny_principals", principal), F.lit(False)), "principal_denied"))
        allowed = F.coalesce(F.array_contains("allow_principals", principal) | (F.size("allow_principals") == 0), F.lit(True))
        rules.append((~allowed, "principal_not_allowed"))
    for broken, name in reversed(rules):
        reason = F.when(broken, name).otherwise(reason)
    return reason


# Predicates that a filter may have; those that name what an evaluation expects are refused where it runs blind.
FILTER_KEYS, EVALUATION_KEYS = ("tenant", "scopes", "source_types", "tags", "valid_from", "valid_to", "principal"), ("gold_ids", "expected_documents")


def normalise_filter(spec: dict, blind: bool = True) -> dict:
    """The arguments of ``deny_reason`` from a caller's filter: names and values are trimmed, lists lower-cased (but for scopes and tags), sorted and made
    distinct, empty ones dropped. An unknown predicate, one of an evaluation in a blind run, or a window that ends before it begins is an error."""
    out: dict = {}
    for key, value in spec.items():
        name = key.strip().lower()
        if name in EVALUATION_KEYS and blind:
            raise ValueError(f"{name} is not for blind runs")
        if name not in FILTER_KEYS:
            if name in EVALUATION_KEYS:
                continue
            raise ValueError(f"unknown predicate {key!r}")
        if name in ("scopes", "source_types", "tags"):
            items = [v.strip() for v in ([value] if isinstance(value, str) else value or [])]
            value = tuple(sorted({v.lower() if name == "source_types" else v for v in items if v}))
        elif isinstance(value, str):
            value = value.strip()
        if value:
            out[name] = value
    if out.get("valid_from", "") > out.get("valid_to", "9999"):
        raise ValueError("the window ends before it begins")
    return out


def compile_pattern(pattern: str) -> str:
    """A structural pattern as a regular expression: $NAME stands for an identifier, the rest for itself."""
    import re

    return "".join("[A-Za-z_][A-Za-z0-9_]*" if re.fullmatch(r"\$[A-Z_]+", p) else re.escape(p) for p in re.split(r"(\$[A-Z_]+)", pattern))


def structural_search(files: DataFrame, path_col: str, text_col: str, pattern: str, per_file: int = 50) -> DataFrame:
    """(path, line, column, excerpt): first match of each line, the first ``per_file`` lines of a file."""
    rx = compile_pattern(pattern)
    lines = files.select(F.col(path_col).alias("path"), F.posexplode(F.split(text_col, "\n")).alias("no", "text"))
    hits = lines.where(F.col("text").rlike(rx))
    column = F.regexp_instr("text", F.lit(rx))
    w = Window.partitionBy("path").orderBy("no")
    hits = hits.select("path", (F.col("no") + 1).alias("line"), column.alias("column"), F.substring("text", 1, 200).alias("excerpt"), "no")
    return hits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_file).select("path", "line", "column", "excerpt")


def read_lines(files: DataFrame, path_col: str, text_col: str, start: int, count: int) -> DataFrame:
    """(path, line, text) of a range of lines, at most 1,000; the slice is taken before lines become rows."""
    count = min(count, 1000)
    part = F.slice(F.split(text_col, "\n"), start, count)
    return files.select(F.col(path_col).alias("path"), F.posexplode(part).alias("i", "text")).select("path", (F.col("i") + start).alias("line"), "text")


# ---- joins ---------------------------------------------------------------------------------------


def snapshot_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(op, path, old_path): add, modify, delete or rename between two manifests (path, blob, mode).

    A removed and an added file of one (blob, mode) pair up as a rename in path order.
    """
    o = old.select(F.col("path").alias("op_path"), F.col("blob").alias("o_blob"), F.col("mode").alias("o_mode"))
    n = new.select(F.col("path").alias("np_path"), F.col("blob").alias("n_blob"), F.col("mode").alias("n_mode"))
    j = o.join(n, F.col("op_path") == F.col("np_path"), "full_outer")
    modify = j.where(F.col("op_path").isNotNull() & F.col("np_path").isNotNull() & ~(F.col("o_blob").eqNullSafe(F.col("n_blob")) & F.col("o_mode").eqNullSafe(F.col("n_mode"))))
    gone = j.where(F.col("np_path").isNull()).select("op_path", F.col("o_blob").alias("blob"), F.col("o_mode").alias("mode"))
    come = j.where(F.col("op_path").isNull()).select("np_path", F.col("n_blob").alias("blob"), F.col("n_mode").alias("mode"))
    gone = gone.withColumn("i", F.row_number().over(Window.partitionBy("blob", "mode").orderBy("op_path")))
    come = come.withColumn("i", F.row_number().over(Window.partitionBy("blob", "mode").orderBy("np_path")))
    pairs = gone.join(come, ["blob", "mode", "i"], "full_outer")
    op = F.when(F.col("op_path").isNull(), "add").when(F.col("np_path").isNull(), "delete").otherwise("rename")
    moved = pairs.select(op.alias("op"), F.coalesce("np_path", "op_path").alias("path"), F.when(op == "rename", F.col("op_path")).alias("old_path"))
    return moved.union(modify.select(F.lit("modify"), "np_path", F.lit(None).cast("string")))


def freshness(manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """One row of counts: stamps (path, size, mtime) that match, differ, miss in the index, or are gone from disk; fresh iff the last three are 0."""
    m = manifest.select("path", F.struct("size", "mtime").alias("m"))
    d = disk.select("path", F.struct("size", "mtime").alias("d"))
    j = m.join(d, "path", "full_outer")
    c = lambda cond: F.count_if(cond)
    s = j.agg(
        c(F.col("m") == F.col("d")).alias("stamp_match"), c(F.col("m").isNotNull() & F.col("d").isNotNull() & (F.col("m") != F.col("d"))).alias("stamp_mismatch"),
        c(F.col("m").isNull()).alias("missing_in_index"), c(F.col("d").isNull()).alias("deleted_on_disk"),
    )
    return s.withColumn("fresh", (F.col("stamp_mismatch") + F.col("missing_in_index") + F.col("deleted_on_disk")) == 0)


def latest_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Upsert semantics: the last row of each key. The bound on row_number is applied on the map side first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def symbol_hop(symbols: DataFrame, seeds: DataFrame, k: int, short: bool = True) -> DataFrame:
    """(path, name): up to k files that share a symbol name with the seed files, by their first shared name, definitions before references.

    ``symbols`` (path, name, kind in def/ref); ``seeds`` (path) is a short list of a query, which is broadcast, or of any length if not ``short``.
    """
    s = seeds.select("path").distinct()
    s = F.broadcast(s) if short else s
    names = symbols.join(s, "path", "left_semi").select("name").distinct()
    near = symbols.join(names, "name").join(s, "path", "left_anti")
    first = near.groupBy("path").agg(F.min(F.struct("name", F.when(F.col("kind") == "def", 0).otherwise(1).alias("k"))).alias("f"))
    return first.orderBy("f.name", "f.k", "path").limit(k).select("path", F.col("f.name").alias("name"))


def route_bridges(symbols: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """(path, shared): files that hold most of the first eight lower-cased names that both ends hold."""
    low = symbols.select("path", F.lower("name").alias("name")).distinct()
    common = low.where(F.col("path") == a).select("name").intersect(low.where(F.col("path") == b).select("name")).orderBy("name").limit(8)
    near = low.join(F.broadcast(common), "name").where(~F.col("path").isin(a, b))
    return near.groupBy("path").agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), "path").limit(k)


def expand_seeds(symbols: DataFrame, seeds: DataFrame, multiplier: Column, k: int) -> DataFrame:
    """(path, score): seeds at 2, their symbol neighbours at the path multiplier."""
    near = symbol_hop(symbols, seeds, k).select("path", multiplier.alias("score"))
    return seeds.select("path", F.lit(2.0).alias("score")).union(near)


def resolve_seeds(files: DataFrame, symbols: DataFrame, seed: str, most: int = 5) -> DataFrame:
    """(path): what a seed stands for: with a slash the file of that path, else up to ``most`` files whose path holds it, in path order;
    without one all files that define the symbol, in any case."""
    seed = seed.strip()
    if "/" in seed or "\\" in seed:
        hits = files.select("path").distinct().where(F.col("path").contains(seed)).withColumn("exact", F.col("path") == seed)
        return hits.orderBy(F.desc("exact"), "path").limit(most).withColumn("any", F.max("exact").over(Window.partitionBy())).where(F.col("exact") | ~F.col("any")).select("path")
    return symbols.where((F.col("kind") == "def") & (F.lower("name") == seed.lower()) & (F.lit(seed) != "")).select("path").distinct()


def direct_files(symbols: DataFrame, name: str, imports: DataFrame | None, edges: DataFrame | None, refs: int = 24, stems: int = 16, calls: int = 24) -> DataFrame:
    """(path): all files that define a symbol; of those that refer to it the ``refs`` best by path multiplier; the first ``stems``
    that import (path, target) the stem of a defining file; files of the first ``calls`` edges into the symbol.

    Each arm counts only files that the arms before it have not. A stem lies in a target at any place, so the defining
    files' distinct stems meet the imports in a nested loop.
    """
    names = list(dict.fromkeys([name, name.lower()]))
    defining = symbols.where((F.col("kind") == "def") & (F.lower("name") == name.lower())).select("path").distinct()
    referring = symbols.where((F.col("kind") == "ref") & F.col("name").isin(*names)).select("path").distinct().join(defining, "path", "left_anti")
    found = defining.union(referring.orderBy(F.desc(path_multiplier(F.col("path"))), "path").limit(refs))
    if imports is not None:
        stem = F.regexp_replace(F.regexp_replace(F.lower("path"), r"^.*/", ""), r"\.[^.]*$", "")
        s = defining.groupBy(stem.alias("stem")).agg(F.min("path").alias("definer"))
        i = imports.select("path", F.lower("target").alias("target")).distinct().join(found, "path", "left_anti")
        hits = i.join(s, F.col("target").contains(F.col("stem"))).groupBy("path").agg(F.min("definer").alias("definer"))
        found = found.union(hits.orderBy("definer", "path").limit(stems).select("path"))
    if edges is not None:
        into = None
        for n in names:
            e = callers(edges, n, calls).select("file", F.lit(names.index(n)).alias("name"))
            into = e if into is None else into.union(e)
        new = into.groupBy(F.col("file").alias("path")).agg(F.min("name").alias("name")).join(found, "path", "left_anti")
        found = found.union(new.orderBy("name", "path").limit(calls).select("path"))
    return found


def impact(symbols: DataFrame, name: str, depth: int = 2, k: int = 40, imports: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """(path, hops, severity): the files a symbol's change meets directly and, to a bounded depth, up to k symbol neighbours of the last hop's files.

    ``imports`` (path, target) and ``edges`` (file, position, from, to, kind) add the files that import a defining file or call the
    symbol. The reference also ends the closure at 40 files in all, which leaves nearly no neighbours where more define the symbol; here every hop counts.
    """
    found = materialise(direct_files(symbols, name, imports, edges).withColumn("hops", F.lit(0)))
    last = found
    for i in range(depth):  # a fixed small number of joins
        near = symbol_hop(symbols, last.select("path"), k, short=False).select("path").join(found.select("path"), "path", "left_anti")
        last = materialise(near.withColumn("hops", F.lit(i + 1)))
        found = found.union(last)
    n = found.agg(F.count("*").alias("n"))
    level = F.when(F.col("n") <= 4, "low").when(F.col("n") <= 16, "medium").otherwise("high")
    return found.crossJoin(F.broadcast(n)).select("path", "hops", level.alias("severity"))


def callers(edges: DataFrame, symbol: str, k: int) -> DataFrame:
    """Edges into a symbol from elsewhere. The cap counts in file and edge order, before the final sort."""
    kept = edges.where(F.col("kind").isin("call", "reference", "lexical") & (F.col("to") == symbol) & (F.col("from") != symbol))
    return kept.orderBy("file", "position").limit(k).orderBy("from", "file", "position")


def callees(edges: DataFrame, symbol: str, k: int) -> DataFrame:
    kept = edges.where(F.col("kind").isin("call", "reference", "lexical") & (F.col("from") == symbol) & (F.col("to") != symbol))
    return kept.orderBy("file", "position").limit(k).orderBy("to", "file", "position")


def parent_links(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(doc, child, parent): the parent span that overlaps a child span most; the earliest on ties. Spans are (doc, id, start, end)."""
    c = children.select("doc", F.col("id").alias("child"), F.col("start").alias("cs"), F.col("end").alias("ce"))
    p = parents.select("doc", F.col("id").alias("parent"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    shared = F.least("ce", "pe") - F.greatest("cs", "ps")
    j = c.join(p, "doc").where((F.col("cs") < F.col("pe")) & (F.col("ps") < F.col("ce")))
    best = j.groupBy("doc", "child").agg(F.max_by("parent", F.struct(shared, -F.col("ps"))).alias("parent"))
    return best


def overlapping(a: DataFrame, b: DataFrame, keep: bool) -> DataFrame:
    """Spans (doc, start, end) of a that overlap one of b (or none, if not ``keep``)."""
    x, y = a.alias("x"), b.alias("y")
    on = (F.col("x.doc") == F.col("y.doc")) & (F.col("x.start") < F.col("y.end")) & (F.col("y.start") < F.col("x.end"))
    return x.join(y, on, "left_semi" if keep else "left_anti")


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("r")).select("r.*")


def siblings(chunks: DataFrame, seeds: DataFrame, k: int = 4) -> DataFrame:
    """(doc, chunk): up to k chunks of the seeds' documents, by chunk id, the seeds themselves left out."""
    near = chunks.join(seeds.select("doc").distinct(), "doc", "left_semi").join(seeds.select("doc", "chunk"), ["doc", "chunk"], "left_anti")
    w = Window.partitionBy("doc").orderBy("chunk")
    return near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("doc", "chunk")


# ---- sets ----------------------------------------------------------------------------------------


def first_seen(rows: DataFrame, key: str, position: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(position).alias(position))


def purge(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the given document ids. ``tables``: name -> (table, id column)."""
    return {name: t.join(ids.select(F.col(ids.columns[0]).alias("_id")).distinct(), t[col] == F.col("_id"), "left_anti") for name, (t, col) in tables.items()}


def residual(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> DataFrame:
    """(table, id): ids that are still present somewhere."""
    out = None
    for name, (t, col) in tables.items():
        part = t.select(F.col(col).alias("id")).join(ids.select(F.col(ids.columns[0]).alias("id")).distinct(), "id", "left_semi").distinct().select(F.lit(name).alias("table"), "id")
        out = part if out is None else out.union(part)
    return out


def drop_contained(spans: DataFrame) -> DataFrame:
    """Spans (doc, start, end) without empty ones and ones inside an earlier kept span."""
    w = Window.partitionBy("doc").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return spans.where("start < end").withColumn("_m", F.max("end").over(w)).where(F.col("_m").isNull() | (F.col("end") > F.col("_m"))).drop("_m")


# ---- windows, pages, budgets ---------------------------------------------------------------------


def page_after(rows: DataFrame, order: Sequence[str], cursor: tuple | None, size: int) -> DataFrame:
    """Keyset page: rows after the cursor in key order, one more than asked, by which the caller sees whether there is a next page."""
    if cursor is not None:
        types = dict(rows.dtypes)
        rows = rows.where(F.struct(*order) > F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(order, cursor)]))
    return rows.orderBy(*order).limit(size + 1)


def retain_window(pool: DataFrame, k: int, per_doc: int, per_prefix: int, prefix: int = 12) -> DataFrame:
    """The k best rows (query, doc, chunk, score) of each query with at most ``per_doc`` of a document and ``per_prefix``
    of documents whose ids share their first bytes; identifier hits (protected) come first."""
    by = [F.desc("protected"), F.desc("score"), F.asc("chunk")]
    one = Window.partitionBy("query", "doc").orderBy(*by)
    two = Window.partitionBy("query", F.substring(F.col("doc").cast("string"), 1, prefix)).orderBy(*by)
    three = Window.partitionBy("query").orderBy(*by)
    kept = pool.withColumn("a", F.row_number().over(one)).where(F.col("a") <= per_doc)
    kept = kept.withColumn("b", F.row_number().over(two)).where((F.col("b") <= per_prefix) | F.col("protected"))
    return kept.withColumn("place", F.row_number().over(three)).where(F.col("place") <= k).drop("a", "b")


def allocate_budget(sources: DataFrame, limit: int, floor_share: float) -> DataFrame:
    """(pack, item, granted) of sources (pack, item, size, score, direct): direct items share a floor, then all share the rest by score; no item gets more than its size."""
    w = Window.partitionBy("pack")
    n_direct = F.sum(F.col("direct").cast("int")).over(w)
    floor = F.when(F.col("direct"), F.least(F.col("size"), F.floor(limit * floor_share / n_direct))).otherwise(0)
    s = sources.withColumn("f", floor).withColumn("rest", limit - F.sum("f").over(w)).withColumn("wt", F.greatest("score", F.lit(0.0)))
    s = s.withColumn("total", F.sum("wt").over(w)).withColumn("n", F.count("*").over(w))
    share = F.when(F.col("total") > 0, F.floor(F.col("rest") * F.col("wt") / F.col("total"))).otherwise(F.floor(F.col("rest") / F.col("n")))
    return s.select("pack", "item", F.least(F.col("size"), F.col("f") + share).cast("long").alias("granted"))


def tier_budgets(items: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """Items (session, item, tier, position, size) that fit their tier's byte budget, taken greedily: one that does not fit is skipped.

    Only a session's items of one tier meet in a task.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        left, keep = budgets.get(pdf["tier"].iloc[0], 0), []
        for row in pdf.sort_values(["position", "item"]).itertuples(index=False):
            if row.size <= left:
                left -= row.size
                keep.append(row)
        return pd.DataFrame(keep, columns=pdf.columns)

    return items.groupBy("session", "tier").applyInPandas(pick, items.schema)


def evidence_order(rows: DataFrame, mode: str) -> DataFrame:
    """(pack, item, place) of rows (pack, item, path, line, rank): original (path, line), tail_first (reverse rank),
    head_tail (even ranks in front, odd ones behind, reversed) or retrieval order."""
    if mode == "original":
        key = [F.asc("path"), F.asc("line"), F.asc("rank")]
    elif mode == "tail_first":
        key = [F.desc("rank")]
    elif mode == "head_tail":
        even = F.col("rank") % 2 == 0
        key = [F.when(even, 0).otherwise(1), F.when(even, F.col("rank")).otherwise(-F.col("rank"))]
    else:
        key = [F.asc("rank")]
    return rows.select("pack", "item", F.row_number().over(Window.partitionBy("pack").orderBy(*key)).alias("place"))
