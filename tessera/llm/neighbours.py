"""Problem 4: the most similar vectors of every vector, by cosine.

Vectors are compared within a partition (store, generation, model, length). A bounded sample of each
partition fits cell centres (spherical k-means) and the codebooks of a score-aware anisotropic
product quantiser: two dimensions and four bits per sub-space, the error parallel to the vector
weighing ``eta`` times the error across it, since that is what moves a large inner product. Every
row, not only the sample, is indexed.

``similar_pairs`` (all rows against all rows): each vector goes to its ``spread`` nearest cells, and
two vectors meet where their cells do. In a cell the codes are scanned with four-bit tables (two per
byte look-up); what scores near ``least`` is reranked with the exact vectors.
``nearest`` (a query set against all rows): query blocks of bounded size are broadcast and scanned
against the codes of every row, with exact reranking of ``rerank`` rows a partition of the data.

Defined results: null vectors, empty ones, ones whose length disagrees with dim, ones with a NaN or
infinite value and all-zero ones are not usable and come out nowhere; a repeated id (a replay) is one
vector; ties in similarity go to the smaller id; more than ``COPIES`` equal vectors are searched
through their first eleven ids, which is exact, since ties go to those; an empty table gives an
empty result; columns beside the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import BROADCAST_BYTES, checked_broadcast, materialise

SAMPLE, SAMPLE_OF_CELL = 16_384, 8  # rows of a partition that fit its index: the first, or so many a cell where that is more
CELL_ROWS, MAX_CELLS = 128, 16_384  # cells grow in number with the rows up to two million rows a partition, beyond that in size
STRIP = 4_096  # rows scored against all centres at once
TILE = 16_384  # rows of a cell that meet in one task, at most
COPIES = 64
_OUT = "part int, a string, b string, similarity double"


def eta(dim: int, threshold: float = 0.5) -> float:
    """Weight of the parallel residual for inner products above ``threshold`` (unit vectors, uniform directions)."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int, spherical: bool) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        less = 0 if spherical else (c * c).sum(1) / 2
        own = np.concatenate([(x[i : i + STRIP] @ c.T - less).argmax(1) for i in range(0, len(x), STRIP)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        count = np.bincount(own, minlength=k)
        full = count > 0
        c[full] = total[full] / count[full, None]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Quantiser:
    """Anisotropic product quantiser of unit vectors: sub-spaces of two dimensions, sixteen words each."""

    def __init__(self, books: np.ndarray, dim: int):
        self.books, self.dim, self.eta = books, dim, eta(dim)

    @staticmethod
    def padded(x: np.ndarray) -> np.ndarray:
        extra = -x.shape[1] % 4  # whole bytes: two sub-spaces of two dimensions
        x = np.pad(x, ((0, 0), (0, extra))) if extra else x
        return x.reshape(len(x), -1, 2)

    @classmethod
    def fit(cls, x: np.ndarray, rounds: int = 4) -> Quantiser:
        dim, sub = x.shape[1], cls.padded(x)
        books = np.stack([kmeans(sub[:, m], 16, 6, m, False) for m in range(sub.shape[1])])
        out = cls(books, dim)
        for _ in range(rounds):
            codes = out.encode(x)
            r = sub - np.take_along_axis(books[None], codes[:, :, None, None].repeat(2, 3), 2)[:, :, 0]
            dots = (r * sub).sum(2)
            along = dots.sum(1)
            for m in range(sub.shape[1]):
                v, rest = sub[:, m], along - dots[:, m]
                for w in range(16):
                    pick = codes[:, m] == w
                    if pick.any():
                        vm = v[pick]
                        lhs = pick.sum() * np.eye(2) + (out.eta - 1) * vm.T @ vm
                        rhs = vm.sum(0) + (out.eta - 1) * ((rest[pick] + (vm * vm).sum(1)) @ vm)
                        books[m, w] = np.linalg.solve(lhs, rhs)
        return out

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (n x sub-spaces) by coordinate descent on |r|^2 + (eta-1) <r, x>^2."""
        sub = self.padded(x)
        n, m_all = sub.shape[:2]
        codes = np.empty((n, m_all), np.int64)
        square = np.empty((m_all, n, 16), np.float32)
        dot = np.empty((m_all, n, 16), np.float32)
        for m in range(m_all):
            r = sub[:, m, None, :] - self.books[m][None]
            square[m] = (r * r).sum(2)
            dot[m] = (r * sub[:, m, None, :]).sum(2)
            codes[:, m] = square[m].argmin(1)
        row = np.arange(n)
        along = sum(dot[m, row, codes[:, m]] for m in range(m_all))
        for _ in range(sweeps):
            for m in range(m_all):
                rest = along - dot[m, row, codes[:, m]]
                codes[:, m] = (square[m] + (self.eta - 1) * (rest[:, None] + dot[m]) ** 2).argmin(1)
                along = rest + dot[m, row, codes[:, m]]
        return codes

    def packed(self, x: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(codes, margins): two four-bit codes a byte, one row per vector, and how far below ``least`` the score of a
        query with that true similarity may lie: the parallel error, plus the part across it at four deviations of
        its projection on a random direction, or in full where that is less."""
        c = self.encode(x)
        r = self.padded(x) - self.books[np.arange(c.shape[1])[None], c]
        r = r.reshape(len(x), -1)[:, : self.dim]
        along = (r * x).sum(1)
        across = np.sqrt(np.maximum((r * r).sum(1) - along**2, 0))
        margin = np.abs(along) + (1 - least**2) ** 0.5 * across * min(1.0, 4 / max(self.dim - 1, 1) ** 0.5)
        return (c[:, ::2] * 16 + c[:, 1::2]).astype(np.uint8), margin.astype(np.float32)

    def scores(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products (queries x rows) by table look-ups; codes has a row per pair of sub-spaces."""
        sub = self.padded(queries)
        luts = np.einsum("qmd,mwd->qmw", sub, self.books).astype(np.float32)
        pair = (luts[:, ::2, :, None] + luts[:, 1::2, None, :]).reshape(len(queries), -1, 256)
        out = np.zeros((len(queries), codes.shape[1]), np.float32)
        for j in range(codes.shape[0]):
            out += pair[:, j].take(codes[j], axis=1)
        return out


def best_of(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, pq: Quantiser, codes: np.ndarray, margin: np.ndarray, k: int, least: float | None, rerank: int):
    """(query ids, row ids, similarities) of the up to k best rows of each query, itself left out."""
    out = []
    codes = np.ascontiguousarray(codes.T)
    for at in range(0, len(q), 128):
        block, ids = q[at : at + 128], q_ids[at : at + 128]
        near: list[tuple[np.ndarray, np.ndarray]] = []
        for lo in range(0, len(x), 8192):
            s = pq.scores(block, codes[:, lo : lo + 8192])
            if least is not None:
                i, j = np.nonzero(s >= least - margin[None, lo : lo + 8192])
            else:
                take = min(rerank + 1, s.shape[1])
                j = np.argpartition(-s, take - 1, axis=1)[:, :take]
                i, j = np.repeat(np.arange(len(block)), take), j.ravel()
            near.append((i, j + lo))
        i, j = (np.concatenate(v) for v in zip(*near))
        other = ids[i] != x_ids[j]
        i, j = i[other], j[other]
        sim = np.einsum("nd,nd->n", block[i].astype(np.float64), x[j].astype(np.float64))
        if least is not None:
            keep = sim >= least
            i, j, sim = i[keep], j[keep], sim[keep]
        order = np.lexsort((x_ids[j], -sim, i))
        i, j, sim = i[order], j[order], sim[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        top = rank < k
        out.append((ids[i[top]], x_ids[j[top]], sim[top]))
    return [np.concatenate(v) for v in zip(*out)] if out else None


def usable(df: DataFrame, keys: list[str], id_col: str = "document_id") -> DataFrame:
    """(keys.., id, embedding) of the usable rows."""
    e = F.col("embedding")
    odd = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    zero = F.forall(e, lambda v: v == 0)
    rows = df.where(e.isNotNull() & F.col(id_col).isNotNull() & (F.size(e) == F.col("dim")) & (F.size(e) > 0))
    return rows.where(~odd & ~zero).select(*keys, F.col(id_col).alias("id"), "embedding")


class Index:
    """Partition numbers, cell centres and quantisers, fitted on samples of at most ``SAMPLE`` or ``SAMPLE_OF_CELL`` x ``MAX_CELLS`` rows a partition.

    Each partition's sample, drawn by a hash of the id, is fitted in a task of its own; the driver gets the fitted models alone
    (at most ``MAX_CELLS`` centres and the codebooks a partition) and sends them to the workers.
    """

    def __init__(self, rows: DataFrame, keys: list[str]):
        self.keys = keys
        counts = {tuple(r[k] for k in keys): r["n"] for r in rows.groupBy(*keys).agg(F.count("*").alias("n")).collect()}
        self.parts = sorted(counts, key=lambda p: tuple((v is None, str(v)) for v in p))
        self.number = {p: i for i, p in enumerate(self.parts)}
        spark = rows.sparkSession
        fields = rows.select(*keys).schema
        self.table = spark.createDataFrame([(*p, i, min(1.0, max(SAMPLE, SAMPLE_OF_CELL * min(MAX_CELLS, counts[p] // CELL_ROWS)) / counts[p])) for p, i in self.number.items()], fields.add("part", "integer").add("share", "double"))
        on = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]) if keys else F.lit(True)
        # one row per partition: bounded by the number of stores, generations, models and lengths
        self.rows = rows.alias("r").join(F.broadcast(self.table).alias("p"), on).select("p.part", "p.share", "r.id", "r.embedding")
        most = {i: counts[p] // CELL_ROWS for p, i in self.number.items()}

        def fit(table: pa.Table) -> pa.Table:
            p = table.column("part")[0].as_py()
            order = np.argsort(table.column("h").to_numpy(), kind="stable")  # by hash, whatever order the rows came in
            x = _unit(_matrix(table.column("embedding")))[order]
            cells = max(min(MAX_CELLS, most[p], len(x) // 8), 1)
            centres = kmeans(x, cells, 4, p, True) if cells > 8 else x[:1].copy()
            books = Quantiser.fit(x[:4096]).books  # the rows stand in the order of a hash: these are a random sample too
            return pa.table({"part": pa.array([p], pa.int32()), "dim": pa.array([x.shape[1]], pa.int32()), "centres": pa.array([centres.astype(np.float32).tobytes()], pa.binary()), "books": pa.array([books.astype(np.float32).tobytes()], pa.binary())})

        h = F.xxhash64("id")
        drawn = self.rows.where(F.pmod(h, F.lit(1_000_000)) < F.col("share") * 1_000_000).select("part", h.alias("h"), "embedding")
        self.model = {}
        for r in drawn.groupBy("part").applyInArrow(fit, "part int, dim int, centres binary, books binary").collect():
            centres = np.frombuffer(r["centres"], np.float32).reshape(-1, r["dim"])
            self.model[r["part"]] = (centres, Quantiser(np.frombuffer(r["books"], np.float32).reshape(-1, 16, 2), r["dim"]))
        self.shared = spark.sparkContext.broadcast(self.model)
        self.rows = self.rows.where(F.col("part").isin(sorted(self.model))).select("part", "id", "embedding") if self.model else self.rows.select("part", "id", "embedding")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of the norm
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of lists of one length as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)


def _cell_sizes(index: Index, spread: int) -> DataFrame:
    """(part, cell, n): how many vectors go to each cell; vectors are not encoded for that."""
    shared = index.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            part = batch.column(0).to_numpy()
            for p in np.unique(part):
                centres = shared.value[int(p)][0]
                near = _nearest_cells(_unit(_matrix(batch.column(1).filter(pa.array(part == p)))), centres, spread)
                total[int(p)] = total.get(int(p), 0) + np.bincount(near.ravel(), minlength=len(centres))
        for p, n in total.items():
            cells = np.nonzero(n)[0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), p, np.int32)), pa.array(cells), pa.array(n[cells])], names=["part", "cell", "n"])

    return index.rows.select("part", "embedding").mapInArrow(run, "part int, cell int, n long").groupBy("part", "cell").agg(F.sum("n").alias("n"))


def _nearest_cells(x: np.ndarray, centres: np.ndarray, spread: int) -> np.ndarray:
    take = min(spread, len(centres))
    strips = [np.argpartition(-(x[i : i + STRIP] @ centres.T), take - 1, axis=1)[:, :take] for i in range(0, len(x), STRIP)]
    return np.concatenate(strips).astype(np.int32)


def _cells(index: Index, spread: int, least: float) -> DataFrame:
    """(part, id, unit, code, margin, cells): each vector is normalised and encoded once, before its copies go to its cells."""
    shared = index.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(0).to_numpy()
            for p in np.unique(part):
                rows = batch.take(pa.array(np.nonzero(part == p)[0]))
                centres, pq = shared.value[int(p)]
                x = _unit(_matrix(rows.column(2)))
                codes, margin = pq.packed(x, least)
                near = _nearest_cells(x, centres, spread)
                take = near.shape[1]
                offsets = np.arange(len(x) + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.ListArray.from_arrays(offsets * x.shape[1], x.ravel()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(margin), pa.ListArray.from_arrays(offsets * take, near.ravel())],
                    names=["part", "id", "unit", "code", "margin", "cells"],
                )

    return index.rows.mapInArrow(run, "part int, id string, unit array<float>, code binary, margin float, cells array<int>")


def similar_pairs(df: DataFrame, keys: list[str], k: int = 10, least: float = 0.9, spread: int = 4) -> tuple[Index, DataFrame]:
    """(index, pairs(part, a, b, similarity)): each usable vector a with its up to k nearest b of similarity ``least`` or more."""
    rows = usable(df, keys)
    index = Index(rows, keys)
    shared = index.shared
    base, direct = _without_copies(index, k)
    index.rows = base
    placed = _cells(index, spread, least).select("part", "id", "unit", "code", "margin", F.explode("cells").alias("cell"))
    # cells of more than TILE rows: their rows are dealt to tiles, and each pair of tiles meets once
    big = materialise(_cell_sizes(index, spread).where(F.col("n") > TILE).select("part", "cell", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), label="big")
    n_big = big.count()
    if n_big:
        placed = placed.join(checked_broadcast(big, n_big, 24), ["part", "cell"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        placed = placed.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
        other = F.sequence(F.lit(0), F.col("tiles") - 1)
        meet = F.transform(other, lambda o: F.least(o, F.col("tile")) * F.col("tiles") + F.greatest(o, F.col("tile")))
        placed = placed.select("part", "cell", F.explode(meet).alias("tile"), "id", "unit", "code", "margin")
    else:
        placed = placed.select("part", "cell", F.lit(0).alias("tile"), "id", "unit", "code", "margin")

    def search(table: pa.Table) -> pa.Table:
        p = table.column("part")[0].as_py()
        ids, first = np.unique(np.array(table.column("id").to_pylist(), dtype=object).astype(str), return_index=True)
        x = _matrix(table.column("unit"))[first]
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(table.num_rows, -1)[first]
        margin = table.column("margin").to_numpy()[first]
        found = best_of(x, ids, x, ids, shared.value[p][1], codes, margin, k, least, 0) if len(x) > 1 else None
        if found is None:
            found = [np.array([], str), np.array([], str), np.array([], float)]
        a, b, s = found
        return pa.table({"part": pa.array(np.full(len(a), p, np.int32)), "a": pa.array(a.tolist(), pa.string()), "b": pa.array(b.tolist(), pa.string()), "similarity": pa.array(s)})

    met = placed.groupBy("part", "cell", "tile").applyInArrow(search, _OUT)
    if direct is not None:
        met = met.union(direct)
    return index, _top(met, k)


def _without_copies(index: Index, k: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows without the surplus of vectors that more than COPIES ids share, and the surplus ids' own neighbours."""
    rows = index.rows.withColumn("vh", F.xxhash64("embedding"))
    hot = rows.groupBy("part", "vh").agg(F.count("*").alias("n")).where(F.col("n") > COPIES).select("part", "vh")
    hot = materialise(hot, label="hot")
    n = hot.count()
    if not n:
        return index.rows, None
    small = F.broadcast(hot) if n * 16 <= BROADCAST_BYTES else hot
    inside = rows.join(small, ["part", "vh"], "left_semi").select("part", "vh", "id").distinct()
    # row_number under a bound is cut on the map side, so a hot vector's ids never gather in one task
    heads = inside.withColumn("n", F.row_number().over(Window.partitionBy("part", "vh").orderBy("id"))).where(F.col("n") <= k + 1)
    heads = materialise(heads, label="heads")
    lead = heads.groupBy("part", "vh").agg(F.sort_array(F.collect_list("id")).alias("lead"))
    surplus = inside.join(heads, ["part", "vh", "id"], "left_anti")
    direct = surplus.join(lead, ["part", "vh"]).select("part", F.col("id").alias("a"), F.explode(F.slice("lead", 1, k)).alias("b"), F.lit(1.0).alias("similarity"))
    cold = rows.join(small, ["part", "vh"], "left_anti").select("part", "id", "embedding")
    kept = rows.join(heads.select("part", "vh", "id"), ["part", "vh", "id"], "left_semi").select("part", "id", "embedding")
    return cold.union(kept), direct


def _top(met: DataFrame, k: int) -> DataFrame:
    """The k best of each a; a pair met in several cells or blocks counts once."""
    once = met.groupBy("part", "a", "b").agg(F.max("similarity").alias("similarity"))
    best = Window.partitionBy("part", "a").orderBy(F.desc("similarity"), "b")
    return once.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def nearest(df: DataFrame, keys: list[str], is_query, k: int = 10, rerank: int = 60, block_bytes: int = 16 << 20) -> tuple[Index, DataFrame]:
    """(index, pairs(part, a, b, similarity, place)): the k nearest rows of each query row (``is_query`` on the column id).

    Every row is encoded once, into a written table; queries are broadcast in blocks of at most ``block_bytes``, each of which
    is scanned against all rows of its partition. At least ``rerank`` rows of each batch of rows are compared exactly."""
    rows = usable(df, keys)
    index = Index(rows, keys)
    shared = index.shared
    coded = materialise(_cells(index, 1, 0.0).select("part", "id", "unit", "code"), label="coded")
    asked = coded.where(is_query)
    sizes = asked.groupBy("part").agg(F.count("*").alias("n"), F.first(F.size("unit")).alias("dim")).collect()
    found = []
    for r in sorted(sizes, key=lambda r: r["part"]):
        p, blocks = r["part"], -(-r["n"] * r["dim"] * 4 // block_bytes)
        mine = asked.where(F.col("part") == p).select("id", "unit")
        for i in range(blocks):  # bounded blocks of queries, each against all rows of the partition
            part = mine.where(F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)) == i).dropDuplicates(["id"]).toArrow()
            if part.num_rows:
                q_ids, q = np.array(part.column("id").to_pylist(), dtype=str), _matrix(part.column("unit"))
                found.append(_against(coded.where(F.col("part") == p), df.sparkSession.sparkContext.broadcast((p, q_ids, q)), shared, k, rerank))
    if not found:
        return index, df.sparkSession.createDataFrame([], _OUT + ", place int")
    return index, _top(reduce(DataFrame.union, found), k)


def _against(rows: DataFrame, asked, shared, k: int, rerank: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q_ids, q = asked.value
        pq = shared.value[p][1]
        for batch in batches:
            ids, first = np.unique(np.array(batch.column("id").to_pylist(), dtype=str), return_index=True)
            if len(ids):
                x = _matrix(batch.column("unit"))[first]
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)[first]
                a, b, s = best_of(q, q_ids, x, ids, pq, codes, np.zeros(len(x), np.float32), k, None, rerank)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), p, np.int32)), pa.array(a.tolist(), pa.string()), pa.array(b.tolist(), pa.string()), pa.array(s)], names=["part", "a", "b", "similarity"])

    return rows.mapInArrow(run, _OUT)
