"""Problem 1: near-duplicate records by BagMinHash signatures, banding and exact verification.

Every record is a bag of word shingles. A shingle of weight w owns the part [0, w) of a weight
axis, cut into the dyadic layers [0,1), [1,2), [2,4), ... Each (shingle, layer) carries its own
Poisson process, seeded by the shingle and the layer alone, whose points fall in random signature
slots at random times. A layer that w covers in part is thinned by the points' positions on the
axis. A slot keeps its earliest time, so two records agree in a slot with probability equal to
their weighted Jaccard similarity. A process is followed only until its time passes the largest
slot value, which is what makes the signature fast.

Stages: (1) one Python pass gives each record the class of its bag (equal bags: one class), and each
class its band keys and a 128-bit sketch; (2) classes that share a band key meet in a self-join on
that key, pairs whose sketches are too far apart are dropped inside the join; (3) the texts of the
remaining pairs are compared exactly. Groups of equal bags never meet each other's copies in (2).

Defined results: a null text, a text with fewer than ``min_words`` words or none at all has no
class and no links; an empty table gives an empty result; a repeated record id with an equal text
is one record; extra columns are ignored; very long texts are processed whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.words import WordHashes, mix, shingle_hashes, words
from tessera.runtime import BROADCAST_BYTES, materialise


@dataclass(frozen=True)
class NearDupSpec:
    """Parameters. A pair of similarity s becomes a candidate with probability 1-(1-s^rows)^bands, times that of
    its sketches. ``rows`` bounds how many unlike pairs meet (s^rows each): raise it, and ``bands``, with the collection."""

    shingle: int = 5
    threshold: float = 0.8
    min_words: int = 1
    multiset: bool = True
    slots: int = 128
    rows: int = 4
    bands: int = 16

    @property
    def max_far(self) -> int:
        """Differing bits of the 128-bit sketch (one bit a slot) that a pair at the threshold stays under, at three deviations."""
        p = (1 - self.threshold) / 2
        return int(128 * p + 3 * (128 * p * (1 - p)) ** 0.5)

    @property
    def max_far_fine(self) -> int:
        """The same of the fine sketch (four bits a slot), where a slot that differs flips two bits in the mean."""
        q = 1 - self.threshold
        return int(128 * 2 * q + 3.4 * (128 * (5 * q - 4 * q * q)) ** 0.5)


#: Classes of a band key that are joined in one task at most; larger buckets are cut into pairs of tiles.
TILE = 2_048
#: The statement of TESTDATA.md: three words, half of the distinct sequences, twenty words at least.
STATED = NearDupSpec(shingle=3, threshold=0.5, min_words=20, multiset=False, rows=3, bands=36)


def signatures(docs: np.ndarray, keys: np.ndarray, weights: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """BagMinHash signatures (n_docs x slots) of (doc, key, integer weight) elements."""
    sig = np.full((n_docs, slots), np.inf)
    flat = sig.reshape(-1)
    lo, hi, layer = 0, 1, 0
    top = int(weights.max()) if len(weights) else 0
    while lo < top:
        pick = weights > lo
        d, w = docs[pick], weights[pick]
        seed = mix(keys[pick] ^ np.uint64(layer * 0x51ED2701 + 1))
        t = np.zeros(len(d))
        part = w < hi
        k = 0
        while len(d):
            k += 1
            r = mix(seed + np.uint64(k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
            slot = (r % np.uint64(slots)).astype(np.int64)
            t = t - np.log(((r >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / (hi - lo)
            if part.any():
                v = (mix(r) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                ok = ~part | (lo + (hi - lo) * v < w)
                np.minimum.at(flat, d[ok] * slots + slot[ok], t[ok])
            else:
                np.minimum.at(flat, d * slots + slot, t)
            go = t < sig.max(axis=1)[d]
            d, w, seed, t, part = d[go], w[go], seed[go], t[go], part[go]
        lo, hi, layer = hi, hi * 2, layer + 1
    return sig


def _bag(hashes: np.ndarray, spec: NearDupSpec) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.unique(shingle_hashes(hashes, spec.shingle), return_counts=True)
    return keys, (counts if spec.multiset else np.ones(len(keys), np.int64))


def _sign(spec: NearDupSpec):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, seen = WordHashes(), {}
        for batch in batches:
            for at in range(0, len(batch), 400):
                part = batch.iloc[at : at + 400]
                ids, classes, bags, slot_of = [], [], [], []
                for record, text in zip(part["record_id"], part["body"]):
                    found = words(text)
                    if len(found) < max(spec.min_words, spec.shingle):
                        continue
                    keys, weights = _bag(np.array([table[w] for w in found], np.uint64), spec)
                    cls = xxhash.xxh64_intdigest(keys.tobytes() + weights.tobytes() if spec.multiset else keys.tobytes())
                    ids.append(record)
                    classes.append(cls)
                    if cls in seen:
                        slot_of.append(-1)
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen[cls] = None
                    slot_of.append(len(bags))
                    bags.append((keys, weights))
                if not ids:
                    continue
                bands = sketch = fine = None
                if bags:
                    lens = [len(k) for k, _ in bags]
                    sig = signatures(
                        np.repeat(np.arange(len(bags)), lens), np.concatenate([k for k, _ in bags]),
                        np.concatenate([w for _, w in bags]), len(bags), spec.slots,
                    )
                    # single precision: a last-bit difference of log() between machines must not matter
                    code = mix(sig.astype(np.float32).view(np.uint32).astype(np.uint64))
                    grid = code[:, : spec.bands * spec.rows].reshape(len(bags), spec.bands, spec.rows)
                    key = np.zeros(grid.shape[:2], np.uint64) + np.arange(spec.bands, dtype=np.uint64)
                    for i in range(spec.rows):
                        key = mix(key ^ grid[:, :, i])
                    bands = key.view(np.int64)
                    bits = mix(code)
                    sketch = np.packbits((bits & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                    nibble = ((bits >> np.uint64(1)) & np.uint64(15)).astype(np.uint8)
                    fine = np.ascontiguousarray(nibble[:, ::2] * 16 + nibble[:, 1::2]).view(np.int64)
                yield pd.DataFrame({
                    "record_id": ids,
                    "cls": np.array(classes, np.uint64).view(np.int64),
                    "bands": [None if s < 0 else bands[s] for s in slot_of],
                    "s1": [0 if s < 0 else int(sketch[s, 0]) for s in slot_of],
                    "s2": [0 if s < 0 else int(sketch[s, 1]) for s in slot_of],
                    "fine": [None if s < 0 else fine[s] for s in slot_of],
                })

    return run


def signed_records(df: DataFrame, id_col: str, text_col: str, spec: NearDupSpec) -> DataFrame:
    """(record_id, cls, bands, s1, s2, fine) of each record with enough words; bands and fine are null on a copy seen before in the task."""
    least = 2 * max(spec.min_words, spec.shingle) - 1
    body = df.select(F.col(id_col).alias("record_id"), F.col(text_col).alias("body"))
    body = body.where(F.col("record_id").isNotNull() & (F.length("body") >= least))
    return body.mapInPandas(_sign(spec), "record_id string, cls long, bands array<long>, s1 long, s2 long, fine array<long>")


def candidate_pairs(signed: DataFrame, spec: NearDupSpec) -> DataFrame:
    """Pairs of classes (a < b) that share a band key and whose sketches are near; each once.

    One exchange by band key serves the removal of repeats of a class within a key, the size of each key's bucket and both
    sides of the self-join. A bucket of more than ``TILE`` classes is not joined in one task: its classes are dealt to tiles,
    and each pair of tiles meets in a task of its own. No class is left out of a bucket, however large.
    """
    rows = signed.where(F.col("bands").isNotNull()).select(F.explode("bands").alias("key"), "cls", "s1", "s2")
    rows = rows.repartition("key").groupBy("key", "cls").agg(F.first("s1").alias("s1"), F.first("s2").alias("s2"))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    small = rows.where(F.col("n").between(2, TILE))
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    hot = rows.where(F.col("n") > TILE).withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    hot = hot.select("key", "cls", "s1", "s2", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    hot = hot.withColumn("lo", F.least("tile", "other")).withColumn("hi", F.greatest("tile", "other"))
    far = F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1"))) + F.bit_count(F.col("a.s2").bitwiseXOR(F.col("b.s2")))
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.cls") < F.col("b.cls")) & (far <= spec.max_far)
    # classes of one tile meet where the pair of tiles is that tile with itself
    apart = (F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi")) & ((F.col("a.tile") != F.col("b.tile")) | (F.col("a.lo") == F.col("a.hi")))
    pair = [F.col("a.cls").alias("cls_a"), F.col("b.cls").alias("cls_b")]
    met = small.alias("a").join(small.alias("b"), near).select(*pair).union(hot.alias("a").join(hot.alias("b"), near & apart).select(*pair))
    pairs = met.distinct()
    # unlike pairs that passed by chance are dropped by the fine sketch before any text moves
    fine = signed.where(F.col("fine").isNotNull()).select("cls", *[F.element_at("fine", i + 1).alias(f"f{i}") for i in range(8)]).dropDuplicates(["cls"])
    a, b = (fine.select(F.col("cls").alias(f"cls_{x}"), *[F.col(f"f{i}").alias(f"{x}{i}") for i in range(8)]) for x in "ab")
    apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(8)), F.lit(0))
    return pairs.join(a, "cls_a").join(b, "cls_b").where(apart <= spec.max_far_fine).select("cls_a", "cls_b")


def overlap(a: Counter, b: Counter) -> float:
    """Exact weighted Jaccard similarity of two bags."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    both = sum(min(n, large[k]) for k, n in small.items() if k in large)
    union = sum(a.values()) + sum(b.values()) - both
    return both / union if union else 0.0


def bag_of(text: str, spec: NearDupSpec) -> Counter:
    found = words(text)
    grams = zip(*(found[i:] for i in range(spec.shingle)))
    return Counter(grams) if spec.multiset else Counter(set(grams))


def _verify(spec: NearDupSpec):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, Counter] = {}

        def bag(cls: int, text: str) -> Counter:
            if cls not in kept:
                if len(kept) >= 256:
                    kept.clear()
                kept[cls] = bag_of(text, spec)
            return kept[cls]

        for batch in batches:
            sims = [
                overlap(bag(a, ta), bag(b, tb))
                for a, ta, b, tb in zip(batch["cls_a"], batch["body_a"], batch["cls_b"], batch["body_b"])
            ]
            out = pd.DataFrame({"cls_a": batch["cls_a"], "cls_b": batch["cls_b"], "similarity": sims})
            yield out[out["similarity"] >= spec.threshold]

    return run


def class_links(df: DataFrame, id_col: str, text_col: str, spec: NearDupSpec = STATED) -> tuple[DataFrame, DataFrame]:
    """(members(record_id, cls), links(cls_a, cls_b, similarity)): all links between different bags, and who holds each bag."""
    signed = materialise(signed_records(df, id_col, text_col, spec), label="signed")
    members = signed.select("record_id", "cls")
    pairs = materialise(candidate_pairs(signed, spec), label="pairs")
    ends = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    # one record stands for each class; its text is fetched by record id
    heads = members.join(ends, "cls", "left_semi").groupBy("cls").agg(F.min("record_id").alias("record_id"))
    heads = materialise(heads, label="heads")
    small = heads.count() * 64 <= BROADCAST_BYTES
    texts = df.select(F.col(id_col).alias("record_id"), F.col(text_col).alias("body")).where(F.col("body").isNotNull())
    texts = texts.join(F.broadcast(heads) if small else heads, "record_id").dropDuplicates(["cls"]).select("cls", "body")
    both = (
        pairs.join(texts.select(F.col("cls").alias("cls_a"), F.col("body").alias("body_a")), "cls_a")
        .join(texts.select(F.col("cls").alias("cls_b"), F.col("body").alias("body_b")), "cls_b")
        .select("cls_a", "body_a", "cls_b", "body_b")
    )
    return members, both.mapInPandas(_verify(spec), "cls_a long, cls_b long, similarity double")


def record_pairs(members: DataFrame, links: DataFrame, spell_out: int = 1_000) -> DataFrame:
    """(record_a, record_b), a < b: the links of classes spelled out for their records, and the pairs of equal records.

    A class of more than ``spell_out`` equal records is not expanded into all pairs: each of its records is paired with
    the first one, which alone carries the class's links. No link between different bags is lost, and a class
    that holds a third of the collection gives as many rows as it has records.
    """
    who = members.distinct()
    crowd = who.groupBy("cls").agg(F.count("*").alias("n"), F.min("record_id").alias("head")).where(F.col("n") > spell_out).select("cls", "head")
    placed = who.join(crowd, "cls", "left")
    star = placed.where(F.col("head") < F.col("record_id")).select(F.col("head").alias("x"), F.col("record_id").alias("y"))
    shown = placed.where(F.col("head").isNull() | (F.col("head") == F.col("record_id"))).select("cls", "record_id")
    a = shown.select(F.col("cls").alias("cls_a"), F.col("record_id").alias("x"))
    b = shown.select(F.col("cls").alias("cls_b"), F.col("record_id").alias("y"))
    across = links.select("cls_a", "cls_b").join(a, "cls_a").join(b, "cls_b").where(F.col("x") != F.col("y")).select("x", "y")
    inside = a.join(b, (F.col("cls_a") == F.col("cls_b")) & (F.col("x") < F.col("y"))).select("x", "y")
    pairs = across.union(inside).union(star)
    return pairs.select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b")).distinct()


def near_duplicate_classes(df: DataFrame, id_col: str, text_col: str, spec: NearDupSpec = NearDupSpec(bands=30)) -> DataFrame:
    """(record_id, class_id, n_copies, n_links): one row per record. Records of equal bags are one class, named by its first
    record; n_links counts the other classes whose bags have at least the threshold of weighted Jaccard similarity with it.

    Records with fewer words than a shingle, empty and null ones are classed by their exact words and have no links."""
    members, links = class_links(df, id_col, text_col, spec)
    ends = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    who = members.distinct()
    sizes = who.groupBy("cls").agg(F.count("*").alias("n_copies"), F.min("record_id").alias("class_id")).join(ends, "cls", "left")
    large = who.join(sizes, "cls").select("record_id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # whoever has no bag: its words joined by blanks, which are short
    rest = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("record_id"), F.col(text_col).alias("body"))
    rest = rest.join(who.select("record_id"), "record_id", "left_anti")
    found = F.regexp_extract_all(F.lower(F.coalesce("body", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    short = rest.select("record_id", F.array_join(found, " ").alias("said")).groupBy("record_id").agg(F.max("said").alias("said"))
    classes = short.groupBy("said").agg(F.count("*").alias("n_copies"), F.min("record_id").alias("class_id"))
    return large.union(short.join(classes, "said").select("record_id", "class_id", "n_copies", F.lit(0)))
