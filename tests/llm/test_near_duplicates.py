import random
from collections import Counter

import numpy as np

from tessera.llm import bagminhash as B
from tessera.llm.words import words

SCHEMA = "record_id string, body string, cls string, key int"


def brute(records, spec):
    bags = {}
    for r, t in records:
        if r is not None and t is not None and len(words(t)) >= max(spec.min_words, spec.shingle):
            bags.setdefault(r, []).append(B.bag_of(t, spec))
    ids = sorted(bags)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if any(B.overlap(x, y) >= spec.threshold for x in bags[a] for y in bags[b])}


def found(spark, records, spec):
    df = spark.createDataFrame([(r, t, "x", 1) for r, t in records], SCHEMA)
    members, links = B.class_links(df, "record_id", "body", spec)
    return {tuple(r) for r in B.record_pairs(members, links).collect()}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        base = [rng.choice(vocab) for _ in range(rng.randint(25, 80))]
        out.append((f"r{i}", " ".join(base)))
        for j in range(rng.randint(0, 2)):
            edit = list(base)
            for _ in range(rng.randint(0, 3)):
                edit[rng.randrange(len(edit))] = rng.choice(vocab)
            out.append((f"r{i}e{j}", " ".join(edit).upper()))
    return out


def test_pairs_match_brute_force_with_dirty_rows(spark):
    records = corpus(1) + [("n1", None), ("n2", ""), ("n3", "too short"), (None, "w1 " * 40), ("r0", None)]
    records += [records[0], ("copy", records[0][1]), ("long", " ".join(t for _, t in corpus(2, 40)))]
    assert found(spark, records, B.STATED) == brute(records, B.STATED)


def test_repeats_count_in_bags(spark):
    a = "one two three four five six seven eight nine ten"
    records = [("a", a), ("b", a + " " + a + " " + a), ("c", a)]
    spec = B.NearDupSpec()
    assert found(spark, records, spec) == brute(records, spec) == {("a", "c")}


def test_empty_table_and_classes(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert B.near_duplicate_classes(empty, "record_id", "body").count() == 0
    text = " ".join(f"t{i}" for i in range(60))
    df = spark.createDataFrame([("a", text, "x", 1), ("b", text, "x", 1), ("b", text, "x", 2), ("c", text + " more", "x", 1)], SCHEMA)
    got = {r["record_id"]: (r["n_copies"], r["n_links"]) for r in B.near_duplicate_classes(df, "record_id", "body").collect()}
    assert got == {"a": (2, 1), "b": (2, 1), "c": (1, 1)}


def test_every_record_has_a_class(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [("a", text), ("b", "too short"), ("c", "Too, SHORT!"), ("d", None), ("e", ""), ("f", " - "), ("g", text), ("b", "too short"), (None, text)]
    df = spark.createDataFrame([(r, t, "x", 1) for r, t in rows], SCHEMA)
    got = {r["record_id"]: (r["class_id"], r["n_copies"], r["n_links"]) for r in B.near_duplicate_classes(df, "record_id", "body").collect()}
    assert got == {"a": ("a", 2, 0), "g": ("a", 2, 0), "b": ("b", 2, 0), "c": ("b", 2, 0), "d": ("d", 3, 0), "e": ("d", 3, 0), "f": ("d", 3, 0)}


def test_hot_band_keys_meet_in_tiles(spark, monkeypatch):
    """A template that half of the records vary: their band keys are shared by most of them."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    records = corpus(5, 40)
    for i in range(90):
        edit = list(base)
        edit[rng.randrange(120)] = f"x{i}"
        records.append((f"t{i:02d}", " ".join(edit)))
    monkeypatch.setattr(B, "TILE", 16)
    assert found(spark, records, B.STATED) == brute(records, B.STATED)
    assert len(brute(records, B.STATED)) >= 90 * 89 // 2


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 200).astype(np.uint64)
    w1, w2 = rng.integers(1, 9, 200), rng.integers(1, 9, 200)
    sig = B.signatures(np.repeat([0, 1], 200), np.concatenate([keys, keys]), np.concatenate([w1, w2]), 2, 4096)
    true = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * (true * (1 - true) / 4096) ** 0.5


def test_overlap():
    assert B.overlap(Counter("aab"), Counter("ab")) == 2 / 3 and B.overlap(Counter(), Counter()) == 0.0


def test_a_crowd_of_copies_is_a_star(spark):
    text = " ".join(f"t{i}" for i in range(40))
    df = spark.createDataFrame([(f"c{i:02d}", text, "x", 1) for i in range(12)] + [("near", text + " more", "x", 1)], SCHEMA)
    members, links = B.class_links(df, "record_id", "body", B.STATED)
    got = {tuple(r) for r in B.record_pairs(members, links, spell_out=5).collect()}
    assert got == {("c00", f"c{i:02d}") for i in range(1, 12)} | {("c00", "near")}
