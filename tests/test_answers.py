import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import answers as A
from tessera.operators import arms, code, graph, work

POOL = "query string, item string, source string, text string, score double, orig int"
LONG = "retention policy for archived snapshots keeps every record during ninety calendar days after closing"


def pool(spark, *rows):
    return spark.createDataFrame([("q", i, s, t, sc, n) for n, (i, s, t, sc) in enumerate(rows)], POOL)


def order(df):
    return [r["item"] for r in df.orderBy("place").collect()]


def test_document_dates(spark):
    texts = ["Effective from 2024-03-01, written 2025-01-01", "head 2023-02-03 and 2024-01-01", "x" * 900 + " 2021-05-05 then 2022-06-06", "only 2019 and 2017", "2024-13-45", None, ""]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [str(r[0]) for r in d.orderBy("i").select(A.document_date(F.col("t"))).collect()]
    assert got == ["2024-03-01", "2023-02-03", "2022-06-06", "2019-01-01", "2024-01-01", "None", "None"]


def test_authority_recency_orders(spark):
    p = pool(spark, ("a", "slack", "old 2020-01-01", 0.9), ("b", "confluence", "new 2024-05-01", 0.1), ("c", "slack", "undated", 0.8), ("turn:1", "", "hi", 0.0))
    assert order(A.authority_recency(p, "conflict")) == ["turn:1", "b", "a", "c"]
    assert order(A.authority_recency(p, "medium")) == ["turn:1", "b", "a", "c"]
    assert order(A.authority_recency(p, "other"))[0] == "turn:1"
    v = pool(spark, ("a", "", "valid from 2024-01-01 valid until 2024-02-01", 1.0), ("b", "", "valid from 2023-01-01", 0.5), ("c", "", "none", 0.4))
    assert order(A.authority_recency(v, "other", "2024-06-01")) == ["b", "c", "a"]


def test_qualifiers_and_constrained(spark):
    assert A.qualifiers("Which limit holds in the EU region and for the tenant: acme?") == [("region", "eu"), ("tenant", "acme")]
    p = pool(spark, ("a", "", "us region limits", 1.0), ("b", "", "nothing said", 0.9), ("c", "", "the eu region has it", 0.8))
    assert order(A.rerank_constrained(p, "Which limit holds in the eu region?")) == ["c", "b", "a"]
    assert order(A.rerank_constrained(p, "Which limit holds?")) == ["a", "b", "c"]


def test_intra_document(spark):
    p = pool(spark, ("a", "d1", "2024-01-01 start", 1.0), ("b", "d2", "2024-03-01 later", 0.9), ("c", "d3", "2024-02-10 soon after", 0.8), ("d", "d2", "no date", 0.7))
    assert order(A.rerank_intra(p, "What came after 2024-02-01?", [])) == ["c", "b", "a", "d"]
    assert order(A.rerank_intra(p, "What is in it?", ["later"])) == ["b", "d", "a", "c"]


def test_similar_heads_are_grouped_greedily(spark):
    near = LONG.replace("ninety", "sixty")
    p = pool(spark, ("a", "", LONG + " 2023-01-01", 1.0), ("b", "", "something else entirely about clocks and rivers here", 0.9), ("c", "", near + " 2024-01-01", 0.8), ("d", "", LONG + " 2023-01-01", 0.7))
    assert {(r["item"], r["leader"]) for r in A.near_duplicate_heads(p).collect()} == {("a", "a"), ("c", "a"), ("d", "a")}
    assert [r["item"] for r in A.supersede(p).where("leads").collect()] == ["c"]
    assert order(A.rerank_conflicting(p))[:2] == ["c", "a"] and sorted(order(A.rerank_conflicting(p))) == ["a", "b", "c", "d"]
    assert A.near_duplicate_heads(p.where("false")).count() == 0


def test_stem_diversity_equals_the_greedy_walk(spark):
    import random

    rng = random.Random(5)
    rows = [("q", f"d{i % 7}/f{rng.randrange(6)}.py" + str(i), round(rng.random(), 3)) for i in range(40)]
    rows = [(q, p.rsplit(".py", 1)[0] + ".py" if i % 2 else p, s) for i, (q, p, s) in enumerate(rows)]
    rows = list({p: (q, p, s) for q, p, s in rows}.values())
    stem = lambda p: p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    left, taken = sorted(rows, key=lambda r: r[1]), []
    while left:
        best = max(left, key=lambda r: (round(0.7 * r[2] - 0.3 * sum(stem(t[1]) == stem(r[1]) for t in taken), 9), [-ord(c) for c in r[1]]))
        taken.append(best)
        left.remove(best)
    got = A.stem_diversity(spark.createDataFrame(rows, "query string, path string, score double")).orderBy("place").collect()
    gains = lambda paths: [round(0.7 * s - 0.3 * sum(stem(x) == stem(p) for x in paths[:i]), 6) for i, (p, s) in enumerate((p, dict((r[1], r[2]) for r in rows)[p]) for p in paths)]
    assert gains([r["path"] for r in got]) == gains([t[1] for t in taken])


def test_bounded_scan_and_recall(spark):
    d = spark.range(5).toDF("id")
    assert A.bounded(d, 5).count() == 5
    with pytest.raises(Exception, match="more than 4 rows"):
        A.bounded(d, 4).collect()
    schema = "id int, symbol string, path string, handle string, text string, repository string, tree string, confidence double, freshness string"
    rows = [(1, "Fold", "a/b.py", None, "x", "r", None, 0.9, None), (2, "FoldAll", None, None, "x", "r", None, 0.9, "live"), (3, "Fold", "a", None, "", "r", None, 0.9, "superseded"), (4, "Fold", None, None, "", None, None, 0.9, None), (5, "Fold", "p", None, "", "r", None, None, None)]
    got = [(r["id"], r["relevance"]) for r in A.recall(spark.createDataFrame(rows, schema), "fold").collect()]
    assert got == [(1, 1.0), (2, 0.9)]


def test_clip_keeps_facts(spark):
    text = "h" * 900 + " the sum was $1,200 in all " + "t" * 900
    r = spark.createDataFrame([(text,), ("short",), ("n" * 2000,), (None,)], "t string").select(A.clip_passage(F.col("t"), 1000)).collect()
    assert len(r[0][0]) <= 1000 and "$1,200" in r[0][0] and "…" in r[0][0] and r[1][0] == "short" and r[2][0] == "n" * 1000 and r[3][0] is None


def test_faithfulness(spark):
    c = spark.createDataFrame([(1, 0, "d", ["a", "b"]), (2, 0, "d", ["a", "z"]), (3, 0, "x", ["a"])], "answer int, claim int, doc string, tokens array<string>")
    e = spark.createDataFrame([(i, "d", ["a", "b", "c"]) for i in (1, 2, 3)], "answer int, doc string, tokens array<string>")
    assert {r["answer"]: r["outcome"] for r in A.faithfulness(c, e).collect()} == {1: "supported", 2: "insufficient_context", 3: "insufficient_context"}


def test_replay_is_strict(spark, tmp_path):
    good = [json.dumps({"session": "s", "seq": i, "kind": "edit"}) for i in range(3)]
    at = lambda name, lines: (tmp_path / name).write_text("\n".join(lines)) and str(tmp_path / name)
    assert work.replay(spark, at("ok", [good[0], "", *good[1:]])).count() == 3
    for bad in ('{"session": "s", "seq": 1, "kind": "edit", "extra": 1}', '{"session": "s"', '{"session": "s", "seq": 1, "kind": "dance"}', '{"seq": 1, "kind": "edit"}'):
        with pytest.raises(Exception, match="invalid event line"):
            work.replay(spark, at("bad", [*good, bad])).select("session").collect()


def test_jobs_and_changes(spark):
    jobs = spark.createDataFrame([(1, "pending", 0, 1, "2024-01-01", None), (2, "running", 1, 5, "2024-01-01", "2024-01-02"), (3, "running", 1, 9, "2024-01-01", "2099-01-01"), (4, "done", 1, 9, "2024-01-01", None)], "job int, state string, attempts int, priority int, created string, lease string")
    jobs = jobs.withColumn("created", F.col("created").cast("timestamp")).withColumn("lease_until", F.col("lease").cast("timestamp"))
    got = work.claim_jobs(jobs, F.lit("2024-06-01").cast("timestamp"), 60, 5).collect()
    assert [(r["job"], r["attempts"], str(r["lease_until"])) for r in got] == [(2, 2, "2024-06-01 00:01:00"), (1, 1, "2024-06-01 00:01:00")]
    snap = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, digest string")
    ch = spark.createDataFrame([("rename", "z", "a", None), ("delete", "b", None, None), ("modify", "c", None, "9"), ("add", "n", None, "5")], "op string, path string, old_path string, digest string")
    assert {tuple(r) for r in work.apply_changes(snap, ch).collect()} == {("z", "1"), ("c", "9"), ("n", "5")}
    many = spark.createDataFrame([(f"p{i}", i) for i in range(6)], "path string, at int")
    assert work.refresh_queue(many, 6).where("rescan").count() == 0 and [tuple(r) for r in work.refresh_queue(many, 5).collect()] == [(None, True)]


def test_ranks_by_name_equal_ranks_over_links(spark):
    import random

    rng = random.Random(2)
    rows = {(f"f{rng.randrange(15)}", f"n{rng.randrange(12)}"): rng.choice(["def", "ref"]) for _ in range(90)}
    s = spark.createDataFrame([(p, n, k) for (p, n), k in rows.items()], "path string, name string, kind string")
    links = s.where("kind = 'ref'").select(F.col("path").alias("src"), "name").join(s.where("kind = 'def'").select(F.col("path").alias("dst"), "name"), "name").select("src", "dst")
    nodes = s.select(F.col("path").alias("node")).distinct()
    table = lambda df: {r["node"]: round(r[1], 9) for r in df.collect()}
    for how in ({}, {"dangling": "drop"}, {"seeds": nodes.limit(2), "dangling": "seeds"}):
        assert table(graph.pagerank_by_name(s, nodes, 4, **how)) == table(graph.pagerank(links, nodes, 4, **how))
    assert table(graph.degree_by_name(s)) == table(graph.degree_centrality(links))


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(100, 101)], "src int, dst int")
    got = {r["node"]: r["component"] for r in graph.components(e).collect()}
    assert set(got.values()) == {0, 100} and got[70] == 0


def test_code_edges(spark):
    text = "import os.path\n// note: def nothing\nclass Fold(Base):\n    def walk(self):\n        return scan(tree)\n\nfunc main() { fold(x) }\n"
    f = spark.createDataFrame([("a", text), ("b", None), ("c", "")], "path string, t string")
    e = {(r["line"], r["from"], r["to"], r["kind"]) for r in code.typed_edges(f, "path", "t").collect()}
    assert {(1, "<file>", "os.path", "import"), (3, "<file>", "Fold", "definition"), (3, "Fold", "Base", "inheritance"), (4, "<file>", "walk", "definition"), (5, "walk", "scan", "call"), (5, "walk", "tree", "reference"), (7, "main", "fold", "call")} <= e
    assert not any(x[0] == 2 for x in e)


def test_map_and_reduce(spark):
    s = spark.createDataFrame([(0, 4, "about cursors"), (1, 2, "about nothing")], "community int, docs long, text string")
    got = {r["id"]: (r["score"], r["text"]) for r in arms.map_reduce_answer(s, ["cursors"]).collect()}
    assert got["map-0"][0] == 1.0 and got["map-1"][0] == 0.1 and got["reduce"][1] == "reduce over 2 communities: about cursors | about nothing"


def test_a_generation_is_published_once(spark, tmp_path):
    from tessera.sources.readers import VersionedTable

    a, b = VersionedTable(spark, str(tmp_path / "t")), VersionedTable(spark, str(tmp_path / "t"))
    assert a.publish(spark.range(3)) == 1 and b.publish(spark.range(4)) == 2 and a.load().count() == 4
    b.current = lambda: (1, "v")  # a writer that has not seen generation 2
    with pytest.raises(RuntimeError, match="another writer"):
        b.publish(spark.range(9))
    assert a.load().count() == 4


def test_left_out_files(spark, tmp_path):
    from tessera.sources import readers

    for name, size in (("a.py", 3), ("b.bin", 3), ("vendor/c.py", 3), ("big.py", readers.MAX_FILE_BYTES + 1)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * size)
    got = {r["path"].rsplit("/", 1)[-1]: r["reason"] for r in readers.left_out(spark, str(tmp_path), ignore=["vendor/"]).collect()}
    assert got == {"b.bin": "extension", "c.py": "ignored", "big.py": "too_large"}


def test_media_are_admitted_by_their_content(spark, tmp_path):
    from tessera.sources import connectors

    files = {"a.pdf": b"%PDF-1.7 x", "b.pdf": b"plain text", "c.png": b"\x89PNG\r\n\x1a\nzz", "d.wav": b"RIFF\0\0\0\0WAVEfmt", "e.txt": "é".encode(), "f.txt": b"\xff\xfe\xfa", "g.exe": b"MZ"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[-1]: r["reason"] for r in connectors.admit_media(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": None, "b.pdf": "content", "c.png": None, "d.wav": None, "e.txt": None, "f.txt": "content", "g.exe": "type"}


def test_open_or_refresh(spark, tmp_path):
    from tessera.sources.readers import VersionedTable, open_or_refresh

    t = VersionedTable(spark, str(tmp_path / "t"))
    stamps = spark.createDataFrame([("a", 1, 1)], "path string, size int, mtime int")
    df, fresh = open_or_refresh(t, None, stamps, lambda: spark.range(3))
    assert fresh and df.count() == 3
    df, fresh = open_or_refresh(t, stamps, stamps, lambda: spark.range(9))
    assert not fresh and df.count() == 3
    df, fresh = open_or_refresh(t, stamps, stamps.withColumn("size", F.lit(2)), lambda: spark.range(9))
    assert fresh and df.count() == 9


def test_whole_lines(spark):
    from tessera.operators.evidence import whole_lines

    d = spark.createDataFrame([("é1\nab\ncd", n) for n in (0, 2, 3, 4, 5, 6, 7, 8, 9, 20)] + [(None, 3)], "t string, n int")
    assert [r[0] for r in d.select(whole_lines(F.col("t"), F.col("n"))).collect()] == ["", "", "é1", "é1", "é1", "é1\nab", "é1\nab", "é1\nab", "é1\nab\ncd", "é1\nab\ncd", None]


def test_filters_are_normalised():
    from tessera.operators.relations import normalise_filter

    assert normalise_filter({"Tags": ["b", "a", "b", " "], "source_types": "EN", "tenant": " x ", "scopes": []}) == {"tags": ("a", "b"), "source_types": ("en",), "tenant": "x"}
    for bad in ({"colour": 1}, {"gold_ids": [1]}, {"valid_from": "2025-02-01", "valid_to": "2025-01-01"}):
        with pytest.raises(ValueError):
            normalise_filter(bad)
    assert normalise_filter({"gold_ids": [1]}, blind=False) == {}


def test_recall_of_projections(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 24))
    x = centres[rng.integers(0, 60, 1500)] + 0.25 * rng.standard_normal((1500, 24))
    from tessera.operators import dense

    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, embedding array<double>")
    q = v.where("id % 20 = 0").select(F.col("id").alias("query"), "embedding")
    table = lambda mode: {(r["query"], r["id"]) for r in dense.search(v, q, 10, mode).collect()}
    want, got = table("exact"), table("ann")
    assert len(want) == 750 and len(want & got) / len(want) >= 0.9
    few = v.where("id < 8")
    assert dense.search(few, q.where("query = 0"), 10).count() == 8 and dense.search(few, q.where("query = 0"), 10, "ann").count() == 8


def test_chunk_receipts(spark):
    from tessera.operators import chunking

    text = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(30)) for i in range(12)) + "\n\né end"
    d = spark.createDataFrame([("a", text, "prose"), ("b", None, "prose"), ("c", "", None)], "id string, t string, k string")
    rows = chunking.chunk_receipts(d, "id", "t", "k", 100, 35, 0).collect()
    raw, spans = text.encode(), {r["chunk_id"]: (r["byte_start"], r["byte_end"]) for r in rows}
    parents, children = [r for r in rows if r["role"] == "parent"], [r for r in rows if r["role"] == "child"]
    assert len(parents) == 4 and len(children) >= 12 and {r["doc"] for r in rows} == {"a"}
    for c in children:
        share = {p["chunk_id"]: min(c["byte_end"], p["byte_end"]) - max(c["byte_start"], p["byte_start"]) for p in parents}
        assert share[c["parent_id"]] == max(share.values()) > 0
    assert raw[slice(*spans[children[-1]["chunk_id"]])].decode().endswith("é end")


def test_deltas_and_compaction(spark, tmp_path):
    from tessera.sources.readers import DeltaTable

    t = DeltaTable(spark, str(tmp_path / "d"), ["k"], [F.desc("at")])
    assert t.load() is None
    rows = lambda *x: spark.createDataFrame(list(x), "k int, at int, v string")
    t.append(rows((1, 1, "a"), (2, 1, "b")))
    t.append(rows((1, 2, "c")))
    assert {tuple(r) for r in t.load().collect()} == {(1, 2, "c"), (2, 1, "b")}
    assert t.compact() == 1
    t.append(rows((2, 5, "z")))
    assert {tuple(r) for r in t.load().collect()} == {(1, 2, "c"), (2, 5, "z")}


def test_a_pinned_commit_is_read(spark, tmp_path):
    import subprocess

    from tessera.sources import connectors

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=n@example.org", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "é.txt").write_text("one")
    (tmp_path / "e.py").write_text("")
    git("add", "-A")
    git("commit", "-qm", "first")
    first = git("rev-parse", "HEAD")
    (tmp_path / "d" / "é.txt").write_text("changed")
    git("commit", "-qam", "second")
    got = {r["path"]: (bytes(r["content"]).decode(), r["size"], r["mode"]) for r in connectors.read_commit(spark, str(tmp_path), first, 2).collect()}
    assert got == {"d/é.txt": ("one", 3, "100644"), "e.py": ("", 0, "100644")}


def test_postings_are_verified(spark, tmp_path):
    import glob
    import os

    from tessera.sources import readers

    root = str(tmp_path / "p")
    readers.save_postings(spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "doc string, token string, tf int"), root)
    assert readers.verify_postings(spark, root) and not readers.verify_postings(spark, str(tmp_path / "none"))
    os.remove(next(f for f in glob.glob(f"{root}/v-*/bucket=*/*.parquet")))
    assert not readers.verify_postings(spark, root)


def test_postings_are_saved_without_a_shuffle(spark, tmp_path):
    """Counted by row and written from there; rows of one document are added up when they are read."""
    from tessera.functions import text as T
    from tessera.operators import index
    from tessera.sources import readers

    rows = [(1, "b a b  B c"), (2, ""), (3, None), (4, "zz"), (1, "a a"), (None, "a É é e\u0301"), (5, "?!"), (6, "ab " * 3000)]
    d = spark.createDataFrame(rows, "id bigint, t string").repartition(3)
    post = index.row_postings(d, "id", T.unicode_tokens("t"))
    assert "Exchange" not in index.row_postings(spark.range(9).select("id", F.lit("a").alias("t")), "id", T.unicode_tokens("t"))._jdf.queryExecution().executedPlan().toString()
    assert post.dtypes == [("doc", "bigint"), ("token", "string"), ("tf", "bigint")] and post.count() == 9
    readers.save_postings(post, str(tmp_path / "p"), parts=2)
    want = index.postings(d, "id", T.unicode_tokens("t"))
    key = lambda r: (r["doc"] or 0, r["token"])
    assert sorted(readers.load_postings(spark, str(tmp_path / "p")).collect(), key=key) == sorted(want.collect(), key=key)
    got = readers.load_postings(spark, str(tmp_path / "p"), ["a", "none"])
    assert sorted((r["doc"] or 0, r["token"], r["tf"]) for r in got.collect()) == [(0, "a", 1), (1, "a", 3)] and readers.verify_postings(spark, str(tmp_path / "p"))


def test_checksums_of_many_rows(spark):
    """More rows than a sum of their hashes as one long can hold; few rows have the plain sum, as the sums of older postings have."""
    from tessera.sources import readers

    assert tuple(readers.checksum(spark.range(0), ["id"]).first()) == (0, 0)
    for n in (1000, 1 << 25):
        d = spark.range(n)
        plain = d.agg(F.sum(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("decimal(20,0)"))).first()[0]
        assert (n < 1 << 25) == (plain < 1 << 63)
        got = readers.checksum(d, ["id"])
        assert got.dtypes == [("rows", "bigint"), ("checksum", "bigint")] and tuple(got.first()) == (n, int(plain) % (1 << 63))


def test_polling():
    from tessera.streaming import jobs

    seen = iter([True, False, True])
    assert jobs.poll(lambda: next(seen), 0.01, 3) == 2


@pytest.mark.parametrize("question,want", [
    ("", "basic"), ("List all of the exporters", "completeness"), ("Are there any customers besides Acme?", "completeness"), ("Are there any exports?", "info_not_found"), ("Was it corrected or superseded instead of moved?", "conflicting_info"),
    ("How do we start a rollout?", "project_related"), ("When was the cursor moved?", "basic"), ("Tell me more", "semantic"),
])
def test_question_types(spark, question, want):
    from tessera.functions import questions as Q

    assert spark.createDataFrame([(question,)], "q string").select(Q.effective_type(F.col("q"))).first()[0] == want
