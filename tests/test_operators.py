"""Operators on small hand-made inputs: nulls, empty tables, ties, repeated rows, extra columns."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import chunking, claims, graph, index, metrics, privacy, ranking, relations
from tessera.sources import readers
from tessera.streaming import jobs


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def test_tokens(spark):
    d = spark.createDataFrame([("A b_c É x9 the", ), (None, )], "t string")
    got = d.select(T.unicode_tokens("t").alias("u"), T.index_tokens("t").alias("i"), T.ascii_tokens("t").alias("a")).collect()
    assert got[0]["u"] == ["a", "b", "c", "é", "x9", "the"]
    assert got[0]["i"] == ["b_c", "é", "x9", "the"]
    assert got[0]["a"] == ["a", "b", "c", "x9", "the"]
    assert got[1]["u"] is None


def test_query_terms():
    assert T.query_terms("How is the cursor stored, the CURSOR?") == ["cursor", "stored"]
    assert T.query_terms("the") == ["the"]
    assert T.query_terms("the of") == ["the", "of"]


def test_bm25_against_formula(spark):
    import math

    d = spark.createDataFrame([(1, "alpha beta beta", 9), (2, "beta gamma", 9), (3, "delta", 9)], "id int, t string, extra int")
    got = dict(rows(ranking.bm25(d, "id", T.index_tokens("t"), ["beta", "beta", "zeta"])))
    avg, idf = 2.0, math.log(1 + (3 - 2 + 0.5) / 2.5)
    want = {i: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg)) for i, tf, dl in ((1, 2, 3), (2, 1, 2))}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    assert rows(ranking.bm25(d.where("false"), "id", T.index_tokens("t"), ["beta"])) == []


def test_path_rules(spark):
    d = spark.createDataFrame([("src/iconfigurationService.ts",), ("a/tests/x.go",), ("a/testing/x.go",), ("node_modules/a.js",)], "p string")
    got = [round(r[0], 6) for r in d.select(ranking.path_multiplier(F.col("p"))).collect()]
    assert got == [1.725, 0.1, 0.3, 0.25]


def test_rrf_ties_by_first_seen(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "doc string, rank int")
    b = spark.createDataFrame([("y", 1), ("x", 2)], "doc string, rank int")
    got = ranking.rrf([a, b]).orderBy(F.desc("score"), "first_list", "first_rank").collect()
    assert [r["doc"] for r in got] == ["x", "y"] and got[0]["score"] == pytest.approx(1 / 61 + 1 / 62)


def test_coverage_rerank_prefers_new_documents(spark):
    pool = spark.createDataFrame([("q", "d1", "c1", ["a", "b"], 1.0), ("q", "d1", "c2", ["a", "b"], 0.99), ("q", "d2", "c3", ["c"], 0.6)], "query string, doc string, chunk string, tokens array<string>, relevance double")
    got = [r["chunk"] for r in ranking.coverage_rerank(pool, 3).orderBy("place").collect()]
    assert got == ["c1", "c3", "c2"]


def test_cosine_zero_and_length(spark):
    d = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in d.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_snapshot_delta_rename_pairs(spark):
    s = "path string, blob string, mode string"
    old = spark.createDataFrame([("a", "1", "m"), ("b", "1", "m"), ("c", "2", "m"), ("k", "9", "m")], s)
    new = spark.createDataFrame([("c", "3", "m"), ("x", "1", "m"), ("n", "7", "m"), ("k", "9", "m")], s)
    got = rows(relations.snapshot_delta(old, new).na.fill("-"))
    assert got == [("add", "n", "-"), ("delete", "b", "-"), ("modify", "c", "-"), ("rename", "x", "a")]
    assert rows(relations.snapshot_delta(old.where("false"), new.where("false"))) == []


def test_filter_reasons(spark):
    d = spark.createDataFrame(
        [("A", "s", "doc", ["x", "y"], "2024-01-01", "2024-02-01", [], []), ("b", "s", "doc", ["x"], "2024-01-01", "2024-02-01", [], []), ("a", "s", "doc", None, "2024-01-01", "2024-02-01", [], []),
         ("a", "s", "doc", ["x"], None, None, [], []), ("a", "s", "doc", ["x"], "2024-01-01", "2024-02-01", ["p"], []), ("a", "s", "doc", ["x"], "2024-01-01", "2024-02-01", [], ["q"])],
        "tenant string, scope string, source_type string, tags array<string>, valid_from string, valid_to string, deny_principals array<string>, allow_principals array<string>",
    ).withColumn("valid_from", F.col("valid_from").cast("timestamp")).withColumn("valid_to", F.col("valid_to").cast("timestamp"))
    reason = relations.deny_reason("a", ("s",), ("DOC",), ("x",), "2024-01-15", "2024-01-20", "p")
    assert [r[0] for r in d.select(reason).collect()] == [None, "tenant", "tags", "validity", "principal_denied", "principal_not_allowed"]


def test_parent_links_ties_go_to_the_earliest(spark):
    s = "doc int, id string, start int, end int"
    c = spark.createDataFrame([(1, "c", 10, 20)], s)
    p = spark.createDataFrame([(1, "p2", 15, 30), (1, "p1", 5, 15), (1, "far", 40, 50)], s)
    assert rows(relations.parent_links(c, p)) == [(1, "c", "p1")]


def test_drop_contained(spark):
    d = spark.createDataFrame([(1, 0, 10), (1, 2, 5), (1, 5, 15), (1, 7, 7)], "doc int, start int, end int")
    assert rows(relations.drop_contained(d)) == [(1, 0, 10), (1, 5, 15)]


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(40)]
    hub = [(100, i) for i in range(101, 160)]
    e = spark.createDataFrame(path + hub + [(7, 7)], "src int, dst int")
    got = dict(rows(graph.components(e)))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100}


def test_pagerank_mass_is_kept(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c")], "src string, dst string")
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    r = dict(rows(graph.pagerank(e, n, 10)))
    assert sum(r.values()) == pytest.approx(1.0)
    seeded = dict(rows(graph.pagerank(e, n, 10, seeds=spark.createDataFrame([("c",)], "node string"), dangling="seeds")))
    assert seeded["c"] > 0.9


def test_claim_ladder(spark):
    cols = "id int, subject string, predicate string, object string, valid_from timestamp, valid_to timestamp, status string, quality int, documents array<int>, supersedes int, superseded_by int"
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d)
    data = [
        (1, "one", "p", "x", t(1), None, "active", 1, [1], None, None),
        (2, "sup", "p", "x", t(1), None, "active", 1, [1], None, None), (3, "sup", "p", "y", t(1), None, "active", 0, [1], 2, None),
        (4, "q", "p", "x", t(1), None, "active", 2, [1], None, None), (5, "q", "p", "y", t(1), None, "active", 1, [1, 2], None, None),
        (6, "d", "p", "x", t(1), None, "active", 1, [1, 2], None, None), (7, "d", "p", "y", t(1), None, "active", 1, [1], None, None),
        (8, "w", "p", "x", t(1), t(3), "active", 1, [1], None, None), (9, "w", "p", "y", t(1), t(9), "active", 1, [1], None, None),
        (10, "tie", "p", "x", t(1), None, "active", 1, [1], None, None), (11, "tie", "p", "y", t(1), None, "active", 1, [1], None, None),
        (12, "m", "tags", "x", t(1), None, "active", 1, [1], None, None), (13, "m", "tags", "y", t(1), None, "active", 1, [1], None, None),
    ]
    got = {r["subject"]: (r["reason"], r["winner"]) for r in claims.resolve(spark.createDataFrame(data, cols), ["subject", "predicate"]).collect()}
    assert got == {"one": ("single", 1), "sup": ("supersession", 3), "q": ("evidence_quality", 4), "d": ("document_count", 6), "w": ("tighter_valid_window", 8), "tie": ("tie", None), "m": ("multi_valued_predicate", None)}


def test_blocks_and_packing():
    text = "# A\none two\n\nthree four five\n\n# B\nsix"
    assert [text[a:b].strip() for a, b in chunking.blocks(text, "prose")] == ["# A\none two", "three four five", "# B\nsix"]
    code = "x = 1\n```\na\n\nb\n```\ny = 2\n"
    assert [code[a:b].strip() for a, b in chunking.blocks(code, "code")] == ["x = 1", "```\na\n\nb\n```", "y = 2"]
    long = " ".join(map(str, range(50)))
    cut = chunking.pack_blocks(long, [(0, len(long))], 20, 5)
    assert [long[a:b].split()[0] for a, b in cut] == ["0", "15", "30"]


def test_structure_chunks_offsets(spark):
    d = spark.createDataFrame([("a", "é one\n\ntwo", "prose"), ("b", None, "prose"), ("c", "", None)], "id string, t string, k string")
    got = chunking.structure_chunks(d, "id", "t", "k", 1, 0).orderBy("seq").collect()
    raw = "é one\n\ntwo".encode()
    assert [raw[r["byte_start"] : r["byte_end"]].decode() for r in got] == ["é", "one", "two"]


def test_cards_and_status(spark):
    d = spark.createDataFrame([("4111 1111 1111 1111",), ("4111 1111 1111 1112",), ("411",)], "n string")
    assert [r[0] for r in d.select(privacy.valid_card(F.col("n"))).collect()] == [True, False, False]
    s = spark.createDataFrame([("id 123-45-6789 a@b.org",), ("a@b.org",), ("none",), ("pay 4111 1111 1111 1111",), ("row 4111 1111 1111 1112x",), ("pwd = hunter2",)], "t string")
    assert [r[0] for r in s.select(privacy.status(privacy.counts(F.col("t")))).collect()] == ["tombstone", "redact", "clean", "quarantine", "redact", "quarantine"]
    m = spark.createDataFrame([("é a@b.org, password: höf 4111 1111 1111 1111",), ("no find",), ("-----BEGIN RSA PRIVATE KEY-----\nab",)], "t string")
    assert [r[0] for r in m.select(privacy.masked(F.col("t"))).collect()] == ["é *******, ************** *******************", "no find", "*" * 34]


def test_detectors_are_pluggable(spark):
    import pandas as pd

    d = spark.createDataFrame([(1, "é a@b.org and 123-45-6789"), (2, None), (3, "ghp_abcdefghij0123456789")], "id int, t string")
    got = {(r["doc"], r["cls"], r["start"], r["end"]) for r in privacy.detect(d, "id", "t", classes=["email", "ssn", "api_key"]).collect()}
    assert got == {(1, "email", 3, 10), (1, "ssn", 15, 26), (3, "api_key", 0, 24)}
    privacy.detector("first_letter")(lambda texts: pd.Series([[{"cls": "x", "start": 0, "end": 1}] for _ in texts]))
    assert privacy.detect(d, "id", "t", "first_letter").count() == 2
    privacy.detector("broken")(lambda texts: pd.Series([[{"cls": "x", "start": 0, "end": 999}] for _ in texts]))
    import pytest

    with pytest.raises(Exception, match="outside its text"):
        privacy.detect(d, "id", "t", "broken").collect()


def test_privacy_evaluation(spark):
    s = "doc int, cls string, start int, end int"
    p = spark.createDataFrame([(1, "email", 0, 5), (1, "email", 9, 12)], s)
    e = spark.createDataFrame([(1, "email", 0, 5), (2, "ssn", 1, 4)], s)
    r = privacy.evaluate(p, e).first()
    assert (r["hit"], r["precision"], r["recall"]) == (1, 0.5, 0.5)
    empty = privacy.evaluate(p.where("false"), e.where("false")).first()
    assert (empty["precision"], empty["recall"]) == (1.0, 1.0)


def test_retrieval_metrics(spark):
    ranked = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "c", 1)], "query string, doc string, rank int")
    gold = spark.createDataFrame([("q1", "b"), ("q2", "z")], "query string, doc string")
    r = metrics.retrieval(ranked, gold).first()
    assert r["hit_at_1"] == 0 and r["hit_at_5"] == 0.5 and r["mrr"] == 0.25


def test_tier_budget_skips_what_does_not_fit(spark):
    d = spark.createDataFrame([("s", i, "L0", i, n) for i, n in enumerate((6, 8, 3))], "session string, item int, tier string, position int, size int")
    assert rows(relations.tier_budgets(d, {"L0": 10}), "item") == [(0,), (2,)]


def test_evidence_orders(spark):
    d = spark.createDataFrame([("p", f"i{k}", "f", 9 - k, k) for k in range(5)], "pack string, item string, path string, line int, rank int")
    order = lambda m: [r["item"] for r in relations.evidence_order(d, m).orderBy("place").collect()]
    assert order("original") == ["i4", "i3", "i2", "i1", "i0"] and order("tail_first") == ["i4", "i3", "i2", "i1", "i0"]
    assert order("head_tail") == ["i0", "i2", "i4", "i3", "i1"] and order("retrieval") == ["i0", "i1", "i2", "i3", "i4"]


def test_ignore_rules(spark):
    d = spark.createDataFrame([("/r/node_modules/a.js",), ("/r/build/keep.txt",), ("/r/build/x.txt",), ("/r/a.log",)], "p string")
    rule = readers.ignored(F.col("p"), ["node_modules/", "build/*", "!keep.txt", "*.log", "# note"])
    assert [r[0] for r in d.select(rule).collect()] == [True, False, True, True]


def test_crawl_and_listing(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.go").write_text("package a")
    (tmp_path / "a" / "y.bin").write_bytes(b"\0")
    assert [r["text"] for r in readers.crawl(spark, str(tmp_path)).collect()] == ["package a"]
    assert readers.list_files(spark, str(tmp_path)).count() == 1


def test_alias_keys_and_broken_lines(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"doc_id": "1", "content": "t", "path": "u"}\nnot json\n{"id": "2"}\n')
    assert rows(readers.read_documents(spark, str(tmp_path)), "id", "text", "uri") == [("1", "t", "u")]


def test_symbol_index(spark):
    doc = '{"documents":[{"relative_path":"a.go","language":"go","occurrences":[{"range":[3,4],"symbol":"f","symbol_roles":1},{"range":[5,1],"symbol":"f","symbol_roles":0}]}]}'
    got = readers.decode_symbol_index(spark.createDataFrame([(doc,), (None,)], "j string"), "j")
    assert rows(got, "path", "kind", "line", "column") == [("a.go", "definition", 3, 4), ("a.go", "reference", 5, 1)]


def test_versioned_upsert(spark, tmp_path):
    t = readers.VersionedTable(spark, str(tmp_path / "t"))
    assert t.load() is None
    t.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), ["k"], [F.desc("v")])
    assert t.upsert(spark.createDataFrame([("a", 2), ("a", 0)], "k string, v int"), ["k"], [F.desc("v")]) == 2
    assert rows(t.load()) == [("a", 2), ("b", 1)]


def test_refresh_builds_only_changes(spark, tmp_path):
    src, out, seen = tmp_path / "in", str(tmp_path / "out"), []
    schema = "id string, text string"
    spark.createDataFrame([("a", "1"), ("b", "1")], schema).coalesce(1).write.parquet(str(src / "one"))

    def build(df):
        seen.extend(r["id"] for r in df.select("id").collect())
        return df.withColumn("n", F.length("text"))

    ck = str(tmp_path / "ck")
    read = lambda: jobs.file_stream(spark, str(src / "*"), "*.parquet", spark.read.parquet(str(src / "one")).schema)
    jobs.refresh_changed(read(), out, "id", "text", build, ck)
    spark.createDataFrame([("a", "22"), ("b", "1")], schema).coalesce(1).write.parquet(str(src / "two"))
    t = jobs.refresh_changed(read(), out, "id", "text", build, ck)
    assert sorted(seen) == ["a", "a", "b"] and rows(t.load(), "id", "n") == [("a", 2), ("b", 1)]


def test_hypotheses_and_neighbours(spark):
    e = spark.createDataFrame([(1, 2, 1.9), (2, 3, 0.15)], "src int, dst int, weight double")
    s = spark.createDataFrame([(1, "Cursor"), (2, "cursor"), (3, "ab")], "doc int, subject string")
    assert rows(graph.hypothesise(e, s)) == [(1, 2, 2.0)]
    assert rows(graph.neighbours(e, spark.createDataFrame([(1,)], "node int"), 2)) == [(1, 0), (2, 1), (3, 2)]


def test_decay(spark):
    d = spark.createDataFrame([(0.5, 7 * 86400.0), (2.0, 365 * 86400.0), (0.011, 1e9)], "s double, t double")
    assert [round(r[0], 6) for r in d.select(claims.decayed(F.col("s"), F.col("t"))).collect()] == [0.25, 1.0, 0.01]


def test_postings_of_empty_table(spark):
    d = spark.createDataFrame([], "id int, t string")
    assert index.postings(d, "id", T.index_tokens("t")).count() == 0


def test_question_helpers(spark):
    from tessera.functions import questions as Q

    assert Q.identifiers("why does fetchRows call `a b` in pkg/x.go for ABC-12?") == ["fetchRows", "a b", "pkg/x.go", "ABC-12"]
    assert Q.variants("the of")[0] == "the of" and len(Q.variants("where is read_cache used by the planner")) == 3
    assert Q.decompose("Where is the cache stored and who owns the nightly replay", True) == ["Where is the cache stored", "who owns the nightly replay?"]
    assert Q.infer_plan("how many shards")["type"] == "wide" and Q.infer_plan("read_cache")["type"] == "exact"
    d = spark.createDataFrame([(["abc", "ab", "abc"],), (None,)], "t array<string>")
    v = [sum(r[0]) for r in d.select(Q.hash_embedding(F.col("t"))).collect()]
    assert v == [2.0, 0.0]
    t = spark.createDataFrame([("Cursor planner rebuilds shards",), (None,)], "t string")
    assert [len(r[0]) for r in t.select(Q.question_lines(F.col("t"))).collect()] == [4, 0]


def test_tree_source_and_media(spark, tmp_path):
    import hashlib

    from tessera.sources import connectors

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("hi")
    (tmp_path / "e.png").write_bytes(b"\x89PNG\r\n\x1a\n12")
    (tmp_path / "z.exe").write_bytes(b"1")
    got = {r["path"]: r for r in connectors.read_tree(spark, str(tmp_path)).collect()}
    assert set(got) == {"a/x.txt", "e.png", "z.exe"} and got["a/x.txt"]["blob"] == hashlib.sha1(b"blob 2\0hi").hexdigest()
    assert rows(connectors.admit_media(spark, str(tmp_path)).na.fill("-"), "kind", "admitted", "reason") == [("exe", False, "type"), ("png", True, "-"), ("txt", True, "-")]


def test_evidence_operators(spark):
    from tessera.operators import evidence as E

    d = spark.createDataFrame([("aé語x",), ("ab",), (None,)], "t string")
    assert [r[0] for r in d.select(E.clip_bytes(F.col("t"), 5)).collect()] == ["aé", "ab", None]
    pool = spark.createDataFrame([("q", "d", "long text", 0.5), ("q", "e", None, 0.4)], "query string, doc string, text string, score double")
    got = rows(E.rerank_with(pool, lambda q, t: t.str.len().astype("float64")), "doc", "score")
    assert got == [("d", 9.0), ("e", 0.4)]
    jobs = spark.createDataFrame([("d", "context_header", "first line\nrest"), ("e", "other", "x")], "doc string, kind string, text string")
    assert rows(E.run_workers(jobs, "context_header"), "doc", "output") == [("d", "From d: first line")]
    edges = spark.createDataFrame([("f", "pkg/cursor", False), ("g", "pkg/cursor", True)], "file string, to string, resolved boolean")
    assert rows(E.import_stem_edges(edges, "Cursor"), "file") == [("f",)]
    s = spark.createDataFrame([(1, "One two. Cursor planner here! Cursor"), (2, None)], "id int, t string")
    assert rows(E.support_sentences(s, "id", "t", ["cursor", "planner"])) == [(1, "Cursor planner here!", 2)]


def test_impact_keeps_every_definer_and_ranks_the_rest(spark):
    from tessera.operators import relations as R

    defs = [(f"z/d{i:02d}.go", "Widget", "def") for i in range(30)]
    refs = [(f"a/tests/r{i:02d}.go", "widget", "ref") for i in range(24)] + [(f"src/r{i}.go", "Widget", "ref") for i in range(3)]
    s = spark.createDataFrame([*defs, *refs, ("n/near.go", "Other", "ref"), ("z/d29.go", "Other", "def")], "path string, name string, kind string")
    imports = spark.createDataFrame([(f"i/{i:02d}.go", "x/D07") for i in range(20)], "path string, target string")
    edges = spark.createDataFrame([("c/call.go", 0, "f", "Widget", "call"), ("c/self.go", 0, "Widget", "Widget", "call")], "file string, position int, from string, to string, kind string")
    got = {r["path"]: r["hops"] for r in R.impact(s, "Widget", imports=imports, edges=edges).collect()}
    direct = {p for p, h in got.items() if h == 0}
    assert {p for p, _, _ in defs} <= direct and {"src/r0.go", "src/r1.go", "src/r2.go"} <= direct and "c/call.go" in direct and "c/self.go" not in got
    assert sum(p.startswith("a/tests") for p in direct) == 21 and {p for p in direct if p[0] == "i"} == {f"i/{i:02d}.go" for i in range(16)} and got["n/near.go"] == 1


def test_seeds_by_path_and_symbol(spark):
    from tessera.operators import relations as R

    files = spark.createDataFrame([(f"m{i}/a/b.go",) for i in range(9)] + [("a/b.go",)], "path string")
    s = spark.createDataFrame([("x.go", "Widget", "def"), ("y.go", "widget", "def"), ("z.go", "Widget", "ref")], "path string, name string, kind string")
    got = lambda seed: sorted(r["path"] for r in R.resolve_seeds(files, s, seed).collect())
    assert got("a/b.go") == ["a/b.go"] and got("/a/b") == [f"m{i}/a/b.go" for i in range(5)] and got("WIDGET") == ["x.go", "y.go"] and got(" ") == []
