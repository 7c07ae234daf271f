import random

from tessera.llm import leakage as L
from tessera.llm.words import words


def brute(docs, items, run):
    out = set()
    for d, t in docs:
        w = words(t or "")
        grams = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for k, x in items:
            v = words(x or "")
            if any(tuple(v[i : i + run]) in grams for i in range(len(v) - run + 1)):
                out.add((d, k))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(30)] + ["É_x", "İz"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40)))) for i in range(25)] + [(90, None), (91, ""), (92, "w1 w2")]
    docs = [(i, ", ".join(rng.choice(vocab) for _ in range(30))) for i in range(30)] + [(60, None), (61, "")]
    docs += [(100 + i, "Foo " + rng.choice(items[:25])[1].upper().replace(" ", "\n> ") + " bar" if items[i][1] else "x") for i in range(25)]
    docs.append((200, "pad " * 50_000 + items[0][1] + " z"))
    d, q = frames(spark, docs, items)
    want = brute(docs, items, L.RUN)
    get = lambda: {(r["doc_id"], r["item_id"]) for r in L.leaked_items(d, q, "doc_id", "text", "item_id", "text").collect()}
    assert get() == want and want
    monkeypatch.setattr(L, "ITEM_WORDS", 100)  # many parts
    assert get() == want


def test_offsets_and_empty(spark):
    item = "one two three four five six seven eight nine ten eleven"
    d, q = frames(spark, [(1, "İntro: One, two three four\nfive six seven eight nine TEN end")], [(7, item)])
    r = L.leaked_items(d, q, "doc_id", "text", "item_id", "text").first()
    text = "İntro: One, two three four\nfive six seven eight nine TEN end"
    assert text[r["start_pos"] : r["end_pos"]].startswith("One, two") and text[r["start_pos"] : r["end_pos"]].endswith("TEN") and r["matched_words"] == 10
    assert L.leaked_items(d.where("false"), q, "doc_id", "text", "item_id", "text").count() == 0
    assert L.leaked_items(d, q.where("false"), "doc_id", "text", "item_id", "text").count() == 0


def test_answers_are_a_part_of_their_own(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    d = spark.createDataFrame([(1, f"see {long} and Forty-Two."), (2, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10; forty two"), (3, "forty two only, nothing else of any item is here at all")], "doc_id bigint, text string")
    q = spark.createDataFrame([(7, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11", "forty two"), (8, "none of it", long), (9, None, None)], "item_id bigint, text string, gold string")
    got = {(r["doc_id"], r["item_id"], r["part"]): r for r in L.leaked_items(d, q, "doc_id", "text", "item_id", "text", "gold").collect()}
    assert set(got) == {(1, 8, "answer"), (2, 7, "question")}
    assert got[2, 7, "question"]["answer_pos"] == len("q1 q2 q3 q4 q5 q6 q7 q8 q9 q10; ") and got[1, 8, "answer"]["answer_pos"] == 4


def test_repeated_words_and_shared_codes(monkeypatch):
    m = L.ItemAutomaton([(1, "question", "blank " * 30), (2, "question", "blank " * 9)])
    rows = m.rows(5, "x " + "blank " * 20_000)
    assert [r[:5] for r in rows] == [(5, 1, "question", 20_000, 30)]
    monkeypatch.setattr(L, "_LAST", L._FIRST + L._GAP + 3)  # three codes for all words: hits are compared by words
    m = L.ItemAutomaton([(1, "question", " ".join(f"w{i}" for i in range(40)))])
    assert m.rows(1, " ".join(f"w{i + 3}" for i in range(40))) and not m.rows(1, " ".join(f"w{i}" for i in range(40, 80)))
