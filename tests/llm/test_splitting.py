import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import splitting as S


def check(text, kind, limit, overlap):
    out, end = S.spans(text, kind, limit, overlap), 0
    rebuilt = ""
    for i, (a, b) in enumerate(out):
        assert b - a <= limit and a <= end and (i == 0 or 0 <= end - a <= overlap)
        rebuilt = rebuilt[:a] + text[a:b]
        end = b
    assert rebuilt == text
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab c.\n,|#é\r\t語́‍")), min_size=0, max_size=900), st.sampled_from([None, "prose", "CODE", "table", "chat", "slides", "odd"]))
def test_nothing_is_lost(text, kind):
    check(text, kind, 100, 20)


def test_very_long_and_boundless_text():
    rng = random.Random(3)
    text = "".join(rng.choice("abcde .\n") for _ in range(300_000))
    check(text, "prose", 2000, 200)
    pieces = check("x" * 10_001, None, 2000, 200)
    assert all(b - a == 2000 for a, b in pieces[:-1])


def test_cuts_at_the_strongest_boundary_rightmost_on_ties():
    text = "a" * 60 + "\n\n" + "b" * 20 + ". " + "c" * 60
    assert S.spans(text, "prose", 100, 0)[0] == (0, 62)
    ties = "a" * 55 + ". " + "b" * 20 + ". " + "c" * 90
    assert S.spans(ties, "prose", 100, 0)[0] == (0, 79)


def test_range_max():
    v = np.array([1, 3, 3, 0, 2, 3, 1])
    r = S.RangeMax(v, len(v))
    for lo in range(len(v)):
        for hi in range(lo, len(v)):
            best = max(range(lo, hi + 1), key=lambda i: (v[i], i))
            assert r.best(lo, hi) == best


def test_table(spark):
    long = "One sentence here. " * 300
    df = spark.createDataFrame(
        [("a", long, "prose", 1, "x"), ("a", long, "prose", 1, "x"), ("a", "old " * 900, "prose", 0, "x"), ("b", "short", None, 1, "x"), ("c", None, None, 1, "x"), (None, long, None, 1, "x")],
        "id string, t string, kind string, at int, piece string",
    )
    got = S.split_texts(df, "id", "t", "kind", "at").orderBy("piece_no").collect()
    assert {r["record_id"] for r in got} == {"a"} and [r["piece_no"] for r in got] == list(range(len(got)))
    assert all(long[r["start_pos"] : r["end_pos"]] == r["piece"] for r in got) and got[-1]["end_pos"] == len(long)
    assert S.split_texts(df.where("false"), "id", "t", "kind", "at").count() == 0


def test_the_kind_counts_all_lines():
    from tessera.llm.splitting import kind_of

    assert kind_of("A licence in plain words\n" * 210 + "x = f(1);\n" * 800, None) == "code"
