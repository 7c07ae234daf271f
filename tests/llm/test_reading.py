import random

from tessera.llm import reading as R

EASY = ["the dog is in the box", "we see the red hat on it", "it is a big cup and we like it"]
HARD = ["notwithstanding the methodological heterogeneity of the investigation it is epistemologically indeterminate", "the presupposition is that institutional accountability and the theoretical parsimony are incommensurable"]


def doc(rng, level):
    pool = {1: EASY, 4: HARD}.get(level) or (EASY + HARD)
    return ". ".join(rng.choice(pool) for _ in range(14)) + "."


def test_levels_and_defined_cases(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(120):
        level = 1 if i % 2 else 4
        docs.append((i, doc(rng, level), "prose", level, "x"))
        if i < 60:
            labels += [(i, "a", level), (i, "a", level), (i, "b", level), (i, "b", None)]
    docs += [(200, None, "prose", 0, "x"), (201, "", "prose", 0, "x"), (202, doc(rng, 1), "code", 0, "x"), (203, "the dog", "prose", 0, "x")]
    docs += [(204, "Der Hund und die Katze sind nicht im Haus und das ist mit dem Kind " * 8, "prose", 0, "x"), (205, "```\n" + "the code is in the box and we see it " * 12 + "\n```", "prose", 0, "x"), docs[0]]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, kind string, truth int, level string")
    l = spark.createDataFrame(labels, "doc_id bigint, rater string, level int")
    got = {r["doc_id"]: r["level"] for r in R.reading_levels(d, l).collect()}
    held = [i for i in range(60, 120)]
    assert sum(got[i] == docs[i][3] for i in held) >= 57
    assert not {200, 201, 202, 203, 204} & set(got) and 205 in got
    assert R.reading_levels(d.where("false"), l).count() == 0
    assert R.reading_levels(d, l.where("false")).count() == len(got)


def test_running_text():
    text = "Menu  Home  Search\n\n<p>It is &amp; fine (see lib/a.py) [pkg/b.go] `x()`</p>\n```\ncode\n```\n| a | b |\na,1,b_c,3\n> quoted\nx = 1;\nDone here."
    assert R.running_text(text).split("\n") == ["It is & fine", "Done here."]


def test_best_cuts():
    import numpy as np

    t = np.array([1.0, 1.2, 2.0, 2.1, 3.0, 3.2, 3.9])
    cuts = R.best_cuts(t, np.array([1, 1, 2, 2, 3, 3, 4]), np.ones(7))
    assert [int(sum(x >= c for c in cuts)) + 1 for x in t] == [1, 1, 2, 2, 3, 3, 4]


def test_newton_finds_the_curves():
    import numpy as np

    nodes, trials = np.linspace(-2, 2, 41), np.full(41, 50_000.0)
    truth = np.array([[-3.0, 1.5, 0.0], [-4.0, -1.0, 2.0], [-5.0, 0.0, 4.0]])
    prob = 1 / (1 + np.exp(-(truth @ np.stack([np.ones(41), nodes, -nodes * nodes / 2]))))
    x = prob * trials
    sums = np.stack([x.sum(1), (x * nodes).sum(1), (x * nodes**2).sum(1)])
    start = np.tile([-3.0, 0.0, 0.7], (3, 1))
    got = R.newton(sums, nodes, trials, np.ones(3), start, 30)
    assert np.abs(got - truth).max() < 0.03


def test_levels_of_documents_from_known_curves():
    import numpy as np

    rng = np.random.default_rng(1)
    length, c = np.full(R.SLOTS, 4.0), np.full(R.SLOTS, -np.inf)
    p, q = np.zeros(R.SLOTS), np.zeros(R.SLOTS)
    where = rng.uniform(0, 5, 400) - R.MIDDLE
    c[:400], p[:400], q[:400] = -7 - where**2, 2 * where, 2.0
    curves = R.Curves(length, c, p, q)
    levels = np.array([1.0, 2.0, 3.0, 4.0])
    prob = np.exp(c[:400] + p[:400] * (levels[:, None] - R.MIDDLE) - (levels[:, None] - R.MIDDLE) ** 2)
    counts = np.array([rng.multinomial(300, row / row.sum()) for row in prob])
    doc, ids = np.nonzero(counts)
    got, places = curves.levels(ids, counts[doc, ids], doc, 4)
    assert np.abs(got - levels).max() < 0.25 and (places == 300).all()
