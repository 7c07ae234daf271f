"""Problem 9: reading level of English prose by a latent difficulty model.

A Rasch-style response model with a logistic curve for each word, single-peaked on one latent scale: at any place
of a document of level t, word w stands with probability

    P(w | t) = logistic(c_w + p_w t - q_w t^2 / 2),   q_w >= 0,

so p_w / q_w is the difficulty of the word and q_w its discrimination (q_w = 0 is the plain Rasch curve with a slope).
A document is a binomial trial for each word: its number of words against the occurrences. Words of one sentence
depend on each other, so the likelihood of a word is tempered by the length of the sentences it stands in.

The estimates alternate until the levels move by less than ``SETTLED`` on average:

* documents: the tempered likelihood depends on a document only through sum(x p), sum(x q) and its number of words,
  so each document's level is its maximum over a grid, refined by a parabola (one pass in the tasks);
* words: (c, p, q) by Newton steps from the sufficient statistics sum(x), sum(x t), sum(x t^2) of the word and the
  histogram of all documents' levels. Weak normal priors keep rare words near a flat curve.

Documents judged by people anchor the scale: their levels are fixed at the mean of the judgments, each rater's
severity removed, and the others' raw levels are brought to it by a line fitted on the judged ones each round.

All words of all documents take part. Words are held in ``SLOTS`` slots by a hash, which bounds what is broadcast and
collected at any size of the corpus (two words that share a slot share a curve: of V words a share of V / SLOTS).

Running text only: markup, entities, menus, code (fenced or not), tables, quotations and references in
brackets are dropped. A level from 1 to 4 comes from cut points that err least on the judged documents.

Defined results: a document that is not of the given kind, null, empty, under ``MIN_WORDS`` words or not
English comes out nowhere; a repeated id comes out once (of differing texts the most difficult one counts); one
without running text gets the level of all its words; without at least ``ANCHORS`` judged documents the scale follows
the length of words and is cut at its quartiles; null levels and repeated judgments do not count.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import WordHashes, words
from tessera.runtime import materialise

MIN_WORDS, ANCHORS = 60, 20
SLOTS = 1 << 18
SETTLED, MOST_ROUNDS = 0.01, 30
GRID = np.linspace(-0.5, 5.5, 61)  # levels at which likelihoods are taken
MIDDLE, PLAIN_LENGTH = 2.5, 15.0
TEMPER = 6.0  # what a sentence counts in the words' step, against their priors
ENGLISH = frozenset("the a an and or of to in is are was were it that this these those with for on as at by be not do you we they which than from can if has have had when then so no but i our your its their also how each before after often about should".split())
OTHER = frozenset("der die das und ist nicht ein eine mit von zu den dem für auf werden wird sind le la les des est une un et dans pour que qui sur pas avec plus du au el los las una y en por con para se su al es como más ne wurde nach aus bei im vom zum son sont cette ce".split())

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_REF = re.compile(r"\((?:see |cf\. )?[\w\-]*[./_][\w./\-]*(?:\s\w+)?\)|\[[^\[\]\s]{1,120}\]|`[^`\n]{0,200}`")
_HIDDEN = re.compile("[­​‌‍⁠﻿]")
_QUOTE = re.compile(r"[“„«\"][^“”„«»\"\n]{60,}?[”“»\"]")
_CODE_START = re.compile(r"\s*(?:#|//|/\*|\*/|\"\"\"|'''|@\w|>|\||\w+\s*=\s*\S|(?:export|assert|yield|import|return|func|def|class|with \w+\()|\[[\w.]+\]\s*$|[\w\-]+:\s*\S*$)")
_CALL, _OPTION = re.compile(r"\w\(\w*\)"), re.compile(r"--\w")
_SENTENCE = re.compile(r"[.!?]\s+|\n")


def _is_code(line: str, bare: str) -> bool:
    """Looks like code, a quotation mark of mail, a table row or a key without a sentence; cheap tests come first."""
    if _CODE_START.match(line) or bare[-1] in ";{}":
        return True
    if "=" in line and ("==" in line or ":=" in line or "=>" in line) or "->" in line:
        return True
    return "(" in line and bool(_CALL.search(line)) or "--" in line and bool(_OPTION.search(line))


def running_text(text: str) -> str:
    """Lines and sentences of prose; empty if there are none."""
    text = _HIDDEN.sub("", html.unescape(text) if "&" in text else text)
    if "```" in text:
        text = _FENCE.sub("\n", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = _REF.sub(" ", text)
    kept = []
    for line in text.replace("\r", "\n").split("\n"):
        bare = line.strip()
        if not bare or _is_code(line, bare) or bare.count(",") >= 3 and " " not in bare.replace(", ", ""):
            continue
        if bare.count(" | ") or bare.count(" > ") or bare.count("  ") >= 2 and len(bare) < 200:
            continue
        kept.append(_QUOTE.sub(" ", bare) if len(bare) > 60 else bare)
    return "\n".join(kept)


def is_english(count: Counter, total: int) -> bool:
    get = count.get
    english = sum([get(w, 0) for w in ENGLISH])
    return english >= 0.06 * total and english > sum([get(w, 0) for w in OTHER]) * 1.5


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    slot = WordHashes()
    for batch in batches:
        out = []
        for doc, text in zip(batch["doc_id"], batch["body"]):
            body = running_text(text)
            found = words(body)
            count = speech = Counter(found)
            total = len(found)
            if total < MIN_WORDS:
                every = words(text)
                total = len(every)
                if total < MIN_WORDS:
                    continue
                speech = Counter(every)
                if not found:
                    body, found, count = text, every, speech
            if not is_english(speech, total):
                continue
            ends = len([s for s in _SENTENCE.split(body) if len(s) > 11]) or 1
            per = len(found) / ends
            # a text without full stops tells nothing of the length of its sentences
            length = per if ends > 2 and per < 60 else 0.0
            held: dict[int, int] = {}
            for w, n in count.items():
                s = slot[w] & (SLOTS - 1)
                held[s] = held.get(s, 0) + n
            out.append((doc, length, (len(body) - len(found)) / len(found), list(held), list(held.values())))
        yield pd.DataFrame(out, columns=["doc_id", "sentence", "letters", "ids", "counts"])


def _judged(labels: DataFrame) -> DataFrame:
    """(doc_id, judged): mean level without the raters' severities; a rater's judgment of a document counts once."""
    rows = labels.where(F.col("level").between(1, 4)).groupBy("doc_id", "rater").agg(F.avg("level").alias("level"))
    mean = rows.groupBy("doc_id").agg(F.avg("level").alias("doc_level"), F.count("*").alias("n"))
    bias = rows.join(mean.where("n > 1"), "doc_id").groupBy("rater").agg((F.sum(F.col("level") - F.col("doc_level")) / (F.count("*") + 20)).alias("bias"))
    return rows.join(bias, "rater", "left").groupBy("doc_id").agg(F.avg(F.col("level") - F.coalesce("bias", F.lit(0.0))).alias("judged"))


class Curves:
    """Response curves of the words by slot, and what a document's likelihood needs of them."""

    def __init__(self, length: np.ndarray, c: np.ndarray, p: np.ndarray, q: np.ndarray):
        self.share = (1 / np.maximum(length, 4)).astype(np.float32)  # one occurrence as a part of a sentence
        self.p, self.q = p.astype(np.float32), q.astype(np.float32)
        u = GRID - MIDDLE
        self.none = np.zeros(len(u))  # the log likelihood of a place where no word stands, with its sign changed
        used = np.nonzero(np.isfinite(c))[0]
        for at in range(0, len(used), 16_384):
            i = used[at : at + 16_384]
            eta = c[i, None] + p[i, None] * u - q[i, None] * u * u / 2
            self.none += (self.share[i, None] * np.logaddexp(0, eta)).sum(0)

    def levels(self, ids: np.ndarray, counts: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(raw level, words) of each of n documents, from their occurrences (slot, count, document)."""
        x = counts * self.share[ids]
        u = GRID - MIDDLE
        a, b, m = np.bincount(doc, x * self.p[ids], n), np.bincount(doc, x * self.q[ids], n), np.bincount(doc, counts, n)
        like = a[:, None] * u - (b[:, None] / 2 + 0.02) * (u * u) - m[:, None] * self.none
        k, i = np.clip(like.argmax(1), 1, len(u) - 2), np.arange(n)
        low, at, high = like[i, k - 1], like[i, k], like[i, k + 1]
        bend = low - 2 * at + high
        shift = np.where(bend < 0, (low - high) / 2 / np.where(bend < 0, bend, 1), 0)
        return GRID[k] + np.clip(shift, -1, 1) * (GRID[1] - GRID[0]), m


def newton(sums: np.ndarray, nodes: np.ndarray, trials: np.ndarray, temper: np.ndarray, theta: np.ndarray, steps: int) -> np.ndarray:
    """(c, p, q) of each word from sum(x), sum(x u), sum(x u^2) and the number of places at each level u of ``nodes``; from ``theta`` on.

    ``temper`` is each word's power of the likelihood, already in the sums."""
    basis = np.stack([np.ones_like(nodes), nodes, -nodes * nodes / 2])
    observed = np.stack([sums[0], sums[1], -sums[2] / 2], 1)
    centre, hold = np.array([0.0, 0.0, 0.7]), np.array([1e-6, 0.25, 1.0])
    outer = (basis[:, None] * basis[None]).reshape(9, -1)
    for _ in range(steps):
        prob = 1 / (1 + np.exp(-np.clip(theta @ basis, -30, 30)))
        held = trials * temper[:, None]
        slope = observed - (prob * held) @ basis.T - hold * (theta - centre)
        bend = ((prob * (1 - prob) * held) @ outer.T).reshape(-1, 3, 3) + np.diag(hold)
        step = np.linalg.solve(bend, slope[:, :, None])[:, :, 0]
        theta = theta + step * np.minimum(1, 2 / np.maximum(np.abs(step).max(1), 1e-9))[:, None]
        theta[:, 2] = np.clip(theta[:, 2], 0, 8)
    return theta


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, count, document of the batch) of each occurrence."""
    lists = batch.column("ids")
    doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    return lists.flatten().to_numpy(zero_copy_only=False), batch.column("counts").flatten().to_numpy(zero_copy_only=False), doc


_MOMENTS, _FREE, _FIXED, _PAIRS = -1, -100, -200, -1_000


def _round(tokens: DataFrame, shared) -> DataFrame:
    """(w, a..f): sums by slot for the words' step. a, b, c: sum(x), sum(x u), sum(x u^2) over documents at their raw level; d, e, f:
    the same over judged documents at their judgment. Negative w: moments of raw level against anchor, the histograms of raw
    levels and of judgments, and the judged documents by raw level and judgment. One row per slot and task at most.

    Without curves (the first pass) the anchors alone are summed, and a, b are the lengths of sentences and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curves: Curves | None = shared.value
        s = np.zeros((6, SLOTS))
        extra: dict[int, np.ndarray] = {}

        def note(w: np.ndarray, columns: dict[int, np.ndarray | float]) -> None:
            for i, v in columns.items():
                for k, x in zip(*_summed(w, v)):
                    extra.setdefault(int(k), np.zeros(6))[i] += x

        for batch in batches:
            ids, counts, doc = _flat(batch)
            n = batch.num_rows
            anchor = batch.column("anchor").to_numpy(zero_copy_only=False).astype(float)
            judged = batch.column("judged").to_numpy(zero_copy_only=False).astype(float)
            if curves is None:
                x, m = counts.astype(float), np.bincount(doc, counts, n)
                length = batch.column("sentence").to_numpy(zero_copy_only=False)
                known = length[doc] > 0
                s[0] += np.bincount(ids[known], length[doc[known]], SLOTS)
                s[1] += np.bincount(ids[known], minlength=SLOTS)
                fixed, free = ~np.isnan(anchor), np.zeros(n, bool)
                y = np.where(fixed, anchor, 0)
            else:
                t, m = curves.levels(ids, counts, doc, n)
                x = counts * curves.share[ids] * TEMPER
                fixed = ~np.isnan(judged)
                free, y = ~fixed, np.where(fixed, judged, 0)
                pick = free[doc]
                for i, v in enumerate((np.ones(n), t - MIDDLE, (t - MIDDLE) ** 2)):
                    s[i] += np.bincount(ids[pick], x[pick] * v[doc[pick]], SLOTS)
                note(_FREE - _node(t[free]), {0: m[free]})
                at = ~np.isnan(anchor)
                tt, yy = t[at], anchor[at]
                note(np.full(len(tt), _MOMENTS), {0: np.ones(len(tt)), 1: tt, 2: yy, 3: tt * tt, 4: tt * yy})
                note(_PAIRS - 4 * np.round(t[fixed] * 100).astype(int) - 400 - np.clip(np.round(y[fixed]), 1, 4).astype(int) + 1, {0: np.ones(fixed.sum())})
            pick = fixed[doc]
            for i, v in enumerate((np.ones(n), y - MIDDLE, (y - MIDDLE) ** 2)):
                s[3 + i] += np.bincount(ids[pick], x[pick] * v[doc[pick]], SLOTS)
            note(_FIXED - _node(y[fixed]), {0: m[fixed]})
        w = np.nonzero((s != 0).any(0))[0]
        keys = np.concatenate([w, np.array(list(extra), np.int64)]) if extra else w
        values = np.concatenate([s[:, w], np.stack(list(extra.values()), 1)], 1) if extra else s[:, w]
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), *map(pa.array, values)], names=["w", *"abcdef"])

    sums = tokens.mapInArrow(run, "w long, a double, b double, c double, d double, e double, f double")
    return sums.groupBy("w").agg(*[F.sum(x).alias(x) for x in "abcdef"])


def _node(t: np.ndarray) -> np.ndarray:
    return np.clip(np.round((t - GRID[0]) / (GRID[1] - GRID[0])), 0, len(GRID) - 1).astype(int)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, values, len(found))


def _levels(tokens: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curves, a0, a1 = shared.value
        for batch in batches:
            t, _ = curves.levels(*_flat(batch), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a0 + a1 * t)], names=["doc_id", "t"])

    return tokens.select("doc_id", "ids", "counts").mapInArrow(run, "doc_id long, t double")


def _step(s: pd.DataFrame, scale: tuple[float, float], temper: np.ndarray, theta: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(curves' parameters, sum(x u) of each slot) from the sums of a round, raw levels brought to the scale."""
    a0, a1 = scale
    words_ = s[s.index >= 0]
    at, (a, b, c, d, e, f) = words_.index.to_numpy(), (words_[x].to_numpy() for x in "abcdef")
    shift = a0 + (a1 - 1) * MIDDLE  # of (t - MIDDLE): a0 + a1 t - MIDDLE = shift + a1 (t - MIDDLE)
    sums = np.stack([a + d, shift * a + a1 * b + e, shift**2 * a + 2 * shift * a1 * b + a1**2 * c + f])
    nodes = np.concatenate([a0 + a1 * GRID, GRID]) - MIDDLE
    trials = np.array([s["a"].get(w - k, 0.0) for w in (_FREE, _FIXED) for k in range(len(GRID))])
    keep = trials > 0
    start = theta[at]
    fresh = ~np.isfinite(start[:, 0])
    start[fresh] = np.column_stack([np.log((sums[0, fresh] + 0.1) / (trials.sum() * temper[at[fresh]])), np.zeros(fresh.sum()), np.full(fresh.sum(), 0.7)])
    out, moved = np.full((SLOTS, 3), [-np.inf, 0.0, 0.7]), np.zeros(SLOTS)
    for i in range(0, len(at), 16_384):  # blocks, so that the driver's memory does not grow with the vocabulary
        part = slice(i, i + 16_384)
        out[at[part]] = newton(sums[:, part], nodes[keep], trials[keep], temper[at[part]], start[part], steps)
    moved[at] = sums[1]
    return out, moved


def reading_levels(docs: DataFrame, labels: DataFrame, kind: str = "prose") -> DataFrame:
    """(doc_id, level, difficulty) of each English document of the kind with at least MIN_WORDS words."""
    spark = docs.sparkSession
    body = docs.where((F.col("kind") == kind) & F.col("doc_id").isNotNull() & (F.length("text") >= 2 * MIN_WORDS - 1))
    body = body.select("doc_id", F.col("text").alias("body"))
    found = body.mapInPandas(_tokens, "doc_id long, sentence double, letters double, ids array<int>, counts array<int>")
    tokens = materialise(found.join(_judged(labels), "doc_id", "left"), label="tokens")
    size = tokens.agg(F.count("*").alias("n"), F.avg("letters").alias("l"), F.stddev("letters").alias("sl"), F.count("judged").alias("j")).first()
    if not size["n"]:
        return spark.createDataFrame([], "doc_id long, level int, difficulty double")
    anchored = size["j"] >= ANCHORS
    anchor = F.col("judged") if anchored else (F.col("letters") - size["l"]) / max(size["sl"] or 1.0, 1e-6) + MIDDLE
    tokens = tokens.select("doc_id", anchor.alias("anchor"), (F.col("judged") if anchored else F.lit(None).cast("double")).alias("judged"), "sentence", "ids", "counts")
    send = spark.sparkContext.broadcast
    # first pass: curves from the anchors alone, and the length of the sentences each word stands in
    s = _round(tokens, send(None)).toPandas().set_index("w")
    length, at = np.full(SLOTS, PLAIN_LENGTH), s.index[s.index >= 0]
    length[at] = (s.loc[at, "a"] + 2 * PLAIN_LENGTH) / (s.loc[at, "b"] + 2)
    s.loc[at, ["a", "b"]] = 0.0
    theta, before = _step(s, (0.0, 1.0), np.ones(SLOTS), np.full((SLOTS, 3), -np.inf), 8)
    curves = Curves(length, *theta.T)
    temper = curves.share * TEMPER
    for _ in range(MOST_ROUNDS):
        s = _round(tokens, send(curves)).toPandas().set_index("w")
        k, t, y, tt, ty, _ = s.loc[_MOMENTS]
        spread = tt / k - (t / k) ** 2
        a1 = max((ty / k - t * y / k / k) / spread, 1e-3) if spread > 1e-9 else 1.0
        a0 = y / k - a1 * t / k
        theta, moved = _step(s, (a0, a1), temper, theta, 4)
        settled = np.abs(moved - before).sum() <= SETTLED * max(s.loc[s.index >= 0, ["a", "d"]].to_numpy().sum(), 1e-9)
        before = moved
        if settled:
            break
        curves = Curves(length, *theta.T)
    levels = _levels(tokens, send((curves, a0, a1)))
    if anchored:  # cut points over the judged documents' histogram, which is bounded
        pairs = s.loc[s.index <= _PAIRS, "a"]
        code = _PAIRS - 400 - pairs.index.to_numpy()
        t, y = (code // 4) / 100, code % 4 + 1
        cuts = best_cuts(np.round(a0 + a1 * t, 2), y, pairs.to_numpy(float))
    else:
        cuts = levels.approxQuantile("t", [0.25, 0.5, 0.75], 0.005)
    level = sum((F.when(F.col("t") >= c, 1).otherwise(0) for c in cuts), F.lit(1))
    return levels.groupBy("doc_id").agg(F.max("t").alias("t")).select("doc_id", level.cast("int").alias("level"), F.col("t").alias("difficulty"))


def best_cuts(t: np.ndarray, y: np.ndarray, n: np.ndarray) -> list[float]:
    """Three cut points, each placed where the judgments on either side are least contradicted."""
    cuts = []
    for k in (1, 2, 3):
        at = np.unique(t)
        mid = np.concatenate(([at[0] - 0.01], (at[1:] + at[:-1]) / 2, [at[-1] + 0.01]))
        # balanced: an error weighs by how rare its side is near the border, so a scarce level keeps its place
        low, high = y == k, y == k + 1
        use = (y >= k) if k == 1 else (y <= k + 1) if k == 3 else np.ones(len(y), bool)
        use = use if low.any() and high.any() else np.ones(len(y), bool)
        cost = np.array([n[use & (y > k) & (t < c)].sum() + n[use & (y <= k) & (t >= c)].sum() for c in mid])
        best = np.nonzero(cost == cost.min())[0]
        cuts.append(float(mid[best[len(best) // 2]]))
    return sorted(cuts)
