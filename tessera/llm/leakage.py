"""Problem 8: passages of held-out items inside a training corpus.

The words of the items' questions and answers get one code point each. They are cut into blocks of ``(run + 1) // 2``
words that do not overlap; the blocks are the patterns of one Aho-Corasick automaton, so it has about one node per item
word. Any ``run`` consecutive words of an item hold a whole block: a document is read and split into words once, passed
through the automaton, and at each hit the common words are followed to both sides. Shared stretches of ``run`` words or
more count; word positions are mapped to character positions in the text as stored. Short answers are patterns as a whole.

The items are held by each worker, who builds the automaton once. Item sets of more than ``ITEM_WORDS`` words are cut into
parts that are scanned one after the other, for the workers' memory only: each item stands in one part, whole.

Defined results: null and empty texts, and items with fewer than ``run`` words, leak nothing; items
that share a passage are all reported; a document id that occurs twice is reported once per item;
empty tables give an empty result; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.words import WORD, words

RUN = 10
ITEM_WORDS = 4_000_000
_OUT = "doc_id long, item_id long, part string, matched_words long, item_words long, start_pos long, end_pos long, answer_pos long"
_FIRST, _LAST, _GAP = 0x21, 0x10FFFF, 0x800  # code points of words, without the surrogates


class ItemAutomaton:
    """Automaton over the blocks of (item_id, part, text) rows; of part 'answer' also the whole text, where it is shorter than a run."""

    def __init__(self, items: list[tuple[int, str, str]], run: int = RUN):
        self.run, self.block, self.code = run, (run + 1) // 2, {}
        self.items = [(item, part, words(text or "")) for item, part, text in items]
        found: dict[str, list[tuple[int, int]]] = {}
        self.answers: dict[str, list[int]] = {}
        for i, (_, part, w) in enumerate(self.items):
            line = "".join(map(self._code, w))
            if len(w) >= run:
                for at in range(0, len(line) - self.block + 1, self.block):
                    found.setdefault(line[at : at + self.block], []).append((i, at))
            if part == "answer" and w:
                self.answers.setdefault(line, []).append(i)
        self.machine = None
        if found or self.answers:
            self.machine = ahocorasick.Automaton()
            for pattern in found.keys() | self.answers.keys():
                self.machine.add_word(pattern, (len(pattern), found.get(pattern, ()), tuple(self.answers.get(pattern, ()))))
            self.machine.make_automaton()

    def _code(self, word: str) -> str:
        c = self.code.get(word)
        if c is None:
            n = _FIRST + len(self.code) % (_LAST - _FIRST - _GAP)  # beyond a million words codes are shared; words are compared below
            c = self.code[word] = chr(n if n < 0xD800 else n + _GAP)
        return c

    def hits(self, text: str) -> tuple[dict[int, list[tuple[int, int]]], dict[int, int]]:
        """(item number -> shared stretches of words, item number -> first word of its whole answer)."""
        runs: dict[int, list[tuple[int, int]]] = {}
        told: dict[int, int] = {}
        if self.machine is None or not text:
            return runs, told
        found = words(text)
        get = self.code.get
        line = "".join([get(w, " ") for w in found])
        seen: dict[tuple[int, int], int] = {}
        for end, (size, owners, answers) in self.machine.iter(line):
            lo = end - size + 1
            for i in answers:
                if i not in told and found[lo : end + 1] == self.items[i][2]:
                    told[i] = lo
            for i, at in owners:
                if seen.get((i, lo - at), 0) > lo:
                    continue  # inside a stretch followed before
                w = self.items[i][2]
                a, b, x, y = lo, lo, at, at
                while a and x and found[a - 1] == w[x - 1]:
                    a, x = a - 1, x - 1
                while b < len(found) and y < len(w) and found[b] == w[y]:
                    b, y = b + 1, y + 1
                seen[i, lo - at] = max(b, lo + 1)
                if b - a >= self.run:
                    runs.setdefault(i, []).append((a, b))
        return runs, told

    def rows(self, doc: int, text: str) -> list[tuple]:
        runs, told = self.hits(text)
        if not runs:
            return []
        at = [m.span() for m in WORD.finditer(text)]
        answer = {self.items[i][0]: at[lo][0] for i, lo in sorted(told.items(), key=lambda t: -t[1])}
        out = []
        for i, spans in runs.items():
            item, part, w = self.items[i]
            covered, last = 0, 0
            for a, b in sorted(spans):
                covered += max(0, b - max(a, last))
                last = max(last, b)
            out.append((doc, item, part, covered, len(w), at[min(a for a, _ in spans)][0], at[max(b for _, b in spans) - 1][1], answer.get(item)))
        return out


_BUILT: dict[tuple[str, int], ItemAutomaton] = {}


def _machine(shared, run: int) -> ItemAutomaton:
    """The automaton of a broadcast, built once a worker; of the last few broadcasts only."""
    key = (shared.value[0], run)
    if key not in _BUILT:
        while len(_BUILT) > 1:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[key] = ItemAutomaton(shared.value[1], run)
    return _BUILT[key]


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str, text_col: str, item_id: str, item_text: str, answer: str | None = None, run: int = RUN) -> DataFrame:
    """(doc_id, item_id, part, matched_words, item_words, start_pos, end_pos, answer_pos): one row per document, item and part of it
    (question or answer) with a shared run of words; answer_pos is where the document first has the item's whole answer, null if nowhere."""
    key = F.col(item_id).cast("long").alias("item")
    parts = items.select(key, F.lit("question").alias("part"), F.col(item_text).alias("t"))
    if answer:
        parts = parts.union(items.select(key, F.lit("answer"), F.col(answer)))
    parts = parts.where(F.col("t").isNotNull() & F.col("item").isNotNull())
    size = parts.agg(F.sum(F.length("t") / 2 + 1)).first()[0] or 0
    pieces = int(size // ITEM_WORDS) + 1
    dealt = parts.withColumn("piece", F.pmod(F.xxhash64("item"), F.lit(pieces)))
    found = [_scan(docs, [tuple(r) for r in dealt.where(F.col("piece") == k).select("item", "part", "t").toLocalIterator()], doc_id, text_col, run) for k in range(pieces)]
    best = Window.partitionBy("doc_id", "item_id", "part").orderBy(F.desc("matched_words"), "start_pos", "end_pos", F.asc_nulls_last("answer_pos"))
    return reduce(DataFrame.union, found).withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def _scan(docs: DataFrame, items: list[tuple[int, str, str]], doc_id: str, text_col: str, run: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    body = body.where(F.col("doc_id").isNotNull() & (F.length("body") >= 2 * run - 1))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = _machine(shared, run)
        for batch in batches:
            rows = [row for doc, text in zip(batch["doc_id"], batch["body"]) for row in machine.rows(doc, text)]
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "part", "matched_words", "item_words", "start_pos", "end_pos", "answer_pos"])
            yield out.astype({"answer_pos": "Int64"})

    return body.mapInPandas(scan, _OUT)
