"""Problem 5: transcript segments into clean speaker turns.

Each segment is parsed by itself: a leading time, a speaker label, sound notes and hesitations are taken
out of the text. Within a block of a meeting the order is a precedence graph: timing edges join
neighbours in known start times, cue edges place a segment without any start before the first one that
starts after its end, dialogue edges keep one that continues a sentence behind its beginning. An edge
that contradicts those of a stronger kind is dropped, and the rest is sorted topologically. Blocks are
stretches of time, so no group grows with a meeting. Each block carries its speakers forward and counts its
changes; only one row per block (first and last named speaker, changes) goes through a window over the meeting,
and comes back to the segments by a join. So a meeting that holds a third of all rows is spread like any other.

Defined results: a replayed row counts once; a null or empty text, or one without spoken words,
neither makes nor ends a turn; starts given as epoch times are brought to the meeting's start; a
segment without a column start takes the time written in its text, without that its end, without
that it comes last (in an order of its own by a hash of the text); segments before any named speaker belong to the first one named, and to the
speaker null where none ever is; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import materialise

BLOCK_MILLIS = 30 * 60 * 1000
UNTIMED_BLOCKS = 4_096
NUMBERS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())}
FILLERS = r"u+h+m*|u+m+|e+r+m*|e+h+m*|h+m+|m+h*m+|a+h+|ä+h+m*|e+u+h+|uh-huh|mm-hmm|you\s+know"

_TIME = r"(?:(\d{1,3}):)?(\d{1,2}):(\d{2})(?:[.,](\d{1,3}))?"
LEAD_TIME = re.compile(rf"^\s*(?:\[\s*{_TIME}\s*\]|\(\s*{_TIME}\s*\)|<\s*{_TIME}\s*>|{_TIME})(?=[\s\-–:>]|$)[\s\-–:]*")
ANY_TIME = re.compile(r"[\[(<]\s*(?:\d{1,3}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?\s*[\])>]")
_WHO = r"(?:speaker|spk|s|participant|sprecher|sprecherin|locuteur|hablante)[\s_\-#.]*(\d{1,3}|" + "|".join(NUMBERS) + r")"
LEAD_LABEL = re.compile(rf"^\s*(?:<v\s+{_WHO}\s*>|\[\s*{_WHO}\s*\]\s*:?|\(\s*{_WHO}\s*\)\s*:?|(?:>>|-|–)?\s*{_WHO}\s*(?::|\s[-–]\s|>>))\s*(?:</v>)?", re.I)
COLUMN_LABEL = re.compile(rf"^[\W_]*(?:{_WHO}|(\d{{1,3}}))[\W_]*$", re.I)
NOTES = re.compile(r"\[[^\W\d_][^\[\]\d_/.]{0,38}\]|\((?:[^\W\d_]+(?:[ \-,'][^\W\d_]+){0,3})\)|<(?!v\b)/?[^\W\d_][^<>\d_/]{0,38}>|\*[^\W\d_][^*\n\d_/]{0,38}\*|♪[^♪\n]{0,80}♪|[♪♫]")
FILLER = re.compile(rf"(?<![\w\-])(?:{FILLERS})(?![\w\-])(?:\.\.\.|…|[,;.!?])?", re.I)
REPEAT = re.compile(r"(?<![\w/.\-])(\w[\w'/.\-]*)(?:\s+\1)+(?![\w/\-])", re.I)
_NOBODY = {"", "?", "??", "unknown", "n/a", "na", "none", "null", "-", "--", "speaker", "speaker ?", "unbekannt", "inconnu", "desconocido"}


def speaker_of(label: str | None) -> str | None:
    """'s' and the number, from any spelling; another name trimmed and lower-cased; None where it names nobody."""
    if label is None or not isinstance(label, str):
        return None
    plain = re.sub(r"\s+", " ", label).strip().lower()
    m = COLUMN_LABEL.match(plain)
    if m:
        v = m[1] or m[2]
        return f"s{NUMBERS[v] if v in NUMBERS else int(v)}"
    plain = plain.strip(" []():<>-_")
    return None if plain in _NOBODY else plain


def parse_segment(text: str | None) -> tuple[int | None, str | None, str]:
    """(written time in ms, speaker in the text, clean text)."""
    if not isinstance(text, str) or not text.strip():
        return None, None, ""
    at = who = None
    for _ in range(4):  # time and label, in either order
        m = LEAD_TIME.match(text)
        if m and at is None:
            g = [x for x in (m.groups()[i : i + 4] for i in (0, 4, 8, 12)) if x[1] is not None][0]
            at = ((int(g[0] or 0) * 60 + int(g[1])) * 60 + int(g[2])) * 1000 + int((g[3] or "0").ljust(3, "0"))
            text = text[m.end() :]
            continue
        m = LEAD_LABEL.match(text)
        if m and who is None:
            v = next(x for x in m.groups() if x).lower()
            who = f"s{NUMBERS[v] if v in NUMBERS else int(v)}"
            text = text[m.end() :]
            continue
        break
    text = NOTES.sub(" ", ANY_TIME.sub(" ", text))
    text = FILLER.sub(" ", text)
    text = REPEAT.sub(r"\1", text)
    text = re.sub(r"\s+([,.;:!?])", r"\1", re.sub(r"\s+", " ", text)).strip(" ,;–-")
    return at, who, text if re.search(r"[^\W_]", text) else ""


def precedence_order(n: int, edges: list[tuple[int, int, int]], key: list) -> list[int]:
    """Topological order of 0..n-1 under (before, after, strength) edges, ties by ``key``.

    Edges enter strongest first; one that would close a cycle with those already in is dropped. Of each
    strength the edges inside the chain of timing are checked by its positions, others by search.
    """
    after: list[list[int]] = [[] for _ in range(n)]
    chain = [-1] * n
    for a, b, s in edges:
        if s == 3:
            chain[a], chain[b] = (0 if chain[a] < 0 else chain[a]), 0
            after[a].append(b)
    place = {}
    heads = set(range(n)) - {b for row in after for b in row}
    for h in sorted(heads):
        v, i = h, 0
        while True:
            place[v] = (h, i)
            if not after[v]:
                break
            v, i = after[v][0], i + 1

    def reaches(a: int, b: int) -> bool:
        seen, todo = set(), [a]
        while todo:
            v = todo.pop()
            if v == b:
                return True
            if place[v][0] == place[b][0]:
                if place[v][1] <= place[b][1]:
                    return True
            for w in after[v]:
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        return False

    for a, b, s in sorted((e for e in edges if e[2] < 3), key=lambda e: -e[2]):
        if a != b and not reaches(b, a):
            after[a].append(b)
    degree = [0] * n
    for row in after:
        for b in row:
            degree[b] += 1
    ready = [(key[v], v) for v in range(n) if not degree[v]]
    heapq.heapify(ready)
    out = []
    while ready:
        _, v = heapq.heappop(ready)
        out.append(v)
        for w in after[v]:
            degree[w] -= 1
            if not degree[w]:
                heapq.heappush(ready, (key[w], w))
    return out


def order_block(starts: list[int | None], ends: list[int | None], texts: list[str], speakers: list[str | None]) -> list[int]:
    n = len(starts)
    far = 1 << 62
    known = sorted((i for i in range(n) if starts[i] is not None), key=lambda i: (starts[i], far if ends[i] is None else ends[i], texts[i], i))
    edges = [(a, b, 3) for a, b in zip(known, known[1:])]
    if len(known) < n:
        import bisect

        times = [starts[i] for i in known]
        for i in range(n):
            if starts[i] is None:
                if ends[i] is not None:  # cue: it ends before whatever starts later, and begins after what started before its end
                    j = bisect.bisect_right(times, ends[i])
                    if j < len(known):
                        edges.append((i, known[j], 2))
                    if j:
                        edges.append((known[j - 1], i, 2))
                elif known:
                    edges.append((known[-1], i, 2))
        open_of: dict[str | None, int] = {}  # the first unfinished sentence of each speaker
        for j in known:
            if texts[j] and texts[j][-1] not in ".!?":
                open_of.setdefault(speakers[j], j)
        for i in range(n):
            if starts[i] is None and texts[i][:1].islower() and speakers[i] in open_of:  # dialogue: it goes on with it
                edges.append((open_of[speakers[i]], i, 1))
    key = [(starts[i] if starts[i] is not None else ends[i] if ends[i] is not None else far, texts[i], i) for i in range(n)]
    return precedence_order(n, edges, key)


def parsed_segments(df: DataFrame) -> DataFrame:
    """(meeting_id, start, end_ms, named, clean, block): one row per distinct segment, starts since the meeting's start."""
    cols = ["meeting_id", "started_at_ms", "start_millis", "end_millis", "text", "speaker_label"]
    rows = df.where(F.col("meeting_id").isNotNull()).select(*cols).dropDuplicates()

    def since(col: str):
        c, zero = F.col(col), F.col("started_at_ms")
        return F.when((zero > 0) & (c >= zero), c - zero).otherwise(c)

    rows = rows.select("meeting_id", since("start_millis").alias("start"), since("end_millis").alias("end_ms"), "text", "speaker_label")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [parse_segment(t) for t in batch["text"]]
            written = pd.array([g[0] for g in got], dtype="Int64")
            start = batch["start"].astype("Float64").round().astype("Int64")
            yield pd.DataFrame({
                "meeting_id": batch["meeting_id"],
                "start": start.fillna(pd.Series(written, index=start.index)),
                "end_ms": batch["end_ms"].astype("Float64").round().astype("Int64"),
                "named": [speaker_of(c) or g[1] for c, g in zip(batch["speaker_label"], got)],
                "clean": [g[2] for g in got],
            })

    parsed = rows.mapInPandas(run, "meeting_id string, start long, end_ms long, named string, clean string").where(F.col("clean") != "")
    where = F.coalesce("start", "end_ms")
    # segments without any time are dealt to many blocks behind all others
    return parsed.withColumn("block", F.coalesce(F.floor(where / BLOCK_MILLIS), F.lit(1 << 40) + F.pmod(F.xxhash64("clean"), F.lit(UNTIMED_BLOCKS))))


def ordered_segments(df: DataFrame) -> DataFrame:
    """Spoken segments with their place (block, pos), the speaker so far in the block (null before the first named one) and the
    number of changes of speaker so far in the block."""

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        none = lambda col: [None if pd.isna(v) else int(v) for v in pdf[col]]
        rank = order_block(none("start"), none("end_ms"), list(pdf["clean"]), [None if pd.isna(v) else v for v in pdf["named"]])
        out = pdf.iloc[rank]
        said, change, speakers, changes = None, 0, [], []
        for name in out["named"]:
            if not pd.isna(name):
                change += said is not None and name != said
                said = name
            speakers.append(said)
            changes.append(change)
        return out.assign(pos=range(len(out)), said=speakers, change=changes)

    schema = "meeting_id string, start long, end_ms long, named string, clean string, block long, pos long, said string, change long"
    return parsed_segments(df).groupBy("meeting_id", "block").applyInPandas(order, schema)


def speaker_turns(df: DataFrame) -> DataFrame:
    """(meeting_id, turn_no, speaker, start_millis, end_millis, segments, text): one row per turn."""
    said = materialise(ordered_segments(df), label="segments")
    blocks = said.groupBy("meeting_id", "block").agg(
        F.min_by("named", F.when(F.col("named").isNotNull(), F.col("pos"))).alias("first"), F.max_by("said", "pos").alias("last"), F.max("change").alias("changes")
    )
    before = Window.partitionBy("meeting_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("carried", F.last("last", True).over(before))
    # the first named speaker of a meeting takes what was said before; any other opens a turn where the one carried here differs
    blocks = blocks.withColumn("opens", F.when(F.col("carried").isNotNull() & F.col("first").isNotNull() & (F.col("carried") != F.col("first")), 1).otherwise(0))
    blocks = blocks.withColumn("turns", 1 + F.coalesce(F.sum(F.col("opens") + F.col("changes")).over(before), F.lit(0)))
    placed = said.join(blocks.select("meeting_id", "block", "carried", "opens", "turns"), ["meeting_id", "block"])
    number = F.col("turns") + F.when(F.col("said").isNull(), 0).otherwise(F.col("opens") + F.col("change"))
    placed = placed.withColumn("turn_no", number.cast("long")).withColumn("speaker", F.coalesce("said", "carried"))
    turn = placed.groupBy("meeting_id", "turn_no").agg(
        F.max("speaker").alias("speaker"),  # one speaker, or none before the first named one
        F.min_by("start", F.struct("block", "pos")).alias("start_millis"),
        F.max("end_ms").alias("end_millis"),
        F.count("*").alias("segments"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "pos", "clean"))), lambda s: s["clean"]), " ").alias("text"),
    )
    return turn.select("meeting_id", "turn_no", "speaker", "start_millis", "end_millis", "segments", "text")
