"""Problem 2: cutting oversized texts at natural boundaries.

Each position of a text gets a boundary strength that depends on the kind of the text (paragraph,
heading, statement, table row, chat turn, sentence, clause, word). A sparse table of range maxima
over the strengths answers "strongest cut in this window, rightmost on ties" in constant time. A
piece that starts at ``a`` is cut in (a + limit/2, a + limit]; the next one starts ``overlap``
characters before the cut, moved right only where that point lies inside a word or a character
cluster.

Defined results: a null id, a null text and a text of at most ``limit`` characters give no pieces;
of a repeated id the latest text (then the greatest) is split once; a null, unknown or wrong-case
kind is replaced by the kind its lines suggest; extra columns are ignored; text without any boundary
is cut at the limit. Pieces concatenated without their overlaps give the text exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 200
KINDS = ("prose", "code", "table", "chat", "slides")

_TURN = re.compile(r"^\s*(?:\[?\d{1,2}:\d{2}(?::\d{2})?\]?\s+)?[\w .-]{1,30}:\s")
_CODE_TOP = re.compile(r"^(?:def|class|func|type|var|public|private|export|async|impl|fn|struct|enum|import|package|@|\[|if |for |with |const )")
_CODE_LINE = re.compile(r"[{};=()]|^\s*(?:#|//)|^\s+\w+:")


def kind_of(text: str, kind: str | None) -> str:
    """The stated kind if its lines do not contradict it, else the kind most of its lines look like."""
    stated = (kind or "").strip().lower()
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines:
        return stated if stated in KINDS else "prose"
    share = lambda test: sum(map(bool, map(test, lines))) / len(lines)
    table = share(lambda x: x.lstrip().startswith("|") or x.count(",") >= 3 and " " not in x.split(",")[0])
    chat = share(lambda x: re.match(r"^\d{1,2}:\d{2}\s+\S{1,30}:\s", x))
    slides = share(lambda x: x.startswith("# ")) if len(lines) > 3 else 0
    code = share(_CODE_LINE.search)
    looks = {"table": table > 0.6, "chat": chat > 0.4, "slides": slides > 0.3 and stated != "code", "code": code > 0.6}
    if stated in KINDS and (stated == "prose" and not any(looks.values()) or looks.get(stated)):
        return stated
    found = next((k for k in ("table", "chat", "slides", "code") if looks[k]), None)
    return found or (stated if stated in KINDS else "prose")


def strengths(text: str, kind: str) -> np.ndarray:
    """Strength of a cut before each position 0..n: 9 (section) down to 1 (between words), 0 inside a word, -1 where no cut is allowed."""
    n = len(text)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(n + 1, np.int8)
    space = np.isin(code, (32, 9, 11, 12, 0xA0, 0x2003, 0x3000))
    feed = (code == 10) | (code == 13)
    out[1:][space] = 1
    word = ((code >= 48) & (code <= 57)) | ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122)) | (code == 95) | (code > 127)
    out[1:n][(~word[:-1] & ~space[:-1]) & word[1:]] = 1

    def after(pattern: str, value: int) -> None:
        for m in re.finditer(pattern, text):
            out[m.end()] = max(out[m.end()], value)

    if kind in ("prose", "chat", "slides"):
        after(r"[,;:–—]\s+", 2)
        after(r"[.!?…][\"')\]»”]*\s+", 4)
    elif kind == "code":
        after(r"[;{}]\s*", 2)
        after(r",\s+", 2)
    else:
        after(r"[|,\t;]", 2)
    out[1:][feed] = np.maximum(out[1:][feed], 5)
    after(r"\n[ \t\r]*\n\s*", 7)
    at = 0
    for line in text.splitlines(keepends=True):
        if at:
            if kind == "code":
                if _CODE_TOP.match(line):
                    out[at] = max(out[at], 8)
                elif line[:1] in " \t}":
                    out[at] = min(out[at], 5) if line.strip() else out[at]
            elif kind == "chat" and _TURN.match(line):
                out[at] = 8
            elif line.startswith("#") and kind in ("prose", "slides"):
                out[at] = 9
            elif kind == "slides" and re.match(r"-{3,}\s*$", line):
                out[at] = 9
        at += len(line)
    # never inside CR LF, before a combining mark, a joiner or a variation selector, nor after a joiner
    joins = ((code >= 0x300) & (code <= 0x36F)) | ((code >= 0xFE00) & (code <= 0xFE0F)) | (code == 0x200D) | ((code >= 0x1F3FB) & (code <= 0x1F3FF))
    if n:
        out[:n][joins] = -1
        out[1:n][code[:-1] == 0x200D] = -1
        out[1:n][(code[:-1] == 13) & (code[1:] == 10)] = -1
    return out


class RangeMax:
    """Sparse table: position of the greatest value in a closed range, the rightmost on ties, in constant time."""

    def __init__(self, values: np.ndarray, width: int):
        self.values = values
        self.levels = [np.arange(len(values), dtype=np.int64)]
        step = 1
        while 2 * step <= min(width, len(values)):
            low = self.levels[-1]
            a, b = low[:-step], low[step:]
            self.levels.append(np.where(values[a] > values[b], a, b))
            step *= 2

    def best(self, lo: int, hi: int) -> int:
        k = min((hi - lo + 1).bit_length() - 1, len(self.levels) - 1)
        a, b = int(self.levels[k][lo]), int(self.levels[k][hi - (1 << k) + 1])
        return a if self.values[a] > self.values[b] else b


def spans(text: str, kind: str | None, limit: int = LIMIT, overlap: int = OVERLAP, block: int = 1 << 16) -> list[tuple[int, int]]:
    """(start, end) of the pieces of one text, in order."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half the limit")
    n, out, a = len(text), [], 0
    if n <= limit:
        return [(0, n)]
    s = strengths(text, kind_of(text, kind))
    base, index = 0, RangeMax(s[: block + limit + 1], limit)
    while n - a > limit:
        if a - base > block - limit:  # the table covers a stretch of the text, however long the text is
            base, index = a, RangeMax(s[a : a + block + limit + 1], limit)
        cut = base + index.best(a + limit // 2 + 1 - base, a + limit - base)
        out.append((a, cut))
        back = cut - overlap
        if overlap and s[back] <= 0:  # the nearest boundary to the right, else the nearest permitted cut
            near = s[back : back + max(overlap // 5, 1) + 1]
            back += int(np.argmax(near > 0)) if (near > 0).any() else int(np.argmax(s[back : cut + 1] >= 0))
        a = back
    out.append((a, n))
    return out


def split_texts(df: DataFrame, id_col: str, text_col: str, kind_col: str, order_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(record_id, piece_no, start_pos, end_pos, piece) of each text longer than ``limit`` characters.

    The length filter runs before anything reaches Python or a shuffle, so only oversized texts move.
    """
    long = df.select(F.col(id_col).alias("record_id"), F.col(text_col).alias("body"), F.col(kind_col).alias("kind"), F.col(order_col).alias("seen"))
    long = long.where(F.col("record_id").isNotNull() & (F.length("body") > limit))
    # one shuffle of the oversized texts by id; of repeated ids the partial maximum keeps one a task
    long = long.groupBy("record_id").agg(F.max(F.struct("seen", "body", "kind")).alias("r")).select("record_id", "r.body", "r.kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (r, i, a, b, body[a:b])
                for r, body, kind in zip(batch["record_id"], batch["body"], batch["kind"])
                for i, (a, b) in enumerate(spans(body, kind, limit, overlap))
            ]
            yield pd.DataFrame(rows, columns=["record_id", "piece_no", "start_pos", "end_pos", "piece"])

    return long.mapInPandas(run, "record_id string, piece_no long, start_pos long, end_pos long, piece string")
