"""Token windows and structural chunks. Offsets count UTF-8 bytes where a column is named so."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed_chunks(docs: DataFrame, id_col: str, text_col: str, target: int = 200, overlap: int = 20) -> DataFrame:
    """(doc, seq, tokens, text, digest): windows of ``target`` space-separated tokens, stepping by target - overlap, the last one ending with the text.

    Sequence and slice expressions: no Python, no shuffle.
    """
    step = target - overlap
    words = F.filter(F.split(F.trim(F.regexp_replace(text_col, r"\s+", " ")), " "), lambda t: t != "")
    d = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), words.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - target) / step)).cast("int")
    d = d.select("doc", "w", F.explode(F.sequence(F.lit(0), last)).alias("seq"))
    piece = F.slice("w", F.col("seq") * step + 1, target)
    d = d.select("doc", "seq", F.size(piece).alias("tokens"), F.array_join(piece, " ").alias("text"))
    return d.withColumn("digest", F.sha2("text", 256))


_TURN = re.compile(r"^\s*(?:\[?\d{1,2}:\d{2}(?::\d{2})?\]?\s*)?[A-Za-z][\w .-]{0,40}:\s")


def blocks(text: str, kind: str) -> list[tuple[int, int]]:
    """Character spans of the natural blocks of a text of a kind: fences whole, table rows together, slides by rulers, chat by turns, prose by blank lines and headings."""
    lines = text.splitlines(keepends=True)
    spans, start, at, fence = [], 0, 0, False

    def close(end: int) -> None:
        nonlocal start
        if text[start:end].strip():
            spans.append((start, end))
        start = end

    was_row = False
    for line in lines:
        bare = line.strip()
        if kind == "code" and bare.startswith("```"):
            if not fence:
                close(at)
            fence = not fence
            if not fence:
                at += len(line)
                close(at)
                continue
        elif not fence:
            row = bare.startswith("|")
            if kind == "chat":
                if _TURN.match(line):
                    close(at)
            elif kind == "slides" and re.fullmatch(r"-{3,}", bare):
                close(at)
            elif kind == "table" and row != was_row or bare.startswith("#") and kind in ("prose", "slides"):
                close(at)
            elif not bare:
                close(at + len(line))
            was_row = row
        at += len(line)
    close(len(text))
    return spans


def pack_blocks(text: str, spans: list[tuple[int, int]], target: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy packing of blocks up to ``target`` tokens; the next chunk takes up trailing blocks of at least ``overlap`` tokens
    unless they are over half of it; a block over the target is cut into token windows."""
    count = lambda a, b: len(text[a:b].split())
    out, now, size = [], [], 0
    for a, b in spans:
        n = count(a, b)
        if n > target:
            if now:
                out.append((now[0][0], now[-1][1]))
            words = [m.span() for m in re.finditer(r"\S+", text[a:b])]
            step, i = max(target - overlap, 1), 0
            while True:
                part = words[i : i + target]
                out.append((a + part[0][0], a + part[-1][1]))
                if i + target >= len(words):
                    break
                i += step
            now, size = [], 0
            continue
        if now and size + n > target:
            out.append((now[0][0], now[-1][1]))
            tail, held = [], 0
            for s in reversed(now):
                if held >= overlap:
                    break
                tail.insert(0, s)
                held += count(*s)
            now, size = (tail, held) if 0 < held <= target // 2 and overlap else ([], 0)
        now.append((a, b))
        size += n
    if now:
        out.append((now[0][0], now[-1][1]))
    return out


def structure_chunks(docs: DataFrame, id_col: str, text_col: str, kind_col: str, target: int = 200, overlap: int = 20) -> DataFrame:
    """(doc, seq, chunk_id, role, byte_start, byte_end, tokens, digest) of chunks along the blocks of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, kind in zip(batch["doc"], batch["body"], batch["kind"]):
                for i, (a, b) in enumerate(pack_blocks(text, blocks(text, (kind or "prose").lower()), target, overlap)):
                    part = text[a:b]
                    lead = len(part) - len(part.lstrip())
                    part = part.strip()
                    start = len(text[: a + lead].encode("utf-8", "replace"))
                    raw = part.encode("utf-8", "replace")
                    rows.append((doc, i, f"{doc}#structure.v1.{i}", "parent", start, start + len(raw), len(part.split()), hashlib.sha256(raw).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc", "seq", "chunk_id", "role", "byte_start", "byte_end", "tokens", "digest"])

    body = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("body"), F.col(kind_col).alias("kind"))
    return body.mapInPandas(run, "doc string, seq int, chunk_id string, role string, byte_start long, byte_end long, tokens int, digest string")


def chunk_receipts(docs: DataFrame, id_col: str, text_col: str, kind_col: str, target: int = 200, child: int = 50, overlap: int = 20, version: int = 1) -> DataFrame:
    """(doc, chunk_id, role, parent_id, byte_start, byte_end, digest): parents along the blocks of each text and children of at most ``child`` tokens
    along the same blocks, each under the parent that shares most bytes with it, the earliest on ties."""

    def receipt(text: str, span: tuple[int, int]) -> tuple[int, int, str]:
        part = text[span[0] : span[1]]
        lead = len(part) - len(part.lstrip())
        raw = part.strip().encode("utf-8", "replace")
        start = len(text[: span[0] + lead].encode("utf-8", "replace"))
        return start, start + len(raw), hashlib.sha256(raw).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, kind in zip(batch["doc"], batch["body"], batch["kind"]):
                found = blocks(text, (kind or "prose").lower())
                name = f"{doc}#structure.v{version}."
                parents = [receipt(text, s) for s in pack_blocks(text, found, target, overlap)]
                rows += [(doc, f"{name}p{i}", "parent", None, *r) for i, r in enumerate(parents)]
                at = 0
                for i, (a, b, digest) in enumerate(receipt(text, s) for s in pack_blocks(text, found, child, 0)):
                    while at < len(parents) - 1 and parents[at][1] <= a:
                        at += 1
                    near = range(max(at - 1, 0), min(at + 3, len(parents)))  # parents are in order, and only neighbours overlap
                    best = max(near, key=lambda j: (min(b, parents[j][1]) - max(a, parents[j][0]), -j))
                    rows.append((doc, f"{name}c{i}", "child", f"{name}p{best}", a, b, digest))
            yield pd.DataFrame(rows, columns=["doc", "chunk_id", "role", "parent_id", "byte_start", "byte_end", "digest"])

    body = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("body"), F.col(kind_col).alias("kind"))
    return body.mapInPandas(run, "doc string, chunk_id string, role string, parent_id string, byte_start long, byte_end long, digest string")


def headings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, line, level, title, parent_line): headings with their parent, the nearest earlier heading of a lower level."""
    from tessera.functions.text import heading_level

    lines = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("line", "title"))
    h = lines.withColumn("level", heading_level("title").cast("int")).where("level > 0")
    from pyspark.sql import Window

    w = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.max(F.when(F.col("level") == k, F.col("line"))).over(w) for k in range(1, 7)]
    up = F.greatest(*[F.when(F.col("level") > k, above[k - 1]) for k in range(1, 7)])
    return h.select("doc", "line", "level", F.trim("title").alias("title"), up.alias("parent_line"))
