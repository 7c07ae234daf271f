"""Problem 7: encoding a corpus with a byte-level byte-pair vocabulary by backtracking.

A text is cut into pre-tokens by the tokenizer's pattern. For each distinct pre-token an Aho-Corasick
automaton over the vocabulary finds every token occurrence; the encoder walks the pre-token taking the
longest token, checks it against the token before it with a pair-compatibility test (would the merges
have left this boundary?), and backtracks to the next shorter token, or the token before, where not.
Positions proved dead are marked, so each is left once and the work is linear. The result equals that
of the merges in rank order. Decoding concatenates slices of one byte string by an offset table.

Defined results: null and empty texts give an empty list; every row of the input comes out, repeated
ids too; special tokens' strings in a text are ordinary text; lone surrogates become U+FFFD.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_FORM = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{W}{LN}]+|[{W}]+(?![^{W}])|[{W}]+"
ASCII_PATTERN = re.compile(_FORM.replace("{LN}", "A-Za-z0-9").replace("{L}", "[A-Za-z]").replace("{N}", "[0-9]").replace("{W}", "\\t-\\r "))
PATTERN = regex.compile(_FORM.replace("{LN}", r"\p{L}\p{N}").replace("{L}", r"\p{L}").replace("{N}", r"\p{N}").replace("{W}", _WS))


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 byte values."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class BacktrackingEncoder:
    """Exact byte-pair encoder built from the JSON text of a tokenizer file."""

    def __init__(self, spec: str, cache: int = 300_000):
        model = json.loads(spec)["model"]
        byte = _byte_of_char()
        raw = {t: bytes(byte[c] for c in t) for t in model["vocab"] if all(c in byte for c in t)}
        self.size = max(model["vocab"].values()) + 1
        parts = [b""] * self.size
        self.rank_pair: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> (merge rank, token)
        self.parts_of: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        vocab = model["vocab"]
        usable = set()
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            token = vocab[a + b]
            self.rank_pair[vocab[a], vocab[b]] = (rank, token)
            self.parts_of.setdefault(token, (vocab[a], vocab[b]))
            self.made_at.setdefault(token, rank)
            usable.add(token)
        trie = ahocorasick.Automaton()
        for t, data in raw.items():
            token = vocab[t]
            parts[token] = data
            if len(data) == 1 or token in usable:  # only what merges can reach
                trie.add_word(data.decode("latin-1"), (len(data), token))
        trie.make_automaton()
        self.trie = trie
        self.length = [len(p) for p in parts]
        self.bytes = b"".join(parts)
        self.offsets = np.concatenate(([0], np.cumsum(self.length)))
        self.compatible: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.limit = cache

    def decode(self, ids) -> str:
        return b"".join(self.bytes[self.offsets[i] : self.offsets[i + 1]] for i in ids).decode("utf-8", "replace")

    def _boundary_stays(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens leaves a boundary between them.

        The tokens are unmerged from the inside out, the later-made neighbour first; a merge across the
        boundary that comes before either neighbour was finished would have been taken.
        """
        limit = len(self.rank_pair) + 1
        made = self.made_at
        while True:
            across = self.rank_pair.get((left, right))
            if across is not None and across[0] < limit:
                return False
            at_left, at_right = made.get(left, -1), made.get(right, -1)
            if at_left < 0 and at_right < 0:
                return True
            if at_left > at_right:  # the left token came last: a merge across must precede it
                limit, left = at_left, self.parts_of[left][1]
            else:  # equal tokens: the left one was made first, a merge of equal rank to the left wins
                limit, right = at_right + 1, self.parts_of[right][0]

    def _pair_ok(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 1_000_000:
                self.compatible.clear()
            known = self.compatible[key] = self._boundary_stays(left, right)
        return known

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        n = len(piece)
        at: list[list[int]] = [[] for _ in range(n)]  # tokens that start here, in order of length
        for end, (size, token) in self.trie.iter(piece.decode("latin-1")):
            at[end - size + 1].append(token)
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        choice: list[int] = []
        pos, k = 0, len(at[0]) - 1
        while pos < n:
            while k >= 0:
                token = at[pos][k]
                if alive[pos + self.length[token]] and (not out or self._pair_ok(out[-1], token)):
                    break
                k -= 1
            if k >= 0:
                out.append(token)
                choice.append(k)
                pos += self.length[token]
                k = len(at[pos]) - 1 if pos < n else -1
            else:
                alive[pos] = 0
                pos -= self.length[out.pop()]
                k = choice.pop() - 1
        return tuple(out)

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        if len(self.cache) >= self.limit:
            self.cache.clear()
        ids = self.encode_piece(piece.encode("utf-8", "replace"))
        if len(piece) <= 64:
            self.cache[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        pieces = (ASCII_PATTERN if text.isascii() else PATTERN).findall(text)
        cache, more = self.cache, self.piece_ids
        try:
            return list(chain.from_iterable([cache[p] for p in pieces]))
        except KeyError:
            return list(chain.from_iterable([cache[p] if p in cache else more(p) for p in pieces]))


def encode_corpus(df: DataFrame, id_col: str, text_col: str, path: str = TOKENIZER) -> DataFrame:
    """(id, ids array<int>) of every row. The vocabulary file (about 1.5 MB, fixed) is read once and broadcast; no shuffle."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > 64 << 20:
        raise ValueError("the tokenizer file is too large to broadcast")
    shared = df.sparkSession.sparkContext.broadcast(spec)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            lists = [encoder.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=[id_col, "ids"])

    return df.select(F.col(id_col), F.col(text_col).alias("body")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


_ENCODERS: dict[int, BacktrackingEncoder] = {}


def _encoder(spec: str) -> BacktrackingEncoder:
    """One encoder per Python worker, which outlives its tasks."""
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = BacktrackingEncoder(spec)
    return _ENCODERS[key]
