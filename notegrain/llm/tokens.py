"""Exact byte-pair encoding by dynamic programming over prefixes.

For every prefix of a piece there is exactly one last token of its encoding. It is found among the tokens that
end there (suffix matches of an automaton over the whole vocabulary): the one whose start is a prefix that is
already settled and whose predecessor, that prefix's last token, it may follow. A pair may be adjacent if no
merge across its border comes before the merges that built the two sides up. Following the last tokens back
from the end gives the ids, in time linear in the piece, with no heap of merges.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KEPT_PIECES, KEPT_PAIRS, LONG = 300_000, 2_000_000, 64
"""A worker's caches are emptied at these sizes; pieces above LONG characters aren't kept."""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> str:
    """The printable character that stands for each byte in the vocabulary file: visible Latin-1 for itself, the others in order from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(rest)) for b in range(256))


class PrefixEncoder:
    """Encodes texts by one byte-level vocabulary; text that looks like a special token is ordinary text."""

    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.size = [0] * (max(vocab.values()) + 1)
        self.match = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.size[i] = len(token)
            self.match.add_word(token, i)
        self.match.make_automaton()
        self.rank: dict[tuple[int, int], int] = {}
        self.built: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = vocab[a], vocab[b]
            self.rank[left, right] = r
            self.built.setdefault(vocab[a + b], (left, right, r))
        self.letters = {b: c for b, c in enumerate(_byte_letters())}
        self.split = regex.compile(self.PIECES).findall
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that lie at one edge of a token while it is built, each with the rank of the merge that ends it."""
        out, ends = [], float("inf")
        while True:
            out.append((token, ends))
            if token not in self.built:
                return out
            *parts, ends = self.built[token]
            token = parts[side]

    def follows(self, a: int, b: int) -> bool:
        """Whether b may come right after a: no merge over the border happens while both its sides lie there."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            known = True
            right = self._edge(b, 0)
            for x, x_ends in self._edge(a, 1):
                for y, y_ends in right:
                    r = self.rank.get((x, y))
                    if r is not None and r < x_ends and r <= y_ends:  # of equal merges the left one comes first
                        known = False
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def piece(self, text: str) -> tuple[int, ...]:
        s = text.encode("utf-8").decode("latin-1").translate(self.letters)
        last, size, follows = [-1] * (len(s) + 1), self.size, self.follows
        for end, token in self.match.iter(s):
            end += 1
            if last[end] < 0:
                start = end - size[token]
                if start == 0 or (last[start] >= 0 and follows(last[start], token)):
                    last[end] = token
        out, at = [], len(s)
        while at:
            out.append(last[at])
            at -= size[last[at]]
        return tuple(reversed(out))

    def encode(self, text: str | None) -> array:
        out, pieces = array("i"), self.pieces
        for p in self.split(text) if text else ():
            ids = pieces.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= LONG:
                    if len(pieces) >= KEPT_PIECES:
                        pieces.clear()
                    pieces[p] = ids
            out.extend(ids)
        return out


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """One encoder a worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(path)
    return _ENCODERS[path]


def encode(documents: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids: each row's token ids, an empty list for null and empty texts. No shuffle; other columns are not read."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        e = encoder(path)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                flat, ends = array("i"), [0]
                for t in part.column(1).to_pylist():
                    flat.extend(e.encode(t))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, "i4") if flat else np.empty(0, "i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [key, "ids"])

    rows = documents.select(key, text)
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(documents: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens: only the number of ids of each row."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        e = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(e.encode(t)) for t in b.column(1).to_pylist()], pa.int64())], [key, "n_tokens"])

    rows = documents.select(key, text)
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, n_tokens bigint")
