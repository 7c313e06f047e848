"""Byte-level byte-pair encoding and decoding without merging: longest matches and backtracking.

The tokens of a piece are those that repeated merging of the lowest-ranked adjacent pair leaves. A sequence
of tokens is that result exactly if each two neighbours are the result for their own bytes: a merge across
a boundary sees nothing but the two tokens beside it. So a piece is read from the left. At each place the
longest token is tried first, then its prefixes that are tokens, until one is compatible with the token
before; where none is, the last token is taken back and its place marked dead, because the tokens of a
prefix are unique. Each place dies at most once, so the work is linear in the piece.

The longest tokens at all places come from one pass of an Aho-Corasick automaton over the bytes as Latin-1
letters. Whether two tokens may stand beside each other follows from undoing their merges along the
boundary, the later one first, and is remembered. Pieces are remembered as well: natural text repeats them.

The rank file is read on the driver and broadcast; its size is a property of the tokenizer. Rows stay where
they are and nothing is shuffled. Ids travel packed, as little-endian unsigned 32-bit integers.

Edge cases: a null text counts as empty and has no ids; null ids decode to null. Pieces of any length are
one piece. Repeated rows are encoded alike. An empty table gives an empty table. A column named like a new
one is replaced. Strings of special tokens are ordinary text. Ids without a token are refused.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from billweave.llm.common import map_batches, texts

#: Pieces remembered per task, as many again that were used before those, and twice as many pairs of tokens;
#: results don't depend on it.
MEMORY = 1 << 18
#: Longer pieces are not remembered.
LONGEST_REMEMBERED = 64
SHIFT = 32
NONE = -1


@dataclass(frozen=True)
class Vocabulary:
    """Tokens in the order of their ranks, with the two tokens that each is merged from: itself twice for a
    byte, ``NONE`` for a token that no merging makes."""

    tokens: tuple[bytes, ...]
    ids: tuple[int, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def vocabulary(ranks: dict[bytes, int]) -> Vocabulary:
    """Find what each token is merged from. Rank files whose tokens rank before their parts are refused:
    merging would not go up the ranks then."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    place = {t: i for i, t in enumerate(tokens)}
    if any(bytes([b]) not in place for b in range(256)):
        raise ValueError("a byte has no token")
    left, right = [], []
    for i, token in enumerate(tokens):
        a, b = (i, i) if len(token) == 1 else last_merge(token, place)
        if len(token) > 1 and max(a, b) > i:
            raise ValueError(f"the token of rank {ranks[token]} ranks before a part of it")
        left.append(a)
        right.append(b)
    return Vocabulary(tuple(tokens), tuple(ranks[t] for t in tokens), tuple(left), tuple(right))


def last_merge(token: bytes, place: dict[bytes, int]) -> tuple[int, int]:
    """The pair that merging a token's own bytes ends with; ``NONE`` twice if merging does not make it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [(place[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in place]
        if not found:
            return NONE, NONE
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return place[parts[0]], place[parts[1]]


class Encoder:
    """The tables of a vocabulary, ready for use in a task."""

    def __init__(self, v: Vocabulary, pattern: str) -> None:
        self.left, self.right = v.left, v.right
        self.length = [len(t) for t in v.tokens]
        self.packed = [i.to_bytes(4, "little") for i in v.ids]
        self.place = {t: i for i, t in enumerate(v.tokens)}
        self.merged = {(a << SHIFT | b): i for i, (a, b) in enumerate(zip(v.left, v.right, strict=True)) if a != NONE and len(v.tokens[i]) > 1}
        made = [(t, i) for i, t in enumerate(v.tokens) if v.left[i] != NONE]
        self.automaton = ahocorasick.Automaton()
        for token, i in made:
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        whole = dict(made)
        #: The longest token that a token begins with, besides itself.
        self.shorter = [next((whole[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in whole), NONE) for t in v.tokens]
        self.find = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def beside(self, a: int, b: int) -> bool:
        """Whether merging leaves two tokens apart: undo merges along the boundary, the latest first. A pair
        that ranks before the merge undone last would have merged first; of equal ranks the left one does."""
        left, right, merged = self.left, self.right, self.merged
        limit = len(self.length)
        while True:
            joined = merged.get(a << SHIFT | b)
            if joined is not None and joined < limit:
                return False
            # Bytes are merged from themselves, so they are undone when nothing else is left.
            undo_a, undo_b = right[a] != a, left[b] != b
            if not (undo_a or undo_b):
                return True
            if undo_a and (a > b or not undo_b):
                limit, a = a, right[a]
            else:
                limit, b = b + 1, left[b]

    def tokens_of(self, raw: bytes) -> list[int]:
        """The tokens of one piece, by their places."""
        whole = self.place.get(raw)
        if whole is not None:
            return [whole]
        n, length, shorter, known, beside = len(raw), self.length, self.shorter, self.pairs, self.beside
        longest = [NONE] * (n + 1)
        # Of the matches that begin at one place, the longest ends last.
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            longest[end + 1 - length[token]] = token
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token != NONE:
                end = at + length[token]
                if not dead[end]:
                    if not out:
                        break
                    pair = out[-1] << SHIFT | token
                    fits = known.get(pair)
                    if fits is None:
                        known[pair] = fits = beside(out[-1], token)
                    if fits:
                        break
                token = shorter[token]
            if token != NONE:
                out.append(token)
                at, token = end, longest[end]
            else:
                dead[at] = 1
                last = out.pop()
                at, token = at - length[last], shorter[last]
        return out

    def encode(self, text: str) -> bytes:
        """The packed ids of a text."""
        if len(self.pieces) > MEMORY:
            self.pieces, self.older = {}, self.pieces
        if len(self.pairs) > 2 * MEMORY:
            self.pairs.clear()
        parts, known = self.find(text), self.pieces
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            return b"".join([known.get(p) or self._piece(p) for p in parts])

    def _piece(self, piece: str) -> bytes:
        packed = self.older.get(piece) or b"".join([self.packed[t] for t in self.tokens_of(piece.encode("utf-8"))])
        if len(piece) <= LONGEST_REMEMBERED:
            self.pieces[piece] = packed
        return packed


@lru_cache(maxsize=1)
def _encoder(v: Vocabulary, pattern: str) -> Encoder:
    return Encoder(v, pattern)


def decode_ids(packed: bytes, tokens: dict[int, bytes]) -> bytes:
    try:
        return b"".join([tokens[i] for i in np.frombuffer(packed, dtype="<u4").tolist()])
    except KeyError as missing:
        raise ValueError(f"no token has the id {missing}") from None


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids``, the packed ids of the texts by the rank file at ``ranks``, each
    match of ``pattern`` for itself."""
    encoded = _encoding(docs, ranks, pattern, text)
    return map_batches(docs, _IDS, encoded, bounded=text)


def decode(docs: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``, the bytes of the packed ids. Ids cut from a text need not be valid UTF-8."""
    decoded = _decoding(docs, ranks)
    return map_batches(docs, _DECODED, lambda batch: [decoded(batch.column(batch.schema.get_field_index(ids)))], bounded=ids)


def encode_and_decode(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``encode`` and, decoded from these ids, that of ``decode``; one pass through
    Python instead of two."""
    encoded, decoded = _encoding(docs, ranks, pattern, text), _decoding(docs, ranks)

    def function(batch: pa.RecordBatch) -> list[pa.Array]:
        n, ids = encoded(batch)
        return [n, ids, decoded(ids)]

    return map_batches(docs, [*_IDS, *_DECODED], function, bounded=text)


_IDS = [("n_tokens", "bigint"), ("ids", "binary")]
_DECODED = [("decoded", "binary")]


def _encoding(docs: DataFrame, ranks: str, pattern: str, text: str) -> Callable[[pa.RecordBatch], list[pa.Array]]:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(read_ranks(ranks)))

    def function(batch: pa.RecordBatch) -> list[pa.Array]:
        encode_text = _encoder(shared.value, pattern).encode
        packed = [encode_text(t or "") for t in texts(batch, text)]
        return [pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())]

    return function


def _decoding(docs: DataFrame, ranks: str) -> Callable[[pa.Array], pa.Array]:
    shared = docs.sparkSession.sparkContext.broadcast({i: t for t, i in read_ranks(ranks).items()})

    def function(packed: pa.Array) -> pa.Array:
        tokens = shared.value
        return pa.array([None if p is None else decode_ids(p, tokens) for p in packed.to_pylist()], pa.binary())

    return function
