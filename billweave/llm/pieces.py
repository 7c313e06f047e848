"""SentencePiece encoding and decoding with a batched Viterbi in numpy.

A text is split into words where no piece can reach across, and words of equal length are encoded together,
one row each. Prefix hashes give the hash of every substring; the substrings that end at a place, one length
after the other, are looked up in the sorted hashes of the pieces, for all words at once. The best piece and
thereby the way back are chosen by a maximum over the lengths.

The model at hand is of the byte-pair kind. Its scores are merge ranks and no likelihoods: the path with
the highest sum is not what the library returns. So a piece may only follow another if merging would leave
the two apart. That admits exactly one path, the library's; among what is admitted the maximum is taken.

The pieces are read once on the driver and broadcast; their number is the model's (32,000 here). Characters
without a piece become bytes. Each task remembers the words it has encoded. Rows stay where they are;
nothing is shuffled.

Edge cases: null and empty texts have no pieces; decoding gives "" for both. Decoding undoes encoding but for
U+2581, which the model reads as a blank, and lone surrogates, which become U+FFFD. Repeated rows are encoded
alike. An empty table gives an empty table; a column named like a new one is replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from billweave.llm.common import map_batches, texts

MARK = "▁"
MULTIPLIER = 0xD1342543DE82EF95
#: Remembered words and pairs per task; results don't depend on it.
MEMORY = 600_000
#: Words encoded together, at most, and their characters.
ROWS, CELLS = 8192, 1 << 20
#: Texts are taken in groups of about so many characters.
GROUP = 4_000_000


@dataclass(frozen=True)
class Pieces:
    """The model, as far as encoding and decoding need it."""

    text: list[str]  # by id; empty for control pieces and bytes
    ids: dict[str, int]
    rank: list[int]  # 0 for characters, else 1 + the order of merging
    halves: list[tuple[int, int]]  # the last merge that makes a piece
    byte_ids: list[int]
    decoded: list[bytes]
    dummy_prefix: bool
    longest: int


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if not b & 0x80:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            yield tag >> 3, raw[at : at + size]
            at += size
        else:
            size = 8 if tag & 7 == 1 else 4
            yield tag >> 3, raw[at : at + size]
            at += size


# Fixed values of the model format.
TRAINER, NORMALIZER, MODEL_TYPE, BPE = 2, 3, 3, 2
BYTE_FALLBACK, NORMALIZER_NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 35, 1, 3, 4, 5


def read_pieces(path: str) -> Pieces:
    """Read a model of the byte-pair kind with byte fallback and no normalisation. Others are refused."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    parts = dict(_fields(model.serialized_model_proto()))
    trainer, normalizer = dict(_fields(parts[TRAINER])), dict(_fields(parts[NORMALIZER]))
    n = model.get_piece_size()
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    text = [""] * n
    for i in plain:
        text[i] = model.id_to_piece(i)
    ids = {text[i]: i for i in plain}
    score = [model.get_score(i) for i in range(n)]
    if (
        trainer.get(MODEL_TYPE) != BPE
        or not trainer.get(BYTE_FALLBACK)
        or normalizer.get(NORMALIZER_NAME) != b"identity"
        or normalizer.get(REMOVE_EXTRA, 1)
        or not normalizer.get(ESCAPE, 1)
        or any(MARK in t.lstrip(MARK) for t in ids)
    ):
        raise ValueError(f"{path}: not a model of the kind that this operator encodes")
    rank = [0] * n
    for order, i in enumerate(sorted((i for i in plain if len(text[i]) > 1), key=lambda i: -score[i])):
        rank[i] = order + 1
    halves = [(i, i) for i in range(n)]
    unmade = []
    for i in sorted(plain, key=lambda i: rank[i]):
        if rank[i]:
            made = _last_merge(text[i], ids, rank)
            if made is None:
                unmade.append(i)
            else:
                halves[i] = made
    for i in unmade:  # no text is ever merged into these
        del ids[text[i]]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    decoded = [t.replace(MARK, " ").encode("utf-8") for t in text]
    for b, i in enumerate(byte_ids):
        decoded[i] = bytes([b])
    return Pieces(text, ids, rank, halves, byte_ids, decoded, bool(normalizer.get(ADD_DUMMY_PREFIX, 1)), max(map(len, ids)))


def _last_merge(piece: str, ids: dict[str, int], rank: list[int]) -> tuple[int, int] | None:
    """The two halves that are merged last when ``piece`` is encoded; None if it is not merged as a whole."""
    parts = list(piece)
    while len(parts) > 1:
        best = min(((rank[ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ids), default=None)
        if best is None:
            return None
        k = best[1]
        if len(parts) == 2:
            return (ids[parts[0]], ids[parts[1]]) if all(p in ids for p in parts) else None
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return None


class Apart(dict):
    """Whether merging leaves two neighbouring pieces apart, by ``first * 2**32 + second``."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces

    def __missing__(self, pair: int) -> bool:
        if len(self) >= MEMORY:
            self.clear()
        self[pair] = value = self.judge(pair >> 32, pair & 0xFFFFFFFF)
        return value

    def judge(self, a: int, b: int) -> bool:
        """Take the merges of both pieces back, the latest first. At each point the pieces that then touch
        would have been merged if they make a piece of a rank below that of all merges taken back."""
        text, ids, rank, halves = self.pieces.text, self.pieces.ids, self.pieces.rank, self.pieces.halves
        limit = len(rank) + 1
        while True:
            whole = ids.get(text[a] + text[b])
            if whole is not None and rank[whole] < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], halves[a][1]
            elif rank[b]:
                # At equal ranks the left place is merged first.
                limit, b = rank[b] + 1, halves[b][0]
            else:
                return True


class Encoder:
    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.apart = pieces, Apart(pieces)
        by_size: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, i in pieces.ids.items():
            h = 0
            for c in t:
                h = (h * MULTIPLIER + ord(c) + 1) % 2**64
            by_size[len(t)].append((h, i))
        self.keys = {n: tuple(np.array(x, dtype=np.uint64) for x in zip(*sorted(v), strict=True)) for n, v in by_size.items()}
        self.powers = np.array([pow(MULTIPLIER, k, 2**64) for k in range(pieces.longest + 1)], dtype=np.uint64)
        known = "".join(t for t in pieces.ids if len(t) == 1)
        self.runs = re.compile(f"[{re.escape(known)}]+|[^{re.escape(known)}]", re.S)
        # Line ends have no piece in this kind of model, so words end there too.
        self.words = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if "\n" not in known else f"{MARK}*[^{MARK}]+|{MARK}+", re.S).findall
        self.plain = re.compile(f"[{re.escape(known)}]+").fullmatch
        self.memory: dict[str, bytes] = {}

    def encode(self, bodies: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts."""
        prefix = MARK if self.pieces.dummy_prefix else ""
        split = [self.words(prefix + t.replace(" ", MARK)) if t else [] for t in bodies]
        if len(self.memory) > MEMORY:
            for w in list(islice(self.memory, MEMORY // 2)):  # the oldest
                del self.memory[w]
        self.learn(set(chain.from_iterable(split)).difference(self.memory))
        get = self.memory.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in out]))).astype(np.int64)
        return offsets, np.frombuffer(b"".join(out), dtype=np.int32)

    def learn(self, words: set[str]) -> None:
        """Encode new words and remember them."""
        by_size: dict[int, list[str]] = defaultdict(list)
        mixed = {}
        plain = self.plain
        for w in words:
            if plain(w):
                by_size[len(w)].append(w)
            else:
                mixed[w] = self.runs.findall(w)
        for run in {p for ps in mixed.values() for p in ps if plain(p)} - words:
            by_size[len(run)].append(run)
        ids: dict[str, bytes] = {}
        for size, rows in by_size.items():
            many = max(1, min(ROWS, CELLS // size))
            for k in range(0, len(rows), many):
                ids.update(zip(rows[k : k + many], self.viterbi(rows[k : k + many], size), strict=True))
        for w, ps in mixed.items():
            self.memory[w] = b"".join(ids[p] if p in ids else self.bytes_of(p) for p in ps)
        self.memory.update((w, x) for w, x in ids.items() if w in words)

    def bytes_of(self, char: str) -> bytes:
        try:
            raw = char.encode("utf-8")
        except UnicodeEncodeError:
            raw = "�".encode()
        return np.array([self.pieces.byte_ids[b] for b in raw], dtype=np.int32).tobytes()

    def viterbi(self, rows: list[str], size: int) -> list[bytes]:
        """The ids of ``rows``, which all have ``size`` characters."""
        n = len(rows)
        codes = np.frombuffer("".join(rows).encode("utf-32-le"), dtype=np.uint32).reshape(n, size).astype(np.uint64)
        prefix = np.zeros((size + 1, n), dtype=np.uint64)
        for j in range(size):
            prefix[j + 1] = prefix[j] * np.uint64(MULTIPLIER) + codes[:, j] + np.uint64(1)
        tables = {}  # by length: the piece that each substring is, or -1, and where there is any
        for length, (keys, ids) in sorted(self.keys.items(), reverse=True):
            if length <= size:
                own = prefix[length:] - prefix[: size + 1 - length] * self.powers[length]
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                table = np.where(keys[at] == own, ids[at].astype(np.int64), -1)
                tables[length] = (table, (table >= 0).any(axis=1).tolist())
        last = np.zeros((size + 1, n), dtype=np.int64)  # the piece that ends at each place of the best path
        back = np.zeros((size + 1, n), dtype=np.int64)  # and its length
        for end in range(1, size + 1):
            # The maximum is the longest admitted piece: rows that have one are done.
            open_ = np.ones(n, dtype=bool)
            for length, (table, some) in tables.items():
                if length > end or not some[end - length]:
                    continue
                piece = table[end - length]
                found = np.flatnonzero((piece >= 0) & open_)
                piece = piece[found]
                if end > length:
                    before = last[end - length, found]
                    fits = np.fromiter(map(self.apart.__getitem__, ((before << 32) | piece).tolist()), dtype=bool, count=len(found))
                    found, piece = found[fits], piece[fits]
                last[end, found] = piece
                back[end, found] = length
                open_[found] = False
        return self.walk(last, back, size)

    @staticmethod
    def walk(last: np.ndarray, back: np.ndarray, size: int) -> list[bytes]:
        """All ways back at once: the ids of each row, from the pieces that end it."""
        n = last.shape[1]
        at, steps, rows = np.full(n, size), [], np.arange(n)
        while len(rows):
            steps.append((rows, last[at[rows], rows]))
            at[rows] -= back[at[rows], rows]
            rows = rows[at[rows] > 0]
        many = np.zeros(n, dtype=np.int64)
        for rows, _ in steps:
            many[rows] += 1
        ends = np.cumsum(many)
        flat = np.empty(int(ends[-1]), dtype=np.int32)
        for k, (rows, ids) in enumerate(steps):
            flat[ends[rows] - 1 - k] = ids
        raw, stops = flat.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", ids: str = "piece_ids") -> DataFrame:
    """``docs`` with the ids of the text's pieces."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    made: dict[str, Encoder] = {}

    def function(batch: pa.RecordBatch) -> list[pa.Array]:
        if "encoder" not in made:
            made["encoder"] = Encoder(shared.value)
        bodies, parts = texts(batch, text), []
        for group in _groups(bodies):
            offsets, values = made["encoder"].encode(group)
            parts.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32())))
        return [pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))]

    return map_batches(docs, [(ids, "array<int>")], function)


def _groups(bodies: list[str | None]) -> Iterator[list[str | None]]:
    group, size = [], 0
    for t in bodies:
        group.append(t)
        size += len(t or "")
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def decoder(pieces: Pieces) -> Callable[[list[int] | None], str]:
    def decode_one(ids: list[int] | None) -> str:
        raw = b"".join([pieces.decoded[i] for i in ids or ()])
        if pieces.dummy_prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")

    return decode_one


def decode(docs: DataFrame, pieces: Pieces, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text that the ids stand for."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def function(batch: pa.RecordBatch) -> list[pa.Array]:
        one = decoder(shared.value)
        return [pa.array([one(x) for x in texts(batch, ids)], pa.string())]

    return map_batches(docs, [(text, "string")], function)


def encoded_and_checked(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``piece_ids``, ``n_pieces`` and ``round_trip``: whether decoding gives the text back."""
    pieces = read_pieces(path)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    made: dict[str, Encoder] = {}

    def function(batch: pa.RecordBatch) -> list[pa.Array]:
        if "encoder" not in made:
            made["encoder"] = Encoder(shared.value)
        one, lists, counts, same = decoder(shared.value), [], [], []
        for group in _groups(texts(batch, text)):
            offsets, values = made["encoder"].encode(group)
            lists.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32())))
            counts.append(np.diff(offsets))
            same += [one(values[a:b].tolist()) == (t or "") for t, a, b in zip(group, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        none = pa.array([], pa.list_(pa.int32()))
        return [pa.concat_arrays(lists) if lists else none, pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(same, pa.bool_())]

    return map_batches(docs, [("piece_ids", "array<int>"), ("n_pieces", "bigint"), ("round_trip", "boolean")], function)
