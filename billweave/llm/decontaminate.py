"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over token windows.

The windows of an item are its runs of ``n`` consecutive words; an item with fewer words, but some, is one
window. Words are compared after lower-casing A-Z. Each task maps the words of its texts to the numbers
that the benchmark's words have, hashes all windows at once and looks them up in the sorted hashes of the
test windows; every hit is verified word by word.

What is broadcast is bounded: items are packed into blocks of at most ``BLOCK_WORDS`` words (an item
beyond that is a block of its own), and the texts are scanned once per block. One block is the usual case;
with more, the scan of a block is stored before the next, so that a task never holds two. Nothing is
shuffled.

Edge cases: a null text has no words; a null or word-less item is no window. Repeated items are items of
their own. Items with a null id mark words like all others, but are not named in ``items``. Repeated rows are scanned each on its own. An empty benchmark
hits nothing, an empty table gives an empty table; a column named like a new one is replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.common import byte_table, free_names, map_batches, named, stored, texts, whole_number

WINDOW = 10
BLOCK_WORDS = 500_000
#: All ASCII but digits and letters.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

HIT_COLUMNS = [("n_words", "bigint"), ("hit_ranges", "array<int>"), ("items", "array<bigint>")]


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(byte_table(SEPARATORS)).split() if text else []


class TestWindows:
    """The windows of one block of items: by size their sorted hashes, their word numbers and items."""

    __test__ = False

    def __init__(self, items: list[tuple[int | None, str]], n: int) -> None:
        self.number: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                owners = found[size][tuple(ids[i : i + size])]
                if item is not None:
                    owners.add(item)
        self.by_size = {}
        for size, windows in found.items():
            rows = np.array(list(windows), dtype=np.uint64).reshape(-1, size)
            hashes = hash_windows(rows.T)
            order = np.argsort(hashes, kind="stable")
            owners = list(windows.values())
            owners = [sorted(owners[i]) for i in order]
            ends = np.cumsum([0] + [len(x) for x in owners])
            flat = np.fromiter((x for o in owners for x in o), dtype=np.int64, count=int(ends[-1]))
            self.by_size[size] = (hashes[order], rows[order].astype(np.uint32), ends, flat)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """A mark for each word inside an occurrence of a window, and the items hit."""
        marks, items = np.zeros(len(words), dtype=bool), set()
        number = self.number
        ids = np.array([number.get(w, 0) for w in words], dtype=np.uint64)
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for size, (hashes, rows, ends, flat) in self.by_size.items():
            starts = np.flatnonzero(unknown[size:] == unknown[:-size]) if len(ids) >= size else []
            if not len(starts):
                continue
            own = hash_windows([ids[starts + k] for k in range(size)])
            at = np.searchsorted(hashes, own)
            for i in np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == own):
                start, j = starts[i], at[i]
                while j < len(hashes) and hashes[j] == own[i]:
                    if np.array_equal(rows[j], ids[start : start + size]):
                        marks[start : start + size] = True
                        items.update(flat[ends[j] : ends[j + 1]].tolist())
                    j += 1
        return marks, items


def hash_windows(columns) -> np.ndarray:
    """One hash per window; ``columns`` are the windows' first words, second words and so on."""
    state = np.zeros(len(columns[0]), dtype=np.uint64)
    for ids in columns:
        state = (state ^ ids) * MULTIPLIER
        state ^= state >> np.uint64(29)
    return state


def ranges(marks: np.ndarray) -> list[int]:
    """``[start, end, start, end, ...]`` of the marked runs."""
    return np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))).tolist()


def item_blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of bounded size, read partition by partition and never all at once."""
    block, size = [], 0
    rows = benchmark.where(F.col(text).isNotNull()).select(whole_number(benchmark, item_id), text)
    for item, words in rows.toLocalIterator():
        many = len(words_of(words))
        if block and size + many > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((item, words))
        size += many
    yield block


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, the word ranges hit (``hit_ranges``: start, end, start, end, ...) and the
    ``items`` that hit, in order."""
    out = None
    for block in item_blocks(benchmark, item_id, item_text):
        out = stored(out, "hits") if out is not None else out
        shared = docs.sparkSession.sparkContext.broadcast(TestWindows(block, n))
        out = _scan(docs if out is None else out, shared, text, first=out is None)
    return out


def _scan(docs: DataFrame, shared, text: str, first: bool) -> DataFrame:
    def function(batch: pa.RecordBatch) -> list[pa.Array]:
        windows, out = shared.value, ([], [], [])
        before = None if first else [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hit_ranges", "items")]
        for i, body in enumerate(texts(batch, text)):
            words = words_of(body)
            marks, items = windows.scan(words)
            if before is not None:
                for a, b in zip(before[0][i][::2], before[0][i][1::2], strict=True):
                    marks[a:b] = True
                items |= set(before[1][i])
            for column, value in zip(out, (len(words), ranges(marks), sorted(items)), strict=True):
                column.append(value)
        return [pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.int64()))]

    return map_batches(docs, HIT_COLUMNS, function)


def remove_hits(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text", least_left: float = 0.5, item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``docs`` without benchmark passages: the words hit are cut out of the texts, and a document goes if
    less than ``least_left`` of its words stay.

    A cut leaves a line break. Words on both sides of it may form a window again, so a text is scanned and
    cut until nothing hits; with several blocks the rounds over all of them end when one cuts nothing.
    Texts without hits stay as they are, byte for byte.
    """
    words, left, changed = names = free_names(docs, "words", "left", "cut")
    out, rounds = docs, 0
    while True:
        several = 0
        for block in item_blocks(benchmark, item_id, item_text):
            shared = docs.sparkSession.sparkContext.broadcast(TestWindows(block, n))
            out = stored(out, "cut") if several or rounds else out
            out = _cut_by(out, shared, text, names, first_round=not rounds, first=not several)
            several += 1
        rounds += 1
        if several == 1:
            break
        out = stored(out, "cut")
        if out.where(changed).isEmpty():
            break
    return out.where(F.col(left) >= least_left * F.col(words)).select(*[named(c) for c in docs.columns])


def _cut_by(docs: DataFrame, shared, text: str, names: list[str], first_round: bool, first: bool) -> DataFrame:
    """Cut by one block. The columns of ``names``: words at the start, words now, cut in this round."""

    def function(batch: pa.RecordBatch) -> list[pa.Array]:
        column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
        windows, bodies, counts, left, changed = shared.value, texts(batch, text), [], [], []
        for i, body in enumerate(bodies):
            words = words_of(body)
            counts.append(len(words))
            marked = ranges(windows.scan(words)[0])
            changed.append(bool(marked))
            while marked:
                bodies[i] = cut(bodies[i], marked)
                words = words_of(bodies[i])
                marked = ranges(windows.scan(words)[0])
            left.append(len(words))
        if not first_round or not first:
            counts = column(names[0])
        if not first:
            changed = [a or b for a, b in zip(changed, column(names[2]), strict=True)]
        return [pa.array(bodies, batch.schema.field(text).type), pa.array(counts, pa.int64()), pa.array(left, pa.int64()), pa.array(changed, pa.bool_())]

    kind = docs.schema[text].dataType.simpleString()
    return map_batches(docs, [(text, kind), *zip(names, ("bigint", "bigint", "boolean"), strict=True)], function)


def cut(text: str, marked: list[int]) -> str:
    """``text`` without the words in ``marked`` and what stands between them; a line break is left."""
    raw = text.encode("utf-8", "surrogatepass")
    space = np.frombuffer(raw.translate(byte_table(SEPARATORS)), dtype=np.uint8) == 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    out, last = [], 0
    for a, b in zip(marked[::2], marked[1::2], strict=True):
        out.append(raw[last : starts[a]].rstrip(b" \t\n\r\x0b\x0c"))
        last = int(ends[b - 1])
    out.append(raw[last:].lstrip(b" \t\n\r\x0b\x0c"))
    return b"\n".join(x for x in out if x).decode("utf-8", "surrogatepass")


def items_digest(items: list[int]) -> str:
    """SHA-256 in hex of the ids, sorted as strings and joined by commas."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
