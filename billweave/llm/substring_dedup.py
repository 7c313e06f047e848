"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text: each byte's random number is added to the hash shifted by one
bit, so that the last ``REACH`` bytes decide its value. A chunk ends at a word whose value is smallest
among the words around it, and at every line end. Where a cut falls depends on the text next to it alone,
so an insertion moves the cuts near it and no others. Chunks vary in size and are compared by digest.

A run of consecutive chunks with ``min_words`` words or more is a repeat if one document with a smaller
doc_id holds it as a whole, or its own text at an earlier place. Repeats are cut out; so of a passage that
several documents share, the first keeps all, the others lose it but for a few words at its edges where
the cuts have not yet met. Chunks that only stand scattered over other texts, or in another order, stay.

What is compared are the shortest such runs: from each chunk onwards, and up to each chunk. Together those
inside a longer run cover it, and a document that holds the run holds them all; so the words cut are those
of all repeats, of whatever length.

Each document sends the digest of each of its shortest runs once, at most two for a chunk. Digests are
grouped with partial minima; those that several documents have are joined back with the documents' digests,
which adaptive execution splits where one digest is hot; and each document's own repeats are joined with
its text.

Edge cases: null texts stay null and hold nothing. Rows with one doc_id are one document: they are no
repeats of each other. Rows without a doc_id only lose what they repeat themselves. A text cut as a whole
becomes empty. An empty table gives an empty table. Other columns pass through; a column named like a new
one is replaced.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.common import BLANKS, free_names, map_batches, stored, texts, whole_number

REACH = 16
#: A cut's value is smaller than those of so many words before it, and not greater than of those after.
AROUND = 2
MIN_WORDS = 25


@lru_cache(maxsize=1)
def gear() -> np.ndarray:
    rng = random.Random(20)
    return np.array([rng.getrandbits(64) for _ in range(256)], dtype=np.uint64)


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """The gear hash after each byte. Sums over 1, 2, 4, ... bytes are doubled instead of rolled."""
    out = gear()[raw]
    step = 1
    while step < REACH and step < len(out):
        out[step:] = out[step:] + (out[:-step] << np.uint64(step))
        step *= 2
    return out


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[ord(c) for c in BLANKS]] = True


def chunks(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the chunks in bytes, and their words. Blanks between chunks belong to none."""
    data = np.frombuffer(raw, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[data], [True])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, starts, starts
    # The high bits of the hash depend on all REACH bytes.
    value = gear_hashes(data)[ends - 1] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)
    top = np.uint64(2**64 - 1)
    padded = np.concatenate(([top] * AROUND, value, [top] * AROUND))
    cut = np.ones(len(value), dtype=bool)
    for k in range(1, AROUND + 1):
        cut &= (value < padded[AROUND - k : len(padded) - AROUND - k]) & (value <= padded[AROUND + k : len(padded) - AROUND + k])
    lines = np.concatenate(([0], np.cumsum(data == 0x0A)))
    cut[:-1] |= lines[ends[:-1]] != lines[starts[1:]]
    cut[-1] = True
    last = np.flatnonzero(cut)
    first = np.concatenate(([0], last[:-1] + 1))
    return starts[first], ends[last], last - first + 1


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[int]:
    digest = xxhash.xxh3_64_intdigest
    return [d - (1 << 64) if d >> 63 else d for d in [digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]]


def runs(raw: bytes, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, min_words: int) -> tuple[list[int], list[int], list[int]]:
    """The shortest runs of chunks with ``min_words`` words, from each chunk onwards and up to each chunk, in
    order: their first chunks, the chunks after their last, and the digests of their chunks' digests."""
    before = np.concatenate(([0], np.cumsum(words)))
    n = len(words)
    after = np.searchsorted(before, before[:-1] + min_words)
    onwards = np.flatnonzero(after <= n)
    first = np.searchsorted(before, before[1:] - min_words, side="right") - 1
    upto = np.flatnonzero(first >= 0)
    # A chunk's own place counts as a run even if ``min_words`` is 0.
    a = np.concatenate((onwards, np.minimum(first[upto], upto)))
    b = np.concatenate((np.maximum(after[onwards], onwards + 1), upto + 1))
    a, b = np.divmod(np.unique(a * (n + 1) + b), n + 1)
    if not len(a):
        return [], [], []
    whole = np.array(digests(raw, starts, ends), dtype=np.int64).tobytes()
    a, b = a.tolist(), b.tolist()
    return a, b, digests(whole, 8 * np.array(a), 8 * np.array(b))


def without_repeats(text: str | None, elsewhere: set[int], min_words: int) -> tuple[str | None, int, list[int]]:
    """The text without repeats, the words cut, and the byte ranges cut (start, end, start, ...).
    ``elsewhere``: the digests of runs that earlier documents hold."""
    if not text:
        return text, 0, []
    raw = text.encode("utf-8", "surrogatepass")
    starts, ends, words = chunks(raw)
    seen, depth = set(elsewhere), np.zeros(len(starts) + 1, dtype=np.int64)
    for a, b, d in zip(*runs(raw, starts, ends, words, min_words), strict=True):
        if d in seen:
            depth[a] += 1
            depth[b] -= 1
        seen.add(d)
    marks = np.concatenate(([False], np.cumsum(depth) > 0))
    edges = np.flatnonzero(marks[1:] != marks[:-1])
    out, spans, total, last = [], [], 0, 0
    before = np.concatenate(([0], np.cumsum(words)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        total += int(before[b] - before[a])
        spans += [int(starts[a]), int(ends[b - 1])]
        out.append(raw[last : starts[a]])
        last = int(ends[b - 1])
    if not total:
        return text, 0, []
    out.append(raw[last:])
    blanks = BLANKS.encode()
    parts = [p for p in (out[0].rstrip(blanks), *(p.strip(blanks) for p in out[1:-1]), out[-1].lstrip(blanks)) if p.strip(blanks)]
    return b"\n".join(parts).decode("utf-8", "surrogatepass"), total, spans


def _digest_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """``(digest, id)`` of the different shortest runs of each row of ``docs(id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    raw = text.encode("utf-8", "surrogatepass")
                    own = set(runs(raw, *chunks(raw), min_words)[2])
                    found += own
                    ids += [i] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(ids, pa.int64())], ["digest", "id"])

    return docs.mapInArrow(run, "digest bigint, id bigint")


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeats cut out of ``text``, ``n_cut`` (words cut) and ``cut_ranges`` (bytes of the
    text as it was: start, end, start, end, ...). Texts without such runs stay as they are."""
    plain = docs.select(whole_number(docs, doc_id).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    rows = _digest_rows(plain, min_words)
    shared = rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    shared = stored(shared.select("digest", "first"), "shared-runs")
    of, found = free_names(docs, "id", "repeats")
    repeats = rows.join(shared, "digest").where("id > first").groupBy(F.col("id").alias(of)).agg(F.collect_set("digest").alias(found))
    both = docs.join(repeats, docs[doc_id] == repeats[of], "left").drop(of)
    kind = docs.schema[text].dataType.simpleString()

    def function(batch: pa.RecordBatch) -> list[pa.Array]:
        bodies, cut, spans = [], [], []
        for body, own in zip(texts(batch, text), texts(batch, found), strict=True):
            for column, value in zip((bodies, cut, spans), without_repeats(body, set(own or ()), min_words), strict=True):
                column.append(value)
        return [pa.array(bodies, batch.schema.field(text).type), pa.array(cut, pa.int64()), pa.array(spans, pa.list_(pa.int32()))]

    new = [(text, kind), ("n_cut", "bigint"), ("cut_ranges", "array<int>")]
    return map_batches(both, new, function).drop(found)
