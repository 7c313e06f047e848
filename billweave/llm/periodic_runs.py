"""Periodic runs of words, found in tiles by scale and stitched.

A run is a stretch of words with smallest period ``q``, at least ``TIMES`` periods and ``LEAST`` words long,
that keeps its period no further on either side. In terms of words equal to the word ``q`` on, it is a
maximal stretch of at least ``3 q`` of them.

Periods go by octaves, from ``S`` up to below ``2 S``, and each octave has boundaries at every ``S`` words. The
first boundary inside a run of the octave has ``2 S`` equal words after it, and so has each of the following
that the run holds beyond. A text is cut into tiles per octave, each with some boundaries and the words
that these look at, ``S`` before and ``5 S`` after; tiles overlap by that. Tiles are dealt over all tasks by
text, octave and place, and each is solved for itself: the Z-function of the words after a boundary gives for
every period how far it holds onwards, that of the reversed words how far it holds back. What a tile finds
are fragments of stretches. They are shuffled by text and period, and those that touch are one stretch.

A period that is a multiple of a smaller one is known at the boundary: the Z-function has already reached as
far with the smaller one. So a boundary gives a few fragments at most and the work of an octave is linear in
the text. Boundaries whose next words occur nowhere a period on (compared by hash) hold no run; tiles without
others are not made, and texts without tiles need no shuffle.

Only texts in which a run is possible are shuffled, to meet their runs; adaptive execution splits a text that
very many rows have. Equal texts are solved once a task at most.

Edge cases: a null or empty text has no words, no runs and collapses to an empty text. Texts of any length
are covered in full; a task holds one text and its grams at a time. Repeated rows get the same result. An
empty table gives an empty table. Other columns pass through; a column named like a new one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billweave.llm.common import free_names, map_batches, slices, stored, texts

TIMES = 4
LEAST = 6
#: Words per tile, or one boundary where these are further apart.
TILE = 1024
#: Words compared by hash before a boundary is looked at.
SHORT, LONG = 4, 32
#: Texts and tiles gathered before a task passes them on.
MOST_CODES = 1 << 20
SEEN = 1 << 18

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_TILE_ROW = "key binary, octave int, tile bigint, first bigint, at array<int>, codes array<int>"
_FRAGMENT = "key binary, period bigint, start bigint, end bigint"


def word_codes(raw: bytes) -> np.ndarray:
    """The words ``[^\\x20\\x09-\\x0D]+`` by number, equal words by the same one."""
    words = raw.split()
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))


def grams(codes: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of the next 4, 8, 16 and 32 words from each word on; equal words have equal hashes."""
    out, size, now = {}, 1, codes.astype(np.uint64)
    while size < LONG and len(now) > size:
        now = (now[:-size] * np.uint64(0x9E3779B97F4A7C15) ^ (now[size:] + np.uint64(size))) * np.uint64(0xC2B2AE3D27D4EB4F)
        now ^= now >> np.uint64(29)
        size *= 2
        if size >= SHORT:
            out[size] = now
    return out


def boundaries(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each octave the boundaries, counted in steps of ``S = 2 ** octave``, after which a run is possible."""
    n = len(codes)
    if n < LEAST:
        return
    hashes = grams(codes)
    if len(set(hashes[SHORT].tolist())) == len(hashes[SHORT]):
        return
    octave = 0
    while TIMES << octave <= n:
        step = 1 << octave
        now = hashes[min(max(2 * step, SHORT), LONG)]
        blocks = -(-len(now) // step)
        if blocks > 1:
            padded = np.full(blocks * step, ~now[(blocks - 2) * step], dtype=np.uint64)
            padded[: len(now)] = now
            rows = padded.reshape(blocks, step)
            found = np.flatnonzero((rows[1:] == rows[:-1, :1]).any(axis=1))
            if len(found):
                yield octave, found
        octave += 1


def tiles(codes: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Octave, number, first word, boundaries (from the first word on) and words of each tile."""
    for octave, found in boundaries(codes):
        step = 1 << octave
        each = max(1, TILE >> octave)
        for part in np.split(found, np.flatnonzero(np.diff(found // each)) + 1):
            first = max(0, int(part[0] - 1) * step)
            last = int(part[-1]) * step + 5 * step + 1
            yield octave, int(part[0]) // each, first, part * step - first, codes[first:last]


def onwards(words: list[int], step: int) -> list[tuple[int, int]]:
    """Periods of the octave that hold for ``2 S`` words or more from the first word on, and for how many.
    Multiples of a smaller period that holds as far are left out.

    The Z-function, as far as its shifts are below ``2 S``: ``far`` is where the words cease to equal those
    from the start on, for the best shift yet.
    """
    n, least, top = len(words), max(2 * step, SHORT), 4 * step - 1
    z = [0] * min(2 * step, n)
    out, begin, far = [], 0, 0
    for shift in range(1, len(z)):
        same = z[shift - begin] if shift < far else 0
        if shift + same >= far:
            same = max(0, far - shift)
            while shift + same < n and words[same] == words[shift + same]:
                same += 1
        z[shift] = same
        if shift >= step and same >= least and far < shift + 2 * step:
            out.append((shift, same))
        if shift + same > far:
            begin, far = shift, shift + same
            if far >= top:
                # Any later period of the octave that holds is a multiple of this one.
                break
    return out


def backwards(words: list[int], at: int, step: int) -> list[int]:
    """For each shift below ``2 S`` how many words before ``at``, ``S`` at most, equal those a shift on: the
    Z-function of the reversed words before ``at``, carried on over the words up to ``2 S`` after."""
    before = words[max(0, at - step) : at][::-1]
    m = len(before)
    line = [*before, -1, *words[max(0, at - step) : at + 2 * step][::-1]]
    n, base = len(line), m + 1 + len(words[at : at + 2 * step])
    z, begin, far = [0] * n, 0, 0
    for i in range(1, n):
        same = min(z[i - begin], far - i) if i < far else 0
        while i + same < n and same < m and line[same] == line[i + same]:
            same += 1
        z[i] = same
        if i + same > far:
            begin, far = i, i + same
    return [0, *(z[base - shift] if shift < base - m else 0 for shift in range(1, 2 * step))]


def solved(octave: int, first: int, at: list[int], words: list[int]) -> list[tuple[int, int, int]]:
    """Fragments ``(period, start, end)`` of a tile: words equal to the word a period on."""
    step = 1 << octave
    done, begun, last = [], {}, None
    for boundary in at:
        if last != boundary - step:
            done += begun.items()
            begun = {}
        now, back = {}, None
        for period, same in onwards(words[boundary : boundary + 5 * step + 1], step):
            if period in begun:
                start = begun.pop(period)[0]
            else:
                back = back or backwards(words, boundary, step)
                start = boundary - back[period]
            now[period] = (start, boundary + same)
        done += begun.items()
        begun, last = now, boundary
    done += begun.items()
    return [(period, first + start, first + end) for period, (start, end) in done]


def _key(raw: bytes) -> bytes:
    return blake2b(raw, digest_size=16).digest()


def _tiles_of(docs: DataFrame, text: str) -> DataFrame:
    """The tiles of the texts, each text once a task as far as remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for part in slices(batch, text):
                for body in texts(part, text):
                    raw = (body or "").encode("utf-8", "surrogatepass")
                    key = _key(raw)
                    if key in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    for octave, tile, first, at, words in tiles(word_codes(raw)):
                        rows.append((key, octave, tile, first, at.astype(np.int32), words.astype(np.int32)))
                        size += len(words) + len(at)
                        if size > MOST_CODES:
                            yield _batch(rows)
                            rows, size = [], 0
        yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = ["key", "octave", "tile", "first", "at", "codes"]
    return docs.select(text).mapInArrow(run, _TILE_ROW)


def _fragments_of(tiles: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            key, octave, first, at, codes = (batch.column(batch.schema.get_field_index(c)) for c in ("key", "octave", "first", "at", "codes"))
            for i in range(batch.num_rows):
                fragments = solved(octave[i].as_py(), first[i].as_py(), at[i].as_py(), codes[i].as_py())
                keys += [key[i].as_py()] * len(fragments)
                found += fragments
            columns = list(zip(*found, strict=True)) if found else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *[pa.array(c, pa.int64()) for c in columns]], ["key", "period", "start", "end"])

    return tiles.mapInArrow(run, _FRAGMENT)


def stitched(fragments: DataFrame) -> DataFrame:
    """``(key, period, start, length)`` of the runs from ``(key, period, start, end)`` of their fragments."""
    order = Window.partitionBy("key", "period").orderBy("start", "end")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.col("start") > F.max("end").over(earlier), F.lit(True)).cast("int")
    marked = fragments.distinct().withColumn("begins", begins).withColumn("stretch", F.sum("begins").over(order))
    whole = marked.groupBy("key", "period", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = whole.select("key", "period", "start", (F.col("end") - F.col("start") + F.col("period")).alias("length"))
    return runs.where((F.col("length") >= LEAST) & (F.col("length") >= TIMES * F.col("period")))


def runs_by_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(key, runs)`` for each different text that has runs; ``runs`` ascend by start and period."""
    dealt = _tiles_of(docs, text).repartition("key", "octave", "tile")
    gathered = stitched(_fragments_of(dealt)).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    return gathered.select("key", F.transform("runs", lambda r: F.struct(r["start"], r["length"], r["period"])).cast(RUNS).alias("runs"))


def collapsed_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def collapse_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (start, length and period in words, by start and period), and ``collapsed``, the
    words that remain when each run keeps its first period only, joined by single spaces."""
    runs = stored(runs_by_text(docs, text), "runs")
    key, possible, found = free_names(docs, "key", "possible", "found")

    def mark(batch: pa.RecordBatch) -> list[pa.Array]:
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts(batch, text)]
        return [pa.array([next(boundaries(word_codes(r)), None) is not None for r in raws], pa.bool_()), pa.array([_key(r) for r in raws], pa.binary())]

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        bodies, own = [], []
        for body, held in zip(texts(batch, text), texts(batch, found), strict=True):
            own.append(held or [])
            words = (body or "").encode("utf-8", "surrogatepass").split()
            kept = collapsed_words(words, [(r["start"], r["length"], r["period"]) for r in own[-1]])
            bodies.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return [pa.array(own, kind), pa.array(bodies, pa.string())]

    marked = map_batches(docs, [(possible, "boolean"), (key, "binary")], mark, bounded=text)
    none = marked.where(~F.col(possible)).withColumn(found, F.lit(None).cast(RUNS))
    some = marked.where(possible).join(runs.select(F.col("key").alias(key), F.col("runs").alias(found)), key, "left").select(*none.columns)
    joined = none.unionAll(some).drop(key, possible)
    return map_batches(joined, [("runs", RUNS), ("collapsed", "string")], cut, bounded=text).drop(found)
