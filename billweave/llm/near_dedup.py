"""Near-duplicate detection on word shingles by HyperMinHash.

1. Each text's shingle set becomes a signature of ``REGISTERS`` registers: a shingle's hash chooses a
   bucket, and the bucket keeps the smallest rest of a hash as its count of leading zeros and the
   ``MANTISSA`` bits that follow. So that small sets fill their buckets, the number of buckets follows the
   set's size class (powers of two), and the registers come from as many seeds as it takes. A set whose
   larger partners may be in the next class is signed for both.
2. Equal sets are one node from here on, the smallest doc_id stands for them.
3. ``BANDS`` bands of ``ROWS`` registers are bucketed. Each bucket's members meet its smallest id; pairs
   whose collision-corrected Jaccard estimate is ``MARGIN`` standard deviations below the threshold end
   there, the others are verified on their full sets. Verified pairs are merged into components.
4. Buckets that still hold several components go on, first with another representative. Then members
   meet all members of other components: those of small buckets as pairs, those of larger ones in blocks
   of about ``BLOCK`` members or ``BLOCK_SHINGLES`` shingles, whose overlaps are counted at once, so that
   only similar pairs leave a block. The members outside a bucket's largest component have blocks of their
   own, and only these meet others: a bucket full of copies with a few strangers sends each copy once per
   block of strangers. So no pair that shares a bucket is left out unless it is connected already.

A pair with similarity 0.8 shares no bucket with a probability of 3 in a million.

Hot groups: equal sets are grouped with partial minima; buckets are aggregated with partial minima and
joined back, which adaptive execution splits. Nothing is collected per group. Tables that are read again
(signatures, buckets, sets of candidates, edges) are written to the shared scratch folder.

Edge cases: texts that are null or have no words have an empty set and are linked with nothing; fewer words
than a shingle make one shingle. Rows with one doc_id are one document: a link of any of them holds for
all. Rows without a doc_id are linked with nothing and kept. An empty table gives an empty table. Only the
id and the text are read; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.common import byte_table, stored, whole_number
from billweave.llm.components import components

REGISTERS = 256
BANDS, ROWS = 42, 6
MANTISSA = 10
MARGIN = 6.0
#: Members of a bucket that are compared pair by pair; those of larger ones are compared in blocks.
SMALL_BUCKET = 8
#: Members of a block, at most, and their shingles.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 23
#: Cells of a block's matrix of texts and shingles, at most.
CELLS = 20_000_000
EMPTY = 0xFFFF
#: Remembered word hashes per task; results don't depend on it.
MEMORY = 1_000_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """The set of the text's shingles as sorted 64-bit hashes."""
    words = text.encode("utf-8", "surrogatepass").translate(byte_table(b"")).split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    size = min(size, n)
    out = each[: n - size + 1]
    for k in range(1, size):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15)) + each[k : n - size + 1 + k]
    return np.unique(_mixed(out))


def size_class(n: int) -> int:
    return n.bit_length() - 1


def classes(n: int, threshold: float) -> list[int]:
    """The size classes in which a set of ``n`` meets its partners: its own, and that of the largest set
    that can be similar."""
    return sorted({size_class(n), size_class(int(n / threshold + 1e-9))})


def bucket_bits(size_class_: int) -> int:
    return max(0, min(REGISTERS.bit_length() - 1, size_class_ - 3))


_SEEDS = _mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def signature(hashes: np.ndarray, size_class_: int) -> np.ndarray:
    """The registers of a set in a size class, 16 bits each."""
    bits = bucket_bits(size_class_)
    buckets = 1 << bits
    seeds = REGISTERS // buckets
    x = np.sort(_mixed(hashes[None, :] ^ _SEEDS[:seeds, None]), axis=1) if bits else _mixed(hashes[None, :] ^ _SEEDS[:, None]).min(axis=1)[:, None]
    place = (x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(x.shape, dtype=np.int64)
    place += np.arange(seeds)[:, None] * buckets
    place, x = place.ravel(), x.ravel()
    first = np.concatenate(([True], place[1:] != place[:-1]))
    low = x[first] << np.uint64(bits)
    # Leading zeros by way of the exponent; rounding up to a power of two is undone by the comparison.
    zeros = np.full(len(low), 63, dtype=np.int64)
    some = low > 0
    top = np.minimum(np.frexp(low[some].astype(np.float64))[1].astype(np.int64), 64)
    top -= (low[some] >> (top - 1).astype(np.uint64)) == 0
    zeros[some] = np.minimum(64 - top, 62)
    mantissa = (low << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out = np.full(REGISTERS, EMPTY, dtype=np.uint16)
    out[place[first]] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    return out


def collision_rate(load_a: float, load_b: float) -> float:
    """The chance that registers of disjoint sets are equal, given the shingles per bucket."""
    level = 2.0 ** -np.arange(0, 63)
    rate = lambda load: np.exp(-load * level / 2) - np.exp(-load * level)
    return float((rate(load_a) * rate(load_b)).sum() * 2.0**-MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, size_class_: int) -> float:
    """The Jaccard similarity of two signed sets, corrected for accidental collisions."""
    used = (a != EMPTY) | (b != EMPTY)
    share = float(((a == b) & used).sum()) / max(1, int(used.sum()))
    buckets = 1 << bucket_bits(size_class_)
    chance = collision_rate(n_a / buckets, n_b / buckets)
    return (share - chance) / (1 - chance)


def sketches(docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """``(id, n, digest, signatures)`` of each row of ``docs(id, text)``."""
    schema = "id bigint, n bigint, digest binary, signatures array<struct<cls:int,sig:binary>>"
    kind = pa.list_(pa.struct([("cls", pa.int32()), ("sig", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            n, digest, signed = [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, size, memo)
                n.append(len(hashes))
                digest.append(hashlib.sha256(hashes.tobytes()).digest()[:16] if len(hashes) else None)
                signed.append([{"cls": c, "sig": signature(hashes, c).tobytes()} for c in classes(len(hashes), threshold)] if len(hashes) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(signed, kind)], ["id", "n", "digest", "signatures"])

    return docs.mapInArrow(run, schema)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """``(id, shingles)``: each text's set as the bytes of its sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(t, size, memo).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    return docs.mapInArrow(run, "id bigint, shingles binary")


def _passing(pairs: DataFrame, signed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar enough: by estimate first, then on the full sets."""
    threshold = percent / 100
    floor = threshold - MARGIN * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    sizes = signed.select("id", "n").distinct()
    alike = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    both = pairs.select("a", "b")
    for x in ("a", "b"):
        both = both.join(sizes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}")), x)
    both = both.where(alike).join(signed.select(F.col("id").alias("a"), "cls", F.col("sig").alias("sig_a")), "a")
    both = both.join(signed.select(F.col("id").alias("b"), "cls", F.col("sig").alias("sig_b")), ["b", "cls"])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            registers = lambda raw: np.frombuffer(raw, dtype=np.uint16)
            mask = [
                estimate(registers(x), registers(y), n, m, k) >= floor
                for x, y, n, m, k in zip(c["sig_a"], c["sig_b"], c["n_a"], c["n_b"], c["cls"], strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

    likely_pairs = both.select("a", "b", "cls", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(likely, "a bigint, b bigint").distinct()

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                common = len(np.intersect1d(s, t, assume_unique=True))
                mask.append(100 * common >= percent * (len(s) + len(t) - common))
            yield batch.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

    full = likely_pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(similar, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs``.

    Documents are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of ``shingle`` words;
    ``component_id`` is the smallest doc_id that links reach, ``kept`` whether it is the document itself.
    """
    threshold = percent / 100
    plain = docs.select(whole_number(docs, doc_id).alias("id"), F.col(text).alias("text"))
    sketch = stored(sketches(plain, shingle, threshold), "sketches")
    node = sketch.where("id IS NOT NULL AND n > 0")
    same = stored(node.groupBy("digest").agg(F.min("id").alias("rep")), "same-sets")
    signed = node.join(same, (node["digest"] == same["digest"]) & (node["id"] == same["rep"]), "left_semi")
    signed = stored(signed.select("id", "n", F.inline("signatures")), "signed")

    band = lambda i: F.substring("sig", 2 * ROWS * i + 1, 2 * ROWS)
    keys = F.array(*[F.xxhash64("cls", F.lit(i), band(i)) for i in range(BANDS)])
    bands = signed.select("id", F.explode(keys).alias("key"))
    shared = stored(bands.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("size")).where("low < high"), "shared-bands")
    buckets = stored(bands.join(shared.drop("high"), "key"), "buckets")

    pairs = stored(buckets.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    members = buckets.select("id").distinct()
    sets = stored(_sets(plain.join(members, "id", "left_semi"), shingle).distinct(), "sets")
    links = _links_of_repeated_ids(sketch, same)
    edges = stored(links.unionAll(_passing(pairs, signed, sets, percent)), "links")

    label = stored(components(edges), "labels")
    large = stored(buckets.where("size > 2"), "large-buckets")
    # Another representative for the buckets that hold several components.
    members = _of_open_buckets(large, label)
    other = members.groupBy("key").agg(F.min_by("id", F.xxhash64("id", "key")).alias("a"), F.min_by("component", F.xxhash64("id", "key")).alias("of"))
    new = _new_pairs(members.join(other, "key").where("component <> of"), pairs)
    found = stored(_passing(new, signed, sets, percent), "links")
    tried, edges = pairs.unionAll(new), edges.unionAll(found)
    label = stored(components(edges), "labels")
    # All that is left: within small buckets by themselves, within large ones by prefix.
    members = stored(_of_open_buckets(large, label), "open-buckets")
    small = members.where(F.col("size") <= SMALL_BUCKET)
    other = small.select("key", F.col("id").alias("a"), F.col("component").alias("of"))
    within = small.join(other, "key").where("component < of").select("a", "id")
    crowd = members.where(F.col("size") > SMALL_BUCKET)
    new = _new_pairs(within.unionAll(_similar_in_blocks(crowd, sets, signed.select("id", "n").distinct(), percent)), tried)
    found = stored(_passing(new, signed, sets, percent), "links")
    if not found.isEmpty():
        label = stored(components(edges.unionAll(found)), "labels")

    found = sketch.select("id", "n", "digest").join(same, "digest", "left").select("id", "n", "rep")
    found = found.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return found.select(
        F.col("id").alias(doc_id),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _links_of_repeated_ids(sketch: DataFrame, same: DataFrame) -> DataFrame:
    """Links between the groups of equal sets that rows with one id belong to."""
    nodes = sketch.where("id IS NOT NULL AND n > 0").join(same, "digest").select("id", "rep")
    spread = nodes.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    return nodes.join(spread, "id").where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()


def _of_open_buckets(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """``(key, id, size, component)`` of the members of buckets that hold several components."""
    members = buckets.join(label, "id", "left").select("key", "id", "size", F.coalesce("component", "id").alias("component"))
    mixed = members.groupBy("key").agg(F.min("component").alias("first"), F.max("component").alias("last")).where("first < last")
    return members.join(mixed.select("key"), "key", "left_semi")


def _new_pairs(met: DataFrame, tried: DataFrame) -> DataFrame:
    """The pairs ``a``, ``id`` in order, once each and without those tried."""
    pairs = met.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    return stored(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")


def _blocks(members: DataFrame) -> DataFrame:
    """``(key, id, component, x, y, own)`` from ``(key, id, component, n)``: each member once for each two
    blocks, ``own`` among them, that have to meet. Blocks below ``strangers`` hold members outside the
    bucket's largest component; the others, whose members are all of it, need not meet each other."""
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    largest = F.struct("size", "component")
    total = sizes.groupBy("key").agg(F.max(largest).alias("most"), F.max_by("n", largest).alias("n_most"), F.sum("size").alias("size"), F.sum("n").alias("n"))
    many = lambda size, n: F.ceil(F.greatest(size / BLOCK, n / BLOCK_SHINGLES))
    total = total.select(
        "key",
        F.col("most.component").alias("main"),
        many(F.col("size") - F.col("most.size"), F.col("n") - F.col("n_most")).alias("strangers"),
        many(F.col("most.size"), F.col("n_most")).alias("copies"),
    )
    rows = members.join(total, "key")
    stranger = F.col("component") != F.col("main")
    place = F.xxhash64("id")
    rows = rows.withColumn("own", F.when(stranger, F.pmod(place, "strangers")).otherwise(F.col("strangers") + F.pmod(place, "copies")))
    last = F.when(stranger, F.col("strangers") + F.col("copies")).otherwise(F.col("strangers")) - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return rows.select("key", "id", "component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own")


def _similar_in_blocks(members: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """``(a, id)`` of different components in a bucket that look similar enough on 32 bits of each hash,
    from ``(key, id, size, component)`` and ``sizes(id, n)``. Each two blocks that meet are one row."""

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.frombuffer(x, dtype=np.uint64) for x in batch.column(1).to_pylist()]
            short = [np.unique((x >> np.uint64(32)).astype(np.uint32)).tobytes() for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(short, pa.binary())], ["id", "n", "short"])

    short = sets.join(members.select("id").distinct(), "id", "left_semi").mapInArrow(shorten, "id bigint, n bigint, short binary")
    rows = _blocks(members.select("key", "id", "component").join(sizes, "id")).join(short, "id")
    rows = rows.select("key", "x", "y", F.struct("id", "component", "own", "n", "short").alias("m"))
    gathered = rows.groupBy("key", "x", "y").agg(F.collect_set("m").alias("members")).select("x", "y", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y, block = (batch.column(k)[i].as_py() for k in range(3))
                found = list(_similar_members(block, x != y, percent))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "id"])

    return gathered.mapInArrow(run, "a bigint, id bigint").distinct()


def _similar_members(block: list[dict], across: bool, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of ids; ``across``: only of members that are in different halves of the block."""
    tokens = [np.frombuffer(m["short"], dtype=np.uint32) for m in block]
    ids, component, own, n = (np.array([m[c] for m in block]) for c in ("id", "component", "own", "n"))
    # The largest component's members only meet the others.
    names, kind = np.unique(component, return_inverse=True)
    outside = np.flatnonzero(kind != np.bincount(kind).argmax())
    different, number = np.unique(np.concatenate(tokens), return_inverse=True)
    shared = np.bincount(number) > 1
    place = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(block)), [len(t) for t in tokens])
    keep = shared[number]
    owner, number = owner[keep], place[number[keep]]
    width = max(1, int(shared.sum()))
    step = max(1, CELLS // len(block))
    common = np.zeros((len(outside), len(block)), dtype=np.float32)
    for start in range(0, width, step):
        part = (number >= start) & (number < start + step)
        matrix = np.zeros((len(block), min(step, width - start)), dtype=np.float32)
        matrix[owner[part], number[part] - start] = 1
        common += matrix[outside] @ matrix.T
    # Shingles that a text lost to equal short hashes; a pair has lost no more in common than either.
    lost = n - np.array([len(t) for t in tokens])
    most = common + np.minimum(lost[outside][:, None], lost[None, :])
    similar = (100 * most >= percent * (n[outside][:, None] + n[None, :] - most)) & (component[outside][:, None] != component[None, :])
    similar &= 100 * np.minimum(n[outside][:, None], n[None, :]) >= percent * np.maximum(n[outside][:, None], n[None, :])
    if across:
        similar &= own[outside][:, None] != own[None, :]
    for i, j in zip(*np.nonzero(similar), strict=True):
        yield int(ids[outside[i]]), int(ids[j])
