"""A Merkle manifest of a dataset: digests of rows in a tree per group, proofs by descent.

Each row is a leaf: the digest of its fields. Leaves of a group stand in order; every ``ARITY`` consecutive
nodes become their parent until one is left, the group's root. The group roots, in the order of the groups,
become the root of the manifest in the same way. An inner node is stored once as a record, digest to
children, whatever tree it stands in: equal subtrees are one record.

A proof is found from the root down. Requests are ranks; a level's frontier holds the different nodes that
lead to a requested leaf, each with the path so far. The record of a frontier node's digest gives its
children, the next digit of the rank in base ``ARITY`` picks one, and the others, left and right of it,
are the path's next segment. Frontiers are joined with records by digest and with the requests below them by
place, so a join meets each node once and no key is hot though all paths begin at the root: a level has an
eighth of the rows of the one below. Segments are reversed at the leaf, so they go up.

Leaves are put in order by sorted ranges, whose sizes are added up per range and group: no group, however
large, passes through one task. Trees are built level by level from tables in the shared scratch folder.
Only DataFrame functions are used.

Edge cases: nulls are a digest input of their own, in any column; a null group comes first, rows without a
key first in their group. Rows with equal keys are ordered by digest; equal rows are leaves of their own. A
group with one row has the leaf as its root, a manifest with one group that group's root. An empty table has
no root and no records. Texts of any length are hashed as a whole. A row stays one struct throughout, so its
columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billweave.llm.common import stored

BITS = 3
ARITY = 1 << BITS
#: The tree over the group roots.
TOP = "top"


def field_of(value: Column) -> Column:
    """How a value enters a digest: ``-`` for null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_of(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


@dataclass(frozen=True)
class Manifest:
    """``leaves``: ``tree``, ``place`` (rank in the tree), ``leaf`` and ``row``, the row it was made from.
    ``records``: ``digest`` and ``children``. ``groups``: ``tree``, ``place`` (rank of the group), ``subroot``
    and ``depth`` (levels above the leaves). ``top``: one row ``digest`` and ``depth`` of the root, or none."""

    leaves: DataFrame
    records: DataFrame
    groups: DataFrame
    top: DataFrame

    def root(self) -> str | None:
        first = self.top.first()
        return first["digest"] if first else None


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows(tree, ...)`` with ``place``, the rank within their tree by ``order``, and ``n``, the rows of the tree.

    Rows are dealt by ranges of tree and order; each counts from its range's first row of that tree, and what
    earlier ranges hold of the tree is added. The number of such counts is that of ranges plus that of trees.
    """
    keys = ["tree", *order, "spread"]
    spread = rows.withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    ranges = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("spread")
    at = stored(ranges.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ranges")
    counts = at.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "tree",
        "part",
        (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(Window.partitionBy("tree")).alias("n"),
    )
    return at.join(offsets, ["tree", "part"]).select(*rows.columns, (F.col("at") + F.col("shift")).alias("place"), "n")


def built(nodes: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Trees over ``nodes(tree, place, digest, n)``: the records, if there are any, and ``(tree, digest,
    depth)`` of the roots."""
    records, roots, depth = None, None, 0
    while True:
        done = nodes.where("n = 1").select("tree", "digest", F.lit(depth).alias("depth"))
        roots = done if roots is None else roots.unionAll(done)
        nodes = nodes.where("n > 1")
        if nodes.isEmpty():
            return records, roots
        member = F.struct(F.col("place").alias("at"), "digest")
        runs = nodes.groupBy("tree", _above("place").alias("place")).agg(F.array_sort(F.collect_list(member)).alias("run"), F.max("n").alias("n"))
        runs = runs.select("tree", "place", F.transform("run", lambda x: x["digest"]).alias("children"), _above(F.col("n") + ARITY - 1).alias("n"))
        nodes = stored(runs.withColumn("digest", F.sha2(F.array_join("children", ""), 256)), "nodes")
        depth += 1
        level = nodes.select("digest", "children")
        records = level if records is None else records.unionAll(level)


def _above(place: Column | str) -> Column:
    return F.shiftright(place, BITS)


def manifest(rows: DataFrame, leaf: Column, group: str, order: list[str]) -> Manifest:
    """The manifest over the digests ``leaf`` of ``rows``. Within a group leaves ascend by ``order``, null
    first; the groups ascend bytewise, null first."""
    # A key that sorts as the group does, with null first.
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    # Hashed once: sorting by ranges reads its input twice.
    hashed = stored(rows.select(tree.alias("tree"), F.struct(*order).alias("key"), leaf.alias("leaf"), F.struct("*").alias("row")), "hashed")
    placed = stored(ranked(hashed, ["key", "leaf"]), "leaves")
    records, roots = built(placed.select("tree", "place", F.col("leaf").alias("digest"), "n"))
    tops = roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("group"), F.col("digest").alias("subroot"), "depth")
    tops = stored(ranked(stored(tops, "roots"), ["group"]), "groups")
    upper, top = built(tops.select("tree", "place", F.col("subroot").alias("digest"), "n"))
    known = [r for r in (records, upper) if r is not None] or [placed.limit(0).select(F.col("leaf").alias("digest"), F.array("leaf").alias("children"))]
    records = stored(reduce(DataFrame.unionAll, known).dropDuplicates(["digest"]), "records")
    groups = tops.select(F.col("group").alias("tree"), "place", "subroot", "depth")
    return Manifest(placed.select("tree", "place", "leaf", "row"), records, groups, stored(top.select("digest", "depth"), "top"))


def descended(records: DataFrame, starts: DataFrame, requests: DataFrame) -> DataFrame:
    """From ``starts(tree, digest, depth, path)`` down to ``requests(tree, place, row)``: the requests with
    ``reached``, the digest found at their place, ``start`` and ``path``, its segments from the top on.
    Requests that name no place of a tree are not in it."""
    deepest = starts.agg(F.max("depth")).first()[0] or 0
    below = [requests]
    for _ in range(deepest):
        below.append(below[-1].select("tree", _above("place").alias("place")).distinct())
    none = F.lit(0).cast("long").alias("place")
    frontier = None
    for level in range(deepest, -1, -1):
        begin = starts.where(F.col("depth") == level).select("tree", none, "digest", F.col("digest").alias("start"), "path")
        frontier = begin if frontier is None else begin.unionAll(frontier)
        if level == 0:
            break
        opened = frontier.join(records, "digest").select(F.col("tree").alias("t"), F.col("place").alias("p"), "children", "start", "path")
        digit = F.col("place").bitwiseAND(ARITY - 1).cast("int")
        step = below[level - 1].join(opened, (F.col("tree") == F.col("t")) & (_above("place") == F.col("p"))).where(digit < F.size("children"))
        left = F.array_join(F.slice("children", F.lit(1), digit), "")
        right = F.array_join(F.slice("children", digit + 2, F.lit(ARITY)), "")
        path = F.concat("path", F.array(F.struct(left.alias("left"), right.alias("right")))).alias("path")
        row = ["row"] if level == 1 else []
        step = step.select("tree", "place", *row, F.get("children", digit).alias("digest"), "start", path)
        if level > 1:
            frontier = step
    # Trees of a single leaf have nothing to descend.
    flat = begin.select(F.col("tree").alias("t"), F.col("place").alias("p"), "digest", "start", "path")
    single = requests.join(flat, (F.col("tree") == F.col("t")) & (F.col("place") == F.col("p"))).select("tree", "place", "row", "digest", "start", "path")
    found = single if deepest == 0 else step.unionAll(single)
    return found.withColumnRenamed("digest", "reached")


def proofs(made: Manifest, requests: DataFrame) -> DataFrame:
    """``requests(tree, place, row)`` with ``reached`` (the leaf at that place), ``subroot``, ``root`` and
    ``path``: for each level from the leaf up, the digests ``left`` and ``right`` of it, as one text each."""
    top = made.top.select(F.lit(TOP).alias("tree"), "digest", "depth", F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    groups = made.groups.select(F.lit(TOP).alias("tree"), "place", F.struct(F.col("tree").alias("group"), "depth").alias("row"))
    upper = descended(made.records, top, groups)
    starts = stored(upper.select(F.col("row.group").alias("tree"), F.col("reached").alias("digest"), F.col("row.depth").alias("depth"), "path"), "starts")
    lower = descended(made.records, starts, requests)
    return lower.select("tree", "place", "row", "reached", F.col("start").alias("subroot"), F.lit(made.root()).alias("root"), F.reverse("path").alias("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path from it up lead to. A level without neighbours is folded as well."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path as one text, from the leaf up, left to right."""
    return F.aggregate(path, F.lit(""), lambda text, s: F.concat(text, s["left"], s["right"]))
