"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.session import scratch_dir, written
from billweave.sources.storage import delete_folder


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every end of the edges ``(a, b)``: the smallest id that can be reached.

    Each round points the neighbours of an id at the smallest of them, first the larger ones, then the
    others; the rounds end when each component is a star around its smallest id, after a number that
    grows with the logarithm of the longest path. Edges stay in tables in the shared scratch folder; only
    whether a row is left reaches the driver. An id with very many edges is a hot key of an aggregate with partial minima and of a join that
    adaptive execution can split.
    """
    spark, path = edges.sparkSession, scratch_dir(edges.sparkSession, "edges")
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), path)
    while not _are_stars(now):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        old, path = path, scratch_dir(spark, "edges")
        now = written(small.where("u <> v").distinct(), path)
        delete_folder(spark, old)
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether each ``u`` has a single ``v``, which is no ``u`` itself."""
    several = edges.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low < high")
    inner = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
    return several.select("u").unionAll(inner).isEmpty()
