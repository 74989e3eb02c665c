"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard
from .common import written


def connected(edges: DataFrame, label: str, folders: list[str] | None = None) -> DataFrame:
    """(v, root) for every vertex of edges (a, b) but the roots themselves; the root is a component's smallest vertex.

    Each round is written to the shared folder, so that a lost executor repeats one round, and the round before is deleted; the
    folder of the result is added to ``folders``. Only sums reach the driver."""
    now, folder = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = _sum(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        own = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(own, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        last, (now, folder) = folder, written(small, label)
        discard(now.sparkSession, [last])
        after = _sum(now)
        if after == before:
            break
        before = after
    if folders is not None:
        folders.append(folder)
    return now.select(F.col("a").alias("v"), F.col("b").alias("root"))


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
