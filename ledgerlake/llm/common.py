"""What the operators of this subpackage share: the shared folder and native let-bindings."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder

#: With this, Spark deletes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: ASCII white space ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and its path there, for Python workers."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + unquote(path[5:]).lstrip("/")
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage with a table in the shared folder, so that a lost executor costs no earlier stage again."""
    return written(df, label)[0]


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """What ``materialize`` gives, and its folder, for a caller that discards it before the process ends."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: a lambda variable inside higher-order functions costs no new evaluation."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hot_join(left: DataFrame, right: DataFrame, key: str, count: str, spread: Column, most: int = 1000) -> DataFrame:
    """left with the columns of right (null where it has no row), which has one row a key and counts its rows of left.

    Fewer than ``most`` keys can have more than one row in ``most``: these are broadcast, so that no task gets all rows of one.
    The others meet by hash; rows that are served already, or have a null key, are dealt by ``spread``."""
    right = materialize(right, "hot-join")
    limit = (right.agg(F.sum(count)).first()[0] or 0) / most
    fields = [c for c in right.columns if c not in (key, count)]
    value = F.struct(*fields)
    hot = right.filter(F.col(count) > limit).select(F.col(key).alias("_hk"), value.alias("_hot"))
    cold = right.filter(F.col(count) <= limit).select(F.col(key).alias("_ck"), F.lit(True).alias("_cf"), value.alias("_cold"))
    marked = left.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left").withColumn("_f", F.col("_hk").isNull() & F.col(key).isNotNull())
    dealt = marked.withColumn("_k", F.when(F.col("_f"), F.col(key)).otherwise(spread.cast(left.schema[key].dataType)))
    joined = dealt.join(cold, (F.col("_k") == F.col("_ck")) & (F.col("_f") == F.col("_cf")), "left")
    return joined.select(*[F.col(c) for c in left.columns], *[F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in fields])


def plus(docs: DataFrame, **added: Column) -> DataFrame:
    """docs with columns added at the end; one of docs of the same name (whatever its case) gives way."""
    names = {n.lower() for n in added}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names], *[c.alias(n) for n, c in added.items()])
