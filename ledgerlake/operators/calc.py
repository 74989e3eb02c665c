"""Calculations over triples: exact decimal sums, averages rounded to ten places, and an error for what is not a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = ("sum", "avg", "count", "max", "min")


def _checked(t: DataFrame) -> DataFrame:
    """Links count as numbers, as the data model's links are; every other value that is no number is an error."""
    bad = F.concat(F.lit("not a number: "), F.coalesce(F.col("str"), F.lit("null")))
    return t.withColumn("num", F.when(F.col("rank") <= 1, F.col("num")).otherwise(F.raise_error(bad)))


def _exact(c: Column) -> Column:
    """Numbers as decimals of ten places; what is beyond them is an error by name, never a wrong sum."""
    fits = c.try_cast("decimal(38,10)")
    return F.when(c.isNotNull() & fits.isNull(), F.raise_error(F.concat(F.lit("beyond the exact range: "), c.cast("string"))).cast("decimal(38,10)")).otherwise(fits)


def aggregate(name: str) -> Column:
    num = F.col("num")
    return {
        "sum": lambda: F.sum(_exact(num)),
        # the quotient of an exact sum and a count, rounded once
        "avg": lambda: (F.sum(_exact(num)) / F.count(num).cast("decimal(20,0)")).cast("decimal(38,10)"),
        "count": lambda: F.count(num),
        "max": lambda: F.max(num),
        "min": lambda: F.min(num),
    }[name]()


def over(t: DataFrame, name: str, records: bool = False) -> DataFrame:
    """(value) of all triples. Of no triples: 0 for a count, and for an average of listed records; else null."""
    value = aggregate(name)
    if name == "avg" and records:
        value = F.coalesce(value, F.lit(0).cast("decimal(38,10)"))
    return _checked(t).agg(value.alias("value"))


def by_record(t: DataFrame, name: str) -> DataFrame:
    """(record, value)."""
    return _checked(t).groupBy("record").agg(aggregate(name).alias("value"))


#: The data types of values.
TYPES = ["BOOLEAN", "DOUBLE", "FLOAT", "INTEGER", "LINK", "LONG", "STRING", "TAG", "TIMESTAMP"]


def statistics(t: DataFrame) -> DataFrame:
    """Per key: count of values, distinct ones and their share (distinctiveness), records, the share of all values that the key
    has (proportion), numbers from the least to the largest value (spread), and of each data type the share of values."""
    share = lambda kind: F.avg(F.when(F.col("type") == kind, 1.0).otherwise(0.0)).alias(f"percent_{kind.lower()}")
    number = F.when(F.col("rank") == 0, F.col("num"))
    own = t.groupBy("key").agg(F.count("*").alias("count"), F.countDistinct("vid").alias("distinct"), F.countDistinct("record").alias("records"), (F.max(number) - F.min(number)).alias("spread"), *map(share, TYPES))
    # one row: how many values there are
    total = own.agg(F.sum("count").alias("_all"))
    return own.crossJoin(F.broadcast(total)).select("key", "count", "distinct", "records", (F.col("distinct") / F.col("count")).alias("distinctiveness"), (F.col("count") / F.col("_all")).alias("proportion"), "spread", *[f"percent_{k.lower()}" for k in TYPES])


def contains_type(t: DataFrame, key: str, kind: str) -> bool:
    """Whether any value of the key has the data type."""
    return bool(t.filter((F.col("key") == key) & (F.col("type") == kind)).limit(1).count())
