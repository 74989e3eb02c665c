"""History: changes, running value sets, differences of two folds, and what would undo them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.log import COLUMNS, fold, is_add, moment, text_of


def review(revisions: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """(version, seq, action, key, record, str): changes from start on, before end."""
    out = revisions
    if start is not None:
        out = out.filter(F.col("version") >= start)
    if end is not None:
        out = out.filter(F.col("version") < end)
    return out.select("version", "seq", "action", "key", "record", "str")


def described(revisions: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """(record, version, changes array<string>): the changes of each version of a record, in words."""
    verb = F.when(F.col("action") == "ADD", "added").otherwise("removed")
    text = F.concat_ws(" ", verb, "key", F.when(F.col("action") == "ADD", "as").otherwise("from"), F.coalesce("str", F.lit("")))
    rows = review(revisions, start, end)
    return rows.groupBy("record", "version").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", text.alias("t")))), lambda s: s["t"]).alias("changes"))


def chronologize(revisions: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """(record, key, version, values array<string>): the value set after each change; empty sets are left out.

    Changes of a field are numbered; a value that is live from change i until change j is a row of each change between, which is
    the result's own size. Changes before start count but are not shown."""
    rows = revisions if end is None else revisions.filter(F.col("version") < end)
    states = rows.withColumn("m", moment()).groupBy("record", "key", "vid", "version").agg(F.max("m").alias("m")).withColumn("on", is_add("m"))
    field, value = Window.partitionBy("record", "key"), Window.partitionBy("record", "key", "vid").orderBy("version")
    numbered = states.withColumn("i", F.dense_rank().over(field.orderBy("version")))
    shown = F.lit(0) if start is None else F.max(F.when(F.col("version") < start, F.col("i")).otherwise(0)).over(field)
    numbered = numbered.withColumn("last", F.max("i").over(field)).withColumn("first", shown + 1)
    turned = numbered.withColumn("was", F.coalesce(F.lag("on").over(value), F.lit(False))).filter("on <> was")
    spans = turned.withColumn("until", F.coalesce(F.lead("i").over(value) - 1, F.col("last"))).filter("on").withColumn("i", F.greatest("i", "first")).filter("i <= until")
    each = spans.select("record", "key", text_of(F.col("vid")).alias("str"), F.explode(F.sequence("i", "until")).alias("i"))
    points = numbered.filter("i >= first").select("record", "key", "i", "version").distinct()
    return each.join(points, ["record", "key", "i"]).groupBy("record", "key", "version").agg(F.array_sort(F.collect_list("str")).alias("values"))


def running_counts(revisions: DataFrame) -> DataFrame:
    """(record, key, version, n): sizes of the sets of chronologize by a window, for histories too long for one array."""
    sign = F.when(F.col("action") == "ADD", 1).otherwise(-1)
    per = revisions.groupBy("record", "key", "version").agg(F.sum(sign).alias("d"))
    return per.select("record", "key", "version", F.sum("d").over(Window.partitionBy("record", "key").orderBy("version")).alias("n"))


def diff(revisions: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """(key, record, vid, str, action): what became live (ADDED) or stopped being so (REMOVED) between two times.

    One aggregation makes both folds. Limit revisions to a key, a record or a field before."""
    seen = revisions if end is None else revisions.filter(F.col("version") <= end)
    ends = seen.withColumn("m", moment()).groupBy("key", "record", "vid").agg(F.max(F.when(F.col("version") <= start, F.col("m"))).alias("a"), F.max("m").alias("b"))
    was, now = F.coalesce(is_add("a"), F.lit(False)), is_add("b")
    return ends.filter(was != now).select("key", "record", "vid", text_of(F.col("vid")).alias("str"), F.when(now, "ADDED").otherwise("REMOVED").alias("action"))


def revert(revisions: DataFrame, to: int, version: int) -> DataFrame:
    """New revisions that bring the state at ``to`` back: the symmetric difference of then and now."""
    then, now = fold(revisions, to), fold(revisions)
    key = ["key", "record", "vid"]
    back = then.join(now, key, "left_anti").withColumn("action", F.lit("ADD"))
    away = now.join(then, key, "left_anti").withColumn("action", F.lit("REMOVE"))
    rows = back.unionByName(away)
    return rows.select(F.lit(version).alias("version"), F.lit(0).cast("long").alias("seq"), "action", "key", "record", "type", "num", "str", "vid").select(*COLUMNS)


def as_of(revisions: DataFrame, times: DataFrame) -> DataFrame:
    """(record, key, at, str, vid) of the last live value of a field at each time of times (record, key, at).

    Times and revisions meet in one sorted stream per field, so no pair of them is made: the last change at or before a time
    is carried forward. For fields that hold one value at a time."""
    changes = revisions.groupBy("record", "key", "version").agg(F.max(F.struct("seq", "action", "str", "vid")).alias("c"))
    both = changes.select("record", "key", F.col("version").alias("at"), F.lit(0).alias("asks"), "c").unionByName(times.select("record", "key", "at", F.lit(1).alias("asks"), F.lit(None).cast(changes.schema["c"].dataType).alias("c")))
    w = Window.partitionBy("record", "key").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("c", F.last("c", ignorenulls=True).over(w)).filter("asks = 1 AND c.action = 'ADD'")
    return found.select("record", "key", "at", "c.str", "c.vid")


def as_of_sets(revisions: DataFrame, times: DataFrame) -> DataFrame:
    """(record, key, at, str, vid): every value that is live at each time of times (record, key, at), for fields of any number of
    values.

    The times of a field are numbered; a value that is live from time i to time j is a row of each of these, which is the
    result's own size. Changes and times meet in one sorted stream per field."""
    states = revisions.withColumn("m", moment()).groupBy("record", "key", "vid", "version").agg(F.max("m").alias("m")).withColumn("on", is_add("m"))
    asked = times.select("record", "key", "at").distinct()
    both = states.select("record", "key", F.col("version").alias("at"), F.lit(0).alias("asks"), "vid", "on").unionByName(asked.select("record", "key", "at", F.lit(1).alias("asks"), F.lit(None).cast("string").alias("vid"), F.lit(None).cast("boolean").alias("on")))
    field = Window.partitionBy("record", "key")
    before = F.sum("asks").over(field.orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0))
    numbered = both.withColumn("i", before).withColumn("all", F.sum("asks").over(field))
    value = Window.partitionBy("record", "key", "vid").orderBy("at")
    turned = numbered.filter("asks = 0").withColumn("was", F.coalesce(F.lag("on").over(value), F.lit(False))).filter("on <> was")
    spans = turned.withColumn("until", F.coalesce(F.lead("i").over(value), F.col("all"))).filter("on AND i < until")
    each = spans.select("record", "key", "vid", F.explode(F.sequence(F.col("i") + 1, F.col("until"))).alias("i"))
    found = each.join(numbered.filter("asks = 1").select("record", "key", "i", "at"), ["record", "key", "i"])
    return found.select("record", "key", "at", text_of(F.col("vid")).alias("str"), "vid")
