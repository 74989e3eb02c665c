"""Order and pages of records.

A record stands where its values of a key put it: as a list, from the smallest (ascending) or the largest (descending), by the
first value that differs; records without the key come last in either direction; the record id, read as unsigned, breaks ties.
A key may be a path over links, and may be ordered by its values at another time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ccl import Page, Sort
from ..sources.log import rank
from .navigate import key_triples


def unsigned(record: Column) -> list[Column]:
    return [F.shiftrightunsigned(record, 1), record.bitwiseAND(F.lit(1))]


def value_order() -> Column:
    """The order of values: numbers, links, then text regardless of case, then text."""
    return F.struct(F.col("rank"), F.col("num"), F.when(F.col("rank") == 2, F.lower("str")).alias("lc"), F.when(F.col("rank") == 2, F.col("str")).alias("raw"))


def sort_columns(store, frame: DataFrame, order: tuple[Sort, ...], at: int | None = None) -> tuple[DataFrame, list[Column], list[str]]:
    """frame (record, ...) with one order column per key, what to sort by, and the added columns."""
    by, added = [], []
    for i, s in enumerate(order):
        t = key_triples(store, s.key, s.at if s.at is not None else at)
        if store.unique(s.key):
            least = t.select("record", value_order().alias(f"_o{i}"))
        else:
            least = t.groupBy("record").agg(F.sort_array(F.collect_set(value_order()), s.ascending).alias(f"_o{i}"))
        frame = frame.join(least, "record", "left")
        by.append(F.col(f"_o{i}").asc_nulls_last() if s.ascending else F.col(f"_o{i}").desc_nulls_last())
        added.append(f"_o{i}")
    return frame, by, added


def sort_result(result: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """A flat result (record, key, rank or type, num, str ...) by the values it holds itself, without the store: all rows of a
    record stay together; keys are (key, ascending)."""
    rows = result if "rank" in result.columns else result.withColumn("rank", rank(F.col("type")))
    per = rows.groupBy("record").agg(*[F.sort_array(F.collect_set(F.when(F.col("key") == k, value_order())), up).alias(f"_o{i}") for i, (k, up) in enumerate(keys)])
    per = per.select("record", *[F.when(F.size(f"_o{i}") > 0, F.col(f"_o{i}")).alias(f"_o{i}") for i in range(len(keys))])
    by = [F.col(f"_o{i}").asc_nulls_last() if up else F.col(f"_o{i}").desc_nulls_last() for i, (_, up) in enumerate(keys)]
    return result.join(per, "record").orderBy(*by, *unsigned(F.col("record")), "key", "vid").drop(*[f"_o{i}" for i in range(len(keys))])


def arrange(store, records: DataFrame, order: tuple[Sort, ...] = (), page: Page | None = None, at: int | None = None) -> DataFrame:
    """Distinct records in order, then the page. With a page Spark keeps the top rows only."""
    frame, by, added = sort_columns(store, records, order, at)
    if order or page:
        frame = frame.orderBy(*by, *unsigned(F.col("record")))
    if page:
        if page.skip:
            frame = frame.offset(page.skip)
        if page.limit is not None:
            frame = frame.limit(page.limit)
    return frame.drop(*added)
