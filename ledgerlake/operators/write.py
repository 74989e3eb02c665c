"""Writes as new revisions. Every function gives the rows to append; Ledger.append publishes them under one version.

What a writer refuses is left out by joins with the live triples: an ADD of a live value, a REMOVE of one that is not.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import Call, Link, Scalar, identity, type_of
from ..sources.log import COLUMNS, fold, num_of, text_of

_KEYS = ["key", "record", "vid"]


class InvalidWrite(ValueError):
    pass


class DuplicateEntry(ValueError):
    pass


def check(key: str, value: Scalar, record: int | None) -> None:
    if not re.fullmatch(r"[A-Za-z0-9_]+", key):
        raise InvalidWrite(f"not a writable key: {key!r}")
    if isinstance(value, Call):
        raise InvalidWrite("a calculation cannot be stored")
    if value is None or (isinstance(value, str) and not value.strip()):
        raise InvalidWrite("a blank value cannot be stored")
    if isinstance(value, Link) and value.record == record:
        raise InvalidWrite("a record cannot link to itself")


def intents(spark: SparkSession, rows: list[tuple[str, str, Scalar, int]], version: int) -> DataFrame:
    """Driver-side writes (action, key, value, record) in order, as revisions."""
    found: list[tuple] = []
    for seq, (action, key, value, record) in enumerate(rows):
        check(key, value, record if action == "ADD" else None)
        found.append((version, seq, action, key, record, type_of(value), identity(value)))
    # an Arrow table becomes a local relation: part of the plan, without a job of its own
    columns = zip(*found, strict=True) if found else [[]] * 7
    schema = pa.schema([("version", pa.int64()), ("seq", pa.int64()), ("action", pa.string()), ("key", pa.string()), ("record", pa.int64()), ("type", pa.string()), ("vid", pa.string())])
    table = pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    vid = F.col("vid")
    return spark.createDataFrame(table).select("version", "seq", "action", "key", "record", "type", num_of(vid).alias("num"), text_of(vid).alias("str"), "vid").select(*COLUMNS)


def effective(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted without ADDs of live values and REMOVEs of values that are not live."""
    live = fold(log).select(*_KEYS)
    adds = wanted.filter("action = 'ADD'").dropDuplicates(_KEYS).join(live, _KEYS, "left_anti")
    removes = wanted.filter("action = 'REMOVE'").dropDuplicates(_KEYS).join(live, _KEYS, "left_semi")
    return adds.unionByName(removes).select(*COLUMNS)


def _from_live(live: DataFrame, action: str, version: int, seq: int = 0) -> DataFrame:
    return live.select(F.lit(version).cast("long").alias("version"), F.lit(seq).cast("long").alias("seq"), F.lit(action).alias("action"), "key", "record", "type", "num", "str", "vid").select(*COLUMNS)


def clear(log: DataFrame, records: DataFrame | None, keys: list[str] | None, version: int) -> DataFrame:
    """REMOVEs of all live values of keys (or of every key) of records (record) (or of every record)."""
    live = fold(log if keys is None else log.filter(F.col("key").isin(*keys)))
    return _from_live(live if records is None else live.join(records.select("record"), "record", "left_semi"), "REMOVE", version)


def set_values(log: DataFrame, target: DataFrame, version: int) -> DataFrame:
    """target (key, record, type, num, str, vid): each field gets exactly its target's values.

    This is both ``set`` (one value) and ``reconcile`` (several): values that stay are not written again."""
    fields = target.select("key", "record").distinct()
    live = fold(log).join(fields, ["key", "record"], "left_semi")
    away = _from_live(live.join(target.select(*_KEYS), _KEYS, "left_anti"), "REMOVE", version, 0)
    more = _from_live(target.dropDuplicates(_KEYS).join(live.select(*_KEYS), _KEYS, "left_anti"), "ADD", version, 1)
    return away.unionByName(more)


def verify_and_swap(log: DataFrame, key: str, expected: Scalar, record: int, value: Scalar, version: int) -> DataFrame:
    """Two revisions if expected is live, else none."""
    check(key, value, record)
    spark = log.sparkSession
    live = fold(log.filter((F.col("key") == key) & (F.col("record") == record)))
    held = live.filter(F.col("vid") == identity(expected)).select("key", "record").limit(1)
    both = intents(spark, [("REMOVE", key, expected, record), ("ADD", key, value, record)], version)
    return effective(log.filter((F.col("key") == key) & (F.col("record") == record)), both.join(held, ["key", "record"], "left_semi"))


def links_to(sources: DataFrame, key: str, targets: DataFrame, version: int, seq: int = 0) -> DataFrame:
    """An ADD of a link from each source (record, number) to each target (record, number) of its number, but not to itself.

    The number stands for a condition: sources of one condition and what it found meet by it."""
    found = targets.select(F.col("record").alias("to"), "number")
    pairs = sources.select("record", "number").join(found, "number").filter("record <> to")
    return pairs.select(F.lit(version).cast("long").alias("version"), F.lit(seq).cast("long").alias("seq"), F.lit("ADD").alias("action"), F.lit(key).alias("key"), "record", F.lit("LINK").alias("type"), F.col("to").cast("decimal(38,10)").alias("num"), F.concat(F.lit("@"), "to").alias("str"), F.concat(F.lit("l:"), "to").alias("vid"))


def consolidate(log: DataFrame, into: int, others: list[int], version: int) -> DataFrame:
    """Values of others go to ``into``, links to others point to it, others are cleared."""
    live = fold(log)
    gone = F.col("record").isin(*others)
    to_gone = (F.col("type") == "LINK") & F.col("num").isin(*others)
    moved = live.filter(gone | to_gone)
    moved = moved.withColumn("record", F.when(gone, F.lit(into)).otherwise(F.col("record")))
    num = F.when(to_gone, F.lit(into).cast("decimal(38,10)")).otherwise(F.col("num"))
    text = F.when(to_gone, F.lit(f"@{into}")).otherwise(F.col("str"))
    vid = F.when(to_gone, F.lit(f"l:{into}")).otherwise(F.col("vid"))
    moved = moved.select("key", "record", "type", num.alias("num"), text.alias("str"), vid.alias("vid"))
    adds = moved.filter(~((F.col("type") == "LINK") & (F.col("num") == F.col("record"))))
    adds = adds.dropDuplicates(_KEYS).join(live.select(*_KEYS), _KEYS, "left_anti")
    return _from_live(live.filter(gone | to_gone), "REMOVE", version, 0).unionByName(_from_live(adds, "ADD", version, 1))
