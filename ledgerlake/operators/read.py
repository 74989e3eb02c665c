"""Projections of triples: flat rows (record, key, value ...), one per value; ``wide`` turns them into columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import Scalar, identity
from ..plans.ccl import key_class
from ..sources.log import text_of
from .navigate import many_paths

_FIELDS = ["record", "key", "type", "num", "str", "vid", "added_at"]


def project(store, keys: list[str] | None, records: DataFrame | None, at: int | None = None) -> DataFrame:
    """All live values of keys (or of every key) of records (or of all); keys may navigate."""
    plain = None if keys is None else [k for k in keys if key_class(k) != "navigation"]
    paths = [] if keys is None else [k for k in keys if key_class(k) == "navigation"]
    parts = []
    if plain is None or plain:
        t = store.triples(plain, at)
        parts.append((t if records is None else t.join(records.select("record"), "record", "left_semi")).select(*_FIELDS))
    if paths:
        starts = store.inventory() if records is None else records.select("record")
        parts += [t.select(*_FIELDS) for t in many_paths(store, paths, at, starts).values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.withColumn("num", F.col("num").cast("string")).unionByName(p.withColumn("num", F.col("num").cast("string")))
    return out


def latest(t: DataFrame) -> DataFrame:
    """The last added value of each (record, key)."""
    last = F.max_by(F.struct("type", "num", "str", "vid", "added_at"), F.struct("added_at", "vid"))
    return t.groupBy("record", "key").agg(last.alias("v")).select("record", "key", "v.*")


def wide(t: DataFrame, keys: list[str], records: DataFrame | None = None, single: bool = False) -> DataFrame:
    """(record, one column per key): arrays of string forms in order of addition, empty where a record has none; single: the
    last value or null. Records that are asked for appear even if they have nothing."""
    def column(k: str) -> Column:
        mine = F.when(F.col("key") == k, F.struct("added_at", "vid", "str"))
        if single:
            return F.max(mine)["str"].alias(k)
        return F.transform(F.array_sort(F.collect_set(mine)), lambda s: s["str"]).alias(k)

    out = t.groupBy("record").agg(*[column(k) for k in keys])
    if records is not None and not single:
        out = records.select("record").distinct().join(out, "record", "left").select("record", *[F.coalesce(F.col(f"`{k}`"), F.array().cast("array<string>")).alias(k) for k in keys])
    return out


def browse(store, keys: str | list[str], at: int | None = None) -> DataFrame:
    """(key, vid, str, rank, num, record): the inverted index of keys, one row per key, value and record; keys may navigate."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    columns = ["key", "vid", "str", "rank", "num", "record"]
    plain, paths = [k for k in keys if key_class(k) != "navigation"], [k for k in keys if key_class(k) == "navigation"]
    parts = [store.triples(plain, at).select(*columns)] if plain else []
    parts += [t.select(*columns).distinct() for t in many_paths(store, paths, at, store.inventory()).values()] if paths else []
    out = parts[0]
    for p in parts[1:]:
        out = out.withColumn("num", F.col("num").cast("string")).unionByName(p.withColumn("num", F.col("num").cast("string")))
    return out


def browse_counts(store, keys: str | list[str], at: int | None = None) -> DataFrame:
    """(key, str, records): values of keys with the number of their records."""
    return browse(store, keys, at).groupBy("key", "vid").agg(F.count("*").alias("records")).select("key", text_of(F.col("vid")).alias("str"), "records")


def describe(store, records: DataFrame | None = None, at: int | None = None) -> DataFrame:
    """(record, key): keys that have a live value."""
    t = store.triples(None, at)
    if records is not None:
        t = t.join(records.select("record"), "record", "left_semi")
    return t.select("record", "key").distinct()


def invert(t: DataFrame) -> DataFrame:
    """(key, str, record): the inverted view of a result, a row for each record of a value, so that a common value makes no large
    row; a record stands once with each value."""
    return t.select("key", "vid", "record").distinct().select("key", text_of(F.col("vid")).alias("str"), "record")


def verify(store, key: str, value: Scalar, record: int, at: int | None = None) -> bool:
    return bool(store.triples([key], at).filter((F.col("record") == record) & (F.col("vid") == identity(value))).limit(1).count())


def ping(store, records: DataFrame, at: int | None = None) -> DataFrame:
    """(record, live): whether a record has any live value."""
    live = store.triples(None, at).join(records.select("record"), "record", "left_semi").select("record", F.lit(True).alias("live")).distinct()
    return records.select("record").distinct().join(live, "record", "left").select("record", F.coalesce("live", F.lit(False)).alias("live"))


def jsonify(store, records: DataFrame, at: int | None = None, include_id: bool = False) -> DataFrame:
    """(record, json): one object per record; several values are an array, numbers are bare, links and tags keep their marks."""
    t = project(store, None, records, at)
    text = F.when(F.col("type") == "TAG", F.concat(F.lit("`"), F.col("str"), F.lit("`"))).when(F.col("type") == "TIMESTAMP", F.concat(F.lit("|"), F.col("str"), F.lit("|"))).otherwise(F.col("str"))
    quoted = F.get(F.transform(F.array(F.to_json(F.struct(text.alias("v")))), lambda j: F.substr(j, F.lit(6), F.length(j) - 6)), F.lit(0))
    shown = F.when(F.col("type").isin("INTEGER", "LONG", "FLOAT", "DOUBLE", "BOOLEAN"), F.col("str")).otherwise(quoted)
    fields = t.withColumn("j", shown).groupBy("record", "key").agg(F.array_sort(F.collect_list(F.struct("added_at", "vid", "j"))).alias("vs"))
    one = F.when(F.size("vs") == 1, F.get("vs", F.lit(0))["j"]).otherwise(F.concat(F.lit("["), F.array_join(F.transform("vs", lambda v: v["j"]), ","), F.lit("]")))
    pair = F.concat(F.lit('"'), F.col("key"), F.lit('":'), one)
    body = fields.groupBy("record").agg(F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("b"))
    first = F.concat(F.lit('"$id$":'), F.col("record").cast("string"), F.lit(",")) if include_id else F.lit("")
    return body.select("record", F.concat(F.lit("{"), first, F.col("b"), F.lit("}")).alias("json"))


def json_array(objects: DataFrame) -> DataFrame:
    """(json): all objects of jsonify as one array, by record; no record is an empty array. One text by its nature: for results
    that a reader holds at once; ``jsonify`` has a row for each record."""
    every = objects.agg(F.array_sort(F.collect_list(F.struct("record", "json"))).alias("os"))
    return every.select(F.concat(F.lit("["), F.array_join(F.transform("os", lambda o: o["json"]), ","), F.lit("]")).alias("json"))


def pretty(t: DataFrame, keys: list[str], most: int = 100) -> str:
    """A result as text with a frame, for people: at most ``most`` records, and a last line that tells of more."""
    rows = wide(t, keys).orderBy("record").limit(most + 1).collect()
    cells = [["record", *keys], *([str(r["record"]), *(", ".join(r[k]) for k in keys)] for r in rows[:most])]
    width = [max(len(line[i]) for line in cells) for i in range(len(cells[0]))]
    line = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    shown = ["| " + " | ".join(c.ljust(w) for c, w in zip(row, width, strict=True)) + " |" for row in cells]
    return "\n".join([line, shown[0], line, *shown[1:], line, *["..."] * (len(rows) > most)])
