"""The revision log and its folds, and wide tables read as if they had been written to it.

revisions(version, seq, action, key, record, type, num, str, vid): one row per ADD or REMOVE of a value. Everything else is
a fold over it. A store answers with triples(key, record, type, rank, num, str, vid, added_at) live at a time.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import LINK, NUMBER, OTHER

NUM = "decimal(38,10)"
REVISIONS = f"version long, seq long, action string, key string, record long, type string, num {NUM}, str string, vid string"
COLUMNS = ["version", "seq", "action", "key", "record", "type", "num", "str", "vid"]
TRIPLES = ["key", "record", "type", "rank", "num", "str", "vid", "added_at"]


def rank(type_: Column) -> Column:
    return F.when(type_.isin("INTEGER", "LONG", "FLOAT", "DOUBLE"), NUMBER).when(type_ == "LINK", LINK).otherwise(OTHER)


_WHOLE = ("int", "bigint", "smallint", "tinyint", "long")


def is_number(kind: str) -> bool:
    return kind in (*_WHOLE, "double", "float") or kind.startswith("decimal")


def encoded(column: Column, kind: str) -> list[Column]:
    """type, num, str and vid of a typed column; kind is a Spark type name, or LINK or TAG."""
    if kind == "LINK":
        n = column.cast("long")
        return [F.lit("LINK").alias("type"), n.cast(NUM).alias("num"), F.concat(F.lit("@"), n).alias("str"), F.concat(F.lit("l:"), n).alias("vid")]
    if is_number(kind):
        whole = kind in _WHOLE
        # a float counts by its decimal text, and a number beyond the exact range keeps a null num and its text
        num = column.cast(NUM) if whole else column.cast("string").try_cast(NUM)
        text = column.cast("string") if whole else F.regexp_replace(F.coalesce(F.format_string("%s", num.cast("string")), column.cast("string")), r"(\.[0-9]*?)0+$", "$1")
        text = text if whole else F.regexp_replace(text, r"\.$", "")
        name = "LONG" if kind in ("bigint", "long") else "INTEGER" if whole else "FLOAT" if kind == "float" else "DOUBLE"
        return [F.lit(name).alias("type"), num.alias("num"), text.alias("str"), F.concat(F.lit("n:"), text).alias("vid")]
    none = F.lit(None).cast(NUM).alias("num")
    if kind == "boolean":
        return [F.lit("BOOLEAN").alias("type"), none, column.cast("string").alias("str"), F.concat(F.lit("b:"), column.cast("string")).alias("vid")]
    if kind.startswith("timestamp") or kind == "date":
        text = F.date_format(column.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return [F.lit("TIMESTAMP").alias("type"), none, text.alias("str"), F.concat(F.lit("t:"), text).alias("vid")]
    text = column.cast("string")
    return [F.lit("TAG" if kind == "TAG" else "STRING").alias("type"), none, text.alias("str"), F.concat(F.lit("s:"), text).alias("vid")]


def micros_of(column: Column) -> Column:
    """Micros since the epoch of a timestamp_ntz, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), column)


_TYPES = ["STRING", "TAG", "LINK", "BOOLEAN", "INTEGER", "LONG", "FLOAT", "DOUBLE", "TIMESTAMP"]
_STEP = "10000000000000000000"


def moment() -> Column:
    """(version, seq, type, action) of a revision as one decimal that orders as they do.

    A decimal fits the buffers of hash aggregation, which a struct or a text does not, so the last action of a value is found
    without sorting."""
    code = F.coalesce(F.array_position(F.array(*map(F.lit, _TYPES)), F.col("type")), F.lit(0)).cast("decimal(20,0)")
    low = F.col("seq").cast("decimal(20,0)") * 32 + code * 2 + F.when(F.col("action") == "ADD", 1).otherwise(0)
    return (F.col("version").cast("decimal(38,0)") * F.lit(_STEP).cast("decimal(20,0)") + low).cast("decimal(38,0)")


def is_add(m: str) -> Column:
    return F.expr(f"pmod({m}, 2) = 1")


def text_of(vid: Column) -> Column:
    """The string form that an identity holds."""
    tail = F.substr(vid, F.lit(3))
    return F.when(vid.startswith("l:"), F.concat(F.lit("@"), tail)).otherwise(tail)


def num_of(vid: Column) -> Column:
    return F.when(vid.startswith("n:") | vid.startswith("l:"), F.substr(vid, F.lit(3)).try_cast(NUM))


def fold(revisions: DataFrame, at: int | None = None) -> DataFrame:
    """Triples live at a time: of each (key, record, value) the last action, if that is ADD.

    One hash aggregation with partial maxima; the shuffle holds the identity and one decimal a value, and all else is read
    from those."""
    seen = revisions if at is None else revisions.filter(F.col("version") <= at)
    live = seen.withColumn("m", moment()).groupBy("key", "record", "vid").agg(F.max("m").alias("m")).filter(is_add("m"))
    parts = live.withColumn("_v", F.expr(f"m div {_STEP}BD")).withColumn("_low", F.expr(f"m - CAST(_v AS DECIMAL(38, 0)) * {_STEP}BD"))
    type_ = F.get(F.array(*map(F.lit, _TYPES)), F.expr("CAST(pmod(_low, 32) AS INT) div 2").cast("int") - 1)
    typed = parts.select("key", "record", type_.alias("type"), num_of(F.col("vid")).alias("num"), text_of(F.col("vid")).alias("str"), "vid", F.struct(F.col("_v").alias("version"), F.expr("_low div 32").alias("seq")).alias("added_at"))
    return typed.select("key", "record", "type", rank(F.col("type")).alias("rank"), "num", "str", "vid", "added_at")


def changes(rows: DataFrame) -> DataFrame:
    """A raw log without what a writer refuses: an ADD of a live value, a REMOVE of one that is not live."""
    from pyspark.sql import Window

    before = F.lag("action").over(Window.partitionBy("key", "record", "vid").orderBy("version", "seq"))
    return rows.withColumn("_b", F.coalesce(before, F.lit("REMOVE"))).filter("_b <> action").drop("_b")


class LogStore:
    """A store over a revisions table.

    With a snapshot, ``live`` has the triples live at version ``since`` as ADDs, and ``tail`` the revisions after it (None: there
    are none): reads of that time or a later one fold the two, or read the snapshot alone, instead of the whole history."""

    def __init__(self, revisions: DataFrame, live: DataFrame | None = None, tail: DataFrame | None = None, since: int = 0):
        self.log, self.live, self.tail, self.since = revisions, live, tail, since

    def plus(self, more: DataFrame) -> LogStore:
        """This store with revisions that are newer than all it has."""
        tail = more if self.tail is None else self.tail.unionByName(more)
        return LogStore(self.log.unionByName(more), self.live, tail if self.live is not None else None, self.since)

    def revisions(self, keys: Iterable[str] | None = None) -> DataFrame:
        return _of(self.log, keys)

    def now(self, keys: Iterable[str] | None = None) -> DataFrame:
        """Revisions whose fold is that of the whole history, now: those of the snapshot and its tail, if there is one."""
        if self.live is None:
            return self.revisions(keys)
        return _of(self.live if self.tail is None else self.live.unionByName(self.tail), keys)

    def triples(self, keys: Iterable[str] | None = None, at: int | None = None) -> DataFrame:
        if self.live is None or (at is not None and at < self.since):
            return fold(self.revisions(keys), at)
        if self.tail is None:
            return _of(self.live, keys).select("key", "record", "type", rank(F.col("type")).alias("rank"), "num", "str", "vid", F.struct("version", "seq").alias("added_at"))
        return fold(self.now(keys), at)

    def wide(self, keys: Iterable[str], at: int | None) -> DataFrame | None:
        return None

    def linked(self, key: str, target: int) -> DataFrame | None:
        return None

    def inventory(self) -> DataFrame:
        """Every record ever written; one that was emptied stays."""
        return self.log.select("record").distinct()

    def unique(self, key: str) -> bool:
        return False


def _of(revisions: DataFrame, keys: Iterable[str] | None) -> DataFrame:
    return revisions if keys is None else revisions.filter(F.col("key").isin(*keys))


def snapshot(revisions: DataFrame) -> DataFrame:
    """What is live after all revisions, as ADDs of the version that added it."""
    return fold(revisions).select("added_at.version", "added_at.seq", F.lit("ADD").alias("action"), "key", "record", "type", "num", "str", "vid").select(*COLUMNS)


class Table:
    """A wide table as a source of triples: one value per key and record. ``links`` names the table that a column points to."""

    def __init__(self, df: DataFrame, number: int, pk: str | None, links: dict[str, int] | None = None, tags: Iterable[str] = ()):
        self.df, self.number, self.pk, self.links, self.tags = df, number, pk, links or {}, set(tags)

    def record(self) -> Column:
        base = F.lit(self.number << 40)
        return base + (F.col(self.pk).cast("long") if self.pk else F.col("_metadata.row_index"))

    def columns(self, column: str) -> dict[str, Column]:
        kind = "LINK" if column in self.links else "TAG" if column in self.tags else dict(self.df.dtypes)[column]
        value = F.col(column)
        if kind == "LINK":
            value = F.lit(self.links[column] << 40) + value.cast("long")
        typed = {c: e for c, e in zip(("type", "num", "str", "vid"), encoded(value, kind), strict=True)}
        r = LINK if kind == "LINK" else NUMBER if is_number(kind) else OTHER
        # numbers keep their own type, so that comparisons with literals reach the scan
        num = value if r != OTHER else F.lit(None).cast("double")
        zero = F.struct(F.lit(0).cast("long").alias("version"), F.lit(0).cast("long").alias("seq"))
        return {"type": typed["type"], "rank": F.lit(r), "num": num, "str": typed["str"], "vid": typed["vid"], "added_at": zero}

    def triples(self, column: str) -> DataFrame:
        own = [c.alias(n) for n, c in self.columns(column).items()]
        return self.df.filter(F.col(column).isNotNull()).select(F.lit(column).alias("key"), self.record().alias("record"), *own)


class TableStore:
    """Several wide tables, each with its own columns as keys, present only (reads at a time see all of it)."""

    def __init__(self, tables: Iterable[Table]):
        self.of = {c: t for t in tables for c in t.df.columns}

    def triples(self, keys: Iterable[str] | None = None, at: int | None = None) -> DataFrame:
        parts = [self.of[k].triples(k) for k in (self.of if keys is None else keys) if k in self.of]
        if not parts:
            raise KeyError(f"no such key: {list(keys or [])}")
        if len({p.schema["num"].dataType.simpleString() for p in parts}) > 1:
            parts = [p.withColumn("num", F.col("num").cast("string").try_cast(NUM)) for p in parts]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def inventory(self) -> DataFrame:
        tables = list(dict.fromkeys(self.of.values()))
        out = None
        for t in tables:
            own = t.df.select(t.record().alias("record"))
            own = own if t.pk else own.distinct()  # ids of tables do not overlap
            out = own if out is None else out.unionByName(own)
        return out

    def wide(self, keys: Iterable[str], at: int | None) -> DataFrame | None:
        """If all keys are columns of one table with a primary key: a row per record, (record, <i>_rank, <i>_num, ...)."""
        keys = list(keys)
        tables = {id(self.of[k]): self.of[k] for k in keys if k in self.of}
        if len(tables) != 1 or not all(k in self.of for k in keys):
            return None
        table = next(iter(tables.values()))
        if not table.pk:
            return None
        own = [c.alias(f"{i}_{n}") for i, k in enumerate(keys) for n, c in table.columns(k).items() if n in ("rank", "num", "str", "type")]
        return table.df.select(table.record().alias("record"), *own)

    def linked(self, key: str, target: int) -> DataFrame | None:
        """Triples of a link column with one target, as a plain comparison of the column."""
        table = self.of.get(key)
        if table is None or key not in table.links:
            return None
        return Table(table.df.filter(F.col(key) == target - (table.links[key] << 40)), table.number, table.pk, table.links, table.tags).triples(key)

    def unique(self, key: str) -> bool:
        """Whether a record has one value of the key at most, so that no distinct is needed."""
        return key in self.of and self.of[key].pk is not None

    def revisions(self, keys: Iterable[str] | None = None) -> DataFrame:
        """The rows as ADDs of version 0."""
        t = self.triples(keys)
        return t.select(F.lit(0).cast("long").alias("version"), F.lit(0).cast("long").alias("seq"), F.lit("ADD").alias("action"), "key", "record", "type", F.col("num").cast("string").try_cast(NUM).alias("num"), "str", "vid")


def shred(df: DataFrame, record: Column, version: Column, columns: dict[str, str] | None = None, seq: Column | None = None) -> DataFrame:
    """A wide table as ADD revisions: nulls and blank texts are left out, arrays are several values. columns: name to kind."""
    kinds = columns or {f.name: f.dataType for f in df.schema.fields}
    out = None
    for name, kind in kinds.items():
        value = F.col(name)
        if isinstance(kind, T.ArrayType):
            part = df.select(record.alias("record"), version.alias("version"), (seq if seq is not None else F.lit(0)).cast("long").alias("seq"), F.explode(name).alias("_v"))
            kind, value = kind.elementType, F.col("_v")
        else:
            part = df.select(record.alias("record"), version.alias("version"), (seq if seq is not None else F.lit(0)).cast("long").alias("seq"), value.alias("_v"))
            value = F.col("_v")
        kind = kind if isinstance(kind, str) else kind.simpleString()
        keep = value.isNotNull() & (F.trim(value) != "" if kind in ("string", "TAG") else F.lit(True))
        rows = part.filter(keep).select("version", "seq", F.lit("ADD").alias("action"), F.lit(name).alias("key"), "record", *encoded(value, kind))
        out = rows if out is None else out.unionByName(rows)
    return out.select(*COLUMNS)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REVISIONS)
