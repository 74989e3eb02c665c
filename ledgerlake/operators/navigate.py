"""Link navigation: a chain of joins over LINK triples, distinct after each hop; prefixes that paths share are built once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hop(store, frontier: DataFrame, key: str, at: int | None) -> DataFrame:
    """frontier (record, end) along the links of key."""
    links = store.triples([key], at).filter("type = 'LINK'").select(F.col("record").alias("_from"), F.col("num").cast("long").alias("_to"))
    moved = frontier.join(links, F.col("end") == F.col("_from")).select("record", F.col("_to").alias("end"))
    return moved if store.unique(key) else moved.distinct()


def walk(store, keys: list[str], at: int | None, starts: DataFrame | None = None) -> DataFrame:
    """(record, end): each start and the records that the keys lead to."""
    if starts is not None:
        frontier = starts.select("record", F.col("record").alias("end"))
    else:
        first = store.triples([keys[0]], at).filter("type = 'LINK'").select("record", F.col("num").cast("long").alias("end"))
        frontier, keys = first if store.unique(keys[0]) else first.distinct(), keys[1:]
    for key in keys:
        frontier = hop(store, frontier, key, at)
    return frontier


def path_triples(store, path: str, at: int | None, starts: DataFrame | None = None, want_end: bool = False) -> DataFrame:
    """Triples of the last stop with the start as record; want_end: (record, end) of a path of links only."""
    stops = path.split(".")
    if want_end:
        return walk(store, stops, at, starts)
    ends = walk(store, stops[:-1], at, starts)
    last = store.triples([stops[-1]], at).withColumnRenamed("record", "_end")
    found = ends.join(last, F.col("end") == F.col("_end")).drop("_end")
    return found.select(F.lit(path).alias("key"), "record", "end", "type", "rank", "num", "str", "vid", "added_at")


def key_triples(store, key: str, at: int | None = None, starts: DataFrame | None = None) -> DataFrame:
    """Triples of a plain key, or of a path with its start as record: each value of a record once."""
    if "." not in key:
        t = store.triples([key], at)
        return t if starts is None else t.join(starts.select("record"), "record", "left_semi")
    return path_triples(store, key, at, starts).dropDuplicates(["record", "vid"])


def many_paths(store, paths: list[str], at: int | None, starts: DataFrame) -> dict[str, DataFrame]:
    """Of each path its triples; a trie of stops makes every shared prefix one DataFrame (and one exchange)."""
    nodes: dict[tuple[str, ...], DataFrame] = {(): starts.select("record", F.col("record").alias("end"))}

    def node(prefix: tuple[str, ...]) -> DataFrame:
        if prefix not in nodes:
            nodes[prefix] = hop(store, node(prefix[:-1]), prefix[-1], at)
        return nodes[prefix]

    out = {}
    for path in paths:
        stops = tuple(path.split("."))
        last = store.triples([stops[-1]], at).withColumnRenamed("record", "_end")
        out[path] = node(stops[:-1]).join(last, F.col("end") == F.col("_end")).select(F.lit(path).alias("key"), "record", "end", "type", "rank", "num", "str", "vid", "added_at").dropDuplicates(["record", "vid"])
    return out


def navigate(store, path: str, starts: DataFrame, at: int | None = None) -> DataFrame:
    """Values of the last stop by destination record: (record, str, type, num)."""
    t = path_triples(store, path, at, starts)
    return t.select(F.col("end").alias("record"), "str", "type", "num", "vid", "added_at").dropDuplicates(["record", "vid"])


def trace(store, targets: DataFrame | None = None, keys: list[str] | None = None, at: int | None = None, skip_self: bool = False) -> DataFrame:
    """Incoming links: (record, key, source)."""
    edges = store.triples(keys, at).filter("type = 'LINK'").select(F.col("num").cast("long").alias("record"), "key", F.col("record").alias("source"))
    if targets is not None:
        edges = edges.join(targets.select("record").distinct(), "record", "left_semi")
    return edges.filter("source <> record") if skip_self else edges
