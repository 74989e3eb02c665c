"""Infix phrase search: consecutive tokens, each needle token within the aligned text token, regardless of case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def _ends(text: Column, needle: str) -> Column | None:
    """Positions at which the needle's tokens stand; null if the needle has no token."""
    words = needle.lower().split()
    if not words:
        return None
    hay = tokens(text)

    def at(h: Column) -> Column:
        fits = lambda i: _all([F.contains(F.get(h, i + j), F.lit(w)) for j, w in enumerate(words)])
        return F.when(F.size(h) >= len(words), F.filter(F.sequence(F.lit(0), F.size(h) - len(words)), fits)).otherwise(F.array().cast("array<int>"))

    return F.get(F.transform(F.array(hay), at), F.lit(0))


def _all(cs: list[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out & c
    return out


def condition(text: Column, needle: str) -> Column:
    words = str(needle).lower().split()
    if not words:
        return F.lit(False)
    rough = _all([F.contains(F.lower(text), F.lit(w)) for w in words])  # cheap, and all there is for one token
    return rough if len(words) == 1 else rough & (F.size(_ends(text, needle)) > 0)


def matching(t: DataFrame, needle: str) -> DataFrame:
    return t.filter((F.col("type") == "STRING") & condition(F.col("str"), needle))


def ranked(t: DataFrame, needle: str) -> DataFrame:
    """(record, matches): records by the number of places that match."""
    places = _ends(F.col("str"), str(needle))
    if places is None:
        return t.limit(0).select("record", F.lit(0).cast("long").alias("matches"))
    hits = matching(t, needle).select("record", F.size(places).cast("long").alias("matches"))
    return hits.groupBy("record").agg(F.sum("matches").alias("matches"))
