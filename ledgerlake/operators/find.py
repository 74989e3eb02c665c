"""Conditions to sets of records.

A leaf is a filter on the triples of one key. Leaves of one time on plain keys under one tree are folded together: one scan and
one aggregation by record decide all of them, exactly as separate sets would, since each leaf is judged value by value.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import Call, Link, Triple
from ..plans.ccl import ID, And, Leaf, Or, key_class
from . import calc, search
from .navigate import key_triples, path_triples


class Finder:
    def __init__(self, store):
        self.store = store

    def find(self, tree) -> DataFrame:
        """(record), distinct."""
        if tree is None:
            return self.store.inventory()
        return self._fused(tree) if self._can_fuse(tree) else self._visit(tree)

    def _visit(self, tree) -> DataFrame:
        if isinstance(tree, Leaf):
            return self.leaf(tree)
        if self._can_fuse(tree):
            return self._fused(tree)
        left, right = self._visit(tree.left), self._visit(tree.right)
        return left.join(right, "record", "left_semi") if isinstance(tree, And) else left.unionByName(right).distinct()

    def _leaves(self, tree) -> list[Leaf]:
        return [tree] if isinstance(tree, Leaf) else [*self._leaves(tree.left), *self._leaves(tree.right)]

    def _can_fuse(self, tree) -> bool:
        leaves = self._leaves(tree)
        plain = all(key_class(x.key) == "writable" and x.operator not in ("CONTAINS", "NOT_CONTAINS") and not any(isinstance(v, Call) for v in x.values) for x in leaves)
        return plain and len(leaves) > 1 and len({x.at for x in leaves}) == 1

    def _fused(self, tree) -> DataFrame:
        leaves = self._leaves(tree)
        keys = list(dict.fromkeys(x.key for x in leaves))
        wide = self.store.wide(keys, leaves[0].at)
        if wide is not None:  # one value a record: the tree is a plain condition on the row, and reaches the scan
            return wide.filter(self._on_row(tree, {k: Triple(f"{i}_") for i, k in enumerate(keys)})).select("record")
        t, triple = self.store.triples(keys, leaves[0].at), Triple()
        conditions = [(F.col("key") == x.key) & triple.compare(x.operator, list(x.values)) for x in leaves]
        any_of = conditions[0]
        for c in conditions[1:]:
            any_of = any_of | c
        marks = t.filter(any_of).groupBy("record").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(f"_{i}") for i, c in enumerate(conditions)])
        number = iter(range(len(leaves)))

        def verdict(node) -> Column:
            if isinstance(node, Leaf):
                return F.col(f"_{next(number)}")
            left, right = verdict(node.left), verdict(node.right)
            return left & right if isinstance(node, And) else left | right

        return marks.filter(verdict(tree)).select("record")

    def _on_row(self, node, triples: dict[str, Triple]) -> Column:
        if isinstance(node, Leaf):
            return triples[node.key].compare(node.operator, list(node.values))
        left, right = self._on_row(node.left, triples), self._on_row(node.right, triples)
        return left & right if isinstance(node, And) else left | right

    def leaf(self, leaf: Leaf) -> DataFrame:
        kind = key_class(leaf.key)
        if kind == "identifier":
            return self._identifier(leaf)
        if kind == "function":
            key, name = (x.strip() for x in leaf.key.split("|"))
            value = calc.by_record(key_triples(self.store, key, leaf.at), name)
            number = value.select("record", F.lit(0).alias("rank"), F.col("value").alias("num"), F.col("value").cast("string").alias("str"), F.lit("DOUBLE").alias("type"))
            return self._compare(number, leaf, unique=True)
        if kind == "navigation":
            t = path_triples(self.store, leaf.key, leaf.at)
            if leaf.operator == "NOT_CONTAINS" and leaf.at is None:
                # the rule of a plain key, at the last stop: a destination without the key counts
                stops = leaf.key.split(".")
                found = search.matching(self.store.triples([stops[-1]]), leaf.values[0]).select("record").distinct()
                ends = self.store.inventory().join(found, "record", "left_anti")
                starts = path_triples(self.store, ".".join(stops[:-1]), None, want_end=True)
                return starts.join(ends.withColumnRenamed("record", "end"), "end", "left_semi").select("record").distinct()
            return self._compare(t, leaf)
        if leaf.operator in ("LINKS_TO", "EQUALS") and (leaf.operator == "LINKS_TO" or isinstance(leaf.values[0], Link)):
            v = leaf.values[0]
            t = self.store.linked(leaf.key, v.record if isinstance(v, Link) else int(v))
            if t is not None:
                return t.select("record") if self.store.unique(leaf.key) else t.select("record").distinct()
        t = self.store.triples([leaf.key], leaf.at)
        if leaf.operator == "NOT_CONTAINS" and leaf.at is None:
            return self.store.inventory().join(search.matching(t, leaf.values[0]).select("record").distinct(), "record", "left_anti")
        return self._compare(t, leaf, self.store.unique(leaf.key))

    def _compare(self, t: DataFrame, leaf: Leaf, unique: bool = False) -> DataFrame:
        if leaf.operator in ("CONTAINS", "NOT_CONTAINS"):
            hit = search.condition(F.col("str"), leaf.values[0]) & (F.col("type") == "STRING")
            found = t.filter(hit if leaf.operator == "CONTAINS" else ~hit)
        elif any(isinstance(v, Call) for v in leaf.values):
            # one row of scalars, joined to every triple; an empty calculation is null and matches nothing
            scalars = None
            for i, v in enumerate(leaf.values):
                one = self.scalar(v if isinstance(v, Call) else None, v).withColumnRenamed("value", f"_v{i}")
                scalars = one if scalars is None else scalars.crossJoin(one)
            both = t.crossJoin(F.broadcast(scalars))
            found = both.filter(_against(leaf.operator, [F.col(f"_v{i}") for i in range(len(leaf.values))]))
        else:
            found = t.filter(Triple().compare(leaf.operator, list(leaf.values)))
        rows = found.select("record")
        return rows if unique else rows.distinct()

    def scalar(self, call: Call | None, value) -> DataFrame:
        """One row (value)."""
        if call is None:
            return self.store.inventory().agg(F.lit(value).alias("value"))
        t = key_triples(self.store, call.key, call.at)
        if call.records:
            t = t.filter(F.col("record").isin(*call.records))
        if call.condition is not None:
            t = t.join(self.find(call.condition), "record", "left_semi")
        return calc.over(t, call.name, records=bool(call.records) or call.condition is not None)

    def _identifier(self, leaf: Leaf) -> DataFrame:
        ids = [v.record if isinstance(v, Link) else int(v) for v in leaf.values]
        if leaf.operator == "EQUALS":  # the ids as they are listed, written or not
            spark = self.store.inventory().sparkSession
            return spark.createDataFrame(pa.table({"record": pa.array(sorted(set(ids)), pa.int64())}))
        if leaf.operator == "NOT_EQUALS":
            return self.store.inventory().filter(~F.col("record").isin(*ids))
        raise ValueError(f"{ID} knows = and != only")


def _against(op: str, values: list[Column]) -> Column:
    num, v = F.when(F.col("rank") == 0, F.col("num")), values[0]
    other = F.col("rank") > 0
    return {
        "EQUALS": lambda: num == v,
        "NOT_EQUALS": lambda: v.isNotNull() & (other | (num != v)),
        "GREATER_THAN": lambda: v.isNotNull() & (other | (num > v)),
        "GREATER_THAN_OR_EQUALS": lambda: v.isNotNull() & (other | (num >= v)),
        "LESS_THAN": lambda: num < v,
        "LESS_THAN_OR_EQUALS": lambda: num <= v,
        "BETWEEN": lambda: (num >= v) & (num < values[-1]),
    }[op]()
