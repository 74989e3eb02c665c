"""Language identification by prediction by partial matching.

Of every language a variable-order byte context tree (contexts of up to three bytes, escape method C without exclusion) is
counted over all training texts. A text's code length under a language's frozen tree is the sum of its bytes' code lengths:
at each byte the longest known context predicts it, or an escape is paid and the next shorter context tries, down to a
uniform byte. The language of the shortest code wins; the score is its posterior probability under equal priors.

The tree is a table of nodes, (language, four bytes, count), written to the shared folder; no node and no language is left
out. The counts of shorter contexts are sums of it. A tree of at most ``cells`` (distinct grams times languages) is broadcast
and scored by array look-ups. A larger one stays a table: the distinct grams of the texts get their code lengths by joins with
the nodes and contexts of each order, and each text's sum is a join of its grams with those. Both ways give the same bits.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any training text all are ``und``;
ties go to the first language by name; repeated rows count and are predicted alike; other columns are ignored; a text of
any length is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize
from .textcore import chunks, utf8_of

_CHUNK = 1 << 19
#: Distinct grams times languages of a tree that is broadcast (16 MB of code lengths).
CELLS = 4_000_000
UNDETERMINED = "und"


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with its three before it in the same text, as one number; zero bytes stand before a text."""
    d = data.astype(np.uint32)
    codes = d.copy()
    for k in (1, 2, 3):
        codes[k:] |= d[:-k] << np.uint32(8 * k)
    starts, ends = offsets[:-1], offsets[1:]
    for k in (0, 1, 2):
        at = starts[starts + k < ends] + k
        codes[at] &= np.uint32((1 << (8 * (k + 1))) - 1)
    return codes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text); out: (lang, gram, n), summed as far as memory allows."""
    held: dict[str, list[np.ndarray]] = {}
    total = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, n = np.unique(np.concatenate(parts), return_counts=True)
            for at in range(0, len(grams), 1 << 16):
                g = grams[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n[at : at + (1 << 16)])], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in sorted(set(langs.tolist())):
            texts = batch.column(1).filter(pa.array(langs == lang))
            data, offsets = utf8_of(texts)
            for a, b in chunks(offsets, _CHUNK):
                held.setdefault(lang, []).append(_grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                total += int(offsets[b] - offsets[a])
                if total > 8 << 20:
                    yield from out()
                    total = 0
    yield from out()


class Model:
    """Frozen code lengths, in bits. ``table`` maps known four-byte grams to rows of ``cost``, one column a language."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.languages = languages
        wide = len(languages)
        orders = []  # per order: grams known to some language, counts of each language
        for k in range(4):
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            every = [np.unique(g & mask) for g, _ in counts]
            grams = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
            n = np.zeros((len(grams), wide))
            for j, (g, c) in enumerate(counts):
                np.add.at(n[:, j], np.searchsorted(grams, g & mask), c)
            orders.append((grams, n))
        # from order 0 up: cost of each known gram and escape of each known context
        self.levels = []
        for k, (grams, n) in enumerate(orders):
            context = grams >> np.uint64(8)
            names, of = np.unique(context, return_inverse=True)
            total, kinds = np.zeros((len(names), wide)), np.zeros((len(names), wide))
            np.add.at(total, of, n)
            np.add.at(kinds, of, (n > 0).astype(float))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                direct = -np.log2(n / (total + kinds)[of])
            if k:
                lower = self._lookup(grams & np.uint64((1 << (8 * k)) - 1), k - 1)
            else:
                lower = np.full((len(grams), wide), 8.0)
            cost = np.where(n > 0, direct, escape[of] + lower)
            self.levels.append((grams, cost, names, escape))
        self._freeze()

    def _lookup(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Code lengths of order k, with escapes to shorter contexts where a gram is not known."""
        if k < 0:
            return np.full((len(grams), len(self.languages)), 8.0)
        known, cost, names, escape = self.levels[k]
        out = np.zeros((len(grams), len(self.languages)))
        at = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
        hit = known[at] == grams if len(known) else np.zeros(len(grams), bool)
        out[hit] = cost[at[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            context = grams[miss] >> np.uint64(8)
            c = np.minimum(np.searchsorted(names, context), max(len(names) - 1, 0))
            pay = np.where((names[c] == context)[:, None], escape[c], 0.0) if len(names) else 0.0
            out[miss] = pay + self._lookup(grams[miss] & np.uint64((1 << (8 * k)) - 1), k - 1)
        return out

    def _freeze(self) -> None:
        """An open-addressed table of the longest order: one probe finds most grams."""
        known, cost, _, _ = self.levels[3]
        self.shift = np.uint32(32 - max(int(np.ceil(np.log2(max(len(known), 1) * 2))), 8))
        self.slots = np.full((1 << (32 - int(self.shift)), 1), -1, np.int64).reshape(-1)
        slot = self._slot(known.astype(np.uint32))
        self.slots[slot] = np.arange(len(known))
        self.keys = known.astype(np.uint32)
        self.cost = cost.astype(np.float32)

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((grams ^ (grams >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> self.shift

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of every gram under every language."""
        row = self.slots[self._slot(grams)]
        hit = (row >= 0) & (self.keys[row] == grams) if len(self.keys) else np.zeros(len(grams), bool)
        out = np.empty((len(grams), len(self.languages)), np.float32)
        out[hit] = self.cost[row[hit]]
        rest = np.flatnonzero(~hit)
        if len(rest):
            unique, of = np.unique(grams[rest], return_inverse=True)
            out[rest] = self._lookup(unique.astype(np.uint64), 3)[of]
        return out


class Tree:
    """All nodes (lang, gram, n) of the longest order, and the same as arrays if they are few enough to broadcast."""

    def __init__(self, nodes: DataFrame, languages: list[str], model: Model | None):
        self.nodes, self.languages, self.model = nodes, languages, model


def train(docs: DataFrame, text: Column, lang: Column, cells: int = CELLS) -> Tree:
    """The tree of all rows of docs whose lang is not null, over every language there is."""
    rows = docs.select(lang.alias("lang"), F.lower(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counted = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    nodes = materialize(counted, "language-nodes")
    languages = sorted(r[0] for r in nodes.select("lang").distinct().collect())
    if nodes.select("gram").distinct().count() * len(languages) > cells:
        return Tree(nodes, languages, None)
    held = nodes.select(_number(languages).alias("l"), F.col("gram"), F.col("n")).toArrow()  # at most ``cells`` rows
    of, gram, n = (held.column(c).to_numpy() for c in ("l", "gram", "n"))
    return Tree(nodes, languages, Model(languages, [(gram[of == j].astype(np.uint64), n[of == j].astype(float)) for j in range(len(languages))]))


def _number(languages: list[str]) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1, F.lit(-1)).cast("int") if languages else F.lit(-1)


def _predict(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        for batch in batches:
            data, offsets = utf8_of(batch.column(1))
            letters = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            winner, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for a, b in chunks(offsets, _CHUNK):
                offs = offsets[a : b + 1] - offsets[a]
                total = np.zeros((b - a, len(model.languages)))
                row = np.flatnonzero(np.diff(offs))
                for lo in range(0, int(offs[-1]), _CHUNK) if len(row) and model.languages else []:
                    # a text longer than a chunk is summed piece by piece
                    hi = min(lo + _CHUNK, int(offs[-1]))
                    base = max(lo - 3, 0)
                    grams = _grams(data[offsets[a] + base : offsets[a] + hi], np.unique(np.clip(offs, base, hi)) - base)[lo - base :]
                    cost = model.bits(grams)
                    own = row[(offs[row] < hi) & (offs[row + 1] > lo)]
                    total[own] += np.add.reduceat(cost, np.maximum(offs[own] - lo, 0), axis=0, dtype=np.float64)
                if model.languages:
                    best = total.argmin(axis=1)
                    odds = np.exp2(-(total - total.min(axis=1, keepdims=True)))
                    winner[a:b] = best
                    score[a:b] = 1 / odds.sum(axis=1)
            winner[~letters] = -1
            score[winner < 0] = 0.0
            names = np.array([*model.languages, UNDETERMINED], object)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[winner].tolist(), pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    return run


def _text_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text); out: (key, gram, n) of each whole text."""
    for batch in batches:
        data, offsets = utf8_of(batch.column(1))
        for i in range(batch.num_rows):
            grams, n = np.unique(_grams(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]])), return_counts=True)
            if len(grams):
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], len(grams)), pa.array(grams.astype(np.int64)), pa.array(n)], names=["key", "gram", "n"])


def code_lengths(grams: DataFrame, nodes: DataFrame, languages: list[str]) -> DataFrame:
    """grams (gram) with cost array<float>, one a language, by joins with the nodes and contexts of each order."""
    numbered = nodes.select(_number(languages).alias("l"), "gram", "n")
    out = grams
    for k in (3, 2, 1, 0):
        low = (1 << (8 * (k + 1))) - 1
        own = numbered.groupBy("l", F.col("gram").bitwiseAND(F.lit(low)).alias("g")).agg(F.sum("n").alias("n"))
        contexts = own.groupBy("l", F.shiftright("g", 8).alias("c")).agg(F.sum("n").alias("t"), F.count("*").alias("d"))
        pay = contexts.groupBy("c").agg(F.map_from_entries(F.collect_list(F.struct("l", (-F.log2(F.col("d") / (F.col("t") + F.col("d")))).alias("e")))).alias(f"_e{k}")).withColumnRenamed("c", f"_c{k}")
        direct = own.withColumn("c", F.shiftright("g", 8)).join(contexts, ["l", "c"]).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("l", (-F.log2(F.col("n") / (F.col("t") + F.col("d")))).alias("b")))).alias(f"_d{k}")).withColumnRenamed("g", f"_g{k}")
        if k < 2:  # at most 65,536 grams and 256 contexts, whatever the table's size
            pay, direct = F.broadcast(pay), F.broadcast(direct)
        gram = F.col("gram").bitwiseAND(F.lit(low))
        out = out.join(direct, gram == F.col(f"_g{k}"), "left").join(pay, F.shiftright(gram, 8) == F.col(f"_c{k}"), "left")

    def cost(l: Column) -> Column:
        return reduce(lambda lower, k: F.coalesce(F.col(f"_d{k}")[l], F.coalesce(F.col(f"_e{k}")[l], F.lit(0.0)) + lower), range(4), F.lit(8.0)).cast("float")

    return out.select("gram", F.transform(F.sequence(F.lit(0), F.lit(len(languages) - 1)), cost).alias("cost"))


def _by_join(rows: DataFrame, tree: Tree) -> DataFrame:
    """(row, lang_pred, score) with the nodes as a table. Equal texts are summed once."""
    keyed = rows.withColumn("key", F.md5(F.coalesce("text", F.lit(""))))
    texts = keyed.filter("text <> ''").select("key", "text").mapInArrow(_text_grams, "key string, gram long, n long")
    pairs = materialize(texts.groupBy("key", "gram").agg(F.max("n").alias("n")), "language-grams")
    costs = materialize(code_lengths(pairs.select("gram").distinct(), tree.nodes, tree.languages), "language-costs")
    counted = pairs.groupBy("gram").agg(F.count("*").alias("_rows")).join(costs, "gram")
    each = hot_join(pairs, counted, "gram", "_rows", F.xxhash64("key"))
    sums = each.groupBy("key").agg(F.array(*[F.sum(F.col("n") * F.col("cost")[j].cast("double")) for j in range(len(tree.languages))]).alias("bits"))
    names = F.array(*map(F.lit, tree.languages))
    odds = F.aggregate(F.col("bits"), F.lit(0.0), lambda a, b: a + F.pow(F.lit(2.0), F.array_min("bits") - b))
    best = sums.select("key", F.get(names, F.array_position("bits", F.array_min("bits")).cast("int") - 1).alias("best"), (1 / odds).alias("own"))
    said = F.col("letters") & F.col("best").isNotNull()
    known = best.join(keyed.groupBy("key").agg(F.count("*").alias("_rows")), "key")
    whole = hot_join(keyed.select("row", "key", "letters"), known, "key", "_rows", F.xxhash64("row"))
    return whole.select("row", F.when(said, F.col("best")).otherwise(UNDETERMINED).alias("lang_pred"), F.when(said, F.col("own")).otherwise(0.0).alias("score"))


def predict(docs: DataFrame, tree: Tree, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) from the texts alone."""
    rows = docs.select(F.col(doc_id).cast("long").alias("row"), F.lower(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if tree.model is None:
        out = _by_join(rows, tree)
    else:
        out = rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(tree.model)), "row long, lang_pred string, score double")
    return out.withColumnRenamed("row", doc_id)
