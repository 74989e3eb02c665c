"""Toxicity by classifier chains.

Categories are predicted one after the other by linear (logistic) models over words; the model of a category also reads the
probabilities of the categories before it. While training, those come out of fold: a row's earlier probabilities are
predicted by models that have not seen the row, so that later models learn from what they will meet when scoring.

Models are fitted on labelled documents in the order of a hash of their id, at most ``train_rows`` of them and at most
``train_bytes`` of distinct words (documented bounds of the sample), over at most ``words`` words that stand in at least
``least_docs`` of them, by how far a category's odds differ with the word. Every document is scored, over its whole text.

Defined results: a null text has no words; documents without a label are scored, not trained on; rows that repeat a document
id or its labels count as they stand; a category with one class only (or no labelled row) is predicted at its base rate;
an empty table gives an empty result; other columns are ignored; a text of any length is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TRAIN_ROWS, TRAIN_BYTES, WORDS, LEAST_DOCS, FOLDS = 12_000, 64 << 20, 2_000, 5, 3
#: Beginnings of words are features too, as inflected forms of one word share them.
PREFIXES = (5, 6, 7, 8)
_CACHE = 200_000


def words_of(text: Column) -> Column:
    """The distinct words of a text: runs of letters and digits, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def _features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


class Linear:
    """A logistic model over words and the probabilities of earlier categories."""

    def __init__(self, words: list[str], weights: np.ndarray, extra: np.ndarray, bias: float):
        self.words, self.weights, self.extra, self.bias = words, weights, extra, bias


def _fit(columns: list[np.ndarray], extra: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression with a ridge; columns: of each word the rows that have it. Accelerated gradient descent with restarts and
    a step from the curvature's bound."""
    n, k = len(y), extra.shape[1]
    if not n or y.min() == y.max():
        rate = (y.sum() + 0.5) / (n + 1)
        return np.zeros(len(columns)), np.zeros(k), float(np.log(rate / (1 - rate)))
    size = np.array([len(c) for c in columns], np.int64)
    rows = np.concatenate(columns) if columns else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(columns)), size)
    scale = 1 / np.sqrt(np.maximum(size, 1) / n * (1 - size / n) + 0.01)  # words of all frequencies move alike

    def margin(w: np.ndarray, e: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(rows, weights=(w * scale)[of], minlength=n) + extra @ e + b

    per_row = np.bincount(rows, weights=(scale**2)[of], minlength=n) + (extra**2).sum(axis=1) + 1
    step = 4 / (per_row.max() * n)
    x = np.zeros(len(columns) + k + 1)
    z, momentum = x.copy(), 1.0
    limit = 4 / (np.percentile(per_row, 95) * n)
    step = max(step, limit / 4)
    for _ in range(rounds):
        w, e, b = z[: len(columns)], z[len(columns) : -1], z[-1]
        residual = 1 / (1 + np.exp(-np.clip(margin(w, e, b), -30, 30))) - y
        grad = np.concatenate((np.bincount(of, weights=residual[rows], minlength=len(columns)) * scale + ridge * w, extra.T @ residual + ridge * e, [residual.sum()]))
        new = z - step * grad
        if grad @ (new - x) > 0:  # restart
            momentum = 1.0
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z = new + (momentum - 1) / following * (new - x)
        x, momentum = new, following
    return x[: len(columns)] * scale, x[len(columns) : -1], float(x[-1])


def _select(rows_of: dict[str, np.ndarray], y: np.ndarray, words: int, least: int) -> list[str]:
    """Words by the distance of their log odds from the mean in standard errors, the strongest first."""
    n, positive = len(y), y.sum()
    scored = []
    for w, rows in rows_of.items():
        if len(rows) < least:
            continue
        a, m = y[rows].sum(), len(rows)
        odds = np.log((a + 0.5) * (n - m - positive + a + 0.5) / ((m - a + 0.5) * (positive - a + 0.5)))
        z = abs(odds) / np.sqrt(1 / (a + 0.5) + 1 / (n - m - positive + a + 0.5) + 1 / (m - a + 0.5) + 1 / (positive - a + 0.5))
        scored.append((-z, w))
    chance = np.sqrt(2 * np.log(max(len(scored), 2)))  # what the largest of so many words would reach by chance
    return [w for z, w in sorted(scored)[:words] if z < -chance]


def _rows_of(names: pa.Array, codes: np.ndarray, doc: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """The rows of each feature of at least ``least`` rows. Only features that can have so many become Python objects."""
    doc = doc[np.argsort(codes, kind="stable")]
    count = np.bincount(codes, minlength=len(names)) if len(names) else np.zeros(0, np.int64)
    ends = np.cumsum(count)
    texts, words = [names], [np.arange(len(names))]
    for k in PREFIXES:
        longer = pc.greater(pc.utf8_length(names), k)
        texts.append(pc.binary_join_element_wise(pc.utf8_slice_codeunits(names.filter(longer), 0, k), "*", ""))
        words.append(np.flatnonzero(longer.to_numpy(zero_copy_only=False)))
    features = pa.concat_arrays([t.cast(pa.string()) for t in texts]).dictionary_encode()
    of, word = features.indices.to_numpy(zero_copy_only=False), np.concatenate(words)
    enough = np.bincount(of, weights=count[word], minlength=len(features.dictionary)) >= least
    some = np.flatnonzero(enough[of])
    some = some[np.argsort(of[some], kind="stable")]
    found = {}
    edges = np.flatnonzero(np.r_[True, of[some][1:] != of[some][:-1], True]) if len(some) else []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        ws = word[some[lo:hi]]
        rows = np.unique(np.concatenate([doc[ends[w] - count[w] : ends[w]] for w in ws.tolist()]))
        if len(rows) >= least:
            found[features.dictionary[int(of[some[lo]])].as_py()] = rows
    return found


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


class Chain:
    """Linear models in the order of their categories, and a threshold of each from out-of-fold predictions."""

    def __init__(self, categories: list[str], models: list[Linear], thresholds: list[float]):
        self.categories, self.models, self.thresholds = categories, models, thresholds
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for m in models for w in m.words}))}
        self.cache: dict[str, list[int]] = {}
        self.matrix = np.zeros((len(self.vocabulary), len(models)))
        for j, m in enumerate(models):
            self.matrix[[self.vocabulary[w] for w in m.words], j] = m.weights

    def _known(self, word: str) -> list[int]:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= _CACHE:
                self.cache.clear()
            found = self.cache[word] = [self.vocabulary[f] for f in _features(word) if f in self.vocabulary]
        return found

    def score(self, words: pa.Array, doc: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of n documents; ``words`` are their distinct words and ``doc`` says whose each is.

        A feature counts once for a document, however many of its words share it."""
        coded = words.dictionary_encode()
        known = [self._known(w) for w in coded.dictionary.to_pylist()]
        count = np.array([len(k) for k in known], np.int64)
        flat, start = np.array([f for k in known for f in k], np.int64), np.cumsum(count) - count
        of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = count[of] if len(of) else np.zeros(0, np.int64)
        feature = flat[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[of], size)] if len(flat) else np.zeros(0, np.int64)
        wide = max(len(self.vocabulary), 1)
        pairs = np.unique(np.repeat(doc, size) * wide + feature) if len(feature) else np.zeros(0, np.int64)
        out = np.zeros((n, len(self.models)))
        for j, m in enumerate(self.models):
            base = np.bincount(pairs // wide, weights=self.matrix[pairs % wide, j], minlength=n) if len(pairs) else np.zeros(n)
            out[:, j] = _probability(base + out[:, :j] @ m.extra + m.bias)
        return out


def sample(docs: DataFrame, labels: DataFrame, categories: list[str], doc_id: str, text: str, train_rows: int, train_bytes: int) -> pa.Table:
    """(_id, categories, words) of the labelled documents to fit on, within both bounds, in order of id."""
    marked = labels.select(F.col(doc_id).alias("_id"), *[F.col(c).cast("int").alias(c) for c in categories]).dropna()
    # at most train_rows rows: a bound that holds for any input
    chosen = F.broadcast(marked.orderBy(F.xxhash64("_id"), "_id").limit(train_rows))
    found = docs.select(F.col(doc_id).alias("_doc"), words_of(F.col(text)).alias("words")).join(chosen, F.col("_doc") == F.col("_id"))
    # more rows than chosen labels can only come of repeated document ids
    size = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w))
    rows = materialize(found.select("_id", *categories, "words", size.alias("size")).limit(train_rows), "toxicity-sample")
    held = F.sum("size").over(Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, 0))
    within = rows.select("_id", "size").withColumn("held", held).agg(F.max(F.when(F.col("held") <= train_bytes, F.xxhash64("_id"))), F.max("held")).first()
    if (within[1] or 0) > train_bytes:
        rows = rows.filter(F.xxhash64("_id") <= F.lit(within[0]))
    return rows.drop("size").toArrow().sort_by("_id")


def train(docs: DataFrame, labels: DataFrame, categories: list[str], doc_id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS, words: int = WORDS, least_docs: int = LEAST_DOCS, folds: int = FOLDS, train_bytes: int = TRAIN_BYTES) -> Chain:
    """labels has doc_id and a 0/1 column for each category; null labels leave a row out."""
    rows = sample(docs, labels, categories, doc_id, text, train_rows, train_bytes)
    y = np.stack([rows.column(c).to_numpy().astype(float) for c in categories], axis=1) if len(rows) else np.zeros((0, len(categories)))
    lists = rows.column("words").combine_chunks()
    values = lists.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(lists.offsets.to_numpy()) if len(rows) else 0)
    rows_of = _rows_of(values.dictionary, values.indices.to_numpy(zero_copy_only=False), doc, least_docs)
    fold = np.arange(len(rows)) % folds
    models, thresholds, earlier = [], [], np.zeros((len(rows), 0))
    for j in range(len(categories)):
        own = _select(rows_of, y[:, j], words, least_docs)
        columns = [rows_of[w] for w in own]
        held = np.zeros(len(rows))
        for f in range(folds):
            inside, outside = fold != f, fold == f
            at = np.cumsum(inside) - 1
            w, e, b = _fit([at[c[inside[c]]] for c in columns], earlier[inside], y[inside, j])
            margin = earlier @ e + b
            for c, x in zip(columns, w, strict=True):
                margin[c] += x
            held[outside] = _probability(margin[outside])
        w, e, b = _fit(columns, earlier, y[:, j])
        models.append(Linear(own, w, e, b))
        thresholds.append(_threshold(held, y[:, j]))
        earlier = np.column_stack((earlier, held))
    return Chain(categories, models, thresholds)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 out of fold; 0.5 where there is nothing to choose by."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    last = np.r_[p[order][1:] != p[order][:-1], True]
    best = int(np.argmax(np.where(last, f1, -1)))
    below = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + below) / 2)


def _score(chain_of):
    """Rows (row, distinct words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = chain_of.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(1)
                p = chain.score(lists.flatten(), np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy())), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(p[:, j]) for j in range(p.shape[1])), *(pa.array(p[:, j] >= t) for j, t in enumerate(chain.thresholds))], names=["row", *(f"p_{c}" for c in chain.categories), *chain.categories])

    return run


def predict(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, p_category double ..., category boolean ...)."""
    schema = ", ".join(["row long", *(f"p_{c} double" for c in chain.categories), *(f"{c} boolean" for c in chain.categories)])
    rows = docs.select(F.col(doc_id).cast("long").alias("row"), words_of(F.col(text)).alias("words"))
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(chain)), schema).withColumnRenamed("row", doc_id)
