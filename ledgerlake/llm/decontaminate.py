"""Benchmark decontamination by suffix arrays of the training texts.

The documents are cut into shards of whole documents. A shard's words are coded by the test vocabulary (0: a word of no
test text, and what separates documents), and its suffix array holds every suffix that begins with a test word, in full order
(prefix doubling; a suffix ends at the first 0). Every suffix of every test text is binary-searched in every shard, word by
word: its interval of the array shrinks to the places that go on as it does. What the interval is after a whole window gives
all verbatim places; from those that cannot be longer to the left the match is followed to its end.

Test texts are written to the shared folder in blocks of bounded size, by Spark; a task reads one block after the other and
holds one of them. Documents are never shuffled or compared with each other. Words are told apart by their bytes.

Defined results: a null or empty text has no words and no hits; null test texts are ignored; test rows of one id are one
item (a null id is the item ``null``); repeated document rows are judged alike; empty tables give empty or clean results;
other columns are ignored or, in ``remove``, kept; a text of any length is searched whole, as a shard of its own if need be.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_folder, open_path
from .textcore import IS_ALNUM, LOWER, chunks, digests, distinct, packed, pieces, utf8_of

_SHARD = 2 << 20
#: Words of a block of test texts, and of a part of a text that is longer.
BLOCK_WORDS = 1_000_000
_PAIRS = 1 << 20
_MATCH = "struct<item:string,item_word:int,doc_word:int,words:int>"
_OUT = f"row long, n_words long, hits array<struct<start:int,end:int>>, items array<string>, matches array<{_MATCH}>"
_TEST = "item string, text_hash long, at long, length long, words array<string>"


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of a column, where its words start and end, and the row of each."""
    data, offsets = utf8_of(column)
    low = LOWER[data]
    return low, *pieces(IS_ALNUM[low], offsets)


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Places of all suffixes that begin with a code other than 0, in order; a suffix ends before the first 0.

    Prefix doubling: suffixes that agree in k codes are a group, whose rank is its first slot; each round sorts the groups that
    are not settled by the rank of what follows, and doubles k."""
    n = len(codes)
    at = np.flatnonzero(codes)
    m = len(at)
    if not m:
        return at
    zeros = np.append(np.flatnonzero(codes == 0), n)
    end = np.zeros(n + 1, np.int64)
    end[at] = zeros[np.searchsorted(zeros, at)]
    order = at[np.argsort(codes[at], kind="stable")]
    rank, slots, key, k = np.zeros(n + 1, np.int64), np.arange(m), codes[order].astype(np.int64), 1
    while True:
        new = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(new) - 1
        pos = order[slots]
        rank[pos] = slots[np.flatnonzero(new)][group] + 1
        goes_on = pos + k < end[pos]
        unsettled = ((np.bincount(group) > 1) & (np.bincount(group, weights=goes_on) > 0))[group]
        slots, pos, goes_on = slots[unsettled], pos[unsettled], goes_on[unsettled]
        if not len(slots):
            return order
        key = rank[pos] * (m + 2) + np.where(goes_on, rank[np.minimum(pos + k, n)], 0)
        by = np.argsort(key, kind="stable")
        order[slots], key = pos[by], key[by]
        k *= 2


class TestBlock:
    """Coded test texts, a 0 after each; ``starts`` are the places of all suffixes."""

    __test__ = False

    def __init__(self, rows: pa.Table, window: int):
        lists = rows.column("words").combine_chunks()
        flat = lists.flatten().cast(pa.large_string()).cast(pa.large_binary()).dictionary_encode()
        self.window, self.vocabulary = window, flat.dictionary
        size = np.diff(lists.offsets.to_numpy())
        self.items, self.rows = rows.column("item").to_pylist(), rows.column("text_hash").to_numpy()
        self.at, self.length = rows.column("at").to_numpy(), rows.column("length").to_numpy()
        self.owner = np.repeat(np.arange(len(size)), size)
        self.first = np.cumsum(size) - size + np.arange(len(size))
        self.starts = np.arange(len(flat)) + self.owner
        self.codes = np.zeros(len(flat) + len(size), np.int64)
        self.codes[self.starts] = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1

    def code(self, words: pa.Array) -> np.ndarray:
        return pc.index_in(words, value_set=self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1


def _bound(words: np.ndarray, order: np.ndarray, depth: int, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> np.ndarray:
    """In each interval of the array the first suffix whose word at ``depth`` is ``want`` or more."""
    lo, hi = lo.copy(), hi.copy()
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) // 2
        less = words[order[mid] + depth] < want[open_]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
    return lo


def search(block: TestBlock, codes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, first slot, end slot) of every test suffix that a whole window or a whole shorter text follows, and the longest
    match of every suffix in words."""
    q = block.starts
    lo, hi, longest = np.zeros(len(q), np.int64), np.full(len(q), len(order), np.int64), np.zeros(len(q), np.int64)
    whole = np.flatnonzero((block.length[block.owner] < block.window) & (q == block.first[block.owner]) & (block.at[block.owner] == 0))
    some, found = np.arange(len(q)), []
    for depth in range(len(block.codes) + 1):
        want = block.codes[q[some] + depth]
        some, want = some[want > 0], want[want > 0]
        low = _bound(codes, order, depth, lo[some], hi[some], want)
        lo[some], hi[some] = low, _bound(codes, order, depth, low, hi[some], want + 1)
        some = some[lo[some] < hi[some]]
        longest[some] = depth + 1
        done = some if depth + 1 == block.window else some[np.isin(some, whole) & (block.length[block.owner[some]] == depth + 1)] if depth + 1 < block.window and len(whole) else some[:0]
        if len(done):
            found.append(np.stack((q[done], lo[done], hi[done])))
        if not len(some):
            break
    return *(np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)), longest


def _matches(block: TestBlock, codes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the test texts, place in the shard, words) of all longest verbatim matches of a window or a shorter text."""
    suffix, lo, hi, _ = search(block, codes, order)
    before_test, before = np.append(0, block.codes)[suffix], np.append(0, codes)
    q, p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    size = hi - lo
    for a, b in chunks(np.append(0, np.cumsum(size)), _PAIRS):  # an interval at least; what goes on from the left is dropped
        n = size[a:b]
        of = np.repeat(np.arange(a, b), n)
        place = order[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + lo[of]]
        left = (before_test[of] == 0) | (before[place] != before_test[of])
        q.append(suffix[of[left]])
        p.append(place[left])
    q, p = np.concatenate(q), np.concatenate(p)
    words, some = np.zeros(len(q), np.int64), np.arange(len(q))
    test, own = np.append(block.codes, 0), np.append(codes, 0)
    while len(some):
        a, b = test[np.minimum(q[some] + words[some], len(test) - 1)], own[np.minimum(p[some] + words[some], len(own) - 1)]
        some = some[(a == b) & (a > 0)]
        words[some] += 1
    return q, p, words


class Blocks:
    """Files of test texts in the shared folder. The last one read stays in memory."""

    def __init__(self, files: list[str], window: int):
        self.files, self.window, self.held = files, window, (None, None)

    def __iter__(self) -> Iterator[TestBlock]:
        for name in self.files:
            if self.held[0] != name:
                fs, path = open_path(name)
                with fs.open_input_file(path) as f:
                    self.held = (name, TestBlock(pq.read_table(f), self.window))
            yield self.held[1]


def _shard(column: pa.Array, blocks: Blocks) -> tuple[np.ndarray, list, list, list]:
    """Of each text: number of words, spans under matches, items, longest matches."""
    low, starts, ends, row = words_of(column)
    distinct_words, of = distinct(low, starts, ends) if len(starts) else (pa.array([], pa.large_binary()), np.zeros(0, np.int64))
    n_docs = len(column)
    n_words = np.bincount(row, minlength=n_docs)
    first = np.cumsum(n_words) - n_words + np.arange(n_docs)
    found: list[list[tuple]] = [[] for _ in range(n_docs)]
    parts = False
    for block in blocks:
        codes = np.zeros(len(of) + n_docs, np.int64)  # one zero stands after each document
        codes[np.arange(len(of)) + row] = block.code(distinct_words)[of]
        parts |= bool(block.at.any())
        q, p, words = _matches(block, codes, suffix_array(codes))
        if len(q):
            test, doc = np.searchsorted(block.first, q, "right") - 1, np.searchsorted(first, p, "right") - 1
            columns = (doc, test, block.at[test] + q - block.first[test], p - first[doc], words, block.rows[test], block.length[test])
            for d, t, i, j, n, r, length in zip(*(c.tolist() for c in columns), strict=True):
                found[d].append((block.items[t], r, i, j, n, length))
    hits, items, matches = [], [], []
    for own in found:
        own = _joined(own) if parts else own
        matches.append([{"item": i, "item_word": a, "doc_word": b, "words": n, "length": length} for i, _, a, b, n, length in sorted(own)])
        items.append(sorted({x[0] for x in own}))
        hits.append([{"start": s, "end": e} for s, e in _union(sorted((b, b + n) for _, _, _, b, n, _ in own))])
    return n_words, hits, items, matches


def _joined(own: list[tuple]) -> list[tuple]:
    """Matches of parts of one test text that touch or overlap on one diagonal are one."""
    out = []
    for _, same in groupby(sorted(own, key=lambda x: (x[0], x[1], x[3] - x[2], x[2])), key=lambda x: (x[0], x[1], x[3] - x[2])):
        last = None
        for item, row, a, b, n, length in same:
            if last and a <= last[2] + last[4]:
                last = (item, row, last[2], last[3], max(last[4], a + n - last[2]), length)
                out[-1] = last
            else:
                last = (item, row, a, b, n, length)
                out.append(last)
    return out


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_MATCHES = pa.list_(pa.struct([("item", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())]))


def _find(files: list[str], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(files, window)
        for batch in batches:
            for a, b in chunks(utf8_of(batch.column(1))[1], _SHARD):
                part = batch.slice(a, b - a)
                n_words, hits, items, matches = _shard(part.column(1), blocks)
                shown = [[{k: m[k] for k in ("item", "item_word", "doc_word", "words")} for m in ms] for ms in matches]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words), pa.array(hits, _SPANS), pa.array(items, pa.list_(pa.string())), pa.array(shown, _MATCHES)], names=["row", "n_words", "hits", "items", "matches"])

    return run


def _remove(files: list[str], text: int, window: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(files, window)
        for batch in batches:
            for a, b in chunks(utf8_of(batch.column(text))[1], _SHARD):
                part = batch.slice(a, b - a)
                matches = _shard(part.column(text), blocks)[3]
                yield part.filter(pa.array([not any(m["words"] >= min(least, m["length"]) for m in ms) for ms in matches], pa.bool_()))

    return run


def _tests(window: int, most: int):
    """Rows (item, text). Out: rows of _TEST; a text of more than ``most`` words is cut into parts that overlap by a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                low, starts, ends, _ = words_of(batch.column(1).slice(i, 1))
                if not len(starts):
                    continue
                words = packed(low, starts, ends).cast(pa.large_string()).cast(pa.string())
                own = int(digests([low.tobytes()], 8).view(np.int64)[0, 0])
                for at in range(0, max(len(words) - window + 1, 1), max(most - window + 1, 1)):
                    part = words.slice(at, most)
                    lists = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([own]), pa.array([at]), pa.array([len(words)]), lists], names=["item", "text_hash", "at", "length", "words"])

    return run


def test_files(benchmark: DataFrame, item_id: str, text: str, window: int) -> list[str]:
    """Writes the benchmark in blocks of about BLOCK_WORDS words; the names of their files."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text")).filter("text is not null")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0  # a word and its gap are two characters at least
    path = new_folder(spark, "benchmark-blocks")
    rows.mapInArrow(_tests(window, BLOCK_WORDS), _TEST).repartition(max(1, -(-size // (2 * BLOCK_WORDS)))).write.parquet(path)
    return sorted(spark.read.schema(_TEST).parquet(path).inputFiles())


test_files.__test__ = False


def find_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 8) -> DataFrame:
    """(doc_id, n_words, n_hit, items array<string> sorted, matches): longest verbatim matches with their places."""
    body = docs.select(F.col(doc_id).cast("long").alias("row"), F.col(text).alias("text"))
    found = body.mapInArrow(_find(test_files(benchmark, item_id, item_text, window), window), _OUT)
    return found.select(F.col("row").alias(doc_id), "n_words", _covered(F.col("hits")).cast("long").alias("n_hit"), "items", "matches")


def _covered(hits: Column) -> Column:
    """Number of words under spans that do not overlap."""
    return F.aggregate(hits, F.lit(0), lambda n, s: n + s["end"] - s["start"])


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 8, least: int = 13) -> DataFrame:
    """docs without those that hold a verbatim test match of ``least`` words, or the whole of a test text that is shorter."""
    files = test_files(benchmark, item_id, item_text, window)
    return docs.mapInArrow(_remove(files, docs.columns.index(text), window, least), docs.schema)
