"""BPE encoding and decoding through tables of distinct words.

Words are split and counted in Spark (ASCII white space, which no token of the tokenizer crosses). The table of distinct words
is encoded once, a word at a time, and ids return to the documents by position; ids are decoded through the id-to-piece table
(one row per vocabulary entry). Two ways to bring the ids back:

* ``table_words`` None: the table holds every distinct word of the corpus and meets every place of a word in a join; the places
  of a text are collected by its digest. Nothing is encoded twice, but every place of every word crosses two exchanges.
* ``table_words`` a number: the table holds the most frequent words, at most that many, and is broadcast, so that its size is
  bounded by the number; it meets the distinct words of each block of documents (8 MB of text). Words beyond the table are encoded once
  for each block they stand in. No text and no place of a word moves.

Words are told apart by their bytes. Defined results: a null or empty text has no tokens; repeated rows are encoded alike; an
empty table gives an empty result; other columns are ignored; texts of any length are encoded whole. The tokenizer must drop
white space and have no decoder, as word_bpe_49k.json does; others are refused.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize
from .textcore import IS_SPACE, chunks, distinct, pieces, utf8_of

BLOCK, TABLE_WORDS = 8 << 20, 300_000
_JOINED, _OUT_ROWS = 2000, 128
_SPLIT = r"[\x20\x09-\x0D]+"


def check_tokenizer(path: str) -> None:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("decoder") is not None or spec["model"].get("end_of_word_suffix") is None or spec.get("truncation") or spec.get("padding"):
        raise ValueError("this tokenizer's words are not independent of white space")


class Codec:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        table = [""] * (max(vocabulary.values(), default=-1) + 1)
        for piece, i in vocabulary.items():
            table[i] = piece
        self.pieces = pa.array(table, pa.string())  # the id-to-piece table

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has.

        Many words make one call: joined by spaces, which no token crosses, and told apart by their tokens' offsets. Words that
        the normalizer may lengthen or shorten, so that offsets could shift, are encoded one by one."""
        ids, counts = [], np.zeros(len(words), np.int64)
        for at in range(0, len(words), _JOINED):
            part = words[at : at + _JOINED]
            plain = [w.isascii() or (unicodedata.is_normalized("NFC", w) and len(w.lower()) == len(w)) for w in part]
            joined = [w for w, p in zip(part, plain, strict=True) if p]
            found = self.tokenizer.encode(" ".join(joined), add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in joined)])[:-1]
            begin = np.array([o[0] for o in found.offsets], np.int64)
            own = np.bincount(np.searchsorted(starts, begin, "right") - 1, minlength=len(joined)) if len(joined) else np.zeros(0, np.int64)
            if all(plain):
                ids.append(np.array(found.ids, np.uint32))
                counts[at : at + len(part)] = own
                continue
            flat, taken, k = found.ids, 0, 0
            for i, (w, p) in enumerate(zip(part, plain, strict=True)):
                if p:
                    n = int(own[k])
                    word_ids, taken, k = flat[taken : taken + n], taken + n, k + 1
                else:
                    word_ids = self.tokenizer.encode(w, add_special_tokens=False).ids
                ids.append(np.array(word_ids, np.uint32))
                counts[at + i] = len(word_ids)
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), counts

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts by the join of ids with the pieces; a text's ids end at ``ends``."""
        offsets = pa.array(np.concatenate((np.zeros(1, np.int64), ends)).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self.pieces.take(pa.array(ids.astype(np.int64)))), " ")


def _binary(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Little-endian ids of each row as one binary value."""
    offsets = np.concatenate((np.zeros(1, np.int64), ends)) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... for each start and count."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def _encode_table(path: str):
    """Rows (word, n); out: (word, n, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            ids, counts = codec.encode_words(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(ids, np.cumsum(counts)).cast(pa.binary())], names=["word", "n", "ids"])

    return run


def word_table(docs: DataFrame, text: str, path: str, most: int | None) -> DataFrame:
    """(word, n, ids): the distinct words of docs, or at most ``most`` of the most frequent ones, each encoded once.

    Which counts are frequent enough is read off a histogram of counts with a fixed number of bins; no task sees all words."""
    words = docs.select(F.explode(F.split(F.col(text), _SPLIT)).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    if most is not None:
        words = materialize(words, "bpe-counts")
        size = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
        room, least = most, 1 << 20
        for bin_, count in sorted(words.groupBy(size.alias("bin")).count().collect(), reverse=True):  # at most 16 bins a power of two
            if count > room:
                break
            room, least = room - count, bin_
        words = words.filter(size >= least)
    return words.mapInArrow(_encode_table(path), "word string, n long, ids binary")


class Table:
    """A word table as arrays."""

    def __init__(self, words: pa.Array, ids: pa.Array):
        self.words = words.cast(pa.large_string()).cast(pa.large_binary())
        self.counts = np.array([len(x) for x in ids.to_pylist()], np.int64) // 4
        self.flat = np.frombuffer(b"".join(ids.to_pylist()), "<u4")

    def encode(self, codec: Codec, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and of each word where its own start and how many they are."""
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        rest = np.flatnonzero(at < 0)
        more, n = codec.encode_words([w.decode() for w in words.take(pa.array(rest)).to_pylist()])
        flat = np.concatenate((self.flat, more))
        counts, starts = (np.append(x, 0)[at] for x in (self.counts, np.cumsum(self.counts) - self.counts))
        counts[rest], starts[rest] = n, len(self.flat) + np.cumsum(n) - n
        return flat, starts, counts


def _encode(path: str, table_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, table = Codec(path), table_of.value
        for batch in batches:
            data, offsets = utf8_of(batch.column(1))
            for a, b in chunks(offsets, BLOCK):
                part, offs = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, row = pieces(~IS_SPACE[part], offs)
                words, of = distinct(part, starts, ends)
                flat, first, counts = table.encode(codec, words)
                ids = flat[_ranges(first[of], counts[of])]
                per_doc = np.bincount(row, weights=counts[of], minlength=b - a).astype(np.int64)
                ends = np.cumsum(per_doc)
                for lo in range(0, b - a, _OUT_ROWS):
                    hi = min(lo + _OUT_ROWS, b - a)
                    begin = int(ends[lo] - per_doc[lo])
                    own, to = ids[begin : ends[hi - 1]], ends[lo:hi] - begin
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a + lo, hi - lo), _binary(own, to).cast(pa.binary()), codec.decode(own, to)], names=["row", "ids", "decoded"])

    return run


def _decode(path: str):
    """Rows (key, ids); out: (key, ids, decoded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            raw = batch.column(1).to_pylist()
            ids = np.frombuffer(b"".join(raw), "<u4")
            ends = np.cumsum([len(x) // 4 for x in raw], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codec.decode(ids, ends)], names=["key", "ids", "decoded"])

    return run


def _by_join(rows: DataFrame, path: str) -> DataFrame:
    """The whole word table joined with every place of a word; equal texts are put together once."""
    keyed = rows.withColumn("key", F.md5("text"))
    places = keyed.select("key", F.posexplode(F.array_remove(F.split("text", _SPLIT), "")).alias("pos", "word"))
    found = hot_join(places, word_table(rows, "text", path, None), "word", "n", F.xxhash64("key", "pos"))
    texts = found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("pos", "ids"))).alias("ps"))
    joined = texts.select("key", F.expr("aggregate(ps, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))
    whole = joined.mapInArrow(_decode(path), "key string, ids binary, decoded string")
    return keyed.select("row", "key").join(whole, "key", "left").select("row", F.coalesce("ids", F.lit(b"")).alias("ids"), F.coalesce("decoded", F.lit("")).alias("decoded"))


def encode_decode(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", table_words: int | None = TABLE_WORDS) -> DataFrame:
    """(doc_id, ids binary: little-endian unsigned 32-bit integers, decoded string)."""
    check_tokenizer(tokenizer_path)
    rows = docs.select(F.col(doc_id).cast("long").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if table_words is None:
        return _by_join(rows, tokenizer_path).withColumnRenamed("row", doc_id)
    held = materialize(word_table(rows, "text", tokenizer_path, table_words), "bpe-words").select("word", "ids").toArrow()  # at most table_words rows
    table = docs.sparkSession.sparkContext.broadcast(Table(held.column("word").combine_chunks(), held.column("ids").combine_chunks()))
    return rows.mapInArrow(_encode(tokenizer_path, table), "row long, ids binary, decoded string").withColumnRenamed("row", doc_id)
