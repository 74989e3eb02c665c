"""Line dedup over range-partitioned line hashes.

Each line that is long enough gives one row (128-bit block hash of its key, document, position). The rows are range-partitioned
by (hash, document), sorted by hash, then document from the largest, then position, and streamed once: the first
document of a hash keeps its lines, all others drop theirs if the hash stands in enough documents. A hash whose rows
cross a partition's edge, as those of a very common line do, is settled from one summary per partition and edge.
The result is a run-length compressed keep bitmap per document, never text.

Defined results: a null text is one empty line; a null document id is one document, smaller than any other; rows that
repeat a document id are told apart by their text and count as one document; an empty table gives an empty result;
other columns are ignored. A text of any length is worked on whole; a text that is longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, plus
from .textcore import IS_SPACE, LOWER, chunks, digests, utf8_of

_CHUNK = 2 << 20
#: Bitmaps up to this size are broadcast.
BROADCAST_BYTES = 16 << 20
_KEYS = "h1 long, h2 long, doc long, text_hash long, pos int"
_OUT = "kind string, h1 long, h2 long, doc long, text_hash long, pos int, docs long"


def _line_keys(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_of(batch.column(0))
            doc, text_hash = batch.column(1), batch.column(2)
            for lo, hi in chunks(offsets, _CHUNK):
                part, offs = LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
                if not len(part):
                    continue
                breaks = np.flatnonzero(part == 10)
                starts = np.sort(np.concatenate((offs[:-1], breaks + 1)))
                ends = np.sort(np.concatenate((offs[1:], breaks)))
                row = np.repeat(np.arange(hi - lo), np.diff(np.searchsorted(breaks, offs)) + 1)
                pos = np.arange(len(starts)) - np.searchsorted(row, row, "left")
                solid = np.flatnonzero(~IS_SPACE[part])
                a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
                some = b > a
                row, pos, a, b = row[some], pos[some], a[some], b[some]
                if not len(row):
                    continue
                starts, ends = solid[a], solid[b - 1] + 1
                points = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
                full = points[ends] - points[starts] >= least
                row, pos, starts, ends = row[full], pos[full], starts[full], ends[full]
                at = pa.array(row + lo)
                raw = memoryview(np.ascontiguousarray(part))
                h = digests((raw[x:y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)), 16).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), doc.take(at), text_hash.take(at), pa.array(pos.astype(np.int32))],
                    names=["h1", "h2", "doc", "text_hash", "pos"],
                )

    return run


def _stream(least_docs: int):
    """Rows in order of (h1, h2, doc descending, pos). Out: drop = dropped line, open = line of a run that may have begun
    in an earlier partition or go on in a later one, edge = documents and largest document of such a run's part here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None  # rows of the last run so far, of fewer documents than least_docs
        seen, top, key = 0, None, None  # of the last run: documents so far, its first one, its hash
        first_key, last_doc = None, ()

        def out(kind: str, rows: pa.Table, docs: int | None = None) -> pa.RecordBatch:
            n = rows.num_rows
            cols = {c: rows.column(c).combine_chunks() for c in ("h1", "h2", "doc", "text_hash", "pos")}
            return pa.RecordBatch.from_arrays([pa.array([kind] * n), *cols.values(), pa.array([docs] * n, pa.int64())], names=["kind", *cols, "docs"])

        def edge() -> pa.RecordBatch:
            h1, h2 = key
            return pa.RecordBatch.from_arrays([pa.array(["edge"]), pa.array([h1]), pa.array([h2]), pa.array([top], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int32()), pa.array([seen])], names=["kind", "h1", "h2", "doc", "text_hash", "pos", "docs"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            h1, h2 = (table.column(c).to_numpy() for c in ("h1", "h2"))
            doc = table.column("doc").combine_chunks()
            null = doc.is_null().to_numpy(zero_copy_only=False)
            d = doc.fill_null(0).to_numpy()
            new_run = np.ones(len(d), bool)
            new_run[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_doc = new_run.copy()
            new_doc[1:] |= (d[1:] != d[:-1]) | (null[1:] != null[:-1])
            bounds = np.append(np.flatnonzero(new_run), len(d))
            if len(bounds) > 3:  # runs that begin and end within this batch need no state
                lo, hi = int(bounds[1]), int(bounds[-2])
                starts = bounds[1:-2] - lo
                sizes = np.diff(bounds[1:-1])
                common = np.repeat(np.add.reduceat(new_doc[lo:hi].astype(np.int64), starts) >= least_docs, sizes)
                lead = np.repeat(starts, sizes)
                other = (d[lo:hi] != d[lo:hi][lead]) | (null[lo:hi] != null[lo:hi][lead])
                if (common & other).any():
                    yield out("drop", table.slice(lo, hi - lo).filter(pa.array(common & other)))
            for i in sorted({0, len(bounds) - 2}):
                lo, hi = int(bounds[i]), int(bounds[i + 1])
                if key != (int(h1[lo]), int(h2[lo])):
                    if key is not None and key == first_key:
                        yield edge()
                    kept, seen, last_doc = None, 0, ()
                    key = (int(h1[lo]), int(h2[lo]))
                    first_key = first_key or key
                    top = None if null[lo] else int(d[lo])
                rows, fresh = table.slice(lo, hi - lo), new_doc[lo:hi].copy()
                now = None if null[lo] else int(d[lo])
                fresh[0] = last_doc == () or now != last_doc
                seen += int(fresh.sum())
                last_doc = None if null[hi - 1] else int(d[hi - 1])
                if key == first_key:
                    yield out("open", rows)
                    continue
                kept = rows if kept is None else pa.concat_tables([kept, rows])
                if seen >= least_docs:
                    its, nul = kept.column("doc").fill_null(0).to_numpy(), kept.column("doc").is_null().to_numpy()
                    other = ~nul if top is None else nul | (its != top)
                    yield out("drop", kept.filter(pa.array(other)))
                    kept = kept.slice(0, 0)
        if key is not None:
            yield edge()
            if kept is not None and kept.num_rows:
                yield out("open", kept)

    return run


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """(doc_id, text_hash, keep_runs array<int>) for each document that loses lines.

    keep_runs are run lengths of the keep bitmap, kept lines first, then dropped, in turn; what follows them is kept."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("text_hash"))
    keys = materialize(rows.mapInArrow(_line_keys(least_chars), _KEYS), "line-keys")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc_nulls_last()]
    ranged = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order, "pos")
    found = materialize(ranged.mapInArrow(_stream(least_docs), _OUT), "line-runs")
    edges = found.filter("kind = 'edge'").groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("doc").alias("top")).filter(F.col("docs") >= least_docs)
    # at most two edges a partition: a size that follows from the plan, whatever the data
    opened = found.filter("kind = 'open'").drop("docs").join(F.broadcast(edges), ["h1", "h2"]).filter(~F.col("doc").eqNullSafe(F.col("top")))
    gone = found.filter("kind = 'drop'").select("doc", "text_hash", "pos").unionByName(opened.select("doc", "text_hash", "pos"))
    per_doc = gone.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    return per_doc.select(F.col("doc").alias(doc_id), "text_hash", _runs(F.col("gone")).alias("keep_runs"))


def _runs(gone: Column) -> Column:
    """Sorted dropped positions to run lengths."""

    def step(i: Column, x: Column) -> Column:
        return F.when(i == 0, F.array(x, F.lit(1))).otherwise(F.array(x - F.get(gone, i - 1) - 1, F.lit(1)))

    pairs = F.flatten(F.transform(gone, lambda x, i: step(i, x)))
    return pairs


def keep_lines(lines: Column, keep_runs: Column) -> Column:
    """The lines that a bitmap of line_dedup keeps, in order."""

    def kept(runs: Column) -> Column:
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,n:int>>").alias("spans"))
        step = lambda acc, r: F.struct((acc["at"] + r["n"] + r["gone"]).alias("at"), F.when(r["n"] == 0, acc["spans"]).otherwise(F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("at"), r["n"].alias("n"))))).alias("spans"))
        pairs = F.transform(F.sequence(F.lit(0), F.size(runs) - 2, F.lit(2)), lambda i: F.struct(F.get(runs, i).alias("n"), F.get(runs, i + 1).alias("gone")))
        return F.aggregate(pairs, start, step)

    def cut(ls: Column, k: Column) -> Column:
        spans = F.concat(k["spans"], F.array(F.struct(k["at"].alias("at"), F.greatest(F.size(ls) - k["at"] + 1, F.lit(0)).alias("n"))))
        return F.flatten(F.transform(spans, lambda s: F.slice(ls, s["at"], s["n"])))

    return let(lines, lambda ls: let(kept(keep_runs), lambda k: cut(ls, k)))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text", most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with keep_runs (null: all lines stay), which takes the place of a column of that name.

    Bitmaps of up to ``most_bytes`` are broadcast, so that no text moves; else the small side of the join is hashed."""
    right = materialize(bitmaps.select(F.col(doc_id).alias("_doc"), F.col("text_hash").alias("_hash"), F.col("keep_runs").alias("_runs")), "line-bitmaps")
    held = right.agg(F.sum(F.size("_runs") * 4 + 32)).first()[0] or 0
    left = docs.withColumn("_th", F.xxhash64(text))
    on = F.col(doc_id).cast("long").eqNullSafe(F.col("_doc")) & (F.col("_th") == F.col("_hash"))
    joined = left.join(F.broadcast(right) if held <= most_bytes else right.hint("shuffle_hash"), on, "left")
    return plus(joined, keep_runs=F.col("_runs")).drop("_doc", "_hash", "_th", "_runs")
