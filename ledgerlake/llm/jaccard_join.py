"""N-gram Jaccard join: which documents are connected by links of near-equal shingle sets, exactly.

1. Each document's set of word shingles gives a 128-bit fingerprint (equal sets are one vertex) and part signatures: the
   tokens are dealt into k parts by hash, k greater than the number of tokens by which two linked sets of that size class can
   differ, so that two linked sets agree in a whole part, and in more the nearer their sizes. Signatures meet in buckets; a
   set that shares too few of its parts with any other set has no link. Of each set that is left one text is fetched.
2. Those sets' signatures meet again, among themselves; connected components of what they share are the pieces of work.
3. In a component a signature tree finds the links (signature_tree). Components that are too large for a task are cut into
   blocks by size class and salt: first each block is linked within itself, then one set of each part so found with those of
   other blocks; only pairs of blocks that are not yet all of one part are compared as a whole.
4. Links' components, with all documents of each fingerprint, are the result; keys of many rows are joined by broadcast.

Defined results: null or empty texts, or texts without words, have an empty set and are linked with nothing; fewer words
than a shingle make one shingle; equal sets are linked; a null document id takes part like any other and is the component's
id only where there is no other; rows that repeat a document id and text are one document; rows of one id with other texts
stand for themselves with that id; an empty table gives an empty result; other columns are ignored; texts of any length are
worked on whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard
from .common import hot_join, materialize, written
from .components import connected
from .signature_tree import link
from .textcore import IS_SPACE, LOWER, chunks, mix64, piece_hashes, pieces, utf8_of

_CHUNK = 2 << 20
#: Texts whose signatures are packed together.
_PACK = 8 << 20
#: Texts of a block: what a task holds at once is a few times this.
BLOCK_BYTES = 24 << 20
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its word n-grams."""
    data, offsets = utf8_of(column)
    low = LOWER[data]
    starts, ends, row = pieces(~IS_SPACE[low], offsets)
    words = piece_hashes(low, starts, ends)
    per_doc = np.bincount(row, minlength=len(column))
    first = np.cumsum(per_doc) - per_doc
    rolled = words.copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            rolled[: len(words) - k] = mix64(rolled[: len(words) - k] * _ODD + words[k:])
    out = []
    for at, count in zip(first.tolist(), per_doc.tolist(), strict=True):
        if count >= n:
            s = np.sort(rolled[at : at + count - n + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) > 1 else s)
        elif count:
            with np.errstate(over="ignore"):
                h = words[at : at + 1]
                for k in range(1, count):
                    h = mix64(h * _ODD + words[at + k : at + k + 1])
                out.append(mix64(h + np.uint64(count)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Classes:
    """Size classes and numbers of parts for a threshold num/den."""

    def __init__(self, num: int, den: int):
        self.t = num / den
        self.log = math.log(1 / (self.t * 0.999))

    def band(self, size: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(size, 1)) / self.log).astype(np.int64)

    def parts(self, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of the class whose larger sets are of this band, and how many empty ones a set may leave out."""
        top = np.exp((band + 1) * self.log)
        differ = np.floor(2 * top * (1 - self.t) / (1 + self.t)).astype(np.int64) + 1
        spare = np.where(differ > 8, np.ceil(1.5 * differ * np.exp(-top * self.t / differ)).astype(np.int64) + 2, 0)
        # an eighth more parts than need be, so that a set must share more than a chance part to have a link
        return differ + spare + differ // 8, spare

    def shared(self, size: np.ndarray, more: int) -> np.ndarray:
        """How many parts of its own class (more = 0) or the next a set of this size shares with any that it links to."""
        band = self.band(size) + more
        largest = np.minimum(np.exp((band + 1) * self.log), size / self.t + 1)
        return self.parts(band)[0] - np.floor((size + largest) * (1 - self.t) / (1 + self.t)).astype(np.int64) - 1


def part_signatures(sets: list[np.ndarray], classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, twice the position of the set, plus one in the next class), and for each of these the parts to share."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), size)
    found, least = [], np.zeros((len(sets), 2), np.int64)
    with np.errstate(over="ignore"):
        where, weight = mix64(flat + np.uint64(77)), mix64(flat ^ _ODD)
        for more in (0, 1):
            band = classes.band(size) + more
            parts, spare = classes.parts(band)
            parts = np.where(size > 0, parts, 0)
            first = np.cumsum(parts) - parts
            slot = first[doc] + (where % np.maximum(parts[doc], 1).astype(np.uint64)).astype(np.int64)
            total = int(parts.sum())
            sums = np.zeros(total, np.uint64)
            np.add.at(sums, slot, weight)
            empty = np.bincount(slot, minlength=total) == 0
            owner = np.repeat(np.arange(len(sets)), parts)
            part = np.arange(total) - first[owner]
            sig = mix64(sums + mix64(part.astype(np.uint64) * np.uint64(1_000_003) + band[owner].astype(np.uint64)))
            none = np.bincount(owner[empty], minlength=len(sets))
            drop = empty & (none <= spare)[owner]
            found.append((sig[~drop], owner[~drop] * 2 + more))
            least[:, more] = np.maximum(classes.shared(size, more) - np.minimum(none, spare), 1)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), least


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of two numbers, together below 2^126, so that Spark holds them as decimals."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if size.sum() else np.zeros(0, np.uint64)
    ends = np.cumsum(size)
    out = np.empty((len(sets), 2), np.uint64)
    with np.errstate(over="ignore"):
        for i, odd in enumerate((np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(flat ^ odd))))
            out[:, i] = mix64(total[ends] - total[ends - size] + size.astype(np.uint64) * odd)
    out[:, 1] &= np.uint64((1 << 62) - 1)
    return out


def decimals(fp: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(fp), [None, pa.py_buffer(np.ascontiguousarray(fp, "<u8"))])


def numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], "<u8", 2 * len(column), 16 * column.offset).reshape(-1, 2) if len(column) else np.zeros((0, 2), np.uint64)


def names(fp: np.ndarray) -> np.ndarray:
    """64-bit names of fingerprints, all with the top bit: by these sets are told apart where signatures meet."""
    return mix64(fp[:, 0] + mix64(fp[:, 1])) | np.uint64(1 << 63)


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32 as byte planes, of which the high ones compress to nothing."""
    return np.ascontiguousarray(x.astype("<u4").view("u1").reshape(-1, 4).T).tobytes()


def _of_planes(blob: bytes, m: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, "u1", 4 * m, at).reshape(4, m).T).view("<u4").reshape(-1).astype(np.int64)


_FP = "decimal(38,0)"
_A = f"bucket long, doc long, th long, n long, fp {_FP}, own long, next long, data binary"
_A_NAMES = ["bucket", "doc", "th", "n", "fp", "own", "next", "data"]


def _pack(sig: np.ndarray, owner: np.ndarray, name: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    """The buckets and for each its signatures (40 bits) in order of their owners, with each owner's name, class and count."""
    bucket = (sig >> np.uint64(48)) % np.uint64(buckets)
    order = np.lexsort((owner, bucket.astype(np.uint16)))
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    used, blobs = [], []
    for k in np.flatnonzero(np.diff(edges)).tolist():
        own = order[edges[k] : edges[k + 1]]
        who, count = np.unique(owner[own], return_counts=True)
        s, head = sig[own], name[who // 2] ^ ((who % 2).astype(np.uint64) << np.uint64(63))
        blobs.append(np.array([len(who), len(own)], "<u4").tobytes() + head.astype("<u8").tobytes() + _planes(count) + (s & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (s >> np.uint64(32)).astype("u1").tobytes())
        used.append(k)
    return used, blobs


def _sign(n: int, num: int, den: int, buckets: int):
    """Rows (doc, th, text). Out: each document's set (its name as bucket), then the signatures of some documents by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(num, den)
        for whole in batches:
            for lo, hi in chunks(utf8_of(whole.column(2))[1], _PACK):
                batch = whole.slice(lo, hi - lo)
                prints, sizes, sigs, owners, leasts, at = [], [], [], [], [], 0
                for a, b in chunks(utf8_of(batch.column(2))[1], _CHUNK):
                    sets = shingle_sets(batch.column(2).slice(a, b - a), n)
                    prints.append(fingerprints(sets))
                    sizes += [len(s) for s in sets]
                    sig, owner, least = part_signatures(sets, classes)
                    sigs.append(sig)
                    owners.append((owner + 2 * at).astype(np.uint32))
                    leasts.append(least)
                    at += b - a
                fp, least = np.concatenate(prints), np.concatenate(leasts)
                m, name = batch.num_rows, names(fp)
                # documents are dealt by set
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), decimals(fp), pa.array(least[:, 0]), pa.array(least[:, 1]), pa.nulls(m, pa.binary())], names=_A_NAMES)
                used, blobs = _pack(np.concatenate(sigs), np.concatenate(owners), name, buckets)
                if used:
                    nil = pa.nulls(len(used), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), nil, nil, nil, pa.nulls(len(used), pa.decimal128(38, 0)), nil, nil, pa.array(blobs, pa.binary())], names=_A_NAMES)

    return run


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, name of its set, class)."""
    owners, m = np.frombuffer(blob, "<u4", 2).tolist()
    head = np.frombuffer(blob, "<u8", owners, at := 8)
    count = _of_planes(blob, owners, at := at + 8 * owners)
    low = np.frombuffer(blob, "<u4", m, at := at + 4 * owners)
    high = np.frombuffer(blob, "u1", m, at + 4 * m)
    top = np.uint64(1 << 63)
    return low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), np.repeat(head | top, count), np.repeat((head & top == 0).astype(np.uint8), count)


def local_components(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest vertex of each vertex's component."""
    p = np.arange(n)
    while True:
        u, v = p[x], p[y]
        apart = u != v
        if not apart.any():
            return p
        np.minimum.at(p, np.maximum(u, v)[apart], np.minimum(u, v)[apart])
        while (p[p] != p).any():
            p = p[p]


_B = f"kind int, name long, other long, fp {_FP}, doc long, th long, n long, own long, next long"
_B_NAMES = ["kind", "name", "other", "fp", "doc", "th", "n", "own", "next"]


def _shared(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures that stand with two sets or more: (signature, set, class), each once, in order; and the sets' names."""
    sig, name, more = (np.concatenate(x) for x in zip(*map(_unpack, blobs), strict=True))
    order = np.argsort(sig)
    twin = np.zeros(len(sig), bool)
    same = sig[order[1:]] == sig[order[:-1]]
    twin[1:] |= same
    twin[:-1] |= same
    few = order[twin]
    sig, more = sig[few], more[few]
    who, of = np.unique(name[few], return_inverse=True)
    few = np.lexsort((more, of, sig))
    sig, of, more = sig[few], of[few], more[few]
    first = np.r_[True, (sig[1:] != sig[:-1]) | (of[1:] != of[:-1])] if len(sig) else np.zeros(0, bool)
    sig, of, more = sig[first], of[first], more[first]
    several = np.zeros(len(sig), bool)
    same = sig[1:] == sig[:-1]
    several[1:] |= same
    several[:-1] |= same
    return sig[several], of[several], more[several], who


def _rows(name: np.ndarray, other: np.ndarray | None = None, n: np.ndarray | None = None, own: np.ndarray | None = None) -> pa.RecordBatch:
    m = len(name)
    nil = pa.nulls(m, pa.int64())
    found = (nil if x is None else pa.array(x.astype(np.int64)) for x in (n, own))
    return pa.RecordBatch.from_arrays([pa.array(np.full(m, 1, np.int32)), pa.array(name.view(np.int64)), nil if other is None else pa.array(other.view(np.int64)), pa.nulls(m, pa.decimal128(38, 0)), nil, nil, *found, nil], names=_B_NAMES)


def _support(blobs: list[bytes]) -> pa.RecordBatch:
    """(name, class, parts shared with another set)."""
    _, of, more, who = _shared(blobs)
    both, n = np.unique(of * 2 + more, return_counts=True)
    return _rows(who[both // 2], n=n, own=both % 2)


def _neighbours(blobs: list[bytes]) -> pa.RecordBatch:
    """(name, one that this bucket's signatures connect it with)."""
    sig, of, _, who = _shared(blobs)
    same = np.flatnonzero(sig[1:] == sig[:-1])
    root = local_components(len(who), of[same], of[same + 1])
    inner = np.flatnonzero(root != np.arange(len(who)))
    return _rows(who[inner], who[root[inner]])


def _meet(of_bucket):
    """Rows in order of bucket. Documents pass as kind 0; of each bucket's signatures ``of_bucket`` makes rows of kind 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            docs = batch.filter(batch.column("data").is_null())
            m = docs.num_rows
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), docs.column("bucket"), pa.nulls(m, pa.int64()), *(docs.column(c) for c in ("fp", "doc", "th", "n", "own", "next"))], names=_B_NAMES)
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("data"), strict=True):
                if not blob.is_valid:
                    continue
                if bucket != now and blobs:
                    yield of_bucket(blobs)
                    blobs = []
                now = bucket
                blobs.append(blob.as_py())
        if blobs:
            yield of_bucket(blobs)

    return run


def _link(n: int, num: int, den: int):
    """Rows (work, fp, text) in order of work; out: verified links between fingerprints."""

    def links(prints: list[np.ndarray], texts: list[pa.Array]) -> pa.RecordBatch | None:
        sets = [s for t in texts for a, b in chunks(utf8_of(t)[1], _CHUNK) for s in shingle_sets(t.slice(a, b - a), n)]
        fp = np.concatenate(prints)
        found = link(sets, num, den)
        if not found:
            return None
        a, b = np.array(found).T
        return pa.RecordBatch.from_arrays([decimals(fp[a]), decimals(fp[b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, prints, texts = None, [], []
        for batch in batches:
            work = batch.column("work").to_pylist()
            edges = [0, *(i for i in range(1, len(work)) if work[i] != work[i - 1]), len(work)] if work else []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if work[lo] != now and prints:
                    if (out := links(prints, texts)) is not None:
                        yield out
                    prints, texts = [], []
                now = work[lo]
                prints.append(numbers(batch.column("fp").slice(lo, hi - lo)))
                texts.append(batch.column("text").slice(lo, hi - lo))
        if prints and (out := links(prints, texts)) is not None:
            yield out

    return run


class _Join:
    """One run of the join over (doc, th, text)."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, n: int, num: int, den: int, block_bytes: int):
        self.n, self.num, self.den, self.block_bytes = n, num, den, block_bytes
        self.folders: list[str] = []  # of what is not read any more when the links are written
        self.parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.body = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def _kept(self, df: DataFrame, label: str) -> DataFrame:
        out, folder = written(df, label)
        self.folders.append(folder)
        return out

    def _dealt(self, rows: DataFrame) -> DataFrame:
        buckets = min(4 * self.parts, 65536)
        return rows.mapInArrow(_sign(self.n, self.num, self.den, buckets), _A).repartition(self.parts, "bucket").sortWithinPartitions("bucket")

    def sets(self) -> tuple[DataFrame, DataFrame]:
        """Every document's set (doc, th, n, fp), and (fp, n, text) of each set that shares enough parts with another."""
        met, folder = written(self._dealt(self.body).mapInArrow(_meet(_support), _B), "jaccard-met")
        rows = met.filter("kind = 0").select("doc", "th", "n", "fp", "name", "own", "next")
        support = met.filter("kind = 1").groupBy("name").agg(*[F.sum(F.when(F.col("own") == i, F.col("n")).otherwise(0)).alias(f"s{i}") for i in (0, 1)])
        # one row a set before the join, so that many copies make no large key; the rest of a row follows from its set
        at = F.min(F.struct(F.col("doc").isNull().alias("none"), F.coalesce("doc", F.lit(0)).alias("id"), F.col("th"))).alias("at")
        once = rows.filter("n > 0").groupBy("fp").agg(at, *[F.max(c).alias(c) for c in ("n", "name", "own", "next")])
        some = once.join(support, "name").filter("s0 >= own OR s1 >= next")
        body = self.body.select(F.col("doc").isNull().alias("none"), F.coalesce("doc", F.lit(0)).alias("id"), "th", "text")
        fetched = body.join(some.select("at.*", "fp", "name", "n").hint("shuffle_hash"), ["none", "id", "th"]).dropDuplicates(["none", "id", "th"])
        texts = self._kept(fetched.select("fp", "name", "n", "text"), "jaccard-texts")
        slim = materialize(rows.select("doc", "th", "n", "fp"), "jaccard-rows")
        discard(slim.sparkSession, [folder])
        return slim, texts

    def _linked(self, texts: DataFrame, work: DataFrame) -> DataFrame:
        """Verified links (a, b) within each piece of work (fp, work)."""
        brought = texts.select("fp", "text").join(work.hint("shuffle_hash"), "fp").select("work", "fp", "text").repartition(self.parts, "work").sortWithinPartitions("work", "fp")
        return brought.mapInArrow(_link(self.n, self.num, self.den), f"a {_FP}, b {_FP}")

    def links(self, texts: DataFrame) -> DataFrame:
        """Verified links (a, b) that join all sets that are connected."""
        nothing = texts.select(F.lit(None).cast("long").alias("doc"), F.lit(0).cast("long").alias("th"), "text")
        met = self._dealt(nothing).mapInArrow(_meet(_neighbours), _B).filter("kind = 1")
        near = connected(met.select(F.col("name").alias("a"), F.col("other").alias("b")), "jaccard-near", self.folders)
        member = near.unionByName(near.select(F.col("root").alias("v"), "root").distinct())
        chosen = self._kept(texts.select("fp", "name", "n").join(member, F.col("name") == F.col("v")).select("fp", "n", "root"), "jaccard-chosen")
        large = self._kept(chosen.groupBy("root").agg(F.sum("n").alias("total")).filter(F.col("total") * 8 > self.block_bytes).select("root"), "jaccard-large")
        if large.isEmpty():
            return self._linked(texts, chosen.select("fp", F.xxhash64("root").alias("work")))
        small = self._linked(texts, chosen.join(large, "root", "left_anti").select("fp", F.xxhash64("root").alias("work")))
        return small.unionByName(self._in_blocks(texts, chosen.join(large, "root", "left_semi")))

    def _blocks(self, sets: DataFrame) -> DataFrame:
        """sets (fp, n, root) with band and salt: a block is about as large as a task may hold."""
        kind = F.floor(F.log(F.col("n").cast("double")) / F.lit(Classes(self.num, self.den).log)).cast("int")
        banded = sets.withColumn("band", kind)
        salts = banded.groupBy("root", "band").agg(F.ceil(F.sum("n") * 16 / self.block_bytes).cast("int").alias("salts"))
        return banded.join(salts, ["root", "band"]).withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")).drop("salts")

    def _in_blocks(self, texts: DataFrame, sets: DataFrame) -> DataFrame:
        blocks = self._kept(self._blocks(sets), "jaccard-blocks")
        within = self._kept(self._linked(texts, blocks.select("fp", F.xxhash64("root", "band", "salt").alias("work"))), "jaccard-within")

        def with_parts(links: DataFrame) -> DataFrame:
            of = connected(links, "jaccard-parts", self.folders).select("v", F.col("root").alias("own"))
            return blocks.join(of, F.col("fp") == F.col("v"), "left").select(*blocks.columns, F.coalesce("own", "fp").alias("part"))

        first = with_parts(within)
        heads = first.filter(F.col("part") == F.col("fp")).select("fp", "n", "root")  # one set of each part
        across = self._kept(self._linked(texts, self._blocks(heads).select("fp", F.xxhash64("root", "band", "salt").alias("work"))), "jaccard-across")
        parts = self._kept(with_parts(within.unionByName(across)), "jaccard-parted")
        place = ["root", "band", "salt"]
        held = parts.groupBy(*place).agg(F.min("part").alias("low"), F.max("part").alias("high"))
        left, right = held.select(F.struct(*place).alias("x"), F.col("root"), F.explode(F.array("band", F.col("band") + 1)).alias("near"), "low", "high"), held.select(F.struct(*place).alias("y"), "root", F.col("band").alias("near"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        open_ = left.join(right, ["root", "near"]).filter("x < y AND NOT (low = high AND low2 = high2 AND low = low2)")
        work = open_.select(F.xxhash64("x", "y").alias("work"), F.explode(F.array("x", "y")).alias("block")).select("work", "block.*")
        rest = self._linked(texts, parts.join(work, place).select("fp", "work"))
        return within.unionByName(across).unionByName(rest)


def jaccard_members(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc, th, n, head): each row of docs by id and text hash, the size of its set, and the first document (none, id, th) of
    its component; documents with a null id come after the others. head is null where the set is empty."""
    join = _Join(docs, doc_id, text, n, num, den, block_bytes)
    rows, texts = join.sets()
    linked = connected(join.links(texts), "jaccard-links")
    discard(docs.sparkSession, join.folders)
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), F.coalesce("doc", F.lit(0)).alias("id"), F.col("th")))
    prints = rows.filter("n > 0").groupBy("fp").agg(first.alias("first"), F.count("*").alias("rows"))
    keyed = materialize(prints.join(linked, F.col("fp") == F.col("v"), "left").select("fp", "first", "rows", F.coalesce("root", "fp").alias("key")), "jaccard-keyed")
    heads = keyed.groupBy("key").agg(F.min("first").alias("head"), F.count("*").alias("sets"))
    of_set = hot_join(keyed.select("fp", "rows", "key"), heads, "key", "sets", F.xxhash64("fp")).select("fp", "rows", "head")
    own = rows.withColumn("fp", F.when(F.col("n") > 0, F.col("fp")))
    return hot_join(own, of_set, "fp", "rows", F.xxhash64("doc", "th")).select("doc", "th", "n", "head")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents whose sets link when den * intersection >= num * union."""
    found = jaccard_members(docs, doc_id, text, n, num, den, block_bytes)
    least = F.when(F.col("head").isNull(), F.col("doc")).when(~F.col("head.none"), F.col("head.id"))
    return found.select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), least.alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without those that are linked, directly or not, with a document of a smaller id (null ids come last)."""
    found = jaccard_members(docs, doc_id, text, n, num, den, block_bytes)
    me = F.struct(F.col("doc").isNull().alias("none"), F.coalesce("doc", F.lit(0)).alias("id"), F.col("th"))
    gone = found.filter(F.col("head").isNotNull() & (F.col("head") != me)).select(F.col("doc").alias("_gone"), F.col("th").alias("_th")).distinct().hint("shuffle_hash")
    return docs.join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col("_gone")) & (F.xxhash64(text) == F.col("_th")), "left_anti")
