"""A Spark data source, ``warc``, for archives of gzip members, one record each.

Writing: each task writes its own archives (new names for each attempt), rolled at a size; the driver's commit publishes them
in a manifest, and a failed attempt's files are deleted, so a lost executor leaves no half record to read. The gzip header
of a record has the 'sl' extra field of ISO 28500, its compressed and uncompressed lengths.

Reading: partitions are archives (several small ones together). Filters on record_type, page_id, target_uri and digest are
pushed into the reader: it parses a record's headers from the first bytes of its member, and if they do not match, or if the
payload is not wanted, it goes to the next member by the skip length without decompressing the rest. Archives without skip
lengths are read by decompressing in pieces, so a payload that is not wanted never stands in memory.

Archives of others are read as well: gzip members without skip lengths, plain ``.warc`` files, digests of SHA-1 or SHA-256 in
hexadecimal or base32 digits.

Options: payload = bytes | digest | none. The payload's SHA-256 is taken while reading, and the digest of the record's header is
compared if it is SHA-1 or SHA-256; other algorithms pass unchecked. payload_digest is the SHA-256 in hexadecimal digits: that of
the header where it has one, else that of the payload if it is read (payload = none: null).

Paths may be anything pyarrow.fs opens (file, hdfs, s3, gs). Defined results: a null page id is written as such and read as
null; a null or empty payload has no bytes; control characters in an address are percent-encoded; repeated rows are repeated
records; an empty table or folder gives no rows; other columns of pages are ignored; a payload of any length is one record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .common import hot_join, materialize, open_path

SCHEMA = "page_id long, record_type string, target_uri string, date string, payload_bytes long, payload_digest string, refers_to long, payload binary"
PUSHED = {"record_type", "page_id", "target_uri", "payload_digest"}
MANIFEST = "_manifest.json"
_PIECE = 1 << 18
#: Revisits (about 100 bytes each) that are broadcast.
BROADCAST_ROWS = 100_000


def record_bytes(kind: str, page_id: int | None, uri: str, date: str, digest: str, length: int, refers_to: int | None, payload: bytes) -> bytes:
    """One record as a gzip member with skip lengths."""
    name = lambda x: f"<urn:x-page:{'null' if x is None else x}>"
    clean = "".join(c if c > " " and c != "\x7f" else "%{:02X}".format(ord(c)) for c in uri)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + (b"\r\n" if kind == "revisit" else b"Content-Length: %d\r\n\r\n" % len(payload) + payload)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Target-URI", clean), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(length))]
    if kind == "revisit":
        fields += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(raw) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, roll: int, overwrite: bool):
        self.path, self.roll, self.overwrite = path, roll, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = open_path(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in batches:
                for row in batch.to_pylist() if batch.num_rows < 256 else (r for i in range(0, batch.num_rows, 256) for r in batch.slice(i, 256).to_pylist()):
                    if out is None or size >= self.roll:
                        if out:
                            out.close()
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                    data = record_bytes(row["record_type"], row["page_id"], row["target_uri"] or "", row["date"], row["payload_digest"], row["payload_bytes"], row["refers_to"], row["payload"] or b"")
                    out.write(data)
                    size += len(data)
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = open_path(self.path)
        fs.create_dir(root, recursive=True)
        old = [] if self.overwrite else _manifest(fs, root) or []
        with fs.open_output_stream(f"{root}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(old + [f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = open_path(self.path)
        for m in messages:
            for f in m.files if m else []:
                fs.delete_file(f"{root}/{f}")


def _manifest(fs: pafs.FileSystem, root: str) -> list[str] | None:
    if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
        return json.loads(f.read())


class Archives(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(tuple(files))
        self.files = files


class Member:
    """A gzip member that is decompressed as far as it is asked for."""

    def __init__(self, source):
        self.source, self.inflate, self.out, self.read_bytes = source, zlib.decompressobj(31), b"", 0

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        data = self.source.take(_PIECE)
        if not data:
            raise EOFError("the archive ends inside a record")
        self.out += self.inflate.decompress(data)
        if self.inflate.eof:
            self.source.back(self.inflate.unused_data)
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.out.find(mark)) < 0:
            if not self._more():
                raise EOFError("a record without an end of its headers")
        found, self.out = self.out[: at + len(mark)], self.out[at + len(mark) :]
        return found

    def piece(self, most: int) -> bytes:
        while not self.out and self._more():
            pass
        found, self.out = self.out[:most], self.out[most:]
        return found

    def skip(self) -> None:
        self.out = b""
        while self._more():
            self.out = b""


class Source:
    """Bytes of an archive with a place that can go back over what was read too far, or forward unread."""

    def __init__(self, file):
        self.file, self.left, self.at = file, b"", 0

    def take(self, n: int) -> bytes:
        if self.left:
            found, self.left = self.left[:n], self.left[n:]
        else:
            found = self.file.read(n)
        self.at += len(found)
        return found

    def back(self, data: bytes) -> None:
        self.left, self.at = data + self.left, self.at - len(data)

    def go(self, place: int) -> None:
        ahead = place - self.at
        if 0 <= ahead <= len(self.left):
            self.left = self.left[ahead:]
        else:
            self.left = b""
            self.file.seek(place)
        self.at = place


class Plain:
    """A record of an archive that is not compressed, with the same face as a member."""

    def __init__(self, source: Source):
        self.source, self.out = source, b""

    def _more(self) -> bool:
        data = self.source.take(_PIECE)
        self.out += data
        return bool(data)

    until, piece = Member.until, Member.piece


def _skip_length(head: bytes) -> int | None:
    """Compressed length of a member from its 'sl' field."""
    if len(head) < 12 or not head[3] & 4:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"sl" and size == 8 and at + 12 <= len(head):
            return struct.unpack_from("<I", head, at + 4)[0] or None
        at += 4 + size
    return None


def _number(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


#: Digest algorithms with their names and bytes.
ALGORITHMS = {"sha256": ("sha256", 32), "sha-256": ("sha256", 32), "sha1": ("sha1", 20), "sha-1": ("sha1", 20)}


def digest_of(field: str | None) -> tuple[str, bytes] | None:
    """(algorithm, bytes) of a digest field in hexadecimal or base32 digits; None where it cannot be checked."""
    label, _, text = (field or "").strip().rpartition(":")
    name, size = ALGORITHMS.get(label.lower(), (None, 0))
    try:
        if name and len(text) == 2 * size:
            return name, bytes.fromhex(text)
        found = base64.b32decode(text.upper() + "=" * (-len(text) % 8)) if name else b""
        return (name, found) if len(found) == size > 0 else None
    except ValueError:
        return None


def read_archive(file, wanted, payload: str, by_digest: bool = False) -> Iterator[tuple]:
    """Rows of SCHEMA that ``wanted`` accepts. It is asked by headers alone, where a digest that they do not have is left out, and
    if it asks for digests (``by_digest``) once more when the payload's is known."""
    source = Source(file)
    while head := source.take(64):
        start = source.at - len(head)
        if head.startswith(b"\r\n") or head.startswith(b"\n"):  # blank lines between plain records
            source.back(head.lstrip(b"\r\n"))
            continue
        source.back(head)
        plain = head.startswith(b"WARC/")
        length = None if plain else _skip_length(head)
        member = Plain(source) if plain else Member(source)
        fields = {}
        headers = member.until(b"\r\n\r\n")
        for line in headers.decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        said, kind, left = digest_of(fields.get("warc-payload-digest")), fields.get("warc-type"), int(fields["content-length"])
        if plain:
            length = len(headers) + left
        digest = said[1].hex() if said and said[0] == "sha256" else None
        row = {"record_type": kind, "page_id": _number(fields.get("warc-record-id")), "target_uri": fields.get("warc-target-uri")}
        size, body = (int(fields[x]) if (x := "x-payload-length") in fields else None), None
        if wanted(row | ({"payload_digest": digest} if digest else {})):
            if kind != "revisit" and (payload != "none" or (by_digest and digest is None)):
                if fields.get("content-type", "").startswith("application/http"):
                    left -= len(member.until(b"\r\n\r\n"))
                sha, parts, size = hashlib.sha256(), [], left
                other = hashlib.sha1(usedforsecurity=False) if said and said[0] == "sha1" else None
                while left:
                    if not (part := member.piece(left)):
                        raise EOFError("a record is shorter than it says")
                    left -= len(part)
                    sha.update(part)
                    if other:
                        other.update(part)
                    if payload == "bytes":
                        parts.append(part)
                if said and said[1] != (other or sha).digest():
                    raise ValueError(f"the payload of {fields.get('warc-record-id')} does not match its digest")
                digest, body = sha.hexdigest(), b"".join(parts) if payload == "bytes" else None
            if wanted(row | {"payload_digest": digest}):
                yield (row["page_id"], kind, row["target_uri"], fields.get("warc-date"), size, digest, _number(fields.get("warc-refers-to")), body)
        if length and (plain or not member.inflate.eof):
            if plain:
                source.back(member.out)
            source.go(start + length)
        else:
            member.skip()


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: str, together: int):
        self.path, self.payload, self.together, self.filters = path, payload, together, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                self.filters.append((f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = open_path(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [Archives([root])]
        names = _manifest(fs, root)
        found = fs.get_file_info([f"{root}/{n}" for n in names]) if names is not None else [i for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.type == pafs.FileType.File and i.path.endswith((".warc.gz", ".warc.gz.open", ".warc"))]
        groups, size = [], self.together
        for i in sorted(found, key=lambda i: i.path):
            if size + i.size > self.together:
                groups.append([])
                size = 0
            groups[-1].append(i.path)
            size += i.size
        return [Archives(g) for g in groups]

    def read(self, partition: Archives | None) -> Iterator[tuple]:
        if partition is None:  # no archives at all
            return
        fs, _ = open_path(self.path)
        wanted = lambda row: all(row[k] in v for k, v in self.filters if k in row)
        for name in partition.files:
            with fs.open_input_file(name) as file:
                yield from read_archive(file, wanted, self.payload, any(k == "payload_digest" for k, _ in self.filters))


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "bytes"), int(self.options.get("partition_bytes", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("roll_bytes", 64 << 20)), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Rows of SCHEMA: of equal payloads of ``least`` bytes or more that of the smallest page id is the response.

    Only digests are grouped (with partial sums), and those that many pages share are joined by broadcast; payloads meet their
    verdict in a join by page: the revisits are broadcast if they are few, else the payloads move once."""
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("target_uri"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    keys = own.filter(F.col("payload_bytes") >= least).select("page_id", "payload_digest")
    first = keys.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    met = hot_join(keys, first, "payload_digest", "n", F.xxhash64("page_id")).filter(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = materialize(met.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("first").alias("refers_to")).distinct(), "warc-revisits")
    small = revisits.count() <= BROADCAST_ROWS
    joined = own.join(F.broadcast(revisits) if small else revisits.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return joined.select("page_id", F.when(F.col("_digest").isNull(), "response").otherwise("revisit").alias("record_type"), "target_uri", F.lit(date).alias("date"), "payload_bytes", "payload_digest", "refers_to", F.when(F.col("_digest").isNull(), F.col("payload")).alias("payload"))
