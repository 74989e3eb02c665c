"""Custom importers: a class that turns lines into JSON objects, run by executors as a Python data source.

    class Logs(Importer):
        def parse(self, line):
            return {"level": line[:4], "text": line[5:]}

    register(spark, Logs)
    spark.read.format("logs").load("/folder")        # (file, line, object as JSON text)

    load(ledger, Logs, "/folder")                    # the same as new records of a ledger, or as more of those that it has

Hooks: ``header`` (the first line names the columns of ``split``), ``transform_value(key, text)``, ``resolve_key`` (rows go to the
records whose value of that key they have; see files.resolve).
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import inferred, record_numbers, resolve
from .log import COLUMNS


class Importer:
    """Subclasses name themselves and override parse, or split and transform_value."""

    name = "lines"
    delimiter = ","
    header = True
    resolve_key: str | None = None

    def split(self, line: str) -> list[str]:
        return next(csv.reader(io.StringIO(line), delimiter=self.delimiter, skipinitialspace=True), [])

    def transform_value(self, key: str, text: str):
        return text

    def parse(self, line: str, names: list[str] | None = None) -> dict | None:
        """One object, or None to leave the line out."""
        texts = [t.strip() for t in self.split(line)]
        names = names or [f"column_{i}" for i in range(len(texts))]
        found = {k: self.transform_value(k, t) for k, t in zip(names, texts, strict=False) if t}
        return found or None


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def register(spark: SparkSession, importer: type[Importer]) -> None:
    class Reader(DataSourceReader):
        def __init__(self, path: str):
            self.fs, self.root = pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)

        def partitions(self) -> list[InputPartition]:
            info = self.fs.get_file_info(self.root)
            if info.type == pafs.FileType.File:
                return [_File(self.root)]
            found = self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True))
            return [_File(i.path) for i in sorted(found, key=lambda i: i.path) if i.type == pafs.FileType.File and i.base_name[0] not in "._"]

        def read(self, partition: _File) -> Iterator[tuple]:
            own = importer()
            names = None
            with self.fs.open_input_stream(partition.path) as raw:
                for number, line in enumerate(io.TextIOWrapper(raw, "utf-8")):
                    line = line.rstrip("\r\n")
                    if own.header and names is None:
                        names = [n.strip() for n in own.split(line)]
                    elif line and (found := own.parse(line, names) if names else own.parse(line)) is not None:
                        yield (partition.path, number, json.dumps(found))

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return importer.name

        def schema(self) -> str:
            return "file string, line long, object string"

        def reader(self, schema) -> Reader:
            return Reader(self.options["path"])

    spark.dataSource.register(Source)


def revisions(objects: DataFrame, record: F.Column | str, version: int, annotate: str | None = None) -> DataFrame:
    """(object JSON text, ...) as ADD revisions: arrays are several values, nulls and blanks are left out, texts stay texts unless
    they write a link, tag or timestamp; annotate: a key for the file of each object."""
    fields = objects.select(F.col(record).alias("record") if isinstance(record, str) else record.alias("record"), *(["file"] if annotate else []), F.from_json("object", "map<string,string>").alias("m"))
    pairs = F.explode(F.map_entries(F.map_concat("m", F.create_map(F.lit(annotate), "file")) if annotate else F.col("m")))
    rows = fields.select("record", pairs.alias("e")).select("record", F.col("e.key").alias("key"), F.trim("e.value").alias("v"))
    many = F.when(F.col("v").rlike(r"^\[.*\]$"), F.from_json("v", "array<string>")).otherwise(F.array("v"))
    flat = rows.select("record", F.regexp_replace("key", "[^A-Za-z0-9_]", "_").alias("key"), F.explode(many).alias("v")).filter("v IS NOT NULL AND v <> '' AND key <> '_id_'")
    return flat.select(F.lit(version).cast("long").alias("version"), F.lit(0).cast("long").alias("seq"), F.lit("ADD").alias("action"), "key", "record", *inferred(F.col("v"))).select(*COLUMNS)


def numbered(objects: DataFrame, ledger, version: int, resolve_key: str | None = None) -> DataFrame:
    """objects (object, ...) with _id: new records, or those whose value of ``resolve_key`` an object has."""
    rows = record_numbers(objects, version)
    return rows if resolve_key is None else resolve(rows, ledger.live(), resolve_key, F.get_json_object("object", f"$.{resolve_key}"))


def load(ledger, importer: type[Importer], path: str, annotate: str | None = None) -> DataFrame:
    """What the importer reads, as effective revisions of the ledger, which are committed; returned are those."""
    from ..operators.write import effective

    register(ledger.spark, importer)
    version = ledger.new_record()
    objects = ledger.spark.read.format(importer.name).load(path)
    done = effective(ledger.store.now(), revisions(numbered(objects, ledger, version, importer.resolve_key), "_id", version, annotate))
    ledger.append(done)
    return done
