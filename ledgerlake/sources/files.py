"""Files to revisions and back: delimited text and JSON in, delimited text, workbooks' rows and JSON out."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.read import latest, wide
from .log import COLUMNS, encoded

_TYPES = ["type", "num", "str", "vid"]


def inferred(text: Column) -> list[Column]:
    """type, num, str and vid of a text by the rules of functions.values.infer, as expressions."""
    quoted = text.rlike("""^"[^"]*"$|^'[^']*'$""")
    link, boolean, tag = text.rlike(r"^@-?[0-9]+@?$"), F.lower(text).isin("true", "false"), text.rlike("^`.+`$")
    stamp, number = text.rlike(r"^\|[^|]+\|$"), text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    inner = F.substr(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))
    as_struct = lambda c, kind: F.struct(*encoded(c, kind))
    whole = text.rlike(r"^[+-]?\d{1,18}$")
    value = (
        F.when(quoted, as_struct(inner, "string"))
        .when(link, as_struct(F.regexp_extract(text, "-?[0-9]+", 0).try_cast("long"), "LINK"))
        .when(boolean, as_struct(F.lower(text).try_cast("boolean"), "boolean"))
        .when(tag, as_struct(inner, "TAG"))
        .when(stamp & inner.try_cast("timestamp_ntz").isNotNull(), as_struct(inner.try_cast("timestamp_ntz"), "timestamp_ntz"))
        .when(whole, as_struct(text.try_cast("long"), "long"))
        .when(number, as_struct(text.try_cast("double"), "double"))
        .otherwise(as_struct(text, "string"))
    )
    return [value[c].alias(c) for c in _TYPES]


def shred_texts(df: DataFrame, record: Column, version: int, annotate: str | None = None) -> DataFrame:
    """Text columns as ADD revisions: trimmed, blanks left out, types inferred. annotate: a key for each row's file."""
    frame = df.select(record.alias("_record"), *([F.col("_metadata.file_path").alias(annotate)] if annotate else []), *df.columns)
    names = [c for c in frame.columns if c != "_record"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.trim(F.col(f"`{c}`").cast("string")).alias("v")) for c in names]))
    rows = frame.select("_record", pairs.alias("p")).select("_record", F.regexp_replace("p.key", r"[^A-Za-z0-9_]", "_").alias("key"), F.col("p.v").alias("v")).filter("v IS NOT NULL AND v <> ''")
    typed = rows.select(F.lit(version).cast("long").alias("version"), F.lit(0).cast("long").alias("seq"), F.lit("ADD").alias("action"), "key", F.col("_record").alias("record"), *inferred(F.col("v")))
    return typed.select(*COLUMNS)


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True) -> DataFrame:
    return spark.read.csv(path, sep=delimiter, header=header, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=False)


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A column of text for each key of the objects, which are one a line or, without ``lines``, alone or in an array in each
    file; numbers keep their text."""
    return spark.read.json(path, multiLine=not lines, primitivesAsString=True)


def record_numbers(df: DataFrame, first: int) -> DataFrame:
    """df with _id: new record ids, unique without a shuffle."""
    return df.withColumn("_id", F.lit(first) + F.monotonically_increasing_id())


def resolve(rows: DataFrame, live: DataFrame, key: str, text: Column | None = None) -> DataFrame:
    """Rows with _id: a row goes to every record whose key equals its value (``text``, or the column of the key's name); if it has
    a value and none does, it is dropped."""
    text = F.trim(F.col(f"`{key}`") if text is None else text)
    have = live.filter(F.col("key") == key).select(F.col("vid").alias("_vid"), F.col("record").alias("_known"))
    keyed = rows.withColumn("_want", F.when(text != "", inferred(text)[3]))
    joined = keyed.join(have, F.col("_want") == F.col("_vid"), "left")
    return joined.filter("_want IS NULL OR _known IS NOT NULL").withColumn("_id", F.coalesce("_known", "_id")).drop("_want", "_vid", "_known")


def lines_as_table(spark: SparkSession, lines: list[str], delimiter: str = ",") -> DataFrame:
    """Delimited lines that the driver holds, the first one of names, as a table of texts."""
    import csv

    names = [n.strip() for n in next(csv.reader(lines[:1], delimiter=delimiter), [])]
    frame = spark.createDataFrame([(x,) for x in lines[1:] if x.strip()], "line string")
    schema = ", ".join(f"`{n}` string" for n in names)
    return frame.select(F.from_csv("line", schema, {"sep": delimiter, "quote": '"', "escape": '"'}).alias("r")).select("r.*")


def export_table(t: DataFrame, keys: list[str], include_id: bool = True, single: bool = False) -> DataFrame:
    """(record, one text column per key): several values are joined by commas."""
    w = wide(latest(t) if single else t, keys)
    out = w.select(*(["record"] if include_id else []), *[F.array_join(f"`{k}`", ",").alias(k) for k in keys])
    return out


def write_delimited(df: DataFrame, path: str, delimiter: str = ",") -> None:
    df.write.csv(path, sep=delimiter, header=True, quote='"', escape='"')


#: The parts of a workbook beside its sheet.
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="export" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def write_workbook(df: DataFrame, path: str, most: int = 1_048_575) -> None:
    """A result as one workbook of one sheet, to any file system that Spark knows. A sheet cannot hold more than ``most`` rows
    beside its head; a larger result is refused. Rows pass through the driver one partition at a time."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows; write delimited text instead")
    clean = lambda v: escape("".join(c for c in str(v) if c >= " " or c in "\t\n"))
    number = lambda v: isinstance(v, int | float | Decimal) and not isinstance(v, bool)
    cell = lambda v: "<c/>" if v is None else f"<c><v>{v}</v></c>" if number(v) else f'<c t="inlineStr"><is><t xml:space="preserve">{clean(v)}</t></is></c>'
    line = lambda vs: ("<row>" + "".join(map(cell, vs)) + "</row>").encode()
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _PARTS.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
        with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            sheet.write(line(df.columns))
            for row in df.toLocalIterator():
                sheet.write(line(row))
            sheet.write(b"</sheetData></worksheet>")
    context = df.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(whole.getvalue()))
    out.close()
