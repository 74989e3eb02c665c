import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators.read import project
from ledgerlake.sources import files
from ledgerlake.sources.log import LogStore, fold
from ledgerlake.streaming.live import materialized_view, read_log, write_events


def test_delimited_texts_are_trimmed_inferred_and_resolved(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,v\n1, "x, y" ,true\n2,,@5\n3,z,`t`\n')
    rows = files.record_numbers(files.read_delimited(spark, str(tmp_path / "a.csv")), 100)
    log = files.shred_texts(rows.drop("_id"), F.col("id").cast("long"), 1)
    got = {(r.record, r.key): (r.type, r.str) for r in fold(log).collect()}
    assert got[1, "name"] == ("STRING", "x, y") and got[1, "v"] == ("BOOLEAN", "true") and got[2, "v"] == ("LINK", "@5") and got[3, "v"] == ("TAG", "t") and got[1, "id"] == ("LONG", "1")
    assert (2, "name") not in got
    more = spark.createDataFrame([("2", "new"), ("9", "dropped"), (None, "free")], "id string, name string").withColumn("_id", F.lit(500).cast("long"))
    assert sorted((r.name, r._id) for r in files.resolve(more, fold(log), "id").collect()) == [("free", 500), ("new", 2)]


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 2)], "record long, name string, n int")
    log = files.shred_texts(rows.select("name", "n", "record"), F.col("record"), 1)
    out = files.export_table(project(LogStore(log), ["name", "n"], None), ["name", "n"])
    assert [tuple(r) for r in out.collect()] == [(1, "a", "2")]
    files.write_workbook(out, str(tmp_path / "x.xlsx"))
    sheet = zipfile.ZipFile(tmp_path / "x.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert "<c><v>1</v></c>" in sheet and ">a</t>" in sheet
    with pytest.raises(ValueError):
        files.write_workbook(out, str(tmp_path / "y.xlsx"), most=0)


def test_stream_view_and_events(spark, tmp_path):
    from ledgerlake.operators.write import intents

    one = intents(spark, [("ADD", "k", 1, 1), ("ADD", "k", 2, 1)], 10)
    two = intents(spark, [("REMOVE", "k", 1, 1)], 20)
    two.write.parquet(str(tmp_path / "log"))  # the later version arrives first
    one.write.mode("append").parquet(str(tmp_path / "log"))
    materialized_view(read_log(spark, str(tmp_path / "log"), 1), str(tmp_path / "view"), str(tmp_path / "cp")).awaitTermination()
    last = max(int(p.name) for p in (tmp_path / "view").iterdir() if p.name.isdigit())
    live = spark.read.parquet(str(tmp_path / "view" / str(last))).filter("action = 'ADD'")
    assert [r.str for r in live.collect()] == ["2"]
    seen = []
    write_events(read_log(spark, str(tmp_path / "log")), lambda df, _: seen.extend(df.collect()), str(tmp_path / "cp2")).awaitTermination()
    assert sorted(r.str for r in seen) == ["1", "1", "2"]
