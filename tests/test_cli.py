import io

import pytest

from ledgerlake.cli import parser, run
from ledgerlake.engine import Ledger
from ledgerlake.sources import importer


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")
    (folder / "a.csv").write_text("sku,name,n\n1,x,5\n2,y,\n")
    (folder / "b.csv").write_text("sku,color\n1,red\n9,lost\n")
    (folder / "c.json").write_text('[{"name": "z", "tags": ["t", "u"], "none": null}]')
    do = lambda *a: run(spark, parser().parse_args(list(a)))
    root = str(folder / "ledger")
    assert do("import", root, str(folder / "a.csv"), "--dry-run") == 2
    do("import", root, str(folder / "a.csv"))
    do("import", root, str(folder / "b.csv"), "--resolve", "sku")
    do("import", root, str(folder / "c.json"), "--json", "--annotate")
    return root, do, folder


def test_import_resolves_and_annotates_every_kind(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "ledger")
    do = lambda *a: run(spark, parser().parse_args(list(a)))
    (tmp_path / "a.csv").write_text("sku,name\n1,x\n2,y\n")
    do("import", root, str(tmp_path / "a.csv"), "--annotate", "source")
    (tmp_path / "b.json").write_text('[{"sku": 1, "color": "red"}, {"sku": 9, "color": "lost"}]')
    do("import", root, str(tmp_path / "b.json"), "--json", "--resolve", "sku")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "d.txt").write_text("2 7\n9 8\n")
    do("import", root, str(tmp_path / "c"), "--importer", "tests.test_cli:Weights")
    monkeypatch.setattr("sys.stdin", io.StringIO("sku,name\n5,z\n"))
    do("import", root, "-")
    ledger = Ledger(spark, root)
    assert ledger.find("source like %a.csv").count() == 2 and ledger.find("color = red and name = x").count() == 1
    assert ledger.find("color = lost").count() == 0 and ledger.find("weight = 7 and name = y").count() == 1
    assert ledger.find("weight = 8").count() == 0 and ledger.find("sku = 5 and name = z").count() == 1
    do("export", root, str(tmp_path / "o"), "--keys", "sku", "--condition", "sku > 0", "--order", "sku desc", "--no-id")
    lines = [x for p in sorted((tmp_path / "o").glob("part*.csv")) for x in p.read_text().split()]
    assert [x for x in lines if x != "sku"] == ["5", "2", "1"]
    do("compact", root)
    assert do("vacuum", root) > 0 and Ledger(spark, root).find("sku > 0").count() == 3


class Weights(importer.Importer):
    name = "weights"
    header = False
    resolve_key = "sku"

    def parse(self, line, names=None):
        sku, weight = line.split()
        return {"sku": int(sku), "weight": int(weight)}


def test_import(spark, root):
    ledger = Ledger(spark, root[0])
    assert ledger.find("color = red and name = x").count() == 1 and ledger.find("color = lost").count() == 0
    assert sorted(r.str for r in ledger.select("tags", "name = z").collect()) == ["t", "u"]
    assert ledger.find("__datasource like %c.json").count() == 1


def test_export(spark, root):
    path, do, folder = root
    do("export", path, str(folder / "out"), "--condition", "n > 1", "--keys", "name,n", "--no-id")
    assert [tuple(r) for r in spark.read.csv(str(folder / "out"), header=True).collect()] == [("x", "5")]
    do("export", path, str(folder / "j"), "--condition", "name = y", "--format", "json", "--no-id")
    assert [r.value for r in spark.read.text(str(folder / "j")).collect()] == ['{"name":"y","sku":2}']


class Levels(importer.Importer):
    name = "levels"
    header = False

    def parse(self, line, names=None):
        level, _, text = line.partition(" ")
        return {"level": level, "text": text} if text else None


def test_custom_importer(spark, tmp_path):
    importer.register(spark, Levels)
    (tmp_path / "log.txt").write_text("WARN low disk\nnothing\nINFO ok then\n")
    got = spark.read.format("levels").load(str(tmp_path))
    assert sorted((r.line, r.object) for r in got.collect()) == [(0, '{"level": "WARN", "text": "low disk"}'), (2, '{"level": "INFO", "text": "ok then"}')]
    rows = importer.revisions(got, "line", 1)
    assert {(r.record, r.key, r.str) for r in rows.collect()} == {(0, "level", "WARN"), (0, "text", "low disk"), (2, "level", "INFO"), (2, "text", "ok then")}
