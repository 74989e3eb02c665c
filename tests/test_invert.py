"""The inverted view over whole tables."""

from ledgerlake import queries

SF = "/root/testdata/sf0.01"


def test_invert_works_over_all_events(spark, monkeypatch):
    made, whole = [], queries.read.invert
    monkeypatch.setattr(queries.read, "invert", lambda rows: made.append(whole(rows)) or made[-1])
    queries.QUERIES["invert"](spark, SF)
    expected = {}
    for r in queries.added(spark, SF).store.triples().select("key", "str", "record").collect():
        expected.setdefault((r["key"], r["str"]), set()).add(r["record"])
    got = [((r["key"], r["str"]), r["record"]) for r in made[0].collect()]
    assert sorted(got) == sorted((k, v) for k, vs in expected.items() for v in vs)
