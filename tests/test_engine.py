"""Verbs against hand-computed results and against a plain fold in Python."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlake.engine import Conflict, Extensions, Ledger, Reader
from ledgerlake.functions.values import Link, Tag, identity, rank_of, string_form
from ledgerlake.operators import order, read, temporal
from ledgerlake.operators.write import DuplicateEntry, InvalidWrite, intents
from ledgerlake.plans.ccl import Page, Sort
from ledgerlake.sources.log import LogStore


def reader(spark, rows):
    """rows: (version, action, key, value, record)."""
    log = intents(spark, [r[1:] for r in rows], 0)
    versions = F.get(F.array(*[F.lit(r[0]) for r in rows]), F.col("seq").cast("int"))
    return Reader(LogStore(log.withColumn("version", versions.cast("long")).cache()), spark)


def ids(df):
    return sorted(r[0] for r in df.collect())


#: Boats (11 to 13) and the harbours (31, 32) they call at.
FLEET = {
    11: {"label": ["Grey Heron"], "tons": [410], "calls": [Link(31), Link(32)]},
    12: {"label": ["Tern of Skye"], "tons": [410], "remark": ["Skerry"]},
    13: {"label": ["Old Skua"], "tons": [95], "calls": [Link(32)]},
    31: {"label": ["Oban"], "depth": [7]},
    32: {"label": ["Skerry Bay"], "depth": [4, 9]},
}


@pytest.fixture(scope="module")
def fleet(spark):
    rows = [(k, v, r) for r, fields in FLEET.items() for k, vs in fields.items() for v in vs]
    return reader(spark, [(i, "ADD", k, v, r) for i, (k, v, r) in enumerate(rows)])


def held(record, path):
    """The values that a path leads to in FLEET."""
    first, _, rest = path.partition(".")
    own = FLEET[record].get(first, [])
    return [v for x in own if isinstance(x, Link) for v in held(x.record, rest)] if rest else own


def those(path, test):
    return [r for r in FLEET if any(test(v) for v in held(r, path))]


def without(path, needle):
    """Records that have a destination (themselves, for a plain key) with no value of the last key that holds the needle."""
    *links, last = path.split(".")
    lacks = lambda r: not any(holds(needle)(v) for v in held(r, last))
    ends = lambda r: [v.record for v in held(r, ".".join(links)) if isinstance(v, Link)] if links else [r]
    return [r for r in FLEET if any(lacks(e) for e in ends(r))]


def holds(needle):
    return lambda v: isinstance(v, str) and needle.lower() in v.lower()


def mean(path, records=FLEET):
    numbers = [v for r in records for v in held(r, path)]
    return sum(numbers) / len(numbers)


@pytest.mark.parametrize(
    "condition, want",
    [
        ("label ~ sk", lambda: those("label", holds("sk"))),
        ("label ~ skk", lambda: []),
        ("label !~ sk", lambda: without("label", "sk")),
        ("calls.label ~ erry", lambda: those("calls.label", holds("erry"))),
        ("calls.label ~ heron", lambda: []),
        ("calls.label !~ erry", lambda: without("calls.label", "erry")),
        ("calls.label !~ a", lambda: without("calls.label", "a")),
        ("calls ~ 3", lambda: []),
        ("calls -> 32", lambda: those("calls", lambda v: v == Link(32))),
        ("tons -> 410", lambda: []),
        ("calls.label = OBAN", lambda: those("calls.label", lambda v: v.lower() == "oban")),
        ("tons | max > 100", lambda: those("tons", lambda v: v > 100)),
        ("calls.depth | avg > 6", lambda: [r for r in FLEET if held(r, "calls.depth") and mean("calls.depth", [r]) > 6]),
        ("tons > avg(tons)", lambda: those("tons", lambda v: v > mean("tons"))),
        ("depth < avg(calls.depth)", lambda: those("depth", lambda v: v < mean("calls.depth"))),
        ("tons = min(tons, label = old skua)", lambda: those("tons", lambda v: v == 95)),
        ("tons > max(tons, label = nobody)", lambda: []),
        ("tons > avg(tons, label = nobody)", lambda: those("tons", lambda v: v > 0)),
        ("$id$ != 13", lambda: [r for r in FLEET if r != 13]),
        ("$id$ = 999", lambda: [999]),
    ],
)
def test_find(fleet, condition, want):
    assert ids(fleet.find(condition)) == sorted(want())


def test_links_and_projection(fleet):
    assert ids(fleet.navigate("calls.label", 11).select("str")) == sorted(held(11, "calls.label"))
    assert sorted(map(tuple, fleet.trace([31, 32]).select("record", "source").collect())) == sorted((v.record, r) for r in FLEET for v in held(r, "calls"))
    t = {r.record: r for r in fleet.table(["calls.label", "tons"], [11, 12]).collect()}
    assert sorted(t[11]["calls.label"]) == sorted(held(11, "calls.label"))
    assert t[12]["calls.label"] == [] and t[12]["tons"] == ["410"]
    assert [r.record for r in fleet.search("label", "sk").collect()] == those("label", holds("sk"))
    assert sorted((r.key, r.str, r.record) for r in fleet.browse(["label", "calls.label"]).collect()) == sorted((k, v, r) for k in ("label", "calls.label") for r in FLEET for v in held(r, k))
    assert [fleet.calculate(f, "calls.depth").first()[0] for f in ("count", "sum")] == [5, 33]


def test_results_for_people(fleet):
    t = fleet.select(["label", "tons"], [11, 13])
    assert [r.record for r in order.sort_result(t, [("tons", True)]).collect()] == [13, 13, 11, 11]
    text = read.pretty(t, ["label", "tons"]).splitlines()
    assert len(text) == 6 and "Old Skua" in text[4] and len({len(x) for x in text}) == 1
    assert fleet.json_array([31], include_id=True) == '[{"$id$":31,"depth":7,"label":"Oban"}]' and fleet.json_array([77]) == "[]"


def test_order_keeps_records_without_the_key_last(fleet):
    order = lambda s, page=None: [r.record for r in fleet.find(None, [s], page).collect()]
    assert order(Sort("tons")) == [13, 11, 12, 31, 32] and order(Sort("tons", False)) == [11, 12, 13, 31, 32]
    assert order(Sort("tons"), Page(1, 2)) == [11, 12]
    assert order(Sort("calls.depth", False)) == [11, 13, 12, 31, 32]  # 9, 7, 4 before 9, 4


HISTORY = [(10, "ADD", "k", "a", 1), (20, "ADD", "k", "b", 1), (30, "REMOVE", "k", "a", 1), (40, "ADD", "k", "a", 1), (50, "REMOVE", "k", "b", 1), (60, "REMOVE", "k", "a", 1)]


def test_history(spark):
    r = reader(spark, HISTORY)
    sets = {x.version: x["values"] for x in r.chronologize("k", 1).collect()}
    assert sets == {10: ["a"], 20: ["a", "b"], 30: ["b"], 40: ["a", "b"], 50: ["a"]}
    assert {x.version for x in r.chronologize("k", 1, 20, 40).collect()} == {20, 30}
    for at, live in [(5, []), (10, ["a"]), (25, ["a", "b"]), (30, ["b"]), (60, [])]:
        assert sorted(x.str for x in r.select("k", at=at).collect()) == live
    assert {(x.str, x.action) for x in r.diff(10, 30).collect()} == {("a", "REMOVED"), ("b", "ADDED")}
    assert {(x.str, x.action) for x in r.diff(20).collect()} == {("a", "REMOVED"), ("b", "REMOVED")}
    assert [x.version for x in r.review(1, "k", 20, 50).orderBy("version").collect()] == [20, 30, 40]
    assert ids(r.inventory()) == [1] and r.ping([1, 2]).filter("live").count() == 0
    assert r.get("k", at=45).first().str == "a"  # the last added


MATRIX = [7, 7.0, 7.25, "7", "Mast", "mast", "MAST", True, Link(7), Tag("mast"), datetime(2024, 1, 1), 2, 30, -4, "9%", "yawl", "mast\n"]


def expected(op, stored, values):
    """The model: one stored value under an operator."""
    v = values[0]

    def key(x):
        r = rank_of(x)
        return (r, float(x) if r == 0 else x.record if r == 1 else string_form(x).lower())

    import re

    return {
        "=": lambda: key(stored) == key(v),
        "!=": lambda: key(stored) != key(v),
        ">": lambda: key(stored) > key(v),
        ">=": lambda: key(stored) >= key(v),
        "<": lambda: key(stored) < key(v),
        "<=": lambda: key(stored) <= key(v),
        "bw": lambda: key(v) <= key(stored) < key(values[-1]),
        "regex": lambda: bool(re.fullmatch(string_form(v), string_form(stored))),
        "nregex": lambda: not re.fullmatch(string_form(v), string_form(stored)),
    }[op]()


def test_operators_by_types(spark):
    rows = [(i, "ADD", "v", x, i) for i, x in enumerate(MATRIX)]
    seen = {}
    for i, x in enumerate(MATRIX):  # a record that holds all of them, each identity once
        if identity(x) not in seen:
            seen[identity(x)] = x
            rows.append((100 + i, "ADD", "v", x, 99))
    r = reader(spark, rows)
    from ledgerlake.plans.ccl import where

    for op, v in itertools.product(["=", "!=", ">", ">=", "<", "<=", "regex", "nregex"], [7, 7.25, "mast", Link(7), True, "k"]):
        want = [i for i, x in enumerate(MATRIX) if expected(op, x, [v])]
        want += [99] * any(expected(op, x, [v]) for x in seen.values())
        assert ids(r.find(where("v").op(op, v))) == want, (op, v)
    assert ids(r.find(where("v").op("bw", 2, 7.25))) == [i for i, x in enumerate(MATRIX) if expected("bw", x, [2, 7.25])] + [99]


def test_set_order_in_chronologies(spark):
    """Against a fold in Python, with many values, several changes a version, and versions without a net change."""
    rng = random.Random(11)
    rows, live, sets = [], {}, {}
    for version in range(1, 60):
        for _ in range(rng.choice([1, 1, 2])):
            record, value = rng.randint(1, 2), rng.randint(1, 4)
            now = live.setdefault(record, set())
            action = "REMOVE" if value in now else "ADD"
            if any(r[0] == version and r[3:] == (value, record) for r in rows):
                continue
            (now.discard if action == "REMOVE" else now.add)(value)
            rows.append((version, action, "k", value, record))
            sets[record, version] = sorted(map(str, now))
    r = reader(spark, rows)
    for start, end in ((None, None), (20, 41), (58, None)):
        got = {(x.record, x.version): x["values"] for x in r.chronologize("k", start=start, end=end).collect()}
        assert got == {k: v for k, v in sets.items() if v and (start or 0) <= k[1] < (end or 99)}
    times = spark.createDataFrame([(rec, "k", at) for rec in (1, 2) for at in (0, 7, 30, 59)], "record long, key string, at long")
    got = {}
    for x in temporal.as_of_sets(r.store.revisions(["k"]), times).collect():
        got.setdefault((x.record, x.at), []).append(x.str)
    want = {(rec, at): next((sets[rec, v] for v in range(at, 0, -1) if (rec, v) in sets), []) for rec in (1, 2) for at in (0, 7, 30, 59)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_sides_of_and_are_judged_by_any_value(spark):
    r = reader(spark, [(1, "ADD", "age", 4, 1), (2, "ADD", "age", 20, 1)])
    assert ids(r.find("age > 10 and age < 5")) == [1]


def test_random_logs_fold_like_the_model(spark):
    rng = random.Random(7)
    rows, live, snapshots = [], set(), {}
    for version in range(1, 41):
        key, value, record = rng.choice("ab"), rng.choice([1, 2, "x"]), rng.randint(1, 3)
        triple = (key, identity(value), record)
        action = "REMOVE" if triple in live else "ADD"
        (live.discard if action == "REMOVE" else live.add)(triple)
        rows.append((version, action, key, value, record))
        snapshots[version] = set(live)
    r = reader(spark, rows)
    for at in (1, 13, 27, 40):
        assert {(x.key, x.vid, x.record) for x in r.select(at=at).collect()} == snapshots[at]


def test_phrases(spark):
    r = reader(spark, [(1, "ADD", "t", "a a a b", 1), (2, "ADD", "t", "xay bzz", 2), (3, "ADD", "t", Tag("a b"), 3)])
    for needle, want in [("a a b", [1]), ("ay bz", [2]), ("a b", [1, 2]), ("   ", []), ("A B", [1, 2])]:
        from ledgerlake.plans.ccl import where

        assert ids(r.find(where("t").op("contains", needle))) == want, needle


def test_calculations(spark):
    r = reader(spark, [(1, "ADD", "n", 1, 1), (2, "ADD", "n", 2, 1), (3, "ADD", "n", 2, 2), (4, "ADD", "s", "x", 1)])
    value = lambda *a, **k: r.calculate(*a, **k).first()[0]
    assert (value("sum", "n"), value("count", "n"), value("max", "n"), value("min", "n")) == (5, 3, 2, 1)
    assert str(value("avg", "n")) == "1.6666666667" and value("avg", "n", 1) == 1.5 and value("avg", "n", [2]) == 2
    assert value("avg", "none") is None and value("avg", "none", [1]) == 0 and value("count", "none") == 0 and value("sum", "none") is None
    with pytest.raises(Exception, match="not a number"):
        value("sum", "s")
    big = reader(spark, [(1, "ADD", "n", 2 * 10**18, 1), (2, "ADD", "n", 3 * 10**18, 2), (3, "ADD", "m", 2**53 + 1, 1)])
    assert big.calculate("sum", "n").first()[0] == 5 * 10**18 and big.calculate("sum", "m").first()[0] == 2**53 + 1


@pytest.fixture
def ledger(spark, tmp_path):
    ticks = itertools.count()
    return Ledger(spark, str(tmp_path), clock=lambda: datetime(2024, 1, 1) + timedelta(seconds=next(ticks)))


def test_writes(ledger):
    assert ledger.add("k", 1, 1) and not ledger.add("k", 1.0, 1) and ledger.add("k", "b", 1)
    before = ledger.time()
    assert not ledger.remove("k", "zzz", 1) and ledger.remove("k", "b", 1)
    ledger.set("k", 5, 1)
    assert [x.str for x in ledger.select("k", 1).collect()] == ["5"]
    ledger.reconcile("k", 1, [5, 6, 7])
    assert sorted(x.str for x in ledger.select("k", 1).collect()) == ["5", "6", "7"]
    assert ledger.verify_and_swap("k", 5, 1, 8) and not ledger.verify_and_swap("k", 5, 1, 9)
    ledger.revert(["k"], 1, before)
    assert sorted(x.str for x in ledger.select("k", 1).collect()) == ["1", "b"]
    ledger.clear(None, 1)
    assert ledger.select(of=1).count() == 0 and ledger.holds(1)
    assert [x.str for x in ledger.select("k", 1, at=before).orderBy("str").collect()] == ["1", "b"]


def test_insert_links_and_uniqueness(ledger):
    a, b = ledger.insert('[{"name": "a", "n": [1, 2], "none": null}, {"name": "b", "like": "@name = a@", "$id$": 77}]')
    assert b == 77 and ids(ledger.find(f"like -> {a}")) == [77]
    assert ledger.find_or_add("name", "a") == a
    assert ledger.find_or_insert("name = c", {"name": "c"}) not in (a, b)
    ledger.add("name", "a", 78)
    with pytest.raises(DuplicateEntry):
        ledger.find_or_add("name", "a")
    for bad in [{"x": {"y": 1}}, {"x": " "}, {"x-y": 1}]:
        with pytest.raises(InvalidWrite):
            ledger.insert(bad)
    with pytest.raises(InvalidWrite):
        ledger.link("self", 5, 5)
    ledger.consolidate(a, 78)
    assert ledger.select(of=78).count() == 0 and ids(ledger.find("name = a")) == [a]
    row = ledger.jsonify(77, include_id=True).first().json
    assert row == f'{{"$id$":77,"like":"@{a}","name":"b"}}'


def test_outcomes_of_several_records(ledger):
    assert ledger.add("k", 1, 5) and ledger.add("k", 1, [5, 6]) == {5: False, 6: True}
    assert ledger.remove("k", 1, [5, 7]) == {5: True, 7: False}
    fresh = ledger.set("k", 2)
    assert ids(ledger.find("k = 2")) == [fresh]
    assert ledger.insert({"k": [1, 9]}, into=[6, 8]) == {6: False, 8: True} and ids(ledger.find("k = 9")) == [8]
    assert ledger.insert({"k": 9}, into=8) is False and ledger.changes(8).first().changes == ["added k as 1", "added k as 9"]


VERBS = {
    "add": lambda g, r: g.add("k", "a", r),
    "remove": lambda g, r: g.remove("k", "a", r),
    "set": lambda g, r: g.set("k", "b", r),
}


def test_a_transaction_leaves_what_its_verbs_left(spark, tmp_path):
    """Every pair of verbs, inside one transaction and outside of it."""
    at = itertools.count()
    inside, outside = (Ledger(spark, str(tmp_path), e, clock=lambda: datetime(2024, 1, 1) + timedelta(seconds=next(at))) for e in ("in", "out"))
    inside.stage()
    for i, (x, y) in enumerate(itertools.product(VERBS, VERBS)):
        for verb in (x, y):
            assert VERBS[verb](inside, i) == VERBS[verb](outside, i), (x, y)
    state = lambda g: sorted((r.record, r.str) for r in g.select("k").collect())
    before = state(inside)
    inside.commit()
    assert before == state(inside) == state(outside) and inside.review().select("version").distinct().count() == 1
    inside.stage()
    inside.clear(["k"], None)
    assert state(inside) == []
    inside.abort()
    assert state(inside) == before


def test_of_two_writers_one_wins(spark, tmp_path):
    one, two = (Ledger(spark, str(tmp_path)) for _ in range(2))
    one.add("k", 1, 1)
    with pytest.raises(Conflict):
        two.add("k", 2, 1)
    manifest = one.manifest
    one._claim(2, manifest)
    with pytest.raises(Conflict):  # both past every check
        two._claim(2, manifest)
    assert Ledger(spark, str(tmp_path)).commits() == [1, 2]
    two.refresh()
    assert two.add("k", 2, 1) and sorted(x.str for x in two.select("k", 1).collect()) == ["1", "2"]
    assert Ledger(spark, str(tmp_path), "other").inventory().count() == 0


def test_new_ids_are_never_old_ones(spark, tmp_path):
    fixed = Ledger(spark, str(tmp_path), clock=lambda: datetime(2024, 1, 1))
    seen = fixed.insert([{"n": i} for i in range(3)])
    fixed.add("k", 1, fixed.time() + 5)  # an id of the caller's own, ahead of the clock
    seen += [fixed.time() + 5, *fixed.insert([{"n": i} for i in range(9)]), fixed.add("n", 1)]
    again = Ledger(spark, str(tmp_path), clock=lambda: datetime(2024, 1, 1))
    seen += again.insert([{"n": 1}, {"n": 2}])
    assert len(set(seen)) == len(seen) == 16 and again.inventory().count() == 16


def test_compaction_and_crashes(ledger, spark, monkeypatch):
    ledger.add("k", 1, 1)
    ledger.add("k", 2, 1)
    early = ledger.version
    ledger.remove("k", 1, 1)
    root = ledger.root.rsplit("/", 1)[0]

    def die(*_):
        raise OSError("gone")

    monkeypatch.setattr(Ledger, "_claim", die)
    for step in (ledger.compact, lambda: ledger.add("k", 9, 1)):
        with pytest.raises(OSError):
            step()
    monkeypatch.undo()
    again = Ledger(spark, root)
    assert again.review(1).count() == 3 and [x.str for x in again.select("k", 1).collect()] == ["2"]
    again.compact()
    assert again.review(1).count() == 3  # old and new folders stand, one of them counts
    again.add("k", 3, 1)
    assert again.vacuum() > 0 and len(again.commits()) == 1
    last = Ledger(spark, root)
    for g in (again, last):
        assert sorted(x.str for x in g.select("k", 1).collect()) == ["2", "3"] and sorted(x.str for x in g.select("k", 1, at=early).collect()) == ["1", "2"]
        assert g.review(1).count() == 4 and ids(g.find("k = 3")) == [1]


def test_extensions(fleet):
    ext = Extensions()
    ext.register("sizes", above=lambda r, n: r.find(f"tons > {n}").count())
    assert ext.invoke("sizes", "above", fleet, 100) == 2
    with pytest.raises(LookupError):
        ext.invoke("sizes", "none", fleet)
