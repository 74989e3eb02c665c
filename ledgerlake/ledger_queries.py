"""Registered queries over a real ledger: tables of the driver are committed to one in the shared folder, then read or written."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .engine import Extensions, Ledger
from .operators import temporal, write
from .plans.times import to_micros
from .queries import _ADDED, _SET, QUERIES, T1, T2, _rows, added, num, query, set_log
from .sources import files, importer
from .sources.log import encoded, fold, shred
from .sources.shared import new_folder

CLOCK = lambda: datetime(2024, 3, 1)


def _named() -> tuple:
    return F.col("record").alias("user_id"), F.col("key").alias("event_type")


def empty(spark: SparkSession) -> Ledger:
    return Ledger(spark, new_folder(spark, "ledger"), clock=CLOCK)


def event_ledger(spark: SparkSession, sf: str) -> Ledger:
    """events as ADDs, in three commits by time."""
    ledger, log = empty(spark), added(spark, sf).store.log
    edges = [-(2**62), to_micros(T1), to_micros(T2), 2**62]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        ledger.import_revisions(log.filter((F.col("version") >= low) & (F.col("version") < high)))
    return ledger


def nation_ledger(spark: SparkSession, sf: str) -> Ledger:
    """Nations and regions by insert: JSON objects with named ids, and links that conditions resolve."""
    ledger = empty(spark)
    ledger.insert([{"$id$": 100 + r.r_regionkey, "rid": r.r_regionkey, "title": r.r_name} for r in spark.read.parquet(f"{sf}/region.parquet").collect()])
    ledger.insert([{"$id$": r.n_nationkey, "name": r.n_name, "marks": [r.n_nationkey, "x", None], "region": f"@rid = {r.n_regionkey}@"} for r in spark.read.parquet(f"{sf}/nation.parquet").collect()])
    return ledger


@query(f"SELECT user_id, event_type, value FROM ({_ADDED}) WHERE ts <= TIMESTAMP '{T1}'")
def ledger_read(spark, sf):
    return event_ledger(spark, sf).select(at=T1).select(*_named(), num())


@query(f"SELECT user_id, event_type, arg_max(value, ts) AS value FROM ({_ADDED}) GROUP BY ALL")
def ledger_latest(spark, sf):
    return event_ledger(spark, sf).get().select(*_named(), num())


_SET_50 = f"SELECT user_id, event_type, value FROM ({_ADDED}) WHERE event_type <> 'signup' UNION ALL SELECT DISTINCT user_id, 'signup', 50.0 FROM events WHERE event_type = 'signup'"


def _to_50(ledger: Ledger) -> DataFrame:
    target = ledger.store.revisions(["signup"]).select("key", "record").distinct().select("key", "record", *encoded(F.lit(50.0), "double"))
    return write.set_values(ledger.store.now(["signup"]), target, ledger.next_version())


@query(_SET_50)
def ledger_compacted(spark, sf):
    """A snapshot and a commit after it: every signup is set to 50."""
    ledger = event_ledger(spark, sf)
    ledger.compact()
    ledger.append(_to_50(ledger))
    return ledger.select().select(*_named(), num())


@query(f"SELECT user_id, event_type, value FROM ({_ADDED}) WHERE ts <= TIMESTAMP '{T2}' AND event_type = 'signup'")
def ledger_compacted_at(spark, sf):
    """The history before a snapshot stays."""
    ledger = event_ledger(spark, sf)
    ledger.compact()
    ledger.append(_to_50(ledger))
    ledger.vacuum()
    return ledger.select("signup", at=T2).select(*_named(), num())


@query(f"SELECT user_id, value, 1 AS versions FROM ({_ADDED}) WHERE event_type = 'error' AND value > 50")
def txn_rows(spark, sf):
    """One transaction: all errors are cleared, all are added again, then those of 50 or less are removed."""
    ledger = event_ledger(spark, sf)
    errors = ledger.store.triples(["error"])
    rows = lambda action, of: of.select(F.lit(0).cast("long").alias("version"), F.lit(0).cast("long").alias("seq"), F.lit(action).alias("action"), "key", "record", "type", "num", "str", "vid")
    before = ledger.version
    ledger.stage()
    ledger.clear(["error"], None)
    ledger.append(rows("ADD", errors))
    ledger.append(rows("REMOVE", errors.filter("num <= 50")))
    ledger.commit()
    versions = ledger.review(key="error").filter(F.col("version") > before).select("version").distinct().count()
    return ledger.select("error").select(F.col("record").alias("user_id"), num(), F.lit(versions).alias("versions"))


@query(f"SELECT user_id, value FROM ({_ADDED}) WHERE event_type = 'error'")
def txn_aborted(spark, sf):
    ledger = event_ledger(spark, sf)
    ledger.stage()
    ledger.clear(["error"], None)
    left = ledger.select("error").limit(1).count()
    ledger.abort()
    return ledger.select("error").filter(F.lit(left) == 0).select(F.col("record").alias("user_id"), num())


# ---- writes ------------------------------------------------------------------------------------------------------------
@query(f"SELECT 'REMOVE' AS action, user_id, event_type, value FROM ({_ADDED}) WHERE event_type = 'click' AND value > 100")
def remove_rows(spark, sf):
    """Removes of live values, and of values that are not, which take no effect."""
    log = added(spark, sf).store.revisions(["click"])
    wanted = log.filter("num > 100").withColumn("action", F.lit("REMOVE"))
    absent = wanted.withColumn("vid", F.concat("vid", F.lit("0001"))).withColumn("record", F.col("record") + 1000000)
    return _rows(write.effective(log, wanted.unionByName(absent)))


@query(f"""SELECT 'REMOVE' AS action, user_id, event_type, value FROM ({_ADDED}) WHERE event_type = 'signup' AND value NOT IN (50, 60)
UNION ALL SELECT 'ADD', user_id, 'signup', v FROM events, (VALUES (50.0), (60.0)) t(v) WHERE event_type = 'signup' GROUP BY user_id, v HAVING count(*) FILTER (value = v) = 0""")
def reconcile_rows(spark, sf):
    log = added(spark, sf).store.revisions(["signup"])
    fields = log.select("key", "record").distinct()
    target = fields.select("key", "record", *encoded(F.lit(50.0), "double")).unionByName(fields.select("key", "record", *encoded(F.lit(60.0), "double")))
    return _rows(write.set_values(log, target, 10**18))


@query(f"SELECT unnest(['REMOVE', 'ADD']) AS action, user_id, 'click' AS event_type, unnest([max(value), 12345.5]) AS value FROM ({_ADDED}) WHERE event_type = 'click' AND user_id = 8 GROUP BY user_id")
def swap_rows(spark, sf):
    """The largest click of a user for another; a swap of a value that is not there has no rows."""
    r = added(spark, sf)
    log, most = r.store.log, float(r.calculate("max", "click", 8).first()[0])
    return _rows(write.verify_and_swap(log, "click", most, 8, 12345.5, 10**18).unionByName(write.verify_and_swap(log, "click", -1.5, 8, 2.5, 10**18)))


@query("""SELECT n_nationkey AS record, 'name' AS key, n_name AS v FROM nation UNION ALL SELECT n_nationkey, 'marks', unnest([CAST(n_nationkey AS VARCHAR), 'x']) FROM nation
UNION ALL SELECT n_nationkey, 'region', '@' || (100 + n_regionkey) FROM nation""")
def insert_rows(spark, sf):
    return nation_ledger(spark, sf).select(["name", "marks", "region"]).select("record", "key", F.col("str").alias("v"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def resolvable_rows(spark, sf):
    """What the resolved links lead to."""
    t = nation_ledger(spark, sf).table(["name", "region.title"], "name regex .*")
    return t.select(F.element_at("name", 1).alias("n_name"), F.element_at("`region.title`", 1).alias("r_name"))


@query("SELECT n_nationkey AS record, n_nationkey <> 7 AS taken, n_nationkey IN (7, 8) AS sees FROM nation WHERE n_nationkey IN (7, 8, 9)")
def insert_into_rows(spark, sf):
    """An object goes into a record as a whole, or not at all where one of its values stands already."""
    ledger = nation_ledger(spark, sf)
    ledger.add("sees", "coast", 7)
    took = ledger.insert({"sees": "coast", "more": 1}, into=[7, 8])
    seen = {r[0] for r in ledger.find("sees = coast").collect()}
    more = {r[0] for r in ledger.find("more = 1").collect()}
    return spark.createDataFrame([(r, took.get(r, True) and (r not in (7, 8) or r in more), r in seen) for r in (7, 8, 9)], "record int, taken boolean, sees boolean")


@query("SELECT n_nationkey AS target FROM nation WHERE n_nationkey % 2 = 1 AND n_nationkey > 0")
def link_rows(spark, sf):
    ledger = nation_ledger(spark, sf)
    others = [r[0] for r in ledger.find("name regex .* and name != NATION_0").collect()]
    ledger.link("near", 0, others)
    ledger.unlink("near", 0, [k for k in others if k % 2 == 0])
    return ledger.select("near", 0).select(F.col("num").cast("int").alias("target"))


@query("SELECT n_nationkey AS found, count(*) OVER () + 2 AS records, true AS fresh FROM nation QUALIFY n_nationkey = 3")
def find_or_add_rows(spark, sf):
    """One that is there, one that is added, one that is inserted; new ids are no old ones."""
    ledger = nation_ledger(spark, sf)
    there, new = ledger.find_or_add("name", "NATION_3"), ledger.find_or_add("name", "nowhere")
    more = ledger.find_or_insert("name = elsewhere", {"name": "elsewhere", "marks": [1, 2]})
    again = ledger.find_or_insert("name = elsewhere", {"name": "elsewhere"})
    return spark.createDataFrame([(there, ledger.find("name regex .*").count(), again == more != new > 200)], "found int, records long, fresh boolean")


# ---- history and times ---------------------------------------------------------------------------------------------------
@query(f"""SELECT t.user_id, t.at, s.value FROM (SELECT DISTINCT user_id, epoch_us(TIMESTAMP '2024-01-05' + INTERVAL (d) DAY) AS at FROM events, range(0, 20, 5) r(d)) t
JOIN ({_ADDED}) s ON s.user_id = t.user_id AND s.event_type = 'purchase' AND epoch_us(s.ts) <= t.at""")
def as_of_sets(spark, sf):
    r = added(spark, sf)
    at = F.explode(F.array(*[F.lit(1704412800000000 + k * 86_400_000_000).cast("long") for k in (0, 5, 10, 15)]))
    times = r.inventory().select("record", F.lit("purchase").alias("key"), at.alias("at"))
    return temporal.as_of_sets(r.store.revisions(["purchase"]), times).select(F.col("record").alias("user_id"), "at", F.col("str").cast("double").alias("value"))


_PHRASES = {"now": "2024-03-01 12:30:00", "today": "2024-03-01", "yesterday at 5pm": "2024-02-29 17:00:00", "last monday": "2024-02-26", "2 months ago": "2024-01-01 12:30:00", "one year ago": "2023-03-01 12:30:00", "noon": "2024-03-01 12:00:00", "january 5, 2024 at 7:15 am": "2024-01-05 07:15:00", "in 3 weeks": "2024-03-22 12:30:00"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', epoch_us(TIMESTAMP '{v}'))" for k, v in _PHRASES.items()) + ") t(phrase, micros)")
def time_phrases(spark, sf):
    clock = lambda: datetime(2024, 3, 1, 12, 30)
    return spark.createDataFrame([(p, to_micros(p, clock)) for p in _PHRASES], "phrase string, micros long")


# ---- sources and sinks -----------------------------------------------------------------------------------------------------
@query("SELECT s_suppkey, s_name || ' again' AS v FROM supplier")
def resolve_rows(spark, sf):
    """Rows go to the records that have their value; of those of unknown values none is left."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", "s_name")
    live = fold(shred(s, F.col("s_suppkey"), F.lit(1).cast("long"), {"s_name": "string"}))
    rows = s.select("s_name", F.concat("s_name", F.lit(" again")).alias("v")).unionByName(s.select(F.concat("s_name", F.lit("?")).alias("s_name"), F.lit("lost").alias("v")))
    return files.resolve(files.record_numbers(rows, 10**9), live, "s_name").select(F.col("_id").alias("s_suppkey"), "v")


@query("SELECT event_id, 'kind' AS key, event_type AS v FROM events UNION ALL SELECT event_id, 'user', CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT event_id, 'k', CAST(json_extract(props, '$.k') AS VARCHAR) FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_source(spark, sf):
    """JSON lines from files, as revisions of their keys."""
    path = new_folder(spark, "json")
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("user"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    e.write.json(path)
    read = files.read_json(spark, path, lines=True)
    objects = read.select(F.to_json(F.struct("kind", "user", "k")).alias("object"), F.col("event_id").cast("long").alias("id"))
    return importer.revisions(objects, "id", 1).select(F.col("record").alias("event_id"), "key", F.col("str").alias("v"))


@query("SELECT key, count(*) AS n FROM (UNPIVOT (SELECT c_name, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer) ON c_name, c_acctbal, c_mktsegment INTO NAME key VALUE v) GROUP BY 1")
def shred_counts(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    log = shred(c, F.col("c_custkey"), F.lit(1).cast("long"), {"c_name": "string", "c_acctbal": "double", "c_mktsegment": "string"})
    return fold(log).groupBy("key").agg(F.count("*").alias("n"))


class PartLines(importer.Importer):
    """Lines of a part's number, brand and name, parted by bars; numbers become texts."""

    name = "part_lines"
    header = False

    def parse(self, line: str, names: list[str] | None = None) -> dict | None:
        number, brand, title = line.split("|")
        return {"part": int(number), "brand": brand, "title": title}


@query("SELECT p_partkey, p_brand, p_name FROM part")
def importer_rows(spark, sf):
    path, ledger = new_folder(spark, "lines"), empty(spark)
    spark.read.parquet(f"{sf}/part.parquet").select(F.concat_ws("|", "p_partkey", "p_brand", "p_name").alias("value")).write.text(path)
    importer.load(ledger, PartLines, path)
    t = ledger.table(["part", "brand", "title"], single=True)
    return t.select(F.col("part").cast("long").alias("p_partkey"), F.col("brand").alias("p_brand"), F.col("title").alias("p_name"))


@query("SELECT n_name AS name, r_name AS title, row_number() OVER (ORDER BY lower(n_name) DESC) AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def export_rows(spark, sf):
    """The command line's export in an order, read back in the order of its files and lines."""
    ledger, out = nation_ledger(spark, sf), new_folder(spark, "export")
    root = ledger.root.rpartition("/")[0]
    cli.run(spark, cli.parser().parse_args(["export", root, out, "--condition", "name regex .*", "--keys", "name,region.title", "--order", "name desc", "--no-id"]))
    lines = spark.read.text(out).select(F.input_file_name().alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), "value").filter("value not like 'name,%'")
    rows = [r.value.split(",") for r in lines.orderBy("f", "b", "i").collect()]
    return spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], "name string, title string, place long")


@query("SELECT n_nationkey, n_name FROM nation")
def workbook_rows(spark, sf):
    """A workbook, and the cells of its sheet."""
    path = new_folder(spark, "workbook") + ".xlsx"
    files.write_workbook(spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_name"), path)
    raw = spark.read.format("binaryFile").load(path).select("content").first()[0]
    sheet = zipfile.ZipFile(io.BytesIO(raw)).read("xl/worksheets/sheet1.xml").decode()
    lines = [re.findall(r"<(?:v|t xml:space=\"preserve\")>([^<]*)<", line) for line in re.findall("<row>(.*?)</row>", sheet)]
    return spark.createDataFrame([(int(k), v) for k, v in lines[1:]], "n_nationkey int, n_name string")


@query("SELECT count(*) AS n FROM customer WHERE c_acctbal > 5000")
def extension_rows(spark, sf):
    from .queries import star

    own = Extensions()
    own.register("balances", above=lambda r, least: r.find(f"c_acctbal > {least}").agg(F.count("*").alias("n")))
    return own.invoke("balances", "above", star(spark, sf, "customer"), 5000)


# ---- streams ---------------------------------------------------------------------------------------------------------------
_EVENTS = f"SELECT 'ADD' AS action, user_id, event_type, value FROM ({_SET}) UNION ALL SELECT 'REMOVE', user_id, event_type, before FROM ({_SET.replace('ts, lead', 'ts, before, lead')}) WHERE before IS NOT NULL"


@query(_EVENTS)
def stream_events(spark, sf):
    """Every write of the log, as a listener gets it in packets."""
    from .streaming.live import read_log, write_events

    log, out = new_folder(spark, "events-log"), new_folder(spark, "events-out")
    set_log(spark, sf).store.log.repartition(4, "record").write.parquet(log)
    listener = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    write_events(read_log(spark, log, 2), listener, f"{out}-checkpoint").awaitTermination()
    seen = spark.read.parquet(out)
    return seen.select("action", F.col("record").alias("user_id"), F.col("key").alias("event_type"), F.col("str").cast("double").alias("value"))


@query(f"SELECT user_id, event_type, value FROM ({_SET}) WHERE until IS NULL AND event_type = 'signup'")
def stream_changes(spark, sf):
    """The same state by the stateful operator: of every value its last change that was sent."""
    from .streaming.live import live_changes, read_log

    log, out = new_folder(spark, "changes-log"), new_folder(spark, "changes-out")
    set_log(spark, sf).store.revisions(["signup"]).repartition(2, "record").write.parquet(log)
    setting, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(setting)
    spark.conf.set(setting, provider)
    try:
        keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        live_changes(read_log(spark, log, 1)).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
    last = F.max_by(F.struct("action", "str"), F.struct("version", "seq"))
    now = spark.read.parquet(out).groupBy("key", "record", "vid").agg(last.alias("l")).filter("l.action = 'ADD'")
    return now.select(F.col("record").alias("user_id"), F.col("key").alias("event_type"), F.col("l.str").cast("double").alias("value"))


__all__ = ["QUERIES"]
