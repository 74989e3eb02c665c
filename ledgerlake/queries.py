"""The registered queries: each operator over the driver's tables, with an equivalent in SQL where that can say it.

Star tables are read as records in place (record = table number and primary key); events are a log of revisions, either of
ADDs (record: user, key: event type, version: time) or of SETs, in which a value takes the place of the one before."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .engine import Reader
from .operators import calc, order, read, temporal, write
from .operators.find import Finder
from .operators.navigate import trace
from .plans import ccl
from .plans.ccl import Page, Sort, where
from .sources import files
from .sources.log import COLUMNS, LogStore, Table, TableStore, changes, encoded, fold, micros_of, shred

NATION, CUSTOMER, SUPPLIER, PART, ORDERS, LINEITEM, DOCUMENTS, REGION = 2, 3, 4, 5, 6, 7, 8, 1
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
T1, T2 = "2024-01-10 00:00:00", "2024-01-20 00:00:00"


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return keep


def star(spark: SparkSession, sf: str, *names: str) -> Reader:
    """A reader of some of the star tables."""
    spec = {
        "region": (REGION, "r_regionkey", {}),
        "nation": (NATION, "n_nationkey", {"n_regionkey": REGION}),
        "customer": (CUSTOMER, "c_custkey", {"c_nationkey": NATION}),
        "supplier": (SUPPLIER, "s_suppkey", {"s_nationkey": NATION}),
        "part": (PART, "p_partkey", {}),
        "orders": (ORDERS, "o_orderkey", {"o_custkey": CUSTOMER}),
        "lineitem": (LINEITEM, None, {"l_orderkey": ORDERS, "l_partkey": PART, "l_suppkey": SUPPLIER}),
        "documents": (DOCUMENTS, "doc_id", {}),
    }
    return Reader(TableStore([Table(spark.read.parquet(f"{sf}/{n}.parquet"), *spec[n]) for n in names]), spark)


def pk(name: str, column: str = "record") -> Column:
    return F.col(column).bitwiseAND(F.lit((1 << 40) - 1)).alias(name)


def added(spark: SparkSession, sf: str) -> Reader:
    """events as ADDs; those of a value that is live already are left out, as a writer refuses them."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    rows = e.select(micros_of(F.col("ts")).alias("version"), F.col("event_id").alias("seq"), F.lit("ADD").alias("action"), F.col("event_type").alias("key"), F.col("user_id").alias("record"), *encoded(F.col("value"), "double"))
    return Reader(LogStore(changes(rows.select(*COLUMNS))), spark)


def set_log(spark: SparkSession, sf: str) -> Reader:
    """events as SETs: REMOVE of the value before and ADD of the new one at one version."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    rows = e.select(micros_of(F.col("ts")).alias("version"), F.col("event_type").alias("key"), F.col("user_id").alias("record"), *encoded(F.col("value"), "double"))
    typed = F.struct("type", "num", "str", "vid")
    seen = rows.withColumn("now", typed).withColumn("before", F.lag(typed).over(Window.partitionBy("record", "key").orderBy("version")))
    seen = seen.filter(~F.col("before.vid").eqNullSafe(F.col("now.vid")))
    step = lambda action, seq, v: F.struct(F.lit(action).alias("action"), F.lit(seq).cast("long").alias("seq"), v.alias("v"))
    both = seen.select("version", "key", "record", F.explode(F.array(step("REMOVE", 0, F.col("before")), step("ADD", 1, F.col("now")))).alias("s")).filter("s.v.vid IS NOT NULL")
    return Reader(LogStore(both.select("version", "s.seq", "s.action", "key", "record", "s.v.*").select(*COLUMNS)), spark)


def num(name: str = "value") -> Column:
    return F.col("num").cast("double").alias(name)


_ADDED = "SELECT user_id, event_type, value, min(ts) AS ts FROM events GROUP BY ALL"
_SET = "SELECT user_id, event_type, value, ts, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS until FROM (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS before FROM events) WHERE value IS DISTINCT FROM before"

# ---- predicates ------------------------------------------------------------------------------------------------------
for _name, _table, _key, _ccl, _sql in [
    ("find_eq_ci", "customer", "c_custkey", "c_mktsegment = building", "lower(c_mktsegment) = 'building'"),
    ("find_ne", "customer", "c_custkey", "c_mktsegment != BUILDING", "lower(c_mktsegment) <> 'building'"),
    ("find_gt", "customer", "c_custkey", "c_acctbal > 5000", "c_acctbal > 5000"),
    ("find_gte", "part", "p_partkey", "p_size >= 30", "p_size >= 30"),
    ("find_lt", "customer", "c_custkey", "c_acctbal lt 100.5", "c_acctbal < 100.5"),
    ("find_lte", "part", "p_partkey", "p_size <= 11", "p_size <= 11"),
    ("find_between", "customer", "c_custkey", "c_acctbal bw 1000 2000", "c_acctbal >= 1000 AND c_acctbal < 2000"),
    ("find_between_text", "customer", "c_custkey", "c_mktsegment bw B H", "lower(c_mktsegment) >= 'b' AND lower(c_mktsegment) < 'h'"),
    ("find_regex", "part", "p_partkey", "p_name regex red.*", "regexp_full_match(p_name, 'red.*')"),
    ("find_nregex", "part", "p_partkey", "p_name nregex .*ring", "NOT regexp_full_match(p_name, '.*ring')"),
    ("find_like", "part", "p_partkey", "p_name like %widget", "p_name LIKE '%widget'"),
    ("find_nlike", "part", "p_partkey", "p_brand nlike Brand#1%", "p_brand NOT LIKE 'Brand#1%'"),
    ("find_gt_mixed", "customer", "c_custkey", "c_mktsegment > 7", "c_mktsegment IS NOT NULL"),
    ("find_and_or", "customer", "c_custkey", "(c_acctbal > 5000 or c_mktsegment = AUTOMOBILE) and c_acctbal < 9000", "(c_acctbal > 5000 OR lower(c_mktsegment) = 'automobile') AND c_acctbal < 9000"),
    ("find_timestamp", "orders", "o_orderkey", "o_orderdate >= |1998-01-01|", "o_orderdate >= TIMESTAMP '1998-01-01'"),
    ("find_contains", "documents", "doc_id", "text ~ than", "contains(lower(text), 'than')"),
    ("find_contains_phrase", "documents", "doc_id", 'text contains "the and"', "len(list_filter(range(len(w) - 1), lambda i: contains(w[i + 1], 'the') AND contains(w[i + 2], 'and'))) > 0"),
    ("find_not_contains", "documents", "doc_id", "text !~ than", "NOT contains(lower(text), 'than')"),
    ("find_multiword", "part", "p_partkey", "p_name = Cold Widget or p_name = 'small widget'", "lower(p_name) IN ('cold widget', 'small widget')"),
    ("find_no_spaces", "part", "p_partkey", "p_size>=30&&p_size<40", "p_size >= 30 AND p_size < 40"),
    ("find_quoted_function", "customer", "c_custkey", "c_name != 'avg(c_acctbal)' and c_acctbal > 9000", "c_acctbal > 9000"),
    ("find_timestamp_format", "orders", "o_orderkey", "o_orderdate < |15/03/1996|dd/MM/yyyy|", "o_orderdate < TIMESTAMP '1996-03-15'"),
]:
    _from = "(SELECT *, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents)" if "w[" in _sql else _table

    def _find(spark, sf, _table=_table, _key=_key, _ccl=_ccl):
        return star(spark, sf, _table).find(_ccl).select(pk(_key))

    query(f"SELECT {_key} FROM {_from} WHERE {_sql}", _name)(_find)


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def find_links_to(spark, sf):
    return star(spark, sf, "orders").find(f"o_custkey -> {CUSTOMER << 40 | 7}").select(pk("o_orderkey"))


@query("SELECT n_nationkey FROM nation WHERE n_nationkey = 3")
def find_id_eq(spark, sf):
    return star(spark, sf, "nation").find(f"$id$ = {NATION << 40 | 3}").select(pk("n_nationkey"))


@query("SELECT n_nationkey FROM nation WHERE n_nationkey <> 3")
def find_id_ne(spark, sf):
    return star(spark, sf, "nation").find(f"$id$ != {NATION << 40 | 3}").select(pk("n_nationkey"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 9000 AND regexp_full_match(c_mktsegment, '.*U.*')")
def find_builder(spark, sf):
    return star(spark, sf, "customer").find(where("c_acctbal").op(">", 9000) & where("c_mktsegment").op("regex", ".*U.*")).select(pk("c_custkey"))


@query("SELECT * FROM (VALUES (3), (900)) t(n_nationkey)")
def find_id_unknown(spark, sf):
    """Ids are what they are listed as, whether a record was written or not."""
    tree = ccl.Leaf("$id$", "EQUALS", (NATION << 40 | 3, NATION << 40 | 900))
    return star(spark, sf, "nation").find(tree).select(pk("n_nationkey").cast("int").alias("n_nationkey"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 7000 AND lower(c_mktsegment) = 'furniture'")
def find_local_data(spark, sf):
    return star(spark, sf, "customer").find("c_acctbal > $least and c_mktsegment = $segment", data={"least": 7000, "segment": "Furniture"}).select(pk("c_custkey"))


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def find_fn_nav(spark, sf):
    return star(spark, sf, "orders", "customer").find("o_custkey.c_acctbal | avg > 5000").select(pk("o_orderkey"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal < (SELECT max(n_nationkey) FROM customer JOIN nation ON c_nationkey = n_nationkey)")
def find_fn_value_nav(spark, sf):
    return star(spark, sf, "customer", "nation").find("c_acctbal < max(c_nationkey.n_nationkey)").select(pk("c_custkey"))


@query("SELECT c_custkey, c_acctbal FROM customer JOIN (SELECT max(c_acctbal) AS m FROM customer) ON c_acctbal = m")
def find_one(spark, sf):
    """The record of the largest balance by find_one, if one record has it, and its value by gather."""
    r = star(spark, sf, "customer")
    record = r.find_one("c_acctbal >= max(c_acctbal)")
    return r.gather("c_acctbal", record).select(pk("c_custkey"), F.col("num").alias("c_acctbal"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_3')")
def find_or_nav(spark, sf):
    return star(spark, sf, "customer", "nation").find("c_acctbal > 5000 or c_nationkey.n_name = nation_3").select(pk("c_custkey"))


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7'")
def find_nav(spark, sf):
    return star(spark, sf, "orders", "customer", "nation").find("o_custkey.c_nationkey.n_name = nation_7").select(pk("o_orderkey"))


@query(f"SELECT user_id FROM ({_ADDED}) WHERE event_type = 'purchase' GROUP BY 1 HAVING sum(CAST(value AS DECIMAL(28, 10))) / count(*) > 50")
def find_fn_key(spark, sf):
    return added(spark, sf).find("purchase | average > 50").select(F.col("record").alias("user_id"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def find_fn_value(spark, sf):
    return star(spark, sf, "orders").find("o_totalprice > avg(o_totalprice)").select(pk("o_orderkey"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders WHERE o_orderkey IN (1, 2))")
def find_fn_value_records(spark, sf):
    return star(spark, sf, "orders").find(f"o_totalprice > avg(o_totalprice, {ORDERS << 40 | 1}, {ORDERS << 40 | 2})").select(pk("o_orderkey"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders WHERE o_orderstatus = 'F')")
def find_fn_value_condition(spark, sf):
    return star(spark, sf, "orders").find("o_totalprice > avg(o_totalprice, o_orderstatus = F)").select(pk("o_orderkey"))


@query(f"SELECT DISTINCT user_id FROM ({_ADDED}) WHERE event_type = 'click' AND value > (SELECT max(value) * 1.0 FROM ({_ADDED}) WHERE event_type = 'view' AND ts <= TIMESTAMP '{T1}')")
def find_fn_value_at(spark, sf):
    return added(spark, sf).find(f"click > max(view, at '{T1}')").select(F.col("record").alias("user_id"))


@query(f"SELECT DISTINCT user_id FROM ({_SET}) WHERE event_type = 'view' AND value > 60 AND ts <= TIMESTAMP '{T1}' AND (until IS NULL OR until > TIMESTAMP '{T1}')")
def find_at(spark, sf):
    return set_log(spark, sf).find(f"view > 60 at '{T1}'").select(F.col("record").alias("user_id"))


@query(f"""SELECT DISTINCT a.user_id FROM ({_SET}) a JOIN ({_SET}) b ON a.user_id = b.user_id WHERE a.event_type = 'view' AND a.value > 20 AND a.ts <= TIMESTAMP '{T1}'
AND (a.until IS NULL OR a.until > TIMESTAMP '{T1}') AND b.event_type = 'click' AND b.value > 20 AND b.until IS NULL""")
def find_two_times(spark, sf):
    return set_log(spark, sf).find(f"view > 20 at '{T1}' and click > 20").select(F.col("record").alias("user_id"))


@query(f"SELECT DISTINCT user_id, value FROM ({_ADDED}) WHERE event_type = 'signup' AND value > 90")
def explore(spark, sf):
    return added(spark, sf).explore("signup", ">", 90).select(F.col("record").alias("user_id"), num())


@query(f"SELECT user_id, value FROM ({_ADDED}) WHERE event_type = 'click' AND user_id = 8")
def gather(spark, sf):
    return added(spark, sf).gather("click", 8).select(F.col("record").alias("user_id"), num())


# ---- projections -----------------------------------------------------------------------------------------------------
@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal > 9000")
def select_keys(spark, sf):
    r = star(spark, sf, "customer")
    t = r.select(["c_name", "c_mktsegment"], "c_acctbal > 9000")
    w = t.groupBy("record").agg(F.max(F.when(F.col("key") == "c_name", F.col("str"))).alias("c_name"), F.max(F.when(F.col("key") == "c_mktsegment", F.col("str"))).alias("c_mktsegment"))
    return w.select(pk("c_custkey"), "c_name", "c_mktsegment")


@query(f"SELECT user_id, event_type, value FROM ({_ADDED}) WHERE user_id = 8")
def select_record(spark, sf):
    return added(spark, sf).select(None, 8).select(F.col("record").alias("user_id"), F.col("key").alias("event_type"), num())


@query("SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 400000")
def select_nav(spark, sf):
    return star(spark, sf, "orders", "customer", "nation").select("o_custkey.c_nationkey.n_name", "o_totalprice > 400000").select(pk("o_orderkey"), F.col("str").alias("n_name"))


@query("""SELECT o_orderkey, 'o_custkey.c_name' AS path, c_name AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000
UNION ALL SELECT o_orderkey, 'o_custkey.c_nationkey.n_name', n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 400000""")
def select_many_paths(spark, sf):
    t = star(spark, sf, "orders", "customer", "nation").select(["o_custkey.c_name", "o_custkey.c_nationkey.n_name"], "o_totalprice > 400000")
    return t.select(pk("o_orderkey"), F.col("key").alias("path"), F.col("str").alias("v"))


@query(f"SELECT user_id, event_type, arg_max(value, ts) AS value FROM ({_ADDED}) GROUP BY ALL")
def get_latest(spark, sf):
    return added(spark, sf).get().select(F.col("record").alias("user_id"), F.col("key").alias("event_type"), num())


@query(f"SELECT event_type, value, user_id FROM ({_ADDED})")
def invert(spark, sf):
    i = read.invert(added(spark, sf).store.triples())
    return i.select(F.col("key").alias("event_type"), F.col("str").cast("double").alias("value"), F.col("record").alias("user_id"))


@query(f"SELECT user_id, event_type, value FROM ({_SET}) WHERE ts <= TIMESTAMP '{T1}' AND (until IS NULL OR until > TIMESTAMP '{T1}')")
def select_at(spark, sf):
    return set_log(spark, sf).select(at=T1).select(F.col("record").alias("user_id"), F.col("key").alias("event_type"), num())


@query("SELECT c_mktsegment AS value, count(*) AS records FROM customer GROUP BY 1")
def browse_key(spark, sf):
    return read.browse_counts(star(spark, sf, "customer").store, "c_mktsegment").select(F.col("str").alias("value"), "records")


@query("SELECT 'c_mktsegment' AS key, c_mktsegment AS value, count(*) AS records FROM customer GROUP BY 2 UNION ALL SELECT 'c_nationkey.n_name', n_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 2")
def browse_keys(spark, sf):
    return read.browse_counts(star(spark, sf, "customer", "nation").store, ["c_mktsegment", "c_nationkey.n_name"]).select("key", F.col("str").alias("value"), "records")


@query("SELECT n_name AS value, count(*) AS records FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def browse_nav(spark, sf):
    return read.browse_counts(star(spark, sf, "customer", "nation").store, "c_nationkey.n_name").select(F.col("str").alias("value"), "records")


@query(f"SELECT value, count(*) AS records FROM ({_SET}) WHERE event_type = 'error' AND ts <= TIMESTAMP '{T1}' AND (until IS NULL OR until > TIMESTAMP '{T1}') GROUP BY 1")
def browse_at(spark, sf):
    b = set_log(spark, sf).browse("error", T1)
    return b.groupBy("vid").agg(F.first("num").cast("double").alias("value"), F.count("*").alias("records")).drop("vid")


@query("SELECT DISTINCT user_id, event_type FROM events")
def describe_records(spark, sf):
    return added(spark, sf).describe().select(F.col("record").alias("user_id"), F.col("key").alias("event_type"))


@query(f"SELECT DISTINCT user_id, event_type FROM events WHERE ts <= TIMESTAMP '{T1}' AND user_id IN (1, 2, 3)")
def describe_at(spark, sf):
    return added(spark, sf).describe([1, 2, 3], T1).select(F.col("record").alias("user_id"), F.col("key").alias("event_type"))


@query("SELECT DISTINCT user_id FROM events")
def inventory(spark, sf):
    return added(spark, sf).inventory().select(F.col("record").alias("user_id"))


@query("SELECT DISTINCT user_id, true AS live FROM events UNION ALL SELECT DISTINCT user_id + 1000000, false FROM events")
def ping(spark, sf):
    """All records that have values, and as many that do not."""
    r = added(spark, sf)
    asked = r.inventory().select(F.explode(F.array("record", F.col("record") + 1000000)).alias("record"))
    return r.ping(asked).select(F.col("record").alias("user_id"), "live")


_HELD = [(1, 6.55), (2, 185.22), (8, 106.03), (13, 185.22), (1000000, 6.55)]


@query(f"SELECT t.user_id, CAST(t.value AS DOUBLE) AS value, EXISTS (SELECT 1 FROM events e WHERE event_type = 'error' AND e.user_id = t.user_id AND e.value = t.value) AS held FROM (VALUES {', '.join(map(str, _HELD))}) t(user_id, value)")
def verify(spark, sf):
    r = added(spark, sf)
    return spark.createDataFrame([(u, v, r.verify("error", v, u)) for u, v in _HELD], "user_id int, value double, held boolean")


@query("SELECT t.user_id, EXISTS (SELECT 1 FROM events e WHERE e.user_id = t.user_id) AS written FROM (VALUES (1), (8), (1000000)) t(user_id)")
def holds(spark, sf):
    r = added(spark, sf)
    return spark.createDataFrame([(u, r.holds(u)) for u in (1, 8, 1000000)], "user_id int, written boolean")


_NATION_JSON = "'{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":\"@' || CAST(n_regionkey + 1099511627776 AS VARCHAR) || '\"}'"


@query(f"SELECT n_nationkey, {_NATION_JSON} AS json FROM nation")
def jsonify(spark, sf):
    return star(spark, sf, "nation").jsonify().select(pk("n_nationkey"), "json")


@query(f"SELECT '[' || string_agg({_NATION_JSON}, ',' ORDER BY n_nationkey) || ']' AS json FROM nation WHERE n_regionkey = 1")
def jsonify_array(spark, sf):
    r = star(spark, sf, "nation", "region")
    return read.json_array(r.jsonify(f"n_regionkey -> {REGION << 40 | 1}").filter(F.col("record").bitwiseAND(F.lit(-1 << 40)) == NATION << 40))


@query(f"SELECT user_id, event_type, value FROM ({_SET}) WHERE ts <= TIMESTAMP '2024-01-17 12:00:00' AND (until IS NULL OR until > TIMESTAMP '2024-01-17 12:00:00')")
def select_at_phrase(spark, sf):
    """A phrase by a clock that stands at the 20th of January 2024."""
    r = set_log(spark, sf)
    r.clock = lambda: datetime(2024, 1, 20, 8)
    return r.select(at="last wednesday at noon").select(F.col("record").alias("user_id"), F.col("key").alias("event_type"), num())


# ---- calculations ----------------------------------------------------------------------------------------------------
# an average is a quotient of whole numbers of cents, rounded half up at the tenth place
_AVG = "CAST((2 * sum(CAST(round({v} * 100) AS HUGEINT)) * 100000000 + count({v})) // (2 * count({v})) AS DOUBLE) / 1e10"
_FUNCTIONS = {"sum": "CAST(sum(CAST({v} AS DECIMAL(28, 10))) AS DOUBLE)", "avg": _AVG, "count": "count({v})", "max": "max({v})", "min": "min({v})"}
for _f, _e in _FUNCTIONS.items():
    _e = _e.format(v="o_totalprice")
    for _shape, _of, _sql in [("key", None, "orders"), ("record", ORDERS << 40 | 5, "orders WHERE o_orderkey = 5"), ("records", [ORDERS << 40 | k for k in (1, 2, 3)], "orders WHERE o_orderkey IN (1, 2, 3)"), ("condition", "o_orderstatus = F", "orders WHERE o_orderstatus = 'F'")]:

        def _calculate(spark, sf, _f=_f, _of=_of):
            v = star(spark, sf, "orders").calculate(_f, "o_totalprice", _of)
            return v if _f == "count" else v.select(F.col("value").cast("double").alias("value"))

        query(f"SELECT {_e} AS value FROM {_sql}", f"{_f}_{_shape}")(_calculate)


@query(f"SELECT {_AVG.format(v='value')} AS value FROM ({_SET}) WHERE event_type = 'click' AND ts <= TIMESTAMP '{T1}' AND (until IS NULL OR until > TIMESTAMP '{T1}')")
def avg_at(spark, sf):
    return set_log(spark, sf).calculate("avg", "click", at=T1).select(F.col("value").cast("double").alias("value"))


@query(f"SELECT user_id, CAST(sum(CAST(value AS DECIMAL(28, 10))) AS DOUBLE) AS value FROM ({_ADDED}) WHERE event_type = 'purchase' GROUP BY 1")
def sum_by_record(spark, sf):
    return added(spark, sf).calculate_by_record("sum", "purchase").select(F.col("record").alias("user_id"), F.col("value").cast("double").alias("value"))


@query("SELECT CAST(sum(CAST(o_orderkey % 900 AS HUGEINT) * 10000000000000000 + o_orderkey) AS VARCHAR) AS value FROM orders")
def sum_large(spark, sf):
    """Whole numbers up to the largest long: the sum is exact."""
    large = F.pmod("o_orderkey", F.lit(900)) * F.lit(10**16) + F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.lit(1).cast("long").alias("version"), F.lit(0).cast("long").alias("seq"), F.lit("ADD").alias("action"), F.lit("big").alias("key"), F.col("o_orderkey").alias("record"), *encoded(large, "bigint"))
    return Reader(LogStore(rows.select(*COLUMNS)), spark).calculate("sum", "big").select(F.col("value").cast("decimal(38,0)").cast("string").alias("value"))


@query("SELECT CAST(sum(CAST(c_acctbal AS DECIMAL(28, 10))) AS DOUBLE) AS value FROM orders JOIN customer ON o_custkey = c_custkey")
def sum_nav(spark, sf):
    return star(spark, sf, "orders", "customer").calculate("sum", "o_custkey.c_acctbal").select(F.col("value").cast("double").alias("value"))


@query(f"""SELECT event_type, count(*) AS count, count(DISTINCT value) AS distinct_values, count(DISTINCT user_id) AS records, count(DISTINCT value) / count(*) AS distinctiveness,
count(*) / (SELECT count(*) FROM ({_ADDED})) AS proportion, CAST(max(CAST(value AS DECIMAL(28, 10))) - min(CAST(value AS DECIMAL(28, 10))) AS DOUBLE) AS spread, 1.0::DOUBLE AS percent_double, 0.0::DOUBLE AS percent_string FROM ({_ADDED}) GROUP BY 1""")
def statistics(spark, sf):
    return added(spark, sf).statistics().select(F.col("key").alias("event_type"), "count", F.col("distinct").alias("distinct_values"), "records", "distinctiveness", "proportion", F.col("spread").cast("double").alias("spread"), "percent_double", "percent_string")


# ---- order, pages, search, links ---------------------------------------------------------------------------------------
@query("SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20")
def order_asc(spark, sf):
    return star(spark, sf, "customer").find("c_custkey >= 0 order by c_acctbal page 1 size 20").select(pk("c_custkey"))


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def order_desc_page(spark, sf):
    return star(spark, sf, "customer").find(None, [Sort("c_acctbal", False)], Page.number(3)).select(pk("c_custkey"))


@query("SELECT c_custkey FROM customer ORDER BY lower(c_mktsegment) DESC, c_acctbal, c_custkey LIMIT 10 OFFSET 5")
def order_multi(spark, sf):
    return star(spark, sf, "customer").find(None, [Sort("c_mktsegment", False), Sort("c_acctbal")], Page(5, 10)).select(pk("c_custkey"))


@query(f"""SELECT u.user_id FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, value FROM ({_SET}) WHERE event_type = 'signup' AND ts <= TIMESTAMP '{T1}' AND (until IS NULL OR until > TIMESTAMP '{T1}')) s
ON u.user_id = s.user_id ORDER BY s.value DESC NULLS LAST, u.user_id LIMIT 30""")
def order_at(spark, sf):
    from .plans.times import to_micros

    return set_log(spark, sf).find(None, [Sort("signup", False, to_micros(T1))], Page(0, 30)).select(F.col("record").alias("user_id"))


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY lower(n_name) DESC, c_acctbal, c_custkey LIMIT 25")
def order_nav(spark, sf):
    return star(spark, sf, "customer", "nation").find("c_custkey >= 0 order by c_nationkey.n_name desc, c_acctbal limit 25").select(pk("c_custkey"))


@query(f"SELECT user_id FROM (SELECT user_id, list(value ORDER BY value DESC) AS vs FROM ({_ADDED}) WHERE event_type = 'click' GROUP BY 1) ORDER BY vs DESC, user_id LIMIT 40")
def order_sets(spark, sf):
    """Fields of several values are ordered as lists."""
    return added(spark, sf).find("click > 0 order by click desc limit 40").select(F.col("record").alias("user_id"))


@query("SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer WHERE c_acctbal > 9500")
def sort_result(spark, sf):
    """A result that is sorted without the store: places by the order of its own rows."""
    t = star(spark, sf, "customer").select(["c_acctbal"], "c_acctbal > 9500")
    rows = order.sort_result(t, [("c_acctbal", False)]).select(pk("c_custkey"), F.col("num").alias("c_acctbal")).collect()
    return spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], "c_custkey long, c_acctbal double, place long")


@query("""SELECT doc_id, CAST(len(list_filter(range(len(w) - 1), lambda i: contains(w[i + 1], 'th') AND contains(w[i + 2], 'an'))) AS BIGINT) AS matches
FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(list_filter(range(len(w) - 1), lambda i: contains(w[i + 1], 'th') AND contains(w[i + 2], 'an'))) > 0""")
def search_phrase(spark, sf):
    return star(spark, sf, "documents").search("text", "th an").select(pk("doc_id"), "matches")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'widget')")
def find_strings_only(spark, sf):
    """Tags are no strings: a search over both kinds of value finds the strings."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    log = shred(part, F.col("p_partkey"), F.lit(1).cast("long"), {"p_name": "string"}).unionByName(shred(part.withColumnRenamed("p_name", "t").withColumn("p_name", F.lower("t")), F.col("p_partkey") + 10**9, F.lit(1).cast("long"), {"p_name": "TAG"}))
    return Reader(LogStore(log), spark).find("p_name ~ widget").select(F.col("record").alias("p_partkey"))


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: contains(x, 'tion'))) AS BIGINT) AS matches FROM documents WHERE contains(lower(text), 'tion')")
def search_ranked(spark, sf):
    return star(spark, sf, "documents").search("text", "tion").select(pk("doc_id"), "matches")


@query("SELECT DISTINCT n_nationkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 450000")
def navigate_destination(spark, sf):
    return star(spark, sf, "orders", "customer", "nation").navigate("o_custkey.c_nationkey.n_name", "o_totalprice > 450000").select(pk("n_nationkey"), F.col("str").alias("n_name"))


@query("SELECT o_custkey AS c_custkey, o_orderkey FROM orders WHERE o_custkey IN (7, 8, 9)")
def trace_links(spark, sf):
    r = star(spark, sf, "orders", "customer")
    return trace(r.store, r.ids([CUSTOMER << 40 | k for k in (7, 8, 9)]), ["o_custkey"]).select(pk("c_custkey"), pk("o_orderkey", "source"))


@query("SELECT n_nationkey, count(*) AS n FROM (SELECT c_nationkey AS n_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def trace_counts(spark, sf):
    r = star(spark, sf, "customer", "supplier")
    return trace(r.store, None, ["c_nationkey", "s_nationkey"]).groupBy("record").agg(F.count("*").alias("n")).select(pk("n_nationkey"), "n")


# ---- history ---------------------------------------------------------------------------------------------------------
_AT = "(SELECT user_id, event_type, value FROM ({s}) WHERE ts <= TIMESTAMP '{t}' AND (until IS NULL OR until > TIMESTAMP '{t}'))"
_DIFF = f"""SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.value, b.value) AS value,
CASE WHEN a.user_id IS NULL THEN 'ADDED' ELSE 'REMOVED' END AS action FROM {_AT.format(s=_SET, t=T1)} a FULL JOIN {_AT.format(s=_SET, t=T2)} b
ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.value = b.value WHERE (a.user_id IS NULL OR b.user_id IS NULL)"""


def _differences(frame: DataFrame) -> DataFrame:
    return frame.select(F.col("record").alias("user_id"), F.col("key").alias("event_type"), F.col("str").cast("double").alias("value"), "action")


@query(_DIFF + " AND coalesce(a.event_type, b.event_type) = 'view'")
def diff_key(spark, sf):
    return _differences(set_log(spark, sf).diff(T1, T2, key="view"))


@query(_DIFF + " AND coalesce(a.user_id, b.user_id) = 8")
def diff_record(spark, sf):
    return _differences(set_log(spark, sf).diff(T1, T2, record=8))


@query(_DIFF + " AND coalesce(a.user_id, b.user_id) = 8 AND coalesce(a.event_type, b.event_type) = 'click'")
def diff_field(spark, sf):
    return _differences(set_log(spark, sf).diff(T1, T2, key="click", record=8))


@query(f"SELECT epoch_us(ts) AS version, 'ADD' AS action, event_type, value FROM ({_ADDED}) WHERE user_id = 8 AND ts >= TIMESTAMP '{T1}' AND ts < TIMESTAMP '{T2}'")
def review_window(spark, sf):
    return added(spark, sf).review(8, start=T1, end=T2).select("version", "action", F.col("key").alias("event_type"), F.col("str").cast("double").alias("value"))


_NOW = f"(SELECT user_id, event_type, value FROM ({_SET}) WHERE until IS NULL)"


@query(f"""SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.value, b.value) AS value, CASE WHEN a.user_id IS NULL THEN 'ADDED' ELSE 'REMOVED' END AS action
FROM {_AT.format(s=_SET, t=T1)} a FULL JOIN {_NOW} b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.value = b.value WHERE (a.user_id IS NULL OR b.user_id IS NULL) AND coalesce(a.event_type, b.event_type) = 'view'""")
def diff_open(spark, sf):
    return _differences(set_log(spark, sf).diff(T1, key="view"))


@query(f"SELECT epoch_us(ts) AS version, count(*) AS changes FROM ({_ADDED}) WHERE user_id = 8 GROUP BY 1")
def audit(spark, sf):
    return added(spark, sf).audit(8).groupBy("version").agg(F.count("*").alias("changes"))


@query(f"SELECT user_id, epoch_us(ts) AS version, count(*) AS n, 'added ' || min(event_type) || ' as ' AS first FROM ({_ADDED}) WHERE ts >= TIMESTAMP '{T1}' AND ts < TIMESTAMP '{T2}' GROUP BY ALL")
def review_described(spark, sf):
    c = added(spark, sf).changes(start=T1, end=T2)
    return c.select(F.col("record").alias("user_id"), "version", F.size("changes").cast("long").alias("n"), F.regexp_extract(F.array_min("changes"), "^added \\S+ as ", 0).alias("first"))


@query(f"SELECT user_id, epoch_us(ts) AS version, value FROM ({_SET}) WHERE event_type = 'view' AND ts >= TIMESTAMP '{T1}' AND ts < TIMESTAMP '{T2}'")
def chronologize(spark, sf):
    c = set_log(spark, sf).chronologize("view", start=T1, end=T2)
    return c.select(F.col("record").alias("user_id"), "version", F.explode("values").alias("value")).withColumn("value", F.col("value").cast("double"))


@query(f"SELECT a.user_id, epoch_us(a.ts) AS version, count(*) AS n, min(b.value) AS low FROM ({_ADDED}) a JOIN ({_ADDED}) b ON a.user_id = b.user_id AND b.event_type = 'error' AND b.ts <= a.ts WHERE a.event_type = 'error' AND a.user_id IN (1, 2, 3) GROUP BY ALL")
def chronologize_sets(spark, sf):
    r = added(spark, sf)
    few = Reader(LogStore(r.store.log.filter(F.col("record").isin(1, 2, 3))), spark).chronologize("error")
    return few.select(F.col("record").alias("user_id"), "version", F.size("values").cast("long").alias("n"), F.array_min(F.transform("values", lambda v: v.cast("double"))).alias("low"))


@query(f"SELECT user_id, epoch_us(ts) AS version, count(*) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM ({_ADDED}) WHERE event_type = 'click'")
def chronologize_counts(spark, sf):
    return temporal.running_counts(added(spark, sf).store.revisions(["click"])).select(F.col("record").alias("user_id"), "version", "n")


@query(f"""SELECT t.user_id, t.at, s.value FROM (SELECT DISTINCT user_id, epoch_us(TIMESTAMP '2024-01-05' + INTERVAL (d) DAY) AS at FROM events, range(0, 20, 5) r(d)) t
JOIN ({_SET}) s ON s.user_id = t.user_id AND s.event_type = 'view' AND epoch_us(s.ts) <= t.at AND (s.until IS NULL OR epoch_us(s.until) > t.at)""")
def as_of_times(spark, sf):
    r = set_log(spark, sf)
    day = 86_400_000_000
    at = F.explode(F.array(*[F.lit(1704412800000000 + k * day).cast("long") for k in (0, 5, 10, 15)]))
    times = r.inventory().select("record", F.lit("view").alias("key"), at.alias("at"))
    return temporal.as_of(r.store.revisions(["view"]), times).select(F.col("record").alias("user_id"), "at", F.col("str").cast("double").alias("value"))


# ---- writes: the revisions that a verb appends -------------------------------------------------------------------------
_ROWS = ["action", "user_id", "event_type", "value"]


def _rows(frame: DataFrame) -> DataFrame:
    return frame.select("action", F.col("record").alias("user_id"), F.col("key").alias("event_type"), F.col("str").cast("double").alias("value"))


@query(f"""SELECT CASE WHEN action = 'ADDED' THEN 'REMOVE' ELSE 'ADD' END AS action, user_id, event_type, value FROM (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type,
coalesce(a.value, b.value) AS value, CASE WHEN a.user_id IS NULL THEN 'ADDED' ELSE 'REMOVED' END AS action FROM {_AT.format(s=_SET, t=T1)} a FULL JOIN (SELECT * FROM ({_SET}) WHERE until IS NULL) b
ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.value = b.value WHERE a.user_id IS NULL OR b.user_id IS NULL) WHERE event_type = 'view'""")
def revert_rows(spark, sf):
    from .plans.times import to_micros

    return _rows(temporal.revert(set_log(spark, sf).store.revisions(["view"]), to_micros(T1), 10**18))


@query(f"""SELECT 'REMOVE' AS action, user_id, event_type, value FROM ({_ADDED}) WHERE event_type = 'signup' AND value <> 50
UNION ALL SELECT 'ADD', user_id, 'signup', 50 FROM events WHERE event_type = 'signup' GROUP BY user_id HAVING count(*) FILTER (value = 50) = 0""")
def set_rows(spark, sf):
    r = added(spark, sf)
    log = r.store.revisions(["signup"])
    target = log.select("key", "record").distinct().select("key", "record", *encoded(F.lit(50.0), "double"))
    return _rows(write.set_values(log, target, 10**18))


@query(f"SELECT 'REMOVE' AS action, user_id, event_type, value FROM ({_ADDED}) WHERE event_type IN ('click', 'view') AND user_id IN (1, 2)")
def clear_rows(spark, sf):
    r = added(spark, sf)
    return _rows(write.clear(r.store.log, r.ids([1, 2]), ["click", "view"], 10**18))


@query(f"""SELECT 'ADD' AS action, user_id, event_type, value FROM (SELECT user_id, event_type, value FROM ({_SET}) WHERE until IS NOT NULL AND event_type = 'error'
EXCEPT SELECT user_id, event_type, value FROM ({_SET}) WHERE until IS NULL)""")
def add_rows(spark, sf):
    """Adds back every value that was replaced: those that are live already are refused."""
    log = set_log(spark, sf).store.revisions(["error"])
    wanted = log.filter("action = 'REMOVE'").withColumn("action", F.lit("ADD")).withColumn("version", F.lit(10**18).cast("long"))
    return _rows(write.effective(log, wanted))


@query(f"""SELECT 'REMOVE' AS action, user_id, event_type, value FROM ({_ADDED}) WHERE user_id IN (2, 3)
UNION ALL SELECT 'ADD', 1, event_type, value FROM (SELECT event_type, value FROM ({_ADDED}) WHERE user_id IN (2, 3) EXCEPT SELECT event_type, value FROM ({_ADDED}) WHERE user_id = 1)""")
def consolidate_rows(spark, sf):
    return _rows(write.consolidate(added(spark, sf).store.log, 1, [2, 3], 10**18))


# ---- sources and sinks -------------------------------------------------------------------------------------------------
@query("SELECT c_custkey, 'c_name' AS key, c_name AS v, NULL::DOUBLE AS value FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment, NULL FROM customer UNION ALL SELECT c_custkey, 'c_acctbal', NULL, c_acctbal FROM customer")
def shred_customer(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    log = shred(c, F.col("c_custkey"), F.lit(1).cast("long"), {"c_name": "string", "c_acctbal": "double", "c_mktsegment": "string"})
    return fold(log).select(F.col("record").alias("c_custkey"), "key", F.when(F.col("type") == "STRING", F.col("str")).alias("v"), num())


@query("SELECT p_partkey, 'p_brand' AS key, p_brand AS v FROM part UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part")
def csv_round_trip(spark, sf):
    """Writes delimited text to the shared folder, reads it back and infers its types."""
    from .sources.shared import new_folder

    path = new_folder(spark, "csv")
    files.write_delimited(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand", "p_size"), path)
    back = files.read_delimited(spark, path)
    log = files.shred_texts(back.select("p_brand", "p_size", "p_partkey"), F.col("p_partkey").cast("long"), 1)
    return fold(log).filter("key <> 'p_partkey'").select(F.col("record").alias("p_partkey"), "key", F.col("str").alias("v"))


@query(f"SELECT user_id, event_type, value FROM ({_SET}) WHERE until IS NULL")
def stream_fold(spark, sf):
    """The log as a stream, folded batch by batch; its last state is the live view."""
    from .sources.shared import new_folder
    from .streaming.live import materialized_view, read_log

    log, view = new_folder(spark, "stream-log"), new_folder(spark, "stream-view")
    set_log(spark, sf).store.log.repartition(4, "record").write.parquet(log)
    materialized_view(read_log(spark, log, 2), view, f"{view}-checkpoint").awaitTermination()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(view)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = max(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit())
    return spark.read.parquet(f"{view}/{last}").filter("action = 'ADD'").select(F.col("record").alias("user_id"), F.col("key").alias("event_type"), F.col("str").cast("double").alias("value"))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of customers of one nation above the average price, largest first."""
    r = star(spark, sf, "orders", "customer", "nation")
    found = Finder(r.store).find(ccl.parse("o_totalprice > avg(o_totalprice) and o_custkey.c_nationkey.n_name like NATION_1%").condition)
    best = order.arrange(r.store, found, (Sort("o_totalprice", False),), Page(0, 100))
    return r.store.triples(["o_totalprice"]).join(best, "record", "left_semi").select(pk("o_orderkey"), F.col("num").alias("o_totalprice"))


from . import ledger_queries  # noqa: E402, F401  (registers its queries)
