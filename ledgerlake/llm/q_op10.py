"""op10: spans of secrets in every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .secret_scan import ENCODINGS, FALSE_RATE, KINDS, LEAST, RUN, UNIFORM_P, scan, written

NAME = "op10_secret_scan"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda i: F.size(F.filter("base_spans", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k[0]}") for i, k in enumerate(KINDS)],
        F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"),
        written(F.sort_array(F.concat("base_spans", "random_spans"))).alias("spans"),
    )


def _sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = [*KINDS, ("random", RUN, 0, LEAST)]
    found = " UNION ALL ".join(f"SELECT doc_id, {i} AS kind, {least} AS least, regexp_extract_all(t, {quoted(p)}) AS f, regexp_extract_all(t, {quoted(p)}, {g}) AS g, string_split_regex(t, {quoted(p)}) AS parts FROM d" for i, (_, p, g, least) in enumerate(kinds))
    names = "[" + ", ".join(f"'{k[0]}'" for k in kinds) + "]"
    pick = lambda j: "CASE " + " ".join(f"WHEN regexp_full_match(bare, '{e[1]}') THEN {e[j] if j == 3 else quoted(e[j])}" for e in ENCODINGS) + " END"
    t = "(1 / (1 + 0.2316419 * abs(z)))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({found}),
u AS (SELECT doc_id, kind, least, f, g, parts, unnest(range(1, len(f) + 1)) AS i FROM m),
p AS (SELECT doc_id, kind, f[i] AS s, length(g[i]) >= least AS ok, length(f[i]) AS n, CAST(sum(length(parts[i]) + length(f[i])) OVER (PARTITION BY doc_id, kind ORDER BY i) AS INTEGER) AS e FROM u),
spans AS (SELECT doc_id, kind, s, e - n AS b, e FROM p WHERE ok),
base AS (SELECT * FROM spans WHERE kind < {len(KINDS)}),
r AS (SELECT *, rtrim(s, '=') AS bare FROM spans x WHERE kind = {len(KINDS)} AND NOT EXISTS (SELECT 1 FROM base y WHERE y.doc_id = x.doc_id AND y.b < x.e AND x.b < y.e)),
en AS (SELECT doc_id, b, e, bare, length(bare) AS n, {pick(2)} AS a, {pick(3)} AS same FROM r),
c AS (SELECT doc_id, b, n, length(a) AS k, same, j, strpos(a, bare[j]) - 1 AS x FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM en WHERE a IS NOT NULL)),
sq AS (SELECT doc_id, b, sum(q * q) AS squares FROM (SELECT doc_id, b, x, count(*) AS q FROM c GROUP BY doc_id, b, x) GROUP BY doc_id, b),
h AS (SELECT *, CASE WHEN x * 2 >= k THEN 1 ELSE 0 END AS high, x - avg(x) OVER (PARTITION BY doc_id, b) AS dev FROM c),
l AS (SELECT *, abs(high - lag(high) OVER w) AS turn, dev * lag(dev) OVER w AS lagged FROM h WINDOW w AS (PARTITION BY doc_id, b ORDER BY j)),
a AS (SELECT doc_id, b, any_value(n) AS n, any_value(k) AS k, any_value(same) AS same, sum(high) AS n1, 1 + coalesce(sum(turn), 0) AS changes, sum(dev * dev) AS whole, coalesce(sum(lagged), 0) AS lagged FROM l GROUP BY doc_id, b),
v AS (SELECT a.*, squares * k / n - n AS chi, CAST(k - 1 AS DOUBLE) AS df, n * (k * same - 1) AS shift, 2.0 * n1 * (n - n1) / n + 1 AS mean FROM a JOIN sq USING (doc_id, b)),
y AS (SELECT *, (df + 2 * shift) / (df + shift) AS scale, (df + shift) * (df + shift) / (df + 2 * shift) AS freedom, (mean - 1) * (mean - 2) / (n - 1) AS var FROM v),
z AS (SELECT doc_id, b, (pow(greatest(chi, 0) / scale / freedom, 1.0 / 3) - (1 - 2 / (9 * freedom))) / sqrt(2 / (9 * freedom)) AS zp, (pow(greatest(chi, 0) / df, 1.0 / 3) - (1 - 2 / (9 * df))) / sqrt(2 / (9 * df)) AS zc,
  CASE WHEN n1 = 0 OR n1 = n OR var <= 0 THEN NULL ELSE abs(changes - mean) / sqrt(var) END AS zr, CASE WHEN whole <= 0 THEN NULL ELSE abs(lagged / whole + 1.0 / n) * sqrt(n) END AS zs FROM y),
tails AS (SELECT doc_id, b, name, CASE WHEN z >= 0 THEN q ELSE 1 - q END AS p FROM (SELECT *, exp(-z * z / 2) * 0.3989422804014327 * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))) AS q FROM (SELECT doc_id, b, unnest(['plain', 'chi', 'runs', 'serial']) AS name, unnest([zp, zc, zr, zs]) AS z FROM z))),
w AS (SELECT doc_id, b, 1 - max(p) FILTER (name = 'plain') AS plain, least(1, 3 * min(CASE name WHEN 'chi' THEN p ELSE 2 * coalesce(p, 0) END) FILTER (name <> 'plain')) AS uniform FROM tails GROUP BY doc_id, b),
k AS (SELECT r.doc_id, r.b, r.e, coalesce(plain, 1) AS plain, coalesce(uniform, 0) AS uniform, r.e - r.b AS size FROM r LEFT JOIN w USING (doc_id, b)),
o AS (SELECT *, plain * sum(size) OVER (PARTITION BY doc_id) <= {FALSE_RATE} * sum(size) OVER (PARTITION BY doc_id ORDER BY plain RANGE UNBOUNDED PRECEDING) AS fits FROM k),
g AS (SELECT doc_id, {len(KINDS)} AS kind, b, e FROM (SELECT *, max(plain) FILTER (fits) OVER (PARTITION BY doc_id) AS most FROM o) WHERE plain <= most AND uniform >= {UNIFORM_P}),
every AS (SELECT doc_id, kind, b, e FROM base UNION ALL SELECT * FROM g),
said AS (SELECT *, {names}[kind + 1] || ':' || b || ':' || e AS text FROM every),
sums AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{k[0]}" for i, k in enumerate(KINDS))}, string_agg(text, ',' ORDER BY b, e, kind) FILTER (kind < {len(KINDS)}) AS base, string_agg(text, ',' ORDER BY b, e, kind) AS spans FROM said GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k[0]}, 0) AS n_{k[0]}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN sums USING (doc_id)
"""


SQL = _sql()
