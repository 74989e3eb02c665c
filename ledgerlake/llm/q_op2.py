"""op2: drops lines of at least 40 characters that five documents share, but in the largest document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .line_dedup import keep_lines, line_dedup, with_bitmaps

NAME = "op2_line_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_bitmaps(docs, line_dedup(docs)).withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.split("text", "\n", -1)
    gone = F.aggregate(F.transform("keep_runs", lambda x, i: F.when(i % 2 == 1, x).otherwise(0)), F.lit(0), lambda a, x: a + x)
    kept = F.when(F.col("keep_runs").isNull(), F.col("text")).otherwise(F.array_join(keep_lines(lines, F.col("keep_runs")), "\n"))
    # splitting at one character gives one line more than the text has of it
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return found.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (c.n >= 5 AND k.doc_id <> c.top) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT coalesce(c.n >= 5 AND k.doc_id <> c.top, false)), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY k.doc_id
"""
