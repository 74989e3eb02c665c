"""op4: writes every page to WARC archives and reads them back."""

from pyspark.sql import DataFrame, SparkSession

from .common import new_folder, read_table
from .warc import register, with_revisits

NAME = "op4_warc"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = new_folder(spark, "warc")
    with_revisits(read_table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").option("payload", "digest").load(path)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
