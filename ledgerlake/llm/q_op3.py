"""op3: the language of every document, learned from the documents that are not held out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .language_id import predict, train

NAME = "op3_language_id"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = train(docs.filter(~F.coalesce(held, F.lit(False))), F.col("text"), F.col("lang"))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
