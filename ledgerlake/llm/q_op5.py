"""op5: low quality, then toxicity, of every document, by a chain learned from the labels."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .toxicity import predict, train

NAME = "op5_toxicity"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return predict(docs, train(docs, labels, ["low_quality", "toxic"]))
