"""From raw documents to token ids: each stage works on all documents that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_rules
from ledgerlake.llm.common import materialize, read_table
from ledgerlake.llm.q_op6 import tokenizer_path
from ledgerlake.sources.shared import discard, made


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, whose histograms are too far from their language's, or that lack its common words, go."""
    # the verdict takes the names of the operator's columns; what docs has under these names is set aside
    aside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text", "lang")
    return quality_rules.rules(aside, least_common=quality_rules.LEAST_COMMON, keep_text=False).filter("kept").select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents share stay in the largest of them only; n_chars follows the text."""
    aside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"), "doc_id", "text")
    found = line_dedup.with_bitmaps(aside, line_dedup.line_dedup(docs))
    kept = F.array_join(line_dedup.keep_lines(F.split("text", "\n", -1), F.col("keep_runs")), "\n")
    new = found.withColumn("text", F.when(F.col("keep_runs").isNull(), F.col("text")).otherwise(kept))
    size = F.when(F.col("keep_runs").isNull(), F.col("_row.n_chars")).otherwise(F.length("text").cast("long"))
    return new.select(*[F.col("text") if c == "text" else size.alias(c) if c == "n_chars" else F.col(f"_row.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more the one with the smallest id stays."""
    return jaccard_join.keep_one(docs, n=5, num=80, den=100)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verbatim benchmark match of 13 words or more go."""
    return decontaminate.remove(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids as little-endian unsigned 32-bit integers, decoded_sha256)."""
    done = bpe.encode_decode(docs, tokenizer_path())
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("decontamination", benchmark_free), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        before = set(made())
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        mine = [f for f in made() if f not in before]
        discard(spark, last + mine[:-1])  # all but this stage's result, which is written
        last = mine[-1:]
    return docs


#: The tokenizer's merges are not expressible in SQL.
ORACLE_SQL = None
