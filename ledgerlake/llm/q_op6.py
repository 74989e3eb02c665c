"""op6: every document's token ids and what they decode to."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode
from .common import read_table

NAME = "op6_bpe"
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode_decode(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
