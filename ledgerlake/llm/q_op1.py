"""op1: formats all conversations and one of control strings, and reads them back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_chats, loss_text, read_back
from .common import let, read_table

NAME = "op1_chat_format"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    out = format_chats(rows.unionByName(more))
    digest = lambda turns: F.struct(
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
    )
    loss = lambda text: F.struct(F.length(text).cast("long").alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"))
    return out.select(
        "conv_id", let(read_back(F.col("formatted")), digest).alias("a"), let(loss_text(F.col("formatted"), F.col("loss_spans")), loss).alias("b"), F.length("formatted").cast("long").alias("formatted_chars")
    ).select("conv_id", "a.*", "b.*", "formatted_chars")


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?s>)', '\1\\\2\3', 'g')) AS n,
    length(regexp_replace(role, '([\[<])(\\*)(/?INST\]|/?s>)', '\1\\\2\3', 'g')) AS r,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS opens
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + 13 + CASE WHEN opens THEN r + 7 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
