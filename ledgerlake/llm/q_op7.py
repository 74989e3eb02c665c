"""op7: base quality counts and the verdict of distribution divergence, for every document."""

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .quality_rules import _DIGIT, _MARK, _SYMBOL, _UPPER, COMMON, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MIN_WORDS, OTHER, _list_of, rules

NAME = "op7_quality_rules"
COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep_text=False).select(*COLUMNS)


def _sql() -> str:
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    lists = " ".join(f"WHEN '{k}' THEN {quoted(_list_of(k))}" for k in COMMON) + f" ELSE {quoted(_list_of(OTHER))}"
    count = lambda p: "len(regexp_extract_all(text, '" + p.replace("'", "''") + "'))"
    js = lambda p, q: f"sqrt(greatest(list_sum([CASE WHEN x[1] > 0 THEN x[1] * log2(x[1] * 2 / (x[1] + x[2])) ELSE 0 END + CASE WHEN x[2] > 0 THEN x[2] * log2(x[2] * 2 / (x[1] + x[2])) ELSE 0 END FOR x IN list_zip({p}, {q})]) / 2, 0))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({", ".join(f"'{k}'" for k in COMMON)}) THEN lang ELSE '{OTHER}' END AS k FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, CASE k {lists} END AS common FROM d),
c AS (SELECT *, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, {count(_SYMBOL)} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  {count(_UPPER)} AS cu, {count(_DIGIT)} AS cd, {count(_MARK)} AS cm, octet_length(encode(text)) - length(text) AS cw,
  list_transform(common, lambda x: len(list_filter(ws, lambda y: y = x))) AS cc FROM w),
g AS (SELECT doc_id, unnest(range(n_words - 7)) AS i, ws FROM c WHERE n_words >= 8),
v AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 8], ' ') AS s FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM v) WHERE n > 1),
u AS (SELECT doc_id, sum(least(8, coalesce(i - before, 8))) AS n_repeat_words FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r) GROUP BY doc_id),
h AS (SELECT *, [cu, cd, cm, n_symbols, length(text) - word_chars, cw, greatest(length(text) - (cu + cd + cm + n_symbols + length(text) - word_chars + cw), 0)] AS chars,
  list_append(cc, n_words - coalesce(list_sum(cc), 0)) AS counts FROM c),
s AS (SELECT *, list_transform(chars, lambda x: x / greatest(list_sum(chars), 1)) AS cs, list_transform(counts, lambda x: x / greatest(list_sum(counts), 1)) AS wsh FROM h),
f AS (SELECT k, list(m ORDER BY i) AS cr FROM (SELECT k, i, avg(cs[i]) AS m FROM s, range(1, 8) t(i) WHERE n_words >= {MIN_WORDS} GROUP BY k, i) GROUP BY k),
e AS (SELECT k, list(m ORDER BY i) AS wr FROM (SELECT k, i, avg(wsh[i]) AS m FROM s, range(1, {len(_list_of(OTHER)) + 2}) t(i) WHERE n_words >= {MIN_WORDS} AND i <= len(wsh) GROUP BY k, i) GROUP BY k),
z AS (SELECT s.*, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS nr, CASE WHEN n_words >= {MIN_WORDS} THEN {js("cs", "cr")} ELSE 0 END AS dc, CASE WHEN n_words >= {MIN_WORDS} THEN {js("wsh", "wr")} ELSE 0 END AS dw
  FROM s LEFT JOIN u USING (doc_id) LEFT JOIN f USING (k) LEFT JOIN e USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, nr AS n_repeat_words, n_words < 20 OR 100 * nr > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * nr > 30 * n_words) AND dc <= {MAX_CHAR_DISTANCE} AND dw <= {MAX_WORD_DISTANCE} AS kept FROM z
"""


SQL = _sql()
