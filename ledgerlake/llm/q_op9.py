"""op9: documents connected by 3-word shingle sets of Jaccard similarity 0.9 or more."""

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .jaccard_join import jaccard_components

NAME = "op9_jaccard_join"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(CASE WHEN len(w) < 3 THEN w ELSE w[i + 1:i + 3] END, ' ')) AS h FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (h) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r AS (SELECT doc_id AS v, doc_id AS m FROM d UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.v WHERE r.m < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.m) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.v = d.doc_id GROUP BY d.doc_id, n.n
"""
