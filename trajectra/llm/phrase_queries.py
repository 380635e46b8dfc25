"""Queries over terms, repeated passages and phrases, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, lexical, substring_dedup


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=10)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')"
OP11_SQL = rf"""
WITH split AS (
  SELECT row_number() OVER () AS place, doc_id, {_TERMS} AS w FROM documents
), totals AS (
  SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM split
), wanted AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark
), tf AS (
  SELECT place, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT place, doc_id, w, unnest(w) AS term FROM split) SEMI JOIN wanted USING (term) GROUP BY ALL
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), impacts AS (
  SELECT place, doc_id, term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS impact
  FROM tf JOIN df USING (term), totals
), scores AS (
  SELECT item_id, doc_id, place, CAST(sum(impact) AS BIGINT) AS score FROM wanted JOIN impacts USING (term) GROUP BY ALL HAVING sum(impact) > 0
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_passages(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP12_SQL = rf"""
WITH split AS (
  SELECT row_number() OVER () AS place, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), starts AS (
  SELECT place, doc_id, i, sha256(array_to_string(w[i:i + {substring_dedup.WINDOW - 1}], ' ')) AS s FROM (SELECT place, doc_id, w, unnest(range(1, len(w) - {substring_dedup.WINDOW - 2})) AS i FROM split WHERE len(w) >= {substring_dedup.WINDOW})
), least AS (
  SELECT s, min(doc_id) AS first_id FROM starts GROUP BY s HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT place, unnest(range(i, i + {substring_dedup.WINDOW})) AS spot FROM starts JOIN least USING (s) WHERE first_id < coalesce(doc_id, 9223372036854775807)
), lists AS (
  SELECT place, list(spot) AS spots FROM gone GROUP BY place
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(spots), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN spots IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(spots, i)), lambda i: w[i]) END, ' '), '')) AS kept_sha256
FROM split LEFT JOIN lists USING (place)
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"), max_n=3, least=10, inside_percent=50, top=2000)


OP13_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{collocations.UNKNOWN}') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang
), grams AS (
  SELECT lang, size, phrase, count(*) AS f
  FROM (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM split, (VALUES (1), (2), (3)) sizes(size) WHERE len(w) >= size))
  GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT lang, size, phrase, f AS a, k, string_split(phrase, ' ') AS w FROM (SELECT lang, size, phrase, f, unnest(range(1, size)) AS k FROM grams WHERE size > 1)
), scored AS (
  SELECT c.lang, c.size, c.phrase, a, k, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
), best AS (
  SELECT lang, size, phrase, a, arg_min(l, k) AS l, arg_min(r, k) AS r, score FROM (SELECT *, min(score) OVER (PARTITION BY lang, phrase) AS least FROM scored) WHERE score = least GROUP BY lang, size, phrase, a, score
), free AS (
  SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM grams g WHERE g.lang = b.lang AND g.size > b.size AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * g.f >= 50 * b.a)
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM free
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

QUERIES = {"op11_lexical_search": op11_lexical_search, "op12_substring_dedup": op12_substring_dedup, "op13_collocations": op13_collocations}
ORACLES = {"op11_lexical_search": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_collocations": OP13_SQL}
