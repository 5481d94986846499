"""The queries of this subpackage, each over a whole table with production parameters, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import decontaminate, html_extract, lang_id, license_scan, lm_score, near_dedup, packing, quality_classifier, quality_rules, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.train_and_predict(_documents(spark, sf_dir))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_documents(spark, sf_dir)).select("doc_id", "class_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score.score(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", F.round("log_prob", 4).alias("log_prob"), F.round("mean_log_prob", 6).alias("mean_log_prob"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_documents(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(_documents(spark, sf_dir))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_quality_classifier, op3_warc, op4_near_dedup, op5_decontamination, op6_lm_score, op7_packing, op8_license_scan, op9_quality_rules, op10_html_extraction)
}

#: DuckDB. Absent: a model's or a tokenizer's verdicts, alignments, packing, markup and rules of licences; tests check those by brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS x FROM p),
d AS (SELECT x, list_reduce(list_transform([1, 6, 11, 16, 21, 26, 31, 36], lambda i: (
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(x, i, 5))::INT // 32768) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(x, i, 5))::INT // 1024) % 32 + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(x, i, 5))::INT // 32) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ('0x' || substr(x, i, 5))::INT % 32 + 1, 1))), lambda a, b: a || b) AS payload_digest,
    max(page_id) AS first FROM h GROUP BY x)
SELECT h.page_id, h.payload_bytes, d.payload_digest, CASE WHEN h.page_id = d.first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN h.page_id <> d.first THEN d.first END AS refers_to FROM h JOIN d USING (x)""",
    "op4_near_dedup": """
WITH RECURSIVE t AS (SELECT doc_id, text, string_split_regex(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
n AS (SELECT text, min(doc_id) AS node, any_value(w) AS w FROM t GROUP BY text),
e AS (SELECT node, s, count(*) AS c FROM (SELECT node, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
    FROM (SELECT node, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM n WHERE len(w) > 0 AND w <> [''])) GROUP BY 1, 2),
z AS (SELECT node, sum(c) AS m FROM e GROUP BY node),
c AS (SELECT a.node AS a, b.node AS b, sum(least(a.c, b.c)) AS k FROM e a JOIN e b ON a.s = b.s AND a.node < b.node GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN z x ON x.node = a JOIN z y ON y.node = b WHERE k / (x.m + y.m - k) >= 0.8),
g AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, seen) AS (SELECT node, node FROM n UNION SELECT r.node, g.b FROM r JOIN g ON g.a = r.seen),
k AS (SELECT node, min(seen) AS class_id FROM r GROUP BY node)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN d.doc_id ELSE k.class_id END AS class_id FROM documents d LEFT JOIN n ON n.text = d.text LEFT JOIN k ON k.node = n.node""",
    "op6_lm_score": """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT r, i, w[i] AS w0, CASE WHEN i > 1 THEN w[i - 1] END AS w1, CASE WHEN i > 2 THEN w[i - 2] END AS w2 FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0)),
c1 AS (SELECT w0, count(*) AS n FROM t GROUP BY 1),
c2 AS (SELECT w1, w0, count(*) AS n FROM t WHERE w1 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2),
c3 AS (SELECT w2, w1, w0, count(*) AS n FROM t WHERE w2 IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2),
s AS (SELECT t.r, CASE WHEN c3.n IS NOT NULL THEN ln(c3.n / b.n) WHEN c2.n IS NOT NULL THEN ln(c2.n / a.n) + (t.i > 2)::INT * ln(0.4)
    ELSE ln(c1.n / (SELECT sum(n) FROM c1)) + least(t.i - 1, 2) * ln(0.4) END AS x
    FROM t JOIN c1 ON c1.w0 = t.w0 LEFT JOIN c1 a ON a.w0 = t.w1 LEFT JOIN c2 ON c2.w1 = t.w1 AND c2.w0 = t.w0 LEFT JOIN c2 b ON b.w1 = t.w2 AND b.w0 = t.w1 LEFT JOIN c3 ON c3.w2 = t.w2 AND c3.w1 = t.w1 AND c3.w0 = t.w0),
g AS (SELECT r, sum(x) AS x, count(*) AS n FROM s GROUP BY r)
SELECT d.doc_id, coalesce(g.n, 0)::BIGINT AS n_words, round(g.x, 4) AS log_prob, round(g.x / g.n, 6) AS mean_log_prob FROM d LEFT JOIN g ON g.r = d.r""",
}
