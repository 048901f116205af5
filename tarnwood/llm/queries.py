"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwood.llm import decontaminate, fingerprint, html, line_dedup, near_dedup, packing, tokens, toxicity, urls, warc

#: The remainder of crc32(doc_id) that marks documents whose labels are held out, and the modulus.
HELD_OUT, FOLDS = 2, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS)) == HELD_OUT


def toxicity_model(documents: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.train(documents, labels.where(~held_out()))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    pieces = tokens.pieces(documents, vocabulary("word_bpe_49k.json"))
    return packing.pack(pieces, n_docs=documents.count())


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.array_join(F.col("__tw_removed").cast("array<string>"), ",")
    return out.select(
        "doc_id", F.col("__tw_n_lines").alias("n_lines"), F.size("__tw_removed").cast("long").alias("n_links"), removed.alias("removed_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op5_line_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.links(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity_model(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_token_counts, op3_warc_archive, op4_html_main_text, op5_line_dedup, op5_line_links, op6_decontamination, op7_hyperminhash, op8_order_minhash, op9_toxicity, op10_url_filter)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op3_warc_archive": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT h, min(page_id) AS keeper FROM p GROUP BY h)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(p.h, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM p JOIN k USING (h)""",
    "op5_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS place FROM documents),
sets AS (
  SELECT doc_id, place, line, list_sort(list_distinct(regexp_extract_all({_LOWER.replace("text", "line")}, '[^\x20\x09-\x0D]+'))) AS words FROM lines),
ranked AS (SELECT words, min((doc_id, place)) AS first FROM sets WHERE len(words) > 0 GROUP BY words),
numbered AS (SELECT words, first, row_number() OVER (ORDER BY first) AS s FROM ranked),
tokens AS (SELECT s, len(words) AS n, unnest(words) AS w FROM numbered),
freq AS (SELECT w, count(*) AS c FROM tokens GROUP BY w),
placed AS (SELECT s, n, w, row_number() OVER (PARTITION BY s ORDER BY c, w) AS r FROM tokens JOIN freq USING (w)),
prefix AS (SELECT s, n, w FROM placed WHERE r <= n - ceil(0.75 * n) + 1),
pairs AS (SELECT DISTINCT y.s AS y, x.s AS x FROM prefix y JOIN prefix x ON y.w = x.w AND x.s < y.s AND 4 * least(x.n, y.n) >= 3 * greatest(x.n, y.n)),
near AS (
  SELECT DISTINCT y FROM pairs JOIN numbered a ON a.s = y JOIN numbered b ON b.s = x
  WHERE 4 * len(list_intersect(a.words, b.words)) >= 3 * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)))),
marked AS (
  SELECT sets.doc_id, sets.place, sets.line, n.s IS NOT NULL AND ((sets.doc_id, sets.place) <> n.first OR near.y IS NOT NULL) AS gone
  FROM sets LEFT JOIN numbered n ON n.words = sets.words LEFT JOIN near ON near.y = n.s)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_links,
  coalesce(string_agg(place::VARCHAR, ',' ORDER BY place) FILTER (WHERE gone), '') AS removed_lines,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op7_hyperminhash": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n - count(*) AS u, count(*) AS c FROM rows a JOIN rows b ON a.g = b.g AND a.doc_id < b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n),
links AS (SELECT a, b FROM common WHERE 100 * c >= 75 * u),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT both_ways.a, reach.r FROM reach JOIN both_ways ON both_ways.b = reach.a WHERE reach.r < both_ways.a),
component AS (SELECT a, min(r) AS c FROM reach GROUP BY a)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, c = sets.doc_id AS kept FROM sets JOIN component ON a = sets.doc_id""",
}
