"""The training-data operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablevet.llm import bpe
from tablevet.llm.adaptive_rules import judged, judged_sql
from tablevet.llm.decontaminate import benchmark_hits
from tablevet.llm.fuzzy_lines import line_components
from tablevet.llm.graph_index import nearest
from tablevet.llm.kneser_ney import rated
from tablevet.llm.licences import scan_licences
from tablevet.llm.parity_join import similar_documents
from tablevet.llm.ppm import score_documents
from tablevet.llm.templates import main_texts
from tablevet.llm.turn_repair import damaged, repaired_conversations, repaired_sql
from tablevet.llm.warc_fixity import as_records, audit, record_text
from tablevet.llm.word_variants import damaged_words, variants, variants_sql, vocabulary
from tablevet.sources.scratch import staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(_table(spark, sf_dir, "documents"), shingle_words=3, percent=90)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op3_warc_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a replica of all pages in which some records are changed, cut short or lost.

    The replica is made from the same pages by rules on page_id, each record at its old place.
    """
    body = F.expr(
        "CASE WHEN page_id % 211 = 7 THEN overlay(html PLACING '#' FROM 40 FOR 1)"
        " WHEN page_id % 499 = 3 THEN left(html, length(html) - 16) ELSE html END"
    )
    one, two = record_text(F.col("url"), F.col("html")), record_text(F.col("url"), body)
    pages = _table(spark, sf_dir, "pages").select(
        "page_id",
        F.octet_length(one).alias("length"), F.sha2(one, 256).alias("digest"),
        F.octet_length(two).alias("replica_length"), F.sha2(two, 256).alias("replica_digest"),
    )
    placed = staged(as_records(pages))
    replica = placed.filter("coalesce(page_id % 997 != 5, true)")
    replica = replica.selectExpr("file", "offset", "replica_length AS length", "replica_digest AS digest")
    found = audit(placed.select("file", "offset", "length", "digest"), replica)
    names = placed.select("file", "offset", "page_id")
    return found.join(names, ["file", "offset"]).select(
        "page_id", "file", "offset", "status",
        F.col("length").cast("bigint").alias("length"), F.col("replica_length").cast("bigint").alias("replica_length"),
    )


OP3_SQL = r"""
WITH bodies AS (
    SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS one,
        CASE WHEN page_id % 211 = 7 THEN substr(html, 1, 39) || '#' || substr(html, 41)
             WHEN page_id % 499 = 3 THEN substr(html, 1, greatest(length(html) - 16, 0))
             ELSE coalesce(html, '') END AS two
    FROM pages),
records AS (
    SELECT page_id,
        'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
        || chr(13) || chr(10) || 'Content-Length: ' || strlen(one) || chr(13) || chr(10) || chr(13) || chr(10) || one
        || chr(13) || chr(10) || chr(13) || chr(10) AS one,
        'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
        || chr(13) || chr(10) || 'Content-Length: ' || strlen(two) || chr(13) || chr(10) || chr(13) || chr(10) || two
        || chr(13) || chr(10) || chr(13) || chr(10) AS two
    FROM bodies),
placed AS (
    SELECT page_id, CAST(page_id // 1000 AS BIGINT) AS file, one, two,
        CAST(coalesce(sum(strlen(one)) OVER (PARTITION BY page_id // 1000 ORDER BY page_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
    FROM records)
SELECT page_id, file, "offset", CASE WHEN page_id % 997 = 5 THEN 'missing' ELSE 'changed' END AS status,
    CAST(strlen(one) AS BIGINT) AS length,
    CAST(CASE WHEN page_id % 997 != 5 THEN strlen(two) END AS BIGINT) AS replica_length
FROM placed WHERE page_id % 997 = 5 OR one != two
"""


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "lang", "perplexity", "least_perplexity", "threshold", "accepted")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_components(_table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "line_no", "kept", "first_doc_id", "first_line_no")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter("vec_id % 20 = 0"), k=20)


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.with_digests(bpe.round_trip(docs, vocabulary))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_hits(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.size("item_ids").cast("bigint").alias("n_items"), "item_ids")


def _as_files(docs: DataFrame) -> DataFrame:
    """The documents laid out as a tree, for the table has no paths.

    Directories are source, language and the number's hundreds.  Every tenth document is the
    licence file of its directory, every hundredth of its language, every thousandth of its source.
    """
    path = """CASE WHEN doc_id % 1000 = 0 THEN concat_ws('/', source, concat('LICENSE-', doc_id))
        WHEN doc_id % 100 = 0 THEN concat_ws('/', source, lang, concat('LICENSE-', doc_id))
        WHEN doc_id % 10 = 0 THEN concat_ws('/', source, lang, CAST(doc_id DIV 100 AS STRING), concat('LICENSE-', doc_id))
        ELSE concat_ws('/', source, lang, CAST(doc_id DIV 100 AS STRING), concat(doc_id, '.txt')) END"""
    return docs.selectExpr("doc_id", f"{path} AS path", "text", "doc_id % 10 = 0 AS is_licence_file")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(_as_files(_table(spark, sf_dir, "documents")))
    doc_id = F.regexp_extract("path", r"(\d+)(\.txt)?$", 1).cast("bigint").alias("doc_id")
    return found.select(doc_id, "path", "licence", F.round("cosine", 6).alias("cosine"), "origin", "source_path")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_texts(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(damaged_words(_table(spark, sf_dir, "documents"))))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(damaged(_table(spark, sf_dir, "conversations")))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_warc_merkle_fixity": op3_warc_merkle_fixity,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_nearest_neighbours": op5_nearest_neighbours,
        "op6_line_dedup": op6_line_dedup,
        "op7_bpe_roundtrip": op7_bpe_roundtrip,
        "op8_benchmark_decontamination": op8_benchmark_decontamination,
        "op9_license_scans": op9_license_scans,
        "op10_html_extraction": op10_html_extraction,
        "op11_quality_rules": op11_quality_rules,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_conversation_repair": op13_conversation_repair,
    }


def llm_oracles() -> dict[str, str]:
    return {
        "op3_warc_merkle_fixity": OP3_SQL,
        "op11_quality_rules": judged_sql(),
        "op12_spelling_variants": variants_sql(),
        "op13_conversation_repair": repaired_sql(),
    }
