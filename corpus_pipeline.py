"""From raw documents to token ids: quality, lines, near copies, benchmark leaks, encoding.

Each stage takes the documents that its predecessor kept and returns a table with the columns of
``documents``; the last one adds their ids.  ``run`` writes every stage as Parquet to the shared
scratch folder and goes on from there, so a lost executor costs the tasks of one stage only.

A stage begins by giving back the space of the tables that the stage before wrote on its way: its
result is written by then.  A result that is still to be read must be written before the next stage is called.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablevet.llm import bpe
from tablevet.llm.decontaminate import benchmark_hits
from tablevet.llm.fuzzy_lines import without_repeated_lines
from tablevet.llm.kneser_ney import rated
from tablevet.llm.parity_join import one_of_each_component
from tablevet.sources.scratch import booked, give_back, staged

VOCABULARY = "byte_bpe_50k.json"
CACHED_WORDS = 60_000  # workers have run other stages before and keep some of their memory

_left: list[str] = []  # what the stage before wrote on its way


def _stage(function: Callable) -> Callable:
    @wraps(function)
    def own(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        done = [path for path in _left if not any(path.rsplit("/", 1)[1] in file for file in read)]
        _left[:] = [path for path in _left if path not in done]
        give_back(spark, done)
        with booked() as paths:
            out = function(spark, docs, sf_dir)
        _left.extend(paths)
        return out

    return own


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rated(docs, labels).filter("accepted").select(*docs.columns)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that nearly repeat an earlier one; those left without text go."""
    return without_repeated_lines(docs)


@_stage
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return one_of_each_component(docs, shingle_words=5, percent=80)


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no near copy of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return benchmark_hits(docs, benchmark).filter("size(item_ids) = 0").select(*docs.columns)


@_stage
def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    vocabulary = bpe.read_vocabulary(public_tokenizers.path(VOCABULARY))
    found = bpe.round_trip(docs.withColumn("source_text", F.coalesce("text", F.lit(""))), vocabulary, CACHED_WORDS)
    same = (F.col("decoded") == F.col("source_text")).alias("round_trip")
    return found.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("bigint").alias("n_tokens"), same)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Signatures, language models and encodings have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
