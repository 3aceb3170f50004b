"""A corpus in five stages: quality, near copies, repeated passages, source mixing, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookframe.llm import minhash, mixing, packing, quality, substring
from brookframe.llm.scratch import Scratch, disposable


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It is fitted on labelled rows of docs.

    Nulls, empty texts, texts of any length, repeated rows and further columns: as `keep_good` says; none is dropped but by its score.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit_quality(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id.

    Null and empty texts, and rows with a null doc_id, stay; of repeated rows of one doc_id one stays.
    """
    return minhash.drop_near_duplicates(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that occur anywhere else go from all texts; a text without any stays as it is.

    A document of which nothing is left stays, with an empty text. A null text stays null. Repeated rows repeat each other, so
    passages of 35 words go from all of them. Texts are read whole; further columns pass through.
    """
    found = substring.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of sources below their weight occur again; none is lost.

    A null source is a source; rows with a null doc_id occur once; null and empty texts are documents without words.
    """
    return mixing.mixed_documents(docs)


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, placed in sequences of 2048 tokens.

    A null or empty text is one piece, the end id; repeated rows are documents of their own.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("source_mixing", source_mixing),
    ("token_packing", token_packing),
]

#: SQL cannot express the first stage; tests/llm compare the others with brute force on its output.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's output is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        with disposable():  # the stage's own tables go when its output is written
            before, docs = docs, scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
