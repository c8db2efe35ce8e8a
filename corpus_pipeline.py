"""A training-corpus pipeline: quality, near copies, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and
reread as the next one's ``docs``.  All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.shared import free_name
from tracelake.llm import decontamination, jaccard, packing, quality, substrings
from tracelake.llm.common import discard, written_tables

#: Documents whose probability of good quality is less are rejected.
LEAST_QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality, as they are.  Null and empty texts have the score of no evidence; equal rows share their fate;
    an empty table gives no rows; columns of any name stay, the score's name is one that they leave free."""
    network = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    into = free_name(docs.columns, "score")
    return quality.score(docs, network, into=into).filter(F.col(into) >= LEAST_QUALITY).drop(into)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: one of the smallest id, rows without an id behind all others.  Rows that repeat an id
    with another text are another document.  Null and wordless texts are copies of nothing and stay; other columns stay."""
    return jaccard.keep_one(docs, n=5, threshold=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the words of passages that an earlier one holds (ids in order, null ids last; of equal rows neither is
    earlier).  Null texts stay null; ``n_chars`` follows the text where there is such a column."""
    left = substrings.remove(docs, window=20)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no test item is found, whatever their ids are; null and empty texts stay; an item of fewer than five
    words is found as it stands; no items, no loss."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each row in sequences: a null or empty text is a piece of the end id alone, equal rows are packed each by itself."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024, end_id=2)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  Of what they write the returned rows alone stay."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with written_tables() as keep:
            docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*before)
        before = [docs]
    return docs
