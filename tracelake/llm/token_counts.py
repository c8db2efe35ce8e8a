"""Token counts through a digest cache.

Each text's digest is joined with the stored counts of this tokenizer version; only
distinct texts that miss are encoded, and their counts are appended to the cache.  The
normalisation is the one that can never change a count: a null text is the empty text.  A bit
table of the missing digests, of bounded size, keeps texts that hit out of the exchange.

Nulls: a null text counts as empty (0 tokens); a null id is kept.  Repeated rows and
equal texts are encoded once and each row gets its own result row.  An empty table gives
no rows.  Extra columns are ignored; very long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from importlib.metadata import version

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_dir
from ..functions.ship import ship
from .bpe import encoder
from .common import bit_table, discard, materialize, may_hold

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """A digest of the file and of the library that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library} {version(library)}".encode()).hexdigest()


def open_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """digest, n_tokens of the counts stored for this tokenizer version; none if there is no cache yet."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    # two writers may have stored the same digest; their counts are equal
    return stored.filter(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _counter(tokenizer_path: str):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(tokenizer_path)
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.iloc[i : i + 500]
                yield pd.DataFrame({"digest": part["digest"], "n_tokens": [len(x) // 4 for x in e.encode(part["text"].tolist())]})

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, n_tokens, over_limit, cached (its count was stored before)."""
    spark, tokenizer = docs.sparkSession, tokenizer_version(tokenizer_path)
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("digest"))
    rows = materialize(keyed.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    stored = open_cache(spark, cache_path, tokenizer)
    missing = materialize(rows.select("digest").distinct().join(stored, "digest", "left_anti").select("digest", F.xxhash64("digest").alias("h")), "missing")
    if not missing.isEmpty():
        likely = may_hold(keyed.select("digest", "text", F.xxhash64("digest").alias("h")), "h", *bit_table(missing, "h"))
        texts = likely.groupBy("digest").agg(F.first("text").alias("text")).join(missing, "digest", "left_semi")
        fresh = texts.select("digest", "text").mapInPandas(_counter(tokenizer_path), "digest binary, n_tokens long")
        run = uuid.uuid4().hex
        fresh.select("digest", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(f"{cache_path}/run={run}")
    # written once more, so that the join below stands alone and a text that many rows share can be split
    new = F.col("h").isNull().alias("cached")
    counts = materialize(open_cache(spark, cache_path, tokenizer).join(missing, "digest", "left").select("digest", "n_tokens", new), "counts")
    discard(missing)
    return rows.join(counts, "digest", "left").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cached")


def new_cache(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
