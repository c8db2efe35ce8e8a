"""Shards by extendible hashing.

A directory is indexed by the first bits of a key's hash.  Only buckets over the byte limit
split on another bit; the directory's cells of all others keep pointing to the shorter
prefix.  Six bits are looked at in a round, and only rows of buckets that are still too
large go into the next one, so that the rounds grow with the logarithm of the data.

Nulls: a null text has 0 bytes; null keys hash alike and stay together.  Rows of one key
cannot be told apart by bits: they stay in one shard, which is marked ``oversize`` if it is
over the limit, as is that of a single larger row.  An empty table gives no rows.  Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BITS = 60
STEP = 6


def shard(docs: DataFrame, *, max_bytes: int, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, n_bytes, shard_depth (bits), shard_prefix (their value), shard_bytes, oversize of each row."""
    text = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")
    left = materialize(docs.select(F.col(key), text.alias("n_bytes"), h.alias("h")), "keys")
    done, depth = [], 0
    while True:
        to = min(depth + STEP, BITS)
        cell = F.shiftright(F.col("h"), BITS - to)
        cells = left.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        levels = cells.select("*", F.explode(F.sequence(F.lit(depth), F.lit(to))).alias("d"))
        prefix = F.expr(f"shiftright(cell, cast({to} - d as int))")
        buckets = levels.groupBy("d", prefix.alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        whole = buckets.filter((F.col("bytes") <= max_bytes) | (F.col("lo") == F.col("hi")) | (F.col("d") == BITS))
        of_cell = levels.select("cell", "d", prefix.alias("prefix")).join(whole, ["d", "prefix"])
        directory = materialize(of_cell.groupBy("cell").agg(F.min_by(F.struct("d", "prefix", "bytes"), "d").alias("bucket")), "directory")
        found = left.withColumn("cell", cell).join(directory, "cell", "left")
        done.append(found.filter(F.col("bucket").isNotNull()))
        rest = found.filter(F.col("bucket").isNull()).select(key, "n_bytes", "h")
        if to == BITS or rest.isEmpty():
            break
        left, depth = materialize(rest, "keys"), to
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(key, "n_bytes", F.col("bucket.d").alias("shard_depth"), F.col("bucket.prefix").alias("shard_prefix"), F.col("bucket.bytes").alias("shard_bytes"), (F.col("bucket.bytes") > max_bytes).alias("oversize"))
