"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of shingles.  For each partition the documents
are cut into overlapping windows a little longer than its items, so that an item inside a
long document nearly fills one window: containment then bounds Jaccard similarity from
below, and enough independent MinHash values (one to a band) find it all but surely.
Documents meet items through the MinHash values only: a bit table made from the items, of
64 bits a value or more and 64 MB at most, keeps values that no item has from ever leaving a task.  Candidates are verified
by exact containment: shingles that items may have are sent as text and counted.

Words are runs of letters and digits, A-Z in lower case; a shingle is ``n`` words, or all of
a shorter item's words.  Nulls: null or wordless texts match nothing; ``find`` names no document
without an id, ``decontaminate`` judges each row by its text, whatever its id is.  Items without
an id take no part.  Equal items are matched each by itself, repeated rows of an id count as one document.  Empty
tables give no rows.  Extra columns are ignored; texts of any length are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import free_name
from ..functions.ship import ship
from .common import ALNUM_LOWER, materialize, mix, ngrams, released, slices, words

#: A window is twice as long as the longest item of its class and an item half as long as that at least, so a containment
#: of 0.8 means a similarity of 0.19 or more with some window: one of 64 values agrees but for 1 in 700,000.
PERMUTATIONS = 64
_LEAST_BITS, _MOST_BITS = 24, 29
_SALT = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)


def _minhash(grams: np.ndarray) -> np.ndarray:
    """The least value under each permutation."""
    return np.array([(grams * s).min() for s in _SALT], np.uint64)


def _named(values: np.ndarray, band: np.ndarray | int, kind: int) -> np.ndarray:
    return mix(values ^ mix(np.asarray(band).astype(np.uint64) * np.uint64(64) + np.uint64(kind)))


def size_class(shingles: int) -> int:
    """Items of one class differ in size by less than two times."""
    return int(shingles).bit_length() - 1


def _text_of(w, i: int, n: int) -> str:
    a, b = w.start[i], w.end[i + n - 1]
    return " ".join(bytes(w.data[x:y]).translate(_LOWER).decode() for x, y in zip(w.start[i : i + n], w.end[i : i + n])) if b > a else ""


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _maybe(table: np.ndarray, bits: int, x: np.ndarray) -> np.ndarray:
    """Whether both bits of each number are set."""

    def has(at: np.ndarray) -> np.ndarray:
        at = (at & np.uint64((1 << bits) - 1)).astype(np.int64)
        return (table[at >> 3] >> (at & 7)) & 1 != 0

    found = has(x)
    found[found] = has(x[found] >> np.uint64(32))
    return found


def find(docs: DataFrame, items: DataFrame, *, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """id, item id, item_shingles, shared, containment of each document that holds ``threshold`` of an item's shingles."""
    spark = docs.sparkSession
    ship(spark)
    id_kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, id_col), (items, item_col)))

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w, ids, out = words(part.column(1), ALNUM_LOWER), part.column(0), []
                for d in range(len(ids)):
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    if a == b:
                        continue
                    size = min(n, b - a)
                    grams = ngrams(w.hash[a:b], size)
                    texts = {g: _text_of(w, a + i, size) for i, g in enumerate(grams.tolist())}
                    kind = size_class(len(texts))
                    keys = _named(_minhash(grams), np.arange(PERMUTATIONS), kind)
                    out.append((ids[d].as_py(), size, len(texts), kind, keys.view(np.int64).tolist(), list(texts.values()), np.array(list(texts), np.uint64).view(np.int64).tolist()))
                cols = list(zip(*out)) or [[]] * 7
                kinds = [ids.type, pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["item", "size", "item_shingles", "kind", "keys", "shingles", "grams"])

    profile = materialize(
        items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
        .filter(F.col("item").isNotNull())
        .mapInArrow(of_items, f"item {item_kind}, size int, item_shingles long, kind int, keys array<long>, shingles array<string>, grams array<long>"),
        "items",
    )
    # what leaves the executors is bounded: bit tables of 2**_MOST_BITS bits at most, and one row for each size class
    def places(column: str) -> tuple[np.ndarray, int]:
        x = profile.select(F.explode(column).alias("x"))
        bits = min(_MOST_BITS, max(_LEAST_BITS, (64 * x.count()).bit_length()))
        both = F.explode(F.array("x", F.shiftrightunsigned("x", 32))).alias("x")
        place = F.col("x").bitwiseAND((1 << bits) - 1) + 1
        parts = x.select(both).groupBy(F.bitmap_bucket_number(place).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        table = np.zeros(1 << bits - 3, np.uint8)
        for r in parts.toLocalIterator():  # pieces of 4 KB
            table[(r["n"] - 1) * 4096 : r["n"] * 4096] = np.frombuffer(r["bits"], np.uint8)
        return table, bits

    kinds = {r["kind"]: r["most"] for r in profile.filter(F.col("size") == n).groupBy("kind").agg(F.max("item_shingles").alias("most")).collect()}
    short = [r["size"] for r in profile.filter(F.col("size") < n).select("size").distinct().collect()]
    shared = spark.sparkContext.broadcast((places("keys"), places("grams"), kinds, short))

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_of, grams_of = shared.value[:2]

        for batch in batches:
            for part in slices(batch):
                ids = part.column(0)
                w = words(part.column(1), ALNUM_LOWER)
                out_doc, out_key, out_text = [], [], []
                # MinHash values of windows; windows run over all texts of the batch, their documents' ends excepted
                if len(w.hash) >= n:
                    grams, doc = ngrams(w.hash, n), w.doc_of()
                    inside = np.flatnonzero(doc[: len(grams)] == doc[n - 1 :])
                    grams, doc = grams[inside], doc[inside]
                    first = np.searchsorted(doc, np.arange(len(ids) + 1))
                    for band, salt in enumerate(_SALT if len(grams) else ()):
                        hashed = grams * salt
                        for kind, most in shared.value[2].items():
                            width, step = 2 * most, most
                            n_win = np.maximum(0, -(-(np.diff(first) - width) // step)) + (np.diff(first) > 0)
                            of = np.repeat(np.arange(len(ids)), n_win)
                            k = np.arange(len(of)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
                            lo = first[of] + k * step
                            hi = np.minimum(lo + width, first[of + 1])
                            values = np.minimum.reduceat(np.concatenate((hashed, hashed[-1:])), np.stack((lo, hi), 1).ravel())[::2]
                            keys = _named(values, band, kind)
                            hit = np.flatnonzero(_maybe(*keys_of, keys))
                            out_doc.append(of[hit])
                            out_key.append(keys[hit])
                for size in sorted({n, *shared.value[3]}):
                    if len(w.hash) < size:
                        continue
                    grams, doc = ngrams(w.hash, size), w.doc_of()
                    hit = _maybe(*grams_of, grams) & (doc[: len(grams)] == doc[size - 1 :])
                    for i in np.flatnonzero(hit).tolist():
                        out_text.append((int(doc[i]), _text_of(w, i, size)))
                at = np.concatenate(out_doc) if out_doc else np.zeros(0, np.int64)
                keys = np.concatenate(out_key) if out_key else np.zeros(0, np.uint64)
                pairs = np.unique(np.stack((at.astype(np.int64), keys.view(np.int64)), 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
                texts = sorted(set(out_text))
                rows = np.concatenate((pairs[:, 0], np.array([d for d, _ in texts], np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array([*pairs[:, 1].tolist(), *[None] * len(texts)], pa.int64()), pa.array([*[None] * len(pairs), *[t for _, t in texts]], pa.string())],
                    names=["doc", "key", "shingle"],
                )

    hits = materialize(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter(F.col("doc").isNotNull()).mapInArrow(released(of_docs), f"doc {id_kind}, key long, shingle string"), "hits")
    bands = profile.filter(F.col("size") == n).select("item", F.explode("keys").alias("key"))
    found = hits.filter(F.col("key").isNotNull()).select("doc", "key").join(bands, "key").select("doc", "item").distinct()
    shingles = profile.select("item", "size", "item_shingles", F.explode("shingles").alias("shingle"))
    shares = hits.filter(F.col("shingle").isNotNull()).select("doc", "shingle").join(shingles, "shingle").groupBy("doc", "item", "size", "item_shingles").agg(F.count_distinct("shingle").alias("shared"))
    enough = shares.filter(F.col("shared") >= F.lit(threshold) * F.col("item_shingles"))
    # items shorter than a shingle are their one shingle: finding it is finding them
    held = enough.filter(F.col("size") < n).unionByName(enough.filter(F.col("size") == n).join(found, ["doc", "item"], "left_semi"))
    return held.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "item_shingles", "shared", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **more) -> DataFrame:
    """``docs`` without the rows in whose text an item is found."""
    key = free_name(docs.columns, "digest")
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias(key)
    found = find(docs.select(digest.alias("digest"), F.col(text_col).alias("text")), items.withColumnRenamed(text_col, "text"), id_col="digest", **more)
    leaks = materialize(found.select(F.col("digest").alias(key)).distinct(), "leaks")
    return docs.withColumn(key, digest).join(leaks, key, "left_anti").select(*docs.columns)
