"""Best-fit packing, certified by dual-feasible-function bounds and mended by exchange.

Documents become pieces of at most ``size`` tokens.  Full pieces are sequences by
themselves; the rest are spread over partitions, and each packs its own by best-fit
decreasing.  Dual feasible functions give a lower bound on the partition's number of
sequences.  A partition that meets it is certified and gives up only its emptiest
sequence (what rounding up to whole sequences wastes); one with a gap gives up four of its
emptiest sequences for each that it is above the bound, and half of its sequences at most:
the emptiest half holds half of the tokens at most, so what is packed again halves with each
round.  The documents given up are spread anew over fewer partitions and packed again, until
one partition of bounded size is left.  Each piece is returned with its partition's bound, its
gap (sequences above the bound) and whether that is certified to be the fewest.

Nulls: a null text is empty and becomes one piece that holds the end id alone.  Repeated
rows are packed each by themselves.  Ties go by length, then by arrival.  An empty table
gives no rows.  Extra columns are ignored; a very long text is cut into full pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from .bpe import encoder
from .common import materialize, pieces_of, released, released_group

#: Items that one task packs; the memory of a task is bounded by it.
ITEMS_PER_PARTITION = 200_000


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The largest bound of the dual feasible functions of Martello-Toth and Fekete-Schepers."""
    return lower_bound_of(*np.unique(lengths, return_counts=True), size)


def lower_bound_of(x: np.ndarray, n: np.ndarray, size: int) -> int:
    """The same for ``n`` items of each length ``x``."""
    if not len(x):
        return 0
    best = -(-int((x * n).sum()) // size)
    for cut in np.unique(np.concatenate(([0], x[x <= size // 2]))).tolist():
        # f(x) = 1 above size - cut, 0 below cut, x / size between
        f = np.where(x > size - cut, size, np.where(x < cut, 0, x))
        best = max(best, -(-int((f * n).sum()) // size))
    for k in range(1, 20):
        # u(x) = x where (k + 1) x / size is whole, else floor((k + 1) x / size) / k; counted in units of 1 / (k size)
        whole = (k + 1) * x % size == 0
        f = np.where(whole, k * x, (k + 1) * x // size * size)
        best = max(best, -(-int((f * n).sum()) // (k * size)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's free space.  Longest first; each into the fullest bin that takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_free: list[list[int]] = [[] for _ in range(size + 1)]
    open_sizes, free = 0, []  # open_sizes: bit r is set if a bin has r free
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = open_sizes >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_free[r].pop()
            if not by_free[r]:
                open_sizes ^= 1 << r
        else:
            b, r = len(free), size
            free.append(size)
        bins[i], offsets[i] = b, size - r
        free[b] = r - n
        if r > n:
            by_free[r - n].append(b)
            open_sizes |= 1 << (r - n)
    return bins, offsets, np.array(free, np.int64)


def _cutter(tokenizer_path: str, size: int, end_id: int | None, with_ids: bool):
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(tokenizer_path)
        for b in batches:
            for i in range(0, len(b), 500):
                part, rows = b.iloc[i : i + 500], []
                for doc, ids in zip(part.iloc[:, 0].tolist(), e.encode(part.iloc[:, 1].tolist())):
                    ids += tail
                    n = len(ids) // 4
                    at = 0
                    for piece, length in enumerate([n] if n <= size else [n % size] * (n % size > 0) + [size] * (n // size)):
                        own = ids[4 * at : 4 * (at + length)]
                        rows.append((doc, piece, at, length, zlib.crc32(own), *([np.frombuffer(own, "<u4").astype(np.int64)] if with_ids else [])))
                        at += length
                out = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
                out["id"] = out["id"].astype(part.iloc[:, 0].dtype if len(out) else "object")
                yield out

    return cut


def cut_documents(docs: DataFrame, tokenizer_path: str, *, size: int = 1024, end_id: int | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32 (, ids) of each piece; only longer documents are cut, and only the first piece may be short."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(
        released(_cutter(tokenizer_path, size, end_id, with_ids)), f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    )
    return found.withColumnRenamed("id", id_col)


def _packer(size: int, number: int, last: bool):
    def pack(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "item"], ascending=[False, True], kind="stable", ignore_index=True)
        lengths = items["length"].to_numpy()
        bins, offsets, free = best_fit_decreasing(lengths, size)
        bound = lower_bound(lengths, size)
        gap = len(free) - bound
        given = np.zeros(len(free), bool)
        if not last:
            emptiest = np.argsort(-free, kind="stable")[: min(1 + 4 * gap, len(free) // 2)]
            given[emptiest[free[emptiest] > 0]] = True
        part = int(items["part"].iloc[0])
        return pd.DataFrame({"item": items["item"], "length": lengths, "sequence_id": (number << 56) + (part << 28) + bins, "offset": offsets, "given": given[bins], "bound": bound, "gap": gap})

    return pack


def pack(pieces: DataFrame, *, size: int = 1024, items_per_partition: int = ITEMS_PER_PARTITION) -> DataFrame:
    """``pieces`` with sequence_id and offset.  ``pieces`` needs ``length``; it is written once, so that items keep their numbers."""
    ship(pieces.sparkSession)
    names = pieces.columns
    table = materialize(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    items = table.filter(F.col("length") < size).select("item", "length")
    done, number, left = [], 0, items.count()
    while left:
        parts = pieces_of(left, items_per_partition)
        placed = materialize(
            items.withColumn("part", F.pmod(F.xxhash64("item", F.lit(number)), F.lit(parts)))
            .groupBy("part")
            .applyInPandas(released_group(_packer(size, number, parts == 1)), "item long, length long, sequence_id long, offset long, given boolean, bound long, gap long"),
            "packed",
        )
        done.append(placed.filter(~F.col("given")))
        items, number = placed.filter("given").select("item", "length"), number + 1
        left = items.count()
    kept = [d.select("item", "sequence_id", "offset", "bound", "gap") for d in done]
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    kept.append(table.filter(F.col("length") == size).select("item", (-1 - F.col("item")).alias("sequence_id"), none.alias("offset"), one.alias("bound"), none.alias("gap")))
    found = kept[0]
    for d in kept[1:]:
        found = found.unionByName(d)
    return table.join(found, "item").select(*names, "sequence_id", "offset", "bound", "gap", (F.col("gap") == 0).alias("certified"))


def certificate(packed: DataFrame, *, size: int = 1024) -> DataFrame:
    """One row for the whole of what is packed: sequences, bound (the fewest that any packing can have), gap."""
    lengths = packed.groupBy("length").count().orderBy("length").collect()  # ``size`` rows at most
    bound = lower_bound_of(np.array([r["length"] for r in lengths], np.int64), np.array([r["count"] for r in lengths], np.int64), size)
    return packed.agg(F.count_distinct("sequence_id").alias("sequences")).select("sequences", F.lit(bound).cast("long").alias("bound"), (F.col("sequences") - bound).cast("long").alias("gap"))


def pack_documents(docs: DataFrame, tokenizer_path: str, *, size: int = 1024, end_id: int | None = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut and pack: id, piece, start, length, ids_crc32 (, ids), sequence_id, offset, bound, gap, certified."""
    return pack(cut_documents(docs, tokenizer_path, size=size, end_id=end_id, with_ids=with_ids, id_col=id_col, text_col=text_col), size=size)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the token ids of each whole sequence, from pieces packed ``with_ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
