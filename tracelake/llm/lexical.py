"""Ranked lexical search: the best documents for each item, by terms counted straight from the texts.

The items are the queries.  They go in blocks of bounded size; the terms of a block make an Aho-Corasick automaton that is
broadcast, each term between two guards.  A text whose separators are all made guards then gives, in one pass, every
place of every term: no document index is built or stored.  What the automaton puts out are numbers of terms, and a
table of the block says which items hold a term and how often.

Two scans answer a block: the first counts, over all documents, those that have a term at all (N), their terms (L) and in how many
documents each term of the block stands (df); the second scores.  In the second a task scores its documents, some hundred at a
time, against all items of the block and keeps each item's best; what is exchanged are these, whatever the number of documents.

Score: a term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))); a document of n terms has m = 100 - 75 + 75 n N div L; the item's terms,
repeats included, add w * (10**9 tf div (1000 tf + 8 m)).

Nulls: a null text has no terms, and such documents count for nothing; rows without an id are documents, behind all others of their score.
Items without an id are ignored, an item without terms finds nothing; of rows that repeat an item's id that of the smallest text counts.
Documents that repeat an id are ranked each by itself.  Equal scores go by id.  Empty tables give no rows.  Extra columns are ignored.
An item's terms and a document are held whole by a task; its tables of scores have ``CELLS`` numbers at most, or those of one document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ship import ship
from .common import buffers, byte_classes, discard, materialize, pieces_of, released, slices

# Fixed value: what stands between terms.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Separators as guards, A-Z as a-z.
GUARDED = bytes(32 if v == 0 else (v - 1) & 255 for v in byte_classes(SEPARATORS, lower=True).tolist())
#: Bytes of items for a block: bounds what is broadcast.
BLOCK_BYTES = 4 << 20
#: Documents scored at once, at most; and numbers in a table of them by items or by terms.
AT_ONCE, CELLS = 256, 4_000_000
#: Terms of items that are summed at once.
ROWS = 8192
#: What documents without an id are ranked by.
_LAST = np.iinfo(np.int64).max


@dataclass
class Block:
    """Some items: ``terms``; for each item (in order) the numbers of its different terms and how often it holds each; each of these
    has the ``item`` beside it."""

    terms: list[str]
    of: np.ndarray
    times: np.ndarray
    item: np.ndarray
    items: int


def block_of(texts: list[str]) -> Block:
    number: dict[str, int] = {}
    of, times, item = [], [], []
    for i, t in enumerate(texts):
        held = Counter(guarded(t).split())
        item += [i] * len(held)
        of += [number.setdefault(x, len(number)) for x in held]
        times += held.values()
    return Block(list(number), np.array(of, np.int64), np.array(times, np.int64), np.array(item, np.int64), len(texts))


def guarded(text: str) -> str:
    return (b" " + text.encode().translate(GUARDED) + b" ").decode()


_AUTOMATA: dict[int, object] = {}


def automaton(key: int, terms: list[str]):
    """One for each worker process and block: each term between guards, so that it is found whole only; its output is its number."""
    import ahocorasick

    if key not in _AUTOMATA:
        a = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            a.add_word(f" {t} ", i)
        a.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[key] = a
    return _AUTOMATA[key]


def counted(texts: pa.Array, found) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its number of terms; and (text, term, tf) of the terms that the automaton knows."""
    data, at = buffers(texts)
    raw, number = data.tobytes().translate(GUARDED), itemgetter(1)
    n, docs, terms, tfs = np.zeros(len(at) - 1, np.int64), [], [], []
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        own = b" " + raw[a:b] + b" "
        inside = np.frombuffer(own, np.uint8) != 32
        n[i] = np.count_nonzero(inside[1:] & ~inside[:-1])
        if n[i]:
            tf = Counter(map(number, found.iter(own.decode())))
            docs += [i] * len(tf)
            terms += tf.keys()
            tfs += tf.values()
    return n, np.array(docs, np.int64), np.array(terms, np.int64), np.array(tfs, np.int64)


def _statistics(key: int, block):
    """A task's share of df by term; term -1 has the documents with terms, -2 their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = block.value.terms
        df, n_docs, n_terms = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for part in slices(batch):
                n, _, t, _ = counted(part.column("text"), automaton(key, terms))
                df += np.bincount(t, minlength=len(terms))
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], [n_docs, n_terms]))], names=["term", "n"])

    return run


class Best:
    """The k best documents of each item so far; what may be among them is gathered, and sorted when there is much of it."""

    def __init__(self, items: int, k: int):
        self.k, self.least, self.size = k, np.ones(items, np.int64), 0
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.least[:, None])
        self.held.append((item, scores[item, at], docs[at]))
        self.size += len(item)
        if self.size > 4 * self.k * len(self.least) + 10_000:
            self.sort()

    def sort(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item, score, doc = (np.concatenate(x) for x in zip(*self.held)) if self.held else [np.zeros(0, np.int64)] * 3
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kth = place == self.k - 1
        self.least[item[kth]] = score[kth]  # equal scores of smaller ids may still come
        top = place < self.k
        self.held, self.size = [(item[top], score[top], doc[top])], int(top.sum())
        return self.held[0]


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def _scores(key: int, block, df, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, best = block.value, Best(block.value.items, k)
        w = weights(df.value, n_docs)
        gain = (w[b.of] * b.times)[:, None]
        for batch in batches:
            for part in slices(batch):
                found = counted(part.column("text"), automaton(key, b.terms))
                ids = part.column("id").fill_null(_LAST).to_numpy(zero_copy_only=False)
                step = max(1, min(AT_ONCE, CELLS // b.items, CELLS // max(1, len(np.unique(found[2])))))
                for lo in range(0, len(ids), step):
                    best.add(*scored(b, found, lo, min(step, len(ids) - lo), gain, n_docs, n_terms, ids))
        item, score, doc = best.sort()
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(doc)], names=["item", "score", "doc"])

    return run


def scored(b: Block, found, lo: int, many: int, gain: np.ndarray, n_docs: int, n_terms: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """items x documents scores of the texts from ``lo`` on, and their ids."""
    n, doc, term, tf = found
    i, j = np.searchsorted(doc, [lo, lo + many])
    m = 25 + 75 * n[lo : lo + many] * n_docs // max(1, n_terms)
    d, (own, at) = doc[i:j] - lo, np.unique(term[i:j], return_inverse=True)
    one = np.zeros((len(own), many), np.int64)  # of the terms that these documents hold
    one[at, d] = 10**9 * tf[i:j] // (1000 * tf[i:j] + 8 * m[d])
    out, place = np.zeros((b.items, many), np.int64), np.full(len(b.terms), -1, np.int64)
    place[own] = np.arange(len(own))
    rows = place[b.of]
    some = np.flatnonzero(rows >= 0)
    for lo_row in range(0, len(some), ROWS):
        part = some[lo_row : lo_row + ROWS]
        item = b.item[part]
        first = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        out[item[first]] += np.add.reduceat(one[rows[part]] * gain[part], first, axis=0)
    return out, ids[lo : lo + many]


def search(docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item, rank (from 1), id, score of each item's ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    ship(spark)
    kind = items.schema[item_col].dataType.simpleString()
    own = items.filter(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).groupBy(F.col(item_col).alias("item")).agg(F.min(item_text_col).alias("text"))
    own = own.withColumn("size", F.octet_length("text").cast("long"))
    total = own.agg(F.sum("size")).first()[0] or 0
    blocks = pieces_of(total, block_bytes)
    # a block has about ``block_bytes`` by the spread of the hash, and the items that are longer by themselves
    queries = materialize(own.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")), "queries")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = [_answer(texts, [tuple(r) for r in queries.filter(F.col("block") == i).select("item", "text").collect()], k, kind, i) for i in range(blocks)]
    discard(queries)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(F.col("item").alias(item_col), "rank", F.when(F.col("doc") != _LAST, F.col("doc")).cast(docs.schema[id_col].dataType).alias(id_col), "score")


def _answer(texts: DataFrame, items: list[tuple], k: int, kind: str, number: int) -> DataFrame:
    """The answers to one block of items."""
    spark, none = texts.sparkSession, f"item {kind}, rank int, doc long, score long"
    block = block_of([t for _, t in items])
    if not block.terms:
        return spark.createDataFrame([], none)
    sent, key = spark.sparkContext.broadcast(block), hash((spark.sparkContext.applicationId, number, tuple(block.terms)))
    got = texts.select("text").mapInArrow(released(_statistics(key, sent)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a term
    sums = {r["term"]: r["n"] for r in got}
    n_docs, n_terms = sums.pop(-1, 0), sums.pop(-2, 0)
    df = np.zeros(len(block.terms), np.int64)
    for t, n in sums.items():
        df[t] = n
    best = texts.mapInArrow(released(_scores(key, sent, spark.sparkContext.broadcast(df), n_docs, n_terms, k)), "item long, score long, doc long")
    # each item's best of some tasks, then of all
    best = best.withColumn("some", F.spark_partition_id() % 256)
    for by in (["item", "some"], ["item"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc"))).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(items)], f"number long, name {kind}")  # a block's items
    return best.join(F.broadcast(names), F.col("item") == F.col("number")).select(F.col("name").alias("item"), "rank", "doc", "score")
