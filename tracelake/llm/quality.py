"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters run over all bytes of a document.  Their rectified outputs are max-pooled in
overlapping chunks that cover the whole document; the mean and the largest over the chunks
are combined into one probability.  A long document goes through in windows of chunks with the
sum and the maximum so far, so that memory doesn't grow with it.  Training uses a bounded sample
of labelled rows (``sample`` per class, by hash of the id), and of a row over ``excerpt`` bytes
pieces spread evenly over the whole of it; scoring covers every byte of every document.

Nulls: a null text is empty and gets the score of no evidence (the bias alone); rows with a
null label or id are not learned from, and a null id is not held out.  Repeated labels of an id
count once, by the lowest.  Equal texts get equal scores.  An empty table gives no rows; without
labels of both classes every score is 0.5.  Extra columns are kept; the score's own name must be
free.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.shared import free_name
from ..functions.ship import ship
from .common import buffers, released, slices

CHUNK, STEP = 512, 448
#: Chunks of a document that are looked at together.
WINDOW = 512


@dataclass
class Network:
    """``table[j, b]``: what byte b at place j of a filter adds to each filter."""

    table: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float = 0.0
    shift: float = 0.0
    known: bool = field(default=True)

    @classmethod
    def fresh(cls, filters: int, width: int, seed: int) -> Network:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.3, (width, 256, filters)).astype(np.float32), np.zeros(filters, np.float32), r.normal(0, 0.1, 2 * filters).astype(np.float32))

    def layout(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with a gap of zeros behind each text; where chunks begin and end; each chunk's text."""
        pad = self.table.shape[0] - 1
        n = np.diff(at)
        padded = np.zeros(len(data) + pad * len(n) + pad, np.uint8)
        begin = at[:-1] + pad * np.arange(len(n))
        padded[np.arange(len(data)) + np.repeat(pad * np.arange(len(n)), n)] = data
        chunks = np.maximum(1, -(-(n - (CHUNK - STEP)) // STEP))
        doc = np.repeat(np.arange(len(n)), chunks)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        lo = begin[doc] + k * STEP
        hi = np.minimum(lo + CHUNK, begin[doc] + np.maximum(n[doc], 1))
        return padded, lo, hi, doc

    def responses(self, padded: np.ndarray) -> np.ndarray:
        n = len(padded) - self.table.shape[0] + 1
        out = self.table[0].take(padded[:n], axis=0)
        for j in range(1, self.table.shape[0]):
            out += self.table[j].take(padded[j : n + j], axis=0)
        return out

    def pooled(self, padded: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        r = self.responses(padded)
        r = np.concatenate((r, r[-1:]))
        both = np.stack((lo, hi), 1).ravel()
        return np.maximum(np.maximum.reduceat(r, both, axis=0)[::2] + self.bias, 0)

    def long_features(self, data: np.ndarray) -> np.ndarray:
        """The features of one text, by windows of its chunks."""
        pad, n = self.table.shape[0] - 1, len(data)
        chunks = max(1, -(-(n - (CHUNK - STEP)) // STEP))
        total, most = np.zeros(len(self.bias), np.float64), np.zeros(len(self.bias), np.float32)
        for k in range(0, chunks, WINDOW):
            begin, last = k * STEP, min(chunks, k + WINDOW) - 1
            own = data[begin : min(n, last * STEP + CHUNK + pad)]
            lo = np.arange(last - k + 1) * STEP
            pooled = self.pooled(np.concatenate((own, np.zeros(pad, np.uint8))), lo, np.minimum(lo + CHUNK, n - begin))
            total += pooled.sum(axis=0)
            most = np.maximum(most, pooled.max(axis=0))
        return np.concatenate((total / chunks, most)).astype(np.float32)

    @staticmethod
    def combined(pooled: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        n = np.diff(np.concatenate((first, [len(doc)])))[:, None]
        return np.concatenate((np.add.reduceat(pooled, first, axis=0) / n, np.maximum.reduceat(pooled, first, axis=0)), 1), first

    def scores(self, texts: pa.Array) -> np.ndarray:
        data, at = buffers(texts)
        if len(at) == 1:
            return np.zeros(0)
        if not self.known:
            return np.full(len(at) - 1, 0.5)
        n = np.diff(at)
        features = np.zeros((len(n), 2 * len(self.bias)), np.float32)
        long = n > WINDOW * STEP
        for i in np.flatnonzero(long).tolist():
            features[i] = self.long_features(data[at[i] : at[i + 1]])
        if not long.all():
            short = np.concatenate(([0], np.cumsum(n[~long])))
            padded, lo, hi, doc = self.layout(data[np.repeat(~long, n)] if long.any() else data, short)
            features[~long], _ = self.combined(self.pooled(padded, lo, hi), doc)
        features[n == 0] = 0
        z = features.astype(np.float64) @ self.weight.astype(np.float64) + self.offset + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def gradients(net: Network, texts: list[bytes], y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean logistic loss over some texts, and its gradient by each of the network's parameters."""
    filters, width = len(net.bias), net.table.shape[0]
    data, at = buffers(pa.array(texts, pa.binary()))
    padded, lo, hi, doc = net.layout(data, at)
    pooled = net.pooled(padded, lo, hi)
    features, first = net.combined(pooled, doc)
    z = np.clip(features @ net.weight + net.offset, -60, 60)
    loss = float(np.mean(np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z))
    err = (1 / (1 + np.exp(-z)) - y) / len(y)
    # to the pooled outputs: the mean's share for each chunk, the maximum's for the largest, which chunks that overlap may share
    largest = pooled == features[doc][:, filters:]
    ties = np.add.reduceat(largest, first, axis=0, dtype=np.int64)
    g_mean, g_max = err[:, None] * net.weight[:filters], err[:, None] * net.weight[filters:]
    n = np.diff(np.concatenate((first, [len(doc)])))
    g = (g_mean / n[:, None])[doc] + (g_max / ties)[doc] * largest
    g *= pooled > 0
    responses, g_table = net.responses(padded), np.zeros_like(net.table, dtype=np.float64)
    c, f = np.nonzero(g)
    where = np.empty(len(c), np.int64)
    for chunk in np.unique(c):
        own = c == chunk
        where[own] = lo[chunk] + responses[lo[chunk] : hi[chunk], :].argmax(axis=0)[f[own]]
    for j in range(width):
        np.add.at(g_table[j], (padded[where + j], f), g[c, f])
    return loss, {"table": g_table, "bias": g.sum(axis=0), "weight": features.T @ err, "offset": np.array([err.sum()])}


def train(texts: list[bytes], labels: np.ndarray, *, prior: float, filters: int = 12, width: int = 5, steps: int = 700, batch: int = 48, rate: float = 0.03, seed: int = 7) -> Network:
    """Fit by Adam on the logistic loss; scores are shifted from the sample's to the table's share of ones."""
    net, r = Network.fresh(filters, width, seed), np.random.default_rng(seed)
    if len(set(labels.tolist())) < 2:
        net.known = False
        return net
    y_all = labels.astype(np.float64)
    state = {k: [np.zeros_like(v, dtype=np.float64), np.zeros_like(v, dtype=np.float64)] for k, v in (("table", net.table), ("bias", net.bias), ("weight", net.weight), ("offset", np.zeros(1)))}
    epochs, t = -(-steps // -(-len(texts) // batch)), 0

    def adam(name: str, value: np.ndarray, g: np.ndarray) -> np.ndarray:
        m, v = state[name]
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        now = rate * (1 - t / (epochs * -(-len(texts) // batch) + 1))
        return value - now * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    for _ in range(epochs):
        order = r.permutation(len(texts))
        for lo in range(0, len(order), batch):
            pick, t = order[lo : lo + batch], t + 1
            _, g = gradients(net, [texts[i] for i in pick], y_all[pick])
            for name in ("table", "bias", "weight"):
                setattr(net, name, adam(name, getattr(net, name), g[name]).astype(np.float32))
            net.offset = float(adam("offset", np.array([net.offset]), g["offset"])[0])
    share = float(np.clip(y_all.mean(), 1e-3, 1 - 1e-3))
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    net.shift = float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return net


def held_out(id_col: str = "doc_id"):
    """Whether a row's label is kept from training; false for a row without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def excerpt_of(text, most: int):
    """The whole text, or of one of more bytes 64 pieces spread evenly from its beginning to its end: in all its share of ``most`` bytes."""
    piece = F.floor(F.length(text).cast("long") * most / F.octet_length(text) / 64).cast("int")
    at = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i * (F.length(text).cast("long") - piece) / 63).cast("int") + 1)
    return F.when(F.octet_length(text) > most, F.array_join(F.transform(at, lambda x: F.substr(text, x, piece)), "\n")).otherwise(text)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = 1000, excerpt: int = 256 << 10, id_col: str = "doc_id", text_col: str = "text", **more) -> Network:
    """Train on at most ``sample`` labelled, not held-out documents of each class."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.min(label).alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # one row for each class
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    rows = []
    for y in (0, 1):
        ids = known.filter(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(sample)
        rows += [(bytes(x["b"]), y) for x in texts.join(F.broadcast(ids), id_col).orderBy(F.xxhash64(id_col), "text").limit(sample).select(F.encode(excerpt_of(F.col("text"), excerpt), "UTF-8").alias("b")).collect()]
    total = counts.get(0, 0) + counts.get(1, 0)
    return train([b for b, _ in rows], np.array([y for _, y in rows]), prior=counts.get(1, 0) / max(total, 1), **more)


def score(docs: DataFrame, network: Network, *, into: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with a new column ``into``: the probability of label 1."""
    ship(docs.sparkSession)
    if free_name(docs.columns, into) != into:
        raise ValueError(f"there is a column {into!r} already; name another one with into")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 256 << 10):
                s = network.scores(part.column(part.schema.get_field_index(text_col)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=[*part.schema.names, into])

    return docs.mapInArrow(released(run), StructType([*docs.schema.fields, StructField(into, DoubleType())]))
