"""Approximate nearest neighbours by a hierarchical k-means tree.

The top of the tree is fitted on a bounded sample (``sample`` vectors, by hash of the id) and
every vector is sent down to its leaf.  Leaves that hold more than twice ``leaf`` vectors are
split in further Spark rounds, each by a small tree of its own that is fitted on a bounded
sample of it, until no leaf is larger (or all its vectors are equal): the size of leaves stays
the same and the depth grows with the logarithm of the data.  A query visits leaves best bin
first: it goes through the top, and through each small tree that it opens, by a priority queue
of nodes by the nearness of their centres; of all that it has met the best ``most`` stay, and
those that are split are opened in the next round.  How many leaves are visited is widened by a
quarter at a time until the recall over ``calibration`` queries, measured against brute force
over all vectors, reaches ``recall``.  Leaves are dealt in pieces to a fixed number of regions, so
that neither a large leaf nor a popular one falls to one task.  A query goes to a region once, and
comes back with the best of all leaves that it visits there: what leaves a region is in proportion
to the queries, however many leaves are visited.  A task holds a bounded number of queries and
goes through the candidates as a stream.

Nulls: vectors that are null, zero, of another dimension than the sample's most frequent
one, or hold null or non-finite components take no part, nor do rows with a null id.  Equal
vectors have equal scores, ties go to the smaller id.  Rows that repeat an id are candidates
each by themselves, except for the query of that id.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from .common import discard, materialize

CANDIDATES_IN_BLOCK, QUERIES_IN_BLOCK = 4096, 1024
#: Leaves are dealt to so many regions, in pieces of about so many vectors; a task holds so many queries, and so many rows that it has found for them.
REGIONS, VECTORS_IN_PIECE, QUERIES_AT_ONCE, FOUND_AT_ONCE = 32, 256, 8192, 200_000
#: A leaf is split by a tree of its own, fitted on about so many of its vectors.
SPLIT_SAMPLE = 4096


@dataclass
class Tree:
    """Node i has ``children[i]`` (empty: a leaf) and its ``centres[i]``, of length one."""

    centres: np.ndarray
    children: list[np.ndarray]

    @classmethod
    def fit(cls, unit: np.ndarray, branches: int, leaf: int, seed: int = 3) -> Tree:
        r = np.random.default_rng(seed)
        centres, children, todo = [unit.mean(axis=0)], [np.zeros(0, np.int64)], [(0, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf:
                continue
            own = unit[rows]
            # so many branches as make leaves of the size asked for, if that is fewer
            c = own[r.choice(len(own), min(branches, max(2, -(-len(own) // leaf))), replace=False)]
            for _ in range(12):
                near = (own @ c.T).argmax(axis=1)
                c = np.stack([own[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
                c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
            near = (own @ c.T).argmax(axis=1)
            used = np.unique(near)
            if len(used) < 2:
                continue  # equal vectors
            children[node] = np.arange(len(centres), len(centres) + len(used))
            for k in used:
                todo.append((len(centres), rows[near == k]))
                centres.append(c[k])
                children.append(np.zeros(0, np.int64))
        return cls(np.stack(centres), children)

    @property
    def leaves(self) -> int:
        return sum(not len(c) for c in self.children)

    def leaf_of(self, unit: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(unit), np.int64), [(0, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            if not len(self.children[node]):
                out[rows] = node
                continue
            near = (unit[rows] @ self.centres[self.children[node]].T).argmax(axis=1)
            todo += [(int(c), rows[near == k]) for k, c in enumerate(self.children[node]) if (near == k).any()]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[tuple[int, float]]:
        """The first ``most`` leaves, best bin first, and how near their centres are."""
        out, queue = [], [(0.0, 0)]
        while queue and len(out) < most:
            far, node = heapq.heappop(queue)
            below = self.children[node]
            if len(below):
                for c, near in zip(below.tolist(), (self.centres[below] @ q).tolist()):
                    heapq.heappush(queue, (-near, c))
            else:
                out.append((node, -far))
        return out


def _matrix(column: pd.Series) -> np.ndarray:
    """Vectors as rows, each scaled by a power of two so that its largest component is below 1: squares of doubles of any size stay finite and
    above 0, and no cosine changes."""
    x = np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(q: pd.DataFrame, x: pd.DataFrame, k: int) -> pd.DataFrame:
    return _best_of(_matrix(q["vec"]), q["id"].to_numpy(), x, k)


def _best_of(Q: np.ndarray, qids: np.ndarray, x: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's k nearest of x, by exact cosines; ties to the smaller id."""
    X, ids = _matrix(x["vec"]), x["id"].to_numpy()
    norms, qnorms = np.sqrt((X * X).sum(axis=1)), np.sqrt((Q * Q).sum(axis=1))
    out = []
    for i in range(0, len(Q), 256):
        rough = (Q[i : i + 256] @ X.T) / (qnorms[i : i + 256, None] * norms)
        rough[qids[i : i + 256, None] == ids] = -np.inf
        floor = np.partition(rough, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(rough), -2.0)
        row, col = np.nonzero(rough >= np.maximum(floor - 1e-9, -2.0)[:, None])
        row += i
        # exact and the same wherever a pair stands; a product of matrices is neither
        exact = np.concatenate([(X[col[j : j + 50_000]] * Q[row[j : j + 50_000]]).sum(axis=1) for j in range(0, len(row), 50_000)] or [np.zeros(0)])
        exact /= norms[col] * qnorms[row]
        order = np.lexsort((ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        head = np.searchsorted(row, row)
        best = np.arange(len(row)) - head < k
        out.append(pd.DataFrame({"query_id": qids[row[best]], "vec_id": ids[col[best]], "score": exact[best]}))
    none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    return (pd.concat(out) if out else none).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def _merged(found: list[pd.DataFrame], k: int) -> pd.DataFrame:
    rows = pd.concat(found, ignore_index=True).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return rows[rows.groupby("query_id").cumcount() < k]


def _in_regions(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The k best of each query in each block (region, ask).  Rows are sorted by block, the queries (without a piece) before the candidates."""
    at, queries, visits, found, held = None, [], None, [], 0
    for b in batches:
        for block, rows in b.groupby(["region", "ask"]):
            if block != at:
                if found:
                    yield _merged(found, k)
                at, queries, visits, found, held = block, [], None, [], 0
            candidates = rows["piece"].notna()
            if not candidates.all():
                queries.append(rows[~candidates])
            if not candidates.any() or not queries:
                continue
            if visits is None:
                asked = pd.concat(queries, ignore_index=True)
                Q, qids = _matrix(asked["vec"]), asked["id"].to_numpy()
                by_piece = asked["asked"].explode()
                visits = by_piece.groupby(by_piece).groups
            for piece, x in rows[candidates].groupby("piece"):
                if piece in visits:
                    mine = visits[piece].to_numpy()
                    found.append(_best_of(Q[mine], qids[mine], x, k))
                    held += len(found[-1])
                if held > FOUND_AT_ONCE:
                    found = [_merged(found, k)]
                    held = 0
    if found:
        yield _merged(found, k)


FOUND = "query_id long, vec_id long, score double"


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the best k."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))), 1, k)
    return found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vec (doubles) of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & fine)


INDEX = "id long, vec array<double>, cell string, done boolean"
RESULT = "query_id long, rank int, vec_id long, score double, leaves int, of_leaves long, recall double"


@dataclass
class Index:
    """``vectors``: id, vec, cell (the leaf's name); ``top``; ``trees``: cell, tree of each leaf that was split; how many leaves."""

    vectors: DataFrame
    top: Tree
    trees: DataFrame
    leaves: int


def build_index(rows: DataFrame, top: Tree, branches: int, leaf: int) -> Index:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(top)  # at most 2 * sample nodes

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cells = shared.value.leaf_of(_unit(_matrix(b["vec"]))) if len(b) else []
            yield b.assign(cell=[str(x) for x in cells], done=False)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        tree = Tree.fit(_unit(_matrix(rows["vec"])), branches, leaf)
        return pd.DataFrame({"cell": rows["cell"].iloc[:1], "tree": [pickle.dumps(tree)]})

    def descend(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        tree = pickle.loads(trees["tree"].iloc[0]) if len(trees) else None
        if tree is None or tree.leaves == 1:  # equal vectors
            return rows[["id", "vec", "cell"]].assign(done=True)
        own = tree.leaf_of(_unit(_matrix(rows["vec"])))
        return rows[["id", "vec"]].assign(cell=[f"{c}.{x}" for c, x in zip(rows["cell"], own.tolist())], done=False)

    index = materialize(rows.mapInPandas(place, INDEX), "index")
    trees, number = spark.createDataFrame([], "cell string, tree binary"), 0
    while True:
        large = materialize(index.filter("not done").groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * leaf), "large")
        if large.isEmpty():
            break
        number += 1
        opened = index.join(large, "cell")
        sampled = opened.filter(F.pmod(F.xxhash64("id", F.lit(number)), F.col("n")) < SPLIT_SAMPLE)
        new = materialize(sampled.groupBy("cell").applyInPandas(fit, "cell string, tree binary"), "trees")
        blocks = F.ceil(F.col("n") / CANDIDATES_IN_BLOCK).cast("int")
        for_blocks = new.join(large, "cell").select("cell", "tree", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
        moved = opened.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).groupBy("cell", "block").cogroup(for_blocks.groupBy("cell", "block")).applyInPandas(descend, INDEX)
        split = materialize(index.join(large, "cell", "left_anti").select(*index.columns).unionByName(moved), "index")
        discard(index, large)
        index, trees = split, trees.unionByName(new)
    return Index(index, top, trees, index.select("cell").distinct().count())


def visit(index: Index, queries: DataFrame, most: int) -> DataFrame:
    """id, cell, near, place (from 0) of the first ``most`` leaves that each query visits."""
    top = queries.sparkSession.sparkContext.broadcast(index.top)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 200):
                part = b.iloc[i : i + 200]
                found = [top.value.visits(u, most) for u in _unit(_matrix(part["vec"]))]
                n = [len(x) for x in found]
                flat = [y for x in found for y in x]
                yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), n), "cell": [str(c) for c, _ in flat], "near": [x for _, x in flat]})

    def deeper(asked: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(trees):
            tree, cell = pickle.loads(trees["tree"].iloc[0]), trees["cell"].iloc[0]
            for q, u in zip(asked["id"].tolist(), _unit(_matrix(asked["vec"]))):
                out += [(q, f"{cell}.{c}", near) for c, near in tree.visits(u, most)]
        return pd.DataFrame(out, columns=["id", "cell", "near"]).astype({"id": "int64", "near": "float64"})

    def best(met: DataFrame) -> DataFrame:
        rows = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("near")).alias("far"), "cell"))), 1, most)
        return met.groupBy("id").agg(rows.alias("b")).select("id", F.posexplode("b").alias("place", "b")).select("id", "b.cell", (-F.col("b.far")).alias("near"), "place")

    met = materialize(best(queries.select("id", "vec").mapInPandas(first, "id long, cell string, near double")), "met")
    # a leaf of one value keeps its name when its tree could not split it
    trees = index.trees.join(index.vectors.filter("done").select("cell").distinct(), "cell", "left_anti") if index.leaves > 1 else index.trees
    cells = trees.select("cell")
    while True:
        inner = materialize(met.join(cells, "cell", "left_semi").select("id", "cell"), "inner")
        if inner.isEmpty():
            return met
        blocks = inner.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES_IN_BLOCK).cast("int").alias("blocks"))
        asked = inner.join(materialize(blocks, "blocks"), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        asked = asked.join(queries.select("id", "vec"), "id").select("id", "vec", "cell", "block")
        for_blocks = trees.join(blocks, "cell").select("cell", "tree", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        found = asked.groupBy("cell", "block").cogroup(for_blocks.groupBy("cell", "block")).applyInPandas(deeper, "id long, cell string, near double")
        now = materialize(best(met.join(cells, "cell", "left_anti").select("id", "cell", "near").unionByName(found)), "met")
        discard(met, inner)
        met = now


def search(vectors: DataFrame, is_query: Column, *, k: int = 5, recall: float = 0.94, branches: int = 12, leaf: int = 120, sample: int = 20_000, calibration: int = 200, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, leaves (visited by each query), of_leaves (that there are), recall (as calibrated).
    ``is_query`` is over the column ``id``."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_col, vector_col)
    seen = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    if not len(seen):
        return spark.createDataFrame([], RESULT)
    dim = Counter(map(len, seen["vec"])).most_common(1)[0][0]
    top = Tree.fit(_unit(_matrix(seen["vec"][seen["vec"].map(len) == dim])), branches, leaf)
    index = build_index(rows.filter(F.size("vec") == dim), top, branches, leaf)
    # a query of an id that repeats is the vector that sorts first
    queries = materialize(index.vectors.filter(is_query).groupBy("id").agg(F.min("vec").alias("vec")), "queries")

    # brute force over all vectors for a bounded number of queries, and in which of its visits each true neighbour is met
    chosen = queries.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(calibration)
    trial = chosen.toPandas()
    if not len(trial):
        return spark.createDataFrame([], RESULT)
    all_trial = spark.sparkContext.broadcast(trial)

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), CANDIDATES_IN_BLOCK):
                yield _best(all_trial.value, b.iloc[i : i + CANDIDATES_IN_BLOCK], k)

    truth = _nearest(index.vectors.select("id", "vec").mapInPandas(brute, FOUND), k).join(index.vectors.select(F.col("id").alias("vec_id"), "cell"), "vec_id")
    truth = materialize(truth.select(F.col("query_id").alias("id"), "cell"), "truth")
    chosen = spark.createDataFrame(trial, queries.schema)
    reach = 64
    while True:
        met = truth.join(visit(index, chosen, reach), ["id", "cell"], "left").select(F.coalesce("place", F.lit(1 << 30)).alias("place")).toPandas()["place"].to_numpy()  # k a trial query
        if not len(met) or reach >= index.leaves or (met < reach).mean() >= recall:
            break
        reach *= 4
    most = 4
    while most < min(reach, index.leaves) and len(met) and (met < most).mean() < recall:
        most += -(-most // 4)
    most, reached = min(most, index.leaves), float((met < most).mean()) if len(met) else 1.0

    # a query goes to a region once, with the pieces of leaves that it visits there
    probes = visit(index, queries, most)
    visited = index.vectors.join(probes.select("cell").distinct(), "cell", "left_semi")
    pieces = materialize(visited.groupBy("cell").agg(F.ceil(F.count("*") / VECTORS_IN_PIECE).cast("int").alias("pieces")), "pieces")
    asks = -(-queries.count() // QUERIES_AT_ONCE)
    piece, region = F.concat_ws("/", "cell", "n"), F.pmod(F.xxhash64("piece"), F.lit(REGIONS)).cast("int").alias("region")

    def upto(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    xs = visited.join(pieces, "cell").select("id", "vec", "cell", F.pmod(F.xxhash64("id"), "pieces").alias("n")).select("id", "vec", piece.alias("piece"))
    xs = xs.select(region, upto(F.lit(asks)).alias("ask"), "piece", "id", "vec", F.lit(None).cast("array<string>").alias("asked"))
    met = probes.join(pieces, "cell").select("id", "cell", upto(F.col("pieces")).alias("n")).select("id", piece.alias("piece"))
    met = met.groupBy("id", region).agg(F.collect_list("piece").alias("asked")).join(queries, "id")
    qs = met.select("region", F.pmod(F.xxhash64("id"), F.lit(asks)).cast("int").alias("ask"), F.lit(None).cast("string").alias("piece"), "id", "vec", "asked")
    # a block's queries stand before its candidates, and these piece by piece
    dealt = qs.unionByName(xs).repartition("region", "ask").sortWithinPartitions("region", "ask", F.col("piece").asc_nulls_first())
    found = dealt.mapInPandas(lambda batches: _in_regions(batches, k), FOUND)
    return _nearest(found, k).select("*", F.lit(most).alias("leaves"), F.lit(index.leaves).cast("long").alias("of_leaves"), F.lit(reached).alias("recall"))
