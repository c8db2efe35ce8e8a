"""N-gram Jaccard join by prefix trees, and the components of its links.

A document's set is its distinct n-word shingles, in a global order (that of their
fingerprints).  Equal sets are one node.  Different sets are routed to where they can meet:
sets of one size class are cut, along the global order, into half as many parts again as two
similar sets can differ in shingles, so that similar sets share many parts.  Parts are
counted over all sets and ordered rarest first: a set that shares too few of its parts with
any other is done, and of the others only so many of the rarest parts are kept that two
similar sets still have one in common (a prefix filter; parts of passages that many documents
share come last in this order and are hardly ever kept).  A part that several sets of one batch
hold is shared for certain: it comes after all that are counted, and its entries go straight to
the sets, so that no task gathers all that hold a common part.

The most common of its kept parts is a set's home.  Sets of one home meet there; where a kept
part joins sets of different homes, those of the later home visit the earlier one.  So two sets
meet once if they have a kept part in common, and a set goes nowhere else.  A home of many sets
is cut into blocks of a bounded number of shingles that are joined two by two: a trie holds
sets in global order, and each set walks it, sharing the overlap so far with all sets below a
branch and leaving subtrees where the lengths that remain can't make it.  Every link is found,
in one pair of blocks, and counted for both of its sets, a set of several rows as so many; of
the links themselves a pair of blocks gives only which sets they connect, so that the rows of a
family don't grow with its square.

Nulls: a null or wordless text has the empty set and is linked with nothing.  A null id is
kept, counts in no component's smallest id and is linked with nothing; its component and
number of links are null.  Repeated rows and equal texts are linked (similarity 1).  Fewer than
n words are one shingle.  An empty table gives no rows.  Extra columns are ignored.  Texts of
any length are read whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import free_name
from ..functions.ship import ship
from .common import SPACED_LOWER, bit_table, discard, gathered, materialize, may_hold, mix, pack_columns, pieces_of, released, released_group, shingle_sets, slices, text_bytes, unpack_columns, words

#: A block holds so many sets at most, and so many shingles (or one set).
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: A part that so many different sets of one batch hold is shared for certain.
COMMON = 4
_COMMON_DF = (1 << 32) - 1


class Classes:
    """Size classes: similar sets are in one class or in neighbouring ones."""

    def __init__(self, threshold: Fraction):
        self.t = threshold
        grow = max(Fraction(5, 4), 1 / threshold)
        hi = [1]
        while hi[-1] < 1 << 40:
            hi.append(max(hi[-1] + 1, int(hi[-1] * grow)))
        self.hi = np.array(hi)

    def of(self, size: int) -> list[tuple[int, int]]:
        """Class number and largest size, of its own class and the next one if a similar set may be in it."""
        k = int(np.searchsorted(self.hi, size))
        both = [k] if int(size / self.t) <= self.hi[k] else [k, k + 1]
        return [(c, int(self.hi[c])) for c in both]

    def differ(self, most: int) -> int:
        """In how many shingles two similar sets of at most this size can differ."""
        return int(2 * most * (1 - self.t) / (1 + self.t))


def _node(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def part_keys(sets: list[np.ndarray], classes: Classes) -> tuple[np.ndarray, ...]:
    """Keys of the sets' parts and the task (a set in a size class) of each; of each task the set, its class and its ``need``:
    how many keys it has in common with any similar set at least."""
    sizes, tasks = [len(s) for s in sets], []
    cache: dict[int, list] = {}
    for i, n in enumerate(sizes):
        if n not in cache:
            cache[n] = [(c, d, d + d // 2 + 2) for c, most in classes.of(n) if n for d in [classes.differ(most)] if d]
        tasks += [(i, *x) for x in cache[n]]
    none = np.zeros(0, np.int64)
    if not tasks:
        return none.astype(np.uint64), none, none, none, none
    who, cls, differ, m = (np.array(c, np.int64) for c in zip(*tasks))
    base = np.cumsum(m) - m
    flat = np.concatenate([sets[i] for i in who.tolist()])
    n = np.array(sizes)[who]
    rep = np.repeat(np.arange(len(who)), n)
    part = ((flat >> np.uint64(32)) * m[rep].astype(np.uint64) >> np.uint64(32)).astype(np.int64) + base[rep]
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(mix(flat + np.uint64(1)), out=total[1:])
    at = np.searchsorted(part, np.arange(int(m.sum()) + 1))
    held = np.diff(at)
    task = np.repeat(np.arange(len(who)), m)
    number = np.arange(len(task)) - base[task]
    keys = mix(total[at[1:]] - total[at[:-1]] + mix((cls[task] << 40 | number).astype(np.uint64)))
    full = np.add.reduceat((held > 0).astype(np.int64), base)
    # a set with too few parts in use sends the empty ones too, and has a key in common with a similar set all the same
    send = (held > 0) | (full <= differ)[task]
    return keys[send], task[send], who, cls, np.maximum(full - differ, 1)


def _entries(blob: bytes) -> tuple[np.ndarray, ...]:
    """key, node, class, need."""
    n_tasks, n_keys, size = struct.unpack_from("<III", blob)
    node, cls, need = unpack_columns(blob[12 : 12 + size], n_tasks, "<i8", "<u1", "<u4")
    step = unpack_columns(blob[12 + size : -8 * n_keys], n_keys, "<u4")[0]
    task = np.cumsum(step)
    return np.frombuffer(blob, "<u8", n_keys, len(blob) - 8 * n_keys), node[task], cls[task], need[task]


def _lots(group: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The columns' rows by group, packed."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    cut = [*np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))).tolist(), len(group)] if len(group) else [0]
    return group[cut[:-1]], [struct.pack("<I", b - a) + pack_columns(*[c[order[a:b]] for c in columns]) for a, b in zip(cut, cut[1:])]


def _unlot(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    lots = [unpack_columns(b[4:], struct.unpack_from("<I", b)[0], *kinds) for b in blobs]
    return [np.concatenate(c) for c in zip(*lots)] if lots else [np.zeros(0, k) for k in kinds]


def count_keys(cold: list[bytes], common: list[bytes], moved: list[bytes], group: int, groups: int) -> pa.Table:
    """One bucket of keys: those of two sets or more, with how many have them, by group of nodes; ``moved`` entries pass on."""
    key, node, cls, need = (np.concatenate(c) for c in zip(*map(_entries, cold))) if cold else (np.zeros(0, k) for k in ("<u8", "<i8", "<u1", "<u4"))
    order = np.lexsort((node, key))
    key, node, cls, need = key[order], node[order], cls[order], need[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])  # copies in other tasks
    key, node, cls, need = key[new], node[new], cls[new], need[new]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate((head, [len(key)])))
    df = np.repeat(n, n)
    df[np.isin(key, np.frombuffer(b"".join(common), "<u8"))] = _COMMON_DF
    many = df > 1
    which, lots = _lots(node[many] % groups, node[many].astype("<i8"), cls[many].astype("<u1"), need[many].astype("<u4"), key[many].astype("<u8"), df[many].astype("<u4"))
    if moved:
        node, cls, need, key = _unlot(moved, "<i8", "<u1", "<u4", "<u8")
        own = pack_columns(node, cls, need, key, np.full(len(key), _COMMON_DF, "<u4"))
        which, lots = np.append(which, group), [*lots, struct.pack("<I", len(key)) + own]
    return pa.table({"group": pa.array(which, pa.int64()), "lot": pa.array(lots, pa.binary())})


def rarest_keys(blobs: list[bytes]) -> pa.Table:
    """One group of nodes: each set's rarest keys, as many as the prefix filter asks for; its home is the most common of these.
    ``lead`` is true once for each set and class."""
    node, cls, need, key, df = _unlot(blobs, "<i8", "<u1", "<u4", "<u8", "<u4")
    order = np.lexsort((key, df, cls, node))
    node, cls, need, key, df = node[order], cls[order], need[order], key[order], df[order]

    def heads(*columns: np.ndarray) -> np.ndarray:
        new = np.ones(len(columns[0]), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        return new

    once = heads(node, cls, key)  # a node of several tasks
    node, cls, need, key, df = node[once], cls[once], need[once], key[once], df[once]
    head = np.flatnonzero(heads(node, cls)) if len(node) else np.zeros(0, np.int64)
    shared = np.diff(np.concatenate((head, [len(node)])))
    rank = np.arange(len(node)) - np.repeat(head, shared)
    keep = rank <= np.repeat(shared, shared) - need.astype(np.int64)
    node, cls, key, df = node[keep], cls[keep], key[keep], df[keep]
    lead, equal = heads(node, cls), np.flatnonzero(heads(node, cls, df))
    task = np.cumsum(lead) - 1
    home = np.zeros(len(node) and int(task[-1]) + 1, np.int64)
    home[task[equal]] = equal  # of the runs of one count the last stays
    return pa.table({"key": key.view("<i8"), "node": node, "cls": cls.astype(np.int32), "home": key[home[task]].view("<i8"), "lead": lead})


class Trie:
    """Sets of numbers in order; branches hold runs of numbers."""

    __slots__ = ("run", "below", "ids", "short", "long")

    def __init__(self, run: np.ndarray):
        self.run, self.below, self.ids, self.short, self.long = run, {}, [], 1 << 60, 0

    def _count(self, size: int) -> None:
        self.short, self.long = min(self.short, size), max(self.long, size)

    def add(self, s: np.ndarray, who: int) -> None:
        node, at = self, 0
        self._count(len(s))
        while at < len(s):
            child = node.below.get(int(s[at]))
            if child is None:
                child = Trie(s[at:])
                node.below[int(s[at])] = child
                child._count(len(s))
                at, node = len(s), child
                break
            n = min(len(child.run), len(s) - at)
            differ = np.flatnonzero(child.run[:n] != s[at : at + n])
            same = int(differ[0]) if len(differ) else n
            if same < len(child.run):
                middle = Trie(child.run[:same])
                node.below[int(s[at])] = middle
                child.run = child.run[same:]
                middle.below[int(child.run[0])] = child
                middle.short, middle.long = child.short, child.long
                child = middle
            child._count(len(s))
            at, node = at + same, child
        node.ids.append(who)

    def similar(self, s: np.ndarray, universe: int, num: int, den: int) -> list[int]:
        """The sets in the trie whose similarity with s is num / den at least."""
        a, out = len(s), []
        has = np.zeros(universe + 1, np.int32)
        has[s + 1] = 1
        upto = np.cumsum(has)  # of s, how many are below a number
        todo = [(c, 0, 0) for c in self.below.values()]
        while todo:
            node, over, length = todo.pop()
            over, length = over + int(has[node.run + 1].sum()), length + len(node.run)
            left = a - int(upto[int(node.run[-1]) + 1])
            # the best size that a set below can have, and its overlap if all that remains agrees
            size = min(node.long, max(node.short, length + left))
            if (num + den) * (over + min(left, size - length)) < num * (a + size):
                continue
            if node.ids and (num + den) * over >= num * (a + length):
                out += node.ids
            todo += [(c, over, length) for c in node.below.values()]
        return out


def links_within(sets: list[np.ndarray], threshold: Fraction, first: int = 0) -> list[tuple[int, int]]:
    """All pairs of similar sets; with ``first``, those of one of the first so many sets and one of the others."""
    universe, ranks = np.unique(np.concatenate(sets), return_inverse=True)
    cut = np.cumsum([len(s) for s in sets])[:-1]
    root, out = Trie(np.zeros(0, np.int64)), []
    for i, s in enumerate(np.split(ranks.ravel().astype(np.int64), cut)):
        if i >= first:
            out += [(k, i) for k in root.similar(s, len(universe), threshold.numerator, threshold.denominator)]
        if i < first or not first:
            root.add(s, i)
    return out


def linked_sets(links: list[tuple[int, int]], copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets that have links, the first set that each is connected with, and the rows that its links lead to."""
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    up = list(range(len(copies)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in links:
        i, j = root(i), root(j)
        up[max(i, j)] = min(i, j)
    n = np.zeros(len(copies), np.int64)
    np.add.at(n, a, copies[b])
    np.add.at(n, b, copies[a])
    has = np.flatnonzero(n)
    return has, np.array([root(x) for x in has.tolist()], np.int64), n[has]


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for the nodes of ``edges`` (a, b), by large-star and small-star rounds.

    The least neighbours are written before they are joined, so that Spark can split the rows of a node that many are linked with.
    """
    links = materialize(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = materialize(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m")), "least")
        large = materialize(both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct(), "large")
        small = materialize(large.groupBy("v").agg(F.min("u").alias("m")), "small")
        pairs = F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u"))))
        now_links = materialize(large.join(small, "v").select(pairs.alias("e")).select("e.*").filter("u <> v").distinct(), "links")
        now = tuple(now_links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(links, least, large, small)
        links = now_links
        if now == before:
            break
        before = now
    return links.groupBy("v").agg(F.min("u").alias("root")).withColumnRenamed("v", "node").unionByName(links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def join(docs: DataFrame, *, n: int = 5, threshold: Fraction | float = 0.8, bucket_bytes: int = 12 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the smallest id that links reach, its own included), n_links (other rows that are similar) of each row."""
    ship(docs.sparkSession)
    t = Fraction(threshold).limit_denominator(1000)
    classes, kind = Classes(t), docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    buckets = pieces_of(text_bytes(docs, text_col), bucket_bytes)
    to_meet = "bucket long, cold binary, common binary, moved binary"

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(words(part.column(1), SPACED_LOWER), n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) if len(s) else None for s in sets], pa.int64())], names=["id", "n_shingles", "node"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in gathered(batches, most=3 << 20):
            own: dict[int, np.ndarray] = {}
            for part in slices(batch):
                for s in shingle_sets(words(part.column(1), SPACED_LOWER), n):
                    if len(s) and (x := _node(s)) not in done:
                        done.add(x)
                        own[x] = s
            keys, task, who, cls, need = part_keys(list(own.values()), classes)
            if not len(keys):
                continue
            tasks = [np.array(list(own), np.int64)[who].astype("<i8"), cls.astype("<u1"), need.astype("<u4")]
            each, of, held = np.unique(keys, return_inverse=True, return_counts=True)
            common, shared = each[held >= COMMON], (held >= COMMON)[of]
            out: dict[int, list] = {}
            for b in np.unique(home := (common % np.uint64(buckets)).astype(np.int64)).tolist():
                out.setdefault(b, [None] * 3)[1] = common[home == b].astype("<u8").tobytes()
            at = task[shared]
            for g, lot in zip(*_lots(tasks[0][at] % buckets, *[c[at] for c in tasks], keys[shared].astype("<u8"))):
                out.setdefault(int(g), [None] * 3)[2] = lot
            keys, task = keys[~shared], task[~shared]
            bucket = (keys % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((task, bucket))
            keys, task = keys[order], task[order]
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                mine, own_task = np.unique(task[cut[b] : cut[b + 1]], return_inverse=True)
                table = pack_columns(*[c[mine] for c in tasks])
                steps = pack_columns(np.diff(own_task, prepend=0).astype("<u4"))
                out.setdefault(b, [None] * 3)[0] = struct.pack("<III", len(mine), len(own_task), len(table)) + table + steps + keys[cut[b] : cut[b + 1]].tobytes()
            lots = list(out.items())
            for i in range(0, len(lots), 500):
                part = lots[i : i + 500]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in part], pa.int64()), *[pa.array([x[k] for _, x in part], pa.binary()) for k in range(3)]], names=["bucket", "cold", "common", "moved"])

    def count(lot: pa.Table) -> pa.Table:
        cold, common, moved = ([x for x in lot.column(c).to_pylist() if x is not None] for c in ("cold", "common", "moved"))
        return count_keys(cold, common, moved, lot.column("bucket")[0].as_py(), buckets)

    table = materialize(rows.mapInArrow(released(profile), f"id {kind}, n_shingles long, node long"), "sets")
    sent = rows.mapInArrow(released(route), to_meet).repartition(pieces_of(buckets, 2), "bucket")  # as many partitions as the data asks for
    counted = sent.groupBy("bucket").applyInArrow(released_group(count), "group long, lot binary")
    kept = counted.groupBy("group").applyInArrow(released_group(lambda x: rarest_keys(x.column("lot").to_pylist())), "key long, node long, cls int, home long, lead boolean")
    kept = materialize(kept, "kept")
    # parts that join sets of different homes: the sets of the later homes visit the earlier ones
    several = materialize(kept.groupBy("key").agg(F.min("home").alias("lo"), F.max("home").alias("hi")).filter("lo < hi").select("key"), "several")
    meeting = materialize(kept.join(several, "key", "left_semi").select("key", "node", "cls", "home"), "meeting")
    others = materialize(meeting.select("key", F.col("home").alias("other")).distinct(), "others")
    visits = meeting.join(others, "key").filter("other < home").select("node", "cls", F.col("other").alias("home")).distinct()
    placed = kept.filter("lead").select("node", "cls", "home", F.lit(False).alias("visits")).unionByName(visits.withColumn("visits", F.lit(True)))
    placed = materialize(placed, "placed")
    room = F.greatest(F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_SHINGLES) / F.element_at(F.array(*[F.lit(float(x)) for x in classes.hi]), F.col("cls") + 1))), F.lit(1))
    sizes = placed.groupBy("home", "cls").agg(F.count_if(~F.col("visits")).alias("own"), F.count_if("visits").alias("more")).filter("own + more > 1")
    sizes = sizes.withColumn("room", room).select("home", "cls", F.ceil(F.col("own") / F.col("room")).cast("int").alias("own"), F.ceil(F.col("more") / F.col("room")).cast("int").alias("more"))
    sizes = materialize(sizes, "sizes")
    at = F.when(F.col("visits"), F.col("own") + F.pmod(F.xxhash64("node"), F.col("more"))).otherwise(F.pmod(F.xxhash64("node"), F.col("own"))).cast("int")
    # a set meets its own block and all others of its home; a visitor meets the home's own alone
    last = F.when(F.col("visits"), F.col("own")).otherwise(F.col("own") + F.col("more")) - 1
    members = materialize(placed.join(sizes, ["home", "cls"]).select("node", "cls", "home", at.alias("block"), last.alias("last")), "members")
    # one document for each set; the join reads texts again instead of keeping all sets
    of_node = materialize(table.filter(F.col("node").isNotNull() & F.col("id").isNotNull()).groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "nodes")
    chosen = materialize(members.select("node").distinct().join(of_node, "node"), "chosen")
    discard(kept, several, meeting, others, placed, sizes)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(words(part.column(1), SPACED_LOWER), n)
                mine = pa.array([len(s) > 0 and _node(s) == x for s, x in zip(sets, part.column(2).to_pylist())])
                held = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([c.filter(mine) for c in (*part.columns[2:], held)], names=["node", "copies", "held"])

    # a bit table of the chosen ids, of bounded size, keeps the texts of all other documents out of the exchange
    h = F.xxhash64("id").alias("h")
    likely = may_hold(rows.select("id", "text", h), "h", *bit_table(chosen.select(h), "h")).drop("h")

    held = likely.join(chosen, "id").select("id", "text", "node", "copies").mapInArrow(released(sets_of), "node long, copies long, held binary")
    other = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    blocks = held.join(members, "node").select("node", "cls", "home", "block", "copies", "held", other).select("node", "cls", "home", "block", "copies", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "held")

    def verify(lot: pa.Table) -> pa.Table:
        # by block; a pair of two blocks gives the links between them, the pair of a block with itself those within
        own = {x: (b, x, c, h) for b, x, c, h in zip(*[lot.column(c).to_pylist() for c in ("block", "node", "copies", "held")])}
        rows = sorted(own.values(), key=lambda x: x[:2])
        first = sum(x[0] == rows[0][0] for x in rows)
        cls, two = lot.column("cls")[0].as_py(), lot.column("i")[0].as_py() != lot.column("j")[0].as_py()
        none = len(rows) < 2 or two and first == len(rows)
        found = [] if none else links_within([np.frombuffer(x[3], np.uint64) for x in rows], t, first if two else 0)
        # two sets that meet in two classes count in that of the larger one
        found = [(a, b) for a, b in found if classes.of(max(len(rows[a][3]), len(rows[b][3])) // 8)[0][0] == cls]
        nodes = np.array([x[1] for x in rows], np.int64)
        has, to, n_links = linked_sets(found, np.array([x[2] for x in rows], np.int64))
        return pa.table({"a": nodes[has], "b": nodes[to], "n": n_links})

    met = materialize(blocks.groupBy("home", "cls", "i", "j").applyInArrow(verify, "a long, b long, n long"), "met")
    discard(members, chosen)
    linked = components(met).join(met.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")), "node")
    # what the rows of a set have besides the rows themselves, for sets of several rows and sets with links; written, so that the joins
    # below stand alone and a set or a component of many rows can be split
    extra = of_node.join(linked, "node", "left").filter("copies > 1 or n > 0").select("node", "root", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"))
    named = table.join(materialize(extra, "extra"), "node", "left").select("id", "n_shingles", F.coalesce("root", "node").alias("root"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    first = materialize(named.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("component")), "first")
    component = F.when(F.col("root").isNull() | F.col("id").isNull(), F.col("id")).otherwise(F.col("component"))
    return named.join(first, "root", "left").select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.when(F.col("id").isNotNull(), F.col("n")).alias("n_links"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``docs`` with one row of each component: one of those of the smallest id; rows without an id come behind all ids."""
    row = free_name(docs.columns, "row")
    # written, so that rows keep their numbers; a row is known by its id and number, since rows may repeat an id or have none
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    found = join(numbered.select(key.alias("key"), F.col(text_col).alias("text")), id_col="key", text_col="text", **more)
    gone = found.filter(F.col("key") != F.col("component_id")).select(F.col("key.row").alias(row))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)
