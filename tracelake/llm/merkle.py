"""Merkle manifest of a dataset: a tree of digests for each group of rows, and one over the groups.

Digests are lower-case hexadecimal SHA-256.  A leaf is the digest of a row's fields; each run of
``fanout`` consecutive nodes has a parent.  A *slot pivot* makes a level: conditional aggregates
spread each parent's children into ``fanout`` columns, and the columns put together are hashed to
the parent; the same columns without a child's own are its siblings.  So a level is one grouping,
and the siblings of a whole level need no join of nodes with nodes.

Rows get their places in a group by ranges: rows are dealt by (group, id, leaf, what is offered), numbered where they
are, and each part of a group starts where the parts before it end.  A group of any share of the rows
is spread over many tasks.  Going down again, what proves a parent is shared by its children: a table
of paths has a row for each parent, and only in the last step a row for each leaf.

Nulls: a null field is written as ``-``; rows without an id come first in their group, the group of no
name before all others.  Empty texts are fields of no bytes.  Rows that repeat an id stand by their
leaves, and equal rows are leaves each by itself.  An empty table gives no rows and no root.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, pieces_of

#: Rows that a task puts in order.
ROWS_PER_PART = 200_000
PATH = "array<struct<l:string,r:string>>"


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of some values: each its number of bytes, a colon and itself; ``-`` if null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, the row's place in its group ``g`` by ``order`` (from 0), and ``n``, the group's number of rows."""
    names = rows.columns
    parts = pieces_of(rows.count(), ROWS_PER_PART)
    ranged = materialize(rows.repartitionByRange(parts, "g", *order).sortWithinPartitions("g", *order).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ranged")
    whole = Window.partitionBy("g")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a group has a row here for each part that holds some of it
    starts = ranged.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("own"))
    starts = starts.select("g", "part", (F.coalesce(F.sum("own").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("own").over(whole).alias("n"))
    out = materialize(ranged.join(starts, ["g", "part"]).select(*names, (F.col("at") + F.col("shift")).alias("pos"), "n"), "placed")
    discard(ranged)
    return out


@dataclass
class Tree:
    """One tree for each ``g``.  ``levels[k]`` has a row (g, pos, n, c0, c1, ..., h) for each parent of nodes of level k: its place among
    the ``n`` parents of its group, its children by slot, its digest.  ``tops`` is (g, top), the digest of each group."""

    nodes: DataFrame
    fanout: int
    levels: list[DataFrame]
    tops: DataFrame

    @property
    def slots(self) -> list[str]:
        return [f"c{i}" for i in range(self.fanout)]

    def step(self, slot: Column) -> Column:
        """What stands on either side of a slot: the columns before it and after it, put together."""
        left = F.concat_ws("", *[F.when(slot > i, F.col(c)) for i, c in enumerate(self.slots)])
        right = F.concat_ws("", *[F.when(slot < i, F.col(c)) for i, c in enumerate(self.slots)])
        return F.struct(left.alias("l"), right.alias("r"))

    def paths(self, tops: DataFrame, leaves: DataFrame) -> DataFrame:
        """``leaves`` (g, pos, n, ...) with the columns of ``tops`` (g, path, ...), ``path`` led on down to the leaf: from below, what stands on
        either side of the way up."""
        more = [c for c in tops.columns if c not in ("g", "path")]
        parent, slot = F.expr(f"pos div {self.fanout}"), F.pmod(F.col("pos"), F.lit(self.fanout))
        above = None  # of the level's parents that have a parent themselves: g, pos, path
        for level in reversed(self.levels):
            ended = level.filter("n = 1").join(tops, "g")
            known = ended if above is None else ended.unionByName(level.filter("n > 1").join(above, ["g", "pos"]))
            if level is self.levels[0]:
                above = known.drop("n", "h")
                break
            held = known.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(self.fanout - 1)))).filter(F.array(*self.slots)[F.col("slot")].isNotNull())
            above = held.select("g", (F.col("pos") * self.fanout + F.col("slot")).alias("pos"), F.concat(F.array(self.step(F.col("slot"))), "path").alias("path"), *more)
        alone = leaves.filter("n = 1").join(tops, "g")
        if above is None:
            return alone
        own = leaves.filter("n > 1").withColumns({"parent": parent, "slot": slot}).join(above.withColumnRenamed("pos", "parent"), ["g", "parent"])
        return alone.unionByName(own.withColumn("path", F.concat(F.array(self.step(F.col("slot"))), "path")).select(*alone.columns))


def tree(nodes: DataFrame, fanout: int = 16) -> Tree:
    """``nodes``: g, pos, n, h of the leaves, written."""
    out = Tree(nodes, fanout, [], nodes.filter("n = 1").select("g", F.col("h").alias("top")))
    slot = F.pmod(F.col("pos"), F.lit(fanout))
    while nodes.filter("n > 1").limit(1).count():
        # the slot pivot
        pivot = (
            nodes.filter("n > 1")
            .groupBy("g", F.expr(f"pos div {fanout}").alias("pos"))
            .agg(F.ceil(F.max("n") / fanout).cast("long").alias("n"), *[F.max(F.when(slot == i, F.col("h"))).alias(c) for i, c in enumerate(out.slots)])
        )
        nodes = materialize(pivot.withColumn("h", F.sha2(F.concat_ws("", *out.slots), 256)), "level")
        out.levels.append(nodes)
        out.tops = out.tops.unionByName(nodes.filter("n = 1").select("g", F.col("h").alias("top")))
    return out


@dataclass
class Manifest:
    """``proofs`` has a row for each row; ``groups`` one for each group (its name, subroot, root); ``root`` is None of an empty table."""

    proofs: DataFrame
    groups: DataFrame
    root: str | None


def manifest(docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), fanout: int = 16, offered: Column | None = None) -> Manifest:
    """Trees by group and the tree of the groups.

    ``proofs``: id, leaf, subroot, root, path (from below: what stands left and right of the way up), proof_sha256 (the digest of all siblings in
    that order), folded_root (what the path makes of the leaf that is ``offered``, the row's own where
    that is null) and verified (whether that is the root).
    """
    if fanout < 2:
        raise ValueError("a parent has two children at least")
    own = leaf([F.col(f) for f in fields])
    group = F.col(group_col).cast("string")
    # names in order, the null one first
    key = F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), group))
    leaves = materialize(docs.select(F.col(id_col).alias("id"), key.alias("g"), own.alias("h"), (F.lit(None).cast("string") if offered is None else offered).alias("offered")), "leaves")
    nodes = placed(leaves, ["id", "h", "offered"])
    discard(leaves)
    lower = tree(nodes, fanout)
    tops = placed(lower.tops.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("top").alias("h")), ["name"])
    upper = tree(tops, fanout)
    found = upper.tops.first()
    root = found["top"] if found else None
    ends = upper.tops.select("g", F.array().cast(PATH).alias("path"))
    groups = materialize(upper.paths(ends, tops).select(F.col("name").alias("g"), F.col("h").alias("subroot"), "path"), "groups")
    rows = lower.paths(groups, nodes)
    folded = F.aggregate("path", F.coalesce("offered", "h"), lambda h, x: F.sha2(F.concat(x["l"], h, x["r"]), 256))
    proofs = rows.select(
        F.col("id").alias(id_col),
        F.col("h").alias("leaf"),
        "subroot",
        F.lit(root).alias("root"),
        "path",
        F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["l"], x["r"])), ""), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
    return Manifest(proofs, groups.select(F.when(F.col("g") != "", F.substring("g", F.lit(2), F.length("g"))).alias(group_col), "subroot", F.lit(root).alias("root")), root)
