"""What a file held: replay of writes and edits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.columns import beside
from ..functions.ship import ship

KEYS = ["session_id", "file_path"]


_STEP = [*KEYS, "stretch", "version", "timestamp", "tool_use_id", "operation_type", "content", "old_content"]
_VERSION = "session_id string, file_path string, version bigint, timestamp string, tool_use_id string, content string"
#: Bytes of versions that a task holds before it gives them away.
_HELD = 8 << 20


def applied(content: str | None, kind: str, new: str, old: str | None) -> str | None:
    """A write replaces all; an edit replaces every place of its old text, once there is a content.  An empty old text stands nowhere."""
    if kind == "write":
        return new
    return content if content is None or not old else content.replace(old, new)


def _folding(every: bool):
    """Steps in order become versions, each given away as it is made (``every``), or the last of each stretch alone: a task holds one content."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _VERSION.split(", ")]
        out, held, key, content, last = [], 0, None, None, None

        def given() -> pa.RecordBatch:
            rows = out.copy()
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if n == "version" else pa.string()) for i, n in enumerate(names)], names=names)

        for batch in batches:
            for session, path, stretch, version, at, tool, kind, new, old in zip(*[batch.column(i).to_pylist() for i in range(len(_STEP))]):
                if (session, path, stretch) != key:
                    if last and not every:
                        out.append((*last, content))
                        held += len(content or "")
                    key, content = (session, path, stretch), None
                content, last = applied(content, kind, new, old), (session, path, version, at, tool)
                if every:
                    out.append((*last, content))
                    held += len(content or "")
                if held > _HELD:
                    yield given()
                    held = 0
        if last and not every:
            out.append((*last, content))
        if out:
            yield given()

    return fold


def replayed(steps: DataFrame, every: bool) -> DataFrame:
    """``steps`` (of stretches that begin with a write) folded in order, a stretch in a task."""
    ship(steps.sparkSession)
    rows = steps.select(*_STEP).repartition(*KEYS, "stretch").sortWithinPartitions(*KEYS, "stretch", "version")
    return rows.mapInArrow(_folding(every), _VERSION)


def _mutations(ops: DataFrame, cutoffs: DataFrame | None) -> DataFrame:
    """Writes and edits in order; ``cutoffs`` (session_id, file_path, until) leaves those up to then.
    A write without a content, or an edit that lacks its old or new text, changes nothing."""
    m = ops.filter(F.col("operation_type").isin("write", "edit") & F.col("content").isNotNull() & ((F.col("operation_type") == "write") | F.col("old_content").isNotNull()))
    if cutoffs is not None:
        m = m.join(cutoffs, KEYS, "left").filter(F.col("until").isNull() | (F.col("timestamp") <= F.col("until"))).drop("until")
    return m.select(*KEYS, "timestamp", "tool_use_id", "operation_type", "content", "old_content")


def cutoffs_at(ops: DataFrame, messages: DataFrame, uuid: str) -> DataFrame:
    """For all files the timestamp of one message; an unknown message gives no cutoff."""
    at = messages.filter(F.col("uuid") == uuid).agg(F.min("timestamp").alias("until"))
    return beside(ops.select(*KEYS).distinct(), at)


def reconstruct(ops: DataFrame, cutoffs: DataFrame | None = None) -> DataFrame:
    """The content of each file after its last operation, null if it was never written."""
    files = ops.select(*KEYS).distinct()
    m = _mutations(ops, cutoffs)
    # nothing before the last write matters
    last = m.filter(F.col("operation_type") == "write").groupBy(*KEYS).agg(F.max(F.struct("timestamp", "tool_use_id")).alias("w"))
    m = m.join(last, KEYS).filter(F.struct("timestamp", "tool_use_id") >= F.col("w")).drop("w")
    counts = m.groupBy(*KEYS).agg(F.count("*").alias("applied"))
    done = replayed(m.withColumns({"stretch": F.lit(1).cast("long"), "version": F.row_number().over(Window.partitionBy(*KEYS).orderBy("timestamp", "tool_use_id")).cast("long")}), every=False)
    found = done.select(*KEYS, "content").join(counts, KEYS)
    return files.join(found, KEYS, "left").withColumn("applied", F.coalesce("applied", F.lit(0)).cast("long"))


def file_versions(ops: DataFrame) -> DataFrame:
    """The content after each write and edit: session, path, version, timestamp, tool_use_id, content.

    A write begins a stretch that needs nothing before it: stretches are replayed each by itself, and versions leave a task as they are made."""
    order = Window.partitionBy(*KEYS).orderBy("timestamp", "tool_use_id")
    m = _mutations(ops, None).withColumn("version", (F.row_number().over(order) - 1).cast("long")).withColumn("stretch", F.count_if(F.col("operation_type") == "write").over(order))
    return replayed(m.filter("stretch > 0"), every=True)


_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+")


def unified(path: str, before: str, after: str) -> str:
    """A unified diff of lines with their ends; a last line without one is marked."""
    import difflib

    out = []
    for line in difflib.unified_diff(_LINE.findall(before), _LINE.findall(after), f"a/{path}", f"b/{path}", n=3):
        out.append(line if line[-1] in "\r\n" else f"{line}\n\\ No newline at end of file\n")
    return "".join(out)


@F.pandas_udf(StringType())
def _diff(path: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([unified(p, a or "", b or "") for p, a, b in zip(path, before, after)], dtype="object")


def file_diffs(ops: DataFrame) -> DataFrame:
    """A unified diff for each version that changed something."""
    ship(ops.sparkSession)
    v = file_versions(ops).withColumn("before", F.lag("content").over(Window.partitionBy(*KEYS).orderBy("version")))
    d = v.withColumn("diff", _diff(F.col("file_path"), F.col("before"), F.col("content")))
    return d.filter(F.length("diff") > 0).select(*KEYS, "version", "timestamp", "tool_use_id", "diff")


def joined_diffs(ops: DataFrame) -> DataFrame:
    """All diffs of a file, one after another."""
    parts = F.array_sort(F.collect_list(F.struct("version", "diff")))
    return file_diffs(ops).groupBy(*KEYS).agg(F.array_join(F.transform(parts, lambda p: p["diff"]), "\n").alias("diffs"))
