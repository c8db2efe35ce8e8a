"""Nested documents: messages with their blocks, conversations, trees, artifacts and timelines of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assembled_messages(messages: DataFrame, content: DataFrame, usage: DataFrame, *, session: str | None = None, uuid: str | None = None) -> DataFrame:
    """Each message with ``blocks`` in order (no plan blocks) and ``usage``; one grouped join for all of them."""
    if session is not None:
        messages = messages.filter(F.col("session_id") == session)
    if uuid is not None:
        messages = messages.filter(F.col("uuid") == uuid)
    block = F.struct("block_index", "block_type", "text_content", "tool_use_id", "tool_name", "tool_input", "is_error")
    blocks = content.filter("block_index >= 0").groupBy(F.col("message_uuid").alias("uuid")).agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    used = usage.select(F.col("message_uuid").alias("uuid"), F.struct("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens").alias("usage"))
    joined = messages.join(blocks, "uuid", "left").join(used, "uuid", "left")
    return joined.withColumn("blocks", F.coalesce("blocks", F.array().cast(blocks.schema["blocks"].dataType)))


def conversation(messages: DataFrame, content: DataFrame, usage: DataFrame, *, session: str | None = None, include_thinking: bool = True, include_tool_io: bool = True, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Assembled messages of each session in order, with their position, without the blocks that aren't asked for."""
    df = assembled_messages(messages, content, usage, session=session)
    hidden = ["thinking"] * (not include_thinking) + ["tool_use", "tool_result"] * (not include_tool_io)
    if hidden:
        df = df.withColumn("blocks", F.filter("blocks", lambda b: ~b["block_type"].isin(*hidden)))
    df = df.withColumn("position", F.row_number().over(Window.partitionBy("session_id").orderBy("timestamp", "uuid")).cast("long"))
    if offset:
        df = df.filter(F.col("position") > offset)
    if limit is not None:
        df = df.filter(F.col("position") <= offset + limit)
    return df.select("session_id", "position", "uuid", "parent_uuid", "is_sidechain", "type", "timestamp", "model", "blocks", "usage")


def session_tree(messages: DataFrame, session: str | None = None) -> DataFrame:
    """Each message with the number of its direct children, of whatever session."""
    children = messages.filter(F.col("parent_uuid").isNotNull()).groupBy(F.col("parent_uuid").alias("uuid")).agg(F.count("*").alias("child_count"))
    nodes = messages if session is None else messages.filter(F.col("session_id") == session)
    return nodes.select("uuid", "session_id", "parent_uuid", "type", "timestamp", "is_sidechain").join(children, "uuid", "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)).cast("long"))


def session_artifacts(files: DataFrame, git: DataFrame, tools: DataFrame, messages: DataFrame, session: str | None = None) -> DataFrame:
    """session_id, files, git_operations, tool_runs: arrays in order."""
    runs = tools.join(messages.select(F.col("uuid").alias("message_uuid"), "session_id", "timestamp"), "message_uuid")
    f = files.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("file_path", "first_seen", "last_modified", "operation_count"))).alias("files"))
    g = git.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "operation_type", "command", "commit_message", "branch"))).alias("git_operations"))
    t = runs.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "tool_use_id", "tool_name", F.substring("result_content", 1, 500).alias("summary"), "is_error"))).alias("tool_runs"))
    out = f.join(g, "session_id", "full").join(t, "session_id", "full")
    return out if session is None else out.filter(F.col("session_id") == session)


def session_timeline(ops: DataFrame, git: DataFrame, tools: DataFrame, messages: DataFrame, session: str | None = None, limit: int | None = 500) -> DataFrame:
    """File operations, git operations and tool runs of each session by time, the first ``limit`` of each."""
    runs = tools.join(messages.select(F.col("uuid").alias("message_uuid"), "session_id", "timestamp"), "message_uuid")
    a = ops.select("session_id", "timestamp", F.lit("file_operation").alias("event_type"), F.col("operation_type").alias("name"), F.col("file_path").alias("detail"), "message_uuid", "tool_use_id")
    b = git.select("session_id", "timestamp", F.lit("git_operation").alias("event_type"), F.col("operation_type").alias("name"), F.coalesce("commit_message", "command").alias("detail"), "message_uuid", "tool_use_id")
    c = runs.select("session_id", "timestamp", F.lit("tool_execution").alias("event_type"), F.col("tool_name").alias("name"), F.substring("input_json", 1, 200).alias("detail"), "message_uuid", "tool_use_id")
    rows = a.unionByName(b).unionByName(c)
    if session is not None:
        rows = rows.filter(F.col("session_id") == session)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("timestamp", "event_type", "tool_use_id", "name", "detail")).cast("long")
    rows = rows.withColumn("position", place)
    return rows if limit is None else rows.filter(F.col("position") <= limit)
