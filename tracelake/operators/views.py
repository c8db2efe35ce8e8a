"""Analytical views.  Compact summaries don't count as messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import instant


def _live(messages: DataFrame) -> DataFrame:
    return messages.filter(~F.col("is_compact_summary"))


def file_token_cost(ops: DataFrame, messages: DataFrame, sessions: DataFrame, usage: DataFrame) -> DataFrame:
    """A message with several operations counts for each of them."""
    m = _live(messages).select(F.col("uuid").alias("message_uuid"), F.col("session_id").alias("sid"))
    rows = (
        ops.select("file_path", "operation_type", "message_uuid")
        .join(m, "message_uuid")
        .join(sessions.select(F.col("session_id").alias("sid"), "project_path"), "sid")
        .join(usage.select("message_uuid", "input_tokens", "output_tokens"), "message_uuid", "left")
    )
    zero = F.lit(0)
    return rows.groupBy("project_path", "file_path", "operation_type").agg(
        F.count("*").alias("operation_count"),
        F.coalesce(F.sum("input_tokens"), zero).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), zero).alias("output_tokens"),
        F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), zero).alias("total_tokens"),
    )


def _said_before(ops: DataFrame, messages: DataFrame, content: DataFrame, sessions: DataFrame, window_s: int, compat: str | None) -> DataFrame:
    """Operations with what the assistant said in their session in the seconds before, their own message included.

    An equi-join on the session and a bucket of time as long as the window; an operation looks into its own bucket and
    the one before, so the work is bounded by what was said in two windows, however long the session.
    """
    at = instant(F.col("timestamp"))
    op = ops.join(_live(messages).select(F.col("uuid").alias("message_uuid"), F.col("session_id").alias("sid"), at.alias("op_at")), "message_uuid")
    said = messages.filter(F.col("type") == "assistant").select(F.col("uuid").alias("assistant_uuid"), F.col("session_id").alias("sid"), F.col("timestamp").alias("reasoning_timestamp"), "model", at.alias("said_at"))
    if compat == "lexical":
        # a lower bound on the text of the day alone: everything since the midnight before the window's start
        op = op.withColumn("since", F.date_trunc("day", F.col("op_at") - F.make_interval(secs=F.lit(window_s)))).withColumn("bucket", F.explode(F.sequence(F.to_date("since"), F.to_date("op_at"))))
        said = said.withColumn("bucket", F.to_date("said_at"))
    else:
        op = op.withColumn("since", F.col("op_at") - F.make_interval(secs=F.lit(window_s)))
        number = F.floor(F.unix_millis("op_at") / (window_s * 1000))
        op = op.withColumn("bucket", F.explode(F.array(number - 1, number)))
        said = said.withColumn("bucket", F.floor(F.unix_millis("said_at") / (window_s * 1000)))
    text = content.filter(F.col("block_type") == "text").select(F.col("message_uuid").alias("assistant_uuid"), "block_index", F.col("text_content").alias("assistant_reasoning"))
    near = op.join(said, ["sid", "bucket"]).filter((F.col("said_at") <= F.col("op_at")) & (F.col("said_at") >= F.col("since")))
    return near.join(text, "assistant_uuid").join(sessions.select("session_id", "project_path"), "session_id")


def file_conversation_context(ops: DataFrame, messages: DataFrame, content: DataFrame, sessions: DataFrame, window_s: int = 60, compat: str | None = None) -> DataFrame:
    own = ops.filter(F.col("operation_type").isin("write", "edit")).select("file_path", "operation_type", F.col("timestamp").alias("operation_timestamp"), "session_id", "message_uuid")
    return _said_before(own, messages, content, sessions, window_s, compat).select(
        "file_path", "operation_type", "operation_timestamp", "session_id", "project_path", F.col("assistant_uuid").alias("assistant_message_uuid"), "assistant_reasoning", "reasoning_timestamp", "model"
    )


def git_commit_context(git: DataFrame, messages: DataFrame, content: DataFrame, sessions: DataFrame, window_s: int = 120, compat: str | None = None) -> DataFrame:
    own = git.filter(F.col("operation_type") == "commit").select("commit_message", "branch", F.col("timestamp").alias("commit_timestamp"), "session_id", "message_uuid")
    return _said_before(own, messages, content, sessions, window_s, compat).select("commit_message", "branch", "commit_timestamp", "session_id", "project_path", "assistant_reasoning", "reasoning_timestamp")


def _per_session(sessions: DataFrame, messages: DataFrame, usage: DataFrame, ops: DataFrame, git: DataFrame) -> DataFrame:
    """Sessions with the sums of each child table, summed before the join."""
    m = (
        _live(messages)
        .select(F.col("uuid").alias("message_uuid"), "session_id", "timestamp")
        .join(usage.select("message_uuid", "input_tokens", "output_tokens", "cache_read_input_tokens"), "message_uuid", "left")
        .groupBy("session_id")
        .agg(
            F.count("*").alias("message_count"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
            F.sum("cache_read_input_tokens").alias("cache_read_tokens"),
            F.max("timestamp").alias("last_activity"),
        )
    )
    f = ops.groupBy("session_id").agg(F.count("*").alias("file_ops"))
    g = git.groupBy("session_id").agg(F.count("*").alias("git_ops"))
    out = sessions.select("session_id", "project_path", "first_seen_at").join(m, "session_id", "left").join(f, "session_id", "left").join(g, "session_id", "left")
    for c in ("message_count", "input_tokens", "output_tokens", "total_tokens", "cache_read_tokens", "file_ops", "git_ops"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)).cast("long"))
    return out


def _fanned_out(name: str):
    return F.col(name) * F.greatest(F.col("file_ops"), F.lit(1)) * F.greatest(F.col("git_ops"), F.lit(1))


def project_summary(sessions: DataFrame, messages: DataFrame, usage: DataFrame, ops: DataFrame, git: DataFrame, compat: str | None = None) -> DataFrame:
    """``compat='fanout'``: token sums as a join of all children before summing would inflate them, in closed form."""
    s = _per_session(sessions, messages, usage, ops, git)
    return s.groupBy("project_path").agg(
        F.count("*").alias("session_count"),
        F.sum("message_count").alias("message_count"),
        F.sum(_fanned_out("total_tokens") if compat == "fanout" else F.col("total_tokens")).alias("total_tokens"),
        F.sum("file_ops").alias("file_operations"),
        F.sum("git_ops").alias("git_operations"),
        F.min("first_seen_at").alias("first_activity"),
        F.max("last_activity").alias("last_activity"),
    )


def session_cost(sessions: DataFrame, messages: DataFrame, usage: DataFrame, ops: DataFrame, git: DataFrame, compat: str | None = None) -> DataFrame:
    s = _per_session(sessions, messages, usage, ops, git)
    for c in ("input_tokens", "output_tokens", "cache_read_tokens") if compat == "fanout" else ():
        s = s.withColumn(c, _fanned_out(c))
    return s.select("session_id", "project_path", "first_seen_at", "message_count", "input_tokens", "output_tokens", "cache_read_tokens", "file_ops", "git_ops")


def file_provenance(ops: DataFrame, messages: DataFrame, sessions: DataFrame) -> DataFrame:
    m = _live(messages).select(F.col("uuid").alias("message_uuid"), F.col("type").alias("message_type"))
    rows = ops.join(m, "message_uuid").join(sessions.select("session_id", "project_path"), "session_id")
    return rows.select("file_path", "operation_type", "timestamp", "session_id", "project_path", "content", "old_content", "command", "result_summary", "is_error", "message_uuid", "message_type").orderBy("file_path", "timestamp", "message_uuid")


def tool_errors(tools: DataFrame, messages: DataFrame, sessions: DataFrame) -> DataFrame:
    m = _live(messages).select(F.col("uuid").alias("message_uuid"), "session_id", "timestamp")
    rows = tools.filter(F.col("is_error")).join(m, "message_uuid").join(sessions.select("session_id", "project_path"), "session_id")
    return rows.select("tool_name", "is_error", F.substring("result_content", 1, 500).alias("error_content"), "message_uuid", "session_id", "project_path", "timestamp", "input_json")
