"""Token, tool and model statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import instant
from .listing import session_counts


def _tokens(messages: DataFrame, usage: DataFrame, key: Column, name: str) -> DataFrame:
    own = messages.select(F.col("uuid").alias("message_uuid"), key.alias(name))
    return (
        own.join(usage, "message_uuid")
        .groupBy(name)
        .agg(
            F.count("*").alias("message_count"),
            F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
            F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
            F.sum("cache_creation_input_tokens").alias("cache_creation_tokens"),
            F.sum("cache_read_input_tokens").alias("cache_read_tokens"),
        )
    )


def tokens_by_model(messages: DataFrame, usage: DataFrame) -> DataFrame:
    return _tokens(messages, usage, F.coalesce("model", F.lit("unknown")), "model").orderBy(F.desc("input_tokens"), "model")


def tokens_by_session(messages: DataFrame, usage: DataFrame, session: str | None = None) -> DataFrame:
    if session is not None:
        messages = messages.filter(F.col("session_id") == session)
    return _tokens(messages, usage, F.col("session_id"), "session_id").orderBy(F.desc("input_tokens"), "session_id")


def tokens_by_day(messages: DataFrame, usage: DataFrame) -> DataFrame:
    return _tokens(messages, usage, F.to_date(instant(F.col("timestamp"))), "day").orderBy(F.desc("day"))


def tool_frequency(tools: DataFrame) -> DataFrame:
    return tools.groupBy("tool_name").agg(F.count("*").alias("invocations"), F.count_if(F.coalesce("is_error", F.lit(False))).alias("errors")).orderBy(F.desc("invocations"), "tool_name")


def tool_usage_by_session(tools: DataFrame, messages: DataFrame, session: str | None = None) -> DataFrame:
    if session is not None:
        messages = messages.filter(F.col("session_id") == session)
    rows = tools.join(messages.select(F.col("uuid").alias("message_uuid"), "session_id"), "message_uuid")
    return rows.groupBy("session_id", "tool_name").agg(F.count("*").alias("invocations"), F.count_if(F.coalesce("is_error", F.lit(False))).alias("errors"))


def model_breakdown(messages: DataFrame) -> DataFrame:
    per = messages.filter(F.col("model").isNotNull()).groupBy("model").agg(F.count("*").alias("message_count"))
    # one row for each model; the window is over those
    share = F.round(F.col("message_count") * 100.0 / F.sum("message_count").over(Window.partitionBy(F.lit(1))), 2)
    return per.withColumn("percentage", share).orderBy(F.desc("message_count"), "model")


def session_summary(sessions: DataFrame, messages: DataFrame, usage: DataFrame, tools: DataFrame, session: str | None = None) -> DataFrame:
    """Each child table is summed by session before the join, so nothing is counted twice."""
    if session is not None:
        messages, sessions = messages.filter(F.col("session_id") == session), sessions.filter(F.col("session_id") == session)
    own = messages.select(F.col("uuid").alias("message_uuid"), "session_id", "timestamp")
    m = (
        own.join(usage.select("message_uuid", "input_tokens", "output_tokens"), "message_uuid", "left")
        .groupBy("session_id")
        .agg(
            F.count("*").alias("message_count"),
            F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
            F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
            F.min("timestamp").alias("first_message"),
            F.max("timestamp").alias("last_message"),
        )
    )
    t = tools.join(own, "message_uuid").groupBy("session_id").agg(F.count("*").alias("tool_uses"), F.count_distinct("tool_name").alias("distinct_tools"))
    zero = F.lit(0).cast("long")
    millis = F.unix_millis(instant(F.col("last_message"))) - F.unix_millis(instant(F.col("first_message")))
    return (
        sessions.select("session_id", "project_path")
        .join(m, "session_id")
        .join(t, "session_id", "left")
        .withColumn("tool_uses", F.coalesce("tool_uses", zero))
        .withColumn("distinct_tools", F.coalesce("distinct_tools", zero))
        .withColumn("duration_seconds", F.floor(millis / 1000))
    )


def session_details(sessions: DataFrame, messages: DataFrame, session: str | None = None) -> DataFrame:
    if session is not None:
        messages, sessions = messages.filter(F.col("session_id") == session), sessions.filter(F.col("session_id") == session)
    return session_counts(sessions, messages)


def project_details(project_summary: DataFrame, projects: DataFrame, path: str | None = None) -> DataFrame:
    if path is not None:
        project_summary = project_summary.filter(F.col("project_path") == path)
    return project_summary.join(projects.select("project_path", "display_name"), "project_path", "left")
