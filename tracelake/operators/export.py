"""Exports: session documents as JSON, CSV rows, Markdown transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assemble import assembled_messages


def export_json(sessions: DataFrame, messages: DataFrame, content: DataFrame, usage: DataFrame, session_id: str | None = None) -> DataFrame:
    """session_id, project_path, messages (in order, with blocks and usage)."""
    m = assembled_messages(messages, content, usage, session=session_id)
    one = F.struct("timestamp", "uuid", "type", "parent_uuid", "model", "blocks", "usage")
    docs = m.groupBy("session_id").agg(F.array_sort(F.collect_list(one)).alias("messages"))
    own = sessions if session_id is None else sessions.filter(F.col("session_id") == session_id)
    return own.select("session_id", "project_path").join(docs, "session_id", "left")


def write_json(docs: DataFrame, path: str) -> None:
    docs.withColumn("session", F.col("session_id")).write.mode("overwrite").partitionBy("session").json(path)


def export_csv(messages: DataFrame, content: DataFrame, usage: DataFrame, session_id: str | None = None) -> DataFrame:
    """uuid, session_id, type, timestamp, model, content_preview (first text or thought, 500 characters), input_tokens, output_tokens."""
    if session_id is not None:
        messages = messages.filter(F.col("session_id") == session_id)
    said = content.filter((F.col("block_index") >= 0) & F.col("block_type").isin("text", "thinking") & F.col("text_content").isNotNull())
    first = said.groupBy(F.col("message_uuid").alias("uuid")).agg(F.min_by(F.substring("text_content", 1, 500), "block_index").alias("content_preview"))
    used = usage.select(F.col("message_uuid").alias("uuid"), "input_tokens", "output_tokens")
    rows = messages.select("uuid", "session_id", "type", "timestamp", "model").join(first, "uuid", "left").join(used, "uuid", "left")
    return rows.select("uuid", "session_id", "type", "timestamp", "model", F.coalesce("content_preview", F.lit("")).alias("content_preview"), "input_tokens", "output_tokens")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.orderBy("session_id", "timestamp", "uuid").write.mode("overwrite").option("header", True).csv(path)


def export_markdown(sessions: DataFrame, messages: DataFrame, content: DataFrame, usage: DataFrame, session_id: str | None = None) -> DataFrame:
    """session_id and its transcript."""

    def block(b):
        text, kind = b["text_content"], b["block_type"]
        told = F.concat(F.coalesce(text, F.lit("")), F.lit("\n\n"))
        call = F.concat(F.lit("### Tool Use: "), F.coalesce(b["tool_name"], F.lit("unknown")), F.lit("\n"), F.coalesce(F.concat(F.lit("**Input:** `"), F.substring(b["tool_input"], 1, 200), F.lit("`\n")), F.lit("")), F.lit("\n"))
        result = F.concat(F.substring(text, 1, 500), F.when(F.length(text) > 500, " *(truncated)*").otherwise(""), F.lit("\n\n"))
        other = F.concat(F.lit("*["), kind, F.lit("]* "), text, F.lit("\n\n"))
        whole = F.when(kind.isin("text", "thinking"), F.when(text.isNotNull(), told)).when(kind == "tool_use", call).when(kind == "tool_result", result).otherwise(other)
        return F.coalesce(whole, F.lit(""))

    m = assembled_messages(messages, content, usage, session=session_id)
    body = F.concat(F.lit("---\n## "), F.initcap("type"), F.lit(" ("), "timestamp", F.lit(")\n\n"), F.array_join(F.transform("blocks", block), ""))
    parts = m.select("session_id", F.struct("timestamp", "uuid", body.alias("text")).alias("p")).groupBy("session_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    own = sessions if session_id is None else sessions.filter(F.col("session_id") == session_id)
    head = F.concat(F.lit("# Session: "), "session_id", F.lit("\n"), F.coalesce(F.concat(F.lit("**Project:** "), "project_path", F.lit("\n")), F.lit("")))
    date = F.concat(F.lit("**Date:** "), F.col("p")[0]["timestamp"], F.lit("\n\n"))
    told = F.when(F.col("p").isNull(), F.lit("\n*No messages found for this session.*\n")).otherwise(F.concat(date, F.array_join(F.transform("p", lambda x: x["text"]), "")))
    return own.select("session_id", "project_path").join(parts, "session_id", "left").select("session_id", F.concat(head, told).alias("markdown"))


def write_markdown(docs: DataFrame, path: str) -> None:
    docs.withColumn("session", F.col("session_id")).select("session", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("session").text(path)
