"""Filtered listings.  Filters that are None don't filter; substrings are literal and ignore the case."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import has_text, newest


def _where(df: DataFrame, **equal) -> DataFrame:
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def _between(df: DataFrame, column: str, after: str | None, before: str | None) -> DataFrame:
    if after is not None:
        df = df.filter(F.col(column) >= after)
    if before is not None:
        df = df.filter(F.col(column) <= before)
    return df


def _of_project(df: DataFrame, sessions: DataFrame, project: str | None) -> DataFrame:
    """Only rows of sessions whose project path has the text; no join without the filter."""
    if project is None:
        return df
    return df.join(sessions.filter(has_text(F.col("project_path"), project)).select("session_id"), "session_id", "left_semi")


def session_counts(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with message_count and primary model (that of the earliest message with one)."""
    per = messages.groupBy("session_id").agg(F.count("*").alias("message_count"), F.min_by("model", F.when(F.col("model").isNotNull(), F.struct("timestamp", "uuid"))).alias("model"))
    return sessions.join(per, "session_id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)).cast("long"))


def list_sessions(sessions: DataFrame, messages: DataFrame, *, project: str | None = None, after: str | None = None, before: str | None = None, has_plan: bool | None = None, limit: int | None = 50) -> DataFrame:
    df = _between(sessions, "first_seen_at", after, before)
    if project is not None:
        df = df.filter(has_text(F.col("project_path"), project))
    if has_plan is not None:
        df = df.join(messages.filter(F.col("plan_content").isNotNull()).select("session_id"), "session_id", "left_semi" if has_plan else "left_anti")
    return newest(session_counts(df, messages), limit, F.desc("first_seen_at"), "session_id")


def query_messages(
    messages: DataFrame,
    tool_executions: DataFrame,
    *,
    session: str | None = None,
    type: str | None = None,
    model: str | None = None,
    tool: str | None = None,
    after: str | None = None,
    before: str | None = None,
    has_plan: bool | None = None,
    limit: int | None = 100,
) -> DataFrame:
    df = _between(_where(messages, session_id=session, type=type, model=model), "timestamp", after, before)
    if tool is not None:
        df = df.join(tool_executions.filter(F.col("tool_name") == tool).select(F.col("message_uuid").alias("uuid")), "uuid", "left_semi")
    if has_plan is not None:
        df = df.filter(F.col("plan_content").isNotNull() == has_plan)
    return newest(df, limit, F.desc("timestamp"), "uuid")


def list_attachments(attachments: DataFrame, sessions: DataFrame, *, project: str | None = None, inner_type: str | None = None, since: str | None = None, uuid: str | None = None, limit: int | None = 100) -> DataFrame:
    df = _between(_where(attachments, inner_type=inner_type, uuid=uuid), "timestamp", since, None).join(sessions.select("session_id", "project_path"), "session_id", "left")
    if project is not None:
        df = df.filter(has_text(F.col("project_path"), project))
    return newest(df, limit, F.desc("timestamp"), "uuid")


def list_hook_executions(hooks: DataFrame, *, tool_use_id: str | None = None, hook_event: str | None = None, exit_code: int | None = None, limit: int | None = 100) -> DataFrame:
    return newest(_where(hooks, tool_use_id=tool_use_id, hook_event=hook_event, exit_code=exit_code), limit, F.desc("timestamp"), "attachment_uuid", "hook_event", "tool_use_id")


def list_plans(messages: DataFrame, sessions: DataFrame, *, project: str | None = None, since: str | None = None, limit: int | None = 100) -> DataFrame:
    df = _between(messages.filter(F.col("plan_content").isNotNull()), "timestamp", since, None).join(sessions.select("session_id", "project_path"), "session_id", "left")
    if project is not None:
        df = df.filter(has_text(F.col("project_path"), project))
    df = df.select("uuid", "session_id", "project_path", "timestamp", F.length("plan_content").cast("long").alias("plan_length"), F.substring("plan_content", 1, 200).alias("preview"))
    return newest(df, limit, F.desc("timestamp"), "uuid")


def show_plans(messages: DataFrame, session_id: str | None = None) -> DataFrame:
    df = _where(messages.filter(F.col("plan_content").isNotNull()), session_id=session_id)
    return df.select("uuid", "session_id", "timestamp", "plan_content").orderBy("timestamp", "uuid")


def list_files(files: DataFrame, sessions: DataFrame, *, session: str | None = None, path_contains: str | None = None, project: str | None = None, file_path: str | None = None, limit: int | None = 100) -> DataFrame:
    df = _where(files, session_id=session, file_path=file_path)
    if path_contains is not None:
        df = df.filter(has_text(F.col("file_path"), path_contains))
    return newest(_of_project(df, sessions, project), limit, F.desc("last_modified"), "session_id", "file_path")


def glob_regex(pattern: str) -> str:
    """A glob in which ``*`` crosses slashes as a regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        if c == "*":
            out += "" if out.endswith(".*") else ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 1)) >= 0:
            body, i = pattern[i:end], end + 1
            out += "[" + ("^" + body[1:] if body[:1] in "!^" else body).replace("\\", "\\\\") + "]"
        else:
            out += re.escape(c)
    return f"^(?s:{out})$"


def glob_files(files: DataFrame, pattern: str, *, session: str | None = None, limit: int | None = 100) -> DataFrame:
    """Over all files, case-sensitive."""
    return newest(_where(files, session_id=session).filter(F.col("file_path").rlike(glob_regex(pattern))), limit, F.desc("last_modified"), "session_id", "file_path")


def file_history(ops: DataFrame, sessions: DataFrame, path_contains: str, *, session: str | None = None, project: str | None = None, limit: int | None = None) -> DataFrame:
    df = _where(ops, session_id=session).filter(has_text(F.col("file_path"), path_contains))
    return newest(_of_project(df, sessions, project), limit, "timestamp", "tool_use_id")


def git_log(git: DataFrame, *, session: str | None = None, op_type: str | None = None, limit: int | None = 100) -> DataFrame:
    return newest(_where(git, session_id=session, operation_type=op_type), limit, F.desc("timestamp"), "tool_use_id", "operation_type")


def git_commits(git: DataFrame, *, session: str | None = None, limit: int | None = 100) -> DataFrame:
    return git_log(git, session=session, op_type="commit", limit=limit)


def list_projects(projects: DataFrame, limit: int | None = None) -> DataFrame:
    return newest(projects, limit, F.desc("session_count"), "project_path")


def session_agents(agents: DataFrame, session: str | None = None) -> DataFrame:
    return _where(agents, session_id=session).orderBy("first_seen_at", "agent_id")


def read_bookmarks(bookmarks: DataFrame, projects: DataFrame) -> DataFrame:
    """bookmarks (id, project_id, session_id, user_uuid, assistant_uuid, label, tags JSON, created: seconds since 2001) with their projects."""
    p = projects.select(F.col("id").alias("project_id"), F.col("path").alias("project_path"), F.col("encoded_name"))
    return bookmarks.join(p, "project_id").withColumn("created_at", F.timestamp_seconds(F.col("created") + 978307200)).withColumn("tag_list", F.from_json("tags", "array<string>"))


def list_bookmarks(bookmarks: DataFrame, *, project: str | None = None, limit: int | None = 100) -> DataFrame:
    if project is not None:
        bookmarks = bookmarks.filter(has_text(F.col("project_path"), project) | (F.col("encoded_name") == project))
    return newest(bookmarks, limit, F.desc("created_at"), "id")


def search_bookmarks(bookmarks: DataFrame, query: str, *, project: str | None = None, limit: int | None = 100) -> DataFrame:
    return list_bookmarks(bookmarks.filter(has_text(F.col("label"), query) | has_text(F.col("tags"), query)), project=project, limit=limit)


def get_bookmark(bookmarks: DataFrame, *, id: int | None = None, assistant_uuid: str | None = None, project: str | None = None) -> DataFrame:
    if id is None and assistant_uuid is None:
        raise ValueError("an id or an assistant message's uuid is needed")
    return list_bookmarks(_where(bookmarks, id=id, assistant_uuid=assistant_uuid), project=project, limit=1)


def content_like(messages: DataFrame, content: DataFrame, term: str, limit: int | None = 50) -> DataFrame:
    """Blocks that hold a text, by a scan."""
    found = content.filter(has_text(F.col("text_content"), term)).select(F.col("message_uuid").alias("uuid"), "block_index", "block_type", F.substring("text_content", 1, 200).alias("content_preview"))
    rows = messages.select("uuid", "session_id", F.col("type").alias("message_type"), "timestamp").join(found, "uuid")
    return newest(rows, limit, F.desc("timestamp"), "uuid", "block_index")


def recent_sessions(sessions: DataFrame, messages: DataFrame, limit: int | None = 20) -> DataFrame:
    return newest(session_counts(sessions, messages), limit, F.desc("last_seen_at"), "session_id")
