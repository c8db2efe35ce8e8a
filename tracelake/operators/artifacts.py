"""File and git operations mined from tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import upsert_first

# What counts as a git or file command, and where messages and branches stand in it.
GIT = r"(?U)(?:^|&&\s*|;\s*)git\s+(\w+)"
HEREDOC = r"""(?U)git\s+commit\s+[^"]*-m\s+"\$\(cat\s+<<'?EOF'?\n([\s\S]*?)\n\s*EOF"""
INLINE = r'(?U)git\s+commit\s+[^"]*-m\s+"([^"]+)"'
BRANCH = r"(?U)git\s+(?:checkout\s+-b|push\s+\w+)\s+(\S+)"
FILES = r"(?U)(?:^|[;&]\s*(?:&\s*)?)\s*(cp|mv|rm|mkdir|touch)\s+([^;&]+)"


def _dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Dealt by keys into so many parts; left to Spark if it isn't said."""
    return rows if parts is None else rows.repartition(parts, *keys)


def _calls(tool_executions: DataFrame, messages: DataFrame, *tools: str, parts: int | None = None) -> DataFrame:
    own = messages.select(F.col("uuid").alias("message_uuid"), "session_id", "timestamp")
    calls = tool_executions.filter(F.col("tool_name").isin(*tools)).select("message_uuid", "tool_use_id", "tool_name", "input_json")
    return _dealt(calls, parts, "message_uuid").join(_dealt(own, parts, "message_uuid"), "message_uuid")


def _op(df: DataFrame, path, kind, content, old, command, tool_use_id) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        "session_id",
        path.alias("file_path"),
        kind.alias("operation_type"),
        "timestamp",
        (none if content is None else content).alias("content"),
        (none if old is None else old).alias("old_content"),
        (none if command is None else command).alias("command"),
        tool_use_id.alias("tool_use_id"),
        "message_uuid",
    )


def write_ops(calls: DataFrame) -> DataFrame:
    c = calls.filter(F.col("tool_name") == "Write")
    return _op(c, F.get_json_object("input_json", "$.file_path"), F.lit("write"), F.get_json_object("input_json", "$.content"), None, None, F.col("tool_use_id")).filter("file_path is not null")


def edit_ops(calls: DataFrame) -> DataFrame:
    c = calls.filter(F.col("tool_name") == "Edit")
    new, old = (F.get_json_object("input_json", f"$.{x}_string") for x in ("new", "old"))
    return _op(c, F.get_json_object("input_json", "$.file_path"), F.lit("edit"), new, old, None, F.col("tool_use_id")).filter("file_path is not null")


def read_ops(calls: DataFrame) -> DataFrame:
    c = calls.filter(F.col("tool_name") == "Read")
    return _op(c, F.get_json_object("input_json", "$.file_path"), F.lit("read"), None, None, None, F.col("tool_use_id")).filter("file_path is not null")


def shell_ops(calls: DataFrame) -> DataFrame:
    """One row for each argument of cp, mv, rm, mkdir, touch that is no flag; ``<command>`` if there is none."""
    c = calls.filter(F.col("tool_name") == "Bash").withColumn("cmd", F.get_json_object("input_json", "$.command")).filter("cmd is not null")
    found = F.arrays_zip(F.regexp_extract_all("cmd", F.lit(FILES), F.lit(1)).alias("name"), F.regexp_extract_all("cmd", F.lit(FILES), F.lit(2)).alias("args"))
    c = c.withColumn("f", F.explode(found)).select(*c.columns, F.col("f.name").alias("name"), F.trim("f.args").alias("args"))
    paths = F.filter(F.split("args", r"(?U)\s+"), lambda a: (F.length(a) > 0) & ~a.startswith("-"))
    c = c.withColumn("p", F.explode_outer(paths))
    path = F.coalesce("p", F.concat(F.lit("<"), "name", F.lit(">")))
    key = F.when(F.col("p").isNull(), F.col("tool_use_id")).otherwise(F.concat_ws(":", "tool_use_id", F.lit("bash"), "name", "p"))
    return _op(c, path, F.concat(F.lit("bash_"), "name"), None, None, F.col("cmd"), key)


def file_operations(tool_executions: DataFrame, messages: DataFrame, parts: int | None = None) -> DataFrame:
    """All of them by one join: a call has the operations of its tool."""
    calls = _calls(tool_executions, messages, "Write", "Edit", "Read", "Bash", parts=parts)
    none = F.lit(None).cast("string")

    def given(name: str):
        return F.get_json_object("input_json", f"$.{name}")

    def op(path, kind, content, old, command, key):
        names = ("file_path", "operation_type", "content", "old_content", "command", "key")
        return F.struct(*[c.alias(n) for c, n in zip((path, kind, content, old, command, key), names)])

    own = F.col("tool_use_id")
    made = {
        "Write": op(given("file_path"), F.lit("write"), given("content"), none, none, own),
        "Edit": op(given("file_path"), F.lit("edit"), given("new_string"), given("old_string"), none, own),
        "Read": op(given("file_path"), F.lit("read"), none, none, none, own),
    }
    cmd = given("command")
    found = F.arrays_zip(F.regexp_extract_all(cmd, F.lit(FILES), F.lit(1)).alias("name"), F.regexp_extract_all(cmd, F.lit(FILES), F.lit(2)).alias("args"))

    def shell(f):
        paths = F.filter(F.split(F.trim(f["args"]), r"(?U)\s+"), lambda a: (F.length(a) > 0) & ~a.startswith("-"))
        paths = F.when(F.size(paths) > 0, paths).otherwise(F.array(none))
        key = lambda p: F.when(p.isNull(), own).otherwise(F.concat_ws(":", own, F.lit("bash"), f["name"], p))
        return F.transform(paths, lambda p: op(F.coalesce(p, F.concat(F.lit("<"), f["name"], F.lit(">"))), F.concat(F.lit("bash_"), f["name"]), none, none, cmd, key(p)))

    all_ops = F.when(F.col("tool_name") == "Bash", F.flatten(F.transform(found, shell)))
    for tool, one in made.items():
        all_ops = F.when((F.col("tool_name") == tool) & one["file_path"].isNotNull(), F.array(one)).otherwise(all_ops)
    ops = calls.select("session_id", "timestamp", "message_uuid", F.explode(all_ops).alias("o"))
    ops = ops.select("session_id", "o.file_path", "o.operation_type", "timestamp", "o.content", "o.old_content", "o.command", F.col("o.key").alias("tool_use_id"), "message_uuid")
    return upsert_first(_dealt(ops, parts, "tool_use_id"), ["tool_use_id"], ["timestamp", "message_uuid", "file_path"])


def git_operations(tool_executions: DataFrame, messages: DataFrame, parts: int | None = None) -> DataFrame:
    c = _calls(tool_executions, messages, "Bash", parts=parts).withColumn("command", F.get_json_object("input_json", "$.command")).filter("command is not null")
    c = c.withColumn("operation_type", F.explode(F.array_distinct(F.regexp_extract_all("command", F.lit(GIT), F.lit(1)))))
    found = F.coalesce(*[F.nullif(F.trim(F.regexp_extract("command", p, 1)) if p is HEREDOC else F.regexp_extract("command", p, 1), F.lit("")) for p in (HEREDOC, INLINE)])
    ops = c.select(
        "session_id",
        "operation_type",
        "command",
        F.when(F.col("operation_type") == "commit", found).alias("commit_message"),
        F.nullif(F.regexp_extract("command", BRANCH, 1), F.lit("")).alias("branch"),
        "tool_use_id",
        "message_uuid",
        "timestamp",
    )
    return upsert_first(_dealt(ops, parts, "tool_use_id"), ["tool_use_id", "operation_type"], ["timestamp", "message_uuid"])


def enrich(ops: DataFrame, tool_executions: DataFrame, parts: int | None = None) -> DataFrame:
    """Adds result_summary (500 characters) and is_error of the tool call that an operation came from."""
    told = _dealt(tool_executions.select(F.col("tool_use_id").alias("__id"), F.substring("result_content", 1, 500).alias("said"), "is_error"), parts, "__id")
    r = told.groupBy("__id").agg(F.max("said").alias("result_summary"), F.max("is_error").alias("is_error"))
    joined = _dealt(ops.withColumn("__id", F.element_at(F.split("tool_use_id", ":bash:"), 1)), parts, "__id").join(r, "__id", "left").drop("__id")
    return joined.withColumn("is_error", F.coalesce("is_error", F.lit(False)))


def files(ops: DataFrame) -> DataFrame:
    return (
        ops.filter(~F.col("file_path").rlike(r"^<\w+>$"))
        .groupBy("session_id", "file_path")
        .agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_modified"), F.count_if(F.col("operation_type") != "read").alias("operation_count"))
    )


def mine_artifacts(tool_executions: DataFrame, messages: DataFrame, parts: int | None = None) -> dict[str, DataFrame]:
    """All artifact tables from stored tool rows; ``parts``: into how many rows are dealt by a key, left to Spark if it isn't said."""
    ops = enrich(file_operations(tool_executions, messages, parts), tool_executions, parts)
    return {"file_operations": ops, "git_operations": enrich(git_operations(tool_executions, messages, parts), tool_executions, parts), "files": files(ops)}
