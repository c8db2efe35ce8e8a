"""From raw lines to tidy tables.

``bronze`` is (path, off, line): one JSON record a line, with its byte offset.  Which record
comes first is decided by (path, off) alone, never by partition order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.columns import json_type, session_id_from_path, upsert_first, upsert_last
from ..functions.ship import ship

# The record types, their fields, and what a line of each type must have.
LINE = (
    "type string, uuid string, timestamp string, sessionId string, version string, cwd string, parentUuid string, isSidechain boolean, userType string, "
    "gitBranch string, slug string, agentId string, teamName string, isMeta boolean, entrypoint string, message string, requestId string, data string, subtype string, "
    "level string, durationMs bigint, hookCount int, content string, operation string, summary string, leafUuid string, messageId string, snapshot string, attachment string"
)
BASE = ["uuid", "timestamp", "sessionId", "version", "cwd"]
REQUIRED = {
    "user": [*BASE, "message"],
    "assistant": [*BASE, "message"],
    "progress": [*BASE, "data"],
    "system": [*BASE, "subtype"],
    "queue-operation": ["operation", "timestamp", "sessionId"],
    "summary": ["summary", "leafUuid"],
    "file-history-snapshot": ["messageId", "snapshot"],
    "attachment": ["uuid", "timestamp", "sessionId", "attachment"],
}
BASED = ("user", "assistant", "progress", "system")
BASE_KEYS = [*BASE, "type", "parentUuid", "isSidechain", "userType", "gitBranch", "slug", "agentId", "teamName", "isMeta"]
KEYS = {
    "user": [*BASE_KEYS, "message", "sourceToolAssistantUUID", "toolUseResult", "thinkingMetadata", "todos", "permissionMode"],
    "assistant": [*BASE_KEYS, "message", "requestId", "isApiErrorMessage", "error"],
    "assistant.message": ["id", "model", "content", "role", "stop_reason", "stop_sequence", "usage", "type"],
    "assistant.message.usage": ["input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "cache_creation", "service_tier"],
    "progress": [*BASE_KEYS, "data"],
    "system": [*BASE_KEYS, "subtype", "level", "durationMs", "hookCount", "content"],
    "queue-operation": ["type", "operation", "timestamp", "sessionId", "content"],
    "summary": ["type", "summary", "leafUuid"],
    "file-history-snapshot": ["type", "messageId", "snapshot", "isSnapshotUpdate"],
    "attachment": ["type", "uuid", "timestamp", "sessionId", "version", "cwd", "parentUuid", "isSidechain", "userType", "gitBranch", "slug", "entrypoint", "attachment"],
}
SUBTYPE_KEYS = {
    "hook_success": ["hookName", "toolUseID", "hookEvent", "content", "stdout", "stderr", "exitCode", "command", "durationMs"],
    "hook_permission_decision": ["decision", "toolUseID", "hookEvent"],
    "mcp_instructions_delta": ["addedNames", "addedBlocks"],
    "skill_listing": ["content"],
    "edited_text_file": ["filename", "snippet"],
    "task_reminder": ["content", "itemCount"],
    "todo_reminder": ["content", "itemCount"],
    "deferred_tools_delta": ["addedNames"],
    "plan_mode": ["planFilePath", "planExists", "reminderType", "isSubAgent"],
    "plan_mode_exit": ["planFilePath", "planExists"],
    "plan_mode_reentry": ["planFilePath", "planExists", "reminderType", "isSubAgent"],
    "nested_memory": ["path", "content"],
}
USAGE = "input_tokens bigint, output_tokens bigint, cache_creation_input_tokens bigint, cache_read_input_tokens bigint, cache_creation string, service_tier string"
MESSAGE = "id string, role string, model string, stop_reason string, content string, usage string"
BLOCKS = "array<struct<type:string,text:string,thinking:string,signature:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"


@F.pandas_udf(StringType())
def _json_error(lines: pd.Series) -> pd.Series:
    """What a JSON parser says against each line."""
    import json

    def say(line: str | None) -> str | None:
        try:
            json.loads(line)
        except (ValueError, TypeError, RecursionError) as e:
            return str(e)
        return "not JSON in Spark's sense"

    return lines.map(say)


def numbered(rejected: DataFrame, bronze: DataFrame, chunk: int = 64 << 20) -> DataFrame:
    """``rejected`` with ``line_number``: how many lines of its file stand before it.  Files are counted by chunks of bytes."""
    part = F.floor(F.col("off") / chunk)
    lines = bronze.join(rejected.select("path").distinct(), "path", "left_semi").select("path", "off", part.alias("part")).distinct()
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy("path", "part").agg(F.count("*").alias("n")).select("path", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = lines.withColumn("own", F.row_number().over(Window.partitionBy("path", "part").orderBy("off")) - 1)
    at = own.join(counts, ["path", "part"]).select("path", "off", (F.col("own") + F.col("before")).cast("long").alias("line_number"))
    return rejected.join(at, ["path", "off"], "left")


def parse(bronze: DataFrame) -> DataFrame:
    """Each line with its fields, its type and ``error``: null if the line is a good record, ``malformed line`` if it is no JSON."""
    r = F.from_json("line", LINE + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    # made as rows, for a filter on fields that are columns would parse the line again for each field that it looks at
    df = bronze.filter(F.length(F.trim("line")) > 0).select(*bronze.columns, F.inline(F.array(r)))
    missing = F.lit(None).cast("string")
    for kind, fields in REQUIRED.items():
        first = F.coalesce(*[F.when(F.col(f).isNull(), F.lit(f"missing field {f}")) for f in fields])
        missing = F.when(F.col("type") == kind, first).otherwise(missing)
    kinds = {"isSidechain": "BOOLEAN", "isMeta": "BOOLEAN", "durationMs": "BIGINT", "hookCount": "BIGINT"}
    v = F.try_parse_json("line")
    wrong = F.coalesce(*[F.when(~json_type(v, f"$.{f}").isin(k, "VOID"), F.lit(f"field {f} is not {k}")) for f, k in kinds.items()], F.lit("a field is of another kind"))
    bad = F.when(F.col("_corrupt").isNotNull(), F.when(v.isNull(), F.lit(MALFORMED)).otherwise(wrong))
    error = F.when(F.col("_corrupt").isNotNull(), bad).when(F.col("type").isNull(), F.lit("missing type")).otherwise(missing)
    return df.withColumn("error", error).drop("_corrupt")


MALFORMED = "malformed line"


def quarantine(bronze: DataFrame, preview: int = 500) -> tuple[DataFrame, DataFrame]:
    """The good records, and (path, off, error, preview) of the lines that are not: the parser's own message, or the field that is missing or wrong."""
    return sorted_out(parse(bronze), preview)


def sorted_out(parsed: DataFrame, preview: int = 500) -> tuple[DataFrame, DataFrame]:
    """``quarantine`` of lines that were parsed before."""
    ship(parsed.sparkSession)
    bad = parsed.filter(F.col("error").isNotNull())
    # only rejected lines go through Python, for its parser's message: in ``parse`` the call would see every line, whatever branch it is in
    error = F.when(F.col("error") == MALFORMED, F.concat("error", F.lit(": "), _json_error("line"))).otherwise(F.col("error"))
    bad = bad.select("path", "off", error.alias("error"), F.substring("line", 1, preview).alias("preview"))
    return parsed.filter(F.col("error").isNull()).drop("error"), bad


def dispatch(records: DataFrame) -> dict[str, DataFrame]:
    """Records by type; ``unknown`` holds the rest, raw."""
    out = {k: records.filter(F.col("type") == k) for k in REQUIRED}
    out["unknown"] = records.filter(~F.col("type").isin(*REQUIRED)).select("path", "off", "type", "version", F.col("line").alias("raw"))
    return out


def _all_known(json: Column, keys: Column) -> Column:
    """True if ``json`` is an object of ``keys`` alone: most are, and to look at its keys costs far less than to take it apart."""
    return F.coalesce(F.size(F.array_except(F.json_object_keys(json), keys)) == 0, F.lit(False))


def overflow(df: DataFrame, json: Column, known: Column | list[str]) -> DataFrame:
    """``df`` with one row for each key of ``json`` that is not modelled: field, value (as JSON)."""
    pairs = F.map_entries(F.from_json(json, "map<string,variant>"))
    keys = F.array(*[F.lit(k) for k in known]) if isinstance(known, list) else known
    return df.filter(~_all_known(json, keys)).withColumn("__p", F.explode(pairs)).select(*df.columns, F.col("__p.key").alias("field"), F.to_json(F.col("__p.value")).alias("value")).filter(~F.array_contains(keys, F.col("field")))


def quoted(text: Column) -> Column:
    """Text as a JSON string."""
    j = F.to_json(F.array(text))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def unmodelled(json: Column, known: list[str]) -> Column:
    """The keys of ``json`` that are not modelled, with their values as JSON: (field, value) in an array; null if it is no object."""
    pairs = F.filter(F.map_entries(F.from_json(json, "map<string,variant>")), lambda p: ~p["key"].isin(*known))
    none = F.array().cast("array<struct<field:string,value:string>>")
    return F.when(_all_known(json, F.array(*[F.lit(k) for k in known])), none).otherwise(F.transform(pairs, lambda p: F.struct(p["key"].alias("field"), F.to_json(p["value"]).alias("value"))))


def object_of(parts: Column) -> Column:
    """(field, value) of an array as one JSON object, fields in order; null if there is none."""
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(parts), lambda p: F.concat(quoted(p["field"]), F.lit(":"), p["value"])), ","), F.lit("}"))
    return F.when(F.size(parts) > 0, text)


def as_object(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fields and values put together as one JSON object in ``extra_json``, fields in order."""
    parts = F.array_sort(F.collect_list(F.struct("field", "value")))
    text = F.concat(F.lit("{"), F.array_join(F.transform(parts, lambda p: F.concat(quoted(p["field"]), F.lit(":"), p["value"])), ","), F.lit("}"))
    return df.groupBy(*keys).agg(text.alias("extra_json"))


# Projects and agents are of several sessions: their parts can be merged, as those of any shares of the records.
PROJECT_PARTS = "project_path string, first_seen_at string, last_seen_at string"
AGENT_PARTS = "agent_id string, first struct<path:string,off:bigint,session_id:string,timestamp:string>, last_seen_at string"


def project_parts(records: DataFrame) -> DataFrame:
    seen = records.filter(F.col("type").isin(*BASED, "attachment") & (F.length("cwd") > 0))
    return merge_projects(seen.select(F.col("cwd").alias("project_path"), F.col("timestamp").alias("first_seen_at"), F.col("timestamp").alias("last_seen_at")))


def merge_projects(parts: DataFrame) -> DataFrame:
    return parts.groupBy("project_path").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))


def projects_of(parts: DataFrame, sessions: DataFrame) -> DataFrame:
    held = sessions.groupBy("project_path").agg(F.count("*").alias("session_count"))
    return parts.join(held, "project_path", "left").select(
        "project_path", F.element_at(F.split("project_path", "/"), -1).alias("display_name"), "first_seen_at", "last_seen_at", F.coalesce("session_count", F.lit(0)).cast("long").alias("session_count")
    )


def agent_parts(records: DataFrame) -> DataFrame:
    r = records.filter(F.col("type").isin("user", "assistant", "system") & F.col("agentId").isNotNull())
    return merge_agents(r.select(F.col("agentId").alias("agent_id"), F.struct("path", "off", F.col("sessionId").alias("session_id"), "timestamp").alias("first"), F.col("timestamp").alias("last_seen_at")))


def merge_agents(parts: DataFrame) -> DataFrame:
    return parts.groupBy("agent_id").agg(F.min_by("first", F.struct("first.path", "first.off")).alias("first"), F.max("last_seen_at").alias("last_seen_at"))


def agents_of(parts: DataFrame) -> DataFrame:
    return parts.select("agent_id", "first.session_id", F.col("first.timestamp").alias("first_seen_at"), "last_seen_at")


def table(build: Callable) -> cached_property:
    """A table of ``Tables``: stored by its ``keep``, if it has one."""

    def get(self):
        df = build(self)
        return self.keep(build.__name__, df) if self.keep else df

    get.__doc__ = build.__doc__
    return cached_property(get)


def stored_under(root: str) -> Callable[[str, DataFrame], DataFrame]:
    """A ``keep`` that writes each table as Parquet below ``root``."""

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}")

    return keep


def _said(spoken: DataFrame, *along: str) -> DataFrame:
    """What a message has of its record, each with its place."""
    assistant = F.col("type") == "assistant"
    return spoken.select(
        "uuid",
        F.col("sessionId").alias("session_id"),
        "type",
        "timestamp",
        F.col("parentUuid").alias("parent_uuid"),
        F.coalesce("isSidechain", F.lit(False)).alias("is_sidechain"),
        F.col("userType").alias("user_type"),
        "cwd",
        F.col("gitBranch").alias("git_branch"),
        "version",
        "slug",
        F.col("agentId").alias("agent_id"),
        F.col("isMeta").alias("is_meta"),
        F.when(assistant, F.col("m.model")).alias("model"),
        F.when(assistant, F.col("m.stop_reason")).alias("stop_reason"),
        F.when(assistant, F.col("requestId")).alias("request_id"),
        "path",
        "off",
        *along,
    )


def _promoted(users: DataFrame, *along: str) -> DataFrame:
    """uuid, path, off, ``along`` and the promoted fields of each user record."""
    found = users.select("uuid", "path", "off", *along, F.try_parse_json("line").alias("v"), unmodelled(F.col("line"), KEYS["user"]).alias("rest"))
    plan = F.when(json_type(F.col("v"), "$.planContent") == "STRING", F.try_variant_get("v", "$.planContent", "string"))
    found = found.select(
        "uuid",
        "path",
        "off",
        *along,
        F.when(json_type(F.col("v"), "$.isCompactSummary") == "BOOLEAN", F.try_variant_get("v", "$.isCompactSummary", "boolean")).alias("is_compact_summary"),
        F.try_variant_get("v", "$.sourceToolUseID", "string").alias("source_tool_use_id"),
        plan.alias("plan_content"),
        "rest",
    )
    kept = F.filter("rest", lambda p: ~p["field"].isin("isCompactSummary", "sourceToolUseID") & ~((p["field"] == "planContent") & F.col("plan_content").isNotNull()))
    return found.withColumn("rest", kept).withColumn("extra_json", object_of(F.col("rest"))).drop("rest")


def _assistant_extra(assistants: DataFrame, *along: str) -> DataFrame:
    """uuid, path, off, ``along`` and extra_json of each assistant record."""
    r = assistants.select("uuid", "path", "off", *along, unmodelled(F.col("line"), KEYS["assistant"]).alias("a"), unmodelled(F.col("message"), KEYS["assistant.message"]).alias("b"))
    own, over = F.coalesce("a", F.array().cast(r.schema["a"].dataType)), F.coalesce("b", F.array().cast(r.schema["b"].dataType))
    r = r.select("uuid", "path", "off", *along, own.alias("a"), over.alias("b"), F.transform(over, lambda p: p["field"]).alias("names"))
    r = r.select("uuid", "path", "off", *along, F.concat(F.filter("a", lambda p: ~F.array_contains("names", p["field"])), "b").alias("parts"))
    return r.select("uuid", "path", "off", *along, object_of(F.col("parts")).alias("extra_json"))


#: Records whose rows one task sorts.
RECORDS_IN_PART = 50_000


@dataclass
class Tables:
    """All tables made from one bronze DataFrame; each is built when it is first asked for.

    With ``keep`` (name, DataFrame) -> DataFrame each is stored then and read by those made from it, so that every line is
    parsed once and every table is one job; without it they are plans.

    With ``again``, the uuids (uuid) of more than one user or assistant record, only the records of these are dealt by their uuid; of the others each is
    the first and the last, and what is made of it stays where it is read.  ``carried`` are columns of the records that go along into the tables of
    messages and their blocks.
    """

    bronze: DataFrame | None
    keep: Callable[[str, DataFrame], DataFrame] | None = None
    parsed: DataFrame | None = None  # records that were parsed before, instead of bronze
    again: DataFrame | None = None
    carried: tuple[str, ...] = ()

    @cached_property
    def parts(self) -> int | None:
        """Into how many parts rows are dealt by a key: by the number of records, where they are stored, for records compress so well that parts of so
        many bytes of shuffle are too large to be sorted in memory."""
        if self.keep is None:
            return None
        spark = self.records.sparkSession
        return max(spark.sparkContext.defaultParallelism, -(-self.records.count() // RECORDS_IN_PART))

    def dealt(self, rows: DataFrame, *keys: str) -> DataFrame:
        return rows if self.parts is None else rows.repartition(self.parts, *keys)

    @table
    def records(self) -> DataFrame:
        return quarantine(self.bronze)[0] if self.parsed is None else self.parsed

    @table
    def rejected(self) -> DataFrame:
        return numbered(quarantine(self.bronze)[1], self.bronze)

    def of(self, *types: str) -> DataFrame:
        return self.records.filter(F.col("type").isin(*types))

    @table
    def sessions(self) -> DataFrame:
        """First record of a session wins; last_seen_at is the latest timestamp."""
        r = self.of(*BASED, "attachment").select("sessionId", "timestamp", "cwd", "version", "slug", "gitBranch", F.struct("path", "off").alias("at"))
        first = F.min_by(F.struct("cwd", "timestamp", "version", "slug", "gitBranch"), "at")
        return (
            r.groupBy(F.col("sessionId").alias("session_id"))
            .agg(first.alias("f"), F.max("timestamp").alias("last_seen_at"))
            .select(
                "session_id", F.col("f.cwd").alias("project_path"), F.col("f.timestamp").alias("first_seen_at"), "last_seen_at", F.col("f.version").alias("version"), F.col("f.slug").alias("slug"), F.col("f.gitBranch").alias("git_branch")
            )
        )

    @table
    def projects(self) -> DataFrame:
        return projects_of(project_parts(self.records), self.sessions)

    @table
    def agents(self) -> DataFrame:
        return agents_of(agent_parts(self.records))

    def _back(self, rows: DataFrame) -> DataFrame:
        """Rows that were dealt by their uuid, together as those are that were not."""
        return rows.repartition(*self.carried) if self.carried else rows

    @cached_property
    def spoken(self) -> DataFrame:
        """User and assistant records with their message's fields; the first of each uuid, if it is known which have several."""
        r = self.of("user", "assistant")
        if self.again is not None:
            several = upsert_first(r.join(self.again, "uuid", "left_semi").repartition("uuid"), ["uuid"], ["path", "off"])
            r = r.join(self.again, "uuid", "left_anti").unionByName(self._back(several))
        return r.withColumn("m", F.from_json("message", MESSAGE))

    def _first(self, rows: DataFrame) -> DataFrame:
        """Of rows of ``spoken`` the first of each uuid."""
        return rows if self.again is not None else upsert_first(self.dealt(rows, "uuid"), ["uuid"], ["path", "off"])

    @table
    def messages(self) -> DataFrame:
        """First record of a uuid wins; the fields that the last one promotes are joined to it."""
        if self.again is None:
            first = upsert_first(self.dealt(_said(self.spoken), "uuid"), ["uuid"], ["path", "off"])
            extra = self.promoted.unionByName(self.assistant_extra, allowMissingColumns=True)
            rows = first.join(self.dealt(extra, "uuid"), "uuid", "left")
        else:
            r = self.of("user", "assistant").withColumn("m", F.from_json("message", MESSAGE))
            alone, several = (r.join(self.again, "uuid", how) for how in ("left_anti", "left_semi"))
            own = _said(alone, "line", "message", *self.carried)
            names = [c for c in own.columns if c not in ("uuid", "path", "off", "line", "message")]
            of = {k: own.filter(F.col("type") == k) for k in ("user", "assistant")}
            alone = _promoted(of["user"], *names).unionByName(_assistant_extra(of["assistant"], *names), allowMissingColumns=True)
            first = upsert_first(_said(several, *self.carried).repartition("uuid"), ["uuid"], ["path", "off"])
            of = {k: several.filter(F.col("type") == k).drop("m") for k in ("user", "assistant")}
            user, assistant = (upsert_last(f(of[k]).repartition("uuid"), ["uuid"], ["path", "off"]).drop("path", "off") for k, f in (("user", _promoted), ("assistant", _assistant_extra)))
            extra = user.unionByName(assistant.filter("extra_json is not null"), allowMissingColumns=True)
            rows = self._back(first.join(extra, "uuid", "left")).unionByName(alone)
        return rows.withColumn("is_compact_summary", F.coalesce("is_compact_summary", F.lit(False)))

    @table
    def promoted(self) -> DataFrame:
        """uuid, is_compact_summary, source_tool_use_id, plan_content, extra_json of user records; the last record wins."""
        # taken out of the lines where they are read: lines are neither exchanged nor sorted
        return upsert_last(self.dealt(_promoted(self.of("user")), "uuid"), ["uuid"], ["path", "off"]).drop("path", "off")

    @table
    def assistant_extra(self) -> DataFrame:
        """uuid, extra_json of assistant records: record-level overflow with message-level overflow over it."""
        r = _assistant_extra(self.of("assistant"))
        return upsert_last(self.dealt(r, "uuid"), ["uuid"], ["path", "off"]).select("uuid", "extra_json").filter("extra_json is not null")

    @table
    def message_content(self) -> DataFrame:
        """One row a block; text content is one block, and what a plan says is block -1."""
        # made as rows, so that a filter on its kind doesn't parse the message again
        said = F.struct(F.col("m.content").alias("c"), json_type(F.try_parse_json("message"), "$.content").alias("kind"))
        r = self._first(self.spoken.select("uuid", "path", "off", *self.carried, F.inline(F.array(said))))
        # text is one block of an array, so that records are dealt once
        text = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("c").alias("text"))))
        r = r.filter((F.col("kind") == "STRING") | F.col("kind").startswith("ARRAY"))
        b = r.select("uuid", *self.carried, F.posexplode(F.from_json(F.when(F.col("kind") == "STRING", text).otherwise(F.col("c")), BLOCKS)).alias("i", "b"))
        kind, of = F.col("b.type"), {"text": "b.text", "thinking": "b.thinking", "tool_result": "b.content"}
        held = F.lit(None).cast("string")
        for k, c in of.items():
            held = F.when(kind == k, F.col(c)).otherwise(held)
        return b.select(
            F.col("uuid").alias("message_uuid"),
            F.col("i").cast("long").alias("block_index"),
            kind.alias("block_type"),
            held.alias("text_content"),
            F.when(kind == "tool_use", F.col("b.id")).when(kind == "tool_result", F.col("b.tool_use_id")).alias("tool_use_id"),
            F.when(kind == "tool_use", F.col("b.name")).alias("tool_name"),
            F.when(kind == "tool_use", F.col("b.input")).alias("tool_input"),
            F.when(kind == "tool_result", F.coalesce("b.is_error", F.lit(False))).alias("is_error"),
            F.when(kind == "thinking", F.col("b.signature")).alias("thinking_signature"),
            *self.carried,
        )

    @table
    def plan_blocks(self) -> DataFrame:
        r = self.promoted if self.again is None else self.messages  # which hold the promoted fields
        return r.filter(F.col("plan_content").isNotNull()).select(
            F.col("uuid").alias("message_uuid"), F.lit(-1).cast("long").alias("block_index"), F.lit("plan_content").alias("block_type"), F.col("plan_content").alias("text_content"), *self.carried
        )

    @table
    def searchable(self) -> DataFrame:
        """Content blocks and plan blocks."""
        return self.message_content.unionByName(self.plan_blocks, allowMissingColumns=True)

    @table
    def token_usage(self) -> DataFrame:
        def used(records: DataFrame) -> DataFrame:
            usage = F.struct(F.from_json("message", MESSAGE)["usage"].alias("usage"))
            return records.select("uuid", "path", "off", *self.carried, F.inline(F.array(usage))).filter("usage is not null")

        r = self.of("assistant")
        if self.again is None:
            r = upsert_first(self.dealt(used(r), "uuid"), ["uuid"], ["path", "off"])
        else:
            several = upsert_first(used(r.join(self.again, "uuid", "left_semi")).repartition("uuid"), ["uuid"], ["path", "off"])
            r = self._back(several).unionByName(used(r.join(self.again, "uuid", "left_anti")))
        r = r.select("uuid", *self.carried, F.from_json("usage", USAGE).alias("t"), object_of(unmodelled(F.col("usage"), KEYS["assistant.message.usage"])).alias("extra_json"))
        return r.select(
            F.col("uuid").alias("message_uuid"), "t.input_tokens", "t.output_tokens", "t.cache_creation_input_tokens", "t.cache_read_input_tokens", "t.service_tier", F.col("t.cache_creation").alias("cache_creation_json"), "extra_json", *self.carried
        )

    @table
    def tool_executions(self) -> DataFrame:
        """Tool uses with the last result of their id, whichever order they came in."""
        b = self.message_content
        order = self.of("user", "assistant").select(F.col("uuid").alias("message_uuid"), F.struct("path", "off").alias("at"))
        results = (
            self.dealt(
                self.dealt(b.filter((F.col("block_type") == "tool_result") & F.col("tool_use_id").isNotNull()).select("message_uuid", "block_index", "tool_use_id", "text_content", "is_error"), "message_uuid").join(
                    self.dealt(order, "message_uuid"), "message_uuid"
                ),
                "tool_use_id",
            )
            .groupBy("tool_use_id")
            .agg(F.max_by(F.struct(F.col("text_content").alias("result_content"), "is_error"), F.struct("at", "block_index")).alias("r"))
            .select("tool_use_id", "r.result_content", "r.is_error")
        )
        uses = b.filter(F.col("block_type") == "tool_use").select("message_uuid", "tool_use_id", "tool_name", F.col("tool_input").alias("input_json"), "block_index", *self.carried)
        uses = upsert_first(self.dealt(uses, "tool_use_id"), ["message_uuid", "tool_use_id"], ["block_index"]).drop("block_index")
        return uses.join(results, "tool_use_id", "left").select("message_uuid", "tool_use_id", "tool_name", "input_json", "result_content", "is_error", *self.carried)

    @table
    def system_events(self) -> DataFrame:
        r = upsert_first(self.of("system"), ["uuid"], ["path", "off"])
        rest = overflow(r.select("uuid", "line"), F.col("line"), KEYS["system"])
        hooks = r.filter(F.col("hookCount").isNotNull()).select("uuid", F.lit("").alias("line"), F.lit("hookCount").alias("field"), F.col("hookCount").cast("string").alias("value"))
        extra = as_object(rest.unionByName(hooks), ["uuid"])
        return r.join(extra, "uuid", "left").select("uuid", F.col("sessionId").alias("session_id"), "timestamp", "subtype", "level", F.col("durationMs").alias("duration_ms"), "content", "extra_json")

    @table
    def summaries(self) -> DataFrame:
        return self.of("summary").select(session_id_from_path(F.col("path")).alias("session_id"), "summary", F.col("leafUuid").alias("leaf_uuid")).distinct()

    @table
    def attachments(self) -> DataFrame:
        """The envelope, the inner type, and the body as JSON without its type; unknown subtypes keep the raw body."""
        r = upsert_first(self.of("attachment"), ["uuid"], ["path", "off"]).withColumn("inner_type", F.get_json_object("attachment", "$.type"))
        body = overflow(r.select("uuid", "attachment"), F.col("attachment"), ["type"])
        body = as_object(body, ["uuid"]).withColumnRenamed("extra_json", "body")
        known = F.col("inner_type").isin(*SUBTYPE_KEYS)
        return r.join(body, "uuid", "left").select(
            "uuid",
            F.col("sessionId").alias("session_id"),
            "timestamp",
            "version",
            "cwd",
            F.col("gitBranch").alias("git_branch"),
            "slug",
            F.col("parentUuid").alias("parent_uuid"),
            "entrypoint",
            "inner_type",
            F.when(known, F.coalesce("body", F.lit("{}"))).otherwise(F.col("attachment")).alias("body_json"),
        )

    @table
    def hook_executions(self) -> DataFrame:
        body = "hookName string, hookEvent string, toolUseID string, exitCode bigint, durationMs bigint, stdout string, stderr string, command string, decision string"
        a = self.attachments.filter(F.col("inner_type").isin("hook_success", "hook_permission_decision")).withColumn("b", F.from_json("body_json", body))
        success = F.col("inner_type") == "hook_success"

        def only(c: str, name: str) -> Column:
            return F.when(success, F.col(f"b.{c}")).alias(name)

        return a.select(
            F.col("uuid").alias("attachment_uuid"),
            only("hookName", "hook_name"),
            F.col("b.hookEvent").alias("hook_event"),
            F.col("b.toolUseID").alias("tool_use_id"),
            only("exitCode", "exit_code"),
            only("durationMs", "duration_ms"),
            only("stdout", "stdout"),
            only("stderr", "stderr"),
            only("command", "command"),
            F.when(~success, F.col("b.decision")).alias("decision"),
            "timestamp",
        ).dropDuplicates(["attachment_uuid", "hook_event", "tool_use_id"])

    @table
    def file_operations(self) -> DataFrame:
        from .artifacts import enrich, file_operations

        return enrich(file_operations(self.tool_executions, self.messages, self.parts), self.tool_executions, self.parts)

    @table
    def git_operations(self) -> DataFrame:
        from .artifacts import enrich, git_operations

        return enrich(git_operations(self.tool_executions, self.messages, self.parts), self.tool_executions, self.parts)

    @table
    def files(self) -> DataFrame:
        from .artifacts import files

        return files(self.file_operations)

    @table
    def schema_drift(self) -> DataFrame:
        from .drift import schema_drift

        return schema_drift(self.records)

    @table
    def record_type_drift(self) -> DataFrame:
        from .drift import record_type_drift

        return record_type_drift(self.records)
