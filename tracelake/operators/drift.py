"""Schema drift: fields, record types and versions that the model doesn't know."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cut, has_text, newest
from .decompose import KEYS, REQUIRED, SUBTYPE_KEYS, overflow

SAMPLE = 500
# The table each record type's fields may have been promoted to, and that table's columns.
TABLE_OF = {"user": "messages", "assistant": "messages", "assistant.message": "messages", "progress": "messages", "assistant.message.usage": "token_usage", "system": "system_events", "summary": "summaries"}
COLUMNS_OF = {
    "messages": "uuid session_id type timestamp parent_uuid is_sidechain user_type cwd git_branch version slug agent_id is_meta model stop_reason request_id subtype is_compact_summary source_tool_use_id extra_json plan_content".split(),
    "token_usage": "message_uuid input_tokens output_tokens cache_creation_input_tokens cache_read_input_tokens service_tier cache_creation_json extra_json".split(),
    "system_events": "id uuid session_id timestamp subtype level duration_ms content extra_json".split(),
    "summaries": "id session_id summary leaf_uuid".split(),
}
UNVERSIONED = ("queue-operation", "summary", "file-history-snapshot")


def observations(records: DataFrame) -> DataFrame:
    """One row for each unmodelled field of each record: field, value, record_type, version, timestamp, path, off."""
    base = records.select("path", "off", "type", "timestamp", "version", "line", "message", "attachment")
    keys = F.create_map(*[x for k in REQUIRED for x in (F.lit(k), F.array(*[F.lit(f) for f in KEYS[k]]))])
    levels = [base.filter(F.col("type").isin(*REQUIRED)).select("path", "off", "timestamp", F.when(F.col("type").isin(*UNVERSIONED), F.lit("unknown")).otherwise(F.col("version")).alias("version"), F.col("type").alias("record_type"), F.col("line").alias("j"), keys[F.col("type")].alias("k"))]

    def level(rows: DataFrame, name, j, known: list[str] | None = None, k=None) -> None:
        levels.append(rows.select("path", "off", "timestamp", "version", name.alias("record_type"), j.alias("j"), (k if known is None else F.array(*[F.lit(x) for x in known])).alias("k")))

    a = base.filter(F.col("type") == "assistant")
    level(a, F.lit("assistant.message"), F.col("message"), KEYS["assistant.message"])
    level(a, F.lit("assistant.message.usage"), F.get_json_object("message", "$.usage"), KEYS["assistant.message.usage"])
    inner = F.get_json_object("attachment", "$.type")
    of = F.create_map(*[x for k, v in SUBTYPE_KEYS.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in ["type", *v]]))])
    level(base.filter((F.col("type") == "attachment") & inner.isin(*SUBTYPE_KEYS)), F.concat(F.lit("attachment."), inner), F.col("attachment"), k=of[inner])
    rows = levels[0]
    for x in levels[1:]:
        rows = rows.unionByName(x)
    return overflow(rows.filter(F.col("j").isNotNull()), F.col("j"), F.col("k")).drop("j", "k")


# ``..._parts`` are aggregates that can be merged: those of all records are the merged ones of any shares of them.
DRIFT_PARTS = "field string, record_type string, version string, occurrence_count bigint, first_seen_at string, last_seen_at string, sample struct<path:string,off:bigint,value:string>"
TYPE_PARTS = "type_name string, version string, occurrence_count bigint, first_seen_at string, last_seen_at string, sample struct<path:string,off:bigint,value:string>"


def _sample(value: str):
    """A value with the place that decides which is shown."""
    return F.struct("path", "off", cut(F.col(value), SAMPLE, "...").alias("value")).alias("sample")


def drift_parts(records: DataFrame) -> DataFrame:
    one = observations(records).select("field", "record_type", "version", F.lit(1).cast("long").alias("occurrence_count"), F.col("timestamp").alias("first_seen_at"), F.col("timestamp").alias("last_seen_at"), _sample("value"))
    return merge_drift(one)


def _merged(parts: DataFrame, keys: list[str], sample) -> DataFrame:
    place = F.struct("sample.path", "sample.off")
    return parts.groupBy(*keys).agg(F.sum("occurrence_count").alias("occurrence_count"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), sample("sample", place).alias("sample"))


def merge_drift(parts: DataFrame) -> DataFrame:
    """The first record's value is the sample."""
    return _merged(parts, ["field", "record_type", "version"], F.min_by)


def drift_of(parts: DataFrame) -> DataFrame:
    """The drift table of merged parts."""
    v = F.col("version")
    context = F.when(v.isNull(), F.concat(F.lit("overflow capture from "), "record_type", F.lit(" record (no version)"))).otherwise(F.concat(F.lit("overflow capture from "), "record_type", F.lit(" record v"), v))
    return parts.select(F.col("field").alias("field_name"), "record_type", "version", "occurrence_count", "first_seen_at", "last_seen_at", F.col("sample.value").alias("sample_value"), context.alias("source_context"))


def schema_drift(records: DataFrame) -> DataFrame:
    return drift_of(drift_parts(records))


def type_parts(records: DataFrame) -> DataFrame:
    inner = F.get_json_object("attachment", "$.type")
    unknown = records.filter(~F.col("type").isin(*REQUIRED)).select(F.col("type").alias("type_name"), "version", "timestamp", F.col("line").alias("raw"), "path", "off")
    sub = records.filter((F.col("type") == "attachment") & ~F.coalesce(inner.isin(*SUBTYPE_KEYS), F.lit(False))).select(F.concat(F.lit("attachment."), F.coalesce(inner, F.lit("unknown"))).alias("type_name"), "version", "timestamp", F.col("attachment").alias("raw"), "path", "off")
    return merge_types(unknown.unionByName(sub).select("type_name", "version", F.lit(1).cast("long").alias("occurrence_count"), F.col("timestamp").alias("first_seen_at"), F.col("timestamp").alias("last_seen_at"), _sample("raw")))


def merge_types(parts: DataFrame) -> DataFrame:
    """The last record is the sample."""
    return _merged(parts, ["type_name", "version"], F.max_by)


def types_of(parts: DataFrame) -> DataFrame:
    return parts.select("type_name", "version", "occurrence_count", "first_seen_at", "last_seen_at", F.col("sample.value").alias("sample_value"))


def record_type_drift(records: DataFrame) -> DataFrame:
    return types_of(type_parts(records))


def schema_drift_list(drift: DataFrame, limit: int | None = None) -> DataFrame:
    return newest(drift, limit, F.desc("first_seen_at"), "field_name", "record_type", "version")


def record_type_drift_list(drift: DataFrame, type_contains: str | None = None, version: str | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
    if type_contains is not None:
        drift = drift.filter(has_text(F.col("type_name"), type_contains))
    if version is not None:
        drift = drift.filter(F.col("version") == version)
    if since is not None:
        drift = drift.filter(F.col("last_seen_at") >= since)
    return newest(drift, limit, F.desc("last_seen_at"), "type_name", "version")


def drift_fields(drift: DataFrame) -> DataFrame:
    """Each drift row with whether its field has become a column, is kept in extra_json, or is unhandled."""
    spark = drift.sparkSession
    tables = F.broadcast(spark.createDataFrame([(k, COLUMNS_OF[t]) for k, t in TABLE_OF.items()], "record_type string, columns array<string>"))  # one row a record type
    has = F.array_contains("columns", F.col("field_name"))
    status = F.when(has, "promoted").when(F.array_contains("columns", F.lit("extra_json")), "extra_json").otherwise("unhandled")
    return drift.join(tables, "record_type", "left").withColumn("promotion_status", F.coalesce(status, F.lit("unhandled"))).withColumn("sample_value", cut(F.col("sample_value"), 200, "...")).drop("columns")


def drift_by_version(drift: DataFrame, record_type_contains: str | None = None, limit: int | None = None) -> DataFrame:
    """version, record_types: array of (record_type, fields)."""
    rows = drift_fields(drift.filter(F.col("version").isNotNull()))
    if record_type_contains is not None:
        rows = rows.filter(has_text(F.col("record_type"), record_type_contains))
    if limit is not None:
        # the first fields over all versions; a sorted limit, not a window over everything
        rows = rows.orderBy("version", "record_type", "field_name").limit(limit)
    field = F.struct("field_name", "sample_value", "occurrence_count", "first_seen_at", "promotion_status")
    by_type = rows.groupBy("version", "record_type").agg(F.array_sort(F.collect_list(field)).alias("fields"))
    return by_type.groupBy("version").agg(F.array_sort(F.collect_list(F.struct("record_type", "fields"))).alias("record_types"))


def version_span(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("version").isNotNull()).groupBy("version").agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def new_fields_count(drift: DataFrame) -> DataFrame:
    """version, new_fields_count: drift rows whose field and type were not seen earlier under another version."""
    first = drift.filter(F.col("version").isNotNull()).withColumn("earliest", F.min("first_seen_at").over(Window.partitionBy("field_name", "record_type")))
    return first.groupBy("version").agg(F.count_if(F.col("first_seen_at") == F.col("earliest")).alias("new_fields_count"))


def version_history(sessions: DataFrame, drift: DataFrame) -> DataFrame:
    seen = (
        sessions.filter(F.col("version").isNotNull())
        .groupBy("version")
        .agg(
            F.min("first_seen_at").alias("first_seen_at"),
            F.max(F.coalesce("last_seen_at", "first_seen_at")).alias("last_seen_at"),
            F.min_by("session_id", F.struct("first_seen_at", "session_id")).alias("first_session_id"),
            F.count("*").alias("session_count"),
        )
    )
    return seen.join(new_fields_count(drift), "version", "left").withColumn("new_fields_count", F.coalesce("new_fields_count", F.lit(0)).cast("long"))


def version_diff(sessions: DataFrame, drift: DataFrame) -> DataFrame:
    """Fields that are new or gone in a version, against the version before it by first_seen_at."""
    sets = drift.filter(F.col("version").isNotNull()).groupBy("version").agg(F.array_sort(F.collect_set(F.concat_ws(":", "field_name", "record_type"))).alias("fields"))
    rows = version_history(sessions, drift).select("version", "first_seen_at").join(sets, "version", "left")
    empty = F.array().cast("array<string>")
    rows = rows.withColumn("fields", F.coalesce("fields", empty))
    # one row for each version of the producer: a handful, whatever the data
    w = Window.orderBy("first_seen_at", "version")
    before = F.coalesce(F.lag("fields").over(w), empty)
    return rows.select("version", F.lag("version").over(w).alias("previous_version"), F.array_except("fields", before).alias("new_fields"), F.array_except(before, "fields").alias("disappeared_fields"))
