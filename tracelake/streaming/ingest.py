"""Live ingest: each micro-batch is appended to bronze once, and becomes typed change events."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import session_id_from_path
from ..functions.store import BUCKETS, Keys, State, Store
from ..operators import decompose, drift
from ..operators.decompose import BASED, LINE, Tables, parse, quarantine, sorted_out
from ..operators.drift import observations
from ..operators.search import build_index, index_notes, read_index, write_index
from ..sources.session_logs import SCHEMA, counted, list_logs, sync_report, tail_session_logs, tail_version

EVENT = "batch_id bigint, type string, session_id string, path string, detail string, n bigint"


def _event(rows: DataFrame, kind: str, session=None, path=None, detail=None, n=None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(F.lit(kind).alias("type"), *[(none if c is None else c.cast("string")).alias(a) for a, c in (("session_id", session), ("path", path), ("detail", detail))], (F.lit(1) if n is None else n).cast("long").alias("n"))


def record_added(batch: Tables) -> DataFrame:
    """One event a file: how many records came."""
    rows = batch.records.groupBy("path").agg(F.max("sessionId").alias("session"), F.count("*").alias("n"))
    return _event(rows, "record:added", F.col("session"), F.col("path"), n=F.col("n"))


def session_started(batch: Tables, known: DataFrame | None = None) -> DataFrame:
    """Files that were never seen before."""
    rows = batch.records.groupBy("path").agg(F.max("sessionId").alias("session"))
    if known is not None:
        rows = rows.join(known.select("path").distinct(), "path", "left_anti")
    return _event(rows, "session:started", F.col("session"), F.col("path"))


def schema_drifted(batch: Tables) -> DataFrame:
    """Files of the batch with unmodelled fields."""
    rows = observations(batch.records).groupBy("path").agg(F.count("*").alias("n"))
    return _event(rows, "schema:drift", path=F.col("path"), n=F.col("n"))


def version_changed(batch: Tables, last: str | None = None) -> DataFrame:
    """Sessions whose version is not that of the session that arrived before, starting from the ``last`` known one.

    Sessions are ordered by their first record's time, a minute at a time; the first of a minute meets the last of the minutes before,
    of which one row each goes through the window.
    """
    s = batch.of(*BASED, "attachment").filter(F.col("version").isNotNull()).groupBy("sessionId").agg(F.min_by(F.struct("timestamp", "version"), F.struct("path", "off")).alias("f")).select("sessionId", "f.*")
    s = s.withColumn("minute", F.substring("timestamp", 1, 16))
    minutes = s.groupBy("minute").agg(F.max_by("version", F.struct("timestamp", "sessionId")).alias("latest"))
    minutes = minutes.select("minute", F.lag("latest").over(Window.orderBy("minute")).alias("carried"))
    within = F.lag("version").over(Window.partitionBy("minute").orderBy("timestamp", "sessionId"))
    rows = s.withColumn("within", within).join(minutes, "minute").withColumn("before", F.coalesce("within", "carried", F.lit(last))).filter(~F.col("version").eqNullSafe(F.col("before")))
    return _event(rows, "version:changed", F.col("sessionId"), detail=F.concat_ws("->", "before", "version"))


def artifact_events(batch: Tables, stored_files: DataFrame | None = None, stored_git: DataFrame | None = None) -> DataFrame:
    """Writes, edits and commits that are not stored yet."""
    ops = batch.file_operations.filter(F.col("operation_type").isin("write", "edit"))
    git = batch.git_operations.filter(F.col("operation_type") == "commit")
    if stored_files is not None:
        ops = ops.join(stored_files.select("tool_use_id", "operation_type"), ["tool_use_id", "operation_type"], "left_anti")
    if stored_git is not None:
        git = git.join(stored_git.select("tool_use_id", "operation_type"), ["tool_use_id", "operation_type"], "left_anti")
    written = _event(ops.filter("operation_type = 'write'"), "file:written", F.col("session_id"), F.col("file_path"), F.col("tool_use_id"))
    edited = _event(ops.filter("operation_type = 'edit'"), "file:edited", F.col("session_id"), F.col("file_path"), F.col("tool_use_id"))
    return written.unionByName(edited).unionByName(_event(git, "git:commit", F.col("session_id"), detail=F.col("commit_message")))


#: Silver tables by the column that leads to their session: of it, of their message, of their attachment.
OF_SESSION = ("sessions", "messages", "attachments", "system_events", "summaries", "file_operations", "git_operations", "files")
OF_MESSAGE = {"message_content": "message_uuid", "plan_blocks": "message_uuid", "token_usage": "message_uuid", "tool_executions": "message_uuid"}
OF_ATTACHMENT = {"hook_executions": "attachment_uuid"}
SILVER = (*OF_SESSION, *OF_MESSAGE, *OF_ATTACHMENT)
RECORD = f"{SCHEMA}, {LINE}"
#: Tables of parts that merge over all batches: schema, parts of some records, merging.
MERGED = {
    "projects": (decompose.PROJECT_PARTS, decompose.project_parts, decompose.merge_projects),
    "agents": (decompose.AGENT_PARTS, decompose.agent_parts, decompose.merge_agents),
    "schema_drift": (drift.DRIFT_PARTS, drift.drift_parts, drift.merge_drift),
    "record_type_drift": (drift.TYPE_PARTS, drift.type_parts, drift.merge_types),
}


def together(jobs: list[Callable[[], None]], at_once: int = 4) -> None:
    """Run independent Spark jobs side by side; the first error is raised when all have ended."""
    with ThreadPoolExecutor(at_once) as pool:
        found = [pool.submit(j) for j in jobs]
    for f in found:
        f.result()


class Stored:
    """The tables of a lake as its last version has them: what ``Tables`` has, read and not made."""

    def __init__(self, lake: "Lake", state: State):
        self._lake, self._state = lake, state

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SILVER:
            raise AttributeError(name)
        return self._lake.store.bucketed(self._state, name, self._state.notes["schemas"][name])

    def _parts(self, name: str) -> DataFrame:
        schema, _, merge = MERGED[name]
        return merge(self._lake.store.run(self._state, name, schema))

    @property
    def bronze(self) -> DataFrame:
        return self._lake.bronze.select("path", "off", "line")

    @property
    def records(self) -> DataFrame:
        return self._lake.store.bucketed(self._state, "records", RECORD)

    @property
    def rejected(self) -> DataFrame:
        """Rejected lines are not stored: they are looked for in bronze."""
        return decompose.numbered(quarantine(self.bronze)[1], self.bronze)

    @property
    def searchable(self) -> DataFrame:
        return self.message_content.unionByName(self.plan_blocks, allowMissingColumns=True)

    @property
    def projects(self) -> DataFrame:
        return decompose.projects_of(self._parts("projects"), self.sessions)

    @property
    def agents(self) -> DataFrame:
        return decompose.agents_of(self._parts("agents"))

    @property
    def schema_drift(self) -> DataFrame:
        return drift.drift_of(self._parts("schema_drift"))

    @property
    def record_type_drift(self) -> DataFrame:
        return drift.types_of(self._parts("record_type_drift"))


class Lake:
    """Where a stream keeps its tables.

    A batch is parsed once.  Its lines and events are appended under its number; the buckets of its sessions are read, joined with its records
    and written anew as silver tables; projects, agents and drift are added as parts that merge; files, artifacts, messages and
    tool calls as keys.  One version (``store``) then makes all of it visible: a batch that stopped anywhere before shows nothing, and is
    done again when it comes again.  A batch that is committed is not done twice.

    A batch opens the buckets of its sessions, the parts of key runs that may hold one of its keys, and O(log n) runs of parts.

    A message or a tool call is of one session.  Where a batch finds one in the records of two buckets (a session taken up again under another name
    copies records), the lake notes that, and ``tables`` settles all records together, as batch decomposition does, unless the last batch wrote
    all buckets and so did it.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.store = Store(spark, self.root)
        self.keys = Keys(self.store)

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        self.store.write(df, f"{name}/batch_id={batch_id}")

    def _appended(self, name: str, schema: str) -> DataFrame:
        """The rows of all batches that are committed."""
        return self.store.read(name, f"{schema}, batch_id bigint").filter(F.col("batch_id") <= self.store.state().batch)

    @property
    def bronze(self) -> DataFrame:
        return self._appended("bronze", SCHEMA)

    @property
    def events(self) -> DataFrame:
        return self._appended("events", "type string, session_id string, path string, detail string, n bigint")

    @property
    def records(self) -> DataFrame:
        return self.store.bucketed(self.store.state(), "records", RECORD)

    def tables(self, keep=None) -> Stored | Tables:
        """The silver tables of the last version."""
        state = self.store.state()
        if state.batch < 0 or state.notes.get("shared") and not self._settled(state):
            return Tables(self.bronze.select("path", "off", "line"), keep, self.records)
        return Stored(self, state)

    @staticmethod
    def _settled(state: State) -> bool:
        """One batch wrote all buckets, and so settled all their records together."""
        return len(set(state.buckets.values())) < 2

    def sync_totals(self, last: bool = False) -> dict[str, int]:
        """What ``sync_totals`` counts, of all batches or the ``last``, as their own jobs counted it.  A file is synced where it gave records; one
        that several batches read counts for each."""
        return self.store.state().notes.get("last_sync" if last else "all_syncs", {})

    def bucket(self, session: Column) -> Column:
        return F.pmod(F.xxhash64(session), F.lit(self.buckets)).cast("int")

    def _home(self) -> Column:
        """The bucket of a record: that of its session."""
        from_path = session_id_from_path(F.col("path"))
        return self.bucket(F.when(F.col("type") == "summary", from_path).otherwise(F.coalesce("sessionId", from_path)))

    # ------------------------------------------------------------ one batch

    def ingest_batch(self, df: DataFrame, batch_id: int) -> None:
        """All of one micro-batch, or nothing that can be seen."""
        before = self.store.state()
        if batch_id <= before.batch:
            return
        self.store.sweep(before)
        self.buckets = before.notes.get("of_buckets", self.buckets)  # as the lake began
        work = f"work/{batch_id}"
        self.store.drop(work)
        # counted by the jobs that write, not by jobs of their own
        lines, parsed, told = Observation(), Observation(), Observation()
        self._write(df.select("path", "off", "line").observe(lines, F.count_if(F.col("off") >= 0).alias("lines"), F.count_if(F.col("off") < 0).alias("errored")), "bronze", batch_id)
        good, _ = quarantine(self.store.read(f"bronze/batch_id={batch_id}", SCHEMA))
        good, stored = good.withColumn("bucket", self._home()).observe(parsed, F.count("*").alias("records")), f"{RECORD}, bucket int"
        if before.buckets:
            self.store.write(good, f"{work}/records")
            fresh = self.store.read(f"{work}/records", stored)
        else:  # there is nothing to put them to
            self.store.write_buckets(good, "records", batch_id)
            fresh = self.store.read(f"silver/records/made={batch_id}", stored)
        new = State(before.number, batch_id, dict(before.buckets), {k: list(v) for k, v in before.runs.items()}, dict(before.notes))
        touched = sorted(r[0] for r in fresh.select("bucket").distinct().collect())  # the buckets at most
        new.buckets.update({str(b): batch_id for b in touched})
        new.notes["of_buckets"] = self.buckets
        silver, new.notes["schemas"] = self._write_silver(before, fresh, touched, batch_id, work)
        gone = self._write_events_and_keys(before, new, fresh, silver, batch_id, work, told)
        seen = {**lines.get, **parsed.get, **told.get}
        report = {"files_synced": seen["synced"], "files_errored": seen["errored"], "total_records": seen["records"], "total_warnings": seen["lines"] - seen["records"], "total_overflow_fields": seen["overflow"] or 0}
        new.notes["last_sync"] = report
        new.notes["all_syncs"] = {k: before.notes.get("all_syncs", {}).get(k, 0) + v for k, v in report.items()}

        def merged(name: str) -> Callable[[], None]:
            schema, parts, merge = MERGED[name]

            def run() -> None:
                _, old = self.store.add_run(new, parts(fresh), name, schema, merge, batch_id)
                gone.extend(f"runs/{name}/{r}" for r in old)

            return run

        together([merged(name) for name in MERGED])
        self.store.retire(before, new, gone, ["records", *SILVER])
        self.store.sweep(self.store.commit(new))
        self.store.drop(work)

    def _kept(self, at: str) -> Callable[[str, DataFrame], DataFrame]:
        def keep(name: str, df: DataFrame) -> DataFrame:
            self.store.write(df, f"{at}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{self.root}/{at}/{name}")

        return keep

    def _write_silver(self, before: State, fresh: DataFrame, touched: list[int], version: int, work: str) -> tuple[Tables, dict[str, str]]:
        """The touched buckets of all silver tables, from their records, old and new; and the tables' schemas."""
        if before.buckets:
            old = self.store.bucketed(before, "records", RECORD, touched)
            self.store.write_buckets(old.unionByName(fresh.drop("bucket")).withColumn("bucket", self._home()), "records", version)
        records = self.store.read(f"silver/records/made={version}", f"{RECORD}, bucket int")
        said = records.filter(F.col("type").isin("user", "assistant"))
        self.store.write(said.groupBy("uuid").count().filter("count > 1").select("uuid"), f"{work}/again")
        again = self.store.read(f"{work}/again", "uuid string")
        homes = records.filter("type = 'attachment'").groupBy("uuid").agg(F.min_by("bucket", F.struct("path", "off")).alias("bucket"))
        aside, schemas = self._kept(f"{work}/silver"), {}

        def keep(name: str, df: DataFrame) -> DataFrame:
            if name not in SILVER:
                return aside(name, df)  # only other tables are made of it
            carried = "bucket" in df.columns
            plain = df.drop("bucket")
            if not carried:
                of_session = name in OF_SESSION
                df = df.withColumn("bucket", self.bucket(F.col("session_id"))) if of_session else df.join(homes.withColumnRenamed("uuid", OF_ATTACHMENT[name]), OF_ATTACHMENT[name])
            placed = df.select(*plain.columns, "bucket")
            # rows that are made where the records are read lie by their buckets
            self.store.write_buckets(placed, name, version, together=name in ("messages", "message_content", "plan_blocks", "token_usage"))
            schemas[name] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
            stored = self.store.read(f"silver/{name}/made={version}", f"{schemas[name]}, bucket int")
            return stored if carried else stored.drop("bucket")

        t = Tables(None, keep, records, again, ("bucket",))
        t.__dict__["records"] = records  # written already
        # what a step is made of was written by the steps before
        for step in (
            ("messages", "message_content", "token_usage", "attachments", "sessions", "system_events", "summaries"),
            ("plan_blocks", "tool_executions", "hook_executions"),
            ("file_operations", "git_operations"),
            ("files",),
        ):
            together([lambda name=name: getattr(t, name) for name in step])
        return t, schemas

    def _write_events_and_keys(self, before: State, new: State, fresh: DataFrame, silver: Tables, batch_id: int, work: str, told: Observation) -> list[str]:
        """The batch's events, told apart from what was seen by the keys; its own new keys.  ``silver`` are the tables of the touched buckets:
        the batch's part of them is what its messages gave."""
        batch = Tables(None, None, fresh.drop("bucket"))
        own_messages = fresh.filter(F.col("type").isin("user", "assistant")).select(F.col("uuid").alias("message_uuid")).distinct()
        for name in ("message_content", "file_operations", "git_operations"):
            made = getattr(silver, name)
            batch.__dict__[name] = made.join(own_messages, "message_uuid", "left_semi") if before.buckets else made  # else all is the batch's
        mined = batch.file_operations.select("tool_use_id", "operation_type").unionByName(batch.git_operations.select("tool_use_id", "operation_type"))
        owners = fresh.filter(F.col("uuid").isNotNull()).select("uuid", "bucket").distinct()
        calls = batch.message_content.filter("tool_use_id is not null")
        none = F.lit(0)
        kinds = [("file", fresh, F.col("path"), none), ("artifact", mined, F.concat_ws("\x1f", "tool_use_id", "operation_type"), none), ("record", owners, F.col("uuid"), F.col("bucket")), ("call", calls, F.col("tool_use_id"), F.col("bucket"))]
        found = None
        for kind, rows, key, home in kinds:
            one = rows.select(F.lit(kind).alias("kind"), key.alias("key"), home.alias("home"))
            found = one if found is None else found.unionByName(one)
        schema = "kind string, key string, home int"
        self.store.write(found.distinct(), f"{work}/keys")
        own = self.store.read(f"{work}/keys", schema)
        self.store.write(self.keys.seen(before, own), f"{work}/seen")
        seen = self.store.read(f"{work}/seen", schema)
        twice = own.unionByName(seen).filter("kind in ('record', 'call')").groupBy("kind", "key").agg(F.count_distinct("home").alias("n")).filter("n > 1")
        new.notes["shared"] = bool(before.notes.get("shared")) or not twice.isEmpty()
        files = seen.filter("kind = 'file'").select(F.col("key").alias("path"))
        parts = F.split("key", "\x1f")
        stored = seen.filter("kind = 'artifact'").select(parts[0].alias("tool_use_id"), parts[1].alias("operation_type"))
        last = before.notes.get("last_version")
        events = record_added(batch).unionByName(session_started(batch, files)).unionByName(schema_drifted(batch)).unionByName(version_changed(batch, last[2] if last else None)).unionByName(artifact_events(batch, stored, stored))
        kind = F.col("type")
        self._write(events.observe(told, F.count_if(kind == "record:added").alias("synced"), F.sum(F.when(kind == "schema:drift", F.col("n"))).alias("overflow")), "events", batch_id)
        latest = batch.sessions.filter("version is not null").agg(F.max(F.struct("first_seen_at", "session_id", "version"))).first()[0]
        new.notes["last_version"] = max([x for x in (last, list(latest) if latest else None) if x], default=None)
        return self.keys.add(new, own.join(seen.select("kind", "key"), ["kind", "key"], "left_anti"), batch_id)

    # ------------------------------------------------------------ search

    def refresh_index(self, path: str | None = None) -> bool:
        """Add what came since the last refresh to the search index, and what was read anew in place of what it was.

        Only the buckets that were written since are looked at.  What is added is a segment of its own (``search.write_index``).
        """
        state, at, keys = self.store.state(), path or f"{self.root}/index", ["message_uuid", "block_index"]
        built = index_notes(self.spark, at).get("built", -1)
        if state.batch <= built:
            return False
        since = State(state.number, state.batch, {b: v for b, v in state.buckets.items() if v > built}, notes=state.notes)
        texts = self.tables().searchable if state.notes.get("shared") and not self._settled(state) else Stored(self, since).searchable
        docs = texts.filter(F.col("text_content").isNotNull()).select(*keys, "text_content").withColumn("digest", F.xxhash64("text_content"))
        self.store.write(docs, f"work/index-{state.batch}")
        docs = self.store.read(f"work/index-{state.batch}", "message_uuid string, block_index bigint, text_content string, digest bigint")
        held = read_index(self.spark, at, keys).docs.select(*keys, F.col("digest").alias("old"))
        met = docs.join(held, keys, "left")
        changed = met.filter("old is not null and old != digest").select(*keys)
        added = met.filter("old is null or old != digest").select(*keys, "text_content")
        write_index(build_index(added, keys, "text_content"), at, run=state.batch, dead=changed, notes={"built": state.batch})
        self.store.drop(f"work/index-{state.batch}")
        return True

    def follow(self, logs: str, *, once: bool = False, every: str = "2 seconds", suffix: str = ".jsonl", max_bytes_per_trigger: int = 0, state: str | None = None):
        """Start tailing; ``once`` takes all that is there, in one batch, and stops.  ``state`` is where the tail keeps its manifest, in the lake by
        default: a folder that pyarrow opens on driver and executors."""
        w = tail_session_logs(self.spark, logs, suffix=suffix, max_bytes_per_trigger=0 if once else max_bytes_per_trigger, state=state or f"{self.root}/tail").writeStream.foreachBatch(self.ingest_batch).option("checkpointLocation", f"{self.root}/checkpoint")
        return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


@dataclass
class Synced:
    """One run's ``report``, a row a file, and its ``totals`` (``sync_totals``), as the job that wrote the report counted them."""

    report: DataFrame
    totals: dict[str, int]


def sync_session_logs(spark: SparkSession, logs: str, to: str, *, suffix: str = ".jsonl", state: str | None = None) -> Synced:
    """One run over the files below ``logs``: the tail goes on from where the run before with this ``to`` left each, and the run reports on what it brought.

    Lines are stored below ``to``, a batch a folder, before the tail's offset moves on: a batch that stopped is done again, in the same folder, and is
    part of the run that ended it.  A file of which the run read nothing is skipped.
    """
    store, done = Store(spark, to), []
    state = state or f"{store.root}/tail"

    def take(df: DataFrame, batch_id: int) -> None:
        store.write(df.select("path", "off", "line"), f"bronze/batch_id={batch_id}")
        done.append(batch_id)

    found = spark.createDataFrame([(p,) for p in list_logs([logs], suffix)], "path string")  # as the tail lists them
    tail, again = tail_session_logs(spark, logs, suffix=suffix, state=state), True
    while again:
        planned, before = tail_version(state), len(done)
        tail.writeStream.foreachBatch(take).option("checkpointLocation", f"{store.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        again = len(done) > before and tail_version(state) == planned  # a batch that stopped is done again alone: what came since is left
    lines = store.read("bronze", f"{SCHEMA}, batch_id bigint").filter(F.col("batch_id").isin(done)).drop("batch_id")
    store.write(parse(lines), "work/parsed")  # once, for good and rejected lines
    records, rejected = sorted_out(store.read("work/parsed", f"{RECORD}, error string"))
    listed = found.unionByName(lines.select("path")).distinct()  # also what came after the list was made
    told, at = Observation(), f"reports/{uuid.uuid4().hex}"
    report = sync_report(listed, lines, rejected, observations(records))
    store.write(report.observe(told, *counted()), at)
    store.drop("work")
    return Synced(spark.read.schema(report.schema).parquet(f"{store.root}/{at}"), told.get)
