"""JSONL trees as a Spark data source, in batch and as a stream of appended lines.

Rows are (path, off, line): ``off`` is the line's byte offset.  A task reads byte ranges,
each the lines that begin in it: a huge file is read by many tasks, many small files by one.  The
stream's offset is, for each file, where its last complete line ends and a fingerprint of its
first bytes: a file that shrank or was replaced is read from the start again; files whose size
and time are what they were are not opened.  With a folder for its ``state`` the offset is the number of a
manifest there, whatever the number of files: the driver lists the tree and compares sizes and times, and executors look
at heads and newlines, and tell how far they came (``ManifestReader``).  A line that is not finished yet is left for later;
in batch mode a last line without a newline counts.  A file that can't be opened gives one row
of offset -1 without a line, and the others are read.  Trees in stores that only Spark opens
are read by its own text source in batch mode, with offsets that keep the order of lines.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from ..functions.ship import ship

SCHEMA = "path string, off bigint, line string"
_HEAD = 64
_BLOCK = 1 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(roots: list[str], suffix: str) -> dict[str, tuple[int, int]]:
    """Files below the roots, their sizes and times; links are not followed."""
    out = {}
    for root in roots:
        system, at = _open(root)
        info = system.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
        prefix = root[: len(root) - len(at)] if root.endswith(at) else ""
        for f in found:
            if f.type == fs.FileType.File and f.path.endswith(suffix):
                out[prefix + f.path] = (f.size, f.mtime_ns or 0)
    return dict(sorted(out.items()))


def list_logs(roots: list[str], suffix: str = ".jsonl") -> dict[str, int]:
    """Files below the roots and their sizes."""
    return {p: size for p, (size, _) in _listed(roots, suffix).items()}


@dataclass
class Range:
    path: str
    start: int
    end: int
    open_end: bool = True


class Ranges(InputPartition):
    """What one task reads: a range of a large file, or small files together."""

    def __init__(self, parts: list[Range]):
        super().__init__(None)
        self.parts = parts


def together(ranges: list[Range], most: int) -> list[Ranges]:
    """Ranges in order, so many to a task as have ``most`` bytes."""
    out, held = [[]], 0
    for r in ranges:
        if held and held + r.end - r.start > most:
            out.append([])
            held = 0
        out[-1].append(r)
        held += r.end - r.start
    return [Ranges(x) for x in out]


def read_ranges(part: Ranges) -> Iterator[pa.RecordBatch]:
    for r in part.parts:
        yield from read_range(r)


def read_range(part: Range) -> Iterator[pa.RecordBatch]:
    """The lines that begin in the range; up to the file's end if ``open_end``, else to ``end`` alone."""
    system, at = _open(part.path)
    try:
        opened = system.open_input_file(at)
    except OSError:
        yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([-1], pa.int64()), pa.array([None], pa.string())], names=["path", "off", "line"])
        return
    with opened as f:
        size = f.size()
        pos, rest = part.start, b""
        if pos:
            # the line that holds the byte before belongs to the range before
            f.seek(pos - 1)
            pos -= 1
            skipping = True
        else:
            f.seek(0)
            skipping = False
        offs, lines, held = [], [], 0
        begin = pos
        last = size if part.open_end else min(size, part.end)
        while pos < last:
            block = f.read(min(_BLOCK, last - pos))
            if not block:
                break
            pos += len(block)
            rest += block
            *whole, rest = rest.split(b"\n")
            for line in whole:
                if skipping:
                    skipping = False
                elif begin >= part.end:
                    break
                elif line.strip():
                    offs.append(begin)
                    lines.append(line)
                    held += len(line)
                begin += len(line) + 1
            if held > 4 * _BLOCK:
                yield _batch(part.path, offs, lines)
                offs, lines, held = [], [], 0
            if not skipping and begin >= part.end:
                break
        if rest.strip() and not skipping and begin < part.end and part.open_end:
            offs.append(begin)
            lines.append(rest)
        if lines:
            yield _batch(part.path, offs, lines)


def _batch(path: str, offs: list[int], lines: list[bytes]) -> pa.RecordBatch:
    text = [x.rstrip(b"\r").decode("utf-8", "replace") for x in lines]
    return pa.RecordBatch.from_arrays([pa.array([path] * len(text)), pa.array(offs, pa.int64()), pa.array(text)], names=["path", "off", "line"])


class _Options:
    def __init__(self, options):
        self.roots = json.loads(options["roots"]) if "roots" in options else [options["path"]]
        self.suffix = options.get("suffix", ".jsonl")
        self.chunk = int(options.get("chunkBytes", 64 << 20))
        self.most = int(options.get("maxBytesPerTrigger", 0))


class BatchReader(DataSourceReader):
    def __init__(self, options):
        self.o = _Options(options)

    def partitions(self):
        found = [Range(p, a, min(a + self.o.chunk, n)) for p, n in list_logs(self.o.roots, self.o.suffix).items() for a in range(0, n, self.o.chunk)]
        return together(found, self.o.chunk)

    def read(self, partition):
        return read_ranges(partition)


def _complete(path: str, start: int, size: int) -> int:
    """Where the last complete line ends, looking back from the file's end to ``start``."""
    system, at = _open(path)
    with system.open_input_file(at) as f:
        end = size
        while end > start:
            lo = max(start, end - _BLOCK)
            f.seek(lo)
            cut = f.read(end - lo).rfind(b"\n")
            if cut >= 0:
                return lo + cut + 1
            end = lo
    return start


def _head(path: str, end: int) -> str:
    system, at = _open(path)
    with system.open_input_file(at) as f:
        return hashlib.sha1(f.read(min(_HEAD, end))).hexdigest()


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.o, self.known = _Options(options), {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        out, left = {}, self.o.most or None
        for path, (size, time) in _listed(self.o.roots, self.o.suffix).items():
            known = self.known.get(path)
            if known and known[3:] == [size, time]:
                out[path] = known  # nothing was appended: the file is not opened
                continue
            end, head, head_of = known[:3] if known else (0, "", 0)
            same = size >= end and (not end or _head(path, head_of) == head)
            start = end if same else 0
            stop = size if left is None else min(size, start + left)
            done = _complete(path, start, stop)
            if done == start and stop < size:
                done = _complete(path, start, size)  # one line longer than the limit
            if left is not None:
                left = max(0, left - (done - start))
            if done:
                seen = [size, time] if stop == size or done == size else [-1, 0]
                out[path] = [done, _head(path, min(_HEAD, done)), min(_HEAD, done), *seen]
        self.known = out
        return out

    def partitions(self, start, end):
        found = []
        for path, (stop, head, head_of, *_) in end.items():
            before, old, old_of = start.get(path, [0, "", 0])[:3]
            if [before, old, old_of] == [stop, head, head_of]:
                continue
            # the heads tell, and only of a file that was shorter than a head the file itself
            same = not before or stop >= before and (old == head if old_of == head_of else _head(path, old_of) == old)
            begin = before if same else 0
            found += [Range(path, a, min(a + self.o.chunk, stop), open_end=stop > a + self.o.chunk) for a in range(begin, stop, self.o.chunk)]
        return together(found, self.o.chunk)

    def read(self, partition):
        return read_ranges(partition)

    def commit(self, end):
        pass


def _read_json(path: str) -> list | None:
    system, at = _open(path)
    if system.get_file_info(at).type != fs.FileType.File:
        return None
    with system.open_input_stream(at, compression="gzip") as f:
        return json.loads(f.read())


def _write_json(path: str, what: list) -> None:
    """In one step: a reader sees the file whole or not at all."""
    system, at = _open(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    beside = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(beside, compression="gzip") as f:
        f.write(json.dumps(what).encode())
    system.move(beside, at)


def _versions(state: str) -> list[int]:
    system, at = _open(state)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(int(f.base_name[:-5]) for f in found if f.type == fs.FileType.File and f.base_name.endswith(".json") and f.base_name[:-5].isdigit())


def tail_version(state: str) -> int:
    """The version of the files that a tail with this ``state`` planned to read last."""
    return max(_versions(state), default=0)


@dataclass
class Tail:
    """A file from where its complete lines ended to where it ended when it was listed; ``head`` is of its first ``head_of`` bytes."""

    path: str
    start: int
    stop: int
    head: str
    head_of: int


class Tails(InputPartition):
    def __init__(self, parts: list[tuple[Tail, int, int]], told: str):
        super().__init__(None)
        self.parts, self.told = parts, told


def look(tail: Tail, begin: int) -> tuple[int, int, list]:
    """From where to where the complete lines of a range are that begins at ``begin``; the first range of a file that was replaced begins at 0.
    Also what is told: path, where the file's complete lines end, its head, the head's bytes."""
    system, at = _open(tail.path)
    with system.open_input_file(at) as f:
        replaced = tail.head_of > 0 and hashlib.sha1(f.read(tail.head_of)).hexdigest() != tail.head
    if replaced and begin == tail.start:
        begin = 0
    done = _complete(tail.path, begin, tail.stop)  # what is behind the last newline waits
    head_of = min(_HEAD, done)
    return begin, done, [tail.path, done if done > begin else 0 if replaced else tail.start, _head(tail.path, head_of) if done else "", head_of]


class ManifestReader(DataSourceStreamReader):
    """Offsets are {"version": n}.  ``state/<n>.json`` lists the files as version n saw them; ``state/told-<n>/`` is what the executors that read
    version n found: where each file's complete lines end, and its head."""

    def __init__(self, options):
        self.o, self.state = _Options(options), options["state"].rstrip("/")

    def initialOffset(self):
        return {"version": 0}

    def _versions(self) -> list[int]:
        return _versions(self.state)

    def _files(self, version: int) -> dict[str, list]:
        """path: size, time, where it was begun, up to where it was planned, head, bytes of head."""
        return {r[0]: r[1:] for r in (_read_json(f"{self.state}/{version}.json") or [])} if version else {}

    def _ended(self, version: int) -> dict[str, list]:
        """path: where its lines end, head, bytes of head, after version ``version`` was read."""
        told: dict[str, list] = {}
        system, at = _open(f"{self.state}/told-{version}")
        for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if f.base_name.endswith(".json"):
                for path, *found in _read_json(f"{self.state}/told-{version}/{f.base_name}"):
                    told[path] = max(told.get(path, found), found)  # of several ranges the farthest
        return {p: [begin, head, head_of] for p, (_, _, begin, _, head, head_of) in self._files(version).items()} | told

    def latestOffset(self):
        last = max(self._versions(), default=0)
        before, ended, left, now, news = self._files(last), self._ended(last), self.o.most or None, {}, False
        for path, (size, time) in _listed(self.o.roots, self.o.suffix).items():
            end, head, head_of = ended.get(path, [0, "", 0])
            old = before.get(path)
            if old and old[:2] == [size, time] and (old[3] >= size or end == old[2] and old[3] < size and left == 0):
                now[path] = [size, time, end, max(end, old[3]), head, head_of]
                continue
            if size < end:
                end, head, head_of = 0, "", 0
            stop = size
            if left is not None:
                # a line longer than the limit: twice as far as last time
                step = max(left, 2 * (old[3] - old[2]) if old and old[2] == end else 0) if left else 0
                stop = min(size, end + step)
                left = max(0, left - (stop - end))
            now[path] = [size, time, end, stop, head, head_of]
            news = news or stop > end
        if not news:
            return {"version": last}
        _write_json(f"{self.state}/{last + 1}.json", [[p, *x] for p, x in now.items()])
        return {"version": last + 1}

    def partitions(self, start, end):
        if start["version"] == end["version"]:
            return []
        # compared with what was read last: versions between may never have been
        version, before, parts, held, out = end["version"], self._files(start["version"]), [], 0, []
        for path, (size, time, begin, stop, head, head_of) in self._files(version).items():
            old = before.get(path)
            if stop <= begin or old and old[:2] == [size, time] and old[3] >= stop:
                continue
            for a in range(begin, stop, self.o.chunk):
                if parts and held + min(stop, a + self.o.chunk) - a > self.o.chunk:
                    out, parts, held = [*out, parts], [], 0
                parts.append((Tail(path, begin, stop, head, head_of), a, min(stop, a + self.o.chunk)))
                held += parts[-1][2] - a
        out = [*out, parts] if parts else out
        return [Tails(p, f"{self.state}/told-{version}/{i}.json") for i, p in enumerate(out)]

    def read(self, partition):
        told = []
        for tail, begin, end in partition.parts:
            try:
                begin, done, found = look(tail, begin)
            except OSError:
                yield from read_range(Range(tail.path, 0, 1))  # a row that says so
                continue
            if done > begin:
                yield from read_range(Range(tail.path, begin, min(end, done), open_end=end < done))
            told.append(found)
        _write_json(partition.told, told)

    def commit(self, end):
        """Versions before the last two are not asked for any more."""
        for v in self._versions():
            if v < end["version"] - 1:
                system, at = _open(f"{self.state}/{v}.json")
                system.delete_file(at)
                if system.get_file_info(f"{at[:-5].rpartition('/')[0]}/told-{v}").type == fs.FileType.Directory:
                    system.delete_dir(f"{at[:-5].rpartition('/')[0]}/told-{v}")


class LogsWriter(DataSourceArrowWriter):
    """Rows (path, line), those of a path one after another, as files below ``path``.  A file has its name when it is whole: a task that is run
    again puts the same file in the same place."""

    def __init__(self, options):
        self.root = options["path"].rstrip("/")

    def write(self, iterator):
        system, root = _open(self.root)
        own, at, out = f".{uuid.uuid4().hex}", None, None
        for batch in iterator:
            paths, lines = batch.column("path"), batch.column("line")
            ends = pa.compute.run_end_encode(paths).run_ends.to_pylist() if len(paths) else []
            for begin, end in zip([0, *ends], ends):
                if paths[begin].as_py() != at:
                    self._close(system, out, at, own, root)
                    at = paths[begin].as_py()
                    folder = f"{root}/{at}".rpartition("/")[0]
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(f"{folder}/{own}")
                out.write("".join(f"{x or ''}\n" for x in lines[begin:end].to_pylist()).encode())
        self._close(system, out, at, own, root)
        return WriterCommitMessage()

    @staticmethod
    def _close(system, out, at, own, root):
        if out is not None:
            out.close()
            to = f"{root}/{at}"
            system.move(f"{to.rpartition('/')[0]}/{own}", to)


class SessionLogs(DataSource):
    @classmethod
    def name(cls):
        return "session_logs"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BatchReader(self.options)

    def streamReader(self, schema):
        return ManifestReader(self.options) if "state" in self.options else TailReader(self.options)

    def writer(self, schema, overwrite):
        return LogsWriter(self.options)


def _by_spark(spark: SparkSession, paths: list[str], suffix: str) -> DataFrame:
    """The same lines by Spark's own reader.  An offset is where the line's block begins and how many bytes of lines stand before it there."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").option("lineSep", "\n").text(paths)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r+$", "").alias("line"), F.octet_length("value").alias("size"), F.monotonically_increasing_id().alias("n"))
    before = Window.partitionBy("path", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    off = (F.col("block") + F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0))).cast("long")
    return raw.select("path", off.alias("off"), "line").filter(F.length(F.trim("line")) > 0)


def read_session_logs(spark: SparkSession, path: str | list[str], *, suffix: str = ".jsonl", chunk_bytes: int = 64 << 20) -> DataFrame:
    """All lines of all files below ``path``."""
    paths = [path] if isinstance(path, str) else list(path)
    if any("://" in p and not p.startswith("file:") for p in paths):
        return _by_spark(spark, paths, suffix)
    ship(spark)
    spark.dataSource.register(SessionLogs)
    return spark.read.format("session_logs").option("roots", json.dumps(paths)).option("suffix", suffix).option("chunkBytes", chunk_bytes).load()


def write_session_logs(lines: DataFrame, path: str) -> None:
    """``lines`` (path, off, line) as files below the new folder ``path``, one for each path, each with its lines by their offset.

    Tasks write side by side with pyarrow, a file at a time: Spark's own writer asks for a folder, a checksum and rights of each file, which costs more
    than its lines where files are many and small.
    """
    ship(lines.sparkSession)
    lines.sparkSession.dataSource.register(SessionLogs)
    lines.repartition("path").sortWithinPartitions("path", "off").select("path", "line").write.format("session_logs").mode("append").option("path", path).save()


def tail_session_logs(spark: SparkSession, path: str, *, suffix: str = ".jsonl", chunk_bytes: int = 64 << 20, max_bytes_per_trigger: int = 0, state: str | None = None) -> DataFrame:
    """A stream of the lines appended to the files below ``path``.

    ``state`` is a folder of the stream's own that driver and executors share, kept as long as its checkpoint: with it offsets stay small however many
    files there are, and executors look into the files.
    """
    ship(spark)
    spark.dataSource.register(SessionLogs)
    r = spark.readStream.format("session_logs").option("path", path).option("suffix", suffix).option("chunkBytes", chunk_bytes).option("maxBytesPerTrigger", max_bytes_per_trigger)
    return (r if state is None else r.option("state", state)).load()


def follow_session_logs(spark: SparkSession, logs: str, to: str, *, once: bool = False, every: str = "2 seconds", suffix: str = ".jsonl", max_bytes_per_trigger: int = 0, state: str | None = None) -> StreamingQuery:
    """Start appending the tail's lines, and nothing made of them, to a Parquet table below ``to`` (``followed_lines``).

    Spark's file sink commits a batch's rows and its offset together: a batch that stopped is run again and its rows show once, and a start of later goes
    on where the last one ended.  ``once`` takes all that is there, in one batch, and stops.  A ``Lake`` makes tables of the lines too.
    """
    tail = tail_session_logs(spark, logs, suffix=suffix, max_bytes_per_trigger=0 if once else max_bytes_per_trigger, state=state or f"{to}/tail")
    w = tail.writeStream.format("parquet").option("checkpointLocation", f"{to}/checkpoint")
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start(f"{to}/lines")


def followed_lines(spark: SparkSession, to: str) -> DataFrame:
    """The lines of all batches that are committed below ``to``; none if none was."""
    try:
        return spark.read.schema(SCHEMA).parquet(f"{to}/lines")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def sync_report(listed: DataFrame, bronze: DataFrame, rejected: DataFrame, observations: DataFrame) -> DataFrame:
    """For each file of ``listed`` (path): its state (synced, skipped: nothing new, errored: can't be opened), records, warnings, overflow fields."""
    lines = bronze.groupBy("path").agg(F.count_if(F.col("off") >= 0).alias("lines"), F.count_if(F.col("off") < 0).alias("unopened"))
    bad = rejected.groupBy("path").agg(F.count("*").alias("warnings"))
    drift = observations.groupBy("path").agg(F.count("*").alias("overflow_fields"))
    out = listed.select("path").join(lines, "path", "left").join(bad, "path", "left").join(drift, "path", "left").fillna(0, ["lines", "unopened", "warnings", "overflow_fields"])
    state = F.when(F.col("unopened") > 0, "errored").when(F.col("lines") > 0, "synced").otherwise("skipped")
    return out.select("path", state.alias("state"), (F.col("lines") - F.col("warnings")).alias("records"), "warnings", "overflow_fields")


def counted() -> list[Column]:
    """The aggregates of ``sync_totals``, also for an ``Observation`` of the job that makes the report."""
    files = [F.count("*").alias("files_discovered"), *[F.count_if(F.col("state") == s).alias(f"files_{s}") for s in ("synced", "skipped", "errored")]]
    return files + [F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in ("records", "warnings", "overflow_fields")]


def sync_totals(report: DataFrame) -> DataFrame:
    """One row: files discovered, synced, skipped and errored, and the sums of what they gave."""
    return report.agg(*counted())


#: Parts of the stored bronze table, whatever the number of files.
BUCKETS = 256


def _bucketed(bronze: DataFrame) -> DataFrame:
    return bronze.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int"))


def write_bronze(bronze: DataFrame, path: str) -> None:
    """Store lines in parts by a hash of their file; parts that ``bronze`` has no file of stay as they are."""
    # a file a bucket, and not one for each bucket and task
    _bucketed(bronze).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def reingest(spark: SparkSession, files: list[str], bronze_path: str, *, suffix: str = ".jsonl") -> None:
    """Read the chosen files anew and replace their lines, and no others, in the stored bronze table."""
    chosen = spark.createDataFrame([(f,) for f in files], "path string")  # as many rows as files are named
    parts = [r[0] for r in _bucketed(chosen).select("bucket").distinct().collect()]
    stored = spark.read.parquet(bronze_path).filter(F.col("bucket").isin(parts)).drop("bucket")
    # the new parts are written beside the old ones and take their places when all are done
    write_bronze(stored.join(chosen, "path", "left_anti").unionByName(read_session_logs(spark, files, suffix=suffix).filter("off >= 0")), bronze_path)
