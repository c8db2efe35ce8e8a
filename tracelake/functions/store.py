"""Tables that change as a whole: versions of a small manifest name what is live, and one rename makes a version the latest.

A version is a JSON file ``versions/<n>.json``.  Whatever a batch writes goes to new folders, which no reader looks into until
the version that names them is there; a batch that stopped half-way leaves the version before it as it was, and is run again.

Two kinds of tables live side by side.  *Bucketed* ones are kept by a hash of their session: a batch writes the buckets of its
sessions anew, and the manifest has for each bucket the number of the batch that wrote it last.  *Runs* are aggregates that can be
merged, and keys: a batch adds a run of its own, and of ``FAN`` runs of one size one of the next size is made, so that a store of n batches has
O(log n) runs.  The manifest is bounded by the number of buckets and by that of runs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import delete

#: Runs of one size that become one.
FAN = 8
#: Buckets of sessions.  A batch writes those of its sessions whole: take so many that one has some hundred MB.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer made the version first."""


@dataclass
class State:
    """What is live: the last batch, each bucket's batch, each run table's runs (name, size class), what the writers remember."""

    number: int = 0
    batch: int = -1
    buckets: dict[str, int] = field(default_factory=dict)
    runs: dict[str, list] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ versions

    def _versions(self) -> list[int]:
        at = self._path(f"{self.root}/versions")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def state(self) -> State:
        """The latest version."""
        numbers = self._versions()
        if not numbers:
            return State()
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        stream = self._fs.open(self._path(f"{self.root}/versions/{numbers[-1]}.json"))
        try:
            return State(**json.loads(text.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def commit(self, state: State) -> State:
        """Make ``state`` the version after the one it was made from, in one step; the version before stays for those who read it."""
        new = State(state.number + 1, state.batch, dict(state.buckets), {k: list(v) for k, v in state.runs.items()}, dict(state.notes))
        beside, to = self._path(f"{self.root}/versions/.{uuid.uuid4().hex}"), self._path(f"{self.root}/versions/{new.number}.json")
        out = self._fs.create(beside, False)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(beside, to):
            self._fs.delete(beside, False)
            raise Conflict(f"version {new.number} is there")
        for n in self._versions():
            if n < new.number - 1:
                self._fs.delete(self._path(f"{self.root}/versions/{n}.json"), False)
        return new

    # ------------------------------------------------------------ tables

    def read(self, path: str, schema: str) -> DataFrame:
        """What is stored below ``path``; no rows if there is nothing."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{path}").select(*StructType.fromDDL(schema).names)  # folders below add columns
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, path: str, *by: str) -> None:
        """The one way by which anything is written."""
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.root}/{path}")

    def drop(self, path: str) -> None:
        delete(self.spark, f"{self.root}/{path}")

    def bucketed(self, state: State, name: str, schema: str, only: list[int] | None = None) -> DataFrame:
        """The live rows of a bucketed table, or those of some buckets."""
        by_version: dict[int, list[int]] = {}
        for b, v in state.buckets.items():
            if only is None or int(b) in only:
                by_version.setdefault(v, []).append(int(b))
        live = F.lit(False)
        for v, buckets in by_version.items():
            live = live | ((F.col("made") == v) & F.col("bucket").isin(buckets))
        # both are folders: what is not live is not opened
        return self.read(f"silver/{name}", f"{schema}, made bigint, bucket int").filter(live).drop("made", "bucket")

    def write_buckets(self, df: DataFrame, name: str, version: int, together: bool = False) -> None:
        """``df`` with its ``bucket`` as what a batch makes of the buckets it touches; ``together``: its tasks hold rows of few buckets already."""
        self.write(df if together else df.repartition("bucket"), f"silver/{name}/made={version}", "bucket")

    def retire(self, before: State, new: State, paths: list[str], tables: list[str]) -> None:
        """Note in ``new`` what it no longer names: it goes when the version after it is there, for until then somebody may read ``before``."""
        old = [[v, int(b)] for b, v in before.buckets.items() if new.buckets.get(b) != v]
        new.notes.update(going=before.notes.get("gone", {}), gone={"paths": paths, "buckets": old, "tables": tables})

    def sweep(self, state: State) -> None:
        """Remove what neither the version nor the one before it names.  May be done again."""
        going = state.notes.get("going", {})
        for path in going.get("paths", []):
            self.drop(path)
        for v, b in going.get("buckets", []):
            for t in going["tables"]:
                self.drop(f"silver/{t}/made={v}/bucket={b}")

    def run(self, state: State, name: str, schema: str) -> DataFrame:
        """The rows of all live runs of a table."""
        out = self.spark.createDataFrame([], schema)
        for r, _ in state.runs.get(name, []):
            out = out.unionByName(self.read(f"runs/{name}/{r}", schema))
        return out

    def add_run(self, state: State, df: DataFrame, name: str, schema: str, fold: Callable[[DataFrame], DataFrame], batch_id: int, by: tuple[str, ...] = ()) -> tuple[str, list[str]]:
        """Add a run to ``state``, merging where there are many of one size.  Returns the run that holds ``df`` then, and those that no longer count."""
        gone, level, own = [], 0, f"{batch_id}-0"
        runs = [r for r in state.runs.get(name, []) if r[0] != own]
        self.write(fold(df), f"runs/{name}/{own}", *by)
        runs.append([own, 0])
        while len(same := [r for r in runs if r[1] == level]) >= FAN:
            own = f"{batch_id}-{level + 1}"
            old = self.run(State(runs={name: same}), name, schema)
            self.write(fold(old), f"runs/{name}/{own}", *by)
            gone += [r for r, _ in same]
            runs = [r for r in runs if r[1] != level] + [[own, level + 1]]
            level += 1
        state.runs[name] = runs
        return own, gone


# ---------------------------------------------------------------- keys

#: Bits of a filter for each key, bits that a key sets, bits of one row of a filter (Spark's bitmaps).
KEY_BITS, KEY_HASHES, ROW_BITS = 24, 8, 32_768
KEYS = "kind string, key string, home int"


def _rows(n: int) -> int:
    return max(1, -(-n * KEY_BITS // ROW_BITS))


def _places(rows: Column) -> list[Column]:
    """The row of a key's filter, and its bits there."""
    a, b = F.xxhash64("kind", "key"), F.xxhash64("key", "kind")
    first, step = F.pmod(b, F.lit(ROW_BITS)), F.pmod(F.shiftrightunsigned(b, 20), F.lit(ROW_BITS // 2)) * 2 + 1
    return [F.pmod(a, rows).cast("long"), *[F.pmod(first + i * step, F.lit(ROW_BITS)) for i in range(KEY_HASHES)]]


@dataclass
class Keys:
    """Keys that were seen, by kind, each with its home.  A run lies in parts by hash, and has a Bloom filter in rows of 4 KB: a look-up
    opens the parts of those runs alone that may hold one of its keys."""

    store: Store
    parts: int = 16

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.parts)).cast("int")

    def add(self, state: State, keys: DataFrame, batch_id: int) -> list[str]:
        def lay(df: DataFrame) -> DataFrame:
            return df.groupBy("kind", "key").agg(F.min("home").alias("home")).withColumn("part", self._part()).repartition("part")

        run, gone = self.store.add_run(state, keys, "keys", KEYS, lay, batch_id, ("part",))
        stored = self.store.read(f"runs/keys/{run}", KEYS)
        rows = _rows(stored.count())
        row, *bits = _places(F.lit(rows))
        table = stored.select(row.alias("row"), F.explode(F.array(*bits)).alias("bit")).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))
        self.store.write(table.withColumn("rows", F.lit(rows).cast("long")), f"runs/filters/{run}")
        return [*(f"runs/keys/{r}" for r in gone), *(f"runs/filters/{r}" for r in gone)]

    def opened(self, state: State, keys: DataFrame) -> dict[str, list[int]]:
        """For each run the parts that may hold one of the keys."""
        found = {}
        held = "forall(places, x -> (cast(conv(hex(substring(bits, cast(x div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(x % 8 as int))) != 0)"
        for run, _ in state.runs.get("keys", []):
            table = self.store.read(f"runs/filters/{run}", "row bigint, bits binary, rows bigint")
            some = table.first()
            if some is None:
                continue
            row, *bits = _places(F.lit(some["rows"]))
            met = keys.select(self._part().alias("part"), row.alias("row"), F.array(*bits).alias("places")).join(table, "row").filter(held)
            parts = [r["part"] for r in met.select("part").distinct().collect()]  # the parts of a run at most
            if parts:
                found[run] = sorted(parts)
        return found

    def seen(self, state: State, keys: DataFrame) -> DataFrame:
        """kind, key, home of those of ``keys`` (kind, key, written) that are stored."""
        out = self.store.spark.createDataFrame([], KEYS)
        for run, parts in self.opened(state, keys).items():
            stored = self.store.read(f"runs/keys/{run}", f"{KEYS}, part int").filter(F.col("part").isin(parts)).drop("part")
            out = out.unionByName(stored.join(keys.select("kind", "key").distinct(), ["kind", "key"], "left_semi"))
        return out
