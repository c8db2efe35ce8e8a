"""Files of token ids: a data source that writes and reads them.

``write`` deals documents into ranges of their ids; a task writes one file of its range in order:

    magic | words (64 bits, little-endian) | first word of each block | document index | tail | magic

Ids are packed by ``simple8b`` without regard to documents.  The index is an Arrow stream of each
document's id and number of ids; the tail says where things stand.  Blocks are coded as they fill, so
a task holds about a million ids, one document, and the index of its file.  The driver puts what the tasks
tell of their files into ``_manifest.json``, in one step when all are done: readers see the files it names, so tries
that failed or ran twice leave nothing behind that counts.  A file gives back (id, start, n_tokens, ids): ``start`` counts the ids of all
documents before, ``ids`` are little-endian unsigned 32-bit numbers.  The path must be one that pyarrow opens on driver and executors.

Nulls: a null text is empty; documents without an id come first.  Rows that repeat an id stand by a digest of their texts, equal ones
as they come.  An empty table gives a manifest of no files.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..functions.ship import ship
from . import simple8b
from .bpe import encoder
from .common import pieces_of, release, slices, text_bytes

MAGIC = b"IDS8B\x00\x00\x01"
#: Words, first words, index: where they begin; documents, ids, ids in a block.
TAIL = struct.Struct("<QQQQQQ")
MANIFEST = "_manifest.json"
#: Ids that are coded at once.
HELD = 1 << 20
#: Bytes of text for a file.
FILE_BYTES = 64 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_manifest(path: str) -> dict | None:
    system, at = _open(path)
    if system.get_file_info(f"{at}/{MANIFEST}").type != fs.FileType.File:
        return None
    with system.open_input_file(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


class FileWriter:
    """One file: ids go in document by document; what is left of a block waits for more."""

    def __init__(self, to, id_type: pa.DataType, block: int = simple8b.BLOCK):
        self.to, self.id_type, self.block = to, id_type, block
        self.docs: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.held: list[np.ndarray] = []
        self.firsts: list[np.ndarray] = []
        self.waiting = self.n_ids = self.n_words = 0
        to.write(MAGIC)

    def put(self, docs: pa.Array, ids: list[bytes]) -> None:
        self.docs.append(docs)
        self.lengths.append(np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids)))
        own = np.frombuffer(b"".join(ids), "<u4")
        self.held.append(own)
        self.waiting += len(own)
        self.n_ids += len(own)
        if self.waiting >= HELD:
            self._code(self.waiting - self.waiting % self.block)

    def _code(self, n: int) -> None:
        own = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        self.held, self.waiting = [own[n:].copy()], len(own) - n
        for lo in range(0, n, HELD // self.block * self.block):
            words, first = simple8b.encode(own[lo : min(n, lo + HELD // self.block * self.block)], self.block)
            self.to.write(words.astype("<u8").tobytes())
            self.firsts.append(first + self.n_words)
            self.n_words += len(words)

    def close(self) -> tuple[int, int]:
        self._code(self.waiting)
        lengths = np.concatenate([np.zeros(0, np.int64), *self.lengths])
        firsts = np.concatenate([np.zeros(0, np.int64), *self.firsts])
        at = len(MAGIC) + 8 * self.n_words
        self.to.write(firsts.astype("<u8").tobytes())
        index = pa.table({"id": pa.chunked_array(self.docs, self.id_type), "n": lengths})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as s:
            s.write_table(index, max_chunksize=1 << 16)
        self.to.write(sink.getvalue())
        self.to.write(TAIL.pack(len(MAGIC), at, at + 8 * len(firsts), len(lengths), self.n_ids, self.block) + MAGIC)
        return len(lengths), self.n_ids


def read_file(f, base: int, name: str = "id") -> Iterator[pa.RecordBatch]:
    """A file's documents: id, start (``base`` is that of its first), n_tokens, ids."""
    size, end = f.size(), TAIL.size + len(MAGIC)
    f.seek(0)
    if size < end + len(MAGIC) or f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of token ids")
    f.seek(size - end)
    tail = f.read(end)
    if tail[TAIL.size :] != MAGIC:
        raise ValueError("a file of token ids that was not ended")
    words_at, firsts_at, index_at, n_docs, n_ids, block = TAIL.unpack(tail[: TAIL.size])
    f.seek(firsts_at)
    firsts = np.frombuffer(f.read(index_at - firsts_at), "<u8").astype(np.int64)
    index = pa.ipc.open_stream(f.read(size - end - index_at)).read_all().combine_chunks()
    docs, lengths = index.column("id").combine_chunks(), index.column("n").to_numpy()
    ends, n_words = np.cumsum(lengths), (firsts_at - words_at) // 8
    bounds, many = np.append(firsts, n_words), HELD // block
    held, have, done, doc = [], 0, 0, 0  # ids decoded and not given yet; ids before them; documents given
    for b in range(0, max(1, len(firsts)), many):
        lo, hi = (int(bounds[b]), int(bounds[min(b + many, len(firsts))])) if len(firsts) else (0, 0)
        f.seek(words_at + 8 * lo)
        words = np.frombuffer(f.read(8 * (hi - lo)), "<u8")
        ids = simple8b.decode(words, firsts[b : b + many] - lo, min(n_ids, (b + many) * block) - b * block, block)
        held.append(ids)
        have += len(ids)
        upto = int(np.searchsorted(ends, done + have, side="right"))
        if upto == doc:
            continue
        own = np.concatenate(held)
        # whole documents go out, the rest waits
        at = np.concatenate(([done], ends[doc:upto])) - done
        for i in range(0, upto - doc, 4096):
            j = min(upto - doc, i + 4096)
            offsets = ((at[i : j + 1] - at[i]) * 4).astype(np.int64)
            data = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(own[at[i] : at[j]].astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays([docs.slice(doc + i, j - i), pa.array(base + done + at[i:j], pa.int64()), pa.array(lengths[doc + i : doc + j], pa.int64()), data.cast(pa.binary())], names=[name, "start", "n_tokens", "ids"])
        held, have, done, doc = [own[at[-1] :].copy()], have - int(at[-1]), done + int(at[-1]), upto


@dataclass
class Written(WriterCommitMessage):
    part: int
    file: str
    n_docs: int
    n_ids: int


class Writer(DataSourceArrowWriter):
    """Rows (id, text) with a tokenizer, or (id, ids) without."""

    def __init__(self, options, schema: StructType, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.tokenizer, self.end_id = options.get("tokenizer"), options.get("endId")
        self.kind, self.name = schema[0].dataType.json(), schema[0].name

    def write(self, iterator):
        tail = b"" if self.end_id is None else int(self.end_id).to_bytes(4, "little")
        part, name, out = TaskContext.get().partitionId(), f"part-{uuid.uuid4().hex}.ids", None
        system, at = _open(self.path)
        for batch in iterator:
            for rows in slices(batch, batch.schema.names[1]):
                if out is None:
                    system.create_dir(at, recursive=True)
                    to = system.open_output_stream(f"{at}/{name}")
                    out = FileWriter(to, rows.schema.types[0])
                own = rows.column(1).to_pylist()
                ids = encoder(self.tokenizer).encode([x or "" for x in own]) if self.tokenizer else [x or b"" for x in own]
                out.put(rows.column(0), [x + tail for x in ids])
        if out is None:
            return Written(part, "", 0, 0)
        n_docs, n_ids = out.close()
        to.close()
        release()
        return Written(part, name, n_docs, n_ids)

    def commit(self, messages):
        old = None if self.overwrite else read_manifest(self.path)
        found = sorted((m for m in messages if m and m.file), key=lambda m: m.part)
        files = (old["files"] if old else []) + [[m.file, m.n_docs, m.n_ids] for m in found]
        system, at = _open(self.path)
        system.create_dir(at, recursive=True)
        beside = f"{at}/.{uuid.uuid4().hex}"
        with system.open_output_stream(beside) as f:
            f.write(json.dumps({"id": [self.name, self.kind], "files": files}).encode())
        system.move(beside, f"{at}/{MANIFEST}")

    def abort(self, messages):
        system, at = _open(self.path)
        for m in messages:
            if m and m.file:
                system.delete_file(f"{at}/{m.file}")


@dataclass
class OneFile(InputPartition):
    path: str
    base: int
    name: str


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        out, base, found = [], 0, read_manifest(self.path)
        for file, _, n_ids in found["files"]:
            out.append(OneFile(f"{self.path}/{file}", base, found["id"][0]))
            base += n_ids
        return out or [OneFile("", 0, "")]

    def read(self, partition):
        if partition.path:
            system, at = _open(partition.path)
            with system.open_input_file(at) as f:
                yield from read_file(f, partition.base, partition.name)
            release()


class TokenIds(DataSource):
    @classmethod
    def name(cls):
        return "token_ids"

    def schema(self):
        from pyspark.sql.types import _parse_datatype_json_string

        found = read_manifest(self.options["path"].rstrip("/"))
        if found is None:
            raise ValueError(f"no token ids at {self.options['path']}")
        name, kind = found["id"]
        return StructType([StructField(name, _parse_datatype_json_string(kind)), StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("ids", BinaryType())])

    def reader(self, schema):
        return Reader(self.options["path"].rstrip("/"))

    def writer(self, schema, overwrite):
        return Writer(self.options, schema, overwrite)


def write(docs: DataFrame, path: str, tokenizer_path: str | None = None, *, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """The ids of all documents in files under ``path``, in ascending order of document ids; what is there is replaced.

    ``text_col`` holds texts for the tokenizer or, without one, ids as little-endian unsigned 32-bit bytes.
    """
    spark = docs.sparkSession
    ship(spark)
    spark.dataSource.register(TokenIds)
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text" if tokenizer_path else "ids"))
    content = rows.columns[1]
    # many rows of one id are dealt by their contents too, and equal rows by where they come from
    order = [F.col(id_col), F.xxhash64(content), F.monotonically_increasing_id()]
    ranged = rows.repartitionByRange(pieces_of(text_bytes(rows, content), file_bytes), *order).sortWithinPartitions(id_col, F.xxhash64(content))
    out = ranged.write.format("token_ids").mode("overwrite")
    for k, v in {"tokenizer": tokenizer_path, "endId": end_id}.items():
        if v is not None:
            out = out.option(k, str(v))
    out.save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """id, start, n_tokens, ids of each document."""
    ship(spark)
    spark.dataSource.register(TokenIds)
    return spark.read.format("token_ids").load(path)
