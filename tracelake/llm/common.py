"""What the operators share: stable intermediate tables, and words as numbers.

The words of a text are held at once, at about 10 bytes of memory for a byte of the longest text of a task.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import delete, shared_dir

_WRITTEN: dict[int, tuple[DataFrame, str]] = {}
_OWNED: list[list[DataFrame]] = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[id(back)] = (back, path)
    if _OWNED:
        _OWNED[-1].append(back)
    return back


@contextlib.contextmanager
def written_tables():
    """What operators write inside goes at the end, but for what they have discarded themselves and for what ``keep`` (the value) is
    given: that outlives the block, as its result."""
    own: list[DataFrame] = []
    _OWNED.append(own)

    def keep(df: DataFrame, tag: str) -> DataFrame:
        kept = materialize(df, tag)
        own.remove(kept)
        if len(_OWNED) > 1:
            _OWNED[-2].append(kept)
        return kept

    try:
        yield keep
    finally:
        _OWNED.pop()
        discard(*[t for t in own if id(t) in _WRITTEN])


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing is read from any more."""
    for t in tables:
        _, path = _WRITTEN.pop(id(t))
        delete(t.sparkSession, path)


def bit_table(values: DataFrame, column: str, most: int = 27) -> tuple[DataFrame, int]:
    """A bit table of 64-bit numbers for ``may_hold``: 2**most bits (16 MB) at most."""
    bits = 1 << min(most, max(15, (16 * values.count()).bit_length()))
    place = F.pmod(F.col(column), F.lit(bits)) + 1
    return values.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")), bits


def may_hold(rows: DataFrame, column: str, table: DataFrame, bits: int) -> DataFrame:
    """The rows whose number is in the table, and a few more."""
    place = F.pmod(F.col(column), F.lit(bits)) + 1
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    met = rows.withColumns({"bucket": F.bitmap_bucket_number(place), "at": F.bitmap_bit_position(place)}).join(F.broadcast(table), "bucket")
    return met.filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(at % 8 as int))")) != 0).select(*rows.columns)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def pieces_of(total: int, each: int) -> int:
    return max(1, -(-total // each))


def release() -> None:
    """Give back to the system what freed arrays have left with the process's allocators."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def released(run: Callable) -> Callable:
    """A task's function over batches that gives its memory back at its end: Spark keeps workers for the tasks to come."""

    def then(batches):
        yield from run(batches)
        release()

    return then


def released_group(run: Callable) -> Callable:
    """The same for a function over one group."""

    def then(group):
        out = run(group)
        release()
        return out

    return then


# ---------------------------------------------------------------- words as 64-bit numbers

_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)
_BLOCK = 1 << 18
#: Longer words have a name by ``xxhash``: sums modulo 2**64 of two words of 1,024 letters may be equal whatever the base.
_LONG_WORD = 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i < n at least."""
    size = 1 << max(12, int(n).bit_length())
    have = max(_POWERS, default=0)
    if have < size:
        _POWERS.clear()
        both = []
        for base in (_R, _R_INV):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            both.append(np.cumprod(a, dtype=np.uint64))
        _POWERS[size] = (both[0], both[1])
        have = size
    return _POWERS[have]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def byte_classes(separators: bytes, lower: bool) -> np.ndarray:
    """For each byte its value in a word, 0 for a separator; A-Z as a-z if ``lower``."""
    t = np.arange(1, 257, dtype=np.uint16)
    if lower:
        t[65:91] += 32
    t[np.frombuffer(separators, dtype=np.uint8)] = 0
    return t


#: The two kinds of words, by their separators.
SPACES = b" \t\n\x0b\x0c\r"
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
SPACED = byte_classes(SPACES, lower=False)
SPACED_LOWER = byte_classes(SPACES, lower=True)
ALNUM_LOWER = byte_classes(bytes(set(NOT_ALNUM) - set(range(65, 91))), lower=True)


@dataclass
class Words:
    """Words of some texts in one byte buffer; text i has words ``first[i]`` up to ``first[i + 1]``."""

    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each text begins (and the last ends). Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def spans(data: np.ndarray, text_at: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all texts start and end, never across texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = (classes != 0)[data]
    cut = np.zeros(n + 1, bool)
    cut[text_at] = True
    begins, ends = inside.copy(), inside
    begins[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A fingerprint of each word, the same wherever the word stands: a polynomial of short ones, ``xxh3_64`` of long ones."""
    out = np.empty(len(start), np.uint64)
    values, table = classes.astype(np.uint64), (classes - 1).astype(np.uint8).tobytes()
    long = end - start > _LONG_WORD
    short = np.flatnonzero(~long)
    ends, i = end[short], 0
    while i < len(short):
        lo = int(start[short[i]])
        j = max(i + 1, int(np.searchsorted(ends, lo + _BLOCK, side="right")))
        own = short[i:j]
        hi = int(ends[j - 1])
        up, down = powers(hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = start[own] - lo, end[own] - lo
        out[own] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    for k in np.flatnonzero(long).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes().translate(table))
    return mix(out)


def words(texts: pa.Array, classes: np.ndarray) -> Words:
    data, at = buffers(texts)
    start, end = spans(data, at, classes)
    return Words(data, at, start, end, np.searchsorted(start, at), hash_words(data, start, end, classes))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of each n consecutive numbers, at its first; len(h) - n + 1 of them."""
    out = np.empty(max(0, len(h) - n + 1), np.uint64)
    for lo in range(0, len(out), _BLOCK):  # a name doesn't depend on where the numbers stand, so long texts go by blocks
        own = h[lo : lo + _BLOCK + n - 1]
        up, down = powers(len(own))
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(own * up[: len(own)], out=total[1:])
        out[lo : lo + _BLOCK] = mix((total[n:] - total[:-n]) * down[: len(own) - n + 1] + np.uint64(n))
    return out


def shingle_sets(w: Words, n: int) -> list[np.ndarray]:
    """Each text's distinct n-word shingles as sorted numbers; fewer words count as one shingle, none as the empty set."""
    grams = ngrams(w.hash, n)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(ngrams(w.hash[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with ``most`` bytes of text at most, or one row."""
    _, at = buffers(batch.column(batch.schema.get_field_index(text)))
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = min(j, n)


def gathered(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a task in batches of about ``most`` bytes of text, however Arrow cut them."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, text, most // 4):
            _, at = buffers(part.column(part.schema.get_field_index(text)))
            held.append(part)
            size += int(at[-1])
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()[:1]


def pack_columns(*columns: np.ndarray) -> bytes:
    """Columns of one length; bytes of equal rank side by side, for the compression."""
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack_columns(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), [], 0
    for k in kinds:
        w = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(raw[at : at + w * n].reshape(w, n).T).view(k).ravel())
        at += w * n
    return out
