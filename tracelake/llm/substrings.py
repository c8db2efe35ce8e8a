"""Substring dedup by recompression.

Each document is a string of words.  A round names runs of equal symbols and pairs (a symbol
whose coin is 0 before one whose coin is 1) by fingerprints of what they spell, which are the
same all over the corpus without a table of names; a gap between two symbols that no name
spans goes on to the next round.  Whether a gap lasts depends only on the symbols beside it,
so equal substrings have equal interior gaps.  Each window of ``window`` words is known by
the gap in it that lasts longest, as far as the window's own words decide it, and of these
by the one with the smallest name: equal windows name equal gaps.  The gap's name is that of
the two symbols of the latest round beside it, which lie inside the window; what is left of the
window on either side is its fringe.  Gaps of one name meet in one bucket: that exchange is the
round that is global.  Two windows are equal if the symbols about their gaps have one name, the
gaps stand at one distance and the fringes have one name: the symbols decide the interior, and
no window is compared as a whole.

A task sends each different window once, and of windows that go on recurring in it only the
first: a passage that many documents share costs a bucket a few entries for each task.  Nothing
else leaves: no text is sent until the end, when each document meets its repeated windows.

Nulls: a null text has no words; a row without an id is ordered behind all ids.  Ids of any type
that can be ordered go by that order (others than whole numbers are numbered first).  Rows that
share an id are told apart by their texts; of two equal rows neither is earlier.  An empty
table gives no rows.  Extra columns are ignored (``removed``) or kept (``remove``), whatever
their names; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import free_name
from ..functions.ship import ship
from .common import SPACED, gathered, materialize, mix, ngrams, pack_columns, pieces_of, powers, released, released_group, slices, spans, text_bytes, unpack_columns, words

_LEVELS = 3
_FAR = 120
_NO_ID = (1 << 63) - 1


def _gaps(h: np.ndarray, doc: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For each round the gaps that last (gap g is behind word g), their names, how many words to the left and right decide that,
    and where the symbols on both sides begin and end."""
    n = len(h)
    end = np.flatnonzero(np.concatenate((doc[1:] != doc[:-1], [True])))
    at, names = np.arange(n), h  # each word is a symbol that ends at its own gap
    lo, hi = np.arange(n), np.arange(n) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=total[1:])
    is_end = np.zeros(n, bool)
    is_end[end] = True
    out = []
    for level in range(1, _LEVELS + 1):
        a, b = names[:-1], names[1:]
        coin = (mix(names + np.uint64(level)) & np.uint64(1)).astype(bool)
        stays = np.ones(len(at), bool)
        stays[:-1] = (a != b) & (coin[:-1] | ~coin[1:])
        stays |= is_end[at]
        inner = np.flatnonzero(stays[:-1] & ~is_end[at[:-1]])
        name = mix(names[inner] * np.uint64(3) + mix(names[inner + 1] + np.uint64(level)))
        if level == 1:
            own_lo, own_hi = at[inner], at[inner] + 1
        else:
            # both symbols must be seen whole: up to the gaps on their far sides, and what decides these
            before = np.where(inner > 0, lo[np.maximum(inner - 1, 0)], -_FAR)
            own_lo, own_hi = before, hi[inner + 1]
        out.append((at[inner], name, np.minimum(at[inner] - own_lo, _FAR).astype(np.int8), np.minimum(own_hi - at[inner], _FAR).astype(np.int8), np.where(inner > 0, at[inner - 1] + 1, 0), at[inner + 1] + 1))
        # the symbols of the next round, and what decides their gaps
        kept = np.flatnonzero(stays)
        decide_lo, decide_hi = np.full(len(at), -(1 << 40)), np.full(len(at), 1 << 40)
        decide_lo[inner], decide_hi[inner] = own_lo, own_hi
        at, lo, hi = at[kept], decide_lo[kept], decide_hi[kept]
        begin = np.concatenate(([0], at[:-1] + 1))
        names = mix((total[at + 1] - total[begin]) * down[begin] + (at + 1 - begin).astype(np.uint64))
    return out


def anchors(h: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window inside one document: its start, its gap's distance from the start, the gap's name, and its fringe's."""
    n = len(h) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    rounds = _gaps(h, doc)
    start = np.flatnonzero(doc[:n] == doc[window - 1 :])
    best = np.full(len(start), np.iinfo(np.uint64).max, np.uint64)
    most, low = np.iinfo(np.uint64).max, np.uint64(31)
    todo = np.arange(len(start))
    before, behind = start.copy(), start.copy()  # where the symbols about the gap begin and end
    for level in range(_LEVELS, 0, -1):
        gap, name, left, right, begin, end = rounds[level - 1]
        key = np.full(len(h), most, np.uint64)
        key[gap] = (name & ~low) - np.uint64(32) * (name > most - np.uint64(64))
        need_l, need_r = np.full(len(h), 127, np.int8), np.full(len(h), 127, np.int8)
        need_l[gap], need_r[gap] = left, right
        s, found = start[todo], best[todo]
        whole = len(s) == n
        for d in range(window - 1):
            where = slice(d, n + d) if whole else s + d
            fits = (need_l[where] <= d) & (need_r[where] <= window - 1 - d)
            np.minimum(found, np.where(fits, key[where] | np.uint64(d), most), out=found)
        best[todo] = found
        has = found != most
        at = np.searchsorted(gap, s[has] + (found[has] & low).astype(np.int64))
        before[todo[has]], behind[todo[has]] = begin[at], end[at]
        todo = todo[~has]
        if not len(todo):
            break
    distance = (best & low).astype(np.int64)
    name = mix(best & ~low)
    up, down = powers(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])

    def spelled(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))

    # a window all in one run or pair has no gap inside: it is all fringe
    lone = best == most
    distance[lone] = 0
    last = start + window
    fringe = mix(spelled(start, before) * np.uint64(3) + spelled(behind, last))
    name[lone] = mix(fringe[lone])
    return start, distance, name, fringe


def _runs(doc: np.ndarray, mark: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive starts as runs: doc, mark, first start, how many."""
    order = np.lexsort((start, mark, doc))
    doc, mark, start = doc[order], mark[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(doc)])) - 1
    return doc[first], mark[first], start[first], start[last] - start[first] + 1


def _marks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The CRC-32 of each text."""
    raw = data.tobytes()
    return np.array([zlib.crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], np.uint32)


@dataclass
class Recurring:
    """Windows that a task has met again, with the first place of each that was sent; those met last, at most ``most``.

    Without them a passage that stands all over the corpus would be sent for every batch.  Forgetting one costs an entry more.
    """

    most: int = 1 << 17
    cells: int = 1 << 22
    table: np.ndarray = field(default_factory=lambda: np.zeros(0, [("whole", "u8"), ("name", "u8"), ("fringe", "u8"), ("id", "i8"), ("at", "i8"), ("met", "i8")]))
    batch: int = 0
    filled: int = 0

    def __post_init__(self):
        self.met = np.zeros(self.cells, bool)

    def judge(self, heads: np.ndarray, again: np.ndarray) -> np.ndarray:
        """Which of a batch's different windows (each at its first place) were sent from an earlier place; ``again``: it recurs in the batch."""
        self.batch += 1
        heads["met"] = self.batch
        have = self.table
        at = np.minimum(np.searchsorted(have["whole"], heads["whole"]), max(len(have) - 1, 0))
        known = np.zeros(len(heads), bool)
        if len(have):
            known = np.all([have[c][at] == heads[c] for c in ("whole", "name", "fringe")], axis=0)
        old = have[at[known]]
        earlier = np.zeros(len(heads), bool)
        earlier[known] = (old["id"] < heads["id"][known]) | ((old["id"] == heads["id"][known]) & (old["at"] < heads["at"][known]))
        heads["id"][earlier], heads["at"][earlier] = (have[c][at[earlier]] for c in ("id", "at"))
        cell = (heads["whole"] % np.uint64(self.cells)).astype(np.int64)
        keep = known | again | self.met[cell]
        if self.filled > self.cells // 4:
            self.met[:], self.filled = False, 0
        self.met[cell] = True
        self.filled += len(cell)
        stay = np.ones(len(have), bool)
        stay[at[known]] = False
        table = np.concatenate((have[stay], heads[keep]))
        if len(table) > self.most:
            table = table[np.argsort(-table["met"], kind="stable")[: self.most]]
        self.table = table[np.argsort(table["whole"], kind="stable")]
        return earlier


def _sender(window: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recurring = Recurring()
        for batch in gathered(batches, most=2 << 20):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            ids, texts = ids[order], batch.column(1).take(pa.array(order))
            w = words(texts, SPACED)
            doc, marks = w.doc_of(), _marks(w.data, w.text_at)
            start, distance, name, fringe = anchors(w.hash, doc, window)
            if not len(start):
                continue
            own = start - w.first[doc[start]]
            # of equal windows here, all but the first are repeats for certain and only the first is sent
            whole, symbols = mix(name + distance.astype(np.uint64)) ^ fringe, name + distance.astype(np.uint64)
            by = np.argsort(whole, kind="stable")
            same = np.concatenate(([False], np.all([x[by][1:] == x[by][:-1] for x in (whole, symbols, fringe)], axis=0)))
            head = np.flatnonzero(~same)
            of = np.cumsum(~same) - 1
            first = by[head]
            found = np.empty(len(head), recurring.table.dtype)
            found["whole"], found["name"], found["fringe"], found["id"], found["at"] = whole[first], symbols[first], fringe[first], ids[doc[start[first]]], own[first]
            before = recurring.judge(found, np.diff(np.append(head, len(by))) > 1)
            # rows of one id and start are not earlier than each other: send both
            tie = (ids[doc[start[by]]] == ids[doc[start[first[of]]]]) & (own[by] == own[first[of]])
            repeat = np.zeros(len(start), bool)
            repeat[by[(same & ~tie) | before[of]]] = True
            rows: list[tuple[int, bytes, bytes]] = []
            if repeat.any():
                d = doc[start[repeat]]
                runs = _runs(ids[d], marks[d], own[repeat])
                rows.append((int(whole[0] % np.uint64(buckets)), b"", _run_lot(*runs)))
            keep = np.flatnonzero(~repeat)
            start, distance, name, fringe = start[keep], distance[keep], name[keep], fringe[keep]
            gap = start + distance
            bucket = (name % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((start, name, gap, bucket))
            bucket, gap, name, distance, fringe = bucket[order], gap[order], name[order], distance[order], fringe[order]
            new = np.ones(len(gap), bool)
            new[1:] = (gap[1:] != gap[:-1]) | (name[1:] != name[:-1])
            first = np.flatnonzero(new)
            mask = np.bitwise_or.reduceat(np.left_shift(1, distance), first).astype("<u4") if len(first) else np.zeros(0, "<u4")
            d = doc[gap[first]]
            place = gap[first] - w.first[d]
            cuts = np.searchsorted(bucket[first], np.arange(buckets + 1))
            for b in np.unique(bucket).tolist():
                lo, hi = int(cuts[b]), int(cuts[b + 1])
                w_lo, w_hi = int(first[lo]), int(first[hi]) if hi < len(first) else len(fringe)
                step = np.diff(ids[d[lo:hi]], prepend=0)
                body = pack_columns(step.astype("<i8"), marks[d[lo:hi]].astype("<u4"), place[lo:hi].astype("<u4"), mask[lo:hi])
                rows.append((b, struct.pack("<II", hi - lo, len(body)) + body + name[first[lo:hi]].astype("<u8").tobytes() + fringe[w_lo:w_hi].astype("<u8").tobytes(), b""))
            for i in range(0, len(rows), 1000):
                part = list(zip(*rows[i : i + 1000]))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.binary()), pa.array(part[2], pa.binary())], names=["bucket", "windows", "known"])

    return send


def _run_lot(doc: np.ndarray, mark: np.ndarray, first: np.ndarray, n: np.ndarray) -> bytes:
    return struct.pack("<I", len(doc)) + pack_columns(doc.astype("<i8"), mark.astype("<u4"), first.astype("<u4"), n.astype("<u4"))


def _unrun(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    lots = [unpack_columns(b[4:], struct.unpack_from("<I", b)[0], "<i8", "<u4", "<u4", "<u4") for b in blobs if b]
    doc, mark, first, n = (np.concatenate(c) for c in zip(*lots)) if lots else (np.zeros(0, np.int64),) * 4
    return doc, mark, first.astype(np.int64), n.astype(np.int64)


def _read_windows(blob: bytes) -> tuple[np.ndarray, ...]:
    """Name and distance, fringe, id, mark, start of each window."""
    n, size = struct.unpack_from("<II", blob)
    step, mark, place, mask = unpack_columns(blob[8 : 8 + size], n, "<i8", "<u4", "<u4", "<u4")
    name = np.frombuffer(blob, "<u8", n, 8 + size)
    fringe = np.frombuffer(blob, "<u8", -1, 8 + size + 8 * n)
    bits = (mask[:, None] >> np.arange(31, -1, -1).astype("<u4")) & 1  # the farthest start first
    row, col = np.nonzero(bits)
    distance = 31 - col
    return name[row] + distance.astype(np.uint64), fringe, np.cumsum(step)[row], mark[row], place[row].astype(np.int64) - distance


def _group(doc: np.ndarray, mark: np.ndarray, groups: int) -> np.ndarray:
    """Of documents; rows without an id are told apart by their texts."""
    return (mix(np.where(doc == _NO_ID, mark, doc).astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _repeats(x: np.ndarray) -> np.ndarray:
    """Which numbers equal the one before them, from the second on."""
    return x[1:] == x[:-1]


def _judge(groups: int):
    def judge(table: pa.Table) -> pa.Table:
        """One bucket: runs of window starts that are not the first of their windows, by group of documents."""
        found = [_unrun(table.column("known").to_pylist())]
        lots = [_read_windows(b) for b in table.column("windows").to_pylist() if b]
        if lots:
            symbols, fringe, doc, mark, start = (np.concatenate(c) for c in zip(*lots))
            del lots
            whole = mix(symbols) ^ fringe
            by = np.argsort(whole)
            one, two = _repeats(whole[by]), _repeats(symbols[by])
            if (one & ~two).any():  # different windows that fold into one number
                by = np.lexsort((fringe, symbols))
                two = _repeats(symbols[by])
            same = two & _repeats(fringe[by])
            del whole, one, two
            shared = np.zeros(len(by), bool)
            shared[1:] |= same
            shared[:-1] |= same
            pick = by[shared]
            if len(pick):
                pick = pick[np.lexsort((start[pick], doc[pick], fringe[pick], symbols[pick]))]
                head = np.ones(len(pick), bool)
                head[1:] = (symbols[pick][1:] != symbols[pick][:-1]) | (fringe[pick][1:] != fringe[pick][:-1])
                first = pick[np.maximum.accumulate(np.where(head, np.arange(len(pick)), 0))]
                later = pick[(doc[pick] != doc[first]) | (start[pick] != start[first])]
                if len(later):
                    found.append(_runs(doc[later], mark[later], start[later]))
        doc, mark, first, n = (np.concatenate(c) for c in zip(*found))
        if not len(doc):
            return pa.table({"group": pa.array([], pa.int64()), "runs": pa.array([], pa.binary())})
        group = _group(doc, mark, groups)
        order = np.lexsort((doc, group))
        doc, mark, first, n, group = doc[order], mark[order], first[order], n[order], group[order]
        cut = [*np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))).tolist(), len(group)]
        return pa.table({"group": pa.array(group[cut[:-1]]), "runs": pa.array([_run_lot(doc[a:b], mark[a:b], first[a:b], n[a:b]) for a, b in zip(cut, cut[1:])], pa.binary())})

    return judge


def _by_document(table: pa.Table) -> pa.Table:
    """One group of documents: each with all its runs, joined where they touch."""
    doc, mark, first, n = _unrun(table.column("runs").to_pylist())
    order = np.lexsort((first, mark, doc))
    doc, mark, first, n = doc[order], mark[order], first[order], n[order]
    cut = [*np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])))).tolist(), len(doc)] if len(doc) else [0]
    runs = []
    for a, b in zip(cut, cut[1:]):
        lo, hi = first[a:b], np.maximum.accumulate(first[a:b] + n[a:b])
        new = np.concatenate(([True], lo[1:] > hi[:-1]))
        last = np.append(np.flatnonzero(new)[1:], b - a) - 1
        runs.append(np.stack((lo[new], hi[last] - lo[new]), 1).astype("<i8").tobytes())
    return pa.table({"n": pa.array(doc[cut[:-1]].astype(np.int64)), "mark": pa.array(mark[cut[:-1]].astype(np.int64)), "runs": pa.array(runs, pa.binary())})


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str, str]:
    """``docs`` with numbers in the order of its ids, the texts' marks, and names for both and for the runs."""
    number, mark, runs = (free_name(docs.columns, x) for x in ("number", "mark", "runs"))
    kind = docs.schema[id_col].dataType.typeName()
    if kind in ("byte", "short", "integer", "long"):
        docs = docs.withColumn(number, F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)))
    else:
        # sorted, so that numbers that grow from partition to partition grow with the ids
        ids = docs.select(F.col(id_col)).filter(F.col(id_col).isNotNull()).distinct().orderBy(id_col)
        ids = materialize(ids.withColumn(number, F.monotonically_increasing_id()), "ids")
        docs = docs.join(ids, id_col, "left").select(*docs.columns, F.coalesce(number, F.lit(_NO_ID)).alias(number))
    return docs.withColumn(mark, F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))), number, mark, runs


def repeated_windows(docs: DataFrame, number: str, text_col: str, *, window: int, group_bytes: int, bucket_bytes: int) -> DataFrame:
    """n (as ``number``), mark (of the text), runs (first start, how many; 64-bit numbers) of each document with repeated windows."""
    if not 2 <= window <= 32:
        raise ValueError("windows of 2 to 32 words")
    ship(docs.sparkSession)
    size = text_bytes(docs, text_col)
    buckets = pieces_of(size, bucket_bytes)
    sent = docs.select(F.col(number).alias("id"), F.col(text_col).alias("text")).mapInArrow(released(_sender(window, buckets)), "bucket long, windows binary, known binary")
    # as many partitions as the data asks for
    found = sent.repartition(pieces_of(buckets, 2), "bucket").groupBy("bucket").applyInArrow(released_group(_judge(pieces_of(size, group_bytes))), "group long, runs binary")
    return found.groupBy("group").applyInArrow(released_group(_by_document), "n long, mark long, runs binary")


def _covered(n: int, runs: np.ndarray, window: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1] - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _digest(text: bytes, runs: np.ndarray | None, window: int) -> tuple[int, int, str]:
    own = text.split()
    gone = None if runs is None else _covered(len(own), runs, window)
    left = own if gone is None else [x for x, g in zip(own, gone.tolist()) if not g]
    return len(own), len(own) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()


def _cut(text: str | None, runs: np.ndarray | None, window: int) -> str | None:
    if runs is None or text is None:
        return text
    raw = text.encode()
    start, end = spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), SPACED)
    stay = np.concatenate(([False], ~_covered(len(start), runs, window), [False]))
    lo, hi = np.flatnonzero(stay[1:] & ~stay[:-1]), np.flatnonzero(stay[:-1] & ~stay[1:]) - 1
    return "\n".join(raw[start[a] : end[b]].decode() for a, b in zip(lo.tolist(), hi.tolist()))


def _met(docs: DataFrame, window: int, group_bytes: int, bucket_bytes: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with a column of each row's runs (null if it has none), and its name.  Spark may split the rows of one id."""
    docs, number, mark, runs = _numbered(docs, id_col, text_col)
    found = repeated_windows(docs, number, text_col, window=window, group_bytes=group_bytes, bucket_bytes=bucket_bytes)
    met = docs.join(found.select(F.col("n").alias(number), F.col("mark").alias(mark), F.col("runs").alias(runs)), [number, mark], "left")
    return met.select(*[c for c in docs.columns if c not in (number, mark)], runs), runs


def _pairs(part: pa.RecordBatch, text_at: int) -> Iterator[tuple[str | None, np.ndarray | None]]:
    for text, runs in zip(part.column(text_at).to_pylist(), part.column(part.num_columns - 1).to_pylist()):
        yield text, None if runs is None else np.frombuffer(runs, "<i8").reshape(-1, 2)


def removed(docs: DataFrame, *, window: int = 20, group_bytes: int = 4 << 20, bucket_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of each row."""
    met, _ = _met(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), window, group_bytes, bucket_bytes, "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n_words, n_removed, kept = zip(*[_digest((t or "").encode(), r, window) for t, r in _pairs(part, 1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept)], names=["id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return met.mapInArrow(released(run), f"id {kind}, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)


def remove(docs: DataFrame, *, window: int = 20, group_bytes: int = 4 << 20, bucket_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words that repeated windows cover; what is left of a cut text stands in lines, other texts stay as they are."""
    met, _ = _met(docs, window, group_bytes, bucket_bytes, id_col, text_col)
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                cut = pa.array([_cut(t, r, window) for t, r in _pairs(part, text_at)], part.column(text_at).type)
                yield pa.RecordBatch.from_arrays([cut if i == text_at else c for i, c in enumerate(part.columns[:-1])], names=part.schema.names[:-1])

    return met.mapInArrow(released(run), docs.schema)
