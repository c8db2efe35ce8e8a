"""License scans by fuzzy search for short notices.

A notice may differ from its wording by ``edits`` edits.  Cut into ``edits + 1`` seeds, at
least one seed must stand in the text unchanged (pigeonhole), so exact search for seeds
finds all candidates; bounded-error matching of the ``regex`` library then verifies each
and gives its span and its number of edits.  Texts are compared by their words: A-Z in
lower case, everything that is not a letter or digit as one space.

Nulls: a null text is empty and has no words and no notices.  Repeated rows are scanned
each by themselves.  Of places of one notice that overlap, the one with fewest edits, then
the first, counts.  An empty table gives no rows.  Extra columns are ignored; texts are
scanned whole, however long.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from .common import ALNUM_LOWER, buffers, slices, spans


@dataclass(frozen=True)
class Notice:
    """``head`` must stand as it is, ``tail`` may have ``edits`` edits; both begin and end at words."""

    label: str
    head: str
    tail: str = ""
    edits: int = 0

    @property
    def phrase(self) -> str:
        return f"{self.head} {self.tail}".strip()


#: The base phrases and their labels.
BASE = (
    Notice("gpl", "gnu general public license"),
    Notice("apache", "apache license"),
    Notice("cc-by", "cc by"),
    Notice("mit", "mit license"),
)
#: The same with errors, and other short notices.  What is short keeps its telling word exact.
FUZZY = (
    Notice("gpl", "", "gnu general public license", 2),
    Notice("apache", "", "apache license", 1),
    Notice("mit", "mit", "license", 1),
    Notice("mit", "", "permission is hereby granted free of charge to any person", 4),
    Notice("bsd", "", "redistribution and use in source and binary forms", 3),
    Notice("bsd", "bsd", "license", 1),
    Notice("mpl", "", "mozilla public license", 2),
    Notice("cc-by", "", "creative commons attribution", 2),
    Notice("cc-by", "cc by", "license", 1),
    Notice("cc0", "cc0", "public domain dedication", 2),
    Notice("unlicense", "", "free and unencumbered software released into the public domain", 4),
    Notice("lgpl", "", "gnu lesser general public license", 2),
    Notice("agpl", "", "gnu affero general public license", 2),
    Notice("isc", "", "permission to use copy modify and or distribute this software for any purpose", 4),
    Notice("isc", "isc", "license", 1),
    Notice("zlib", "", "this software is provided as is without any express or implied warranty", 4),
    Notice("epl", "", "eclipse public license", 2),
    Notice("boost", "", "boost software license", 2),
    Notice("gfdl", "", "gnu free documentation license", 2),
    # the machine-readable line names a license by its identifier, which stays exact
    *(
        Notice(label, "", f"spdx license identifier {name}", 0)
        for label, name in (("apache", "apache 2 0"), ("mit", "mit"), ("bsd", "bsd"), ("gpl", "gpl"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("mpl", "mpl"), ("isc", "isc"), ("zlib", "zlib"), ("epl", "epl"), ("cc-by", "cc by"), ("cc0", "cc0"))
    ),
)


def _seeds(n: Notice) -> list[tuple[bytes, int]]:
    """Exact pieces of the tail and where each begins in the phrase."""
    tail, k = n.tail.encode(), n.edits + 1
    before = len(n.phrase.encode()) - len(tail)
    at = [len(tail) * i // k for i in range(k + 1)]
    return [(tail[a:b], before + a) for a, b in zip(at, at[1:])]


def _pattern(n: Notice):
    head = regex.escape(n.head.encode() + b" ", special_only=True) if n.head else b""
    tail = regex.escape(n.tail.encode(), special_only=True)
    if not n.edits:
        return regex.compile(rb"(?<![^ \n])" + head + tail + rb"(?![^ \n])")
    return regex.compile(rb"(?be)(?<![^ \n])" + head + rb"(?:" + tail + rb"){e<=%d:[^\n]}(?![^ \n])" % n.edits)


def _everywhere(text: bytes, what: bytes) -> Iterator[int]:
    at = text.find(what)
    while at >= 0:
        yield at
        at = text.find(what, at + 1)


def _whole_words(text: bytes, at: int, what: bytes) -> bool:
    """Whether ``what`` stands at ``at`` with word boundaries on both sides."""
    return at > 0 and text.startswith(what, at) and text[at - 1] in b" \n" and text[at + len(what)] in b" \n"


def _joined(data: np.ndarray, text_at: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words in lower case behind a line end, each followed by one space, or by a line end where a text ends."""
    start, end = spans(data, text_at, ALNUM_LOWER)
    first = np.searchsorted(start, text_at)
    n = end - start
    letters = (ALNUM_LOWER.astype(np.int16) - 1).astype(np.uint8)[data[(ALNUM_LOWER != 0)[data]]]
    out = np.full(1 + int(n.sum()) + len(n), 32, np.uint8)
    out[0] = 10
    out[1 + np.arange(len(letters)) + np.repeat(np.arange(len(n)), n)] = letters
    word_at = np.cumsum(n + 1) - n
    last = first[1:][np.diff(first) > 0] - 1
    out[word_at[last] + n[last]] = 10
    return out.tobytes(), word_at, first, start, end


def scan_texts(texts: pa.Array, fuzzy: tuple[Notice, ...] = FUZZY) -> tuple[np.ndarray, list[list[tuple]]]:
    """Number of words of each text, and its places: label, phrase, first word, words, first byte, byte behind, edits, base."""
    data, text_at = buffers(texts)
    text, word_at, first, start, end = _joined(data, text_at)
    places: list[list[tuple]] = [[] for _ in range(len(text_at) - 1)]

    def put(n: Notice, lo: int, hi: int, edits: int, base: bool) -> None:
        a, b = int(np.searchsorted(word_at, lo)), int(np.searchsorted(word_at, hi))
        doc = int(np.searchsorted(first, a, side="right")) - 1
        places[doc].append((n.label, n.phrase, a - int(first[doc]), b - a, int(start[a] - text_at[doc]), int(end[b - 1] - text_at[doc]), edits, base))

    for n in BASE:
        what = n.phrase.encode()
        for at in _everywhere(text, what):
            if _whole_words(text, at, what):
                put(n, at, at + len(what), 0, True)
    for n in fuzzy:
        exact = n.phrase.encode()
        found: dict[tuple[int, int], int] = {}
        tried: set[int] = set()
        pattern = _pattern(n)
        for seed, offset in _seeds(n):
            for at in _everywhere(text, seed):
                guess = at - offset
                if guess in tried:
                    continue
                tried.add(guess)
                if _whole_words(text, guess, exact):
                    continue  # unchanged wording of a base phrase is already a place; of another notice it is found below
                # from the line end on: the library allows no insertion where its search begins; no farther than a match may reach
                lo, hi = max(guess - n.edits - 1, 0), min(guess + len(exact) + n.edits + 1, len(text))
                lo = max(lo, text.rfind(b"\n", lo, at))
                ends = text.find(b"\n", at, hi)
                hi = ends if ends >= 0 else hi
                for m in pattern.finditer(text, lo, hi):
                    if text[m.start() - 1] in b" \n" and text[m.end()] in b" \n":
                        found[m.span()] = min(found.get(m.span(), 99), sum(m.fuzzy_counts))
        for at in _everywhere(text, exact):
            if _whole_words(text, at, exact):
                found[at, at + len(exact)] = 0
        begun, ended = [], []  # of the places taken, in order
        for (lo, hi), edits in sorted(found.items(), key=lambda x: (x[1], x[0])):
            i = bisect.bisect_right(begun, lo)
            if (i == 0 or ended[i - 1] <= lo) and (i == len(begun) or begun[i] >= hi):
                begun.insert(i, lo)
                ended.insert(i, hi)
                if edits or all(n.phrase != b.phrase for b in BASE):
                    put(n, lo, hi, edits, False)
    return np.diff(first), places


PLACES = "array<struct<label:string,phrase:string,first_word:long,words:long,first_byte:long,end_byte:long,edits:int,base:boolean>>"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, places (see ``scan_texts``) of each row of ``docs``, and score: 1 for a base phrase, else 1 less the share of edits."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    place = pa.struct([("label", pa.string()), ("phrase", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("first_byte", pa.int64()), ("end_byte", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, places = scan_texts(part.column(1))
                rows = [[dict(zip(place.names if hasattr(place, "names") else [f.name for f in place], p)) for p in sorted(x, key=lambda p: (p[2], p[0], p[1]))] for x in places]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(rows, pa.list_(place))], names=["id", "n_words", "places"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_words long, places {PLACES}")
    share = F.transform("places", lambda p: F.when(p["base"], F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - p["edits"] / F.length(p["phrase"]))))
    return found.withColumn("score", F.coalesce(F.array_max(share), F.lit(0.0))).withColumnRenamed("id", id_col)


def labels_of(places: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
