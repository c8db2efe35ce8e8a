"""Full-text search: a postings table, phrase matching and BM25 over DataFrames.

The index is a table of (term, key, positions, tf, doc_len).  Stored (``write_index``) it consists of segments that never change: a segment
lies in parts by term, so many as its size asks for, and a version of the index's manifest lists the live ones, so that a segment is seen whole or not at
all.  Each write adds one; of ``FAN`` segments of a size one of the next size is made, so that n writes leave O(log n).  Documents that were read anew
are told to be dead in the segments before.  A query opens the parts of its own terms alone (``read_index``).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import beside
from ..functions.ship import ship
from ..functions.store import FAN, State, Store

K1, B = 1.2, 0.75


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks beside the letters they count as, then the marks themselves, which count as nothing; by Unicode's decomposition."""
    marked, plain = "", ""
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        first, *rest = unicodedata.normalize("NFD", c)
        if rest and c == c.lower() and all(map(unicodedata.combining, rest)):
            marked, plain = marked + c, plain + first
    return marked + "".join(map(chr, range(0x300, 0x370))), plain


MARKED, PLAIN = _plain_letters()
WORD = r"[\p{L}\p{N}]+"
#: The same words in a text whose marks are still there.
MARKED_WORD = r"[\p{L}\p{N}](?:[\x{300}-\x{36F}]*[\p{L}\p{N}])*"


def tokenize(text: Column) -> Column:
    """Runs of letters and digits, in lower case, without marks."""
    low = F.lower(text)
    # only a text with letters beyond ASCII can have marks, and to look each letter up takes most of the time
    plain = F.when(F.length(low) == F.octet_length(low), low).otherwise(F.translate(low, MARKED, PLAIN))
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def query_terms(query: str) -> list[str]:
    """The same for a query, on the driver."""
    return re.findall(r"[^\W_]+", query.lower().translate(str.maketrans(MARKED[: len(PLAIN)], PLAIN, MARKED[len(PLAIN) :])))


@dataclass
class Index:
    """postings: term, key, positions, tf, doc_len; docs: key, doc_len, digest (of the text); ``keys`` name the key's columns.
    ``rows`` are those that both are made of, where they were not stored yet."""

    postings: DataFrame
    docs: DataFrame
    keys: list[str]
    rows: DataFrame | None = None


def _index(rows: DataFrame, keys: list[str]) -> Index:
    """``rows``: key, doc_len, digest, term, positions; a document without words has one of no term."""
    postings = rows.filter(F.col("term").isNotNull()).withColumn("tf", F.size("positions").cast("long"))
    first = F.col("term").isNull() | (F.try_element_at("positions", F.lit(1)) == 0)  # one row of each document
    return Index(postings, rows.filter(first).select(*keys, "doc_len", "digest"), keys, rows)


#: Words that are gathered at once, and postings of a batch that leaves.
WORDS_AT_ONCE, POSTINGS_AT_ONCE = 1 << 20, 1 << 16


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From key, digest, tokens of documents to key, doc_len, digest, term, positions."""
    for whole in batches:
        ends, begin = np.cumsum(whole.column("tokens").value_lengths().to_numpy(zero_copy_only=False)), 0
        while begin < len(ends):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + WORDS_AT_ONCE, "right")))
            yield from _places(whole.slice(begin, end - begin))
            begin = end


def _places(docs: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    tokens = docs.column("tokens")
    n = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(n)), n)
    places = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    coded = tokens.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    name = of * max(1, len(coded.dictionary)) + code
    order = np.argsort(name, kind="stable")  # places stay in order
    name = name[order]
    head = np.flatnonzero(np.diff(name, prepend=-1))
    silent = np.flatnonzero(n == 0)
    row = np.concatenate([of[order[head]], silent])
    term = coded.dictionary.take(pa.array(np.concatenate([code[order[head]], np.zeros(len(silent), np.int64)]), mask=np.arange(len(row)) >= len(head)))
    begins = np.concatenate([head, np.full(len(silent) + 1, len(of))]).astype(np.int32)
    positions = pa.ListArray.from_arrays(pa.array(begins), pa.array(places[order].astype(np.int32)))
    keys = docs.select([c for c in docs.schema.names if c not in ("digest", "tokens")])
    for a in range(0, len(row), POSTINGS_AT_ONCE):
        some = pa.array(row[a : a + POSTINGS_AT_ONCE])
        own = keys.take(some)
        yield pa.RecordBatch.from_arrays(
            [*own.columns, pa.array(n[row[a : a + POSTINGS_AT_ONCE]]), docs.column("digest").take(some), term[a : a + POSTINGS_AT_ONCE], positions[a : a + POSTINGS_AT_ONCE]], names=[*own.schema.names, "doc_len", "digest", "term", "positions"]
        )


def _rows(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """key, doc_len, digest, term, positions: a document's words are gathered where it is read, and nothing is exchanged for it."""
    ship(docs.sparkSession)
    tokens = docs.select(*keys, F.xxhash64(text).alias("digest"), tokenize(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    extra = StructType.fromDDL("doc_len bigint, digest bigint, term string, positions array<int>")
    return tokens.mapInArrow(_gathered, StructType([*docs.select(*keys).schema.fields, *extra.fields]))


def build_index(docs: DataFrame, keys: list[str], text: str) -> Index:
    """Postings of all documents; a document without words has none, but counts among the documents."""
    return _index(_rows(docs, keys, text), keys)


def write_index(index: Index, path: str, *, run: int = 0, part_tokens: int = 4_000_000, dead: DataFrame | None = None, notes: dict | None = None) -> None:
    """Store an index, or add a ``run`` of other documents to one (the same run again replaces itself).

    ``dead`` (key) are documents that stand in segments before and no longer count there.  ``notes`` are kept with the version.
    The texts are tokenised once; rows are ranged by part, term and key, so that a term of very many documents is shared by several tasks and files.
    """
    spark, keys = index.postings.sparkSession, index.keys
    store = Store(spark, path)
    before = store.state()
    store.sweep(before)
    name = f"{run}-{before.number}"
    rows = index.rows
    if rows is None:
        lengths = index.docs.withColumns({"term": F.lit(None).cast("string"), "positions": F.array().cast("array<int>")})
        rows = index.postings.select(*keys, "doc_len", "digest", "term", "positions").unionByName(lengths.filter("doc_len = 0"))
    store.write(rows, f"raw/{name}")
    stored = _index(spark.read.parquet(f"{path}/raw/{name}"), keys)
    known = before.notes.get("segments", [])
    gone = [f"segments/{x['name']}" for x in known if x["run"] == run]
    if not gone and run <= before.batch:  # its first writing stands in a merged segment
        dead = stored.docs.select(*keys) if dead is None else stored.docs.select(*keys).union(dead.select(*keys)).distinct()
    own = _write_segment(store, stored, name, run, 0, part_tokens, dead)
    store.drop(f"raw/{name}")
    segments = [x for x in known if x["run"] != run] + [own]
    level = 0
    while len(same := [x for x in segments if x["size"] == level]) >= FAN:
        merged = f"{name}-{level + 1}"
        live = _live(spark, path, same, keys, None)  # smaller ones are newer, and there are none now
        killed = _dead(spark, path, same, keys).select(*keys).distinct() if any(x["dead"] for x in same) else None
        segments = [x for x in segments if x["size"] != level] + [_write_segment(store, live, merged, None, level + 1, part_tokens, killed)]
        gone += [f"segments/{x['name']}" for x in same]
        level += 1
    new = State(before.number, max(run, before.batch), notes={**before.notes, **(notes or {}), "segments": segments})
    store.retire(before, new, gone, [])
    store.sweep(store.commit(new))


def index_notes(spark, path: str) -> dict:
    """What the last version of a stored index was written with."""
    return Store(spark, path).state().notes


def _write_segment(store: Store, index: Index, name: str, run: int | None, size: int, part_tokens: int, dead: DataFrame | None) -> dict:
    """Parts by term, documents and dead documents of one segment; what the manifest says of it."""
    keys = index.keys
    total = index.docs.agg(F.coalesce(F.sum("doc_len"), F.lit(0))).first()[0]
    pieces = max(1, -(-total // part_tokens))
    parts = min(pieces, 4096)
    part = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")
    rows = index.postings.select(*keys, "doc_len", "term", "positions").repartitionByRange(pieces, part, "term", *keys)
    rows = rows.withColumns({"tf": F.size("positions").cast("long"), "term_part": part})  # not exchanged
    store.write(rows.sortWithinPartitions("term_part", "term", *keys), f"segments/{name}/postings", "term_part")
    store.write(index.docs.coalesce(pieces), f"segments/{name}/docs")
    n = 0
    if dead is not None:
        store.write(dead.select(*keys), f"segments/{name}/dead")
        n = store.spark.read.schema(dead.select(*keys).schema).parquet(f"{store.root}/segments/{name}/dead").count()
    return {"name": name, "run": run, "size": size, "parts": parts, "dead": n, "keys": {f.name: f.dataType.simpleString() for f in index.docs.schema if f.name in keys}}


def _dead(spark, path: str, segments: list[dict], keys: list[str]) -> DataFrame:
    """key, before: documents that don't count in segments older than ``before`` (a place in the list)."""
    out = None
    for i, x in enumerate(segments):
        if x["dead"]:
            one = spark.read.schema(", ".join(f"`{k}` {t}" for k, t in x["keys"].items())).parquet(f"{path}/segments/{x['name']}/dead").select(*keys, F.lit(i).alias("before"))
            out = one if out is None else out.unionByName(one)
    return out.groupBy(*keys).agg(F.max("before").alias("before"))


def _live(spark, path: str, segments: list[dict], keys: list[str], terms: set[str] | None) -> Index:
    """The live rows of some segments, in the order of their writing; with ``terms`` of their postings those parts that hold one."""
    postings = docs = None
    for i, x in enumerate(segments):
        key = ", ".join(f"`{k}` {t}" for k, t in x["keys"].items())
        p = spark.read.schema(f"{key}, doc_len bigint, term string, positions array<int>, tf bigint, term_part int").parquet(f"{path}/segments/{x['name']}/postings")
        if terms is not None:
            own = spark.createDataFrame([(t,) for t in terms or {""}], "term string").select(F.pmod(F.xxhash64("term"), F.lit(x["parts"])).cast("int")).collect()  # one row a query term
            p = p.filter(F.col("term_part").isin(sorted({r[0] for r in own})))
        d = spark.read.schema(f"{key}, doc_len bigint, digest bigint").parquet(f"{path}/segments/{x['name']}/docs")
        p, d = p.drop("term_part").withColumn("segment", F.lit(i)), d.withColumn("segment", F.lit(i))
        postings, docs = (p, d) if postings is None else (postings.unionByName(p), docs.unionByName(d))
    if any(x["dead"] for x in segments):
        dead = _dead(spark, path, segments, keys)
        alive = [dead[k] == F.col(f"r.{k}") for k in keys]

        def without(rows: DataFrame) -> DataFrame:
            return rows.alias("r").join(dead, [*alive, F.col("r.segment") < dead["before"]], "left_anti")

        postings, docs = without(postings), without(docs)
    return Index(postings.drop("segment"), docs.drop("segment"), keys)


def read_index(spark, path: str, keys: list[str], query: str | None = None) -> Index:
    """A stored index; with ``query`` of its postings only the parts of the query's terms."""
    segments = index_notes(spark, path).get("segments", [])
    if not segments:
        none = spark.createDataFrame([], ", ".join(f"`{k}` string" for k in keys))
        extra = {"doc_len": F.lit(0).cast("long"), "digest": F.lit(0).cast("long")}
        return Index(none.withColumns({"term": F.lit(""), "positions": F.array().cast("array<int>"), "tf": F.lit(0).cast("long"), "doc_len": extra["doc_len"]}), none.withColumns(extra), keys)
    return _live(spark, path, segments, keys, None if query is None else set(query_terms(query)))


def phrase_matches(index: Index, query: str) -> DataFrame:
    """key, doc_len, tf, first (position) of each document that holds the words of ``query`` one after another."""
    terms = query_terms(query)
    p = index.postings
    if not terms:
        return p.limit(0).select(*index.keys, "doc_len", "tf", F.lit(0).alias("first"))
    # the documents of each different term, then the places where all of them agree
    need = {t: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("term") == t, F.col("positions"))))).alias(f"of_{i}") for i, t in enumerate(sorted(set(terms)))}
    place = {t: F.col(f"by.of_{i}") for i, t in enumerate(need)}
    own = p.filter(F.col("term").isin(list(need))).groupBy(*index.keys, "doc_len").agg(F.struct(*need.values()).alias("by"))
    for x in place.values():
        own = own.filter(F.size(x) > 0)

    def shifted(term: str, by: int) -> Column:
        return F.transform(place[term], lambda x: x - by)

    starts = place[terms[0]]
    for i, t in enumerate(terms[1:], 1):
        starts = F.array_intersect(starts, shifted(t, i))
    found = own.withColumn("starts", starts).filter(F.size("starts") > 0)
    return found.select(*index.keys, "doc_len", F.size("starts").cast("long").alias("tf"), F.array_min("starts").alias("first"))


def ranked(index: Index, query: str) -> DataFrame:
    """phrase_matches with ``score``: BM25, best first and negated (smaller is better)."""
    m = phrase_matches(index, query)
    stats = F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len")
    stats, df = index.docs.agg(*stats), m.agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    return beside(beside(m, stats), df).withColumn("score", -idf * gain).drop("n_docs", "avg_len", "df")


def phrase_search(index: Index, query: str, limit: int | None = 20, offset: int = 0) -> DataFrame:
    out = ranked(index, query).orderBy(F.round("score", 9), *index.keys)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def snippet(text: Column, first: Column, words: int, pre: str = ">>>", post: str = "<<<", around: int = 30) -> Column:
    """The source text about a phrase that begins at word ``first``, the phrase in marks, ``...`` where text is left out."""
    lo = F.greatest(first - F.lit((around - words) // 2), F.lit(0))
    last = first + words - 1

    def shown(both: Column) -> Column:
        spans, gaps = both["spans"], both["gaps"]
        hi = F.least(lo + around, F.size(spans))

        def piece(i: Column) -> Column:
            word = F.concat(F.when(i == first, pre).otherwise(""), spans[i], F.when(i == last, post).otherwise(""))
            return F.concat(word, F.when(i < hi - 1, gaps[i + 1]).otherwise(""))

        body = F.array_join(F.transform(F.sequence(lo, hi - 1), piece), "")
        before, after = F.when(lo > 0, "...").otherwise(gaps[0]), F.when(hi < F.size(spans), "...").otherwise(gaps[F.size(spans)])
        return F.concat(before, body, after)

    # the text is what stands between its words and the words by turns: it is taken apart once, not for each word that is shown
    both = F.struct(F.regexp_extract_all(text, F.lit(MARKED_WORD), F.lit(0)).alias("spans"), F.split(text, MARKED_WORD, -1).alias("gaps"))
    return F.transform(F.array(both), shown)[0]


def _shown(top: DataFrame, docs: DataFrame, keys: list[str], text: str, query: str, pre: str = ">>>", post: str = "<<<", around: int = 30) -> DataFrame:
    return top.join(docs, keys).withColumn("snippet", snippet(F.coalesce(F.col(text), F.lit("")), F.col("first"), len(query_terms(query)), pre, post, around)).drop("first", text)


def search_messages(index: Index, messages: DataFrame, searchable: DataFrame, query: str, limit: int | None = 20, offset: int = 0, only: str | None = None) -> DataFrame:
    """Blocks with the phrase, by the index of ``searchable``; statistics are those of all blocks, whatever ``only`` (a block type) leaves."""
    keys = index.keys
    docs = searchable.filter(F.col("text_content").isNotNull()).select(*keys, "block_type", "text_content")
    hits = ranked(index, query)
    if only is not None:
        hits = hits.join(docs.filter(F.col("block_type") == only).select(*keys), keys, "left_semi")
    hits = hits.orderBy(F.round("score", 9), *keys)
    if offset:
        hits = hits.offset(offset)
    if limit is not None:
        hits = hits.limit(limit)
    m = messages.select(F.col("uuid").alias("message_uuid"), "session_id", F.col("type").alias("message_type"), "timestamp")
    return _shown(hits, docs, keys, "text_content", query).join(m, "message_uuid").withColumn("source", F.lit("message"))


def search_plans(index: Index, messages: DataFrame, searchable: DataFrame, query: str, limit: int | None = 20, offset: int = 0) -> DataFrame:
    return search_messages(index, messages, searchable, query, limit, offset, only="plan_content")


def attachment_docs(attachments: DataFrame) -> DataFrame:
    """attachment_uuid, part, session_id, inner_type, text_content of the four subtypes that hold text."""
    a = attachments.filter(F.col("body_json").isNotNull()).select(F.col("uuid").alias("attachment_uuid"), "session_id", "inner_type", "timestamp", "body_json")
    blocks = a.filter(F.col("inner_type") == "mcp_instructions_delta").select("*", F.posexplode(F.from_json(F.get_json_object("body_json", "$.addedBlocks"), "array<string>")).alias("part", "text_content"))
    out = blocks
    # Where each subtype keeps its text.
    for kind, path in {"skill_listing": "$.content", "edited_text_file": "$.snippet", "nested_memory": "$.content.content"}.items():
        out = out.unionByName(a.filter(F.col("inner_type") == kind).select("*", F.lit(0).alias("part"), F.get_json_object("body_json", path).alias("text_content")))
    return out.filter(F.length("text_content") > 0).drop("body_json")


def search_attachments(index: Index, docs: DataFrame, query: str, limit: int | None = 20, offset: int = 0) -> DataFrame:
    """``docs`` are ``attachment_docs``, ``index`` is theirs."""
    top = phrase_search(index, query, limit, offset)
    return _shown(top, docs, index.keys, "text_content", query).withColumn("source", F.lit("attachment"))


def search_all(index: Index, messages: DataFrame, searchable: DataFrame, attachment_index: Index, attachment_texts: DataFrame, query: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """The best of both corpora by their own scores; each gives limit + offset."""
    a = search_messages(index, messages, searchable, query, limit + offset).select("source", F.col("message_uuid").alias("id"), F.col("block_index").cast("long").alias("part"), "session_id", "timestamp", "snippet", "score")
    b = search_attachments(attachment_index, attachment_texts, query, limit + offset).select("source", F.col("attachment_uuid").alias("id"), F.col("part").cast("long").alias("part"), "session_id", "timestamp", "snippet", "score")
    out = a.unionByName(b).orderBy(F.round("score", 9), "source", "id", "part")
    return (out.offset(offset) if offset else out).limit(limit)


def file_op_docs(ops: DataFrame) -> DataFrame:
    """tool_use_id, field, text_content: each of an operation's texts by itself, so that no phrase crosses them."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text_content")) for c in ("content", "old_content", "command")]))
    return ops.select("tool_use_id", parts.alias("p")).select("tool_use_id", "p.field", "p.text_content").filter(F.col("text_content").isNotNull())


def search_file_ops(index: Index, ops: DataFrame, query: str, limit: int | None = 20, offset: int = 0) -> DataFrame:
    """Operations with the phrase in content, old content or command; ``index`` is that of ``file_op_docs``."""
    hits = phrase_matches(index, query).groupBy("tool_use_id").agg(F.sum("tf").alias("tf"), F.min_by(F.struct("field", "first"), "field").alias("at"))
    lengths = index.docs.groupBy("tool_use_id").agg(F.sum("doc_len").alias("doc_len"))
    stats = lengths.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))
    df = hits.agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    out = beside(beside(hits.join(lengths, "tool_use_id"), stats), df).withColumn("score", -idf * gain).orderBy(F.round("score", 9), "tool_use_id")
    out = out.offset(offset) if offset else out
    out = (out if limit is None else out.limit(limit)).select("tool_use_id", "tf", "doc_len", "score", "at.field", "at.first")
    shown = out.join(file_op_docs(ops), ["tool_use_id", "field"]).withColumn("snippet", snippet(F.col("text_content"), F.col("first"), len(query_terms(query)), "<b>", "</b>", 32)).drop("text_content", "first")
    return shown.join(ops.select("tool_use_id", "session_id", "file_path", "operation_type", "timestamp"), "tool_use_id")
