"""Token files, lexical search, Merkle manifest: against brute force and on awkward tables."""

import hashlib
import io
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelake.llm import lexical, merkle, simple8b, token_files

from .data import LOWER, documents, empty, sentence, texts

BPE = public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- Simple-8b


def plain_words(ids, block):
    """One word after another, each with as many of the next ids as some selector takes."""
    words, first = [], []
    for lo in range(0, len(ids), block):
        own, i = ids[lo : lo + block], 0
        first.append(len(words))
        while i < len(own):
            for s, n, width in reversed(simple8b.SELECTORS):
                held = own[i : i + n]
                if all(x < 1 << width for x in held):
                    words.append(s << 60 | sum(x << width * j for j, x in enumerate(held)))
                    i += n
                    break
    return words, first


@pytest.mark.parametrize("block", [1, 7, 64, 4096])
def test_words_equal_plain_coding_and_round_trip(block):
    r = random.Random(block)
    for top in (1, 2, 3, 100, 50_257, 1 << 30, (1 << 32) - 1):
        for n in (0, 1, 59, 60, 61, 4096, 5000):
            ids = [r.choice([0, 1, r.randint(0, top), r.randint(0, top) >> r.randint(0, 31)]) for _ in range(n)]
            words, first = simple8b.encode(np.array(ids, np.uint32), block)
            assert (words.tolist(), first.tolist()) == plain_words(ids, block)
            assert simple8b.decode(words, first, n, block).tolist() == ids
            if len(first) > 2:  # a run of blocks alone
                own = simple8b.decode(words[first[1] : first[2]], first[1:2] - first[1], block, block)
                assert own.tolist() == ids[block : 2 * block]


def test_escapes_stand_alone():
    words, _ = simple8b.encode(np.array([1 << 31, 5, 1 << 30, 0], np.uint32))
    assert [int(w) >> 60 for w in words] == [0, 0, 0, 13] and int(words[0]) == 1 << 31


def test_one_file(monkeypatch):
    """Documents over many blocks and many times what is held, empty ones between them."""
    monkeypatch.setattr(token_files, "HELD", 256)
    r, to = random.Random(2), io.BytesIO()
    lengths = [0, 3, 0, 0, 1000, 1, 0, 63, 64, 65, 5000, 0]
    ids = [np.array([r.randint(0, 60_000) for _ in range(n)], "<u4").tobytes() for n in lengths]
    out = token_files.FileWriter(to, pa.int64(), block=64)
    for lo in range(0, len(ids), 5):
        out.put(pa.array(range(lo, min(lo + 5, len(ids)))), ids[lo : lo + 5])
    assert out.close() == (len(lengths), sum(lengths))
    rows = [x for b in token_files.read_file(pa.BufferReader(to.getvalue()), 7) for x in b.to_pylist()]
    assert [x["id"] for x in rows] == list(range(len(ids))) and [x["ids"] for x in rows] == ids
    assert [x["start"] for x in rows] == [7 + sum(lengths[:i]) for i in range(len(ids))] and [x["n_tokens"] for x in rows] == lengths
    with pytest.raises(ValueError):
        list(token_files.read_file(pa.BufferReader(to.getvalue()[:-1]), 0))


def test_token_files(spark, tmp_path):
    plain, found = Tokenizer.from_file(BPE), texts()
    docs = documents(spark, found).orderBy(F.rand(3)).repartition(7)
    token_files.write(docs, f"file://{tmp_path}/a", BPE, end_id=0, file_bytes=40_000)
    assert len(json.loads((tmp_path / "a" / "_manifest.json").read_text())["files"]) > 2
    (tmp_path / "a" / "part-left-by-a-lost-task.ids").write_bytes(b"half")  # not named by the manifest
    got, start = {r.doc_id: r for r in token_files.read(spark, f"file://{tmp_path}/a").collect()}, 0
    for i, t in enumerate(found):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, bytes(got[i].ids)) == (start, len(ids), ids.tobytes())
        start += len(ids)
    assert len(got) == len(found)


def test_token_files_on_odd_rows(spark, tmp_path):
    """Repeated and missing ids, ids of another type, ids given as bytes, no rows; what is there is replaced."""
    path = str(tmp_path / "b")
    rows = [(None, b""), ("b", b"\1\0\0\0"), (None, b"\2\0\0\0"), ("a", None), ("b", b"\1\0\0\0"), ("b", b"\3\0\0\0\4\0\0\0")]
    token_files.write(spark.createDataFrame(rows, "name string, ids binary").withColumn("start", F.lit("x")), path, id_col="name", text_col="ids", file_bytes=8)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.name for r in got if r.n_tokens] == [None, "b", "b", "b"]
    assert Counter((r.name, bytes(r.ids)) for r in got) == Counter((a, b or b"") for a, b in rows)
    assert [r.start for r in got if r.n_tokens] == [0, *(int(x) for x in np.cumsum([r.n_tokens for r in got if r.n_tokens])[:-1])]
    token_files.write(empty(spark), path, BPE, end_id=0)
    back = token_files.read(spark, path)
    assert back.columns == ["doc_id", "start", "n_tokens", "ids"] and back.count() == 0


# ---------------------------------------------------------------- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, k):
    """docs: (id, text); items: {id: text}."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items.items():
        found = []
        for i, c, n in held:
            m, score = 25 + 75 * n * n_docs // n_terms, 0
            for t in terms(text):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i, score))
        out += [(item, r, i, s) for r, (_, _, i, s) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_lexical_search(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(lexical, "AT_ONCE", 16)
    monkeypatch.setattr(lexical, "ROWS", 50)  # items run over several sums
    r = random.Random(4)
    found = texts(4)
    found += ["MIT-x_y the THE2 é", "x" * 3000 + " the", found[5], found[5]]
    items = {i: sentence(r, r.randint(1, 30)) for i in range(25)} | {30: "", 31: None, 32: "the the THE", 33: "nowhere-at-all", 34: "é y_x", 35: "q" * 900}
    docs = documents(spark, found).unionByName(documents(spark, found[:2])).repartition(6)
    own = spark.createDataFrame([*items.items(), (3, "~ of"), (None, "the of")], "item_id long, text string").withColumn("score", F.lit("x"))
    items[3] = min(items[3], "~ of")
    got = sorted(tuple(x) for x in lexical.search(docs, own, k=7, block_bytes=block_bytes).collect())
    want = sorted(plain_search([*enumerate(found), *enumerate(found[:2])], items, 7))
    assert got == want and len({x[0] for x in got}) > 20


def test_lexical_edges(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    some = spark.createDataFrame([("a", "the of"), ("b", "?!")], none.schema)
    assert lexical.search(documents(spark, ["the"]), none).count() == 0
    assert lexical.search(empty(spark), some).count() == 0
    rows = [(None, "the one"), (None, "the one"), (4, "the one"), (None, None), (5, "something else altogether")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.item_id, r["rank"], r.doc_id) for r in lexical.search(docs, some).orderBy("rank").collect()]
    assert got == [("a", 1, 4), ("a", 2, None), ("a", 3, None)]


def test_few_cells_give_the_same(monkeypatch):
    """Tables cut down to single documents and terms."""
    r = random.Random(9)
    found, items = [t or "" for t in texts(9, 40)], [sentence(r, 40) for _ in range(9)]
    b, raw = lexical.block_of(items), pa.array(found)
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, t in enumerate(b.terms):
        a.add_word(f" {t} ", i)
    a.make_automaton()
    counts = lexical.counted(raw, a)
    assert counts[0].tolist() == [len(terms(t)) for t in found]
    gain, ids = (np.arange(len(b.of)) % 7 * b.times)[:, None], np.arange(len(found))
    whole = lexical.scored(b, counts, 0, len(found), gain, 30, 4000, ids)[0]
    monkeypatch.setattr(lexical, "ROWS", 3)
    for lo in range(len(found)):
        assert (lexical.scored(b, counts, lo, 1, gain, 30, 4000, ids)[0][:, 0] == whole[:, lo]).all()


def test_best_keeps_equal_scores_of_smaller_ids():
    best = lexical.Best(1, 2)
    for docs in ([9, 8], [7, 6], [3, 5]):
        best.add(np.array([[4, 4]]), np.array(docs))
        best.sort()
    assert best.sort()[2].tolist() == [3, 5]


# ---------------------------------------------------------------- Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_paths(leaves, fanout):
    """The root, and for each leaf what stands left and right of its way up."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, p in enumerate(paths):
            lo = at[i] // fanout * fanout
            run = level[lo : lo + fanout]
            p.append(("".join(run[: at[i] - lo]), "".join(run[at[i] - lo + 1 :])))
            at[i] //= fanout
        level = [digest(*level[lo : lo + fanout]) for lo in range(0, len(level), fanout)]
    return level[0], paths


def plain_manifest(rows, fanout, fields=5):
    groups = {}
    for i, source, *rest, offered in rows:
        groups.setdefault(source, []).append((i is not None, i or 0, plain_leaf([i, source, *rest][:fields]), offered))
    order, tops = sorted(groups, key=lambda s: (s is not None, s or "")), {}
    for s in order:
        groups[s].sort(key=lambda x: (*x[:3], x[3] or ""))
        tops[s] = plain_paths([x[2] for x in groups[s]], fanout)
    root, above = plain_paths([tops[s][0] for s in order], fanout)
    out = Counter()
    for s, up in zip(order, above):
        for (known, i, own, offered), path in zip(groups[s], tops[s][1]):
            h, path = offered or own, path + up
            for a, b in path:
                h = digest(a, h, b)
            out[(i if known else None, own, tops[s][0], root, digest(*[x for p in path for x in p]), h, h == root)] += 1
    return out, root


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_merkle_manifest(spark, monkeypatch, fanout):
    monkeypatch.setattr(merkle, "ROWS_PER_PART", 23)  # many parts: groups run over several, and several stand in one
    r = random.Random(fanout)
    rows = []
    for i in range(300):
        source = r.choice(["big"] * 6 + [None, "", "a", "B", "é", f"own{i}"])
        rows.append((r.choice([i, i, i, None, i // 2]), source, r.choice(["en", None]), r.choice([i, None]), r.choice(["", None, "Text ß", "x" * i]), r.choice([None, None, digest("else")])))
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, offered string").withColumns({"g": F.lit(1), "h": F.lit("x"), "pos": F.lit(2), "n": F.lit(0)})
    found = merkle.manifest(docs.repartition(5), fanout=fanout, offered=F.col("offered"))
    got = Counter(tuple(x) for x in found.proofs.drop("path").collect())
    want, root = plain_manifest(rows, fanout)
    assert got == want and found.root == root
    assert {x.source for x in found.groups.collect()} == {x[1] for x in rows}
    assert len({x[6] for x in got}) == 2


def test_merkle_edges(spark):
    found = merkle.manifest(empty(spark))
    assert found.root is None and found.proofs.count() == 0
    one = merkle.manifest(documents(spark, ["a"])).proofs.first()
    assert one.leaf == one.subroot == one.root and one.verified and one.path == [] and one.proof_sha256 == digest()
    with pytest.raises(ValueError):
        merkle.manifest(empty(spark), fanout=1)


def test_a_changed_byte_is_found(spark):
    docs = documents(spark, [f"Text {i}" for i in range(40)])
    changed = F.when(F.col("doc_id") == 17, merkle.leaf([F.col("doc_id"), F.lower("text")])).when(F.col("doc_id") == 18, merkle.leaf([F.col("doc_id"), F.col("text")]))
    found = merkle.manifest(docs, fields=("doc_id", "text"), offered=changed).proofs
    assert {r.doc_id for r in found.filter("not verified").collect()} == {17}
    assert zlib.crc32(b"17") == docs.filter("doc_id = 17").select(F.crc32(F.col("doc_id").cast("string"))).first()[0]
