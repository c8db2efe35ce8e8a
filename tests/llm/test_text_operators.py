"""Packing, token counts, licenses, sharding, quality: against brute force and on awkward tables."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelake.llm import licenses, packing, quality, queries, sharding, token_counts
from tracelake.llm.bpe import Encoder

from .data import ALNUM, LOWER, documents, empty, sentence, texts

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(BPE)


def test_ids_equal_the_library(plain):
    r = random.Random(3)
    odd = " \n\t  ab'sAÉ12!\x1c\x85\xa0 ß中́😀<|endoftext|>"
    found = ["".join(r.choice(odd) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["a <|endoftext|> b<|endoftext|>c  <|endoftext|>", "", " ", "x  y", "don't we're"]
    found += [t for t in texts(5) if t]
    e = Encoder(BPE)
    assert e.fast is not None
    for _ in range(2):  # once learning, once from what is known
        got = e.encode(found)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x.ids for x in plain.encode_batch(found, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name, tmp_path):
    docs = documents(spark, ["Hello world", None, "", "a  b\nc"])
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, public_tokenizers.path(name), str(tmp_path / "c")).collect()}
    if name.endswith(".model"):
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        assert got == {i: len(s.encode(t)) for i, t in enumerate(["Hello world", "", "", "a  b\nc"])}
    else:
        t = Tokenizer.from_file(public_tokenizers.path(name))
        assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(["Hello world", "", "", "a  b\nc"])}


def test_token_counts_and_cache(spark, plain, tmp_path):
    found, cache = texts(), str(tmp_path / "cache")
    docs = documents(spark, found).unionByName(documents(spark, found[:3]))
    got = token_counts.count_tokens(docs, BPE, cache).collect()
    want = [(i, len((t or "").encode()), len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t in [*enumerate(found), *enumerate(found[:3])]]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter(want)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    stored = spark.read.schema(token_counts.CACHE_SCHEMA).parquet(cache).count()
    assert stored == len({t or "" for t in found})
    # a second run encodes nothing new, another version everything
    again = token_counts.count_tokens(docs, BPE, cache).collect()
    assert sorted(tuple(r)[:4] for r in again) == sorted(tuple(r)[:4] for r in got)
    assert not any(r.cached for r in got) and all(r.cached for r in again)
    assert spark.read.schema(token_counts.CACHE_SCHEMA).parquet(cache).count() == stored
    assert token_counts.count_tokens(empty(spark), BPE, str(tmp_path / "none")).count() == 0


def test_packing(spark, plain):
    found = texts()
    docs = documents(spark, found).unionByName(documents(spark, found[:2]))
    got = [r.asDict() for r in packing.pack_documents(docs, BPE, with_ids=True).collect()]
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(found)}
    for r in got:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == own and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
    for i, x in ids.items():
        own = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == i)
        n = [len(x)] if len(x) <= 1024 else [len(x) % 1024] * (len(x) % 1024 > 0) + [1024] * (len(x) // 1024)
        assert Counter(own) == Counter([(k, sum(n[:k]), m) for k, m in enumerate(n)] * (2 if i < 2 else 1))
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [sum(x["length"] for x in rows[:k]) for k in range(len(rows))]
        assert sum(r["length"] for r in rows) <= 1024
    assert len(by) <= packing.lower_bound(np.array([r["length"] for r in got]), 1024) + 1
    assert packing.pack_documents(empty(spark), BPE).count() == 0


def test_whole_sequences(spark):
    packed = packing.pack_documents(documents(spark, ["a b", "c", None]), BPE, with_ids=True)
    s = packing.sequences(packed).collect()
    assert len(s) == 1 and len(s[0].ids) == sum(r.length for r in packed.collect())


def test_exchange_between_partitions(spark):
    r = random.Random(2)
    lengths = [r.choice([1, 7, 120, 300, 341, 512, 513, 700, 900, 1023, 1024]) for _ in range(3000)]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    got = packing.pack(pieces, items_per_partition=300).collect()
    assert sorted(x.doc_id for x in got) == list(range(3000))
    used = Counter()
    for x in got:
        used[x.sequence_id] += x.length
    assert max(used.values()) <= 1024
    bound = packing.lower_bound(np.array(lengths), 1024)
    assert len(used) <= bound * 1.01 + 1
    assert all(x.certified == (x.gap == 0) and x.bound >= 1 for x in got)
    whole = packing.certificate(packing.pack(pieces, items_per_partition=300)).first()
    assert (whole.bound, whole.gap) == (bound, whole.sequences - bound) and whole.gap >= 0
    # sizes that leave gaps everywhere: rounds end, and no piece is lost
    hard = spark.createDataFrame([(i, 400 + i % 7) for i in range(2000)], "doc_id long, length long")
    assert packing.pack(hard, items_per_partition=100).select("sequence_id").distinct().count() == 1000


def fewest_bins(lengths, size):
    """All ways tried."""
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in {x: k for k, x in enumerate(bins)}.values():
            if bins[b] >= lengths[i]:
                place(i + 1, [*bins[:b], bins[b] - lengths[i], *bins[b + 1 :]])
        place(i + 1, [*bins, size - lengths[i]])

    place(0, [])
    return best[0]


def test_bound_and_packing_about_the_optimum():
    """Never above the fewest, and best-fit decreasing never below it; where both meet, the packing is certified."""
    r, met = random.Random(7), 0
    for _ in range(300):
        size = r.choice([10, 13, 24])
        lengths = sorted((r.randint(1, size) for _ in range(r.randint(1, 9))), reverse=True)
        bound, fewest = packing.lower_bound(np.array(lengths), size), fewest_bins(lengths, size)
        made = len(packing.best_fit_decreasing(np.array(lengths), size)[2])
        assert bound <= fewest <= made <= -(-11 * fewest // 9) + 1
        met += bound == made
    assert met > 200


def test_bound_is_a_bound():
    r = random.Random(5)
    for _ in range(200):
        x = np.array([r.randint(1, 100) for _ in range(r.randint(1, 60))])
        bins, offsets, free = packing.best_fit_decreasing(x, 100)
        for b in range(len(free)):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(offsets[own])]
            assert (offsets[own] == np.cumsum(x[own]) - x[own]).all()
        assert packing.lower_bound(x, 100) <= len(free)
        assert (np.bincount(bins, x) + free == 100).all()
    assert packing.lower_bound(np.array([60] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 6), 100) == 3


def places(text):
    w, out = ALNUM.findall((text or "").translate(LOWER)), []
    for phrase, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), out


def test_licenses(spark, monkeypatch):
    own = [
        "Released under the MIT\n License.", "Lizenz: GNU General-Public LICENSE, Version 3", "the Apache Licence 2.0", "gnu generel publik license", "emit license", "cc bye",
        "CC BY-NC and CC-BY, mit license apache license", "éapache license", "Permision is hereby granted free of charge, to any persn", "mit licence mit license", "GNU Generl Public License", "mit licensees", None, "", "x " * 40_000 + "mit license",
    ]
    found = texts() + own
    docs = documents(spark, found)
    monkeypatch.setattr(queries, "_read", lambda *a: docs)
    got = {r.doc_id: r for r in queries.op5_license_scans(spark, "").collect()}
    assert len(got) == len(found)
    for i, t in enumerate(found):
        n, base = places(t)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), min([b[0] for b in base], default=None), max([b[0] for b in base], default=None)), t
        assert r.base_labels == ",".join(sorted({b[1] for b in base}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert (r.score == 1.0) == bool(base) and 0 <= r.score <= 1
    at = len(texts())
    assert {i: got[at + i].labels for i in (2, 3, 4, 5, 7, 8, 10)} == {2: "apache", 3: "gpl", 4: "", 5: "", 7: "", 8: "mit", 10: "gpl"}
    p = [x for x in licenses.scan(docs).filter(f"doc_id = {at + 2}").first().places]
    assert (p[0].edits, p[0].first_word, found[at + 2].encode()[p[0].first_byte : p[0].end_byte]) == (1, 1, b"Apache Licence")
    assert licenses.scan(empty(spark)).count() == 0


def test_fuzzy_notices_equal_a_search_without_seeds():
    """Seeds leave nothing out: each notice's pattern tried over every whole text."""
    r = random.Random(11)
    for _ in range(150):
        parts = []
        for _ in range(4):
            n = r.choice([x for x in licenses.FUZZY if x.edits])
            w = list(n.phrase)
            for _ in range(r.randint(0, n.edits + 1)):
                i = r.randrange(len(w))
                w[i : i + r.choice([0, 1])] = r.choice(["", "q", "e"])
            parts += [sentence(r, 3), "".join(w)]
        text = " ".join(parts)
        found = {(p[0], p[1]) for p in licenses.scan_texts(pa.array([text]))[1][0]}
        data, text_at = licenses.buffers(pa.array([text]))
        plain = licenses._joined(data, text_at)[0]
        for n in licenses.FUZZY:
            hit = any(plain[m.start() - 1] in b" \n" and plain[m.end()] in b" \n" for m in licenses._pattern(n).finditer(plain, 0, len(plain), overlapped=True))
            assert hit == ((n.label, n.phrase) in found), (n, text)


def test_long_texts_take_time_in_proportion():
    """A text of nothing but seeds: what is searched about each is as long as a notice, not as the text."""
    import time

    took = []
    for n in (1, 4):
        text = pa.array(["the license of " * (n * 70_000)])
        began = time.process_time()
        licenses.scan_texts(text)
        took.append(time.process_time() - began)
    assert took[1] < 7 * took[0] + 1, took


def test_places_in_the_result(spark, monkeypatch):
    docs = documents(spark, ["Under the Apache Licence, SPDX-License-Identifier: Apache-2.0", "GNU Lesser General Publik License"])
    monkeypatch.setattr(queries, "_read", lambda *a: docs)
    got = {r.doc_id: r for r in queries.op5_license_scans(spark, "").collect()}
    assert [(p.label, p.edits, p.first_word, p.base) for p in got[0].places] == [("apache", 1, 2, False), ("apache", 0, 4, False)]
    assert got[1].labels == "lgpl" and got[1].places[0].edits == 1 and got[1].n_base == 0


def test_licenses_with_edits_at_the_ends():
    """An edit before or behind wording that is exact otherwise, in its middle and at an end of the text."""
    one = {
        "MIT Licensed": "mit", "Apache Licensed": "apache", "GNU General Public Licenses": "gpl", "Mozilla Public Licenses": "mpl", "xapache license": "apache", "xGNU General Public License": "gpl",
    }
    two = {"GNU General Public Licensees": "gpl", "xGNU General Public Licensed": "gpl", "xMozilla Public Licensed": "mpl"}
    for edits, found in ((1, one), (2, two)):
        for wording, label in found.items():
            for before, behind in (("", ""), ("the ", " and more")):
                got = licenses.scan_texts(pa.array([before + wording + behind, "x"]))[1]
                assert [(p[0], p[2], p[4], p[5], p[6], p[7]) for p in got[0]] == [(label, len(before.split()), len(before), len(before + wording), edits, False)], wording
                assert got[1] == []
    for other in ("emit license", "mit licensees", "xapache licensed", "xxmozilla public licensed"):
        assert licenses.scan_texts(pa.array([other]))[1] == [[]], other
    # each place for itself: the exact one beside one with an edit
    got = licenses.scan_texts(pa.array(["apache license apache licensed xapache license"]))[1][0]
    assert sorted((p[2], p[6], p[7]) for p in got) == [(0, 0, True), (2, 1, False), (4, 1, False)]


def test_sharding(spark):
    found = texts()
    docs = documents(spark, found + ["y" * 9000])
    got = sharding.shard(docs, max_bytes=8192).collect()
    size = {i: len((t or "").encode()) for i, t in enumerate(found + ["y" * 9000])}
    assert {r.doc_id: r.n_bytes for r in got} == size
    by = Counter()
    for r in got:
        by[r.shard_depth, r.shard_prefix] += r.n_bytes
        h = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16)
        assert h >> (60 - r.shard_depth) == r.shard_prefix
        # only what was too large was split
        if r.shard_depth:
            up = sum(n for i, n in size.items() if int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) >> (60 - r.shard_depth + 1) == r.shard_prefix >> 1)
            assert up > 8192
    assert all(by[r.shard_depth, r.shard_prefix] == r.shard_bytes and r.oversize == (r.shard_bytes > 8192) for r in got)
    large = {r.doc_id for r in got if r.oversize}
    assert large == {i for i, n in size.items() if n > 8192}
    same = documents(spark, ["z" * 5000] * 3).selectExpr("7L AS doc_id", "text")
    assert {(r.shard_bytes, r.oversize) for r in sharding.shard(same, max_bytes=8192).collect()} == {(15000, True)}
    assert sharding.shard(empty(spark), max_bytes=10).count() == 0


def labelled(seed, n):
    r, found, labels = random.Random(seed), [], []
    for _ in range(n):
        good = r.random() < 0.7
        t = sentence(r, r.randint(20, 300))
        if not good:
            w = t.split()
            a = r.randrange(len(w))
            t = " ".join(w[:a] + [x + r.choice(["&&&", "***", "!!"]) for x in w[a : a + 30]] + w[a + 30 :])
        found.append(t)
        labels.append(int(good))
    return found, labels


def test_quality(spark):
    found, y = labelled(1, 400)
    docs = documents(spark, found + [None, "", "q" * 200_000])
    labels = spark.createDataFrame([*((i, v, 0) for i, v in enumerate(y)), (400, None, 0), (None, 1, 0), (3, y[3], 1)], "doc_id long, quality int, toxic int")
    net = quality.fit(docs, labels, steps=300)
    got = {r.doc_id: r.good for r in quality.score(docs, net, into="good").collect()}
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values()) and got[400] == got[401]
    out = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == bool(y[i]) for i in out]) > 0.9
    again = quality.fit(docs, labels, steps=300)
    assert np.array_equal(net.table, again.table)
    assert quality.score(empty(spark), net, into="good").count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert {r.good for r in quality.score(docs.limit(3), none, into="good").collect()} == {0.5}


def test_score_names_and_null_ids(spark):
    found, y = labelled(4, 60)
    net = quality.train([t.encode() for t in found], np.array(y), prior=0.5, steps=30)
    docs = spark.createDataFrame([(None, found[0], 5.0), (1, found[1], 6.0)], "doc_id long, text string, Score double")
    with pytest.raises(ValueError):
        quality.score(docs, net)
    assert {(r.doc_id, r.Score) for r in quality.score(docs, net, into="other").collect()} == {(None, 5.0), (1, 6.0)}
    assert [r[0] for r in docs.filter("doc_id is null").select(quality.held_out()).collect()] == [False]


def plain_score(net, text):
    """The network in plain loops."""
    pad, n = net.table.shape[0] - 1, len(text)
    padded, sums, best = text + bytes(pad), [], []
    for lo in range(0, max(1, n - (quality.CHUNK - quality.STEP)), quality.STEP):
        pooled = []
        for f in range(len(net.bias)):
            r = [sum(float(net.table[j, padded[i + j], f]) for j in range(pad + 1)) for i in range(lo, min(lo + quality.CHUNK, max(n, 1)))]
            pooled.append(max(max(r) + float(net.bias[f]), 0))
        sums.append(pooled)
    best = [max(c) for c in zip(*sums)]
    z = sum(float(w) * x for w, x in zip(net.weight, [*(sum(c) / len(sums) for c in zip(*sums)), *best])) + net.offset + net.shift
    return 1 / (1 + np.exp(-z))


def test_network_equals_plain_loops_and_its_gradient(monkeypatch):
    r, texts_ = np.random.default_rng(1), [b"abc", b"x" * 511, bytes(range(97, 123)) * 30, "é\n&&& ".encode() * 150]
    net = quality.Network.fresh(3, 4, 5)
    net.bias, net.offset, net.shift = r.normal(0, 0.2, 3).astype(np.float32), 0.3, -0.1
    want = [plain_score(net, t) for t in texts_]
    assert np.allclose(net.scores(pa.array(texts_, pa.binary())), want, atol=1e-5)
    monkeypatch.setattr(quality, "WINDOW", 1)  # every text by windows of its chunks
    assert np.allclose(net.scores(pa.array(texts_, pa.binary())), want, atol=1e-5)
    monkeypatch.undo()
    y = np.array([1.0, 0.0, 1.0, 0.0])
    net.table, net.bias, net.weight = (x.astype(np.float64) for x in (net.table, net.bias, net.weight))
    _, g = quality.gradients(net, texts_, y)
    for name in ("table", "bias", "weight"):
        value = getattr(net, name)
        for at in [np.unravel_index(i, value.shape) for i in np.argsort(-np.abs(g[name]).ravel())[:5]]:
            losses = []
            for step in (1e-6, -2e-6):
                value[at] += step
                losses.append(quality.gradients(net, texts_, y)[0])
            value[at] += 1e-6
            assert abs((losses[0] - losses[1]) / 2e-6 - g[name][at]) < 1e-4, name


def test_excerpts_cover_the_whole_text(spark):
    text = "".join(chr(97 + i // 4000) for i in range(100_000))
    got = spark.createDataFrame([(text,), ("short",), (None,)], "text string").select(quality.excerpt_of(F.col("text"), 6400).alias("e")).collect()
    assert got[1].e == "short" and got[2].e is None and set(got[0].e) - {"\n"} == set(text) and got[0].e[0] == "a" and got[0].e[-1] == text[-1] and len(got[0].e) <= 6464


def test_excerpts_of_many_byte_letters_stay_in_bounds(spark):
    rows = [("中文字符" * 25_000,), ("abc" * 100_000,), ("short",)]
    got = [r[0] for r in spark.createDataFrame(rows, "text string").select(quality.excerpt_of(F.col("text"), 64 << 10)).collect()]
    assert [len(x.encode()) <= (64 << 10) + 64 for x in got] == [True] * 3 and got[2] == "short" and len(got[0].encode()) > 60_000


def test_long_text_in_little_memory():
    import tracemalloc

    net = quality.Network.fresh(12, 5, 7)
    data = pa.array([b"some words & more " * 600_000], pa.binary())
    tracemalloc.start()
    net.scores(data)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20  # of 11 MB


def test_every_byte_counts():
    found, y = labelled(2, 200)
    net = quality.train([t.encode() for t in found], np.array(y), prior=0.7, steps=200)
    base = sentence(random.Random(9), 4000)
    late = base + " " + " ".join(w + "&&&" for w in base.split()[:40])
    s = net.scores(pa.array([base, late]))
    assert s[0] > s[1]
    assert np.allclose(net.scores(pa.array([base, "x", late]))[[0, 2]], s)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no driver tables")
def test_quality_on_the_drivers_rows(spark):
    rows = queries.op4_quality_classifier(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = rows[rows.held_out].merge(labels, on="doc_id")
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert (good >= 0.3).mean() > 0.97
