"""Neighbours, decontamination, chat repair, substring dedup, Jaccard join: against brute force."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelake.llm import chat, decontamination, jaccard, neighbours, substrings
from tracelake.llm.common import SPACED as SPACES
from tracelake.llm.common import SPACED_LOWER
from tracelake.llm.common import ngrams, words

from .data import ALNUM, LOWER, SPACED, documents, empty, sentence, texts

# ---------------------------------------------------------------- words


def test_words_are_the_same_wherever_they_stand():
    import pyarrow as pa

    long = "w" * 70_000
    a = words(pa.array(["x yé", None, "", f" {long} x\n", "x"]), SPACES)
    b = words(pa.array([f"yé {long}", "x"]), SPACES)
    assert np.diff(a.first).tolist() == [2, 0, 0, 2, 1]
    assert a.hash[0] == a.hash[3] == a.hash[4] == b.hash[2] and a.hash[1] == b.hash[0] and a.hash[2] == b.hash[1]
    assert len(set(b.hash.tolist())) == 3
    h = np.arange(50, dtype=np.uint64)
    assert ngrams(np.concatenate((h[5:30], h[:40])), 20)[25 + 5] == ngrams(h, 20)[5]
    mixed = [" ".join(random.Random(i).choices(["a", "bc", "x" * 31, "y" * 32, "z" * 33, "w" * 300], k=5000)) for i in range(3)]
    named = {}
    for t in mixed:
        for w, h in zip(t.split(), words(pa.array([t]), SPACES).hash.tolist()):
            assert named.setdefault(w, h) == h
    assert len(set(named.values())) == 6


def twins(n):
    """Two words of n letters whose sums modulo 2**64 are equal for n >= 1024, whatever the base: Thue-Morse and its complement."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [32, 33, 512, 1024, 2048, 4096])
def test_twins_have_names_of_their_own(spark, n):
    import pyarrow as pa

    a, b = twins(n)
    assert len(set(words(pa.array([f"{a} {b} {a.upper()}"]), SPACES).hash.tolist())) == 3
    lower = words(pa.array([f"{a} {a.upper()} {b}"]), SPACED_LOWER).hash.tolist()
    assert lower[0] == lower[1] != lower[2]
    found = [f"x {a} y", f"x {b} y", f"{sentence(random.Random(1), 10)} {a} {sentence(random.Random(2), 10)}", f"{sentence(random.Random(1), 10)} {b} {sentence(random.Random(2), 10)}"]
    docs = documents(spark, found)
    assert {r.doc_id: (r.component_id, r.n_links) for r in jaccard.join(docs, n=3, threshold=0.3).collect() if r.doc_id < 2} == {0: (0, 0), 1: (1, 0)}
    assert sum(r.n_removed for r in substrings.removed(docs, window=20).collect()) == 0
    assert jaccard.keep_one(docs.limit(2), n=3, threshold=0.3).count() == 2
    items = spark.createDataFrame([(1, f"x {b} y")], "item_id long, text string")
    assert [r.doc_id for r in decontamination.find(docs, items).collect()] == [1]


# ---------------------------------------------------------------- substring dedup


def brute_removed(rows, k=20):
    first, found = {}, {}
    for i, t in rows:
        w = SPACED.findall(t or "")
        for j in range(len(w) - k + 1):
            at = tuple(w[j : j + k])
            first[at] = min(first.get(at, (i, j)), (i, j))
    for i, t in rows:
        w = SPACED.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] != (i, j):
                gone[j : j + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        found[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return found


def periodic(seed, n):
    """Few words, many runs and repeats of pairs: the hard case for names."""
    r, out = random.Random(seed), []
    for _ in range(n):
        t = []
        while len(t) < r.randint(10, 200):
            t += [r.choice("abc")] * r.choice([1, 1, 2, 3, 9, 25]) if r.random() < 0.5 else [r.choice("ab"), r.choice("bc")] * r.choice([1, 2, 12])
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("found", [texts(2), periodic(1, 60), periodic(2, 60), texts(3, 12) * 2], ids=["texts", "periodic", "periodic2", "copies"])
def test_substring_dedup(spark, found):
    docs = documents(spark, found).repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removed(docs, bucket_bytes=5000, group_bytes=20_000).collect()}
    assert got == brute_removed(list(enumerate(found)))


def test_substring_edges(spark):
    assert substrings.removed(empty(spark)).count() == 0
    t = sentence(random.Random(1), 30)
    rows = [(1, t), (1, t), (None, t), (2, t + " more"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substrings.removed(docs).collect())
    assert got == Counter({(1, 30, 0): 2, (None, 30, 30): 1, (2, 31, 30): 1, (3, 0, 0): 1})


def test_substring_ids_of_any_type(spark):
    """String ids go by their order; columns with the names that are used inside stay."""
    t = sentence(random.Random(1), 30)
    rows = [("b", t, 1, 2), ("a", t, 3, 4), ("c", "no repeat here", 5, 6), (None, t, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, Number int, runs int")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.removed(docs).collect()}
    assert got == {"a": (30, 0), "b": (30, 30), "c": (3, 0), None: (30, 30)}
    left = substrings.remove(docs)
    assert left.columns == docs.columns and {(r.doc_id, r.text, r.Number, r.runs) for r in left.collect()} == {("a", t, 3, 4), ("b", "", 1, 2), ("c", "no repeat here", 5, 6), (None, "", 7, 8)}
    odd = spark.createDataFrame([(1, t, 5, 6), (2, t, 7, 8)], "doc_id long, text string, __id int, __group int")
    assert {(r.doc_id, r["__id"], r["__group"]) for r in substrings.remove(odd).collect()} == {(1, 5, 6), (2, 7, 8)}


def test_recurring_windows_are_sent_once(spark):
    """Windows that go on recurring in a task: all but the first are known without being sent, whatever the order of ids."""
    import pyarrow as pa

    r = random.Random(5)
    passage = sentence(r, 40)
    for ids in (range(40), range(40, 0, -1)):
        rows = [(i, f"{sentence(r, 30)} {passage} {sentence(r, 30)}") for i in ids]
        batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t])], names=["id", "text"]) for i, t in rows]
        seen = substrings.gathered
        substrings.gathered = lambda x, most: x
        try:
            out = pa.Table.from_batches(list(substrings._sender(20, 1)(iter(batches))))
        finally:
            substrings.gathered = seen
        sent = sum(len(substrings._read_windows(b)[0]) for b in out.column("windows").to_pylist() if b)
        alone = sum(max(0, len(t.split()) - 19) for _, t in rows) - 21 * len(rows)
        # windows in the passage: at first sight, once more when they come again, and each time that an earlier place is met
        assert sent - alone <= 21 * (len(rows) if ids == range(40, 0, -1) else 4)
        found = substrings._by_document(substrings._judge(1)(out).rename_columns(["group", "runs"]))
        covered = Counter()
        for n, runs in zip(found.column("n").to_pylist(), found.column("runs").to_pylist()):
            covered[n] = int(np.frombuffer(runs, "<i8").reshape(-1, 2)[:, 1].sum())
        assert all(covered[i] >= 21 for i in set(ids) - {min(ids)})


def test_remove_keeps_clean_texts_and_columns(spark):
    found = texts(2)
    docs = documents(spark, found)
    left = substrings.remove(docs)
    assert left.columns == docs.columns
    want = brute_removed(list(enumerate(found)))
    got = {r.doc_id: r.text for r in left.collect()}
    for i, t in enumerate(found):
        if want[i][1] == 0:
            assert got[i] == t
        else:
            assert hashlib.sha256(" ".join(SPACED.findall(got[i])).encode()).hexdigest() == want[i][2]


# ---------------------------------------------------------------- Jaccard


def brute_components(rows, n, t):
    sets, up, post = {}, {}, defaultdict(list)
    for i, x in rows:
        w = SPACED.findall((x or "").translate(LOWER))
        sets[i] = frozenset(zip(*[w[k:] for k in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else [])
        up[i] = i

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        shared = Counter(o for g in s for o in post[g])
        for g in s:
            post[g].append(i)
        for o, c in shared.items():
            if c >= t * (len(s) + len(sets[o]) - c):
                a, b = root(i), root(o)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def chains(seed, n=150):
    """Families whose copies drift apart: linked through others, not with all."""
    r, out = random.Random(seed), []
    for _ in range(6):
        w = sentence(r, r.choice([8, 15, 40, 120, 300])).split()
        for _ in range(n // 6):
            w = list(w)
            for _ in range(max(1, len(w) // r.choice([40, 60, 100]))):
                w[r.randrange(len(w))] = f"d{r.randint(0, 999)}"
            out.append(" ".join(w))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("n,t", [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
@pytest.mark.parametrize("found", [texts(4), chains(1), chains(2)], ids=["texts", "chains", "chains2"])
def test_jaccard(spark, monkeypatch, found, n, t):
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(documents(spark, found).repartition(3), n=n, threshold=t, bucket_bytes=20_000).collect()}
    assert got == brute_components(list(enumerate(found)), n, t)


def test_jaccard_edges(spark):
    assert jaccard.join(empty(spark)).count() == 0
    docs = spark.createDataFrame([(5, "a b"), (3, "A b"), (9, None), (8, ""), (None, "a b"), (5, "a b")], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs, n=3, threshold=0.9).collect())
    assert got == Counter({(5, 1, 3): 2, (3, 1, 3): 1, (9, 0, 9): 1, (8, 0, 8): 1, (None, 1, None): 1})
    kept = jaccard.keep_one(docs, n=3, threshold=0.9)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 8, 9]


def test_keep_one_keeps_one_row(spark):
    """Rows that repeat an id: one row of each component, and none of another component goes with them."""
    rows = [(3, "a b c d"), (3, "a b c d"), (5, "a b c d"), (5, "other words here"), (7, "Other words here"), (2, "alone"), (None, "a b c d"), (None, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, jaccard.keep_one(docs, n=3, threshold=0.9).collect()))
    assert got == Counter({(3, "a b c d"): 1, (5, "other words here"): 1, (2, "alone"): 1})
    # rows without an id are copies too; an id that repeats with another text stays with that text
    rows = [(None, "p q r s"), (None, "p q r s"), (None, None), (None, ""), (3, "A b c d"), (7, "a b c d"), (7, "quite another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ROW", F.lit(1)).repartition(3)
    got = Counter((r.doc_id, r.text) for r in jaccard.keep_one(docs, n=3, threshold=0.9).collect())
    assert got == Counter({(None, "p q r s"): 1, (None, None): 1, (None, ""): 1, (3, "A b c d"): 1, (7, "quite another text"): 1})


def brute_links(rows, n, t):
    """Of each row, how many other rows are similar."""
    sets = []
    for _, x in rows:
        w = SPACED.findall((x or "").translate(LOWER))
        sets.append(frozenset(zip(*[w[k:] for k in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else []))
    out = Counter()
    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        if a and b and rows[i][0] is not None and rows[j][0] is not None and len(a & b) >= t * len(a | b):
            out.update((i, j))
    return Counter((x[0], None if x[0] is None else out[i]) for i, x in enumerate(rows))


@pytest.mark.parametrize("n,t", [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_jaccard_counts_every_link(spark, monkeypatch, n, t):
    """Families over several blocks, exact copies of near copies, repeated rows, and rows without an id."""
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    w = sentence(random.Random(6), 200).split()
    found = chains(3, 60) + texts(4, 60) + [" ".join([*w[: 6 * k], f"d{k}", *w[6 * k + 1 :]]) for k in range(30)]
    rows = list(enumerate(found)) + [(1000 + i, x) for i, x in enumerate(found[::3])] + list(enumerate(found))[:9] + [(None, found[0]), (None, found[1]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_links(rows, n, t)
    assert max(k[1] or 0 for k in want) > 30
    assert Counter((r.doc_id, r.n_links) for r in jaccard.join(docs, n=n, threshold=t, bucket_bytes=20_000).collect()) == want


def test_links_within_gives_all_pairs():
    r = random.Random(4)
    base = r.sample(range(1000), 60)
    sets = [np.array(sorted(set(base) - set(r.sample(base, 2))), np.uint64) for _ in range(30)] + [np.array([1, 2, 3], np.uint64)]
    t = Fraction(9, 10)
    pairs = {(a, b) for a, b in itertools.combinations(range(31), 2) if 10 * len(np.intersect1d(sets[a], sets[b])) >= 9 * len(np.union1d(sets[a], sets[b]))}
    assert len(pairs) > 100 and sorted(jaccard.links_within(sets, t)) == sorted(pairs)
    assert sorted(jaccard.links_within(sets, t, 12)) == sorted(p for p in pairs if p[0] < 12 <= p[1])


def test_trie_walk():
    r = random.Random(3)
    for _ in range(40):
        base = sorted(r.sample(range(200), 40))
        sets = [np.array(sorted({*base, *r.sample(range(200), r.randint(0, 6))} - {*r.sample(base, r.randint(0, 6))}), np.uint64) for _ in range(15)] + [np.array(r.sample(range(200), 5), np.uint64)]
        sets = [np.unique(s) for s in sets]
        t = Fraction(r.choice([5, 8, 9]), 10)
        up = list(range(len(sets)))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        other = list(up)
        for a, b in jaccard.links_within(sets, t):
            inter = len(np.intersect1d(sets[a], sets[b]))
            assert inter >= t * (len(sets[a]) + len(sets[b]) - inter)
            up[root(a)] = root(b)
        first = [root(i) for i in range(len(sets))]
        up = other
        for a, b in itertools.combinations(range(len(sets)), 2):
            inter = len(np.intersect1d(sets[a], sets[b]))
            if inter >= t * (len(sets[a]) + len(sets[b]) - inter):
                up[root(a)] = root(b)
        second = [root(i) for i in range(len(sets))]
        assert all((first[a] == first[b]) == (second[a] == second[b]) for a, b in itertools.combinations(range(len(sets)), 2))


def test_components(spark):
    r = random.Random(1)
    edges = [(a, b) for a, b in ((r.randint(0, 400), r.randint(0, 400)) for _ in range(250))] + [(1000 + i, 1001 + i) for i in range(40)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}


# ---------------------------------------------------------------- decontamination


def test_decontamination(spark):
    r = random.Random(7)
    items = [sentence(r, n) for n in (3, 4, 5, 9, 16, 17, 31, 40, 59, 120)] + [None, "", "?!"]
    found = []
    for i in range(150):
        w, item = sentence(r, r.choice([5, 60, 900])).split(), (r.choice(items) or "").split()
        if i % 3:
            item = list(item)
            for _ in range(r.choice([0, 0, 1, 2])):
                if item:
                    item[r.randrange(len(item))] = "changed"
            if i % 5 == 0:
                item = item[: len(item) * 9 // 10]
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() + "," for x in item]
        found.append(" ".join(w))
    found += [None, ""]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, key int")

    def shingles(t):
        w = ALNUM.findall((t or "").translate(LOWER))
        return w, set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set()

    want = set()
    for d, t in enumerate(found):
        w, own = shingles(t)
        for i, x in enumerate(items):
            iw, q = shingles(x)
            if q and (len(iw) >= 5 and len(q & own) >= 0.8 * len(q) or len(iw) < 5 and any(w[a : a + len(iw)] == iw for a in range(len(w)))):
                want.add((d, i))
    docs = documents(spark, found)
    got = decontamination.find(docs, bench)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want and len(want) > 15
    left = decontamination.decontaminate(docs, bench)
    assert left.columns == docs.columns and {x.doc_id for x in left.collect()} == set(range(len(found))) - {d for d, _ in want}
    assert decontamination.find(empty(spark), bench).count() == 0
    # each row is judged by its text: no id, an id that repeats, and columns with names that are used inside
    odd = spark.createDataFrame([(None, items[7], 1), (1, items[7], 2), (1, "a clean text", 3), (None, "clean too", 4), (2, None, 5)], "doc_id long, text string, Digest int")
    assert sorted(x.Digest for x in decontamination.decontaminate(odd, bench).collect()) == [3, 4, 5]
    assert decontamination.find(docs, bench.limit(0)).count() == 0


# ---------------------------------------------------------------- neighbours


def test_neighbours(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(20, 16))
    x = (centres[r.integers(0, 20, 3000)] + 0.5 * r.normal(size=(3000, 16))).astype(np.float32)
    x[100:160] = x[50]  # equal vectors
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(5000, None, 0), (5050, [0.0] * 16, 0), (5100, [float("nan")] * 16, 0), (5150, [1.0] * 3, 0), (5200, [None] * 16, 0), (None, x[0].tolist(), 0), (5250, [float("inf")] * 16, 0)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int")
    got = neighbours.search(vectors, F.col("id") % 50 == 0, k=5).collect()
    y = x.astype(np.float64)
    norm = np.sqrt((y * y).sum(1))
    hits = 0
    for q in range(0, 3000, 50):
        own = sorted((g for g in got if g.query_id == q), key=lambda g: g["rank"])
        assert [g["rank"] for g in own] == [1, 2, 3, 4, 5] and q not in [g.vec_id for g in own]
        s = (y * y[q]).sum(1) / (norm * np.sqrt((y[q] * y[q]).sum()))
        assert all(g.score == s[g.vec_id] for g in own)
        assert [(-g.score, g.vec_id) for g in own] == sorted((-g.score, g.vec_id) for g in own)
        s[q] = -9
        hits += len({g.vec_id for g in own} & set(np.lexsort((np.arange(3000), -s))[:5].tolist()))
    assert hits / 300 >= 0.9 and len(got) == 300
    # the data clusters, so a query needs few of the leaves, and no leaf but that of equal vectors is large
    assert got[0].leaves <= 0.35 * got[0].of_leaves and got[0].recall >= 0.94
    few = neighbours.search(vectors.filter("vec_id in (0, 1, 2)"), F.col("id") % 50 == 0, k=5).collect()
    assert len(few) == 2
    assert neighbours.search(vectors.limit(0), F.col("id") % 50 == 0).count() == 0


def test_neighbours_of_extreme_doubles(spark):
    """Cosines do not depend on lengths, whatever squares would overflow or vanish."""
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 6))
    scale = np.array([1.0, 1e200, 1e-200, 1e-310, 1e300] * 8)[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base * scale)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for x in neighbours.search(rows, F.col("id") % 4 == 0, k=5).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, round(x.score, 6)))
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    for q in range(0, 40, 4):
        near = sorted(((-(unit[q] @ unit[i]), i) for i in range(40) if i != q))[:5]
        assert [i for i, _ in got[q]] == [i for _, i in near] and np.allclose([s for _, s in got[q]], [-s for s, _ in near], atol=1e-5)


def test_leaves_are_split_in_rounds(spark):
    """A top fitted on a small sample: its leaves are split again until all are small; equal vectors stay together."""
    r = np.random.default_rng(2)
    x = r.normal(size=(2500, 8))
    x[:400] = x[0]
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    top = neighbours.Tree.fit(neighbours._unit(x[::50]), 3, 20)
    index = neighbours.build_index(rows, top, 3, 20)
    sizes = {c.cell: c["count"] for c in index.vectors.groupBy("cell").count().collect()}
    assert sum(sizes.values()) == 2500 and len(sizes) == index.leaves and sorted(sizes.values())[-2] <= 40 and max(sizes.values()) >= 400
    assert max(c.count(".") for c in sizes) >= 1
    queries = rows.filter("id % 500 = 499")
    # all leaves are reached in the end, and the best first
    met = neighbours.visit(index, queries, 10_000)
    assert met.groupBy("id").count().filter(f"count <> {len(sizes)}").count() == 0
    few = {(m.id, m.cell) for m in neighbours.visit(index, queries, 5).collect()}
    own = {(v.id, v.cell) for v in index.vectors.filter("id % 500 = 499").collect()}
    assert len(few) == 25 and len(few & own) >= 4


# ---------------------------------------------------------------- chat


def cheapest(roles, costs=chat.USUAL):
    """All choices tried."""
    best = 10**9
    for states in itertools.product(range(1, 4), repeat=len(roles)):
        cost, at = 0, 0
        for role, to in zip(roles, states):
            if (at, to) not in costs.links:
                cost = 10**9
                break
            cost, at = cost + costs.links[at, to][0] + costs.relabel * (role != chat.STATES[to]), to
        best = min(best, cost + costs.ends[at][0])
    return best


def legal(roles):
    body = roles[1:] if roles[:1] == ["system"] else roles
    return bool(body) and len(body) % 2 == 0 and all(x == ("user", "assistant")[i % 2] for i, x in enumerate(body))


def test_chat_repair_is_cheapest():
    r = random.Random(4)
    for _ in range(300):
        roles = [r.choice(["user", "assistant", "system", "tool", None]) for _ in range(r.randint(1, 7))]
        rows = chat.repair_turns(roles, [f"t{i}" for i in range(len(roles))])
        assert sum(x[4] for x in rows) == cheapest(roles)
        assert legal([x[2] for x in rows if "merge" not in x[3]])
        text = "".join(x[5] for x in rows)
        assert text.count("<|end|>") == sum("merge" not in x[3] for x in rows) and all(f"t{i}" in text for i in range(len(roles)))
        # a stretch's matrix says the same as the whole
        m = chat.stretch_costs(roles)
        assert min(m[0, s] + chat.USUAL.ends[s][0] for s in range(1, 4)) == cheapest(roles)


def test_costs_decide_between_merging_and_inserting(spark):
    r, dear = random.Random(6), chat.Costs(merge=9, insert=2, relabel=4)
    for _ in range(200):
        roles = [r.choice(["user", "assistant", "system", None]) for _ in range(r.randint(1, 6))]
        rows = chat.repair_turns(roles, [""] * len(roles), costs=dear)
        assert sum(x[4] for x in rows) == cheapest(roles, dear) and legal([x[2] for x in rows if "merge" not in x[3]])
    two = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert [r.action for r in chat.repair(two, merge=9).orderBy("place", "step").collect()] == ["keep", "insert", "keep", "keep"]
    assert [r.action for r in chat.repair(two).orderBy("place", "step").collect()] == ["keep", "merge", "keep"]
    assert chat.links()[2, 2] == (chat.MERGE, (), True)
    assert chat.links(merge=5, insert=2)[2, 2] == (2, (3,), False) and chat.links(merge=5, insert=2)[3, 3] == (2, (2,), False)


def test_a_row_for_each_short_conversation(spark):
    """Over many partitions, and in stretches smaller than all conversations together: only what is larger than a stretch has parts."""
    rows = [(f"c{c}", t, ["user", "assistant"][t % 2], f"text {c} {t}") for c in range(60) for t in range(1 + c % 7)] + [("big", t, "user", "x" * 50) for t in range(100)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    for at_once in (300, 4000, 16 << 20):
        shown = chat.render(chat.repair(df.repartition(9), stretch_bytes=at_once))
        parts = {r.conv_id: r["count"] for r in shown.groupBy("conv_id").count().collect()}
        assert len(parts) == 61 and all(n == 1 for c, n in parts.items() if c != "big") and (parts["big"] > 1) == (at_once < 5000)


def test_chat_over_partitions(spark):
    r = random.Random(5)
    rows = []
    for c, n in enumerate([400, 1, 2, 5, 9, 300, 3]):
        rows += [(c, t, r.choice(["user", "assistant", "system", None, "USER "]), r.choice([f"text {t}", None, ""]), "x") for t in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, action string")
    got = chat.repair(df, stretch_bytes=400)
    assert got.select("place").distinct().count() > 10
    out = defaultdict(list)
    for x in got.collect():
        out[x.conv_id].append(x)
    assert got.filter("step = 0 or action <> 'insert'").select("conv_id", "turn").distinct().count() == len(rows)
    by = defaultdict(list)
    for c, t, role, text, _ in sorted(rows, key=lambda x: (x[0], x[1])):
        by[c].append((role.strip().lower() if role else None, text or ""))
    text = defaultdict(str)
    for x in chat.render(got).orderBy("part").collect():
        text[x.conv_id] += x.text
    for c, turns in by.items():
        want = chat.repair_turns([a for a, _ in turns], [b for _, b in turns])
        own = sorted(out[c], key=lambda x: (x.place, x.step))
        assert sum(x.cost for x in own) == sum(x[4] for x in want)
        assert legal([x.role for x in own if "merge" not in x.action])
        assert text[c] == "".join(x.fragment for x in own)
    assert chat.repair(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None)], df.schema.simpleString()[7:-1].replace(":", " ").replace(",action string", "").replace("bigint", "long"))
    assert [(x.conv_id, x.role) for x in chat.repair(nulls).orderBy("step").collect()] == [(None, "user"), (None, "assistant")]
    # no id and an empty one are two conversations
    both = spark.createDataFrame([(None, 1, "user", "a"), ("", 1, "user", "b"), ("=", 1, "user", "c")], "conv_id string, turn long, role string, text string")
    shown = {x.conv_id: (x.turns, x.inserted, x.merged, x.cost, x.text) for x in chat.render(chat.repair(both)).collect()}
    assert shown == {c: (2, 1, 0, 2, f"<|user|>\n{t}<|end|>\n<|assistant|>\n<|end|>\n") for c, t in ((None, "a"), ("", "b"), ("=", "c"))}


def test_a_region_gives_a_query_its_best_once_however_many_leaves(monkeypatch):
    monkeypatch.setattr(neighbours, "FOUND_AT_ONCE", 40)
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 6))
    piece = [f"{i % 20:02d}/0" for i in range(300)]  # 20 leaves
    asked = {0: sorted(set(piece)), 7: sorted(set(piece))[:3], 300: ["05/0"], 301: ["none/0"]}
    qv = {q: x[q] if q < 300 else r.normal(size=6) for q in asked}
    block = {"region": 2, "ask": 1}
    rows = [{**block, "piece": None, "id": q, "vec": qv[q], "asked": asked[q]} for q in asked]
    rows += [{**block, "piece": piece[i], "id": i, "vec": x[i], "asked": None} for i in sorted(range(300), key=lambda i: piece[i])]
    rows += [{**block, "region": 3, "piece": piece[i], "id": i, "vec": x[i], "asked": None} for i in range(20)]  # nobody asks there
    table = pd.DataFrame(rows)
    for size in (7, 1000):  # batches are cut anywhere
        got = pd.concat(neighbours._in_regions((table.iloc[i : i + size].reset_index(drop=True) for i in range(0, len(table), size)), 4))
        want = []
        for q, leaves in asked.items():
            near = [(-float(x[i] @ qv[q] / np.linalg.norm(x[i]) / np.linalg.norm(qv[q])), i) for i in range(300) if i != q and piece[i] in leaves]
            want += [(q, i) for _, i in sorted(near)[:4]]
        assert sorted(zip(got["query_id"], got["vec_id"])) == sorted(want)  # four a query, and not four a leaf
