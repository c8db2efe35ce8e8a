"""The pipeline's stages against brute force."""

import os
import random

import pytest

import corpus_pipeline
from tracelake.functions.shared import shared_dir
from tracelake.llm import queries

from .data import ALNUM, LOWER, documents, sentence
from .test_pair_operators import brute_components, brute_removed
from .test_text_operators import labelled


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    found, y = labelled(3, 240)
    found = [t + " " + sentence(r, 20) for t in found]
    item, passage = sentence(r, 40), sentence(r, 60)
    found[10] += " " + item
    found[11] += " " + item
    for i in (20, 21, 22):
        found[i] += "\n" + passage
    found += [found[1], found[2] + " tail", None, ""]
    at = tmp_path_factory.mktemp("sf")
    documents(spark, found).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(y)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), found, item


def test_stages(spark, folder, tmp_path):
    sf, _, item = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = docs.count()
        if k < 4:
            assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()} if k < 4 else None
        if k == 0:
            assert set(after) < set(before) and all(after[i] == before[i] for i in after)
        if k == 1:
            found = brute_components(sorted(before.items()), 5, 0.8)
            assert set(after) == {i for i, (_, c) in found.items() if i == c}
        if k == 2:
            gone = brute_removed(sorted(before.items()))
            assert set(after) == set(before)
            assert all((after[i] == before[i]) == (gone[i][1] == 0) for i in before)
            assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text is not None)
        if k == 3:
            q = ALNUM.findall(item.translate(LOWER))
            q = set(zip(*[q[i:] for i in range(5)]))
            for i, t in before.items():
                w = ALNUM.findall((t or "").translate(LOWER))
                assert (i not in after) == (len(q & set(zip(*[w[j:] for j in range(5)]))) >= 0.8 * len(q))
        if k == 4:
            assert {r.doc_id for r in docs.collect()} == set(before)
    there = set(os.listdir(shared_dir(spark)))
    assert corpus_pipeline.run(spark, sf).count() == seen["best-fit packing"]
    left = set(os.listdir(shared_dir(spark))) - there
    assert [x.rsplit("-", 1)[0] for x in left] == ["best-fit-packing"]  # what the result reads


def test_columns_with_names_used_inside(spark, folder):
    """A table with a score of its own, in any case, keeps it through all stages."""
    sf, found, _ = folder
    docs = spark.createDataFrame([(i, t, i * 0.5, 1, 2) for i, t in enumerate(found)], "doc_id long, text string, Score double, row int, h int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "Score", "row", "h"]
    rows = docs.collect()
    assert rows and all((r.Score, r.row, r.h) == (r.doc_id * 0.5, 1, 2) for r in rows)


def test_every_operator_has_one_query():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)
