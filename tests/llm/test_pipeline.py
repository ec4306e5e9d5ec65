"""The pipeline's stages against brute force, on odd rows."""

import random

import pytest

import corpus_pipeline
from frameloom.llm import secrets
from llm.test_operators import ODD, edited, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _id string, _n int, x string, features string, _key long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    items = [prose(900 + k, 30) for k in range(5)] + [None, ""]
    texts = [t for t in ODD if t is None or len(t) < 10_000]
    texts += [prose(k, 80) + " you idiot, what a loser" for k in range(40)] + [prose(100 + k, 80) for k in range(60)]
    texts += [edited(prose(100, 80), 1, k) for k in range(5)] + [prose(300, 40) + " " + items[1] + " " + prose(301, 40), prose(302, 60) + ' token = "0641917ea4e9feb9cda83477b57ac2654884f485"']
    rows = [(i if i != 4 else None, t, "en", "s", len(t or ""), 0.5, "a", 1, "b", "c", 9) for i, t in enumerate(texts)]
    spark.createDataFrame(rows + [rows[-1]], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int("idiot" in (t or ""))) for i, t in enumerate(texts) if i % 5], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        after = docs.collect()
        kept = {r["doc_id"] for r in after}
        gone = [r for r in before if r["doc_id"] not in kept]
        assert all(r["score"] == 0.5 and r["_id"] == "a" and r["_key"] == 9 for r in after)
        if name == "toxicity":
            assert {("idiot" in (r["text"] or "")) for r in gone} == {True} and not any("idiot" in (r["text"] or "") for r in after)
        elif name == "near_duplicates":
            assert len(after) == len(kept) and sum((r["text"] or "").split()[:1] == prose(100, 80).split()[:1] for r in after) <= 2
            assert len({r["text"] for r in before}) - len(after) in (4, 5)
        elif name == "decontamination":
            assert len(gone) == 1 and prose(901, 30) in gone[0]["text"]
        else:
            assert len(before) == len(after) and sum("<SECRET>" in (r["text"] or "") for r in after) == 1
            assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in after)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len(out) == docs.count()


def test_run_and_empty(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 50
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mask_keeps_the_rest():
    assert secrets.masked("abc def ghi", [(4, 7)]) == "abc <SECRET> ghi" and secrets.masked("abc", []) == "abc"
