"""The pipeline over a small folder, and the registration of all queries."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from staveline.llm import catalog


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(6)
    word = lambda: "".join(r.choice(["th", "er", "an", "on", "re", "he", "in", "ed"]) for _ in range(r.randint(1, 3)))
    texts = {i: " ".join(word() for _ in range(60)) for i in range(300)}
    labels = []
    for i in range(0, 200, 2):
        words = texts[i].split()
        words[7] = "moron"
        texts[i] = " ".join(words)
    labels = [(i, 1, int(i % 2 == 0)) for i in range(200)]
    texts[250] = texts[249]
    texts[252] = texts[251] + " end"
    bench = " ".join(word() for _ in range(25))
    texts[260] += " " + bench
    texts[270] += " mail a@b.org"
    texts[280], texts[281] = None, ""
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    docs = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_each_stage_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            kept[name] = {r.doc_id: r for r in docs.collect()}
    assert set(kept["toxicity"]) == set(range(300)) - set(range(0, 200, 2))
    assert set(kept["toxicity"]) - set(kept["near_duplicates"]) == {250, 252}
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {260}
    assert kept["personal_data"][270].text.endswith("mail <EMAIL>")
    assert all(r.n_chars == len(r.text) for r in kept["personal_data"].values() if r.text)
    assert {r.doc_id for r in docs.collect()} == set(kept["personal_data"])


def test_run_is_its_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(range(300)) - set(range(0, 200, 2)) - {250, 252, 260}


def test_all_queries_are_registered():
    names = catalog.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n != "pipeline"} == {f"op{k}" for k in range(1, 11)}
    assert len(corpus_pipeline.STAGES) == 5
