"""Pipeline stages on awkward tables, and the operators' SQL against their queries."""

from __future__ import annotations

import random
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from staveline.llm import catalog

SF = Path("/root/testdata/sf0.001")
#: Names that the operators use inside; here they are columns of the documents.
CLASHING = ["score", "component_id", "kept", "n_shingles", "spans", "text_a", "held", "digest", "start", "length"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def _word(r: random.Random) -> str:
    return "".join(r.choice(["th", "er", "an", "on", "re", "he", "in", "ed"]) for _ in range(r.randint(1, 3)))


def _row(doc_id, text) -> tuple:
    return (doc_id, text, "en", "s", len(text or ""), *[f"{c} of {doc_id}" for c in CLASHING])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels that tell one word, and a benchmark of one passage."""
    path, r = f"file://{tmp_path_factory.mktemp('stages')}", random.Random(9)
    spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(_word(r) for _ in range(25)))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def awkward(spark):
    r = random.Random(4)
    texts = {i: " ".join([_word(r) for _ in range(40)] + ["moron"] * (i < 120 and i % 2 == 0)) for i in range(160)}
    rows = [_row(i, t) for i, t in texts.items()]
    rows += [_row(None, "a text without id"), _row(None, None), _row(200, None), _row(201, ""), _row(202, " \t\n")]
    rows += [_row(150, texts[150]), _row(203, " ".join(_word(r) for _ in range(40_000)))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_a_stage_keeps_awkward_rows_and_all_columns(spark, folder, awkward, stage):
    name, apply = stage
    out = apply(spark, awkward, folder)
    assert out.columns == awkward.columns
    rows = out.collect()
    ids = [r.doc_id for r in rows]
    assert ids.count(None) == 2 and {200, 201, 202, 203, 151} <= set(ids)
    assert all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in CLASHING)
    assert ids.count(150) == (1 if name == "near_duplicates" else 2)
    removed = set(range(0, 120, 2)) if name == "toxicity" else set()
    assert set(range(160)) - set(ids) == removed


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_a_stage_takes_an_empty_table(spark, folder, awkward, stage):
    out = stage[1](spark, awkward.limit(0), folder)
    assert out.count() == 0
    assert stage[0] == "packing" or out.columns == awkward.columns


def test_packing_covers_awkward_rows(spark, folder, awkward):
    pieces = corpus_pipeline.packed(spark, awkward, folder).collect()
    found: dict = {}
    for p in pieces:
        found.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens))
    assert set(range(160)) | {200, 201, 202, 203} <= set(found)
    for doc_id in (1, 200, 201, 203):
        at = 0
        for start, length, total in sorted(found[doc_id]):
            assert start == at
            at += length
        assert at == total


@pytest.mark.skipif(not SF.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = catalog.queries()[name](spark, str(SF))
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    plain = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    assert sorted((plain(r) for r in got.select(columns).collect()), key=repr) == sorted(map(plain, want), key=repr)
