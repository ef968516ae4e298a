"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from staveline.plans import catalog

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool) or not hasattr(v, "__float__"):
        return str(v)
    return repr(round(float(v), 6) + 0.0)


def _rows(frame: pd.DataFrame) -> list[tuple]:
    cols = sorted(frame.columns)
    return sorted(tuple(map(_cell, r)) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, str(SF)).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, str(SF)).count() > 0


def test_voices_are_the_lowest_free_ones(spark):
    spans: dict = {}
    for r in catalog.queries()["voice_colouring"](spark, str(SF)).collect():
        spans.setdefault(r.o_custkey, []).append((r.lo, r.hi, r.o_orderkey, r.voice))
    for own in spans.values():
        ends: list = []
        for lo, hi, _, voice in sorted(own):
            want = next((k for k, e in enumerate(ends) if e <= lo), len(ends))
            ends[want : want + 1] = [hi]
            assert voice == want


def test_pairs_are_taken_greedily(spark, duck):
    got = {(r.n_regionkey, r.n1, r.n2) for r in catalog.queries()["best_pair_greedy"](spark, str(SF)).collect()}
    nations, want = duck.execute("SELECT n_regionkey, n_nationkey FROM nation ORDER BY 2").fetchall(), set()
    for region in {r for r, _ in nations}:
        own = [n for r, n in nations if r == region]
        taken: set = set()
        for _, a, b in sorted((-((a * 7 + b * 3) % 11), a, b) for a in own for b in own if a < b and (a * 7 + b * 3) % 11):
            if not taken & {a, b}:
                taken |= {a, b}
                want.add((region, a, b))
    assert got == want


def test_alignments_are_the_cheapest(spark, duck):
    rows: dict = {}
    for r in catalog.queries()["alignment"](spark, str(SF)).collect():
        rows.setdefault(r.user_id, []).append((r.place, r.left, r.right, r.cost))
    hours = {}
    for user, kind, event, hour in duck.execute("SELECT user_id, event_type, event_id, hour(ts) FROM events WHERE event_type IN ('purchase', 'click') ORDER BY event_id").fetchall():
        hours.setdefault(user, {"purchase": [], "click": []})[kind].append((event, hour))
    assert set(rows) == set(hours)
    for user, own in hours.items():
        a, b = own["purchase"], own["click"]
        cost = [[float(i + j) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, (_, x) in enumerate(a, 1):
            for j, (_, y) in enumerate(b, 1):
                cost[i][j] = min(cost[i - 1][j - 1] + (x != y), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
        got = sorted(rows[user])
        value = dict(a) | dict(b)
        assert [x for _, x, _, _ in got if x is not None] == [e for e, _ in a] and [y for _, _, y, _ in got if y is not None] == [e for e, _ in b]
        assert sum(1 if x is None or y is None else value[x] != value[y] for _, x, y, _ in got) == got[0][3] == cost[-1][-1]


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_subsets_are_found_in_every_order(spark, duck):
    got = catalog.queries()["subset_test"](spark, str(SF))
    blocks, orders = {r.l_orderkey // 8 for r in got.collect()}, duck.execute("SELECT DISTINCT l_orderkey FROM lineitem").fetchall()
    assert max(blocks) >= 400 // 8 and max(blocks) <= max(o for (o,) in orders) // 8


@pytest.mark.skipif(not SF.with_name("sf0.01").exists(), reason="needs the test tables")
def test_a_document_is_written_for_every_order(spark):
    sf = SF.with_name("sf0.01")  # its orders reach beyond 2000
    got = {r.page for r in catalog.queries()["score_export"](spark, str(sf)).collect()}
    assert got == {o for (o,) in duckdb.sql(f"SELECT DISTINCT l_orderkey FROM '{sf}/lineitem.parquet'").fetchall()} and max(got) > 2000
