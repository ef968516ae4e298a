"""Page layout operators, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from staveline.plans import layout

STAFF = "page long, staff long, min_x double, max_x double, min_y double, max_y double, unit double"


def test_free_rows_and_sight(spark):
    r = random.Random(2)
    rows = [(p, i, float(r.randint(0, 100)), float(r.randint(150, 900)), y := float(r.randint(0, 900)), y + r.randint(20, 60), 10.0) for p in (1, 2) for i in range(12)]
    df = spark.createDataFrame(rows, STAFF)
    for x in layout.free_rows(df).collect():
        mine = [q for q in rows if q[0] == x.page]
        assert x.above == max((q[5] for q in mine if q[4] < x.min_y), default=0)
        assert x.below == min((q[4] for q in mine if q[5] > x.max_y), default=layout.NO_STAFF_BELOW)
    page = df.withColumns({"width": F.lit(1000.0), "height": F.lit(940.0)})
    assert {(x.page, x.staff) for x in layout.in_sight(page).collect()} == {(q[0], q[1]) for q in rows if q[5] < 940}


def test_grand_staffs(spark):
    staffs = spark.createDataFrame([(1, i, 100.0, 900.0, 100.0 * i, 100.0 * i + 40, 10.0) for i in range(4)], STAFF)
    braces = spark.createDataFrame([(1, 0, 90.0, 70.0, 5.0, 140.0), (1, 1, 95.0, 270.0, 5.0, 130.0), (1, 2, 300.0, 170.0, 5.0, 140.0)], "page long, brace long, cx double, cy double, w double, h double")
    assert sorted((x.upper, x.lower) for x in layout.grand_staffs(staffs, braces).collect()) == [(0, 1), (2, 3)]


def test_titles_and_crops(spark):
    texts = spark.createDataFrame([(1, 0, "♩=120", 0.0, 90.0), (1, 1, "The Kesh, jig!", 0.0, 42.0), (1, 2, "Other Tunes..", 0.0, 39.0), (2, 0, "Am", 0.0, 9.0)], "page long, seq long, text string, top double, bottom double")
    assert [(x.page, x.title) for x in layout.titles(texts).collect()] == [(1, "The Kesh jig")]
    crop = F.struct(F.lit(0.1).alias("x0"), F.lit(0.9).alias("x1"), F.lit(0.0).alias("y0"), F.lit(0.5).alias("y1"))
    staff = F.struct(F.lit(3).alias("index"), F.lit(0.5).alias("cx"), F.lit(0.5).alias("cy"), F.lit(1.0).alias("w"), F.lit(0.2).alias("h"))
    row = spark.range(1).select(layout.column_in_page(F.lit(0.5), crop).alias("x"), layout.staff_in_page(staff, crop).alias("s"), layout.chord_strip(staff, F.lit(1000), F.lit(800)).alias("c")).first()
    assert row.x == pytest.approx(0.5) and (row.s.cx, row.s.cy, row.s.w, row.s.h) == pytest.approx((0.5, 0.25, 0.8, 0.1))
    assert (row.c.x0, row.c.x1, row.c.y0, row.c.y1) == (0, 1000, 16, 312)


def test_notes_meet_their_columns(spark):
    heads = spark.createDataFrame([(1, 0, i, x, p, 10.0) for i, (x, p) in enumerate([(0.0, 2), (3.0, 4), (11.0, 6), (30.0, 5), (38.0, 1)])], "page long, staff long, head long, x double, position long, unit double")
    columns = layout.note_columns(heads)
    assert [(c.column, c.positions) for c in columns.orderBy("column").collect()] == [(0, [2, 4]), (1, [6]), (2, [5]), (3, [1])]  # 8 is not less than 8
    events = spark.createDataFrame([(1, 0, 0, 1.0, 4), (1, 0, 1, None, 5), (1, 0, 2, 39.0, 2), (1, 0, 3, 40.0, 9), (2, 0, 0, 1.0, 1)], "page long, staff long, event long, x double, position long")
    got = {(x.page, x.event): x.column for x in layout.align_notes(events, columns).collect()}
    assert got == {(1, 0): 0, (1, 1): 2, (1, 2): 3, (1, 3): None, (2, 0): None}
