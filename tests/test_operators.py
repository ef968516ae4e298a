"""Edge rules of the relational operators, against plain Python."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from staveline.functions import notation, rational, rounding, text
from staveline.operators import intervals, runs, sequential, tiles
from staveline.operators.components import connected_components


def _one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_rounding_family(spark):
    values = [2.5, 3.5, -2.5, 0.5, 1.4999, 2.675, -0.1]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    out = df.select(rounding.round_half_even("x").alias("r"), rounding.py_round("x", 2).alias("p"), rounding.round_half_away("x").alias("a")).collect()
    assert [r.r for r in out] == [float(round(v)) for v in values]
    assert [r.p for r in out] == [round(v, 2) for v in values]
    assert [r.a for r in out] == [math.copysign(math.floor(abs(v) + 0.5), v) for v in values]
    pairs = [(7, 2), (-7, 2), (7, -2), (-7, -2), (0, 3)]
    df = spark.createDataFrame(pairs, "a long, b long")
    assert [r[0] for r in df.select(rounding.int_floor_div("a", "b")).collect()] == [a // b for a, b in pairs]
    floats = [(1.0, 0.1), (-1.0, 0.1), (0.3, 0.1), (6.0, 0.0)]
    got = [r[0] for r in spark.createDataFrame(floats, "a double, b double").select(rounding.float_floor_div("a", "b")).collect()]
    assert got[:3] == [1.0 // 0.1, -1.0 // 0.1, 0.3 // 0.1] and (got[3] is None or math.isnan(got[3]))


def test_index_arithmetic(spark):
    n = 5
    got = [r[0] for r in spark.range(-9, 10).select(rounding.reflect101("id", F.lit(n))).collect()]
    assert got == [int(np.pad(np.arange(n), 40, mode="reflect")[40 + i]) for i in range(-9, 10)]
    cases = [(a, b) for a in range(-7, 8) for b in range(-7, 8)]
    df = spark.createDataFrame(cases, "a int, b int").select(rounding.slice_bounds("a", "b", F.lit(5)).alias("s")).select("s.*")
    for (a, b), r in zip(cases, df.collect(), strict=True):
        assert list(range(5))[a:b] == list(range(5))[r.start : r.stop]
    assert _one(spark, rounding.prior_power_of_two(F.lit(17)))[0] == 16


def test_rationals_are_exact(spark):
    r = random.Random(1)
    cases = [(r.randint(-50, 50), r.randint(1, 50), r.randint(-50, 50), r.randint(1, 50)) for _ in range(60)]
    df = spark.createDataFrame(cases, "a long, b long, c long, d long")
    x, y = rational.ratio("a", "b"), rational.ratio("c", "d")
    out = df.select(rational.add(x, y).alias("s"), rational.mul(x, y).alias("m"), rational.compare(x, y).alias("o"), rational.truncated(x).alias("t")).collect()
    for (a, b, c, d), row in zip(cases, out, strict=True):
        p, q = Fraction(a, b), Fraction(c, d)
        assert Fraction(row.s.num, row.s.den) == p + q and (row.s.num, row.s.den) == (p + q).as_integer_ratio()
        assert (row.m.num, row.m.den) == (p * q).as_integer_ratio() and row.o == (p > q) - (p < q) and row.t == math.trunc(p)
    assert _one(spark, rational.ratio(F.lit(1), F.lit(0)))[0] is None
    dotted = _one(spark, rational.dotted(rational.ratio(1, 4), F.lit(1), F.lit(3), F.lit(2)).alias("d")).d
    assert Fraction(dotted.num, dotted.den) == Fraction(1, 4)


def test_pitches(spark):
    df = spark.createDataFrame([("C4",), ("A4",), ("F#3",), ("Bb2",), ("E2",), ("H1",), (None,)], "p string")
    assert [r[0] for r in df.select(notation.midi_of_pitch("p")).collect()] == [60, 69, 54, 46, 40, None, None]
    assert [r[0] for r in spark.range(58, 63).select(notation.pitch_of_midi("id")).collect()] == ["A#3", "B3", "C4", "C#4", "D4"]
    near = [r[0] for r in spark.range(12).select(notation.nearest_octave("id", F.lit(60))).collect()]
    assert near == [60, 61, 62, 63, 64, 65, 54, 55, 56, 57, 58, 59]  # a tritone goes down
    assert _one(spark, notation.ticks(F.lit(4), F.lit(1)))[0] == 1440


def test_text_parsers(spark):
    df = spark.createDataFrame([("l2",), ("O",), ("37",), ("x",), (" 7 ",), (None,)], "t string")
    assert [r[0] for r in df.select(text.fret_of("t")).collect()] == [12, 0, None, None, 7, None]
    df = spark.createDataFrame([("Am7",), ("Allegro",), ("♩=120",), ("éèàü",)], "t string")
    assert [r[0] for r in df.select(text.is_tempo_marking("t")).collect()] == [True, False, True, False]
    got = _one(spark, text.ctc_collapse(F.array(*map(F.lit, [1, 1, 0, 1, 2, 2, 0])), F.array(*map(F.lit, [0.5, 0.9, 0.9, 0.7, 0.6, 0.1, 0.2]))).alias("c")).c
    assert got.codes == [1, 1, 2] and got.score == pytest.approx(0.6)


def _spans(spark, seed, names):
    r = random.Random(seed)
    rows = [(i, r.randint(0, 2), a := r.randint(-40, 40), a + r.randint(0, 12)) for i in range(60)]
    return rows, spark.createDataFrame(rows, "{} long, k long, {} long, {} long".format(*names))


def test_overlap_joins(spark):
    a, left = _spans(spark, 1, ("i", "lo", "hi"))
    b, right = _spans(spark, 2, ("j", "from", "to"))
    meets = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]}
    pairs = intervals.overlap_pairs(left, right, ["k"], ("lo", "hi"), ("from", "to"), 7).select("i", "j").collect()
    assert sorted(map(tuple, pairs)) == sorted(meets)
    first = {r.i: r.j for r in intervals.first_match(left, right, ["k"], ("lo", "hi"), ("from", "to"), 7, left_id="i", order="j", take=["j"]).collect()}
    assert first == {x[0]: min((j for i, j in meets if i == x[0]), default=None) for x in a}
    anti = intervals.overlapping(left, right, ["k"], ("lo", "hi"), ("from", "to"), 7, left_id="i", anti=True)
    assert {r.i for r in anti.collect()} == {x[0] for x in a} - {i for i, _ in meets}


def test_order_joins(spark):
    r = random.Random(3)
    left = [(i, r.randint(0, 1), float(r.randint(0, 30))) for i in range(40)]
    right = [(i, r.randint(0, 1), float(r.randint(0, 30))) for i in range(15)]
    dl, dr = spark.createDataFrame(left, "i long, k long, t double"), spark.createDataFrame(right, "j long, k long, t double")
    asof = {x.i: x.j for x in intervals.asof_previous(dl, dr, ["k"], "t", ["j"], tie="j").collect()}
    near = {x.i: (x.j, x.distance) for x in intervals.nearest(dl, dr.withColumnRenamed("t", "u"), ["k"], "t", "u", "j", 3).collect()}
    for i, k, t in left:
        before = [(u, j) for j, kk, u in right if kk == k and u <= t]
        assert asof[i] == (max(before)[1] if before else None)
        best = min(((abs(u - t), j) for j, kk, u in right if kk == k), default=None)
        assert near[i] == ((best[1], best[0]) if best and best[0] <= 3 else (None, None))


def test_runs(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 9), (1, 2, 19), (1, 3, 30), (1, 4, None)], "k long, i long, t long")
    got = {r.i: r.island for r in runs.gap_islands(df.filter("t is not null"), ["k"], "t", "i", 10).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2}  # a gap of exactly the threshold splits
    assert [r.i for r in runs.running_change(df.withColumn("v", F.lit(None).cast("int")), ["k"], ["i"], "v").collect()] == [0]
    assert df.filter("t is not null").agg(runs.upper_median("t")).first()[0] == 19
    same = spark.createDataFrame([(1, 5.0)] * 4, "k long, v double")
    assert runs.within_sigma(same, ["k"], "v").count() == 4
    merged = runs.merge_spans(spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 1, 2), (1, 8, 9)], "k long, a long, b long"), ["k"], "a", "b")
    assert sorted(map(tuple, merged.collect())) == [(1, 0, 7, 3), (1, 8, 9, 1)]


def test_tiles(spark):
    assert _one(spark, tiles.tile_origins(F.lit(700), 320, 320))[0] == [0, 320, 380]
    assert _one(spark, tiles.tile_origins(F.lit(100), 320, 320))[0] == [0]
    t = spark.createDataFrame([(0, 0, 9), (0, 1, 9), (3, 3, 9), (5, 5, 1), (5, 6, 9)], "i long, j long, n long")
    assert sorted((r.i, r.j) for r in tiles.noisy_tiles(t, [], "n", 5).collect()) == [(0, 0), (0, 1)]


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 160)] + [(200, 200)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {x.node: x.component for x in connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges for x in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sequential_folds(spark):
    spans = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate([(0, 4), (1, 3), (3, 5), (4, 6), (0, 1)])], "k long, i long, a long, b long")
    got = {r.i: r.voice for r in sequential.lowest_free_voice(spans, ["k"], "a", "b", "i").collect()}
    assert got == {4: 0, 0: 1, 1: 0, 2: 0, 3: 1}  # touching spans share a voice
    pairs = spark.createDataFrame([(1, 1, 2, 5.0), (1, 2, 3, 9.0), (1, 3, 4, 5.0), (1, 4, 5, 0.0), (1, 1, 5, 5.0)], "k long, a long, b long, s double")
    assert sorted((r.a, r.b) for r in sequential.greedy_pairs(pairs, ["k"], "k long", "a", "b", "s").collect()) == [(1, 5), (2, 3)]
    left = spark.createDataFrame([(1, i, v) for i, v in enumerate("abcd")], "k long, i long, v string")
    right = spark.createDataFrame([(1, i, v) for i, v in enumerate("acd")], "k long, j long, v string")
    rows = sequential.align(left, right, ["k"], "k long", left_order="i", right_order="j", left_value="v", right_value="v").orderBy("place").collect()
    assert [(r.left, r.right) for r in rows] == [(0, 0), (1, None), (2, 1), (3, 2)] and rows[0].cost == 1.0
    sets = spark.createDataFrame([(1, 1, [1, 2], 1), (1, 2, [2, 3], 2), (1, 3, [3], 2), (1, 4, [9], 1), (1, 5, [3, 9], 9)], "k long, i long, m array<long>, w long")
    assert [r.i for r in sequential.drop_duplicated(sets, "k", "i", "m", "w").orderBy("place").collect()] == [2, 4]
    frags = spark.createDataFrame([(1, 1, 0, 10, 5.0, 5.0), (1, 2, 12, 20, 5.5, 6.0), (1, 3, 12, 20, 40.0, 40.0)], "p long, id long, x0 long, x1 long, y0 double, y1 double")
    chains = {r.id: (r.chain, r.place) for r in sequential.chain_fragments(frags, "p", reach=5, slope=1.0).collect()}
    assert chains == {1: (0, 0), 2: (0, 1), 3: (1, 0)}
