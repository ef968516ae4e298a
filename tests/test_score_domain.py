"""Geometry, tokens, tablature, images, page files, sinks and streams."""

from __future__ import annotations

import struct
import zlib
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from staveline.functions import geometry
from staveline.operators import images
from staveline.plans import tab, tokens
from staveline.sinks import musicxml
from staveline.sources import pages
from staveline.streaming import islands


def _rects(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i long, r {geometry.RECT}")


def test_rectangle_conventions(spark):
    rows = [(10.0, 20.0, 4.0, 8.0, float(a)) for a in (-90, -60, -45, 0, 30, 45, 60, 90, 135)]
    df = _rects(spark, rows)
    out = df.select("i", geometry.legacy_angle("r").alias("l"), geometry.normalized("r").alias("n"), geometry.corners("r").alias("c"),
                    geometry.corners(geometry.legacy_angle("r")).alias("cl"), geometry.corners(geometry.normalized("r")).alias("cn")).orderBy("i").collect()
    points = lambda c: {(round(p.x, 6), round(p.y, 6)) for p in c}
    for r in out:
        assert r.l.angle < 0 and -45 <= r.n.angle <= 45
        assert points(r.c) == points(r.cl) == points(r.cn)  # the same rectangle in every convention


def test_rectangle_predicates(spark):
    a, b = geometry.rect(0, 0, 20, 2), geometry.rect(24, 0.5, 20, 2)
    row = spark.range(1).select(
        geometry.extrapolates_to(a, b, F.lit(3.0)).alias("near"), geometry.extrapolates_to(a, geometry.rect(60, 0, 20, 2), F.lit(3.0)).alias("far"),
        geometry.extrapolates_to(a, geometry.rect(24, 2, 20, 2), F.lit(3.0)).alias("high"), geometry.may_touch(a, b).alias("touch"),
        geometry.within_size(a, min_w=20, max_h=1).alias("size"), geometry.is_valid(geometry.rect(0, 0, 0, 1)).alias("valid"),
        geometry.unit_size(F.array(*map(F.lit, [10.0, 20.0, 30.0, 40.0, 52.0]))).alias("u"),
    ).first()
    assert (row.near, row.far, row.high, row.touch, row.size, row.valid, row.u) == (True, False, False, True, False, False, 10.5)


def test_polygons(spark):
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    square = F.array(point(0, 0), point(4, 0), point(4, 3), point(0, 3))
    row = spark.range(1).select(
        geometry.polygon_area(square).alias("a"), geometry.polygon_length(square).alias("l"), geometry.unclip_distance(square).alias("d"),
        geometry.in_triangle(point(1, 1), point(0, 0), point(4, 0), point(0, 4)).alias("inside"),
        geometry.in_triangle(point(2, 0), point(0, 0), point(4, 0), point(0, 4)).alias("edge"),
        geometry.in_triangle(point(3, 3), point(0, 0), point(4, 0), point(0, 4)).alias("outside"),
    ).first()
    assert (row.a, row.l, row.d) == (12.0, 14.0, pytest.approx(12 * 1.6 / 14)) and (row.inside, row.edge, row.outside) == (True, True, False)


def _tokens(spark, rhythms, pitches=None, position="upper"):
    rows = [(1, 0, i, r, (pitches or {}).get(i, "."), position) for i, r in enumerate(rhythms)]
    return spark.createDataFrame(rows, "page long, voice long, seq long, rhythm string, pitch string, position string")


def test_chords_and_their_leading_marker(spark):
    plain = tokens.chords(_tokens(spark, ["note_4", "chord", "note_4", "note_8", "chord", "rest_8", "barline"]))
    assert [r.chord for r in plain.orderBy("seq").collect()] == [0, 0, 1, 1, 2]
    lead = tokens.chords(_tokens(spark, ["chord", "note_4", "note_8", "note_8"]))
    assert [r.chord for r in lead.orderBy("seq").collect()] == [0, 0, 1]


def test_token_clean_up(spark):
    t = tokens.chords(_tokens(spark, ["note_4", "chord", "note_8", "chord", "note_4"], {0: "C4", 2: "C4", 4: "E4"}))
    assert [r.seq for r in tokens.without_repeated_pitches(t).orderBy("seq").collect()] == [0, 4]
    t = _tokens(spark, ["clef_G2", "keySignature_1", "clef_G2", "note_4", "clef_F4", "keySignature_1", "clef_G2"])
    assert [r.seq for r in tokens.without_redundant(t).orderBy("seq").collect()] == [0, 1, 3, 4, 6]
    m = tokens.measures(_tokens(spark, ["note_4", "barline", "note_4", "note_4", "barline"]), F.col("rhythm") == "barline")
    assert [r.measure for r in m.orderBy("seq").collect()] == [0, 0, 1, 1, 1]
    lengths = spark.createDataFrame([(1, 0, i, n) for i, n in enumerate([4, 3, 4, 2])], "page long, voice long, measure long, length long")
    assert sorted(r.measure for r in tokens.short_measures(lengths).collect()) == [1, 3]  # the upper median is 4


def test_bars_are_strictly_between_their_lines(spark):
    events = spark.createDataFrame([(1, 0, i, float(x), 960) for i, x in enumerate([1, 5, 10, 12, 30])], "page long, system long, seq long, x double, ticks long")
    lines = spark.createDataFrame([(1, 0, 10.0, False, True), (1, 0, 20.0, False, False), (1, 0, 25.0, True, False)], "page long, system long, x double, repeat_start boolean, repeat_end boolean")
    got = sorted((r.seq, r.bar, r.repeat_start, r.repeat_end) for r in tab.bars(events, lines).collect())
    assert got == [(0, 0, False, True), (1, 0, False, True), (3, 1, False, False), (4, 2, True, False)]  # 10 is lost, the empty bar isn't counted


def test_fit_of_pickups_closings_and_open_notes(spark):
    rows = [(1, 0, 960, 0, False, False), (1, 1, 3840, 0, False, False), (1, 2, 2880, 0, False, True), (1, 3, 960, 1, False, False), (1, 4, 960, 2, False, False)]
    lengths = spark.createDataFrame([(*r, 5) for r in rows], "page long, bar int, known long, open long, repeat_start boolean, repeat_end boolean, count long")
    got = {r.bar: (r.pickup, r.fits, r.long) for r in tab.fit(lengths, F.lit(3840)).collect()}
    assert got == {0: (True, True, None), 1: (False, True, None), 2: (False, True, None), 3: (False, True, 2880), 4: (False, False, None)}
    assert spark.range(1).select(tab.stem_ticks(F.lit(1), F.lit(1))).first()[0] == 720
    meter = tab.vote_meter(lengths.filter("bar between 1 and 1").withColumns({"bar": F.lit(0), "count": F.lit(1).cast("long")})).first()
    assert (meter.num, meter.den) == (4, 4)


def test_tunings(spark):
    lines = spark.createDataFrame([(4,), (5,), (6,), (7,)], "n int")
    assert [r[0] and r[0][0] for r in lines.select(tab.standard_tuning(F.col("n"))).collect()] == ["E5", "D4", "E4", None]


def test_documents_parse_and_hold_their_notes(spark):
    rows = [(1, 1, m, s, step, 0, 4, 1, den, "quarter", 0, s == 2, 1) for m in (1, 2) for s, (step, den) in enumerate([("C", 4), (None, 8), ("E", 12)])]
    notes = spark.createDataFrame(rows, "page long, part int, measure int, seq int, step string, alter int, octave int, num long, den long, kind string, dots int, chord boolean, staff int")
    doc = musicxml.documents(notes, spark.createDataFrame([(1, "A & <B>")], "page long, title string")).first()
    root = ElementTree.fromstring(doc.xml.encode())
    assert root.findtext("work/work-title") == "A & <B>" and doc.divisions == 6
    assert [n.findtext("duration") for n in root.iter("note")] == ["6", "3", "2"] * 2
    assert len(root.findall("part/measure")) == 2 and len(root.findall(".//rest")) == 2 and len(root.findall(".//chord")) == 2


def _png(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape[:2]
    color = 2 if pixels.ndim == 3 else 0
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    flat = pixels.reshape(h, -1).astype(np.int64)
    lines = b""
    for y in range(h):  # a different filter for each line
        above = flat[y - 1] if y else np.zeros_like(flat[0])
        step = 3 if color else 1
        left, corner = (np.concatenate([np.zeros(step, np.int64), v[:-step]]) for v in (flat[y], above))
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0 * left, left, above, (left + above) // 2, near][y % 5]
        lines += bytes([y % 5]) + ((flat[y] - guess) & 255).astype(np.uint8).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_page_files_are_decoded(spark, tmp_path):
    rgb = np.random.default_rng(1).integers(0, 256, (11, 7, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(_png(rgb))
    (tmp_path / "b.pgm").write_bytes(b"P5\n# note\n3 2\n255\n" + bytes(range(6)))
    (tmp_path / "c.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    out = {r.page: r for r in pages.decoded(pages.page_files(spark, str(tmp_path))).collect()}
    assert (images.array_of(out["a.png"].plane.asDict()) == rgb[..., ::-1]).all()
    assert images.array_of(out["b.pgm"].plane.asDict())[..., 0].tolist() == [[0, 1, 2], [3, 4, 5]]
    assert out["c.png"].plane is None and out["c.png"].error == "bad_input"


def test_kernels_against_plain_loops(spark):
    r = np.random.default_rng(2)
    p = r.integers(0, 256, (9, 12), dtype=np.uint8)
    near = lambda y, x: p[max(0, y - 1) : y + 2, max(0, x - 2) : x + 3]
    assert (images.dilate(p, 5, 3) == [[near(y, x).max() for x in range(12)] for y in range(9)]).all()
    assert (images.erode(p, 5, 3) == [[near(y, x).min() for x in range(12)] for y in range(9)]).all()
    assert (images.resize(p, 12, 9) == p).all() and images.resize(p, 6, 4).shape == (4, 6)
    assert images.otsu(np.array([[10] * 50 + [200] * 50], np.uint8)) in range(10, 200)
    assert images.crop(p, 8.5, 5.5, 1.5, 2.5).shape == (4, 6)
    assert images.peaks(np.array([0, 3, 1, 5, 5, 2, 4, 0]), 2, 1, 2).tolist() == [1, 3, 6]


def test_components_of_masks(spark):
    r = np.random.default_rng(3)
    for _ in range(20):
        mask = (r.random((14, 17)) < 0.4).astype(np.uint8)
        labels, boxes = images.components(mask)
        seen = np.zeros_like(labels)
        for k in range(len(boxes)):
            y, x = np.argwhere(labels == k + 1)[0]
            stack, mine = [(y, x)], set()
            while stack:
                c = stack.pop()
                if c in mine or not (0 <= c[0] < 14 and 0 <= c[1] < 17) or not mask[c]:
                    continue
                mine.add(c)
                stack += [(c[0] + a, c[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            assert {tuple(t) for t in np.argwhere(labels == k + 1)} == mine and boxes[k][4] == len(mine)
            seen[tuple(zip(*mine, strict=True))] = 1
        assert (seen == mask).all()
    plane = images.plane_of(np.array([[1, 0, 1], [1, 0, 0]], np.uint8), "mask")
    df = spark.createDataFrame([(1, plane), (2, None), (3, {"kind": "mask", "width": 9, "height": 9, "data": b"x"})], f"page long, plane {images.PLANE}")
    found = images.boxes(df.filter("page < 3"), "plane", "page").collect()
    assert [(b.page, b.x, b.y, b.w, b.h, b.area) for b in found] == [(1, 0, 0, 1, 2, 2), (1, 2, 0, 1, 1, 1)]
    assert [row.ok for row in df.select(images.is_valid("plane").alias("ok")).collect()] == [True, None, False]
    grown = images.apply(df, "plane", lambda m: images.dilate(m, 3, 1), "mask", "grown").orderBy("page").collect()
    assert images.array_of(grown[0].grown.asDict()).tolist() == [[1, 1, 1], [1, 1, 0]] and grown[1].grown is None and grown[2].grown is None


def test_streams_equal_their_batch_forms(spark, tmp_path):
    rows = [(1, 1, "a", 0.0), (1, 2, "a", 5.0), (1, 3, "b", 20.0), (2, 4, "b", 1.0), (1, 5, "b", 29.0), (2, 6, "c", 40.0)]
    for k in range(0, 6, 2):
        spark.createDataFrame(rows[k : k + 2], "k long, i long, v string, at double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, i long, v string, at double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, df in (("changes", islands.running_changes(stream, "k", "i", "v")), ("runs", islands.gap_islands(stream, "k", "at", 10))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.i for r in spark.table("changes").collect()) == [1, 3, 4, 6]
    assert sorted((r.k, r.at, r.island) for r in spark.table("runs").collect()) == [(1, 0.0, 0), (1, 5.0, 0), (1, 20.0, 1), (1, 29.0, 1), (2, 1.0, 0), (2, 40.0, 1)]
