"""Queries of boxes, index arithmetic, pitches, tokens and page layout over the general-purpose tables, each with its SQL.

As in ``catalog``: the SQL is written from the operator's definition, doubles are rounded, every order is total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staveline.functions import geometry, half, notation, rounding, text
from staveline.plans import layout, tokens
from staveline.plans.registry import query, table

_ROW = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def _rects(spark, sf_dir) -> DataFrame:
    sides = (F.col("l_partkey") % 17 + 1, F.col("l_suppkey") % 13 + 1)
    r = geometry.rect(F.col("l_quantity") + 1000, F.col("l_linenumber") + 2000, *sides, F.col("l_partkey") % 271 - 135)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", *_ROW, r.alias("r"))


_RECTS = """
    WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(l_quantity AS DOUBLE) + 1000 AS cx, CAST(l_linenumber AS DOUBLE) + 2000 AS cy,
                      CAST(l_partkey % 17 + 1 AS DOUBLE) AS w, CAST(l_suppkey % 13 + 1 AS DOUBLE) AS h, CAST(l_partkey % 271 - 135 AS DOUBLE) AS a FROM lineitem)"""


@query(_RECTS + """,
    t AS (SELECT *, CAST(greatest(floor(a / 90) + 1, 0) AS BIGINT) AS q, CAST(greatest(ceil((abs(a) - 45) / 90), 0) AS BIGINT) AS k FROM r)
    SELECT l_orderkey, l_linenumber, CASE WHEN q % 2 = 1 THEN h ELSE w END AS legacy_w, a - 90 * q AS legacy_angle,
           CASE WHEN k % 2 = 1 THEN h ELSE w END AS normal_w, a - sign(a) * 90 * k AS normal_angle,
           w + 3 AS thick_w, h + 3 AS thick_h, cy - 2 AS tall_cy, h + 5 AS tall_h, greatest(w, 6) AS least_w, greatest(h, 4) AS least_h, w >= 3 AND h <= 9 AS sized
    FROM t""")
def rect_transforms(spark, sf_dir):
    """Rectangles in both angle conventions, grown, raised and tested for size."""
    r = "r"
    legacy, normal = geometry.legacy_angle(r), geometry.normalized(r)
    thick, tall, least = geometry.thicker(r, 3), geometry.taller(r, 5, keep_center=False), geometry.at_least(r, 6.0, 4.0)
    return _rects(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", legacy["w"].alias("legacy_w"), legacy["angle"].alias("legacy_angle"), normal["w"].alias("normal_w"),
        normal["angle"].alias("normal_angle"), thick["w"].alias("thick_w"), thick["h"].alias("thick_h"), tall["cy"].alias("tall_cy"),
        tall["h"].alias("tall_h"), least["w"].alias("least_w"), least["h"].alias("least_h"), geometry.within_size(r, min_w=3, max_h=9).alias("sized"),
    )


@query(_RECTS + """,
    t AS (SELECT *, cos(radians(a)) / 2 AS b, sin(radians(a)) / 2 AS c FROM r)
    SELECT l_orderkey, l_linenumber, round(cx - h * c - w * b, 6) AS x1, round(cy + h * b - w * c, 6) AS y1, round(cx + h * c - w * b, 6) AS x2,
           round(cy - h * b - w * c, 6) AS y2, round(cx + h * c + w * b, 6) AS x3, round(cy - h * b + w * c, 6) AS y3 FROM t""")
def rect_corners(spark, sf_dir):
    """Corners of turned rectangles, the last one (which the other three fix) left out."""
    at = lambda k, axis: F.round(geometry.corners("r")[k][axis], 6).alias(f"{axis}{k + 1}")
    return _rects(spark, sf_dir).select("l_orderkey", "l_linenumber", *[at(k, axis) for k in range(3) for axis in "xy"])


@query(_RECTS + """,
    s AS (SELECT *, a / 9 AS tilt FROM r),
    p AS (SELECT *, lead(cx) OVER o AS cx2, lead(cy) OVER o AS cy2, lead(w) OVER o AS w2, lead(h) OVER o AS h2, lead(tilt) OVER o AS tilt2, row_number() OVER o AS seq
          FROM s WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)),
    m AS (SELECT *, sqrt((cx - cx2) ** 2 + (cy - cy2) ** 2) AS d, (cx + cx2) / 2 AS mid FROM p WHERE cx2 IS NOT NULL)
    SELECT l_orderkey, seq, round(d, 6) AS distance, d <= greatest(w, h) + greatest(w2, h2) AS touch,
           greatest(abs(cx - mid) - floor(w / 2), 0) + greatest(abs(cx2 - mid) - floor(w2 / 2), 0) <= 20
           AND abs(cy + (mid - cx) * tan(radians(tilt)) - cy2 - (mid - cx2) * tan(radians(tilt2))) <= 4 / 3 AS carries_on
    FROM m""")
def line_neighbours(spark, sf_dir):
    """Each line piece and the next of its order: how far apart, whether they may touch and whether they carry on into each other."""
    w = Window.partitionBy("l_orderkey").orderBy(*_ROW)
    r = F.col("r")
    tilted = geometry.rect(r["cx"], r["cy"], r["w"], r["h"], r["angle"] / 9)
    pieces = _rects(spark, sf_dir).withColumn("r", tilted)
    pairs = pieces.select("l_orderkey", "r", F.lead("r").over(w).alias("s"), F.row_number().over(w).cast("long").alias("seq")).filter("s is not null")
    return pairs.select(
        "l_orderkey", "seq", F.round(geometry.center_distance("r", "s"), 6).alias("distance"), geometry.may_touch("r", "s").alias("touch"),
        geometry.extrapolates_to("r", "s", 4.0).alias("carries_on"),
    )


@query("""
    WITH q AS (SELECT o_orderkey, CAST(o_orderkey % 97 + 3 AS DOUBLE) AS a, CAST(o_custkey % 53 + 5 AS DOUBLE) AS b, CAST(o_orderkey % 11 AS DOUBLE) AS c FROM orders),
    m AS (SELECT o_orderkey, (a * b - (a + c) * c + (a + c) * b - c * b) / 2 AS area, sqrt(a * a + c * c) + sqrt(c * c + (b - c) ** 2) + a + sqrt(c * c + b * b) AS len FROM q)
    SELECT o_orderkey, area, round(len, 6) AS length, round(abs(area) * 1.6 / len, 6) AS unclip FROM m""")
def polygon_measures(spark, sf_dir):
    """Area, length and growing distance of a quad for each order."""
    a, b, c = ((F.col(x) % m + k).cast("double") for x, m, k in (("o_orderkey", 97, 3), ("o_custkey", 53, 5), ("o_orderkey", 11, 0)))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    quads = table(spark, sf_dir, "orders").select("o_orderkey", F.array(point(zero, zero), point(a, c), point(a + c, b), point(c, b)).alias("p"))
    length, unclip = F.round(geometry.polygon_length("p"), 6), F.round(geometry.unclip_distance("p"), 6)
    return quads.select("o_orderkey", geometry.polygon_area("p").alias("area"), length.alias("length"), unclip.alias("unclip"))


@query("""
    SELECT p_partkey, round(p_size / 3, 6) AS line_tolerance, 5.0::DOUBLE * p_size AS line_gap, round(p_size / 5, 6) AS short_line, 2.0::DOUBLE * p_size AS bar_width,
           3.0::DOUBLE * p_size AS bar_height, CAST(4 * p_size AS BIGINT) AS y_tolerance FROM part""")
def unit_thresholds(spark, sf_dir):
    """Thresholds in units of a staff, for each part's size as the unit."""
    u = F.col("p_size")
    at = lambda name, digits=6: F.round(geometry.threshold(name, u), digits).alias(name)
    names = ("line_tolerance", "line_gap", "short_line", "bar_width", "bar_height")
    return table(spark, sf_dir, "part").select("p_partkey", *map(at, names), geometry.y_tolerance(u).cast("long").alias("y_tolerance"))


@query("""
    WITH o AS (SELECT o_orderkey, o_custkey % 41 - 20 AS i, o_orderkey % 13 + 1 AS n, greatest(2 * (o_orderkey % 13), 1) AS period, o_orderkey % 1000 AS v, o_totalprice AS price FROM orders)
    SELECT o_orderkey, CAST(CASE WHEN n <= 1 THEN 0 ELSE least(((i % period) + period) % period, period - ((i % period) + period) % period) END AS BIGINT) AS mirrored,
           CAST(least(greatest(CASE WHEN i < 0 THEN i + n ELSE i END, 0), n) AS BIGINT) AS start,
           CAST(greatest(least(greatest(CASE WHEN i < 0 THEN i + n ELSE i END, 0), n), least(greatest(CASE WHEN i + 7 < 0 THEN i + 7 + n ELSE i + 7 END, 0), n)) AS BIGINT) AS stop,
           greatest(CAST(round_even(v / 32, 0) AS BIGINT) * 32, 32) AS padded, CAST(round_even(v / 50, 0) AS BIGINT) * 50 AS stepped,
           CAST(2 ** (length(bin(CAST(o_orderkey + 1 AS BIGINT))) - 1) AS BIGINT) AS power, CAST(round_even((v + v + n) / 2, 0) AS BIGINT) AS centre,
           CAST(round(i / 2) AS BIGINT) AS away, CAST(CAST(price AS FLOAT) AS DOUBLE) AS single
    FROM o""")
def index_arithmetic(spark, sf_dir):
    """Mirrored and clipped indexes, steps, powers of two and roundings of numbers of each order."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 41 - 20).alias("i"), (F.col("o_orderkey") % 13 + 1).alias("n"), (F.col("o_orderkey") % 1000).alias("v"), "o_totalprice"
    )
    cut = rounding.slice_bounds("i", F.col("i") + 7, "n")
    whole = lambda column, name: column.cast("long").alias(name)
    return o.select(
        "o_orderkey", whole(rounding.reflect101("i", "n"), "mirrored"), whole(cut["start"], "start"), whole(cut["stop"], "stop"),
        whole(rounding.multiple_of("v", 32), "padded"), whole(rounding.round_to_step("v", 50), "stepped"),
        whole(rounding.prior_power_of_two(F.col("o_orderkey") + 1), "power"), whole(rounding.center_of_span("v", F.col("v") + F.col("n")), "centre"),
        whole(rounding.round_half_away(F.col("i") / 2), "away"), rounding.to_float32("o_totalprice").alias("single"),
    )


@query("""
    WITH p AS (SELECT p_partkey, CAST(p_retailprice AS FLOAT)::DOUBLE AS x FROM part),
    e AS (SELECT p_partkey, x, CAST(floor(log2(x)) AS BIGINT) AS e FROM p),
    s AS (SELECT p_partkey, e, CAST(round_even(x / 2.0 ** (e - 10), 0) AS BIGINT) AS m FROM e)
    SELECT p_partkey, CAST((e + 15) * 1024 + m - 1024 AS BIGINT) AS bits, m * 2.0 ** (e - 10) AS value FROM s""")
def half_precision(spark, sf_dir):
    """Prices in half precision: the bits, and the value that they stand for."""
    bits = half.to_half(F.col("p_retailprice"))
    out = table(spark, sf_dir, "part").select("p_partkey", bits.alias("bits"))
    return out.select("p_partkey", F.col("bits").cast("long").alias("bits"), half.from_half(F.col("bits")).cast("double").alias("value"))


@query("""
    WITH o AS (SELECT o_orderkey, 21 + o_orderkey % 88 AS midi, o_orderkey % 7 AS s, o_orderkey % 6 AS k, o_custkey % 9 - 1 AS octave, o_custkey % 128 AS ref, o_orderkey % 12 AS class, o_orderkey % 3 AS dots FROM orders)
    SELECT o_orderkey, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][midi % 12 + 1] || CAST(midi // 12 - 1 AS VARCHAR) AS pitch,
           CAST(CASE WHEN k < 5 THEN [0, 2, 4, 5, 7, 9, 11][s + 1] + [0, 1, -1, 2, -2][k + 1] + 12 * (octave + 1) END AS BIGINT) AS read,
           CAST(ref + CASE WHEN (class - ref % 12 + 12) % 12 < 6 THEN (class - ref % 12 + 12) % 12 ELSE (class - ref % 12 + 12) % 12 - 12 END AS BIGINT) AS near,
           CAST([3840, 960, 120][s % 3 + 1] * [4, 6, 7][dots + 1] // 4 AS BIGINT) AS ticks, CAST(3840 * (k + 1) // 8 AS BIGINT) AS bar, CAST(round_even(2 * (ref - 40) / 5, 0) AS BIGINT) AS step
    FROM o""")
def pitch_names(spark, sf_dir):
    """Pitches spelt and read, octaves nearest to a reference, lengths in ticks and steps on a staff."""
    k, s = F.col("o_orderkey") % 6, F.col("o_orderkey") % 7
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    name = F.concat(pick("CDEFGAB", s), pick(["", "#", "b", "##", "bb", "x"], k), (F.col("o_custkey") % 9 - 1).cast("string"))
    ref = F.col("o_custkey") % 128
    whole = lambda column, alias: column.cast("long").alias(alias)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", notation.pitch_of_midi(F.col("o_orderkey") % 88 + 21).alias("pitch"), whole(notation.midi_of_pitch(name), "read"),
        whole(notation.nearest_octave(F.col("o_orderkey") % 12, ref), "near"), whole(notation.ticks(pick([1, 4, 32], s % 3), F.col("o_orderkey") % 3), "ticks"),
        whole(notation.bar_ticks(k + 1, 8), "bar"), whole(notation.staff_step(ref, 40, 5), "step"),
    )


@query(r"""
    SELECT p_partkey, CAST([12, 0, 12, 7, 5, NULL, NULL, NULL, 11, NULL][p_partkey % 10 + 1] AS INTEGER) AS fret,
           length(p_name) < 4 OR length(regexp_replace(p_name, '[^\p{L}]', '', 'g')) < 4 AS tempo FROM part""")
def fret_readings(spark, sf_dir):
    """Frets read with look-alike letters, and which names could be tempo markings."""
    words = F.array(*map(F.lit, ["12", "o", "l2", " 7 ", "S", "3B", "x", "", "|i", "100"]))
    word = F.element_at(words, (F.col("p_partkey") % 10 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", word.alias("word"))
    return rows.select("p_partkey", text.fret_of("word").alias("fret"), text.is_tempo_marking("p_name").alias("tempo"))


_TOKENS = """
    WITH t AS (SELECT l_orderkey AS page, l_linenumber % 2 AS voice, row_number() OVER o AS seq, ['chord', 'note_4', 'rest_8', 'barline', 'note_4', 'clef_G'][l_partkey % 6 + 1] AS rhythm,
                      ['C4', 'E4'][l_suppkey % 2 + 1] AS pitch, ['upper', 'lower'][l_orderkey % 2 + 1] AS position
               FROM lineitem WINDOW o AS (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)),
    b AS (SELECT *, coalesce(lag(rhythm) OVER o = 'chord', FALSE) AS joined, first_value(rhythm) OVER o = 'chord' AS lead FROM t WINDOW o AS (PARTITION BY page, voice ORDER BY seq)),
    s AS (SELECT *, row_number() OVER (PARTITION BY page, voice ORDER BY seq) AS place FROM b WHERE rhythm <> 'chord'),
    c AS (SELECT *, sum(CASE WHEN place = 1 OR NOT (joined OR (lead AND place = 2)) THEN 1 ELSE 0 END) OVER (PARTITION BY page, voice ORDER BY seq) - 1 AS chord,
                 count(*) FILTER (rhythm = 'barline') OVER (PARTITION BY page, voice ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS measure FROM s)"""


def _tokens(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("l_orderkey", "voice").orderBy(*_ROW)
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    rhythm = pick(["chord", "note_4", "rest_8", "barline", "note_4", "clef_G"], F.col("l_partkey") % 6)
    pitch, position = pick(["C4", "E4"], F.col("l_suppkey") % 2), pick(["upper", "lower"], F.col("l_orderkey") % 2)
    lines = table(spark, sf_dir, "lineitem").withColumn("voice", (F.col("l_linenumber") % 2).cast("long"))
    rows = lines.select(F.col("l_orderkey").alias("page"), "voice", F.row_number().over(w).cast("long").alias("seq"), rhythm.alias("rhythm"), pitch.alias("pitch"), position.alias("position"))
    held = tokens.measures(tokens.chords(rows), F.col("rhythm") == "barline")
    return held.withColumns({"chord": F.col("chord").cast("long"), "measure": F.col("measure").cast("long")})


@query(_TOKENS + "SELECT page, CAST(voice AS BIGINT) AS voice, seq, CAST(chord AS BIGINT) AS chord, CAST(measure AS BIGINT) AS measure FROM c")
def token_chords(spark, sf_dir):
    """Decoded tokens of every order's page with their chord and measure."""
    return _tokens(spark, sf_dir).select("page", "voice", "seq", "chord", "measure")


@query(_TOKENS + """,
    d AS (SELECT *, row_number() OVER (PARTITION BY page, voice, chord, pitch, position, starts_with(rhythm, 'note') ORDER BY seq) AS rn,
                 starts_with(rhythm, 'clef') AND coalesce(rhythm = lag(rhythm) OVER (PARTITION BY page, voice, starts_with(rhythm, 'clef'), position = 'upper' ORDER BY seq), FALSE) AS again FROM c)
    SELECT page, CAST(voice AS BIGINT) AS voice, seq FROM d WHERE (rn = 1 OR NOT starts_with(rhythm, 'note')) AND NOT again AND (page % 3 = 0 OR position <> 'lower')""")
def token_cleanup(spark, sf_dir):
    """Tokens left without repeated pitches, clefs seen before, and lower symbols where there is one staff."""
    kept = tokens.without_redundant(tokens.without_repeated_pitches(_tokens(spark, sf_dir)))
    return tokens.for_single_staff(kept, F.col("page") % 3 == 0).select("page", "voice", "seq")


@query("""
    WITH m AS (SELECT o_custkey AS page, o_orderkey AS measure, o_orderkey % 7 AS length, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 7 DESC, o_orderkey) AS rn,
                      count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    t AS (SELECT page, max(length) AS typical FROM m WHERE rn = (n + 1) // 2 GROUP BY page)
    SELECT page, measure, length FROM m JOIN t USING (page) WHERE length < typical""")
def short_measures(spark, sf_dir):
    """Measures shorter than their voice's upper median."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.lit(0).alias("voice"), F.col("o_orderkey").alias("measure"), (F.col("o_orderkey") % 7).alias("length"))
    return tokens.short_measures(rows).select("page", "measure", "length")


@query("""
    WITH h AS (SELECT o_custkey AS page, o_orderkey AS head, CAST(o_orderkey % 200 AS DOUBLE) AS x, o_orderkey % 9 AS position FROM orders),
    o AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY page ORDER BY x, head) >= 4 THEN 1 ELSE 0 END AS opens FROM h),
    c AS (SELECT *, sum(opens) OVER (PARTITION BY page ORDER BY x, head) AS col FROM o)
    SELECT page, CAST(col AS BIGINT) AS col, round(avg(x), 6) AS x, string_agg(CAST(position AS VARCHAR), ' ' ORDER BY position) AS positions FROM c GROUP BY page, col""")
def note_columns(spark, sf_dir):
    """Columns of note heads of each customer's page."""
    heads = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("page"), F.lit(0).alias("staff"), F.col("o_orderkey").alias("head"), (F.col("o_orderkey") % 200).cast("double").alias("x"),
        (F.col("o_orderkey") % 9).alias("position"), F.lit(5.0).alias("unit"),
    )
    spelt = F.array_join(F.transform("positions", lambda p: p.cast("string")), " ")
    return layout.note_columns(heads).select("page", F.col("column").cast("long").alias("col"), F.round("x", 6).alias("x"), spelt.alias("positions"))


_STAFFS = """
    WITH s AS (SELECT o_custkey AS page, o_orderkey AS staff, CAST(o_orderkey % 300 AS DOUBLE) AS min_x, CAST(o_orderkey % 300 + 20 + o_orderkey % 90 AS DOUBLE) AS max_x,
                      CAST(o_orderkey % 1000 AS DOUBLE) AS min_y, CAST(o_orderkey % 1000 + 20 + o_orderkey % 7 AS DOUBLE) AS max_y FROM orders)"""


def _staffs(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    columns = {"min_x": k % 300, "max_x": k % 300 + 20 + k % 90, "min_y": k % 1000, "max_y": k % 1000 + 20 + k % 7}
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), k.alias("staff"), *[c.cast("double").alias(n) for n, c in columns.items()])


@query(_STAFFS + """
    SELECT page, staff, coalesce((SELECT max(max_y) FROM s a WHERE a.page = s.page AND a.min_y < s.min_y), 0) AS above,
           coalesce((SELECT min(min_y) FROM s b WHERE b.page = s.page AND b.max_y > s.max_y), 1e12::DOUBLE) AS below FROM s""")
def free_rows(spark, sf_dir):
    """How far the free rows above and below each staff reach."""
    return layout.free_rows(_staffs(spark, sf_dir)).select("page", "staff", "above", "below")


@query(_STAFFS + """
    SELECT page, staff FROM s JOIN (SELECT page, avg(max_x - min_x) AS mean FROM s GROUP BY page) USING (page)
    WHERE max_y < 900 AND min_y >= 0 AND NOT ((max_x < 3 OR min_x > 297) AND max_x - min_x < mean / 2)""")
def staffs_in_sight(spark, sf_dir):
    """Staffs inside the page, without narrow ones at its edges."""
    staffs = _staffs(spark, sf_dir).withColumns({"width": F.lit(300.0), "height": F.lit(900.0)})
    return layout.in_sight(staffs).select("page", "staff")


@query("""
    WITH s AS (SELECT o_orderkey, (o_orderkey % 100) / 100.0::DOUBLE AS cx, (o_custkey % 100) / 100.0::DOUBLE AS cy, 0.25::DOUBLE AS w, 0.125::DOUBLE AS h FROM orders)
    SELECT o_orderkey, CAST(greatest(0, least(trunc((cy - h / 2 - 1.9::DOUBLE * h) * 800), 800)) AS BIGINT) AS y0, CAST(greatest(0, least(trunc((cy - h / 2 - 0.05::DOUBLE * h) * 800), 800)) AS BIGINT) AS y1,
           CAST(greatest(0, least(trunc((cx - w / 2 - 0.03::DOUBLE) * 600), 600)) AS BIGINT) AS x0, CAST(greatest(0, least(trunc((cx - w / 2 + w + 0.02::DOUBLE) * 600), 600)) AS BIGINT) AS x1,
           round(0.25::DOUBLE + cx * 0.5::DOUBLE, 6) AS page_x, round(0.125::DOUBLE + cy * 0.75::DOUBLE, 6) AS page_y, h * 0.75::DOUBLE AS page_h FROM s""")
def chord_strips(spark, sf_dir):
    """The pixels above a staff where chord texts stand, and the staff's place on the page that its crop was cut from."""
    staff = F.struct(F.lit(0).alias("index"), (F.col("o_orderkey") % 100 / 100.0).alias("cx"), (F.col("o_custkey") % 100 / 100.0).alias("cy"), F.lit(0.25).alias("w"), F.lit(0.125).alias("h"))
    crop = F.struct(F.lit(0.25).alias("x0"), F.lit(0.75).alias("x1"), F.lit(0.125).alias("y0"), F.lit(0.875).alias("y1"))
    strip, placed = layout.chord_strip("s", F.lit(600), F.lit(800)), layout.staff_in_page("s", crop)
    return table(spark, sf_dir, "orders").select("o_orderkey", staff.alias("s")).select(
        "o_orderkey", *[strip[c].cast("long").alias(c) for c in ("y0", "y1", "x0", "x1")], F.round(placed["cx"], 6).alias("page_x"), F.round(placed["cy"], 6).alias("page_y"), placed["h"].alias("page_h")
    )


@query(r"""
    WITH t AS (SELECT p_partkey % 500 AS page, p_partkey AS seq, p_name AS text, CAST(CAST(CAST(10 + p_size AS FLOAT) AS DOUBLE) / length(p_name) AS FLOAT) AS size
               FROM part WHERE NOT (length(p_name) < 4 OR length(regexp_replace(p_name, '[^\p{L}]', '', 'g')) < 4)),
    b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY size DESC, seq) AS rn FROM t)
    SELECT page, trim(regexp_replace(text, '[^\p{L}\p{M}\p{N}''’-]+', ' ', 'g')) AS title FROM b WHERE rn = 1""")
def page_titles(spark, sf_dir):
    """The title of each page: its line of the tallest characters."""
    lines = table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 500).alias("page"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("text"), F.lit(0.0).alias("top"), (F.col("p_size") + 10.0).alias("bottom")
    )
    return layout.titles(lines)
