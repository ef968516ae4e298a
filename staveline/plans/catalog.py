"""Queries of the relational library over the general-purpose tables, each with SQL that must give the same rows.

Every query applies one operator of the library; the SQL is written from the
operator's definition, not from its plan. Aggregates are aliased alike on both
sides, doubles are rounded, every order is total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staveline.functions import notation, rational, rounding, text
from staveline.operators import images, intervals, runs, sequential, tiles
from staveline.operators.components import connected_components
from staveline.plans import catalog_parts, layout, tab, tab_text  # noqa: F401  (catalog_parts registers its queries)
from staveline.plans.registry import QUERIES, SQL, query
from staveline.plans.registry import table as _t
from staveline.sinks import musicxml, score

FLAGSHIP = "lookup_pitch"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)


def _event_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").withColumn("sec", F.unix_timestamp("ts"))


@query("""
    SELECT l_orderkey, l_linenumber, p_size + 12 + CAST(l_quantity AS BIGINT) AS midi
    FROM lineitem JOIN part ON l_partkey = p_partkey""")
def lookup_pitch(spark, sf_dir):
    """Sounding pitch: look up the open string (part size), add capo and fret."""
    open_strings = _t(spark, sf_dir, "part").select("p_partkey", "p_size")
    notes = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    joined = notes.join(open_strings, notes.l_partkey == open_strings.p_partkey)
    midi = notation.fretted(F.col("p_size"), F.lit(12), F.col("l_quantity").cast("long"))
    return joined.select("l_orderkey", "l_linenumber", midi.alias("midi"))


@query("""
    SELECT l.event_id, r.event_id AS match_id, r.event_type AS match_type
    FROM events l LEFT JOIN LATERAL (
        SELECT event_id, event_type FROM events r
        WHERE r.user_id = l.user_id AND r.event_id <> l.event_id AND r.event_type = 'purchase'
          AND epoch(date_trunc('second', r.ts)) BETWEEN epoch(date_trunc('second', l.ts)) AND epoch(date_trunc('second', l.ts)) + 36000
        ORDER BY event_id LIMIT 1) r ON TRUE
    WHERE l.event_type = 'view'""")
def first_match(spark, sf_dir):
    """Each view with the first (by id, not nearest) purchase of its user in the ten hours after it."""
    e = _event_seconds(spark, sf_dir)
    left = e.filter("event_type = 'view'").select("event_id", "user_id", F.col("sec").alias("lo"), (F.col("sec") + 36000).alias("hi"))
    right = e.filter("event_type = 'purchase'").select(
        "user_id", F.col("sec").alias("a"), F.col("sec").alias("b"), F.col("event_id").alias("match_id"), F.col("event_type").alias("match_type")
    )
    out = intervals.first_match(left, right, ["user_id"], ("lo", "hi"), ("a", "b"), 36000, left_id="event_id", order="match_id", take=["match_id", "match_type"])
    return out.select("event_id", "match_id", "match_type")


_SPANS = """
    WITH spans AS (SELECT l_suppkey, l_orderkey, l_linenumber, epoch(l_shipdate) // 86400 AS lo,
                          epoch(l_shipdate) // 86400 + CAST(l_quantity AS BIGINT) // 10 AS hi, l_returnflag AS f FROM lineitem)"""


def _spans(spark, sf_dir):
    day = F.floor(F.unix_timestamp("l_shipdate") / 86400)
    return _t(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", day.alias("lo"), (day + F.floor(F.col("l_quantity") / 10)).alias("hi"), F.col("l_returnflag").alias("f")
    )


@query(_SPANS + """
    SELECT l_orderkey, l_linenumber FROM spans a WHERE f = 'R' AND EXISTS (
        SELECT 1 FROM spans b WHERE b.f = 'A' AND b.l_suppkey = a.l_suppkey AND a.lo <= b.hi AND b.lo <= a.hi)""")
def semi_overlap(spark, sf_dir):
    """Spans of one kind that overlap some span of another kind of the same supplier."""
    return _overlap(spark, sf_dir, anti=False)


@query(_SPANS + """
    SELECT l_orderkey, l_linenumber FROM spans a WHERE f = 'R' AND NOT EXISTS (
        SELECT 1 FROM spans b WHERE b.f = 'A' AND b.l_suppkey = a.l_suppkey AND a.lo <= b.hi AND b.lo <= a.hi)""")
def anti_overlap(spark, sf_dir):
    """Spans of one kind that overlap no span of the other kind."""
    return _overlap(spark, sf_dir, anti=True)


def _overlap(spark, sf_dir, anti):
    s = _spans(spark, sf_dir)
    left = s.filter("f = 'R'").withColumn("id", F.struct("l_orderkey", "l_linenumber", "l_suppkey", "lo", "hi")).select("id", "l_suppkey", "lo", "hi")
    right = s.filter("f = 'A'").select("l_suppkey", F.col("lo").alias("a"), F.col("hi").alias("b"))
    out = intervals.overlapping(left, right, ["l_suppkey"], ("lo", "hi"), ("a", "b"), 16, left_id="id", anti=anti)
    return out.select("id.l_orderkey", "id.l_linenumber")


@query("""
    WITH bars AS (SELECT user_id, event_id AS bar_id, epoch(date_trunc('second', ts)) AS a,
                         lead(epoch(date_trunc('second', ts))) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)), event_id) AS b
                  FROM events WHERE event_type = 'purchase')
    SELECT e.event_id, bar_id FROM events e JOIN bars USING (user_id)
    WHERE event_type <> 'purchase' AND epoch(date_trunc('second', e.ts)) > a AND epoch(date_trunc('second', e.ts)) < b""")
def range_join_bars(spark, sf_dir):
    """Events strictly between two successive purchases of their user; what lies on a bound is lost."""
    e = _event_seconds(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("sec", "event_id")
    bars = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("bar_id"), F.col("sec").alias("a"), F.lead("sec").over(w).alias("b")).dropna()
    points = e.filter("event_type <> 'purchase'").select("event_id", "user_id", "sec")
    return intervals.points_in_spans(points, bars, ["user_id"], "sec", ("a", "b"), 864000).select("event_id", "bar_id")


@query("""
    SELECT l.event_id, arg_max(r.event_id, (epoch(date_trunc('second', r.ts)), r.event_id)) AS last_purchase
    FROM events l LEFT JOIN events r ON r.user_id = l.user_id AND r.event_type = 'purchase'
         AND date_trunc('second', r.ts) <= date_trunc('second', l.ts)
    WHERE l.event_type <> 'purchase' GROUP BY l.event_id""")
def asof_previous(spark, sf_dir):
    """Each event with the last purchase of its user at or before it."""
    e = _event_seconds(spark, sf_dir)
    right = e.filter("event_type = 'purchase'").select("user_id", "sec", F.col("event_id").alias("last_purchase"))
    left = e.filter("event_type <> 'purchase'").select("event_id", "user_id", "sec")
    return intervals.asof_previous(left, right, ["user_id"], "sec", ["last_purchase"], tie="last_purchase").select("event_id", "last_purchase")


@query("""
    SELECT c_custkey, s_suppkey, round(d, 4) AS distance FROM customer LEFT JOIN (
        SELECT c_custkey AS ck, s_suppkey, abs(c_acctbal - s_acctbal) AS d,
               row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS rn
        FROM customer JOIN supplier ON c_nationkey = s_nationkey) ON ck = c_custkey AND rn = 1 AND d <= 500""")
def nearest_one(spark, sf_dir):
    """Each customer's supplier of nearest balance in the nation, none beyond a distance of 500."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_acctbal", "s_suppkey")
    out = intervals.nearest(c, s, ["nation"], "c_acctbal", "s_acctbal", "s_suppkey", 500)
    return out.select("c_custkey", "s_suppkey", F.round("distance", 4).alias("distance"))


_ISLANDS = """
    SELECT event_id, user_id, sum(CASE WHEN sec - before >= 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS island
    FROM (SELECT *, lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS before
          FROM (SELECT event_id, user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec FROM events))"""


@query(f"SELECT event_id, user_id, CAST(island AS BIGINT) AS island FROM ({_ISLANDS})")
def islands_gap(spark, sf_dir):
    """Runs of a user's events; a gap of a day or more, measured from the previous event, opens a new one."""
    return runs.gap_islands(_event_seconds(spark, sf_dir), ["user_id"], "sec", "event_id", 86400).select("event_id", "user_id", "island")


@query(f"""
    SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first_id FROM ({_ISLANDS}) GROUP BY user_id, island""")
def islands_vs_session_window(spark, sf_dir):
    """Sessions counted by gap; the edge rule (a gap of exactly the threshold splits) differs from session_window."""
    e = runs.gap_islands(_event_seconds(spark, sf_dir), ["user_id"], "sec", "event_id", 86400)
    return e.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""
    SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY line, price, o_orderkey) AS place FROM (
        SELECT *, sum(CASE WHEN day - before >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey) AS line FROM (
            SELECT o_orderkey, o_custkey, o_totalprice AS price, epoch(o_orderdate) // 86400 AS day,
                   lag(epoch(o_orderdate) // 86400) OVER (PARTITION BY o_custkey ORDER BY epoch(o_orderdate) // 86400, o_orderkey) AS before FROM orders))""")
def reading_order(spark, sf_dir):
    """Boxes in reading order: rows break at a step of 30 from the previous box, then left to right."""
    o = _t(spark, sf_dir, "orders").withColumn("day", F.floor(F.unix_timestamp("o_orderdate") / 86400))
    return runs.reading_order(o, ["o_custkey"], "o_totalprice", "day", "o_orderkey", 30).select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("""
    SELECT event_id, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR event_type IS DISTINCT FROM before""")
def running_change(spark, sf_dir):
    """Drop events that repeat the user's previous type (redundant clefs, keys, metres)."""
    return runs.running_change(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "event_type")


@query("""
    SELECT event_id, round(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS in_force FROM events""")
def forward_fill(spark, sf_dir):
    """The value in force: that of the last purchase up to each event."""
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    out = runs.forward_fill(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], value, "in_force")
    return out.select("event_id", F.round("in_force", 4).alias("in_force"))


@query("""
    SELECT conv_id, CAST(run AS BIGINT) AS run, role, count(*) AS n, min(turn) AS first_turn, sum(length(text)) AS chars FROM (
        SELECT *, sum(CASE WHEN n > 1 AND role IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (
            SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n
            FROM conversations)) GROUP BY conv_id, run, role""")
def chord_groups(spark, sf_dir):
    """Successive turns of one speaker as one group."""
    r = runs.equal_runs(_t(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role")
    return r.groupBy("conv_id", "run", "role").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.sum(F.length("text")).alias("chars"))


@query("""
    WITH m AS (SELECT l_orderkey, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS len FROM lineitem GROUP BY l_orderkey),
         t AS (SELECT n, list_sort(list(len))[count(*) // 2 + 1] AS typical FROM m GROUP BY n)
    SELECT l_orderkey, len, typical, len < typical AS short FROM m JOIN t USING (n)""")
def measure_typical(spark, sf_dir):
    """Measures shorter than the typical one (upper median) of their kind."""
    m = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("len"))
    t = m.groupBy("n").agg(runs.upper_median("len").cast("long").alias("typical"))
    return m.join(t, "n").select("l_orderkey", "len", "typical", (F.col("len") < F.col("typical")).alias("short"))


@query("SELECT l_returnflag, round(median(l_extendedprice), 4) AS med FROM lineitem GROUP BY l_returnflag")
def exact_median(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.median("l_extendedprice"), 4).alias("med"))


@query("SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sd FROM lineitem GROUP BY l_returnflag")
def pop_std(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.stddev_pop("l_quantity"), 6).alias("sd"))


@query("""
    SELECT l_returnflag, q, n FROM (SELECT l_returnflag, q, n, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, q) AS rn FROM (
        SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE rn = 1""")
def mode_tie(spark, sf_dir):
    """The most frequent value, the smallest of equally frequent ones."""
    li = _t(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("q"))
    return runs.mode_smallest(li, ["l_returnflag"], "q")


@query("""
    SELECT l_orderkey, l_linenumber FROM lineitem JOIN (
        SELECT l_returnflag AS f, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS sd FROM lineitem GROUP BY 1) ON f = l_returnflag
    WHERE NOT (abs(l_extendedprice - m) > 1.5 * sd AND sd > 0)""")
def sigma_filter(spark, sf_dir):
    """Rows within 1.5 population deviations of their group's mean."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return runs.within_sigma(li, ["l_returnflag"], "l_extendedprice", 1.5).select("l_orderkey", "l_linenumber")


_TILES = """
    SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS i, CAST(floor(l_extendedprice / 5000) AS BIGINT) AS j, count(*) AS n,
           round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY 1, 2"""


def _tiles(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return tiles.tile_counts(li, [], "l_quantity", "l_extendedprice", 5, 5000, F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("mean"))


@query(_TILES)
def tile_grid(spark, sf_dir):
    """Two-dimensional tumbling windows."""
    return _tiles(spark, sf_dir)


@query(f"""
    WITH t AS ({_TILES}), m AS (SELECT avg(n) AS limit_n FROM t)
    SELECT i, j, n FROM t a, m WHERE n > limit_n AND EXISTS (SELECT 1 FROM t b, m WHERE b.n > limit_n AND abs(a.i - b.i) + abs(a.j - b.j) = 1)""")
def neighbour_exists(spark, sf_dir):
    """Tiles above the mean count with a 4-neighbour above it."""
    t = _tiles(spark, sf_dir).crossJoin(F.broadcast(_tiles(spark, sf_dir).agg(F.avg("n").alias("limit_n"))))  # one row
    return tiles.noisy_tiles(t.withColumn("over", F.col("n") - F.col("limit_n")), [], "over", 0).select("i", "j", "n")


@query("""
    SELECT s_nationkey, place, CAST(trunc(avg(v)) AS BIGINT) AS merged FROM (
        SELECT s_nationkey, unnest(generate_series(s_suppkey, s_suppkey + 4)) AS place, CAST(floor(abs(s_acctbal) / 100) AS BIGINT) AS v FROM supplier) GROUP BY 1, 2""")
def coverage_merge(spark, sf_dir):
    """Values averaged (and truncated) over all tiles that cover a place."""
    s = _t(spark, sf_dir, "supplier").withColumn("v", F.floor(F.abs("s_acctbal") / 100))
    return tiles.covered_average(s, ["s_nationkey"], "s_suppkey", 5, "v").withColumnRenamed("at", "place")


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM (SELECT c_custkey AS a, c_custkey + 7 AS b FROM customer WHERE c_acctbal > 8000
                         UNION ALL SELECT c_custkey + 7, c_custkey FROM customer WHERE c_acctbal > 8000
                         UNION ALL SELECT c_custkey, c_custkey + 11 FROM customer WHERE c_acctbal < -500
                         UNION ALL SELECT c_custkey + 11, c_custkey FROM customer WHERE c_acctbal < -500)),
    r(node, reach) AS (SELECT a, a FROM e UNION SELECT e.b, reach FROM r JOIN e ON r.node = e.a)
    SELECT node, min(reach) AS component FROM r GROUP BY node""")
def components(spark, sf_dir):
    """Connected components of a graph over customers."""
    c = _t(spark, sf_dir, "customer")
    far = c.filter("c_acctbal > 8000").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 7).alias("b"))
    near = c.filter("c_acctbal < -500").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 11).alias("b"))
    return connected_components(far.union(near))


@query("""
    WITH s AS (SELECT o_custkey, epoch(o_orderdate) // 86400 AS lo, epoch(o_orderdate) // 86400 + CAST(o_totalprice AS BIGINT) % 60 AS hi FROM orders),
    m AS (SELECT *, max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    p AS (SELECT *, sum(CASE WHEN lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS part FROM m)
    SELECT o_custkey, CAST(min(lo) AS BIGINT) AS lo, CAST(max(hi) AS BIGINT) AS hi, count(*) AS parts FROM p GROUP BY o_custkey, part""")
def interval_merge(spark, sf_dir):
    """Unions of overlapping order intervals by customer."""
    day = F.floor(F.unix_timestamp("o_orderdate") / 86400)
    s = _t(spark, sf_dir, "orders").select("o_custkey", day.alias("lo"), (day + F.rint("o_totalprice").cast("long") % 60).alias("hi"))
    return runs.merge_spans(s, ["o_custkey"], "lo", "hi")


@query("SELECT * EXCLUDE rn FROM (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def top1_rank(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    return runs.top_ranked(p, ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")])


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE (rn - 1) % 7 = 0")
def systematic_sample(spark, sf_dir):
    """Every seventh row of each supplier, from the first."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").withColumn("rn", F.row_number().over(w))
    return li.filter("(rn - 1) % 7 = 0").select("l_orderkey", "l_linenumber")


@query("SELECT s_suppkey, s_nationkey, row_number() OVER (ORDER BY s_nationkey, s_suppkey) - 1 AS place FROM supplier")
def stable_sort(spark, sf_dir):
    """Boxes renumbered in a stable sort: a global rank from per-partition counts, without a single-task window."""
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    before = s.groupBy("s_nationkey").agg(F.count("*").alias("n"))
    w = Window.orderBy("s_nationkey").rowsBetween(Window.unboundedPreceding, -1)  # over nations only
    start = before.select("s_nationkey", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    return s.withColumn("own", own).join(start, "s_nationkey").select("s_suppkey", "s_nationkey", (F.col("own") + F.col("start")).alias("place"))


@query("SELECT lang, source, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY lang, source")
def dedup_first_wins(spark, sf_dir):
    """One document for each language and source, the first."""
    d = _t(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars")
    return runs.first_of_each(d, ["lang", "source"], ["doc_id"])


@query("""
    WITH a AS (SELECT l_suppkey, l_partkey, min(l_orderkey) AS o FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
         b AS (SELECT l_suppkey, l_partkey, min(l_orderkey) AS o FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
         u AS (SELECT *, 0 AS side FROM a UNION ALL SELECT *, 1 FROM b ANTI JOIN a USING (l_suppkey, l_partkey))
    SELECT l_suppkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY side, o, l_partkey) AS parts, count(*) AS n FROM u GROUP BY l_suppkey""")
def array_union_keep_order(spark, sf_dir):
    """Union of two ordered lists: the first as it is, then what only the second holds."""
    li = _t(spark, sf_dir, "lineitem")

    def ordered(flag, name):
        g = li.filter(F.col("l_returnflag") == flag).groupBy("l_suppkey", "l_partkey").agg(F.min("l_orderkey").alias("o"))
        return g.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("o", "l_partkey"))).alias(name))

    both = ordered("R", "x").join(ordered("A", "y"), "l_suppkey", "full")
    empty = F.array().cast("array<bigint>")
    merged = F.array_union(F.coalesce("x.l_partkey", empty), F.coalesce("y.l_partkey", empty))
    return both.select("l_suppkey", F.array_join(merged.cast("array<string>"), ",").alias("parts"), F.size(merged).cast("long").alias("n"))


@query("""
    WITH p AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem GROUP BY 1)
    SELECT a.l_orderkey, b.l_orderkey AS inside FROM p a JOIN p b ON a.l_orderkey <> b.l_orderkey AND a.l_orderkey // 8 = b.l_orderkey // 8 AND list_has_all(b.s, a.s)""")
def subset_test(spark, sf_dir):
    """Groups all of whose members another group of the same block holds too."""
    return _subsets(_t(spark, sf_dir, "lineitem"))


def _subsets(lines: DataFrame) -> DataFrame:
    p = lines.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"))
    p = p.withColumn("block", F.floor(F.col("l_orderkey") / 8))
    q = p.select(F.col("l_orderkey").alias("inside"), F.col("s").alias("t"), "block")
    holds = F.size(F.array_except("s", "t")) == 0
    return p.join(q, "block").filter((F.col("l_orderkey") != F.col("inside")) & holds).select("l_orderkey", "inside")


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings")
def argmax_array(spark, sf_dir):
    """Index of the largest element, the first of equal ones."""
    e = _t(spark, sf_dir, "embeddings")
    return e.select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("best"))


@query("""
    WITH s AS (SELECT vec_id, i, CAST(floor(abs(embedding[i]) * 12) AS INTEGER) AS c, round(CAST(abs(embedding[i]) AS DOUBLE), 5) AS p
               FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i)),
         k AS (SELECT *, lag(c) OVER (PARTITION BY vec_id ORDER BY i) AS before FROM s)
    SELECT vec_id, string_agg(CAST(c AS VARCHAR), '' ORDER BY i) FILTER (c <> 0 AND c IS DISTINCT FROM before) AS text,
           round(coalesce(avg(p) FILTER (c <> 0 AND c IS DISTINCT FROM before), 0), 4) AS score FROM k GROUP BY vec_id""")
def ctc_collapse(spark, sf_dir):
    """Collapse repeats against the previous step, blanks included, drop blanks; score by the mean of the kept steps."""
    e = _t(spark, sf_dir, "embeddings")
    codes = F.transform("embedding", lambda v: F.floor(F.abs(v) * 12).cast("int"))
    probs = F.transform("embedding", lambda v: F.round(F.abs(v.cast("double")), 5))
    out = text.ctc_collapse(codes, probs)
    return e.select("vec_id", F.when(F.size(out["codes"]) > 0, F.array_join(out["codes"].cast("array<string>"), "")).alias("text"), F.round(out["score"], 4).alias("score"))


@query("""
    SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))) AS norm,
           length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits FROM documents""")
def text_normalise(spark, sf_dir):
    """ASCII letters and digits of the lower-cased text, single spaces, trimmed."""
    d = _t(spark, sf_dir, "documents")
    digits = F.length(F.regexp_replace("text", "[^0-9]", ""))
    return d.select("doc_id", F.md5(text.ascii_words("text").cast("binary")).alias("norm"), digits.cast("long").alias("digits"))


@query(r"""
    SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host,
           TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) AS number FROM pages""")
def regex_parse(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    return p.select(
        "page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"),
        text.number_in("url", "/([0-9]+)").alias("number"),
    )


@query(r"""
    SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[.,;:_ ]+$', '')) AS title FROM pages""")
def title_clean(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    return p.select("page_id", text.clean_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("""
    WITH c(num) AS (VALUES (3), (4), (6), (8), (9), (12)),
         m AS (SELECT o_custkey, CAST(o_totalprice AS BIGINT) % 24 AS len FROM orders),
         v AS (SELECT o_custkey, num, count(*) FILTER (len % num = 0) AS fits FROM m, c GROUP BY ALL)
    SELECT o_custkey, num AS meter, fits FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY fits DESC, num) AS rn FROM v) WHERE rn = 1""")
def vote_candidates(spark, sf_dir):
    """The candidate metre that most bars fit; earlier candidates win ties."""
    m = _t(spark, sf_dir, "orders").select("o_custkey", (F.rint("o_totalprice").cast("long") % 24).alias("len"))
    fits = [F.count(F.when(F.col("len") % n == 0, 1)).alias(f"f{n}") for n in (3, 4, 6, 8, 9, 12)]
    wide = m.groupBy("o_custkey").agg(*fits)
    ranked = F.array_max(F.array(*[F.struct(F.col(f"f{n}").alias("fits"), F.lit(-n).alias("minus")) for n in (3, 4, 6, 8, 9, 12)]))
    return wide.select("o_custkey", (-ranked["minus"]).alias("meter"), ranked["fits"].alias("fits"))


@query("""
    SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' ELSE coalesce(lang, 'unknown') END AS verdict
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def conditional_coalesce(spark, sf_dir):
    d, l_ = _t(spark, sf_dir, "documents").select("doc_id", "lang"), _t(spark, sf_dir, "labels")
    verdict = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise(F.coalesce("lang", F.lit("unknown")))
    return d.join(l_, "doc_id", "left").select("doc_id", verdict.alias("verdict"))


@query("""
    SELECT name, arg_min(key, (side, key)) AS key, min(side) AS side FROM (
        SELECT c_nationkey AS name, c_custkey AS key, 0 AS side FROM customer UNION ALL SELECT s_nationkey, s_suppkey, 1 FROM supplier) GROUP BY name""")
def union_dedupe(spark, sf_dir):
    """Union of two tables by key, the first table's first row winning."""
    a = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("name"), F.col("c_custkey").alias("key"), F.lit(0).alias("side"))
    b = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("name"), F.col("s_suppkey").alias("key"), F.lit(1).alias("side"))
    return runs.first_of_each(a.union(b), ["name"], ["side", "key"])


@query("SELECT l_orderkey, list_reduce(list_prepend(CAST(1 AS BIGINT), list(CAST(l_quantity AS BIGINT) % 12 + 1)), lambda a, b: lcm(a, b)) AS divisions FROM lineitem GROUP BY l_orderkey")
def lcm_reduce(spark, sf_dir):
    """Divisions of a measure: the least common multiple of its lengths' denominators."""
    g = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_quantity").cast("long") % 12 + 1).alias("d"))
    return g.select("l_orderkey", rounding.lcm_of("d").alias("divisions"))


@query("""
    SELECT p_partkey, CAST((2 * p_size * 3 + 5) / g AS BIGINT) AS num, CAST(2 * p_size * 5 / g AS BIGINT) AS den
    FROM (SELECT p_partkey, p_size, gcd(6 * p_size + 5, 10 * p_size) AS g FROM part)""")
def rational_sum(spark, sf_dir):
    """3/5 + 1/(2 n), exactly."""
    total = rational.add(rational.ratio(3, 5), rational.ratio(1, F.col("p_size") * 2))
    return _t(spark, sf_dir, "part").select("p_partkey", total.alias("r")).select("p_partkey", "r.num", "r.den")


@query("""
    SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice / 100, 0) AS BIGINT) AS even, CAST(trunc(l_extendedprice / 7) AS BIGINT) AS whole,
           least(greatest(CAST(round_even(l_quantity, 0) AS BIGINT), 0), 29) AS idx, ((l_partkey - 500) // 7) - CASE WHEN l_partkey < 500 AND (l_partkey - 500) % 7 <> 0 THEN 1 ELSE 0 END AS fdiv
    FROM lineitem""")
def rounding_family(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", rounding.round_half_even(F.col("l_extendedprice") / 100).cast("long").alias("even"),
        rounding.trunc_to_int(F.col("l_extendedprice") / 7).alias("whole"), rounding.clamp_to_index("l_quantity", F.lit(30)).alias("idx"),
        rounding.int_floor_div(F.col("l_partkey") - 500, F.lit(7)).alias("fdiv"),
    )


@query("""
    SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), list_transform(generate_series(1, 64), lambda i: ((i - 1) % 7 - 3) / 4.0)), 6) AS score FROM embeddings""")
def udf_batch_score(spark, sf_dir):
    """A model behind the batch interface: a fixed vector's inner product, in Arrow batches."""
    from staveline.operators.models import FixedVector, score

    weights = [((i % 7) - 3) / 4.0 for i in range(64)]
    out = score(_t(spark, sf_dir, "embeddings"), FixedVector(weights), "embedding", "score")
    return out.select("vec_id", F.round("score", 6).alias("score"))


_PAGES = """
    WITH dark AS (SELECT user_id AS page, event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec, CAST(floor(value) AS BIGINT) % 256 AS v FROM events),
    px AS (SELECT page, (row_number() OVER (PARTITION BY page ORDER BY sec, event_id) - 1) AS k, v FROM dark),
    img AS (SELECT page, k // 8 AS y, k % 8 AS x, v FROM px WHERE k // 8 < (SELECT count(*) FROM px q WHERE q.page = px.page) // 8)"""


@query(_PAGES + """,
    size AS (SELECT page, max(y) + 1 AS h FROM img GROUP BY page),
    near AS (SELECT i.page, i.x, i.y, dx, dy, (CASE dx WHEN 0 THEN 2 ELSE 1 END) * (CASE dy WHEN 0 THEN 2 ELSE 1 END) * (CASE WHEN (dx = 0) <> (dy = 0) THEN -1 ELSE 1 END) AS w,
                    CASE WHEN i.x + dx < 0 THEN 1 WHEN i.x + dx > 7 THEN 6 ELSE i.x + dx END AS nx,
                    CASE WHEN h = 1 THEN 0 WHEN i.y + dy < 0 THEN 1 WHEN i.y + dy >= h THEN h - 2 ELSE i.y + dy END AS ny
             FROM img i JOIN size USING (page), (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)),
    resp AS (SELECT n.page, n.x, n.y, abs(sum(w * v)) AS r, max(h) AS h FROM near n JOIN size USING (page) JOIN img m ON m.page = n.page AND m.x = nx AND m.y = ny GROUP BY n.page, n.x, n.y)
    SELECT page, CAST(max(h) AS BIGINT) AS height, round(sum(r) / (max(h) * 8), 6) AS noise FROM resp GROUP BY page""")
def noise_estimate(spark, sf_dir):
    """Mean absolute second-difference response of small planes: each user's event values, eight in a row, whole rows."""
    e = _event_seconds(spark, sf_dir)
    held = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("sec", "event_id", (F.floor("value") % 256).alias("v")))).alias("a"))
    rows = held.select(F.col("user_id").alias("page"), F.floor(F.size("a") / 8).alias("height"), "a.v").filter("height > 0")
    plane = F.struct(F.lit(8).alias("width"), F.col("height").cast("int").alias("height"), F.slice("v", 1, (F.col("height") * 8).cast("int")).alias("v"))
    return images.noise(rows.select("page", "height", plane.alias("plane")), "plane").select("page", F.col("height").cast("long").alias("height"), F.round("noise", 6).alias("noise"))


@query("""
    WITH s AS (SELECT s_nationkey AS page, s_suppkey AS staff, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS k, 10 + s_suppkey % 4 AS unit FROM supplier),
    p AS (SELECT a.page, a.staff AS upper, b.staff AS lower, (a.unit + b.unit) / 2.0 AS unit, a.k FROM s a JOIN s b ON b.page = a.page AND b.k = a.k + 1),
    c AS (SELECT page, upper, lower, unit, k, 30 + upper % 40 AS away, 140 - upper % 60 AS shared FROM p)
    SELECT page, upper, lower, CAST(CASE WHEN away < 5 * unit AND shared > 70 AND shared > away THEN shared - away ELSE 0 END AS DOUBLE) AS score FROM c""")
def brace_score(spark, sf_dir):
    """The score of a brace beside each two neighbouring staffs (suppliers of a nation, stacked)."""
    w = Window.partitionBy("page").orderBy("s_suppkey")
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page"), "s_suppkey").withColumn("k", F.row_number().over(w) - 1)
    top = F.col("k") * 140.0
    staffs = s.select("page", F.col("s_suppkey").alias("staff"), F.lit(100.0).alias("min_x"), F.lit(900.0).alias("max_x"), top.alias("min_y"), (top + 40).alias("max_y"), (10.0 + F.col("s_suppkey") % 4).alias("unit"))
    # One brace a pair: 140 high, from as far above or below the pair as its id says.
    braces = s.select("page", F.col("s_suppkey").alias("brace"), (100.0 - 30 - F.col("s_suppkey") % 40).alias("cx"), (top + 70 - F.col("s_suppkey") % 60).alias("cy"), F.lit(5.0).alias("w"), F.lit(140.0).alias("h"))
    scored = layout.brace_scores(staffs, braces.withColumn("upper", F.col("brace")), own_pair=True)
    return scored.select("page", "upper", "lower", "score")


@query()
def best_pair_greedy(spark, sf_dir):
    """Pairs of nations of a region by falling score, none used twice."""
    n = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("n_regionkey"), F.col("n_nationkey").cast("long").alias("n1"))
    m = n.select("n_regionkey", F.col("n1").alias("n2"))
    pairs = n.join(m, "n_regionkey").filter("n1 < n2").withColumn("score", ((F.col("n1") * 7 + F.col("n2") * 3) % 11).cast("double"))
    return sequential.greedy_pairs(pairs, ["n_regionkey"], "n_regionkey long", "n1", "n2", "score")


@query()
def alignment(spark, sf_dir):
    """Global alignment of each user's purchases' and clicks' hours."""
    e = _event_seconds(spark, sf_dir).withColumn("hour", F.floor(F.col("sec") / 3600) % 24)
    pick = lambda kind: e.filter(F.col("event_type") == kind).select("user_id", "event_id", "hour")
    return sequential.align(pick("purchase"), pick("click"), ["user_id"], "user_id long", left_order="event_id", right_order="event_id", left_value="hour", right_value="hour")


@query()
def voice_colouring(spark, sf_dir):
    """The lowest free voice for each customer's overlapping order intervals."""
    day = F.floor(F.unix_timestamp("o_orderdate") / 86400)
    s = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day.alias("lo"), (day + 1 + F.rint("o_totalprice").cast("long") % 90).alias("hi"))
    return sequential.lowest_free_voice(s, ["o_custkey"], "lo", "hi", "o_orderkey")


def _tab_tables(spark, sf_dir):
    """Events as tablature: a user's page, one system, purchases as barlines, lengths by id."""
    e = _event_seconds(spark, sf_dir).withColumn("page", F.col("user_id"))
    ticks = F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.element_at(F.array(*map(F.lit, [960, 480, 1920, 240])), (F.col("event_id") % 4 + 1).cast("int")))
    notes = e.filter("event_type <> 'purchase'").select(
        "page", F.lit(0).alias("system"), F.col("event_id").alias("seq"), F.col("sec").cast("double").alias("x"), ticks.cast("long").alias("ticks")
    )
    lines = e.filter("event_type = 'purchase'").select(
        "page", F.lit(0).alias("system"), F.col("sec").cast("double").alias("x"),
        (F.col("event_id") % 5 == 0).alias("repeat_start"), (F.col("event_id") % 7 == 0).alias("repeat_end"),
    )
    return notes, lines


@query("""
    WITH e AS (SELECT user_id AS page, event_id, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS x, event_type FROM events),
    n AS (SELECT page, event_id, x, CASE WHEN event_id % 11 = 0 THEN NULL ELSE [960, 480, 1920, 240][event_id % 4 + 1] END AS ticks FROM e WHERE event_type <> 'purchase'),
    l AS (SELECT page, x, bool_or(event_id % 5 = 0) AS rs, bool_or(event_id % 7 = 0) AS re FROM e WHERE event_type = 'purchase' GROUP BY page, x),
    b AS (SELECT n.*, (SELECT max(l.x) FROM l WHERE l.page = n.page AND l.x <= n.x) AS lx, (SELECT min(l.x) FROM l WHERE l.page = n.page AND l.x >= n.x) AS rx FROM n),
    k AS (SELECT b.*, coalesce(a.rs, FALSE) AS rs, coalesce(z.re, FALSE) AS re FROM b LEFT JOIN l a ON a.page = b.page AND a.x = lx
          LEFT JOIN l z ON z.page = b.page AND z.x = rx WHERE (lx IS NULL OR b.x > lx) AND (rx IS NULL OR b.x < rx)),
    d AS (SELECT *, dense_rank() OVER (PARTITION BY page ORDER BY coalesce(lx, -1e300)) - 1 AS bar FROM k),
    g AS (SELECT page, bar, coalesce(sum(ticks), 0) AS known, count(*) FILTER (ticks IS NULL) AS open, bool_or(rs) AS rs, bool_or(re) AS re,
                 count(*) OVER (PARTITION BY page) AS cnt FROM d GROUP BY page, bar),
    m AS (SELECT * FROM (VALUES (0, 4, 4), (1, 2, 4), (2, 3, 4), (3, 6, 8), (4, 2, 2), (5, 9, 8), (6, 12, 8)) AS t(k, num, den)),
    f AS (SELECT g.*, k, num, den, 3840 * num // den AS whole, (bar = 0 OR rs) AS opens FROM g, m),
    p AS (SELECT *, CASE WHEN open > 0 AND (whole - known) / open IN (3840, 2880, 1920) THEN CAST((whole - known) / open AS BIGINT) END AS long,
                 max(CASE WHEN opens THEN bar END) OVER (PARTITION BY page, k ORDER BY bar) AS part FROM f),
    u AS (SELECT p.*, CASE WHEN o.open = 0 AND o.cnt > 1 AND o.known > 0 AND o.known * 2 <= o.whole THEN o.known END AS upbeat
          FROM p JOIN p o ON o.page = p.page AND o.k = p.k AND o.bar = p.part),
    c AS (SELECT *, opens AND upbeat IS NOT NULL AS pickup,
                 CASE WHEN open > 0 THEN long IS NOT NULL ELSE known = whole OR (opens AND upbeat IS NOT NULL)
                      OR (NOT opens AND (re OR bar = cnt - 1) AND upbeat IS NOT NULL AND known + coalesce(upbeat, 0) = whole) END AS fits FROM u),
    v AS (SELECT page, k, row_number() OVER (PARTITION BY page ORDER BY count(*) FILTER (fits) DESC, k) AS rn FROM c GROUP BY page, k)
    SELECT page, bar, num, den, 'missing' AS status, (known + coalesce(open * long, 0)) / 960 AS quarters, open, pickup, fits
    FROM c JOIN v USING (page, k) WHERE rn = 1""")
def resolve_tab(spark, sf_dir):
    """Bars of each page, the metre that most of them fit, and how each fits it."""
    notes, lines = _tab_tables(spark, sf_dir)
    lines = lines.groupBy("page", "system", "x").agg(F.bool_or("repeat_start").alias("repeat_start"), F.bool_or("repeat_end").alias("repeat_end"))
    return tab.resolve(notes, lines)


@query("""
    WITH n AS (SELECT l_orderkey AS page, l_linenumber, p_size, CAST(l_quantity AS BIGINT) % 3 AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS seq
               FROM lineitem JOIN part ON l_partkey = p_partkey),
    x AS (SELECT page, seq, 1 AS num, [4, 8, 6][d + 1] AS den, p_size FROM n),
    k AS (SELECT page, list_reduce(list_prepend(4, list(den)), lambda a, b: lcm(a, b)) // 4 AS divisions FROM x GROUP BY page)
    SELECT page, divisions, sum(num * divisions * 4 // den) AS length, count(*) AS notes FROM x JOIN k USING (page) GROUP BY page, divisions""")
def score_export(spark, sf_dir):
    """Documents of notes, read back: divisions, sounding length and number of notes of each page."""
    return _exported(_t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part"))


def _exported(li: DataFrame, part: DataFrame) -> DataFrame:
    p = part.select("p_partkey", "p_size")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    names = F.array(*[F.lit(x) for x in "CDEFGAB"])
    notes = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("page"), F.lit(1).alias("part"), F.lit(1).alias("measure"), F.row_number().over(w).alias("seq"),
        F.element_at(names, (F.col("p_size") % 7 + 1).cast("int")).alias("step"), F.lit(0).alias("alter"), F.lit(4).alias("octave"), F.lit(1).cast("long").alias("num"),
        F.element_at(F.array(*map(F.lit, [4, 8, 6])), (F.col("l_quantity").cast("long") % 3 + 1).cast("int")).cast("long").alias("den"),
        F.lit(None).cast("string").alias("kind"), F.lit(0).alias("dots"), F.lit(False).alias("chord"), F.lit(None).cast("int").alias("staff"),
    )
    docs = musicxml.documents(notes)
    lengths = F.transform(F.regexp_extract_all("xml", F.lit("<duration>([0-9]+)</duration>"), F.lit(1)), lambda s: s.cast("long"))
    total = F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x)
    return docs.select("page", "divisions", total.alias("length"), F.size(lengths).cast("long").alias("notes"))


@query("""
    WITH t AS (SELECT l_orderkey AS page, l_linenumber AS n, CAST(l_quantity AS BIGINT) % 4 AS k,
                      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS back FROM lineitem),
    d AS (SELECT page, list_reduce(list_prepend(4, list(CASE k WHEN 1 THEN 8 WHEN 2 THEN 16 ELSE 4 END)), lambda a, b: lcm(a, b)) AS division,
                 count(*) FILTER (n % 3 = 0) + max(CASE WHEN back = 1 AND n % 3 <> 0 THEN 1 ELSE 0 END) AS measures, count(*) FILTER (k < 3) AS notes, count(*) FILTER (k = 3) AS rests,
                 sum(CASE k WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END) AS sixteenths FROM t GROUP BY page)
    SELECT page, division // 4 AS divisions, measures, notes, rests, CAST(sixteenths * division // 16 AS BIGINT) AS length FROM d""")
def score_tokens(spark, sf_dir):
    """Scores written from decoded tokens and read back: measures, notes, rests and sounding length of every order's page."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    line = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") % 4).alias("k"), F.row_number().over(w).alias("n"))
    note = F.struct(F.element_at(F.array(*map(F.lit, ["note_4", "note_8", "note_8.", "rest_4"])), (F.col("k") + 1).cast("int")).alias("rhythm"), F.when(F.col("k") < 3, F.lit("A4")).otherwise("_").alias("pitch"))
    bar = F.struct(F.lit("barline").alias("rhythm"), F.lit(".").alias("pitch"))
    both = F.when(F.col("l_linenumber") % 3 == 0, F.array(note, bar)).otherwise(F.array(note))
    tokens = line.select(F.col("l_orderkey").alias("page"), F.lit(0).alias("part"), "n", F.posexplode(both).alias("m", "t"))
    head = lambda name, value: F.lit(value).alias(name)
    tokens = tokens.select("page", "part", (F.col("n") * 2 + F.col("m")).alias("seq"), "t.rhythm", "t.pitch", head("lift", "_"), head("articulation", "_"), head("slur", "_"), head("position", "upper"), F.lit(None).cast("int").alias("column"))
    out = score.scores(tokens)
    numbers = lambda tag: F.transform(F.regexp_extract_all("xml", F.lit(f"<{tag}>([0-9]+)</{tag}>"), F.lit(1)), lambda x: x.cast("long"))
    count = lambda piece: F.regexp_count("xml", F.lit(piece)).cast("long")
    length = F.aggregate(numbers("duration"), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("page", numbers("divisions")[0].alias("divisions"), count("<measure ").alias("measures"), count("<pitch>").alias("notes"), count("<rest />").alias("rests"), length.alias("length"))


@query("""
    WITH o AS (SELECT o_orderkey, o_orderkey % 7 AS k, o_orderkey % 15 AS f, 5 + o_orderkey % 2 AS n FROM orders)
    SELECT o_orderkey, CASE WHEN k = 0 AND f <= 12 THEN f WHEN k = 1 THEN 0 END AS capo,
           CASE k WHEN 2 THEN 'read' WHEN 3 THEN CASE n WHEN 6 THEN 'read' ELSE 'string_count' END WHEN 4 THEN CASE n WHEN 5 THEN 'string_count' ELSE 'read' END WHEN 5 THEN 'unknown_name' END AS status,
           CASE k WHEN 2 THEN CASE n WHEN 5 THEN 'D4 B3 G3 D3 G4' ELSE 'D4 B3 G3 D3 G2 D2' END WHEN 3 THEN 'D4 A3 G3 D3 A2 D2' WHEN 4 THEN 'E4 B3 G3 D3 A2 D2' END AS strings,
           CASE k WHEN 6 THEN CASE n WHEN 5 THEN 'tenorBanjo' ELSE 'guitar' END END AS instrument
    FROM o""")
def tab_texts(spark, sf_dir):
    """Capo, tuning and instrument read from a line of text for each order, worded by its id."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).cast("int").alias("k"), (F.col("o_orderkey") % 15).alias("f"), (5 + F.col("o_orderkey") % 2).cast("int").alias("n"))
    words = [F.concat(F.lit("Capo on the "), F.col("f")), F.lit("sans capo"), F.lit("Open  G"), F.lit("accordage : D A D G A D"), F.lit("(6) = re"), F.lit("special tuning"), F.when(F.col("n") == 5, "Tenor Banjo").otherwise("pour guitare")]
    line = F.element_at(F.array(*words), F.col("k") + 1)
    read = o.select("o_orderkey", "n", line.alias("line")).withColumn("p", tab_text.parsed("line")).withColumn("t", tab_text.tuning("p", "n"))
    return read.select("o_orderkey", F.col("p.capo").alias("capo"), F.col("t.status").alias("status"), F.array_join("t.strings", " ").alias("strings"), tab_text.instrument_kind("line").alias("instrument"))


@query("""
    SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 <> 1 THEN 62 END AS top, CASE WHEN o_orderkey % 3 <> 1 THEN 59 + o_orderkey % 5 END AS second
    FROM orders""")
def pitch_tab(spark, sf_dir):
    """Sounding pitches of fretted notes under each page's tuning and capo; nulls where no tuning was read."""
    o = _t(spark, sf_dir, "orders")
    note = lambda s, f: F.struct(F.lit(s).alias("string"), f.cast("int").alias("fret"))
    events = o.select(F.col("o_orderkey").alias("page"), "o_custkey", F.array(note(1, F.lit(0)), note(2, F.col("o_orderkey") % 5)).alias("notes"))
    tunings = o.filter("o_orderkey % 3 <> 1").select(F.col("o_orderkey").alias("page"), F.array(F.lit("C4"), F.lit("A3")).alias("strings"), F.lit(2).alias("capo"))
    out = tab.pitch_tab(events, tunings)
    return out.select("o_custkey", F.col("page").alias("o_orderkey"), F.col("midi")[0].alias("top"), F.col("midi")[1].alias("second"))
