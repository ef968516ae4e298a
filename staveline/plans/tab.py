"""From tablature readings to a tune: bars, note lengths, metre and pitches.

Tables, one page being the unit of work:

* ``events``: ``page, system, seq, x, ticks`` (null: no stem, the bar decides; 0: grace) and, for pitches,
  ``notes array<struct<string int, fret int>>``
* ``barlines``: ``page, system, x, repeat_start, repeat_end``

Everything is equi-joins and windows under the page; no step holds a page in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staveline.functions import notation
from staveline.functions.notation import WHOLE

#: The metres that are tried where none is printed, in order of preference.
METERS = ((4, 4), (2, 4), (3, 4), (6, 8), (2, 2), (9, 8), (12, 8))
#: Lengths that notes without stems may share, longest first: whole, dotted half, half.
LONG = (WHOLE, WHOLE * 3 // 4, WHOLE // 2)
#: Standard tunings by line count, the bottom line first.
STANDARD = {4: ("G3", "D4", "A4", "E5"), 5: ("G4", "D3", "G3", "B3", "D4"), 6: ("E2", "A2", "D3", "G3", "B3", "E4")}


def stem_ticks(beams, dots) -> Column:
    """Ticks of a stem: no beam a quarter, one an eighth, two a sixteenth, three a 32nd; two dots at most."""
    beams, dots = F.col(beams) if isinstance(beams, str) else beams, F.col(dots) if isinstance(dots, str) else dots
    value = F.lit(WHOLE // 4) / F.pow(F.lit(2.0), beams)
    ticks = value * (2 - F.pow(F.lit(2.0), -F.least(dots, F.lit(2))))
    return F.when(beams.between(0, 3), ticks.cast("long"))


def bars(events: DataFrame, barlines: DataFrame) -> DataFrame:
    """``events`` with ``bar`` (numbered over the page), ``repeat_start`` and ``repeat_end`` of the bar.

    An event belongs to the bar whose lines lie strictly on either side; one exactly on a line is lost. A system's
    first and last bars are open to the page. Bars without events are not numbered.
    """
    both = events.select("page", "system", "x", F.lit(1).alias("is_event"), F.struct(*events.columns).alias("event")).unionByName(
        barlines.select("page", "system", "x", "repeat_start", "repeat_end", F.lit(0).alias("is_event")), allowMissingColumns=True
    )
    w = Window.partitionBy("page", "system").orderBy("x", "is_event")
    line = F.when(F.col("is_event") == 0, F.struct("x", "repeat_start", "repeat_end"))
    both = both.withColumns({
        "left": F.last(line, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "right": F.first(line, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    })
    within = (F.col("left.x").isNull() | (F.col("x") > F.col("left.x"))) & (F.col("right.x").isNull() | (F.col("x") < F.col("right.x")))
    held = both.filter((F.col("is_event") == 1) & within)
    edge = F.coalesce("left.x", F.lit(float("-inf")))
    number = F.dense_rank().over(Window.partitionBy("page").orderBy("system", edge)) - 1
    return held.select(
        "event.*", number.alias("bar"),
        F.coalesce("left.repeat_start", F.lit(False)).alias("repeat_start"), F.coalesce("right.repeat_end", F.lit(False)).alias("repeat_end"),
    )


def bar_lengths(barred: DataFrame) -> DataFrame:
    """One row for each bar: ``known`` ticks, ``open`` notes without length, repeats, and whether it is the page's last."""
    per = barred.groupBy("page", "bar").agg(
        F.coalesce(F.sum("ticks"), F.lit(0)).alias("known"), F.count(F.when(F.col("ticks").isNull(), 1)).alias("open"),
        F.bool_or("repeat_start").alias("repeat_start"), F.bool_or("repeat_end").alias("repeat_end"),
    )
    return per.withColumn("count", F.count("*").over(Window.partitionBy("page")))


def fit(lengths: DataFrame, full: Column) -> DataFrame:
    """``lengths`` with ``long`` (ticks that each open note takes), ``pickup`` and ``fits`` for bars of ``full`` ticks.

    A part opens at the page's first bar and after a repeat start; a bar there of half a bar at most is a pickup, and
    the bar that closes the part may lack as much. Open notes share the rest if each gets a whole, dotted half or half.
    """
    share = (full - F.col("known")) / F.col("open")
    long = F.when(F.col("open") > 0, F.coalesce(*[F.when(share == v, F.lit(v)) for v in LONG]))
    opens = (F.col("bar") == 0) | F.col("repeat_start")
    short = (F.col("open") == 0) & (F.col("count") > 1) & (F.col("known") > 0) & (F.col("known") * 2 <= full)
    start = F.when(opens, F.struct(F.when(short, F.col("known")).alias("upbeat")))
    w = Window.partitionBy("page").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    out = lengths.withColumns({"full": full, "long": long, "opens": opens, "part": F.last(start, ignorenulls=True).over(w)})
    upbeat = F.col("part.upbeat")
    ends = F.col("repeat_end") | (F.col("bar") == F.col("count") - 1)
    pickup = F.col("opens") & upbeat.isNotNull()
    closing = ~F.col("opens") & ends & upbeat.isNotNull() & (F.col("known") + upbeat == F.col("full"))
    fits = F.when(F.col("open") > 0, F.col("long").isNotNull()).otherwise((F.col("known") == F.col("full")) | pickup | F.coalesce(closing, F.lit(False)))
    return out.withColumns({"pickup": pickup, "fits": fits}).drop("part", "opens")


def vote_meter(lengths: DataFrame) -> DataFrame:
    """``page, num, den, fit, bars``: the metre that most bars fit, the earlier one of equals."""
    meters = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("num"), F.lit(d).alias("den")) for k, (n, d) in enumerate(METERS)])
    tried = lengths.withColumn("m", F.explode(meters))
    # One window over (page, metre): the page column is the pair for the time being.
    keyed = tried.withColumns({"whole_page": F.col("page"), "page": F.struct("page", "m")})
    checked = fit(keyed, (F.lit(WHOLE) * F.col("m.num") / F.col("m.den")).cast("long"))
    counts = checked.groupBy("whole_page", "m").agg(F.count(F.when(F.col("fits"), 1)).alias("fit"), F.count("*").alias("bars"))
    best = counts.groupBy("whole_page").agg(F.max(F.struct("fit", (-F.col("m.k")).alias("k"), "m", "bars")).alias("b"))
    return best.select(F.col("whole_page").alias("page"), "b.m.num", "b.m.den", "b.fit", "b.bars")


def pitch_tab(events: DataFrame, tunings: DataFrame) -> DataFrame:
    """``events`` with ``midi array<int>`` beside ``notes``: open string, capo and fret.

    ``tunings`` is ``page, strings array<string>`` (pitch names, the top line first) and ``capo`` (null: none); a string
    that the tuning lacks, or a capo outside 0 to 24, gives null.
    """
    opened = F.transform("strings", notation.midi_of_pitch)
    t = tunings.select("page", opened.alias("__open"), F.coalesce("capo", F.lit(0)).alias("__capo"))
    one = lambda n: F.when(
        F.col("__capo").between(0, 24), F.try_element_at("__open", n["string"].cast("int")) + F.col("__capo") + n["fret"]
    ).cast("int")
    return events.join(t, "page", "left").withColumn("midi", F.transform("notes", one)).drop("__open", "__capo")


def standard_tuning(lines: Column) -> Column:
    """Pitch names of the standard tuning for a line count, the top line first; null for other counts."""
    named = [F.when(lines == n, F.array(*[F.lit(p) for p in reversed(strings)])) for n, strings in STANDARD.items()]
    return F.coalesce(*named)


def resolve(events: DataFrame, barlines: DataFrame, meters: DataFrame | None = None) -> DataFrame:
    """One row for each bar: its page's metre (printed in ``meters`` or voted), ``status``, length and fit.

    ``meters`` is ``page, num, den`` for pages that print one; for the others the status stays ``missing`` and the
    voted metre is a candidate only.
    """
    lengths = bar_lengths(bars(events, barlines))
    voted = vote_meter(lengths).select("page", "num", "den")
    if meters is None:
        known = voted.withColumn("status", F.lit("missing"))
    else:
        printed = meters.select("page", F.col("num").alias("pnum"), F.col("den").alias("pden"))
        status = F.when(F.col("pnum").isNotNull(), "read").otherwise("missing").alias("status")
        known = voted.join(printed, "page", "left").select("page", F.coalesce("pnum", "num").alias("num"), F.coalesce("pden", "den").alias("den"), status)
    checked = fit(lengths.join(known, "page"), (F.lit(WHOLE) * F.col("num") / F.col("den")).cast("long"))
    total = F.col("known") + F.when(F.col("long").isNotNull(), F.col("open") * F.col("long")).otherwise(0)
    return checked.select("page", "bar", "num", "den", "status", (total / (WHOLE // 4)).alias("quarters"), "open", "pickup", "fits")
