"""Page layout: staffs, systems, title and the columns of note heads.

Tables: ``staffs`` (``page, staff, min_x, max_x, min_y, max_y, unit``), ``braces`` (``page, brace, cx, cy, w, h``),
``texts`` (``page, seq, text, top, bottom``), ``heads`` (``page, staff, head, x, position``), ``events`` (``page, staff,
event, x, position``; a null x is a note without attention).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staveline.functions.rounding import _c, to_float32
from staveline.functions.text import is_tempo_marking
from staveline.operators.sequential import greedy_pairs, move_table, walk_back

#: Costs of the alignment of notes and columns.
GAP, ATTENTION, ATTENTION_CAP = 1.0, 0.25, 3.0
#: Where no staff lies below.
NO_STAFF_BELOW = 1e12


def column_in_page(x, crop) -> Column:
    """An x of the cropped page on the whole one; ``crop`` is ``struct<x0, x1, y0, y1>`` in shares."""
    c = _c(crop)
    return c["x0"] + _c(x) * (c["x1"] - c["x0"])


def staff_in_page(staff, crop) -> Column:
    """A staff box (``struct<index, cx, cy, w, h>``) of the cropped page on the whole one."""
    s, c = _c(staff), _c(crop)
    width, height = c["x1"] - c["x0"], c["y1"] - c["y0"]
    return F.struct(
        s["index"].alias("index"), (c["x0"] + s["cx"] * width).alias("cx"), (c["y0"] + s["cy"] * height).alias("cy"),
        (s["w"] * width).alias("w"), (s["h"] * height).alias("h"),
    )


def free_rows(staffs: DataFrame) -> DataFrame:
    """``staffs`` with ``above`` (lowest end of the staffs that start above this one, or 0) and ``below`` (highest start
    of the staffs that end below this one's end)."""
    up = Window.partitionBy("page").orderBy("min_y")
    down = Window.partitionBy("page").orderBy(F.desc("max_y"))
    # Equal starts aren't above one another: one row for each start, and all rows before it.
    starts = staffs.groupBy("page", "min_y").agg(F.max("max_y").alias("reach"))
    starts = starts.withColumn("above", F.max("reach").over(up.rowsBetween(Window.unboundedPreceding, -1))).drop("reach")
    ends = staffs.groupBy("page", "max_y").agg(F.min("min_y").alias("reach"))
    ends = ends.withColumn("below", F.min("reach").over(down.rowsBetween(Window.unboundedPreceding, -1))).drop("reach")
    out = staffs.join(starts, ["page", "min_y"]).join(ends, ["page", "max_y"])
    return out.withColumns({"above": F.coalesce("above", F.lit(0.0)), "below": F.coalesce("below", F.lit(NO_STAFF_BELOW))})


def in_sight(staffs: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Staffs inside the page; in its outer hundredth (left or right) only those at least half as wide as the mean."""
    mean = staffs.groupBy("page").agg(F.avg(F.col("max_x") - F.col("min_x")).alias("__mean"))
    margin = F.col(width) * 0.01
    outer = (F.col("max_x") < margin) | (F.col("min_x") > F.col(width) - margin)
    narrow = F.col("max_x") - F.col("min_x") < F.col("__mean") / 2
    inside = (F.col("max_y") < F.col(height)) & (F.col("min_y") >= 0)
    return staffs.join(mean, "page").filter(inside & ~(outer & narrow)).drop("__mean")


def brace_scores(staffs: DataFrame, braces: DataFrame, x_factor: float = 5.0, y_factor: float = 0.5, *, own_pair: bool = False) -> DataFrame:
    """``page, upper, lower, score`` of each two neighbouring staffs: their best brace's score, 0 without one.

    A brace scores the rows it shares with the pair less its distance from the pair's left edge, if it is nearer than
    ``x_factor`` units (the mean of both staffs'), shares more than ``y_factor`` of its height and more rows than that
    distance. With ``own_pair`` a brace counts for the pair that its column ``upper`` names only.
    """
    w = Window.partitionBy("page").orderBy("min_y", "staff")
    pairs = staffs.select(
        "page", F.col("staff").cast("long").alias("upper"), F.lead("staff").over(w).cast("long").alias("lower"), "min_y",
        ((F.col("unit") + F.lead("unit").over(w)) / 2).alias("unit"), F.least("min_x", F.lead("min_x").over(w)).alias("left"), F.lead("max_y").over(w).alias("end"),
    ).filter("lower is not null")
    met = pairs.join(braces, ["page", "upper"] if own_pair else "page", "left")
    away = F.abs(F.col("left") - F.col("cx"))
    shared = F.least(F.col("cy") + F.col("h") / 2, F.col("end")) - F.greatest(F.col("cy") - F.col("h") / 2, F.col("min_y"))
    good = (away < x_factor * F.col("unit")) & (shared > y_factor * F.col("h")) & (shared > away)
    return met.groupBy("page", "upper", "lower").agg(F.max(F.when(good, shared - away).otherwise(0.0)).alias("score"))


def grand_staffs(staffs: DataFrame, braces: DataFrame, x_factor: float = 5.0, y_factor: float = 0.5) -> DataFrame:
    """``page, upper, lower, score``: neighbouring staffs that a brace joins, best scores first, none used twice."""
    scored = brace_scores(staffs, braces, x_factor, y_factor)
    kind = staffs.schema["page"].dataType.simpleString()
    return greedy_pairs(scored, ["page"], f"page {kind}", "upper", "lower", "score")


def titles(texts: DataFrame) -> DataFrame:
    """``page, title``: the line of the tallest characters that is no tempo marking, the first of equals."""
    size = to_float32(to_float32(F.col("bottom") - F.col("top")) / F.length("text"))
    kept = texts.filter(~is_tempo_marking("text")).withColumn("size", size)
    best = kept.groupBy("page").agg(F.max(F.struct("size", (-F.col("seq")).alias("first"), "text")).alias("b"))
    clean = F.trim(F.regexp_replace("b.text", r"[^\p{L}\p{M}\p{N}'’-]+", " "))
    return best.select("page", clean.alias("title"))


def chord_strip(staff, width, height) -> Column:
    """Rows and columns above a staff box where chord texts stand: from 1.9 to 0.05 heights above it, a little wider."""
    s, w, h = _c(staff), _c(width), _c(height)
    top, left = s["cy"] - s["h"] / 2, s["cx"] - s["w"] / 2
    pixel = lambda v, of: F.greatest(F.lit(0), F.least((v * of).cast("long"), of.cast("long")))
    return F.struct(
        pixel(top - 1.9 * s["h"], h).alias("y0"), pixel(top - 0.05 * s["h"], h).alias("y1"),
        pixel(left - 0.03, w).alias("x0"), pixel(left + s["w"] + 0.02, w).alias("x1"),
    )


def note_columns(heads: DataFrame, unit: str = "unit", share: float = 0.8) -> DataFrame:
    """``page, staff, column, x, positions``: heads grouped where each lies less than ``share`` units after the one before."""
    w = Window.partitionBy("page", "staff").orderBy("x", "head")
    opens = F.when(F.col("x") - F.lag("x").over(w) >= share * F.col(unit), 1).otherwise(0)
    numbered = heads.withColumn("__open", opens)
    numbered = numbered.withColumn("column", F.sum("__open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("page", "staff", "column").agg(F.avg("x").alias("x"), F.sort_array(F.collect_list("position")).alias("positions"))


def align_notes(events: DataFrame, columns: DataFrame, schema: str = "page long, staff long") -> DataFrame:
    """``page, staff, event, column``: notes paired with head columns in order, nulls for unpaired notes.

    A pair costs its pitch (0, 0.5 or 1 for the nearest position 0, 1 or more steps away) and a quarter of the attention
    distance in column spacings, three at most; a skip costs 1. Of equal costs a pair wins, then skipping the note.
    """
    def one(key: tuple, ev: pd.DataFrame, co: pd.DataFrame) -> pd.DataFrame:
        if "event" not in ev.columns or not len(ev):
            return pd.DataFrame({"page": [], "staff": [], "event": [], "column": []})
        ev = ev.sort_values("event")
        notes = list(zip(ev["x"], ev["position"], strict=True))
        cols = list(zip(*(co.sort_values("column")[c] for c in ("x", "positions", "column")), strict=True)) if "column" in co.columns else []
        xs = np.array([c[0] for c in cols], float)
        spacing = np.minimum(np.diff(xs, prepend=-np.inf), np.diff(xs, append=np.inf)) if cols else xs

        def costs(x, position) -> list[float]:
            known = position is not None and not pd.isna(position)
            near = [min((abs(position - p) for p in positions), default=9) if known else 9 for _, positions, _ in cols]
            away = np.zeros(len(xs)) if x is None or pd.isna(x) else np.abs(x - xs) / spacing
            return [min(n, 2) / 2 + ATTENTION * d for n, d in zip(near, np.minimum(away, ATTENTION_CAP).tolist(), strict=True)]

        moves, _ = move_table((costs(*note) for note in notes), len(notes), len(cols), GAP)
        paired: list = [None] * len(notes)
        for i, j in walk_back(moves):
            if i is not None and j is not None:
                paired[i] = cols[j][2]
        out = pd.DataFrame({"event": ev["event"].to_numpy(), "column": pd.array(paired, "Int64")})
        out["page"], out["staff"] = key
        return out[["page", "staff", "event", "column"]]

    grouped = events.groupBy("page", "staff").cogroup(columns.groupBy("page", "staff"))
    return grouped.applyInPandas(one, f"{schema}, event long, column long")
