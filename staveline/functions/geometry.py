"""Rotated rectangles, staffs and quads as Column expressions.

A rectangle is ``struct<cx, cy, w, h, angle: double>`` (degrees); a point is ``struct<x, y: double>``. ``u`` is the
staff's unit size, the distance between two of its lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from staveline.functions.rounding import _c

RECT = "struct<cx:double,cy:double,w:double,h:double,angle:double>"


def rect(cx, cy, w, h, angle=0.0) -> Column:
    names = ("cx", "cy", "w", "h", "angle")
    return F.struct(*[_c(v).cast("double").alias(n) for v, n in zip((cx, cy, w, h, angle), names, strict=True)])


def legacy_angle(r) -> Column:
    """Turn by quarter turns, swapping the sides, until the angle lies below zero (from -90)."""
    r = _c(r)
    turns = F.greatest(F.floor(r["angle"] / 90) + 1, F.lit(0))
    odd = turns % 2 == 1
    return rect(r["cx"], r["cy"], F.when(odd, r["h"]).otherwise(r["w"]), F.when(odd, r["w"]).otherwise(r["h"]), r["angle"] - 90 * turns)


def normalized(r) -> Column:
    """The same rectangle with its angle in [-45, 45]."""
    r = _c(r)
    turns = F.ceil((F.abs(r["angle"]) - 45) / 90)
    turns = F.greatest(turns, F.lit(0))
    odd = turns % 2 == 1
    angle = r["angle"] - F.signum(r["angle"]) * 90 * turns
    return rect(r["cx"], r["cy"], F.when(odd, r["h"]).otherwise(r["w"]), F.when(odd, r["w"]).otherwise(r["h"]), angle)


def corners(r) -> Column:
    """The four corners, from the lower left around."""
    r = _c(r)
    a = F.radians(r["angle"])
    b, c = F.cos(a) * 0.5, F.sin(a) * 0.5

    def at(sx: int, sy: int) -> Column:
        x = r["cx"] + sx * r["h"] * c + sy * r["w"] * b
        y = r["cy"] - sx * r["h"] * b + sy * r["w"] * c
        return F.struct(x.alias("x"), y.alias("y"))

    return F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1))


def thicker(r, by) -> Column:
    """Both sides grown."""
    r = _c(r)
    return rect(r["cx"], r["cy"], r["w"] + by, r["h"] + by, r["angle"])


def taller(r, by, keep_center: bool = True) -> Column:
    """The height grown; without ``keep_center`` the centre moves up by half of it (floored)."""
    r = _c(r)
    up = F.lit(0.0) if keep_center else F.floor(_c(by) / 2)
    return rect(r["cx"], r["cy"] - up, r["w"], r["h"] + by, r["angle"])


def at_least(r, w, h) -> Column:
    r = _c(r)
    return rect(r["cx"], r["cy"], F.greatest(r["w"], _c(w)), F.greatest(r["h"], _c(h)), r["angle"])


def within_size(r, min_w=None, min_h=None, max_w=None, max_h=None) -> Column:
    """Size bounds; None is no bound."""
    r, out = _c(r), F.lit(True)
    for side, low, high in (("w", min_w, max_w), ("h", min_h, max_h)):
        if low is not None:
            out = out & (r[side] >= low)
        if high is not None:
            out = out & (r[side] <= high)
    return out


def is_valid(r) -> Column:
    """Finite sides that aren't zero."""
    r = _c(r)
    fine = lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")) & (v != 0)
    return fine(r["w"]) & fine(r["h"])


def center_distance(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.hypot(a["cx"] - b["cx"], a["cy"] - b["cy"])


def may_touch(a, b) -> Column:
    """Whether the centres are no further apart than the sum of the longer sides."""
    x, y = _c(a), _c(b)
    return center_distance(a, b) <= F.greatest(x["w"], x["h"]) + F.greatest(y["w"], y["h"])


def height_at(r, x) -> Column:
    """The height of the rectangle's long axis, carried on to ``x``."""
    r = _c(r)
    return r["cy"] + (_c(x) - r["cx"]) * F.tan(F.radians(r["angle"]))


def extrapolates_to(a, b, u) -> Column:
    """Whether two line pieces carry on into each other: a gap of 5 u at most, a third of u in height at the middle."""
    p, q = _c(a), _c(b)
    mid = (p["cx"] + q["cx"]) / 2
    gap = lambda r: F.greatest(F.abs(r["cx"] - mid) - F.floor(r["w"] / 2), F.lit(0.0))
    return (gap(p) + gap(q) <= 5 * _c(u)) & (F.abs(height_at(a, mid) - height_at(b, mid)) <= _c(u) / 3)


def unit_size(ys) -> Column:
    """The mean distance of successive lines."""
    y = _c(ys)
    n = F.size(y)
    return (F.element_at(y, n) - F.element_at(y, 1)) / (n - 1)


def y_tolerance(u) -> Column:
    return 4 * _c(u)


def polygon_area(points) -> Column:
    """Signed area by the shoelace rule."""
    p = _c(points)
    n = F.size(p)
    term = lambda i: (
        F.element_at(p, i)["x"] * F.element_at(p, i % n + 1)["y"] - F.element_at(p, i % n + 1)["x"] * F.element_at(p, i)["y"]
    )
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), term), F.lit(0.0), lambda s, x: s + x) / 2


def polygon_length(points) -> Column:
    p = _c(points)
    n = F.size(p)
    step = lambda i: F.hypot(
        F.element_at(p, i % n + 1)["x"] - F.element_at(p, i)["x"], F.element_at(p, i % n + 1)["y"] - F.element_at(p, i)["y"]
    )
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), step), F.lit(0.0), lambda s, x: s + x)


def unclip_distance(points, ratio: float = 1.6) -> Column:
    """How far a text box is to grow: area times ratio by length."""
    return F.abs(polygon_area(points)) * ratio / polygon_length(points)


def in_triangle(p, a, b, c) -> Column:
    """Whether a point lies in a triangle, its edges included."""
    p, a, b, c = _c(p), _c(a), _c(b), _c(c)
    side = lambda s, t: (t["x"] - s["x"]) * (p["y"] - s["y"]) - (t["y"] - s["y"]) * (p["x"] - s["x"])
    d = [side(a, b), side(b, c), side(c, a)]
    return ~(F.greatest(*d) > 0) | ~(F.least(*d) < 0)


#: Thresholds in units of the staff's unit size.
UNITS = {
    "line_tolerance": 1 / 3, "line_gap": 5.0, "short_line": 1 / 5, "short_connected_line": 2.0, "brace_height_rough": 2.0,
    "brace_width_rough": 3.0, "brace_height": 4.0, "bar_width": 2.0, "bar_height": 3.0, "black_spot": 2.0,
}


def threshold(name: str, u) -> Column:
    return UNITS[name] * _c(u)


def share_of_page(x0, y0, x1, y1, width, height, digits: int = 4) -> Column:
    """A pixel box as shares of its page."""
    part = lambda v, of: F.round(_c(v) / _c(of), digits)
    return F.struct(part(x0, width).alias("x0"), part(y0, height).alias("y0"), part(x1, width).alias("x1"), part(y1, height).alias("y1"))
