"""Rounding and index arithmetic as Column expressions.

All are built-in expressions and stay inside whole-stage code generation, but
for ``py_round`` and ``float_floor_div``, whose results depend on the exact
value of a double and come from Arrow batches.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def round_half_even(x) -> Column:
    """Nearest integer, ties to even, as double."""
    return F.rint(_c(x))


def np_round(x, decimals: int) -> Column:
    """Scale, round half to even, scale back."""
    scale = 10.0**decimals
    return F.rint(_c(x) * scale) / scale


@F.pandas_udf(T.DoubleType())
def _py_round(x: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or math.isnan(v) else round(v, int(k)) for v, k in zip(x, n, strict=True)], dtype="float64")


def py_round(x, ndigits: int) -> Column:
    """Round to ``ndigits`` by the double's exact value (2.675 gives 2.67)."""
    return _py_round(_c(x).cast("double"), F.lit(ndigits))


@F.pandas_udf(T.DoubleType())
def _floor_div(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: float, y: float) -> float:
        return x // y if y else math.nan

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def float_floor_div(a, b) -> Column:
    """Floor division of doubles by the remainder, exact on cell edges; NaN for a zero divisor."""
    return _floor_div(_c(a).cast("double"), _c(b).cast("double"))


def int_floor_div(a, b) -> Column:
    """Floor division of integers."""
    sign = F.signum(_c(b)).cast("long")
    a, b = _c(a) * sign, _c(b) * sign
    return ((a - F.pmod(a, b)) / b).cast("long")


def trunc_to_int(x) -> Column:
    """Towards zero."""
    return _c(x).cast("long")


def clamp(x, low, high) -> Column:
    return F.least(F.greatest(_c(x), _c(low)), _c(high))


def clamp_to_index(x, length) -> Column:
    """Half-even rounded and kept inside 0 .. length - 1."""
    return clamp(F.rint(_c(x)).cast("long"), F.lit(0), _c(length) - 1)


def to_float32(x) -> Column:
    """The double nearest to the single-precision value."""
    return _c(x).cast("float").cast("double")


def round_half_away(x) -> Column:
    """Ties away from zero."""
    x = _c(x)
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def slice_bounds(start, stop, length) -> Column:
    """``start, stop`` of a half-open slice after negative indexes and clipping."""
    def norm(v: Column) -> Column:
        return clamp(F.when(v < 0, v + _c(length)).otherwise(v), F.lit(0), _c(length))

    low = norm(_c(start))
    return F.struct(low.alias("start"), F.greatest(low, norm(_c(stop))).alias("stop"))


def reflect101(index, length) -> Column:
    """Mirror an index into 0 .. length - 1 without repeating the edge."""
    i, n = _c(index), _c(length)
    period = F.greatest(2 * (n - 1), F.lit(1))
    m = F.pmod(i, period)
    return F.when(n <= 1, F.lit(0)).otherwise(F.least(m, period - m))


def center_of_span(low, high) -> Column:
    return F.rint((_c(low) + _c(high)) / 2).cast("long")


def round_to_step(x, step: int) -> Column:
    """Half-even to a multiple of ``step``."""
    return (F.rint(_c(x) / step) * step).cast("long")


def multiple_of(x, step: int) -> Column:
    """The nearest multiple of ``step``, one step at least."""
    return F.greatest(F.rint(_c(x) / step).cast("long") * step, F.lit(step).cast("long"))


def prior_power_of_two(n) -> Column:
    """The largest power of two that is not above ``n``."""
    n = _c(n).cast("long")
    p = F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double")))).cast("long")
    # The logarithm may be off by one step at the edges.
    return F.when(p > n, (p / 2).cast("long")).when(2 * p <= n, 2 * p).otherwise(p)


def min_or_either(a, b) -> Column:
    """The smaller of two, or the one that isn't null."""
    return F.least(_c(a), _c(b))


def gcd(a, b) -> Column:
    """Greatest common divisor by Euclid's steps inside one expression (93 bound 64-bit inputs)."""
    start = F.struct(F.abs(_c(a).cast("long")).alias("x"), F.abs(_c(b).cast("long")).alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(
        F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).alias("y"))
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["x"])


def lcm(a, b) -> Column:
    a, b = _c(a).cast("long"), _c(b).cast("long")
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.abs(F.floor(a / gcd(a, b)).cast("long") * b))


def lcm_of(array) -> Column:
    """Least common multiple of an array of positive integers; 1 if it is empty."""
    return F.aggregate(_c(array), F.lit(1).cast("long"), lambda s, x: lcm(s, x.cast("long")))
