"""Exact note lengths: ``struct<num: bigint, den: bigint>`` in lowest terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from staveline.functions.rounding import _c, gcd

TYPE = "struct<num:bigint,den:bigint>"


def ratio(num, den=1) -> Column:
    """Lowest terms, positive denominator; null for a zero denominator."""
    n, d = _c(num).cast("long"), _c(den).cast("long")
    g = gcd(n, d) * F.signum(d).cast("long")
    reduced = F.struct((n / g).cast("long").alias("num"), (d / g).cast("long").alias("den"))
    return F.when(d != 0, reduced)


def add(a, b) -> Column:
    a, b = _c(a), _c(b)
    return ratio(a["num"] * b["den"] + b["num"] * a["den"], a["den"] * b["den"])


def sub(a, b) -> Column:
    a, b = _c(a), _c(b)
    return ratio(a["num"] * b["den"] - b["num"] * a["den"], a["den"] * b["den"])


def mul(a, b) -> Column:
    a, b = _c(a), _c(b)
    return ratio(a["num"] * b["num"], a["den"] * b["den"])


def compare(a, b) -> Column:
    """Negative, zero or positive, by cross-multiplication."""
    a, b = _c(a), _c(b)
    return F.signum(a["num"] * b["den"] - b["num"] * a["den"]).cast("int")


def truncated(a) -> Column:
    """The whole part, towards zero."""
    a = _c(a)
    return F.when(a["num"] >= 0, F.floor(a["num"] / a["den"])).otherwise(F.ceil(a["num"] / a["den"])).cast("long")


def dotted(base, dots, actual=1, normal=1) -> Column:
    """A base length with augmentation dots, ``actual`` notes in the time of ``normal``."""
    scale = F.pow(F.lit(2.0), _c(dots)).cast("long")
    return mul(mul(base, ratio(2 * scale - 1, scale)), ratio(normal, actual))
