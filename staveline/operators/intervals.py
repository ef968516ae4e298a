"""Joins on overlap, order and distance, written as equi-joins.

Overlap joins cut the axis into cells of ``width``; a span is listed in each
cell it touches and spans meet by (keys, cell), so that the exact predicate only
sees neighbours and every join partitions on a key. A match is kept in the cell
where the later of the two spans begins, so that no pair appears twice. Order
joins are one sort of the union of both sides by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cells(df: DataFrame, low: str, high: str, width: float) -> DataFrame:
    first, last = F.floor(F.col(low) / width), F.floor(F.col(high) / width)
    return df.withColumn("__cell", F.explode(F.sequence(first, F.greatest(first, last))))


def overlap_pairs(
    left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: float,
    *, strict: bool = False,
) -> DataFrame:
    """All pairs of rows with equal keys whose spans overlap (touching counts unless ``strict``).

    Apart from ``keys`` the two sides' column names must differ. Null ends match nothing.
    """
    a, b = _cells(left, *left_span, width), _cells(right, *right_span, width)
    (la, ha), (lb, hb) = left_span, right_span
    meets = (F.col(la) < F.col(hb)) & (F.col(lb) < F.col(ha)) if strict else (F.col(la) <= F.col(hb)) & (F.col(lb) <= F.col(ha))
    once = F.col("__cell") == F.floor(F.greatest(F.col(la), F.col(lb)) / width)
    return a.join(b, [*keys, "__cell"]).filter(meets & once).drop("__cell")


def first_match(
    left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: float,
    *, left_id: str, order: str, take: list[str],
) -> DataFrame:
    """``left`` with the ``take`` columns of the first overlapping right row in ``order``, nulls where there is none.

    The first in input order wins, not the nearest; a right row may serve many left rows.
    """
    pairs = overlap_pairs(left, right, keys, left_span, right_span, width)
    best = pairs.groupBy(left_id).agg(F.min(F.struct(F.col(order).alias("__order"), *take)).alias("__best"))
    best = best.select(left_id, *[F.col(f"__best.{t}").alias(t) for t in take])
    return left.join(best, left_id, "left")


def overlapping(
    left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: float,
    *, left_id: str, anti: bool = False,
) -> DataFrame:
    """Left rows that overlap some right row (or none, with ``anti``)."""
    hit = overlap_pairs(left.select(left_id, *keys, *left_span), right.select(*keys, *right_span), keys, left_span, right_span, width)
    return left.join(hit.select(left_id).distinct(), left_id, "left_anti" if anti else "left_semi")


def points_in_spans(
    points: DataFrame, spans: DataFrame, keys: list[str], at: str, span: tuple[str, str], width: float,
    *, low_open: bool = True, high_open: bool = True,
) -> DataFrame:
    """Each point with each span that holds it; open bounds lose points that lie on them."""
    cells = _cells(spans, *span, width)
    p = points.withColumn("__cell", F.floor(F.col(at) / width))
    low = F.col(at) > F.col(span[0]) if low_open else F.col(at) >= F.col(span[0])
    high = F.col(at) < F.col(span[1]) if high_open else F.col(at) <= F.col(span[1])
    return p.join(cells, [*keys, "__cell"]).filter(low & high).drop("__cell")


def asof_previous(left: DataFrame, right: DataFrame, keys: list[str], at: str, take: list[str], *, tie: str | None = None) -> DataFrame:
    """``left`` with the ``take`` columns of the last right row at or before ``at`` (largest ``tie`` of equals)."""
    held = F.struct(*[F.col(t).alias(t) for t in take])
    r = right.select(*keys, F.col(at), F.lit(0).alias("__side"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("__tie"), held.alias("__held"))
    own = F.struct(*[F.col(c) for c in left.columns])
    l_ = left.select(*keys, F.col(at), F.lit(1).alias("__side"), F.lit(0).cast("long").alias("__tie"), own.alias("__own"))
    both = r.unionByName(l_, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("__last", F.last("__held", ignorenulls=True).over(w)).filter("__side = 1")
    return filled.select("__own.*", *[F.col(f"__last.{t}").alias(t) for t in take])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, right_id: str, cutoff: float) -> DataFrame:
    """``left`` with ``right_id`` and ``distance`` of the nearest right row, nulls beyond ``cutoff``.

    Of equally near rows the smallest ``right_id`` wins. Only the neighbours on either side in sort order are looked at.
    """
    held = F.struct(F.col(right_at).alias("v"), F.col(right_id).alias("id"))
    # Of equal right values only the smallest id can win.
    r = right.groupBy(*keys, right_at).agg(F.min(right_id).alias(right_id))
    r = r.select(*keys, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), held.alias("__held"))
    own = F.struct(*[F.col(c) for c in left.columns])
    l_ = left.select(*keys, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), own.alias("__own"))
    both = r.unionByName(l_, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__at", "__side")
    before = F.last("__held", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__held", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumns({"__b": before, "__a": after}).filter("__side = 1")

    def option(c: str) -> Column:
        # A missing neighbour leaves the least() of the other alone.
        return F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["v"] - F.col("__at")).alias("d"), F.col(c)["id"].alias("id")))

    best = F.least(option("__b"), option("__a"))
    near = near.withColumn("__best", F.when(best["d"] <= cutoff, best))
    return near.select("__own.*", F.col("__best.id").alias(right_id), F.col("__best.d").alias("distance"))
