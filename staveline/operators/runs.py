"""Window-shaped operators: islands, running state, fills, merges and ranks. One sort by key each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_islands(df: DataFrame, keys: list[str], at: str, tie: str, gap: float, name: str = "island") -> DataFrame:
    """Number runs in which each row lies less than ``gap`` after the one before; a gap of exactly ``gap`` opens a new run."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    opens = F.when(F.col(at) - F.lag(at).over(w) >= gap, 1).otherwise(0)
    marked = df.withColumn("__open", opens)
    return marked.withColumn(name, F.sum("__open").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__open")


def equal_runs(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "run") -> DataFrame:
    """Number runs of successive rows with an equal value (null equals null)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))) & (F.row_number().over(w) > 1)
    marked = df.withColumn("__open", new.cast("int"))
    return marked.withColumn(name, F.sum("__open").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__open")


def running_change(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the last one seen under the key; first rows stay."""
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumns({"__n": F.row_number().over(w), "__last": F.lag(value).over(w)})
    return kept.filter((F.col("__n") == 1) | ~F.col(value).eqNullSafe(F.col("__last"))).drop("__n", "__last")


def forward_fill(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last non-null ``value`` up to and with each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def reading_order(df: DataFrame, keys: list[str], x: str, y: str, tie: str, row_gap: float, name: str = "place") -> DataFrame:
    """Place in reading order: rows break where ``y`` is ``row_gap`` or more below the previous one in y-order; within a row by ``x``."""
    rows = gap_islands(df, keys, y, tie, row_gap, "__row")
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("__row", x, tie))).drop("__row")


def merge_spans(df: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Unions of overlapping or touching spans: keys, ``low``, ``high`` and the number of ``parts``."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__open", F.when(F.col(low) > reach, 1).otherwise(0))
    marked = marked.withColumn("__part", F.sum("__open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__part").agg(F.min(low).alias(low), F.max(high).alias(high), F.count("*").alias("parts")).drop("__part")


def top_ranked(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows under each key; ``order`` must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n).drop("__rank")


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in ``order``; a pre-aggregated minimum, not a sort."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    one = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__one"))
    return one.select(*[c if c in keys else F.col(f"__one.{c}").alias(c) for c in df.columns])


def within_sigma(df: DataFrame, keys: list[str], value: str, sigmas: float = 3.0) -> DataFrame:
    """Rows not further than ``sigmas`` population deviations from the mean of their key; a zero or undefined deviation keeps all."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__sd"))
    far = (F.abs(F.col(value) - F.col("__mean")) > sigmas * F.col("__sd")) & (F.col("__sd") > 0)
    return df.join(stats, keys).filter(~F.coalesce(far, F.lit(False))).drop("__mean", "__sd")


def upper_median(value: str) -> Column:
    """The element at index n // 2 of the sorted values."""
    return F.expr(f"percentile_disc(0.5) within group (order by {value} desc)")


def mode_smallest(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, the smallest of equally frequent ones, and its count."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col(value)).alias("v"))).alias("b"))
    return best.select(*keys, (-F.col("b.v")).alias(value), F.col("b.n").alias("n"))
