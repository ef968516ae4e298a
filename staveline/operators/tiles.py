"""Two-dimensional tumbling windows: tile counts, neighbour tests and the merge of overlapping tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tile_counts(points: DataFrame, keys: list[str], x: str, y: str, size_x: float, size_y: float, *aggregates: Column) -> DataFrame:
    """``keys, i, j`` and the aggregates of each tile that holds a point."""
    i, j = F.floor(F.col(x) / size_x).alias("i"), F.floor(F.col(y) / size_y).alias("j")
    return points.groupBy(*[F.col(k) for k in keys], i, j).agg(*aggregates)


def noisy_tiles(tiles: DataFrame, keys: list[str], value: str, limit: float) -> DataFrame:
    """Tiles above ``limit`` that have a 4-neighbour above it as well."""
    high = tiles.filter(F.col(value) > limit)
    step = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    near = high.select(*keys, "i", "j", F.explode(step).alias("d"))
    near = near.select(*keys, (F.col("i") + F.col("d.di")).alias("i"), (F.col("j") + F.col("d.dj")).alias("j")).distinct()
    return high.join(near, [*keys, "i", "j"], "left_semi")


def covered_average(tiles: DataFrame, keys: list[str], start: str, length: int, value: str) -> DataFrame:
    """Truncated mean of the values of all tiles that cover a place: ``keys, at, merged``."""
    at = F.explode(F.sequence(F.col(start), F.col(start) + F.lit(length - 1)))
    spread = tiles.select(*keys, at.alias("at"), value)
    return spread.groupBy(*keys, "at").agg(F.avg(value).cast("long").alias("merged"))


def tile_origins(width: Column, window: int, step: int) -> Column:
    """Starts of tiles along one axis; the last is pulled back so that it ends with the axis."""
    last = F.greatest(width - window, F.lit(0))
    regular = F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long"))
    return F.array_distinct(F.array_append(regular, last.cast("long")))
