"""Streaming forms of window operators; an extension, the batch operators define the results.

State is one small row for each key; late rows beyond the watermark are dropped
by Spark before they reach it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_counts(events: DataFrame, at: str, size: str, late: str, *keys: str) -> DataFrame:
    """Counts of tumbling windows by key, final once the watermark has passed."""
    windowed = events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), *keys)
    return windowed.agg(F.count("*").alias("n")).select("w.start", "w.end", *keys, "n")


def running_changes(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the last one seen under the key, across micro-batches.

    ``key`` and ``order`` are bigint, ``value`` is a string; rows of one batch are taken in ``order``.
    """
    schema = f"{key} long, {order} long, {value} string"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        seen = state.exists
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = []
        for o, v in zip(rows[order], rows[value], strict=True):
            if not seen or v != last:
                out.append((k[0], o, v))
            seen, last = True, v
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, order, value])

    picked = events.select(F.col(key).cast("long").alias(key), F.col(order).cast("long").alias(order), F.col(value).cast("string").alias(value))
    return picked.groupBy(key).applyInPandasWithState(step, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def gap_islands(events: DataFrame, key: str, at: str, gap: float) -> DataFrame:
    """Rows with the number of their run under the key, across micro-batches that arrive in order of ``at``.

    A gap of ``gap`` or more from the row before opens a new run.
    """
    schema = f"{key} long, {at} double, island long"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, island = state.get if state.exists else (None, 0)
        out = []
        for x in pd.concat(list(frames))[at].sort_values(kind="stable"):
            if last is not None and x - last >= gap:
                island += 1
            last = x
            out.append((k[0], float(x), island))
        state.update((float(last), island))
        yield pd.DataFrame(out, columns=[key, at, "island"])

    picked = events.select(F.col(key).cast("long").alias(key), F.col(at).cast("double").alias(at))
    return picked.groupBy(key).applyInPandasWithState(step, schema, "last double, island long", "append", GroupStateTimeout.NoTimeout)
