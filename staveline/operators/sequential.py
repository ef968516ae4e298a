"""Order-dependent folds over one bounded group (a page, a staff, a measure): grouped Arrow functions.

Each takes the group's rows to one Python worker; the keys must therefore name
groups of bounded size. Input order is an explicit column, never row order.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def fold_groups(df: DataFrame, n_keys: int, order: list[str], fold: Callable[[tuple, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``fold`` of each group of rows with equal first ``n_keys`` columns, in order; groups must be of bounded size.

    One sort by key; successive rows of a key form a group, so that small groups cost little.
    """
    keys = df.columns[:n_keys]
    kind = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) or [[]] * len(kind)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind, strict=True)], schema=kind)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n_keys] != key:
                    if rows:
                        out += fold(key, rows)
                    key, rows = row[:n_keys], []
                    if len(out) >= 2000:
                        yield batch_of(out)
                        out = []
                rows.append(row)
        if rows:
            out += fold(key, rows)
        yield batch_of(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def align(
    left: DataFrame, right: DataFrame, keys: list[str], schema_keys: str, *, left_order: str, right_order: str, left_value: str, right_value: str,
    gap: float = 1.0, unlike: float = 1.0,
) -> DataFrame:
    """Global alignment of two sequences: ``keys, place, left, right, cost`` with nulls for gaps, in order of ``place``.

    A pair costs 0 if the values are equal, else ``unlike``; a skipped element costs ``gap``. Ties prefer the pair,
    then skipping on the left, then on the right (looking back from the end). A group takes a table of the product of
    both lengths, of a byte each.
    """

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        n_keys = len(keys)
        a, b = ([(r[n_keys + 1], r[n_keys + 2]) for r in rows if r[n_keys] == side] for side in (0, 1))
        codes = {v: k for k, v in enumerate(dict.fromkeys(v for _, v in (*a, *b)))}
        y = np.array([codes[v] for _, v in b], np.int64)
        moves, last = move_table(([0.0 if same else unlike for same in y == codes[v]] for _, v in a), len(a), len(b), gap)
        pairs = walk_back(moves)
        return [(*key, k, a[i][0] if i is not None else None, b[j][0] if j is not None else None, last) for k, (i, j) in enumerate(pairs)]

    side = lambda df, k, order, value: df.select(*keys, F.lit(k).alias("__side"), F.col(order).cast("long").alias("__at"), F.col(value).alias("__value"))
    both = side(left, 0, left_order, left_value).unionByName(side(right, 1, right_order, right_value))
    return fold_groups(both, len(keys), ["__side", "__at"], fold, f"{schema_keys}, place long, left long, right long, cost double")


def move_table(costs, n: int, m: int, gap: float) -> tuple[np.ndarray, float]:
    """Moves (0 pair, 1 skip left, 2 skip right) of the cheapest alignment to each cell, and its cost; ``costs`` has a row of pair costs for each left element."""
    moves = np.zeros((n + 1, m + 1), np.int8)
    moves[1:, 0], moves[0, 1:] = 1, 2
    above = (gap * np.arange(m + 1)).tolist()
    for i, row in enumerate(costs, 1):
        here = [gap * i]
        own = moves[i]
        for j, pair in enumerate(row, 1):
            best, move = above[j - 1] + pair, 0
            if above[j] + gap < best:
                best, move = above[j] + gap, 1
            if here[-1] + gap < best:
                best, move = here[-1] + gap, 2
            here.append(best)
            own[j] = move
        above = here
    return moves, float(above[-1])


def walk_back(moves: np.ndarray) -> list[tuple[int | None, int | None]]:
    """The pairs of an alignment in order, None for a skipped side."""
    i, j = moves.shape[0] - 1, moves.shape[1] - 1
    out: list[tuple[int | None, int | None]] = []
    while i or j:
        move = moves[i, j]
        i, j = i - (move != 2), j - (move != 1)
        out.append((i if move != 2 else None, j if move != 1 else None))
    return out[::-1]


def lowest_free_voice(spans: DataFrame, keys: list[str], low: str, high: str, tie: str, name: str = "voice") -> DataFrame:
    """The lowest voice (from 0) whose last span has ended, for spans in order of (low, high, tie).

    A voice is busy while its end lies after the new span's beginning; touching spans share a voice.
    """
    columns = [*keys, *(c for c in spans.columns if c not in keys)]
    at_low, at_high = columns.index(low), columns.index(high)
    schema = ", ".join(f"{c} {spans.schema[c].dataType.simpleString()}" for c in columns) + f", {name} int"

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        busy: list[tuple] = []  # (end, voice)
        free: list[int] = []
        out = []
        for r in rows:
            while busy and busy[0][0] <= r[at_low]:
                heapq.heappush(free, heapq.heappop(busy)[1])
            voice = heapq.heappop(free) if free else len(busy)
            heapq.heappush(busy, (r[at_high], voice))
            out.append((*r, voice))
        return out

    return fold_groups(spans.select(*columns), len(keys), [low, high, tie], fold, schema).select(*spans.columns, name)


def greedy_pairs(pairs: DataFrame, keys: list[str], schema_keys: str, a: str, b: str, score: str) -> DataFrame:
    """Pairs of positive score taken by falling score, earlier first, none of whose ends is taken already."""

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        taken, out = set(), []
        for *_, x, y, s, _ in rows:
            if x not in taken and y not in taken:
                taken |= {x, y}
                out.append((*key, x, y, s))
        return out

    rows = pairs.filter(F.col(score) > 0).select(*keys, F.col(a).cast("long").alias(a), F.col(b).cast("long").alias(b), F.col(score).cast("double").alias(score))
    rows = rows.withColumn("__down", -F.col(score))
    return fold_groups(rows, len(keys), ["__down", a, b], fold, f"{schema_keys}, {a} long, {b} long, {score} double")


def chain_fragments(fragments: DataFrame, key: str, *, reach: float, slope: float) -> DataFrame:
    """Fragments (``key, id, x0, x1, y0, y1``) joined into lines from left to right: ``key, chain, id, place``.

    A fragment extends every chain whose end is at most ``reach`` before it and whose extrapolated height is within
    ``slope`` times the distance of its own; with none it starts a chain. Of equal starts the first given goes first.
    Chains are numbered by the height, then the start, of their first fragment.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["x0", "id"], kind="stable").itertuples(index=False)
        chains: list[list] = []
        for r in rows:
            found = [c for c in chains if 0 <= r.x0 - c[-1].x1 <= reach and abs(r.y0 - c[-1].y1) <= slope * max(r.x0 - c[-1].x1, 1)]
            for c in found:
                c.append(r)
            if not found:
                chains.append([r])
        chains.sort(key=lambda c: (c[0].y0, c[0].x0, c[0].id))
        out = [(getattr(r, key), k, r.id, i) for k, c in enumerate(chains) for i, r in enumerate(c)]
        return pd.DataFrame(out, columns=[key, "chain", "id", "place"])

    return fragments.groupBy(key).applyInPandas(one, f"{key} long, chain long, id long, place long")


def drop_duplicated(groups: DataFrame, key: str, id_col: str, members: str, weight: str) -> DataFrame:
    """Sequential removal of sets that share members with one kept before: ``key, id`` of what stays.

    A set that shares members with two kept ones or more goes; one that shares with exactly one replaces it if its
    weight is strictly larger, else it goes. Sets are taken in order of id; a replacement moves to the end.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        for r in group.sort_values(id_col).itertuples(index=False):
            own = set(getattr(r, members))
            over = [k for k in kept if k[1] & own]
            row = (getattr(r, id_col), own, getattr(r, weight))
            if not over:
                kept.append(row)
            elif len(over) == 1 and row[2] > over[0][2]:
                kept.remove(over[0])
                kept.append(row)
        return pd.DataFrame({key: [group[key].iloc[0]] * len(kept), id_col: [k[0] for k in kept], "place": range(len(kept))})

    return groups.groupBy(key).applyInPandas(one, f"{key} long, {id_col} long, place long")
