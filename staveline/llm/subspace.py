"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= ``cosine`` are at most sqrt(2 - 2 * cosine) apart.
After one random rotation (fixed seed) they are split into ``blocks`` blocks of
dimensions; if every block's squared distance were above its share of the
squared budget (in proportion to its dimensions), the whole would be above the
budget. So each linked pair is close in one block at least:

1. Vectors of one label that are equal are one class; its smallest id goes on.
2. In each block a vector lives in one cell of a grid over the block's first
   coordinates, twice the block's radius wide, and visits each cell that its
   range box touches. Cells meet by key; visitors and residents of a cell are
   compared by block distance, in numpy blocks.
3. The union of candidate pairs over blocks is verified by cosine in double
   precision on the original vectors.

A cell with more than ``CELL`` residents is cut into pieces, and residents and
visitors are dealt to every pair of pieces, so that no task holds a whole hot
cell. The grid has more dimensions the more vectors there are per label; this
changes how many pairs are compared, not which are found.

Vectors that are null, empty or zero, that hold null or non-finite components,
or whose label is null link with nothing; neither do vectors of different
length. Rows with a null id are dropped; rows that repeat an id are one vector,
the first by label and components. An empty table gives an empty result. Equal vectors link with each
other and are counted in ``n_links`` without being paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staveline.operators.components import connected_components
from staveline.sources.scratch import discard, materialize

CELL = 1000
SLACK = 1e-5
POSTS = "rep long, part long, block int, cell long, resident boolean, coords binary"


def rotation(dim: int, seed: int = 9) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def splits(dim: int, blocks: int) -> list[tuple[int, int]]:
    """Block bounds; as many blocks as asked for, at most one for each dimension."""
    cuts = np.linspace(0, dim, min(blocks, dim) + 1).round().astype(int).tolist()
    return list(zip(cuts, cuts[1:], strict=False))


def _post(budget: float, blocks: int, grid: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned: dict[int, np.ndarray] = {}
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                piece = batch.slice(first, 512)
                dims = np.array([len(v) for v in piece.column(2)])
                ids, parts = piece.column(0).to_numpy(), piece.column(1).to_numpy()
                for dim in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == dim)
                    x = np.array([piece.column(2)[k].as_py() for k in at.tolist()], np.float64)
                    scale = np.abs(x).max(1, keepdims=True)
                    x = x / scale
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    if dim not in turned:
                        turned[dim] = rotation(dim)
                    x = x @ turned[dim]
                    for b, (lo, hi) in enumerate(splits(dim, blocks)):
                        radius = math.sqrt(budget * (hi - lo) / dim) + SLACK
                        own = x[:, lo:hi]
                        g = min(grid, hi - lo)
                        home = np.floor(own[:, :g] / (2 * radius)).astype(np.int64)
                        low = np.floor((own[:, :g] - radius) / (2 * radius)).astype(np.int64)
                        high = np.floor((own[:, :g] + radius) / (2 * radius)).astype(np.int64)
                        rows, cells, resident = [np.arange(len(at))], [home], [np.ones(len(at), bool)]
                        for step in np.ndindex(*[3] * g):
                            cell = low + np.array(step)
                            keep = np.flatnonzero((cell <= high).all(1))
                            rows.append(keep)
                            cells.append(cell[keep])
                            resident.append(np.zeros(len(keep), bool))
                        row, cell = np.concatenate(rows), np.concatenate(cells)
                        key = np.full(len(row), dim, np.int64)
                        for j in range(g):
                            key = key * np.int64(1_000_003) + cell[:, j]
                        data = own.astype(np.float32)
                        held = [data[k].tobytes() for k in range(len(at))]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(ids[at][row]), pa.array(parts[at][row]), pa.array(np.full(len(row), b, np.int32)),
                                pa.array(key), pa.array(np.concatenate(resident)), pa.array([held[k] for k in row.tolist()], pa.binary()),
                            ],
                            ["rep", "part", "block", "cell", "resident", "coords"],
                        )

    return run


def _meet(budget: float, blocks: int):
    def run(group: pa.Table) -> pa.Table:
        resident = group.column("resident").to_numpy()
        reps, out = group.column("rep").to_numpy(), []
        coords = group.column("coords").to_pylist()
        sizes = np.array([len(c) for c in coords]) // 4
        for size in np.unique(sizes).tolist():
            mine = sizes == size
            x_at, y_at = np.flatnonzero(mine & ~resident), np.flatnonzero(mine & resident)
            if not len(x_at) or not len(y_at):
                continue
            x = np.frombuffer(b"".join(coords[k] for k in x_at.tolist()), np.float32).reshape(-1, size).astype(np.float64)
            y = np.frombuffer(b"".join(coords[k] for k in y_at.tolist()), np.float32).reshape(-1, size).astype(np.float64)
            # The block's share of the budget for the shortest vectors that such a block can belong to.
            limit = (math.sqrt(budget * share(size, blocks)) + SLACK) ** 2 + 1e-6
            y_sq = (y * y).sum(1)
            for k in range(0, len(x), 512):
                part = x[k : k + 512]
                near = (part * part).sum(1)[:, None] + y_sq[None, :] - 2 * (part @ y.T) <= limit
                i, j = np.nonzero(near)
                a, b = reps[x_at[k + i]], reps[y_at[j]]
                keep = a < b
                out.append((a[keep], b[keep]))
        a = np.concatenate([p[0] for p in out]) if out else np.zeros(0, np.int64)
        b = np.concatenate([p[1] for p in out]) if out else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def share(size: int, blocks: int) -> float:
    """The largest share of the dimensions that a block of ``size`` of them can be: of the shortest vector that has one."""
    return size / next(d for d in range(size, size * blocks + blocks + 1) if any(hi - lo == size for lo, hi in splits(d, blocks)))


def _verify(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for first in range(0, batch.num_rows, 2048):
                part = batch.slice(first, 2048)
                x, y = (np.array(part.column(k).to_pylist(), object) for k in (2, 3))
                if x.ndim == 1 or y.ndim == 1:
                    for k, (u, v) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
                        keep[first + k] = len(u) == len(v) and _cosine(np.array([u], float), np.array([v], float))[0] >= cosine
                else:
                    keep[first : first + part.num_rows] = _cosine(x.astype(float), y.astype(float)) >= cosine
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def near_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.98,
    blocks: int = 8,
) -> DataFrame:
    """``id, n_links, component_id, kept`` for every vector."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")
    ).filter("vec_id is not null")
    if rows.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").take(1):
        rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("one")).select("vec_id", "one.label", "one.v")
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0)
    usable = usable & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = rows.filter("usable")
    # Equal vectors have equal pairs of 64-bit hashes.
    hashed = good.select("vec_id", "label", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v", F.lit(2)).alias("h2"))
    classes = materialize(
        hashed.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes"
    )
    found = classes.agg(F.count("*"), F.approx_count_distinct("label")).first()
    grid = int(min(3, max(1, math.ceil(math.log(max(found[0], 1) / (500 * max(found[1], 1)) + 1e-9, 4)))))
    keyed = good.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v", F.lit(2))}).join(
        classes.select("label", "h1", "h2", "rep"), ["label", "h1", "h2"]
    )
    reps = materialize(keyed.filter("vec_id = rep").select("rep", F.xxhash64("label").alias("part"), "v"), "vectors")
    budget = 2 - 2 * cosine
    posts = materialize(reps.select("rep", "part", "v").mapInArrow(_post(budget, blocks, grid), POSTS), "posts")
    key = ["part", "block", "cell"]
    hot = posts.filter("resident").groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > CELL)
    hot = hot.select(*key, F.ceil(F.col("n") / CELL).alias("pieces"))
    dealt = posts.join(hot, key, "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("pieces")))
    dealt = dealt.select(
        *key, "rep", "resident", "coords",
        F.when(F.col("resident"), F.col("own")).otherwise(F.col("other")).alias("i"),
        F.when(F.col("resident"), F.col("other")).otherwise(F.col("own")).alias("j"),
    )
    pairs = dealt.groupBy(*key, "i", "j").applyInArrow(_meet(budget, blocks), "a long, b long").distinct()
    one = pairs.join(reps.select(F.col("rep").alias("a"), F.col("v").alias("x")), "a")
    both = one.join(reps.select(F.col("rep").alias("b"), F.col("v").alias("y")), "b")
    links = materialize(both.select("a", "b", "x", "y").mapInArrow(_verify(cosine), "a long, b long"), "links")
    discard(posts)
    parts = materialize(connected_components(links), "components")
    sizes = classes.groupBy("rep").agg(F.sum("n").alias("n"))
    ends = links.select(F.col("a").alias("rep"), F.col("b").alias("to")).union(links.select(F.col("b").alias("rep"), F.col("a").alias("to")))
    linked = ends.join(sizes.select(F.col("rep").alias("to"), "n"), "to").groupBy("rep").agg(F.sum("n").alias("far"))
    told = keyed.join(classes.select("label", "h1", "h2", "n"), ["label", "h1", "h2"]).select("vec_id", "rep", "n")
    told = told.join(linked, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    told = told.select(
        "vec_id", (F.coalesce("far", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = told.union(alone)
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
