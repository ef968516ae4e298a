"""Pixel kernels over planes, in numpy behind Arrow batches.

A plane is ``struct<kind: string, width: int, height: int, data: binary>``: row-major bytes, one channel for ``mask``,
``gray`` and ``classes``, three (BGR) for ``color``. Kernels work row by row of a DataFrame, one plane at a time; a row
whose plane is broken gets null, never a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLANE = "struct<kind:string,width:int,height:int,data:binary>"
CHANNELS = {"mask": 1, "gray": 1, "classes": 1, "color": 3}


def is_valid(plane: str) -> Column:
    """Whether the bytes are as many as the plane's kind and sides ask for."""
    p = F.col(plane)
    channels = F.coalesce(*[F.when(p["kind"] == k, F.lit(n)) for k, n in CHANNELS.items()])
    return (p["width"] >= 0) & (p["height"] >= 0) & (F.length(p["data"]) == p["width"] * p["height"] * channels)


def array_of(plane: dict) -> np.ndarray:
    channels = CHANNELS[plane["kind"]]
    shape = (plane["height"], plane["width"]) + ((channels,) if channels > 1 else ())
    out = np.frombuffer(plane["data"], np.uint8).reshape(shape)
    if plane["kind"] == "mask" and out.max(initial=0) > 1:
        raise ValueError("a mask holds 0 and 1 only")
    return out


def plane_of(pixels: np.ndarray, kind: str) -> dict:
    return {"kind": kind, "width": pixels.shape[1], "height": pixels.shape[0], "data": np.ascontiguousarray(pixels, np.uint8).tobytes()}


def apply(df: DataFrame, plane: str, kernel: Callable[[np.ndarray], np.ndarray], kind: str, name: str) -> DataFrame:
    """``df`` with the plane that ``kernel`` makes of each plane; null where it can't be made."""
    at = df.columns.index(plane)
    schema = df.drop(name).withColumn(name, F.lit(None).cast(PLANE)).schema
    kept = [c for c in df.columns if c != name]
    arrow = pa.struct([("kind", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())])

    def one(value: dict | None) -> dict | None:
        try:
            return None if value is None else plane_of(kernel(array_of(value)), kind)
        except (KeyError, TypeError, ValueError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                made = pa.array([one(row.column(at)[0].as_py())], arrow)
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in kept), made], [*kept, name])

    return df.mapInArrow(run, schema)


def gray(color: np.ndarray) -> np.ndarray:
    """Luma of BGR pixels, in 14-bit fixed point."""
    b, g, r = (color[..., k].astype(np.int64) for k in range(3))
    return ((b * 1868 + g * 9617 + r * 4899 + 8192) >> 14).astype(np.uint8)


def _windows(pixels: np.ndarray, width: int, height: int, fill: int) -> np.ndarray:
    left, top = width // 2, height // 2
    padded = np.pad(pixels, ((top, height - 1 - top), (left, width - 1 - left)), constant_values=fill)
    return np.lib.stride_tricks.sliding_window_view(padded, (height, width))


def dilate(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """The largest pixel under a box centred on each."""
    return _windows(_windows(pixels, width, 1, 0).max((2, 3)), 1, height, 0).max((2, 3))


def erode(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """The smallest pixel under a box centred on each."""
    return _windows(_windows(pixels, width, 1, 255).min((2, 3)), 1, height, 255).min((2, 3))


def otsu(pixels: np.ndarray) -> int:
    """The threshold that parts the histogram into two classes of the largest distance."""
    counts = np.bincount(pixels.ravel(), minlength=256).astype(float)
    low = np.cumsum(counts)
    mass = np.cumsum(counts * np.arange(256))
    high = low[-1] - low
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = low * high * (mass / low - (mass[-1] - mass) / high) ** 2
    return int(np.nanargmax(np.nan_to_num(apart, nan=-1.0)))


def ink(pixels: np.ndarray) -> np.ndarray:
    """Dark pixels as 1."""
    return (pixels <= otsu(pixels)).astype(np.uint8)


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    def axis(old: int, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        low = np.minimum(at.astype(int), old - 1)
        return low, np.minimum(low + 1, old - 1), at - low

    y0, y1, fy = axis(pixels.shape[0], height)
    x0, x1, fx = axis(pixels.shape[1], width)
    p = pixels.astype(float)
    extra = (1,) * (p.ndim - 2)
    fx, fy = fx.reshape(1, -1, *extra), fy.reshape(-1, 1, *extra)
    top = p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx
    low = p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx
    return np.clip(np.rint(top * (1 - fy) + low * fy), 0, 255).astype(np.uint8)


def crop(pixels: np.ndarray, x1: float, y1: float, x2: float, y2: float) -> np.ndarray:
    """A region with corners in any order, half-even rounded and clipped."""
    h, w = pixels.shape[:2]
    xs, ys = sorted((x1, x2)), sorted((y1, y2))
    a, b = (int(np.clip(np.rint(v), 0, w)) for v in xs)
    c, d = (int(np.clip(np.rint(v), 0, h)) for v in ys)
    return pixels[c:d, a:b]


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels (0 is background) and ``x, y, w, h, area`` of the 8-connected components, in reading order of their first pixel."""
    h, w = mask.shape
    runs = []
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask != 0
    d = np.diff(padded, axis=1)
    starts, ends = np.argwhere(d == 1), np.argwhere(d == -1)
    parent: list[int] = []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    above: list[int] = []
    row = -1
    mine: list[int] = []
    for k, ((y, a), (_, b)) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if y != row:
            above, mine, row = (mine if y == row + 1 else []), [], y
        parent.append(k)
        for j in above:
            if runs[j][1] <= b and runs[j][2] >= a:
                x, z = sorted((root(j), root(k)))
                parent[z] = x
        mine.append(k)
        runs.append((y, a, b))
    labels = np.zeros((h, w), np.int32)
    numbers: dict[int, int] = {}
    boxes: list[list[int]] = []
    for k, (y, a, b) in enumerate(runs):
        n = numbers.setdefault(root(k), len(numbers) + 1)
        labels[y, a:b] = n
        if n > len(boxes):
            boxes.append([a, y, b, y + 1, 0])
        box = boxes[n - 1]
        box[:] = [min(box[0], a), min(box[1], y), max(box[2], b), max(box[3], y + 1), box[4] + b - a]
    out = np.array([[x1, y1, x2 - x1, y2 - y1, n] for x1, y1, x2, y2, n in boxes], np.int64).reshape(-1, 5)
    return labels, out


def boxes(df: DataFrame, plane: str, id_col: str) -> DataFrame:
    """``id, box, x, y, w, h, area``: the components of each mask."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                plane_ = value.as_py()
                found = components(array_of(plane_))[1] if plane_ is not None else np.zeros((0, 5), np.int64)
                cols = [pa.array([name] * len(found), batch.schema.field(0).type), pa.array(np.arange(len(found)))]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(found[:, k]) for k in range(5))], [id_col, "box", "x", "y", "w", "h", "area"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, plane).mapInArrow(run, f"{id_col} {kind}, box long, x long, y long, w long, h long, area long")


def peaks(values: np.ndarray, height: float, prominence: float, distance: int) -> np.ndarray:
    """Local maxima (plateau middles) filtered by height, then prominence, then distance (higher first)."""
    v = np.asarray(values, float)
    found, k = [], 1
    while k < len(v) - 1:
        if v[k - 1] < v[k]:
            end = k
            while end < len(v) - 1 and v[end + 1] == v[k]:
                end += 1
            if end < len(v) - 1 and v[end + 1] < v[k]:
                found.append((k + end) // 2)
            k = end
        k += 1
    at = np.array([p for p in found if v[p] >= height], int)

    def rise(p: int) -> float:
        left = v[: p + 1][::-1]
        higher = np.flatnonzero(left > v[p])
        low_l = left[: higher[0] if len(higher) else None].min()
        right = v[p:]
        higher = np.flatnonzero(right > v[p])
        return v[p] - max(low_l, right[: higher[0] if len(higher) else None].min())

    at = np.array([p for p in at if rise(p) >= prominence], int)
    keep = np.ones(len(at), bool)
    for k in np.argsort(-v[at], kind="stable"):
        if keep[k]:
            near = np.abs(at - at[k]) < distance
            near[k] = False
            keep[near & (v[at] <= v[at[k]])] = False
    return at[keep]


def clahe(pixels: np.ndarray, clip: float = 1.0, grid: int = 8) -> np.ndarray:
    """Contrast equalisation in ``grid`` x ``grid`` tiles with a clipped histogram, bilinear between tiles."""
    h, w = pixels.shape
    th, tw = -(-h // grid), -(-w // grid)
    padded = np.pad(pixels, ((0, th * grid - h), (0, tw * grid - w)), mode="reflect" if min(h, w) > 1 else "edge")
    limit = max(int(clip * th * tw / 256), 1)
    maps = np.zeros((grid, grid, 256))
    for i in range(grid):
        for j in range(grid):
            counts = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(counts - limit, 0).sum())
            counts = np.minimum(counts, limit) + over // 256
            counts[: over % 256] += 1
            maps[i, j] = np.clip(np.rint(np.cumsum(counts) * 255.0 / (th * tw)), 0, 255)

    def axis(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(n) + 0.5) / size - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, grid - 1), np.clip(low + 1, 0, grid - 1), at - low

    y0, y1, fy = axis(h, th)
    x0, x1, fx = axis(w, tw)
    v, fy, fx = pixels.astype(int), fy[:, None], fx[None, :]
    pick = lambda y, x: maps[y[:, None], x[None, :], v]
    out = (pick(y0, x0) * (1 - fx) + pick(y0, x1) * fx) * (1 - fy) + (pick(y1, x0) * (1 - fx) + pick(y1, x1) * fx) * fy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def paper_rect(pixels: np.ndarray, below_mode: int = 30, least: float = 0.25) -> tuple[int, int, int, int] | None:
    """``x, y, w, h`` of the largest bright area, if it is a part of the page only and at least ``least`` of it."""
    g = gray(pixels) if pixels.ndim == 3 else pixels
    level = int(np.argmax(np.bincount(g.ravel(), minlength=256))) - below_mode
    bright = erode(dilate((g > level).astype(np.uint8), 5, 5), 5, 5)
    _, found = components(bright)
    if not len(found):
        return None
    x, y, w, h, _ = found[np.argmax(found[:, 4])].tolist()
    share = w * h / g.size
    return (x, y, w, h) if least <= share < 1 else None


def autocrop(pixels: np.ndarray) -> np.ndarray:
    """The sheet of paper cut out of a photo, or the page as it is."""
    found = paper_rect(pixels)
    if found is None:
        return pixels
    x, y, w, h = found
    return pixels[y : y + h, x : x + w]


def bicubic(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Separable bicubic resampling (a = -0.5) whose support grows when shrinking; weights sum to one."""
    def weights(old: int, new: int) -> np.ndarray:
        scale = old / new
        wide = max(scale, 1.0)
        out = np.zeros((new, old))
        for k in range(new):
            center = (k + 0.5) * scale
            lo, hi = max(int(center - 2 * wide + 0.5), 0), min(int(center + 2 * wide + 0.5), old)
            t = np.abs((np.arange(lo, hi) - center + 0.5) / wide)
            near = (1.5 * t - 2.5) * t * t + 1
            far = -0.5 * (((t - 5) * t + 8) * t - 4)
            v = np.where(t < 1, near, np.where(t < 2, far, 0.0))
            out[k, lo:hi] = v / v.sum()
        return out

    p = pixels.astype(float)
    p = np.clip(np.rint(np.tensordot(weights(p.shape[1], width), p, (1, 1)).swapaxes(0, 1)), 0, 255)
    return np.clip(np.rint(np.tensordot(weights(p.shape[0], height), p, (1, 0))), 0, 255).astype(np.uint8)


def tile_starts(length: int, window: int, step: int) -> list[int]:
    """Tile starts along one axis; the last is pulled back to end with it."""
    last = max(length - window, 0)
    out = list(range(0, last + 1, step))
    return out if out[-1] == last else [*out, last]


def cut_tiles(pixels: np.ndarray, window: int, step: int, fill: int = 255) -> list[tuple[int, int, np.ndarray]]:
    """``x, y, tile`` in row-major order; what lies off the page is ``fill``."""
    h, w = pixels.shape
    out = []
    for y in tile_starts(h, window, step):
        for x in tile_starts(w, window, step):
            tile = np.full((window, window), fill, np.uint8)
            part = pixels[y : y + window, x : x + window]
            tile[: part.shape[0], : part.shape[1]] = part
            out.append((x, y, tile))
    return out


def merge_tiles(tiles: list[tuple[int, int, np.ndarray]], width: int, height: int) -> np.ndarray:
    """Class maps laid back on the page: where tiles overlap, the truncated mean of their class numbers."""
    total, count = np.zeros((height, width), np.int64), np.zeros((height, width), np.int64)
    for x, y, tile in tiles:
        part = tile[: height - y, : width - x]
        total[y : y + part.shape[0], x : x + part.shape[1]] += part
        count[y : y + part.shape[0], x : x + part.shape[1]] += 1
    return (total // np.maximum(count, 1)).astype(np.uint8)


#: The page's share that a noise tile's side takes, and the noise that a tile may have.
NOISE_DIVISIONS, NOISE_LIMIT = 20, 50
_SECOND = np.array([1.0, -2.0, 1.0])


def noise_of(tile: np.ndarray) -> float:
    """Mean absolute response of the second difference along both axes; edges are mirrored without being repeated."""
    out = tile.astype(float)
    for axis in (0, 1):
        mirrored = np.pad(out, [(1, 1) if k == axis else (0, 0) for k in (0, 1)], "reflect" if out.shape[axis] > 1 else "edge")
        out = np.apply_along_axis(np.convolve, axis, mirrored, _SECOND, "valid")
    return float(np.abs(out).mean())


def noise(df: DataFrame, plane: str, name: str = "noise") -> DataFrame:
    """``df`` with the noise of each plane (``struct<width, height, v: array>``, row by row)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if p is None else noise_of(np.array(p["v"], float).reshape(p["height"], p["width"])) for p in batch.column(plane).to_pylist()]
            yield batch.append_column(name, pa.array(found, pa.float64()))

    return df.mapInArrow(run, df.withColumn(name, F.lit(0.0)).schema)


def noise_grid(gray: np.ndarray, divisions: int = NOISE_DIVISIONS) -> np.ndarray:
    """The truncated noise (modulo 256) of each tile of a page; tiles at the right and lower edge may be smaller."""
    h, w = gray.shape
    high, wide = h // divisions, w // divisions
    if not high or not wide:
        raise ValueError(f"a {w}x{h} page is too small for {divisions} tiles a side")
    return np.array([[int(noise_of(gray[y : y + high, x : x + wide])) for x in range(0, w, wide)] for y in range(0, h, high)]).astype(np.uint8)


def without_noise(mask: np.ndarray, limit: int = NOISE_LIMIT, divisions: int = NOISE_DIVISIONS) -> tuple[str, np.ndarray]:
    """``status`` and what to keep: tiles noisier than ``limit`` next to (left, right, above, below) another such tile go.

    No such tile leaves the page ``clean``; more than half of them leave it ``skipped``; else they are ``masked`` out.
    """
    h, w = mask.shape
    high = np.pad(noise_grid(np.where(mask != 0, 255, 0), divisions) > limit, 1)
    noisy = high[1:-1, 1:-1] & (high[:-2, 1:-1] | high[2:, 1:-1] | high[1:-1, :-2] | high[1:-1, 2:])
    keep = np.ones((h, w), bool)
    if not noisy.any():
        return "clean", keep
    if noisy.mean() > 0.5:
        return "skipped", keep
    cover = np.kron(noisy, np.ones((h // divisions, w // divisions), bool))[:h, :w]
    return "masked", ~cover


def argmax_classes(planes: np.ndarray) -> np.ndarray:
    """The class of the highest score at each pixel (class first), the lowest class of equals."""
    return planes.argmax(0).astype(np.uint8)
