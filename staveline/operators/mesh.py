"""Triangle meshes: Delaunay triangulation and piecewise affine maps, in numpy for one page's points."""

from __future__ import annotations

import numpy as np


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (indexes, counter-clockwise) of the Delaunay triangulation, by incremental insertion; needs three points."""
    p = np.asarray(points, float)
    if len(p) < 3:
        raise ValueError("a triangulation needs three points")
    span = max(np.ptp(p[:, 0]), np.ptp(p[:, 1]), 1.0)
    mid = (p.max(0) + p.min(0)) / 2
    far = 1000 * span
    q = np.vstack([p, mid + [-far, -far], mid + [far, -far], mid + [0, far]])
    n = len(p)
    triangles = {(n, n + 1, n + 2)}

    def inside(t: tuple[int, int, int], k: int) -> bool:
        a, b, c = (q[i] - q[k] for i in t)
        m = np.array([[*a, a @ a], [*b, b @ b], [*c, c @ c]])
        return np.linalg.det(m) > 1e-9 * span**4

    for k in range(n):
        bad = [t for t in triangles if inside(t, k)]
        edges: dict[tuple[int, int], int] = {}
        for t in bad:
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                if (e[1], e[0]) in edges:
                    del edges[e[1], e[0]]
                else:
                    edges[e] = 1
        triangles.difference_update(bad)
        triangles.update((a, b, k) for a, b in edges)
    return np.array(sorted(t for t in triangles if max(t) < n), int).reshape(-1, 3)


def barycentric(points: np.ndarray, t: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Weights of a triangle's corners at a point."""
    a, b, c = np.asarray(points, float)[t]
    m = np.stack([b - a, c - a], 1)
    if abs(np.linalg.det(m)) < 1e-12:
        return np.full(3, -1.0)
    u, v = np.linalg.solve(m, np.asarray(at, float) - a)
    return np.array([1 - u - v, u, v])


def first_triangle(points: np.ndarray, triangles: np.ndarray, at: np.ndarray) -> int:
    """The first triangle that holds a point, edges included; -1 if none does."""
    for k, t in enumerate(triangles):
        if (barycentric(points, t, at) >= -1e-9).all():
            return k
    return -1


def mapped(source: np.ndarray, target: np.ndarray, triangles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A point under the affine map of its triangle; itself outside the mesh."""
    k = first_triangle(source, triangles, at)
    return np.asarray(at, float) if k < 0 else barycentric(source, triangles[k], at) @ np.asarray(target, float)[triangles[k]]


def warp(pixels: np.ndarray, source: np.ndarray, target: np.ndarray, triangles: np.ndarray, fill: int = 255) -> np.ndarray:
    """The image whose pixels at ``target`` points are the old ones at ``source`` points; later triangles win; bilinear."""
    h, w = pixels.shape
    out = np.full((h, w), fill, np.uint8)
    for t in triangles:
        corners = np.asarray(target, float)[t]
        lo, hi = np.floor(corners.min(0)).astype(int), np.ceil(corners.max(0)).astype(int)
        x, y = np.meshgrid(np.arange(max(lo[0], 0), min(hi[0] + 1, w)), np.arange(max(lo[1], 0), min(hi[1] + 1, h)))
        m = np.stack([corners[1] - corners[0], corners[2] - corners[0]], 1)
        if abs(np.linalg.det(m)) < 1e-12 or not x.size:
            continue
        uv = np.linalg.solve(m, np.stack([x.ravel(), y.ravel()]) - corners[0][:, None])
        weights = np.stack([1 - uv.sum(0), uv[0], uv[1]])
        inside = (weights >= -1e-9).all(0)
        sx, sy = np.asarray(source, float)[t].T @ weights[:, inside]
        seen = (sx >= -1e-6) & (sx <= w - 1 + 1e-6) & (sy >= -1e-6) & (sy <= h - 1 + 1e-6)
        sx, sy = np.clip(sx[seen], 0, w - 1), np.clip(sy[seen], 0, h - 1)
        x0, y0 = np.minimum(sx.astype(int), max(w - 2, 0)), np.minimum(sy.astype(int), max(h - 2, 0))
        x1, y1, fx, fy = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1), sx - x0, sy - y0
        p = pixels.astype(float)
        value = (p[y0, x0] * (1 - fx) + p[y0, x1] * fx) * (1 - fy) + (p[y1, x0] * (1 - fx) + p[y1, x1] * fx) * fy
        out[y.ravel()[inside][seen], x.ravel()[inside][seen]] = np.clip(np.rint(value), 0, 255)
    return out
