"""Page kernels and meshes, against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from staveline.functions import half
from staveline.operators import images, mesh


def test_tiles_go_back_to_where_they_came_from():
    r = np.random.default_rng(1)
    for h, w in ((10, 10), (25, 31), (7, 40)):
        page = r.integers(0, 5, (h, w), dtype=np.uint8)
        tiles = images.cut_tiles(page, 10, 10)
        assert (images.merge_tiles(tiles, w, h) == page).all()
    both = images.merge_tiles([(0, 0, np.full((4, 4), 3, np.uint8)), (2, 0, np.full((4, 4), 0, np.uint8))], 6, 4)
    assert both[0].tolist() == [3, 3, 1, 1, 0, 0]  # class numbers are averaged and truncated
    assert images.tile_starts(700, 320, 320) == [0, 320, 380] and images.tile_starts(9, 320, 320) == [0]


def test_noise_is_the_mean_response_of_the_kernel():
    r = np.random.default_rng(4)
    kernel = np.outer([1, -2, 1], [1, -2, 1])
    for shape in ((1, 1), (1, 5), (4, 1), (5, 7)):
        tile = r.integers(0, 256, shape)
        mirror = lambda k, n: 0 if n == 1 else -k if k < 0 else 2 * n - 2 - k if k >= n else k
        total = 0
        for y in range(shape[0]):
            for x in range(shape[1]):
                total += abs(sum(kernel[a + 1, b + 1] * tile[mirror(y + a, shape[0]), mirror(x + b, shape[1])] for a in (-1, 0, 1) for b in (-1, 0, 1)))
        assert images.noise_of(tile) == pytest.approx(total / tile.size)


def test_noise_needs_a_noisy_neighbour():
    board = np.indices((10, 10)).sum(0) % 2
    mask = np.zeros((200, 205), np.uint8)
    mask[:10, :20] = np.tile(board, (1, 2))
    mask[100:110, 100:110] = board
    grid = images.noise_grid(mask * 255)
    assert grid.shape == (20, 21) and grid[0, 0] > 50 and grid[10, 10] > 50 and grid[5, 5] == 0
    status, keep = images.without_noise(mask)
    assert status == "masked" and not keep[:10, :20].any() and keep[100:110, 100:110].all() and keep.sum() == keep.size - 200
    assert images.without_noise(np.zeros((40, 40), np.uint8))[0] == "clean"
    assert images.without_noise((np.indices((40, 40)).sum(0) % 2).astype(np.uint8))[0] in ("skipped", "clean")
    with pytest.raises(ValueError, match="too small"):
        images.noise_grid(np.zeros((19, 40), np.uint8))


def test_paper_is_cut_out():
    photo = np.full((60, 80, 3), 40, np.uint8)
    photo[5:55, 8:74] = 250
    assert images.paper_rect(photo) == (8, 5, 66, 50) and images.autocrop(photo).shape == (50, 66, 3)
    page = np.full((30, 30, 3), 250, np.uint8)
    assert images.autocrop(page).shape == page.shape


def test_resampling_and_contrast():
    r = np.random.default_rng(2)
    p = r.integers(0, 256, (16, 20), dtype=np.uint8)
    assert (images.bicubic(p, 20, 16) == p).all()
    flat = np.full((16, 20), 77, np.uint8)
    assert (images.bicubic(flat, 7, 33) == 77).all() and images.bicubic(np.stack([p] * 3, 2), 5, 4).shape == (4, 5, 3)
    ramp = np.tile(np.arange(100, 140, dtype=np.uint8), (40, 1))
    wide = images.clahe(ramp, clip=40.0)
    assert wide.shape == ramp.shape and int(wide.max()) - int(wide.min()) > 40
    assert images.argmax_classes(np.array([[[1.0, 0]], [[1.0, 2]]])).tolist() == [[0, 1]]


def test_delaunay_circles_are_empty():
    r = np.random.default_rng(3)
    points = r.random((25, 2)) * 100
    triangles = mesh.delaunay(points)
    assert set(triangles.ravel()) == set(range(25))
    for t in triangles:
        a, b, c = points[t]
        m = 2 * np.array([b - a, c - a])
        center = np.linalg.solve(m, [b @ b - a @ a, c @ c - a @ a])
        radius = np.linalg.norm(a - center)
        assert (np.linalg.norm(points - center, axis=1) >= radius - 1e-6).all()
    with pytest.raises(ValueError, match="three points"):
        mesh.delaunay(points[:2])


def test_piecewise_affine_maps():
    source = np.array([[0, 0], [10, 0], [0, 10], [10, 10]], float)
    target = source * 2 + [1, 3]
    triangles = mesh.delaunay(source)
    assert mesh.mapped(source, target, triangles, [2.5, 7.0]) == pytest.approx([6, 17])
    assert mesh.mapped(source, target, triangles, [50, 50]).tolist() == [50, 50]
    p = np.arange(121, dtype=np.uint8).reshape(11, 11)
    assert (mesh.warp(p, source, source, triangles) == p).all()
    shifted = mesh.warp(p, source, source + [3, 0], triangles)
    assert (shifted[:, 3:] == p[:, :8]).all() and (shifted[:, :3] == 255).all()


def test_half_precision(spark):
    values = [0.0, 1.0, -2.5, 0.1, 65504.0, 1e6, 6e-8, None]
    df = spark.createDataFrame([(v,) for v in values], "x float").select("x", half.to_half(F.col("x")).alias("h"))
    rows = df.select("x", "h", half.from_half(F.col("h")).alias("y")).collect()
    for v, r in zip(values, rows, strict=True):
        if v is None:
            assert r.h is None and r.y is None
        else:
            with np.errstate(over="ignore"):
                want = np.float32(v).astype(np.float16)
            assert r.h == int(want.view(np.uint16)) and np.float32(r.y) == np.float32(want)
