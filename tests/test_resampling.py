"""Resampling against dense linear algebra, correlated landmarks, spread, edge masks and map logs against loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from osteon.operators import blocks, evaluate, graph, intensity, stencil
from test_blocks import as_arrays, volumes


def spline_matrix(n, own, target):
    """Values at the new centres of the spline through unit impulses, by solving for its coefficients."""
    m = max(1, round(n * own / target))
    at = ((n * own - m * target) / 2 + (np.arange(m) + 0.5) * target) / own - 0.5
    fold = lambda i: (i % (2 * n)) if (i % (2 * n)) < n else 2 * n - 1 - i % (2 * n)
    basis = lambda d: (4 - 6 * d * d + 3 * d**3) / 6 if d < 1 else max(2 - d, 0) ** 3 / 6
    a, e = np.zeros((n, n)), np.zeros((m, n))
    for i in range(n):
        for k in range(-3, 4):
            a[i, fold(i + k)] += basis(abs(k))
    for j, p in enumerate(at):
        for i in range(int(np.floor(p)) - 3, int(np.floor(p)) + 5):
            e[j, fold(i)] += basis(abs(p - i))
    return e @ np.linalg.inv(a)


def area_matrix(n, own, target):
    m = max(1, round(n * own / target))
    start, out = (n * own - m * target) / 2, np.zeros((m, n))
    for j in range(m):
        lo, hi = max(start + j * target, 0), min(start + (j + 1) * target, n * own)
        for i in range(n):
            out[j, i] = max(0, min(hi, (i + 1) * own) - max(lo, i * own))
    return out / out.sum(1, keepdims=True)


def nearest_matrix(n, own, target):
    m = max(1, round(n * own / target))
    at = ((n * own - m * target) / 2 + (np.arange(m) + 0.5) * target) / own - 0.5
    return np.eye(n)[np.clip(np.floor(at + 0.5).astype(int), 0, n - 1)]


def plain(a, spacing, target, binary=False, whole=True):
    t = min(spacing) if target == "finest" else max(spacing)
    out = a
    for axis, s in enumerate(spacing):
        if s != t:
            make = (nearest_matrix if binary else spline_matrix) if s > t else area_matrix
            out = np.moveaxis(np.tensordot(make(a.shape[axis], s, t), out, (1, axis)), 0, axis)
    if binary:
        return np.where(out >= (a.min() + a.max()) / 2 - 1e-12, a.max(), a.min())
    out = np.clip(out, a.min(), a.max())
    return np.rint(out) if whole else out


SPACING = {1: (2.0, 1.0, 1.0), 2: (0.5, 0.8, 0.65), 3: (1.0, 1.0, 1.0), 4: (3.0, 1.0, 0.4), 5: (1.0, 0.3, 1.0)}


@pytest.mark.parametrize("target", ["finest", "coarsest"])
@pytest.mark.parametrize("binary", [False, True])
def test_mixed_shapes_in_one_call(spark, target, binary):
    rng = np.random.default_rng(9)
    shapes = {1: (5, 6, 7), 2: (9, 4, 3), 3: (4, 4, 4), 4: (1, 5, 8), 5: (2, 13, 3)}
    arrays = {s: (rng.integers(0, 2, n) * 3 if binary else rng.random(n) * 200) for s, n in shapes.items()}
    spacings = spark.createDataFrame([(s, *p, binary) for s, p in SPACING.items()], "scan_id long, sz double, sy double, sx double, binary boolean")
    want = {s: plain(a, SPACING[s], target, binary, False) for s, a in arrays.items()}
    df = stencil.resample_isotropic(volumes(spark, arrays), spacings, target)
    got = as_arrays(df, {s: a.shape for s, a in want.items()})
    for s in arrays:
        assert np.allclose(got[s], want[s], atol=1e-9), s
    assert df.count() == sum(a.size for a in want.values())


def test_whole_numbers_stay_whole(spark):
    a = {1: np.arange(24).reshape(4, 3, 2).astype(float)}
    df = stencil.resample_isotropic(volumes(spark, a, "int"), spark.createDataFrame([(1, 1.0, 2.0, 2.0)], "scan_id long, sz double, sy double, sx double"), "coarsest")
    assert df.schema["v"].dataType.simpleString() == "int"
    assert np.array_equal(as_arrays(df, {1: (2, 3, 2)})[1], plain(a[1], (1.0, 2.0, 2.0), "coarsest"))


@pytest.mark.parametrize("size", [2, 256])
def test_decorrelation_is_the_sequential_one(spark, size):
    rng = np.random.default_rng(10)
    n, subjects = 60, 7
    at, base = rng.random((n, 3)) * 4, rng.normal(size=(subjects, 6, 3))
    fields = np.stack([base[:, i % 6] + 0.3 * rng.normal(size=(subjects, 3)) for i in range(n)], axis=1)
    fields[:, 5] = 0.0
    variance = np.round(fields.var(axis=0).sum(1), 2)
    left, want = set(range(n)), []
    while left:
        i = min(left, key=lambda k: (-variance[k], k))
        want.append(i)
        near = [k for k in left if np.linalg.norm(at[k] - at[i]) <= 1.5 and k != i]
        left -= {i, *[k for k in near if fields[:, k].any() and fields[:, i].any() and np.corrcoef(fields[:, i].ravel(), fields[:, k].ravel())[0, 1] >= 0.7]}
    marks = spark.createDataFrame([(i, *map(float, at[i]), float(variance[i])) for i in range(n)], "id long, x double, y double, z double, variance double")
    rows = spark.createDataFrame([(s, i, *map(float, fields[s, i])) for s in range(subjects) for i in range(n)], "scan_id long, id long, ux double, uy double, uz double")
    assert {r.id for r in graph.decorrelate_landmarks(marks, rows, 1.5, 0.7, size).collect()} == set(want) and len(want) < n


def test_spread_is_the_loop(spark):
    rng = np.random.default_rng(11)
    scans = {1: rng.random((40, 3)) * 6, 2: rng.random((7, 3)), 3: np.repeat(rng.random((2, 3)), 8, axis=0)}
    rows = [(s, i, *map(float, p)) for s, a in scans.items() for i, p in enumerate(a)]
    got = {}
    for r in graph.spread_select(spark.createDataFrame(rows, "scan_id long, id long, x double, y double, z double"), 0.7, 5).orderBy("order").collect():
        got.setdefault(r.scan_id, []).append(r.id)
    for s, a in scans.items():
        left, chosen = set(range(len(a))), []
        while left:
            far = lambda k: min(((a[k] - a[c]) ** 2).sum() for c in chosen) if chosen else -((a[k] - a.mean(0)) ** 2).sum()
            i = min(left, key=lambda k: (-far(k), k))
            near = sorted((((a[k] - a[i]) ** 2).sum(), k) for k in range(len(a)))
            left -= {i, *[k for d, k in near if d <= (5 * np.log(0.7)) ** 2][:5]}
            chosen.append(i)
        assert got[s] == chosen


def test_edge_masks(spark):
    a = np.zeros((9, 9, 30))
    a[2, 2, 2:9:2], a[6, 6, 20:24], a[6, 6, 14] = 100, 60, 60
    a[2, 2, 4], a[6, 6, 21] = 200, 190
    df = volumes(spark, {1: a, 2: np.full((3, 3, 3), 5.0)})
    hot = np.zeros(a.shape, bool)
    hot[2, 2, 4] = hot[6, 6, 20:24] = True
    far = blocks.squared_distances
    closed = far(~(far(hot) <= 1)) > 1
    got = lambda mode, least: {(r.scan_id, r.z, r.y, r.x) for r in graph.edge_mask(df, 0.2, 0.9, 1, mode, least).collect()}
    every = {(1, *map(int, c)) for c in np.argwhere(closed)}
    assert got("off", 1) == every and len(every) >= 5
    assert got("largest", 1) == {c for c in every if c[1] == 6} and got("above_min", 2) == {c for c in every if c[1] == 6} and got("largest", 99) == set()


def test_erosion_and_interest_points(spark):
    rng = np.random.default_rng(12)
    a = rng.random((10, 10, 10))
    inside = volumes(spark, {1: np.ones((6, 6, 6))}).drop("v")
    assert {(r.z, r.y, r.x) for r in stencil.erode(inside, 2).collect()} == {(i, j, k) for i in (2, 3) for j in (2, 3) for k in (2, 3)}
    points = lambda least: {(r.z, r.y, r.x) for r in stencil.interest_points(volumes(spark, {1: a}), inside, 1, 50, 2, erosion=2, least=least).collect()}
    assert points(8) and all(min(p) >= 2 and max(p) <= 3 for p in points(8)) and any(min(p) < 2 for p in points(64))


def test_map_changes(spark):
    maps = spark.createDataFrame([(1, 1, "SubA_lossy.nii.gz", 2.0, 10.0), (2, 1, "SubB_lossy.nii.gz", 1.0, 0.0), (2, 2, "SubB_edit_0_crop_lossy.nii.gz", 4.0, 1.0), (3, 1, "a", 1.0, 5.0)], "scan_id long, seq int, filename string, mapping_scale double, mapping_shift double")
    log = [
        (1, 1, "record", "SubA_edit_0_bg_lossy.nii.gz", None, 1.0, -5.0), (1, 2, "record", "SubA_edit_1_x_lossy.nii.gz", None, 4.0, 1.0), (1, 3, "record", "SubA_edit_2_y_lossy.nii.gz", None, 0.0, 9.0),
        (2, 1, "rename", "SubB", "SubC", None, None), (2, 2, "drop", "_crop_", None, None, None), (2, 3, "record", "SubC_lossy.nii.gz", "SubC_lossy.nii.gz", 2.0, 0.0), (2, 4, "remove", "none", None, None, None), (2, 5, "drop", "", None, None, None),
        (3, 1, "remove", "a", None, None, None), (3, 2, "record", "b", None, 2.0, 2.0), (4, 1, "record", "c", None, 2.0, 2.0),
    ]
    changes = spark.createDataFrame(log, "scan_id long, seq int, op string, filename string, other string, s double, o double")
    got = [tuple(r) for r in intensity.apply_map_changes(maps, changes).orderBy("scan_id", "seq").collect()]
    assert got == [
        (1, 1, "SubA_lossy.nii.gz", 2.0, 10.0), (1, 2, "SubA_edit_0_bg_lossy.nii.gz", 2.0, 20.0), (1, 3, "SubA_edit_1_x_lossy.nii.gz", 0.5, 19.5), (1, 4, "SubA_edit_2_y_lossy.nii.gz", 0.5, 19.5),
        (2, 1, "SubC_lossy.nii.gz", 0.5, 0.0),
    ]


def test_init_slices(spark):
    cells = spark.createDataFrame([(1, z, 0, 0, 1) for z in (2, 3, 5, 6, 8, 9, 11)] + [(2, 4, 0, 0, 1)], "scan_id long, z int, y int, x int, label int")
    slab = {r.slice for r in evaluate.middle_slab(cells, 1).where("scan_id = 1").collect()}
    assert {r.scan_id: r.slice for r in evaluate.init_slice(cells, 1).collect()} == {1: sorted(slab)[len(slab) // 2], 2: 4}
    drawn = evaluate.init_slice(cells, 1, seed=3)
    assert {r.slice for r in drawn.where(F.col("scan_id") == 1).collect()} <= slab and sorted(drawn.collect()) == sorted(evaluate.init_slice(cells, 1, seed=3).collect())
