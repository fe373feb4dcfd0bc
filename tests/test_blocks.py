"""Halo blocks, distance transforms and what is built on them, against NumPy on whole volumes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from osteon.operators import blocks, stencil

CELL = "scan_id long, z int, y int, x int"


def volumes(spark, arrays, kind="double"):
    rows = [(s, *map(int, at), float(v) if kind == "double" else int(v)) for s, a in arrays.items() for at, v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, f"{CELL}, v {kind}")


def as_arrays(df, shapes, column="v"):
    out = {s: np.full(n, np.nan) for s, n in shapes.items()}
    for r in df.collect():
        out[r.scan_id][r.z, r.y, r.x] = r[column]
    return out


@pytest.fixture(scope="module")
def cohort():
    rng = np.random.default_rng(3)
    return {1: rng.integers(0, 255, (16, 16, 16)).astype(float), 2: rng.integers(0, 255, (40, 3, 9)).astype(float), 3: np.full((1, 1, 1), 7.0)}


def smoothed(a, sigma, mode="symmetric", whole=False):
    w = np.array(stencil.kernel(sigma))
    r = len(w) // 2
    for axis in range(3):
        p = np.pad(a, [(r, r) if k == axis else (0, 0) for k in range(3)], mode=mode)
        a = sum(w[k] * np.take(p, range(k, k + a.shape[axis]), axis) for k in range(2 * r + 1))
        a = np.floor(a + 1e-9) if whole else a
    return a


@pytest.mark.parametrize("options", [{}, {"pad": "edge"}, {"whole": True}])
def test_gaussian(spark, cohort, options):
    got = as_arrays(stencil.gaussian_smooth(volumes(spark, cohort), 1.0, **options), {s: a.shape for s, a in cohort.items()})
    for s, a in cohort.items():
        assert np.allclose(got[s], smoothed(a, 1.0, options.get("pad", "symmetric"), options.get("whole", False)), atol=1e-9)


def test_median(spark, cohort):
    got = as_arrays(stencil.median_filter(volumes(spark, cohort)), {s: a.shape for s, a in cohort.items()})
    for s, a in cohort.items():
        want = [np.median(a[max(z - 1, 0) : z + 2, max(y - 1, 0) : y + 2, max(x - 1, 0) : x + 2]) for z, y, x in np.ndindex(a.shape)]
        assert np.allclose(got[s].ravel(), want)


def test_block_sides_do_not_show(spark, cohort):
    """The same values whatever the blocks are."""
    a = {1: cohort[1]}
    one = as_arrays(blocks.over_blocks(volumes(spark, a), 2, lambda v, i: [blocks.shifted(v[0], (2, -1, 0), 2)], ["v"], pad="symmetric", side=5), {1: (16, 16, 16)})[1]
    p = np.pad(cohort[1], 2, mode="symmetric")
    assert np.array_equal(one, p[4:20, 1:17, 2:18])


def test_envelope():
    rng = np.random.default_rng(4)
    f = np.where(rng.random((50, 23)) < 0.3, rng.integers(0, 200, (50, 23)).astype(float), np.inf)
    f[0] = np.inf
    want = np.min(f[:, None, :] + (np.arange(23)[:, None] - np.arange(23)) ** 2, axis=2)
    assert np.array_equal(blocks.envelope(f), want)


def brute(sites):
    at = np.argwhere(sites)
    cells = np.array(list(np.ndindex(sites.shape)))
    return np.full(sites.shape, np.inf) if not len(at) else np.min(((cells[:, None] - at) ** 2).sum(2), axis=1).reshape(sites.shape)


def test_distance_transform(spark):
    rng = np.random.default_rng(5)
    arrays = {1: rng.random((12, 9, 14)), 2: rng.random((3, 30, 2)), 3: np.zeros((4, 4, 4))}
    df = volumes(spark, arrays).withColumn("site", F.col("v") > 0.97).withColumn("kept", F.col("v") * 2)
    out = blocks.distance_transform(df)
    assert out.columns == ["scan_id", "z", "y", "x", "v", "kept", "site", "d2"]
    got = as_arrays(out, {s: a.shape for s, a in arrays.items()}, "d2")
    for s, a in arrays.items():
        assert np.array_equal(got[s], brute(a > 0.97)) and np.array_equal(blocks.squared_distances(a > 0.97), got[s])
    far = as_arrays(stencil.distance_guard(df, 0.97), {s: a.shape for s, a in arrays.items()}, "distance")
    assert all(np.array_equal(far[s], np.sqrt(got[s])) for s in arrays)


@pytest.mark.parametrize("r", [1, 3])
def test_closing(spark, r):
    rng = np.random.default_rng(6)
    a = rng.random((14, 10, 37)) < 0.03
    cells = spark.createDataFrame([(1, *map(int, c)) for c in np.argwhere(a)], CELL)
    got = lambda df: {(q.z, q.y, q.x) for q in df.collect()}
    far = blocks.squared_distances
    inner = far(~(far(a) <= r * r)) > r * r
    assert got(stencil.close_ball(cells, r, a.shape)) == {tuple(map(int, c)) for c in np.argwhere(inner)}
    sizes = spark.createDataFrame([(1, *a.shape)], "scan_id long, nz int, ny int, nx int")
    assert got(stencil.close_ball(cells, r, sizes)) == got(stencil.close_ball(cells, r, a.shape))
    wide = np.pad(a, 2 * r + 1)
    free = far(~(far(wide) <= r * r)) > r * r
    assert got(stencil.close_ball(cells, r)) == {tuple(int(v) - 2 * r - 1 for v in c) for c in np.argwhere(free)}


def test_a_large_closing_has_no_offset_lists(spark):
    """Radius 10: the plan's size doesn't depend on the radius."""
    a = np.zeros((30, 30, 90), bool)
    a[4, 5, 6::7] = a[20, 9, 3::11] = True
    cells = spark.createDataFrame([(1, *map(int, c)) for c in np.argwhere(a)], CELL)
    plan = stencil.close_ball(cells, 10, a.shape)._jdf.queryExecution().toString()
    assert len(plan) < 200_000
    want = blocks.squared_distances(blocks.squared_distances(a) > 100) > 100
    assert {(q.z, q.y, q.x) for q in stencil.close_ball(cells, 10, a.shape).collect()} == {tuple(map(int, c)) for c in np.argwhere(want)} and want.sum() > a.sum()


@pytest.mark.parametrize("n", [0, 1, 3])
def test_dilation(spark, n):
    rng = np.random.default_rng(7)
    a = rng.random((7, 9, 8)) < 0.02
    cells = spark.createDataFrame([(1, *map(int, c)) for c in np.argwhere(a)], CELL)
    grown = np.pad(a, n)
    for _ in range(n):
        p = np.pad(grown, 1)
        grown = grown | p[2:, 1:-1, 1:-1] | p[:-2, 1:-1, 1:-1] | p[1:-1, 2:, 1:-1] | p[1:-1, :-2, 1:-1] | p[1:-1, 1:-1, 2:] | p[1:-1, 1:-1, :-2]
    free = {tuple(int(v) - n for v in c) for c in np.argwhere(grown)}
    got = lambda df: {(q.z, q.y, q.x) for q in df.collect()}
    assert got(stencil.dilate(cells, n)) == free
    assert got(stencil.dilate(cells, n, a.shape)) == {c for c in free if all(0 <= v < s for v, s in zip(c, a.shape))}


def test_denoising_across_blocks(spark):
    """Against shifts of the whole volume at once."""
    a = np.random.default_rng(8).integers(0, 255, (5, 6, 37)).astype(float)
    halo = 3
    v, there = np.pad(a, halo), np.pad(np.ones(a.shape, bool), halo)
    top, low = np.zeros(a.shape), np.zeros(a.shape)
    at = lambda array, o: array[tuple(slice(halo + k, halo + k + n) for k, n in zip(o, a.shape))]
    for o in np.ndindex(5, 5, 5):
        t = np.array(o) - 2
        gap, n = np.zeros(a.shape), np.zeros(a.shape)
        for d in np.ndindex(3, 3, 3):
            q = np.array(d) - 1
            both = at(there, q) & (at(there, q + t) if max(abs(q + t)) <= halo else False)
            gap, n = gap + np.where(both, (at(v, q) - at(v, q + t)) ** 2, 0), n + both
        w = np.where(at(there, t), np.exp(-gap / np.maximum(n, 1) / 200), 0)
        top, low = top + w * at(v, t), low + w
    got = as_arrays(stencil.nlm_denoise(volumes(spark, {1: a}), 10.0), {1: a.shape})[1]
    assert np.allclose(got, top / low)


def test_small_volumes_are_worked_on_together(spark):
    """Blocks of one shape share a call, and large volumes beside them still come right."""
    rng = np.random.default_rng(6)
    arrays = {s: rng.random((4, 4, 4)) if s % 3 else rng.random((2, 35, 3)) for s in range(30)}
    met = blocks.over_blocks(volumes(spark, arrays).coalesce(1), 1, lambda a, inside: [blocks.shifted(a[0], (0, 0, 1), 1), np.full(inside.shape, float(len(inside)))[:, 1:-1, 1:-1, 1:-1]], ["next", "calls"], many=True)
    got = as_arrays(met, {s: a.shape for s, a in arrays.items()}, "next")
    assert all((got[s] == np.pad(a, [(0, 0), (0, 0), (0, 1)])[:, :, 1:]).all() for s, a in arrays.items())
    assert met.agg(F.max("calls")).first()[0] > 1


def test_inverse_rounds_end_for_each_volume(spark):
    """Small volumes share NumPy calls, and each one's rounds still end by its own moves."""
    from osteon.operators import spatial

    rng = np.random.default_rng(9)
    size = {s: 0.6 * (s % 5) / 5 for s in range(12)}
    rows = [(s, *map(int, at), *[float(v) for v in rng.normal(0, 0.2, 3) * size[s]]) for s in size for at in np.ndindex(3, 4, 2)]
    fields = spark.createDataFrame(rows, f"{CELL}, uz double, uy double, ux double")
    seen, over = {}, spatial.over_blocks
    spatial.over_blocks = lambda *a, **b: seen.update(b) or over(*a, **b)
    try:
        got = {tuple(r) for r in spatial.invert_field(fields).collect()}
    finally:
        spatial.over_blocks = over
    assert seen["many"]
    u = {(r[0], *r[1:4]): np.array(r[4:]) for r in rows}
    for s in (0, 2, 4):
        padded = [np.pad(np.array([u[s, *at][k] for at in np.ndindex(3, 4, 2)]).reshape(3, 4, 2), 2, mode="edge") for k in range(3)]
        p = np.stack(np.meshgrid(*[np.arange(2.0, n + 2) for n in (3, 4, 2)], indexing="ij"))
        w = np.zeros_like(p)
        for _ in range(100):
            new = -np.stack([spatial.linear(v, p + w) for v in padded])
            moved, w = np.abs(new - w).max(), new
            if moved < 1e-6:
                break
        assert {(s, *at, *[float(w[k][at]) for k in range(3)]) for at in np.ndindex(3, 4, 2)} == {r[:7] for r in got if r[0] == s}


def test_non_local_means_of_many_small_volumes(spark, monkeypatch):
    """Volumes that share NumPy calls come out as each does alone."""
    rng = np.random.default_rng(12)
    arrays = {s: rng.integers(80, 120, (4, 4, 4) if s % 2 else (3, 2, 5)).astype(float) for s in range(8)}
    shapes = {s: a.shape for s, a in arrays.items()}
    seen, over = {}, stencil.over_blocks
    alone = lambda *a, **b: over(*a, **{**b, "many": False})
    monkeypatch.setattr(stencil, "over_blocks", lambda *a, **b: seen.update(b) or over(*a, **b))
    together = as_arrays(stencil.nlm_denoise(volumes(spark, arrays), 10.0), shapes)
    assert seen["many"]
    monkeypatch.setattr(stencil, "over_blocks", alone)
    apart = as_arrays(stencil.nlm_denoise(volumes(spark, arrays), 10.0), shapes)
    assert all((together[s] == apart[s]).all() for s in arrays)
