"""The background estimate on phantoms, for all scans of a cohort at once, and its parts against NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from osteon.operators import pose, thresholds
from osteon.operators.blocks import squared_distances
from osteon.operators.stencil import kernel


def ball(n):
    axis = np.arange(n) - n / 2
    return np.sqrt(axis[:, None, None] ** 2 + axis[:, None] ** 2 + axis**2)


def phantom(parts, n=96, air=3000.0, noise=400.0, seed=0):
    """Noise around nested balls: (radius, value, noise), the largest first."""
    rng, r = np.random.default_rng(seed), ball(n)
    v, s = np.full(r.shape, air), np.full(r.shape, noise)
    for radius, value, spread in parts:
        v[r <= radius], s[r <= radius] = value, spread
    return np.clip(v + rng.normal(size=r.shape) * s, 0, 65535).astype(np.int32)


@pytest.fixture(scope="module")
def scans():
    padded = phantom([(30, 20000, 400)])
    padded[:20, :20, :] = 0
    return {
        1: (phantom([(30, 20000, 400)]), 10000), 2: (phantom([(30, 20000, 400), (14, 7000, 400)]), 10000), 3: (padded, 10000),
        4: (phantom([(40, 8000, 300), (12, 20000, 300)], air=1000.0, noise=300.0, seed=1), 15000), 5: (phantom([(30, 8000, 900), (10, 20000, 900)], air=1000.0, noise=60.0, seed=2), 15000),
        6: (phantom([(50, 2500, 300), (24, 8000, 300), (6, 20000, 300)], n=128, air=1000.0, noise=300.0, seed=3), 15000), 7: (np.full((32, 32, 32), 20000, np.int32), 10000),
    }


@pytest.fixture(scope="module")
def tables(spark, scans, tmp_path_factory):
    folder = tmp_path_factory.mktemp("phantoms")
    for s, (v, _) in scans.items():
        at = np.indices(v.shape, dtype=np.int32).reshape(3, -1)
        pq.write_table(pa.table({"scan_id": np.full(v.size, s), "z": at[0], "y": at[1], "x": at[2], "v": v.ravel()}), f"{folder}/{s}.parquet")
    levels = spark.createDataFrame([(s, float(t)) for s, (_, t) in scans.items()], "scan_id long, threshold double")
    return spark.read.parquet(str(folder)), levels


def test_outside(tables):
    got = {r.scan_id: r for r in pose.estimate_background(*tables, dtype="uint16").collect()}
    for s, air, most in ((1, 3000, 60), (2, 3000, 60), (3, 3000, 60), (4, 1000, 80), (5, 1000, 40), (6, 1000, 80)):
        assert got[s].reason == "outside" and got[s].stride == 2 and abs(got[s].background - air) < most, got[s]
    assert got[7].reason == "too few cells beyond the guard" and got[7].background is None and got[7].eligible == 0


def test_tissue(tables):
    voxels, levels = tables
    some = "scan_id IN (4, 5, 6)"
    got = {r.scan_id: r for r in pose.estimate_background(voxels.where(some), levels.where(some), region=" Surrounding_Tissue ").collect()}
    for s, most in ((4, 80), (5, 250), (6, 150)):
        assert got[s].reason == "surrounding_tissue" and abs(got[s].background - 8000) < most, got[s]
    assert got[5].air_exclusion == "applied" and abs(got[5].air_peak - 1000) < 40
    assert got[6].shell_outer < got[6].split


def test_cells_against_whole_volumes(spark, tables, scans):
    """Eligible cells, their distances and blurred values, block borders included."""
    voxels, levels = tables
    small = pose.sampled(voxels.where("scan_id = 3"))
    rows = pose.background_cells(small.drop("stride"), levels).collect()
    v = scans[3][0][::2, ::2, ::2].astype(float)
    below = v < 10000
    p = np.pad(v, 1, mode="edge")
    cube = np.stack([p[i : i + 48, j : j + 48, k : k + 48] for i in range(3) for j in range(3) for k in range(3)])
    fill = below & (cube.max(0) == cube.min(0))
    d = np.sqrt(squared_distances(~below))
    kept = below & (d >= 3) & (np.sqrt(squared_distances(fill)) >= 3)
    w, blurred = np.array(kernel(1.0)), v
    for axis in range(3):
        q = np.pad(blurred, [(4, 4) if k == axis else (0, 0) for k in range(3)], mode="edge")
        blurred = sum(w[k] * np.take(q, range(k, k + 48), axis) for k in range(9))
    assert fill.any() and sorted((r.v, round(r.blurred, 6), round(r.d, 9)) for r in rows) == sorted(zip(v[kept], np.round(blurred[kept], 6), np.round(d[kept], 9), strict=True))
    assert all(r.exterior for r in rows)  # nothing is enclosed


def test_strides_and_names(spark):
    boxes = spark.createDataFrame([(1, 99, 99, 99, 0), (2, 1999, 1999, 1999, 0), (1, 0, 0, 2, 5), (1, 0, 0, 3, 6)], "scan_id long, z int, y int, x int, v int")
    assert {(r.scan_id, r.x, r.v, r.stride) for r in pose.sampled(boxes).collect()} == {(1, 1, 5, 2)}
    assert {r.stride for r in pose.sampled(boxes.union(spark.createDataFrame([(2, 0, 0, 0, 1)], boxes.schema))).where("scan_id = 2").collect()} == {8}
    assert [pose.region_name(n) for n in (None, "bogus", "outside", "SURROUNDING_tissue ")] == ["outside", "outside", "outside", "surrounding_tissue"]


def frame(spark, values):
    return spark.createDataFrame(pa.table({"scan_id": np.concatenate([np.full(len(v), s) for s, v in values.items()]), "v": np.concatenate(list(values.values()))}))


def test_spread_of_clipped_values(spark):
    rng = np.random.default_rng(4)
    clipped = np.concatenate([np.clip(rng.normal(0.8, 1.0, 400_000), 0, None), rng.normal(8, 1.5, 100_000)])
    df = frame(spark, {1: clipped, 2: -clipped, 3: rng.normal(100, 5, 10_000), 4: np.full(50, 3.0)})
    piled = thresholds.range_pile_up(df)
    assert {(r.scan_id, r.low_end, r.high_end) for r in piled.collect()} == {(1, True, False), (2, False, True), (3, False, False), (4, True, True)}
    peaks = spark.createDataFrame([(1, 0.8), (2, -0.8), (3, 100.0), (4, 3.0)], "scan_id long, peak double")
    got = {r.scan_id: r for r in thresholds.mode_spread(df, peaks, piled).collect()}
    assert (got[1].rule, got[2].rule, got[3].rule, got[4].rule) == ("half_max_upper", "half_max_lower", "narrower_side_rms", "none")
    assert abs(got[1].spread - 1) < 0.15 and abs(got[2].spread - 1) < 0.15 and abs(got[3].spread - 5) < 0.3 and got[4].spread == 0
    naive = thresholds.mode_spread(df, peaks, piled.where("scan_id > 2")).where("scan_id = 1").first()
    assert naive.rule == "narrower_side_rms" and naive.spread < 0.7


def test_peak_of_constant_values(spark):
    got = {r.scan_id: r.peak for r in thresholds.fd_histogram_peak(frame(spark, {1: np.full(9, 4.0), 2: np.arange(20.0)})).collect()}
    assert got[1] == 4.0 and 0 <= got[2] <= 19


@pytest.mark.parametrize("name", ["a5_estimate_background", "a5_estimate_tissue"])
def test_queries(spark, sf_dir, name):
    from osteon import queries

    rows = queries.queries()[name](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert {r.reason for r in rows} >= {"outside" if name.endswith("ground") else "surrounding_tissue"}
    assert all(0 <= r.background <= 255 for r in rows if r.reason in pose.REGIONS)
