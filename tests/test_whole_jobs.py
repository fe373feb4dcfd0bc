"""Registered queries against brute force over all rows of a small fixture."""

from __future__ import annotations

import numpy as np
import pytest

from osteon import queries as base

QUERIES = base.queries()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with 40 vectors of two cohorts as embeddings."""
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, [float(v) for v in rng.normal(0, 0.125, 64)]) for i in range(40)]
    folder = tmp_path_factory.mktemp("small")
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def vectors(spark, folder):
    return {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}


def on_triangle(p, a, b, c):
    """The closest point of triangle a b c by its edges and, where the foot of the normal is inside, its plane."""
    n = np.cross(b - a, c - a)
    foot = p - n * (n @ (p - a)) / (n @ n)
    if all(np.cross(e - s, foot - s) @ n >= 0 for s, e in ((a, b), (b, c), (c, a))):
        return foot
    ends = [s + (e - s) * np.clip((p - s) @ (e - s) / ((e - s) @ (e - s)), 0, 1) for s, e in ((a, b), (b, c), (c, a))]
    return min(ends, key=lambda q: np.linalg.norm(p - q))


def faces_at(points):
    return {k: (p, p + [1, 0, 0.5], p + [0, 1, -0.5]) for k, p in points.items()}


def test_surfaces_are_whole(spark, small):
    points = {k: v[:3] * 10 for k, v in vectors(spark, small).items()}
    faces = faces_at(points)
    probe = {k: p + [-0.15, 0.1, 0.3] for k, p in points.items() if k % 2 == 0}
    near = {k: min((on_triangle(p, *f) for f in faces.values()), key=lambda q: np.linalg.norm(p - q)) for k, p in probe.items()}
    want = {k: np.linalg.norm(p - near[k]) for k, p in probe.items()}
    run = lambda name: {r.id: r for r in QUERIES[name](spark, small).collect()}
    got = run("j2_surface_distance")
    assert {k: r.distance for k, r in got.items()} == pytest.approx(want)
    snapped = run("j3_snap_landmarks")
    assert {k: r.snap_distance for k, r in snapped.items()} == pytest.approx({k: d for k, d in want.items() if d <= 0.5})
    assert set(run("j4_parallel_distance")) == set(probe)
    corners = np.array([c for f in faces.values() for c in f])
    least = 0.005 * np.linalg.norm(corners.max(0) - corners.min(0))
    assert set(run("j19_keep_landmarks_near")) == {k for k, d in want.items() if d <= least}


def test_denoise_is_whole(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, 0, [float(v) for v in rng.normal(0, 0.125, 64)]) for i in (3, 1_000_000)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {}
    for scan, e in vectors(spark, str(tmp_path)).items():
        v = np.clip(np.rint((e + 1) * 127.5), 0, 255).reshape(4, 4, 4)
        inside = lambda q: all(0 <= c < 4 for c in q)
        for at in np.ndindex(v.shape):
            top = low = 0.0
            for step in np.ndindex(5, 5, 5):
                t = np.array(step) - 2
                if not inside(at + t):
                    continue
                patch = [np.array(at) + np.array(d) - 1 for d in np.ndindex(3, 3, 3)]
                gaps = [(v[tuple(q)] - v[tuple(q + t)]) ** 2 for q in patch if inside(q) and inside(q + t)]
                w = np.exp(-np.mean(gaps) / 200)
                top, low = top + w * v[tuple(at + t)], low + w
            want[(scan, *at)] = top / low
    got = {(r.scan_id, r.z, r.y, r.x): r.v for r in QUERIES["w21_nlm_denoise"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want)


def test_wide_distances_are_whole(spark, sf_dir):
    df = QUERIES["s8_distances_wide_all"](spark, sf_dir)
    assert df.columns == ["scan_id", *[f"d{i}" for i in range(12)]]
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice").collect():
        key = (r.o_custkey, r.o_orderkey % 12)
        want[key] = max(float(r.o_totalprice) / 1e6, want.get(key, 0.0))
    assert {(r.scan_id, i): r[f"d{i}"] for r in df.collect() for i in range(12) if r[f"d{i}"] is not None} == pytest.approx(want)


def test_icp_returns_moved_points(spark, small):
    points = {k: v[:3] * 10 + [0.05, 0, 0] for k, v in vectors(spark, small).items()}
    scan = {r.vec_id: r.label for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    df = QUERIES["i7_icp_batch"](spark, small)
    got = {r.id: np.array([r.x, r.y, r.z]) for r in df.collect()}
    assert df.columns == ["scan_id", "id", "x", "y", "z"] and set(got) == set(points)
    for s in (0, 1):
        own = [k for k in points if scan[k] == s]
        faces = [f for k, f in faces_at({k: points[k] - [0.05, 0, 0] for k in own}).items()]
        gap = lambda at: np.median([min(np.linalg.norm(at[k] - on_triangle(at[k], *f)) for f in faces) for k in own])
        assert gap(got) < gap(points)
        # the move is rigid
        far = lambda at: np.linalg.norm(np.array([at[k] for k in own])[:, None] - np.array([at[k] for k in own]), axis=2)
        assert far(got) == pytest.approx(far(points))


def test_poses_are_of_all_tries(spark, small, monkeypatch):
    from osteon.operators import pose

    asked = []
    real = pose.ransac_rigid
    monkeypatch.setattr(pose, "ransac_rigid", lambda m, tries=200, *a, **k: asked.append(tries) or real(m, tries, *a, **k))
    rows = QUERIES["i8_ransac_rigid"](spark, small).collect()
    # matches are an exact transform, so all poses but the best are within 8 degrees of it
    assert asked == [200] and sorted((r.scan_id, r.r21, r.t_z) for r in rows) == [(0, 1.0, 3.0), (1, 1.0, 3.0)]


def test_unusable_coordinates_end(spark):
    from osteon.operators import spatial

    nan, inf = float("nan"), float("inf")
    points = spark.createDataFrame([(1, 1, 0.1, 0.0, 0.0), (1, 2, nan, 0.0, 0.0), (1, 3, None, 0.0, 0.0), (1, 4, inf, 0.0, 0.0), (2, 5, 0.0, 0.0, 0.0), (1, 6, 9.0, 0.0, 0.0)], "g int, id long, x double, y double, z double")
    cloud = spark.createDataFrame([(1, 10, 0.0, 0.0, 0.0), (1, 11, nan, 0.0, 0.0), (1, 12, None, 1.0, 1.0)], "g int, id long, x double, y double, z double")
    got = {r.id: (r.neighbour, round(r.distance, 6)) for r in spatial.nearest_point(points, cloud, k=2, group=["g"]).collect()}
    assert got == {1: (10, 0.1), 2: (None, inf), 3: (None, inf), 4: (None, inf), 5: (None, inf), 6: (10, 9.0)}
    corners = ", ".join(f"{k}{a} double" for k in "abc" for a in "xyz")
    faces = spark.createDataFrame([(1, 7, *[0.0, -1.0, -1.0, 0.0, 1.0, -1.0, 0.0, 0.0, 2.0]), (1, 8, nan, *[0.0] * 8)], f"g int, face_id long, {corners}")
    near = {r.id: (r.face_id, round(r.distance, 6)) for r in spatial.surface_distance(points, faces, ["g"]).collect()}
    assert near == {1: (7, 0.1), 2: (None, inf), 3: (None, inf), 4: (None, inf), 5: (None, inf), 6: (7, 9.0)}
    assert spatial.surface_distance(points.drop("g"), faces.drop("g").limit(0)).where("face_id IS NULL").count() == 6


def test_metric_names():
    from osteon.operators.pose import metric_name

    asked = [None, "", " NCC ", "dice", "Surface", "surface_distance", "parallel_distance", "other"]
    assert [metric_name(a) for a in asked] == ["surface_distance", "surface_distance", "ncc", "surface_distance", "surface_distance", "surface_distance", "parallel_distance", "surface_distance"]
    assert metric_name("ncc", mesh=True) == "surface_distance"


def test_ranks_from_many_ranges(spark):
    from osteon.operators.planning import ranked

    names = spark.range(5000).selectExpr("cast(id AS string) AS name")
    rows = ranked(names, 5).orderBy("r").collect()
    assert [r.r for r in rows] == list(range(1, 5001))
    assert [(r.d, r.name) for r in rows] == sorted((r.d, r.name) for r in rows)
    assert ranked(names.limit(0), 5).count() == 0


def test_hd95_of_an_empty_mask_is_null(spark):
    from osteon.operators.evaluate import hd95

    cell = "scan_id long, z int, y int, x int, label int"
    pred = spark.createDataFrame([(1, 0, 0, 0, 1), (2, 0, 0, 0, 0)], cell)
    target = spark.createDataFrame([(1, 0, 0, 2, 1), (2, 0, 0, 1, 1), (3, 0, 0, 1, 1)], cell)
    assert {r.scan_id: r.hd95 for r in hd95(pred, target, 0.5).collect()} == {1: 1.0, 2: None, 3: None}
