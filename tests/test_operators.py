"""Literals, analytic shapes, round trips and brute force on small inputs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from osteon.operators import cohort, evaluate, geometry, graph, intensity, planning, sets, spatial, stencil, thresholds
from osteon.sources import manifests
from osteon.streaming import jobs

CELLS = ["scan_id", "z", "y", "x"]


def volume(spark, array, scan=1):
    rows = [(scan, *map(int, at), int(v)) for at, v in np.ndenumerate(array) for at in [at]]
    return spark.createDataFrame(rows, "scan_id long, z int, y int, x int, v int")


def as_array(df, shape, column="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.z, r.y, r.x] = r[column]
    return out


def test_pooling_literals(spark):
    assert thresholds.average_pool(volume(spark, np.arange(1, 17, 2).reshape(2, 2, 2)), 2).first().v == 8
    pooled = thresholds.average_pool(volume(spark, np.arange(1, 13).reshape(3, 2, 2)), 2).orderBy("z").collect()
    assert [r.v for r in pooled] == [4, 10]


def test_centroid_size_literals(spark):
    p = spark.createDataFrame([(1, 1.0, 0.0, 0.0), (1, -1.0, 0.0, 0.0)], "scan_id long, x double, y double, z double")
    assert evaluate.centroid_size(p).first()["size"] == pytest.approx(1.0)


def test_intensity_map_literals(spark):
    steps = spark.createDataFrame([(1, "a", 1, 1.0, -20.0), (2, "a", 1, 4.0, 1.0), (3, "a", 1, 0.0, 9.0)], "scan_id long, filename string, seq int, s double, o double")
    got = {r.scan_id: (r.mapping_scale, r.mapping_shift) for r in intensity.compose_intensity_maps(steps).collect()}
    assert got == {1: (1.0, 20.0), 2: (0.25, -0.25), 3: (1.0, 0.0)}


def test_kabsch_recovers_pose(spark):
    rng = np.random.default_rng(0)
    p = rng.normal(size=(20, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    t = 1.5 * p @ q.T + [1, 2, 3]
    df = spark.createDataFrame([(1, *map(float, a), *map(float, b)) for a, b in zip(p, t, strict=True)] + [(2, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "scan_id long, x double, y double, z double, tx double, ty double, tz double")
    got = {r.scan_id: r for r in evaluate.kabsch_batch(df, scaled=True).collect()}
    assert np.allclose([[got[1][f"r{i}{j}"] for j in (1, 2, 3)] for i in (1, 2, 3)], q) and got[1].scale == pytest.approx(1.5)
    assert got[2].r11 is None


def test_labels_match_flood_fill(spark):
    rng = np.random.default_rng(1)
    a = (rng.random((5, 6, 7)) < 0.35).astype(int)
    for full in (False, True):
        got = as_array(graph.label_components(volume(spark, a).where("v > 0"), full), a.shape, "component")
        seen, groups = np.zeros_like(a, bool), []
        near = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (abs(i) + abs(j) + abs(k) == 1 or full) and (i, j, k) != (0, 0, 0)]
        for start in zip(*np.nonzero(a), strict=True):
            if not seen[start]:
                stack, group = [start], []
                seen[start] = True
                while stack:
                    c = stack.pop()
                    group.append(c)
                    for d in near:
                        n = tuple(np.add(c, d))
                        if all(0 <= v < s for v, s in zip(n, a.shape, strict=True)) and a[n] and not seen[n]:
                            seen[n] = True
                            stack.append(n)
                groups.append(group)
        assert len({got[g[0]] for g in groups}) == len(groups)
        assert all(len({got[c] for c in g}) == 1 for g in groups)


def test_gaussian_mirrors_the_border(spark):
    a = np.random.default_rng(2).integers(0, 100, (3, 4, 5))
    sigma, r = 0.8, 3
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    want = a.astype(float)
    for axis in range(3):
        padded = np.pad(want, [(r, r) if k == axis else (0, 0) for k in range(3)], mode="symmetric")
        want = sum(w[k] * np.take(padded, range(k, k + a.shape[axis]), axis=axis) for k in range(2 * r + 1))
    assert np.allclose(as_array(stencil.gaussian_smooth(volume(spark, a), sigma), a.shape), want)


def test_threshold_li_matches_fixed_point(spark):
    a = np.random.default_rng(3).integers(0, 200, (4, 5, 6))
    v, t = a.ravel().astype(float), np.percentile(a, 95)
    for _ in range(64):
        hi, lo = v[v > t].mean() - v.min() + 1, v[v <= t].mean() - v.min() + 1
        t = (hi - lo) / (math.log(hi) - math.log(lo)) + v.min() - 1
    assert thresholds.threshold_li(volume(spark, a)).first().threshold == math.floor(t)


def test_surface_distance_of_a_triangle(spark):
    face = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 4.0, 0.0)], "face_id long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    pts = spark.createDataFrame([(1, 1.0, 1.0, 2.0), (2, -3.0, 0.0, 4.0), (3, 4.0, 4.0, 0.0), (4, 100.0, 0.0, 0.0)], "id long, x double, y double, z double")
    got = {r.id: r.distance for r in spatial.surface_distance(pts, face).collect()}
    assert got == pytest.approx({1: 2.0, 2: 5.0, 3: math.sqrt(8), 4: 96.0})


def test_clipped_area(spark):
    face = spark.createDataFrame([(1, 1, -1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "mesh_id long, face_id long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    parts = geometry.clip_boundary_faces(face, [(0.0, 0.0, 0.0, 1.0, 0.0, 0.0)])
    assert geometry.face_normals(parts).agg(F.sum("area")).first()[0] == pytest.approx(0.5)


def test_alignment_round_trip(spark):
    one = {"vs": 0.5, "vs_before": 0.25, "scale": 2.0, **{f"r{i}{j}": v for i, row in enumerate([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], 1) for j, v in enumerate(row, 1)}}
    one |= {f"{k}_{a}": 0.0 for k in ("pad", "shift", "ref", "src") for a in "xyz"}
    poses = spark.createDataFrame([(1,)], "scan_id long").withColumns({k: F.lit(v) for k, v in one.items()})
    p = spark.createDataFrame([(1, 1, 1.0, 2.0, 3.0)], "scan_id long, id long, x double, y double, z double")
    r = geometry.invert_alignment(p, poses).first()
    assert (r.x, r.y, r.z) == pytest.approx((4 / 2 * 0.25, -2 / 2 * 0.25, 6 / 2 * 0.25))


def test_best_checkpoint_table(spark):
    rows = [("a", 1, 1.0, 0.5), ("a", 2, 0.5, 0.1), ("b", 1, 1.0, 0.5), ("b", 2, 1.001, 0.9), ("c", 1, 1.0, 0.5), ("c", 2, 1.5, 0.99), ("d", 1, None, 0.9), ("d", 2, 2.0, 0.1)]
    got = {r.run: r.epoch for r in planning.best_checkpoint(spark.createDataFrame(rows, "run string, epoch int, loss double, dice double")).collect()}
    assert got == {"a": 2, "b": 2, "c": 1, "d": 2}


def test_split_properties(spark):
    names = spark.createDataFrame([(f"S{i}",) for i in range(12)], "name string")
    one, two = (planning.subject_split(names, 10, 20, seed).collect() for seed in (7, 7))
    assert sorted(one) == sorted(two) and len({r.name for r in one}) == 12
    assert sorted(r.split for r in one).count("val") == 1 and sorted(r.split for r in one).count("test") == 2
    with pytest.raises(ValueError):
        planning.subject_split(names.limit(2), 10, 10, 1)
    folds = planning.k_fold(names, 3, 1, names.limit(2)).where("role = 'val'").collect()
    assert len(folds) == 10 == len({r.name for r in folds})


def test_greedy_is_the_sequential_answer(spark):
    rng = np.random.default_rng(4)
    var = {i: float(rng.integers(0, 8)) for i in range(40)}
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 40, (80, 2)) if a < b}
    kept = []
    for i in sorted(var, key=lambda i: (-var[i], i)):
        if not any((min(i, j), max(i, j)) in pairs for j in kept):
            kept.append(i)
    got = graph.greedy_decorrelate(spark.createDataFrame(list(var.items()), "id long, variance double"), spark.createDataFrame(list(pairs), "a long, b long"))
    assert sorted(r.id for r in got.collect()) == sorted(kept)


def test_semi_landmarks_on_a_path(spark):
    v = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(5)], "id long, x double, y double, z double")
    e = spark.createDataFrame([(i, i + 1) for i in range(4)], "a long, b long")
    got = graph.semi_landmarks(e, v, spark.createDataFrame([(1, 0, 4)], "pair long, start long, goal long"), 3)
    assert sorted((r.idx, round(r.x, 6)) for r in got.collect()) == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_landmark_shapes(spark):
    texts = spark.createDataFrame([(1, "[[1,2,3],[4,5,6]]"), (2, '[{"position":[1,2,3],"landmark_type":"semi"}]'), (3, '{"10":{"position":{"x":7,"y":8,"z":9}},"2":[1,1,1]}')], "scan_id long, text string")
    got = sorted((r.scan_id, r.idx, r.type, r.x, r.y, r.z) for r in manifests.read_landmarks(texts).collect())
    assert got == [(1, 0, "main", 1, 2, 3), (1, 1, "main", 4, 5, 6), (2, 0, "semi", 1, 2, 3), (3, 0, "main", 1, 1, 1), (3, 1, "main", 7, 8, 9)]


def test_project_on_disk(spark, tmp_path):
    for name in ("SubA", "SubB"):
        (tmp_path / "extracted" / name).mkdir(parents=True)
        (tmp_path / "extracted" / name / f"{name}.json").write_text('{"name": "%s", "voxel_size": 0.05, "faulty": false}' % name)
    (tmp_path / "extracted" / "SubA" / "other.json").write_text('{"name": "x"}')
    (tmp_path / "extracted" / "SubA" / "SubA_edit_11_crop_lossy.nii.gz").write_bytes(b"x")
    (tmp_path / "extracted" / "SubA" / "SubA_edit_2_crop_mask.nii.gz").write_bytes(b"x")
    assert [r.name for r in manifests.read_scans(spark, str(tmp_path)).collect()] == ["SubA", "SubB"]
    edits = {(r.scan, r.edit_number, r.kind, r.lossy, r.role) for r in manifests.read_edits(spark, str(tmp_path)).collect()}
    assert edits == {("SubA", 11, "crop", True, "image"), ("SubA", 2, "crop", False, "mask")}


def test_log_first_value_wins(spark):
    logs = spark.createDataFrame([("f", "a.log", "[Scan]\nPixel Size=5\nPixel Size=6"), ("f", "b.log", "[Scan]\nPixel Size=7")], "folder string, file string, text string")
    assert [(r.section, r.key, r.value) for r in manifests.acquisition_log_kv(logs).collect()] == [("scan", "pixel size", "5")]
    assert manifests.log_disagreements(logs, ["pixel size"]).count() == 1


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "scan_id long, z int, y int, x int, v int")
    assert graph.label_components(none).count() == 0
    assert thresholds.threshold_otsu(none).count() == 0
    empty = spark.createDataFrame([], "id long, x double, y double, z double")
    one = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    assert spatial.nearest_point(one, empty).first().distance == float("inf")
    m = spark.createDataFrame([], "scan_id long, z int, y int, x int, label int")
    assert evaluate.overlap_metrics(m, m).count() == 0 and sets.mask_union(m, m).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = [("start", "a", 0, "crop", None), ("end", "a", 30, "crop", "done"), ("start", "b", 5, "crop", None), ("start", "z", 90_000, "crop", None), ("end", "z", 90_001, "crop", "done")]
    events = spark.createDataFrame(rows, "event string, id string, s long, tool string, status string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))).drop("s")
    events.where("id <> 'z'").write.parquet(str(tmp_path / "in"))
    events.where("id = 'z'").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    out = jobs.job_pairing_stream(stream.where("event = 'start'"), stream.where("event = 'end'"))
    q = out.writeStream.format("memory").queryName("paired").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.id, r.status) for r in spark.sql("SELECT * FROM paired").collect()}
    want = {(r.id, r.status) for r in jobs.job_pairing(events).collect()}
    assert got == want == {("a", "done"), ("b", "interrupted"), ("z", "done")}


def test_eligibility_issues(spark):
    scans = spark.createDataFrame([(1, "a", False, False, False), (2, "b", True, False, False), (3, "c", False, True, False)], "scan_id long, name string, faulty boolean, is_mesh boolean, voxelized boolean")
    images = spark.createDataFrame([(1, [8, 8, 8], 1.0), (2, [8, 8, 8], 1.0)], "scan_id long, dims array<int>, zoom double")
    masks = spark.createDataFrame([(1, [8, 8, 8], 1.0), (2, [8, 8, 9], 1.1)], "scan_id long, dims array<int>, zoom double")
    got = {r.scan_id: r.issues for r in cohort.training_eligibility(scans, images, masks).collect()}
    assert got == {1: [], 2: ["faulty", "shape_mismatch", "geometry_mismatch"], 3: ["mesh_only", "image_missing", "mask_missing"]}
