"""Blocked matching, resized masks, inverted fields and the small mends, against loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from osteon.functions.scalars import natural_key
from osteon.operators import cohort, evaluate, planning, spatial, tables
from osteon.sources import manifests


def plain_matches(m, f, least):
    """(pair, a, b) by comparing everything with everything; ties go to the lower id."""
    out = []
    for pair in {p for p, _, _ in m}:
        a, b = ({i: np.array(v, float) for p, i, v in d if p == pair and v is not None and np.any(v)} for d in (m, f))
        cos = {(i, k): (u * w).sum() / (np.sqrt((u * u).sum()) * np.sqrt((w * w).sum())) for i, u in a.items() for k, w in b.items()}
        best_b = {i: min(b, key=lambda k, i=i: (-cos[i, k], k)) for i in a if b}
        best_a = {k: min(a, key=lambda i, k=k: (-cos[i, k], i)) for k in b if a}
        out += [(pair, i, k) for i, k in best_b.items() if best_a[k] == i and cos[i, k] >= least]
    return sorted(out)


@pytest.mark.parametrize("size", [1, 3, 512])
def test_blocked_matches(spark, size):
    rng = np.random.default_rng(3)
    make = lambda n, shift: [(p, i + shift, [float(x) for x in rng.integers(-2, 3, 5)]) for p in (1, 2, 3) for i in range(n)]
    m, f = make(40, 0), make(30, 100)
    m += [(1, 900, [0.0] * 5), (1, 901, None), (4, 1, [1.0] * 5)]  # no direction, no vector, no partner
    f += [(1, 902, [float("nan")] * 5), (5, 1, [1.0] * 5)]
    kind = "pair long, id long, vector array<double>"
    got = spatial.mutual_matches(spark.createDataFrame(m, kind), spark.createDataFrame(f, kind), 0.3, size).collect()
    assert sorted((r.pair, r.a, r.b) for r in got) == plain_matches(m, [r for r in f if not np.isnan(r[2]).any()], 0.3)
    for pair in (1, 2, 3):
        mine = sorted((r.rank, -r.cos, r.a) for r in got if r.pair == pair)
        assert [r[0] for r in mine] == list(range(1, len(mine) + 1)) and mine == sorted(mine, key=lambda r: r[1:])
    none = spark.createDataFrame([], kind)
    assert spatial.mutual_matches(none, spark.createDataFrame(f, kind)).count() == 0


def test_many_blocks_meet_in_slices(spark):
    """More than 64 blocks a pair: several slices, each with all fixed blocks."""
    rng = np.random.default_rng(4)
    m, f = ([(1, i, [float(x) for x in rng.normal(size=3)]) for i in range(n)] for n in (150, 20))
    kind = "pair long, id long, vector array<double>"
    got = spatial.mutual_matches(spark.createDataFrame(m, kind), spark.createDataFrame(f, kind), 0.0, 1)
    assert sorted((r.pair, r.a, r.b) for r in got.collect()) == plain_matches(m, f, 0.0)


def nearest(a, shape):
    for axis, (n, m) in enumerate(zip(a.shape, shape, strict=True)):
        rf = max(1, round(max(n, m) / min(n, m)))
        if n == m:
            continue
        if m > n and -(-m // rf) == n:
            a = np.take(np.repeat(a, rf, axis), range(m), axis)
        elif m < n and -(-n // rf) == m:
            a = np.take(a, np.arange(m) * rf, axis)
        else:
            a = np.take(a, [min(int(np.floor(j * ((n - 1) / (m - 1) if m > 1 else 1.0) + 0.5)), n - 1) for j in range(m)], axis)
    return a


def test_resize_mask(spark):
    rng = np.random.default_rng(5)
    old, new = [(5, 7, 3), (4, 4, 4), (1, 9, 2), (6, 5, 8)], [(9, 3, 5), (13, 2, 1), (3, 4, 2), (3, 11, 8)]
    arrays = [rng.integers(0, 4, s) for s in old]
    cells = [(n, *map(int, at), int(v)) for n, a in enumerate(arrays) for at, v in np.ndenumerate(a) if v]
    masks = spark.createDataFrame(cells, "scan_id int, z int, y int, x int, label int")
    shapes = spark.createDataFrame([(n, *o, *w) for n, (o, w) in enumerate(zip(old, new, strict=True))], "scan_id int, nz int, ny int, nx int, mz int, my int, mx int")
    got = [np.zeros(s, int) for s in new]
    for r in spatial.resize_mask(masks, shapes).collect():
        assert not got[r.scan_id][r.z, r.y, r.x]
        got[r.scan_id][r.z, r.y, r.x] = r.label
    for g, a, s in zip(got, arrays, new, strict=True):
        assert (g == nearest(a, s)).all()


def test_inverse_undoes_field(spark):
    """Forward, then inverse, ends where it began, in every cell that stays inside."""
    shape = (40, 12, 11)
    z, y, x = np.indices(shape).astype(float)
    u = np.stack([2.5 * np.sin(x / 5), 1.5 * np.cos(z / 6), 2 * np.sin(y / 4 + z / 9)])
    rows = [(1, *map(int, at), *[float(u[k][at]) for k in range(3)]) for at in np.ndindex(shape)]
    fields = spark.createDataFrame(rows, "scan_id long, z int, y int, x int, uz double, uy double, ux double")
    got = spatial.invert_field(fields).toPandas()
    assert len(got) == np.prod(shape) and got.residual.max() < 1e-5
    w = np.zeros((3, *shape))
    at = tuple(got[a] for a in "zyx")
    for k, a in enumerate("zyx"):
        w[k][at] = got[f"w{a}"]
    p = np.stack([z, y, x]) + u
    inside = np.all([(p[k] >= 0) & (p[k] <= shape[k] - 1) for k in range(3)], axis=0)
    back = p + np.stack([spatial.linear(w[k], np.clip(p, 0, np.array(shape).reshape(3, 1, 1, 1) - 1)) for k in range(3)])
    assert np.abs(back - np.stack([z, y, x]))[:, inside].max() < 0.5


def test_atlas_mean_of_constant_fields(spark):
    cells = [(s, z, y, x, float(z * 9 + y * 3 + x + s)) for s in (0, 1) for z in range(3) for y in range(3) for x in range(3)]
    images = spark.createDataFrame(cells, "scan_id int, z int, y int, x int, v double")
    got = {(r.z, r.y, r.x): r.v for r in evaluate.atlas_mean(images, images.select("scan_id", "z", "y", "x", F.lit(1.0).alias("ux"), F.lit(0.0).alias("uy"), F.lit(-1.0).alias("uz"))).collect()}
    assert got == {(z, y, x): (z + 1) * 9 + y * 3 + x - 1 + 0.5 for z in (0, 1) for y in range(3) for x in (1, 2)}


def test_examples_of_known_and_unknown_subjects(spark):
    scans = spark.createDataFrame([(1,), (2,), (3,)], "scan_id long")
    labels = spark.createDataFrame([(1,), (2,), (2,), (None,)], "label int")
    known = spark.createDataFrame([(1, 2), (1, 2), (1, 9), (2, None), (8, 1)], "scan_id long, label int")
    got = cohort.collect_examples(scans, labels, known)
    assert sorted((r.scan_id, r.label) for r in got.collect()) == [(1, 2), (3, 1), (3, 2)]
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "BroadcastNestedLoop" not in got._jdf.queryExecution().toString()


def test_keys(spark):
    s = spark.createDataFrame([(1, {"a": 'b","c":"d'}), (2, {"a": "b", "c": "d"}), (3, {"c": "d", "a": "b"})], "run int, settings map<string,string>")
    key = {r.run: r.key for r in planning.settings_key(s).collect()}
    assert key[1] != key[2] and key[2] == key[3]
    names = ["a2", "a10", "A010", "a1234567890123", "a1234567890124", "b0"]
    keys = [r.k for r in spark.createDataFrame([(n,) for n in names], "t string").select(natural_key(F.col("t")).alias("k")).collect()]
    assert keys[0] < keys[1] == keys[2] < keys[3] < keys[4] < keys[5]


def test_landmarks_csv(spark, tmp_path):
    landmarks = spark.createDataFrame([(1, 0, "main", 1.5, 2.0, 3.0), (2, 1, "semi", 4.0, 5.0, 6.0), (3, 0, "main", 9.0, 9.0, 9.0)], "scan_id long, idx int, type string, x double, y double, z double")
    scans = spark.createDataFrame([(1, "beta", None), (2, "Alpha", False), (3, "bad", True)], "scan_id long, name string, faulty boolean")
    manifests.write_landmarks_csv(manifests.landmarks_wide(landmarks, scans, 2), str(tmp_path / "out"))
    parts = [p.read_text().splitlines() for p in sorted((tmp_path / "out").glob("part-*.csv"))]
    lines = [line for p in parts for line in p[1:]]
    assert parts[0][0].startswith("Subject,landmark_0_x,landmark_0_y,landmark_0_z,landmark_1_x")
    assert lines == ["Alpha,,,,,,,,,,4.0,5.0,6.0", "beta,1.5,2.0,3.0,,,,,,,,,"]


def test_clusters_need_a_shared_folder():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda name, default: default)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_path(Session, "table")


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_in_crowds(spark, k):
    """Crowds beside far points, points in one place, and groups of different scale: as by comparing all."""
    rng = np.random.default_rng(8)
    crowd = rng.normal(0, 1e-4, (300, 3))
    far = rng.uniform(-50, 50, (20, 3))
    grid = np.stack(np.meshgrid(*[np.arange(4.0)] * 3), -1).reshape(-1, 3) * 1e6
    cloud = [(1, i, *map(float, p)) for i, p in enumerate(np.concatenate([crowd, far, np.zeros((40, 3))]))] + [(2, 1000 + i, *map(float, p)) for i, p in enumerate(grid)] + [(3, 2000, 5.0, 5.0, 5.0)]
    asked = np.concatenate([rng.normal(0, 1e-4, (40, 3)), rng.uniform(-80, 80, (40, 3)), np.zeros((2, 3))])
    points = [(1, i, *map(float, p)) for i, p in enumerate(asked)] + [(2, 500 + i, *map(float, p)) for i, p in enumerate(rng.uniform(-1e6, 5e6, (30, 3)))] + [(3, 900, -1e9, 0.0, 0.0)]
    kind = "g int, id long, x double, y double, z double"
    got = spatial.nearest_point(spark.createDataFrame(points, kind), spark.createDataFrame(cloud, kind), k, ["g"]).collect()
    want = []
    for g, i, *p in points:
        near = sorted((sum((np.array(p) - np.array(q)) ** 2) ** 0.5, n) for h, n, *q in cloud if h == g)[:k]
        want += [(g, i, r + 1, n, d) for r, (d, n) in enumerate(near)]
    found = sorted((r.g, r.id, r.rank, r.neighbour, r.distance) for r in got)
    assert [r[:4] for r in found] == [r[:4] for r in sorted(want)]
    assert np.allclose([r[4] for r in found], [r[4] for r in sorted(want)], rtol=1e-12, atol=0)


def test_widths_follow_crowds(spark):
    rng = np.random.default_rng(9)
    rows = [(1, *map(float, p)) for p in rng.uniform(0, 100, (400, 3))] + [(2, *map(float, p)) for p in np.concatenate([rng.uniform(0, 1, (390, 3)), [[0, 0, 0], [100, 100, 100]]])]
    cloud = spark.createDataFrame(rows, "g int, x double, y double, z double")
    width = {r["g"]: r["__w"] for r in spatial.group_widths(cloud, ["g"]).collect()}
    assert width[2] < width[1] / 8
