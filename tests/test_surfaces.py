"""Distances to meshes whose triangles differ in size by orders of magnitude, against all triangles."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from osteon.operators import spatial

CORNERS = [f"{k}{a}" for k in "abc" for a in "xyz"]
FACES = "g int, face_id long, " + ", ".join(f"{c} double" for c in CORNERS)


def to_segment(p, a, b):
    d = b - a
    t = np.clip(((p - a) @ d) / max(d @ d, 1e-300), 0, 1)
    return np.linalg.norm(p - (a + t * d))


def to_triangle(p, a, b, c):
    n = np.cross(b - a, c - a)
    out = min(to_segment(p, a, b), to_segment(p, b, c), to_segment(p, c, a))
    if n @ n > 1e-24:
        q = p - ((p - a) @ n) / (n @ n) * n
        if all(np.cross(e - s, q - s) @ n >= 0 for s, e in ((a, b), (b, c), (c, a))):
            out = min(out, np.linalg.norm(p - q))
    return out


@pytest.fixture(scope="module")
def scene():
    """Group 1: small triangles in two crowds, a huge one, a point and a segment; group 2: a mesh 1000 times larger."""
    r = np.random.default_rng(11)
    faces, points = [], []
    for i in range(120):
        at = np.array([0.0, 0, 0]) if i % 2 else np.array([50.0, 50, 50])
        faces.append((1, i, *(at + r.normal(0, 1, 3) + r.normal(0, 0.1, (3, 3))).ravel()))
    faces.append((1, 900, -4000.0, -4000.0, 3.0, 4000.0, -4000.0, 3.0, 0.0, 5000.0, 3.5))
    faces.append((1, 901, *[7.0, 7.0, 7.0] * 3))  # a point
    faces.append((1, 902, 20.0, 0.0, 0.0, 40.0, 0.0, 0.0, 30.0, 0.0, 0.0))  # a segment
    faces += [(1, 903, *faces[0][2:]), (1, 904, *faces[0][2:])]  # repeated
    faces += [(2, i, *(r.normal(0, 1000, 3) + r.normal(0, 100, (3, 3))).ravel()) for i in range(40)]
    for i in range(60):
        at = [[0.0, 0, 0], [50.0, 50, 50], [25.0, 1, 1], [3000.0, -2000, 900], [1e6, -1e6, 5e5]][i % 5]
        points.append((1, i, *(np.array(at) + r.normal(0, 1, 3))))
    points += [(2, 100 + i, *r.normal(0, 2000, 3)) for i in range(20)]
    points += [(1, 200 + i, 0.25, 0.25, 0.25) for i in range(5)]
    return [tuple([f[0], f[1], *map(float, f[2:])]) for f in faces], [tuple([p[0], p[1], *map(float, p[2:])]) for p in points]


def expected(faces, points, grouped):
    out = {}
    for g, i, *at in points:
        d = {f[1] if grouped else (f[0], f[1]): to_triangle(np.array(at), *np.array(f[2:]).reshape(3, 3)) for f in faces if not grouped or f[0] == g}
        out[i] = min(d.values())
    return out


@pytest.mark.parametrize("width", [None, 0.05, 300.0])
def test_triangles_of_all_sizes(spark, scene, width):
    faces, points = scene
    got = spatial.surface_distance(spark.createDataFrame(points, "g int, id long, x double, y double, z double"), spark.createDataFrame(faces, FACES), ["g"], width).collect()
    want = expected(faces, points, True)
    assert len(got) == len(points)
    for r in got:
        assert r.distance == pytest.approx(want[r.id], rel=1e-9, abs=1e-9), r
        p = next(x for x in points if x[1] == r.id)
        assert np.linalg.norm(np.array(p[2:]) - [r.sx, r.sy, r.sz]) == pytest.approx(r.distance, rel=1e-9)
        assert r.face_id not in (903, 904)  # ties go to the lower face


def test_without_groups_and_with_hot_cells(spark, scene, monkeypatch):
    faces, points = scene
    points = points + [(1, 1000 + i, 0.5 + i * 1e-6, 0.25, 0.0) for i in range(3000)]
    real, parts = spatial.salted, []

    def seen(p, listed, keys, share=1000):
        a, b = real(p, listed, keys, share)
        parts.append(a.agg(F.max("__salt")).first()[0])
        return a, b

    monkeypatch.setattr(spatial, "salted", seen)
    p = spark.createDataFrame([x[1:] for x in points], "id long, x double, y double, z double")
    f = spark.createDataFrame([x[1:] for x in faces if x[0] == 1], FACES.removeprefix("g int, "))
    got = {r.id: r.distance for r in spatial.surface_distance(p, f).collect()}
    some = points[:85] + points[85::300]
    want = expected([x for x in faces if x[0] == 1], [(1, *x[1:]) for x in some], True)
    assert len(got) == len(points) and all(got[i] == pytest.approx(d, rel=1e-9, abs=1e-9) for i, d in want.items())
    assert parts[0] > 0


def test_a_huge_triangle_has_few_cells(spark, scene):
    faces = spark.createDataFrame([x for x in scene[0] if x[0] == 1], FACES)
    low = {a: F.least(*[F.col(f"{k}{a}") for k in "abc"]) for a in "xyz"}
    high = {a: F.greatest(*[F.col(f"{k}{a}") for k in "abc"]) for a in "xyz"}
    sized = faces.withColumns({"__w": F.lit(0.2), "__level": F.greatest(F.ceil(F.log2(F.greatest(*[high[a] - low[a] for a in "xyz"]) / 0.8)), F.lit(0)).cast("int")})
    sized = sized.withColumn("__level", F.coalesce("__level", F.lit(0)))
    cells = {r.face_id: r["count"] for r in spatial.listed_faces(sized, low, high).groupBy("face_id").count().collect()}
    assert 1 <= cells[900] <= 216 and max(cells.values()) <= 343


def test_empty_sides(spark, scene):
    points = spark.createDataFrame(scene[1], "g int, id long, x double, y double, z double")
    none = spark.createDataFrame([], FACES)
    assert spatial.surface_distance(points, none, ["g"]).where("face_id IS NULL AND distance = double('infinity')").count() == len(scene[1])
    assert spatial.surface_distance(points.limit(0), spark.createDataFrame(scene[0], FACES), ["g"]).count() == 0


def test_few_pairs_need_exact_distances(spark, monkeypatch):
    rng = np.random.default_rng(11)
    at, corner = rng.normal(0, 1, (60, 3)), rng.normal(0, 1, (400, 1, 3)) + rng.normal(0, 0.7, (400, 3, 3))
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(at.tolist())], "id long, x double, y double, z double")
    faces = spark.createDataFrame([(i, *t) for i, t in enumerate(corner.reshape(400, 9).tolist())], "face_id long, " + ", ".join(f"{k}{a} double" for k in "abc" for a in "xyz"))
    measured, exact = [], spatial.with_closest
    monkeypatch.setattr(spatial, "with_closest", lambda df: measured.append(df) or exact(df))
    got = {r.id: (r.face_id, r.distance) for r in spatial.surface_distance(points, faces).collect()}
    assert measured[0].count() < 5 * 60
    every = exact(points.crossJoin(faces)).groupBy("id").agg(F.min(F.struct("distance", "face_id")).alias("m")).collect()
    assert got == {r.id: (r.m.face_id, r.m.distance) for r in every}
