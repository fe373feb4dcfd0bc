"""Joins and rounds that must not grow with what a compressed file or an explosion hides."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from osteon.operators import graph, spatial, stencil, tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_rows_decide_on_broadcasts(spark):
    many = tables.written(spark.range(tables.MOST_BROADCAST + 1).select("id", F.lit(0).alias("v")))
    few = tables.written(spark.range(10).select("id", F.lit(0).alias("w")))
    assert "Broadcast" not in plan_of(many.join(tables.written(many.withColumnRenamed("v", "w")), "id"))
    assert "Broadcast" not in plan_of(spark.range(10**8).join(many, "id", "left"))
    assert "Broadcast" in plan_of(spark.range(10**8).join(few, "id", "left"))
    assert tables.written(few.where("id > 50")).count() == 0


def test_eroded_cells_are_not_broadcast(spark):
    cells = spark.range(64).select(F.lit(1).alias("scan_id"), *[F.floor(F.col("id") / n % 4).cast("int").alias(a) for a, n in zip("zyx", (16, 4, 1), strict=True)])
    inner = stencil.erode(cells, 1)
    assert "Broadcast" not in plan_of(inner)
    assert {tuple(r) for r in inner.collect()} == {(1, z, y, x) for z in (1, 2) for y in (1, 2) for x in (1, 2)}


def spread(points, rho, most):
    """The choices one by one: points as id, place."""
    radius, ids, at = -5 * np.log(rho), np.array([i for i, _ in points]), np.array([p for _, p in points])
    score, free, out = -((at - at.mean(0)) ** 2).sum(1), np.ones(len(ids), bool), []
    near = np.full(len(ids), np.inf)
    while free.any():
        p = min(np.flatnonzero(free), key=lambda n: (-score[n], ids[n]))
        out.append(int(ids[p]))
        far = ((at - at[p]) ** 2).sum(1)
        for n in [n for n in np.lexsort((ids, far)) if far[n] <= radius**2][:most] + [p]:
            free[n] = False
        near = np.minimum(near, far)
        score = near
    return out


def test_spread_in_few_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    scans = {1: [(i, tuple(p)) for i, p in enumerate(rng.normal(0, 2, (300, 3)).tolist())], 2: [(i, (float(i % 5), float(i // 5 % 5), float(i // 25))) for i in range(100)], 3: [(7, (0.0, 0.0, 0.0))]}
    rows = [(s, i, *p) for s, points in scans.items() for i, p in points]
    tables_written, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: tables_written.append(1) or write(df))
    got = graph.spread_select(spark.createDataFrame(rows, "scan_id long, id long, x double, y double, z double"), 0.7, 4, 128).collect()
    for s, points in scans.items():
        assert [r.id for r in sorted((r for r in got if r.scan_id == s), key=lambda r: r.order)] == spread(points, 0.7, 4)
    assert len(tables_written) < 2 * max(r.order + 1 for r in got)


def test_clahe_sends_only_values_that_are_there(spark):
    rng, tile, clip, bins = np.random.default_rng(3), 3, 6.0, 32
    v = {(z, y, x): int(n) for (z, y, x), n in zip(np.ndindex(5, 4, 7), rng.integers(0, bins, 140), strict=True) if (z, y, x) != (2, 1, 1)}
    held = {}
    for at, n in v.items():
        held.setdefault(tuple(c // tile for c in at), []).append(n)
    to = {}
    for t, values in held.items():
        n = np.bincount(values, minlength=bins).astype(float)
        kept = np.minimum(n, max(clip * len(values) / bins, 1.0))
        to[t] = np.cumsum(kept + (n - kept).sum() / bins) / len(values) * (bins - 1)
    expected = {}
    for at, n in v.items():
        p = [(c + 0.5) / tile - 0.5 for c in at]
        low = [int(np.floor(c)) for c in p]
        expected[at] = sum(
            np.prod([c - b if o else 1 - (c - b) for c, b, o in zip(p, low, corner, strict=True)]) * to[tuple(min(max(b + o, 0), m) for b, o, m in zip(low, corner, (1, 1, 2), strict=True))][n]
            for corner in np.ndindex(2, 2, 2))
    out = stencil.clahe(spark.createDataFrame([(1, *at, n) for at, n in v.items()], "scan_id long, z int, y int, x int, v int"), tile, clip, bins)
    assert "Broadcast" not in plan_of(out) and "sequence" not in plan_of(out)
    got = {(r.z, r.y, r.x): r.v for r in out.collect()}
    assert got.keys() == expected.keys() and all(abs(got[at] - expected[at]) <= 0.5 + 1e-9 for at in got)


def test_li_rounds_end_when_settled(spark):
    from osteon.operators.thresholds import threshold_li

    rng = np.random.default_rng(2)
    rows = [(s, i, 0, 0, int(v)) for s in range(3) for i, v in enumerate(np.concatenate([rng.normal(40, 9, 300), rng.normal(150, 20, 100 * (s + 1))]))]
    voxels = spark.createDataFrame(rows, "scan_id int, z int, y int, x int, v int")
    few, many = ({r.scan_id: r.threshold for r in threshold_li(voxels, n).collect()} for n in (64, 10**6))  # a million sums over the histogram take minutes
    assert few == many and all(40 < t < 150 for t in few.values())


def test_greedy_choice_needs_no_pairs(spark):
    rng = np.random.default_rng(8)
    at = np.concatenate([rng.normal(0, 0.6, (60, 3)).round(2), rng.normal(0, 0.05, (40, 3)).round(2), np.arange(8)[:, None] * [0.25, 0.5, 0.0], [[np.nan, 0, 0], [0, np.inf, 0], [1e17, 0, 0], [1e17, 0, 0]]])
    rows = [(i, *map(float, p), None if i % 37 == 5 else float(round(abs(p[0]), 1))) for i, p in enumerate(at)] + [(999, None, 0.0, 0.0, 1.0)]
    nodes = spark.createDataFrame(rows, "id long, x double, y double, z double, variance double")
    ids = lambda df: sorted(r.id for r in df.collect())
    expected = ids(graph.greedy_decorrelate(nodes, spatial.radius_pairs(nodes.where("abs(x) < 1e9 and abs(y) < 1e9"), 0.5)))
    assert ids(graph.greedy_apart(nodes, 0.5)) == sorted(set(expected) - {len(at) - 1})  # the two farthest are in one place
    crowd = spark.range(200_000).selectExpr("id", "id % 1000 / 1e4 as x", "id % 777 / 1e4 as y", "0.0 as z", "id % 500 / 1.0 as variance")  # 20 billion pairs
    assert ids(graph.greedy_apart(crowd, 0.5)) == [499]


def test_hd95_of_small_volumes_shuffles_no_neighbours(spark, monkeypatch):
    """Volumes of one block are settled in it; in larger ones only cells with nothing within the halo go to nearest_point."""
    from osteon.operators import evaluate

    rng = np.random.default_rng(21)
    asked, near = [], evaluate.nearest_point
    monkeypatch.setattr(evaluate, "nearest_point", lambda p, *a, **b: asked.append(p.count()) or near(p, *a, **b))
    sets = {}
    for s, shape in enumerate([(4, 4, 4), (6, 3, 5), (4, 4, 4), (70, 5, 40), (50, 2, 2)]):
        box = list(np.ndindex(shape))
        sets[s] = [[tuple(int(c) - 3 for c in box[i]) for i in rng.choice(len(box), n, replace=False)] for n in (len(box) // 3, len(box) // 5)]
    sets[4] = [[(0, 0, 0), (1, 0, 0), (30, 1, 0)], [(49, 0, 1)]]
    sets[5] = [[(0, 0, 0)], []]
    sets[6] = [[(0, 0, 0), (80, 0, 0)], []]
    frame = lambda k, twice: spark.createDataFrame([(s, *c, 1 + n) for s, m in sets.items() for c in m[k] for n in range(twice)] + [(7, 0, 0, 0, 0)], "scan_id long, z int, y int, x int, label int")
    expected = {5: None, 6: None, 7: None}
    for s in range(5):
        p, t = (np.array(m, float) for m in sets[s])
        d = np.sqrt(((p[:, None] - t) ** 2).sum(2))
        expected[s] = 0.5 * max(np.percentile(d.min(1), 95), np.percentile(d.min(0), 95))
    got = {r.scan_id: r.hd95 for r in evaluate.hd95(frame(0, 2), frame(1, 1), 0.5).collect()}
    assert got.keys() == expected.keys() and all(got[s] is None if e is None else abs(got[s] - e) < 1e-9 for s, e in expected.items())
    assert sum(asked) == 6  # four cells of volume 4 and two of volume 6
    asked.clear()
    small = [m.where("scan_id < 3") for m in (frame(0, 1), frame(1, 1))]
    assert evaluate.hd95(*small, 0.5).count() == 3 and not asked


def test_nearest_points_sort_no_pairs_beyond_a_width(spark, monkeypatch):
    """Of the pairs of the 27 cells only those within one width are ranked, and answers stay those of brute force."""
    rng = np.random.default_rng(17)
    at = {h: np.concatenate([rng.uniform(0, 6, (120, 3)), rng.normal(3, 0.2, (60, 3)), [[40.0, 1.0, -9.0 + h]]]) for h in (0, 1)}
    frame = lambda h: spark.createDataFrame([(i, i % 2, *map(float, p)) for i, p in enumerate(at[h])], "id long, g int, x double, y double, z double")
    tables_written, write = [], spatial.written
    monkeypatch.setattr(spatial, "written", lambda df: tables_written.append(write(df)) or tables_written[-1])
    got = {(r.id, r["rank"]): (r.neighbour, round(r.distance, 9)) for r in spatial.nearest_point(frame(0), frame(1), 3, ["g"], width=1.0).collect()}
    far = np.sqrt(((at[0][:, None] - at[1]) ** 2).sum(2))
    for i in range(len(at[0])):
        own = sorted((round(far[i, j], 9), j) for j in range(len(at[1])) if j % 2 == i % 2)[:3]
        assert [got[i, r + 1] for r in range(3)] == [(j, d) for d, j in own]
    ranked = [t for t in tables_written if {"distance", "rank", "want"} <= set(t.columns)]
    assert len(ranked) == 1 and ranked[0].agg(F.max("distance")).first()[0] <= 1.0
