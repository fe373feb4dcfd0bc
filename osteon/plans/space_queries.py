"""Queries on points, meshes, distances and measures, with their SQL by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as e, geometry as g, sets as u, spatial as s
from .intensity_queries import dense, masks
from .proxies import points, table, with_tables

T = with_tables
XYZ = ("x", "y", "z")


def cloud(k, d, part):
    """Points of even (0) or odd (1) id, with cohort as their group."""
    return points(k, d).where(F.col("id") % 2 == part)


def subjects(k, d):
    """Points as landmarks of scans: scan_id is the cohort."""
    return points(k, d).select(F.col("cohort").alias("scan_id"), "id", *XYZ)


def probes(k, d):
    """Points of even id, moved off the corners of their own triangles."""
    return cloud(k, d, 0).withColumns({"x": F.col("x") - 0.15, "y": F.col("y") + 0.1, "z": F.col("z") + 0.3})


def triangles(k, d):
    """A triangle at each point, with two corners beside it; mesh_id is the cohort."""
    p = points(k, d)
    return p.select(
        F.col("cohort").alias("mesh_id"), F.col("id").alias("face_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"),
        (F.col("x") + 1).alias("bx"), F.col("y").alias("by"), (F.col("z") + 0.5).alias("bz"), F.col("x").alias("cx"), (F.col("y") + 1).alias("cy"), (F.col("z") - 0.5).alias("cz"))


def predicted(k, d):
    return dense(k, d).where("v > 120").select("scan_id", "z", "y", "x", (1 + F.col("v") % 2).alias("label"))


def actual(k, d):
    return dense(k, d).where("v > 126").select("scan_id", "z", "y", "x", (1 + F.col("v") % 2).alias("label"))


def volume_pairs(k, d, shift):
    """Volumes numbered in pairs: 2 i and 2 i + 1."""
    return dense(k, d).where(F.col("scan_id") % 2 == shift).select(F.floor(F.col("scan_id") / 2).alias("pair"), "z", "y", "x", "v")


def distances(k, d):
    """Landmark distances from orders: scan_id, idx, distance, snap_distance."""
    o = table(k, d, "orders")
    return o.select(F.col("o_custkey").alias("scan_id"), (F.col("o_orderkey") % 12).alias("idx"), (F.col("o_totalprice") / 1e6).alias("distance"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") / 2e6).alias("snap_distance"))


def values(k, d):
    """Per-vertex values from line items: scan_id, vertex_id, value."""
    return table(k, d, "lineitem").select(F.col("l_suppkey").alias("scan_id"), (F.col("l_partkey") % 500).alias("vertex_id"), F.when(F.col("l_linenumber") == 7, float("nan")).otherwise(F.col("l_quantity")).alias("value"))


PLANES = [(0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0, 0.6, 0.8)]
TURN = [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]


def boxes(k, d):
    return subjects(k, d).select("scan_id").distinct().withColumns({"vs": F.lit(0.5), "pad": F.lit(2), **{f"lo_{a}": F.lit(-2) for a in XYZ}, **{f"hi_{a}": F.lit(2) for a in XYZ}})


QUERIES = {
    "g1_crop_landmarks": lambda k, d: g.crop_landmarks(subjects(k, d), boxes(k, d)),
    "g5_scale_mm_assets": lambda k, d: g.scale_mm_assets(subjects(k, d), boxes(k, d).select("scan_id", F.lit(0.02).alias("old"), (F.lit(0.02) + F.col("scan_id") * 0.01).alias("new"))),
    "g6_scale_about_center": lambda k, d: g.scale_about_center(subjects(k, d), (1.0, 2.0, 3.0), 5.0, 4.0),
    "g7_mesh_reference_prism": lambda k, d: g.mesh_reference_prism(subjects(k, d), 0.25, 0.5),
    "g9_crop_reorigin": lambda k, d: g.crop_reorigin(subjects(k, d), subjects(k, d).groupBy("scan_id").agg(*[F.min(a).alias(f"min_{a}") for a in XYZ]), 1.5),
    "g10_wedge_select": lambda k, d: g.wedge_select(subjects(k, d), [("isolate", PLANES), ("delete", [(1.0, 1.0, 0.0, 1.0, 1.0, 0.0)])]),
    "g11_classify_faces": lambda k, d: g.classify_faces(triangles(k, d), PLANES),
    "g12_clip_boundary_faces": lambda k, d: g.face_normals(g.clip_boundary_faces(triangles(k, d), PLANES).withColumn("face_id", F.col("face_id") * 100 + F.col("part"))).groupBy("mesh_id").agg(F.sum("area").alias("area")),
    "g13_face_normals": lambda k, d: g.face_normals(triangles(k, d)),
    "g14_rasterize_points": lambda k, d: g.rasterize_points(subjects(k, d), 0.75),
    "g17_affine_field": lambda k, d: g.affine_field(dense(k, d).select("scan_id", "z", "y", "x"), [[1.1, 0.0, 0.0], [0.0, 0.9, 0.2], [0.0, -0.2, 1.0]], [0.5, -0.5, 1.0]),
    "g19_rotate_about_center": lambda k, d: g.rotate_about_center(subjects(k, d), TURN, (1.0, 0.0, -1.0)),
    "j1_nearest_point": lambda k, d: s.nearest_point(cloud(k, d, 0), cloud(k, d, 1)),
    "j1_nearest_three_by_cohort": lambda k, d: s.nearest_point(cloud(k, d, 0), cloud(k, d, 1), 3, ["cohort"]),
    "j2_surface_distance": lambda k, d: s.surface_distance(probes(k, d), triangles(k, d)).select("id", "distance"),
    "j3_snap_landmarks": lambda k, d: s.snap_landmarks(probes(k, d), triangles(k, d), 0.5).select("id", "snap_distance"),
    "j5_knn_propagate": lambda k, d: s.knn_propagate(cloud(k, d, 0), cloud(k, d, 1).withColumns({"ux": F.col("y"), "uy": F.col("z"), "uz": F.col("x")})),
    "j6_sample_field": lambda k, d: s.sample_field(dense(k, d).where("v > 150").select("scan_id", (F.col("z") * 16 + F.col("y") * 4 + F.col("x")).cast("long").alias("id"), *[(F.col(a) + 0.25).alias(a) for a in XYZ]), dense(k, d).select("scan_id", *XYZ, *[(F.col("v") / n).alias(f"u{a}") for n, a in zip((100, 200, 300), XYZ, strict=True)])),
    "j8_transfer_mask": lambda k, d: s.transfer_mask(masks(k, d), dense(k, d).select("scan_id", *XYZ, F.lit(0.8).alias("ux"), F.lit(-0.3).alias("uy"), F.lit(0.0).alias("uz"))),
    "j9_resize_mask": lambda k, d: s.grow_mask(s.shrink_mask(masks(k, d), 2), 2, (4, 4, 3)).select("scan_id", "z", "y", "x", "label"),
    "j13_map_to_display": lambda k, d: s.map_to_display(cloud(k, d, 0), cloud(k, d, 1).withColumn("value", F.col("x") * 2), 1.0)[0],
    "j14_mutual_matches": lambda k, d: s.mutual_matches(*[table(k, d, "embeddings").where(F.col("vec_id") % 2 == h).select((F.col("vec_id") % 20 - h).alias("pair"), F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("vector")) for h in (0, 1)], least=0.1),
    "j21_radius_pairs": lambda k, d: s.radius_pairs(points(k, d), 0.6),
    "a17_mask_bbox": lambda k, d: e.mask_bbox(masks(k, d)),
    "a18_centroid_size": lambda k, d: e.centroid_size(subjects(k, d)),
    "a18_scale_factor": lambda k, d: e.scale_factor(subjects(k, d), 0),
    "a19_landmark_summary": lambda k, d: e.landmark_summary(distances(k, d), 0.05),
    "a20_surface_metric": lambda k, d: e.surface_metric(distances(k, d), 0.03),
    "a21_union_mask_ncc": lambda k, d: e.union_mask_ncc(volume_pairs(k, d, 0), volume_pairs(k, d, 1), 128),
    "a22_overlap_metrics": lambda k, d: e.overlap_metrics(predicted(k, d), actual(k, d)),
    "a23_hd95": lambda k, d: e.hd95(predicted(k, d).where("x < 3"), actual(k, d), 0.5),
    "a24_aggregate_metrics": lambda k, d: e.aggregate_metrics(distances(k, d), ["distance", "snap_distance"]),
    "a25_pair_score": lambda k, d: e.pair_score(*[volume_pairs(k, d, h).withColumn("v", (F.col("v") - 120) / 10) for h in (0, 1)], least=10),
    "a26_population_mean": lambda k, d: e.population_mean(values(k, d))[0],
    "a27_region_distribution": lambda k, d: e.region_distribution(values(k, d).where("NOT isnan(value)"), values(k, d).where("vertex_id < 40")),
    "a29_kabsch_batch": lambda k, d: e.kabsch_batch(g.rotate_about_center(subjects(k, d).withColumns({f"t{a}": F.col(a) for a in XYZ}), TURN, (0.0, 0.0, 0.0)), scaled=True).select("scan_id", "n", *[F.round(c, 6).alias(c) for c in e.POSE[2:]]),
    "a32_robust_inliers": lambda k, d: e.robust_inliers(distances(k, d).groupBy("scan_id", "idx").agg(F.avg("distance").alias("distance")).withColumn("outer", F.lit(0.3)), 0.03),
    "a33_pose_score": lambda k, d: e.pose_score(distances(k, d), 0.03),
    "a34_rank_poses": lambda k, d: e.rank_poses(table(k, d, "lineitem").select(F.col("l_suppkey").alias("scan_id"), (F.col("l_orderkey") * 10_000 + F.col("l_partkey")).alias("pose"), (F.col("l_discount") * 10).alias("fixed_recall"), F.col("l_quantity").alias("iou"), F.col("l_extendedprice").alias("ncc"))),
    "a35_scale_outlier_groups": lambda k, d: e.scale_outlier_groups(table(k, d, "customer").select(F.col("c_custkey").alias("scan_id"), F.col("c_nationkey").alias("grp"), F.abs("c_acctbal").alias("size"))),
    "a36_tissue_extent": lambda k, d: e.tissue_extent(dense(k, d), "z", 0.9),
    "a37_middle_slab": lambda k, d: e.middle_slab(masks(k, d), 1),
    "a38_slice_bbox": lambda k, d: e.slice_bbox(masks(k, d), 1, (4, 4), 1),
    "a39_majority_vote": lambda k, d: e.majority_vote(dense(k, d).select(F.floor(F.col("scan_id") / 3).alias("scan_id"), (F.col("scan_id") % 3).alias("view"), "z", "y", "x", "v").where("v > 128")),
    "a41_projection_sum": lambda k, d: e.projection_sum(dense(k, d)),
    "a44_cohort_snap_distance": lambda k, d: e.cohort_snap_distance(distances(k, d)),
    "a45_upload_mismatch": lambda k, d: e.upload_mismatch(distances(k, d), 0.05),
    "u1_union_labels": lambda k, d: u.union_labels(masks(k, d), [1, 3]),
    "u2_mask_union": lambda k, d: u.mask_union(predicted(k, d).where("x = 1"), actual(k, d).where("y = 2")),
    "u2_mask_intersect": lambda k, d: u.mask_intersect(predicted(k, d), actual(k, d)),
    "u2_mask_except": lambda k, d: u.mask_except(predicted(k, d), actual(k, d)),
    "u4_paste_on_canvas": lambda k, d: u.paste_on_canvas(dense(k, d), dense(k, d).where("x < 2").withColumn("v", F.lit(7)), (1, 0, 2), (4, 4, 4)),
}

_SUBJECTS = "subjects AS (SELECT cohort AS scan_id, id, x, y, z FROM points)"
_TRI = "tri AS (SELECT cohort AS mesh_id, id AS face_id, x AS ax, y AS ay, z AS az, x + 1 AS bx, y AS \"by\", z + 0.5::DOUBLE AS bz, x AS cx, y + 1 AS cy, z - 0.5::DOUBLE AS cz FROM points)"
_DIST = "WITH dist AS (SELECT o_custkey AS scan_id, o_orderkey % 12 AS idx, o_totalprice / 1e6 AS distance, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 2e6 END AS snap_distance FROM orders)"
_VALUES = "WITH vals AS (SELECT l_suppkey AS scan_id, l_partkey % 500 AS vertex_id, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS value FROM lineitem)"
_MASKS = "masks AS (SELECT scan_id, z, y, x, 1 + v % 3 AS label FROM dense WHERE v > 128)"
_PRED = "pred AS (SELECT scan_id, z, y, x, 1 + v % 2 AS label FROM dense WHERE v > 120), act AS (SELECT scan_id, z, y, x, 1 + v % 2 AS label FROM dense WHERE v > 126)"
_PAIRS = "pr AS (SELECT a.scan_id // 2 AS pair, a.v AS f, b.v AS m FROM dense a JOIN dense b ON b.scan_id = a.scan_id + 1 AND a.scan_id % 2 = 0 AND a.z = b.z AND a.y = b.y AND a.x = b.x)"
_NEAR = "near AS (SELECT a.id, a.cohort, b.id AS neighbour, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS distance, b.x AS bx, b.y AS \"by\", b.z AS bz, b.cohort AS other FROM points a JOIN points b ON a.id % 2 = 0 AND b.id % 2 = 1)"
_IN = lambda k: f'("{k}x" >= -1e-7 AND 0.6::DOUBLE * "{k}y" + 0.8::DOUBLE * "{k}z" >= -1e-7)'

SQL = {
    "g1_crop_landmarks": T("points") + f", {_SUBJECTS} SELECT scan_id, id, (x / 0.5::DOUBLE + 4) * 0.5::DOUBLE AS x, (y / 0.5::DOUBLE + 4) * 0.5::DOUBLE AS y, (z / 0.5::DOUBLE + 4) * 0.5::DOUBLE AS z FROM subjects WHERE x >= -1 AND x < 1 AND y >= -1 AND y < 1 AND z >= -1 AND z < 1",
    "g5_scale_mm_assets": T("points") + f", {_SUBJECTS} SELECT scan_id, id, x * f AS x, y * f AS y, z * f AS z FROM (SELECT *, (0.02::DOUBLE + scan_id * 0.01::DOUBLE) / 0.02::DOUBLE AS f FROM subjects)",
    "g6_scale_about_center": T("points") + f", {_SUBJECTS} SELECT scan_id, id, 1 + 1.25::DOUBLE * (x - 1) AS x, 2 + 1.25::DOUBLE * (y - 2) AS y, 3 + 1.25::DOUBLE * (z - 3) AS z FROM subjects",
    "g7_mesh_reference_prism": T("points") + f", {_SUBJECTS} SELECT scan_id, " + ", ".join(f"min({a}) - 0.5::DOUBLE AS corner_{a}, greatest(ceil((max({a}) - min({a}) + 1) / 0.25::DOUBLE), 1)::INT AS n_{a}" for a in XYZ) + " FROM subjects GROUP BY 1",
    "g9_crop_reorigin": T("points") + f", {_SUBJECTS} SELECT scan_id, id, " + ", ".join(f"{a} + 1.5::DOUBLE - min({a}) OVER w AS {a}" for a in XYZ) + " FROM subjects WINDOW w AS (PARTITION BY scan_id)",
    "g10_wedge_select": T("points") + f", {_SUBJECTS} SELECT * FROM subjects WHERE {_IN('')} AND NOT (x - 1 + y - 1 >= -1e-7)",
    "g11_classify_faces": T("points") + f", {_TRI} SELECT mesh_id, face_id, CASE ({' + '.join('CAST(' + _IN(k) + ' AS INT)' for k in 'abc')}) WHEN 3 THEN 'inside' WHEN 0 THEN 'outside' ELSE 'boundary' END AS side FROM tri",
    "g13_face_normals": T("points") + f", {_TRI} SELECT mesh_id, face_id, -0.5::DOUBLE / l AS nx, 0.5::DOUBLE / l AS ny, 1 / l AS nz, l / 2 AS area FROM (SELECT *, sqrt(1.5::DOUBLE) AS l FROM tri)",
    "g14_rasterize_points": T("points") + f", {_SUBJECTS} SELECT DISTINCT scan_id, floor(x / 0.75::DOUBLE + 1e-6)::INT AS x, floor(y / 0.75::DOUBLE + 1e-6)::INT AS y, floor(z / 0.75::DOUBLE + 1e-6)::INT AS z FROM subjects",
    "g17_affine_field": T("dense") + " SELECT scan_id, z, y, x, 1.1::DOUBLE * x + 0.5::DOUBLE - x AS ux, 0.9::DOUBLE * y + 0.2::DOUBLE * z - 0.5::DOUBLE - y AS uy, -0.2::DOUBLE * y + z + 1.0::DOUBLE - z AS uz FROM dense",
    "g19_rotate_about_center": T("points") + f", {_SUBJECTS} SELECT scan_id, id, y + 1 AS x, -(x - 1) AS y, z FROM subjects",
    "j1_nearest_point": T("points") + f", {_NEAR} SELECT id, neighbour, distance, 1 AS rank FROM near QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) = 1",
    "j1_nearest_three_by_cohort": T("points") + f", {_NEAR} SELECT cohort, id, neighbour, distance, (row_number() OVER (PARTITION BY id ORDER BY distance, neighbour))::INT AS rank FROM near WHERE cohort = other QUALIFY rank <= 3",
    "j5_knn_propagate": T("points") + f", {_NEAR}, n AS (SELECT *, 1 / greatest(distance, 1e-10) AS w FROM near QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) <= 4) SELECT n.id, sum(n.w * n.\"by\") / sum(n.w) AS ux, sum(n.w * n.bz) / sum(n.w) AS uy, sum(n.w * n.bx) / sum(n.w) AS uz FROM n GROUP BY 1",
    "j8_transfer_mask": T("dense") + f", {_MASKS} SELECT d.scan_id, d.x, d.y, d.z, m.label FROM dense d JOIN masks m ON m.scan_id = d.scan_id AND m.x = d.x + 1 AND m.y = d.y AND m.z = d.z",
    "j9_resize_mask": T("dense") + f", {_MASKS} SELECT d.scan_id, d.z, d.y, d.x, m.label FROM dense d JOIN masks m ON m.scan_id = d.scan_id AND m.x = d.x // 2 * 2 AND m.y = d.y // 2 * 2 AND m.z = d.z // 2 * 2 WHERE d.z < 3",
    "j13_map_to_display": T("points") + f", {_NEAR} SELECT id, bx * 2 AS value, distance FROM near QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) = 1",
    "j21_radius_pairs": T("points") + " SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS distance FROM points a JOIN points b ON a.id < b.id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 0.6::DOUBLE",
    "a17_mask_bbox": T("dense") + f", {_MASKS} SELECT scan_id, " + ", ".join(f"min({a}) AS lo_{a}, max({a}) AS hi_{a}" for a in "zyx") + " FROM masks GROUP BY 1",
    "a18_centroid_size": T("points") + f", {_SUBJECTS} SELECT scan_id, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS size FROM subjects GROUP BY 1",
    "a18_scale_factor": T("points") + f", {_SUBJECTS}, s AS (SELECT scan_id, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS size FROM subjects GROUP BY 1) SELECT scan_id, (SELECT size FROM s WHERE scan_id = 0) / size AS scale FROM s",
    "a19_landmark_summary": _DIST + " SELECT scan_id, " + ", ".join(f"count({c}) AS {c}_n, avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std, sum(({c} > {m1}::DOUBLE)::INT)::BIGINT AS {c}_over_1, sum(({c} > {m6}::DOUBLE)::INT)::BIGINT AS {c}_over_6" for c in ("distance", "snap_distance") for m1, m6 in ((0.05, 0.30000000000000004),)) + " FROM dist GROUP BY 1",
    "a20_surface_metric": _DIST + " SELECT scan_id, avg((distance > 0.18::DOUBLE)::INT) AS over, 1 - avg((distance > 0.18::DOUBLE)::INT) AS within, avg(distance) AS mean FROM dist GROUP BY 1",
    "a21_union_mask_ncc": T("dense") + f", {_PAIRS} SELECT pair, CASE WHEN count(*) > 1 AND var_pop(f) > 0 AND var_pop(m) > 0 THEN corr(f, m) ELSE 0 END AS ncc FROM pr WHERE f > 128 OR m > 128 GROUP BY 1",
    "a22_overlap_metrics": T("dense") + f", {_PRED}, n AS (SELECT coalesce(p.scan_id, t.scan_id) AS scan_id, coalesce(p.label, t.label) AS label, count(p.scan_id) AS a, count(t.scan_id) AS b, count(CASE WHEN p.scan_id IS NOT NULL THEN t.scan_id END) AS i FROM pred p FULL JOIN act t ON p.scan_id = t.scan_id AND p.z = t.z AND p.y = t.y AND p.x = t.x AND p.label = t.label GROUP BY 1, 2) SELECT scan_id, label, (2 * i + 1e-6) / (a + b + 1e-6) AS dice, (i + 1e-6) / (a + b - i + 1e-6) AS iou FROM n",
    "a23_hd95": T("dense") + f""", {_PRED}, p AS (SELECT * FROM pred WHERE x < 3), one AS (
        SELECT scan_id, z, y, x, d FROM (SELECT p.scan_id, p.z, p.y, p.x, min(sqrt((p.z - t.z) ** 2 + (p.y - t.y) ** 2 + (p.x - t.x) ** 2)) AS d FROM p JOIN act t ON p.scan_id = t.scan_id GROUP BY ALL)),
        two AS (SELECT t.scan_id, t.z, t.y, t.x, min(sqrt((p.z - t.z) ** 2 + (p.y - t.y) ** 2 + (p.x - t.x) ** 2)) AS d FROM p JOIN act t ON p.scan_id = t.scan_id GROUP BY ALL)
        SELECT scan_id, max(q) * 0.5::DOUBLE AS hd95 FROM (SELECT scan_id, quantile_cont(d, 0.95) AS q FROM one GROUP BY 1 UNION ALL SELECT scan_id, quantile_cont(d, 0.95) FROM two GROUP BY 1) GROUP BY 1""",
    "a24_aggregate_metrics": _DIST + " SELECT avg(distance) AS distance, avg(snap_distance) AS snap_distance FROM dist",
    "a26_population_mean": _VALUES + " SELECT vertex_id, avg(coalesce(value, 0)) AS mean FROM vals GROUP BY 1",
    "a27_region_distribution": _VALUES + " SELECT scan_id, avg(value) AS value FROM vals WHERE vertex_id < 40 AND value IS NOT NULL GROUP BY 1",
    "a33_pose_score": _DIST + ", q AS (SELECT scan_id, quantile_cont(distance, 0.5) AS m, quantile_cont(distance, 0.9) AS p90, quantile_cont(distance, 0.95) AS p95 FROM dist GROUP BY 1) SELECT scan_id, any_value(m) + 0.25::DOUBLE * any_value(p90) + 0.1::DOUBLE * any_value(p95) + avg((distance > greatest(0.03::DOUBLE, m))::INT) * greatest(0.03::DOUBLE, any_value(m)) AS score FROM dist JOIN q USING (scan_id) GROUP BY 1",
    "a34_rank_poses": "SELECT l_suppkey AS scan_id, l_orderkey * 10000 + l_partkey AS pose FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC, l_quantity DESC, l_extendedprice DESC) = 1",
    "a35_scale_outlier_groups": "SELECT c_custkey AS scan_id, c_nationkey AS grp, abs(c_acctbal) > 1.5::DOUBLE * median(abs(c_acctbal)) OVER (PARTITION BY c_nationkey) AS apart FROM customer",
    "a36_tissue_extent": T("dense") + ", s AS (SELECT scan_id, z, quantile_cont(v, 0.95) - quantile_cont(v, 0.05) AS span FROM dense GROUP BY ALL), k AS (SELECT * FROM s QUALIFY span >= 0.9::DOUBLE * max(span) OVER (PARTITION BY scan_id)) SELECT scan_id, greatest(min(z) - 1, 0) AS first, least(max(z) + 1, 3) AS last FROM k GROUP BY 1",
    "a37_middle_slab": T("dense") + f", {_MASKS}, s AS (SELECT DISTINCT scan_id, z FROM masks WHERE label = 1), r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY z) - 1 AS i, count(*) OVER (PARTITION BY scan_id) AS n FROM s) SELECT scan_id, z AS slice, i = n // 2 AS centre FROM r WHERE i >= n // 4 AND i < n - n // 4",
    "a38_slice_bbox": T("dense") + f", {_MASKS} SELECT scan_id, z, greatest(min(y) - 1, 0) AS y0, least(max(y) + 1, 3) AS y1, greatest(min(x) - 1, 0) AS x0, least(max(x) + 1, 3) AS x1 FROM masks WHERE label = 1 GROUP BY ALL",
    "a39_majority_vote": T("dense") + " SELECT scan_id // 3 AS scan_id, z, y, x FROM dense WHERE v > 128 GROUP BY ALL HAVING count(*) >= 2",
    "a41_projection_sum": T("dense") + " SELECT scan_id, y, x, sum(v)::BIGINT AS v FROM dense GROUP BY ALL",
    "a44_cohort_snap_distance": _DIST + " SELECT idx, avg(snap_distance) AS mean, count(snap_distance) AS n FROM dist GROUP BY 1",
    "a45_upload_mismatch": _DIST + " SELECT scan_id, avg(distance) > 3 * 0.05::DOUBLE AS mismatch FROM dist GROUP BY 1",
    "u1_union_labels": T("dense") + f", {_MASKS} SELECT scan_id, z, y, x FROM masks WHERE label IN (1, 3)",
    "u2_mask_union": T("dense") + f", {_PRED} SELECT scan_id, z, y, x FROM pred WHERE x = 1 UNION SELECT scan_id, z, y, x FROM act WHERE y = 2",
    "u2_mask_intersect": T("dense") + f", {_PRED} SELECT scan_id, z, y, x FROM pred INTERSECT SELECT scan_id, z, y, x FROM act",
    "u2_mask_except": T("dense") + f", {_PRED} SELECT scan_id, z, y, x FROM pred EXCEPT SELECT scan_id, z, y, x FROM act",
    "u4_paste_on_canvas": T("dense") + " SELECT scan_id, z, y, x, CASE WHEN z >= 1 AND x >= 2 THEN 7 ELSE v END AS v FROM dense",
}
