"""Queries on poses, examples, manifests and meshes that complete the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as c, evaluate as e, geometry as g, intensity as i, pose, sets as u, spatial as s
from ..sources import manifests as m
from .intensity_queries import dense, level, masks
from .proxies import edits, points, scans, table, with_tables
from .space_queries import actual, cloud, distances, predicted, probes, subjects, triangles, volume_pairs
from .volume_queries import as_mesh, grid_faces

T = with_tables
XYZ = ("x", "y", "z")


def images(k, d, part):
    """Dims and zoom of the newest image (or mask) of a subject, some of them missing."""
    r = scans(k, d).where(F.col("scan_id") % part != 0)
    return r.select("scan_id", F.array(F.col("dim"), F.col("dim"), F.lit(4) + (F.col("scan_id") % part == 1).cast("int")).alias("dims"), F.col("voxel_size").alias("zoom"))


def known_labels(k, d):
    return table(k, d, "orders").select(F.col("o_custkey").alias("scan_id"), (F.col("o_orderkey") % 5).cast("int").alias("label")).distinct()


def runs(k, d, shift):
    return table(k, d, "lineitem").groupBy(F.col("l_suppkey").alias("scan_id"), F.col("l_linenumber").alias("label")).agg(F.avg(F.col("l_discount") + shift).alias("dice"), F.avg(F.col("l_tax") + shift).alias("iou"))


def paired(k, d):
    p = subjects(k, d)
    return p.withColumns({"tx": -F.col("y") + 1, "ty": F.col("x") + 2, "tz": F.col("z") + 3, "sim": F.lit(1.0)})


QUERIES = {
    "f6_training_eligibility": lambda k, d: c.training_eligibility(scans(k, d), images(k, d, 6), images(k, d, 5)).select("scan_id", F.array_join("issues", ",").alias("issues"), "eligible"),
    "f9_set_flags": lambda k, d: c.set_flags(scans(k, d), scans(k, d).where("scan_id % 4 = 0")).select("scan_id", "flag"),
    "j15_compare_before_after": lambda k, d: c.compare_before_after(runs(k, d, 0.0), runs(k, d, 0.1)),
    "j16_collect_examples": lambda k, d: c.collect_examples(scans(k, d), known_labels(k, d).select("label"), known_labels(k, d)),
    "j17_invalid_subjects": lambda k, d: c.invalid_subjects(table(k, d, "orders").select((F.col("o_custkey") * 2).alias("scan_id")).distinct(), scans(k, d), known_labels(k, d), [0, 1]).select("scan_id", "issue", F.array_join("missing", ",").alias("missing")),
    "a28_cohort_median_spacing": lambda k, d: e.cohort_median_spacing(scans(k, d)),
    "a30_atlas_mean": lambda k, d: e.atlas_mean(dense(k, d), dense(k, d).select("scan_id", "z", "y", "x", F.lit(1.0).alias("ux"), F.lit(0.0).alias("uy"), F.lit(-0.4).alias("uz"))),
    "a31_union_foreground": lambda k, d: pose.union_foreground(dense(k, d), 140),
    "a42_span_summary": lambda k, d: e.span_summary(table(k, d, "events").select(F.col("event_type").alias("span"), F.when(F.col("user_id") % 2 == 0, "train").otherwise("val").alias("phase"), F.coalesce("value", F.lit(0.0)).alias("seconds"))),
    "a5_estimate_background": lambda k, d: pose.estimate_background(dense(k, d), level(k, d, 140), 1.0, 8, least_stride=1),
    "a5_estimate_tissue": lambda k, d: pose.estimate_background(dense(k, d), level(k, d, 150), 1.0, 4, "surrounding_tissue", least_stride=1),
    "g2_crop_voxels": lambda k, d: g.crop_voxels(dense(k, d), dense(k, d).select("scan_id").distinct().withColumns({"pad": F.lit(1), **{f"lo_{a}": F.lit(1) for a in XYZ}, **{f"hi_{a}": F.lit(3) for a in XYZ}}), 9),
    "g8_to_shared_frame": lambda k, d: g.to_shared_frame(subjects(k, d), subjects(k, d).groupBy("scan_id").agg(*[F.min(a).alias(f"s_{a}") for a in XYZ], *[F.lit(0.5).alias(f"r_{a}") for a in XYZ]).withColumn("move", F.col("scan_id") % 2 == 0)),
    "g15_native_voxel_size": lambda k, d: c.native_voxel_size(scans(k, d).withColumn("alignment_previous_voxel_size", F.when(F.col("scan_id") % 3 == 0, 0.5)), scans(k, d).where("scan_id % 2 = 0").select("scan_id", F.lit(0.25).alias("size"))),
    "i8_ransac_rigid": lambda k, d: pose.ransac_rigid(paired(k, d), apart=0.5).select("scan_id", F.round("r21", 6).alias("r21"), F.round("t_z", 6).alias("t_z")),
    "i9_pca_flip_seeds": lambda k, d: pose.pca_flip_seeds(subjects(k, d)).groupBy("scan_id").agg(F.count("*").alias("n")),
    "j4_parallel_distance": lambda k, d: s.parallel_surface_distance(probes(k, d).withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)}), triangles(k, d)),
    "j7_transfer_landmarks": lambda k, d: s.transfer_landmarks(dense(k, d).where("v > 150").select("scan_id", (F.col("z") * 16 + F.col("y") * 4 + F.col("x")).cast("long").alias("id"), *[F.col(a).cast("double").alias(a) for a in XYZ], F.lit("main").alias("type")), dense(k, d).select("scan_id", *XYZ, *[F.lit(1.5).alias(f"u{a}") for a in XYZ])),
    "j19_keep_landmarks_near": lambda k, d: s.keep_landmarks_near(probes(k, d), triangles(k, d)).select("id"),
    "j20_propagate_uv": lambda k, d: s.propagate_uv(cloud(k, d, 1).select(F.col("id").alias("face_id"), *XYZ, F.col("id").alias("uv")), points(k, d).select(F.col("id").alias("face_id"), *XYZ)),
    "p9_saturating_cast": lambda k, d: dense(k, d).select("scan_id", "z", "y", "x", i.saturating_cast(F.col("v") * 2.5 - 100, "uint8").alias("v")),
    "s4_acquisition_log": lambda k, d: m.acquisition_log_kv(table(k, d, "customer").select(F.col("c_nationkey").cast("string").alias("folder"), F.col("c_name").alias("file"), F.concat(F.lit("[Scan]\nName="), F.col("c_name"), F.lit("\nBalance="), F.col("c_acctbal").cast("string")).alias("text"))),
    "s6_frame_manifest": lambda k, d: m.frame_manifest(table(k, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("frame"), (F.col("l_linenumber") - 1).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("u"), F.col("l_partkey").alias("z")), table(k, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("frame")))[0].groupBy("file").agg(F.count("*").alias("n"), F.max("slice").alias("last")),
    "s8_distances_wide": lambda k, d: m.distances_wide(distances(k, d).groupBy("scan_id", "idx").agg(F.max("distance").alias("distance"), F.max("snap_distance").alias("snap_distance")), 3)[0].select("scan_id", F.col("0").alias("d0"), F.col("1").alias("d1"), F.col("2").alias("d2")),
    "s8_distances_wide_all": lambda k, d: m.distances_wide(distances(k, d).groupBy("scan_id", "idx").agg(F.max("distance").alias("distance"), F.max("snap_distance").alias("snap_distance")), 12)[0].select("scan_id", *[F.col(f"{i}").alias(f"d{i}") for i in range(12)]),
    "u3_unique_faces": lambda k, d: u.unique_faces(u.nondegenerate_faces(grid_faces(k, d).union(grid_faces(k, d).select("mesh_id", F.col("face_id") + 100000, "c", "a", "b")))).select("mesh_id", "face_id"),
    "u3_referenced_vertices": lambda k, d: u.referenced_vertices(as_mesh(k, d), grid_faces(k, d)).select("mesh_id", "vertex_id"),
    "u4_union_canvas": lambda k, d: u.union_canvas(e.mask_bbox(masks(k, d)), 2),
    "x1_run_metric": lambda k, d: pose.run_metric("local_ncc", points=volume_pairs(k, d, 0).where("v > 160").select(F.col("pair").alias("scan_id"), (F.col("z") * 16 + F.col("y") * 4 + F.col("x")).alias("id"), *XYZ), subject=volume_pairs(k, d, 1).withColumnRenamed("pair", "scan_id"), reference=volume_pairs(k, d, 0).withColumnRenamed("pair", "scan_id"), r=1).select("scan_id", "vertex_id", "metric", "value"),
}

_RUNS = "b AS (SELECT l_suppkey AS scan_id, l_linenumber AS label, avg(l_discount) AS dice, avg(l_tax) AS iou, avg(l_discount + 0.1::DOUBLE) AS dice_after, avg(l_tax + 0.1::DOUBLE) AS iou_after FROM lineitem GROUP BY ALL)"
_KNOWN = "known AS (SELECT DISTINCT o_custkey AS scan_id, (o_orderkey % 5)::INT AS label FROM orders)"
_STRIP = "l AS (SELECT cohort AS mesh_id, id AS a, lead(id) OVER w AS b, lead(id, 2) OVER w AS c FROM points WINDOW w AS (PARTITION BY cohort ORDER BY id)), f AS (SELECT * FROM l WHERE c IS NOT NULL AND a % 7 <> 0 AND b % 7 <> 0)"

SQL = {
    "f9_set_flags": T("scans") + " SELECT scan_id, CASE WHEN scan_id % 4 = 0 THEN NOT flag ELSE flag END AS flag FROM scans",
    "j15_compare_before_after": f"WITH {_RUNS} SELECT scan_id, label, dice, dice_after, dice_after - dice AS gain, iou, iou_after FROM b",
    "j16_collect_examples": T("scans") + f", {_KNOWN} SELECT s.scan_id, l.label FROM scans s, (SELECT DISTINCT label FROM known) l WHERE s.scan_id NOT IN (SELECT scan_id FROM known) OR EXISTS (SELECT 1 FROM known k WHERE k.scan_id = s.scan_id AND k.label = l.label)",
    "a28_cohort_median_spacing": T("scans") + " SELECT median(round_even(voxel_size, 4)) AS spacing FROM scans WHERE NOT faulty AND NOT (is_mesh AND NOT voxelized)",
    "a30_atlas_mean": T("dense") + ", m AS (SELECT z, y, x, avg(v) AS v FROM dense GROUP BY ALL) SELECT a.z, a.y, a.x, b.v FROM m a JOIN m b ON b.x = a.x - 1 AND b.y = a.y AND b.z = a.z",
    "a42_span_summary": "WITH s AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'val' END AS phase, event_type AS span, sum(coalesce(value, 0)) AS seconds FROM events GROUP BY ALL) SELECT phase, span, seconds, 100 * seconds / sum(seconds) OVER () AS percent, sum(seconds) OVER (PARTITION BY phase) AS phase_seconds FROM s",
    "g2_crop_voxels": T("dense") + " SELECT s.scan_id, a::INT AS z, b::INT AS y, c::INT AS x, CASE WHEN d.v IS NULL OR a NOT IN (1, 2) OR b NOT IN (1, 2) OR c NOT IN (1, 2) THEN 9 ELSE d.v END AS v FROM (SELECT DISTINCT scan_id FROM dense) s, range(4) p(a), range(4) q(b), range(4) r(c) LEFT JOIN dense d ON d.scan_id = s.scan_id AND d.z = a AND d.y = b AND d.x = c",
    "g8_to_shared_frame": T("points") + " SELECT cohort AS scan_id, id, " + ", ".join(f"{a} + CASE WHEN cohort % 2 = 0 THEN min({a}) OVER w - 0.5::DOUBLE ELSE 0 END AS {a}" for a in XYZ) + " FROM points WINDOW w AS (PARTITION BY cohort)",
    "g15_native_voxel_size": T("scans") + " SELECT scan_id, CASE WHEN scan_id % 3 = 0 THEN 0.5::DOUBLE WHEN scan_id % 2 = 0 THEN 0.25::DOUBLE ELSE voxel_size END AS voxel_size FROM scans",
    "i8_ransac_rigid": T("points") + " SELECT DISTINCT cohort AS scan_id, 1.0::DOUBLE AS r21, 3.0::DOUBLE AS t_z FROM points",
    "i9_pca_flip_seeds": T("points") + " SELECT DISTINCT cohort AS scan_id, 4::BIGINT AS n FROM points",
    "j20_propagate_uv": T("points") + " SELECT a.id AS face_id, b.id AS uv FROM points a JOIN points b ON b.id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY (a.id = b.id) DESC, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), b.id) = 1",
    "p9_saturating_cast": T("dense") + " SELECT scan_id, z, y, x, least(greatest(round_even(v * 2.5::DOUBLE - 100, 0), 0), 255)::INT AS v FROM dense",
    "s6_frame_manifest": "SELECT l_suppkey AS file, count(*) AS n, (count(*) - 1)::INT AS last FROM lineitem WHERE l_linenumber = 1 GROUP BY 1",
    "s8_distances_wide": "SELECT o_custkey AS scan_id, " + ", ".join(f"max(CASE WHEN o_orderkey % 12 = {i} THEN o_totalprice / 1e6 END) AS d{i}" for i in range(3)) + " FROM orders GROUP BY 1",
    "s8_distances_wide_all": "SELECT o_custkey AS scan_id, " + ", ".join(f"max(CASE WHEN o_orderkey % 12 = {i} THEN o_totalprice / 1e6 END) AS d{i}" for i in range(12)) + " FROM orders GROUP BY 1",
    "u3_unique_faces": T("points") + f", {_STRIP} SELECT mesh_id, a AS face_id FROM f",
    "u3_referenced_vertices": T("points") + f", {_STRIP} SELECT mesh_id, a AS vertex_id FROM f UNION SELECT mesh_id, b FROM f UNION SELECT mesh_id, c FROM f",
}
