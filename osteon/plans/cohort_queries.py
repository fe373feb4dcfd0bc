"""Queries on subjects and edits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as c
from .proxies import edits, scans, with_tables

T = with_tables


def history(spark, sf_dir):
    e = edits(spark, sf_dir)
    return e.select("scan_id", F.col("kind").alias("edit"), F.col("edit_number").alias("seq"), F.when(F.col("has_mask"), None).otherwise(F.col("edit_number") * 1.5).alias("threshold"))


QUERIES = {
    "f1_flag_filter": lambda s, d: c.flag_filter(scans(s, d), "only").select("scan_id", "name"),
    "f2_drop_faulty": lambda s, d: c.drop_faulty(scans(s, d)).select("scan_id"),
    "f3_split_voxel_mesh": lambda s, d: c.split_voxel_mesh(scans(s, d))[1].select("scan_id"),
    "f4_drop_linked_children": lambda s, d: c.drop_linked_children(scans(s, d)).select("scan_id"),
    "f5_eligible_batch": lambda s, d: c.eligible_batch(scans(s, d), edits(s, d), "crop", flags="exclude"),
    "f5_eligibility_summary": lambda s, d: c.eligibility_summary(c.eligible_batch(scans(s, d), edits(s, d), "crop", needs="elastic")),
    "f7_needs_backfill": lambda s, d: c.needs_backfill(scans(s, d), edits(s, d), scans(s, d).where("scan_id % 5 = 0")).select("scan_id"),
    "f8_clear_orphan_settings": lambda s, d: c.clear_orphan_settings(scans(s, d), edits(s, d), {"threshold": "smooth", "elastic_to": "elastic"}).select("scan_id", "threshold", "elastic_to"),
    "w1_latest_edit_first_gap": lambda s, d: c.latest_edit_first_gap(edits(s, d).where("edit_number <> 7")),
    "w1_next_edit_number": lambda s, d: c.next_edit_number(scans(s, d), edits(s, d)),
    "w2_latest_edit_max": lambda s, d: c.latest_edit_max(edits(s, d), exclude_elastic=True),
    "w3_latest_with_mask": lambda s, d: c.latest_with_mask(edits(s, d)),
    "w4_threshold_history": lambda s, d: c.current_thresholds(history(s, d)),
    "w17_keep_newest": lambda s, d: c.keep_newest_per_group(edits(s, d), ["scan_id"], "edit_number").select("scan_id", "edit_number"),
    "w23_retained_edits": lambda s, d: c.retained_edits(edits(s, d)).select("scan_id", "edit_number", "kind"),
    "j10_link_groups": lambda s, d: c.link_groups(scans(s, d)).select("main", F.array_join("members", ",").alias("members")),
    "j11_same_shape_siblings": lambda s, d: c.same_shape_siblings(scans(s, d)),
    "j12_discover_elastic": lambda s, d: c.discover_elastic(scans(s, d), edits(s, d), "atlas"),
    "j18_threshold_for_edit": lambda s, d: c.threshold_for_edit(edits(s, d), c.current_thresholds(history(s, d).withColumn("edit", F.col("seq"))), scans(s, d)),
    "g16_voxel_size_for_edit": lambda s, d: c.voxel_size_for_edit(scans(s, d).withColumn("previous", F.col("voxel_size") * 2), edits(s, d), "previous"),
    "g18_classify_spacing": lambda s, d: c.classify_spacing(scans(s, d).select("scan_id", F.col("voxel_size").alias("sx"), F.col("voxel_size").alias("sy"), (F.col("voxel_size") * (1 + F.col("scan_id") % 3 * 0.05 + F.col("scan_id") % 2 * 0.2)).alias("sz"), F.col("dim").alias("nx"), F.col("dim").alias("ny"), F.col("dim").alias("nz"))),
}

_SKIP = "CASE WHEN faulty THEN 'faulty' WHEN is_mesh AND NOT voxelized THEN 'mesh' WHEN linked_to IS NOT NULL AND linked_to <> scan_id THEN 'linked child'"
_HISTORY = "h AS (SELECT scan_id, kind AS edit, edit_number AS seq, CASE WHEN NOT has_mask THEN edit_number * 1.5 END::DOUBLE AS threshold FROM edits)"
_ALIVE = """, d AS (SELECT *, sum(CASE WHEN threshold IS NULL THEN -1 ELSE 1 END) OVER w AS depth FROM h WINDOW w AS (PARTITION BY scan_id, edit ORDER BY seq)),
    a AS (SELECT *, min(depth) OVER (PARTITION BY scan_id, edit ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM d),
    t AS (SELECT scan_id, edit, arg_max(round_even(threshold, 0)::INT, seq) AS threshold FROM a WHERE threshold IS NOT NULL AND (later IS NULL OR later >= depth) GROUP BY ALL)"""

SQL = {
    "f1_flag_filter": T("scans") + " SELECT scan_id, name FROM scans WHERE flag",
    "f2_drop_faulty": T("scans") + " SELECT scan_id FROM scans WHERE NOT coalesce(faulty, false)",
    "f3_split_voxel_mesh": T("scans") + " SELECT scan_id FROM scans WHERE is_mesh AND NOT voxelized",
    "f4_drop_linked_children": T("scans") + " SELECT scan_id FROM scans WHERE linked_to IS NULL OR linked_to = scan_id",
    "f5_eligible_batch": T("scans", "edits") + f", r AS (SELECT scan_id, {_SKIP} WHEN flag THEN 'flag' WHEN scan_id IN (SELECT scan_id FROM edits WHERE kind = 'crop') THEN 'already has edit' END AS skip_reason FROM scans) SELECT scan_id, skip_reason IS NULL AS keep, skip_reason FROM r",
    "f5_eligibility_summary": T("scans", "edits") + f", r AS (SELECT {_SKIP} WHEN scan_id IN (SELECT scan_id FROM edits WHERE kind = 'crop') THEN 'already has edit' WHEN scan_id NOT IN (SELECT scan_id FROM edits WHERE kind = 'elastic') THEN 'missing edit' ELSE 'kept' END AS reason FROM scans) SELECT reason, count(*) AS n FROM r GROUP BY 1",
    "f7_needs_backfill": T("scans", "edits") + " SELECT scan_id FROM scans WHERE elastic_to IS NOT NULL AND NOT (is_mesh AND NOT voxelized) AND threshold IS NOT NULL AND scan_id % 5 <> 0 AND scan_id IN (SELECT scan_id FROM edits WHERE kind = 'elastic')",
    "f8_clear_orphan_settings": T("scans", "edits") + " SELECT scan_id, CASE WHEN scan_id IN (SELECT scan_id FROM edits WHERE kind = 'smooth') THEN threshold END AS threshold, CASE WHEN scan_id IN (SELECT scan_id FROM edits WHERE kind = 'elastic') THEN elastic_to END AS elastic_to FROM scans",
    "w1_latest_edit_first_gap": T("edits") + " SELECT scan_id, least(max(edit_number), 6)::INT AS latest FROM edits GROUP BY 1",
    "w1_next_edit_number": T("scans", "edits") + " SELECT s.scan_id, (coalesce(max(edit_number), -1) + 1)::INT AS next FROM scans s LEFT JOIN edits e ON s.scan_id = e.scan_id GROUP BY 1",
    "w2_latest_edit_max": T("edits") + " SELECT scan_id, max(edit_number) AS latest, arg_max(kind, edit_number) AS kind FROM edits WHERE kind <> 'elastic' GROUP BY 1",
    "w3_latest_with_mask": T("edits") + " SELECT scan_id, edit_number, kind, has_mask FROM edits WHERE kind <> 'elastic' QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY has_mask DESC, edit_number DESC) = 1",
    "w4_threshold_history": T("edits") + ", " + _HISTORY + _ALIVE + " SELECT scan_id, edit, threshold FROM t",
    "w17_keep_newest": T("edits") + " SELECT scan_id, edit_number FROM edits QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY edit_number DESC) <= 3",
    "w23_retained_edits": T("edits") + ", m AS (SELECT *, max(CASE WHEN kind = 'elastic' THEN edit_number END) OVER (PARTITION BY scan_id) AS last FROM edits) SELECT scan_id, edit_number, kind FROM m WHERE edit_number = 0 OR edit_number IN (last, last - 1)",
    "j10_link_groups": T("scans") + ", g AS (SELECT linked_to AS main, list(DISTINCT scan_id ORDER BY scan_id) AS l FROM scans WHERE linked_to IS NOT NULL GROUP BY 1) SELECT main, CASE WHEN len(list_distinct(list_append(l, main))) >= 2 THEN array_to_string(list_prepend(main, list_filter(l, lambda x: x <> main)), ',') END AS members FROM g",
    "j11_same_shape_siblings": T("scans") + " SELECT a.scan_id, b.scan_id AS sibling FROM scans a JOIN scans b ON a.linked_to = b.linked_to AND a.dim = b.dim AND a.scan_id <> b.scan_id",
    "j12_discover_elastic": T("scans", "edits") + " SELECT e.scan_id, edit_number, is_mesh AND NOT voxelized AS mesh FROM edits e JOIN scans s ON e.scan_id = s.scan_id WHERE kind = 'elastic' AND coalesce(elastic_to, 'atlas') = 'atlas' QUALIFY row_number() OVER (PARTITION BY e.scan_id ORDER BY edit_number DESC) = 1",
    "j18_threshold_for_edit": T("scans", "edits") + ", h AS (SELECT scan_id, edit_number AS edit, edit_number AS seq, CASE WHEN NOT has_mask THEN edit_number * 1.5 END::DOUBLE AS threshold FROM edits)" + _ALIVE + " SELECT e.scan_id, e.edit_number, coalesce(t.threshold, s.threshold) AS threshold FROM edits e LEFT JOIN t ON t.scan_id = e.scan_id AND t.edit = e.edit_number LEFT JOIN scans s ON s.scan_id = e.scan_id",
    "g16_voxel_size_for_edit": T("scans", "edits") + ", f AS (SELECT scan_id, min(edit_number) AS first FROM edits WHERE kind = 'aligned' GROUP BY 1) SELECT e.scan_id, e.edit_number, CASE WHEN edit_number < first THEN voxel_size * 2 ELSE voxel_size END AS voxel_size FROM edits e JOIN scans s ON s.scan_id = e.scan_id LEFT JOIN f ON f.scan_id = e.scan_id",
    "g18_classify_spacing": T("scans") + ", p AS (SELECT scan_id, dim, voxel_size AS low, voxel_size * (1 + (scan_id % 3) * 0.05::DOUBLE + (scan_id % 2) * 0.2::DOUBLE) AS high FROM scans) SELECT scan_id, CASE WHEN high <= low * 1.001::DOUBLE THEN 'isotropic' WHEN high > low * 1.1::DOUBLE THEN 'registration' ELSE 'resample' END AS kind, low AS target, dim AS out_x, dim AS out_y, greatest(round_even(dim * high / low, 0), 1)::INT AS out_z FROM p",
}
