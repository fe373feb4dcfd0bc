"""Queries on intensities and thresholds, with their SQL. Thresholds are 128 unless said otherwise."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort, intensity as i, thresholds as t
from ..operators.stencil import kernel
from .proxies import dense_voxels, edits, scans, sparse_voxels, with_tables

T = with_tables
CELLS = ["scan_id", "z", "y", "x", "v"]
REFERENCE = 0


def dense(s, d):
    return dense_voxels(s, d).select(*CELLS)


def level(s, d, value=128):
    return dense(s, d).select("scan_id").distinct().withColumn("threshold", F.lit(value))


def offsets(s, d):
    return dense(s, d).groupBy("scan_id").agg((F.col("scan_id") % 7 * 1.5).alias("offset"))


def channels(s, d):
    """Groups of three volumes as the channels of one subject."""
    return dense(s, d).select(F.floor(F.col("scan_id") / 3).alias("scan_id"), "z", "y", "x", "v", (F.col("scan_id") % 3).cast("int").alias("channel"))


def aligned(method, voxels=sparse_voxels, **options):
    def query(s, d):
        batch = cohort.eligible_batch(scans(s, d), edits(s, d), "crop")
        return t.align_thresholds(method, voxels(s, d), batch, **options)

    return query


QUERIES = {
    "x2_align_thresholds_percentile": aligned("percentile", reference=1, value=25.0, sigma=None),
    "x2_align_thresholds_otsu": aligned("otsu", dense),
    "x2_align_thresholds_smoothed_percentile": aligned("percentile", dense, reference=0),
    "x2_align_thresholds_same": aligned("same", dense, reference=0, value=128.0),
    "p1_subtract_background": lambda s, d: i.subtract_background(dense(s, d), offsets(s, d)).select(*CELLS),
    "p2_remove_background": lambda s, d: i.remove_background(dense(s, d), level(s, d)).select(*CELLS),
    "p3_shift_to_reference": lambda s, d: i.shift_to_reference_threshold(dense(s, d), level(s, d).withColumn("threshold", (F.col("scan_id") % 50 + 100).cast("int")), F.lit(128)).select(*CELLS),
    "p4_percentile_normalize": lambda s, d: i.percentile_normalize(dense(s, d), level(s, d))[0].select(*CELLS),
    "p5_tissue_aware_normalize": lambda s, d: i.tissue_aware_normalize(dense(s, d), level(s, d), REFERENCE),
    "p6_match_histogram": lambda s, d: i.match_histogram_foreground(dense(s, d), level(s, d), REFERENCE),
    "p7_min_max_normalize": lambda s, d: i.min_max_normalize(dense(s, d), -1.0, 1.0).select(*CELLS),
    "p8_intensity_maps": lambda s, d: i.compose_intensity_maps(edits(s, d).select("scan_id", F.col("kind").alias("filename"), F.col("edit_number").alias("seq"), F.when(F.col("has_mask"), 2.0).otherwise(1.0).alias("s"), (F.col("edit_number") % 5 - 2.0).alias("o"))),
    "p10_combine_mean": lambda s, d: i.combine_channels(channels(s, d), "mean"),
    "p10_combine_luma": lambda s, d: i.combine_channels(channels(s, d), "luma"),
    "p10_combine_sum": lambda s, d: i.combine_channels(channels(s, d), "sum"),
    "p10_combine_multiply": lambda s, d: i.combine_channels(channels(s, d), "multiply"),
    "p11_mask_out": lambda s, d: i.mask_out(dense(s, d), masks(s, d), [2], invert=True).select(*CELLS),
    "p12_volume_to_uint8": lambda s, d: i.volume_to_uint8(sparse_voxels(s, d).withColumn("v", F.col("v") * 7)).select(*CELLS),
    "p13_fill_speckle_zeros": lambda s, d: i.fill_speckle_zeros(dense(s, d).withColumn("v", F.when(F.col("v") < 110, 0).otherwise(F.col("v"))), 60.0).select(*CELLS),
    "p14_extract_patch": lambda s, d: i.extract_patch(dense(s, d), dense(s, d).where("v > 175").selectExpr("scan_id", "z AS cz", "y AS cy", "x AS cx"), 3),
    "a1_value_histogram": lambda s, d: t.value_histogram(dense(s, d)),
    "a2_fixed_histogram": lambda s, d: t.fixed_histogram(dense(s, d)),
    "a3_fd_histogram_peak": lambda s, d: t.fd_histogram_peak(sparse_voxels(s, d)),
    "a4_peak_spread": lambda s, d: t.peak_spread(dense(s, d), t.value_histogram(dense(s, d)).groupBy("scan_id").agg(F.min("value").alias("peak"))),
    "a4_range_pile_up": lambda s, d: t.range_pile_up(sparse_voxels(s, d), 0.02),
    "a6_background_mode": lambda s, d: t.background_mode_legacy(dense(s, d), level(s, d)),
    "a7_background_border": lambda s, d: t.background_border(dense(s, d), 1),
    "a7_background_peak_no_zero": lambda s, d: t.background_peak_no_zero(dense(s, d), 16),
    "a8_threshold_otsu": lambda s, d: t.threshold_otsu(dense(s, d)),
    "a9_threshold_li": lambda s, d: t.threshold_li(dense(s, d)),
    "a10_threshold_kapur": lambda s, d: t.threshold_kapur(sparse_voxels(s, d), 32),
    "a11_percentile_match": lambda s, d: t.threshold_percentile_match(dense(s, d), REFERENCE, 128),
    "a12_peak_shift": lambda s, d: t.threshold_peak_shift(dense(s, d), REFERENCE, 128),
    "a13_same_threshold": lambda s, d: t.same_threshold(dense(s, d), 128),
    "a14_average_pool": lambda s, d: t.average_pool(dense(s, d), 3),
    "a15_quantize_preview": lambda s, d: t.quantize_preview(dense(s, d), 2),
}


def masks(s, d):
    """label 1 + v mod 3 of the voxels over 128."""
    return dense(s, d).where("v > 128").select("scan_id", "z", "y", "x", (1 + F.col("v") % 3).alias("label"))


_CHANNELS = ", ch AS (SELECT scan_id // 3 AS scan_id, z, y, x, v, (scan_id % 3)::INT AS channel FROM dense) SELECT scan_id, z, y, x, "
_ELIGIBLE = "e AS (SELECT scan_id FROM scans WHERE NOT faulty AND NOT (is_mesh AND NOT voxelized) AND (linked_to IS NULL OR linked_to = scan_id) AND scan_id NOT IN (SELECT scan_id FROM edits WHERE kind = 'crop'))"
_OTSU = """h AS (SELECT scan_id, v::DOUBLE AS value, count(*) AS n FROM {t} GROUP BY ALL),
    c AS (SELECT scan_id, value, sum(n) OVER r AS w0, sum(n * value) OVER r AS m0, sum(n) OVER a AS w, sum(n * value) OVER a AS m FROM h
          WINDOW r AS (PARTITION BY scan_id ORDER BY value), a AS (PARTITION BY scan_id)),
    o AS (SELECT scan_id, value AS threshold FROM c WHERE w0 < w QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY w0 * (w - w0) * (m0 / w0 - (m - m0) / (w - w0)) ** 2 DESC, value) = 1)"""
_RANKED = """r AS (SELECT scan_id, v, row_number() OVER (PARTITION BY scan_id ORDER BY v) - 1 AS i, share * (count(*) OVER (PARTITION BY scan_id) - 1) AS pos FROM {t}, q),
    o AS (SELECT scan_id, max(v) FILTER (i = floor(pos)) + (max(v) FILTER (i = ceil(pos)) - max(v) FILTER (i = floor(pos))) * (any_value(pos) - floor(any_value(pos))) AS threshold FROM r GROUP BY 1)"""
_FINAL = " SELECT o.scan_id, o.threshold, sum((v > threshold)::INT)::BIGINT AS foreground FROM sparse JOIN o USING (scan_id) WHERE scan_id IN (FROM e) GROUP BY ALL"



def kernel_rows(sigma: float, n: int = 4) -> str:
    """(target, source, weight) of a Gaussian along an axis of n cells, mirrored at its faces."""
    weights = kernel(sigma)
    r, rows = len(weights) // 2, {}
    for to in range(n):
        for k, w in enumerate(weights):
            at = (to + k - r) % (2 * n)
            at = at if at < n else 2 * n - 1 - at
            rows[to, at] = rows.get((to, at), 0.0) + w
    return "kernel(t, s, w) AS (VALUES " + ", ".join(f"({a}, {b}, {w!r}::DOUBLE)" for (a, b), w in rows.items()) + ")"


_SMOOTH = kernel_rows(1.0) + """,
    sz AS (SELECT scan_id, t AS z, y, x, floor(sum(v * w) + 1e-9::DOUBLE) AS v FROM dense JOIN kernel ON s = z GROUP BY ALL),
    sy AS (SELECT scan_id, z, t AS y, x, floor(sum(v * w) + 1e-9::DOUBLE) AS v FROM sz JOIN kernel ON s = y GROUP BY ALL),
    smooth AS (SELECT scan_id, z, y, t AS x, floor(sum(v * w) + 1e-9::DOUBLE) AS v FROM sy JOIN kernel ON s = x GROUP BY ALL)"""
_FINAL_DENSE = " SELECT o.scan_id, o.threshold::DOUBLE AS threshold, sum((v > threshold)::INT)::BIGINT AS foreground FROM dense JOIN o USING (scan_id) WHERE scan_id IN (FROM e) GROUP BY ALL"

SQL = {
    "x2_align_thresholds_otsu": T("dense", "scans", "edits") + f", {_ELIGIBLE}, {_SMOOTH}, " + _OTSU.format(t="smooth") + _FINAL_DENSE,
    "x2_align_thresholds_smoothed_percentile": T("dense", "scans", "edits") + f", {_ELIGIBLE}, {_SMOOTH}, " + _OTSU.format(t="smooth").replace("o AS", "otsu AS") + ", q AS (SELECT avg((v < (SELECT threshold FROM otsu WHERE scan_id = 0))::INT) AS share FROM smooth WHERE scan_id = 0), " + _RANKED.format(t="smooth") + _FINAL_DENSE,
    "x2_align_thresholds_same": T("dense", "scans", "edits") + f", {_ELIGIBLE} SELECT scan_id, 128.0::DOUBLE AS threshold, sum((v > 128)::INT)::BIGINT AS foreground FROM dense WHERE scan_id IN (FROM e) GROUP BY 1",
    "x2_align_thresholds_percentile": T("sparse", "scans", "edits") + f", {_ELIGIBLE}, q AS (SELECT avg((v < 25)::INT) AS share FROM sparse WHERE scan_id = 1), " + _RANKED.format(t="sparse") + _FINAL,
    "p1_subtract_background": T("dense") + " SELECT scan_id, z, y, x, least(greatest(v - trunc((scan_id % 7) * 1.5)::INT, 0), 255)::INT AS v FROM dense",
    "p2_remove_background": T("dense") + " SELECT scan_id, z, y, x, CASE WHEN v < 128 THEN min(v) OVER (PARTITION BY scan_id) ELSE v END AS v FROM dense",
    "p3_shift_to_reference": T("dense") + " SELECT scan_id, z, y, x, least(greatest(v + 128 - (scan_id % 50 + 100), 0), 255)::INT AS v FROM dense",
    "p4_percentile_normalize": T("dense") + ", p AS (SELECT scan_id, quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.995) AS b FROM dense GROUP BY 1) SELECT scan_id, z, y, x, CASE WHEN b <= a THEN v ELSE floor((least(greatest(v, a), b) - a) / (b - a) * 255 + 1e-9::DOUBLE)::INT END AS v FROM dense JOIN p USING (scan_id)",
    "p6_match_histogram": T("dense") + """, h AS (SELECT scan_id, v, count(*) AS n FROM dense WHERE v > 128 GROUP BY ALL),
        q AS (SELECT scan_id, v, sum(n) OVER (PARTITION BY scan_id ORDER BY v) / sum(n) OVER (PARTITION BY scan_id) AS q FROM h),
        r AS (SELECT q AS q1, v::DOUBLE AS v1, lag(q, 1, -1) OVER (ORDER BY q) AS q0, coalesce(lag(v) OVER (ORDER BY q), v)::DOUBLE AS v0 FROM q WHERE scan_id = 0),
        m AS (SELECT scan_id, v, round_even(CASE WHEN q0 < 0 THEN v1 ELSE v0 + (q - q0) / (q1 - q0) * (v1 - v0) END, 0)::INT AS w FROM q JOIN r ON q > q0 AND q <= q1)
        SELECT d.scan_id, z, y, x, coalesce(w, d.v) AS v FROM dense d LEFT JOIN m ON m.scan_id = d.scan_id AND m.v = d.v""",
    "p7_min_max_normalize": T("dense") + " SELECT scan_id, z, y, x, coalesce(-1 + (v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0)::DOUBLE * 2, -1) AS v FROM dense WINDOW w AS (PARTITION BY scan_id)",
    "p10_combine_mean": T("dense") + _CHANNELS + "round_even(avg(v), 0)::INT AS v FROM ch GROUP BY ALL",
    "p10_combine_sum": T("dense") + _CHANNELS + "least(sum(v), 255)::INT AS v FROM ch GROUP BY ALL",
    "p10_combine_luma": T("dense") + _CHANNELS + "CASE WHEN count(DISTINCT channel) = 3 THEN least(round_even(max(CASE WHEN channel = 0 THEN v END)::DOUBLE * 0.299::DOUBLE + max(CASE WHEN channel = 1 THEN v END) * 0.587::DOUBLE + max(CASE WHEN channel = 2 THEN v END) * 0.114::DOUBLE, 0), 255) END::INT AS v FROM ch GROUP BY ALL",
    "p10_combine_multiply": T("dense") + _CHANNELS + "least(round_even(list_reduce(list_prepend(255.0::DOUBLE, list(v::DOUBLE ORDER BY channel)), lambda a, b: a * b / 255.0::DOUBLE), 0), 255)::INT AS v FROM ch GROUP BY ALL",
    "p11_mask_out": T("dense") + " SELECT scan_id, z, y, x, CASE WHEN v > 128 AND 1 + v % 3 = 2 THEN v ELSE 0 END AS v FROM dense",
    "p12_volume_to_uint8": T("sparse") + """, s AS (SELECT scan_id, z, y, x, v * 7 AS v FROM sparse), e AS (SELECT scan_id, min(v) AS a, max(v) AS b, bool_and(v >= 0 AND v <= 255 AND v = floor(v)) AS fits FROM s GROUP BY 1)
        SELECT scan_id, z, y, x, CASE WHEN fits THEN v::INT WHEN b > a THEN floor((v - a) / (b - a) * 255)::INT ELSE 0 END AS v FROM s JOIN e USING (scan_id)""",
    "p13_fill_speckle_zeros": T("dense") + """, s AS (SELECT scan_id, z, y, x, CASE WHEN v < 110 THEN 0 ELSE v END AS v FROM dense)
        SELECT scan_id, z, y, x, CASE WHEN v = 0 AND m >= 60 THEN round_even(m, 0)::INT ELSE v END AS v FROM (SELECT s.*, (SELECT coalesce(sum(n.v), 0) / 6.0::DOUBLE FROM s n WHERE n.scan_id = s.scan_id AND abs(n.z - s.z) + abs(n.y - s.y) + abs(n.x - s.x) = 1) AS m FROM s)""",
    "p14_extract_patch": T("dense") + """ SELECT c.scan_id, c.z AS cz, c.y AS cy, c.x AS cx, pz::INT AS pz, py::INT AS py, px::INT AS px, coalesce(d.v, 0) AS v
        FROM dense c, range(3) a(pz), range(3) b(py), range(3) e(px) LEFT JOIN dense d ON d.scan_id = c.scan_id AND d.z = c.z - 1 + pz AND d.y = c.y - 1 + py AND d.x = c.x - 1 + px WHERE c.v > 175""",
    "a1_value_histogram": T("dense") + " SELECT scan_id, v::DOUBLE AS value, count(*) AS n FROM dense GROUP BY ALL",
    "a2_fixed_histogram": T("dense") + " SELECT scan_id, least(floor(v / (255.0::DOUBLE / 65)), 64)::INT AS bin, count(*) AS n FROM dense GROUP BY ALL",
    "a4_peak_spread": T("dense") + ", p AS (SELECT scan_id, min(v) AS m FROM dense GROUP BY 1) SELECT scan_id, least(sqrt(avg((v - m) ** 2) FILTER (v <= m)), sqrt(avg((v - m) ** 2) FILTER (v >= m))) AS spread FROM dense JOIN p USING (scan_id) GROUP BY 1",
    "a4_range_pile_up": T("sparse") + ", e AS (SELECT scan_id, min(v) AS a, max(v) AS b FROM sparse GROUP BY 1) SELECT scan_id, avg((v = a)::INT) >= 0.02 AS low_end, avg((v = b)::INT) >= 0.02 AS high_end FROM sparse JOIN e USING (scan_id) GROUP BY 1",
    "a6_background_mode": T("dense") + ", h AS (SELECT scan_id, v, count(*) AS n FROM dense WHERE v BETWEEN 2 AND 128 GROUP BY ALL) SELECT scan_id, v::DOUBLE AS background FROM h QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, v) = 1",
    "a7_background_border": T("dense") + ", h AS (SELECT scan_id, v, count(*) AS n FROM dense WHERE z IN (0, 3) OR y IN (0, 3) OR x IN (0, 3) GROUP BY ALL) SELECT scan_id, v::DOUBLE AS background FROM h QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, v) = 1",
    "a8_threshold_otsu": T("dense") + ", " + _OTSU.format(t="dense") + " SELECT * FROM o",
    "a11_percentile_match": T("dense") + ", q AS (SELECT avg((v < 128)::INT) AS share FROM dense WHERE scan_id = 0), " + _RANKED.format(t="dense") + " SELECT scan_id, threshold::DOUBLE AS threshold FROM o",
    "a13_same_threshold": T("dense") + " SELECT DISTINCT scan_id, 128.0::DOUBLE AS threshold FROM dense",
    "a14_average_pool": T("dense") + """, w AS (SELECT *, CASE WHEN z = 3 THEN 3 ELSE 1 END * CASE WHEN y = 3 THEN 3 ELSE 1 END * CASE WHEN x = 3 THEN 3 ELSE 1 END AS w FROM dense)
        SELECT scan_id, (z // 3)::INT AS z, (y // 3)::INT AS y, (x // 3)::INT AS x, round_even(sum(v * w) / sum(w)::DOUBLE, 0)::INT AS v FROM w GROUP BY ALL""",
    "a15_quantize_preview": T("dense") + """, p AS (SELECT scan_id, (z // 2)::INT AS z, (y // 2)::INT AS y, (x // 2)::INT AS x, avg(v) AS m FROM dense GROUP BY ALL), e AS (SELECT scan_id, min(m) AS zero, (max(m) - min(m)) / 255 AS scale FROM p GROUP BY 1)
        SELECT scan_id, z, y, x, CASE WHEN scale > 0 THEN least(floor((m - zero) / scale), 255) ELSE 0 END::INT AS v, scale, zero FROM p JOIN e USING (scan_id)""",
}
