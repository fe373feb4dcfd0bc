"""Queries on moved landmarks, linked subjects, channels, restored ranges and names, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import cohort as c, evaluate as e, geometry as g, intensity as i
from .intensity_queries import CELLS, _CHANNELS, channels, dense
from .proxies import points, scans, table, with_tables

T = with_tables
XYZ = ("x", "y", "z")


def landmarks(k, d):
    """Points as the landmarks of their cohort's scan."""
    return points(k, d).select(F.col("cohort").alias("scan_id"), "id", *XYZ)


def poses(k, d):
    """A turn by the 3-4-5 triangle about z for each scan, with its voxel sizes, box, padding and centroids; every other scan has a shift."""
    n = F.col("scan_id")
    turn = {"r11": 0.6, "r12": -0.8, "r13": 0.0, "r21": 0.8, "r22": 0.6, "r23": 0.0, "r31": 0.0, "r32": 0.0, "r33": 1.0}
    same = {f"{name}_{a}": v for a in XYZ for name, v in (("embed", 1.0), ("origin", 2.0), ("lo", -8.0), ("hi", 5.0), ("pad", 3.0))}
    made = landmarks(k, d).select("scan_id").distinct().withColumns({c: F.lit(v) for c, v in (turn | same).items()})
    moved = {f"{name}_{a}": v for a in XYZ for name, v in (("shift", F.when(n % 2 == 0, F.lit(4.0))), ("ref", n + 7.75), ("src", n % 3 + 0.5))}
    return made.withColumns({"vs": 0.5 + n % 3 * 0.25, "vs_before": F.lit(0.25), "scale": F.lit(2.0)} | moved)


def links(k, d):
    """Children two ids above their main, which have its dims, and children one above, which do not."""
    n = F.col("scan_id")
    return scans(k, d).where(n % 6 != 1).select((n - F.when(n % 6 == 5, 1).otherwise(2)).alias("main"), n.alias("child"))


def ranges(k, d):
    return dense(k, d).groupBy("scan_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


QUERIES = {
    "g3_rotate_landmarks": lambda k, d: g.rotate_landmarks(landmarks(k, d), poses(k, d)),
    "g4_invert_alignment": lambda k, d: g.invert_alignment(landmarks(k, d), poses(k, d)),
    "f9_link_scans": lambda k, d: c.link_scans(scans(k, d).withColumnRenamed("dim", "dims"), links(k, d)).select("scan_id", "linked_to"),
    "a17_mask_centroid": lambda k, d: e.mask_centroid(dense(k, d).select("scan_id", *XYZ, (F.col("v") > 175).cast("int").alias("label")), dense(k, d).select("scan_id").distinct().withColumns({f"n{a}": F.lit(4) for a in XYZ})),
    "p7_restore_range": lambda k, d: i.restore_range(i.min_max_normalize(dense(k, d), -1.0, 1.0), ranges(k, d), -1.0, 1.0).select(*CELLS[:4], F.rint("v").cast("int").alias("v")),
    "p7_map_background": lambda k, d: i.map_background(dense(k, d), 12.5, 120).select(*CELLS),
    "p10_combine_first": lambda k, d: i.combine_channels(channels(k, d), "first"),
    "p10_combine_channel": lambda k, d: i.combine_channels(channels(k, d), "channel", channel=1),
    "p10_combine_max": lambda k, d: i.combine_channels(channels(k, d), "max"),
    "p10_split_channels": lambda k, d: i.split_channels(scans(k, d), channels(k, d).select("scan_id", "channel").distinct()),
    "scalar_names": lambda k, d: table(k, d, "part").select("p_partkey", scalars.normal_stem(F.concat(F.lit("scans/"), "p_name", F.lit(" #"), "p_partkey", F.lit(".nii.gz"))).alias("stem"), scalars.natural_key(F.concat("p_name", F.lit("-"), "p_partkey")).alias("key"), scalars.clean_label(F.concat(F.lit(" "), "p_name", F.lit("  "), "p_brand")).alias("label")),
    "scalar_measures": lambda k, d: table(k, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.entropy(F.col("l_discount").cast("double")).alias("entropy"), scalars.rotation_angle(*[F.col("l_tax").cast("double") * n for n in (1, 2, 4)]).alias("angle")),
}

_FRAME = T("points") + ", p AS (SELECT cohort AS scan_id, id, x, y, z, 0.5::DOUBLE + cohort % 3 * 0.25::DOUBLE AS vs FROM points)"

SQL = {
    "g3_rotate_landmarks": _FRAME + """, v AS (SELECT scan_id, id, vs, x / vs - 1 - 2 AS x, y / vs - 1 - 2 AS y, z / vs - 1 - 2 AS z FROM p),
        r AS (SELECT scan_id, id, vs, 0.6::DOUBLE * x + -0.8::DOUBLE * y AS x, 0.8::DOUBLE * x + 0.6::DOUBLE * y AS y, z FROM v)
        SELECT scan_id, id, (x + 8) * vs AS x, (y + 8) * vs AS y, (z + 8) * vs AS z FROM r WHERE x >= -8 AND x < 5 AND y >= -8 AND y < 5 AND z >= -8 AND z < 5""",
    "g4_invert_alignment": _FRAME + """, s AS (SELECT *, CASE WHEN scan_id % 2 = 0 THEN 4 ELSE trunc(scan_id + 7.75::DOUBLE) - trunc(scan_id % 3 + 0.5::DOUBLE) END AS shift FROM p),
        v AS (SELECT scan_id, id, x / vs - shift AS x, y / vs - shift AS y, z / vs - shift AS z FROM s)
        SELECT scan_id, id, (0.6::DOUBLE * x + 0.8::DOUBLE * y - 3) / 2 * 0.25::DOUBLE AS x, (-0.8::DOUBLE * x + 0.6::DOUBLE * y - 3) / 2 * 0.25::DOUBLE AS y, (z - 3) / 2 * 0.25::DOUBLE AS z FROM v""",
    "f9_link_scans": T("scans") + """, l AS (SELECT scan_id - CASE WHEN scan_id % 6 = 5 THEN 1 ELSE 2 END AS main, scan_id FROM scans WHERE scan_id % 6 <> 1),
        m AS (SELECT main, scan_id FROM l UNION SELECT main, main FROM l),
        fit AS (SELECT main FROM m JOIN scans USING (scan_id) GROUP BY 1 HAVING count(DISTINCT dim) = 1),
        c AS (SELECT scan_id, min(main) AS main FROM m WHERE main IN (FROM fit) GROUP BY 1)
        SELECT s.scan_id, coalesce(c.main, linked_to) AS linked_to FROM scans s LEFT JOIN c ON c.scan_id = s.scan_id""",
    "a17_mask_centroid": T("dense") + " SELECT scan_id, " + ", ".join(f"coalesce(avg({a}) FILTER (v > 175), 1.5::DOUBLE) AS c{a}" for a in XYZ) + " FROM dense GROUP BY 1",
    "p7_restore_range": T("dense") + " SELECT scan_id, z, y, x, v FROM dense",
    "p7_map_background": T("dense") + " SELECT scan_id, z, y, x, CASE WHEN v <= 120 THEN 12.5::DOUBLE ELSE v END AS v FROM dense",
    "p10_combine_first": T("dense") + _CHANNELS + "arg_min(v, channel)::INT AS v FROM ch GROUP BY ALL",
    "p10_combine_channel": T("dense") + _CHANNELS + "max(v) FILTER (channel = 1)::INT AS v FROM ch GROUP BY ALL",
    "p10_combine_max": T("dense") + _CHANNELS + "max(v)::INT AS v FROM ch GROUP BY ALL",
    "p10_split_channels": T("dense", "scans") + ", ch AS (SELECT DISTINCT scan_id // 3 AS scan_id, (scan_id % 3)::INT AS channel FROM dense) SELECT scan_id, name || '_ch' || channel AS name, scan_id AS linked_to, channel FROM scans JOIN ch USING (scan_id)",
    "scalar_names": """SELECT p_partkey, trim(regexp_replace(lower(p_name || ' #' || p_partkey), '[^a-z0-9]+', '_', 'g'), '_') AS stem,
        array_to_string(list_transform(regexp_extract_all(p_name || '-' || p_partkey, '[0-9]+|[^0-9]+'), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') THEN lpad(length(ltrim(s, '0'))::VARCHAR, 10, '0') || ltrim(s, '0') ELSE lower(s) END), '') AS key,
        trim(regexp_replace(' ' || p_name || '  ' || p_brand, '\\s+', ' ', 'g')) AS label FROM part""",
    "scalar_measures": "SELECT l_orderkey, l_linenumber, -l_discount::DOUBLE * ln(l_discount::DOUBLE + 1e-10::DOUBLE) AS entropy, degrees(acos(least(greatest((l_tax::DOUBLE + l_tax::DOUBLE * 2 + l_tax::DOUBLE * 4 - 1) / 2, -1), 1))) AS angle FROM lineitem",
}
