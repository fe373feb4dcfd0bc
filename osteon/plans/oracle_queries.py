"""Queries of the newer operators, and SQL for queries of other modules that brute force expresses plainly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import evaluate as e, graph as g, intensity as i, spatial as j, stencil as s
from ..operators.tables import shared_path
from ..sources import manifests as m
from .intensity_queries import dense
from .proxies import edits, scans, table, with_tables
from .space_queries import actual, subjects
from .volume_queries import deformation

T = with_tables


def marks(k, d):
    """The 20 landmarks of the fields along a line, with the variance of their displacements."""
    var = sum(F.var_pop(f"u{a}") for a in "xyz")
    return deformation(k, d).groupBy(F.col("idx").alias("id")).agg(F.round(var, 9).alias("variance")).select("id", (F.col("id") * 0.5).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), "variance")


def map_log(k, d):
    """Changes of intensity maps from the chains of edits."""
    n, kind = F.col("edit_number"), F.col("kind")
    op = F.when(kind == "mask", "drop").when(kind == "smooth", "rename").otherwise("record")
    name = F.when(kind == "mask", F.concat(F.lit("_edit_"), (n % 3).cast("string"), F.lit("_"))).when(kind == "smooth", "crop").otherwise(F.concat(F.lit("s_edit_"), (n % 3).cast("string"), F.lit("_"), kind))
    return edits(k, d).select("scan_id", n.alias("seq"), op.alias("op"), name.alias("filename"), F.when(kind == "smooth", "cut").alias("other"), F.when(F.col("has_mask"), 2.0).otherwise(1.0).alias("s"), (n % 5 - 2.0).alias("o"))


def waves(k, d):
    """Displacements of every dense scan, in part smooth and in part its own values."""
    own = (F.col("v") - 128) / 4036.0
    return dense(k, d).select("scan_id", "z", "y", "x", (own + F.col("y") * 0.05).alias("uz"), (F.col("x") * 0.08).alias("uy"), (F.col("z") * 0.1 + own / 2).alias("ux"))


def grids(k, d):
    """Shapes to resize to: repeated, taken at steps, and zoomed."""
    pick = lambda a: F.element_at(F.array(*[F.lit(g[a]) for g in GRIDS]), (F.col("scan_id") % 4 + 1).cast("int"))
    return dense(k, d).select("scan_id").distinct().select("scan_id", *[F.lit(4).alias(f"n{a}") for a in "zyx"], *[pick(n).alias(f"m{a}") for n, a in enumerate("zyx")])


def scan_files(k, d):
    """Metadata of every scan in its own file, beside files that are none."""
    s = scans(k, d).select("name", "voxel_size", F.col("threshold").cast("double").alias("threshold"), "faulty", "is_mesh", "voxelized", "flag")
    at = lambda file: F.concat(F.lit("project/extracted/"), F.col("name"), F.lit("/"), file)
    text = F.to_json(F.struct(*s.columns)).alias("text")
    return s.select(at(F.concat("name", F.lit(".json"))).alias("path"), text).union(s.select(at(F.lit("landmarks.json")), text))


def landmark_rows(k, d):
    p = table(k, d, "embeddings").where("vec_id > 0")
    at = lambda n: F.col("embedding")[n].cast("double").alias("xyz"[n])
    return p.select(F.floor((F.col("vec_id") - 1) / 3).cast("long").alias("scan_id"), (F.col("vec_id") % 3).cast("int").alias("idx"), F.when(F.col("vec_id") % 3 == 2, "semi").otherwise("main").alias("type"), *[at(n) for n in range(3)])


def landmarks_csv(k, d):
    """Writes the wide landmarks and reads the file back."""
    path = shared_path(k, "landmarks")
    m.write_landmarks_csv(m.landmarks_wide(landmark_rows(k, d), scans(k, d).where("scan_id > 0"), 3), path)
    back = k.read.csv(path, header=True)
    return back.select("Subject", *[F.coalesce(c, F.lit("")).try_cast("double").alias(c) for c in back.columns if c != "Subject"])


GRIDS = ((8, 6, 3), (2, 7, 4), (4, 5, 1), (3, 4, 10))
QUERIES = {
    "a30_invert_field": lambda k, d: j.invert_field(waves(k, d), tolerance=1e-12).select("scan_id", "z", "y", "x", *[F.round(c, 6).alias(c) for c in ("wz", "wy", "wx", "residual")]),
    "j9_resize_any": lambda k, d: j.resize_mask(dense(k, d).select("scan_id", "z", "y", "x", (F.col("v") % 3).alias("label")), grids(k, d)),
    "s1_scan_rows": lambda k, d: m.scan_rows(scan_files(k, d)).select("folder", "voxel_size", "threshold", "faulty", "is_mesh", "voxelized", "flag"),
    "s7_landmarks_csv": landmarks_csv,
    "i5_decorrelate_fields": lambda k, d: g.decorrelate_landmarks(marks(k, d), deformation(k, d).withColumnRenamed("idx", "id"), 2.0, 0.02).select("id", "variance"),
    "i6_spread_select": lambda k, d: g.spread_select(subjects(k, d)),
    "i10_edge_mask": lambda k, d: g.edge_mask(dense(k, d), 0.6, 0.9, 1, "above_min", 3),
    "a37_init_slice": lambda k, d: e.init_slice(actual(k, d), 1),
    "p8_map_changes": lambda k, d: i.apply_map_changes(edits(k, d).select("scan_id").distinct().select("scan_id", F.lit(1).alias("seq"), F.lit("s").alias("filename"), F.lit(2.0).alias("mapping_scale"), F.lit(10.0).alias("mapping_shift")), map_log(k, d)),
    "w18_interest_points_eroded": lambda k, d: s.interest_points(dense(k, d), dense(k, d).where("v > 20"), 1, 10, 2, erosion=1, least=4).select("scan_id", "z", "y", "x", F.round("var", 6).alias("var")),
}


def resampling(kind: str, finest: bool) -> str:
    """(scan's kind, target, source, weight) of an axis of 4 cells, by solving for splines or by overlap; kinds as in volume_queries.spacings."""
    rows = []
    for n, sizes in enumerate(({"z": 2.0, "y": 1.0, "x": 1.0}, {"z": 1.0, "y": 1.6, "x": 1.0}, {"z": 1.0, "y": 1.0, "x": 1.0})):
        own, to = sizes[kind], (min if finest else max)(sizes.values())
        m = max(1, round(4 * own / to))
        start = (4 * own - m * to) / 2
        if own == to:
            matrix = np.eye(4)
        elif own > to:
            basis = lambda far: (4 - 6 * far**2 + 3 * far**3) / 6 if far < 1 else max(2 - far, 0.0) ** 3 / 6
            mirror = lambda c: c % 8 if c % 8 < 4 else 7 - c % 8
            at = [(start + (j + 0.5) * to) / own - 0.5 for j in range(m)]
            known, wanted = np.zeros((4, 4)), np.zeros((m, 4))
            for cell in range(-8, 12):
                for j in range(4):
                    known[j, mirror(cell)] += basis(abs(j - cell))
                for j, p in enumerate(at):
                    wanted[j, mirror(cell)] += basis(abs(p - cell))
            matrix = wanted @ np.linalg.inv(known)
        else:
            matrix = np.array([[max(0.0, min(start + (j + 1) * to, (c + 1) * own) - max(start + j * to, c * own)) for c in range(4)] for j in range(m)])
            matrix /= matrix.sum(axis=1, keepdims=True)
        rows += [f"({n}, {j}, {c}, {float(w)!r}::DOUBLE)" for (j, c), w in np.ndenumerate(matrix) if w]
    return f"k{kind}(kind, t, s, w) AS (VALUES {', '.join(rows)})"


def resampled(finest: bool, source: str, value: str) -> str:
    kernels = ", ".join(resampling(a, finest) for a in "zyx")
    return T("dense") + f""", {kernels}, d AS (SELECT scan_id, z, y, x, {source} AS v FROM dense), ends AS (SELECT scan_id, min(v) AS lo, max(v) AS hi FROM d GROUP BY 1),
        r AS (SELECT scan_id, a.t::INT AS z, b.t::INT AS y, c.t::INT AS x, sum(v * a.w * b.w * c.w) AS v FROM d JOIN kz a ON a.kind = scan_id % 3 AND a.s = z JOIN ky b ON b.kind = scan_id % 3 AND b.s = y JOIN kx c ON c.kind = scan_id % 3 AND c.s = x GROUP BY ALL)
        SELECT scan_id, z, y, x, {value} AS v FROM r JOIN ends USING (scan_id)"""


#: Squared distance and height of the closest point on each triangle of space_queries.triangles, which are one shape, for each probe.
_NEAR = T("points") + """, p AS (SELECT id, x - 0.15::DOUBLE AS x, y + 0.1::DOUBLE AS y, z + 0.3::DOUBLE AS z FROM points WHERE id % 2 = 0),
    d AS (SELECT p.id, f.id AS face_id, p.x - f.x AS dx, p.y - f.y AS dy, p.z - f.z AS dz FROM p, points f),
    m AS (SELECT *, dx + 0.5::DOUBLE * dz AS du, dy - 0.5::DOUBLE * dz AS dw, ((dx - 1) * -1 + dy - (dz - 0.5::DOUBLE)) / 3 AS de FROM d),
    k AS (SELECT *, (1.25::DOUBLE * du + 0.25::DOUBLE * dw) / 1.5::DOUBLE AS s, (1.25::DOUBLE * dw + 0.25::DOUBLE * du) / 1.5::DOUBLE AS t,
        least(greatest(du / 1.25::DOUBLE, 0), 1) AS ku, least(greatest(dw / 1.25::DOUBLE, 0), 1) AS kw, least(greatest(de, 0), 1) AS ke FROM m),
    c AS (SELECT id, face_id, dz, list_min([
        CASE WHEN s >= 0 AND t >= 0 AND s + t <= 1 THEN {'d2': (-0.5::DOUBLE * dx + 0.5::DOUBLE * dy + dz) ** 2 / 1.5::DOUBLE, 'cz': 0.5::DOUBLE * s - 0.5::DOUBLE * t} END,
        {'d2': (dx - ku) ** 2 + dy ** 2 + (dz - 0.5::DOUBLE * ku) ** 2, 'cz': 0.5::DOUBLE * ku},
        {'d2': dx ** 2 + (dy - kw) ** 2 + (dz + 0.5::DOUBLE * kw) ** 2, 'cz': -0.5::DOUBLE * kw},
        {'d2': (dx - 1 + ke) ** 2 + (dy - ke) ** 2 + (dz - 0.5::DOUBLE + ke) ** 2, 'cz': 0.5::DOUBLE - ke}]) AS best FROM k),
    near AS (SELECT id, best.d2 AS d2, dz - best.cz AS up FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY best.d2, face_id) = 1)"""


def reached(name: str, start: str, cells: str) -> str:
    """Cells (scan_id, root, c) that are reached from the starts by faces inside a set of cells; c = 16 z + 4 y + x."""
    return f"""{name} AS (SELECT scan_id, c AS root, c FROM {start} UNION SELECT r.scan_id, r.root, n.c FROM {name} r JOIN {cells} n ON n.scan_id = r.scan_id
        AND abs(n.c // 16 - r.c // 16) + abs(n.c // 4 % 4 - r.c // 4 % 4) + abs(n.c % 4 - r.c % 4) = 1)"""


def cells_where(name: str, rule: str) -> str:
    return f"{name} AS (SELECT scan_id, z * 16 + y * 4 + x AS c, v FROM dense WHERE {rule})"


_CODE = "(c // 16)::INT AS z, (c // 4 % 4)::INT AS y, (c % 4)::INT AS x"
_REC = T("dense").replace("WITH", "WITH RECURSIVE", 1)
_BORDER = "(z IN (0, 3) OR y IN (0, 3) OR x IN (0, 3))"


def labeled(level: int) -> str:
    return f"{_REC}, {cells_where('w', f'v > {level}')}, {reached('r', 'w', 'w')}, l AS (SELECT scan_id, c, min(root) AS component FROM r GROUP BY ALL), n AS (SELECT scan_id, component, count(*) AS n FROM l GROUP BY ALL)"


_STRIP = "l AS (SELECT cohort AS mesh_id, id AS a, lead(id) OVER w AS b, lead(id, 2) OVER w AS c FROM points WINDOW w AS (PARTITION BY cohort ORDER BY id)), f AS (SELECT * FROM l WHERE c IS NOT NULL AND a % 7 <> 0 AND b % 7 <> 0)"
_KNOWN = "known AS (SELECT DISTINCT o_custkey AS scan_id, o_orderkey % 5 AS label FROM orders)"

def inverted(rounds: int) -> str:
    """Fixed-point rounds of inverting the displacements of waves, linear between cells."""
    field = T("dense") + ", u AS (SELECT scan_id, z, y, x, (v - 128) / 4036.0::DOUBLE + y * 0.05::DOUBLE AS uz, x * 0.08::DOUBLE AS uy, z * 0.1::DOUBLE + (v - 128) / 8072.0::DOUBLE AS ux FROM dense)"
    corner = ", k AS (SELECT i, j, l FROM range(2) p(i), range(2) q(j), range(2) r(l)), w0 AS (SELECT scan_id, z, y, x, 0.0::DOUBLE AS wz, 0.0::DOUBLE AS wy, 0.0::DOUBLE AS wx FROM u)"
    weight = " * ".join(f"CASE WHEN {c} = 1 THEN {a} + w{a} - floor({a} + w{a}) ELSE 1 - ({a} + w{a} - floor({a} + w{a})) END" for a, c in zip("zyx", "ijl", strict=True))
    cell = ", ".join(f"least(greatest(floor({a} + w{a}) + {c}, 0), 3)::INT AS s{a}" for a, c in zip("zyx", "ijl", strict=True))
    steps = "".join(
        f", w{n} AS (SELECT c.scan_id, c.z, c.y, c.x, " + ", ".join(f"-sum(g * u.u{a}) AS w{a}" for a in "zyx") + f" FROM (SELECT scan_id, z, y, x, {weight} AS g, {cell} FROM w{n - 1}, k) c"
        " JOIN u ON u.scan_id = c.scan_id AND u.z = sz AND u.y = sy AND u.x = sx GROUP BY ALL)" for n in range(1, rounds + 1)
    )
    return field + corner + steps + f" SELECT scan_id, z, y, x, {', '.join(f'round(w{a}, 6) AS w{a}' for a in 'zyx')}, 0.0::DOUBLE AS residual FROM w{rounds}"


def resized() -> str:
    shape = "CASE scan_id % 4 " + " ".join(f"WHEN {n} THEN {list(g)}" for n, g in enumerate(GRIDS)) + " END AS m"
    rf = "greatest(round_even(greatest(4, m) / least(4, m), 0), 1)::INT"
    source = f"CASE WHEN m = 4 THEN t WHEN m > 4 AND ceil(m / {rf}) = 4 THEN t // {rf} WHEN m < 4 AND ceil(4 / {rf}) = m THEN t * {rf} ELSE least(floor(t * (3 / greatest(m - 1, 1)::DOUBLE) + 0.5::DOUBLE), 3) END::INT"
    axes = f"ax AS (SELECT m, t, {source} AS s FROM (SELECT m, unnest(range(m)) AS t FROM range(1, 11) r(m)))"
    return T("dense") + f", {axes}, d AS (SELECT *, {shape} FROM dense) SELECT scan_id, az.t::INT AS z, ay.t::INT AS y, ax.t::INT AS x, (v % 3)::INT AS label FROM d JOIN ax az ON az.m = d.m[1] AND az.s = d.z JOIN ax ay ON ay.m = d.m[2] AND ay.s = d.y JOIN ax ON ax.m = d.m[3] AND ax.s = d.x"


SQL = {
    "a30_invert_field": inverted(20),
    "j9_resize_any": resized(),
    "s1_scan_rows": T("scans") + " SELECT name AS folder, voxel_size, threshold::DOUBLE AS threshold, faulty, is_mesh, voxelized, flag FROM scans",
    "s7_landmarks_csv": T("scans") + ", e AS (SELECT (vec_id - 1) // 3 AS scan_id, (vec_id % 3)::INT AS i, embedding FROM embeddings WHERE vec_id > 0) SELECT name AS \"Subject\", " + ", ".join(
        f'max(CASE WHEN i = {n} THEN embedding[{c + 1}]::DOUBLE END) AS {p}landmark_{n}_{a}' if (p == "semi_") == (n == 2) else f"NULL::DOUBLE AS {p}landmark_{n}_{a}" for p in ("", "semi_") for n in range(3) for c, a in enumerate("xyz")
    ) + " FROM e JOIN scans USING (scan_id) WHERE NOT faulty AND scan_id > 0 GROUP BY name",
    "a16_resample_isotropic": resampled(True, "v * 0.7071067811865476::DOUBLE", "least(greatest(v, lo), hi)"),
    "a16_resample_coarsest": resampled(False, "v * 0.7071067811865476::DOUBLE", "least(greatest(v, lo), hi)"),
    "a16_resample_masks": resampled(False, "(v > 128)::INT", "CASE WHEN v >= (lo + hi) / 2.0::DOUBLE - 1e-12 THEN hi ELSE lo END::INT"),
    "j2_surface_distance": _NEAR + " SELECT id, sqrt(d2) AS distance FROM near",
    "j3_snap_landmarks": _NEAR + " SELECT id, sqrt(d2) AS snap_distance FROM near WHERE sqrt(d2) <= 0.5",
    "j4_parallel_distance": _NEAR + " SELECT id, greatest(abs(up), sqrt(greatest(d2 - up * up, 0)) - 0.05::DOUBLE * sqrt(1.25::DOUBLE), 0) AS distance FROM near",
    "j19_keep_landmarks_near": _NEAR + ", b AS (SELECT 0.005::DOUBLE * sqrt((max(x) + 1 - min(x)) ** 2 + (max(y) + 1 - min(y)) ** 2 + (max(z) + 0.5::DOUBLE - min(z) + 0.5::DOUBLE) ** 2) AS most FROM points) SELECT id FROM near, b WHERE sqrt(d2) <= most",
    "j7_transfer_landmarks": T("dense") + " SELECT scan_id, (z * 16 + y * 4 + x)::BIGINT AS id, x + 1.5::DOUBLE AS x, y + 1.5::DOUBLE AS y, z + 1.5::DOUBLE AS z, 'main' AS type FROM dense WHERE v > 150",
    "j14_mutual_matches": """WITH m AS (SELECT vec_id % 20 AS pair, vec_id AS a, embedding::DOUBLE[] AS u FROM embeddings WHERE vec_id % 2 = 0), f AS (SELECT vec_id % 20 - 1 AS pair, vec_id AS b, embedding::DOUBLE[] AS w FROM embeddings WHERE vec_id % 2 = 1),
        c AS (SELECT m.pair, a, b, list_inner_product(u, w) / (sqrt(list_inner_product(u, u)) * sqrt(list_inner_product(w, w))) AS cos FROM m JOIN f USING (pair)),
        r AS (SELECT *, row_number() OVER (PARTITION BY pair, a ORDER BY cos DESC, b) AS ra, row_number() OVER (PARTITION BY pair, b ORDER BY cos DESC, a) AS rb FROM c)
        SELECT pair, a, b, cos, (row_number() OVER (PARTITION BY pair ORDER BY cos DESC, a))::INT AS rank FROM r WHERE ra = 1 AND rb = 1 AND cos >= 0.1""",
    "j17_invalid_subjects": T("scans") + f""", {_KNOWN}, s AS (SELECT DISTINCT o_custkey * 2 AS scan_id FROM orders),
        m AS (SELECT s.scan_id, c.scan_id IS NULL AS gone, c.faulty, (SELECT coalesce(string_agg(w::VARCHAR, ',' ORDER BY w), '') FROM range(2) t(w) WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.scan_id = s.scan_id AND k.label = w)) AS missing FROM s LEFT JOIN scans c ON c.scan_id = s.scan_id)
        SELECT scan_id, CASE WHEN gone THEN 'unknown' WHEN faulty THEN 'faulty' ELSE 'labels missing' END AS issue, missing FROM m WHERE gone OR faulty OR missing <> ''""",
    "f6_training_eligibility": T("scans") + """, i AS (SELECT scan_id, concat_ws(',', CASE WHEN is_mesh AND NOT voxelized THEN 'mesh_only' END, CASE WHEN faulty THEN 'faulty' END, CASE WHEN scan_id % 6 = 0 THEN 'image_missing' END,
        CASE WHEN scan_id % 5 = 0 THEN 'mask_missing' END, CASE WHEN scan_id % 6 <> 0 AND scan_id % 5 <> 0 AND (scan_id % 6 = 1) <> (scan_id % 5 = 1) THEN 'shape_mismatch' END) AS issues FROM scans) SELECT scan_id, issues, issues = '' AS eligible FROM i""",
    "a10_threshold_kapur": T("sparse") + """, q AS (SELECT scan_id, v FROM sparse WHERE z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0), r AS (SELECT scan_id, min(v) AS a, CASE WHEN max(v) > min(v) THEN (max(v) - min(v)) / 32 ELSE 1 END AS w FROM q GROUP BY 1),
        h AS (SELECT r.scan_id, a, w, b AS bin, (SELECT count(*) FROM q WHERE q.scan_id = r.scan_id AND least(floor((q.v - r.a) / r.w), 31) = b) AS n FROM r, range(32) t(b)),
        p AS (SELECT *, n / sum(n) OVER (PARTITION BY scan_id)::DOUBLE AS p FROM h), c AS (SELECT scan_id, a, w, bin, sum(p) OVER o AS p0, sum(p * ln(p + 1e-10)) OVER o AS e0, sum(p * ln(p + 1e-10)) OVER (PARTITION BY scan_id) AS e FROM p WINDOW o AS (PARTITION BY scan_id ORDER BY bin))
        SELECT scan_id, a + (bin + 1) * w AS threshold FROM c WHERE bin < 31 QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY round(ln(p0 + 1e-10) - e0 / (p0 + 1e-10) + ln(1 - p0 + 1e-10) - (e - e0) / (1 - p0 + 1e-10), 9) DESC, bin) = 1""",
    "a31_union_foreground": labeled(140) + f", b AS (SELECT scan_id, component FROM n QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, component) = 1) SELECT DISTINCT {_CODE} FROM l JOIN b USING (scan_id, component)",
    "i1_label_components": labeled(135) + " SELECT scan_id, count(*) AS components, max(n) AS largest FROM n GROUP BY 1",
    "i1_island_cleanup": labeled(140) + """, b AS (SELECT scan_id, component FROM n QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, component) = 1), k AS (SELECT scan_id, c FROM l JOIN b USING (scan_id, component))
        SELECT d.scan_id, z, y, x, CASE WHEN v > 140 AND k.c IS NULL THEN min(v) OVER (PARTITION BY d.scan_id) ELSE v END AS v FROM dense d LEFT JOIN k ON k.scan_id = d.scan_id AND k.c = z * 16 + y * 4 + x""",
    "i2_fill_holes": f"{_REC}, {cells_where('w', 'v <= 118')}, {cells_where('o', f'v <= 118 AND {_BORDER}')}, {reached('r', 'o', 'w')} SELECT scan_id, z, y, x FROM dense d WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.scan_id = d.scan_id AND r.c = z * 16 + y * 4 + x)",
    "i10_hysteresis": f"{_REC}, {cells_where('w', 'v > 130')}, {cells_where('o', 'v > 150')}, {reached('r', 'o', 'w')} SELECT DISTINCT scan_id, {_CODE} FROM r",
    "i3_mesh_components": T("points").replace("WITH", "WITH RECURSIVE", 1) + f""", {_STRIP}, s AS (SELECT mesh_id, a AS p, b AS q FROM f UNION SELECT mesh_id, b, c FROM f UNION SELECT mesh_id, a, c FROM f), t AS (SELECT * FROM s UNION SELECT mesh_id, q, p FROM s),
        r AS (SELECT mesh_id, p AS root, p FROM t UNION SELECT r.mesh_id, r.root, t.q FROM r JOIN t ON t.mesh_id = r.mesh_id AND t.p = r.p) SELECT mesh_id, p AS vertex_id, min(root) AS component FROM r GROUP BY ALL""",
    "p8_intensity_maps": T("edits") + """, k AS (SELECT scan_id, kind AS filename, edit_number AS seq, edit_number % 5 - 2.0::DOUBLE AS o, power(2.0::DOUBLE, -sum(has_mask::INT) OVER (PARTITION BY scan_id, kind ORDER BY edit_number)) AS scale FROM edits)
        SELECT scan_id, filename, min(scale) AS mapping_scale, -sum(o * scale) AS mapping_shift FROM k GROUP BY ALL""",
    "u4_union_canvas": T("dense") + " SELECT " + ", ".join(f"greatest(min({a}) - 2, 0)::INT AS lo_{a}, (max({a}) + 2)::INT AS hi_{a}" for a in "zyx") + ", 1 AS stride FROM dense WHERE v > 128",
    "w15_best_checkpoint": """WITH r AS (SELECT o_custkey AS run, list({'epoch': o_orderkey, 'loss': o_totalprice::DOUBLE / 1e5, 'dice': (o_orderkey % 100) / 100.0::DOUBLE} ORDER BY o_orderkey) AS r FROM orders GROUP BY 1),
        b AS (SELECT run, list_reduce(r, lambda b, e: CASE WHEN e.loss < b.loss - greatest(1e-4, 0.002::DOUBLE * abs(b.loss)) OR abs(e.loss - b.loss) <= greatest(1e-4, 0.002::DOUBLE * abs(b.loss)) AND e.dice > b.dice THEN e ELSE b END) AS b FROM r)
        SELECT run, b.epoch AS epoch, b.loss AS loss, b.dice AS dice FROM b""",
    "s4_acquisition_log": "SELECT c_nationkey::VARCHAR AS folder, 'scan' AS section, unnest(['name', 'balance']) AS key, unnest([min(c_name), arg_min(c_acctbal::VARCHAR, c_name)]) AS value FROM customer GROUP BY 1",
    "a37_init_slice": T("dense") + """, o AS (SELECT DISTINCT scan_id, z FROM dense WHERE v > 126 AND v % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY z) - 1 AS i, count(*) OVER (PARTITION BY scan_id) AS n FROM o),
        s AS (SELECT scan_id, list(z ORDER BY z) AS s FROM r WHERE i >= n // 4 AND i < n - n // 4 GROUP BY 1) SELECT scan_id, s[len(s) // 2 + 1] AS slice FROM s""",
    "i5_decorrelate_fields": """WITH RECURSIVE v AS (SELECT vec_id AS scan_id, i AS id, embedding[i * 3 + 1]::DOUBLE AS x, embedding[i * 3 + 2]::DOUBLE AS y, embedding[i * 3 + 3]::DOUBLE AS z FROM embeddings, range(20) t(i)),
        m AS (SELECT id, round(var_pop(x) + var_pop(y) + var_pop(z), 9) AS variance FROM v GROUP BY 1), f AS (SELECT scan_id, id, unnest([x, y, z]) AS u, unnest([1, 2, 3]) AS k FROM v),
        c AS (SELECT a.id AS a, list(DISTINCT b) AS near FROM (SELECT a.id, b.id AS b, corr(a.u, b.u) AS r FROM f a JOIN f b ON b.scan_id = a.scan_id AND b.k = a.k AND b.id <> a.id AND abs(b.id - a.id) <= 4 GROUP BY ALL) a WHERE r >= 0.02 GROUP BY 1),
        o AS (SELECT m.id, variance, coalesce(near, []) AS near, row_number() OVER (ORDER BY variance DESC, m.id) AS i FROM m LEFT JOIN c ON c.a = m.id),
        g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT o.i, CASE WHEN list_has_any(near::BIGINT[], kept) THEN kept ELSE list_append(kept, id::BIGINT) END FROM g JOIN o ON o.i = g.i + 1)
        SELECT id::INT AS id, variance FROM o WHERE list_contains((SELECT kept FROM g ORDER BY i DESC LIMIT 1), id::BIGINT)""",
}
