"""Moving, cropping and selecting points, landmarks and voxels.

Points have x, y, z in millimetres; rotations are nine numbers r11 to r33, or a 3x3 list. What differs by scan is a
table keyed by scan_id, so one plan moves the whole cohort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def crop_landmarks(landmarks: DataFrame, boxes: DataFrame) -> DataFrame:
    """Keeps lo <= p / vs < hi, then shifts by pad - lo; boxes: scan_id, vs, pad, lo_x.. hi_z in voxels."""
    j = landmarks.join(boxes, "scan_id")
    inside = reduce(lambda a, b: a & b, [(F.col(a) / F.col("vs") >= F.col(f"lo_{a}")) & (F.col(a) / F.col("vs") < F.col(f"hi_{a}")) for a in AXES])
    moved = {a: (F.col(a) / F.col("vs") - F.col(f"lo_{a}") + F.col("pad")) * F.col("vs") for a in AXES}
    return j.where(inside).withColumns(moved).select(*landmarks.columns)


def crop_voxels(voxels: DataFrame, boxes: DataFrame, fill: int = 0) -> DataFrame:
    """The box [lo, hi) of each scan with a constant border of pad voxels; boxes: scan_id, pad, lo_z.. hi_x."""
    inside = reduce(lambda a, b: a & b, [(F.col(a) >= F.col(f"lo_{a}")) & (F.col(a) < F.col(f"hi_{a}")) for a in AXES])
    cut = voxels.join(boxes, "scan_id").where(inside).select("scan_id", *[(F.col(a) - F.col(f"lo_{a}") + F.col("pad")).alias(a) for a in ("z", "y", "x")], "v")
    span = lambda a: F.explode(F.sequence(F.lit(0), (F.col(f"hi_{a}") - F.col(f"lo_{a}") + 2 * F.col("pad") - 1).cast("int")))
    grid = boxes.select("*", span("z").alias("z")).select("*", span("y").alias("y")).select("*", span("x").alias("x")).select("scan_id", "z", "y", "x")
    return grid.join(cut, ["scan_id", "z", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(fill)))


def rotated(x: Column, y: Column, z: Column, r: list[list]) -> list[Column]:
    """Columns of R p, R's entries being numbers or columns."""
    return [r[i][0] * x + r[i][1] * y + r[i][2] * z for i in range(3)]


def entries(transpose: bool = False) -> list[list[Column]]:
    at = lambda i, j: F.col(f"r{j}{i}" if transpose else f"r{i}{j}")
    return [[at(i, j) for j in (1, 2, 3)] for i in (1, 2, 3)]


def rotate_landmarks(landmarks: DataFrame, poses: DataFrame) -> DataFrame:
    """R (p / vs - embed - origin), kept if inside the box [lo, hi), shifted to it and back in millimetres.

    poses: scan_id, vs, r11.., embed_x.., origin_x.., lo_x.., hi_x...
    """
    j = landmarks.join(poses, "scan_id")
    v = [F.col(a) / F.col("vs") - F.col(f"embed_{a}") - F.col(f"origin_{a}") for a in AXES]
    j = j.withColumns({f"__{a}": c for a, c in zip(AXES, rotated(*v, entries()), strict=True)})
    inside = reduce(lambda a, b: a & b, [(F.col(f"__{a}") >= F.col(f"lo_{a}")) & (F.col(f"__{a}") < F.col(f"hi_{a}")) for a in AXES])
    return j.where(inside).withColumns({a: (F.col(f"__{a}") - F.col(f"lo_{a}")) * F.col("vs") for a in AXES}).select(*landmarks.columns)


def invert_alignment(landmarks: DataFrame, poses: DataFrame) -> DataFrame:
    """Undoes shift, rotation, padding and scale; the shift is the crop's or else int(ref) - int(src) of the centroids.

    poses: scan_id, vs, vs_before, scale, r11.., pad_x.., shift_x.. (may be null), ref_x.., src_x..
    """
    j = landmarks.join(poses, "scan_id")
    v = [F.col(a) / F.col("vs") - F.coalesce(F.col(f"shift_{a}"), F.col(f"ref_{a}").cast("int") - F.col(f"src_{a}").cast("int")) for a in AXES]
    back = rotated(*v, entries(transpose=True))
    return j.withColumns({f"__{a}": (c - F.col(f"pad_{a}")) / F.col("scale") * F.col("vs_before") for a, c in zip(AXES, back, strict=True)}).withColumns({a: F.col(f"__{a}") for a in AXES}).select(*landmarks.columns)


def scale_mm_assets(points: DataFrame, factors: DataFrame) -> DataFrame:
    """All coordinates times new / old voxel size; factors: scan_id, old, new."""
    f = F.col("new") / F.col("old")
    return points.join(factors, "scan_id").withColumns({a: F.col(a) * f for a in AXES}).drop("old", "new")


def scale_about_center(points: DataFrame, c: tuple[float, float, float], target: float, measured: float) -> DataFrame:
    s = target / measured
    return points.withColumns({a: c[k] + s * (F.col(a) - c[k]) for k, a in enumerate(AXES)})


def mesh_reference_prism(vertices: DataFrame, vs: float, pad: float = 0.0) -> DataFrame:
    """Per mesh: corner of the padded box and its shape in voxels, at least 1 each."""
    box = vertices.groupBy("scan_id").agg(*[f(a).alias(n + a) for a in AXES for f, n in ((F.min, "lo_"), (F.max, "hi_"))])
    corner = [(F.col(f"lo_{a}") - pad).alias(f"corner_{a}") for a in AXES]
    shape = [F.greatest(F.ceil((F.col(f"hi_{a}") - F.col(f"lo_{a}") + 2 * pad) / vs), F.lit(1)).cast("int").alias(f"n_{a}") for a in AXES]
    return box.select("scan_id", *corner, *shape)


def to_shared_frame(vertices: DataFrame, corners: DataFrame) -> DataFrame:
    """Moves meshes that aren't aligned to the reference; corners: scan_id, move, s_x.., r_x.. (subject's and reference's corner)."""
    j = vertices.join(corners, "scan_id")
    return j.withColumns({a: F.col(a) + F.when(F.col("move"), F.col(f"s_{a}") - F.col(f"r_{a}")).otherwise(F.lit(0.0)) for a in AXES}).select(*vertices.columns)


def crop_reorigin(points: DataFrame, mins: DataFrame, pad: float) -> DataFrame:
    """Adds pad - min on each axis; mins: scan_id, min_x, min_y, min_z."""
    return points.join(mins, "scan_id").withColumns({a: F.col(a) + pad - F.col(f"min_{a}") for a in AXES}).select(*points.columns)


def inside_planes(planes: list[tuple], tolerance: float = 1e-7) -> Column:
    """Whether a point is on the inner side of every plane (ox, oy, oz, nx, ny, nz)."""
    tests = [(F.col("x") - p[0]) * p[3] + (F.col("y") - p[1]) * p[4] + (F.col("z") - p[2]) * p[5] >= -tolerance for p in planes]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def wedge_select(points: DataFrame, operations: list[tuple[str, list[tuple]]]) -> DataFrame:
    """Ordered isolate and delete operations, each with the planes of its wedge."""
    kept = [inside_planes(planes) if what == "isolate" else ~inside_planes(planes) for what, planes in operations]
    return points.where(reduce(lambda a, b: a & b, kept, F.lit(True)))


def corners_of(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """faces (mesh_id, face_id, a, b, c) with ax.. cz of their vertices (mesh_id, vertex_id, x, y, z)."""
    out = faces
    for k in ("a", "b", "c"):
        v = vertices.select("mesh_id", F.col("vertex_id").alias(k), *[F.col(a).alias(f"{k}{a}") for a in AXES])
        out = out.join(v, ["mesh_id", k])
    return out


def classify_faces(faces: DataFrame, planes: list[tuple], tolerance: float = 1e-7) -> DataFrame:
    """inside, outside or boundary, by whether all, none or some corners are inside; faces as from corners_of."""
    def corner(k):
        tests = [(F.col(f"{k}x") - p[0]) * p[3] + (F.col(f"{k}y") - p[1]) * p[4] + (F.col(f"{k}z") - p[2]) * p[5] >= -tolerance for p in planes]
        return reduce(lambda a, b: a & b, tests).cast("int")

    n = corner("a") + corner("b") + corner("c")
    return faces.select("mesh_id", "face_id", F.when(n == 3, "inside").when(n == 0, "outside").otherwise("boundary").alias("side"))


def clip_boundary_faces(faces: DataFrame, planes: list[tuple]) -> DataFrame:
    """The inner part of each triangle, cut at one plane after another (Sutherland-Hodgman), as a fan of triangles.

    Returns mesh_id, face_id, part, ax.. cz; faces as from corners_of.
    """
    point = lambda k: F.struct(*[F.col(f"{k}{a}").alias(a) for a in AXES])
    polygon = F.array(point("a"), point("b"), point("c"))
    out = faces.select("mesh_id", "face_id", polygon.alias("p"))
    for ox, oy, oz, nx, ny, nz in planes:
        def side(q, o=(ox, oy, oz), n=(nx, ny, nz)):
            return (q["x"] - o[0]) * n[0] + (q["y"] - o[1]) * n[1] + (q["z"] - o[2]) * n[2]

        def cut(q, r, side=side):
            t = side(q) / (side(q) - side(r))
            return F.struct(*[(q[a] + t * (r[a] - q[a])).alias(a) for a in AXES])

        none = F.array().cast("array<struct<x:double,y:double,z:double>>")
        pairs = F.arrays_zip(F.col("p").alias("q"), F.concat(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1)).alias("r"))
        step = _edge_step(side, cut, none)
        out = out.withColumn("p", F.when(F.size("p") >= 3, F.flatten(F.transform(pairs, step))).otherwise(none))
    fan = out.where(F.size("p") >= 3).select("mesh_id", "face_id", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 2)).alias("part"))
    pick = lambda i, k: [F.element_at("p", i)[a].alias(f"{k}{a}") for a in AXES]
    return fan.select("mesh_id", "face_id", "part", *pick(F.lit(1), "a"), *pick(F.col("part") + 1, "b"), *pick(F.col("part") + 2, "c"))


def _edge_step(side, cut, none):
    def step(e):
        q, r = e["q"], e["r"]
        start = F.when(side(q) >= 0, F.array(q)).otherwise(none)
        crossing = F.when((side(q) >= 0) != (side(r) >= 0), F.array(cut(q, r))).otherwise(none)
        return F.concat(start, crossing)

    return step


def cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def face_normals(faces: DataFrame) -> DataFrame:
    """Unit normal and area of each face; lengths under 1e-12 count as that."""
    side = lambda k: [F.col(f"{k}{a}") - F.col(f"a{a}") for a in AXES]
    n = cross(side("b"), side("c"))
    length = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    unit = [(c / F.greatest(length, F.lit(1e-12))).alias(f"n{a}") for a, c in zip(AXES, n, strict=True)]
    return faces.select("mesh_id", "face_id", *unit, (length / 2).alias("area"))


def rasterize_points(points: DataFrame, pitch: float, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Distinct cells floor(p / pitch + 1e-6), inside the shape (x, y, z) if one is given."""
    cells = points.select("scan_id", *[F.floor(F.col(a) / pitch + 1e-6).cast("int").alias(a) for a in AXES])
    if shape:
        cells = cells.where(reduce(lambda a, b: a & b, [F.col(a).between(0, n - 1) for a, n in zip(AXES, shape, strict=True)]))
    return cells.distinct()


def affine_field(grid: DataFrame, a: list[list[float]], t: list[float]) -> DataFrame:
    """Displacement A p + t - p at every cell of the grid."""
    moved = rotated(F.col("x"), F.col("y"), F.col("z"), a)
    return grid.withColumns({f"u{k}": moved[i] + t[i] - F.col(k) for i, k in enumerate(AXES)})


def rotate_about_center(points: DataFrame, r: list[list[float]], c: tuple[float, float, float]) -> DataFrame:
    """(p - c) R + c with p as a row."""
    d = [F.col(a) - c[k] for k, a in enumerate(AXES)]
    new = [d[0] * r[0][j] + d[1] * r[1][j] + d[2] * r[2][j] + c[j] for j in range(3)]
    return points.withColumns(dict(zip(AXES, new, strict=True)))


