"""Nearest-neighbour and distance joins in space.

A cloud is dealt into cubic cells; a point looks into its own cell and the 26 around it, which is an equi-join. Points that
find fewer than k neighbours within one cell width go down a tree of cells, so answers are exact at any density. Triangles are listed in
cells of their own size, large ones in coarser cells; points with none within one width go down the tree as well.
Groups of points (scan, cohort, mesh) are part of the key. Nothing here compares all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import over_blocks
from .geometry import AXES, cross
from .tables import written

#: Larger coordinates are as good as infinite: cells are numbered by longs.
FARTHEST = 1e15
NEIGHBOURS = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


def usable(columns: list[str]) -> Column:
    """That all of the coordinates are numbers: neither null nor NaN nor infinite."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.abs(F.col(c)) <= FARTHEST, F.lit(False))  # NaN is above all numbers
    return out


def in_cells(points: DataFrame, width, names=("gx", "gy", "gz"), around: bool = False) -> DataFrame:
    """points with their cell; with around, a row for each of the 27 cells beside it."""
    cells = [F.floor(F.col(a) / width) for a in AXES]
    if not around:
        return points.withColumns(dict(zip(names, cells, strict=True)))
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("ijk", s, strict=True)]) for s in NEIGHBOURS]))
    sent = points.select("*", steps.alias("__s"))
    return sent.withColumns({n: c + F.col(f"__s.{s}") for n, c, s in zip(names, cells, "ijk", strict=True)}).drop("__s")


def group_widths(cloud: DataFrame, group: list[str], per_cell: float = 2.0, most: float = 16.0, sample: int = 1_000_000) -> DataFrame:
    """The group, __have (its points), __w (a cell width) and __levels (doublings of it that span the group's box).

    The width gives the box about per_cell points a cell; where the points crowd, it is halved, at most seven times, until a point shares its
    cell with at most `most` others on average. That is judged on a sample of about `sample` points in all; the width changes speed, not results.
    """
    extent = F.greatest(*[F.max(a) - F.min(a) for a in AXES], F.lit(1e-9))
    least = F.greatest(*[F.max(F.abs(a)) for a in AXES]) / FARTHEST
    boxes = written(cloud.groupBy(*group).agg(F.count("*").alias("__have"), extent.alias("__extent"), least.alias("__least")))
    boxes = boxes.withColumn("__w0", F.greatest(F.col("__extent") / F.greatest(F.cbrt(F.col("__have") / per_cell), F.lit(1.0)), "__least", F.lit(1e-9)))
    share = min(1.0, sample / max(boxes.agg(F.sum("__have")).first()[0] or 0, 1))
    some = cloud.select(*group, *AXES) if share == 1 else cloud.select(*group, *AXES).sample(share, seed=7)
    some = some.join(boxes.select(*group, "__w0"), group) if group else some.join(F.broadcast(boxes.select("__w0")))
    level = some.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(7))))
    cells = level.groupBy(*group, "__level", *[F.floor(F.col(a) * F.pow(F.lit(2.0), "__level") / F.col("__w0")).alias(f"g{a}") for a in AXES]).agg(F.count("*").alias("__c"))
    crowd = cells.groupBy(*group, "__level").agg((F.sum(F.col("__c") * (F.col("__c") - 1)) / F.sum("__c") / share).alias("__others"))
    chosen = crowd.groupBy(*group).agg(F.coalesce(F.min(F.when(F.col("__others") <= most, F.col("__level"))), F.lit(7)).alias("__level"))
    out = boxes.join(chosen, group, "left") if group else boxes.join(F.broadcast(chosen), F.lit(True), "left")
    width = F.greatest(F.col("__w0") / F.pow(F.lit(2.0), F.coalesce("__level", F.lit(0))), "__least", F.lit(1e-9))
    return out.withColumn("__w", width).select(*group, "__have", "__w", spanning(F.col("__extent"), F.col("__w")))


def spanning(extent: Column, width: Column) -> Column:
    return (F.ceil(F.log2(F.greatest(extent / width, F.lit(1.0)))) + 1).cast("int").alias("__levels")


def nearest_point(points: DataFrame, cloud: DataFrame, k: int = 1, group: list[str] | None = None, width: float | None = None) -> DataFrame:
    """id, neighbour, distance and rank of the k nearest; ties go to the lower neighbour id. points and cloud: id, x, y, z and the group.

    A point whose group has no cloud, or with a coordinate that is null, NaN or infinite, gets one row with null
    neighbour and infinite distance; such points of the cloud count as absent.

    Each group has its own cell width, from how its points lie. A point looks into the 27 cells around it; what finds too little within one
    width descends a tree of cells instead (see descend), so that points far from a crowd never meet all of it. Of cloud points in one
    place only the k lowest ids can be neighbours, and only they are kept.
    """
    group = group or []
    cloud = cloud.where(usable(list(AXES))).select(*group, "id", *AXES)
    sizes = group_widths(cloud, group) if width is None else cloud.groupBy(*group).agg(F.count("*").alias("__have"), F.lit(float(width)).alias("__w"), spanning(F.greatest(*[F.max(a) - F.min(a) for a in AXES]), F.lit(float(width))))
    sizes = written(sizes)
    joined = lambda d, how: d.join(sizes, group, how) if group else d.join(F.broadcast(sizes))
    place = W.partitionBy(*group, *AXES).orderBy("id")
    apart = cloud.withColumn("__r", F.row_number().over(place)).where(F.col("__r") <= k)
    keys = ["gx", "gy", "gz"]
    c = written(joined(apart, "inner").select(*group, F.col("id").alias("neighbour"), *[F.col(a).alias(f"n{a}") for a in AXES], *[F.floor(F.col(a) / F.col("__w")).alias(n) for n, a in zip(keys, AXES, strict=True)]))
    p = joined(points.select(*group, "id", *AXES), "left")
    lost = ~usable(list(AXES)) | (F.coalesce("__have", F.lit(0)) == 0)
    out = p.where(lost).select(*group, "id", F.lit(None).cast("long").alias("neighbour"), F.lit(float("inf")).alias("distance"), F.lit(1).alias("rank"))
    left = written(p.where(~lost).withColumn("want", F.least(F.col("__have"), F.lit(k))))
    measured = lambda met: met.withColumn("distance", F.sqrt(sum((F.col(a) - F.col(f"n{a}")) ** 2 for a in AXES)))
    best = lambda met: met.withColumn("rank", F.row_number().over(W.partitionBy(*group, "id").orderBy("distance", "neighbour"))).where(F.col("rank") <= k)
    # cells beyond one width, and pairs beyond it, can't settle a point: they are left out before pairs are sorted
    gap = lambda a, n: F.greatest(F.col(n) * F.col("__w") - F.col(a), F.col(a) - (F.col(n) + 1) * F.col("__w"), F.lit(0.0))
    close = F.sqrt(sum(gap(a, n) ** 2 for a, n in zip(AXES, keys, strict=True))) <= F.col("__w") * (1 + 1e-9) + F.greatest(*[F.abs(a) for a in AXES]) * 1e-12
    met = measured(in_cells(left, F.col("__w"), around=True).where(close).join(c, [*group, *keys])).where(F.col("distance") <= F.col("__w"))
    found = written(best(met).select(*group, "id", "neighbour", "distance", "rank", "want"))
    settled = found.groupBy(*group, "id").agg(F.count("*").alias("n"), F.first("want").alias("want")).where(F.col("n") >= F.col("want")).select(*group, "id")
    result = ["id", "neighbour", "distance", "rank"]
    out = out.union(found.join(settled, [*group, "id"], "left_semi").select(*group, *result))
    rest = written(left.join(settled, [*group, "id"], "left_anti"))
    levels = rest.agg(F.max("__levels")).first()[0]
    if levels is None:
        return out
    leaves = descend(rest, c, group, levels)
    return out.union(best(measured(leaves.join(c, [*group, *keys]))).select(*group, *result))


def descend(points: DataFrame, cloud: DataFrame, group: list[str], levels: int) -> DataFrame:
    """The cells (gx, gy, gz) of the cloud that may hold one of a point's `want` nearest, found from the largest cells down.

    Cells of each level join eight of the one below and know their points' count and box. A cell goes when its box is farther than
    others that hold `want` points together; the rest are opened. So a point meets few cells of each level, however many points they hold.
    What the cloud holds is points nx, ny, nz, or has boxes lo_x to hi_z.
    """
    keys = ["gx", "gy", "gz"]
    box = [(f"{f}{a}", g) for a in AXES for f, g in (("lo_", F.min), ("hi_", F.max))]
    ends = {n: n if n in cloud.columns else f"n{n[3:]}" for n, _ in box}
    tree = [written(cloud.groupBy(*group, *keys).agg(F.count("*").alias("__n"), *[g(ends[n]).alias(n) for n, g in box]))]
    for at in range(1, levels + 1):  # every third level is written, the two above it come from it
        base = (at - 1) // 3 * 3
        up = tree[base].withColumns({n: F.shiftright(n, at - base) for n in keys})
        level = up.groupBy(*group, *keys).agg(F.sum("__n").alias("__n"), *[g(n).alias(n) for n, g in box])
        tree.append(written(level) if at % 3 == 0 else level)
    mine = [*group, "id", *AXES, "want"]
    low, high = F.col("__near"), F.col("__far")
    gap = lambda a: F.greatest(F.col(f"lo_{a}") - F.col(a), F.col(a) - F.col(f"hi_{a}"), F.lit(0.0))
    reach = lambda a: F.greatest(F.abs(F.col(a) - F.col(f"lo_{a}")), F.abs(F.col(a) - F.col(f"hi_{a}")))
    own = W.partitionBy(*group, "id")
    met = points.select(*mine).join(tree[-1], group) if group else points.select(*mine).join(F.broadcast(tree[-1]))
    for at in range(levels, -1, -1):
        far = met.withColumns({"__near": sum(gap(a) ** 2 for a in AXES), "__far": sum(reach(a) ** 2 for a in AXES)})
        held = far.withColumn("__sum", F.sum("__n").over(own.orderBy("__far", *keys).rowsBetween(W.unboundedPreceding, 0)))
        bound = held.withColumn("__bound", F.min(F.when(F.col("__sum") >= F.col("want"), high)).over(own)).where(low <= F.col("__bound"))
        kept = written(bound.select(*mine, *keys)) if at % 3 == 0 else bound.select(*mine, *keys)
        if at:
            below = tree[at - 1].withColumnsRenamed({n: f"__{n}" for n in keys}).withColumns({n: F.shiftright(f"__{n}", 1) for n in keys})
            met = kept.join(below, [*group, *keys]).drop(*keys).withColumnsRenamed({f"__{n}": n for n in keys})
    return kept


def radius_pairs(points: DataFrame, r: float, group: list[str] | None = None) -> DataFrame:
    """Pairs a < b of points at most r apart, with their distance."""
    group = group or []
    other = in_cells(points, r).select(*group, "gx", "gy", "gz", F.col("id").alias("b"), *[F.col(a).alias(f"n{a}") for a in AXES])
    met = in_cells(points.select(*group, F.col("id").alias("a"), *AXES), r, around=True).join(other, [*group, "gx", "gy", "gz"]).where("a < b")
    d = F.sqrt(sum((F.col(a) - F.col(f"n{a}")) ** 2 for a in AXES))
    return met.select(*group, "a", "b", d.alias("distance")).where(F.col("distance") <= r)


def dot(u: list[Column], v: list[Column]) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def with_closest(df: DataFrame) -> DataFrame:
    """Adds sx, sy, sz and distance: the point of triangle a b c (ax.. cz) that is closest to x, y, z, inside it or on an edge.

    The steps are columns of their own, so that each is computed once.
    """
    at = lambda k: [F.col(f"{k}{a}") for a in AXES]
    minus = lambda u, v: [x - y for x, y in zip(u, v, strict=True)]
    named = lambda k, u: {f"{k}{a}": x for a, x in zip(AXES, u, strict=True)}
    p = [F.col(a) for a in AXES]
    df = df.withColumns(named("__n", cross(minus(at("b"), at("a")), minus(at("c"), at("a")))))
    df = df.withColumn("__nn", dot(at("__n"), at("__n")))
    df = df.withColumn("__h", F.when(F.col("__nn") > 0, dot(minus(p, at("a")), at("__n")) / F.col("__nn")))
    df = df.withColumns(named("__q", [x - F.col("__h") * n for x, n in zip(p, at("__n"), strict=True)]))
    sides = [("a", "b"), ("b", "c"), ("c", "a")]
    inner = [dot(cross(minus(at(e), at(s)), minus(at("__q"), at(s))), at("__n")) >= 0 for s, e in sides]
    df = df.withColumn("__in", F.coalesce(inner[0] & inner[1] & inner[2], F.lit(False)))
    for k, (s, e) in enumerate(sides):
        d = minus(at(e), at(s))
        length = dot(d, d)
        t = F.when(length > 0, F.least(F.greatest(dot(minus(p, at(s)), d) / length, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
        df = df.withColumn(f"__t{k}", t)
        df = df.withColumns(named(f"__e{k}", [x + F.col(f"__t{k}") * y for x, y in zip(at(s), d, strict=True)]))
        df = df.withColumn(f"__d{k}", dot(minus(p, at(f"__e{k}")), minus(p, at(f"__e{k}"))))
    low = F.least("__d0", "__d1", "__d2")
    pick = lambda a: F.when(F.col("__in"), F.col(f"__q{a}")).when(F.col("__d0") == low, F.col(f"__e0{a}")).when(F.col("__d1") == low, F.col(f"__e1{a}")).otherwise(F.col(f"__e2{a}"))
    df = df.withColumns({f"s{a}": pick(a) for a in AXES})
    df = df.withColumn("distance", F.sqrt(dot(minus(p, at("s")), minus(p, at("s")))))
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def face_widths(faces: DataFrame, group: list[str], low: dict, high: dict, width: float | None) -> DataFrame:
    """The group, __w (a cell width) and __levels (doublings of it that span the group's box).

    About two triangles a cell, but a fifth to twice their geometric mean extent, which a few huge triangles hardly move. The width changes speed, not results.
    """
    own = F.exp(F.avg(F.log(F.greatest(*[high[a] - low[a] for a in AXES], F.lit(1e-9)))))
    extent = F.greatest(*[F.max(high[a]) - F.min(low[a]) for a in AXES])
    least = F.greatest(*[F.max(F.greatest(F.abs(low[a]), F.abs(high[a]))) for a in AXES]) / FARTHEST
    boxes = faces.groupBy(*group).agg(F.count("*").alias("__n"), own.alias("__own"), extent.alias("__extent"), least.alias("__least")).where("__n > 0")
    dealt = F.col("__extent") / F.greatest(F.cbrt(F.col("__n") / 2), F.lit(1.0))
    w = F.least(F.greatest(dealt, F.col("__own") / 5), F.col("__own") * 2) if width is None else F.lit(float(width))
    return boxes.withColumn("__w", F.greatest(w, "__least", F.lit(1e-9))).select(*group, "__w", spanning(F.col("__extent"), F.col("__w")))


def salted(points: DataFrame, listed: DataFrame, keys: list[str], share: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Both sides with __salt: cells that hold over 1/share of the points' rows are dealt into parts of that size, and what is listed in them is repeated for each.

    There are fewer than `share` such cells, so their table is broadcast at any size of the input.
    """
    part = max(points.count() // share, 1000)
    hot = written(points.groupBy(*keys).agg(F.count("*").alias("__c")).where(F.col("__c") > part).select(*keys, F.ceil(F.col("__c") / part).alias("__parts")))
    with_parts = lambda d: d.join(F.broadcast(hot), keys, "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    p = with_parts(points).withColumn("__salt", F.pmod(F.xxhash64("id", *AXES), F.col("__parts"))).drop("__parts")
    return p, with_parts(listed).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1))).drop("__parts")


def listed_faces(sized: DataFrame, low: dict, high: dict) -> DataFrame:
    """Each triangle in the cells of its level that may hold a point at most __w from it: gx, gy, gz, and its unit normal __nx, __ny, __nz (null if it is too thin).

    Cells of level l are __w * 2^l wide, and no triangle is over four of its level's widths long, so a huge one has no more cells than a small one.
    Cells far from the triangle's plane are left out, unless it is too thin to have a sure one.
    """
    sides = [[F.col(f"{k}{a}") - F.col(f"a{a}") for a in AXES] for k in "bc"]
    made = sized.withColumns({f"__n{a}": x for a, x in zip(AXES, cross(*sides), strict=True)})
    n = [F.col(f"__n{a}") for a in AXES]
    made = made.withColumns({"__l": F.sqrt(dot(n, n)), "__thin": F.sqrt(dot(n, n)) <= 1e-6 * F.sqrt(dot(sides[0], sides[0]) * dot(sides[1], sides[1])), "__cell": F.col("__w") * F.pow(F.lit(2.0), "__level")})
    cells = ("gx", "gy", "gz")
    for c, a in zip(cells, AXES, strict=True):
        made = made.withColumn(c, F.explode(F.sequence(F.floor((low[a] - F.col("__w") * 1.001) / F.col("__cell")), F.floor((high[a] + F.col("__w") * 1.001) / F.col("__cell")))))
    centre = [(F.col(c) + 0.5) * F.col("__cell") - F.col(f"a{a}") for c, a in zip(cells, AXES, strict=True)]
    # half a cell's diagonal is below 0.867 widths; the rest is for rounding
    near = F.abs(dot(centre, n)) <= (0.88 * F.col("__cell") + 1.01 * F.col("__w")) * F.col("__l")
    kept = made.where(F.col("__thin") | near)
    return kept.withColumns({f"__n{a}": F.when(~F.col("__thin"), F.col(f"__n{a}") / F.col("__l")) for a in AXES}).drop("__l", "__thin", "__cell")


def _pair_distances(p: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Distances of points (3 x n) to triangles (corner, axis, n), as in with_closest."""
    dots = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    n = np.cross(corner[1] - corner[0], corner[2] - corner[0], axis=0)
    nn = dots(n, n)
    q = p - np.where(nn > 0, dots(p - corner[0], n) / np.where(nn > 0, nn, 1.0), np.nan) * n
    inner, best = nn > 0, np.full(p.shape[1], np.inf)
    for s, e in ((0, 1), (1, 2), (2, 0)):
        d = corner[e] - corner[s]
        length = dots(d, d)
        inner &= dots(np.cross(d, q - corner[s], axis=0), n) >= 0
        off = p - (corner[s] + np.clip(np.where(length > 0, dots(p - corner[s], d) / np.where(length > 0, length, 1.0), 0.0), 0.0, 1.0) * d)
        best = np.minimum(best, dots(off, off))
    return np.sqrt(np.where(inner, dots(p - q, p - q), best))


def _nearest_pairs(group: list[str]) -> Callable:
    """Rows of points (asked) and triangles (listed) of one cell: each point with those triangles of the row that are nearest to it, within 1.001 w.

    Box and plane give a lower bound of every distance; the triangles of least bound are measured first, and then only those whose bound is no
    larger than what was found. Whatever rounding may decide stays in: the exact choice is made on what comes out.
    """
    corners = [f"{k}{a}" for k in "abc" for a in AXES]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            lists = {c: (batch.column(c).values, np.asarray(batch.column(c).offsets)) for c in ("asked", "listed")}
            numbers = lambda side, c: np.array(lists[side][0].field(c).to_numpy(zero_copy_only=False), float)
            every = np.stack([numbers("asked", a) for a in AXES])
            width = numbers("asked", "w")
            shape = np.stack([numbers("listed", c) for c in corners]).reshape(3, 3, -1)
            normal = np.stack([numbers("listed", f"__n{a}") for a in AXES])
            low, high = shape.min(0), shape.max(0)
            for i in range(batch.num_rows):
                (a0, a1), (l0, l1) = (lists[c][1][i : i + 2] for c in ("asked", "listed"))
                p, reach = every[:, a0:a1], 1.001 * width[a0:a1, None]
                bound = np.zeros((a1 - a0, l1 - l0))
                plane = 0.0
                for k in range(3):
                    at = p[k][:, None]
                    bound = np.maximum(bound, np.maximum(low[k, l0:l1] - at, at - high[k, l0:l1]))
                    plane = plane + (at - shape[0, k, l0:l1]) * normal[k, l0:l1]
                bound = np.fmax(bound, np.abs(plane) * (1 - 1e-6))  # no normal: NaN, which fmax passes over
                bound = np.where(bound <= reach, bound, np.inf)
                some = min(8, l1 - l0)
                first = np.argpartition(bound, some - 1, axis=1)[:, :some]
                row, col = np.repeat(np.arange(a1 - a0), some), first.ravel()
                near = _pair_distances(p[:, row], shape[:, :, l0 + col]).reshape(-1, some).min(1)
                enough = np.minimum(near, reach[:, 0]) * (1 + 1e-6)
                row, col = np.nonzero(bound <= enough[:, None])
                for begin in range(0, len(row), 1 << 18):
                    r, c = row[begin : begin + (1 << 18)], col[begin : begin + (1 << 18)]
                    d = _pair_distances(p[:, r], shape[:, :, l0 + c])
                    np.minimum.at(enough, r, d * (1 + 1e-6))
                    kept = d <= enough[r]
                    out.append((np.full(kept.sum(), i), a0 + r[kept], l0 + c[kept]))
            which, point, face = (np.concatenate(c) if out else np.zeros(0, int) for c in (zip(*out, strict=True) if out else ((), (), ())))
            asked, listed = (lists[c][0].take(pa.array(rows)) for c, rows in (("asked", point), ("listed", face)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(g).take(pa.array(which)) for g in group], *[asked.field(c) for c in ("id", *AXES, "w")], *[listed.field(c) for c in ("face_id", *corners)]], names=[*group, "id", *AXES, "w", "face_id", *corners])

    return solve


def nearest_of_cells(asked: DataFrame, listed: DataFrame, cell: list[str], group: list[str]) -> DataFrame:
    """The group, id, x, y, z, w, face_id and corners of pairs of one cell that may be nearest: blocks of its points meet blocks of its triangles."""
    def packed(df: DataFrame, name: str, key: str, columns: list[str], size: int) -> DataFrame:
        at = F.floor((F.row_number().over(W.partitionBy(*cell).orderBy(key)) - 1) / size)
        return df.withColumn(f"__{name}", at).groupBy(*cell, f"__{name}").agg(F.collect_list(F.struct(*columns)).alias(name)).drop(f"__{name}")

    corners = [f"{k}{a}" for k in "abc" for a in AXES]
    places = [F.col(a).cast("double").alias(a) for a in AXES]
    p = packed(asked.select(*cell, "id", *places, F.col("w").cast("double").alias("w")), "asked", "id", ["id", *AXES, "w"], 256)
    f = packed(listed.select(*cell, "face_id", *[F.col(c).cast("double").alias(c) for c in corners], *[f"__n{a}" for a in AXES]), "listed", "face_id", ["face_id", *corners, *[f"__n{a}" for a in AXES]], 1024)
    fields = [*[T.StructField(g, asked.schema[g].dataType) for g in group], T.StructField("id", asked.schema["id"].dataType), *[T.StructField(c, T.DoubleType()) for c in (*AXES, "w")], T.StructField("face_id", listed.schema["face_id"].dataType), *[T.StructField(c, T.DoubleType()) for c in corners]]
    return p.join(f.hint("merge"), cell).select(*group, "asked", "listed").mapInArrow(_nearest_pairs(group), T.StructType(fields))


def surface_distance(points: DataFrame, faces: DataFrame, group: list[str] | None = None, width: float | None = None) -> DataFrame:
    """id, face_id, distance and closest point sx, sy, sz on the nearest triangle (ties: lower face_id).

    Each group has its own cell width. A triangle is listed in cells of a size that suits it (see listed_faces); a point looks into its own cell
    of each size that its group uses, which finds all triangles within one width. Points that find none that near go down a tree of the
    cells of the triangles' middles, with the boxes of all they hold (see descend), so that a far point never meets a whole mesh.
    faces: face_id, ax.. cz as from corners_of, and the group. Points of groups without faces, and those with a coordinate
    that is null, NaN or infinite, have a null face and an infinite distance; faces with such a corner count as absent.
    """
    group = group or []
    corners = [f"{k}{a}" for k in "abc" for a in AXES]
    faces = faces.where(usable(corners)).select(*group, "face_id", *corners)
    low = {a: F.least(*[F.col(f"{k}{a}") for k in "abc"]) for a in AXES}
    high = {a: F.greatest(*[F.col(f"{k}{a}") for k in "abc"]) for a in AXES}
    sizes = written(face_widths(faces, group, low, high, width))
    joined = lambda d, other, how: d.join(other, group, how) if group else d.join(F.broadcast(other), F.lit(True), how)
    level = F.greatest(F.ceil(F.log2(F.greatest(*[high[a] - low[a] for a in AXES]) / (4 * F.col("__w")))), F.lit(0)).cast("int")
    sized = written(joined(faces, sizes, "inner").withColumn("__level", F.coalesce(level, F.lit(0))))
    used = sized.groupBy(*group).agg(F.first("__w").alias("__w"), F.first("__levels").alias("__levels"), F.collect_set("__level").alias("__used"))
    known = joined(points.select(*group, "id", *AXES), used.where(F.size("__used") > 0), "left")
    known = written(known.withColumn("__some", F.col("__w").isNotNull() & usable(list(AXES))))
    left = known.where("__some").drop("__some")
    none = F.lit(None).cast("double")
    out = known.where("NOT __some").select(*group, "id", F.lit(None).cast(faces.schema["face_id"].dataType).alias("face_id"), F.lit(float("inf")).alias("distance"), none.alias("sx"), none.alias("sy"), none.alias("sz"))
    keys = ["gx", "gy", "gz"]
    order = W.partitionBy(*group, "id").orderBy("distance", "face_id")
    best = lambda near: near.withColumn("r", F.row_number().over(order)).where("r = 1")
    result = [*group, "id", "face_id", "distance", "sx", "sy", "sz"]
    asked = left.select(*group, "id", *AXES, "__w", F.explode("__used").alias("__level"))
    asked = asked.withColumns({n: F.floor(F.col(a) / (F.col("__w") * F.pow(F.lit(2.0), "__level"))) for n, a in zip(keys, AXES, strict=True)}).withColumnRenamed("__w", "w")
    asked, listed = salted(asked, listed_faces(sized, low, high).drop("__w", "__levels"), [*group, "__level", *keys])
    met = nearest_of_cells(asked, listed, [*group, "__level", *keys, "__salt"], group)
    found = written(best(with_closest(met)).where(F.col("distance") <= F.col("w")).select(*result))
    out = out.union(found)
    rest = written(left.join(found, [*group, "id"], "left_anti").withColumn("want", F.lit(1)))
    levels = rest.agg(F.max("__levels")).first()[0]
    if levels is None:
        return out
    middle = {n: F.floor((low[a] / 2 + high[a] / 2) / F.col("__w")) for n, a in zip(keys, AXES, strict=True)}
    boxed = sized.withColumns(middle | {f"lo_{a}": low[a] for a in AXES} | {f"hi_{a}": high[a] for a in AXES})
    leaves = descend(rest, boxed, group, levels)
    leaves, held = salted(leaves, boxed.select(*group, *keys, "face_id", *corners), [*group, *keys])
    return out.union(best(with_closest(leaves.join(held, [*group, *keys, "__salt"]))).select(*result))


def snap_landmarks(landmarks: DataFrame, faces: DataFrame, most: float, group: list[str] | None = None) -> DataFrame:
    """Landmarks moved to the closest surface point; those farther than `most` are dropped. Keeps the distance as snap_distance."""
    near = surface_distance(landmarks, faces, group).where(F.col("distance") <= most)
    moved = landmarks.join(near, [*(group or []), "id"])
    return moved.withColumns({a: F.col(f"s{a}") for a in AXES}).withColumnRenamed("distance", "snap_distance").drop("sx", "sy", "sz", "face_id")


def parallel_surface_distance(points: DataFrame, faces: DataFrame, group: list[str] | None = None) -> DataFrame:
    """max(|n (q - c)|, max(0, |tangent| - tol)) against the closest surface point c, tol = max(1e-4, 5 % of the median edge).

    points also has its own normal nx, ny, nz.
    """
    edge = lambda u, v: F.sqrt(sum((F.col(f"{u}{a}") - F.col(f"{v}{a}")) ** 2 for a in AXES))
    tol = max(1e-4, 0.05 * (faces.select(F.explode(F.array(edge("a", "b"), edge("b", "c"), edge("c", "a"))).alias("e")).agg(F.median("e")).first()[0] or 0.0))
    near = surface_distance(points, faces, group).where("face_id IS NOT NULL").join(points, [*(group or []), "id"])
    d = [F.col(a) - F.col(f"s{a}") for a in AXES]
    along = dot([F.col(f"n{a}") for a in AXES], d)
    tangent = F.sqrt(F.greatest(dot(d, d) - along * along, F.lit(0.0)))
    return near.select(*(group or []), "id", F.greatest(F.abs(along), F.greatest(tangent - tol, F.lit(0.0))).alias("distance"))


def knn_propagate(full: DataFrame, control: DataFrame, k: int = 4) -> DataFrame:
    """Displacement of every point as the mean of its k nearest control points', weighted 1 / max(d, 1e-10); control has ux, uy, uz."""
    near = nearest_point(full, control, k).join(control.select(F.col("id").alias("neighbour"), "ux", "uy", "uz"), "neighbour")
    w = 1 / F.greatest("distance", F.lit(1e-10))
    return near.groupBy("id").agg(*[(F.sum(w * F.col(f"u{a}")) / F.sum(w)).alias(f"u{a}") for a in AXES])


def sample_field(points: DataFrame, field: DataFrame) -> DataFrame:
    """x + u(x): the 27 cells around round(p), weighted by the product of 1 - |p - centre|, normalised, not clamped.

    At the field's edge, where cells are missing, the single cell holding p counts. points and field: scan_id, x, y, z.
    """
    base = points.select("scan_id", "id", *AXES, *[F.rint(a).cast("int").alias(f"b{a}") for a in AXES])
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("ijk", s, strict=True)]) for s in NEIGHBOURS]))
    cells = base.select("*", steps.alias("s")).withColumns({f"f{a}": F.col(f"b{a}") + F.col(f"s.{n}") for a, n in zip(AXES, "ijk", strict=True)})
    f = field.select("scan_id", *[F.col(a).cast("int").alias(f"f{a}") for a in AXES], "ux", "uy", "uz")
    met = cells.join(f, ["scan_id", "fx", "fy", "fz"])
    w = (1 - F.abs(F.col("x") - F.col("fx"))) * (1 - F.abs(F.col("y") - F.col("fy"))) * (1 - F.abs(F.col("z") - F.col("fz")))
    own = (F.col("fx") == F.col("bx")) & (F.col("fy") == F.col("by")) & (F.col("fz") == F.col("bz"))
    sums = met.withColumn("w", w).groupBy("scan_id", "id", *AXES).agg(F.count("*").alias("n"), F.sum("w").alias("sw"), *[F.sum(F.col("w") * F.col(f"u{a}")).alias(f"t{a}") for a in AXES], *[F.max(F.when(own, F.col(f"u{a}"))).alias(f"o{a}") for a in AXES])
    u = lambda a: F.when((F.col("n") == 27) & (F.abs("sw") > 1e-12), F.col(f"t{a}") / F.col("sw")).otherwise(F.coalesce(F.col(f"o{a}"), F.lit(0.0)))
    return sums.select("scan_id", "id", *[(F.col(a) + u(a)).alias(a) for a in AXES])


def transfer_landmarks(source: DataFrame, field: DataFrame) -> DataFrame:
    """Landmarks through a field; all their other columns are carried over."""
    moved = sample_field(source, field).withColumnsRenamed({a: f"__{a}" for a in AXES})
    return source.join(moved, ["scan_id", "id"]).withColumns({a: F.col(f"__{a}") for a in AXES}).drop(*[f"__{a}" for a in AXES])


def transfer_mask(masks: DataFrame, field: DataFrame) -> DataFrame:
    """Pulls labels onto the field's grid: each cell takes the label at rint(cell + u), if there is one."""
    source = field.select("scan_id", *AXES, *[F.rint(F.col(a) + F.col(f"u{a}")).cast("int").alias(f"s{a}") for a in AXES])
    labels = masks.select("scan_id", *[F.col(a).alias(f"s{a}") for a in AXES], "label")
    return source.join(labels, ["scan_id", "sx", "sy", "sz"]).select("scan_id", *AXES, "label")


def shrink_mask(masks: DataFrame, factor: int) -> DataFrame:
    """Every factor-th cell."""
    return masks.where(" AND ".join(f"{a} % {factor} = 0" for a in AXES)).withColumns({a: (F.col(a) / factor).cast("int") for a in AXES})


def grow_mask(masks: DataFrame, factor: int, shape: tuple[int, int, int]) -> DataFrame:
    """Each cell repeated factor times on every axis, cut to the shape (x, y, z)."""
    out = masks
    for a, n in zip(AXES, shape, strict=True):
        out = out.withColumn(a, F.explode(F.sequence(F.col(a) * factor, F.col(a) * factor + factor - 1))).where(F.col(a) < n)
    return out


def resized_cells(i: Column, n: Column, m: Column) -> Column:
    """The cells of an axis of m that take cell i of an axis of n."""
    rf = F.greatest(F.rint(F.greatest(n, m) / F.least(n, m)), F.lit(1.0)).cast("int")
    repeats, strides = (m > n) & (F.ceil(m / rf) == n), (m < n) & (F.ceil(n / rf) == m)
    step = F.when(m > 1, (n - 1) / F.greatest(m - 1, F.lit(1))).otherwise(F.lit(1.0))
    low = F.greatest(F.when(step > 0, F.floor((i - 0.5) / F.when(step > 0, step)) - 1).otherwise(F.lit(0)), F.lit(0)).cast("int")
    high = F.least(F.when(step > 0, F.ceil((i + 0.5) / F.when(step > 0, step)) + 1).otherwise(m - 1), m - 1).cast("int")
    zoomed = F.filter(F.when(low <= high, F.sequence(low, high)), lambda j: F.least(F.floor(step * j + 0.5), n - 1) == i)
    taken = F.when(n == m, F.array(i)).when(repeats, F.filter(F.sequence(i * rf, i * rf + rf - 1), lambda j: j < m))
    return taken.when(strides, F.when(i % rf == 0, F.array((i / rf).cast("int")))).otherwise(zoomed)


def resize_mask(masks: DataFrame, shapes: DataFrame) -> DataFrame:
    """Masks on grids of another shape; masks: scan_id, z, y, x, label; shapes: scan_id, nz, ny, nx (now), mz, my, mx (wanted).

    An axis whose sizes fit blocks of rf cells (rf: the rounded ratio, ceil(larger / rf) = smaller) is repeated or taken at every rf-th cell,
    so cell j covers the cells from j * rf; any other axis takes the nearest cell with first and last centres on each other.
    """
    out = masks.select("scan_id", "z", "y", "x", "label").join(shapes.select("scan_id", *[f"{k}{a}" for k in "nm" for a in "zyx"]), "scan_id")
    for a in "zyx":
        out = out.withColumn(a, F.explode(resized_cells(F.col(a), F.col(f"n{a}"), F.col(f"m{a}"))))
    return out.select("scan_id", "z", "y", "x", "label")


def invert_field(fields: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """scan_id, z, y, x, wz, wy, wx, residual: the inverse of each field, w(p) = -u(p + w(p)), by fixed-point rounds.

    fields: scan_id, z, y, x (a full box), uz, uy, ux in cells; beyond the box the field goes on as at its edge. The halo of a block is the
    largest displacement, so all rounds run where the block is: one shuffle. residual: how far p + w + u(p + w) is from p; it stays large
    only where the field folds, since there is no inverse there.
    """
    u = [f"u{a}" for a in "zyx"]
    far = fields.agg(F.max(F.greatest(*[F.abs(c) for c in u]))).first()[0] or 0.0
    halo = math.ceil(far) + 1

    def work(arrays: list[np.ndarray], inside: np.ndarray) -> list[np.ndarray]:
        at = np.stack(np.meshgrid(*[np.arange(halo, n - halo, dtype=float) for n in arrays[0].shape[1:]], indexing="ij"))[:, None]
        w = np.zeros((3, len(inside), *at.shape[2:]))
        left, held = np.arange(len(inside)), arrays  # the blocks whose rounds go on
        for _ in range(rounds):
            new = -linear_each(held, at + w[:, left])
            moved = np.abs(new - w[:, left]).max(axis=(0, 2, 3, 4), initial=0.0)
            w[:, left] = new
            if (moved < tolerance).any():
                left = left[~(moved < tolerance)]
                held = [v[left] for v in arrays]
            if not len(left):
                break
        return [*w, np.sqrt(((w + linear_each(arrays, at + w)) ** 2).sum(0))]

    return over_blocks(fields, halo, work, ["wz", "wy", "wx", "residual"], columns=tuple(u), pad="edge", many=True)


def linear(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values at the places `at` (axis first), linear between cells."""
    return linear_each([values[None]], at[:, None])[0, 0]


def linear_each(fields: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Each field (block, z, y, x) at the places `at` (axis, block, ...) of its blocks, linear between cells."""
    shape = fields[0].shape
    low = [np.clip(np.floor(p).astype(int), 0, n - 2) for p, n in zip(at, shape[1:], strict=True)]
    part = [p - b for p, b in zip(at, low, strict=True)]
    first = (low[0] * shape[2] + low[1]) * shape[3] + low[2] + (np.arange(shape[0]) * int(np.prod(shape[1:]))).reshape(-1, *[1] * (at.ndim - 2))
    total = np.zeros((len(fields), *at.shape[1:]))
    for corner in np.ndindex(2, 2, 2):
        z, y, x = (t if c else 1 - t for c, t in zip(corner, part, strict=True))
        weight, cell = z * y * x, first + (corner[0] * shape[2] + corner[1]) * shape[3] + corner[2]
        for sums, v in zip(total, fields, strict=True):
            sums += weight * v.reshape(-1)[cell]
    return total


def map_to_display(display: DataFrame, surface: DataFrame, spacing: float) -> tuple[DataFrame, DataFrame]:
    """Each display point takes its nearest surface point's value; and the mean and largest distance, with a warning over one spacing."""
    near = nearest_point(display, surface)
    values = near.join(surface.select(F.col("id").alias("neighbour"), "value"), "neighbour").select("id", "value", "distance")
    return values, near.agg(F.avg("distance").alias("mean"), F.max("distance").alias("most"), (F.max("distance") > spacing).alias("warn"))


def vector_blocks(vectors: DataFrame, size: int) -> DataFrame:
    """pair, block, blocks (of the pair) and cells (id, vector), about `size` a block; ids that are null and vectors without a direction are left out."""
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    known = vectors.where(F.col("id").isNotNull() & (squares > 0) & (squares < float("inf"))).select("pair", "id", "vector")
    counts = known.groupBy("pair").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    dealt = known.join(counts, "pair").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    return dealt.groupBy("pair", "block", "blocks").agg(F.array_sort(F.collect_list(F.struct("id", "vector"))).alias("cells"))


def _opened(lists: pa.ListArray, i: int) -> tuple[pa.Array, np.ndarray]:
    """Ids of a row's cells and their vectors as a matrix."""
    cells = lists.values.slice(lists.offsets[i].as_py(), lists.offsets[i + 1].as_py() - lists.offsets[i].as_py())
    rows = cells.field("vector")
    flat = np.asarray(rows.flatten().cast(pa.float64()))
    return cells.field("id"), flat.reshape(len(rows), -1)


def _best_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best partner of each vector of both blocks of a row; equal cosines go to the lower id.

    A matrix product finds who may be best; cosines that decide are summed vector by vector, so that equal vectors tie.
    """
    for batch in batches:
        for i in range(batch.num_rows):
            (ids_a, a), (ids_b, b) = (_opened(batch.column(c), i) for c in ("of_moving", "of_fixed"))
            long_a, long_b = (np.sqrt((v * v).sum(1)) for v in (a, b))
            about = (a / long_a[:, None]) @ (b / long_b[:, None]).T
            for by_fixed, axis in ((False, 1), (True, 0)):
                row, col = np.nonzero(about >= about.max(axis=axis, keepdims=True) - 1e-9)
                cos = (a[row] * b[col]).sum(1) / (long_a[row] * long_b[col])
                own, other = (col, row) if by_fixed else (row, col)
                order = np.lexsort((other, -cos, own))
                first = order[np.append(True, own[order][1:] != own[order][:-1])]
                n = len(first)
                yield pa.RecordBatch.from_arrays([
                    pa.array([by_fixed] * n), batch.column("pair").take(pa.array(np.full(n, i))), ids_a.take(pa.array(row[first])), ids_b.take(pa.array(col[first])), pa.array(-cos[first]),
                ], names=["by_fixed", "pair", "a", "b", "neg"])


def mutual_matches(moving: DataFrame, fixed: DataFrame, least: float = 0.55, size: int = 512) -> DataFrame:
    """Pairs that are each other's best by cosine, ranked; moving and fixed: pair, id (unique in its pair), vector (of one length).

    Blocks of vectors meet, not vectors: a task takes at most 64 moving blocks of a pair with all of its fixed ones, so a fixed
    vector is sent once for every 64 * size moving ones, and only the best of each vector and block leave the task.
    Ties: lower id. Vectors that are null, zero or not finite match nothing.
    """
    m, f = vector_blocks(moving, size), vector_blocks(fixed, size)
    slices = m.groupBy("pair").agg(F.max(F.floor((F.col("blocks") - 1) / 64)).cast("int").alias("last"))
    left = m.select("pair", F.floor(F.col("block") / 64).cast("int").alias("slice"), F.col("cells").alias("of_moving"))
    right = f.join(slices, "pair").select("pair", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("slice"), F.col("cells").alias("of_fixed"))
    kind = lambda d, c: d.schema[c].dataType.simpleString()
    met = left.join(right, ["pair", "slice"]).select("pair", "of_moving", "of_fixed")
    best = met.mapInArrow(_best_of_blocks, f"by_fixed boolean, pair {kind(moving, 'pair')}, a {kind(moving, 'id')}, b {kind(fixed, 'id')}, neg double")
    own = [F.when(~F.col("by_fixed"), F.col("a")).alias("own_a"), F.when(F.col("by_fixed"), F.col("b")).alias("own_b")]
    top = best.groupBy("by_fixed", "pair", *own).agg(F.min(F.struct("neg", "a", "b")).alias("t"))
    both = top.groupBy("pair", F.col("t.a").alias("a"), F.col("t.b").alias("b")).agg(F.count("*").alias("n"), (-F.min("t.neg")).alias("cos")).where((F.col("n") == 2) & (F.col("cos") >= least))
    return both.select("pair", "a", "b", "cos", F.row_number().over(W.partitionBy("pair").orderBy(F.desc("cos"), "a")).alias("rank"))


def keep_landmarks_near(landmarks: DataFrame, faces: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Landmarks at most half a percent of the mesh's box diagonal from its surface."""
    box = faces.agg(*[f(g(*[F.col(f"{k}{a}") for k in "abc"])).alias(n + a) for a in AXES for f, g, n in ((F.min, F.least, "lo"), (F.max, F.greatest, "hi"))]).first()
    diagonal = sum(((box[f"hi{a}"] or 0.0) - (box[f"lo{a}"] or 0.0)) ** 2 for a in AXES) ** 0.5
    near = surface_distance(landmarks, faces, group).where(F.col("distance") <= 0.005 * diagonal)
    return landmarks.join(near.select(*(group or []), "id"), [*(group or []), "id"], "left_semi")


def propagate_uv(source: DataFrame, target: DataFrame) -> DataFrame:
    """The texture coordinates of each target face: its own if the source has the same face_id, else the nearest centre's.

    source: face_id, centre x, y, z, uv; target: face_id, x, y, z.
    """
    same = target.join(source.select("face_id", "uv"), "face_id", "left")
    own = same.where("uv IS NOT NULL").select("face_id", "uv")
    rest = same.where("uv IS NULL").select(F.col("face_id").alias("id"), *AXES)
    near = nearest_point(rest, source.select(F.col("face_id").alias("id"), *AXES))
    return own.union(near.join(source.select(F.col("face_id").alias("neighbour"), "uv"), "neighbour").select(F.col("id").alias("face_id"), "uv"))
