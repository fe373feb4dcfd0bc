"""Stencils over voxels: smoothing, ranks, windows, distances, morphology and resampling.

Sums, extremes and city-block distances run an axis at a time as ordered windows over lines, which keeps rows where they are; smoothing,
medians, closing and non-local means work on blocks with a halo, Euclidean distances on lines. voxels: scan_id, z, y, x, v on full boxes from 0 unless said otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import SIDE, distance_transform, over_blocks, shifted, squared_distances, weighted
from .tables import written

CELL = ("scan_id", "z", "y", "x")


def line(axis: str, r: int):
    """The window of cells at most r away along an axis."""
    others = [a for a in "zyx" if a != axis]
    return W.partitionBy("scan_id", *others).orderBy(axis).rangeBetween(-r, r)


def kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    """Weights of a Gaussian from -r to r, r = int(truncate * sigma + 0.5), that add up to 1."""
    r = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    total = sum(weights)
    return [w / total for w in weights]


def gaussian_smooth(voxels: DataFrame, sigma: float, truncate: float = 4.0, pad: str = "symmetric", whole: bool = False) -> DataFrame:
    """Separable Gaussian of whole boxes; beyond the box the volume is mirrored about its outer faces, or its edge goes on (pad="edge").

    whole: each of the three passes is truncated to a whole number, as in volumes that are kept in an integer type.
    """
    weights = np.array(kernel(sigma, truncate))

    def smooth(arrays: list, inside: np.ndarray) -> list:
        out = arrays[0]
        for axis in range(3):
            out = weighted(out, weights, axis)
            out = np.trunc(out + np.copysign(1e-9, out)) if whole else out
        return [out]

    return over_blocks(voxels, len(weights) // 2, smooth, ["v"], pad=pad, every=True)


def median_filter(voxels: DataFrame) -> DataFrame:
    """Median of 3x3x3; at the border of the cells that exist."""
    cube = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]

    def middle(arrays: list, inside: np.ndarray) -> list:
        near = np.sort(np.stack([np.where(shifted(inside, o, 1), shifted(arrays[0], o, 1), np.inf) for o in cube]), axis=0)
        n = np.maximum(sum(shifted(inside, o, 1).astype(np.int64) for o in cube), 1)
        low, high = (np.take_along_axis(near, k[None], 0)[0] for k in ((n - 1) // 2, n // 2))
        return [low + (high - low) / 2 if np.isfinite(high).all() else np.where(np.isfinite(high), (low + high) / 2, low)]

    return over_blocks(voxels, 1, middle, ["v"])


def box_sums(voxels: DataFrame, r: int, columns: list[str]) -> DataFrame:
    """Sums of the columns over (2r+1)^3 windows, cut at the border, as three passes of running windows."""
    out = voxels
    for a in "zyx":
        out = out.withColumns({c: F.sum(c).over(line(a, r)) for c in columns})
    return out


def box_moments(voxels: DataFrame, r: int) -> DataFrame:
    """n, mean and variance of every cell's window."""
    base = voxels.select(*CELL, F.col("v").cast("double").alias("s"), (F.col("v").cast("double") ** 2).alias("q"), F.lit(1.0).alias("n"))
    m = box_sums(base, r, ["s", "q", "n"])
    mean = F.col("s") / F.col("n")
    return m.select(*CELL, F.col("n").cast("long").alias("n"), mean.alias("mean"), F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)).alias("var"))


def local_ncc(a: DataFrame, b: DataFrame, r: int = 5) -> DataFrame:
    """Dissimilarity 1 - (ncc + 1) / 2 of two volumes in every cell's window, cut at the border; 0.5 where n <= 1 or a variance is 0."""
    j = a.select(*CELL, F.col("v").cast("double").alias("p")).join(b.select(*CELL, F.col("v").cast("double").alias("q")), list(CELL))
    base = j.select(*CELL, "p", "q", (F.col("p") ** 2).alias("pp"), (F.col("q") ** 2).alias("qq"), (F.col("p") * F.col("q")).alias("pq"), F.lit(1.0).alias("n"))
    s = box_sums(base, r, ["p", "q", "pp", "qq", "pq", "n"])
    n = F.col("n")
    vp, vq = F.col("pp") - F.col("p") ** 2 / n, F.col("qq") - F.col("q") ** 2 / n
    ncc = (F.col("pq") - F.col("p") * F.col("q") / n) / F.sqrt(vp * vq)
    fits = (n > 1) & (vp > 1e-9) & (vq > 1e-9)
    return s.select(*CELL, F.when(fits, 1 - (F.least(F.greatest(ncc, F.lit(-1.0)), F.lit(1.0)) + 1) / 2).otherwise(F.lit(0.5)).alias("d"))


def distance_guard(voxels: DataFrame, threshold: float) -> DataFrame:
    """Exact Euclidean distance, in cells, of every cell to the nearest cell over the threshold; 0 inside, infinite where a scan has none."""
    d = distance_transform(voxels.select(*CELL, (F.col("v") > threshold).alias("site")))
    return d.select(*CELL, F.sqrt("d2").alias("distance"))


def constant_fill(voxels: DataFrame, threshold: float) -> DataFrame:
    """Cells under the threshold whose 3x3x3 window, cut at the border, holds one value only."""
    out = voxels.select(*CELL, "v", F.col("v").alias("lo"), F.col("v").alias("hi"))
    for a in "zyx":
        out = out.withColumns({"lo": F.min("lo").over(line(a, 1)), "hi": F.max("hi").over(line(a, 1))})
    return out.where((F.col("v") < threshold) & (F.col("lo") == F.col("hi"))).select(*CELL)


def box_cells(boxes: DataFrame) -> DataFrame:
    """All cells of boxes: scan_id and lo_z .. hi_x, both ends inside."""
    out = boxes
    for a in "zyx":
        out = out.withColumn(a, F.explode(F.sequence(F.col(f"lo_{a}").cast("int"), F.col(f"hi_{a}").cast("int"))))
    return out.select(*CELL)


def boxes_of(cells: DataFrame, shape: tuple[int, int, int] | DataFrame | None, reach: int) -> DataFrame:
    """scan_id and lo_z .. hi_x: the given shape (z, y, x; or by scan as nz, ny, nx), else the cells' own box, widened."""
    own = cells.groupBy("scan_id").agg(*[f(a).alias(n + a) for a in "zyx" for f, n in ((F.min, "lo_"), (F.max, "hi_"))])
    if shape is None:
        return own.select("scan_id", *[(F.col(f"lo_{a}") - reach).alias(f"lo_{a}") for a in "zyx"], *[(F.col(f"hi_{a}") + reach).alias(f"hi_{a}") for a in "zyx"])
    if isinstance(shape, DataFrame):
        return shape.select("scan_id", *[F.lit(0).alias(f"lo_{a}") for a in "zyx"], *[(F.col(f"n{a}") - 1).alias(f"hi_{a}") for a in "zyx"])
    return own.select("scan_id", *[F.lit(0).alias(f"lo_{a}") for a in "zyx"], *[F.lit(n - 1).alias(f"hi_{a}") for a, n in zip("zyx", shape, strict=True)])


def dilate(cells: DataFrame, n: int, shape: tuple[int, int, int] | DataFrame | None = None) -> DataFrame:
    """n face-adjacent steps, inside the shape (z, y, x) if one is given.

    A cell is n steps away if its city-block distance is at most n, which two running minima along each axis give.
    """
    own = cells.select(*CELL).distinct()
    steps = box_cells(boxes_of(own, shape, n)).join(own.withColumn("d", F.lit(0)).hint("merge"), list(CELL), "left").withColumn("d", F.coalesce("d", F.lit(1 << 30)))
    for a in "zyx":
        order = W.partitionBy("scan_id", *[b for b in "zyx" if b != a]).orderBy(a)
        before = F.min(F.col("d") - F.col(a)).over(order) + F.col(a)
        after = F.min(F.col("d") + F.col(a)).over(order.rowsBetween(0, W.unboundedFollowing)) - F.col(a)
        steps = steps.withColumn("d", F.least(before, after))
    return steps.where(F.col("d") <= n).select(*CELL)


def ball(r: int) -> list[tuple[int, int, int]]:
    return [(i, j, k) for i in range(-r, r + 1) for j in range(-r, r + 1) for k in range(-r, r + 1) if i * i + j * j + k * k <= r * r]


def close_ball(cells: DataFrame, r: int, shape: tuple[int, int, int] | DataFrame | None = None) -> DataFrame:
    """Dilation, then erosion by a ball of radius r.

    With a shape, what lies outside of it counts as empty for the first and as full for the second. Without, space has no border.
    Both are distance transforms inside blocks whose halo is 2 r, so a voxel is shuffled once whatever the radius.
    """
    own = cells.select(*CELL).distinct()
    boxes = boxes_of(own, shape, r)
    # blocks count from 0
    low = boxes.select("scan_id", *[F.least(F.col(f"lo_{a}"), F.lit(0)).alias(f"m{a}") for a in "zyx"])
    every = box_cells(boxes).join(own.withColumn("v", F.lit(1)), list(CELL), "left").na.fill(0, ["v"])
    moved = every.join(low, "scan_id").select("scan_id", *[(F.col(a) - F.col(f"m{a}")).alias(a) for a in "zyx"], "v")
    h, bounded = 2 * r, shape is not None

    def close(arrays: list, inside: np.ndarray) -> list:
        grown = (squared_distances(arrays[0] > 0) <= r * r) & inside
        gaps = ~grown & inside if bounded else ~grown
        return [shifted(squared_distances(gaps) > r * r, (0, 0, 0), h)]

    out = over_blocks(moved, h, close, ["kept"], side=max(SIDE, 2 * h), rows=lambda results: results[0])
    return out.join(low, "scan_id").select("scan_id", *[(F.col(a) + F.col(f"m{a}")).cast("int").alias(a) for a in "zyx"])


def spline_coefficients(f: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients of lines x cells, mirrored about the outer faces: a forward and a backward recursion over the cells."""
    lines, n = f.shape
    if n == 1:
        return f.copy()
    factor, c = np.empty(n), np.empty((lines, n))
    # (c[i - 1] + 4 c[i] + c[i + 1]) / 6 = f[i], where the cell before the first is the first itself
    pivot = 5.0
    c[:, 0] = 6 * f[:, 0]
    for i in range(1, n):
        factor[i - 1] = 1 / pivot
        c[:, i] = 6 * f[:, i] - c[:, i - 1] * factor[i - 1]
        pivot = (5.0 if i == n - 1 else 4.0) - factor[i - 1]
    c[:, n - 1] /= pivot
    for i in range(n - 2, -1, -1):
        c[:, i] = (c[:, i] - c[:, i + 1]) * factor[i]
    return c


def resample_lines(f: np.ndarray, own: float, target: float, binary: bool = False) -> np.ndarray:
    """Lines x cells of spacing `own` at round(n own / target) cells of spacing `target` around the same centre.

    Coarser lines are interpolated by a cubic spline (binary: the cell that holds the centre), finer ones averaged by overlap.
    """
    n = f.shape[1]
    m = max(1, round(n * own / target))
    if m == n and abs(own - target) <= 1e-9 * target:
        return f
    start = (n * own - m * target) / 2
    if own > target:
        at = (start + (np.arange(m) + 0.5) * target) / own - 0.5
        if binary:
            return f[:, np.clip(np.floor(at + 0.5).astype(np.int64), 0, n - 1)]
        if n == 1:
            return np.repeat(f, m, axis=1)
        c, base, out = spline_coefficients(f), np.floor(at).astype(np.int64), 0.0
        for k in range(-1, 3):
            far = np.abs(at - (base + k))
            weight = np.where(far < 1, (4 - 6 * far**2 + 3 * far**3) / 6, np.maximum(2 - far, 0.0) ** 3 / 6)
            cell = (base + k) % (2 * n)
            out = out + weight * c[:, np.where(cell < n, cell, 2 * n - 1 - cell)]
        return out
    edges = np.clip(start + np.arange(m + 1) * target, 0.0, n * own)
    run = np.concatenate([np.zeros((len(f), 1)), np.cumsum(f, axis=1)], axis=1) * own
    # the sum up to a place inside a cell is linear between the cell's faces
    cell = np.minimum(np.floor(edges / own).astype(np.int64), n - 1)
    upto = run[:, cell] + f[:, cell] * (edges - cell * own)
    return (upto[:, 1:] - upto[:, :-1]) / np.maximum(edges[1:] - edges[:-1], 1e-300)


#: Target spacings, and relative differences that count as none.
TARGETS, SAME_SPACING = {"finest": F.least, "coarsest": F.greatest}, 1e-9


def _resample_pass(axis: str):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("cells")
            ends, flat = np.asarray(lists.offsets), lists.values
            at, v = np.asarray(flat.field(axis)), np.asarray(flat.field("v"))
            plan = {c: np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("n", "own", "target", "binary")}
            kinds, of = np.unique(np.stack([plan["n"], plan["own"], plan["target"], plan["binary"].astype(float)], axis=1), axis=0, return_inverse=True)
            which, to, values = [], [], []
            for k, (n, own, target, binary) in enumerate(kinds):
                rows = np.flatnonzero(of.ravel() == k)
                step = max(1, (1 << 21) // int(n))
                for part in np.split(rows, range(step, len(rows), step)):
                    lines = np.zeros((len(part), int(n)))
                    for i, row in enumerate(part):
                        cells = slice(ends[row], ends[row + 1])
                        lines[i, at[cells]] = v[cells]
                    new = resample_lines(lines, own, target, bool(binary))
                    which.append(np.repeat(part, new.shape[1]))
                    to.append(np.tile(np.arange(new.shape[1], dtype=np.int32), len(part)))
                    values.append(new.ravel())
            if which:
                row = pa.array(np.concatenate(which))
                others = [c for c in CELL if c != axis]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(row) for c in others], pa.array(np.concatenate(to)), pa.array(np.concatenate(values))], names=[*others, axis, "v"])

    return solve


def resample_isotropic(voxels: DataFrame, spacings: DataFrame, target: str = "finest") -> DataFrame:
    """Whole boxes of any shapes at one spacing on all axes, each scan's finest or coarsest; the field of view keeps its centre.

    spacings: scan_id, sz, sy, sx and, if some are masks of two values, binary. Axes that are coarser than the target are
    interpolated by a cubic B-spline (prefilter and basis along whole lines), finer ones averaged by overlap; values are clipped to
    the scan's own range and, for whole numbers, rounded half-even. Binary volumes take the nearest cell or the majority by
    volume (half counts as high). An axis that keeps its spacing is not shuffled. Scans without spacings are left out.
    """
    kind = voxels.schema["v"].dataType
    binary = F.coalesce(F.col("binary"), F.lit(False)) if "binary" in spacings.columns else F.lit(False)
    sizes = [F.col(f"s{a}").cast("double") for a in "zyx"]
    plan = spacings.select("scan_id", *[f"s{a}" for a in "zyx"], TARGETS[target if target in TARGETS else "finest"](*sizes).alias("target"), binary.alias("binary"))
    ends = voxels.groupBy("scan_id").agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"), *[(F.max(a) + 1).alias(f"n{a}") for a in "zyx"])
    plan = plan.join(ends, "scan_id")
    out = voxels.select(*CELL, F.col("v").cast("double").alias("v"))
    for a in "zyx":
        others = [c for c in CELL if c != a]
        own = F.col(f"s{a}").cast("double")
        axis = plan.select("scan_id", F.col(f"n{a}").alias("n"), own.alias("own"), "target", "binary", (F.abs(own - F.col("target")) > SAME_SPACING * F.col("target")).alias("moves"))
        met = out.join(axis, "scan_id")
        lines = met.where("moves").groupBy(*others, "n", "own", "target", "binary").agg(F.collect_list(F.struct(a, "v")).alias("cells"))
        schema = T.StructType([*[lines.schema[c] for c in others], T.StructField(a, T.IntegerType()), T.StructField("v", T.DoubleType())])
        out = met.where("NOT moves").select(*CELL, "v").unionByName(lines.mapInArrow(_resample_pass(a), schema))
    met = out.join(plan.select("scan_id", "lo", "hi", "binary"), "scan_id")
    new = F.least(F.greatest("v", F.col("lo")), F.col("hi"))
    new = F.when(F.col("binary"), F.when(F.col("v") >= (F.col("lo") + F.col("hi")) / 2, F.col("hi")).otherwise(F.col("lo"))).otherwise(F.rint(new) if isinstance(kind, T.IntegralType) else new)
    return met.select("scan_id", *[F.col(a).cast("int").alias(a) for a in "zyx"], new.cast(kind).alias("v"))


def _blend_tiles(tile: int, clip: float, bins: int):
    """Equalised values of the cells of rows that hold a tile's cells and the histograms of the tiles around it."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, near = batch.column("cells"), batch.column("around")
            first, flat = np.asarray(lists.offsets), lists.values
            at = [np.asarray(flat.field(a)).astype(np.int64) for a in "zyx"]
            v = np.asarray(flat.field("v").cast(pa.int64()))
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            tables = near.values
            slots = len(tables)
            place = np.full((batch.num_rows, 27), -1)
            place[np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(near.offsets))), np.asarray(tables.field("side"))] = np.arange(slots)
            held, counted = np.asarray(tables.field("held")), tables.field("h")
            ends, entries = np.asarray(counted.offsets), counted.values
            of = np.repeat(np.arange(slots), np.diff(ends))
            n = np.asarray(entries.field("n"))
            kept = np.minimum(n, np.maximum(clip * held / bins, 1.0)[of])
            extra = np.bincount(of, weights=n - kept, minlength=slots)
            key = of * bins + np.asarray(entries.field("bin"))
            run = np.concatenate([[0.0], np.cumsum(kept)])
            own = [np.asarray(batch.column(f"t{a}"))[row] for a in "zyx"]
            top = [np.asarray(batch.column(f"l{a}"))[row] for a in "zyx"]
            total, hit = np.zeros(len(v)), np.zeros(len(v), bool)
            for corner in np.ndindex(2, 2, 2):
                side, weight = 0, 1.0
                for c, x, t, last in zip(corner, at, own, top, strict=True):
                    p = (x + 0.5) / tile - 0.5
                    low = np.floor(p)
                    weight = weight * (p - low if c else 1 - (p - low))
                    side = side * 3 + np.clip(low.astype(np.int64) + c, 0, last) - t + 1
                s = place[row, side]
                there = s >= 0
                s = np.maximum(s, 0)
                upto = run[np.searchsorted(key, s * bins + v, side="right")] - run[ends[s] - ends[0]]
                to = (upto + (v + 1) * (extra[s] / bins)) / held[s] * (bins - 1)
                total += np.where(there, weight * to, 0.0)
                hit |= there
            out = [batch.column("scan_id").take(pa.array(row[hit])), *[pa.array(x[hit].astype(np.int32)) for x in at], pa.array(np.rint(total[hit]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, names=[*CELL, "v"])

    return solve


def clahe(voxels: DataFrame, tile: int, clip: float, bins: int = 256) -> DataFrame:
    """Contrast-limited equalisation of whole values 0 to bins - 1, blended linearly between the eight tiles around a cell.

    A tile's counts over clip * cells / bins are cut and what was cut is spread over all bins. Cells are gathered by tile, and a tile's counts of
    the values that it holds go to the tiles beside it; so a cell is shuffled once, and no row is made for a value that no cell has.
    """
    tiled = voxels.select(*CELL, "v", *[F.floor(F.col(a) / tile).cast("int").alias(f"t{a}") for a in "zyx"])
    key = ["scan_id", "tz", "ty", "tx"]
    valid = F.coalesce((F.col("v") >= 0) & (F.col("v") < bins) & (F.col("v") == F.floor("v")), F.lit(False))
    counts = tiled.groupBy(*key, F.when(valid, F.col("v").cast("long")).alias("bin")).agg(F.count("*").cast("double").alias("n"))
    h = counts.groupBy(*key).agg(F.sum("n").alias("held"), F.array_sort(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))).alias("h"))
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("z"), F.lit(j).alias("y"), F.lit(k).alias("x"), F.lit((1 - i) * 9 + (1 - j) * 3 + 1 - k).alias("side")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    top = tiled.groupBy("scan_id").agg(*[F.max(f"t{a}").alias(f"l{a}") for a in "zyx"]).hint("merge")
    sent = h.join(top, "scan_id").withColumn("s", sides).withColumns({f"t{a}": F.col(f"t{a}") + F.col(f"s.{a}") for a in "zyx"})
    sent = sent.where(" AND ".join(f"t{a} BETWEEN 0 AND l{a}" for a in "zyx"))
    around = sent.groupBy(*key, *[f"l{a}" for a in "zyx"]).agg(F.collect_list(F.struct(F.col("s.side").alias("side"), "held", "h")).alias("around"))
    cells = tiled.where(valid).groupBy(*key).agg(F.collect_list(F.struct("z", "y", "x", "v")).alias("cells"))
    met = cells.join(around.hint("merge"), key).select(*key, *[f"l{a}" for a in "zyx"], "cells", "around")
    return met.mapInArrow(_blend_tiles(tile, clip, bins), T.StructType([voxels.schema["scan_id"], *[T.StructField(a, T.IntegerType()) for a in "zyx"], T.StructField("v", T.IntegerType())]))


def radial_descriptor(voxels: DataFrame, points: DataFrame, r: int = 6, shells: int = 8) -> DataFrame:
    """Mean and deviation of each spherical shell around a point (scan_id, id, z, y, x), as one vector of length 1; empty shells are 0."""
    offsets = [(i, j, k, min(int(math.sqrt(i * i + j * j + k * k) / (r + 1e-9) * shells), shells - 1)) for i, j, k in ball(r)]
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("ijks", o, strict=True)]) for o in offsets]))
    cells = points.select("scan_id", "id", "z", "y", "x", steps.alias("o")).select("scan_id", "id", *[(F.col(a) + F.col(f"o.{n}")).alias(a) for a, n in zip("zyx", "ijk", strict=True)], F.col("o.s").alias("shell"))
    stats = cells.join(voxels, list(CELL)).groupBy("scan_id", "id", "shell").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d"))
    parts = stats.groupBy("scan_id", "id").agg(F.map_from_entries(F.collect_list(F.struct("shell", F.struct("m", "d").alias("p")))).alias("p"))
    vector = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(shells - 1)), lambda s: F.array(F.coalesce(F.element_at("p", s)["m"], F.lit(0.0)), F.coalesce(F.element_at("p", s)["d"], F.lit(0.0)))))
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return parts.select("scan_id", "id", F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(x)).alias("vector"))


def nlm_denoise(voxels: DataFrame, h: float, patch: int = 1, search: int = 2) -> DataFrame:
    """Non-local means: sum w I / sum w over the search window, w = exp(-|dP|^2 / 2h^2) with the mean squared patch difference.

    Each shift is compared through sums of squared differences over shifted patches; cells outside are left out.
    """
    halo, reach = patch + search, range(-search, search + 1)
    ones = np.ones(2 * patch + 1)

    def denoise(arrays: list, inside: np.ndarray) -> list:
        v = arrays[0]
        near = lambda array, o: shifted(array, o, search)
        top = low = 0.0
        for o in ((i, j, k) for i in reach for j in reach for k in reach):
            both = near(inside, (0, 0, 0)) & near(inside, o)
            gap, n = np.where(both, (near(v, (0, 0, 0)) - near(v, o)) ** 2, 0.0), both.astype(np.float64)
            for axis in (-3, -2, -1):
                gap, n = weighted(gap, ones, axis), weighted(n, ones, axis)
            w = np.where(shifted(inside, o, halo) & shifted(inside, (0, 0, 0), halo), np.exp(-gap / np.maximum(n, 1.0) / (2 * h * h)), 0.0)
            top, low = top + w * shifted(v, o, halo), low + w
        return [top / np.where(low > 0, low, 1.0)]

    return over_blocks(voxels, halo, denoise, ["v"], many=True)


def erode(cells: DataFrame, n: int) -> DataFrame:
    """Cells that are more than n face-adjacent steps from all that is not in the set; beyond a volume's box nothing is."""
    own = cells.select(*CELL).distinct().hint("merge")  # cells of boxes are far more than Spark expects, so none are broadcast
    gaps = box_cells(boxes_of(own, None, 1)).join(own, list(CELL), "left_anti")
    return own.join(dilate(gaps, n), list(CELL), "left_anti")


def interest_points(voxels: DataFrame, inside: DataFrame, r: int = 2, n: int = 180, sep: int = 4, erosion: int = 0, least: int = 64) -> DataFrame:
    """Up to n local maxima of local variance inside the mask, at least sep apart, by falling variance: scan_id, z, y, x, var, order.

    The mask is first eroded by `erosion` steps, but for scans that would keep fewer than `least` cells. Separation is greedy, in rounds of which each keeps the points that come before all their open neighbours.
    """
    from .graph import greedy_decorrelate
    from .spatial import radius_pairs

    if erosion:
        inner = written(erode(inside, erosion))
        enough = inner.groupBy("scan_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("scan_id").hint("merge")
        inside = inner.join(enough, "scan_id", "left_semi").unionByName(inside.select(*CELL).join(enough, "scan_id", "left_anti"))
    var = box_moments(voxels, r).join(inside.select(*CELL).hint("merge"), list(CELL), "left_semi").select(*CELL, "var")
    peak = var.withColumn("top", F.col("var"))
    for a in "zyx":
        peak = peak.withColumn("top", F.max("top").over(line(a, 1)))
    code = F.concat_ws(":", *CELL)
    found = written(peak.where("var = top AND var > 0").withColumn("id", F.xxhash64(code)))
    close = radius_pairs(found, float(sep) - 1e-9, ["scan_id"])
    kept = greedy_decorrelate(found.select("id", F.col("var").alias("variance")), close.select("a", "b"))
    order = W.partitionBy("scan_id").orderBy(F.desc("var"), "id")
    return found.join(kept, "id", "left_semi").withColumn("order", F.row_number().over(order)).where(F.col("order") <= n).select(*CELL, "var", "order")
