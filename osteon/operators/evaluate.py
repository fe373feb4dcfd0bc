"""Measures of masks, registrations, landmarks and runs. Empty inputs have the fixed results given at each function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import SIDE, block_table, squared_distances, stacked
from .geometry import AXES
from .spatial import invert_field, nearest_point
from .tables import written

CELL = ("scan_id", "z", "y", "x")


def mask_bbox(masks: DataFrame) -> DataFrame:
    return masks.where("label > 0").groupBy("scan_id").agg(*[f(a).alias(n + a) for a in "zyx" for f, n in ((F.min, "lo_"), (F.max, "hi_"))])


def mask_centroid(masks: DataFrame, scans: DataFrame) -> DataFrame:
    """Mean cell of each mask; an empty one gives the volume's centre; scans: scan_id, nz, ny, nx."""
    c = masks.where("label > 0").groupBy("scan_id").agg(*[F.avg(a).alias(f"m{a}") for a in "zyx"])
    return scans.join(c, "scan_id", "left").select("scan_id", *[F.coalesce(F.col(f"m{a}"), (F.col(f"n{a}") - 1) / 2).alias(f"c{a}") for a in "zyx"])


def centroid_size(points: DataFrame, by: str = "scan_id") -> DataFrame:
    """Root of the mean squared distance from the centroid, from moments of one pass."""
    var = [F.var_pop(a) for a in AXES]
    return points.groupBy(by).agg(F.sqrt(var[0] + var[1] + var[2]).alias("size"))


def scale_factor(points: DataFrame, reference, by: str = "scan_id") -> DataFrame:
    """Size of the reference over each subject's; 1 when either is degenerate."""
    s = centroid_size(points, by)
    ref = s.where(F.col(by) == reference).select(F.col("size").alias("ref"))
    return s.join(F.broadcast(ref)).select(by, F.when((F.col("size") > 0) & (F.col("ref") > 0), F.col("ref") / F.col("size")).otherwise(F.lit(1.0)).alias("scale"))


def landmark_summary(distances: DataFrame, vs: float) -> DataFrame:
    """Count, mean, population deviation and outliers over 1 and 6 voxels of distances and snap distances."""
    stats = []
    for c in ("distance", "snap_distance"):
        stats += [F.count(c).alias(f"{c}_n"), F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
        stats += [F.sum((F.col(c) > m * vs).cast("long")).alias(f"{c}_over_{m}") for m in (1, 6)]
    return distances.groupBy("scan_id").agg(*stats)


def surface_metric(distances: DataFrame, vs: float) -> DataFrame:
    """Share over six voxels, its complement, and the mean; null distances don't count, none at all gives 0, 0, 0."""
    over = F.avg((F.col("distance") > 6 * vs).cast("double"))
    return distances.groupBy("scan_id").agg(F.coalesce(over, F.lit(0.0)).alias("over"), F.coalesce(1 - over, F.lit(0.0)).alias("within"), F.coalesce(F.avg("distance"), F.lit(0.0)).alias("mean"))


def pairs_of(fixed: DataFrame, moving: DataFrame) -> DataFrame:
    return fixed.select("pair", "z", "y", "x", F.col("v").cast("double").alias("f")).join(moving.select("pair", "z", "y", "x", F.col("v").cast("double").alias("m")), ["pair", "z", "y", "x"])


def correlation(f, m):
    """Pearson correlation of two columns in a group; 0 with one row or no variance."""
    return F.when((F.count(m) > 1) & (F.var_pop(f) > 0) & (F.var_pop(m) > 0), F.corr(f, m)).otherwise(F.lit(0.0))


def union_mask_ncc(fixed: DataFrame, moving: DataFrame, threshold: float) -> DataFrame:
    """Correlation over the cells where either volume is over the threshold."""
    kept = pairs_of(fixed, moving).where((F.col("f") > threshold) | (F.col("m") > threshold))
    return kept.groupBy("pair").agg(correlation("f", "m").alias("ncc"))


def overlap_metrics(pred: DataFrame, target: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Dice and IoU by scan_id and label; two empty masks give 1. pred and target: scan_id, z, y, x, label."""
    p, t = (m.where("label > 0").select(*CELL, "label").distinct() for m in (pred, target))
    both = p.withColumn("p", F.lit(1)).join(t.withColumn("t", F.lit(1)), [*CELL, "label"], "full_outer").na.fill(0, ["p", "t"])
    n = both.groupBy("scan_id", "label").agg(F.sum("p").alias("a"), F.sum("t").alias("b"), F.sum(F.col("p") * F.col("t")).alias("i"))
    dice = (2 * F.col("i") + eps) / (F.col("a") + F.col("b") + eps)
    return n.select("scan_id", "label", dice.alias("dice"), ((F.col("i") + eps) / (F.col("a") + F.col("b") - F.col("i") + eps)).alias("iou"))


def hd95(pred: DataFrame, target: DataFrame, spacing: float, halo: int = 8) -> DataFrame:
    """The larger of both directed 95th percentiles of nearest distances in mm; null when either is empty. pred and target: scan_id, z, y, x (whole numbers), label.

    Distances are found in blocks of cells with a halo and leave them as counts. Only what has nothing of the other mask nearer than the halo
    ends in a volume of several blocks goes to nearest_point.
    """
    cells = lambda m, side: m.where("label > 0").select(*CELL, F.lit(side).alias("side"))
    both = cells(pred, 0.0).union(cells(target, 1.0)).where("z IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL")
    boxes = both.groupBy("scan_id").agg(*[F.min(a).alias(f"lo_{a}") for a in "zyx"], *[(F.max(a) - F.min(a) + 1).cast("int").alias(f"n{a}") for a in "zyx"])
    placed = both.join(boxes, "scan_id").select("scan_id", *[(F.col(a) - F.col(f"lo_{a}")).cast("int").alias(a) for a in "zyx"], "side", "nz", "ny", "nx")
    table = block_table(placed, halo, ("side",))
    kind = table.schema["scan_id"].dataType.simpleString()
    # written: read three times
    met = written(table.mapInArrow(_mask_distances(halo), f"scan_id {kind}, side int, d2 double, n long, z int, y int, x int"))
    found = met.where("z IS NULL").select("scan_id", "side", F.sqrt("d2").alias("distance"), "n")
    far = met.where("z IS NOT NULL")
    if far.limit(1).count():
        far = far.select("scan_id", "side", *AXES).withColumn("id", F.col("z").cast("long") * (1 << 40) + F.col("y").cast("long") * (1 << 20) + F.col("x"))
        some = placed.join(far.select("scan_id").distinct(), "scan_id", "left_semi").distinct().withColumn("id", F.col("z").cast("long") * (1 << 40) + F.col("y").cast("long") * (1 << 20) + F.col("x"))
        for side in (0, 1):
            near = nearest_point(far.where(F.col("side") == side), some.where(F.col("side") == 1 - side), group=["scan_id"], width=2.0).where("neighbour IS NOT NULL")
            found = found.union(near.groupBy("scan_id", F.lit(side).alias("side"), "distance").agg(F.count("*").alias("n")))
    each = found.groupBy("scan_id", "side").agg(F.percentile("distance", 0.95, F.col("n")).alias("d")).groupBy("scan_id").agg((F.max("d") * spacing).alias("hd95"))
    return pred.select("scan_id").union(target.select("scan_id")).distinct().join(each, "scan_id", "left")


def _mask_distances(halo: int):
    """Rows of block_table with the column side (0 or 1: which mask a cell is in): how many cells of each side are how far (d2, squared) from the other side.

    Cells that may have something nearer outside the block and its halo come out one by one, with z, y and x; other rows have none. A side that
    faces an empty mask gives no rows where the block sees the whole volume.
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scans, sizes = batch.column("scan_id"), np.stack([np.asarray(batch.column(f"n{a}")) for a in "zyx"], axis=1)
            for rows, origin, edges, shape, index, (side,) in stacked(batch, halo, ("side",), SIDE):
                own = [slice(halo - e0, s - (halo - e1)) for (e0, e1), s in zip(edges, shape[1:], strict=True)]
                masks = np.zeros((2, *shape), bool)
                for m in (0, 1):
                    masks[m].reshape(-1)[index[side == m]] = True
                whole = (np.array(shape[1:]) == sizes[rows]).all(1)
                out = []
                for m in (0, 1):
                    where = np.nonzero(masks[m][(slice(None), *own)])
                    d2 = squared_distances(masks[1 - m], 1)[(slice(None), *own)][where]
                    sure = whole[where[0]] | (d2 <= (halo + 1) ** 2)
                    some = sure & np.isfinite(d2)
                    pairs, n = np.unique(np.stack([where[0][some], d2[some].astype(np.int64)]), axis=1, return_counts=True)
                    none = np.zeros((3, pairs.shape[1]), np.int32)
                    out.append((pairs[0], np.full(len(n), m), pairs[1].astype(float), n, none, np.ones(len(n), bool)))
                    rest = ~sure
                    at = np.stack([w[rest] + origin[where[0][rest], k] for k, w in enumerate(where[1:])]).astype(np.int32)
                    out.append((where[0][rest], np.full(rest.sum(), m), np.full(rest.sum(), np.inf), np.ones(rest.sum(), np.int64), at, np.zeros(rest.sum(), bool)))
                block, m, d2, n, at, known = (np.concatenate(c, axis=-1) for c in zip(*out, strict=True))
                columns = [scans.take(pa.array(rows[block])), pa.array(m.astype(np.int32)), pa.array(d2), pa.array(n.astype(np.int64)), *[pa.array(c, mask=known) for c in at]]
                yield pa.RecordBatch.from_arrays(columns, names=["scan_id", "side", "d2", "n", "z", "y", "x"])

    return solve


def aggregate_metrics(rows: DataFrame, metrics: list[str]) -> DataFrame:
    return rows.agg(*[F.avg(m).alias(m) for m in metrics])


def pair_score(fixed: DataFrame, warped: DataFrame, floor: float = -0.5, least: int = 200) -> DataFrame:
    """Mutual NCC, IoU, recall of the fixed foreground and NCC over it; under `least` mutual voxels -1, 0, 0, -1."""
    j = pairs_of(fixed, warped).withColumn("a", F.col("f") > floor).withColumn("b", F.col("m") > floor)
    n = j.groupBy("pair").agg(
        F.sum((F.col("a") & F.col("b")).cast("long")).alias("both"), F.sum((F.col("a") | F.col("b")).cast("long")).alias("either"), F.sum(F.col("a").cast("long")).alias("fixed"),
        F.corr(F.when(F.col("a") & F.col("b"), F.col("f")), F.when(F.col("a") & F.col("b"), F.col("m"))).alias("ncc"), F.corr(F.when(F.col("a"), F.col("f")), F.when(F.col("a"), F.col("m"))).alias("fncc"))
    ok = F.col("both") >= least
    return n.select("pair", F.when(ok, F.coalesce("ncc", F.lit(0.0))).otherwise(F.lit(-1.0)).alias("ncc"), F.when(ok, F.col("both") / F.col("either")).otherwise(F.lit(0.0)).alias("iou"), F.when(ok, F.col("both") / F.col("fixed")).otherwise(F.lit(0.0)).alias("fixed_recall"), F.when(ok, F.coalesce("fncc", F.lit(0.0))).otherwise(F.lit(-1.0)).alias("fixed_ncc"))


def population_mean(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean per vertex over subjects, NaN and infinite values being 0; and mean and deviation of the means that aren't 0."""
    finite = F.when(F.isnan("value") | F.col("value").isNull() | (F.abs("value") == float("inf")), F.lit(0.0)).otherwise(F.col("value"))
    means = values.groupBy("vertex_id").agg(F.avg(finite).alias("mean"))
    return means, means.where("mean <> 0").agg(F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("std"))


def region_distribution(values: DataFrame, vertices: DataFrame) -> DataFrame:
    """Each subject's mean over the chosen vertices."""
    return values.join(vertices.select("vertex_id").distinct(), "vertex_id", "left_semi").groupBy("scan_id").agg(F.avg("value").alias("value"))


def cohort_median_spacing(scans: DataFrame) -> DataFrame:
    """Median of the spacings, rounded half-even to 4 decimals, of the voxel subjects that aren't faulty."""
    kept = scans.where("NOT coalesce(faulty, false) AND NOT (is_mesh <=> true AND voxelized <=> false)")
    return kept.agg(F.median(F.bround("voxel_size", 4)).alias("spacing"))


def _fit(scaled: bool):
    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                n = r.n
                if n < 3:
                    out.append((r.scan_id, n, *[None] * 13))
                    continue
                s, t = np.array([r.sx, r.sy, r.sz]) / n, np.array([r.tx, r.ty, r.tz]) / n
                h = np.array(r.cross).reshape(3, 3) - n * np.outer(s, t)
                u, d, vt = np.linalg.svd(h)
                flip = np.array([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
                rot = vt.T @ np.diag(flip) @ u.T
                spread = r.ss - n * s @ s
                scale = float((d * flip).sum() / spread) if scaled and spread > 0 else 1.0
                out.append((r.scan_id, n, *rot.reshape(-1), *(t - scale * rot @ s), scale))
            yield pd.DataFrame(out, columns=POSE)

    return solve


POSE = ["scan_id", "n", *[f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)], "t_x", "t_y", "t_z", "scale"]


def kabsch_batch(pairs: DataFrame, scaled: bool = False) -> DataFrame:
    """Rotation (column-vector), translation and scale per scan that best take (x, y, z) to (tx, ty, tz); null under 3 pairs.

    Sums are grouped in Spark; only the 3x3 decomposition of each scan's one row is done in NumPy.
    """
    cross = F.array(*[F.sum(F.col(a) * F.col(f"t{b}")) for a in AXES for b in AXES])
    sums = pairs.groupBy("scan_id").agg(F.count("*").alias("n"), *[F.sum(a).alias(f"s{a}") for a in AXES], *[F.sum(f"t{a}").alias(f"t{a}") for a in AXES], cross.alias("cross"), F.sum(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("ss"))
    return sums.mapInPandas(_fit(scaled), "scan_id long, n long, " + ", ".join(f"{c} double" for c in POSE[2:]))


def atlas_mean(images: DataFrame, fields: DataFrame) -> DataFrame:
    """Mean image of the aligned subjects, pulled through the inverse of the mean field; cells whose source is outside are left out."""
    image = images.groupBy("z", "y", "x").agg(F.avg("v").alias("v"))
    mean = fields.groupBy("z", "y", "x").agg(*[F.avg(f"u{a}").alias(f"u{a}") for a in AXES])
    inverse = invert_field(written(mean.withColumn("scan_id", F.lit(0))))
    source = inverse.select("z", "y", "x", *[F.rint(F.col(a) + F.col(f"w{a}")).cast("int").alias(f"s{a}") for a in AXES])
    return source.join(image.withColumnsRenamed({a: f"s{a}" for a in AXES}), ["sx", "sy", "sz"]).select("z", "y", "x", "v")


def robust_inliers(distances: DataFrame, vs: float) -> DataFrame:
    """idx and inlier: interior points within median + 3 * 1.4826 * MAD; under four of those, the nearer half.

    distances: scan_id, idx, distance (full surface), outer (distance to the outer surface). Interior: distance + max(vs / 2, 0.02) < outer.
    """
    inner = distances.withColumn("interior", F.col("distance") + max(0.5 * vs, 0.02) < F.col("outer"))
    kept = F.when(~F.col("interior"), F.col("distance"))
    med = inner.groupBy("scan_id").agg(F.median(kept).alias("med"))
    joined = inner.join(med, "scan_id")
    mad = joined.where("NOT interior").groupBy("scan_id").agg(F.median(F.abs(F.col("distance") - F.col("med"))).alias("mad"))
    marked = joined.join(mad, "scan_id", "left").withColumn("ok", ~F.col("interior") & (F.col("distance") <= F.col("med") + 3 * 1.4826 * F.col("mad")))
    by = W.partitionBy("scan_id")
    rank = F.row_number().over(by.orderBy("distance", "idx"))
    counted = marked.withColumn("good", F.sum(F.coalesce("ok", F.lit(False)).cast("int")).over(by)).withColumn("r", rank).withColumn("n", F.count("*").over(by))
    return counted.select("scan_id", "idx", F.when(F.col("good") >= 4, F.coalesce("ok", F.lit(False))).otherwise(F.col("r") <= F.ceil(F.col("n") / 2)).alias("inlier"))


def pose_score(distances: DataFrame, vs: float, by: str = "scan_id") -> DataFrame:
    """Median + p90 / 4 + p95 / 10 + share beyond max(vs, median), times that."""
    q = distances.groupBy(by).agg(F.percentile("distance", [0.5, 0.9, 0.95]).alias("q"))
    joined = distances.join(q, by).withColumn("tail", F.greatest(F.lit(vs), F.col("q")[0]))
    share = joined.groupBy(by, "q", "tail").agg(F.avg((F.col("distance") > F.col("tail")).cast("double")).alias("share"))
    return share.select(by, (F.col("q")[0] + 0.25 * F.col("q")[1] + 0.10 * F.col("q")[2] + F.col("share") * F.col("tail")).alias("score"))


def rank_poses(poses: DataFrame) -> DataFrame:
    """The best pose of each scan by fixed_recall, then iou, then ncc."""
    return poses.groupBy("scan_id").agg(F.max_by("pose", F.struct("fixed_recall", "iou", "ncc")).alias("pose"))


def scale_outlier_groups(sizes: DataFrame, most: float = 1.5) -> DataFrame:
    """Marks subjects whose centroid size is over `most` times their group's median; sizes: scan_id, grp, size."""
    med = sizes.groupBy("grp").agg(F.median("size").alias("med"))
    return sizes.join(med, "grp").select("scan_id", "grp", (F.col("size") > most * F.col("med")).alias("apart"))


def tissue_extent(voxels: DataFrame, axis: str = "z", share: float = 0.15) -> DataFrame:
    """First and last slice whose p95 - p5 is at least `share` of the largest, widened by one within the volume."""
    s = voxels.groupBy("scan_id", axis).agg(F.percentile("v", [0.05, 0.95]).alias("q")).withColumn("span", F.col("q")[1] - F.col("q")[0])
    top = s.groupBy("scan_id").agg(F.max("span").alias("peak"), F.min(axis).alias("a"), F.max(axis).alias("b"))
    kept = s.join(top, "scan_id").where(F.col("span") >= share * F.col("peak"))
    return kept.groupBy("scan_id").agg(F.greatest(F.min(axis) - 1, F.min("a")).alias("first"), F.least(F.max(axis) + 1, F.max("b")).alias("last"))


def occupied_slices(masks: DataFrame, label: int, axis: str = "z") -> DataFrame:
    return masks.where(F.col("label") == label).select("scan_id", F.col(axis).alias("slice")).distinct()


def middle_slab(masks: DataFrame, label: int, axis: str = "z") -> DataFrame:
    """The central half of the occupied slices, and the centre one: a quarter, rounded down, goes at each end."""
    s = occupied_slices(masks, label, axis)
    by = W.partitionBy("scan_id")
    r = s.withColumn("i", F.row_number().over(by.orderBy("slice")) - 1).withColumn("n", F.count("*").over(by))
    quarter = F.floor(F.col("n") / 4)
    kept = r.where((F.col("i") >= quarter) & (F.col("i") < F.col("n") - quarter))
    return kept.select("scan_id", "slice", (F.col("i") == F.floor(F.col("n") / 2)).alias("centre"))


def init_slice(masks: DataFrame, label: int, axis: str = "z", seed: int | None = None) -> DataFrame:
    """scan_id and the slice that a prompt starts from: the centre of the middle slab, or one of its slices drawn by a hash of seed and scan."""
    slab = middle_slab(masks, label, axis)
    if seed is None:
        return slab.groupBy("scan_id").agg(F.array_sort(F.collect_list("slice")).alias("s")).select("scan_id", F.element_at("s", (F.floor(F.size("s") / 2) + 1).cast("int")).alias("slice"))
    return slab.groupBy("scan_id").agg(F.min_by("slice", F.struct(F.xxhash64(F.lit(seed), "scan_id", "slice"), "slice")).alias("slice"))


def slice_bbox(masks: DataFrame, label: int, shape: tuple[int, int], pad: int = 2) -> DataFrame:
    """Per slice z: box of the label, padded and clamped to the shape (y, x)."""
    box = masks.where(F.col("label") == label).groupBy("scan_id", "z").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    low = lambda c: F.greatest(F.col(c) - pad, F.lit(0)).alias(c)
    high = lambda c, n: F.least(F.col(c) + pad, F.lit(n - 1)).alias(c)
    return box.select("scan_id", "z", low("y0"), high("y1", shape[0]), low("x0"), high("x1", shape[1]))


def majority_vote(votes: DataFrame, least: int = 2) -> DataFrame:
    """Cells that at least `least` views keep; votes: scan_id, view, z, y, x."""
    return votes.select("view", *CELL).distinct().groupBy(*CELL).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*CELL)


def projection_sum(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("scan_id", "y", "x").agg(F.sum("v").alias("v"))


def span_summary(events: DataFrame) -> DataFrame:
    """Seconds and share of all per span, and totals by phase; events: span, phase, seconds."""
    all_of = F.sum("seconds").over(W.partitionBy())
    spans = events.groupBy("phase", "span").agg(F.sum("seconds").alias("seconds"))
    return spans.select("phase", "span", "seconds", (100 * F.col("seconds") / all_of).alias("percent"), F.sum("seconds").over(W.partitionBy("phase")).alias("phase_seconds"))


def cohort_snap_distance(distances: DataFrame) -> DataFrame:
    return distances.groupBy("idx").agg(F.avg("snap_distance").alias("mean"), F.count("snap_distance").alias("n"))


def snap_histogram(distances: DataFrame, idx: int, width: float) -> DataFrame:
    return distances.where(F.col("idx") == idx).groupBy(F.floor(F.col("snap_distance") / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def upload_mismatch(distances: DataFrame, vs: float, most: float = 3.0) -> DataFrame:
    """Whether a subject's mean landmark distance is over `most` voxels."""
    return distances.groupBy("scan_id").agg((F.avg("distance") > most * vs).alias("mismatch"))
