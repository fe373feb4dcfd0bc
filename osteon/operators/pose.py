"""Pose search, background estimation and named metrics, composed of the other operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blocks, evaluate, graph, spatial, stencil, thresholds
from .geometry import AXES
from .tables import written

CELL = ("scan_id", "z", "y", "x")


def ransac_rigid(matches: DataFrame, tries: int = 200, apart: float = 2.5, inlier: float = 8.0, seed: int = 1, degrees: float = 8.0, top: int = 5) -> DataFrame:
    """The best rigid poses of each scan from point matches (scan_id, id, x, y, z, tx, ty, tz, sim).

    Hypotheses are rows: three matches each, drawn by a seeded hash of try and match, weighted by similarity; triples with points closer than
    `apart` are left out. All are fitted at once and scored on all matches by the sum of similarities of the inliers times the root of their
    number; poses within `degrees` of a better one are dropped. Matches of a scan are few; tries is a bound.
    """
    drawn = matches.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    u = (F.pmod(F.xxhash64(F.lit(seed), "try", "id"), F.lit(1 << 30)) + 1) / float(1 << 30)
    key = -F.log(u) / F.greatest("sim", F.lit(1e-6))
    three = drawn.withColumn("k", F.row_number().over(W.partitionBy("scan_id", "try").orderBy(key, "id"))).where("k <= 3")
    a = three.groupBy("scan_id", "try").agg(F.collect_list(F.struct(*AXES)).alias("p"), F.count("*").alias("n")).where("n = 3")
    gap = lambda i, j: F.sqrt(sum((F.col("p")[i][x] - F.col("p")[j][x]) ** 2 for x in AXES))
    wide = a.where((gap(0, 1) >= apart) & (gap(1, 2) >= apart) & (gap(0, 2) >= apart)).select("scan_id", "try")
    code = (F.col("scan_id") * tries + F.col("try")).alias("scan_id")
    poses = evaluate.kabsch_batch(three.join(wide, ["scan_id", "try"], "left_semi").select(code, *AXES, *[f"t{x}" for x in AXES])).withColumn("try", F.col("scan_id") % tries).withColumn("scan_id", F.floor(F.col("scan_id") / tries))
    met = matches.join(poses, "scan_id")
    off = [sum(F.col(f"r{i}{k + 1}") * F.col(x) for k, x in enumerate(AXES)) + F.col(f"t_{AXES[i - 1]}") - F.col(f"t{AXES[i - 1]}") for i in (1, 2, 3)]
    hit = F.sqrt(off[0] ** 2 + off[1] ** 2 + off[2] ** 2) <= inlier
    scored = met.groupBy("scan_id", "try").agg((F.sum(F.when(hit, F.col("sim")).otherwise(0.0)) * F.sqrt(F.sum(hit.cast("double")))).alias("score"))
    full = written(scored.join(poses, ["scan_id", "try"]))
    rot = [f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
    other = full.select("scan_id", F.col("try").alias("o"), F.col("score").alias("os"), *[F.col(c).alias(f"o_{c}") for c in rot])
    trace = sum(F.col(c) * F.col(f"o_{c}") for c in rot)
    near = F.degrees(F.acos(F.least(F.greatest((trace - 1) / 2, F.lit(-1.0)), F.lit(1.0)))) < degrees
    better = (F.col("os") > F.col("score")) | ((F.col("os") == F.col("score")) & (F.col("o") < F.col("try")))
    beaten = full.join(other, "scan_id").where(near & better).select("scan_id", "try").distinct()
    kept = full.join(beaten, ["scan_id", "try"], "left_anti")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("scan_id").orderBy(F.desc("score"), "try"))).where(F.col("rank") <= top)


def _flips(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            _, axes = np.linalg.eigh(np.array(r.cov).reshape(3, 3))
            seeds = [np.eye(3)] + [2 * np.outer(v, v) - np.eye(3) for v in axes.T]
            for k, s in enumerate(seeds):
                if not any(np.allclose(s, o) for o in seeds[:k]):
                    out.append((r.scan_id, k, *s.reshape(-1)))
        yield pd.DataFrame(out, columns=["scan_id", "seed", *[f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]])


def pca_flip_seeds(points: DataFrame) -> DataFrame:
    """Four rotations per scan: none, and half a turn about each principal axis; the 3x3 decomposition is done on one row a scan."""
    cov = F.array(*[F.covar_pop(a, b) for a in AXES for b in AXES])
    return points.groupBy("scan_id").agg(cov.alias("cov")).mapInPandas(_flips, "scan_id long, seed int, " + ", ".join(f"r{i}{j} double" for i in (1, 2, 3) for j in (1, 2, 3)))


def union_foreground(voxels: DataFrame, threshold: float) -> DataFrame:
    """Cells that are in the largest component of any subject."""
    labeled = written(graph.label_components(voxels.where(F.col("v") > threshold)))
    sizes = graph.component_sizes(labeled)
    best = sizes.groupBy("scan_id").agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("b")).select("scan_id", (-F.col("b.c")).alias("component"))
    return labeled.join(best, ["scan_id", "component"], "left_semi").select("z", "y", "x").distinct()


#: Regions whose peak is the background: far outside of the specimen, or the tissue next to it.
REGIONS = ("outside", "surrounding_tissue")
MOST_SAMPLED, AIR_SIGMAS = 16_000_000, 3.0


def region_name(requested: str | None) -> str:
    name = (requested or "").strip().lower()
    return name if name in REGIONS else REGIONS[0]


def sampled(voxels: DataFrame, most: int = MOST_SAMPLED, least_stride: int = 2) -> DataFrame:
    """Every s-th voxel of each axis, with s as its stride; s is the least, from least_stride on, that leaves at most `most` of a scan's box."""
    n = blocks.extents(voxels)
    total = F.col("nz").cast("double") * F.col("ny") * F.col("nx")
    stride = F.greatest(F.when(total > most, F.ceil(F.pow(total / most, F.lit(1 / 3)) - 1e-12)).otherwise(F.lit(1)), F.lit(least_stride)).cast("int")
    met = voxels.join(n.select("scan_id", stride.alias("stride")), "scan_id").where(" AND ".join(f"{a} % stride = 0" for a in "zyx"))
    return met.select("scan_id", *[F.floor(F.col(a) / F.col("stride")).cast("int").alias(a) for a in "zyx"], "v", "stride")


def _blur_and_fill(sigma: float, guard: float):
    """Blurred values, and whether a cell is closer than the guard to constant fill: below the threshold and one value in 3x3x3."""
    weights = np.array(stencil.kernel(sigma))
    near = int(np.ceil(guard))
    halo = max(len(weights) // 2, near + 1)
    cube = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]

    def work(arrays: list, inside: np.ndarray) -> list:
        v, below = arrays
        cut = halo - len(weights) // 2
        blurred = v[tuple(slice(cut, n - cut) for n in v.shape)]
        for axis in range(3):
            blurred = blocks.weighted(blurred, weights, axis)
        around = [blocks.shifted(v, o, 1) for o in cube]
        fill = (np.maximum.reduce(around) == np.minimum.reduce(around)) & blocks.shifted((below > 0) & inside, (0, 0, 0), 1)
        close = blocks.shifted(blocks.squared_distances(fill), (0, 0, 0), halo - 1) < guard * guard
        return [blurred, close]

    return halo, work


def background_cells(voxels: DataFrame, levels: DataFrame, sigma: float = 1.0, guard: float = 3.0) -> DataFrame:
    """Cells whose value may be background: scan_id, v, blurred, d (distance to the specimen in cells) and exterior.

    Specimen: v >= threshold. Eligible are cells below it, at least `guard` from the specimen and from constant fill. Exterior
    cells are connected to the volume's border below the threshold. voxels: whole boxes; levels: scan_id, threshold.
    """
    marked = written(voxels.join(levels, "scan_id").select(*CELL, "v", (F.col("v") >= F.col("threshold")).alias("site")))
    outside = graph.exterior(marked.select(*CELL, F.col("site").cast("int").alias("v")), 0).withColumn("exterior", F.lit(True))
    halo, work = _blur_and_fill(sigma, guard)
    shaped = blocks.over_blocks(marked.withColumn("below", (~F.col("site")).cast("double")), halo, work, ["blurred", "fill"], columns=("v", "below"), pad="edge")
    far = blocks.distance_transform(marked).where(~F.col("site") & (F.col("d2") >= guard * guard)).select(*CELL, "v", F.sqrt("d2").alias("d"))
    kept = far.join(shaped.where("fill = 0"), list(CELL)).join(outside, list(CELL), "left")
    return kept.select("scan_id", "v", "blurred", "d", F.coalesce("exterior", F.lit(False)).alias("exterior"))


def estimate_background(
    voxels: DataFrame, levels: DataFrame, guard: float = 3.0, least: int = 2000, region: str | None = None, sigma: float = 1.0, most: int = MOST_SAMPLED, least_stride: int = 2, dtype: str = "uint8",
) -> DataFrame:
    """Background of every scan at once, and how it was found.

    On a sample of each volume (`sampled`), the eligible cells (`background_cells`) are split at the median distance of the
    exterior ones. Region "outside": exterior cells at or beyond it. "surrounding_tissue": the innermost shell around the specimen, one
    guard wide; its width doubles until it holds `least` cells, but not past the split, and cells within three spreads of the
    outer region's peak (air) are left out if `least` cells remain. The value is the peak of a Freedman-Diaconis histogram
    of the blurred values, rounded half-even. Scans with fewer than `least` cells fall back to the most frequent low value, with the reason.

    levels: scan_id, threshold. Returns scan_id, background, reason, stride, eligible, split, shell_outer, samples, peak, air_peak,
    air_spread, air_rule, air_exclusion ("applied", "skipped" or null).
    """
    region = region_name(region)
    small = written(sampled(voxels, most, least_stride))
    cells = written(background_cells(small.drop("stride"), levels, sigma, guard))
    q = lambda c: F.percentile(c, 0.5)
    split = cells.groupBy("scan_id").agg(F.count("*").alias("eligible"), F.coalesce(q(F.when(F.col("exterior"), F.col("d"))), q(F.col("d"))).alias("split"))
    split = written(split)
    fit = cells.join(split.where(F.col("eligible") >= least), "scan_id")
    air = written(fit.where(F.col("exterior") & (F.col("d") >= F.col("split"))).select("scan_id", "v", "blurred"))
    none = levels.select("scan_id").limit(0)
    shells = none.withColumn("shell_outer", F.lit(None).cast("double"))
    exclusion = none.select("scan_id", *[F.lit(None).cast(t).alias(c) for c, t in (("air_peak", "double"), ("air_spread", "double"), ("air_rule", "string"), ("air_exclusion", "string"))])
    if region == "outside":
        values = air.select("scan_id", F.col("blurred").alias("v"))
    else:
        # the doubling that first reaches past a distance; the shell is the first that holds enough, or ends at the split
        step = F.greatest(F.ceil(F.log2((F.floor(F.col("d") * (1 << 20)) / (1 << 20) + 2.0 ** -20 - guard) / guard)), F.lit(0)).cast("int")
        counts = fit.groupBy("scan_id", "split", step.alias("step")).agg(F.count("*").alias("n"))
        held = counts.withColumn("held", F.sum("n").over(W.partitionBy("scan_id").orderBy("step"))).withColumn("outer", F.least(guard + guard * F.pow(F.lit(2.0), F.col("step")), F.col("split")))
        done = held.where((F.col("held") >= least) & (F.col("outer") < F.col("split"))).groupBy("scan_id").agg(F.min("outer").alias("outer"))
        shells = written(fit.select("scan_id", "split").distinct().join(done, "scan_id", "left").select("scan_id", F.coalesce("outer", "split").alias("shell_outer")))
        near = written(fit.join(shells, "scan_id").where(F.col("d") < F.col("shell_outer")).select("scan_id", F.col("blurred").alias("v")))
        enough = written(air.groupBy("scan_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("scan_id"))
        air = air.join(enough, "scan_id", "left_semi")
        measured = air.select("scan_id", F.col("blurred").alias("v"))
        peaks = written(thresholds.fd_histogram_peak(measured).select("scan_id", "peak"))
        spread = thresholds.mode_spread(measured, peaks, thresholds.range_pile_up(air.select("scan_id", "v")))
        peaks = written(peaks.join(spread, "scan_id").select("scan_id", F.col("peak").alias("air_peak"), F.col("spread").alias("air_spread"), F.col("rule").alias("air_rule")))
        marked = near.join(peaks, "scan_id", "left").withColumn("tissue", F.coalesce(F.abs(F.col("v") - F.col("air_peak")) > AIR_SIGMAS * F.col("air_spread"), F.lit(True)))
        left = marked.groupBy("scan_id").agg(F.sum(F.col("tissue").cast("long")).alias("left"))
        exclusion = written(shells.select("scan_id").join(peaks, "scan_id", "left").join(left, "scan_id", "left").select(
            "scan_id", "air_peak", "air_spread", "air_rule", F.when(F.col("air_peak").isNotNull() & (F.col("left") >= least), "applied").otherwise("skipped").alias("air_exclusion")))
        values = marked.join(exclusion.select("scan_id", "air_exclusion"), "scan_id").where(F.col("tissue") | (F.col("air_exclusion") == "skipped")).select("scan_id", "v")
    values = written(values)
    found = values.groupBy("scan_id").agg(F.count("*").alias("samples")).join(thresholds.fd_histogram_peak(values).select("scan_id", "peak"), "scan_id")
    legacy = thresholds.background_mode_legacy(voxels, levels, dtype)
    strides = small.groupBy("scan_id").agg(F.first("stride").alias("stride"))
    met = levels.select("scan_id").distinct()
    for other in (strides, split, shells, exclusion, found, legacy):
        met = met.join(other, "scan_id", "left")
    few = F.coalesce("eligible", F.lit(0)) < least
    good = ~few & (F.coalesce("samples", F.lit(0)) >= least)
    reason = F.when(few, "too few cells beyond the guard").when(~good, "too few cells in the region").otherwise(F.lit(region))
    return met.select(
        "scan_id", F.when(good, F.rint("peak")).otherwise(F.col("background")).alias("background"), reason.alias("reason"), "stride", F.coalesce("eligible", F.lit(0)).alias("eligible"), "split", "shell_outer",
        F.coalesce("samples", F.lit(0)).alias("samples"), "peak", "air_peak", "air_spread", "air_rule", "air_exclusion")


def _local(points: DataFrame, subject: DataFrame, reference: DataFrame, r: int) -> DataFrame:
    d = stencil.local_ncc(reference, subject, r)
    return points.select("scan_id", "id", *[F.rint(a).cast("int").alias(a) for a in AXES]).join(d, list(CELL)).select("scan_id", F.col("id").alias("vertex_id"), F.col("d").alias("value"))


#: Per-vertex metrics: the function, and whether it works on voxel and on mesh subjects.
METRICS = {
    "surface_distance": (lambda points, faces, **_: spatial.surface_distance(points, faces, ["scan_id"]).select("scan_id", F.col("id").alias("vertex_id"), F.col("distance").alias("value")), True, True),
    "parallel_distance": (lambda points, faces, **_: spatial.parallel_surface_distance(points, faces, ["scan_id"]).select("scan_id", F.col("id").alias("vertex_id"), F.col("distance").alias("value")), True, True),
    "ncc": (lambda points, subject, reference, r=5, **_: _local(points, subject, reference, r), True, False),
}
#: Older names of metrics.
LEGACY = {"dice": "surface_distance", "surface": "surface_distance", "local_ncc": "ncc"}


def metric_name(requested: str | None, mesh: bool = False) -> str:
    """The metric that a request stands for, whatever its case and outer blanks; what isn't known or supported is surface distance."""
    key = (requested or "").strip().lower()
    key = LEGACY.get(key, key)
    return key if key in METRICS and METRICS[key][2 if mesh else 1] else "surface_distance"


def run_metric(name: str | None, mesh: bool = False, **inputs) -> DataFrame:
    """vertex_metric rows (scan_id, metric, vertex_id, value) of a named metric over the cohort."""
    name = metric_name(name, mesh)
    return METRICS[name][0](**inputs).withColumn("metric", F.lit(name))
