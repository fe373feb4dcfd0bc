"""Histograms, background and threshold selection, for all scans at once.

voxels: scan_id, z, y, x, v. A histogram is the only thing that is gathered per scan; everything after it works on rows of bins.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stencil import gaussian_smooth
from .tables import written


def by_scan():
    return W.partitionBy("scan_id")


def value_histogram(voxels: DataFrame, exact_span: int = 1 << 17, bins: int = 65_536) -> DataFrame:
    """scan_id, value, n: exact for whole numbers of a span under `exact_span`, else bins' centres; non-finite values are skipped."""
    finite = voxels.where(~F.isnan("v") & F.col("v").isNotNull() & (F.abs("v") != float("inf")))
    ends = finite.groupBy("scan_id").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.bool_and(F.col("v") == F.floor("v")).alias("whole"))
    width = (F.col("b") - F.col("a")) / bins
    exact = F.col("whole") & (F.col("b") - F.col("a") < exact_span)
    at = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("a")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    value = F.when(exact, F.col("v").cast("double")).otherwise(F.col("a") + (at + 0.5) * width)
    return finite.join(ends, "scan_id").groupBy("scan_id", value.alias("value")).agg(F.count("*").alias("n"))


def fixed_histogram(voxels: DataFrame, bins: int = 65, low: float = 0.0, high: float = 255.0) -> DataFrame:
    """Equal bins, the last one closed; values outside are left out."""
    at = F.least(F.floor((F.col("v") - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return voxels.where((F.col("v") >= low) & (F.col("v") <= high)).groupBy("scan_id", at.alias("bin")).agg(F.count("*").alias("n"))


def span_histogram(voxels: DataFrame, bins: int) -> DataFrame:
    """scan_id, bin, n, a, w, of every bin from 0 to bins - 1 of the scan's own range, empty ones too."""
    ends = voxels.groupBy("scan_id").agg(F.min("v").cast("double").alias("a"), F.max("v").cast("double").alias("b"))
    w = F.when(F.col("b") > F.col("a"), (F.col("b") - F.col("a")) / bins).otherwise(F.lit(1.0))
    at = F.least(F.floor((F.col("v") - F.col("a")) / F.col("w")), F.lit(bins - 1)).cast("int")
    ends = ends.select("scan_id", "a", w.alias("w"))
    counts = voxels.join(ends, "scan_id").groupBy("scan_id", at.alias("bin")).agg(F.count("*").alias("n"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, ["scan_id", "bin"], "left").select("scan_id", "bin", F.coalesce("n", F.lit(0)).alias("n"), "a", "w")


def fd_bins(voxels: DataFrame) -> DataFrame:
    """scan_id, a, w, bins of a Freedman-Diaconis histogram of 16 to 4096 bins; a scan of one value has one bin around it."""
    q = voxels.groupBy("scan_id").agg(F.percentile("v", [0.25, 0.75]).alias("q"), F.min("v").cast("double").alias("a"), F.max("v").cast("double").alias("b"), F.count("*").alias("total"))
    width = 2 * (F.col("q")[1] - F.col("q")[0]) / F.pow(F.col("total").cast("double"), F.lit(1 / 3))
    spread = F.col("b") > F.col("a")
    bins = F.when(spread & (width > 0), F.least(F.greatest(F.ceil((F.col("b") - F.col("a")) / width), F.lit(16)), F.lit(4096))).when(spread, F.lit(16)).otherwise(F.lit(1)).cast("int")
    plan = q.withColumn("bins", bins)
    return plan.select("scan_id", F.when(spread, F.col("a")).otherwise(F.col("a") - 0.5).alias("a"), F.when(spread, (F.col("b") - F.col("a")) / F.col("bins")).otherwise(F.lit(1.0)).alias("w"), "bins")


def fd_histogram(voxels: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """scan_id, a, w, bins, bin, n of the bins that hold values."""
    plan = fd_bins(voxels) if plan is None else plan
    at = F.least(F.floor((F.col("v") - F.col("a")) / F.col("w")), F.col("bins") - 1).cast("int")
    return voxels.select("scan_id", "v").join(plan, "scan_id").groupBy("scan_id", "a", "w", "bins", at.alias("bin")).agg(F.count("*").alias("n"))


def fd_histogram_peak(voxels: DataFrame) -> DataFrame:
    """Peak of a Freedman-Diaconis histogram, refined by a parabola by half a bin at most; the first and last bin aren't refined."""
    counts = fd_histogram(voxels)
    top = counts.groupBy("scan_id", "a", "w", "bins").agg(F.max(F.struct("n", (-F.col("bin")).alias("i"))).alias("t")).select("scan_id", "a", "w", "bins", F.col("t.n").alias("n"), (-F.col("t.i")).alias("bin"))
    beside = lambda d, name: counts.select("scan_id", (F.col("bin") + d).alias("bin"), F.col("n").alias(name))
    met = top.join(beside(1, "l"), ["scan_id", "bin"], "left").join(beside(-1, "r"), ["scan_id", "bin"], "left").na.fill(0, ["l", "r"])
    bend = F.col("l") - 2 * F.col("n") + F.col("r")
    inner = (F.col("bin") > 0) & (F.col("bin") < F.col("bins") - 1)
    move = F.when(inner & (bend < 0), F.least(F.greatest(0.5 * (F.col("l") - F.col("r")) / bend, F.lit(-0.5)), F.lit(0.5))).otherwise(F.lit(0.0))
    return met.select("scan_id", (F.col("a") + (F.col("bin") + 0.5 + move) * F.col("w")).alias("peak"), "w")


def half_max_spread(voxels: DataFrame, peaks: DataFrame) -> DataFrame:
    """scan_id and half: the deviation of a mode from where its histogram falls to half of the peak's bin, on one side.

    peaks: scan_id, peak, side (-1 or 1). The crossing is interpolated; scans whose histogram ends before it are left out.
    """
    counts = written(fd_histogram(voxels))
    plan = counts.select("scan_id", "a", "w", "bins").distinct().join(peaks, "scan_id")
    own = F.least(F.greatest(F.floor((F.col("peak") - F.col("a")) / F.col("w")), F.lit(0)), F.col("bins") - 1).cast("int")
    plan = plan.withColumn("k", own)
    every = plan.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1))).join(counts.select("scan_id", "bin", "n"), ["scan_id", "bin"], "left").na.fill(0, ["n"])
    steps = every.withColumn("step", (F.col("bin") - F.col("k")) * F.col("side")).where("step >= 0")
    order = by_scan().orderBy("step")
    walked = steps.withColumn("half", F.first("n").over(order) / 2.0).withColumn("before", F.lag("n").over(order))
    first = walked.where("n <= half AND step > 0").groupBy("scan_id").agg(F.min_by(F.struct("bin", "n", "half", "before", "a", "w", "side", "peak"), "step").alias("c")).select("scan_id", "c.*")
    share = F.when(F.col("before") != F.col("n"), (F.col("before") - F.col("half")) / (F.col("before") - F.col("n"))).otherwise(F.lit(0.0))
    crossing = F.col("a") + (F.col("bin") - F.col("side") + 0.5) * F.col("w") + F.col("side") * share * F.col("w")
    return first.select("scan_id", (F.abs(crossing - F.col("peak")) / math.sqrt(2 * math.log(2))).alias("half"))


def mode_spread(voxels: DataFrame, peaks: DataFrame, clipped: DataFrame) -> DataFrame:
    """scan_id, spread and rule of the mode at each scan's peak.

    The narrower of both sides' root mean squares; where one end of the range alone is clipped (clipped: scan_id, low_end,
    high_end), the half-maximum width of the other side, if it can be measured.
    """
    d = voxels.select("scan_id", "v").join(peaks.select("scan_id", "peak"), "scan_id").withColumn("d", F.col("v") - F.col("peak"))
    rms = lambda side: F.sqrt(F.avg(F.when(side, F.col("d") * F.col("d"))))
    sides = d.groupBy("scan_id").agg(rms(F.col("d") < 0).alias("below"), rms(F.col("d") > 0).alias("above"))
    cut = clipped.where("low_end <> high_end").select("scan_id", F.when(F.col("low_end"), 1).otherwise(-1).alias("side"))
    half = half_max_spread(voxels, peaks.select("scan_id", "peak").join(cut, "scan_id"))
    met = sides.join(cut, "scan_id", "left").join(half, "scan_id", "left")
    wide = F.col("half") > 0
    rule = F.when(wide & (F.col("side") > 0), "half_max_upper").when(wide, "half_max_lower").when(F.coalesce("below", "above").isNull(), "none").otherwise("narrower_side_rms")
    return met.select("scan_id", F.when(wide, F.col("half")).otherwise(F.coalesce(F.least("below", "above"), F.lit(0.0))).alias("spread"), rule.alias("rule"))


def peak_spread(voxels: DataFrame, peaks: DataFrame) -> DataFrame:
    """Root mean square distance from the peak on the side where it is smaller."""
    d = voxels.join(peaks.select("scan_id", "peak"), "scan_id").withColumn("d", F.col("v") - F.col("peak"))
    rms = lambda side: F.sqrt(F.avg(F.when(side, F.col("d") * F.col("d"))))
    sides = d.groupBy("scan_id").agg(rms(F.col("d") <= 0).alias("below"), rms(F.col("d") >= 0).alias("above"))
    return sides.select("scan_id", F.least("below", "above").alias("spread"))


def range_pile_up(voxels: DataFrame, share: float = 0.01) -> DataFrame:
    """Whether an end of a scan's range holds at least `share` of its voxels."""
    ends = voxels.groupBy("scan_id").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    at = voxels.join(ends, "scan_id").groupBy("scan_id").agg(F.avg((F.col("v") == F.col("a")).cast("double")).alias("low"), F.avg((F.col("v") == F.col("b")).cast("double")).alias("high"))
    return at.select("scan_id", (F.col("low") >= share).alias("low_end"), (F.col("high") >= share).alias("high_end"))


def background_mode_legacy(voxels: DataFrame, thresholds: DataFrame, dtype: str = "uint8") -> DataFrame:
    """uint8: the most frequent value from 2 to T, lowest on ties; uint16: mean in the fullest 500-wide bin from 1000; else mean in (0, T)."""
    joined = voxels.join(thresholds, "scan_id")
    if dtype == "uint8":
        counts = joined.where((F.col("v") >= 2) & (F.col("v") <= F.col("threshold"))).groupBy("scan_id", "v").agg(F.count("*").alias("n"))
        return counts.groupBy("scan_id").agg(F.max(F.struct("n", (-F.col("v")).alias("m"))).alias("t")).select("scan_id", (-F.col("t.m")).cast("double").alias("background"))
    if dtype == "uint16":
        inside = joined.where((F.col("v") >= 1000) & (F.col("v") <= F.col("threshold"))).withColumn("bin", F.floor((F.col("v") - 1000) / 500))
        bins = inside.groupBy("scan_id", "bin").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
        return bins.groupBy("scan_id").agg(F.max_by("mean", F.struct("n", (-F.col("bin")).alias("b"))).alias("background"))
    return joined.where((F.col("v") > 0) & (F.col("v") < F.col("threshold"))).groupBy("scan_id").agg(F.avg("v").alias("background"))


def background_peak_no_zero(voxels: DataFrame, bins: int = 256) -> DataFrame:
    """The lower of the two tallest local peaks of the histogram without zeros, smoothed over three bins; equal heights: the lower bins."""
    h = span_histogram(voxels.where("v <> 0"), bins)
    order = by_scan().orderBy("bin")
    smooth = h.withColumn("s", (F.coalesce(F.lag("n").over(order), F.lit(0)) + F.col("n") + F.coalesce(F.lead("n").over(order), F.lit(0))) / 3)
    l, r = F.coalesce(F.lag("s").over(order), F.lit(-1.0)), F.coalesce(F.lead("s").over(order), F.lit(-1.0))
    peaks = smooth.withColumn("l", l).withColumn("r", r).where((F.col("s") > F.col("l")) & (F.col("s") >= F.col("r")))
    top = peaks.withColumn("k", F.row_number().over(by_scan().orderBy(F.desc("s"), "bin"))).where("k <= 2")
    return top.groupBy("scan_id").agg(F.min(F.col("a") + (F.col("bin") + 0.5) * F.col("w")).alias("background"))


def background_border(voxels: DataFrame, width: int = 2) -> DataFrame:
    """The most frequent value of the outer shell, lowest on ties."""
    box = voxels.groupBy("scan_id").agg(*[f(a).alias(n + a) for a in "zyx" for f, n in ((F.min, "lo_"), (F.max, "hi_"))])
    near = [(F.col(a) < F.col("lo_" + a) + width) | (F.col(a) > F.col("hi_" + a) - width) for a in "zyx"]
    shell = voxels.join(box, "scan_id").where(near[0] | near[1] | near[2])
    counts = shell.groupBy("scan_id", "v").agg(F.count("*").alias("n"))
    return counts.groupBy("scan_id").agg(F.max(F.struct("n", (-F.col("v")).alias("m"))).alias("t")).select("scan_id", (-F.col("t.m")).cast("double").alias("background"))


def threshold_otsu(voxels: DataFrame) -> DataFrame:
    """The value with the largest between-class variance, lowest on ties; the class below holds the value itself."""
    h = value_histogram(voxels)
    run, all_of = by_scan().orderBy("value"), by_scan()
    c = h.select("scan_id", "value", F.sum("n").over(run).alias("w0"), F.sum(F.col("n") * F.col("value")).over(run).alias("m0"), F.sum("n").over(all_of).alias("w"), F.sum(F.col("n") * F.col("value")).over(all_of).alias("m"))
    gap = F.col("m0") / F.col("w0") - (F.col("m") - F.col("m0")) / (F.col("w") - F.col("w0"))
    scored = c.where("w0 < w").withColumn("between", F.col("w0") * (F.col("w") - F.col("w0")) * gap * gap)
    return scored.groupBy("scan_id").agg(F.max(F.struct("between", (-F.col("value")).alias("t"))).alias("b")).select("scan_id", (-F.col("b.t")).alias("threshold"))


def threshold_li(voxels: DataFrame, rounds: int = 64) -> DataFrame:
    """Iterative minimum cross-entropy from the 95th percentile, truncated; a fixed number of rounds over the histogram.

    The means above and below are of v - min + 1, so that logarithms exist. Scans that stop moving stay where they are.
    """
    values = F.collect_list(F.struct("value", F.col("n").cast("double").alias("n")))
    start = voxels.groupBy("scan_id").agg(F.percentile("v", 0.95).alias("t0"))
    per = value_histogram(voxels).groupBy("scan_id").agg(values.alias("h"), F.min("value").alias("low")).join(start, "scan_id")

    def sums(t):
        add = lambda name, cond, x: lambda a, e: (a[name] + F.when(cond(e), x(e)).otherwise(0.0)).alias(name)
        high, low = (lambda e: e["value"] > t), (lambda e: e["value"] <= t)
        parts = [add("sh", high, lambda e: e["n"] * e["value"]), add("nh", high, lambda e: e["n"]), add("sl", low, lambda e: e["n"] * e["value"]), add("nl", low, lambda e: e["n"])]
        zero = F.struct(*[F.lit(0.0).alias(k) for k in ("sh", "nh", "sl", "nl")])
        return F.aggregate("h", zero, lambda a, e: F.struct(*[p(a, e) for p in parts]), lambda a: move(t, a))

    def move(t, a):
        hi, lo = a["sh"] / a["nh"] - F.col("low") + 1, a["sl"] / a["nl"] - F.col("low") + 1
        fits = (a["nh"] > 0) & (a["nl"] > 0)
        return F.when(fits & (hi > lo), (hi - lo) / (F.log(hi) - F.log(lo)) + F.col("low") - 1).otherwise(t)

    # a threshold that a round leaves in place stays for good, so the sums over the histogram end there
    begin = F.struct(F.col("t0").alias("t"), F.lit(None).cast("double").alias("was"))
    settled = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, lambda s, i: F.when(s["t"] == s["was"], s).otherwise(F.struct(sums(s["t"]).alias("t"), s["t"].alias("was"))), lambda s: s["t"])
    return per.select("scan_id", F.floor(settled).cast("double").alias("threshold"))


def threshold_kapur(voxels: DataFrame, bins: int = 256, stride: int = 2, eps: float = 1e-10) -> DataFrame:
    """Upper edge of the bin with the largest summed entropy of both classes, on every stride-th voxel of each axis."""
    sample = voxels.where((F.col("z") % stride == 0) & (F.col("y") % stride == 0) & (F.col("x") % stride == 0))
    h = span_histogram(sample, bins)
    p = F.col("n") / F.sum("n").over(by_scan())
    run = by_scan().orderBy("bin")
    terms = h.withColumn("p", p).withColumn("e", F.col("p") * F.log(F.col("p") + eps))
    c = terms.select("scan_id", "bin", "a", "w", F.sum("p").over(run).alias("p0"), F.sum("e").over(run).alias("e0"), F.sum("e").over(by_scan()).alias("e"))
    low = F.log(F.col("p0") + eps) - F.col("e0") / (F.col("p0") + eps)
    high = F.log(1 - F.col("p0") + eps) - (F.col("e") - F.col("e0")) / (1 - F.col("p0") + eps)
    scored = c.where(F.col("bin") < bins - 1).withColumn("h", F.round(low + high, 9))
    return scored.groupBy("scan_id").agg(F.max(F.struct("h", (-F.col("bin")).alias("b"), "a", "w")).alias("t")).select("scan_id", (F.col("t.a") + (1 - F.col("t.b")) * F.col("t.w")).alias("threshold"))


def threshold_percentile_match(voxels: DataFrame, reference: int, reference_threshold: float) -> DataFrame:
    """The share of the reference's voxels below its threshold, as a percentile of each scan; never under the scan's minimum."""
    share = voxels.where(F.col("scan_id") == reference).agg(F.avg((F.col("v") < reference_threshold).cast("double")).alias("share"))
    q = share.first()[0] or 0.0
    return voxels.groupBy("scan_id").agg(F.greatest(F.percentile("v", q), F.min("v").cast("double")).alias("threshold"))


def threshold_peak_shift(voxels: DataFrame, reference: int, reference_threshold: float, bins: int = 64) -> DataFrame:
    """T_ref - (peak_ref - peak_scan), truncated and floored at the scan's minimum.

    As in the engine that this rule comes from, bins below the scan's own Otsu threshold don't count 0 but the data's minimum.
    """
    h = span_histogram(voxels, bins).join(threshold_otsu(voxels), "scan_id")
    centre = F.col("a") + (F.col("bin") + 0.5) * F.col("w")
    counted = h.withColumn("c", F.when(centre < F.col("threshold"), F.col("a")).otherwise(F.col("n").cast("double")))
    peaks = counted.groupBy("scan_id").agg(F.max(F.struct("c", (-F.col("bin")).alias("i"), centre.alias("peak"))).alias("t"), F.min("a").alias("low")).select("scan_id", F.col("t.peak").alias("peak"), "low")
    ref = peaks.where(F.col("scan_id") == reference).select(F.col("peak").alias("ref"))
    moved = F.lit(float(reference_threshold)) - (F.col("ref") - F.col("peak"))
    return peaks.join(F.broadcast(ref)).select("scan_id", F.greatest(F.when(moved < 0, F.ceil(moved)).otherwise(F.floor(moved)).cast("double"), F.col("low")).alias("threshold"))


def same_threshold(voxels: DataFrame, reference_threshold: float) -> DataFrame:
    return voxels.select("scan_id").distinct().withColumn("threshold", F.lit(float(reference_threshold)))


#: Threshold methods by name; the last three take a reference scan and its threshold.
METHODS = {
    "otsu": threshold_otsu, "li": threshold_li, "kapur": threshold_kapur,
    "percentile": threshold_percentile_match, "peak": threshold_peak_shift,
    "same": lambda voxels, reference, value: same_threshold(voxels, value),
}


def align_thresholds(method: str, voxels: DataFrame, eligible: DataFrame, reference: int | None = None, value: float | None = None, sigma: float | None = 1.0) -> DataFrame:
    """scan_id, threshold and foreground (voxels above it) of every eligible scan.

    Thresholds are found on volumes smoothed by a Gaussian of `sigma` (None: as they are), each pass cut to whole numbers if the
    voxels are; they are never below a scan's smoothed minimum, but for method "same". Without a value, the reference's own Otsu
    threshold counts.
    """
    kept = eligible.where("keep").select("scan_id").distinct()
    needed = kept if reference is None else kept.union(voxels.sparkSession.createDataFrame([(reference,)], kept.schema)).distinct()
    work = voxels.join(needed, "scan_id", "left_semi")
    if sigma and method != "same":
        work = written(gaussian_smooth(work, sigma, whole=isinstance(voxels.schema["v"].dataType, T.IntegralType)))
    if value is None and method in ("percentile", "peak", "same"):
        value = threshold_otsu(work.where(F.col("scan_id") == reference)).first()["threshold"]
    chosen = METHODS[method](work) if method in ("otsu", "li", "kapur") else METHODS[method](work, reference, value)
    if method != "same":
        low = work.groupBy("scan_id").agg(F.min("v").cast("double").alias("low"))
        chosen = chosen.join(low, "scan_id").select("scan_id", F.greatest("threshold", "low").alias("threshold"))
    counts = voxels.join(chosen.join(kept, "scan_id", "left_semi"), "scan_id").groupBy("scan_id", "threshold").agg(F.sum((F.col("v") > F.col("threshold")).cast("long")).alias("foreground"))
    return counts.select("scan_id", "threshold", "foreground")


def average_pool(voxels: DataFrame, factor: int) -> DataFrame:
    """Means of blocks, edges repeated to fill the last blocks, rounded half-even."""
    if factor == 1:
        return voxels
    top = voxels.groupBy("scan_id").agg(*[F.max(a).alias(f"m{a}") for a in "zyx"])
    joined = voxels.join(top, "scan_id")
    weight = F.lit(1)
    for a in "zyx":
        short = factor - 1 - F.col(f"m{a}") % factor
        weight = weight * F.when(F.col(a) == F.col(f"m{a}"), 1 + short).otherwise(F.lit(1))
    cells = [F.floor(F.col(a) / factor).cast("int").alias(a) for a in "zyx"]
    pooled = joined.withColumn("w", weight).groupBy("scan_id", *cells).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("mean"))
    return pooled.select("scan_id", "z", "y", "x", F.rint("mean").cast("int").alias("v"))


def quantize_preview(voxels: DataFrame, factor: int) -> DataFrame:
    """Pooled means as 0-255, truncated, with the scale and zero to undo it; a constant scan becomes 0."""
    cells = [F.floor(F.col(a) / factor).cast("int").alias(a) for a in "zyx"]
    pooled = voxels.groupBy("scan_id", *cells).agg(F.avg("v").alias("m"))
    ends = pooled.groupBy("scan_id").agg(F.min("m").alias("zero"), F.max("m").alias("top"))
    scale = (F.col("top") - F.col("zero")) / 255
    q = F.when(F.col("top") > F.col("zero"), F.least(F.floor((F.col("m") - F.col("zero")) / scale), F.lit(255))).otherwise(F.lit(0)).cast("int")
    return pooled.join(ends, "scan_id").select("scan_id", "z", "y", "x", q.alias("v"), scale.alias("scale"), "zero")
