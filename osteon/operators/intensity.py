"""Intensities: background, windows, normalisation, channels and masks.

voxels: scan_id, z, y, x, v; limits of a storage type are given by its name. Per-scan parameters arrive as small
tables keyed by scan_id; Spark decides how to join them. Integer results are rounded half-even and clipped to the type.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The range of each storage type.
RANGES = {"uint8": (0, 255), "int8": (-128, 127), "uint16": (0, 65535), "int16": (-32768, 32767)}
CELL = ("scan_id", "z", "y", "x")
#: Equal parts of the cumulative share in which histograms meet.
SHARE_BINS = 4096


def clip(v: Column, dtype: str) -> Column:
    low, high = RANGES[dtype]
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def saturating_cast(v: Column, dtype: str) -> Column:
    if dtype not in RANGES:
        return v.cast("double")
    return clip(F.rint(v), dtype).cast("int")


def subtract_background(voxels: DataFrame, offsets: DataFrame, dtype: str = "uint8") -> DataFrame:
    """Takes int(offset) from every voxel; offsets: scan_id, offset. Scans without one, or with 0, stay."""
    shift = F.coalesce(F.col("offset").cast("int"), F.lit(0))
    return voxels.join(offsets, "scan_id", "left").withColumn("v", clip(F.col("v") - shift, dtype)).drop("offset")


def shift_threshold(thresholds: DataFrame, offsets: DataFrame) -> DataFrame:
    return thresholds.join(offsets, "scan_id", "left").withColumn("threshold", F.col("threshold") - F.coalesce(F.col("offset").cast("int"), F.lit(0))).drop("offset")


def remove_background(voxels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Voxels below the threshold take the scan's minimum."""
    low = voxels.groupBy("scan_id").agg(F.min("v").alias("low")).join(thresholds, "scan_id")
    return voxels.join(low, "scan_id").withColumn("v", F.when(F.col("v") < F.col("threshold"), F.col("low")).otherwise(F.col("v"))).drop("low", "threshold")


def shift_to_reference_threshold(voxels: DataFrame, thresholds: DataFrame, reference: Column, dtype: str = "uint8") -> DataFrame:
    shifted = voxels.join(thresholds, "scan_id")
    return shifted.withColumn("v", F.least(F.greatest(F.col("v") + (reference - F.col("threshold")), F.lit(0)), F.lit(RANGES[dtype][1]))).drop("threshold")


def percentile_normalize(voxels: DataFrame, thresholds: DataFrame, lo: float = 2.0, hi: float = 99.5, dtype: str = "uint8") -> tuple[DataFrame, DataFrame]:
    """Stretches [p_lo, p_hi] of all voxels to [0, max], truncated; the threshold follows. Scans with p_hi <= p_lo stay as they are."""
    top = RANGES[dtype][1]
    p = voxels.groupBy("scan_id").agg(F.percentile("v", [lo / 100, hi / 100]).alias("p")).select("scan_id", F.col("p")[0].alias("p_lo"), F.col("p")[1].alias("p_hi"))
    mapped = lambda c: F.floor((F.least(F.greatest(c, F.col("p_lo")), F.col("p_hi")) - F.col("p_lo")) / (F.col("p_hi") - F.col("p_lo")) * top + 1e-9).cast("int")
    keep = F.col("p_hi") <= F.col("p_lo")
    out = voxels.join(p, "scan_id").withColumn("v", F.when(keep, F.col("v")).otherwise(mapped(F.col("v")))).drop("p_lo", "p_hi")
    new = thresholds.join(p, "scan_id").withColumn("threshold", F.when(keep, F.col("threshold")).otherwise(F.least(F.greatest(mapped(F.col("threshold")), F.lit(0)), F.lit(top)))).drop("p_lo", "p_hi")
    return out, new


def tissue_ranges(voxels: DataFrame, thresholds: DataFrame, bins: int = 256) -> DataFrame:
    """Per scan, from the foreground: mode p of the histogram, soft range and bone range."""
    fore = voxels.join(thresholds, "scan_id").where(F.col("v") > F.col("threshold"))
    span = fore.groupBy("scan_id", "threshold").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.percentile("v", 0.99).alias("p99"))
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("a")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = fore.drop("threshold").join(span, "scan_id").groupBy("scan_id", "threshold", "a", "p99", width.alias("w"), at.alias("bin")).agg(F.count("*").alias("n"))
    mode = counts.groupBy("scan_id", "threshold", "p99").agg(F.max(F.struct("n", (-F.col("bin")).alias("i"), (F.col("a") + (F.col("bin") + 0.5) * F.col("w")).alias("p"))).alias("m"))
    p = F.col("m.p")
    return mode.select("scan_id", F.greatest(F.col("threshold").cast("double"), p * 0.5).alias("soft_lo"), (p * 1.5).alias("soft_hi"), F.greatest(F.col("p99"), p * 1.5).alias("bone_hi"))


def tissue_aware_normalize(voxels: DataFrame, thresholds: DataFrame, reference: int, dtype: str = "uint8") -> DataFrame:
    """Maps each scan's soft and bone ranges linearly onto the reference scan's; what is outside keeps its offset from the nearest end."""
    ranges = tissue_ranges(voxels, thresholds)
    ref = ranges.where(F.col("scan_id") == reference).select(*[F.col(c).alias(f"r_{c}") for c in ("soft_lo", "soft_hi", "bone_hi")])
    joined = voxels.join(ranges, "scan_id").join(F.broadcast(ref))
    v = F.col("v")
    part = lambda a, b, ra, rb: F.col(ra) + (v - F.col(a)) * F.when(F.col(b) > F.col(a), (F.col(rb) - F.col(ra)) / (F.col(b) - F.col(a))).otherwise(F.lit(1.0))
    new = (
        F.when(v < F.col("soft_lo"), v + F.col("r_soft_lo") - F.col("soft_lo"))
        .when(v <= F.col("soft_hi"), part("soft_lo", "soft_hi", "r_soft_lo", "r_soft_hi"))
        .when(v <= F.col("bone_hi"), part("soft_hi", "bone_hi", "r_soft_hi", "r_bone_hi"))
        .otherwise(v + F.col("r_bone_hi") - F.col("bone_hi"))
    )
    return joined.select(*CELL, saturating_cast(new, dtype).alias("v"))


def match_histogram_foreground(voxels: DataFrame, thresholds: DataFrame, reference: int, dtype: str = "uint8") -> DataFrame:
    """Gives each foreground value the reference's value at the same cumulative share, interpolated linearly."""
    from pyspark.sql import Window as W

    fore = voxels.join(thresholds, "scan_id").where(F.col("v") > F.col("threshold"))
    counts = fore.groupBy("scan_id", "v").agg(F.count("*").alias("n"))
    run = F.sum("n").over(W.partitionBy("scan_id").orderBy("v")) / F.sum("n").over(W.partitionBy("scan_id"))
    shares = counts.withColumn("q", run)
    ref = shares.where(F.col("scan_id") == reference).select(F.col("q").alias("q1"), F.col("v").cast("double").alias("v1"))
    before = W.orderBy("q1")  # one row per value of one scan
    steps = ref.withColumn("q0", F.coalesce(F.lag("q1").over(before), F.lit(-1.0))).withColumn("v0", F.coalesce(F.lag("v1").over(before), F.col("v1")))
    # a step is listed at each share bin that it covers, so that shares meet the steps of their own bin only
    bin_of = lambda q: F.floor(q * SHARE_BINS).cast("int")
    listed = steps.withColumn("bin", F.explode(F.sequence(bin_of(F.greatest(F.col("q0"), F.lit(0.0))), bin_of(F.col("q1")))))
    met = shares.withColumn("bin", bin_of(F.col("q"))).join(listed, "bin").where((F.col("q") > F.col("q0")) & (F.col("q") <= F.col("q1")))
    new = F.when(F.col("q0") < 0, F.col("v1")).otherwise(F.col("v0") + (F.col("q") - F.col("q0")) / (F.col("q1") - F.col("q0")) * (F.col("v1") - F.col("v0")))
    lookup = met.select("scan_id", "v", saturating_cast(new, dtype).alias("matched"))
    return voxels.join(lookup, ["scan_id", "v"], "left").select(*CELL, F.coalesce("matched", "v").alias("v"))


def min_max_normalize(voxels: DataFrame, a: float = 0.0, b: float = 1.0) -> DataFrame:
    """Maps each scan's [min, max] to [a, b]; a constant scan becomes a."""
    ends = voxels.groupBy("scan_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return voxels.join(ends, "scan_id").withColumn("v", F.when(F.col("hi") > F.col("lo"), a + share * (b - a)).otherwise(F.lit(float(a)))).drop("lo", "hi")


def restore_range(voxels: DataFrame, ranges: DataFrame, a: float = 0.0, b: float = 1.0) -> DataFrame:
    """Undoes min_max_normalize; ranges: scan_id, lo, hi."""
    return voxels.join(ranges, "scan_id").withColumn("v", F.col("lo") + (F.col("v") - a) / (b - a) * (F.col("hi") - F.col("lo"))).drop("lo", "hi")


def map_background(voxels: DataFrame, value: float, threshold: float) -> DataFrame:
    return voxels.withColumn("v", F.when(F.col("v") <= threshold, F.lit(value)).otherwise(F.col("v")))


def compose_intensity_maps(steps: DataFrame) -> DataFrame:
    """Folds each file's steps in order of seq: v' = v * s + o, so original = stored * scale + shift.

    steps: scan_id, filename, seq, s, o. A step with s = 0 keeps the old map.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "s", "o")))
    start = F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("shift"))
    fold = lambda acc, e: F.when(e["s"] == 0, acc).otherwise(F.struct((acc["scale"] / e["s"]).alias("scale"), (acc["shift"] - e["o"] * acc["scale"] / e["s"]).alias("shift")))
    return steps.groupBy("scan_id", "filename").agg(F.aggregate(ordered, start, fold).alias("m")).select("scan_id", "filename", F.col("m.scale").alias("mapping_scale"), F.col("m.shift").alias("mapping_shift"))


def resolve_intensity_map(edits: DataFrame, maps: DataFrame) -> DataFrame:
    """The map of the edit's file, else of the raw file, else the scan's first; maps: scan_id, filename, seq, ..."""
    own = maps.select("scan_id", "filename", F.struct("mapping_scale", "mapping_shift").alias("own"))
    rest = maps.groupBy("scan_id").agg(F.max(F.when(F.col("filename") == "raw", F.struct("mapping_scale", "mapping_shift"))).alias("raw"), F.min_by(F.struct("mapping_scale", "mapping_shift"), "seq").alias("first"))
    joined = edits.join(own, ["scan_id", "filename"], "left").join(rest, "scan_id", "left")
    return joined.withColumn("m", F.coalesce("own", "raw", "first")).select("scan_id", "filename", "m.mapping_scale", "m.mapping_shift")


def apply_map_changes(maps: DataFrame, changes: DataFrame) -> DataFrame:
    """The intensity maps of all scans after a log of changes, each scan's folded in order of seq.

    maps: scan_id, seq, filename, mapping_scale, mapping_shift; changes: scan_id, seq, op, filename, other, s, o. Operations:
    record: the last map of another file (else the first map), composed with v' = v s + o, becomes the file's, at the end; for the
    raw file, `other` being its name, the raw map (the first without "_edit_" in its name, else the first) composed becomes the only one.
    remove: the file's map goes. drop: maps whose filename contains `filename` go. rename: `filename` in names becomes `other`.
    Scans without maps stay without; empty names change nothing. Returns maps, seq counting from 1.
    """
    entry = F.struct("filename", F.col("mapping_scale").cast("double").alias("scale"), F.col("mapping_shift").cast("double").alias("shift"))
    have = maps.groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", entry.alias("e")))), lambda x: x["e"]).alias("maps"))
    step = F.struct("seq", "op", F.coalesce("filename", F.lit("")).alias("name"), F.coalesce("other", F.lit("")).alias("other"), F.coalesce(F.col("s").cast("double"), F.lit(1.0)).alias("s"), F.coalesce(F.col("o").cast("double"), F.lit(0.0)).alias("o"))
    log = changes.groupBy("scan_id").agg(F.array_sort(F.collect_list(step)).alias("log"))

    def fold(now: Column, c: Column) -> Column:
        name, same = c["name"], lambda e: e["filename"] == c["name"]
        others = F.filter(now, lambda e: ~same(e))
        parent = F.when(F.size(others) > 0, F.element_at(others, -1)).otherwise(F.element_at(now, 1))
        raws = F.filter(now, lambda e: F.coalesce(~e["filename"].contains("_edit_"), F.lit(True)))
        raw = F.when(F.size(raws) > 0, F.element_at(raws, 1)).otherwise(F.element_at(now, 1))
        scale = lambda p: F.when(c["s"] == 0, p["scale"]).otherwise(p["scale"] / c["s"])
        composed = lambda p: F.array(F.struct(name.alias("filename"), scale(p).alias("scale"), F.when(c["s"] == 0, p["shift"]).otherwise(p["shift"] - c["o"] * scale(p)).alias("shift")))
        renamed = F.transform(now, lambda e: F.struct(F.replace(e["filename"], name, c["other"]).alias("filename"), e["scale"].alias("scale"), e["shift"].alias("shift")))
        return (
            F.when((F.size(now) == 0) | (name == ""), now)
            .when((c["op"] == "record") & (c["other"] == name), composed(raw)).when(c["op"] == "record", F.concat(others, composed(parent)))
            .when(c["op"] == "remove", others).when(c["op"] == "drop", F.filter(now, lambda e: ~F.coalesce(e["filename"].contains(name), F.lit(False))))
            .when(c["op"] == "rename", renamed).otherwise(now)
        )

    done = have.join(log, "scan_id", "left").select("scan_id", F.when(F.col("log").isNull(), F.col("maps")).otherwise(F.aggregate("log", F.col("maps"), fold)).alias("maps"))
    return done.select("scan_id", F.posexplode("maps").alias("seq", "m")).select("scan_id", (F.col("seq") + 1).alias("seq"), "m.filename", F.col("m.scale").alias("mapping_scale"), F.col("m.shift").alias("mapping_shift"))


def combine_channels(voxels: DataFrame, mode: str, dtype: str = "uint8", channel: int = 0) -> DataFrame:
    """One channel from several (voxels has channel): first, channel, mean, max, luma, sum or multiply."""
    top = RANGES[dtype][1]
    at = lambda k: F.max(F.when(F.col("channel") == k, F.col("v")))
    if mode in ("sum", "multiply") and RANGES[dtype][0] < 0:
        raise ValueError("sum and multiply take unsigned types only")
    if mode == "first":
        out = F.min_by("v", "channel")
    elif mode == "channel":
        out = at(channel)
    elif mode == "luma":
        out = at(0) * 0.299 + at(1) * 0.587 + at(2) * 0.114
    elif mode == "multiply":
        values = F.transform(F.array_sort(F.collect_list(F.struct("channel", F.col("v").cast("double").alias("v")))), lambda s: s["v"])
        out = F.aggregate(values, F.lit(float(top)), lambda acc, v: acc * v / top)
    else:
        out = {"mean": F.avg("v"), "max": F.max("v"), "sum": F.sum("v")}[mode]
    return voxels.groupBy(*CELL).agg(saturating_cast(out, dtype).alias("v"))


def split_channels(scans: DataFrame, channels: DataFrame) -> DataFrame:
    """Linked subjects <name>_ch<k>, one per channel; channels: scan_id, channel."""
    return scans.join(channels, "scan_id").select("scan_id", F.concat(F.col("name"), F.lit("_ch"), F.col("channel").cast("string")).alias("name"), F.col("scan_id").alias("linked_to"), "channel")


def mask_out(voxels: DataFrame, masks: DataFrame, labels: list[int] | None = None, invert: bool = False) -> DataFrame:
    """Zeroes voxels under the labels (all above 0 by default), or all the others."""
    hit = masks.where(F.col("label").isin(labels) if labels else F.col("label") > 0).select(*CELL, F.lit(True).alias("__hit")).distinct()
    inside = F.coalesce(F.col("__hit"), F.lit(False))
    return voxels.join(hit, list(CELL), "left").withColumn("v", F.when(~inside if invert else inside, F.lit(0)).otherwise(F.col("v"))).drop("__hit")


def volume_to_uint8(voxels: DataFrame) -> DataFrame:
    """Min-max to 0-255, truncated; scans within 0-255 whole numbers pass through."""
    ends = voxels.groupBy("scan_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.bool_and((F.col("v") >= 0) & (F.col("v") <= 255) & (F.col("v") == F.floor("v"))).alias("fits"))
    scaled = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255).cast("int")
    new = F.when(F.col("fits"), F.col("v").cast("int")).when(F.col("hi") > F.col("lo"), scaled).otherwise(F.lit(0))
    return voxels.join(ends, "scan_id").withColumn("v", new).drop("lo", "hi", "fits")


def around(voxels: DataFrame, offsets: list[tuple[int, int, int]], value: str = "v") -> DataFrame:
    """(cell, w): every voxel's value sent to the cells at the offsets; weights may be a fourth entry."""
    shifts = F.array(*[F.struct(F.lit(o[0]).alias("dz"), F.lit(o[1]).alias("dy"), F.lit(o[2]).alias("dx"), F.lit(float(o[3]) if len(o) > 3 else 1.0).alias("w")) for o in offsets])
    sent = voxels.select(*CELL, F.col(value).alias("__v"), F.explode(shifts).alias("o"))
    return sent.select("scan_id", (F.col("z") + F.col("o.dz")).alias("z"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col("__v").alias("nv"), F.col("o.w").alias("w"))


FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def fill_speckle_zeros(voxels: DataFrame, low: float = 40.0) -> DataFrame:
    """Zero voxels whose six face neighbours average `low` or more take that mean; cells outside count 0, the divisor stays 6."""
    means = around(voxels, FACES).groupBy(*CELL).agg((F.sum("nv") / 6).alias("mean"))
    new = F.when((F.col("v") == 0) & (F.col("mean") >= low), F.rint("mean").cast("int")).otherwise(F.col("v"))
    return voxels.join(means, list(CELL), "left").withColumn("v", new).drop("mean")


def extract_patch(voxels: DataFrame, centres: DataFrame, size: int) -> DataFrame:
    """A cube of the given size around each centre (scan_id, cz, cy, cx), zero-padded; patch axes from 0."""
    half = size // 2
    grid = [F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(a) for a in ("pz", "py", "px")]
    cells = reduce(lambda df, g: df.select("*", g), grid, centres)
    keyed = cells.select("*", *[(F.col(f"c{a}") - half + F.col(f"p{a}")).alias(a) for a in "zyx"])
    return keyed.join(voxels, list(CELL), "left").select("scan_id", "cz", "cy", "cx", "pz", "py", "px", F.coalesce("v", F.lit(0)).alias("v"))
