"""Selecting subjects and edits: filters, eligibility, edit chains, link groups and thresholds.

scans: scan_id, name, faulty, flag, is_mesh, voxelized, linked_to, voxel_size, threshold, ...; edits: scan_id,
edit_number, kind, has_mask. Missing flags count as false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def truth(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def flag_filter(scans: DataFrame, mode: str = "off", single: bool = False) -> DataFrame:
    """All, unflagged or flagged subjects: off, exclude, only. A single-subject scope keeps all."""
    if single or mode == "off":
        return scans
    return scans.where(truth("flag") if mode == "only" else ~truth("flag"))


def drop_faulty(scans: DataFrame) -> DataFrame:
    return scans.where(~truth("faulty"))


def is_preserved_mesh() -> Column:
    return F.col("is_mesh").eqNullSafe(True) & F.col("voxelized").eqNullSafe(False)


def split_voxel_mesh(scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = scans.withColumn("is_preserved_mesh", is_preserved_mesh())
    return marked.where("NOT is_preserved_mesh"), marked.where("is_preserved_mesh")


def is_child() -> Column:
    return F.col("linked_to").isNotNull() & (F.col("linked_to") != F.col("scan_id"))


def drop_linked_children(scans: DataFrame) -> DataFrame:
    return scans.where(~is_child())


def eligible_batch(scans: DataFrame, edits: DataFrame, kind: str, needs: str | None = None, flags: str = "off") -> DataFrame:
    """scan_id, keep and the first skip_reason of every subject for a tool that writes edits of `kind`."""
    has = edits.groupBy("scan_id").agg(F.bool_or(F.col("kind") == kind).alias("has"), F.bool_or(F.col("kind") == (needs or "")).alias("needed"))
    flagged = truth("flag") if flags == "exclude" else ~truth("flag") if flags == "only" else F.lit(False)
    reason = (
        F.when(truth("faulty"), "faulty").when(is_preserved_mesh(), "mesh").when(is_child(), "linked child").when(flagged, "flag")
        .when(truth("has"), "already has edit").when(F.lit(needs is not None) & ~truth("needed"), "missing edit")
    )
    return scans.join(has, "scan_id", "left").select("scan_id", reason.isNull().alias("keep"), reason.alias("skip_reason"))


def eligibility_summary(batch: DataFrame) -> DataFrame:
    return batch.groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def training_eligibility(scans: DataFrame, images: DataFrame, masks: DataFrame, rtol: float = 1e-3) -> DataFrame:
    """scan_id, issues and eligible; images and masks: scan_id, dims, zoom of the newest of each."""
    i = images.select("scan_id", F.col("dims").alias("i_dims"), F.col("zoom").alias("i_zoom"))
    m = masks.select("scan_id", F.col("dims").alias("m_dims"), F.col("zoom").alias("m_zoom"))
    joined = scans.join(i, "scan_id", "left").join(m, "scan_id", "left")
    far = F.abs(F.col("i_zoom") - F.col("m_zoom")) > rtol * F.abs(F.col("m_zoom"))
    issues = F.array_compact(F.array(
        F.when(F.col("name").isNull(), "metadata_missing"), F.when(is_preserved_mesh(), "mesh_only"), F.when(truth("faulty"), "faulty"),
        F.when(F.col("i_dims").isNull(), "image_missing"), F.when(F.col("m_dims").isNull(), "mask_missing"),
        F.when(F.col("i_dims") != F.col("m_dims"), "shape_mismatch"), F.when(far, "geometry_mismatch"),
    ))
    return joined.select("scan_id", issues.alias("issues"), (F.size(issues) == 0).alias("eligible"))


def needs_backfill(scans: DataFrame, edits: DataFrame, stored: DataFrame) -> DataFrame:
    """Registered voxel subjects with a threshold and an elastic edit, but no stored correlation."""
    fit = scans.where(F.col("elastic_to").isNotNull() & ~is_preserved_mesh() & F.col("threshold").isNotNull())
    elastic = edits.where("kind = 'elastic'").select("scan_id")
    return fit.join(elastic, "scan_id", "left_semi").join(stored.select("scan_id"), "scan_id", "left_anti")


def clear_orphan_settings(scans: DataFrame, edits: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Nulls each settings column whose kind of edit the subject no longer has; columns: name to kind."""
    kinds = edits.groupBy("scan_id").agg(F.collect_set("kind").alias("__kinds"))
    has = lambda kind: F.coalesce(F.array_contains("__kinds", kind), F.lit(False))
    return scans.join(kinds, "scan_id", "left").withColumns({c: F.when(has(k), F.col(c)) for c, k in columns.items()}).drop("__kinds")


def link_scans(scans: DataFrame, links: DataFrame) -> DataFrame:
    """Writes linked_to on every member, the main included; groups whose members differ in dims are left alone.

    links: main, child; a main is a member of its own group.
    """
    members = links.select("main", F.col("child").alias("scan_id")).union(links.select("main", F.col("main").alias("scan_id"))).distinct()
    fit = members.join(scans.select("scan_id", "dims"), "scan_id").groupBy("main").agg(F.count_distinct("dims").alias("n")).where("n = 1").select("main")
    chosen = members.join(fit, "main").groupBy("scan_id").agg(F.min("main").alias("__main"))
    return scans.join(chosen, "scan_id", "left").withColumn("linked_to", F.coalesce("__main", "linked_to")).drop("__main")


def set_flags(scans: DataFrame, ids: DataFrame, column: str = "flag") -> DataFrame:
    """Toggles flag or faulty of the given subjects."""
    return scans.join(ids.select("scan_id").distinct().withColumn("__hit", F.lit(True)), "scan_id", "left").withColumn(column, F.when(truth("__hit"), ~truth(column)).otherwise(F.col(column))).drop("__hit")


def latest_edit_first_gap(edits: DataFrame) -> DataFrame:
    """The last number of each subject's unbroken run from 0; none without edit 0."""
    numbers = edits.select("scan_id", "edit_number").distinct()
    rank = F.row_number().over(W.partitionBy("scan_id").orderBy("edit_number")) - 1
    return numbers.withColumn("r", rank).where("edit_number = r").groupBy("scan_id").agg(F.max("edit_number").alias("latest"))


def next_edit_number(scans: DataFrame, edits: DataFrame) -> DataFrame:
    return scans.select("scan_id").join(latest_edit_first_gap(edits), "scan_id", "left").select("scan_id", (F.coalesce("latest", F.lit(-1)) + 1).alias("next"))


def latest_edit_max(edits: DataFrame, exclude_elastic: bool = False) -> DataFrame:
    kept = edits.where("kind <> 'elastic'") if exclude_elastic else edits
    return kept.groupBy("scan_id").agg(F.max("edit_number").alias("latest"), F.max_by("kind", "edit_number").alias("kind"))


def latest_with_mask(edits: DataFrame) -> DataFrame:
    """The newest non-elastic edit that has a mask; without any, the newest image, with mask false."""
    kept = edits.where("kind <> 'elastic'")
    best = kept.groupBy("scan_id").agg(F.max(F.struct("has_mask", "edit_number", "kind")).alias("b"))
    return best.select("scan_id", "b.edit_number", "b.kind", "b.has_mask")


def current_thresholds(history: DataFrame) -> DataFrame:
    """Last write per (scan_id, edit) wins, rounded half-even; a deletion (null) restores the write before it.

    history: scan_id, edit, seq, threshold; a row whose threshold is null deletes the last write.
    """
    order = W.partitionBy("scan_id", "edit").orderBy("seq")
    open_writes = F.sum(F.when(F.col("threshold").isNull(), -1).otherwise(1)).over(order)
    kept = history.withColumn("depth", open_writes)
    back = F.min("depth").over(order.rowsBetween(1, W.unboundedFollowing))
    alive = kept.withColumn("later", back).where(F.col("threshold").isNotNull() & (F.col("later").isNull() | (F.col("later") >= F.col("depth"))))
    return alive.groupBy("scan_id", "edit").agg(F.max_by(F.rint("threshold").cast("int"), "seq").alias("threshold"))


def rename_history(history: DataFrame, names: DataFrame) -> DataFrame:
    """Rewrites edit names; names: scan_id, edit, new_edit."""
    return history.join(names, ["scan_id", "edit"], "left").withColumn("edit", F.coalesce("new_edit", "edit")).drop("new_edit")


def threshold_for_edit(edits: DataFrame, thresholds: DataFrame, scans: DataFrame) -> DataFrame:
    """The stored threshold of each edit, else the subject's."""
    own = thresholds.select("scan_id", F.col("edit").alias("edit_number"), F.col("threshold").alias("own"))
    joined = edits.join(own, ["scan_id", "edit_number"], "left").join(scans.select("scan_id", "threshold"), "scan_id", "left")
    return joined.select("scan_id", "edit_number", F.coalesce("own", "threshold").alias("threshold"))


def keep_newest_per_group(results: DataFrame, group: list[str], order: str, n: int = 3) -> DataFrame:
    return results.withColumn("__r", F.row_number().over(W.partitionBy(*group).orderBy(F.col(order).desc()))).where(F.col("__r") <= n).drop("__r")


def retained_edits(edits: DataFrame) -> DataFrame:
    """Original edits (number 0), the latest elastic edit and the one before it."""
    last = F.max(F.when(F.col("kind") == "elastic", F.col("edit_number"))).over(W.partitionBy("scan_id"))
    n = F.col("edit_number")
    return edits.withColumn("__last", last).where((n == 0) | (n == F.col("__last")) | (n == F.col("__last") - 1)).drop("__last")


def link_groups(scans: DataFrame) -> DataFrame:
    """main and its sorted children; members is null when fewer than two belong to it."""
    linked = scans.where("linked_to IS NOT NULL").select(F.col("linked_to").alias("main"), "scan_id")
    every = F.array_sort(F.collect_set("scan_id"))
    grouped = linked.groupBy("main").agg(every.alias("all"))
    members = F.concat(F.array("main"), F.filter("all", lambda s: s != F.col("main")))
    return grouped.select("main", F.when(F.size(members) >= 2, members).alias("members"))


def same_shape_siblings(scans: DataFrame) -> DataFrame:
    """Pairs of subjects of one group with equal dims."""
    a = scans.where("linked_to IS NOT NULL").select("linked_to", "dim", "scan_id")
    return a.join(a.withColumnRenamed("scan_id", "sibling"), ["linked_to", "dim"]).where("scan_id <> sibling").select("scan_id", "sibling")


def discover_elastic(scans: DataFrame, edits: DataFrame, reference: str) -> DataFrame:
    """Subjects registered to the reference (or to an unnamed one) with their newest elastic edit, meshes first on ties."""
    fit = scans.where(F.col("elastic_to").isNull() | (F.col("elastic_to") == reference)).select("scan_id", is_preserved_mesh().alias("mesh"))
    newest = edits.where("kind = 'elastic'").join(fit, "scan_id")
    order = W.partitionBy("scan_id").orderBy(F.desc("edit_number"), F.desc("mesh"))
    return newest.withColumn("__r", F.row_number().over(order)).where("__r = 1").select("scan_id", "edit_number", "mesh")


def native_voxel_size(scans: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """Previous size, else the mean of the acquisition's sizes, else the current one."""
    sizes = acquisitions.groupBy("scan_id").agg(F.avg("size").alias("acquired"))
    return scans.join(sizes, "scan_id", "left").select("scan_id", F.coalesce("alignment_previous_voxel_size", "acquired", "voxel_size").alias("voxel_size"))


def voxel_size_for_edit(scans: DataFrame, edits: DataFrame, previous: str) -> DataFrame:
    """Before a subject's first aligned edit its previous voxel size holds, from there on the current one."""
    first = edits.where("kind = 'aligned'").groupBy("scan_id").agg(F.min("edit_number").alias("first"))
    joined = edits.select("scan_id", "edit_number").join(scans.select("scan_id", "voxel_size", F.col(previous).alias("previous")), "scan_id").join(first, "scan_id", "left")
    return joined.select("scan_id", "edit_number", F.when(F.col("edit_number") < F.col("first"), F.coalesce("previous", "voxel_size")).otherwise(F.col("voxel_size")).alias("voxel_size"))


def classify_spacing(spacings: DataFrame) -> DataFrame:
    """How to make a volume isotropic: spacings scan_id, sx, sy, sz, nx, ny, nz.

    isotropic up to a ratio of 1.001; registration if one axis is over 1.1 times thicker and the others within 1 %;
    else resample. The target is the finest spacing.
    """
    s = F.array_sort(F.array("sx", "sy", "sz"))
    low, mid, high = s[0], s[1], s[2]
    kind = F.when(high <= low * 1.001, "isotropic").when((high > mid * 1.1) & (mid <= low * 1.01), "registration").otherwise("resample")
    shape = [F.greatest(F.rint(F.col(f"n{a}") * F.col(f"s{a}") / low), F.lit(1.0)).cast("int").alias(f"out_{a}") for a in "xyz"]
    return spacings.select("scan_id", kind.alias("kind"), low.alias("target"), *shape)


def collect_examples(scans: DataFrame, labels: DataFrame, known: DataFrame) -> DataFrame:
    """(scan_id, label) pairs to train on; dropped when a subject's labels are known and the label isn't among them.

    Scans with known labels meet their own by key. The others take every label: they are dealt into as many parts as a shuffle has,
    each of which gets the distinct labels once.
    """
    wanted, told = labels.select("label").where("label IS NOT NULL").distinct(), known.select("scan_id", "label").distinct()
    of_known = told.join(scans.select("scan_id"), "scan_id").join(wanted, "label", "left_semi").select("scan_id", "label")
    parts = int(scans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = scans.select("scan_id").join(told, "scan_id", "left_anti").withColumn("part", F.pmod(F.xxhash64("scan_id"), F.lit(parts)).cast("int"))
    every = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return of_known.union(rest.join(every, "part").select("scan_id", "label"))


def invalid_subjects(selection: DataFrame, scans: DataFrame, known: DataFrame, wanted: list[int]) -> DataFrame:
    """Selected subjects that are unknown, faulty or lack wanted labels, with what is wrong."""
    has = known.groupBy("scan_id").agg(F.collect_set("label").alias("has"))
    joined = selection.select("scan_id").join(scans.select("scan_id", "faulty", F.lit(True).alias("exists")), "scan_id", "left").join(has, "scan_id", "left")
    missing = F.array_except(F.array(*[F.lit(w) for w in wanted]), F.coalesce("has", F.array().cast("array<int>")))
    issue = F.when(F.col("exists").isNull(), "unknown").when(truth("faulty"), "faulty").when(F.size(missing) > 0, "labels missing")
    return joined.select("scan_id", issue.alias("issue"), F.array_sort(missing).alias("missing")).where("issue IS NOT NULL")


def compare_before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Dice and IoU of two runs, joined on subject and label."""
    a = after.select("scan_id", "label", F.col("dice").alias("dice_after"), F.col("iou").alias("iou_after"))
    joined = before.join(a, ["scan_id", "label"], "left")
    return joined.select("scan_id", "label", "dice", "dice_after", (F.col("dice_after") - F.col("dice")).alias("gain"), "iou", "iou_after")
