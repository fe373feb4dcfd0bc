"""Planning training sets and ranking runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Leading hex digits of a draw that name its range.
RANGE_DIGITS = 3


def draw(name: Column, seed: int) -> Column:
    """A place in a seeded order that depends on the name alone."""
    return F.md5(F.concat_ws(":", F.lit(seed), name.cast("string")).cast("binary"))


def ranked(names: DataFrame, seed: int) -> DataFrame:
    """names with d, their draw, and r, the place from 1 by d and name.

    The draw's first digits cut the order into 4096 ranges; a place is that in its range after the counts of those before.
    """
    cut = names.withColumn("d", draw(F.col("name"), seed)).withColumn("__range", F.substring("d", 1, RANGE_DIGITS))
    sizes = cut.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(W.orderBy("__range")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__range").orderBy("d", "name"))
    return cut.withColumn("__inside", inside).join(F.broadcast(before), "__range").withColumn("r", F.col("__before") + F.col("__inside")).drop("__range", "__inside", "__before")


def subject_split(subjects: DataFrame, val: float, test: float, seed: int) -> DataFrame:
    """name and split. Sizes are rounded half-even, validation and test have at least one; fails when nothing is left to train on."""
    names = subjects.select("name").distinct()
    n = names.count()
    sizes = [max(1, round(n * val / 100)), max(1, round(n * test / 100))]
    if n - sum(sizes) < 1:
        raise ValueError("no subject is left for training")
    return ranked(names, seed).select("name", F.when(F.col("r") <= sizes[0], "val").when(F.col("r") <= sum(sizes), "test").otherwise("train").alias("split"))


def k_fold(subjects: DataFrame, k: int, seed: int, holdout: DataFrame | None = None) -> DataFrame:
    """name, fold and role in it (val or train): round-robin over the shuffled pool without the holdout."""
    pool = subjects.select("name").distinct()
    pool = pool.join(holdout.select("name"), "name", "left_anti") if holdout is not None else pool
    placed = ranked(pool, seed).withColumn("own", (F.col("r") - 1) % k)
    return placed.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select("name", "fold", F.when(F.col("own") == F.col("fold"), "val").otherwise("train").alias("role"))


def leakage_check(assignments: DataFrame) -> DataFrame:
    """Subjects that are in more than one split."""
    return assignments.groupBy("name").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def best_checkpoint(epochs: DataFrame) -> DataFrame:
    """The epoch that an ordered scan of each run settles on; epochs: run, epoch, loss, dice.

    A loss lower by more than max(1e-4, 0.2 % of the best) wins; within that margin the higher Dice wins; a higher loss never does.
    """
    rows = F.array_sort(F.collect_list(F.struct("epoch", F.col("loss").cast("double").alias("loss"), F.col("dice").cast("double").alias("dice"))))

    def pick(best, e):
        margin = F.greatest(F.lit(1e-4), 0.002 * F.abs(best["loss"]))
        clear = e["loss"] < best["loss"] - margin
        tie = (F.abs(e["loss"] - best["loss"]) <= margin) & (e["dice"] > best["dice"])
        return F.when(best["loss"].isNull() | clear | tie, e).otherwise(best)

    per = epochs.where("loss IS NOT NULL").groupBy("run").agg(rows.alias("r"))
    return per.select("run", F.aggregate(F.slice("r", 2, F.size("r")), F.element_at("r", 1), pick).alias("b")).select("run", "b.epoch", "b.loss", "b.dice")


def rank_folds(folds: DataFrame) -> DataFrame:
    """rank by loss, nulls last, then by falling Dice, then by fold."""
    return folds.withColumn("rank", F.row_number().over(W.partitionBy("run").orderBy(F.asc_nulls_last("loss"), F.desc_nulls_last("dice"), "fold")))


def variance_select(fields: DataFrame, share: float) -> DataFrame:
    """Landmarks by falling summed variance of deformation, up to the first that reaches the share of the total, inclusive.

    fields: scan_id, idx, ux, uy, uz; the reference's zero row counts as a subject.
    """
    v = fields.groupBy("idx").agg((F.var_pop("ux") + F.var_pop("uy") + F.var_pop("uz")).alias("variance"))
    run = W.orderBy(F.desc("variance"), "idx").rowsBetween(W.unboundedPreceding, -1)  # one row per landmark
    before = F.coalesce(F.sum("variance").over(run), F.lit(0.0))
    total = F.sum("variance").over(W.partitionBy())
    return v.withColumn("before", before).withColumn("total", total).where(F.col("before") < share * F.col("total")).select("idx", "variance")


def clip_window(prompts: DataFrame, n: int) -> DataFrame:
    """n slices from the prompt forward, or backward to it when fewer are left; prompts: scan_id, prompt, slices."""
    start = F.when(F.col("prompt") + n <= F.col("slices"), F.col("prompt")).otherwise(F.greatest(F.col("prompt") - n + 1, F.lit(0)))
    last = F.least(start + n - 1, F.col("slices") - 1)
    return prompts.select("scan_id", "prompt", F.explode(F.sequence(start, last)).alias("slice"))


def settings_key(settings: DataFrame) -> DataFrame:
    """First 12 hex digits of the SHA-1 of the settings as canonical JSON; settings: run and a map of strings."""
    body = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("settings"))), {"ignoreNullFields": "false"})
    return settings.select("run", F.substring(F.sha1(body.cast("binary")), 1, 12).alias("key"))


def settings_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Settings that differ between two stamps of a run: name, before, after."""
    one, two = (d.select("run", F.explode("settings").alias("name", v)) for d, v in ((a, "before"), (b, "after")))
    return one.join(two, ["run", "name"], "full_outer").where("NOT before <=> after")
