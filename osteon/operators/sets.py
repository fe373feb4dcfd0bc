"""Unions of labels, grids and meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ("scan_id", "z", "y", "x")


def union_labels(masks: DataFrame, labels: list[int]) -> DataFrame:
    return masks.where(F.col("label").isin(labels)).select(*CELL).distinct()


def mask_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*CELL).union(b.select(*CELL)).distinct()


def mask_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*CELL).intersect(b.select(*CELL))


def mask_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*CELL).distinct().exceptAll(b.select(*CELL).distinct())


def unique_faces(faces: DataFrame) -> DataFrame:
    """One face, the lowest id, for each set of corners."""
    kept = faces.groupBy("mesh_id", F.array_sort(F.array("a", "b", "c")).alias("k")).agg(F.min(F.struct("face_id", "a", "b", "c")).alias("f"))
    return kept.select("mesh_id", "f.*")


def nondegenerate_faces(faces: DataFrame) -> DataFrame:
    return faces.where("a <> b AND b <> c AND a <> c")


def referenced_vertices(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    used = faces.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vertex_id")).distinct()
    return vertices.join(used, ["mesh_id", "vertex_id"], "left_semi")


def union_canvas(boxes: DataFrame, margin: int, most: int = 40_000_000) -> DataFrame:
    """The canvas that holds all boxes and a margin, and the first stride of 1 to 4 at which it has at most `most` voxels (4 if none)."""
    ends = boxes.agg(*[F.greatest(F.min(f"lo_{a}") - margin, F.lit(0)).alias(f"lo_{a}") for a in "zyx"], *[(F.max(f"hi_{a}") + margin).alias(f"hi_{a}") for a in "zyx"])
    cells = lambda s: F.ceil((F.col("hi_z") - F.col("lo_z") + 1) / s) * F.ceil((F.col("hi_y") - F.col("lo_y") + 1) / s) * F.ceil((F.col("hi_x") - F.col("lo_x") + 1) / s)
    return ends.withColumn("stride", F.when(cells(1) <= most, 1).when(cells(2) <= most, 2).when(cells(3) <= most, 3).otherwise(4))


def paste_on_canvas(base: DataFrame, patch: DataFrame, shift: tuple[int, int, int], shape: tuple[int, int, int]) -> DataFrame:
    """patch moved by shift (z, y, x) and cut to the shape covers base."""
    moved = patch.select("scan_id", *[(F.col(a) + s).alias(a) for a, s in zip("zyx", shift, strict=True)], "v")
    moved = moved.where(" AND ".join(f"{a} BETWEEN 0 AND {n - 1}" for a, n in zip("zyx", shape, strict=True)))
    return moved.union(base.join(moved, list(CELL), "left_anti").select(*CELL, "v"))
