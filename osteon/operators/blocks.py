"""Blocks of voxels with a halo: one shuffle, then NumPy on small dense arrays.

A volume is cut into cubes of `side` cells. Every voxel goes to its own block and to those whose halo it lies in, at most eight; blocks
are rows that hold their cells as arrays, so memory is bounded by (side + 2 halo)^3 cells whatever a volume's size. Cells beyond a
volume are filled by its mirror image or its edge, or are marked as outside. A block's work sees whole arrays and returns
what belongs to the block's own cells; no voxel is sent more than once for each block that needs it.

voxels: scan_id, z, y, x (from 0) and the columns to work on; cells that are missing from a box count as `fill`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE, ROWS = 32, 1 << 16
#: Cells of blocks that are worked on at once.
STACK = 1 << 16
CELL = ("scan_id", "z", "y", "x")


def extents(voxels: DataFrame) -> DataFrame:
    """scan_id, nz, ny, nx."""
    return voxels.groupBy("scan_id").agg(*[(F.max(a) + 1).cast("int").alias(f"n{a}") for a in "zyx"])


def block_table(voxels: DataFrame, halo: int, columns: tuple[str, ...] = ("v",), side: int = SIDE) -> DataFrame:
    """scan_id, bz, by, bx, nz, ny, nx (of the volume) and cells (at, columns): the block's cells and its halo's, inside the volume.

    voxels may bring nz, ny and nx along.
    """
    sizes = ["nz", "ny", "nx"]
    out = voxels.select(*CELL, *columns, *sizes) if set(sizes) <= set(voxels.columns) else voxels.select(*CELL, *columns).join(extents(voxels), "scan_id")
    for a in "zyx":
        first = F.greatest(F.floor((F.col(a) - halo) / side), F.lit(0))
        last = F.least(F.floor((F.col(a) + halo) / side), F.floor((F.col(f"n{a}") - 1) / side))
        out = out.withColumn(f"b{a}", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    low = {a: F.greatest(F.col(f"b{a}") * side - halo, F.lit(0)) for a in "zyx"}
    length = {a: F.least((F.col(f"b{a}") + 1) * side + halo, F.col(f"n{a}")) - low[a] for a in "zyx"}
    at = ((F.col("z") - low["z"]) * length["y"] + F.col("y") - low["y"]) * length["x"] + F.col("x") - low["x"]
    key = ["scan_id", "bz", "by", "bx", "nz", "ny", "nx"]
    return out.groupBy(*key).agg(F.collect_list(F.struct(at.cast("int").alias("at"), *[F.col(c).cast("double").alias(c) for c in columns])).alias("cells"))


def stacked(batch: pa.RecordBatch, halo: int, columns: tuple[str, ...], side: int, stack: int = STACK) -> Iterator[tuple]:
    """The blocks of a batch of block_table, those of one shape together, about `stack` cells at a time: their rows in the batch, first cells (row, axis), the
    cells that the halo lacks before and after the block on each axis, the shape (block, z, y, x), and for each cell its place in that (flat) and the columns."""
    n, b = (np.stack([np.asarray(batch.column(f"{k}{a}")).astype(np.int64) for a in "zyx"], axis=1) for k in "nb")
    low, high, own = np.maximum(b * side - halo, 0), np.minimum((b + 1) * side + halo, n), np.minimum((b + 1) * side, n)
    kinds, kind = np.unique(np.hstack([high - low, low - (b * side - halo), own + halo - high]), axis=0, return_inverse=True)
    lists = batch.column("cells")
    ends, flat = np.asarray(lists.offsets).astype(np.int64), lists.values
    at, given = np.asarray(flat.field("at")), [np.asarray(flat.field(c).cast(pa.float64())) for c in columns]
    for k, (*shape, z0, y0, x0, z1, y1, x1) in enumerate(kinds.tolist()):
        size = int(np.prod(shape))
        every = np.flatnonzero(kind.reshape(-1) == k)
        step = max(1, stack // int(np.prod([m + i + j for m, i, j in zip(shape, (z0, y0, x0), (z1, y1, x1), strict=True)])))
        for begin in range(0, len(every), step):
            rows = every[begin : begin + step]
            count = ends[rows + 1] - ends[rows]
            before = np.cumsum(count) - count
            cell = np.arange(count.sum()) + np.repeat(ends[rows] - before, count)
            yield rows, b[rows] * side, ((z0, z1), (y0, y1), (x0, x1)), (len(rows), *shape), np.repeat(np.arange(len(rows)) * size, count) + at[cell], [g[cell] for g in given]


def over_blocks(
    voxels: DataFrame, halo: int, work: Callable, out: list[str], columns: tuple[str, ...] = ("v",), pad: str | None = None, fill: float = 0.0, every: bool = False, side: int = SIDE, rows: Callable | None = None, many: bool = False,
) -> DataFrame:
    """scan_id, z, y, x and the `out` columns (doubles) of what `work` returns for each block.

    work(arrays, inside): padded arrays of the columns and where cells of the volume exist, both longer than the block by 2 halo on each axis;
    returns a list of arrays of the block's own shape. pad: np.pad's mode beyond the volume (symmetric, edge), or None for cells that
    don't exist. every: all cells of the box come out, not only those that came in. rows(results): which cells to keep.
    many: work takes and returns arrays of several blocks of one shape, the blocks along a first axis; small volumes then don't cost a call each.
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, total = [], 0
            for part, origin, edges, shape, index, given in stacked(batch, halo, columns, side):
                there = np.zeros(shape, bool)
                there.reshape(-1)[index] = True
                arrays = []
                for g in given:
                    array = np.full(shape, fill)
                    array.reshape(-1)[index] = g
                    arrays.append(np.pad(array, ((0, 0), *edges), mode=pad) if pad else np.pad(array, ((0, 0), *edges), constant_values=fill))
                inside = np.pad(there, ((0, 0), *edges))
                if many:
                    results = work(arrays, inside)
                else:
                    results = [np.stack(r) for r in zip(*[work([a[i] for a in arrays], inside[i]) for i in range(len(part))], strict=True)]
                core = inside[(..., *(slice(halo, s - halo) for s in inside.shape[1:]))]
                chosen = np.ones(core.shape, bool) if every else core
                if rows is not None:
                    chosen = chosen & rows(results)
                where = np.nonzero(chosen)
                held.append((part[where[0]], *[(w + origin[where[0], k]).astype(np.int32) for k, w in enumerate(where[1:])], *[np.asarray(r, np.float64)[where] for r in results]))
                total += len(where[0])
                if total >= ROWS:
                    yield _rows_out(batch, held, out)
                    held, total = [], 0
            if total:
                yield _rows_out(batch, held, out)

    table = block_table(voxels, halo, columns, side)
    schema = T.StructType([table.schema["scan_id"], *[T.StructField(a, T.IntegerType()) for a in "zyx"], *[T.StructField(c, T.DoubleType()) for c in out]])
    return table.mapInArrow(solve, schema)


def _rows_out(batch: pa.RecordBatch, held: list[tuple], out: list[str]) -> pa.RecordBatch:
    joined = [np.concatenate(c) for c in zip(*held, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("scan_id").take(pa.array(joined[0])), *[pa.array(c) for c in joined[1:]]], names=[*CELL, *out])


def weighted(array: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Sums along an axis that is len(weights) - 1 cells longer than the result."""
    n = array.shape[axis] - len(weights) + 1
    return sum(w * np.take(array, range(k, k + n), axis) for k, w in enumerate(weights))


def shifted(array: np.ndarray, offset: tuple[int, int, int], halo: int) -> np.ndarray:
    """The array's core, moved; of several blocks that of each."""
    return array[(..., *(slice(halo + o, s - halo + o) for o, s in zip(offset, array.shape[-3:], strict=True)))]


def envelope(f: np.ndarray) -> np.ndarray:
    """min over j of f[:, j] + (i - j)^2 for every i and line: the lower envelope of parabolas, built over all lines at once.

    f: lines x cells, infinite where there is no parabola.
    """
    lines, n = f.shape
    if not n:
        return f.copy()
    every = np.arange(lines)
    place = np.zeros((lines, n + 1), np.int64)  # parabolas of the envelope, and from where each is the lowest
    start = np.full((lines, n + 1), np.inf)
    last = np.full(lines, -1)
    for q in range(n):
        left = every[np.isfinite(f[:, q])]
        begin = np.full(lines, -np.inf)
        while len(left):
            some = left[last[left] >= 0]
            p = place[some, last[some]]
            meet = (f[some, q] + q * q - f[some, p] - p * p) / (2.0 * (q - p))
            under = meet <= start[some, last[some]]
            begin[some] = np.where(under, -np.inf, meet)
            last[some[under]] -= 1
            left = some[under]
        new = every[np.isfinite(f[:, q])]
        last[new] += 1
        place[new, last[new]], start[new, last[new]] = q, begin[new]
    out, at = np.full(f.shape, np.inf), np.zeros(lines, np.int64)
    real = every[last >= 0]
    for q in range(n):
        more = real[at[real] < last[real]]
        while len(more):
            more = more[start[more, at[more] + 1] < q]
            at[more] += 1
            more = more[at[more] < last[more]]
        p = place[real, at[real]]
        out[real, q] = f[real, p] + (q - p) ** 2
    return out


def squared_distances(sites: np.ndarray, first: int = 0) -> np.ndarray:
    """Squared distances, in cells, of all cells of an array to the nearest true one; infinite where there is none. Axes before `first` number arrays of their own."""
    d = np.where(sites, 0.0, np.inf)
    for axis in range(first, d.ndim):
        lines = np.moveaxis(d, axis, -1)
        d = np.moveaxis(envelope(np.ascontiguousarray(lines).reshape(-1, lines.shape[-1])).reshape(lines.shape), -1, axis)
    return d


def distance_transform(voxels: DataFrame, site: str = "site") -> DataFrame:
    """voxels with d2: the squared distance in cells to the scan's nearest cell whose `site` is true; infinite where a scan has none.

    Three passes, each of which gathers the lines of one axis (a row a line) and takes the lower envelope of the parabolas over
    their cells. Lines are the largest thing a task holds of a volume.
    """
    rest = [c for c in voxels.columns if c not in (*CELL, site)]
    carried = [*rest, site]
    out = voxels.withColumn("d2", F.when(F.col(site), F.lit(0.0)).otherwise(F.lit(float("inf"))))
    for a in "xyz":
        others = [c for c in CELL if c != a]
        lines = out.groupBy(*others).agg(F.collect_list(F.struct(a, "d2", *carried)).alias("cells"))
        out = lines.mapInArrow(line_pass(a), lines.schema).select(*others, F.explode("cells").alias("c")).select(*others, f"c.{a}", "c.d2", *[f"c.{c}" for c in carried])
    return out.select(*CELL, *carried, "d2")


def line_pass(axis: str):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("cells")
            ends, flat = np.asarray(lists.offsets), lists.values
            at, d = np.asarray(flat.field(axis)), np.asarray(flat.field("d2"))
            count = np.diff(ends)
            first, size = ends[0], int(at[ends[0] : ends[-1]].max(initial=-1)) + 1
            row = np.repeat(np.arange(batch.num_rows), count)
            new = np.empty(len(d))
            step = max(1, (1 << 22) // max(size, 1))
            for begin in range(0, batch.num_rows, step):
                part = slice(ends[begin], ends[min(begin + step, batch.num_rows)])
                lines = np.full((min(step, batch.num_rows - begin), size), np.inf)
                where = row[part.start - first : part.stop - first] - begin, at[part]
                lines[where] = d[part]
                new[part] = envelope(lines)[where]
            fields = [pa.array(new) if f.name == "d2" else flat.field(f.name) for f in flat.type]
            cells = pa.ListArray.from_arrays(lists.offsets, pa.StructArray.from_arrays(fields, fields=list(flat.type)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names if c != "cells"], cells], names=[c for c in batch.schema.names if c != "cells"] + ["cells"])

    return solve
