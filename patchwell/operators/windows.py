"""Crop windows: centred, on a stride grid, and drawn at random."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.numeric import even, sample_count, sliced, whole
from ..params import Params
from .masks import SLICE

#: Draws of one window until the original search gives up.
ATTEMPTS = 10_000
#: Multipliers of the linear congruence that draws pixels without a random generator's state.
DRAW, LAYER = 7919, 104729


def around_box(size: int) -> dict[str, Column]:
    """Place of the window around a rectangle (``box_*``)."""
    return {"row0": F.col("box_y") - whole((F.lit(size) - F.col("box_h")) / 2), "col0": F.col("box_x") - whole((F.lit(size) - F.col("box_w")) / 2)}


def center(extents: DataFrame, size: int) -> DataFrame:
    """One window a slice, around the outline's rectangle."""
    w, h = F.col("x_max") - F.col("x_min") + 1, F.col("y_max") - F.col("y_min") + 1
    x0, y0 = F.col("x_min") - whole((F.lit(size) - w) / 2), F.col("y_min") - whole((F.lit(size) - h) / 2)
    return extents.select(*SLICE, F.lit(1).alias("ordinal"), y0.alias("row0"), x0.alias("col0"))


def containment(dilated: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """How many pixels of the widened gland lie in the window: all of them, or the window does not hold the gland."""
    inside = F.col("y").between(F.col("row0"), F.col("row0") + size - 1) & F.col("x").between(F.col("col0"), F.col("col0") + size - 1)
    out = dilated.join(windows, list(SLICE)).groupBy(*SLICE).agg(F.count("*").alias("total"), F.count_if(inside).alias("inside"))
    return out.withColumn("contained", F.col("total") == F.col("inside"))


def axis(lo: Column, hi: Column, size: int, stride: int) -> dict[str, Column]:
    """First and last place and number of windows along one axis."""
    span = hi - lo + 1
    middle, q = even(lo + span / 2), size / stride
    n = F.greatest(F.ceil(span / stride).cast("double"), F.lit(q))
    full = n * stride
    return {"start": whole(middle - full / 2), "end": whole(middle + full / 2), "steps": whole(n - q + 1)}


def grid(extents: DataFrame, size: int, stride: int, keep: bool = False) -> DataFrame:
    """The grid over each slice's extents; ``keep`` leaves the other columns beside it."""
    i, j = axis(F.col("y_min"), F.col("y_max"), size, stride), axis(F.col("x_min"), F.col("x_max"), size, stride)
    return extents.select("*" if keep else F.struct(*SLICE).alias("s"), *[c.alias(f"{k}_i") for k, c in i.items()], *[c.alias(f"{k}_j") for k, c in j.items()]).select(*(["*"] if keep else ["s.*", *[f"{k}_{a}" for a in "ij" for k in i]]))


def _tile(si: Column, sj: Column, size: int, stride: int, height: Column, width: Column) -> dict[str, Column]:
    """One window of a grid. It is cut out of the grid's own rectangle, so it loses what lies outside of that."""
    out = {"ordinal": (si - 1) * F.col("steps_j") + sj, "row0": F.col("start_i") + (si - 1) * stride, "col0": F.col("start_j") + (sj - 1) * stride}
    for name, k, s, n in (("height", "i", si, height), ("width", "j", sj, width)):
        room = F.greatest(sliced(F.col(f"end_{k}"), n) - sliced(F.col(f"start_{k}"), n), F.lit(0))
        out[name] = F.greatest(F.least((s - 1) * stride + size, room) - F.least((s - 1) * stride, room), F.lit(0))
    return out


def tile_list(size: int, stride: int) -> Column:
    """Windows of a kept grid's row, as structs; ordinals count from 1, row by row, before any filter."""

    def one(si, sj):
        return F.struct(*[c.cast("int").alias(k) for k, c in _tile(si, sj, size, stride, F.col("height"), F.col("width")).items()])

    steps = lambda k: F.sequence(F.lit(1), F.col(f"steps_{k}"))
    return F.when((F.col("steps_i") > 0) & (F.col("steps_j") > 0), F.flatten(F.transform(steps("i"), lambda si: F.transform(steps("j"), lambda sj: one(si, sj)))))


def tiles(grid: DataFrame, size: int, stride: int, height: int, width: int) -> DataFrame:
    """Grid windows, row by row; ordinals count from 1 before any filter. ``height`` and ``width`` of each are what the slice leaves of it."""
    out = grid.select("*", F.explode(F.sequence(F.lit(1), F.col("steps_i"))).alias("si")).select("*", F.explode(F.sequence(F.lit(1), F.col("steps_j"))).alias("sj"))
    return out.select(*SLICE, *[c.alias(k) for k, c in _tile(F.col("si"), F.col("sj"), size, stride, F.lit(height), F.lit(width)).items()])


def ranked(mask: DataFrame) -> DataFrame:
    """Mask pixels of each slice numbered from 0 in row order, with their number. A slice is the largest group."""
    w = W.partitionBy(*SLICE)
    return mask.select(*SLICE, "y", "x", (F.row_number().over(w.orderBy("y", "x")) - 1).alias("rank"), F.count("*").over(w).alias("n"))


def draws(areas: DataFrame, size: int, density: int) -> DataFrame:
    """Sample ordinals of each slice, from 0."""
    return areas.select(*SLICE, F.explode(F.sequence(F.lit(0), sample_count(F.col("gland_area"), size, density) - 1)).alias("ordinal"))


def random_windows(pixels: DataFrame, draws: DataFrame, size: int, seed: int) -> DataFrame:
    """For each draw a pixel of the slice, with replacement, and the window around it.

    The pixel is a function of draw, slice and seed alone, so a task that runs
    again draws the same.
    """
    count = pixels.groupBy(*SLICE).agg(F.count("*").alias("n"))
    pick = F.pmod(F.col("ordinal") * DRAW + F.col("z") * LAYER + seed, F.col("n"))
    drawn = draws.join(count, list(SLICE)).select(*SLICE, "ordinal", pick.cast("int").alias("rank"))
    out = drawn.join(ranked(pixels).drop("n"), [*SLICE, "rank"])
    return out.select(*SLICE, "ordinal", whole(F.col("y") - F.lit(size) / 2).alias("row0"), whole(F.col("x") - F.lit(size) / 2).alias("col0"))


def left_of(start: Column, size: int, n: int | Column) -> Column:
    """How much of a window slicing leaves along an axis of ``n``."""
    return F.greatest(sliced(start + size, F.lit(n)) - sliced(start, F.lit(n)), F.lit(0))


def bounded(windows: DataFrame, size: int, height: int | Column, width: int | Column) -> DataFrame:
    """Windows with the rows and columns that slicing leaves of them."""
    return windows.withColumns({"height": left_of(F.col("row0"), size, height), "width": left_of(F.col("col0"), size, width)})


def lesion_counts(windows: DataFrame, voxels: DataFrame, size: int) -> DataFrame:
    """Lesion voxels in each window; 0 where there are none. Only lesion voxels are joined, by slice and then by place."""
    lesion = voxels.filter("lesion >= 1").select(*SLICE, "y", "x")
    inside = (F.col("l.y") >= F.col("w.row0")) & (F.col("l.y") < F.col("w.row0") + size) & (F.col("l.x") >= F.col("w.col0")) & (F.col("l.x") < F.col("w.col0") + size)
    same = (F.col("w.case_id") == F.col("l.case_id")) & (F.col("w.z") == F.col("l.z"))
    names = [f"w.{c}" for c in windows.columns]
    return windows.alias("w").join(lesion.alias("l"), same & inside, "left").groupBy(*names).agg(F.count("l.y").alias("lesion"))


def with_lesion(slices: DataFrame, label: Column, level: int) -> DataFrame:
    """Mask slices whose ``windows`` (structs with ``row0, col0, height, width``) have the ``lesion`` voxels that lie in each, in place of the label arrays: a table of running sums serves all windows of a slice."""
    names = [c for c in slices.columns if c not in ("gland", "lesion")]
    sides = ("row0", "col0", "height", "width")

    def run(batches):
        for pdf in batches:
            counts = []
            for px, h, w, *at in zip(pdf["_label"], pdf["height"], pdf["width"], *(pdf[f"_{c}"] for c in sides), strict=True):
                counts.append(None if at[0] is None else kernels.window_sums(np.asarray(px).reshape(h, w) >= level, *(np.asarray(a, np.int64) for a in at)))
            yield pdf[["_row"]].assign(_counts=counts)

    every = [F.col(c) for c in names]
    held = slices.select(F.struct(*every).alias("_row"), "height", "width", label.alias("_label"), *[F.col(f"windows.{c}").alias(f"_{c}") for c in sides])
    kind = slices.select(F.struct(*every).alias("_row")).schema["_row"].dataType.simpleString()
    out = held.mapInPandas(run, f"_row {kind}, _counts array<long>").select("_row.*", "_counts")
    one = lambda t, i: F.struct(*[t[f].alias(f) for f in _fields(slices)], F.get("_counts", i).alias("lesion"))
    return out.withColumn("windows", F.transform("windows", one)).drop("_counts")


def _fields(slices: DataFrame) -> list[str]:
    return [f.name for f in slices.schema["windows"].dataType.elementType.fields]


def drawn_lists(slices: DataFrame, params: Params, least: int) -> DataFrame:
    """Mask slices with ``gland_area`` and, in place of their label arrays, random ``windows``: structs of ``ordinal, attempts, row0, col0``.

    A draw is a number made of case, slice, ordinal and seed (``draw="hash"``), or
    of slice, ordinal and seed by a linear congruence that SQL can repeat
    (``"lcg"``), so a task that runs again draws the same. Of negatives, each
    draw picks a gland pixel. Of positives it picks among the pixels whose window
    starts inside the slice and holds ``least`` lesion voxels, as redrawing until
    then would (``positive_draws="acceptable"``; ``attempts`` is 1), or it is
    what the original's redrawing comes to (``"attempts"``): until the lesion is
    enough, a coordinate is negative, or ``ATTEMPTS`` are used up, and the last
    pixel stays. Slices with a ``slice_reason`` get no windows.
    """
    size, label = params.crop_image_size, "gland" if params.gland_contains_lesion else "lesion"
    level = params.tumor_label_level if params.gland_contains_lesion else 1
    positive, redraw = params.positive, params.positive_draws == "attempts"
    count = sample_count(F.col("gland_area"), size, params.sample_number)
    number = (lambda i: i * DRAW + F.col("z") * LAYER + params.seed) if params.draw == "lcg" else (lambda i: F.xxhash64("case_id", "z", i, F.lit(params.seed)))
    draws = F.transform(F.sequence(F.lit(0), count - 1), lambda i: number(i).cast("long"))
    if "slice_reason" in slices.columns:
        draws = F.when(F.col("slice_reason").isNull(), draws).otherwise(F.array().cast("array<long>"))
    names = [c for c in slices.columns if c not in ("gland", "lesion")]
    every = F.struct(*[F.col(c) for c in names])
    held = slices.select(every.alias("_row"), "height", "width", "gland", F.col(label).alias("label"), draws.alias("draws"))

    def run(batches):
        for pdf in batches:
            out = {"attempts": [], "row0": [], "col0": []}
            for h, w, gland, lab, draws in zip(*(pdf[c] for c in ("height", "width", "gland", "label", "draws")), strict=True):
                draws = np.asarray(draws, np.int64)
                y, x = np.divmod(np.flatnonzero(np.asarray(gland) >= 1), w)
                row, col = np.trunc(y - size / 2).astype(np.int64), np.trunc(x - size / 2).astype(np.int64)
                tries = np.ones(len(draws), np.int64)
                if positive and len(draws):
                    held = kernels.window_sums(np.asarray(lab).reshape(h, w) >= level, row, col, size)
                    if redraw:
                        pick, tries = redrawn(draws, (held >= least) | (row < 0) | (col < 0))
                        row, col = row[pick], col[pick]
                    else:
                        ok = (held >= least) & (row >= 0) & (col >= 0)
                        row, col = row[ok], col[ok]
                if not (positive and redraw):
                    pick = draws % len(row) if len(row) else np.zeros(0, np.int64)
                    row, col, tries = row[pick], col[pick], tries[: len(pick)]
                for k, v in (("attempts", tries), ("row0", row), ("col0", col)):
                    out[k].append(v if len(draws) else v[:0])
            yield pdf[["_row"]].assign(**out)

    kind = slices.select(every.alias("_row")).schema["_row"].dataType.simpleString()
    got = held.mapInPandas(run, f"_row {kind}, attempts array<int>, row0 array<int>, col0 array<int>")
    one = lambda r, i: F.struct(i.alias("ordinal"), F.get("attempts", i).alias("attempts"), r.alias("row0"), F.get("col0", i).alias("col0"))
    return got.select("_row.*", F.transform("row0", one).alias("windows"))


def sampled(slices: DataFrame, params: Params, least: int) -> DataFrame:
    """``drawn_lists`` as rows: ``case_id, z, ordinal, attempts, row0, col0, slice_h, slice_w``."""
    out = drawn_lists(slices, params, least).select(*SLICE, F.col("height").alias("slice_h"), F.col("width").alias("slice_w"), F.explode("windows").alias("w"))
    return out.select(*SLICE, "w.*", "slice_h", "slice_w")


def redrawn(draws: np.ndarray, stop: np.ndarray, limit: int = ATTEMPTS) -> tuple[np.ndarray, np.ndarray]:
    """For each draw the pixel that a search stops at, and how many draws it took, without the draws between.

    Drawing with replacement until a pixel of ``stop`` comes takes a geometric
    number of draws, whatever pixel it is, and all of them are equally likely.
    A search that finds none in ``limit`` - 1 draws ends at ``limit`` with any
    other pixel. Each draw seeds two numbers: one for the count and one for the pixel.
    """
    share = stop.mean() if len(stop) else 0.0
    first, second = _uniform(draws, 1), _uniform(draws, 2)
    if share == 0:
        tries = np.full(len(draws), limit)
    elif share == 1:
        tries = np.ones(len(draws), np.int64)
    else:
        tries = np.minimum(np.floor(np.log1p(-first) / np.log1p(-share)) + 1, limit).astype(np.int64)
    yes, no = np.flatnonzero(stop), np.flatnonzero(~stop)
    pick = np.zeros(len(draws), np.int64)
    for some, at in ((yes, tries < limit), (no if len(no) else yes, tries >= limit)):
        if len(some):
            pick[at] = some[np.minimum((second[at] * len(some)).astype(np.int64), len(some) - 1)]
    return pick, tries.astype(np.int64)


def _uniform(draws: np.ndarray, stream: int) -> np.ndarray:
    """Numbers from 0 up to 1, told by draw and stream: a finaliser that spreads every bit over all."""
    x = draws.astype(np.int64).view(np.uint64) + np.uint64(stream * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53
