"""From mask slices to windows to crops: one plan for each method and class.

A slice's masks stay on one row from the scan to its windows, and what leaves
that scan is a small row: the slice's reason and the list of its windows, each
with a reason of its own. It is stored once; the slice range, the windows to
crop and the table of decisions are all read from it, so a plan scans the masks
once and no pixels are shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import least_area, least_voxels
from ..operators import crops, outline, stacks, windows
from ..operators.masks import SLICE
from ..params import Params
from ..sources.stored import stored


def shaped(slices: DataFrame, params: Params) -> DataFrame:
    """Mask slices with the extents and the rectangle that windows are placed by; without an outline, ``contours`` is 0."""
    if params.geometry == "contour":
        return outline.shapes(slices, params, arrays=params.crop_method == "random" or (params.crop_method == "stride" and params.positive))
    out = stacks.box(slices)
    return out.withColumns({
        "contours": F.lit(1), "box_x": F.col("x_min"), "box_y": F.col("y_min"), "box_w": F.col("x_max") - F.col("x_min") + 1, "box_h": F.col("y_max") - F.col("y_min") + 1,
        "g_top": F.col("y_min") + 1, "g_bottom": F.col("y_max"), "g_left": F.col("x_min") + 1, "g_right": F.col("x_max"),
    })


def _reasoned(params: Params, first) -> Column:
    """``windows`` with what is left of each in its slice, and why it is not cropped (``reason``): ``first`` (of a window), outside, or of another size."""
    size = params.crop_image_size
    exact = params.crop_method == "center" or params.sequence_type == "T2W" or params.compat == "strict"

    def one(t: Column) -> Column:
        h, w = (t["height"], t["width"]) if params.crop_method == "stride" else (windows.left_of(t["row0"], size, F.col("height")), windows.left_of(t["col0"], size, F.col("width")))
        reason = F.coalesce(first(t), F.when((h == 0) | (w == 0), "OUT_OF_BOUNDS"))
        if exact:
            reason = F.coalesce(reason, F.when((h != size) | (w != size), "WRONG_SIZE"))
        attempts = t["attempts"] if params.crop_method == "random" else F.lit(1)
        lesion = t["lesion"] if params.crop_method == "stride" and params.positive else F.lit(None).cast("long")
        parts = {"ordinal": t["ordinal"], "attempts": attempts, "row0": t["row0"], "col0": t["col0"], "height": h, "width": w}
        return F.struct(*[c.cast("int").alias(k) for k, c in parts.items()], lesion.alias("lesion"), reason.alias("reason"))

    return F.transform("windows", one)


def placed(shapes: DataFrame, params: Params) -> DataFrame:
    """Shaped slices with the list of their ``windows``, before any filter: none where the slice itself has a reason."""
    size = params.crop_image_size
    fit = F.col("slice_reason").isNull()
    never = lambda t: F.lit(None).cast("string")
    if params.crop_method == "center":
        at = shapes.withColumns(windows.around_box(size)).withColumn("held", stacks.contained(size))
        one = F.struct(F.lit(1).alias("ordinal"), F.col("row0").cast("int").alias("row0"), F.col("col0").cast("int").alias("col0"))
        out, first = at.withColumn("windows", F.when(fit, F.array(one))), lambda t: F.when(~F.col("held"), "NOT_CONTAINED")
    elif params.crop_method == "stride":
        grid = windows.grid(shapes, size, params.crop_stride, keep=True)
        out, first = grid.withColumn("windows", F.when(fit, windows.tile_list(size, params.crop_stride))), never
        if params.positive:
            out = windows.with_lesion(out, stacks.tumor(params), stacks.spot_level(params))
            first = lambda t: F.when(t["lesion"] < least_area(params.c_min_positive, params.pixel_spacing), "LESION_TOO_SMALL")
    else:
        out, first = windows.drawn_lists(shapes, params, least_voxels(params.c_min_positive, params.pixel_spacing)), never
    return out.withColumn("windows", _reasoned(params, first))


def judged(slices: DataFrame, params: Params) -> DataFrame:
    """One small row a gland slice, from one scan of its masks: ``gland_area``, ``metric`` (the area that counts), ``slice_reason`` (null: it may be cropped) and ``windows``. Nothing is shuffled."""
    area = F.col("lesion_area" if params.positive else "gland_area")
    measures = stacks.measured(slices, params).filter("gland_area > 0").withColumns({"slice_reason": stacks.reason(params), "metric": area})
    shapes = shaped(measures, params).withColumn("slice_reason", F.coalesce("slice_reason", F.when(F.col("contours") == 0, "NO_CONTOUR")))
    return placed(shapes, params).select(*SLICE, *(["block"] if "block" in slices.columns else []), "gland_area", "metric", "slice_reason", "windows")


def kept_lists(rows: DataFrame, params: Params) -> DataFrame:
    """``case_id, z`` and the ``windows`` that are cropped, of stored ``judged`` rows: those of slices in range."""
    kept = stacks.in_range(rows, params).withColumn("windows", F.filter("windows", lambda t: t["reason"].isNull()))
    return kept.filter(F.size("windows") > 0).drop("gland_area", "metric", "slice_reason")


def kept_windows(slices: DataFrame, params: Params) -> DataFrame:
    """Windows that are cropped, a row each."""
    rows = stored(judged(slices, params), "windows")
    return kept_lists(rows, params).select(*SLICE, F.explode("windows").alias("w")).select(*SLICE, "w.ordinal", "w.row0", "w.col0", "w.height", "w.width")


def cut_crops(lists: DataFrame, images: DataFrame, originals: DataFrame, params: Params, resample=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Crops of the windows in ``lists`` with the range that their greys cover, and the greys.

    Percentiles are of whole volumes (``originals``). They are joined with the
    lists, which are small, and crops carry them (and the columns of ``keep``).
    """
    p = crops.percentile(originals, params.max_percentile).groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("modality", "p"))).alias("percentiles"))
    carried = {"p": F.col("percentiles")[F.col("modality")], **{c: F.col(c) for c in keep}}
    cut = crops.autoscale(crops.read_lists(lists.join(p, "case_id"), images, params.crop_image_size, resample, carried))
    lo, hi = crops.window_policy(F.col("modality"), F.col("p"), F.col("vmin"), F.col("vmax"), params.normalized_image, params.normalized_vmax, params.do_normalization)
    return crops.grayed(cut.withColumns({"lo": lo, "hi": hi})).drop("p", "vmin", "vmax")


def crop(slices: DataFrame, images: DataFrame, params: Params, originals: DataFrame | None = None, resample=None) -> DataFrame:
    """Crops of every modality (a column of ``images``) with the range that their greys cover.

    Percentiles are of whole volumes as they were before resampling
    (``originals``; without them, of ``images``), selected once and joined by
    volume. ``resample`` is applied to slices that have windows, as they are cut.
    """
    lists = kept_lists(stored(judged(slices, params), "windows"), params)
    return cut_crops(lists, images, images if originals is None else originals, params, resample)


def decisions(slices: DataFrame, params: Params, ranged: bool = True) -> DataFrame:
    """Why each gland slice, or each window of one that passes, was cropped or not: the first reason that holds.

    Slices that fail as a whole have one row, of ordinal 0 (1 for centred
    windows). ``ranged`` leaves out slices that the range does not reach.
    ``metric`` is the lesion in a tile, or else the slice's area.
    """
    rows = stored(judged(slices, params), "windows")
    if ranged:
        rows = stacks.in_range(rows, params)
    told = F.transform("windows", lambda t: F.struct(t["ordinal"].alias("ordinal"), F.coalesce(t["reason"], F.lit("CROPPED")).alias("reason"), F.coalesce(t["lesion"], F.col("metric")).alias("metric")))
    alone = F.array(F.struct(F.lit(int(params.crop_method == "center")).alias("ordinal"), F.col("slice_reason").alias("reason"), F.col("metric").alias("metric")))
    return rows.select(*SLICE, F.explode(F.when(F.col("slice_reason").isNull(), told).otherwise(alone)).alias("d")).select(*SLICE, "d.*")
