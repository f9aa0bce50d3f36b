"""Mask slices as rows: ``case_id, z, height, width, gland, lesion``, the last two being label arrays.

Counts and places are array expressions on that one row, so nothing is exploded
and nothing is shuffled but one small row a slice where a case's slices meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import least_area
from ..params import Params
from .masks import SLICE, ends


def tumor(params: Params) -> Column:
    """The array that holds lesion labels: the gland's own where one mask holds both."""
    return F.col("gland") if params.gland_contains_lesion else F.col("lesion")


def spot_level(params: Params) -> int:
    """The least label that counts as lesion where overlap and windows are judged: masks of their own count from 1."""
    return params.tumor_label_level if params.gland_contains_lesion else 1


def measured(slices: DataFrame, params: Params) -> DataFrame:
    """Slices with voxel counts: ``gland_area``, ``lesion_area`` (labels of the set level), ``spot_area`` and ``overlap_area``, ``percent``."""
    label, level = tumor(params), spot_level(params)
    both = F.zip_with("gland", label, lambda g, t: (g >= 1) & (t >= level))
    out = slices.withColumns({
        "gland_area": F.size(F.filter("gland", lambda v: v >= 1)).cast("long"),
        "lesion_area": F.size(F.filter(label, lambda v: v >= params.tumor_label_level)).cast("long"),
        "spot_area": F.size(F.filter(label, lambda v: v >= level)).cast("long"),
        "overlap_area": F.size(F.filter(both, lambda v: v)).cast("long"),
    })
    return out.withColumn("percent", F.try_divide(F.col("overlap_area") * 100.0, F.col("spot_area")))


def in_range(measures: DataFrame, params: Params) -> DataFrame:
    """Slices from one filled slice to another, gaps included: ``exclude_slices`` are left out at either end, unless all are kept.

    The original range begins one slice late; ``compat="strict"`` begins with the
    filled slice itself. ``measures`` is read again for the ends: small rows that
    were stored once.
    """
    k, late = 0 if params.keep_all_slices else params.exclude_slices, int(params.compat != "strict")
    return measures.join(ends(measures.filter("gland_area > 0").select(*SLICE), k), "case_id").filter((F.col("z") >= F.col("lo") + late) & (F.col("z") <= F.col("hi"))).drop("lo", "hi")


def reason(params: Params) -> Column:
    """Why a slice is not cropped, by its counts; null where it may be."""
    area, cm2 = (F.col("lesion_area"), params.c_min_positive) if params.positive else (F.col("gland_area"), params.c_min_negative)
    out = F.when(area < least_area(cm2, params.pixel_spacing), "AREA_TOO_SMALL")
    if params.positive:
        enough = F.coalesce(F.col("percent") >= params.min_overlap_percent, F.lit(False))
        out = out.when(~enough, "OVERLAP_REJECT").when((F.col("gland_area") == 0) | (F.col("lesion_area") == 0), "EMPTY_MASK")
    return out


def chosen(slices: DataFrame, params: Params) -> DataFrame:
    """Slices in range with gland (positive: lesion, most of it in the gland) enough."""
    return in_range(measured(slices, params), params).filter(reason(params).isNull())


def box(slices: DataFrame) -> DataFrame:
    """How far the outline of a slice's gland reaches, from the gland itself: one pixel before its first, up to its last.

    That holds for one solid part away from the border; ``outline.shapes`` follows the outline.
    """
    at = F.filter(F.transform("gland", lambda v, i: F.when(v >= 1, i)), lambda i: i.isNotNull())
    out = slices.withColumn("at", at).filter(F.size("at") > 0)
    y, x = F.transform("at", lambda i: F.floor(i / F.col("width")).cast("int")), F.transform("at", lambda i: i % F.col("width"))
    return out.withColumns({"y_min": F.array_min(y) - 1, "y_max": F.array_max(y), "x_min": F.array_min(x) - 1, "x_max": F.array_max(x)}).drop("at")


def contained(size: int) -> Column:
    """Whether a window (``row0, col0``) holds the gland (``g_*``: its extents) and one pixel around it, as far as the slice goes."""
    top, left = F.greatest(F.col("g_top") - 1, F.lit(0)), F.greatest(F.col("g_left") - 1, F.lit(0))
    bottom, right = F.least(F.col("g_bottom") + 1, F.col("height") - 1), F.least(F.col("g_right") + 1, F.col("width") - 1)
    return (F.col("row0") <= top) & (bottom < F.col("row0") + size) & (F.col("col0") <= left) & (right < F.col("col0") + size)


def same_stacks(slices: DataFrame) -> DataFrame:
    """Whether a case's stacks (``role``) have equally many slices of one size: masks that do not are not compared."""
    per = slices.groupBy("case_id", "role").agg(F.count("*").alias("n"), F.min(F.struct("height", "width")).alias("a"), F.max(F.struct("height", "width")).alias("b"))
    return per.groupBy("case_id").agg(F.max("n").alias("n_slices"), ((F.min("n") == F.max("n")) & (F.min("a") == F.max("b"))).alias("consistent"))
