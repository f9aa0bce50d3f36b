"""Relational mask operators on ``voxels`` (``case_id, z, y, x`` with label columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import least_area
from ..params import Params

SLICE = ("case_id", "z")
PIXEL = ("case_id", "z", "y", "x")


def by_slice(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` with the columns of ``right`` of the same slice.

    Tables of one slice store are bucketed by case and block. The slice itself is
    compared beside that, not as a third key, so the planner takes the buckets as
    they are and moves no pixels.
    """
    if "block" not in left.columns or "block" not in right.columns:
        return left.join(right, list(SLICE))
    same = (F.col("l.case_id") == F.col("r.case_id")) & (F.col("l.block") == F.col("r.block")) & (F.col("l.z") - F.col("r.z") == 0)
    return left.alias("l").join(right.alias("r"), same).select("l.*", *[F.col(f"r.`{c}`") for c in right.columns if c not in (*SLICE, "block")])


def areas(voxels: DataFrame, level: int = 1, combined: bool = False) -> DataFrame:
    """Voxels of each slice whose gland label is at least 1, and whose lesion label is at least ``level``.

    ``combined``: the gland column holds both. Partial counts leave every scan
    task, so only slices are shuffled.
    """
    lesion = F.col("gland" if combined else "lesion") >= level
    return voxels.groupBy(*SLICE).agg(F.count_if(F.col("gland") >= 1).alias("gland_area"), F.count_if(lesion).alias("lesion_area"))


def nonempty(voxels: DataFrame) -> DataFrame:
    """Slices with a gland voxel."""
    return voxels.filter("gland >= 1").select(*SLICE).distinct()


def ends(filled: DataFrame, k: int) -> DataFrame:
    """Of each case the slices ``lo`` and ``hi`` that ``k`` filled slices (``case_id, z``, each once) lie before and behind; cases of too few have none.

    Tasks keep the ``k + 1`` rows at either end of a case and no others before
    they are shuffled, however many slices a case has.
    """
    if k == 0:
        return filled.groupBy("case_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))

    def side(order: Column, pick, name: str) -> DataFrame:
        near = filled.select(*SLICE, F.row_number().over(W.partitionBy("case_id").orderBy(order)).alias("place")).filter(F.col("place") <= k + 1)
        return near.groupBy("case_id").agg(pick("z").alias(name), F.count("*").alias("n")).filter(F.col("n") == k + 1).drop("n")

    return side(F.col("z").asc(), F.max, "lo").join(side(F.col("z").desc(), F.min, "hi"), "case_id").filter("lo <= hi")


def slice_range(voxels: DataFrame, exclude: int = 0) -> DataFrame:
    """Slices that are processed: from after the ``exclude``-th filled slice to the one as far from the end, gaps included."""
    found = ends(nonempty(voxels), exclude).filter("lo < hi")
    return found.select("case_id", F.explode(F.sequence(F.col("lo") + 1, F.col("hi"))).alias("z"))


def large_enough(areas: DataFrame, params: Params) -> DataFrame:
    """Slices whose gland (positive: lesion) is large enough."""
    column, cm2 = ("lesion_area", params.c_min_positive) if params.positive else ("gland_area", params.c_min_negative)
    return areas.filter(F.col(column) >= least_area(cm2, params.pixel_spacing))


def as_byte(label: Column) -> Column:
    """A label times 255 in eight bits, which wraps."""
    return F.pmod(label * 255, F.lit(256))


def split_labels(label: Column, level: int) -> tuple[Column, Column]:
    """Gland and lesion of one mask that holds both."""
    return F.when(label > 0, 1).otherwise(0), F.when(label > level - 1, 10).otherwise(0)


def overlap(voxels: DataFrame) -> DataFrame:
    """Lesion voxels that lie in the gland, and their share; a slice without lesion has none."""
    both = F.sum((F.col("gland") >= 1).cast("int") * (F.col("lesion") >= 1).cast("int")).cast("long")
    out = voxels.groupBy(*SLICE).agg(F.sum((F.col("lesion") >= 1).cast("int")).cast("long").alias("lesion_area"), both.alias("overlap_area"))
    return out.withColumn("percent", F.try_divide(F.col("overlap_area") * 100.0, F.col("lesion_area")))


def joined_masks(gland: DataFrame, lesion: DataFrame) -> DataFrame:
    """Two mask tables (``label`` each) side by side, matched by pixel."""
    return gland.withColumnRenamed("label", "gland").join(lesion.withColumnRenamed("label", "lesion"), list(PIXEL))


def dilated(mask: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels within one step of a mask pixel: where a 3x3 blur of the mask is not zero."""
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    near = mask.select(*PIXEL, step.alias("dy")).select("*", step.alias("dx"))
    near = near.select("case_id", "z", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
    return near.filter(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).distinct()


def blurred(voxels: DataFrame, value: Column, height: int, width: int) -> DataFrame:
    """3x3 mean of a byte column at pixels away from the border, where it is not zero."""
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    near = voxels.select(*PIXEL, value.alias("b")).filter("b > 0").select("*", step.alias("dy")).select("*", step.alias("dx"))
    near = near.select("case_id", "z", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "b")
    inner = near.filter(F.col("y").between(1, height - 2) & F.col("x").between(1, width - 2))
    return inner.groupBy(*PIXEL).agg(F.bround(F.sum("b") / 9).cast("int").alias("blur")).filter("blur > 0")


def extents(voxels: DataFrame) -> DataFrame:
    """How far the outline of each slice's gland reaches: one pixel before its first, up to its last."""
    return voxels.filter("gland >= 1").groupBy(*SLICE).agg(
        (F.min("y") - 1).alias("y_min"), F.max("y").alias("y_max"), (F.min("x") - 1).alias("x_min"), F.max("x").alias("x_max")
    )
