"""Column arithmetic with the rounding that each formula needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def even(x: Column) -> Column:
    """Round half to even, as a whole number."""
    return F.bround(x).cast("int")


def whole(x: Column) -> Column:
    """Cut towards zero."""
    return x.cast("int")


def voxels_per_cm2(spacing: float) -> Column:
    return F.bround(F.lit(1.0) / F.pow(F.lit(spacing) / 10, F.lit(2))).cast("int")


def least_area(cm2: float, spacing: float) -> Column:
    """Fewest voxels of an area."""
    return whole(F.lit(float(cm2)) * voxels_per_cm2(spacing))


def least_voxels(cm2: float, spacing: float) -> int:
    """``least_area`` as a number, where a task needs it."""
    return int(float(cm2) * round(1.0 / (spacing / 10) ** 2))


def sample_count(area: Column, size: int, density: int) -> Column:
    """Random windows of a slice: its area in windows times the density, one at least."""
    return F.greatest(F.lit(1), whole(area / F.lit(float(size * size)) * density))


def resized(n: Column, spacing: Column, target: Column) -> Column:
    """Pixels of an axis after resampling."""
    return even(n * (spacing / target))


def source_index(out: Column, spacing: Column, target: Column) -> Column:
    """Nearest input pixel of an output pixel."""
    return F.floor(out * target / spacing + 0.5).cast("int")


def sliced(v: Column, n: Column) -> Column:
    """A slice bound as an index: negative ones count from the end, and all are cut to the axis."""
    return F.least(F.greatest(F.when(v < 0, v + n).otherwise(v), F.lit(0)), n)
