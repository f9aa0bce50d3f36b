"""Pixels of windows, intensity windows and names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stored import stored
from .masks import SLICE, by_slice


#: Pixels of crops that a task holds before it gives them on.
HELD = 2_000_000


def read_windows(windows: DataFrame, slices: DataFrame, size: int) -> DataFrame:
    """Windows (a row each) with their pixels, row by row, from ``slices`` (``case_id, z, modality, height, width, px``)."""
    lists = windows.groupBy(*SLICE).agg(F.collect_list(F.struct("ordinal", "row0", "col0")).alias("windows"))
    return read_lists(lists, slices, size)


def read_lists(lists: DataFrame, slices: DataFrame, size: int, resample=None, keep: dict[str, Column] | None = None) -> DataFrame:
    """Windows of each slice (``case_id, z, windows``) with their pixels, a row each.

    A slice meets the list of its windows, so its pixels move once at most, however
    many windows it has, and are cut in the task that has them. ``resample(px,
    modality, spacing, src_dtype)`` makes the slice that windows are cut from;
    only slices that have windows come to it. ``keep`` names columns of ``lists``
    (and ``modality``) that crops carry: what belongs to a case comes with its small
    lists, so that crops need no join of their own.
    """
    keep = keep or {}
    block = ["block"] if "block" in lists.columns and "block" in slices.columns else []
    extra = ["spacing", "src_dtype"] if resample else []
    parts = {f"_{k}": F.col(f"windows.{k}") for k in ("ordinal", "row0", "col0")}
    both = by_slice(slices.select(*SLICE, *block, "modality", "height", "width", *extra, "px"), lists.drop(*[c for c in ("modality", "height", "width", "px", *extra) if c in lists.columns]))
    flat = both.select(*SLICE, "modality", "height", "width", *extra, "px", *[c.alias(k) for k, c in parts.items()], *[c.alias(k) for k, c in keep.items()])
    names = list(keep)
    more = "".join(f", `{k}` {flat.schema[k].dataType.simpleString()}" for k in names)

    def run(batches):
        columns = ["case_id", "z", "ordinal", "row0", "col0", "modality", "height", "width", "px", *names]
        for pdf in batches:
            out, held = [], 0
            for r in pdf.to_dict("records"):
                img = np.asarray(r["px"], float).reshape(r["height"], r["width"])
                if resample:
                    img = resample(img, r["modality"], r["spacing"], r["src_dtype"])
                for k, y, x in zip(r["_ordinal"], r["_row0"], r["_col0"], strict=True):
                    cut = img[_bounds(y, size, img.shape[0]), _bounds(x, size, img.shape[1])]
                    if cut.size:
                        out.append((r["case_id"], r["z"], k, y, x, r["modality"], *cut.shape, cut.ravel(), *(r[k] for k in names)))
                        held += cut.size
                        if held >= HELD:  # crops of a batch may be many times its slices
                            yield pd.DataFrame(out, columns=columns)
                            out, held = [], 0
            yield pd.DataFrame(out, columns=columns)

    return flat.mapInPandas(run, "case_id string, z int, ordinal int, row0 int, col0 int, modality string, height int, width int, px array<double>" + more)


def _bounds(start: int, size: int, n: int) -> slice:
    """An array slice from ``start`` on, negative bounds counting from the end."""
    a, b = (min(max(v + n if v < 0 else v, 0), n) for v in (start, start + size))
    return slice(a, max(a, b))


def _between(slices: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """Slices of the volumes that have bounds, with ``lo`` and ``hi``. In a slice store the bounds of a case come to its buckets, as one small map a block, and pixels stay."""
    if "block" not in slices.columns or by[0] != "case_id":
        return slices.join(bounds.select(*by, "lo", "hi"), by)
    rest = F.struct(*by[1:])
    packed = bounds.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct(rest.alias("k"), F.struct("lo", "hi").alias("v")))).alias("_bounds"))
    blocks = slices.select("case_id", "block").distinct().join(packed, "case_id")
    out = slices.join(blocks, ["case_id", "block"]).withColumn("_bounds", F.col("_bounds")[rest])
    return out.filter("_bounds is not null").select(*slices.columns, "_bounds.*")


#: Bins of a pass of selection, and how many values of a volume one row may gather when few are left.
BINS, GATHER = 4096, 65_536


def percentile(slices: DataFrame, q: float, by: tuple[str, ...] = ("case_id", "modality"), bins: int = BINS, gather: int = GATHER) -> DataFrame:
    """Exact percentile ``p`` of the pixels of whole volumes (rows of ``px`` arrays), interpolated between neighbours; null and NaN pixels do not count.

    By selection: a pass counts the values between the bounds of a volume in equal
    bins, with each bin's least and greatest, and the bin that holds the wanted
    rank gives the next bounds. It ends when the bin has one value, the two ranks
    lie in two bins, or ``gather`` values are left, which are sorted. Counts are
    summed before they are shuffled, so what a volume holds anywhere is a row a bin.
    """
    by = list(by)
    values = lambda d, *more: d.select(*by, *more, F.explode("px").alias("v")).filter("v is not null and not isnan(v)")
    ranges = values(slices).groupBy(*by).agg(F.count("*").alias("n"), F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))
    at = F.lit(q / 100) * (F.col("n") - 1)
    state = ranges.withColumns({"k": F.floor(at).cast("long"), "near": F.floor(at) + 1 - at, "far": at - F.floor(at), "p": F.when(F.col("lo") == F.col("hi"), F.col("lo"))})
    state = stored(state, "percentiles")
    names = ["n", "lo", "hi", "k", "near", "far", "p"]
    while state.filter(F.col("p").isNull() & (F.col("n") > gather)).count():
        wide = state.filter(F.col("p").isNull() & (F.col("n") > gather))
        inside = values(_between(slices, wide, by), "lo", "hi").filter("v between lo and hi")
        # Halves keep the span of the largest numbers finite.
        span, away = F.col("hi") / 2 - F.col("lo") / 2, F.col("v") / 2 - F.col("lo") / 2
        place = F.least(F.floor(away / span * bins), F.lit(bins - 1))
        counted = inside.groupBy(*by, place.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        run = W.partitionBy(*by).orderBy("bin")
        ranked = counted.withColumns({"upto": F.sum("c").over(run), "next": F.lead("least").over(run)}).join(wide.select(*by, "k", "near", "far"), by)
        hit = ranked.filter((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("c") <= F.col("k")))
        apart = F.col("upto") == F.col("k") + 1
        p = F.when(apart, F.col("near") * F.col("most") + F.col("far") * F.coalesce("next", "most")).when(F.col("least") == F.col("most"), F.col("least"))
        # A rank without a part of the next one's value needs no next one.
        p = F.when((F.col("far") == 0) & apart, F.col("most")).otherwise(p)
        nearer = hit.select(*by, F.col("c").alias("n"), F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("k") - F.col("upto") + F.col("c")).alias("k"), "near", "far", p.alias("p"))
        state = stored(state.filter(F.col("p").isNotNull() | (F.col("n") <= gather)).unionByName(nearer.select(*by, *names)), "percentiles")
    few = state.filter("p is null")
    left = values(_between(slices, few, by), "lo", "hi").filter("v between lo and hi").groupBy(*by).agg(F.sort_array(F.collect_list("v")).alias("all"))
    a, b = F.get("all", F.col("k").cast("int")), F.get("all", F.col("k").cast("int") + 1)
    sorted_ = left.join(few, by).select(*by, F.when(F.col("far") == 0, a).otherwise(F.col("near") * a + F.col("far") * b).alias("p"))
    return state.filter("p is not null").select(*by, "p").unionByName(sorted_)


def window_policy(modality: Column, p: Column, lo: Column, hi: Column, normalized: bool, vmax: float, by_percentile: bool) -> tuple[Column, Column]:
    """Darkest and brightest value: fixed or percentile or own range for T2W, percentile for the others."""
    t2 = modality == "T2W"
    if normalized:
        return F.lit(0.0), F.when(t2, F.lit(float(vmax))).otherwise(p)
    if by_percentile:
        return F.lit(0.0), p
    return F.when(t2, lo).otherwise(F.lit(0.0)), F.when(t2, hi).otherwise(p)


def gray(v: Column, vmin: Column, vmax: Column) -> Column:
    """One of 256 greys; a window without extent is black."""
    g = F.floor(F.try_divide(256 * (v - vmin), vmax - vmin))
    return F.coalesce(F.least(F.greatest(g, F.lit(0)), F.lit(255)), F.lit(0)).cast("int")


def grayed(crops: DataFrame) -> DataFrame:
    """Crops with their 256 greys between ``lo`` and ``hi``."""
    return crops.withColumn("gray", F.transform("px", lambda v: gray(v, F.col("lo"), F.col("hi"))))


def autoscale(crops: DataFrame) -> DataFrame:
    """Each crop's own range."""
    return crops.withColumns({"vmin": F.array_min("px"), "vmax": F.array_max("px")})


def ids(name: Column) -> tuple[Column, Column]:
    """Case and study: the first two parts of a file name up to its first dot."""
    stem = F.split_part(name, F.lit("."), F.lit(1))
    return F.split_part(stem, F.lit("_"), F.lit(1)), F.split_part(stem, F.lit("_"), F.lit(2))


def crop_name(sequence: str, z: Column, n: Column, ordinal: Column | None, a: Column, b: Column, modality: Column) -> Column:
    parts = [F.lit(f"{sequence}_slice"), z, F.lit("of"), n, *([] if ordinal is None else [ordinal]), F.lit("cord"), a, b, modality]
    return F.concat_ws("_", *[p.cast("string") for p in parts])


def route(name: Column, keywords: dict) -> Column:
    """The modality that a name's keyword tells, the first that fits; null for none."""
    out = F.when(F.contains(name, F.lit(keywords["T2W"])), "T2W")
    for k in ("ADC", "HBV"):
        out = out.when(F.contains(name, F.lit(keywords[k])), k)
    return out
