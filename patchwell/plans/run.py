"""From volume files to crop files, for any number of cases at once.

Cases are told apart by their files' names, so every path may be a folder or a
pattern: masks and images of one case meet by case and slice. Volumes are decoded
once, into a bucketed table; all that follows reads that table, and no pixels are
shuffled.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.numeric import resized
from ..operators import crops, outline, stacks
from ..operators.masks import by_slice
from ..params import Params
from ..sources import crop_sink
from ..sources.slice_store import KEYS, SliceStore
from ..sources.stored import stored
from . import patches


def load(spark: SparkSession, params: Params, images_at: dict[str, str], gland: str, lesion: str | None = None) -> SliceStore:
    """Decode what a run needs. Positives need lesions, in a mask of their own unless the gland's holds them."""
    missing = [m for m in params.modalities if not images_at.get(m)]
    if missing:
        raise ValueError(f"no path for {', '.join(missing)}")
    paths = {m: images_at[m] for m in params.modalities} | {"gland": gland}
    if params.positive and not params.gland_contains_lesion:
        if not lesion:
            raise ValueError("positive cases need a lesion mask, or a gland mask that holds lesions")
        paths["lesion"] = lesion
    return SliceStore.write(spark, paths)


def masks(store: SliceStore, params: Params) -> DataFrame:
    """Mask slices at the spacing that is asked for. Cases whose two stacks differ in length or size have no slices."""
    header = ["height", "width", "spacing", "src_dtype"]
    gland = store.role("gland")
    rows = gland.select(*KEYS, "n_slices", *header, F.col("px").alias("gland"))
    if params.positive and not params.gland_contains_lesion:
        lesion = store.role("lesion")
        at = F.lit(float(params.pixel_spacing))
        size = [resized(F.col("height"), F.col("spacing")[1], at).alias("height"), resized(F.col("width"), F.col("spacing")[0], at).alias("width")]
        roles = gland.select("case_id", F.lit("gland").alias("role"), *size).unionByName(lesion.select("case_id", F.lit("lesion").alias("role"), *size))
        same = stacks.same_stacks(roles).filter("consistent").select("case_id")
        # By block too, so that this small table comes to the buckets of the slices and not they to it.
        blocks = gland.select("case_id", "block").distinct().join(same, "case_id")
        rows = by_slice(rows, lesion.select(*KEYS, *[F.col(c).alias(f"l_{c}") for c in header], F.col("px").alias("lesion")))
        rows = rows.join(blocks, ["case_id", "block"], "left_semi")
    return outline.at_spacing(rows, params)


def resampler(params: Params):
    """How a slice is resampled in-plane before windows are cut: by splines, or by the nearest pixel where the original does so."""
    near = params.compat == "reference" and not params.positive and params.crop_method in ("center", "random")
    return partial(_resampled, params=params, near=near)


def _resampled(img: np.ndarray, modality: str, spacing, src_dtype: str, params: Params, near: bool) -> np.ndarray:
    make = kernels.nearest_resampled if near and modality != "T2W" else kernels.spline_resampled
    return make(img, (spacing[1], spacing[0]), params.pixel_spacing, params.fill_of(src_dtype))


def named(cut: DataFrame, params: Params) -> DataFrame:
    """Crops with ``file``: case and study, then sequence, slice, ordinal, place and modality. Only tiles name the row first."""
    ordinal = None if params.crop_method == "center" else F.col("ordinal")
    a, b = ("row0", "col0") if params.crop_method == "stride" else ("col0", "row0")
    name = crops.crop_name(params.sequence_type, F.col("z"), F.col("n_slices"), ordinal, F.col(a), F.col(b), F.col("modality"))
    return cut.withColumn("file", F.concat("case_id", F.lit("_"), "study_id", F.lit("/"), name, F.lit(f".{params.file_type}")))


def run(spark: SparkSession, params: Params, images_at: dict[str, str], gland: str, lesion: str | None = None, out: str | None = None) -> DataFrame:
    """Crops of all cases as rows; with ``out``, as files below it, of which a row each is returned.

    ``images_at`` gives a path for each of the modalities that ``params`` wants.
    Only slices that have a window are resampled.
    """
    store = load(spark, params, images_at, gland, lesion)
    original = store.modalities(params.modalities)
    lists = patches.kept_lists(stored(patches.judged(masks(store, params), params), "windows"), params)
    sizes = store.role("T2W").groupBy("case_id").agg(F.min("study_id").alias("study_id"), F.max("n_slices").alias("n_slices"))
    cut = patches.cut_crops(lists.join(sizes, "case_id"), original, original, params, resampler(params), ("study_id", "n_slices"))
    cut = named(cut, params)
    if out is None:
        return cut
    if params.file_type == "parquet":
        cut.write.mode("overwrite").parquet(out)
        made = spark.read.parquet(out)
    else:
        made = crop_sink.write(cut, out, params.file_type)
    store.drop()
    return made
