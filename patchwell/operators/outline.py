"""Slice kernels: a slice is one row, so nothing is shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.numeric import resized, source_index
from ..params import PIXEL_TYPES, Params
from .masks import SLICE


def outlines(masks: DataFrame) -> DataFrame:
    """Outlines of each mask slice (``case_id, z, height, width, px``): blur, edges, borders.

    ``contour`` counts from 0 in scan order and ``parent`` is the one around it
    (-1: none), holes having outlines of their own (``hole``); ``biggest`` marks the
    one of the largest area; ``x, y, w, h`` is the rectangle around its simplified polygon.
    """

    def run(batches):
        for pdf in batches:
            for case, z, h, w, px in zip(*(pdf[c] for c in ("case_id", "z", "height", "width", "px")), strict=True):
                drawn, dy, dx = kernels.mask_edges(np.asarray(px, float).astype(int).reshape(h, w))
                found, parent = kernels.outline_tree(drawn)
                if not found:
                    continue
                found = [p + (dx, dy) for p in found]
                top = kernels.biggest(found)
                hole: list[bool] = []
                for up in parent:  # parents come first: what lies in a part is a hole, what lies in a hole is a part
                    hole.append(up >= 0 and not hole[up])
                rows = [(case, z, i, parent[i], hole[i], len(p), kernels.area(p), i == top, *kernels.rect(kernels.simplified(p)), p.ravel().tolist()) for i, p in enumerate(found)]
                yield pd.DataFrame(rows, columns=["case_id", "z", "contour", "parent", "hole", "n_points", "area", "biggest", "x", "y", "w", "h", "points"])

    cols = masks.select("case_id", "z", "height", "width", "px")
    return cols.mapInPandas(run, "case_id string, z int, contour int, parent int, hole boolean, n_points int, area double, biggest boolean, x int, y int, w int, h int, points array<int>")


def edge_pixels(masks: DataFrame) -> DataFrame:
    """Edge pixels of each mask slice (``case_id, z, height, width, px``)."""

    def run(batches):
        for pdf in batches:
            for case, z, h, w, px in zip(*(pdf[c] for c in ("case_id", "z", "height", "width", "px")), strict=True):
                drawn, dy, dx = kernels.mask_edges(np.asarray(px, float).astype(int).reshape(h, w))
                y, x = np.nonzero(drawn)
                yield pd.DataFrame({"case_id": case, "z": z, "y": y + dy, "x": x + dx})

    return masks.select("case_id", "z", "height", "width", "px").mapInPandas(run, "case_id string, z int, y int, x int")


def components(masks: DataFrame) -> DataFrame:
    """Connected parts of each mask slice (``case_id, z, height, width, px``): of its pixels (``filled``; 8 neighbours) and of what they leave (4), numbered from 0 in scan order, with area and extents."""

    def run(batches):
        for pdf in batches:
            out = []
            for case, z, h, w, px in zip(*(pdf[c] for c in ("case_id", "z", "height", "width", "px")), strict=True):
                m = np.asarray(px).reshape(h, w) != 0
                for filled in (True, False):
                    lines = kernels.runs(m if filled else ~m)
                    number = kernels.connected(lines, diagonal=filled)
                    n = int(number.max(initial=-1)) + 1
                    least = {k: np.full(n, max(h, w)) for k in ("y", "x")}
                    most, area = {k: np.zeros(n, int) for k in ("y", "x")}, np.zeros(n, int)
                    np.add.at(area, number, lines.end - lines.start)
                    for k, a, b in (("y", lines.row, lines.row), ("x", lines.start, lines.end - 1)):
                        np.minimum.at(least[k], number, a)
                        np.maximum.at(most[k], number, b)
                    out.append(pd.DataFrame({"case_id": case, "z": z, "filled": filled, "component": np.arange(n), "area": area, "y_min": least["y"], "y_max": most["y"], "x_min": least["x"], "x_max": most["x"]}))
            if out:
                yield pd.concat(out)

    cols = masks.select("case_id", "z", "height", "width", "px")
    return cols.mapInPandas(run, "case_id string, z int, filled boolean, component long, area long, y_min int, y_max int, x_min int, x_max int")


def at_spacing(slices: DataFrame, params: Params) -> DataFrame:
    """Mask slices at the spacing that is asked for, by the nearest pixel: ``gland`` and ``lesion`` (zeros where there is none) as arrays of labels.

    Each mask comes with its own ``height, width, spacing, src_dtype`` (of lesions
    with ``l_`` before them), so both are read, joined within their buckets, and
    resampled in one pass.
    """
    both = "lesion" in slices.columns
    own = [c for c in slices.columns if c in (*SLICE, "block", "n_slices")]
    target = params.pixel_spacing

    def run(batches):
        for b in batches:
            heads = b.select([c for c in b.schema.names if c not in ("gland", "lesion")]).to_pylist()

            def made(i, mask, p):
                r, px = heads[i], b.column(mask)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023
                img = px.astype(float).reshape(r[p + "height"], r[p + "width"])
                return kernels.nearest_resampled(img, (r[p + "spacing"][1], r[p + "spacing"][0]), target, params.fill_of(r[p + "src_dtype"])).astype(np.int32)

            gland = [made(i, "gland", "") for i in range(len(heads))]
            lesion = [made(i, "lesion", "l_") for i in range(len(heads))] if both else [np.zeros_like(g) for g in gland]
            lists = [pa.ListArray.from_arrays(np.cumsum([0, *(g.size for g in some)], dtype=np.int32), np.concatenate([g.ravel() for g in some] or [np.zeros(0, np.int32)])) for some in (gland, lesion)]
            sizes = [pa.array([g.shape[k] for g in gland], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *sizes, *lists], names=[*own, "height", "width", "gland", "lesion"])

    schema = ", ".join([f"{c} {slices.schema[c].dataType.simpleString()}" for c in own] + ["height int", "width int", "gland array<int>", "lesion array<int>"])
    return slices.mapInArrow(run, schema)


def shapes(slices: DataFrame, params: Params, arrays: bool = True) -> DataFrame:
    """Mask slices with what windows are placed by.

    ``contours`` counts the outlines of the gland's edges (0: none, the rest is
    null); ``y_min`` to ``x_max`` are the extents of the largest outline, ``box_*``
    the rectangle around it simplified; ``g_*`` are the extents of all gland pixels.
    Slices with a ``slice_reason`` are not followed. Without ``arrays`` the labels
    stay behind, where nothing reads them any more.
    """
    names = ["contours", "y_min", "y_max", "x_min", "x_max", "box_x", "box_y", "box_w", "box_h", "g_top", "g_bottom", "g_left", "g_right"]
    binary = params.positive and params.gland_contains_lesion

    def run(batches):
        for pdf in batches:
            rows = []
            failed = pdf["slice_reason"].notna() if "slice_reason" in pdf else [False] * len(pdf)
            for px, h, w, out in zip(pdf["gland"], pdf["height"], pdf["width"], failed, strict=True):
                m = np.asarray(px, int).reshape(h, w)
                got = None if out else kernels.shape((m > 0).astype(int) if binary else m)
                y, x = np.nonzero(m >= 1)
                if got is None or not len(y):
                    rows.append((0, *[None] * 12))
                else:
                    rows.append((got[0], *got[1], *got[2], y.min(), y.max(), x.min(), x.max()))
            # Nullable numbers, as a slice without an outline has none.
            yield pd.concat([pdf[stay], pd.DataFrame(rows, columns=names, dtype="Int32")], axis=1)

    unread = [] if arrays else ["lesion"]
    keep = slices.select(*[c for c in slices.columns if c not in (*names, *unread)])
    stay = [c for c in keep.columns if arrays or c != "gland"]
    schema = ", ".join([f"`{c}` {keep.schema[c].dataType.simpleString()}" for c in stay] + [f"{n} int" for n in names])
    return keep.mapInPandas(run, schema)


def nearest(slices: DataFrame, target: float, columns: tuple[str, ...] = ("px",), fill: float | Column = 0.0) -> DataFrame:
    """Slices with ``spacing`` (x, y, z) resampled in-plane by the nearest pixel; what lies outside gets ``fill``. Array expressions alone."""
    fill = fill if isinstance(fill, Column) else F.lit(fill)
    sx, sy = F.col("spacing")[0], F.col("spacing")[1]
    t = F.lit(float(target))
    h, w = resized(F.col("height"), sy, t), resized(F.col("width"), sx, t)
    at = lambda c: F.flatten(F.transform(F.sequence(F.lit(0), h - 1), lambda y: F.transform(F.sequence(F.lit(0), w - 1), lambda x: _pixel(c, source_index(y, sy, t), source_index(x, sx, t), fill))))
    both = slices.withColumns({**{c: at(c) for c in columns}, "new_h": h, "new_w": w})
    return both.withColumns({"height": F.col("new_h"), "width": F.col("new_w"), "spacing": F.array(t, t, F.col("spacing")[2])}).drop("new_h", "new_w")


def filled(params: Params) -> Column:
    """What lies outside of a slice, by its ``src_dtype``."""
    if params.fill is not None or params.compat != "reference":
        return F.lit(params.fill or 0.0)
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in PIXEL_TYPES.items() for x in (k, float(v))])[F.col("src_dtype")], F.lit(0.0))


def _pixel(column: str, y, x, fill: Column):
    inside = (y < F.col("height")) & (x < F.col("width"))
    return F.coalesce(F.try_element_at(F.col(column), F.when(inside, y * F.col("width") + x + 1)), fill.cast("double"))


def spline(slices: DataFrame, target: float, fill: float = 0.0) -> DataFrame:
    """Slices (``case_id, z, modality, spacing, height, width, px``) resampled in-plane by cubic splines; z stays, so slices do not need each other."""

    def run(batches):
        for pdf in batches:
            out = [kernels.spline_resampled(np.asarray(p, float).reshape(h, w), (s[1], s[0]), target, fill) for p, h, w, s in zip(pdf["px"], pdf["height"], pdf["width"], pdf["spacing"], strict=True)]
            yield pdf[[*SLICE, "modality"]].assign(height=[o.shape[0] for o in out], width=[o.shape[1] for o in out], px=[o.ravel() for o in out])

    cols = slices.select(*SLICE, "modality", "spacing", "height", "width", "px")
    return cols.mapInPandas(run, "case_id string, z int, modality string, height int, width int, px array<double>")
