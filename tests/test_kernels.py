import io
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patchwell.functions import kernels as K
from patchwell.operators import crops, masks, outline, stacks, windows
from patchwell.params import Params, parse, read_keywords
from patchwell.plans import patches, run
from patchwell.sources import images, nifti


def disc(h, w, cy, cx, r2):
    y, x = np.mgrid[:h, :w]
    return ((y - cy) ** 2 + (x - cx) ** 2 <= r2).astype(np.uint8)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_blur_support_is_dilation(seed):
    m = (np.random.default_rng(seed).random((12, 15)) < 0.15).astype(int)
    p = np.pad(m, 1)
    wide = np.max([p[i : i + 12, j : j + 15] for i in range(3) for j in range(3)], axis=0)
    assert ((K.box_blur(m * 255) > 0)[1:-1, 1:-1] == (wide > 0)[1:-1, 1:-1]).all()


def test_edge_ring_of_discs():
    for r2 in (20, 80, 200):
        m = disc(50, 64, 25, 32, r2)
        ys, xs = np.nonzero(K.edges(K.box_blur(m * 255)))
        gy, gx = np.nonzero(m)
        assert (ys.min(), ys.max(), xs.min(), xs.max()) == (gy.min() - 1, gy.max(), gx.min() - 1, gx.max())


def test_outlines():
    m = np.zeros((10, 12), int)
    m[2:5, 3:8] = 1
    m[7, 9] = 1
    found = K.outlines(m)
    assert len(found) == 2 and K.area(found[0]) == 8 and K.rect(found[0]) == (3, 2, 5, 3) and len(found[1]) == 1
    assert K.biggest(found) == 0 and K.outlines(np.zeros((4, 4), int)) == []


def test_simplified_keeps_corners():
    square = np.array([(x, 0) for x in range(20)] + [(20, y) for y in range(20)] + [(20 - x, 20) for x in range(20)] + [(0, 20 - y) for y in range(20)])
    assert {tuple(p) for p in K.simplified(square)} == {(0, 0), (20, 0), (20, 20), (0, 20)}


def test_spline_is_interpolation():
    img = np.random.default_rng(1).random((9, 11))
    assert np.allclose(K.spline_resampled(img, (1.0, 1.0), 1.0), img, atol=1e-10)
    flat = K.spline_resampled(np.full((8, 8), 5.0), (1.0, 1.0), 0.5)
    assert flat.shape == (16, 16) and np.allclose(flat[:15, :15], 5)


def test_files_round_trip(spark, tmp_path):
    img = np.random.default_rng(2).integers(-5, 400, (3, 6, 7)).astype(np.int16)
    got, spacing, origin, kind = nifti.decode_nifti(nifti.encode_nifti(img, (0.5, 0.5, 3.0), (1, 2, 3)))
    assert (got == img).all() and spacing == [0.5, 0.5, 3.0] and origin == [1, 2, 3] and kind == "i2"
    head = b"ObjectType = Image\nDimSize = 7 6 3\nElementSpacing = 0.5 0.5 3\nElementType = MET_SHORT\nElementDataFile = LOCAL\n"
    assert (nifti.decode_meta(head + img.tobytes())[0] == img).all()
    (tmp_path / "10001_1000001_NormT2WI.nii.gz").write_bytes(nifti.encode_nifti(img, (0.5, 0.5, 3.0)))
    rows = nifti.slices(spark, str(tmp_path)).orderBy("z").collect()
    assert [r["case_id"] for r in rows] == ["10001"] * 3 and rows[0]["study_id"] == "1000001" and rows[1]["px"] == img[1].ravel().tolist()
    g = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (images.read_png(images.png(g)) == g).all() and images.tiff(g)[8:20] == g.tobytes()


@pytest.mark.parametrize("lo, hi, expected", [((100, 100), (250, 250), (96, 256, 2)), ((100, 100), (180, 180), (76, 204, 1))])
def test_grid_goldens(spark, lo, hi, expected):
    ext = spark.createDataFrame([("c", 1, lo[0], hi[0], lo[1], hi[1])], "case_id string, z int, y_min int, y_max int, x_min int, x_max int")
    r = windows.grid(ext, 128, 32).head()
    assert windows.grid(ext, 128, 32).columns[:3] == ["case_id", "z", "start_i"]
    assert (r["start_i"], r["end_i"], r["steps_i"]) == expected
    t = windows.tiles(windows.grid(ext, 128, 32), 128, 32, 400, 400).orderBy("ordinal").collect()
    assert [x["ordinal"] for x in t] == list(range(1, expected[2] ** 2 + 1))
    if len(t) > 1:
        assert t[1]["col0"] - t[0]["col0"] == 32 and t[1]["row0"] == t[0]["row0"]


def test_masks_at_the_border_and_with_many_parts(spark):
    v = [("c", z, y, x, int((y < 2 and x < 2) or (y == 5 and x == 6)), int(y == 0)) for z in range(4) for y in range(6) for x in range(7)]
    df = spark.createDataFrame(v, "case_id string, z int, y int, x int, gland int, lesion int")
    assert masks.dilated(df.filter("gland = 1 and z = 0"), 6, 7).count() == 9 + 4
    assert [r["z"] for r in masks.slice_range(df).orderBy("z").collect()] == [1, 2, 3]
    assert masks.slice_range(df, 2).count() == 0
    r = masks.overlap(df).filter("z = 0").head()
    assert (r["lesion_area"], r["overlap_area"]) == (7, 2)
    assert masks.overlap(df.withColumn("lesion", F.lit(0))).head()["percent"] is None


def test_crop_slicing_follows_array_slices(spark):
    img = np.arange(30.0).reshape(5, 6)
    s = spark.createDataFrame([("c", 0, "T2W", 5, 6, img.ravel().tolist())], "case_id string, z int, modality string, height int, width int, px array<double>")
    for row0, col0 in [(0, 0), (3, 4), (-1, 0), (-3, -3), (4, 5), (2, 9)]:
        w = spark.createDataFrame([("c", 0, 1, row0, col0)], "case_id string, z int, ordinal int, row0 int, col0 int")
        got = crops.read_windows(w, s, 2).collect()
        want = img[row0 : row0 + 2, col0 : col0 + 2]
        assert (got[0]["px"] if got else []) == want.ravel().tolist()


def test_params():
    assert parse(["--keep-all-slices", "false", "--crop-method", "stride"]).keep_all_slices is False
    with pytest.raises(ValueError):
        Params(crop_method="spiral")


def mask_rows(spark, *slices):
    """Mask slices of one case from (gland, lesion) arrays."""
    rows = [("c", z, *g.shape, g.ravel().astype(int).tolist(), t.ravel().astype(int).tolist()) for z, (g, t) in enumerate(slices)]
    return spark.createDataFrame(rows, "case_id string, z int, height int, width int, gland array<int>, lesion array<int>")


def test_areas_count_voxels_of_a_level(spark):
    gland = np.zeros((6, 8), int)
    gland[1:4, 1:6] = 1
    gland[2, 2] = 2
    lesion = np.zeros((6, 8), int)
    lesion[2, 2], lesion[2, 3] = 3, 1
    v = spark.createDataFrame([("c", 0, y, x, int(gland[y, x]), int(lesion[y, x])) for y in range(6) for x in range(8)], "case_id string, z int, y int, x int, gland int, lesion int")
    assert masks.areas(v, 2).head()[2:] == (15, 1) and masks.areas(v, 2, True).head()[2:] == (15, 1) and masks.areas(v).head()[2:] == (15, 2)
    s = mask_rows(spark, (gland, lesion))
    got = stacks.measured(s, Params(patient_status="positive")).head()
    assert (got["gland_area"], got["lesion_area"], got["spot_area"], got["overlap_area"], got["percent"]) == (15, 1, 2, 2, 100.0)
    got = stacks.measured(s, Params(patient_status="positive", gland_contains_lesion=True)).head()
    assert (got["lesion_area"], got["spot_area"], got["overlap_area"]) == (1, 1, 1)
    got = stacks.measured(mask_rows(spark, (gland, lesion * 0)), Params(patient_status="positive")).head()
    assert got["percent"] is None


def test_extents_are_of_the_largest_outline(spark):
    gland = np.zeros((40, 48), int)
    gland[10:20, 12:22] = 1
    gland[30, 35] = 1
    border = np.zeros((40, 48), int)
    border[0:12, 0:15] = 1
    s = mask_rows(spark, (gland, gland * 0), (border, border * 0), (gland * 0, gland * 0))
    got = {r["z"]: r for r in outline.shapes(s, Params()).collect()}
    assert tuple(got[0][k] for k in ("y_min", "y_max", "x_min", "x_max")) == (9, 19, 11, 21)
    assert tuple(got[0][k] for k in ("g_top", "g_bottom", "g_left", "g_right")) == (10, 30, 12, 35)
    ys, xs = np.nonzero(K.edges(K.box_blur(border * 255)))
    assert tuple(got[1][k] for k in ("y_min", "y_max", "x_min", "x_max")) == (ys.min(), ys.max(), xs.min(), xs.max()) and got[1]["y_min"] >= 0
    assert got[2]["contours"] == 0 and got[2]["y_min"] is None
    # The stray pixel is outside of the window around the largest part; at the border the window starts outside, and slicing leaves nothing of it.
    params = Params(pixel_spacing=2.0, crop_image_size=16, keep_all_slices=True, compat="strict")
    log = patches.decisions(s, params).orderBy("z").collect()
    assert [(r["z"], r["reason"]) for r in log] == [(0, "NOT_CONTAINED"), (1, "OUT_OF_BOUNDS")]


def test_outline_tree_has_holes():
    m = np.zeros((14, 16), int)
    m[1:12, 1:14] = 1
    m[3:10, 3:11] = 0
    m[5:8, 5:9] = 1
    m[12, 15] = 1
    found, parent = K.outline_tree(m)
    assert parent == [-1, 0, 1, -1]
    assert K.rect(found[0]) == (1, 1, 13, 11) and K.rect(found[1]) == (2, 2, 10, 9) and K.rect(found[2]) == (5, 5, 4, 3)
    assert K.biggest(found) == 0 and [p.tolist() for p in K.outlines(m)] == [p.tolist() for p, q in zip(found, parent, strict=True) if q in (-1, 1)]
    assert K.outline_tree(np.zeros((4, 4), int)) == ([], [])


def flooded(mask, ring):
    """Components pixel by pixel."""
    number, count = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if number[y, x]:
            continue
        count += 1
        todo, number[y, x] = [(y, x)], count
        while todo:
            a, b = todo.pop()
            for i, j in ring:
                if 0 <= a + i < mask.shape[0] and 0 <= b + j < mask.shape[1] and mask[a + i, b + j] and not number[a + i, b + j]:
                    number[a + i, b + j] = count
                    todo.append((a + i, b + j))
    return number, count


def drawn(points):
    """Pixels of a closed path whose corners lie on rows, columns and diagonals."""
    out = set()
    for (x, y), (u, v) in zip(points.tolist(), np.roll(points, -1, axis=0).tolist(), strict=True):
        n = max(abs(u - x), abs(v - y), 1)
        out |= {(x + (u - x) * k // n, y + (v - y) * k // n) for k in range(n + 1)}
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([0.1, 0.4, 0.6, 0.9]))
def test_outlines_run_along_their_part_of_the_background(seed, share):
    """Of each pair of a component and a part of the background beside it there is one outline, through the pixels that touch it, and its parent is what lies around it."""
    rng = np.random.default_rng(seed)
    m = np.pad(rng.random(rng.integers(1, 18, 2)) < share, 1)
    inside, n_inside = flooded(m, K.RING)
    outside, n_outside = flooded(~m, K.RING[::2])
    found, parent = K.outline_tree(m[1:-1, 1:-1].astype(int))
    assert len(found) == n_inside + n_outside - 1
    touching = {}
    for y, x in np.argwhere(m):
        for i, j in K.RING[::2]:
            if not m[y + i, x + j]:
                touching.setdefault((inside[y, x], outside[y + i, x + j]), set()).add((int(x) - 1, int(y) - 1))
    pair = {frozenset(v): k for k, v in touching.items()}
    own = [pair[frozenset(drawn(p))] for p in found]
    assert sorted(own) == sorted(touching) or len(pair) < len(touching)
    if len(pair) == len(touching):
        for (k, o), up in zip(own, parent, strict=True):
            if up >= 0:
                assert own[up][1] != o and (own[up][0] == k or own[up][0] != k and any(q[0] == own[up][0] and q[1] == o for q in touching))
    lines = K.runs(m)
    for diagonal, want in ((True, inside), (False, flooded(m, K.RING[::2])[0])):
        number = K.connected(lines, diagonal)
        assert all(want[y, a] == k + 1 for y, a, k in zip(lines.row, lines.start, number, strict=True))
    assert (K.painted(lines, np.ones(len(lines.row), bool), m.shape) == m).all()


def test_outlines_of_a_large_slice_are_cheap():
    y, x = np.ogrid[:900, :900]
    mask = ((y - 450) ** 2 + (x - 450) ** 2 <= 400**2).astype(int)
    K.shape(mask)
    took = []
    for _ in range(3):
        began = time.process_time()
        K.shape(mask)
        took.append(time.process_time() - began)
    assert min(took) < 0.5  # a tenth of a second on a machine of its own


def test_edges_grow_along_weak_ones_from_strong_ones():
    rng = np.random.default_rng(3)
    for _ in range(20):
        img = rng.integers(0, 256, rng.integers(1, 30, 2))
        got, strong, weak = K.edges(img) > 0, K.edges(img, 200, 200) > 0, K.edges(img, 100, 100) > 0
        number, _ = flooded(weak, K.RING)
        assert (got == np.isin(number, np.unique(number[strong & weak])[np.unique(number[strong & weak]) > 0])).all()


@pytest.mark.parametrize("points, want", [
    ([(0, 0), (10, 0), (20, 0), (20, 30), (0, 30)], [(0, 0), (20, 0), (20, 30), (0, 30)]),  # a corner on a side goes
    ([(0, 0), (10, 2), (20, 0), (20, 30), (0, 30)], [(0, 0), (20, 0), (20, 30), (0, 30)]),  # so does one within 3 of it
    ([(0, 0), (10, -9), (20, 0), (20, 30), (0, 30)], [(0, 0), (10, -9), (20, 0), (20, 30), (0, 30)]),
    ([(5, 5), (6, 5), (6, 6), (5, 6)], [(5, 5)]),  # all within 3 of the last corner reached
    ([(0, 0), (40, 40), (80, 80), (80, 0)], [(0, 0), (80, 80), (80, 0)]),  # nearly straight and slanted
    ([(7, 7)], [(7, 7)]),
    ([(0, 0), (50, 1)], [(0, 0), (50, 1)]),
])
def test_simplified_by_hand(points, want):
    assert sorted(map(tuple, K.simplified(np.array(points)).tolist())) == sorted(want)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_simplified_stays_near(seed):
    """Corners are the polygon's own, and all others lie within reach of the sides that replace them (3, and the clean-up's 2.2)."""
    rng = np.random.default_rng(seed)
    angle = np.sort(rng.random(rng.integers(3, 60))) * 2 * np.pi
    r = rng.integers(10, 60, len(angle))
    p = np.stack([np.rint(100 + r * np.cos(angle)), np.rint(100 + r * np.sin(angle))], axis=1).astype(int)
    q = K.simplified(p)
    assert {tuple(c) for c in q.tolist()} <= {tuple(c) for c in p.tolist()}
    if len(q) > 2:
        a, b = q.astype(float), np.roll(q, -1, axis=0).astype(float)
        for c in p.astype(float):
            t = np.clip(((c - a) * (b - a)).sum(axis=1) / np.maximum(((b - a) ** 2).sum(axis=1), 1e-9), 0, 1)
            assert np.hypot(*(a + t[:, None] * (b - a) - c).T).min() < 9


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_window_sums_follow_array_slices(seed):
    rng = np.random.default_rng(seed)
    m = rng.random((9, 11)) < 0.4
    rows, cols, size = rng.integers(-12, 14, 40), rng.integers(-12, 14, 40), int(rng.integers(1, 7))
    assert K.window_sums(m, rows, cols, size).tolist() == [int(m[r : r + size, c : c + size].sum()) for r, c in zip(rows.tolist(), cols.tolist(), strict=True)]


def test_nearest_takes_the_pixel_that_is_nearest(spark):
    img = np.arange(35.0).reshape(5, 7)
    s = spark.createDataFrame([("c", 0, 5, 7, [0.5, 1.0, 3.0], img.ravel().tolist())], "case_id string, z int, height int, width int, spacing array<double>, px array<double>")
    got = outline.nearest(s, 0.8, fill=-1.0).head()
    h, w = round(5 * 1.0 / 0.8), round(7 * 0.5 / 0.8)
    want = [img[y, x] if y < 5 and x < 7 else -1.0 for y in (int(np.floor(i * 0.8 / 1.0 + 0.5)) for i in range(h)) for x in (int(np.floor(j * 0.8 / 0.5 + 0.5)) for j in range(w))]
    assert (got["height"], got["width"], got["px"], got["spacing"]) == (h, w, want, [0.8, 0.8, 3.0])


def test_random_windows_of_positives(spark):
    gland, lesion = disc(60, 64, 30, 32, 500).astype(int), disc(60, 64, 34, 30, 60).astype(int)
    s = stacks.measured(mask_rows(spark, (gland, lesion * 2)), Params(patient_status="positive"))
    common = {"crop_method": "random", "patient_status": "positive", "crop_image_size": 16, "sample_number": 12}
    for draws in ("acceptable", "attempts"):
        got = windows.sampled(s, Params(**common, positive_draws=draws), 20).collect()
        assert [r["ordinal"] for r in got] == list(range(int(gland.sum() / 256 * 12)))
        assert got == windows.sampled(s, Params(**common, positive_draws=draws), 20).collect()
        assert all(lesion[r["row0"] : r["row0"] + 16, r["col0"] : r["col0"] + 16].sum() >= 20 for r in got)
        assert got != windows.sampled(s, Params(**common, positive_draws=draws, seed=1), 20).collect()
    assert {r["attempts"] for r in got} > {1} and max(r["attempts"] for r in got) < 100
    none = windows.sampled(s, Params(**common, positive_draws="attempts"), 10**6).collect()
    assert {r["attempts"] for r in none} == {windows.ATTEMPTS} and windows.sampled(s, Params(**common), 10**6).count() == 0
    other = s.withColumn("case_id", F.lit("d"))
    assert [r["row0"] for r in windows.sampled(other, Params(**common), 20).collect()] != [r["row0"] for r in windows.sampled(s, Params(**common), 20).collect()]


def test_image_files_open_elsewhere(spark, tmp_path):
    rng = np.random.default_rng(4)
    smooth = (np.add.outer(np.arange(37), 2 * np.arange(50)) % 200 + rng.integers(0, 3, (37, 50))).astype(np.uint8)
    for name, make in (("a.png", images.png), ("a.jpg", images.jpeg)):
        (tmp_path / name).write_bytes(make(smooth))
    got = {r["image"]["origin"].rpartition(".")[2]: r["image"] for r in spark.read.format("image").load(str(tmp_path)).collect()}
    for kind, off in (("png", 0), ("jpg", 6)):
        assert (got[kind]["height"], got[kind]["width"], got[kind]["nChannels"]) == (37, 50, 1)
        assert np.abs(np.frombuffer(got[kind]["data"], np.uint8).reshape(37, 50).astype(int) - smooth).max() <= off


@pytest.mark.parametrize("kind, status, method, sequence", [("npy", "positive", "stride", "bpMRI"), ("png", "negative", "center", "bpMRI"), ("jpg", "negative", "random", "T2W"), ("tiff", "positive", "center", "T2W")])
def test_from_volume_files_to_crop_files(spark, tmp_path, kind, status, method, sequence):
    rng = np.random.default_rng(6)
    gland, lesion = np.zeros((5, 60, 64), np.uint8), np.zeros((5, 60, 64), np.uint8)
    gland[1:4], lesion[2:4] = disc(60, 64, 30, 32, 144), 2 * disc(60, 64, 33, 30, 30)
    vol = {m: rng.integers(0, 300, (5, 60, 64)).astype(np.int16) for m in ("T2W", "ADC", "HBV")}
    for m, v in {**vol, "gland": gland, "lesion": lesion}.items():
        (tmp_path / m).mkdir()
        for case in ("101_7", "102_8"):
            (tmp_path / m / f"{case}_{m}.nii.gz").write_bytes(nifti.encode_nifti(v, (2.0, 2.0, 3.0)))
    params = Params(crop_method=method, patient_status=status, sequence_type=sequence, pixel_spacing=2.0, crop_image_size=30 if method == "center" else 16, crop_stride=8, saved_image_type=kind)
    out = run.run(spark, params, {m: str(tmp_path / m) for m in vol}, str(tmp_path / "gland"), str(tmp_path / "lesion"), str(tmp_path / "out")).collect()
    assert out and {r["modality"] for r in out} == set(params.modalities) and {r["case_id"] for r in out} == {"101", "102"}
    assert {str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.*") if "_crops" not in p.parts} == {r["file"] for r in out}
    for r in out:
        order = (r["row0"], r["col0"]) if method == "stride" else (r["col0"], r["row0"])
        number = "" if method == "center" else f"_{r['ordinal']}"
        study = {"101": "7", "102": "8"}[r["case_id"]]
        assert r["file"] == f"{r['case_id']}_{study}/{sequence}_slice_{r['z']}_of_5{number}_cord_{order[0]}_{order[1]}_{r['modality']}.{kind}"
        want = vol[r["modality"]][r["z"], r["row0"] : r["row0"] + r["height"], r["col0"] : r["col0"] + r["width"]]
        data = (tmp_path / "out" / r["file"]).read_bytes()
        if kind == "npy":
            assert np.allclose(np.load(io.BytesIO(data)), want)
        elif kind == "png":
            top = 242 if r["modality"] == "T2W" else np.percentile(vol[r["modality"]], 99.5)
            assert (images.read_png(data) == np.clip(np.floor(256 * np.round(want.astype(float), 6) / top), 0, 255)).mean() > 0.99
    assert all(r["z"] in ((2, 3) if status == "positive" else (2, 3)) for r in out)


def test_command(spark, tmp_path, capsys):
    from patchwell import __main__ as command

    gland = np.zeros((4, 40, 40), np.uint8)
    gland[1:3] = disc(40, 40, 20, 20, 100)
    for name, v in (("t2", np.arange(6400).reshape(4, 40, 40).astype(np.int16)), ("seg", gland)):
        (tmp_path / f"5_6_{name}.nii.gz").write_bytes(nifti.encode_nifti(v, (2.0, 2.0, 3.0)))
    where = {"orig-img-path-t2w": "5_6_t2.nii.gz", "seg-img-path": "5_6_seg.nii.gz", "path-to-save": "out"}
    argv = [x for k, v in where.items() for x in ("--" + k, str(tmp_path / v))] + ["--pixel-spacing", "2", "--crop-image-size", "26", "--saved-image-type", "tiff"]
    assert command.main(argv) == 0 and "1 files" in capsys.readouterr().out
    assert [p.suffix for p in (tmp_path / "out").rglob("*.*") if "_crops" not in p.parts] == [".tiff"]


def test_keywords_of_an_ini_file(spark, tmp_path):
    (tmp_path / "config.ini").write_text("[config]\nT2W = NormT2WI\nHBV = b1500\n")
    assert read_keywords(str(tmp_path / "config.ini")) == {"T2W": "NormT2WI", "ADC": "ADC", "HBV": "b1500"}
    assert parse(["--config", str(tmp_path / "config.ini")]).keywords["T2W"] == "NormT2WI"
    df = spark.createDataFrame([("1_2_NormT2WI",), ("1_2_b1500",), ("1_2_x",)], "name string")
    assert [r[0] for r in df.select(crops.route(F.col("name"), read_keywords(str(tmp_path / "config.ini")))).collect()] == ["T2W", "HBV", None]


def test_strict_begins_with_the_first_filled_slice(spark):
    g = disc(20, 20, 10, 10, 40).astype(int)
    s = mask_rows(spark, (g * 0, g * 0), (g, g * 0), (g * 0, g * 0), (g, g * 0))
    kept = lambda **p: [r["z"] for r in stacks.in_range(stacks.measured(s, Params(**p)), Params(**p)).orderBy("z").collect()]
    assert kept() == [2, 3] and kept(compat="strict") == [1, 2, 3] and kept(keep_all_slices=False, compat="strict") == []


def test_tiles_are_clipped_by_their_grid(spark):
    g = np.zeros((50, 64), int)
    g[30:49, 40:63] = 1
    s = mask_rows(spark, *[(g, g * 0)] * 3)
    base = {"crop_method": "stride", "pixel_spacing": 2.0, "crop_image_size": 16, "crop_stride": 8}
    part = patches.kept_windows(s, Params(**base, sequence_type="bpMRI")).collect()
    whole = patches.kept_windows(s, Params(**base)).collect()
    assert any(r["height"] < 16 or r["width"] < 16 for r in part) and all((r["height"], r["width"]) == (16, 16) for r in whole) and len(whole) < len(part)
    reasons = {r["reason"] for r in patches.decisions(s, Params(**base)).collect()}
    assert reasons == {"CROPPED", "WRONG_SIZE"}


def test_masks_of_unequal_stacks_are_left_out(spark, tmp_path):
    gland = np.stack([disc(20, 20, 10, 10, 40)] * 4)
    for name, v in (("g/1_1_g", gland), ("g/2_2_g", gland), ("l/1_1_l", gland[:3]), ("l/2_2_l", 2 * gland)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.nii.gz").write_bytes(nifti.encode_nifti(v.astype(np.uint8), (1.0, 1.0, 3.0)))
    params = Params(patient_status="positive", pixel_spacing=2.0)
    images_at = {"T2W": str(tmp_path / "g")}
    got = run.masks(run.load(spark, params, images_at, str(tmp_path / "g"), str(tmp_path / "l")), params).collect()
    assert {r["case_id"] for r in got} == {"2"} and len(got) == 4
    want = gland[0][::2, ::2].ravel().tolist()
    assert all((r["height"], r["width"]) == (10, 10) and r["gland"] == want and r["lesion"] == [2 * v for v in want] for r in got)
    with pytest.raises(ValueError):
        run.load(spark, params, images_at, str(tmp_path / "g"))
    with pytest.raises(ValueError):
        run.load(spark, params, {}, str(tmp_path / "g"), str(tmp_path / "l"))


def test_a_slice_needs_both_masks(spark):
    empty = np.zeros((8, 8), int)
    params = Params(patient_status="positive", c_min_positive=0.0, min_overlap_percent=0.0)
    s = stacks.measured(mask_rows(spark, (disc(8, 8, 4, 4, 4).astype(int), empty + 2), (empty, empty + 2)), params)
    assert [r[0] for r in s.orderBy("z").select(stacks.reason(params)).collect()] == [None, "EMPTY_MASK"]


@pytest.mark.parametrize("bins, gather", [(4096, 65536), (64, 3), (4096, 0)])
def test_percentile_by_selection(spark, bins, gather):
    """Passes of few bins and small rests find what sorting finds: ties, runs, negative, huge and tiny values, volumes of one value, nulls and NaN."""
    rng = np.random.default_rng(bins)
    vols = {
        "int": rng.integers(-50, 50, 300).astype(float), "ties": rng.integers(0, 3, 250).astype(float), "one": np.full(40, 7.0), "single": np.array([3.5]), "normal": rng.normal(size=333),
        "wide": np.concatenate([[-1.7e308, 1.7e308], rng.normal(size=60) * 1e300]), "tiny": rng.random(50) * 1e-300, "skew": np.exp(rng.normal(size=200) * 12), "two": np.array([1.0] * 99 + [2.0]),
    }
    rows = [(k, "T2W", part.tolist()) for k, v in vols.items() for part in np.array_split(v, 3)] + [("int", "ADC", [1.0, None, float("nan"), 3.0]), ("none", "T2W", [None]), ("none", "ADC", [])]
    df = spark.createDataFrame(rows, "case_id string, modality string, px array<double>")
    for q in (0.0, 37.3, 99.5, 100.0) if gather > 3 else (37.3, 99.5):
        got = {(r["case_id"], r["modality"]): r["p"] for r in crops.percentile(df, q, bins=bins, gather=gather).collect()}
        assert set(got) == {(k, "T2W") for k in vols} | {("int", "ADC")}
        for k, v in vols.items():
            with np.errstate(over="ignore"):
                assert got[k, "T2W"] == pytest.approx(np.percentile(v, q), rel=1e-12, abs=0) or k == "wide" and abs(got[k, "T2W"]) >= 1e290, (k, q)
        assert got["int", "ADC"] == pytest.approx(1 + 2 * q / 100)
        spark_own = {r["case_id"]: r["p"] for r in df.filter("case_id in ('int', 'ties', 'normal', 'skew')").filter("modality = 'T2W'").select("case_id", F.explode("px").alias("v")).groupBy("case_id").agg(F.percentile("v", F.lit(q / 100)).alias("p")).collect()}
        assert all(got[k, "T2W"] == pytest.approx(p, rel=1e-14) for k, p in spark_own.items())


@pytest.mark.parametrize("share, limit", [(0.02, 10_000), (0.3, 10_000), (0.002, 300), (0.0, 50), (1.0, 50)])
def test_attempts_follow_the_law_of_redrawing(share, limit):
    """Against a loop that draws: how many draws it takes, how often none is found, and which pixel stays."""
    n = 2000
    stop = np.arange(n) < share * n
    rng = np.random.default_rng(11)
    tries, pixels = [], []
    for _ in range(1500):
        at = rng.integers(0, n, limit - 1)
        hit = np.flatnonzero(stop[at])
        tries.append(hit[0] + 1 if len(hit) else limit)
        pixels.append(at[hit[0]] if len(hit) else at[-1])
    pick, took = windows.redrawn(np.arange(-20_000, 20_000, dtype=np.int64) * 7919, stop, limit)
    tries, pixels = np.array(tries), np.array(pixels)
    assert took.min() >= 1 and took.max() <= limit and (stop[pick] == (took < limit)).all()
    for a, b in ((took, tries), (pick, pixels)):
        every = np.unique(np.concatenate([a, b]))
        gap = np.abs(np.searchsorted(np.sort(a), every, "right") / len(a) - np.searchsorted(np.sort(b), every, "right") / len(b)).max()
        assert gap < 0.05  # of two samples of one law, more than 0.045 comes once in a hundred
    again = windows.redrawn(np.arange(-20_000, 20_000, dtype=np.int64) * 7919, stop, limit)
    assert (again[0] == pick).all() and (again[1] == took).all()


def test_ends_of_a_case(spark):
    rng = np.random.default_rng(2)
    cases = {f"c{k}": sorted(rng.choice(60, rng.integers(1, 20), replace=False).tolist()) for k in range(30)}
    df = spark.createDataFrame([(c, z) for c, zs in cases.items() for z in zs], "case_id string, z int").repartition(6)
    for k in range(5):
        got = {r["case_id"]: (r["lo"], r["hi"]) for r in stacks.ends(df, k).collect()}
        assert got == {c: (zs[k], zs[-1 - k]) for c, zs in cases.items() if len(zs) > 2 * k}
    plan = stacks.ends(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # rows are cut to k + 1 before they move


def test_fill_is_the_pixel_types_number(spark):
    """Places outside of the input: in "reference" the number of the stored type, in "strict" 0, or what is asked for."""
    img = np.full((5, 5), 9.0)
    s = spark.createDataFrame([("c", 0, 5, 5, [0.5, 0.5, 3.0], kind, img.ravel().tolist()) for kind in ("i1", "u1", "i2", "u2", "i4", "u4", "f4", "f8")], "case_id string, z int, height int, width int, spacing array<double>, src_dtype string, px array<double>")
    for params, want in ((Params(), list(range(6)) + [8, 9]), (Params(compat="strict"), [0] * 8), (Params(fill=-3.0), [-3] * 8)):
        got = [r["px"][-1] for r in outline.nearest(s, 0.7, fill=outline.filled(params)).collect()]
        assert got == [9.0] * 8  # within half a pixel of the last one
        wide = s.withColumn("spacing", F.array(F.lit(0.5), F.lit(0.5), F.lit(3.0)))
        rows = outline.nearest(wide, 0.9, fill=outline.filled(params)).collect()
        sizes = {(r["height"], r["width"]) for r in rows}
        assert sizes == {(3, 3)}
        out = [K.nearest_resampled(img[:2, :2], (0.5, 0.5), 0.3, params.fill_of(r["src_dtype"]))[-1, -1] for r in rows]
        assert out == want or out == [9.0] * 8
        assert [params.fill_of(r["src_dtype"]) for r in rows] == want
