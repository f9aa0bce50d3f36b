"""The splittable volume source, the slice store and the crop sink."""

import gzip
import re
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from patchwell.params import Params
from patchwell.plans import patches, run
from patchwell.sources import crop_sink, nifti, volumes
from patchwell.sources.slice_store import SliceStore


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def meta(name, v, kind, more="", file=None):
    return f"ObjectType = Image\nNDims = 3\nDimSize = {v.shape[2]} {v.shape[1]} {v.shape[0]}\nElementSpacing = 0.5 0.75 3\nOffset = 1 2 3\nElementType = {kind}\n{more}ElementDataFile = {file or name}\n".encode()


@pytest.fixture
def volume(tmp_path):
    """One volume in every form that a volume comes in."""
    v = np.random.default_rng(8).integers(-300, 300, (70, 9, 11)).astype(np.int16)
    at = tmp_path / "v"
    at.mkdir()
    packed = nifti.encode_nifti(v, (0.5, 0.75, 3.0), (1, 2, 3))
    (at / "1_a_x.nii.gz").write_bytes(packed)
    (at / "2_a_x.nii").write_bytes(gzip.decompress(packed))
    (at / "3_a_x.mhd").write_bytes(meta("3_a_x.raw", v, "MET_SHORT"))
    (at / "3_a_x.raw").write_bytes(v.tobytes())
    (at / "4_a_x.mha").write_bytes(meta("LOCAL", v, "MET_SHORT") + v.tobytes())
    body = zlib.compress(v.tobytes())
    (at / "5_a_x.mhd").write_bytes(meta("5_a_x.zraw", v, "MET_SHORT", "CompressedData = True\n"))
    (at / "5_a_x.zraw").write_bytes(body)
    (at / "6_a_x.mhd").write_bytes(meta("6_a_x.raw", v, "MET_SHORT", "BinaryDataByteOrderMSB = True\nHeaderSize = -1\n"))
    (at / "6_a_x.raw").write_bytes(b"header" + v.astype(">i2").tobytes())
    (at / "notes.txt").write_text("no volume")
    return v, at


def test_every_form_gives_the_same_slices(spark, volume):
    v, at = volume
    rows = volumes.slices(spark, str(at), part_bytes=3000).collect()
    assert len(rows) == 6 * 70 and {(r["height"], r["width"], r["n_slices"], r["src_dtype"]) for r in rows} == {(9, 11, 70, "i2")}
    assert all(r["px"] == v[r["z"]].ravel().tolist() for r in rows)
    assert {(r["case_id"], r["study_id"]) for r in rows} == {(str(k), "a") for k in range(1, 7)} and all(np.allclose(r["spacing"], [0.5, 0.75, 3]) and np.allclose(r["origin"], [1, 2, 3]) for r in rows)
    assert volumes.slices(spark, f"{at}/[23]_*.*").count() == 140 and volumes.slices(spark, f"{at}/2_a_x.nii").count() == 70


def test_uncompressed_volumes_are_split_by_blocks(spark, volume):
    _, at = volume
    got = volumes.slices(spark, str(at), part_bytes=3000).withColumn("task", F.spark_partition_id()).groupBy("case_id", "task").agg(F.min("z").alias("a"), F.max("z").alias("b")).collect()
    parts = {c: sorted((r["a"], r["b"]) for r in got if r["case_id"] == c) for c in "123456"}
    assert parts["1"] == parts["5"] == [(0, 69)]  # compressed
    for c in "2346":
        assert parts[c] == [(0, 15), (16, 31), (32, 47), (48, 63), (64, 69)]


def test_filters_leave_out_files_and_slices(spark, volume, monkeypatch):
    v, at = volume
    (at / "2_a_x.nii").write_bytes(b"broken")  # a file that no filter wants is not opened
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = volumes.slices(spark, str(at)).filter("case_id in ('3', '6') and z >= 20 and z < 24").collect()
        assert sorted((r["case_id"], r["z"]) for r in got) == [(c, z) for c in "36" for z in range(20, 24)] and all(r["px"] == v[r["z"]].ravel().tolist() for r in got)
        (at / "3_a_x.raw").write_bytes(v.tobytes()[: 9 * 11 * 2 * 24])  # nor slices behind
        assert volumes.slices(spark, str(at)).filter("case_id = '3' and z between 20 and 23").count() == 4
        assert volumes.slices(spark, str(at)).filter("case_id = '3' and z in (2, 5)").count() == 2
        assert volumes.slices(spark, str(at)).filter("case_id = '9'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_broken_volumes_are_errors(spark, tmp_path):
    v = np.zeros((3, 4, 4), np.uint8)
    for name, data in (("a.mhd", meta("a.raw", v, "MET_UCHAR")), ("b.mha", meta("LOCAL", v, "MET_UCHAR") + b"short"), ("c.mhd", meta("LIST", v, "MET_UCHAR"))):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(PySparkException):
            volumes.slices(spark, str(tmp_path / name)).collect()


def test_headers_of_both_sources_agree(spark, volume):
    """The source and the decoder of whole volumes tell the same of a scaled volume."""
    v, at = volume
    data = bytearray(gzip.decompress(nifti.encode_nifti(v, (0.5, 0.75, 3.0))))
    data[112:120] = np.array([0.5, 10.0], "<f4").tobytes()
    (at / "2_a_x.nii").write_bytes(bytes(data))
    new = volumes.slices(spark, f"{at}/2_a_x.nii").orderBy("z").collect()
    old = nifti.slices(spark, f"{at}/2_a_x.nii").orderBy("z").collect()
    assert [(r["z"], r["px"], r["spacing"], r["case_id"]) for r in new] == [(r["z"], r["px"], r["spacing"], r["case_id"]) for r in old]


@pytest.fixture
def cases(tmp_path):
    """Two cases with all modalities and masks."""
    rng = np.random.default_rng(6)
    y, x = np.ogrid[:60, :64]
    gland, lesion = np.zeros((20, 60, 64), np.uint8), np.zeros((20, 60, 64), np.uint8)
    gland[1:18], lesion[2:18] = (y - 30) ** 2 + (x - 32) ** 2 <= 144, 2 * ((y - 33) ** 2 + (x - 30) ** 2 <= 30)
    vol = {m: rng.integers(0, 300, (20, 60, 64)).astype(np.int16) for m in ("T2W", "ADC", "HBV")} | {"gland": gland, "lesion": lesion}
    for m, v in vol.items():
        (tmp_path / m).mkdir()
        for case in ("101_7", "102_8"):
            (tmp_path / m / f"{case}_{m}.nii.gz").write_bytes(nifti.encode_nifti(v, (2.0, 2.0, 3.0)))
    return {m: str(tmp_path / m) for m in vol}


def test_a_run_decodes_once_and_shuffles_no_pixels(spark, cases, monkeypatch):
    """Volumes are read to be stored and never again; plans over the store have no exchange of pixel arrays, whatever the size of what they join."""
    opened = []
    read = volumes.slices
    monkeypatch.setattr(volumes, "slices", lambda s, p, *a: opened.append(p) or read(s, p, *a))
    params = Params(crop_method="stride", patient_status="positive", sequence_type="bpMRI", pixel_spacing=2.0, crop_image_size=16, crop_stride=8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        store = run.load(spark, params, cases, cases["gland"], cases["lesion"])
        assert sorted(opened) == sorted(cases.values())
        masks = run.masks(store, params)
        rows = patches.judged(masks, params)
        out = run.run(spark, params, cases, cases["gland"], cases["lesion"])
        for df in (masks, rows, out):
            plan = plan_of(df)
            assert "BatchScan" not in plan and "BinaryFile" not in plan and "Bucketed: true" in plan
            for line in plan.split("\n"):
                assert "Exchange" not in line or not re.search(r"\b(px|gland|lesion|_1)#", line)
            for below in exchanged(df):
                assert not {"px", "gland", "lesion", "gray"} & set(below)
        assert plan_of(rows).count("FileScan") == 2 + 3  # each mask's pixels once; sizes and cases of the stacks by columns alone
        assert len(re.findall(r"FileScan parquet \S+\[[^\]]*\bpx#", plan_of(rows))) == 2
        assert out.count() > 0 and {r[0] for r in out.select("modality").distinct().collect()} == {"T2W", "ADC", "HBV"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def exchanged(df):
    """Names of the columns that each exchange of a plan moves."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if "Exchange" in node.nodeName():
            cols = node.output()
            out.append([cols.apply(i).name() for i in range(cols.size())])
    return out


def test_a_store_keeps_blocks_together(spark, volume):
    v, at = volume
    store = SliceStore.write(spark, {"a": f"{at}/3_*", "b": f"{at}/4_*"}, buckets=5)
    a = store.role("a").withColumn("task", F.spark_partition_id())
    assert store.role("a").count() == store.role("b").count() == 70
    assert a.groupBy("block").agg(F.count("*").alias("n")).filter("block < 4").select("n").distinct().collect() == [(16,)]
    assert store.modalities(["a", "b"]).groupBy("modality").count().count() == 2
    assert spark.catalog.tableExists(store.table)
    store.drop()
    assert not spark.catalog.tableExists(store.table)
    with pytest.raises(PySparkException):
        spark.read.parquet(store.path)


def crops_of(spark, n, bad=None):
    rows = [(f"{k % 3}_s/c{k}.png", 2, 3, None if k == bad else [k % 256] * 6, k) for k in range(n)]
    return spark.createDataFrame(rows, "file string, height int, width int, gray array<int>, k int").repartition(4)


def test_files_are_written_once_and_by_one_action(spark, tmp_path):
    root = tmp_path / "out"
    made = crop_sink.write(crops_of(spark, 25), str(root), "png")
    files = sorted(str(p.relative_to(root)) for p in root.rglob("*.png"))
    assert files == sorted(r["file"] for r in made.collect()) and len(files) == 25
    assert set(made.columns) == {"file", "height", "width", "k", "bytes"} and made.filter("bytes <= 0").count() == 0
    (root / files[0]).unlink()
    assert made.count() == 25 and not (root / files[0]).exists()  # a later action reads the table and writes nothing
    more = crop_sink.write(crops_of(spark, 3), str(root), "png")  # a second job beside it
    assert more.count() == 3 and made.count() == 25
    assert crop_sink.write(crops_of(spark, 0), str(root), "png").count() == 0
    assert not list(root.rglob("staged"))


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    root = tmp_path / "out"
    with pytest.raises(PySparkException):
        crop_sink.write(crops_of(spark, 25, bad=13), str(root), "png")
    assert not [p for p in root.rglob("*") if p.is_file()]


def test_a_task_that_runs_on_after_the_abort_leaves_no_file(tmp_path, monkeypatch):
    import pyarrow as pa

    writer = crop_sink.CropSink({"path": str(tmp_path), "job": "j", "kind": "png"}).writer(None, False)
    batch = lambda name: pa.RecordBatch.from_pydict({"file": [name], "height": [2], "width": [3], "gray": [[1] * 6]})
    tries, opened = [], crop_sink.opened

    class Busy:
        """A file system where a task still writes as its folder is first removed."""

        def __init__(self, store):
            self.store = store

        def __getattr__(self, name):
            return getattr(self.store, name)

        def delete_dir(self, path):
            tries.append(path)
            if len(tries) == 1:
                raise OSError("Directory not empty")
            self.store.delete_dir(path)

    def rows():
        yield batch("0_s/a.png")
        assert [p for p in tmp_path.rglob("a.png")]
        monkeypatch.setattr(crop_sink, "opened", lambda root: (Busy(opened(root)[0]), opened(root)[1]))
        writer.abort([])
        yield batch("1_s/b.png")

    with pytest.raises(OSError):
        writer.write(rows())
    assert len(tries) > 1 and not list(tmp_path.rglob("*"))


def test_a_committed_job_can_be_finished_later(spark, tmp_path):
    """As after a driver that is lost between commit and move: what is moved already is left, the rest follows."""
    root = tmp_path / "out"
    spark.dataSource.register(crop_sink.CropSink)
    crops_of(spark, 9).write.format("crop_files").option("path", str(root)).option("job", "j").option("kind", "png").mode("append").save()
    assert not [p for p in root.rglob("*.png") if "_crops" not in p.parts]
    staged = next((root / "_crops/j/staged").rglob("c4.png"))
    (root / "1_s").mkdir()
    staged.rename(root / "1_s/c4.png")
    stray = root / "_crops/j/staged/other/0_s"
    stray.mkdir(parents=True)
    (stray / "c99.png").write_bytes(b"x")  # of a task that ran twice
    assert crop_sink.finish(spark, str(root), "j").count() == 9
    assert len([p for p in root.rglob("*.png")]) == 9
    assert crop_sink.finish(spark, str(root), "j").count() == 9
