"""Crop files, all or none: staged by tasks, committed with a list of the tasks that count, and then moved to their names.

Below the target, ``_crops/<job>`` holds the staged files, a manifest part a task,
the ``commit`` file and, when all is done, the table of files. A task that fails or
runs twice leaves staged files that no commit names; a job that fails leaves
nothing, as tasks that still run when it is given up find no folder to go on in.
What a committed job has not moved yet, ``finish`` moves, as often as it is called.
"""

from __future__ import annotations

import os
import time
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from . import images

MAKE = {"png": images.png, "jpg": images.jpeg, "tiff": images.tiff, "npy": images.npy}
#: Columns of pixels, which the table of files leaves out.
PIXELS = ("px", "gray")
#: How often, and after how many seconds each, a folder is removed again that tasks were writing to.
TRIES, PAUSE = 50, 0.1


def opened(root: str):
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(root))


def _folder_below(store, job: str, path: str) -> None:
    """Make a folder below a job's own, which must be there: with that gone, the job was given up."""
    at = job
    for name in path[len(job) + 1 :].split("/"):
        at += f"/{name}"
        store.create_dir(at, recursive=False)


@dataclass
class TaskFiles(WriterCommitMessage):
    """The manifest part of a task that ended well; null if it had no rows."""

    part: str | None


class CropWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.root, self.job, self.kind = options["path"], options["job"], options["kind"]

    def write(self, iterator) -> TaskFiles:
        store, base = opened(self.root)
        task = uuid.uuid4().hex
        at = f"{base}/_crops/{self.job}"
        parts, folders = [], set()
        pixels = "px" if self.kind == "npy" else "gray"
        for batch in iterator:
            names, sizes = batch.column("file").to_pylist(), []
            shapes = zip(*(batch.column(c).to_pylist() for c in ("height", "width")), strict=True)
            for name, (h, w), row in zip(names, shapes, batch.column(pixels), strict=True):
                if not row.is_valid:
                    raise ValueError(f"{name} has no pixels")
                data = MAKE[self.kind](np.asarray(row.values.to_numpy(zero_copy_only=False)).reshape(h, w))
                path = f"{at}/staged/{task}/{name}"
                if (folder := path.rpartition("/")[0]) not in folders:
                    _folder_below(store, at, folder)
                    folders.add(folder)
                with store.open_output_stream(path) as out:
                    out.write(data)
                sizes.append(len(data))
            kept = batch.select([c for c in batch.schema.names if c not in PIXELS])
            staged = pa.array([f"_crops/{self.job}/staged/{task}/{n}" for n in names], pa.string())
            parts.append(pa.Table.from_batches([kept]).append_column("bytes", pa.array(sizes, pa.int64())).append_column("staged", staged))
        if not parts:
            return TaskFiles(None)
        _folder_below(store, at, f"{at}/manifest")
        pq.write_table(pa.concat_tables(parts), f"{at}/manifest/{task}.parquet", filesystem=store)
        return TaskFiles(f"{task}.parquet")

    def commit(self, messages) -> None:
        store, base = opened(self.root)
        store.create_dir(f"{base}/_crops/{self.job}", recursive=True)
        with store.open_output_stream(f"{base}/_crops/{self.job}/commit") as out:
            out.write("\n".join(m.part for m in messages if m is not None and m.part).encode())

    def abort(self, messages) -> None:
        """Other tasks may write until they are told: what comes in between makes a removal fail, and is removed with the next."""
        store, base = opened(self.root)
        at = f"{base}/_crops/{self.job}"
        for left in reversed(range(TRIES)):
            try:
                if store.get_file_info(at).type == fs.FileType.Directory:
                    store.delete_dir(at)
                break
            except OSError:
                if not left:
                    raise
                time.sleep(PAUSE)
        if store.get_file_info(f"{base}/_crops").type == fs.FileType.Directory:
            if not store.get_file_info(fs.FileSelector(f"{base}/_crops")):
                store.delete_dir(f"{base}/_crops")


class CropSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "crop_files"

    def writer(self, schema, overwrite):
        out = CropWriter(dict(self.options))
        store, base = opened(out.root)
        store.create_dir(f"{base}/_crops/{out.job}", recursive=True)
        return out


def _moved(root: str):
    def run(batches):
        store, base = opened(root)
        folders = set()
        for pdf in batches:
            for staged, name in zip(pdf["staged"], pdf["file"], strict=True):
                source, target = f"{base}/{staged}", f"{base}/{name}"
                if store.get_file_info(source).type == fs.FileType.NotFound and store.get_file_info(target).type == fs.FileType.File:
                    continue  # moved before
                if (folder := target.rpartition("/")[0]) not in folders:
                    store.create_dir(folder, recursive=True)
                    folders.add(folder)
                store.move(source, target)
            yield pdf.drop(columns="staged")

    return run


def finish(spark: SparkSession, root: str, job: str) -> DataFrame | None:
    """Move a committed job's files to their names; a row each. Null where the job had no rows."""
    store, base = opened(root)
    at = f"{base}/_crops/{job}"
    with store.open_input_stream(f"{at}/commit") as f:
        parts = f.read().decode().split()
    if not parts:
        return None
    done = f"{root.rstrip('/')}/_crops/{job}/files"
    if store.get_file_info(f"{at}/files/_SUCCESS").type != fs.FileType.File:
        rows = spark.read.parquet(*[f"{root.rstrip('/')}/_crops/{job}/manifest/{p}" for p in parts])
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "staged")
        rows.mapInPandas(_moved(root), schema).write.mode("overwrite").parquet(done)
        store.delete_dir(f"{at}/staged")
    return spark.read.parquet(done)


def write(crops: DataFrame, root: str, kind: str) -> DataFrame:
    """Write each of ``crops`` (``file, height, width, gray``; for arrays ``px``) as a file below ``root``; the table of files, which later uses only read."""
    spark = crops.sparkSession
    spark.dataSource.register(CropSink)
    job = uuid.uuid4().hex
    unused = "gray" if kind == "npy" else "px"
    rows = crops.drop(unused, "bytes", "staged")
    rows.write.format("crop_files").option("path", root).option("job", job).option("kind", kind).mode("append").save()
    made = finish(spark, root, job)
    return rows.drop(*PIXELS).limit(0).withColumn("bytes", F.lit(0).cast("long")) if made is None else made
