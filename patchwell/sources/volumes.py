"""NIfTI-1 and MetaImage volumes as a splittable source of slices.

Uncompressed pixels are read by byte ranges: a large volume is many partitions,
each with a stretch of its slices, whether its pixels follow the header or lie in
a file of their own. Compressed volumes are one partition and are inflated a
slice at a time. Where ``spark.sql.python.filterPushdown.enabled`` is set, filters
on ``case_id`` leave out files and filters on ``z`` leave out slices before they
are read.
"""

from __future__ import annotations

import fnmatch
import gzip
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import nifti

#: Slices of a volume that stay together: partitions begin at multiples, and stores keep such a block in one bucket.
BLOCK = 16
#: Bytes of a partition, as far as blocks allow.
PART_BYTES = 32 << 20
ENDINGS = (".nii", ".nii.gz", ".mha", ".mhd")
ARROW = pa.schema([
    ("path", pa.string()), ("case_id", pa.string()), ("study_id", pa.string()), ("z", pa.int32()), ("n_slices", pa.int32()), ("height", pa.int32()), ("width", pa.int32()),
    ("spacing", pa.list_(pa.float64())), ("origin", pa.list_(pa.float64())), ("src_dtype", pa.string()), ("px", pa.list_(pa.float64())),
])
DDL = "path string, case_id string, study_id string, z int, n_slices int, height int, width int, spacing array<double>, origin array<double>, src_dtype string, px array<double>"


@dataclass
class Header:
    """Where a volume's pixels are and what they are. ``file`` is null where they follow the header; ``at`` of -1 means the end of the file."""

    shape: tuple[int, int, int]
    kind: str
    order: str
    at: int
    spacing: list[float]
    origin: list[float]
    file: str | None = None
    packed: str | None = None
    slope: float = 1.0
    inter: float = 0.0


def nifti_header(data: bytes, packed: str | None) -> Header:
    order = "<" if struct.unpack_from("<i", data)[0] == 348 else ">"
    if struct.unpack_from(order + "i", data)[0] != 348:
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack_from(order + "8h", data, 40)
    code = struct.unpack_from(order + "h", data, 70)[0]
    pixdim = struct.unpack_from(order + "8f", data, 76)
    at, slope, inter = (struct.unpack_from(order + "f", data, k)[0] for k in (108, 112, 116))
    nx, ny, nz = (max(1, dim[k]) if k <= dim[0] else 1 for k in (1, 2, 3))
    scaled = slope not in (0.0, 1.0) or (slope and inter)
    return Header((nz, ny, nx), nifti.TYPES[code], order, int(at), [float(abs(p)) for p in pixdim[1:4]], list(struct.unpack_from(order + "3f", data, 268)), None, packed, *((slope, inter) if scaled else ()))


def meta_header(f) -> Header:
    """Of a MetaImage; reads lines up to the one that names the pixels' file."""
    head, read = {}, b""
    while "ElementDataFile" not in head:
        line = b""
        while not line.endswith(b"\n"):
            c = f.read(1)
            if not c:
                raise ValueError("a MetaImage must name the file of its pixels")
            line += c
        read += line
        k, _, v = line.decode().partition("=")
        head[k.strip()] = v.strip()
    size = [int(x) for x in head["DimSize"].split()]
    size += [1] * (3 - len(size))
    big = head.get("BinaryDataByteOrderMSB", head.get("ElementByteOrderMSB", "False")) == "True"
    floats = lambda k, d: [float(x) for x in head.get(k, d).split()]
    file = head["ElementDataFile"]
    if file.startswith("LIST") or "%" in file:
        raise ValueError("pixels of a MetaImage must be in one file")
    local = file.upper() == "LOCAL"
    return Header(tuple(size[2::-1]), nifti.META[head["ElementType"]], ">" if big else "<", len(read) if local else int(head.get("HeaderSize", 0)), floats("ElementSpacing", "1 1 1"), floats("Offset", "0 0 0"), None if local else file, "zlib" if head.get("CompressedData") == "True" else None)


class _Inflated:
    """A zlib stream read piece by piece."""

    def __init__(self, f):
        self.f, self.z, self.left = f, zlib.decompressobj(), b""

    def read(self, n: int) -> bytes:
        out = [self.left]
        have = len(self.left)
        while have < n:
            data = self.f.read(1 << 20)
            if not data:
                break
            out.append(self.z.decompress(data))
            have += len(out[-1])
        every = b"".join(out)
        self.left = every[n:]
        return every[:n]


@dataclass
class VolumePart(InputPartition):
    """The ``k``-th of ``n`` stretches of a volume's slices."""

    path: str
    k: int
    n: int


def _opened(root: str):
    store, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(root))
    return store, path


def ids(path: str) -> tuple[str, str]:
    """Case and study: the first two parts of a file's name up to its first dot."""
    parts = path.rpartition("/")[2].split(".")[0].split("_")
    return parts[0], parts[1] if len(parts) > 1 else ""


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.part_bytes = options["path"], int(options.get("part_bytes", PART_BYTES))
        self.low, self.high, self.cases = 0, 1 << 31, None

    def partitions(self) -> list[InputPartition]:
        store, path = _opened(self.root)
        wild = next((i for i, c in enumerate(path) if c in "*?["), None)
        base = path if wild is None else path[:wild].rpartition("/")[0] or "/"
        info = store.get_file_info(base)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        sizes = {f.path: f.size for f in found if f.type == fs.FileType.File and (wild is None or fnmatch.fnmatch(f.path, path) or not f.path.endswith(ENDINGS))}
        out = []
        for name in sorted(p for p in sizes if p.lower().endswith(ENDINGS)):
            if self.cases is not None and ids(name)[0] not in self.cases:
                continue
            stem, ending = name.rsplit(".", 1)
            size = sizes[name]
            if ending.lower() == "mhd":  # as far as its pixels are named after it; else it is one partition
                size = max((sizes.get(f"{stem}.{e}", 0) for e in ("raw", "img", "bin")), default=0)
            n = 1 if name.lower().endswith(".gz") else max(1, -(-size // self.part_bytes))
            out += [VolumePart(name, k, n) for k in range(n)]
        return out or [VolumePart("", 0, 0)]

    def read(self, partition: VolumePart) -> Iterator[pa.RecordBatch]:
        if not partition.n:
            return
        store, _ = _opened(self.root)
        name = partition.path
        with store.open_input_file(name) as f:
            if name.lower().endswith((".mha", ".mhd")):
                head = meta_header(f)
            elif name.lower().endswith(".gz"):
                head = nifti_header(gzip.GzipFile(fileobj=f).read(352), "gzip")
            else:
                head = nifti_header(f.read(352), None)
        if head.packed and partition.k:
            return
        n = 1 if head.packed else partition.n
        blocks = -(-head.shape[0] // BLOCK)
        first, after = (min(head.shape[0], blocks * k // n * BLOCK) for k in (partition.k, partition.k + 1))
        first, after = max(first, self.low), min(after, self.high + 1)
        file = name if head.file is None else f"{name.rpartition('/')[0]}/{head.file}"
        with store.open_input_file(file) as f:
            yield from self._slices(f, head, name, first, after)

    def _slices(self, f, head: Header, name: str, first: int, after: int) -> Iterator[pa.RecordBatch]:
        depth, height, width = head.shape
        kind = np.dtype(head.order + head.kind)
        size = height * width * kind.itemsize
        at = head.at if head.at >= 0 else f.size() - depth * size
        begin = first
        if head.packed == "gzip":
            data, begin = gzip.GzipFile(fileobj=f), 0
            data.read(at)
        elif head.packed:
            f.seek(at)
            data, begin = _Inflated(f), 0
        else:
            f.seek(at + first * size)
            data = f
        case, study = ids(name)
        for z in range(begin, after):
            body = data.read(size)
            if len(body) < size:
                raise ValueError(f"{name} ends within slice {z} of {depth}")
            if z < first:
                continue
            px = np.frombuffer(body, kind).astype(float)
            if (head.slope, head.inter) != (1.0, 0.0):
                px = px * head.slope + head.inter
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((name, case, study, z, depth, height, width, head.spacing, head.origin, head.kind, px), ARROW, strict=True)], schema=ARROW)


class PrunedReader(VolumeReader):
    """Takes filters on case and slice."""

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("z",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                v = f.value
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, v + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, v - isinstance(f, LessThan))
                continue
            if column == ("case_id",) and isinstance(f, (EqualTo, In)):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.cases = names if self.cases is None else self.cases & names
                continue
            if column == ("z",) and isinstance(f, In) and f.value:
                self.low, self.high = max(self.low, min(f.value)), min(self.high, max(f.value))
            yield f


class VolumeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volumes"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> DataSourceReader:
        return (PrunedReader if self.options.get("pushdown") == "true" else VolumeReader)(dict(self.options))


def slices(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Every slice of every volume at ``path`` (a file, a folder or a pattern), with case and study from the file's name.

    Stores that only Spark opens are read through ``binaryFile``, a volume a task.
    """
    try:
        store, base = _opened(path)
        store.get_file_info(base.split("*")[0].rpartition("/")[0] or "/")
    except (pa.ArrowInvalid, OSError, ImportError):
        return nifti.slices(spark, path).select(*ARROW.names)
    spark.dataSource.register(VolumeSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("volumes").option("path", path).option("part_bytes", part_bytes).option("pushdown", pushed).load()
