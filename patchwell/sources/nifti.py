"""NIfTI-1 and MetaImage volumes as a table of slices.

Files are read with Spark's ``binaryFile``, so any store that Spark reads will
do; a volume is decoded in one task and leaves it a slice at a time.
"""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.crops import ids

SCHEMA = "path string, z int, n_slices int, height int, width int, spacing array<double>, origin array<double>, src_dtype string, px array<double>"
#: NIfTI-1 type codes.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
#: MetaImage element types.
META = {"MET_UCHAR": "u1", "MET_CHAR": "i1", "MET_SHORT": "i2", "MET_USHORT": "u2", "MET_INT": "i4", "MET_UINT": "u4", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}


def decode_nifti(data: bytes) -> tuple[np.ndarray, list[float], list[float], str]:
    """Pixels [z][y][x], spacing and origin (x, y, z), and the stored type."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    order = "<" if struct.unpack_from("<i", data)[0] == 348 else ">"
    if struct.unpack_from(order + "i", data)[0] != 348:
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack_from(order + "8h", data, 40)
    kind = TYPES[struct.unpack_from(order + "h", data, 70)[0]]
    pixdim = struct.unpack_from(order + "8f", data, 76)
    at, slope, inter = (struct.unpack_from(order + "f", data, k)[0] for k in (108, 112, 116))
    nx, ny, nz = (max(1, dim[k]) if k <= dim[0] else 1 for k in (1, 2, 3))
    img = np.frombuffer(data, np.dtype(order + kind), nx * ny * nz, int(at)).reshape(nz, ny, nx)
    if slope not in (0.0, 1.0) or (slope and inter):
        img = img * slope + inter
    return img, [float(abs(p)) for p in pixdim[1:4]], list(struct.unpack_from(order + "3f", data, 268)), kind


def encode_nifti(img: np.ndarray, spacing, origin=(0.0, 0.0, 0.0)) -> bytes:
    """A gzipped single-file volume of [z][y][x] pixels."""
    kind = np.dtype(img.dtype).str[1:]
    code = {v: k for k, v in TYPES.items()}[kind]
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, img.shape[2], img.shape[1], img.shape[0], 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, code, img.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1.0, *spacing, 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<3f", head, 268, *origin)
    head[344:348] = b"n+1\0"
    return gzip.compress(bytes(head) + np.ascontiguousarray(img, img.dtype.newbyteorder("<")).tobytes(), mtime=0)


def decode_meta(data: bytes) -> tuple[np.ndarray, list[float], list[float], str]:
    """A MetaImage with its pixels in the same file."""
    head, at = {}, 0
    while "ElementDataFile" not in head:
        end = data.index(b"\n", at)
        k, _, v = data[at:end].decode().partition("=")
        head[k.strip()], at = v.strip(), end + 1
    if head["ElementDataFile"] != "LOCAL":
        raise ValueError("pixels of a MetaImage must be in the file itself")
    size = [int(x) for x in head["DimSize"].split()]
    big = head.get("BinaryDataByteOrderMSB", head.get("ElementByteOrderMSB", "False")) == "True"
    kind = META[head["ElementType"]]
    body = zlib.decompress(data[at:]) if head.get("CompressedData") == "True" else data[at:]
    img = np.frombuffer(body, np.dtype((">" if big else "<") + kind), int(np.prod(size))).reshape(size[::-1])
    floats = lambda k, d: [float(x) for x in head.get(k, d).split()]
    return img, floats("ElementSpacing", "1 1 1"), floats("Offset", "0 0 0"), kind


def slices(spark: SparkSession, path: str) -> DataFrame:
    """Every slice of every volume below ``path``, with case and study from the file's name."""

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                img, spacing, origin, kind = (decode_meta if name.lower().endswith((".mhd", ".mha")) else decode_nifti)(data)
                for z in range(len(img)):
                    yield pd.DataFrame({"path": [name], "z": z, "n_slices": len(img), "height": img.shape[1], "width": img.shape[2], "spacing": [spacing], "origin": [origin], "src_dtype": kind, "px": [img[z].ravel().astype(float)]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    case, study = ids(F.element_at(F.split("path", "/"), -1))
    return files.mapInPandas(run, SCHEMA).withColumns({"case_id": case, "study_id": study})
