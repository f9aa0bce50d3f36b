"""Crops as image files: PNG, JPEG, TIFF or NumPy arrays, made in tasks; ``crop_sink`` writes them."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def png(img: np.ndarray) -> bytes:
    """An 8-bit grey PNG."""
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w = img.shape
    rows = np.hstack([np.zeros((h, 1), np.uint8), img.astype(np.uint8)]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows, 6)) + part(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Pixels of a PNG as ``png`` writes it."""
    w, h = struct.unpack_from(">II", data, 16)
    at, body = 8, b""
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w + 1)[:, 1:]


def tiff(img: np.ndarray) -> bytes:
    """An 8-bit grey TIFF of one uncompressed strip."""
    h, w = img.shape
    body = img.astype(np.uint8).tobytes()
    tags = ((256, 4, w), (257, 4, h), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, len(body)))
    pad = b"\0" * (len(body) % 2)
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 8 + len(body) + len(pad)) + body + pad + ifd


def _zigzag() -> np.ndarray:
    """Places of an 8x8 block along its diagonals, which run up and down in turn."""
    return np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


ZIGZAG = _zigzag()
_AT = np.arange(8)
#: Rows are the cosines of a frequency.
COSINES = np.cos((2 * _AT[None, :] + 1) * _AT[:, None] * np.pi / 16) * np.where(_AT == 0, np.sqrt(1 / 8), 0.5)[:, None]
#: Steps rise with the frequency.
STEPS = 1 + (_AT[:, None] + _AT[None, :]) // 3
#: Symbols of the two code tables: all codes have one length, 4 and 8 bits.
DC_SYMBOLS = list(range(12))
AC_SYMBOLS = [0, 0xF0, *[run << 4 | size for run in range(16) for size in range(1, 11)]]


def _bits_of(v: int) -> tuple[int, int]:
    """A coefficient's size and its bits: of negative ones, those of v - 1."""
    size = abs(v).bit_length()
    return size, v if v >= 0 else v + (1 << size) - 1


def jpeg(img: np.ndarray) -> bytes:
    """An 8-bit grey baseline JPEG."""
    h, w = img.shape
    full = np.pad(img.astype(float), ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    blocks = full.reshape(full.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    coded = np.rint(COSINES @ blocks @ COSINES.T / STEPS).astype(int).reshape(-1, 64)[:, ZIGZAG]
    dc, ac = {s: k for k, s in enumerate(DC_SYMBOLS)}, {s: k for k, s in enumerate(AC_SYMBOLS)}
    out: list[str] = []
    last = 0
    for block in coded.tolist():
        size, bits = _bits_of(block[0] - last)
        last = block[0]
        out.append(f"{dc[size]:04b}" + (f"{bits:0{size}b}" if size else ""))
        run = 0
        for v in block[1:]:
            if not v:
                run += 1
                continue
            while run > 15:
                out.append(f"{ac[0xF0]:08b}")
                run -= 16
            size, bits = _bits_of(v)
            out.append(f"{ac[run << 4 | size]:08b}{bits:0{size}b}")
            run = 0
        if run:
            out.append(f"{ac[0]:08b}")
    stream = "".join(out)
    stream += "1" * (-len(stream) % 8)
    body = int(stream, 2).to_bytes(len(stream) // 8, "big").replace(b"\xff", b"\xff\0")
    part = lambda marker, data: b"\xff" + bytes([marker]) + struct.pack(">H", len(data) + 2) + data
    table = lambda kind, length, symbols: bytes([kind]) + bytes([len(symbols) * (k == length) for k in range(1, 17)]) + bytes(symbols)
    frame = struct.pack(">BHHBBBB", 8, h, w, 1, 1, 0x11, 0)
    head = part(0xE0, b"JFIF\0" + struct.pack(">BBBHHBB", 1, 1, 0, 1, 1, 0, 0)) + part(0xDB, b"\0" + bytes(STEPS.ravel()[ZIGZAG].tolist())) + part(0xC0, frame)
    return b"\xff\xd8" + head + part(0xC4, table(0x00, 4, DC_SYMBOLS)) + part(0xC4, table(0x10, 8, AC_SYMBOLS)) + part(0xDA, b"\1\1\0\0\x3f\0") + body + b"\xff\xd9"


def npy(img: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, img, allow_pickle=False)
    return out.getvalue()


def encode(crops: DataFrame, kind: str = "png") -> DataFrame:
    """``crops`` (``height, width, gray`` or, for arrays, ``px``) with each one's file as ``content``."""
    make = {"png": png, "jpg": jpeg, "tiff": tiff, "npy": npy}[kind]
    column = "px" if kind == "npy" else "gray"
    keep = [c for c in crops.columns if c not in ("px", "gray", "content")]

    def run(batches):
        for pdf in batches:
            files = [make(np.asarray(p).reshape(h, w)) for p, h, w in zip(pdf[column], pdf["height"], pdf["width"], strict=True)]
            yield pdf[keep].assign(content=files)

    schema = ", ".join(f"`{c}` {crops.schema[c].dataType.simpleString()}" for c in keep)
    return crops.select(*keep, column).mapInPandas(run, f"{schema}, content binary")
