"""Legacy web archives: ARC files written, parsed and converted to WARC.

An ARC file begins with a version block, whose body names the fields of the
header lines that follow: version 1 has five, version 2 ten. A record is its
header line, then as many bytes as the line's last field declares, then a line
feed. The converter gives each record a WARC identifier made from its address,
date and payload, the date in ISO form, a type, and SHA-1 digests of block and
payload. Files are written by Spark's own text writer, whose rows are bytes here,
so a lost task leaves no half-written archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import mapped, new_path, store

#: Fields of the header lines of both ARC versions, as their version blocks name them.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
KEY = b"X-Record-Key"
DATE = "20240101000000"
#: Records of fewer payload bytes are never revisits.
LEAST_BYTES = 0
#: Records of a file, and revisits that may be broadcast (about 100 bytes each).
PER_FILE, FEW = 1000, 200_000


def sha1(b: bytes) -> str:
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 origin\n{' '.join(FIELDS[version])}\n".encode()
    blank = "" if version == 1 else "200 - - 0 " + name + " "
    return f"filedesc://{name} 0.0.0.0 {DATE} text/plain {blank}{len(body)}\n".encode() + body


def arc_record(version: int, url: str, key: int | None, payload: bytes, name: str) -> bytes:
    """One response as ARC bytes. Spaces and control characters in the address are percent-encoded."""
    safe = "".join([c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url]) or "-"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n" % len(payload)
    head += (b"%s: %d\r\n" % (KEY, key) if key is not None else b"") + b"\r\n"
    extra = "" if version == 1 else f"200 {hashlib.md5(payload).hexdigest()} - 0 {name} "
    return f"{safe} 0.0.0.0 {DATE} text/html {extra}{len(head) + len(payload)}\n".encode("utf-8", "surrogatepass") + head + payload


def parse_arc(data: bytes) -> list[dict]:
    """Records of one ARC file, gzipped or not. Declared lengths alone say where a record ends.

    A file that is cut off, or a line with a wrong number of fields, is an error.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, fields, out = 0, None, []
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "surrogatepass").rstrip("\r").split(" ")
        size = int(line[-1])
        body = data[end + 1 : end + 1 + size]
        if len(body) != size:
            raise ValueError(f"ARC record at byte {at} declares {size} bytes and has {len(body)}")
        at = end + 1 + size
        if line[0].startswith("filedesc:"):
            version = int(body.split(b" ", 1)[0])
            fields = body.split(b"\n")[1].decode().split(" ")
            if fields != FIELDS.get(version):
                raise ValueError(f"unknown ARC version block: {fields}")
            continue
        if fields is None or len(line) != len(fields):
            raise ValueError(f"ARC header line has {len(line)} fields: {line[:3]}")
        out.append(dict(zip(fields, line, strict=True)) | {"block": body})
    return out


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers by lower-cased name, the header bytes and the payload of an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return {}, b"", block
    head, gap, payload = block.partition(b"\r\n\r\n")
    named = dict(x.split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
    return {k.decode("latin-1").lower().strip(): v.decode("latin-1").strip() for k, v in named.items()}, head + gap, payload


def warc_record(url: str, date: str, kind: str, block: bytes, digest: str, refers_to: int | None, media: str) -> bytes:
    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    ident = uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {date} {kind} {sha1(block)}")
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{ident}>\r\nWARC-Date: {stamp}\r\nWARC-Target-URI: {url}\r\nContent-Type: {media}\r\n"
    head += f"WARC-Block-Digest: sha1:{sha1(block)}\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
    if kind == "revisit":
        head += "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
        head += f"X-Refers-To-Key: {refers_to}\r\n" if refers_to is not None else ""
    return (head + f"Content-Length: {len(block)}\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> list[dict]:
    """Records of one WARC file, gzipped or not: headers by lower-cased name, and ``block``."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, out = 0, []
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        size = int(head["content-length"])
        out.append(head | {"block": data[end + 4 : end + 4 + size]})
        at = end + 4 + size
    return out


def _write(rows: DataFrame, path: str) -> None:
    """Bytes as they are, a line feed after each row, gzipped, ``PER_FILE`` rows a file: one is read back as a whole."""
    rows.select(F.col("value").cast("string")).write.option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).filter(F.col("path").rlike(r"part-[^/]*$")).select("content")


def write_arc(pages: DataFrame, path: str) -> None:
    """``(page_id, url, html)`` as ARC files, versions 1 and 2 in turn by partition. A null html is empty."""
    from pyspark import TaskContext

    def run(batches):
        part = TaskContext.get().partitionId()
        version, name, row = 1 + part % 2, f"part-{part}.arc", 0
        for pdf in batches:
            out = []
            for k, u, h in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                if row % PER_FILE == 0:  # every file begins with its own version block
                    out.append(version_block(version, name))
                    row += 1
                out.append(arc_record(version, u if isinstance(u, str) else "", None if k is None else int(k), h.encode("utf-8", "surrogatepass") if isinstance(h, str) else b"", name))
                row += 1
            yield pd.DataFrame({"value": out})

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    _write(rows.mapInPandas(run, "value binary"), path)


ROLE = "key long, digest string"


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """``key, url, date, media, digest, block`` of every record below ``path``."""

    def run(batches):
        for pdf in batches:
            for data in pdf["content"]:
                rows = parse_arc(data)
                for i in range(0, len(rows), 200):
                    out = []
                    for r in rows[i : i + 200]:
                        head, _, payload = http_parts(r["block"])
                        key = head.get(KEY.decode().lower())
                        out.append((key, r["URL"], r["Archive-date"], "application/http; msgtype=response" if head else r["Content-type"], sha1(payload), len(payload), r["block"]))
                    yield pd.DataFrame(out, columns=["key", "url", "date", "media", "digest", "bytes", "block"])

    out = _files(spark, path).mapInPandas(run, "key string, url string, date string, media string, digest string, bytes long, block binary")
    return out.withColumn("key", F.col("key").cast("long"))


def convert(spark: SparkSession, source: str, target: str, least: int = LEAST_BYTES) -> None:
    """ARC files below ``source`` to WARC files below ``target``.

    Of records with equal payloads of at least ``least`` bytes, the one of the
    largest key is written whole and the others as revisits of it, without
    payload; a record with no key is a revisit where one with a key exists.
    """
    records = read_arc(spark, source)
    index = store(records.filter(F.col("bytes") >= least).select("key", "digest"), "digests")
    roles = index.groupBy("digest").agg(F.max("key").alias("keeper"), F.count("*").alias("n")).filter("n > 1 and keeper is not null")
    again = index.distinct().join(roles, "digest").filter(~F.col("key").eqNullSafe(F.col("keeper"))).select(F.col("key").alias("k"), F.col("digest").alias("d"), "keeper")
    again = store(again, "revisits")
    # By key and digest together: no payload has to meet its copies in one task. Few revisits leave the records where they are.
    again = F.broadcast(again) if again.count() <= FEW else again
    both = records.join(again, records["key"].eqNullSafe(again["k"]) & (records["digest"] == again["d"]), "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, keeper, u, t, m, d, b in zip(pdf["key"], pdf["keeper"], pdf["url"], pdf["date"], pdf["media"], pdf["digest"], pdf["block"], strict=True):
            again = keeper is not None
            kind = "revisit" if again else "response" if m.startswith("application/http") else "resource"
            out.append(warc_record(u, t, kind, http_parts(b)[1] if again else b, d, int(keeper) if again else None, m))
        return pd.DataFrame({"value": out})

    text = both.select(F.col("key").cast("string").alias("key"), F.col("keeper").cast("string").alias("keeper"), "url", "date", "media", "digest", "block")
    _write(mapped(text, run, "value binary", column="block", limit=8_000_000), target)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id`` from WARC files; digests are checked."""

    def run(batches):
        for pdf in batches:
            for data in pdf["content"]:
                rows = []
                for r in parse_warc(data):
                    if "sha1:" + sha1(r["block"]) != r["warc-block-digest"]:
                        raise ValueError(f"block digest of {r['warc-record-id']}")
                    head, _, payload = http_parts(r["block"])
                    told = r["warc-payload-digest"].removeprefix("sha1:")
                    again = r["warc-type"] == "revisit"
                    if not again and sha1(payload) != told:
                        raise ValueError(f"payload digest of {r['warc-record-id']}")
                    rows.append((head.get(KEY.decode().lower()), int(head["content-length"]) if again else len(payload), told, r["warc-type"], r.get("x-refers-to-key"), r["warc-target-uri"], r["warc-record-id"]))
                yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id"])

    out = _files(spark, path).mapInPandas(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, record_id string")
    return out.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages as ARC files, converted to WARC files, and read back.

    Null or empty html is an empty payload; a null url is written as ``-``;
    repeated rows each have a record; other columns are not used; no rows give
    archives without records and no rows.
    """
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc)
