"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds the hash of every prefix, so the hash of any span is
one subtraction and one product: spans are compared in constant time, longest
common extensions are found by binary search, and the array of a text put
together from two others is made from theirs. A fingerprint is what is least, in
each of 128 bins, among the hashes of all windows of 16 code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dealt_in_order, small_batches, store, tidy

#: Two hashes modulo a Mersenne prime, each with a base of its own: two spans of n code points that differ look alike with a probability of (n / PRIME)^2 at most.
PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_566_083_941)
#: Code points of a window, bins of a fingerprint, and what an empty bin holds.
WINDOW, BINS, EMPTY = 12, 128, 65535
_P, _S = np.uint64(PRIME), np.uint64(31)
_MIX, _AGAIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` (below 2^62) modulo the prime."""
    x = (x & _P) + (x >> _S)
    x = (x & _P) + (x >> _S)
    return np.where(x >= _P, x - _P, x)


_tables: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Of each base, and then of each one's inverse, the powers from 0 to ``n`` at least."""
    if not _tables or len(_tables[0]) <= n:
        size = max(1 << 14, 1 << n.bit_length())
        made = []
        for b in [*BASES, *(pow(b, -1, PRIME) for b in BASES)]:
            t = np.ones(1, np.uint64)
            while len(t) < size:
                t = np.concatenate([t, _reduced(t * np.uint64(pow(b, len(t), PRIME)))])
            made.append(t)
        _tables[:] = made
    return _tables


class Prefixes:
    """Prefix hashes of a text: ``sums[lane][k]`` is the sum of the first k code points (plus 1), each times its base to the power of its place."""

    def __init__(self, sums: list[np.ndarray]):
        self.sums = sums

    @classmethod
    def of(cls, text: str) -> Prefixes:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        powers = _powers(len(codes))
        sums = []
        for lane in range(2):
            s = np.zeros(len(codes) + 1, np.uint64)
            # 2^32 terms below 2^31 stay below 2^64, of which a division takes the rest.
            np.cumsum(_reduced(codes * powers[lane][: len(codes)]), out=s[1:])
            s = (s & _P) + (s >> _S)
            sums.append(_reduced(s))
        return cls(sums)

    def __len__(self) -> int:
        return len(self.sums[0]) - 1

    def joined(self, k: int, other: Prefixes, m: int) -> Prefixes:
        """Of the first ``k`` code points and then the first ``m`` of another text."""
        powers = _powers(k)
        return Prefixes([np.concatenate([a[: k + 1], _reduced(a[k] + _reduced(b[1 : m + 1] * powers[lane][k]))]) for lane, (a, b) in enumerate(zip(self.sums, other.sums, strict=True))])

    def span(self, i: int, n: int) -> tuple[int, int]:
        """Hash of the ``n`` code points from ``i`` on, the same wherever they stand."""
        powers = _powers(len(self))
        return tuple((int(s[i + n]) - int(s[i])) * int(powers[2 + lane][i]) % PRIME for lane, s in enumerate(self.sums))

    def common(self, i: int, other: Prefixes, j: int) -> int:
        """Longest common extension: how many code points from ``i`` on equal the other text's from ``j`` on."""
        least, most = 0, min(len(self) - i, len(other) - j)
        while least < most:
            n = (least + most + 1) // 2
            if self.span(i, n) == other.span(j, n):
                least = n
            else:
                most = n - 1
        return least

    def common_back(self, i: int, other: Prefixes, j: int) -> int:
        """How many code points before ``i`` equal the other text's before ``j``."""
        least, most = 0, min(i, j)
        while least < most:
            n = (least + most + 1) // 2
            if self.span(i - n, n) == other.span(j - n, n):
                least = n
            else:
                most = n - 1
        return least

    def windows(self, n: int) -> np.ndarray:
        """Hashes of all spans of ``n`` code points."""
        powers = _powers(len(self))
        a, b = (_reduced(_reduced(s[n:] + _P - s[: len(s) - n]) * powers[2 + lane][: len(s) - n]) for lane, s in enumerate(self.sums))
        return a << _S | b

    def fingerprint(self) -> bytes:
        """Two bytes a bin; of a text shorter than a window, the whole text is one."""
        least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
        if len(self):
            h = np.sort(self.windows(min(WINDOW, len(self))))
            again = np.flatnonzero(h[1:] == h[:-1]) + 1
            if len(again):
                # The k-th window of one text is another than its first: a line that is repeated counts as often as it stands there.
                place = np.arange(len(h))
                begins = np.maximum.accumulate(np.where(np.concatenate([[True], h[1:] != h[:-1]]), place, 0))
                h = h + (place - begins).astype(np.uint64) * _AGAIN
            h = h * _MIX
            h ^= h >> np.uint64(32)
            h *= _MIX
            np.minimum.at(least, (h >> np.uint64(57)).astype(np.int64), h & np.uint64((1 << 57) - 1))
        out = np.where(least >> np.uint64(57) > 0, np.uint64(EMPTY), least % np.uint64(EMPTY))
        return out.astype(">u2").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of two texts' windows that both have, as their fingerprints tell: from 0 to 1, and 1 for equal ones."""
    if a == b:
        return 1.0
    x, y = np.frombuffer(a, ">u2"), np.frombuffer(b, ">u2")
    used = (x != EMPTY) | (y != EMPTY)
    same = int(((x == y) & used).sum()) / int(used.sum())
    return 2 * same / (1 + same)


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_edited", pa.int64()), ("common_next", pa.int64()),
])
RESULT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, common_edited long, common_next long"
_EDGES = pa.schema([*RESULT, ("pid", pa.int32()), ("edge", pa.string()), ("text", pa.string())])


class _Text:
    """A document with what is made of its text once."""

    def __init__(self, doc_id: int | None, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.prefixes = Prefixes.of(self.text)
        self.print = self.prefixes.fingerprint()


def _row(doc: _Text, after: _Text) -> tuple:
    n = len(doc.text)
    cut = n // 3
    edited = doc.text[: n - cut] + after.text[:cut]
    array = doc.prefixes.joined(n - cut, after.prefixes, min(cut, len(after.text)))
    mark = array.fingerprint()
    return (
        doc.doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), doc.print, mark, likeness(doc.print, mark), likeness(doc.print, after.print),
        doc.prefixes.common(0, array, 0), doc.prefixes.common(0, after.prefixes, 0),
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents whose next one is in the same task; the first and the last text of the task leave it as they are."""
    pid, last = TaskContext.get().partitionId(), None
    bare = (None,) * (len(RESULT) - 1)
    for b in batches:
        out = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            doc = _Text(doc_id, text)
            out.append((doc_id, *bare, pid, "head", doc.text) if last is None else (*_row(last, doc), pid, None, None))
            last = doc
        if out:
            yield _batch(out, _EDGES)
    if last is not None:
        yield _batch([(last.doc_id, *bare, pid, "tail", last.text)], _EDGES)
    tidy()


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document of ``docs`` (``doc_id, text``) and of its text after an edit with the next document's.

    The next document has the next smaller id (nulls come last, then the order
    begins again); rows of one id are in an order of their texts' hashes, and equal
    rows follow each other. A null text is empty. Empty texts have fingerprints of
    empty bins, which are like each other (1) and like nothing else (0). A single
    document is its own next. ``common_edited`` and ``common_next`` count the code
    points that the text shares with the edited text and the next document from
    their beginning on. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = dealt_in_order(rows.withColumn("tie", F.xxhash64("text")), [F.col("doc_id").desc_nulls_last(), F.col("tie")]).select("doc_id", "text")
    found = store(placed.mapInArrow(_marked, RESULT_DDL + ", pid int, edge string, text string"), "fingerprints")
    # A row for each task that had documents: its last text meets the first one of the task after it.
    pids = sorted(r[0] for r in found.filter("edge = 'tail'").select("pid").collect())
    after = spark.createDataFrame(list(zip(pids, pids[1:] + pids[:1], strict=True)), "pid int, next int")
    tail = found.filter("edge = 'tail'").select("pid", "doc_id", F.col("text").alias("last"))
    head = found.filter("edge = 'head'").select(F.col("pid").alias("next"), "text")

    def meet(batches):
        for b in batches:
            rows = [_row(_Text(d, x), _Text(None, y)) for d, x, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "last", "text")), strict=True)]
            if rows:
                yield _batch(rows, RESULT)

    ends = tail.join(F.broadcast(after), "pid").join(head, "next").select("doc_id", "last", "text").mapInArrow(meet, RESULT_DDL)
    out = found.filter("edge is null").select(*RESULT.names).unionByName(ends)
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
