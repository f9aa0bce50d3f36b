"""Order-preserving packing of documents into fixed windows by dynamic programming.

Documents stay in the order of their partition. Over all cut points (ends of
documents and sentences, and hard cuts where none lies within a window) the
cheapest split is found: a sequence costs its padding, a cut inside a document a
penalty. With costs ``f``, ``f[j] = pen[j] + c + min(f[i] + pad(p[j] - p[i]))``
over ``p[j] - p[i] <= size``; as ``pad`` is ``size - p[j] + p[i]``, the minimum of
``f[i] + p[i]`` over a sliding window comes from a monotone queue. A length that
is a power of two is not padded and is tried on its own.

The stream is cut in runs of ``RUN`` tokens; the last sequence of a run is taken
up by the next, so memory does not depend on a partition's size.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import release, split_batches, tidy
from .tokens import MARK, encoder

SIZE = 2048
END_ID = 1
RUN = 1_000_000
#: Costs in padding tokens: a cut at a sentence's end, anywhere else, and of any sequence.
SENTENCE, HARD, EACH = 8, 64, 16


def cut_points(stops: np.ndarray, ends: np.ndarray, total: int, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions with penalties: 0 after a document, ``SENTENCE`` after a sentence, ``HARD`` in gaps over ``size``."""
    pos = np.union1d(np.union1d(stops, ends), [0, total])
    pos = pos[(pos >= 0) & (pos <= total)]
    gap = np.diff(pos)
    wide = np.flatnonzero(gap > size)
    hard = [np.arange(pos[i] + size, pos[i + 1], size) for i in wide]
    every = np.union1d(pos, np.concatenate(hard)) if hard else pos
    pen = np.full(len(every), HARD, np.int64)
    pen[np.isin(every, stops)] = SENTENCE
    pen[np.isin(every, ends)] = 0
    pen[-1] = 0
    return every, pen


def best_cuts(pos: np.ndarray, pen: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The cheapest cuts, first and last position included."""
    n = len(pos)
    exact: dict[int, list[int]] = {}
    k = 1
    while k < size:
        at = np.searchsorted(pos, pos - k)
        hit = np.flatnonzero((pos >= k) & (pos[np.minimum(at, n - 1)] == pos - k))
        for j, i in zip(hit.tolist(), at[hit].tolist(), strict=True):
            exact.setdefault(j, []).append(i)
        k *= 2
    p, pens = pos.tolist(), pen.tolist()
    cost, back = [0] * n, [0] * n
    queue = deque([(p[0], 0)])  # (f[i] + p[i], i), rising
    for j in range(1, n):
        x = p[j]
        while p[queue[0][1]] < x - size:
            queue.popleft()
        value, i = queue[0]
        best = value + size - x
        if j in exact:
            for e in exact[j]:
                if cost[e] < best:
                    best, i = cost[e], e
        best += pens[j] + EACH
        cost[j], back[j] = best, i
        value = best + x
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    out, j = [n - 1], n - 1
    while j:
        j = back[j]
        out.append(j)
    return pos[out[::-1]]


def tail_cuts(length: int, size: int = SIZE) -> list[int]:
    """Lengths of the last sequences: powers of two where that is cheaper than padding."""
    if length == 0 or length & (length - 1) == 0:
        return [length] if length else []
    parts = [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]
    return parts if len(parts) * (HARD // 8 + EACH) < size - length else [length]


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, words: int = 0) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for every piece.

    A null or empty text is its end id alone. Each row is a document, repeated
    rows too; a null doc_id stays null. Other columns are not used. No rows give
    no rows. ``sequence_id`` holds the partition in its upper bits; sequences are
    numbered from 0 below that. ``words`` is how many words a worker keeps from task
    to task, at some 250 bytes each; with 0 it keeps sixty thousand for a task and
    gives the memory back, where other operators run in the same workers.
    """
    from pyspark import TaskContext

    def run(batches):
        enc, base = encoder(tokenizer, words or 60_000), TaskContext.get().partitionId() << 40
        made = 0
        ids = np.zeros(0, np.uint32)  # what is not written yet
        begin, names, offs, sizes = np.zeros(0, np.int64), [], np.zeros(0, np.int64), np.zeros(0, np.int64)

        def flush(last: bool):
            nonlocal made, ids, begin, names, offs, sizes
            total = len(ids)
            if total == 0:
                return None
            ends = np.append(begin[1:], total)
            plain = ids & ~MARK
            stops = np.flatnonzero(ids & MARK) + 1
            cuts = best_cuts(*cut_points(stops, ends, total, size), size)
            if last:
                tail = np.cumsum([cuts[-2], *tail_cuts(int(cuts[-1] - cuts[-2]), size)])
                cuts = np.union1d(cuts[:-1], tail)
                upto = total
            else:
                upto = int(cuts[-2])
                cuts = cuts[:-1]
            edge = np.unique(np.concatenate([cuts, begin[begin < upto], [upto]]))
            a, b = edge[:-1], edge[1:]
            doc = np.searchsorted(begin, a, side="right") - 1
            seq = np.searchsorted(cuts, a, side="right") - 1
            out = pd.DataFrame({
                "doc_id": pd.array([names[d] for d in doc.tolist()], "Int64"), "start": a - begin[doc] + offs[doc], "length": b - a,
                "ids_crc32": [zlib.crc32(plain[x:y].tobytes()) for x, y in zip(a.tolist(), b.tolist(), strict=True)],
                "doc_tokens": sizes[doc], "sequence_id": base + made + seq, "offset": a - cuts[seq],
            })
            made += len(cuts) - (0 if cuts[-1] < upto else 1)
            d = np.searchsorted(begin, upto, side="right") - 1
            keep = np.arange(d, len(begin)) if upto < total else np.zeros(0, np.int64)
            begin2, offs2 = begin[keep] - upto, offs[keep].copy()
            if len(keep) and begin2[0] < 0:
                offs2[0] -= begin2[0]
                begin2[0] = 0
            ids, begin, offs, sizes, names = ids[upto:].copy(), begin2, offs2, sizes[keep], [names[k] for k in keep.tolist()]
            return out

        for pdf in split_batches(batches):
            got = enc.encode_marked(pdf["text"])
            parts = []
            for x in got:
                parts += [x, np.array([end_id], np.uint32)]
            n = np.array([len(x) + 1 for x in got], np.int64)
            begin = np.append(begin, len(ids) + np.cumsum(n) - n)
            ids = np.concatenate([ids, *parts])
            names += [None if i is None else int(i) for i in pdf["doc_id"].tolist()]
            offs, sizes = np.append(offs, np.zeros(len(n), np.int64)), np.append(sizes, n)
            if len(ids) >= RUN:
                yield flush(False)
        if (out := flush(True)) is not None:
            yield out
        if words:
            tidy()
        else:
            release()

    # As text, ids keep all their digits where some are null.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
