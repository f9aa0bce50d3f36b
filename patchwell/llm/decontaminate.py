"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a bounded run of documents inside a partition. Its suffix array is
built over word ids by prefix doubling; every test suffix is looked up by binary
search, which gives all places where its window occurs, and neighbouring places
on one diagonal join into the longest verbatim matches.

The test set is read in blocks of bounded size. One block is looked up while the
result is made; more of them are broadcast in turn, each for a pass of its own
that leaves only the matches, so neither the driver nor a task holds two. A
block takes about 100 bytes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import mapped, store
from .words import ALNUM, word_hashes

WINDOW = 10
#: Words of benchmark text in a broadcast block.
BLOCK_WORDS = 2_000_000


class TestBlock:
    """Items as word ids, and every window: where it starts and how many words it has."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        h, first = word_hashes(texts, ALNUM)
        self.ids = ids
        self.vocabulary, words = np.unique(h, return_inverse=True)
        n = np.diff(first)
        count = np.where(n == 0, 0, np.maximum(1, n - window + 1))
        self.item = np.repeat(np.arange(len(ids)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.pos = at
        self.length = np.minimum(window, n)[self.item]
        self.grid = np.zeros((len(at), window), np.int64)
        start = first[:-1][self.item] + at
        for k in range(window):
            has = k < self.length
            self.grid[has, k] = words[start[has] + k] + 1
        self.shortest = int(self.length.min()) if len(at) else 0


def suffix_array(words: np.ndarray, depth: int, least: int) -> np.ndarray:
    """Starts of suffixes in order of their first ``depth`` words at least.

    Word id 0 ends every suffix. Suffixes of fewer than ``least`` words are left
    out, as nothing that is looked for can begin there; where that leaves few,
    they are sorted by their words, else by prefix doubling.
    """
    n = len(words)
    zero = np.append(np.flatnonzero(words == 0), n)
    run = zero[np.searchsorted(zero, np.arange(n))] - np.arange(n)
    at = np.flatnonzero(run >= max(1, least))
    if len(at) < n // 8 or not len(at):
        return at[np.lexsort([np.where(run[at] > k, words[np.minimum(at + k, n - 1)], 0) for k in range(depth - 1, -1, -1)])]
    at = np.flatnonzero(run)
    rank = np.zeros(n + 1, np.int64)
    rank[:n] = words
    width, order = 1, np.argsort(words[at], kind="stable")
    while width < depth:
        key = rank[at] * (n + int(words.max()) + 2) + rank[np.minimum(at + width, n)] * (run[at] > width)
        _, back = np.unique(key, return_inverse=True)
        rank[at] = back + 1
        order, width = np.argsort(back, kind="stable"), width * 2
    at = at[order]
    return at[run[at] >= least]


def compare(words: np.ndarray, starts: np.ndarray, grid: np.ndarray, length: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as a suffix's first words are below, equal to or above the query's."""
    out = np.zeros(len(starts), np.int8)
    for k in range(grid.shape[1]):
        same = (out == 0) & (length > k)
        if not same.any():
            break
        at = starts[same] + k
        have = np.where(at < len(words), words[np.minimum(at, len(words) - 1)], 0)
        # After a suffix's end its rest counts as 0, whatever text follows.
        out[same] = np.sign(have - grid[same, k])
    return out


def bounds(words: np.ndarray, sa: np.ndarray, grid: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of the suffix array whose suffixes begin with each query, by binary search."""
    found = []
    for above in (False, True):
        lo, hi = np.zeros(len(grid), np.int64), np.full(len(grid), len(sa), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo[open_] + hi[open_]) // 2
            c = compare(words, sa[mid], grid[open_], length[open_])
            right = c <= 0 if above else c < 0
            lo[open_] = np.where(right, mid + 1, lo[open_])
            hi[open_] = np.where(right, hi[open_], mid)
        found.append(lo)
    return found[0], found[1]


def matches(block: TestBlock, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Longest verbatim matches as (document, its word, item, its word, words)."""
    none = (np.zeros(0, np.int64),) * 5
    if not len(block.item) or not len(h):
        return none
    at = np.minimum(np.searchsorted(block.vocabulary, h), len(block.vocabulary) - 1)
    ids = np.where(block.vocabulary[at] == h, at + 1, 0)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    # A 0 between documents, so no suffix runs over an edge.
    words = np.zeros(len(ids) + len(first), np.int64)
    place = np.arange(len(ids)) + doc
    words[place] = ids
    back = np.zeros(len(words), np.int64)
    back[place] = np.arange(len(ids))
    sa = suffix_array(words, block.grid.shape[1], block.shortest)
    if not len(sa):
        return none
    lo, hi = bounds(words, sa, block.grid, block.length)
    count = hi - lo
    q = np.repeat(np.arange(len(lo)), count)
    if not len(q):
        return none
    spot = back[sa[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]]
    d, item, pos, n = doc[spot], block.item[q], block.pos[q], block.length[q]
    dpos = spot - first[d]
    order = np.lexsort((dpos, dpos - pos, item, d))
    d, dpos, item, pos, n = (x[order] for x in (d, dpos, item, pos, n))
    new = np.append(True, (np.diff(d) != 0) | (np.diff(item) != 0) | (np.diff(dpos - pos) != 0) | (np.diff(dpos) != 1))
    cut = np.flatnonzero(new)
    last = np.append(cut[1:], len(d)) - 1
    return d[cut], dpos[cut], item[cut], pos[cut], dpos[last] + n[last] - dpos[cut]


def test_blocks(benchmark: DataFrame, window: int = WINDOW, words: int = BLOCK_WORDS) -> Iterator[TestBlock]:
    """Blocks of at most ``words`` words of items each (an item is never cut)."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t")).toLocalIterator():
        if ids and size + len(row["t"]) // 2 > words:
            yield TestBlock(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(row["i"])
        texts.append(row["t"])
        size += len(row["t"]) // 2
    if ids:
        yield TestBlock(ids, texts, window)


_MATCHES = "array<struct<item_id:string,item_word:int,doc_word:int,n_words:int>>"


def found(block: TestBlock | None, h: np.ndarray, first: np.ndarray) -> list[list]:
    """The longest matches of each text."""
    out: list[list] = [[] for _ in first[1:]]
    if block is not None:
        for d, dpos, item, pos, size in zip(*(x.tolist() for x in matches(block, h, first)), strict=True):
            out[d].append({"item_id": block.ids[item], "item_word": pos, "doc_word": dpos, "n_words": size})
    return out


def block_matches(docs: DataFrame, block: TestBlock) -> DataFrame:
    """``(k1, k2, matches)`` of the different texts that hold a window of the block; two hashes stand for a text."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["k1", "k2"])
        pdf = pdf.assign(matches=found(shared.value, *word_hashes(pdf["text"], ALNUM)))
        return pdf.loc[pdf["matches"].map(len) > 0, ["k1", "k2", "matches"]]

    out = store(mapped(docs.select("text", *_text_keys()), run, f"k1 long, k2 int, matches {_MATCHES}").dropDuplicates(["k1", "k2"]), "matches")
    shared.destroy()
    return out


def _text_keys() -> list[Column]:
    return [F.xxhash64("text").alias("k1"), F.hash("text").alias("k2")]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``n_words, n_hit, n_items, items_sha256, contaminated, matches``.

    A word is hit if it lies in any occurrence of a window of ``window`` words of
    an item (all words of a shorter one). ``matches`` lists the longest verbatim
    matches: item, its first word, the document's first word, words. Documents
    without text have no words and are clean; items without words match nothing;
    an empty benchmark leaves all documents clean. Rows stay as they are,
    repeated ones and other columns included; result names replace clashing ones.
    """
    own = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "matches"]
    keep = [c for c in docs.columns if c not in own]
    kept = docs.select(F.struct(*keep).alias("row"), "text")
    blocks = test_blocks(benchmark, window, words)
    one, two = next(blocks, None), next(blocks, None)
    before = None
    if two is None:
        shared = docs.sparkSession.sparkContext.broadcast(one)  # of bounded size
        kept = kept.withColumn("before", F.lit(None).cast(_MATCHES))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(None)
        for b in chain([one, two], blocks):
            got = block_matches(docs, b)
            before = got if before is None else before.unionByName(got)
        before = before.groupBy("k1", "k2").agg(F.flatten(F.collect_list("matches")).alias("before"))
        kept = kept.select("*", *_text_keys()).join(before, ["k1", "k2"], "left").select("row", "text", "before")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, first = word_hashes(pdf["text"], ALNUM)
        every = [list(b) + f if b is not None else f for b, f in zip(pdf["before"], found(shared.value, h, first), strict=True)]
        mark = np.zeros(len(h) + 1, np.int64)
        for d, ms in enumerate(every):
            for m in ms:
                mark[first[d] + m["doc_word"]] += 1
                mark[first[d] + m["doc_word"] + m["n_words"]] -= 1
        hit = np.append(0, np.cumsum(np.cumsum(mark[:-1]) > 0))
        hits, items = hit[first[1:]] - hit[first[:-1]], [{m["item_id"] for m in ms} for ms in every]
        return pd.DataFrame({
            "row": pdf["row"], "n_words": np.diff(first), "n_hit": hits, "n_items": [len(x) for x in items],
            "items_sha256": [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], "contaminated": hits > 0, "matches": every,
        })

    row = kept.schema["row"].dataType.simpleString()
    schema = f"row {row}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, matches {_MATCHES}"
    out = mapped(kept, run, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in keep], *own)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no window of the benchmark, columns as they came."""
    return decontaminate(docs, benchmark, window).filter(~F.col("contaminated")).select(*docs.columns)
