"""Katz backoff scores of documents by a trigram model, with every count gathered from the corpus.

Tokens are words and one end a document; ``a b c`` is a token with the two before
it. Counts of trigrams, bigrams and words are Good-Turing discounted, those of
every size being kept. What discounting frees of a context goes to the tokens
that do not follow it, in proportion to the next lower order, by a weight that
makes the whole sum to one exactly: ``(1 - sum p(c|ab)) / (1 - sum p(c|b))`` over
the ``c`` that do follow, and so on down to words, where it is the probability of
a word never seen. A token's probability is evaluated by that recursion.

1. *Words.* Every training word is counted. The commonest ``TOP`` have numbers by
   rank, which a table of fixed size tells every task.
2. *N-grams.* Every token goes with its context and its document to the shard of
   its middle word ``b``, in compressed runs. A shard so holds every trigram and
   bigram around its words, with all that their discounts, totals and backoff
   weights are made of. Shards are a stored table, read for the frequencies of
   frequencies and then once more to score.
3. *What a shard lacks* is brought to it: the counts of rare words (a small part
   of all tokens), and, as a middle word may hold a third of all tokens, shards
   of words over ``HOT`` are split by ``a`` and get the bigram counts of the whole.
4. *Scores.* A shard adds up each text's part, and a run's parts come together in
   arrays. What numbered words alone tell (tokens, known ones, their base score)
   is added up where the run is made.

Equal texts are one text with a weight in each task's run. Shards know texts by
their run and their place in it; a run's keys go with one of its pieces.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop, release, single_rows, small_batches, split_batches, squeezed, store, tidy, unsqueezed
from .words import SPACED, mix, word_hashes

END, BEGIN = np.uint64(1), np.uint64(2)
#: Good-Turing discounts apply up to this count.
K = 5
#: What larger n-gram counts lose, so that every context leaves some mass to backoff.
ABOVE = 0.1
#: Tokens that a task holds before it sends them on, and those of a shard.
RUN, SHARD = 1_500_000, 2_000_000
#: Words with a number of their own.
TOP = 3_000_000
#: A middle word of more training tokens is split.
HOT = 2_000_000
#: Sums of texts that a task holds before it sends them on.
SUMS = 1_000_000
#: Bits of a text's place in its run; the run's number lies above, and has 16 for its place in the task.
_PLACE = 24
#: Words whose shards are chosen so that these hold about equally many tokens.
HEAVY = 4096
_U = np.uint64
_I = np.int64


def pair(ctx: np.ndarray, tok: np.ndarray) -> np.ndarray:
    return mix(ctx * _U(0x9E3779B97F4A7C15) + mix(tok))


def tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with ends, and each text's first index (one more than texts)."""
    h, first = word_hashes(texts, SPACED)
    n = len(first) - 1
    out = np.full(len(h) + n, END, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(n), np.diff(first))] = h
    return out, first + np.arange(n + 1)


def runs(batches, size: int):
    """Different texts of about ``size`` tokens together: tokens, first indices, keys, and how many of each are training rows."""
    held: dict[int, list] = {}
    parts, total = [], 0

    def flush():
        first = np.cumsum([0, *(len(p) for p in parts)])
        out = np.concatenate(parts), first, np.fromiter(held, _I, len(held)), np.array([held[k][0] for k in held], _I)
        held.clear()  # the caller needs the memory
        parts.clear()
        return out

    for pdf in split_batches(batches):
        new = ~pdf["key"].duplicated() & ~pdf["key"].isin(list(held))
        tok, first = tokens(pdf.loc[new, "text"])
        for k, a, b in zip(pdf.loc[new, "key"].tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            held[k] = [0]
            parts.append(tok[a:b])
            total += b - a
        for k in pdf.loc[pdf["learns"], "key"].tolist():
            held[k][0] += 1
        if total >= size:
            yield flush()
            total = 0
    if held:
        yield flush()


def _groups(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal keys begins and ends."""
    if not len(sorted_keys):
        return []
    cut = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])).tolist()
    return list(zip(cut, [*cut[1:], len(sorted_keys)], strict=True))


def word_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """``(key, c)`` of every training word, ends included."""

    def run(batches):
        for tok, first, _, weight in runs(batches, RUN):
            use = np.repeat(weight, np.diff(first))
            voc, at = np.unique(tok, return_inverse=True)
            n = np.bincount(at, use).astype(_I)
            voc, n = voc[n > 0], n[n > 0]
            to = (mix(voc) % _U(buckets)).astype(_I)
            order = np.argsort(to, kind="stable")
            rows = [(int(to[order[a]]), squeezed(np.diff(voc[order[a:b]], prepend=_U(0))), squeezed(n[order[a:b]])) for a, b in _groups(to[order])]
            yield pd.DataFrame(rows, columns=["bucket", "keys", "counts"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.cumsum(unsqueezed(b, "uint64"), dtype=np.uint64) for b in pdf["keys"]])
        voc, at = np.unique(keys, return_inverse=True)
        return pd.DataFrame({"key": voc.view(_I), "c": np.bincount(at, np.concatenate([unsqueezed(b, "int64") for b in pdf["counts"]])).astype(_I)})

    blobs = docs.select("text", "key", "learns").mapInPandas(run, "bucket int, keys binary, counts binary")
    return store(blobs.groupBy("bucket").applyInPandas(merge, "key long, c long"), "words")


def discounts(n: dict[int, int]) -> dict[int, float]:
    """Katz' Good-Turing discounts for counts up to ``K``; absolute ones where the frequencies do not allow them."""
    out, n1 = {}, n.get(1, 0)
    tail = (K + 1) * n.get(K + 1, 0) / n1 if n1 else 1.0
    for r in range(1, K + 1):
        nr, nr1 = n.get(r, 0), n.get(r + 1, 0)
        d = ((r + 1) * nr1 / (r * nr) - tail) / (1 - tail) if nr and tail < 1 else -1.0
        out[r] = d if 0.05 < d < 1 else (r - 0.5) / r
    return out


def discounted(c: np.ndarray, d: dict[int, float], above: float = 0.0) -> np.ndarray:
    """Discounted counts; those over ``K`` lose ``above``."""
    by = np.array([0.0] + [d[r] for r in range(1, K + 1)])
    return np.where(c > K, c - above, c * by[np.minimum(c, K).astype(_I)])


class Words:
    """The commonest words by rank, and the totals that a word's probability is made of."""

    def __init__(self, table: DataFrame, top: int, hot: int):
        total = table.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("key") == 1, F.col("c"))).alias("docs")).head()
        self.n, self.v, self.docs = total["n"] or 0, total["v"], total["docs"] or 0
        small = {r["c"]: r["count"] for r in table.filter(F.col("c") <= K + 1).groupBy("c").count().collect()}  # K + 1 rows
        self.d1 = discounts(small)
        n = float(max(1, self.n))
        free = sum(small.get(r, 0) * r * (1 - self.d1[r]) for r in range(1, K + 1)) / n if self.n else 1.0
        # Without any count to discount, a word never seen gets half a count.
        self.unseen = free if free > 0 else 0.5 / (n + 0.5)
        self.scale = ((1 - self.unseen) / (1 - free) if free < 1 else 0.0) / n
        # The least count that TOP words or fewer reach, from how many words lie between powers of two.
        bands = {r["b"]: r["count"] for r in table.groupBy((F.length(F.bin("c")) - 1).alias("b")).count().collect()}
        self.least, held = 1 << max(bands, default=0) + 1, 0
        while self.least > 1 and held + bands.get(self.least.bit_length() - 2, 0) <= top:
            self.least //= 2
            held += bands.get(self.least.bit_length() - 1, 0)
        known = table.filter(F.col("c") >= self.least).select("key", "c").toArrow()  # at most TOP rows of 16 bytes
        keys, c = (known[k].to_numpy() for k in ("key", "c"))
        by_key = np.argsort(keys.view(np.uint64), kind="stable")
        keys, c = keys.view(np.uint64)[by_key], c[by_key]
        #: Sorted keys, their numbers, and counts by number: the beginning of a text comes after all words.
        self.keys, self.number = keys, np.empty(len(keys), np.int32)
        order = np.lexsort((keys, -c))
        self.number[order] = np.arange(len(keys), dtype=np.int32)
        count = np.append(c[order], self.docs)
        self.begin = len(keys)
        #: Into how many parts, by number, a middle word is split.
        split = np.maximum(1, -(-2 * count // hot)) if hot else np.ones(len(count), _I)
        split[count < hot] = 1
        # Every task holds these: no wider than their numbers ask for.
        self.split, self.count = split.astype(np.min_scalar_type(int(split.max()))), count.astype(np.int32 if count.max() < 1 << 31 else _I)
        self.home = np.zeros(0, np.int32)

    def place(self, shards: int) -> None:
        """Shards of the commonest words: each goes to the one that has the fewest tokens by then, the rest being spread by hash."""
        heavy = self.count[: min(HEAVY, self.begin)]
        load = [((self.n - int(heavy.sum())) / shards, i) for i in range(shards)]
        heapq.heapify(load)
        self.home = np.zeros(len(heavy), np.int32)
        for k, c in enumerate(heavy.tolist()):
            have, i = load[0]
            self.home[k] = i
            heapq.heapreplace(load, (have + c, i))

    def key_of(self) -> np.ndarray:
        """Keys by number."""
        out = np.full(self.begin + 1, BEGIN, np.uint64)
        out[self.number] = self.keys
        return out

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of distinct keys, -1 for words without one."""
        if not len(self.keys):
            return np.where(keys == BEGIN, self.begin, -1).astype(np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.number[at], np.where(keys == BEGIN, self.begin, -1)).astype(np.int32)

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(count, self.d1) * self.scale, self.unseen)

    def floor(self, count: np.ndarray) -> np.ndarray:
        """Log of the add-half probability."""
        return np.log10((count + 0.5) / (self.n + 0.5 * (self.v + 1)))


def trigrams(tok: np.ndarray, first: np.ndarray, words: Words, buckets: int):
    """Distinct keys, their numbers, and of every token: ``a, b, c`` as places in them, the text, and the shard."""
    voc, c = np.unique(tok, return_inverse=True)
    c = c.astype(np.int32)
    at = int(np.searchsorted(voc, BEGIN))
    if at == len(voc) or voc[at] != BEGIN:
        voc = np.insert(voc, at, BEGIN)
        c += c >= at
    b, a = np.empty_like(c), np.empty_like(c)
    b[1:] = c[:-1]
    b[first[:-1]] = at
    a[1:] = b[:-1]
    a[first[:-1]] = at
    number = words.numbers(voc)
    key = mix(voc)
    # Only numbered words are split; the parts of one are told by a.
    parts = np.where(number >= 0, words.split[number], 1)[b]
    to = ((key[b] + (key[a] % parts.astype(np.uint64)) * _U(0xD1B54A32D192ED03)) % _U(buckets)).astype(np.int32)
    own = number[b]
    own = np.where((own >= 0) & (own < len(words.home)) & (parts == 1), own, -1)
    to = np.where(own >= 0, words.home[own], to) if len(words.home) else to
    return voc, number, a, b, c, np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first)), to


def lacking(docs: DataFrame, words: Words, shared, table: DataFrame, buckets: int) -> DataFrame | None:
    """``(bucket, kind, key, c)`` of what shards lack: counts of words without a number (kind 0), and of bigrams whose middle word is split (kind 1, ``key`` being the pair's)."""
    rare, hot = words.v > len(words.keys), bool((words.split > 1).any())
    least = words.least

    def run(batches):
        for tok, first, _, weight in runs(batches, RUN):
            voc, number, a, b, c, text, to = trigrams(tok, first, shared.value, buckets)
            out = []
            if rare:
                # With numbers from two occurrences on, a training word without one occurs once.
                ask = (number[c] < 0) & ((weight[text] == 0) | (least > 2))
                both = np.unique(np.stack([to[ask].astype(_I), c[ask]]), axis=1)
                out.append(pd.DataFrame({"bucket": both[0], "kind": 0, "key": voc[both[1]].view(_I), "c": 0}))
            if hot:
                split = np.flatnonzero(shared.value.split[np.maximum(number[b], 0)] * (number[b] >= 0) > 1)
                if len(split):
                    three, inv = np.unique(np.stack([to[split].astype(_I), b[split], c[split]]), axis=1, return_inverse=True)
                    out.append(pd.DataFrame({"bucket": three[0], "kind": 1, "key": pair(voc[three[1]], voc[three[2]]).view(_I), "c": np.bincount(inv.ravel(), weight[text[split]]).astype(_I)}))
            if out:
                yield pd.concat(out)

    if not rare and not hot:
        return None
    asked = store(docs.select("text", "key", "learns").mapInPandas(run, "bucket int, kind int, key long, c long").groupBy("bucket", "kind", "key").agg(F.sum("c").alias("c")), "lacking")
    few = asked.filter("kind = 0").select("bucket", "kind", "key").join(table.filter(F.col("c") < least), "key").select("bucket", "kind", "key", "c")
    whole = asked.filter("kind = 1").groupBy("key").agg(F.sum("c").alias("whole"))
    return few.unionByName(asked.filter("kind = 1").join(whole, "key").select("bucket", "kind", "key", F.col("whole").alias("c")))


def split_pairs(docs: DataFrame, words: Words, shared, table: DataFrame) -> DataFrame:
    """``(b, key, f, c)``: how often, in training, split middle words (by number) are followed by each word, and that word's count."""
    split, least = np.flatnonzero(words.split > 1), words.least

    def run(batches):
        for tok, first, _, weight in runs(batches, RUN):
            voc, number, _, b, c, text, _ = trigrams(tok, first, shared.value, 1)
            use = np.flatnonzero(np.isin(number[b], split) & (weight[text] > 0))
            if len(use):
                two, inv = np.unique(np.stack([b[use], c[use]]), axis=1, return_inverse=True)
                of = number[two[1]]
                c = np.where(of >= 0, shared.value.count[np.maximum(of, 0)], 1)  # one: with numbers from two occurrences on
                yield pd.DataFrame({"b": number[two[0]], "key": voc[two[1]].view(_I), "f": np.bincount(inv.ravel(), weight[text[use]]).astype(_I), "c": c.astype(_I)})

    pairs = docs.select("text", "key", "learns").mapInPandas(run, "b int, key long, f long, c long")
    pairs = pairs.groupBy("b", "key").agg(F.sum("f").alias("f"), F.max("c").alias("c"))
    if least > 2:
        rare = table.filter(F.col("c") < least).withColumnRenamed("c", "few")
        pairs = pairs.join(rare, "key", "left").select("b", "key", "f", F.coalesce("few", "c").alias("c"))
    return pairs


def encoded(tok, first, keys, weight, words: Words, buckets: int, run: int) -> pd.DataFrame:
    """A run's tokens by shard: words without a number have places after the numbered ones in the shard's own list. One piece has the run's texts: keys, tokens, and what numbered words add to known ones and to the base score."""
    voc, number, a, b, c, text, to = trigrams(tok, first, words, buckets)
    count = words.count[np.maximum(number, 0)]
    common = number >= 0
    known, base_score = (np.bincount(text, x[c], len(keys)) for x in (common & (count > 0), np.where(common, words.floor(count), 0.0)))
    texts = np.stack([keys, np.diff(first), known.astype(_I), base_score.view(_I)])
    base = words.begin + 1
    order = np.lexsort((number[a], number[b], to))
    groups = _groups(to[order])
    rows = []
    for k, (i, j) in enumerate(groups):
        at = order[i:j]
        three = np.stack([a[at], b[at], c[at]])
        own = np.unique(three[number[three] < 0])
        ids = np.where(number[three] >= 0, number[three], base + np.searchsorted(own, three)).astype(np.int32)
        docs, of = np.unique(text[at], return_inverse=True)
        named = squeezed(texts) if k == run % len(groups) else None
        rows.append((int(to[at[0]]), len(at), run, squeezed(ids[0]), squeezed(np.diff(ids[1], prepend=np.int32(0))), squeezed(ids[2]), squeezed(of.astype(np.int32)), squeezed(voc[own]), squeezed(np.diff(docs, prepend=np.int32(0))), squeezed(weight[docs]), named))
    return pd.DataFrame(rows, columns=["bucket", "n", "run", *_COLUMNS, "texts"])


_COLUMNS = ("a", "b", "c", "text", "own", "places", "weight")
_TYPES = ("int32", "int32", "int32", "int32", "uint64", "int64", "int64")


class Shard:
    """The tokens of one shard in order of ``b, a, c``, and their n-grams."""

    def __init__(self, rows: pd.DataFrame, base: int):
        self.base = base
        own = [unsqueezed(x, "uint64") for x in rows["own"]]
        self.own = np.unique(np.concatenate(own))
        #: Of each text, its run and its place there.
        places = [np.cumsum(unsqueezed(x, "int32"), dtype=_I) + (run << _PLACE) for x, run in zip(rows["places"], rows["run"].tolist(), strict=True)]
        self.places, self.weight = np.concatenate(places), np.concatenate([unsqueezed(x, "int64") for x in rows["weight"]])
        n, at, texts = rows["n"].tolist(), 0, 0
        self.a, self.b, self.c, self.text = (np.empty(sum(n), np.int32) for _ in range(4))
        for i, k in enumerate(n):
            place = np.append(np.searchsorted(self.own, own[i]), 0).astype(np.int32) + np.int32(base)
            for name in "abc":
                x = unsqueezed(rows[name].iloc[i], "int32")
                x = np.cumsum(x, dtype=np.int32) if name == "b" else x
                getattr(self, name)[at : at + k] = np.where(x < base, x, place[np.maximum(x - base, 0)])
            self.text[at : at + k] = unsqueezed(rows["text"].iloc[i], "int32") + texts
            at, texts = at + k, texts + len(places[i])
        self._sort()

    def _sort(self) -> None:
        """In order of ``b, a, c``: by one packed number where their bits fit, which takes the least memory."""
        middle, b = np.unique(self.b, return_inverse=True)
        bits = int(max(self.a.max(), self.c.max())).bit_length()
        if len(middle).bit_length() + 2 * bits > 63:
            order = np.lexsort((self.c, self.a, self.b))
            self.a, self.b, self.c, self.text = (x[order] for x in (self.a, self.b, self.c, self.text))
            return
        key = b.astype(_I).ravel() << bits
        del b
        key |= self.a
        key <<= bits
        key |= self.c
        order = np.argsort(key)
        self.text, key = self.text[order], key[order]
        del order
        low = (1 << bits) - 1
        self.c, self.a, self.b = (key & low).astype(np.int32), (key >> bits & low).astype(np.int32), middle[key >> 2 * bits]

    @classmethod
    def stored(cls, row, base: int) -> "Shard":
        s = cls.__new__(cls)
        s.base = base
        s.a, s.b, s.c, s.text, s.own, s.places, s.weight = (unsqueezed(getattr(row, k), t) for k, t in zip(_COLUMNS, _TYPES, strict=True))
        s.b, s.places = np.cumsum(s.b, dtype=np.int32), np.cumsum(s.places)
        return s

    def count(self, rare: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], words: Words) -> None:
        """Trigrams, their contexts and bigrams, with training counts. ``rare`` counts ``own``; ``pairs`` are sorted keys and counts of bigrams of split words."""
        new = np.append(True, self.b[1:] != self.b[:-1])
        new[1:] |= self.a[1:] != self.a[:-1]
        ctx = np.cumsum(new, dtype=np.int32) - 1
        new[1:] |= self.c[1:] != self.c[:-1]
        self.tri = np.cumsum(new, dtype=np.int32) - 1  # of each token
        at = np.flatnonzero(new)
        self.f3 = np.add.reduceat(self.weight.astype(np.int32)[self.text], at, dtype=np.int32)
        self.ctx = ctx[at]  # of each trigram
        del ctx, new
        self.word = np.concatenate([words.count, rare.astype(words.count.dtype)])
        tb, tc = self.b[at], self.c[at]
        del at
        key = tb.astype(_I) << 32
        key |= tc
        del tb, tc
        order = np.argsort(key)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        self.bi = np.empty(len(key), np.int32)  # of each trigram
        self.bi[order] = np.cumsum(new, dtype=np.int32) - 1
        del order
        key = key[new]
        self.bb, self.bc = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32)
        self.f2 = np.bincount(self.bi, self.f3, len(self.bb)).astype(_I)
        self.split = (self.bb < self.base) & (words.split[np.minimum(self.bb, self.base - 1)] > 1)
        if self.split.any():
            key_of = np.concatenate([words.key_of(), self.own])
            want = pair(key_of[self.bb[self.split]], key_of[self.bc[self.split]])
            where = np.minimum(np.searchsorted(pairs[0], want), len(pairs[0]) - 1)
            self.f2[self.split] = np.where(pairs[0][where] == want, pairs[1][where], 0)

    def scores(self, words: Words, d2, d3, hot: dict[int, float]) -> np.ndarray:
        """Log probability of every trigram by the recursion; ``hot`` has backoff weights of split words."""
        one, seen = words.p(self.word[self.bc]), self.f2 > 0
        new = np.append(True, self.bb[1:] != self.bb[:-1])
        middle, at = self.bb[new], np.cumsum(new, dtype=np.int32) - 1  # of each bigram
        # All that follows a word is here, unless it is split: then it is as often followed as it occurs.
        total = np.bincount(at, self.f2, len(middle))
        split = self.split[new]
        total[split] = self.word[middle[split]]
        q2 = discounted(self.f2, d2, ABOVE) / np.maximum(1, total[at])
        freed, taken = (np.bincount(at[seen], x[seen], len(middle)) for x in (q2, one))
        back = np.where(total > 0, np.maximum(1 - freed, 1e-300) / np.maximum(1 - taken, 1e-300), 1.0)
        for b, w in hot.items():
            back[middle == b] = w
        p2 = np.where(seen, q2, back[at] * one)
        del one, q2, at, back, freed, taken
        total = np.bincount(self.ctx, self.f3)
        q3 = discounted(self.f3, d3, ABOVE) / np.maximum(1, total[self.ctx])
        seen = self.f3 > 0
        freed, taken = (np.bincount(self.ctx[seen], x[seen], len(total)) for x in (q3, p2[self.bi]))
        back = np.where(total > 0, np.maximum(1 - freed, 1e-300) / np.maximum(1 - taken, 1e-300), 1.0)
        return np.log10(np.where(seen, q3, back[self.ctx] * p2[self.bi]))

    def sums(self, words: Words, log_p: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each text, by its place: known tokens and base score of words without a number, and the score of all."""
        rare = np.flatnonzero(self.c >= self.base)
        count, n = self.word[self.c[rare]], len(self.places)
        known, base_score = (np.bincount(self.text[rare], x, n) for x in (count > 0, words.floor(count)))
        return self.places, known, base_score, np.bincount(self.text, log_p[self.tri], n)


def by_run(sums: list) -> pd.DataFrame:
    """What shards have added up, a row a run: places, known tokens and both scores."""
    places, *each = (np.concatenate(x) for x in zip(*sums, strict=True))
    voc, at = np.unique(places, return_inverse=True)
    known, base_score, score = (np.bincount(at, x, len(voc)) for x in each)
    known, place = known.astype(np.int32), (voc & ((1 << _PLACE) - 1)).astype(np.int32)
    rows = [(int(voc[i]) >> _PLACE, squeezed(np.diff(place[i:j], prepend=np.int32(0))), *(squeezed(x[i:j]) for x in (known, base_score, score))) for i, j in _groups(voc >> _PLACE)]
    return pd.DataFrame(rows, columns=["run", "places", "known", "base_score", "score"])


class Model:
    """Counts of the rows of ``docs`` whose ``learns`` is true: words, the stored shards around all rows' tokens, and the discounts of each order."""

    def __init__(self, docs: DataFrame, learns: Column, top: int = TOP, hot: int = HOT, shard: int = SHARD):
        spark = docs.sparkSession
        small_batches(spark)
        rows = docs.select("text", F.xxhash64("text").alias("key"), F.coalesce(learns, F.lit(False)).alias("learns"))
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        table = word_counts(rows, least)
        words = self.words = Words(table, top, hot)
        self.table = table
        size = rows.agg(F.sum(F.length("text"))).head()[0] or 0
        buckets = self.buckets = max(12, int(size // (5 * shard)) + 1)
        words.place(buckets)
        shared = self.shared = spark.sparkContext.broadcast(words)  # TOP words, whatever the input
        lacks = lacking(rows, words, shared, table, buckets)
        if lacks is None:
            lacks = spark.createDataFrame([], "bucket int, kind int, key long, c long")
        self.hot: dict[int, float] = {}

        def run(batches):
            task = TaskContext.get().partitionId()
            for k, (tok, first, keys, weight) in enumerate(runs(batches, RUN)):
                yield encoded(tok, first, keys, weight, shared.value, buckets, task << 16 | k)
            tidy()

        def merge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            release()
            names = ["bucket", "n", *_COLUMNS, "rare", "pairs", "pair_counts", "n2", "n3", "runs", "texts"]
            if not len(left):
                return pd.DataFrame(columns=names)
            w = shared.value
            s = Shard(left, w.begin + 1)
            few, two = (right[right["kind"] == k].sort_values("key", key=lambda x: x.to_numpy(_I).view(np.uint64)) for k in (0, 1))
            rare = np.zeros(len(s.own), _I)
            if len(few):
                key = few["key"].to_numpy(_I).view(np.uint64)
                at = np.minimum(np.searchsorted(key, s.own), len(key) - 1)
                rare = np.where(key[at] == s.own, few["c"].to_numpy(_I)[at], 0)
            if w.least <= 2:  # then a word without a number occurs once if a training text has it
                use = (s.c >= s.base) & (s.weight[s.text] > 0)
                rare[s.c[use] - s.base] = 1
            key, c = two["key"].to_numpy(_I).view(np.uint64), two["c"].to_numpy(_I)
            s.count(rare, (key, c), w)
            f2 = s.f2[~s.split]
            n2, n3 = (np.bincount(np.minimum(f, K + 2), minlength=K + 3)[1 : K + 2].tolist() for f in (f2, s.f3))
            out = [squeezed(np.ascontiguousarray(x)) for x in (s.a, np.diff(s.b, prepend=np.int32(0)), s.c, s.text, s.own, np.diff(s.places, prepend=0), s.weight, rare, key, c)]
            have = left[left["texts"].notna()]
            return pd.DataFrame([(int(left["bucket"].iloc[0]), len(s.a), *out, n2, n3, have["run"].tolist(), have["texts"].tolist())], columns=names)

        blob = ", ".join(f"{c} binary" for c in _COLUMNS)
        sent = rows.mapInPandas(run, f"bucket int, n int, run long, {blob}, texts binary")
        shards = sent.groupBy("bucket").cogroup(lacks.groupBy("bucket")).applyInPandas(merge, f"bucket int, n int, {blob}, rare binary, pairs binary, pair_counts binary, n2 array<long>, n3 array<long>, runs array<long>, texts array<binary>")
        self.shards = store(shards, "ngrams")
        freq = self.shards.select(*[F.sum(F.col(f"n{o}")[r]).alias(f"n{o}_{r + 1}") for o in (2, 3) for r in range(K + 1)]).head()
        n2, n3 = ({r: freq[f"n{o}_{r}"] or 0 for r in range(1, K + 2)} for o in (2, 3))
        split = self._split_words(rows) if (words.split > 1).any() else []
        for r in split:
            n2 = {k: n + r[f"f{k}"] for k, n in n2.items()}
        self.d2, self.d3 = discounts(n2), discounts(n3)
        for r in split:
            kept = sum(self.d2[k] * k * r[f"f{k}"] for k in range(1, K + 1)) + (r["large"] or 0) - ABOVE * r["many"]
            self.hot[r["b"]] = max(1 - kept / max(1, int(words.count[r["b"]])), 1e-300) / max(1 - r["p"], 1e-300)
        drop(table)

    def _split_words(self, rows: DataFrame) -> list:
        """Counts that split words' backoff weights are made of: a row a word reaches the driver, and only words of ``HOT`` tokens are split."""
        c = F.col("c")
        d = F.when(c > K, c.cast("double"))
        for r in range(1, K + 1):
            d = d.when(c == r, F.lit(r * self.words.d1[r]))
        few = [F.count_if(F.col("f") == r).alias(f"f{r}") for r in range(1, K + 2)]
        joined = split_pairs(rows, self.words, self.shared, self.table).withColumn("p", d * F.lit(self.words.scale))
        return joined.groupBy("b").agg(*few, F.sum(F.when(F.col("f") > K, F.col("f"))).alias("large"), F.count_if(F.col("f") > K).alias("many"), F.sum("p").alias("p")).collect()

    def scores(self) -> DataFrame:
        """``key, n_tokens, n_known, base_score, score`` of every different text."""
        shared, d2, d3, hot = self.shared, self.d2, self.d3, self.hot

        def run(batches):
            held, size = [], 0
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    w = shared.value
                    s = Shard.stored(row, w.begin + 1)
                    s.count(unsqueezed(row.rare, "int64"), (unsqueezed(row.pairs, "uint64"), unsqueezed(row.pair_counts, "int64")), w)
                    s.a = s.b = None  # counted
                    held.append(s.sums(w, s.scores(w, d2, d3, hot)))
                    size += len(s.places)
                    del s
                    if size >= SUMS:
                        yield by_run(held)
                        held, size = [], 0
            if held:
                yield by_run(held)
            tidy()

        def total(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            keys, n_tokens, n_known, base_score = unsqueezed(left["texts"].iloc[0], "int64").reshape(4, -1)
            base_score, score = base_score.view(np.float64), np.zeros(len(keys))
            for row in right.itertuples(index=False):
                at = np.cumsum(unsqueezed(row.places, "int32"))
                n_known[at] += unsqueezed(row.known, "int32")
                base_score[at] += unsqueezed(row.base_score, "float64")
                score[at] += unsqueezed(row.score, "float64")
            return pd.DataFrame({"key": keys, "n_tokens": n_tokens, "n_known": n_known, "base_score": base_score, "score": score})

        columns = [c for c in self.shards.columns if c not in ("runs", "texts")]
        # A task has four shards, as what several of them add to a text is sent once.
        parts = self.shards.select(columns).coalesce(max(12, -(-self.buckets // 4))).mapInPandas(run, "run long, places binary, known binary, base_score binary, score binary")
        texts = self.shards.select(F.explode(F.arrays_zip("runs", "texts")).alias("x")).select(F.col("x.runs").alias("run"), F.col("x.texts").alias("texts"))
        whole = texts.groupBy("run").cogroup(parts.groupBy("run")).applyInPandas(total, "key long, n_tokens long, n_known long, base_score double, score double")
        with single_rows(self.shards.sparkSession):
            # Every run that held the text has all of its tokens.
            return store(whole.groupBy("key").agg(*[F.min(c).alias(c) for c in whole.columns[1:]]), "scores")


def score(docs: DataFrame, learns: Column, **limits) -> tuple[DataFrame, Model]:
    """``doc_id, n_tokens, n_known, base_score, score`` of every row, by a model of the rows for which ``learns`` holds; and that model.

    ``base_score`` is the add-half unigram one. A null or empty text is its end
    alone. Repeated rows each have a row, and count as often in training; other
    columns are not used; no rows give no rows. Without training text every token
    is one never seen.
    """
    model = Model(docs, learns, **limits)
    got = model.scores()
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"))
    return ids.join(got, "key").select("doc_id", "n_tokens", "n_known", "base_score", "score"), model
