"""Language identification by interpolated Kneser-Ney character models.

Each language has one model over the letters of its words, from unigrams to
``ORDER``-grams, a word being framed by its edges. Counts of ``c`` after ``h``
give ``max(count - D, 0) / total(h) + D * types(h) / total(h) * lower``, with
continuation counts below the highest order and one discount an order. All
languages share sorted arrays of n-gram hashes with a row of values each, found
by binary search. A text goes to the language of the lowest cross-entropy a
character; one that lies far outside of what held-out training texts have is
rejected.

Training uses a bounded sample of ``MAX_DOCS`` documents over all languages;
counts, limits of rejection and predictions are of whole texts.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import crc, mapped, owned, release, tidy
from .words import mix

ORDER = 4
MAX_DOCS = 8_000
UNKNOWN = "und"
#: Rejection: a text lies ``FAR`` times as far out as all but ``SHARE`` of the held-out texts of its language, for its length.
SHARE, FAR = 0.01, 3.0
#: Nats a letter beyond the mean up to which none is rejected: few held-out texts say little about the spread.
NEAR = 0.6
_U = np.uint64
_word = re.compile(r"[^\W\d_]+").findall
_EDGE = 1


def letters(text: str) -> list[str]:
    """Lower-cased words of letters. Digits of other kinds count only beside real letters."""
    words = _word(text.lower())
    return words if any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w) else []


def gram_hashes(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For orders 0 to ``ORDER``, the hash of the last letters up to each place; and each place's word.

    Places are a word's letters and its end. Order ``n`` at a place covers its
    letter and the ``n - 1`` before, edges included; order 0 is the same for all.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    text = np.frombuffer(("\x01".join(words) + "\x01").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    # Each word is followed by its end; the end of the word before stands for its beginning.
    out = [np.zeros(len(text), np.uint64)]
    owner = np.repeat(np.arange(len(words)), size + 1)
    first = np.cumsum(size + 1) - size - 1
    since = np.arange(len(text)) - first[owner]
    h = np.zeros(len(text), np.uint64)
    for n in range(1, ORDER + 1):
        ahead = np.full(len(text), _EDGE, np.uint64)
        ahead[n - 1 :] = text[: len(text) - n + 1]
        ahead[since < n - 1] = _EDGE
        h = mix(h + (ahead + _U(n << 32)) * _U(0x9E3779B97F4A7C15))
        out.append(h.copy())
    return out, owner


def context_hashes(words: list[str]) -> list[np.ndarray]:
    """For orders 1 to ``ORDER``, the hash of the ``n - 1`` letters before each place (0 for none)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    text = np.frombuffer(("\x01".join(words) + "\x01").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size + 1)
    since = np.arange(len(text)) - (np.cumsum(size + 1) - size - 1)[owner]
    out, h = [np.zeros(len(text), np.uint64)], np.zeros(len(text), np.uint64)
    for n in range(1, ORDER):
        back = np.full(len(text), _EDGE, np.uint64)
        back[n:] = text[: len(text) - n]
        back[since < n] = _EDGE
        h = mix(h + (back + _U(n << 32)) * _U(0xC2B2AE3D27D4EB4F))
        out.append(h.copy())
    return out


def fit_language(words: Counter) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """Sorted hashes and values: ``("gram", n)`` has the discounted share, ``("context", n)`` the weight of the lower order."""
    vocab = list(words)
    grams, owner = gram_hashes(vocab)
    contexts = context_hashes(vocab)
    weight = np.fromiter((words[w] for w in vocab), np.float64, len(vocab))[owner]
    out = []
    for n in range(ORDER, 0, -1):
        g, first, inv = np.unique(grams[n], return_index=True, return_inverse=True)
        ctx = contexts[n - 1][first]
        if n == ORDER:
            count = np.bincount(inv, weight)
        else:  # how many different letters (or edges) stand before it: each wider n-gram ends with one of these
            count = np.bincount(inv[wider], minlength=len(g)).astype(float)
        wider = first
        n1, n2 = (count == 1).sum(), (count == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n1 + 2 * n2 else 0.5
        c, back = np.unique(ctx, return_inverse=True)
        total, kinds = np.bincount(back, count), np.bincount(back)
        if n < ORDER:
            grams[n + 1] = None  # done with
        contexts[n - 1] = None
        out.append(("gram", n, g, np.maximum(count - d, 0) / total[back]))
        out.append(("context", n, c, d * kinds / total))
    return out


def calibrated(h: np.ndarray, n: np.ndarray) -> tuple[float, float, float, float]:
    """From cross-entropies of held-out texts and their lengths: the mean, the two parts of the variance, and the largest distance in deviations.

    The parts are fitted twice, the second time without the ``SHARE`` farthest out.
    """
    mean = float((h * n).sum() / n.sum())
    use = np.ones(len(h), bool)
    for _ in range(2):
        x = np.stack([np.ones(use.sum()), 1 / n[use]], axis=1)
        a, b = np.linalg.lstsq(x * n[use, None] ** 0.5, (h[use] - mean) ** 2 * n[use] ** 0.5, rcond=None)[0]
        a, b = max(float(a), 0.02**2), max(float(b), 0.0)
        z = np.abs(h - mean) / np.sqrt(a + b / n)
        use = z <= np.quantile(z, 1 - SHARE)
    return mean, a, b, FAR * max(1.0, float(np.quantile(z, 1 - SHARE)))


class Model:
    """Merged sorted arrays of all languages."""

    def __init__(self, langs: list[str], parts: dict[str, list]):
        self.langs, self.limit, self.ident = langs, {}, uuid.uuid4().hex
        self.alphabet = 1e4
        self.table = {}
        for kind in ("gram", "context"):
            for n in range(1, ORDER + 1):
                own = [next((h, v) for k, m, h, v in parts[x] if (k, m) == (kind, n)) for x in langs]
                keys = np.unique(np.concatenate([h for h, _ in own]))
                value = np.full((len(keys) + 1, len(langs)), 0.0 if kind == "gram" else 1.0, np.float32)
                for i, (h, v) in enumerate(own):
                    value[np.searchsorted(keys, h), i] = v
                self.table[kind, n] = (keys, value)

    def _find(self, kind: str, n: int, h: np.ndarray) -> np.ndarray:
        keys, value = self.table[kind, n]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return value[np.where(keys[at] == h, at, len(keys))]

    def score(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word (its end included) by language."""
        if not words:
            return np.zeros((0, len(self.langs)))
        grams, owner = gram_hashes(words)
        contexts = context_hashes(words)
        p = np.full((len(owner), len(self.langs)), 1 / self.alphabet)
        for n in range(1, ORDER + 1):
            p = self._find("gram", n, grams[n]) + self._find("context", n, contexts[n - 1]) * p
        cut = np.flatnonzero(np.diff(owner, prepend=-1))
        return np.add.reduceat(np.log(p), cut, axis=0)


class Scorer:
    """A worker's cache of word scores before it, bounded to ``limit`` words."""

    def __init__(self, model: Model, limit: int = 300_000):
        self.model, self.limit = model, limit
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.langs)), np.float32)

    def texts(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Summed log probabilities by language, and letters with word ends, of each text."""
        cut = [letters(t) if isinstance(t, str) else [] for t in texts]
        new = [w for w in set().union(*cut) if w not in self.at] if cut else []
        if len(self.at) + len(new) > self.limit:
            self.at, self.rows = {}, self.rows[:0]
            new = list(set().union(*cut))
        if new:
            made = [self.model.score(new[i : i + 50_000]).astype(np.float32) for i in range(0, len(new), 50_000)]
            self.at.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, *made])
        total, n, get = np.zeros((len(cut), len(self.model.langs))), np.zeros(len(cut)), self.at.__getitem__
        for i, w in enumerate(cut):
            if w:
                total[i] = self.rows[np.fromiter(map(get, w), np.int64, len(w))].sum(axis=0, dtype=np.float64)
                n[i] = sum(map(len, w)) + len(w)
        return total, n


def worker_scorer(model: Model) -> Scorer:
    """The worker's own scorer of a model; a Python worker keeps its words between tasks."""
    return owned(("scorer", model.ident), lambda: Scorer(model))


def fit(labelled: DataFrame, max_docs: int = MAX_DOCS) -> Model | None:
    """From ``(doc_id, text, lang)``; None without a usable row. Nine tenths give counts, a tenth the limits of rejection."""
    rows = labelled.filter("lang is not null and text is not null").withColumn("draw", F.crc32(F.concat(F.lit("sample "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")) / F.lit(float(1 << 32)))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = {k: min(1.0, max_docs / len(counts) / n) for k, n in counts.items()}
    spark = labelled.sparkSession
    part = rows.join(F.broadcast(spark.createDataFrame(list(share.items()), "lang string, share double")), "lang").filter("draw < share")  # a row a language
    part = part.select("lang", "text", (F.col("draw") * 10 < F.col("share")).alias("held"))

    few = [r["lang"] for r in part.groupBy("lang").count().filter("count < 20").collect()]  # a row a language

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        by: dict[str, Counter] = {}
        for lang, t in zip(pdf["lang"], pdf["text"], strict=True):
            by.setdefault(lang, Counter()).update(letters(t))
        return pd.DataFrame([(lang, w, n) for lang, c in by.items() for w, n in c.items()], columns=["lang", "word", "n"])

    words = mapped(part.filter(~F.col("held") | F.col("lang").isin(few)), count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def learn(key, pdf: pd.DataFrame) -> pd.DataFrame:
        release()
        parts = fit_language(Counter(dict(zip(pdf["word"], pdf["n"].tolist(), strict=True)))) if len(pdf) else []
        tidy()
        return pd.DataFrame([(key[0], k, n, h.tobytes(), v.tobytes()) for k, n, h, v in parts], columns=["lang", "kind", "n", "hash", "value"])

    parts: dict[str, list] = {}
    for r in words.groupBy("lang").applyInPandas(learn, "lang string, kind string, n int, hash binary, value binary").toLocalIterator():
        parts.setdefault(r["lang"], []).append((r["kind"], r["n"], np.frombuffer(r["hash"], np.uint64), np.frombuffer(r["value"])))
    if not parts:
        return None
    model = Model(sorted(parts), parts)

    def entropy(pdf: pd.DataFrame) -> pd.DataFrame:
        total, n = Scorer(model).texts(pdf["text"])
        i = pdf["lang"].map({x: k for k, x in enumerate(model.langs)}).fillna(-1).astype(int).to_numpy()
        ok = (n > 0) & (i >= 0)
        return pd.DataFrame({"lang": pdf["lang"][ok], "h": -total[ok, i[ok]] / n[ok], "n": n[ok]})

    held = mapped(part.filter("held"), entropy, "lang string, h double, n double").toPandas()  # a tenth of the bounded sample, without its texts
    model.limit = {lang: calibrated(g["h"].to_numpy(), g["n"].to_numpy()) for lang, g in held.groupby("lang")}
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred, score, cross_entropy, rejected``.

    A null text or one without letters is ``und``, with score 0, and rejected; so
    is every text if there is no model. Of equal cross-entropies the first
    language by name wins. Rows stay as they are, repeated ones included; result
    names replace clashing ones; no rows give no rows.
    """
    own = ["lang_pred", "score", "cross_entropy", "rejected"]
    keep = [c for c in docs.columns if c not in own]
    kept = docs.select(F.struct(*keep).alias("row"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it is fitted on

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = shared.value
        if m is None:
            return pd.DataFrame({"row": pdf["row"], "lang_pred": UNKNOWN, "score": 0.0, "cross_entropy": None, "rejected": True})
        total, n = worker_scorer(m).texts(pdf["text"])
        h = -total / np.maximum(n, 1)[:, None]
        best = h.argmin(axis=1)
        least = h[np.arange(len(h)), best]
        # Posterior over languages, each text counted as at most 50 independent letters.
        x = np.exp(-(h - least[:, None]) * np.minimum(n, 50)[:, None])
        name = np.array(m.langs, object)[best]
        mean, a, b, z = np.array([m.limit.get(x, (0.0, np.inf, 0.0, 1.0)) for x in m.langs])[best].T
        limit = mean + np.maximum(NEAR, z * np.sqrt(a + b / np.maximum(n, 1)))
        some = n > 0
        return pd.DataFrame({
            "row": pdf["row"], "lang_pred": np.where(some, name, UNKNOWN), "score": np.where(some, 1 / x.sum(axis=1), 0.0),
            "cross_entropy": np.where(some, least, np.nan), "rejected": ~some | (least > limit),
        })

    schema = f"row {kept.schema['row'].dataType.simpleString()}, lang_pred string, score double, cross_entropy double, rejected boolean"
    return mapped(kept, run, schema).select(*[F.col("row")[c].alias(c) for c in keep], *own)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that are not rejected, columns as they came."""
    return identify(docs, model).filter(~F.col("rejected")).select(*docs.columns)
