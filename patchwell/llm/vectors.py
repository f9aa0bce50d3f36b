"""Nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Equal vectors are one entry with their smallest ids, so a vector that fills a
third of the table is searched once. Centroids and codebooks are fitted on a
bounded sample; every vector is assigned and coded. A query probes its nearest
lists and gets a distance to each entry by asymmetric distance tables over the
codes. That is off by at most the length of what the codes leave out, which is
kept beside them; so all entries are ranked again by their exact distance that
can be among the best, and none that a probed list holds is lost. How many lists
are probed is found by the recall of up to ``TRIALS`` of the queries against brute
force over the whole table.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import store

TOP = 10
SAMPLE = 20_000
PARTS, CODES = 16, 256
#: Entries that a query's lists hold together at least.
LEAST = 200
TRIALS, RECALL = 200, 0.98
#: Lists for each square root of the entries: finer ones are probed in a smaller share of the table.
FINE = 4
#: Entries of one list that a task holds, and components of their vectors; longer lists are dealt out.
LIST_PART, LIST_VALUES = 50_000, 8_000_000


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (c * c).sum(axis=1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (half - x[i : i + 4096] @ c.T).argmin(axis=1)
    return out


def cutoff(value: np.ndarray, cid: np.ndarray, k: int) -> float:
    """The least value up to which there are ``k`` different ids; infinite with fewer."""
    order = np.argsort(value, kind="stable")
    for n in (4 * k, len(order)):
        first = np.sort(np.unique(cid[order[:n]], return_index=True)[1])
        if len(first) >= k:
            return float(value[order[first[k - 1]]])
    return np.inf


class Quantiser:
    """Coarse centroids and one codebook a part of the dimensions."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.coarse = kmeans(sample, lists)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        edge = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int)
        self.cut = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
        self.books = [kmeans(rest[:, a:b], CODES) for a, b in self.cut]
        self.probes = len(self.coarse)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes, and the length of what the codes leave out."""
        at = nearest(x, self.coarse)
        rest = x - self.coarse[at]
        codes = np.stack([nearest(rest[:, a:b], m) for (a, b), m in zip(self.cut, self.books, strict=True)], axis=1).astype(np.uint8)
        for i, ((a, b), m) in enumerate(zip(self.cut, self.books, strict=True)):
            rest[:, a:b] -= m[codes[:, i]]
        return at, codes, np.sqrt((rest * rest).sum(axis=1))

    def terms(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What an entry adds to any query's squared distance: of its decoded residual ``m`` and centroid ``c``, ``m.m + 2 c.m``."""
        out = np.zeros(len(codes))
        for i, ((a, b), m) in enumerate(zip(self.cut, self.books, strict=True)):
            own = m[codes[:, i]]
            out += (own * own).sum(axis=1) + 2 * (self.coarse[lists, a:b] * own).sum(axis=1)
        return out

    def far(self, q: np.ndarray, lists: np.ndarray, codes: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Squared distances of entries' codes to a query, by its distance tables: ``|q - c|^2 + terms - 2 q.m``."""
        near = ((self.coarse - q) ** 2).sum(axis=1)[lists] + terms
        for i, ((a, b), m) in enumerate(zip(self.cut, self.books, strict=True)):
            near -= 2 * (m @ q[a:b])[codes[:, i]]
        return np.maximum(near, 0)

    def probed(self, q: np.ndarray, size: np.ndarray, probes: int | None = None) -> np.ndarray:
        """The nearest ``probes`` lists, and as many more as hold ``LEAST`` entries."""
        order = ((self.coarse - q) ** 2).sum(axis=1).argsort(kind="stable")
        enough = int(np.searchsorted(np.cumsum(size[order]), LEAST)) + 1
        return order[: max(probes or self.probes, enough)]

    def settle(self, qs: list[np.ndarray], truth: list[np.ndarray], size: np.ndarray) -> None:
        """The fewest probes with which the lists of the true neighbours are probed to ``RECALL``; all lists lose none.

        Vectors without any grouping need many; a warning says so where it is
        more than half of the lists.
        """
        place = []
        for q, t in zip(qs, truth, strict=True):
            order = ((self.coarse - q) ** 2).sum(axis=1).argsort(kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            enough = int(np.searchsorted(np.cumsum(size[order]), LEAST)) + 1
            place.append(np.where(rank[t] < enough, 0, rank[t]))
        place = np.sort(np.concatenate(place)) if place else np.zeros(0, np.int64)
        self.probes = int(place[min(len(place) - 1, int(np.ceil(RECALL * len(place))) - 1)]) + 1 if len(place) else len(self.coarse)
        if self.probes > max(8, len(self.coarse) // 2):
            warnings.warn(f"{self.probes} of {len(self.coarse)} lists are probed: these vectors have hardly any groups", stacklevel=2)


def usable(table: DataFrame) -> DataFrame:
    """Rows with an id whose vector is whole: not null, not all 0, no null or non-finite component."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    zero = ~F.exists(v, lambda x: x != 0)
    return table.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(~bad & ~zero).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"))


def search(table: DataFrame, every: int = 100, top: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score`` for each query row (``vec_id`` divisible by ``every``).

    Vectors that are null, zero or hold null or non-finite components take no
    part, nor do those whose dimension is not the table's commonest. A repeated
    id is searched once a distinct vector. Ties go to the smaller id. With fewer
    candidates, all are returned; without queries, no rows.
    """
    spark = table.sparkSession
    none = "query_id long, rank int, vec_id long, score double"
    good = usable(table)
    size = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").head()
    if size is None:
        return spark.createDataFrame([], none)
    good = good.filter(F.size("embedding") == size["d"]).dropDuplicates()

    def fewest(batches):
        for pdf in batches:
            if len(pdf):
                key = [np.asarray(v, np.float64).tobytes() for v in pdf["embedding"]]
                g = pd.DataFrame({"embedding": key, "id": pdf["vec_id"]}).groupby("embedding")["id"].apply(lambda s: sorted(s)[: top + 1])
                yield pd.DataFrame({"vec": g.index, "ids": g.to_numpy()})

    # At most top + 1 ids a batch and vector reach the shuffle, and stay.
    few = good.mapInPandas(fewest, "vec binary, ids array<long>")
    entries = store(few.groupBy("vec").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, top + 1).alias("ids")).withColumn("cid", F.col("ids")[0]), "vectors")
    n = entries.count()
    drawn = entries.filter(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < int(np.ceil(min(1.0, SAMPLE / n) * (1 << 20)))).select("vec").limit(2 * SAMPLE).toPandas()["vec"]
    sample = np.frombuffer(b"".join(drawn if len(drawn) else entries.limit(1000).toPandas()["vec"]), np.float64).reshape(-1, size["d"])
    quant = Quantiser(sample, max(1, min(FINE * int(np.sqrt(n)), 8192, len(sample) // 4 or 1)))
    shared = spark.sparkContext.broadcast(quant)  # bounded by the sample and 8192 lists

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                x = np.frombuffer(b"".join(pdf["vec"]), np.float64).reshape(len(pdf), -1)
                at, codes, off = shared.value.code(x)
                yield pd.DataFrame({"list": at, "cid": pdf["cid"], "codes": [c.tobytes() for c in codes], "off": off, "vec": pdf["vec"]})

    index = store(entries.select("vec", "cid").mapInPandas(assign, "list int, cid long, codes binary, off double, vec binary"), "index")
    sizes = np.zeros(len(quant.coarse), np.int64)
    for r in index.groupBy("list").count().toLocalIterator():  # a row a list
        sizes[r["list"]] = r["count"]
    held = max(1, min(LIST_PART, LIST_VALUES // size["d"]))
    parts = np.maximum(1, -(-sizes // held))
    spread = max(24, int(spark.conf.get("spark.sql.shuffle.partitions")), int(sizes.sum()) // held)
    asked = good.filter(F.col("vec_id") % every == 0)
    trial = [np.asarray(r["embedding"], np.float64) for r in asked.orderBy(F.xxhash64("vec_id", "embedding")).limit(TRIALS).collect()]

    def closest(batches):
        d, at = np.full((len(trial), top + 1), np.inf), np.full((len(trial), top + 1), -1)
        for pdf in batches:
            x, own = np.frombuffer(b"".join(pdf["vec"]), np.float64).reshape(len(pdf), -1), pdf["list"].to_numpy(np.int64)
            for i, q in enumerate(trial):
                both = np.append(d[i], ((x - q) ** 2).sum(axis=1))
                best = np.argpartition(both, top)[: top + 1]
                d[i], at[i] = both[best], np.append(at[i], own)[best]
        i, j = np.nonzero(at >= 0)
        yield pd.DataFrame({"i": i, "d": d[i, j], "list": at[i, j]})

    w = Window.partitionBy("i").orderBy("d")
    true = index.select("vec", "list").coalesce(spread).mapInPandas(closest, "i int, d double, list int")
    true = true.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top + 1).toPandas()  # TRIALS * (top + 1) rows
    quant.settle(trial, [true["list"].to_numpy()[true["i"] == i] for i in range(len(trial))], sizes)
    probes = quant.probes

    def route(batches):
        for pdf in batches:
            rows = [(int(i), np.asarray(v, np.float64).tobytes(), int(k), p) for i, v in zip(pdf["vec_id"], pdf["embedding"], strict=True) for k in shared.value.probed(np.asarray(v), sizes, probes) for p in range(parts[k])]
            yield pd.DataFrame(rows, columns=["query_id", "q", "list", "part"])

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not len(right):
            return pd.DataFrame({"query_id": [], "q": [], "cid": [], "vec": [], "score": []})
        right = right.sort_values("list", kind="stable")
        own, cid, off = (right[k].to_numpy() for k in ("list", "cid", "off"))
        codes, vec = np.frombuffer(b"".join(right["codes"]), np.uint8).reshape(len(right), -1), np.frombuffer(b"".join(right["vec"]), np.float64).reshape(len(right), -1)
        terms = shared.value.terms(own, codes)
        for (i, q), g in left.groupby(["query_id", "q"]):
            v, want = np.frombuffer(q, np.float64), np.unique(g["list"])
            ends = zip(np.searchsorted(own, want).tolist(), np.searchsorted(own, want, side="right").tolist(), strict=True)
            at = np.concatenate([np.arange(a, b) for a, b in ends])
            if len(at):
                c, off_at = cid[at], off[at]
                d = np.sqrt(shared.value.far(v, own[at], codes[at], terms[at]))
                most = cutoff(d + off_at, c, top + 1)
                # Differences of squares are less exact than distances: what they may be off by is left open too.
                can = d - off_at <= most + 1e-6 * (most + np.sqrt((v * v).sum()))
                x = vec[at[can]]
                c, d = c[can], np.sqrt(((v - x) ** 2).sum(axis=1))
                best = np.lexsort((c, d))
                # As many as have top + 1 different ids: ids repeat only where one stands for several vectors.
                best = best[: np.sort(np.unique(c[best], return_index=True)[1])[: top + 1][-1] + 1]
                out.append(pd.DataFrame({"query_id": i, "q": q, "cid": c[best], "vec": [y.tobytes() for y in x[best]], "score": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "q": [], "cid": [], "vec": [], "score": []})

    # As many groups as the index needs, whatever the partitions: each returns its own best entries of a query.
    deal = lambda: F.pmod(F.xxhash64("list", "part"), F.lit(spread)).cast("int").alias("deal")
    long = {int(k): int(parts[k]) for k in np.flatnonzero(parts > 1)}
    split = index.withColumn("parts", F.lit(1)) if not long else index.join(F.broadcast(spark.createDataFrame(list(long.items()), "list int, parts int")), "list", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))  # at most a row a list
    # Explicit partitions: groups are few and small, but their work is not, so they are not put together.
    left = asked.mapInPandas(route, "query_id long, q binary, list int, part int").select("*", deal()).repartition(spread, "deal")
    right = split.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).drop("parts").select("*", deal()).repartition(spread, "deal")
    near = left.groupBy("deal").cogroup(right.groupBy("deal")).applyInPandas(rank, "query_id long, q binary, cid long, vec binary, score double")
    scored = near.join(entries.select("vec", "ids"), "vec")
    each = scored.select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
