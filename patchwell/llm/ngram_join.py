"""Near-duplicate join on word shingles: count-vector R-trees behind an exact prefix filter.

A document's set is its distinct five-word shingles. Two sets link when
``100 * |A & B| >= 75 * |A | B|``, that is when ``7 * |A & B| >= 3 * (|A| + |B|)``.

1. *Classes.* Equal sets become one class, so copies are never paired.
2. *Groups.* Linked sets share one of their first ``n - ceil(3n/4) + 1`` shingles
   in any common order. The order is rarest first by a fixed-size count table of
   the whole corpus, so passages that many documents share come last. Classes
   with such a shingle in common are put together under the smallest hash among
   them; groups that many shingles give are one.
3. *R-tree.* A class is a point: its shingles hashed into token groups and counted.
   A task holds the sets of one cell of a group and loads its points into an
   R-tree. The sum over token groups of the smaller maxima bounds the overlap of
   anything under two nodes, and the sum of the smaller counts that of two
   points; subtrees that cannot reach the threshold are pruned, and so are those
   whose points are all in one component by now.
4. *Verification.* Pairs that are left are checked exactly in the same task, on
   the sets, and a union-find grows with every link. A task returns links of a
   spanning forest, so never more than it has sets.

That is done twice. First each class goes to its largest group alone, where most
components form. Then every group that still holds several components is checked
in whole: its largest component is not compared with itself, all else is. Sets
are longer than points, so before either round the R-trees of all but large
groups are tried on points alone, and only what they leave is moved. Large
groups are dealt in cells of bounded size, so no link is lost and no task or row
count grows with the square of a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import drop, mapped, release, split_batches, squeezed, store, tidy, tree_sum
from .words import mix, shingle_sets

#: Slots of the count table, a power of two: 16 MB.
SLOTS = 22
TABLE = 1 << SLOTS
LEAF, FAN = 16, 8
#: Shingles of all sets of one cell; larger groups are dealt.
CELL = 2_000_000
#: Shingles, or postings, that one Python call gets at a time, about.
BUCKET = 4_000_000
#: Members of large groups that are compared with all others first.
PIVOTS = 4
#: A prefix shingle that may stand in more classes than this is dealt by class too.
HOT = 1_000_000
#: Members of a group that is tried on points alone before sets are moved, and token groups of those points: sets of at least WIDE shingles have as many.
WHOLE, POINT, WIDE = 512, 256, 4096
#: Rows that may be broadcast to pick sets by their class: about 60 bytes each.
FEW = 200_000
#: Stands for a null doc_id where pandas would turn ids to floats.
NO_ID = -(1 << 63)
_U = np.uint64


def class_id(s: np.ndarray) -> int:
    """A 64-bit fingerprint of a set of hashes; 0 is kept for the empty set."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        x = mix(np.array([mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + _U(len(s))], np.uint64))[0]
    return int(x.view(np.int64)) or 1


def pack(s: np.ndarray) -> bytes:
    """The upper 40 bits of sorted hashes: the lower 32 of those as they are, the upper 8 in unary."""
    x = s >> _U(24)
    bits = np.zeros(len(s) + 256, np.uint8)
    bits[(x >> _U(32)).astype(np.int64) + np.arange(len(s))] = 1
    return x.astype("<u4").tobytes() + np.packbits(bits).tobytes()


def unpack(b: bytes, n: int) -> np.ndarray:
    high = np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8, offset=4 * n))) - np.arange(n)
    return high.astype(np.int64) << 32 | np.frombuffer(b, "<u4", n)


def count_vectors(flat: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    at = np.repeat(np.arange(len(n)) * width, n) + flat % width
    return np.bincount(at, minlength=len(n) * width).astype(np.int32).reshape(len(n), width)


def need(n, m):
    """The smallest overlap that links sets of these sizes."""
    return -(-3 * (n + m) // 7)


class RTree:
    """Sort-tile packed R-tree over count vectors, one array a level.

    ``hi`` holds each node's largest count by token group, ``lo``/``top`` its range
    of set sizes, ``pure`` the component that all its points are of, or -1. Level 0
    holds the points themselves.
    """

    def __init__(self, vec: np.ndarray, n: np.ndarray, comp: np.ndarray):
        most = np.bincount(comp).argmax()
        tiles = max(1, int(np.sqrt(len(n) / LEAF)))
        band = np.argsort(np.argsort(n, kind="stable"), kind="stable") * tiles // max(1, len(n))
        widest = np.argsort(-vec.var(axis=0), kind="stable")[:3]
        self.order = np.lexsort([vec[:, g] for g in widest[::-1]] + [band, comp == most])
        hi, lo, pure = vec[self.order], n[self.order], comp[self.order]
        top, self.levels, self.step = lo, [(hi, lo, lo, pure)], [1]
        while len(lo) > 1:
            k = LEAF if len(self.levels) == 1 else FAN
            cut = np.arange(0, len(lo), k)
            same = np.minimum.reduceat(pure, cut) == np.maximum.reduceat(pure, cut)
            hi, lo, top, pure = np.maximum.reduceat(hi, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(top, cut), np.where(same, pure[cut], -1)
            self.levels.append((hi, lo, top, pure))
            self.step.append(k)

    def pairs(self):
        """Index pairs that the bounds leave over, in runs; memory does not follow their number."""
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            if level == 0:
                yield self.order[a], self.order[b]
                continue
            k, (hi, lo, top, pure) = self.step[level], self.levels[level - 1]
            run = max(1, 4_000_000 // (k * k * hi.shape[1]))
            if len(a) > run:
                todo += [(level, a[run:], b[run:])]
                a, b = a[:run], b[:run]
            kids = np.arange(k)
            x = np.repeat((a[:, None] * k + kids)[:, :, None], k, axis=2).ravel()
            y = np.repeat((b[:, None] * k + kids)[:, None, :], k, axis=1).ravel()
            ok = (x < len(lo)) & (y < len(lo)) & ((x < y) if level == 1 else (x <= y))
            x, y = x[ok], y[ok]
            ok = (4 * top[x] >= 3 * lo[y]) & (4 * top[y] >= 3 * lo[x]) & ((pure[x] != pure[y]) | (pure[x] < 0))
            x, y = x[ok], y[ok]
            enough = need(lo[x], lo[y])
            bound = np.minimum(np.minimum(hi[x], hi[y]).sum(axis=1, dtype=np.int64), np.minimum(top[x], top[y]))
            ok = bound >= enough
            if ok.any():
                todo.append((level - 1, x[ok], y[ok]))


class Cell:
    """Sets of one cell of a group, and the union-find over their components."""

    def __init__(self, sets: list[np.ndarray], n: np.ndarray, comp: np.ndarray):
        self.sets, self.n = sets, n
        _, self.comp = np.unique(comp, return_inverse=True)
        self.up = np.arange(self.comp.max() + 1)
        self.links: list[tuple[int, int]] = []
        self.checked = 0

    def roots(self, at):
        x = self.up[self.comp[at]]
        while True:
            y = self.up[x]
            if (x == y).all():
                return x
            x = y

    def check(self, a: int, bs: np.ndarray) -> int:
        """Compare ``a`` with those of ``bs`` that are in other components; the number of links found."""
        na, own = self.n[a], int(self.roots(np.array([a]))[0])
        bs = bs[(self.roots(bs) != own) & (4 * self.n[bs] >= 3 * na) & (4 * na >= 3 * self.n[bs])]
        if not len(bs):
            return 0
        self.checked += len(bs)
        one = self.sets[a]
        found, size = 0, np.cumsum(self.n[bs])
        for lo in range(0, int(size[-1]), CELL):  # parts of about as many shingles
            part = bs[(size > lo) & (size <= lo + CELL)] if size[-1] > CELL else bs
            if not len(part):
                continue
            flat = np.concatenate([self.sets[b] for b in part])
            at = np.searchsorted(one, flat)
            at[at == len(one)] = 0
            both = np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum(self.n[part]) - self.n[part])
            for b in part[7 * both >= 3 * (na + self.n[part])].tolist():
                x, y = self.roots(np.array([a, b])).tolist()
                if x != y:
                    self.up[max(x, y)] = min(x, y)
                    self.links.append((a, b))
                    found += 1
        return found

    def star(self, rounds: int = 6) -> None:
        """A few members with all others, before any tree: in a group of near copies most are one component then."""
        rng, every = np.random.default_rng(len(self.n)), np.arange(len(self.n))
        for r in range(rounds):
            roots = self.roots(every)
            most = roots == np.bincount(roots).argmax()
            among = np.flatnonzero(most if r % 2 == 0 or most.all() else ~most)
            if most.all() or (not self.check(int(rng.choice(among)), every) and r > 1):
                break

    def link(self, side: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links of a forest over all that link; with ``side``, only pairs from different sides are compared."""
        if len(self.n) > 32 and side is None:
            self.star()
        comp = self.roots(np.arange(len(self.n)))
        if (comp == comp[0]).all():
            return self.links
        width = 64
        while width < 4096 and width < np.median(self.n) and 2 * width * len(self.n) <= 8_000_000:
            width *= 2
        tree = RTree(count_vectors(np.concatenate(self.sets), self.n, width), self.n, comp)
        for a, b in tree.pairs():
            ok = self.roots(a) != self.roots(b)
            if side is not None:
                ok &= side[a] != side[b]
            a, b = a[ok], b[ok]
            if not len(a):  # all of them are linked by now, or on one side
                continue
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            cut = np.flatnonzero(np.diff(a, prepend=-1))
            for i, j in zip(cut.tolist(), np.append(cut[1:], len(a)).tolist(), strict=True):
                self.check(int(a[i]), b[i:j])
        return self.links


def members(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``(doc_id, key, cls, n)`` of every row, ``key`` being a hash of its text, and the corpus' shingle counts by slot of a fixed table."""
    from pyspark import TaskContext

    def run(batches):
        release()
        table, seen = np.zeros(TABLE, np.int32), set()
        for pdf in split_batches(batches):
            sets = shingle_sets(pdf["text"])
            ids = [class_id(s) for s in sets]
            new = []
            for c, s in zip(ids, sets, strict=True):
                if c not in seen:
                    seen.add(c)
                    new.append(s)
            if len(seen) > 1_000_000:
                seen.clear()
            if new:
                np.add.at(table, (np.concatenate(new) >> _U(64 - SLOTS)).astype(np.int64), 1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "key": pdf["key"], "cls": ids, "n": [len(s) for s in sets], "slot": -1, "blob": None})
        if table.any():
            yield pd.DataFrame({"doc_id": [NO_ID], "key": 0, "cls": 0, "n": 0, "slot": TaskContext.get().partitionId(), "blob": [squeezed(table)]})
        del table, seen
        tidy()

    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    out = store(docs.mapInPandas(run, "doc_id long, key long, cls long, n int, slot int, blob binary"), "members")
    table = tree_sum(out.filter("slot >= 0").select("slot", "blob"), "int32")
    return out.filter("slot < 0").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "key", "cls", "n"), np.zeros(TABLE, np.int32) if table is None else table


def groups(docs: DataFrame, table: np.ndarray, buckets: int) -> DataFrame:
    """``(grp, cls)``: classes that share a prefix shingle, under the smallest hash of a class among them.

    A shingle moves as its upper 48 bits: two that look alike only make a group larger.
    """
    hot = max(HOT, 8 * int(table.mean(dtype=np.float64)))
    table = docs.sparkSession.sparkContext.broadcast(table)  # TABLE counts, whatever the input

    def postings(pdf: pd.DataFrame) -> pd.DataFrame:
        counts, toks, at, cls, far, seen = table.value, [], [], [], [], set()
        for s in shingle_sets(pdf["text"]):
            c = class_id(s)
            if c and c not in seen:
                seen.add(c)
                k = len(s) - -(-3 * len(s) // 4) + 1
                rank = counts[(s >> _U(64 - SLOTS)).astype(np.int64)].astype(np.int64)
                if k < len(s):
                    edge = np.partition(rank, k - 1)[k - 1]
                    first, ties = np.flatnonzero(rank < edge), np.flatnonzero(rank == edge)
                    use = np.concatenate([first, ties[: k - len(first)]])  # ties by the hash itself: s is sorted
                    s, rank = s[use], rank[use]
                toks.append(s >> _U(16))
                far.append(rank > hot)
                at.append(np.full(len(s), len(cls), np.uint32))
                cls.append(c)
        if not toks:
            return pd.DataFrame({"bucket": pd.Series([], dtype="int32"), "hot": pd.Series([], dtype="bool"), "blob": pd.Series([], dtype=object)})
        tok, at, far, cls = np.concatenate(toks), np.concatenate(at), np.concatenate(far), np.array(cls, np.int64)
        to = mix(tok)
        to[far] += mix(cls.view(np.uint64))[at[far]]
        to = (to % _U(buckets)).astype(np.int64) * 2 + far
        order = np.argsort(to, kind="stable")
        to, tok, at = to[order], tok[order], at[order]
        cut = np.flatnonzero(np.diff(to, prepend=-1))
        blobs = []
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(to)).tolist(), strict=True):
            used, inv = np.unique(at[a:b], return_inverse=True)
            t = tok[a:b]
            blobs.append(np.array([len(used), b - a], np.uint64).tobytes() + cls[used].tobytes() + (t & _U(0xFFFFFFFF)).astype("<u4").tobytes() + (t >> _U(32)).astype("<u2").tobytes() + inv.astype("<u2" if len(used) <= 65536 else "<u4").tobytes())
        return pd.DataFrame({"bucket": (to[cut] // 2).astype(np.int32), "hot": to[cut] % 2 == 1, "blob": blobs})

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for far, g in pdf.groupby("hot"):
            toks, clss = [], []
            for b in g["blob"]:
                used, n = (int(x) for x in np.frombuffer(b, np.uint64, 2))
                p = 16 + 8 * used
                toks.append(np.frombuffer(b, "<u4", n, p).astype(np.uint64) | np.frombuffer(b, "<u2", n, p + 4 * n).astype(np.uint64) << _U(32))
                clss.append(np.frombuffer(b, np.uint64, used, 16)[np.frombuffer(b, "<u2" if used <= 65536 else "<u4", n, p + 6 * n)])
            tok, cls = np.concatenate(toks), np.concatenate(clss)
            del toks, clss
            order = np.argsort(tok, kind="stable")
            tok, cls = tok[order], cls[order]
            cut = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
            size = np.diff(np.append(cut, len(tok)))
            lead = mix(tok[cut]) if far else np.minimum.reduceat(mix(cls), cut)
            many = np.repeat(far | (size > 1), size)
            both = np.stack([np.repeat(lead, size)[many], cls[many]], axis=1)
            both = both[np.lexsort((both[:, 1], both[:, 0]))]
            out.append(both[np.append(True, (both[1:] != both[:-1]).any(axis=1))] if len(both) else both)
        both = np.concatenate(out).view(np.int64)
        return pd.DataFrame({"grp": both[:, 0], "cls": both[:, 1]})

    post = mapped(docs.select("text"), postings, "bucket int, hot boolean, blob binary")
    found = store(post.groupBy("bucket").applyInPandas(gather, "grp long, cls long").distinct(), "groups")
    size = found.groupBy("grp").agg(F.count("*").alias("m")).filter("m > 1")
    return store(found.join(size, "grp"), "groups")


def _spot(bits: int):
    """A class and a document's id as a place in a table of that many bits."""
    return F.col("cls").bitwiseXOR(F.xxhash64("doc_id")).bitwiseAND(F.lit(bits - 1))


def sets_of(docs: DataFrame, member: DataFrame, wanted: DataFrame, make, schema: str) -> DataFrame:
    """``cls, n`` and what ``make`` gives of the set, of the wanted classes, from the text of each one's smallest doc_id.

    A bit table tells those documents apart inside the scan, so only their sets
    leave it. Some others come through by chance, and a repeated row comes once a
    partition: who joins on the class must not mind.
    """
    spark = docs.sparkSession
    first = member.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(wanted, "cls")
    bits = min(1 << 28, max(1 << 15, 1 << (16 * max(1, wanted.count())).bit_length()))  # 32 MB at most; fuller tables let more through
    table = np.zeros(bits // 8, np.uint8)
    page = F.floor(_spot(bits) / 32768).cast("int").alias("page")
    for r in first.groupBy(page).agg(F.bitmap_construct_agg(F.pmod(_spot(bits), F.lit(32768))).alias("b")).toLocalIterator():
        table[r["page"] * 4096 : (r["page"] + 1) * 4096] = np.frombuffer(r["b"], np.uint8)
    table = spark.sparkContext.broadcast(table)

    def run(batches):
        seen = set()
        for pdf in split_batches(batches):
            rows = []
            sets = shingle_sets(pdf["text"])
            ids = np.array([class_id(s) for s in sets], np.int64)
            at = (ids ^ pdf["hid"].to_numpy(np.int64)) & (bits - 1)
            for i in np.flatnonzero((table.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1):
                c, s = int(ids[i]), sets[i]
                if c and c not in seen:
                    seen.add(c)
                    rows.append((c, len(s), make(s)))
            if len(seen) > 1_000_000:
                seen.clear()
            yield pd.DataFrame(rows, columns=["cls", "n", "made"])
        tidy()

    rows = docs.select(F.xxhash64(F.coalesce("doc_id", F.lit(NO_ID))).alias("hid"), "text")
    return rows.mapInPandas(run, schema)


def point(s: np.ndarray) -> bytes:
    """Counts by token group, byte by byte, so that the zeros of small ones lie together; large sets have ``WIDE`` groups."""
    width = WIDE if len(s) >= WIDE else POINT
    return np.bincount((s >> _U(24)).astype(np.int64) % width, minlength=width).astype("<u4").view(np.uint8).reshape(width, 4).T.tobytes()


def points(blobs, width: int) -> np.ndarray:
    """Points of that many token groups; wider ones are folded."""
    out = np.zeros((len(blobs), width), np.int32)
    for i, b in enumerate(blobs):
        out[i] = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<i4").reshape(-1, width).sum(axis=0)
    return out


def apart_when_wide(a: np.ndarray, b: np.ndarray, n: np.ndarray, wide: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of pairs of large sets, those that the bound over ``WIDE`` token groups tells apart; ``place`` is a row of ``wide``, or -1."""
    out = np.zeros(len(a), bool)
    both = np.flatnonzero((place[a] >= 0) & (place[b] >= 0))
    for k in range(0, len(both), 256):
        at = both[k : k + 256]
        x, y = a[at], b[at]
        out[at] = np.minimum(wide[place[x]], wide[place[y]]).sum(axis=1) < need(n[x], n[y])
    return out


def reachable(rows: DataFrame, buckets: int) -> DataFrame:
    """Of ``(grp, cls, n, comp, made)``, the ``(grp, cls, n)`` that the R-tree of their group cannot tell apart from all of other components."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for grp, g in pdf.groupby("grp", sort=False):
            g = g.drop_duplicates("cls")
            n, mark = g["n"].to_numpy(np.int64), np.zeros(len(g), bool)
            kinds, comp = np.unique(g["comp"], return_inverse=True)
            if len(kinds) > 1:
                large = np.array([len(x) > 4 * POINT for x in g["made"]])
                place, wide = np.where(large, np.cumsum(large) - 1, -1), points(g["made"][large], WIDE)
                for a, b in RTree(points(g["made"], POINT), n, comp).pairs():
                    new = (comp[a] != comp[b]) & ~(mark[a] & mark[b])
                    a, b = a[new], b[new]
                    left = ~apart_when_wide(a, b, n, wide, place)
                    mark[a[left]] = mark[b[left]] = True
            if mark.any():
                out.append(pd.DataFrame({"grp": grp, "cls": g["cls"].to_numpy()[mark], "n": n[mark]}))
        return pd.concat(out) if out else pd.DataFrame({"grp": [], "cls": [], "n": []})

    return rows.withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(buckets)).cast("int")).groupBy("bucket").applyInPandas(run, "grp long, cls long, n int")


def first_cells(rows: DataFrame) -> DataFrame:
    """``(grp, cls, n)`` with ``comp`` and ``cell``: each class in its largest group alone; a few members go to all cells of a large group."""
    size = rows.groupBy("grp").agg(F.count("*").alias("m"))
    home = rows.join(size, "grp").groupBy("cls").agg(F.max(F.struct("m", "grp", "n")).alias("h")).select("cls", F.col("h.grp").alias("grp"), F.col("h.n").alias("n"))
    whole = home.groupBy("grp").agg(F.count("*").alias("m"), F.ceil(F.sum("n") / CELL).alias("k"), *[F.min(F.struct(F.xxhash64("cls", F.lit(i)), "cls")).alias(f"p{i}") for i in range(PIVOTS)]).filter("m > 1")
    pivot = F.array_contains(F.array(*[f"p{i}.cls" for i in range(PIVOTS)]), F.col("cls"))
    cells = F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cls"), F.col("k"))))
    cell = lambda i: F.struct(i.alias("i"), i.alias("j"), F.lit(-1).alias("side"))
    return home.join(whole, "grp").select("grp", "cls", "n", F.col("cls").alias("comp"), F.explode(F.transform(cells, cell)).alias("cell"))


def open_cells(rows: DataFrame) -> DataFrame:
    """``(grp, cls, n, comp)`` of groups with several components, dealt in cells.

    What is not of the largest component is compared with all else, cell by cell:
    a cell holds a chunk of it and a chunk of either kind. ``side`` tells the two
    apart; -1 compares everything.
    """
    half = CELL // 2
    each = rows.groupBy("grp", "comp").agg(F.sum("n").alias("w"))
    whole = each.groupBy("grp").agg(F.sum("w").alias("w"), F.max(F.struct("w", "comp")).alias("top"), F.count("*").alias("c")).filter("c > 1").select("grp", F.col("w") <= CELL, F.col("top.comp"), F.ceil((F.col("w") - F.col("top.w")) / half), F.ceil(F.col("top.w") / half)).toDF("grp", "small", "top", "km", "kt")
    struct = lambda i, j, side: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), side.cast("int").alias("side"))
    zero, mine = F.lit(0), F.when(F.col("comp") == F.col("top"), F.pmod(F.xxhash64("cls"), F.col("kt"))).otherwise(F.pmod(F.xxhash64("cls"), F.col("km")))
    upto = lambda k: F.sequence(F.lit(0).cast("long"), F.col(k) - 1)
    among = F.transform(upto("km"), lambda h: struct(F.least(h, F.col("mine")), F.greatest(h, F.col("mine")), F.when(h == F.col("mine"), -1).otherwise((F.col("mine") > h).cast("int"))))
    across = F.transform(upto("kt"), lambda j: struct(F.col("mine"), -1 - j, zero))
    against = F.transform(upto("km"), lambda i: struct(i, -1 - F.col("mine"), F.lit(1)))
    cells = F.when(F.col("small"), F.array(struct(zero, zero, F.lit(-1)))).when(F.col("comp") == F.col("top"), against).otherwise(F.concat(among, across))
    return rows.join(whole, "grp").withColumn("mine", mine).select("grp", "cls", "n", "comp", F.explode(cells).alias("cell"))


def links(cells: DataFrame, sets: DataFrame, buckets: int) -> DataFrame:
    """``(a, b)`` of a spanning forest over what links in each cell: never more than its sets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(["grp", "i", "j"], sort=False):
            g = g.drop_duplicates("cls")
            comp = g["comp"].to_numpy(np.int64)
            if (comp == comp[0]).all():
                continue
            n, cls, side = g["n"].to_numpy(np.int64), g["cls"].to_numpy(np.int64), g["side"].to_numpy()
            cell = Cell([unpack(b, k) for b, k in zip(g["made"], n.tolist(), strict=True)], n, comp)
            out += [(cls[a], cls[b]) for a, b in cell.link(None if (side < 0).all() else side)]
        tidy()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    flat = cells.select("grp", "cls", "comp", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), F.col("cell.side").alias("side"))
    flat = store(flat, "cells")
    # Sets are long, so they stay where they are if the rows that want them are few.
    rows = sets.join(F.broadcast(flat) if flat.count() <= FEW else flat, "cls")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("grp", "i", "j"), F.lit(buckets)).cast("int"))
    return store(rows.groupBy("bucket").applyInPandas(run, "a long, b long"), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id, n_shingles, component_id``.

    ``component_id`` is the smallest doc_id reachable by links. A null or blank
    text has no shingles and links with nothing, so it is its own component.
    Repeated rows stay and are in one component; rows whose doc_id is null form
    no smaller id. Extra columns are left out. No rows give no rows.
    """
    classed = grouped(docs)
    least = classed.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    linked = classed.filter("n > 0").join(least, "comp").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = classed.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def grouped(docs: DataFrame) -> DataFrame:
    """``members`` with ``comp``, which rows of one component share; rows without shingles all have 0."""
    spark = docs.sparkSession
    least = max(24, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    member, table = members(docs)
    total = member.agg(F.sum("n")).head()[0] or 0
    group = groups(docs, table, max(least, int(total // (4 * BUCKET)) + 1))
    seen = store(sets_of(docs, member, group.select("cls").distinct(), point, "cls long, n int, made binary"), "points")
    small = group.filter(F.col("m") <= WHOLE)
    held = max(least, int(small.count() * POINT // BUCKET) + 1)
    near = reachable(small.select("grp", "cls", F.col("cls").alias("comp")).join(seen, "cls"), held).withColumn("small", F.lit(True))
    large = group.filter(F.col("m") > WHOLE).join(seen.select("cls", "n").distinct(), "cls").select("grp", "cls", "n", F.lit(False).alias("small"))
    rows = store(near.unionByName(large), "near")
    drop(group)
    sets = store(sets_of(docs, member, rows.select("cls").distinct(), pack, "cls long, n int, made binary"), "sets")
    buckets = max(least, int((rows.agg(F.sum("n")).head()[0] or 0) // BUCKET) + 1)
    sets = sets.select("cls", "n", "made")
    found = links(first_cells(rows).drop("n"), sets, buckets)
    comp = components(found)
    named = rows.join(comp, rows["cls"] == comp["node"], "left").select("grp", "cls", "n", "small", F.coalesce("comp", "cls").alias("comp"))
    again = reachable(named.filter("small").drop("n").join(seen, "cls"), held).withColumn("small", F.lit(True))
    left = again.join(named.select("grp", "cls", "comp"), ["grp", "cls"]).unionByName(named.filter("not small"))
    more = links(open_cells(left.drop("small")).drop("n"), sets, buckets)
    drop(rows)
    drop(seen)
    drop(sets)
    if not more.isEmpty():
        comp = components(found.union(more))
    return member.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the smallest doc_id, null ones last, and then of the smallest hash of its text.

    Rows are told apart by doc_id and text, so a null or repeated id on different
    texts loses none. A text without shingles stays once for each id it has.
    """
    alone = F.col("n") == 0
    row = [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("key").alias("_key")]
    names = ["none", "_id", "_key"]
    # What is one of its kind: a component, or a row without shingles.
    kind = [F.col("comp"), *[F.when(alone, c).otherwise(F.lit(0).cast(t)).alias(f"g{i}") for i, (c, t) in enumerate(zip(row, ("boolean", "long", "long"), strict=True))]]
    each = store(grouped(docs).select(*kind, *row).groupBy("comp", "g0", "g1", "g2", *names).agg(F.count("*").alias("c")), "rows")
    least = each.groupBy("comp", "g0", "g1", "g2").agg(F.min(F.struct(*names)).alias("row")).select("comp", "g0", "g1", "g2", "row.*")
    gone = store(each.join(least, ["comp", "g0", "g1", "g2", *names], "left_anti").select("_id", "_key"), "gone")
    twice = store(each.filter("c > 1").select("_id", "_key"), "twice")
    few = lambda t: F.broadcast(t) if t.count() <= FEW else t
    # Texts stay where they are if the rows that go are few; only rows that came more than once have to meet.
    marked = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("_key", F.xxhash64("text"))
    left, twice = marked.join(few(gone), ["_id", "_key"], "left_anti"), few(twice)
    once, again = left.join(twice, ["_id", "_key"], "left_anti"), left.join(twice, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])
    return once.unionByName(again).select(*docs.columns)
