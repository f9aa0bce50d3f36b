"""Conversation prefix trie: which beginnings conversations share, rolled up by pointer jumping.

A node's key is a polynomial hash of its turns, so a conversation's prefix keys
are running sums: they are made where its turns lie, and a conversation that
fills several tasks (or begins with another's turns) only needs a shift of each
sum. Counts of leaves and savings then go to all ancestors in as many rounds as
the depth has binary digits: in each, a node gives what it has gathered to the
ancestor that its pointer names, and pointers double their reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import crc, dealt_in_order, drop, small_batches, store

#: Keys are sums of turn hashes times powers of BASE, modulo a Mersenne prime.
PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix trie").digest()[:15], "big")
ROOT = bytes(16)
#: Most turns that a conversation takes from its family's first.
HEAD = 8
#: Ids of a run that one row of sorted ids may hold.
RUN = 100_000


def _key(x: int) -> bytes:
    return x.to_bytes(16, "big")


def _number(b: bytes) -> int:
    return int.from_bytes(b, "big")


_SUMS = pa.schema([("conv_id", pa.int64()), ("pid", pa.int32()), ("ord", pa.int64()), ("before", pa.binary()), ("after", pa.binary()), ("n_bytes", pa.int64()), ("begun", pa.bool_()), ("edge", pa.bool_())])
_SUMS_DDL = "conv_id long, pid int, ord long, before binary, after binary, n_bytes long, begun boolean, edge boolean"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns numbered and hashed from each conversation's first turn in the task on. ``begun`` marks those of the task's first conversation, which may go on from the task before; its totals and the last one's are rows of their own (``edge``)."""
    pid, conv, begun, seen = TaskContext.get().partitionId(), None, True, False
    n, total, power = 0, 0, 1
    edges = []
    for b in batches:
        out = []
        for c, digest, size in zip(*(b.column(k).to_pylist() for k in ("conv_id", "digest", "n_bytes")), strict=True):
            if not seen or c != conv:
                if seen and begun:
                    edges.append((conv, pid, n, None, _key(total), None, True, True))
                begun, seen = not seen, True
                conv, n, total, power = c, 0, 0, 1
            n += 1
            before, total = total, (total + _number(digest) * power) % PRIME
            power = power * BASE % PRIME
            out.append((c, pid, n, _key(before), _key(total), size, begun, False))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _SUMS, strict=True)], schema=_SUMS)
    if seen:
        edges.append((conv, pid, n, None, _key(total), None, begun, True))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*edges), _SUMS, strict=True)], schema=_SUMS)


def _carried(edges: list) -> dict[int, tuple[int, bytes]]:
    """By task, how many turns of its first conversation lie in earlier tasks, and their hash. Two rows a task come here."""
    out, last = {}, (None, 0, 0)
    for e in sorted(edges, key=lambda e: (e["pid"], not e["begun"])):
        n, total = e["ord"], _number(e["after"])
        if e["begun"] and e["conv_id"] == last[0]:
            _, n0, sum0 = last
            out[e["pid"]] = (n0, _key(sum0))
            n, total = n0 + n, (sum0 + total * pow(BASE, n0, PRIME)) % PRIME
        last = (e["conv_id"], n, total)
    return out


def numbered(rows: DataFrame) -> DataFrame:
    """Turns with their number (``ord``, from 1) in their conversation, the hash ``before`` and ``after`` each, and their text's bytes."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.md5(text).alias("tie"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")).filter("conv_id is not null")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie")]
    found = store(dealt_in_order(turns, order).select("conv_id", "digest", "n_bytes").mapInArrow(_summed, _SUMS_DDL), "trie-turns")
    carried = _carried(found.filter("edge").select("conv_id", "pid", "ord", "after", "begun").collect())

    def settle(batches):
        for b in batches:
            rows = b.to_pydict()
            for i, pid in enumerate(rows["pid"]):
                if pid in carried:
                    n0, sum0 = carried[pid]
                    by, sum0 = pow(BASE, n0, PRIME), _number(sum0)
                    rows["ord"][i] += n0
                    for k in ("before", "after"):
                        rows[k][i] = _key((sum0 + _number(rows[k][i]) * by) % PRIME)
            yield pa.RecordBatch.from_pydict(rows, schema=b.schema)

    names = ["conv_id", "pid", "ord", "before", "after", "n_bytes"]
    turns = found.filter("not edge")
    return turns.filter("not begun").select(*names).unionByName(turns.filter("begun").select(*names).mapInArrow(settle, "conv_id long, pid int, ord long, before binary, after binary, n_bytes long")).drop("pid")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Prefixes of every rebuilt conversation (``conv_id, depth, digest, parent, n_bytes, ends``), the empty one included.

    A conversation takes its first ``h`` turns from its family's first, and its own from there on.
    """
    h = (crc("conv_id") % (HEAD + 1)).cast("int")
    head = F.sort_array(F.collect_list(F.when(F.col("ord") <= HEAD, F.struct("ord", "before", "after", "n_bytes"))))
    convs = store(turns.groupBy("conv_id").agg(F.max("ord").alias("n"), head.alias("head")), "trie-heads")
    base = convs.filter("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("head").alias("taken"))
    plan = convs.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % 5}).join(base, "base", "left")
    plan = plan.withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))).cast("int")).withColumn("total", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    last = lambda a, k: F.when(F.col(k) == 0, F.lit(ROOT)).otherwise(F.try_element_at(F.col(f"{a}.after"), F.col(k)))
    plan = plan.withColumns({"taken_sum": last("taken", "k"), "own_sum": last("head", "h")})
    root = plan.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("n_bytes"), (F.col("total") == 0).alias("ends"))
    first = plan.filter("k > 0").select("conv_id", "total", F.explode(F.slice("taken", 1, F.col("k"))).alias("t"))
    first = first.select("conv_id", F.col("t.ord").alias("depth"), F.col("t.after").alias("digest"), F.col("t.before").alias("parent"), F.col("t.n_bytes"), (F.col("t.ord") == F.col("total")).alias("ends"))

    def shift(batches):
        by = {k: pow(BASE, k, PRIME) for k in range(-HEAD, 1)}
        for b in batches:
            r = b.to_pydict()
            moved = {"digest": [], "parent": []}
            for h, k, taken, own, before, after in zip(*(r[c] for c in ("h", "k", "taken_sum", "own_sum", "before", "after")), strict=True):
                own, taken, power = _number(own), _number(taken), by[k - h]
                moved["digest"].append(_key((taken + (_number(after) - own) * power) % PRIME))
                moved["parent"].append(_key((taken + (_number(before) - own) * power) % PRIME))
            depth = [o - h + k for o, h, k in zip(r["ord"], r["h"], r["k"], strict=True)]
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array(r["conv_id"], pa.int64()), "depth": pa.array(depth, pa.int64()), "digest": pa.array(moved["digest"], pa.binary()), "parent": pa.array(moved["parent"], pa.binary()), "n_bytes": pa.array(r["n_bytes"], pa.int64()), "ends": pa.array([d == t for d, t in zip(depth, r["total"], strict=True)], pa.bool_())})

    own = turns.filter(F.col("ord") > h).join(plan.filter("n > h").select("conv_id", "h", "k", "taken_sum", "own_sum", "total"), "conv_id")
    own = own.mapInArrow(shift, "conv_id long, depth long, digest binary, parent binary, n_bytes long, ends boolean")
    return root.unionByName(first).unionByName(own)


def nodes(prefixes: DataFrame) -> DataFrame:
    """One row a node: ``digest, parent, depth, conv_id`` (its smallest member), ``n_convs``, ``saved`` of its own turn. Counts are summed before they are shuffled."""
    out = prefixes.groupBy("digest").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"))
    return out.withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")).drop("n_bytes")


def rolled_up(values: DataFrame, deepest: int) -> DataFrame:
    """``values`` (``digest, depth, jump, leaves, saved``; ``jump`` names the parent) with both sums over each node's subtree.

    Before round r a node holds what lies less than 2^r below it, and its pointer
    names the ancestor 2^r above; those without one give nothing more. Nodes whose
    pointer comes to the root are told by their depth, so none is joined with it.
    """
    step = 1
    while step <= deepest:
        given = values.filter(F.col("depth") >= step).groupBy(F.col("jump").alias("digest")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        more = values.join(given, "digest", "left")
        more = more.select("digest", "depth", "jump", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")])
        near = more.filter(F.col("depth") <= 2 * step).withColumn("jump", F.when(F.col("depth") == 2 * step, F.lit(ROOT)))
        if deepest > 2 * step:
            reach = values.filter(F.col("depth") > step).select(F.col("digest").alias("jump"), F.col("jump").alias("next"))
            far = more.filter(F.col("depth") > 2 * step).join(reach, "jump").select("digest", "depth", F.col("next").alias("jump"), "leaves", "saved")
            near = near.unionByName(far)
        values, old = store(near, "trie-round"), values
        drop(old)
        step *= 2
    return values


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of each node come in order; one hash is led over them."""
    digest, sha = None, None
    for b in batches:
        out = []
        for d, ids in zip(b.column("digest").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if d != digest:
                if sha is not None:
                    out.append((digest, sha.hexdigest()))
                digest, sha = d, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["digest", "ends_sha256"])
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([digest]), pa.array([sha.hexdigest()])], names=["digest", "ends_sha256"])


def ends(prefixes: DataFrame) -> DataFrame:
    """Of each node where conversations end, the hash of their ids in order. Ids are joined in runs first, so a node that a third of them end in is many rows until then."""
    run = F.floor(F.col("conv_id") / RUN).cast("long")
    runs = prefixes.filter("ends").groupBy("digest", run.alias("run")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    return runs.repartition("digest").sortWithinPartitions("digest", "run").mapInArrow(_hashed, "digest binary, ends_sha256 string")


def prefix_trie(rows: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt conversations of ``rows`` (``conv_id, turn, role, text``).

    Turns are in order of ``turn`` (nulls first), then of role and the MD5 of the
    text. Null roles and texts are empty. Rows without ``conv_id`` belong to no
    conversation. Families are ``conv_id - conv_id % 5``, where the remainder has the
    sign of the id. An empty table has no nodes. Other columns are not read.
    """
    small_batches(rows.sparkSession)
    prefixes = store(rebuilt(numbered(rows)), "trie-prefixes")
    found = store(nodes(prefixes), "trie-nodes")
    top = found.filter(F.col("depth") == 0).select("conv_id").head()
    children = found.filter("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    above = found.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    known = found.filter("depth > 1").join(above, "parent").unionByName(found.filter("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(top and top[0]).cast("long"))))
    known = store(known.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-known")
    deepest = known.agg(F.max("depth")).head()[0] or 0
    values = known.select("digest", "depth", F.col("parent").alias("jump"), (F.col("n_children") == 0).cast("long").alias("leaves"), "saved")
    sums = rolled_up(store(values, "trie-round"), deepest).select("digest", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    out = known.drop("saved", "parent").join(sums, "digest").join(ends(prefixes), "digest", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
