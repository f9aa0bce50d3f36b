"""The prefix trie against one made turn by turn."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from patchwell.llm import trie


def by_hand(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r[2], r[4]) for r in sorted(t)] for c, t in convs.items()}
    members, ends = {}, {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        family = c - (abs(c) % 5) * (1 if c > 0 else -1)
        full = tuple(own.get(family, [])[:h] + t[h:])
        for d in range(len(full) + 1):
            members.setdefault(full[:d], []).append(c)
        ends.setdefault(full, []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, m in members.items():
        gain = (len(m) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] = saved.get(node[:d], 0) + gain
            leaves[node[:d]] = leaves.get(node[:d], 0) + (node not in children)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -(10**9), len(m), children.get(n, 0), leaves[n], saved[n], sha(ends.get(n, []))) for n, m in members.items())


def got(df):
    return sorted(tuple(-(10**9) if x is None else x for x in r) for r in trie.prefix_trie(df).collect())


SCHEMA = "conv_id long, turn long, role string, text string"


def test_small_and_odd_tables(spark):
    """Nulls in every column, ties, repeats, empty texts, negative ids, absent families and columns that clash with the operator's own."""
    rng = random.Random(3)
    texts = ["a", "b", "", None, "ccü", "a"]
    rows = [(rng.choice([c, c, None]) if c % 13 == 0 else c, rng.choice([None, t, t, 1]), rng.choice(["u", "a", None]), rng.choice(texts)) for c in [*range(-12, 60), 1000003] for t in range(rng.randrange(1, 13)) if c % 11]
    rows += rows[:40]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"digest": F.lit(1), "depth": F.lit("x")}).repartition(5)
    assert got(df) == by_hand(rows)
    assert got(df.limit(0)) == [] and got(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)) == []


@pytest.mark.parametrize("partitions", [1, 7])
def test_long_conversation_over_many_tasks(spark, partitions):
    """One conversation holds most rows; its family takes its first turns; many are copies of each other."""
    rows = [(5, t, "user", f"turn {t % 40}") for t in range(240)] + [(6, t, "user", f"turn {t % 40}") for t in range(170)]
    rows += [(c, t, "user", f"turn {t}") for c in range(7, 80) for t in range(5 + c % 3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(df) == by_hand(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rounds_follow_the_digits_of_the_depth(spark, monkeypatch):
    rounds = []
    kept = trie.store
    monkeypatch.setattr(trie, "store", lambda df, name: rounds.append(name) or kept(df, name))
    rows = [(0, t, "user", f"t{t}") for t in range(100)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows)
    assert rounds.count("trie-round") == 1 + 7


def test_ids_of_a_node_in_runs(spark):
    """A node where many conversations end: its ids are joined in runs and hashed in order."""
    ids = [7 * k for k in range(60_000)]
    df = spark.range(1).select(F.explode(F.lit(ids)).alias("conv_id"), F.lit(True).alias("ends"), F.lit(b"x" * 16).alias("digest")).repartition(4)
    (row,) = trie.ends(df).collect()
    assert row["ends_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
