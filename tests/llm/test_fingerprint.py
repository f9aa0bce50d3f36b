"""Prefix hashes against plain string comparison, and the operator against the contract by hand."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from patchwell.llm import fingerprint as fp


def some(rng, n, letters="abü😀 "):
    return "".join(rng.choice(letters) for _ in range(n))


def test_spans_and_extensions():
    rng = random.Random(1)
    for _ in range(60):
        a, b = some(rng, rng.randrange(1, 90), "ab"), some(rng, rng.randrange(1, 90), "ab")
        p, q = fp.Prefixes.of(a), fp.Prefixes.of(b)
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        n = rng.randrange(0, min(len(a) - i, len(b) - j) + 1)
        assert (p.span(i, n) == q.span(j, n)) == (a[i : i + n] == b[j : j + n])
        assert p.common(i, q, j) == next((k for k in range(len(a)) if a[i + k : i + k + 1] != b[j + k : j + k + 1] or not a[i + k : i + k + 1]), len(a) - i)
        back = 0
        while back < min(i, j) and a[i - back - 1] == b[j - back - 1]:
            back += 1
        assert p.common_back(i, q, j) == back
        k, m = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        whole, parts = fp.Prefixes.of(a[:k] + b[:m]), p.joined(k, q, m)
        assert all((x == y).all() for x, y in zip(whole.sums, parts.sums, strict=True)) and whole.fingerprint() == parts.fingerprint()


def test_windows_of_a_long_text_by_plain_arithmetic():
    text = some(random.Random(2), 70_000)
    got = fp.Prefixes.of(text).windows(12)
    for i in (0, 1, 33_000, 69_988):
        want = [sum((ord(c) + 1) * pow(b, k, fp.PRIME) for k, c in enumerate(text[i : i + 12])) % fp.PRIME for b in fp.BASES]
        assert int(got[i]) == want[0] << 31 | want[1]


def by_hand(rows):
    """Contract columns of rows in their order; likeness by counted windows."""
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after = text or "", after or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        near = []
        for other in (edited, after):
            a, b = (Counter(t[k : k + 12] for k in range(max(1, len(t) - 11))) if t else Counter() for t in (text, other))
            near.append(1.0 if text == other else 2 * (a & b).total() / (a.total() + b.total()))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *near))
    return out


@pytest.mark.parametrize("partitions", [1, 6])
def test_against_the_contract(spark, partitions):
    """Ids in any order, empty, short, repeated and long texts; each task's last document meets the next task's first."""
    rng = random.Random(4)
    texts = ["", None, "a", "ab", "abcdef", some(rng, 30_000), "line\n" * 300, *(some(rng, rng.randrange(1, 900), "abcdefgh ") for _ in range(40))]
    rows = [(7 * k - 60, t) for k, t in enumerate(texts + texts[5:12])]
    df = spark.createDataFrame(random.Random(9).sample(rows, len(rows)), "doc_id long, text string").withColumns({"pid": F.lit("x"), "tie": F.lit(1)}).repartition(partitions)
    got = {r["doc_id"]: r for r in fp.fingerprints(df).collect()}
    assert len(got) == len(rows)
    prints = {}
    for i, n, sha, near_edited, near_next in by_hand(sorted(rows, reverse=True)):
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert abs(r["near_edited"] - near_edited) < 0.16 and abs(r["near_next"] - near_next) < 0.1
        text = dict(rows)[i] or ""
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert r["common_edited"] >= n - n // 3
    assert len(set(prints.values())) == len(prints)


def test_ties_nulls_and_no_rows(spark):
    """Rows of one id, null ids and equal rows: each row has one result, and those of equal rows are told from their order."""
    rows = [(1, "aaa bbb ccc"), (1, "aaa bbb ccc"), (1, "ddd"), (None, "eee fff"), (None, None), (None, None), (3, "")] + [(5, "same text " * 3)] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = fp.fingerprints(df).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got) == sorted((str(i), len(t or "")) for i, t in rows)
    assert sum(r["near_next"] == 1.0 for r in got if r["doc_id"] == 5) == 199
    assert fp.fingerprints(df.limit(0)).count() == 0
    (one,) = fp.fingerprints(spark.createDataFrame([(1, "only one text here")], "doc_id long, text string")).collect()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(("only one text here"[:12] + "only o").encode()).hexdigest()
