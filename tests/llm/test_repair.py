"""The repair operator against exhaustive search and, over pieces of one long conversation, against one piece."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from patchwell.llm import repair


def searched(symbols):
    """Cheapest and then ASCII-least edits by trying all, with up to three turns put in at a time."""

    @cache
    def best(i, roles):
        ways = [(0, "")] if i == len(symbols) and re.fullmatch("(s?(ua)+)?", roles) else []
        put = len(roles) - len(roles.rstrip("+"))
        if put < 3:
            ways += [(5 + c, "I" + w) for r in "ua" for c, w in [best(i, put_in(roles, r) + "+" * (put + 1))]]
        if i < len(symbols):
            base = roles.rstrip("+")
            s = symbols[i]
            ways += [(2 + c, "D" + w) for c, w in [best(i + 1, base)]]
            if s != repair.GONE:
                more = 5 * (s % 2)
                ways += [(more + c, "K" + w) for c, w in [best(i + 1, put_in(roles, "suax"[s // 2]))]]
                ways += [(1 + more + c, "R" + w) for r in "ua" for c, w in [best(i + 1, put_in(roles, r))]]
        return min(ways, default=(10**6, ""))

    def put_in(roles, r):
        """Only what the pattern's next place depends on is kept: whether it is broken, and the last role."""
        base = roles.rstrip("+")
        if "!" in base or r == "x" or (r == "s" and base) or (r == "a" and base[-1:] != "u") or (r == "u" and base[-1:] == "u"):
            return "!"
        return {"s": "s", "u": base[:1] * (base[:1] == "s") + "u", "a": base[:1] * (base[:1] == "s") + "ua"}[r]

    return best(0, "")


def test_automaton_against_all_edits():
    rng = random.Random(5)
    machine = repair.Automaton()
    for n in [0, 1, 2, 3] * 30 + [5, 6, 7] * 60:
        symbols = bytes(rng.randrange(9) for _ in range(n))
        cost, letters, _ = machine.repair(symbols)
        assert (cost, "".join(letters)) == searched(symbols), symbols
    assert len(machine.states) < 200


def by_hand(rows):
    """The contract for one conversation's original rows, row by row, with edits by search over the automaton's own symbols."""
    live = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        live += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    live.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, counts, symbols = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, role, text in live:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        at = "sua".find(role[0]) if role else -1
        symbols.append(repair.GONE if fault in ("blank", "duplicate") else 2 * (3 if at < 0 else at) + (fault == "truncated"))
    turns = [t for t, _, _ in live if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    first = [r[:1] for _, r, _ in live]
    cost, audit = searched(bytes(symbols))
    out, i, kept = [], 0, [c for c in audit if c != "D"]
    odd, k = len(kept) % 2, 0
    for c in audit:
        if c != "D":
            k += 1
            role = live[i][1] if c == "K" else "user" if (k - odd) % 2 else "assistant"
            out.append(f"{role}:{'' if c == 'I' else live[i][2]}")
        i += c != "I"
    return (gaps, *counts.values(), sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


@pytest.mark.parametrize("piece", [2048, 3])
def test_repair_by_hand(spark, piece):
    """Nulls in every column, ties, repeats, empty and odd roles; small pieces as in a conversation that fills several tasks."""
    rng = random.Random(7)
    texts = ["One.", "Two!", "Three", "", " \n", None, "Vier? ", "Fünf…", "Six.\x0b"]
    roles = ["user", "assistant", "system", None, "tool", "", "user", "assistant"]
    rows = [(c if c < 40 else None, rng.choice([None, *range(7)]) if c % 5 == 0 else t, rng.choice(roles), rng.choice(texts) if c % 3 else f"Text {rng.randrange(4)} of {c}.") for c in range(42) for t in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("x")).withColumn("copy", F.lit(1)).repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(df, piece).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert got == {c: by_hand(g) for c, g in groups.items()}
    assert repair.repair(df.limit(0)).count() == 0


def test_one_conversation_in_many_tasks(spark):
    """A conversation that is nearly the whole table is cut into pieces, and gives what one piece gives."""
    rows = [(1 if i % 10 else i, i // 2, ("user", "assistant", "system")[i % 7 % 3], f"Turn {i % 400} says something{'.' if i % 5 else ''}") for i in range(6000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    whole = {r["conv_id"]: tuple(r) for r in repair.repair(df).collect()}
    assert {r["conv_id"]: tuple(r) for r in repair.repair(df, 200).collect()} == whole and len(whole) == 601
