"""Conversation structure repair: the cheapest edits that make roles alternate, by a lazily determinised weighted automaton.

Turns of a conversation are kept (0), given another role (1), deleted (2) or put
in (5), so that role initials read ``(s?(ua)+)?``; a truncated turn that stays
costs 5 more, a blank or repeated one must go. What is still to pay from each
of the four places of that pattern is a vector; less its minimum, it is one
state of a deterministic automaton. States and moves are made when first met,
so a conversation costs one table lookup a turn, from its last to its first.
The trace then runs back over the same moves along tight arcs, and takes the
least letter of equals.

Rows are dealt by ranges of conversation and turn, so a conversation that holds
a third of all rows is spread over many tasks: each has a piece of it, with a
byte a turn for its place in the automaton. Only these bytes (no more than the
audit has letters) meet; texts are repaired in their pieces, and one hash is
led over the pieces in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import dealt_in_order, small_batches, store

#: Costs of the edits, and of keeping or renaming a truncated turn.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Places in the pattern: nothing yet, after s, after u, after a. Where each role leads from there.
LEADS = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: The role that may come next at each place if it is made, and where it leads.
MADE, MADE_TO = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
#: Places where a conversation may end.
ENDS = (0, 3)
INITIALS = "sua"
#: The symbol of a turn that must go; others are twice the role's place in INITIALS (3: another), plus 1 if truncated.
GONE = 8
LEGAL = ("su", "ua", "au")
WHITE = " \t\n\x0b\x0c\r"
#: Turns and characters of a piece.
PIECE, PIECE_CHARS = 2048, 4_000_000
NEVER = float("inf")


class Automaton:
    """States are normalised vectors of what is still to pay; ``moves`` holds, by state and symbol, the state before, what was taken off, and the tight arcs."""

    def __init__(self):
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.moves: dict[int, tuple[int, float, tuple]] = {}
        self.last, self.offset, self.tail = self._closed([0 if q in ENDS else NEVER for q in range(4)], lambda q: [])

    def _closed(self, paid: list[float], steps) -> tuple[int, float, tuple]:
        """Turns may be put in before anything else; then the vector's number, its minimum, and from each place the letters up to the next turn and where they lead."""
        for _ in range(4):
            paid = [min(paid[q], INSERT + paid[MADE_TO[q]]) for q in range(4)]
        arcs = []
        for at in range(4):
            letters, q = "", at
            while True:
                ways = [w for w in [*steps(q), ("I", INSERT + paid[MADE_TO[q]], MADE_TO[q])] if w[1] == paid[q]]
                if q in ENDS and paid[q] == 0 and not steps(q):
                    break
                if not ways:  # no way from here
                    break
                letter, _, q = min(ways)
                letters += letter
                if letter != "I":
                    break
            arcs.append((letters, q))
        base = min(paid)
        vector = tuple(p - base for p in paid)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.states)
            self.states.append(vector)
        return self.numbers[vector], base, tuple(arcs)

    def move(self, state: int, symbol: int) -> tuple[int, float, tuple]:
        """The state before a turn of ``symbol``, given that after it."""
        key = state * 9 + symbol
        if key not in self.moves:
            v, role, more = self.states[state], symbol // 2, CUT * (symbol % 2)

            def steps(q):
                out = [("D", DELETE + v[q], q)]
                if symbol != GONE:
                    kept = LEADS[INITIALS[role]][q] if role < 3 else None
                    out += [("R", REROLE + more + v[MADE_TO[q]], MADE_TO[q])] + ([] if kept is None else [("K", KEEP + more + v[kept], kept)])
                return out

            self.moves[key] = self._closed([min(w[1] for w in steps(q)) for q in range(4)], steps)
        return self.moves[key]

    def repair(self, symbols: bytes) -> tuple[int, list[str], list[int]]:
        """The least cost, the letters at each turn (those of turns put in before it come first; after the last turn, one more entry), and the place before each."""
        state, cost, path = self.last, self.offset, []
        moves = self.moves
        for s in reversed(symbols):
            got = moves.get(state * 9 + s) or self.move(state, s)
            path.append(got[2])
            state = got[0]
            cost += got[1]
        cost += self.states[state][0]
        letters, places, q = [], [], 0
        for arcs in reversed(path):
            places.append(q)
            step, q = arcs[q]
            letters.append(step)
        places.append(q)
        letters.append(self.tail[q][0])
        return int(cost), letters, places


def applied(audit: str, place: int, roles: list[str], texts: list[str]) -> list[str]:
    """``role:text`` of the turns that edits leave, from a place of the pattern on."""
    out, i = [], 0
    for letter in audit:
        if letter == "I":
            out.append(f"{MADE[place]}:")
            place = MADE_TO[place]
            continue
        if letter == "K":
            out.append(f"{roles[i]}:{texts[i]}")
            place = LEADS[roles[i][0]][place]
        elif letter == "R":
            out.append(f"{MADE[place]}:{texts[i]}")
            place = MADE_TO[place]
        i += 1
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """Turns with the damage that their numbers call for. Lost turns stay as rows without text, so that no conversation is lost."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 0, None).when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = out.withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "turn": F.when(F.col("kind") != 0, F.col("turn"))})
    return out.select("*", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("kind", "copy")


def _symbol(role: str, text: str) -> int:
    left = text.rstrip(WHITE)
    if not left:
        return GONE
    at = INITIALS.find(role[0]) if role else -1
    return 2 * (at if at >= 0 else 3) + (left[-1] not in ".!?")


@dataclass
class _Piece:
    """Turns of one conversation that lie together in a task."""

    conv_id: int | None
    whole: bool
    turns: list = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    chars: int = 0

    def add(self, turn, role: str, text: str) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def full(self, limit: int) -> bool:
        return len(self.roles) >= limit or self.chars >= PIECE_CHARS

    def measures(self) -> dict:
        known = [t for t in self.turns if t is not None]
        first = [r[:1] for r in self.roles]
        return {"low": min(known, default=None), "high": max(known, default=None), "n_turns": len(set(known)), "illegal": sum(a + b not in LEGAL for a, b in zip(first, first[1:])), "first": first[0] if first else None, "final": first[-1] if first else None}


DONE = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
SCHEMA = (
    "conv_id long, done boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, "
    "pid int, seq int, symbols binary, digests binary, low long, high long, n_turns long, first string, final string, roles array<string>, texts array<string>"
)
_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("done", pa.bool_()), *[(n, pa.int64()) for n in DONE], ("audit", pa.string()), ("repaired_sha256", pa.string()), ("pid", pa.int32()), ("seq", pa.int32()), ("symbols", pa.binary()), ("digests", pa.binary()),
    ("low", pa.int64()), ("high", pa.int64()), ("n_turns", pa.int64()), ("first", pa.string()), ("final", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
])


def _digest(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def _finished(piece: _Piece, machine: Automaton) -> dict:
    """A conversation that lies in one piece."""
    symbols = bytearray(_symbol(r, t) for r, t in zip(piece.roles, piece.texts, strict=True))
    blank, seen, again = symbols.count(GONE), set(), 0
    for i, pair in enumerate(zip(piece.roles, piece.texts, strict=True)):
        if symbols[i] != GONE and pair in seen:
            symbols[i] = GONE
            again += 1
        seen.add(pair)
    cost, letters, _ = machine.repair(bytes(symbols))
    audit, m = "".join(letters), piece.measures()
    text = "\n".join(applied(audit, 0, piece.roles, piece.texts))
    gaps = 0 if m["low"] is None else m["high"] - m["low"] + 1 - m["n_turns"]
    truncated = sum(s % 2 for s in symbols)
    return {"conv_id": piece.conv_id, "done": True, "gaps": gaps, "blank": blank, "duplicate": again, "truncated": truncated, "illegal": m["illegal"], "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


def _scan(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Conversations that begin and end in the task are finished; pieces of others leave it with their turns."""
    machine, pid, seq = Automaton(), TaskContext.get().partitionId(), 0
    out: list[dict] = []
    size = 0
    piece: _Piece | None = None

    def close(ended: bool) -> None:
        nonlocal seq, size
        if piece.whole and ended:
            out.append(_finished(piece, machine))
        else:
            symbols = bytes(_symbol(r, t) for r, t in zip(piece.roles, piece.texts, strict=True))
            digests = b"".join(_digest(r, t) for r, t in zip(piece.roles, piece.texts, strict=True))
            out.append({"conv_id": piece.conv_id, "done": False, "pid": pid, "seq": seq, "symbols": symbols, "digests": digests, "roles": piece.roles, "texts": piece.texts, **piece.measures()})
            size += piece.chars
            seq += 1

    for batch in batches:
        for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
            if piece is None:
                piece = _Piece(conv, False)
            elif conv != piece.conv_id:
                close(True)
                piece = _Piece(conv, True)
            elif piece.full(limit):
                close(False)
                piece = _Piece(conv, False)
            if text is not None:
                piece.add(turn, role, text)
        if len(out) > 2000 or size > PIECE_CHARS:
            yield pa.RecordBatch.from_pylist(out, _ARROW)
            out.clear()
            size = 0
    if piece is not None:
        close(False)
    if out:
        yield pa.RecordBatch.from_pylist(out, _ARROW)


def _firsts(pieces: DataFrame) -> DataFrame:
    """By piece, the turns that no equal turn of the conversation comes before (``fresh``)."""

    def apart(batches):
        for b in batches:
            for conv, pid, seq, d in zip(*(b.column(c).to_pylist() for c in ("conv_id", "pid", "seq", "digests")), strict=True):
                n = len(d) // 16
                yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv] * n, pa.int64()), "pid": pa.array([pid] * n, pa.int32()), "seq": pa.array([seq] * n, pa.int32()), "i": pa.array(range(n), pa.int32()), "digest": pa.array([d[16 * k : 16 * k + 16] for k in range(n)], pa.binary())})

    turns = pieces.select("conv_id", "pid", "seq", "digests").mapInArrow(apart, "conv_id long, pid int, seq int, i int, digest binary")
    first = turns.groupBy("conv_id", "digest").agg(F.min(F.struct("pid", "seq", "i")).alias("at")).select("at.*")
    return first.groupBy("pid", "seq").agg(F.collect_list("i").alias("fresh"))


def _judged(pieces: DataFrame) -> DataFrame:
    """By piece: its part of the audit, the place before it, and in its conversation's last piece the counts of the whole."""

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pid", "seq"]).reset_index(drop=True)
        blank = again = illegal = turns = 0
        symbols, last, final, low, high = bytearray(), None, None, None, None
        sizes = []
        for p in pdf.itertuples():
            own = bytearray(p.symbols)
            fresh = set() if p.fresh is None else set(p.fresh)
            for i, s in enumerate(own):
                if s == GONE:
                    blank += 1
                elif i not in fresh:
                    own[i] = GONE
                    again += 1
            symbols += own
            sizes.append(len(own))
            illegal += int(p.illegal)
            if p.first is not None:
                illegal += final is not None and final + p.first not in LEGAL
                final = p.final
            if p.low is not None:
                a, b = int(p.low), int(p.high)
                turns += int(p.n_turns) - (last == a)
                low, high, last = a if low is None else low, b, b
        cost, letters, places = Automaton().repair(bytes(symbols))
        out, at = [], 0
        for k, (p, n) in enumerate(zip(pdf.itertuples(), sizes, strict=True)):
            end = k == len(sizes) - 1
            part = "".join(letters[at : at + n + end])
            out.append((p.pid, p.seq, part, places[at]) + ((0 if low is None else high - low + 1 - turns, blank, again, sum(s % 2 for s in symbols), illegal, cost) if end else (None,) * 6))
            at += n
        return pd.DataFrame(out, columns=["pid", "seq", "part", "place", *DONE], dtype=object)

    small = pieces.select("conv_id", "pid", "seq", "symbols", "fresh", F.col("low").cast("string"), F.col("high").cast("string"), "n_turns", "illegal", "first", "final")
    return small.groupBy("conv_id").applyInPandas(lambda pdf: whole(pdf), "pid int, seq int, part string, place int, " + ", ".join(f"{n} long" for n in DONE))


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.to_pylist()
        lines = [applied(r["part"], r["place"], r["roles"] or [], r["texts"] or []) for r in rows]
        yield pa.RecordBatch.from_pydict({
            "conv_id": pa.array([r["conv_id"] for r in rows], pa.int64()), "pid": pa.array([r["pid"] for r in rows], pa.int32()), "seq": pa.array([r["seq"] for r in rows], pa.int32()), "part": pa.array([r["part"] for r in rows], pa.string()),
            "lines": pa.array([len(x) for x in lines], pa.int64()), "text": pa.array(["\n".join(x) for x in lines], pa.string()), **{n: pa.array([r[n] for r in rows], pa.int64()) for n in DONE},
        })


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of each conversation come in order; its last one has the counts."""
    sha, audit, begun = hashlib.sha256(), [], False
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["lines"]:
                sha.update((b"\n" if begun else b"") + r["text"].encode())
                begun = True
            audit.append(r["part"])
            if r["cost"] is not None:
                out.append({"conv_id": r["conv_id"], **{n: r[n] for n in DONE}, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()})
                sha, audit, begun = hashlib.sha256(), [], False
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([_ARROW.field(n) for n in ("conv_id", *DONE, "audit", "repaired_sha256")]))


def repair(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Faults and the cheapest repair of each conversation of ``rows`` (``conv_id, turn, role, text``), after ``damaged``.

    Null roles and texts are one space; null turns come first and count for no
    gap; a null ``conv_id`` is a conversation of its own. Turns of one number are
    ordered by role and then by the MD5 of the text, so that equal rows adjoin. A
    role that is empty or begins with another letter than s, u or a must be renamed
    or go. A conversation without turns has zeros, an empty audit and the hash of
    nothing; an empty table has no rows. Other columns are not read. ``piece`` is
    the most turns that a task holds at a time.
    """
    small_batches(rows.sparkSession)
    order: list[Column] = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie")]
    found = dealt_in_order(damaged(rows.withColumn("conv_id", F.col("conv_id").cast("long"))).withColumn("tie", F.md5("text")), order).select("conv_id", "turn", "role", "text").mapInArrow(partial(_scan, limit=piece), SCHEMA)
    found = store(found, "repair")
    result = ["conv_id", *DONE, "audit", "repaired_sha256"]
    pieces = found.filter("not done")
    pieces = pieces.join(_firsts(pieces), ["pid", "seq"], "left")
    parts = _judged(pieces)
    texts = found.filter("not done").select("conv_id", "pid", "seq", "roles", "texts").join(parts, ["pid", "seq"])
    fixed = texts.mapInArrow(_repaired, "conv_id long, pid int, seq int, part string, lines long, text string, " + ", ".join(f"{n} long" for n in DONE))
    fixed = fixed.repartition("conv_id").sortWithinPartitions("conv_id", "pid", "seq")
    rest = fixed.mapInArrow(_hashed, "conv_id long, " + ", ".join(f"{n} long" for n in DONE) + ", audit string, repaired_sha256 string")
    return found.filter("done").select(*result).unionByName(rest.select(*result))
