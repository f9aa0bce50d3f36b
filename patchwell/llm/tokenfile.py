"""Token ids in compressed binary files: context mixing and a range coder, many blocks at a time.

An id is coded as a *case*: the id that last followed the same two ids (order 2),
the one that last followed the same id (order 1), an id of a table of recent ones
(order 0), or a new one. The case's distribution mixes adaptive counts of the
block, of how well order 1 has done in its context, of how well order 2 has, and
of both; the closer the context, the more its counts weigh. An order-0 id follows
by its place in the table, under adaptive counts of places, and a new id by how
many bits it has, under adaptive counts, and those bits. Everything goes through
one range coder with 32-bit range and 16-bit digits, whose carries are added to
the digits when the block is done. How much each of the four counts weighs is the
block's own: of a few mixes the one that would have coded its ids best so far, judged
anew whenever their number has doubled. Shares are renewed from the counts every
``RENEW`` ids, and sooner in the beginning.

Every block of ``BLOCK`` ids starts from nothing and has its own checksums, so
one can be decoded, or found damaged, alone. For the same reason all blocks of a
segment advance together, one id a step, as NumPy lanes.

A segment is: ``PWT3``, bytes of it, documents, ids, raw bits (16 or 32), CRC of
the index; the index (doc ids, a null flag, ids of each document); each block's
ids, bytes, CRC of the bytes and CRC of the ids; the blocks, which are digits. A
file is its segments, a line feed after each.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import dealt_in_order, new_path, small_batches, split_batches, store, tidy
from .tokens import encoder

BLOCK = 2048
LANES = 4096
SEGMENT = 8_000_000
END_ID = 0
MAGIC = b"PWT3"
_HEAD = "<4sQQQBI"
#: Bits of a distribution's total, of a context table and of the order-0 table.
_TOTAL, _KEYS, _SLOTS = 12, 10, 8
RENEW = 64
#: Characters of a file's texts, and words that a worker keeps from task to task (some 250 bytes each).
FILE_CHARS, WORDS = 16_000_000, 1_000_000
#: How well a context has done, after a miss (first four) or a hit: 0 to 3.
_NEXT = np.array([0, 0, 1, 1, 1, 2, 3, 3])


def slot_of(ids):
    return (ids * 40503 >> 7) & ((1 << _SLOTS) - 1)


def bits_of(ids: np.ndarray) -> np.ndarray:
    """How many bits each id has, 0 for 0: a float's exponent."""
    return np.maximum((ids.astype(np.float64).view(np.int64) >> 52) - 1022, 0)


def _shares(counts: np.ndarray, symbols: int, out: np.ndarray) -> None:
    """For each lane, a symbol's size, and 16 bits up where its share begins; no share is below 8. Few lanes at a time, as they stay in the cache."""
    room, whole = (1 << _TOTAL) - 8 * symbols, np.uint32(1 << _TOTAL)
    out[:, symbols:] = whole << 16  # where symbols that are not used would begin
    for i in range(0, len(counts), 64):
        c, shares = counts[i : i + 64, :symbols], out[i : i + 64, :symbols]
        exact = c.astype(np.float64)
        exact *= (room / np.maximum(1, c.sum(axis=1, dtype=np.int32)).astype(np.float32)).astype(np.float32)[:, None]
        size = exact.astype(np.int32).view(np.uint32)
        size += np.uint32(8)
        begin = size << 16
        np.cumsum(begin, axis=1, out=shares)
        shares -= begin
        size[:, -1] = whole - (shares[:, -1] >> 16)
        shares |= size


#: Weights of the four counts of a case that a block may mix: of both states, of order 1's, of order 2's, and of all.
MIXES = np.array([[16, 4, 4, 1], [64, 4, 4, 1], [4, 16, 4, 1], [4, 4, 16, 1], [2, 2, 2, 4]], np.int32)


def _cost(share: np.ndarray) -> np.ndarray:
    """Bits that a symbol of this share costs, in 4096ths: by exponent and a straight line between, from exact operations alone, so that every machine tells the same."""
    part, exponent = np.frexp(share)
    return ((2.0 - exponent - 2.0 * part) * 4096).astype(np.int64)


class Lanes:
    """The model's state for ``n`` blocks, flat by block. A context's entry is its id times 4, plus how well it has done; the entry of the order-0 table likewise, its last bits are not used."""

    def __init__(self, n: int, width: int, bits: int):
        self.kind = kind = np.int32 if bits == 16 else np.int64  # products may wrap, the same way in both directions
        row = np.arange(n)
        self.n, self.mixes, self.most = n, row << 6, bits + 1
        #: Where each block's entries begin: order 1, order 2, order 0.
        self.keys = np.stack([row << _KEYS, (n + row) << _KEYS, (2 * n << _KEYS) + (row << _SLOTS)])
        self.table = np.full((2 * n << _KEYS) + (n << _SLOTS), -4, kind)
        self.next = _NEXT.astype(kind)
        #: Of each step since shares were renewed: by block, order 2's state, order 1's state and case.
        self.coded = np.zeros((min(RENEW, width), n), np.int64)
        self.counts = np.zeros(n << 6, np.int64)
        #: How often a place of the order-0 table, and a number of bits, came up, in one row with what needs neither; and their shares, of which the last changes nothing.
        self.second = np.zeros((n << _SLOTS) + (n << 6) + 1, np.int32)
        self.second_shares = np.ones(len(self.second), np.uint32)
        self.recent, self.classes, self.nothing = row << _SLOTS, (n << _SLOTS) + (row << 6), len(self.second) - 1
        self.places, self.sizes = self.second[: n << _SLOTS].reshape(n, -1), self.second[n << _SLOTS : -1].reshape(n, 64)
        self.place_shares, self.size_shares = self.second_shares[: n << _SLOTS], self.second_shares[n << _SLOTS : -1]
        #: The last two ids' hashes.
        self.h = self.g = np.zeros(n, kind)
        self.t = self.renewed = 0
        #: By block, the mix that would have cost least so far, and what each would have.
        self.weights, self.costs, self.judged = np.repeat(MIXES[:1], n, axis=0), np.zeros((n, len(MIXES)), np.int64), np.zeros(n << 6, np.int64)

    def until(self, width: int) -> int:
        """How many steps the shares now hold for."""
        return min(next(t for t in (4, 8, 16, 32, self.t // RENEW * RENEW + RENEW) if t > self.t), width) - self.t

    def _mixed(self, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
        # By columns: adding up four planes is much less work than many sums of four.
        c = np.ascontiguousarray(counts.astype(np.int32).reshape(self.n, 64).T).reshape(4, 4, 4, self.n)
        by_two = c[:, 0] + c[:, 1] + c[:, 2] + c[:, 3]
        by_one = c[0] + c[1] + c[2] + c[3]
        every = by_two[0] + by_two[1] + by_two[2] + by_two[3] + 1
        w = weights.T
        every *= w[3]
        by_one *= w[1]
        by_one += every
        by_two *= w[2]
        c *= w[0]
        c += by_one
        c += by_two[:, None]
        return c

    def adapt(self) -> None:
        """Each block takes the mix that would have coded it best: every mix of what was counted up to the last time is held against what came since."""
        new = np.ascontiguousarray((self.counts - self.judged).reshape(self.n, 64).T).reshape(4, 4, 4, self.n)
        for k, weights in enumerate(MIXES):
            mixed = self._mixed(self.judged, weights[None, :])
            cost = _cost(mixed / (mixed[:, :, 0] + mixed[:, :, 1] + mixed[:, :, 2] + mixed[:, :, 3])[:, :, None])
            cost *= new
            self.costs[:, k] += cost.reshape(64, self.n).sum(axis=0)
        self.weights, self.judged = MIXES[self.costs.argmin(axis=1)], self.counts.copy()

    def renew(self) -> None:
        """Shares of the cases for each pair of states, of places and of numbers of bits."""
        self.counts += np.bincount(self.coded[: self.t - self.renewed].ravel(), minlength=self.n << 6)
        self.renewed = self.t
        if self.t >= RENEW and self.t & (self.t - 1) == 0:
            self.adapt()
        mixed = self._mixed(self.counts, self.weights)
        share = ((1 << _TOTAL) - 64) / (mixed[:, :, 0] + mixed[:, :, 1] + mixed[:, :, 2] + mixed[:, :, 3])
        size = (mixed * share[:, :, None]).astype(np.uint32) + np.uint32(16)
        begin = np.zeros_like(size)
        for k in range(3):
            np.add(begin[:, :, k], size[:, :, k], out=begin[:, :, k + 1])
        size[:, :, 3] = (1 << _TOTAL) - begin[:, :, 3]
        self.shares = np.ascontiguousarray((begin << 16 | size).reshape(64, self.n).T).ravel()
        _shares(self.places, 1 << _SLOTS, self.place_shares.reshape(self.n, -1))
        _shares(self.sizes, self.most, self.size_shares.reshape(self.n, -1))

    def contexts(self, h, g, out) -> None:
        """Entries of orders 1 and 2 for hashes of the last id and of the one before."""
        np.add(h >> 3 & ((1 << _KEYS) - 1), self.keys[0], out=out[0])
        np.add((h + g * self.kind(613)) >> 5 & ((1 << _KEYS) - 1), self.keys[1], out=out[1])

    def follow(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Go through steps whose ids are known, (steps, blocks): what the three entries held before each, and where the entries are."""
        steps = len(x)
        hashes = np.concatenate([[self.g, self.h], x * self.kind(40503)])
        self.g, self.h = hashes[-2], hashes[-1]
        at, held = np.empty((steps, 3, self.n), np.int64), np.empty((steps, 3, self.n), self.kind)
        self.contexts(hashes[1:-1], hashes[:-2], at.swapaxes(0, 1))
        np.add(slot_of(x), self.keys[2], out=at[:, 2])
        new = x << 2
        for t in range(steps):
            e = self.table.take(at[t], out=held[t], mode="clip")
            self.table[at[t].ravel()] = self.entries(e, new[t]).ravel()
        return held, at

    def entries(self, held, new):
        """An entry that held one thing and gets an id (times 4) next."""
        held = held ^ new
        state = held & 3
        state += (held == state) << 2
        state = self.next.take(state, mode="clip")
        state += new
        return state


class Encoder:
    """A range coder for each lane, and the digits so far."""

    def __init__(self, n: int, digits: int):
        self.low, self.rng = np.zeros(n, np.uint32), np.full(n, (1 << 32) - 1, np.uint32)
        self.out, self.begin = np.zeros(n * digits, np.uint32), np.arange(n) * digits
        self.at = self.begin.copy()

    def put(self, symbols: list[tuple]) -> None:
        """Of each step, one symbol after the other: bits of the total, where a share begins, and its size (None: 1), each (steps, lanes). No bits, from 0, of size 1 change nothing."""
        steps, n = symbols[0][1].shape
        lows, full, carry = np.empty((steps, len(symbols), n), np.uint32), np.empty((steps, len(symbols), n), bool), np.empty((steps, len(symbols), n), bool)
        low, rng, r, x, four, least = self.low, self.rng, np.empty(n, np.uint32), np.empty(n, np.uint32), np.uint32(4), np.uint32(1 << 16)
        for t in range(steps):
            for s, (total, begin, size) in enumerate(symbols):
                np.right_shift(rng, total[t], out=r)
                np.multiply(r, begin[t], out=x)
                sums = np.add(low, x, out=lows[t, s])
                np.less(sums, x, out=carry[t, s])
                if size is None:
                    rng, r = r, rng
                else:
                    np.multiply(r, size[t], out=rng)
                np.less(rng, least, out=full[t, s])
                np.left_shift(full[t, s], four, out=x, dtype=np.uint32)
                np.left_shift(sums, x, out=low)
                np.left_shift(rng, x, out=rng)
        self.low, self.rng = low, rng
        full, carry, lows = full.reshape(-1, n), carry.ravel(), lows.ravel()
        # Digits of a lane up to each symbol: at most 4 in each of RENEW steps, so a byte holds their number.
        count = np.cumsum(full.view(np.uint8), axis=0, dtype=np.uint8 if len(full) < 256 else np.int64)
        more, count, full = count[-1], count.ravel(), full.ravel()
        k = np.flatnonzero(full)
        self.out[self.at.take(k - k // n * n) + count.take(k) - 1] = lows.take(k) >> 16
        # A carry goes to the last digit before its symbol's own.
        k = np.flatnonzero(carry)
        self.out[self.at.take(k - k // n * n) + count.take(k) - full.take(k) - 1] += 1
        self.at += more

    def end(self) -> list[bytes]:
        for _ in range(2):
            self.out[self.at] = self.low >> 16
            self.low <<= 16
            self.at += 1
        over = np.flatnonzero(self.out >> 16)
        while len(over):
            self.out[over] &= 0xFFFF
            over = over - 1
            self.out[over] += 1
            over = over[self.out[over] >> 16 > 0]
        out = self.out.astype("<u2")
        return [out[a:b].tobytes() for a, b in zip(self.begin.tolist(), self.at.tolist(), strict=True)]


class Decoder:
    def __init__(self, blobs: list[bytes]):
        n, most = len(blobs), max(map(len, blobs)) // 2 + 4
        words = np.zeros((n, most), np.uint32)
        for i, b in enumerate(blobs):
            words[i, : len(b) // 2] = np.frombuffer(b, "<u2")
        self.rng, self.code = np.full(n, (1 << 32) - 1, np.uint32), words[:, 0] << 16 | words[:, 1]
        self.words, self.at = words.ravel(), np.arange(n) * most + 2

    def take(self, at, r, share) -> None:
        self.code[at] -= r * (share >> 16)
        r *= share & 0xFFFF
        self.rng[at] = r
        self.fill(at, r)

    def fill(self, at, rng) -> None:
        full = np.flatnonzero(rng < 1 << 16)
        if len(full):
            at = full if isinstance(at, slice) else at.take(full)
            place = self.at.take(at)
            self.code[at] = self.code.take(at) << 16 | self.words.take(place)
            place += 1
            self.at[at] = place
            self.rng[at] = rng.take(full) << 16

    def within(self, at) -> tuple[np.ndarray, np.ndarray]:
        """The unit of the lanes' ranges, and what shares are at most that begin where the code is or before."""
        r = self.rng[at] >> _TOTAL
        return r, self.code[at] // r << 16 | 0xFFFF

    def symbol(self, at, shares, row, steps: int, many: int | None = None, few: int = 0):
        """The symbol of each lane ``at``, by binary search in its row of shares of ``2 ** steps`` symbols; of ``2 ** few`` after the first ``many`` lanes."""
        r, most = self.within(at)
        base = row.copy()
        for k in range(steps - 1, -1, -1):
            b, m = (base, most) if many is None or k < few else (base[:many], most[:many])
            b += (shares.take(b + (1 << k)) <= m) * np.int64(1 << k)
        self.take(at, r, shares.take(base))
        base -= row
        return base

    def bits(self, at, k):
        r = self.rng.take(at) >> k
        code = self.code.take(at)
        value = code // r
        self.code[at] = code - value * r
        self.rng[at] = r
        self.fill(at, r)
        return value


def encode_blocks(ids: np.ndarray, lengths: np.ndarray, bits: int) -> list[bytes]:
    """``ids`` (blocks, BLOCK) with each block's length. Shorter blocks go on with what fills them.

    All ids are known here, so what is predicted comes first, for the steps between two renewals of the shares at once.
    """
    n, width = len(ids), int(lengths.max(initial=0))
    m, e = Lanes(n, width, bits), Encoder(n, width * (2 if bits == 16 else 4) + 8)
    ids = np.ascontiguousarray(ids[:, :width].T, m.kind)
    while m.t < width:
        m.renew()
        steps = m.until(width)
        x = ids[m.t : m.t + steps]
        held, at = m.follow(x)
        differ = held >> 2 != x[:, None]
        # 0 if order 2 knew it, or 1 if order 1 did, or 2 if order 0 did.
        case = ((differ[:, 2].view(np.uint8) + np.uint8(1)) * differ[:, 0] + np.uint8(1)) * differ[:, 1]
        coded = np.add((held[:, 1] & 3) << 4 | (held[:, 0] & 3) << 2 | case, m.mixes, out=m.coded[:steps])
        share = m.shares.take(coded)
        symbols = [(np.full(steps, _TOTAL, np.uint32), share >> 16, share & 0xFFFF)]
        second = np.where(case == 2, at[:, 2] - (2 * n << _KEYS), m.nothing).ravel()
        new = np.flatnonzero(case == 3)
        rest = x.ravel().take(new).astype(np.int64)
        k = bits_of(rest)
        second[new] = m.classes.take(new - new // n * n) + k
        np.add.at(m.second, second, np.int32(1))  # of its own kind, or it goes one by one
        share = m.second_shares.take(second).reshape(steps, n)
        symbols.append(((case > 1) * np.uint32(_TOTAL), share >> 16, share & 0xFFFF))
        k = np.maximum(k - 1, 0)
        rest &= (1 << k) - 1
        for low in (0,) if bits == 16 else (16, 0):
            total, value = np.zeros((steps, n), np.uint32), np.zeros((steps, n), np.uint32)
            total.ravel()[new] = np.maximum(k - 16, 0) if low else np.minimum(k, 16)
            value.ravel()[new] = rest >> low & 0xFFFF
            symbols.append((total, value, None))
        e.put(symbols)
        m.t += steps
    return e.end()


def decode_blocks(blobs: list[bytes], lengths: np.ndarray, bits: int) -> np.ndarray:
    n, width = len(blobs), int(lengths.max(initial=0))
    m, d, every = Lanes(n, width, bits), Decoder(blobs), slice(None)
    steps = np.zeros((width, n), m.kind)
    at = np.zeros((3, n), np.int64)
    few = 5 if bits == 16 else 6
    while m.t < width:
        m.renew()
        rows = [np.zeros(0, np.int64)]
        for t in range(m.t, m.t + m.until(width)):
            m.contexts(m.h, m.g, at)
            held = m.table.take(at[:2])
            state = held & 3
            mix = ((state[1] << 2) + state[0] << 2) + m.mixes
            r, most = d.within(every)
            base = mix + ((m.shares.take(mix + 2) <= most) << 1)
            base += m.shares.take(base + 1) <= most
            d.take(every, r, m.shares.take(base))
            m.coded[t - m.t] = base
            case = base & 3
            x = np.where(case == 0, held[1], held[0]) >> 2
            recent, new = np.flatnonzero(case == 2), np.flatnonzero(case == 3)
            if len(recent) + len(new):
                lanes, known = np.concatenate([recent, new]), len(recent)
                row = np.concatenate([m.recent.take(recent), m.classes.take(new)])
                got = d.symbol(lanes, m.second_shares, row, _SLOTS, known, few)
                row += got
                rows.append(row)
                x[recent] = m.table.take(row[:known] + (2 * n << _KEYS)) >> 2
            if len(new):
                k = got[known:]
                low = np.maximum(k - 1, 0)
                value = np.where(k > 0, np.int64(1) << low, 0)
                if bits > 16:
                    value |= d.bits(new, np.maximum(low - 16, 0).astype(np.uint32)).astype(np.int64) << 16
                x[new] = value | d.bits(new, np.minimum(low, 16).astype(np.uint32))
            steps[t] = x
            np.add(slot_of(x), m.keys[2], out=at[2])
            new = x << 2
            m.table[at[:2].ravel()] = m.entries(held, new).ravel()
            m.table[at[2]] = new
            m.h, m.g = x * m.kind(40503), m.h
        np.add.at(m.second, np.concatenate(rows), np.int32(1))
        m.t = t + 1
    return steps.T


def _groups(n: int) -> list[tuple[int, int]]:
    """Blocks that advance together: at most ``LANES``, in groups of like size, as a step takes its time for few lanes too."""
    groups = -(-n // LANES)
    return [(n * k // groups, n * (k + 1) // groups) for k in range(groups)]


def write_segment(names: list, ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """Documents (their ids may be None) and all their token ids as one segment."""
    bits = 16 if not len(ids) or ids.max() < 1 << 16 else 32
    n = -(-len(ids) // BLOCK)
    grid = np.zeros(n * BLOCK, np.int64)
    grid[: len(ids)] = ids
    lengths = np.minimum(BLOCK, len(ids) - np.arange(n) * BLOCK)
    blobs: list[bytes] = []
    for i, j in _groups(n):
        blobs += encode_blocks(grid.reshape(n, BLOCK)[i:j], lengths[i:j], bits)
    small = ids.astype("<u4")
    index = np.array([0 if x is None else x for x in names], "<i8").tobytes() + np.array([x is None for x in names], np.uint8).tobytes() + sizes.astype("<u8").tobytes()
    table = b"".join([struct.pack("<IIII", int(lengths[i]), len(b), zlib.crc32(b), zlib.crc32(small[i * BLOCK : i * BLOCK + int(lengths[i])].tobytes())) for i, b in enumerate(blobs)])
    total = struct.calcsize(_HEAD) + len(index) + len(table) + sum(map(len, blobs))
    return struct.pack(_HEAD, MAGIC, total, len(names), len(ids), bits, zlib.crc32(index)) + index + table + b"".join(blobs)


def read_segment(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    magic, total, docs, count, bits, crc = struct.unpack_from(_HEAD, data)
    if magic != MAGIC or total != len(data):
        raise ValueError("not a whole segment")
    at = struct.calcsize(_HEAD)
    index = data[at : at + 17 * docs]
    if zlib.crc32(index) != crc:
        raise ValueError("damaged index")
    names = [None if z else x for x, z in zip(np.frombuffer(index, "<i8", docs).tolist(), np.frombuffer(index, np.uint8, docs, 8 * docs).tolist(), strict=True)]
    sizes = np.frombuffer(index, "<u8", docs, 9 * docs).astype(np.int64)
    at += len(index)
    n = -(-count // BLOCK)
    table = np.frombuffer(data, "<u4", 4 * n, at).reshape(n, 4)
    at += table.nbytes
    ids = np.zeros(n * BLOCK, np.int64).reshape(n, BLOCK)
    for i, j in _groups(n):
        blobs = []
        for k in range(i, j):
            blobs.append(data[at : at + int(table[k, 1])])
            at += int(table[k, 1])
            if zlib.crc32(blobs[-1]) != table[k, 2]:
                raise ValueError(f"damaged block {k}")
        got = decode_blocks(blobs, table[i:j, 0].astype(np.int64), bits)
        ids[i : i + len(got), : got.shape[1]] = got
    ids = ids.ravel()[:count].astype("<u4")
    for k in range(n):
        if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].tobytes()) != table[k, 3]:
            raise ValueError(f"block {k} has other ids")
    return names, ids, sizes


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, words: int = WORDS) -> None:
    """Files of ids in ascending doc_id (null first); each text ends in ``end_id``.

    There are as many files as the texts' characters ask for, so a file stays far
    below what one row can hold; rows of one id may lie in several.
    """
    chars = docs.agg(F.sum(F.length("text"))).head()[0] or 0
    parts = max(1, -(-chars // FILE_CHARS))

    def run(batches):
        enc = encoder(tokenizer, words)
        names, parts, sizes, total = [], [], [], 0
        for pdf in split_batches(batches):
            names += [None if x is None else int(x) for x in pdf["doc_id"]]
            for x in enc.encode(pdf["text"]):
                x = np.append(x, np.uint32(end_id))
                parts.append(x)
                sizes.append(len(x))
                total += len(x)
            if total >= SEGMENT:
                yield pd.DataFrame({"value": [write_segment(names, np.concatenate(parts), np.array(sizes))]})
                names, parts, sizes, total = [], [], [], 0
        if names:
            yield pd.DataFrame({"value": [write_segment(names, np.concatenate(parts), np.array(sizes))]})
        tidy()

    rows = dealt_in_order(docs.select("doc_id", "text"), [F.col("doc_id").asc_nulls_first()], parts)
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    # Bytes as they are; Spark's writer commits a file only as a whole.
    rows.mapInPandas(run, "value binary").select(F.col("value").cast("string")).write.text(path)


def read(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files below ``path``."""

    def run(batches):
        for pdf in batches:
            for part, data in zip(pdf["part"], pdf["content"], strict=True):
                at, before = 0, 0
                while at < len(data):
                    size = struct.unpack_from(_HEAD, data, at)[1]
                    names, ids, sizes = read_segment(data[at : at + size])
                    ends = np.cumsum(sizes)
                    out = pd.DataFrame({"part": part, "doc_id": [None if x is None else str(x) for x in names], "local": before + ends - sizes, "n_tokens": sizes})
                    out["ids_crc32"] = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                    yield out
                    before += len(ids)
                    at += size + 1

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int").alias("part"), "content").filter("part is not null")
    rows = store(files.mapInPandas(run, "part int, doc_id string, local long, n_tokens long, ids_crc32 long"), "decoded")
    total = rows.groupBy("part").agg(F.sum("n_tokens").alias("t"))  # a row a file
    begin = total.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("begin"))
    return rows.join(begin, "part").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("begin") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write and read back. A null or empty text is its end id; repeated rows each stay; no rows give no rows."""
    spark = docs.sparkSession
    small_batches(spark)
    path = new_path(spark, "tokens")
    write(docs, path, tokenizer)
    return read(spark, path)
