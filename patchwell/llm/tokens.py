"""Token ids by the ``tokenizers`` library, each distinct word encoded once a worker.

Text is cut where the tokenizer's own pre-tokenizer always cuts: at white space.
What a word gives there does not depend on its neighbours, so its ids are kept
in a bounded table of the worker. Words of Latin-1 letters, digits and signs go
to the library's BPE model directly; any other goes through its whole chain, and
so does a text with unusual white space.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import regex

from .scratch import owned

#: Set on the last id of a word that ends a sentence, in ``encode_marked``.
MARK = np.uint32(1 << 31)


def _byte_letters() -> list[str]:
    """Byte-level BPE's letters: printable Latin-1 bytes are themselves, the rest follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


class _Words(dict):
    """Word to ids; what is missing is taken over from older words, or learned as it is met."""

    def __init__(self, owner: "Encoder", before: str):
        self.owner, self.before, self.older = owner, before, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word) or self.owner.learn(word if word[:1] == "\n" else self.before + word)
        self[word] = ids
        return ids

    def age(self) -> None:
        """What has not been met since the last time is dropped."""
        self.older = dict(self)
        self.clear()


class Encoder:
    """Ids of texts by one tokenizer file. ``lowered``: its words are lower-cased and lose white space."""

    def __init__(self, path: str, limit: int = 250_000):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        #: Words that are kept, some 250 bytes each.
        self.limit = limit
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.model = self.tok.model
        self.lowered = self.tok.normalizer is not None
        self.letters = {b: c for b, c in enumerate(_byte_letters()) if c != chr(b)}
        self.space, self.feed = self.letters[0x20], self.letters[0x0A]
        if self.lowered:
            self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        else:
            self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.odd = re.compile(r"[\x1c-\x1f]" if self.lowered else r"[^\S \n]|[\x1c-\x1f\x85᠎​]")
        self.simple = re.compile(r"[\n\x20-\x7e\xa1-\xac\xae-\xff]*").fullmatch
        self.cut = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall
        self.ends = {".", "!", "?"}
        #: Words by themselves, and those after one space, which has been cut off.
        self.words, self.spaced = _Words(self, ""), _Words(self, "" if self.lowered else " ")
        self.pieces: dict[str, bytes] = {}

    def learn(self, w: str) -> bytes:
        """Ids of one word, the last of a sentence marked."""
        space = 0 if self.lowered else 1
        if w.isascii() and w[space:].isalpha() and (not space or w[0] == " ") and (space or w.islower()):
            return self._spell(w)  # most words: kept by their table alone
        known, piece, mark = self.pieces.get, self._piece, False
        plain = self.spaced if space else self.words
        if not self.simple(w):
            ids, mark = array("I", self.tok.encode(w, add_special_tokens=False).ids).tobytes(), True
        else:
            low = w.lower() if self.lowered else w
            if low[space:].isalpha() and (not space or low[0] == " "):
                return self._spell(low) if low == w else plain[low]
            if low[-1] in ".," and low[space:-1].isalpha() and (not space or low[0] == " "):
                ids, mark = plain[low[space:-1]] + (known(low[-1]) or piece(low[-1])), low[-1] == "."
            else:
                ids, mark = b"".join([known(p) or piece(p) for p in self.pattern.findall(low)]), True
        return ids[:-1] + bytes([ids[-1] | 0x80]) if mark and ids and w.rstrip()[-1:] in self.ends else ids

    def _piece(self, p: str) -> bytes:
        """Ids of one pre-token, which are kept."""
        got = self.pieces[p] = self._spell(p)
        return got

    def _spell(self, p: str) -> bytes:
        """Ids of one pre-token, in little-endian order as on every usual machine."""
        # Of the plain words that come here, ASCII ones have no other bytes to spell than these two.
        raw = p.replace(" ", self.space).replace("\n", self.feed) if p.isascii() else p.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(raw)]).tobytes()

    def ids(self, text: str) -> bytes | None:
        """Marked ids; None where white space is unusual."""
        if any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f") if text.isascii() and not self.lowered else self.odd.search(text):
            return None
        if self.lowered:
            return b"".join(map(self.words.__getitem__, text.split()))
        # A line feed begins a word of its own, so all cuts are at one space.
        cut = text.replace("\n", " \n")
        if "  " in cut or "\n\n" in text or text[:1] in " \n" or text[-1:] in " \n":
            return b"".join(map(self.words.__getitem__, self.cut(text)))
        first, *rest = cut.split(" ")
        return self.words[first] + b"".join(map(self.spaced.__getitem__, rest))

    def encode_marked(self, texts) -> list[np.ndarray]:
        """Ids of each text (null: none), sentence ends with ``MARK`` set."""
        if len(self.words) + len(self.spaced) > self.limit // 2:  # as many are older ones
            self.words.age()
            self.spaced.age()
        if len(self.pieces) > self.limit // 2:
            self.pieces.clear()
        out = []
        for t in texts:
            got = self.ids(t) if isinstance(t, str) else b""
            if got is None:
                e = self.tok.encode(t, add_special_tokens=False)
                ids = np.array(e.ids, np.uint32)
                stops = [i for i, (a, b) in enumerate(e.offsets) if t[a:b][-1:] in self.ends]
                ids[stops] |= MARK
                out.append(ids)
            else:
                out.append(np.frombuffer(got, np.uint32))
        return out

    def encode(self, texts) -> list[np.ndarray]:
        return [x & ~MARK for x in self.encode_marked(texts)]


def encoder(path: str, limit: int = 250_000) -> Encoder:
    """The worker's own encoder of a file, until a task releases it or another operator keeps something."""
    return owned(("encoder", path, limit), lambda: Encoder(path, limit))
