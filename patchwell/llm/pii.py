"""Personal data by patterns and a skip-chain conditional random field.

Patterns give base spans, which always stay. The field then labels *units*
(address-like and number-like stretches) of one document together: neighbours in
the text share a potential, and so do distant units that are equal (the same last
nine digits, or address) or similar (the same last seven digits, or the name
before the @). Loopy message passing spreads labels along those edges, so a
number written once in full and once without its marks gets one label. A unit
that no base span touches is added where the belief in a label is at least what
held-out examples ask for; what it looks like is told in parts (how many digits,
which marks), so a look that no sample had is still told by its parts.

Potentials are weights of a softmax regression of a unit's label on its look, the
word before it, and the labels of the units that edges tie it to, with base spans
as labels. Patterns label only what matches them, so what they miss is made from
what they find: of each base span, writings without its marks are examples of its
label, tied to it, and the same writings untied are examples of no label. Both
say by themselves how much an equal or similar writing counts. The penalty is
the one with the best likelihood on a fifth of the sample that the weights have
not seen, and the least belief is the one where ``PRECISION`` of what would be
added there is right. The sample is bounded by ``MAX_DOCS``. A unit that repeats a
base span's key without matching a pattern is of unknown label, and no example of
anything.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import crc, mapped

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
MAX_DOCS = 20_000
#: Share of right ones among held-out examples that the least belief must reach, and the beliefs that are tried.
PRECISION, BELIEFS = 0.98, (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)
PENALTIES = (0.1, 1.0, 10.0)
#: Numbers of words before a unit.
WORDS = 64
ROUNDS = 10
#: Edges whose messages are computed at once; all of a document's units pass messages together.
AT_ONCE = 20_000

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"\+?\(?[0-9](?:[ ().-]{0,2}[0-9])++")
_ADDRESS = re.compile(r"[A-Za-z0-9.-]++")
_BEFORE = re.compile(r"([^\W\d_]+)[^\w]{0,2}\Z")
_LOCALS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses, found from each @ outwards so that long words cost no more than their length."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _LOCALS:
            a -= 1
        m = _HOST.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in order, kinds by their place in ``KINDS``."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def addresses(text: str) -> list[tuple[int, int]]:
    """Stretches that look like addresses, from each @ outwards, of any length."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _LOCALS:
            a -= 1
        m = _ADDRESS.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def units(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, key)`` of address-like and number-like stretches; equal keys are the same thing written twice. Numbers within addresses are none."""
    found = addresses(text) if "@" in text else []
    out = [(a, b, text[a:b].lower().rstrip(".-")) for a, b in found]
    k = 0
    for m in _NUMBER.finditer(text):
        while k < len(found) and found[k][1] <= m.start():
            k += 1
        d = "".join(_DIGIT.findall(m[0]))
        if len(d) >= 7 and (k == len(found) or found[k][0] >= m.end()):
            out.append((m.start(), m.end(), d[-9:]))
    return sorted(out)


def look(s: str) -> tuple[str, str]:
    """What a unit looks like, in two parts: how many digits (or that it is an address), and its marks; of as many as a card has, also whether their check digit is wrong (!)."""
    if "@" in s:
        return "@", "." if "." in s[s.index("@") :] else "@"
    marks = "".join(c for c in ".-(" if c in s.replace(" ", "-"))
    d = "".join(_DIGIT.findall(s))
    return str(min(len(d), 20)), marks + "!" * (14 <= len(d) <= 19 and not luhn(d))


def rewritten(s: str, kind: int) -> list[tuple[str, bool]]:
    """A base span without the marks that its pattern needs, and whether the key stays equal (else it is similar)."""
    if KINDS[kind] == "email":
        return [(s.partition("@")[0] + "@host", False)]
    d = "".join(_DIGIT.findall(s))
    out = [(d, True), (" ".join(d[i : i + 3] for i in range(0, len(d), 3)), True), (".".join(d[i : i + 4] for i in range(0, len(d), 4)), True)]
    if KINDS[kind] == "phone":
        out += [(d[-7:], False), (f"{d[-7:-4]}-{d[-4:]}", False)]
    return out if len(d) >= 7 else []


def similar_key(key: str) -> str:
    """What a unit has in common with similar ones."""
    return key.partition("@")[0] + "@" if "@" in key else key[-7:]


def word_before(text: str, a: int) -> int:
    """The word (letters only) that ends at most two signs before a unit, as one of ``WORDS`` numbers; 0 for none."""
    m = _BEFORE.search(text, max(0, a - 24), a)
    return zlib.crc32(m[1].lower().encode()) % (WORDS - 1) + 1 if m else 0


def unit_labels(us, spans) -> np.ndarray:
    """Each unit's label by the first base span that overlaps it, 0 for none."""
    out, k = np.zeros(len(us), np.int64), 0
    for i, (a, b, _) in enumerate(us):  # both in order of their starts
        while k < len(spans) and spans[k][0] < a and spans[k][2] <= a:
            k += 1
        j = k
        while j < len(spans) and spans[j][0] < b:
            if spans[j][2] > a:
                out[i] = spans[j][1] + 1
                break
            j += 1
    return out


def skip_edges(keys) -> np.ndarray:
    """Each unit with the one before it of the same key: a chain a key, so edges never outnumber units."""
    seen: dict[str, int] = {}
    out = []
    for i, key in enumerate(keys):
        if key in seen:
            out.append((seen[key], i))
        seen[key] = i
    return np.array(out, np.int64).reshape(-1, 2)


def sure_edges(keys, y: np.ndarray) -> np.ndarray:
    """Each unit without a label with the last labelled one of its key before it, or else the first after it.

    Along a chain alone, what is known would reach no further than a unit a round.
    """
    last: dict[str, int] = {}
    out, wait = [], {}
    for i, key in enumerate(keys):
        if y[i]:
            out += [(j, i) for j in wait.pop(key, ())]
            last[key] = i
        elif key in last:
            out.append((last[key], i))
        else:
            wait.setdefault(key, []).append(i)
    return np.array(out, np.int64).reshape(-1, 2)


def near_edges(us) -> np.ndarray:
    return np.array([(i, i + 1) for i in range(len(us) - 1) if us[i + 1][0] - us[i][1] <= 40], np.int64).reshape(-1, 2)


def edges_of(us, y: np.ndarray) -> list[np.ndarray]:
    """Edges of the three kinds: near, equal, similar."""
    equal = [key for _, _, key in us]
    alike = [similar_key(key) for key in equal]
    both = [np.concatenate([skip_edges(k), sure_edges(k, y)]) for k in (equal, alike)]
    same = {tuple(e) for e in both[0].tolist()}
    return [near_edges(us), np.unique(both[0], axis=0), np.array([e for e in np.unique(both[1], axis=0).tolist() if tuple(e) not in same], np.int64).reshape(-1, 2)]


#: What a unit's label is told from.
CASE = ["digits", "marks", "word", "near", "equal", "similar"]


def fit(docs: DataFrame, max_docs: int = MAX_DOCS) -> dict:
    """Log potentials, from at most about ``max_docs`` documents drawn by a hash of their id."""
    total = docs.count()
    part = docs.filter(crc("doc_id") < int(min(1.0, max_docs / max(1, total)) * (1 << 32))).select("text", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held"))
    none = len(LABELS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c: Counter = Counter()
        for t, held in zip(pdf["text"], pdf["held"], strict=True):
            us = units(t) if isinstance(t, str) else []
            if not us:
                continue
            y = unit_labels(us, base_spans(t))
            named = {key for (_, _, key), v in zip(us, y.tolist(), strict=True) if v}
            ties = np.full((len(us), 3), none)
            for kind, e in enumerate(edges_of(us, y)):
                ties[e[:, 1], kind] = y[e[:, 0]]
            c.update(
                (bool(held), *look(t[a:b]), word_before(t, a), *ties[i].tolist(), v)
                for i, ((a, b, key), v) in enumerate(zip(us, y.tolist(), strict=True)) if v or key not in named
            )
            for (a, b, _), v in zip(us, y.tolist(), strict=True):
                for other, equal in rewritten(t[a:b], v - 1) if v else ():
                    tied = (none, v, none) if equal else (none, none, v)
                    c[(bool(held), *look(other), 0, *tied, v)] += 1
                    c[(bool(held), *look(other), 0, none, none, none, 0)] += 1
        return pd.DataFrame([(*k, v) for k, v in c.items()], columns=["held", *CASE, "label", "n"])

    # Digits are twenty, marks eight, words WORDS and labels six, so cases are far fewer than units.
    kinds = "digits string, marks string, word int, near int, equal int, similar int, label int"
    cases = mapped(part, run, f"held boolean, {kinds}, n long").groupBy("held", *CASE, "label").agg(F.sum("n").alias("n")).toPandas()
    return trained(cases)


def trained(cases: pd.DataFrame) -> dict:
    """Weights from counted cases: of digits, marks, words, and three symmetric tables of two labels each; and the least belief (``sure``)."""
    k = len(LABELS)
    parts = [{q: i for i, q in enumerate(sorted(set(cases[c])))} for c in CASE[:2]]
    sizes = [len(parts[0]), len(parts[1]), WORDS, k + 1, k + 1, k + 1]
    at = np.cumsum([0, *sizes])
    cols = [*(cases[c].map(q).to_numpy(np.int64) for c, q in zip(CASE, parts, strict=False)), *(cases[c].to_numpy(np.int64) for c in CASE[2:])]
    x = np.stack([c + a for c, a in zip(cols, at, strict=False)], axis=1) if len(cases) else np.zeros((0, 6), np.int64)
    held, label, n = cases["held"].to_numpy(bool), cases["label"].to_numpy(np.int64), cases["n"].to_numpy(float)
    # No word before, and no unit tied, say nothing.
    still = [int(at[2]), *(int(at[i] + k) for i in (3, 4, 5))]

    def log_p(w, rows):
        z = w[x[rows]].sum(axis=1)
        return z - np.logaddexp.reduce(z, axis=1, keepdims=True)

    def descend(rows, penalty):
        w, m, v = np.zeros((int(at[-1]), k)), 0.0, 0.0
        goal = np.eye(k)[label[rows]]
        for step in range(1, 301):  # Adam on the mean loss
            err = (np.exp(log_p(w, rows)) - goal) * n[rows, None]
            g = np.zeros_like(w)
            for c in range(6):
                np.add.at(g, x[rows, c], err)
            g = g / max(1.0, n[rows].sum()) + penalty * w / max(1.0, n[rows].sum())
            g[still] = 0
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        return w

    every = np.arange(len(x))
    loss = lambda w: -(log_p(w, every[held])[np.arange(held.sum()), label[held]] * n[held]).sum()
    penalty, sure = 1.0, BELIEFS[-1]
    if held.any() and (~held).any():
        tried = {p: descend(every[~held], p) for p in PENALTIES}
        penalty = min(PENALTIES, key=lambda p: loss(tried[p]))
        p = np.exp(log_p(tried[penalty], every[held]))
        best, right = p.argmax(axis=1), p.argmax(axis=1) == label[held]
        for sure in BELIEFS:
            would = (best > 0) & (p.max(axis=1) >= sure)
            if would.any() and (n[held] * right)[would].sum() >= PRECISION * n[held][would].sum():
                break
    w = descend(every, penalty) if len(x) else np.zeros((int(at[-1]), k))
    table = lambda i: (w[at[i] : at[i] + k] + w[at[i] : at[i] + k].T) / 2
    digits, marks = ({q: w[at[i] + j] for q, j in parts[i].items()} for i in (0, 1))
    return {"digits": digits, "marks": marks, "word": w[at[2] : at[3]], "near": table(3), "equal": table(4), "similar": table(5), "penalty": penalty, "sure": sure}


def propagate(unary: np.ndarray, edges: np.ndarray, tables: np.ndarray, rounds: int = ROUNDS, kind: np.ndarray | None = None) -> np.ndarray:
    """Marginals by loopy sum-product in log space, all messages of a round at once.

    ``edges`` (m, 2) with log potentials ``tables`` (m, k, k), or with their places ``kind`` (m,) in fewer tables.
    """
    n, k = unary.shape
    if not len(edges):
        p = np.exp(unary - unary.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    kind = np.arange(len(edges)) if kind is None else kind
    pot, kind = np.concatenate([tables, tables.transpose(0, 2, 1)]), np.append(kind, kind + len(tables))
    m, half = np.zeros((len(src), k)), len(edges)
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, dst, m)
        back = np.concatenate([m[half:], m[:half]])
        new = np.empty_like(m)
        for c in range(0, len(src), AT_ONCE):
            s = slice(c, c + AT_ONCE)
            x = (belief[src[s]] - back[s])[:, :, None] + pot[kind[s]]
            top = x.max(axis=1)
            new[s] = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
        m = 0.5 * m + 0.5 * (new - new.max(axis=1, keepdims=True))
    belief = unary.copy()
    np.add.at(belief, dst, m)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, spans, model: dict) -> list[tuple[int, int, int]]:
    """Spans that the field adds to the base ones."""
    us = units(text)
    if not us:
        return []
    y = unit_labels(us, spans)
    if (y > 0).all():
        return []
    looks = [look(text[a:b]) for a, b, _ in us]
    # A part that no sample had says what the others say on the average.
    mean = {k: np.mean([v for q, v in model[k].items() if "@" not in q] or [np.zeros(len(LABELS))], axis=0) for k in ("digits", "marks")}
    u = np.stack([model["digits"].get(d, mean["digits"]) + model["marks"].get(m, mean["marks"]) + model["word"][word_before(text, a)] for (d, m), (a, _, _) in zip(looks, us, strict=True)])
    fixed = y > 0
    u[fixed] = -1e9  # no number of copies talks a base span out of its label
    u[fixed, y[fixed]] = 0.0
    every = edges_of(us, y)
    kind = np.repeat([0, 1, 2], [len(e) for e in every])
    p = propagate(u, np.concatenate(every), np.stack([model["near"], model["equal"], model["similar"]]), kind=kind)
    best = p.argmax(axis=1).tolist()
    return [(us[i][0], k - 1, us[i][1]) for i, k in enumerate(best) if y[i] == 0 and k and p[i, k] >= model["sure"]]


def joined(spans) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)])


def find(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """``docs`` with ``n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Counts and the digest are of base spans; ``spans`` has the added ones too,
    as ``kind:start:end`` in code points. A null or empty text has none. Rows
    stay as they are, repeated ones included; result names replace clashing
    ones; no rows give no rows.
    """
    own = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    model = fit(docs.select("doc_id", "text")) if model is None else model
    keep = [c for c in docs.columns if c not in own]
    kept = docs.select(F.struct(*keep).alias("row"), "text")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for t in pdf["text"]:
            t = t if isinstance(t, str) else ""
            base = base_spans(t)
            n = Counter(k for _, k, _ in base)
            rows.append((n[0], n[1], n[2], n[3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added_spans(t, base, model))))
        out = pd.DataFrame(rows, columns=own)
        out.insert(0, "row", pdf["row"])
        return out

    schema = f"row {kept.schema['row'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return mapped(kept, run, schema).select(*[F.col("row")[c].alias(c) for c in keep], *own)


def redact_text(text: str | None, spans: str) -> str | None:
    """The text with each span, or run of overlapping ones, replaced by its first kind in angle brackets."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in spans.split(","):
        kind, a, b = s.split(":")
        a, b = int(a), int(b)
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced and ``n_chars``, where there, set to the new length."""
    found = find(docs, model)
    out = mapped(
        found.select(F.struct(*docs.columns).alias("row"), "text", "spans"),
        lambda pdf: pd.DataFrame({"row": pdf["row"], "new": [redact_text(t, s) for t, s in zip(pdf["text"], pdf["spans"], strict=True)]}),
        f"row {docs.select(F.struct(*docs.columns).alias('row')).schema['row'].dataType.simpleString()}, new string",
    )
    cols = {"text": F.col("new"), "n_chars": F.length("new").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[(cols[c] if c in cols else F.col("row")[c]).alias(c) for c in docs.columns])
