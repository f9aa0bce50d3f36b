"""Operators against brute force on small hand-made tables, odd rows included."""

import base64
import collections
import hashlib
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from patchwell.llm import decontaminate, language_id, language_model, ngram_join, packing, pii, quality, tokenfile, vectors, warc
from patchwell.llm.words import ALNUM, SPACED, shingle_sets, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string"
R = random.Random(5)
VOCAB = [a + b for a in "the of and un die Haus été 9x".split() for b in ("", "s", "ing", "é", "X")]


def sentence(n):
    return " ".join(R.choices(VOCAB, k=n)) + "."


@pytest.fixture(scope="module")
def texts():
    base = [sentence(40) for _ in range(6)]
    near = [t.replace(" ", "  ", 3).upper() if i % 2 else t + " tail" for i, t in enumerate(base)]
    return [*base, *near, base[0], None, "", " \n\t", "two words", "two  WORDS", sentence(6000), "word" * 30000, "\x1c a b", "+1 (555) 010-9999 x a@b.co"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, R.choice(["en", "fr", None]), "s", 1, 0.5, "r") for i, t in enumerate(texts)]
    rows += [rows[0], (None, "id is missing here for once", "en", None, None, None, None), (2**60 + 1, texts[1], "en", "s", 1, 0.1, "r")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_word_hashes(texts):
    for table, pattern in ((SPACED, rb"[^\x20\x09-\x0D]+"), (ALNUM, rb"[0-9a-z\x80-\xff]+")):
        h, first = word_hashes(texts, table)
        words = [re.findall(pattern, (t or "").encode().lower()) for t in texts]
        assert np.diff(first).tolist() == [len(w) for w in words]
        flat = [w for x in words for w in x]
        assert len(set(flat)) == len(set(h.tolist())) == len(set(zip(flat, h.tolist(), strict=True)))


def brute_sets(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, brute_sets(t)) for i, t in rows]
    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def test_ngram_join(spark, docs):
    got = ngram_join.near_duplicates(docs).collect()
    rows = docs.filter("doc_id is not null").select("doc_id", "text").distinct().collect()
    want = brute_components([(r[0], r[1]) for r in rows])
    assert len(got) == docs.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} - {None} == {i for i, (_, c) in want.items() if i == c}


def test_one_of_each_keeps_one_row_a_component(spark):
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcde")
    rows = [(None, a), (None, b), (None, b + " tail"), (None, None), (7, c), (7, d), (7, d), (3, e), (None, e + " tail"), (None, e), (8, ""), (8, "")]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    fixed = [(None, a), (None, None), (7, c), (7, d), (3, e), (8, "")]
    assert len(got) == len(fixed) + 1 and set(fixed) <= {tuple(r) for r in got}
    assert {r["text"] for r in got} & {b, b + " tail"}


def chains():
    rng, rows = random.Random(9), []
    for g in range(6):
        words = [f"g{g}w{rng.randrange(40)}" for _ in range(70)]
        for _ in range(14):
            for _ in range(rng.choice((0, 1, 2, 3))):
                words[rng.randrange(len(words))] = f"e{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("limits", [{}, {"CELL": 400, "WHOLE": 3}, {"HOT": 1, "CELL": 900}, {"FEW": 0, "WHOLE": 1}])
def test_ngram_join_with_chains_of_near_copies(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(ngram_join, k, v)
    rows = chains()
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_cells_hold_every_pair_of_different_components_once(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 60)
    rng = random.Random(3)
    rows = [(g, 100 * g + i, rng.randrange(1, 20), min(i, 100) if rng.random() < 0.4 else 0) for g in range(5) for i in range(30)]
    cells = ngram_join.open_cells(spark.createDataFrame(rows, "grp long, cls long, n int, comp long")).collect()
    held = collections.defaultdict(dict)
    for r in cells:
        held[r["grp"], r["cell"]["i"], r["cell"]["j"]][r["cls"]] = r["cell"]["side"]
    met = collections.Counter((min(a, b), max(a, b)) for c in held.values() for a, x in c.items() for b, y in c.items() if a < b and (x < 0 or y < 0 or x != y))
    want = {(a, b) for g, a, _, p in rows for h, b, _, q in rows if g == h and a < b and p != q}
    assert want <= set(met) and all(met[p] == 1 for p in want)


def test_a_cell_whose_pairs_are_all_ruled_out():
    """Pairs that the tree leaves over may all be on one side, or linked by the time they come."""
    one = np.arange(40)
    cell = lambda: ngram_join.Cell([one, one, one], np.full(3, 40), np.arange(3))
    assert cell().link(np.zeros(3, int)) == []
    linked = cell()
    linked.check(0, np.array([1]))
    assert {frozenset(p) for p in linked.link(np.array([0, 1, 0]))} == {frozenset((0, 1)), frozenset((1, 2))}


def test_packed_sets_come_back():
    for n in (1, 2, 255, 4000, 9000):
        s = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64) * 2)
        assert (ngram_join.unpack(ngram_join.pack(s), len(s)) == (s >> np.uint64(24)).astype(np.int64)).all()
        for width in (ngram_join.POINT, ngram_join.WIDE)[: 1 + (n >= ngram_join.WIDE)]:
            assert (ngram_join.points([ngram_join.point(s)], width)[0] == np.bincount((s >> np.uint64(24)).astype(np.int64) % width, minlength=width)).all()


def test_ngram_join_of_long_texts(spark):
    rng, rows = random.Random(2), []
    for g in range(3):
        words = [f"g{g}w{rng.randrange(10**6)}" for _ in range(6000)]
        for share in (0, 0, 0.01, 0.02, 0.05, 0.2):
            again = [w if rng.random() > share else f"e{rng.random()}" for w in words]
            rows.append((len(rows), " ".join(again[: len(words) - rng.randrange(3)])))
    # A passage that all share ties their groups together, so the bounds are tried.
    rows = [(i, t + " shared" * 3 + " ".join(f"p{k}" for k in range(4000))) for i, t in rows]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


@pytest.mark.parametrize("seed", range(30))
def test_rtree_leaves_out_no_pair(seed):
    rng = np.random.default_rng(seed)
    base = rng.poisson(rng.choice((0.3, 2)), (rng.integers(1, 6), 128))
    vec = np.maximum(0, base[rng.integers(0, len(base), 60)] + rng.integers(-1, 2, (60, 128)) * (rng.random((60, 128)) < 0.1)).astype(np.int32)
    n = np.maximum(1, vec.sum(axis=1)).astype(np.int64)
    comp = rng.integers(0, rng.choice((2, 60)), 60)
    runs = list(ngram_join.RTree(vec, n, comp).pairs())
    got = {(min(p), max(p)) for a, b in runs for p in zip(a.tolist(), b.tolist(), strict=True)}
    for i in range(60):
        for j in range(i):
            if comp[i] != comp[j] and 7 * np.minimum(vec[i], vec[j]).sum() >= 3 * (n[i] + n[j]) and 4 * n[i] >= 3 * n[j] and 4 * n[j] >= 3 * n[i]:
                assert (j, i) in got


def brute_hits(text, items):
    toks = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    w, hit, found = toks(text), set(), set()
    for name, t in items:
        y = toks(t)
        n = min(10, len(y))
        wins = {tuple(y[k : k + n]) for k in range(len(y) - n + 1)} if n else set()
        for p in range(len(w) - n + 1 if n else 0):
            if tuple(w[p : p + n]) in wins:
                hit.update(range(p, p + n))
                found.add(name)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_words", [10, 10**6])
def test_decontaminate(spark, docs, texts, block_words):
    items = [(1, " ".join(texts[0].split()[5:30])), (20, texts[3]), (3, "two words"), (4, None), (5, "..."), (6, texts[0][:30])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs.withColumn("n_hit", F.lit("clash")), bench, words=block_words).collect()
    for r in got:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute_hits(r["text"], [(str(i), t) for i, t in items])
        for m in r["matches"]:
            assert m["n_words"] >= 2
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.clean(docs.limit(0), bench).columns == docs.columns


@pytest.mark.parametrize("seed", range(20))
def test_suffix_arrays(seed):
    rng = random.Random(seed)
    vocab = "a b c D e1".split()[: rng.randint(1, 5)]
    items = [(str(i), " ".join(rng.choices(vocab, k=rng.choice((1, 3, 12, 30))))) for i in range(4)]
    docs = [" ".join(rng.choices([*vocab, "zz"], k=rng.randint(0, 60))) + " " + rng.choice(items)[1] for _ in range(5)]
    h, first = word_hashes(docs, ALNUM)
    block = decontaminate.TestBlock([i for i, _ in items], [t for _, t in items], 10)
    mark = np.zeros(len(h) + 1, int)
    for d, at, _, _, n in zip(*decontaminate.matches(block, h, first), strict=True):
        mark[first[d] + at] += 1
        mark[first[d] + at + n] -= 1
    c = np.append(0, np.cumsum(np.cumsum(mark[:-1]) > 0))
    assert (c[first[1:]] - c[first[:-1]]).tolist() == [brute_hits(t, items)[1] for t in docs]


def test_packing(spark, docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    got = packing.pack(docs.dropDuplicates(["doc_id"]), path).toPandas()
    for i, g in got.dropna(subset=["doc_id"]).groupby("doc_id"):
        g = g.sort_values("start")
        ids = np.array([*tok.encode((texts[1] if i > 2**59 else texts[int(i)]) or "", add_special_tokens=False).ids, 1], np.uint32)
        assert (g["doc_tokens"] == len(ids)).all() and g["length"].sum() == len(ids)
        assert g["start"].tolist() == np.append(0, np.cumsum(g["length"])[:-1]).tolist()
        assert g["ids_crc32"].tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(g["start"], g["length"], strict=True)]
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == np.append(0, np.cumsum(g["length"])[:-1]).tolist() and g["length"].sum() <= 2048
    assert packing.pack(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("seed", range(25))
def test_packing_is_cheapest(seed):
    rng = random.Random(seed)
    size, total = rng.choice((16, 32, 64)), rng.randint(1, 300)
    stops = np.array(sorted(rng.sample(range(1, total + 1), min(total, 30))))
    ends = np.array(sorted(set(rng.choices(range(1, total + 1), k=5))))
    pos, pen = packing.cut_points(stops, ends, total, size)
    pad = lambda n: 0 if n & (n - 1) == 0 else size - n
    best = [0] + [10**9] * (len(pos) - 1)
    for j in range(1, len(pos)):
        best[j] = min((best[i] + pad(int(pos[j] - pos[i])) for i in range(j) if pos[j] - pos[i] <= size), default=10**9) + int(pen[j]) + packing.EACH
    cuts, cost = packing.best_cuts(pos, pen, size), dict(zip(pos.tolist(), pen.tolist(), strict=True))
    assert sum(pad(int(b - a)) + cost[int(b)] + packing.EACH for a, b in zip(cuts, cuts[1:], strict=False)) == best[-1]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_are_the_librarys(name, texts):
    from patchwell.llm.tokens import Encoder

    e, rng = Encoder(public_tokenizers.path(name)), random.Random(1)
    bits = ["a", "B", "é", "ß", "1", "½", ".", ",", "!", " ", "  ", "\n", "\n\n", "\t", "'s", "|", "日本", "İ", "Σ", "é", "\xa0", "\x1c", " ", "<|endoftext|>", "😀", "​", "\x00", "\x85"]
    odd = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(3000)] + [t for t in texts if t]
    assert [x.tolist() for x in e.encode(odd)] == [x.ids for x in e.tok.encode_batch(odd, add_special_tokens=False)]


@pytest.mark.parametrize("factor, digest", [(1, "e1e194192050a18fd3f81e6415ef5f2c749e0e2510fbb66410efb9f100dff332"), (70001, "d071c7127a9497b5c45434953f0551dc06ae37f20e59b2c3812f45ab769f705d")])
def test_token_segments_keep_their_bytes(factor, digest):
    ids = (np.arange(9000) ** 2 % 977 // 3 * factor).astype(np.uint32)
    assert hashlib.sha256(tokenfile.write_segment([1], ids, np.array([9000]))).hexdigest() == digest


def test_token_shares_are_found_by_one_division_a_symbol():
    """Shares are ordered by where they begin, so a search compares them as they are."""
    rng = np.random.default_rng(3)
    m, n = tokenfile.Lanes(5, 8, 16), 5
    m.counts[:] = rng.integers(0, 50, n << 6)
    m.places[:] = rng.integers(0, 9, m.places.shape)
    m.renew()
    for shares, steps in ((m.shares.reshape(n * 16, 4), 2), (m.place_shares.reshape(n, 256), 8)):
        begin, size = shares >> 16, shares & 0xFFFF
        assert (np.diff(shares.astype(np.int64)) > 0).all() and (begin[:, 0] == 0).all()
        assert (begin[:, 1:] == np.cumsum(size, axis=1)[:, :-1]).all() and (size.sum(axis=1) == 4096).all()
        d = tokenfile.Decoder([bytes(8)] * len(shares))
        d.rng[:] = 4096 * 77 + 5
        d.code[:] = rng.integers(0, 4096 * 77, len(shares))
        want = [np.flatnonzero(b * 77 <= c)[-1] for b, c in zip(begin.astype(int), d.code.tolist(), strict=True)]
        assert d.symbol(np.arange(len(shares)), shares.ravel(), np.arange(len(shares)) * shares.shape[1], steps).tolist() == want


def test_blocks_advance_in_groups_of_like_size():
    """A step takes its time for few blocks too, so none are left over to go alone."""
    for n in (0, 1, tokenfile.LANES, tokenfile.LANES + 1, 3 * tokenfile.LANES - 5):
        groups = tokenfile._groups(n)
        sizes = [b - a for a, b in groups]
        assert sum(sizes) == n and [a for a, _ in groups[1:]] == [b for _, b in groups[:-1]]
        assert n == 0 or max(sizes) - min(sizes) <= 1 and max(sizes) <= tokenfile.LANES


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_in_use_are_learned_once(name):
    from patchwell.llm.tokens import Encoder

    e, learned = Encoder(public_tokenizers.path(name), 200), []
    learn = e.learn
    e.learn = lambda w: learned.append(w.strip()) or learn(w)
    letters = [chr(97 + k) for k in range(26)]
    for i in range(12):
        rare = ["rare" + letters[i] + letters[j] + letters[k] for j in range(6) for k in range(26)]
        e.encode(["so often here " + " ".join(rare)])
    assert learned.count("often") == learned.count("here") == 1
    assert len(e.words) + len(e.spaced) + len(e.words.older) + len(e.spaced.older) <= 200 + 2 * 160 and len(e.pieces) < 10


def test_token_file(spark, docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(path), 0
    tok.encode_special_tokens = True
    got = tokenfile.round_trip(docs, path).orderBy("start").collect()
    assert len(got) == docs.count() and got[0]["doc_id"] is None
    for r in got:
        i = r["doc_id"]
        t = "id is missing here for once" if i is None else texts[1] if i > 2**59 else texts[i]
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], np.uint32)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokenfile.round_trip(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_segments(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 7000))
    ids = (np.minimum(rng.zipf(1.3, n), 60000) if seed % 2 else rng.integers(0, 60000, n)).astype(np.uint32) * (70000 if seed == 3 else 1)
    sizes = np.bincount(rng.integers(0, 4, n), minlength=4)
    data = tokenfile.write_segment([1, None, -5, 2**62], ids, sizes)
    names, back, got = tokenfile.read_segment(data)
    assert names == [1, None, -5, 2**62] and (back == ids).all() and (got == sizes).all()
    if n:
        with pytest.raises(ValueError):
            tokenfile.read_segment(data[:-3] + bytes([data[-3] ^ 1]) + data[-2:])


def test_language_id(spark):
    rng, rows = random.Random(2), []
    sound = {"en": ["th", "ing", "ea", "st"], "de": ["sch", "ung", "ei", "ß"], "fr": ["eau", "é", "oi", "ç"]}
    for i in range(240):
        lang = rng.choice(list(sound))
        rows.append((i, " ".join("".join(rng.choices(sound[lang], k=3)) for _ in range(30)), lang))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(table.filter("doc_id % 4 != 2"))
    got = language_id.identify(table.filter("doc_id % 4 = 2").withColumn("score", F.lit(1)), model).collect()
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 and not r["rejected"] for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ²! _"), (4, "qqqq zzz xxxxx jjjj kkkk " * 5)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in language_id.identify(odd, model).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and out[4]["rejected"]
    assert language_id.fit(table.withColumn("lang", F.lit(None).cast("string"))) is None
    assert language_id.accepted(odd, None).count() == 0
    for c in ("gram", "context"):  # every context's shares and backoff weight sum to one
        assert (np.diff(model.table[c, 3][0].astype(object)) > 0).all()


def test_language_id_learns_from_whole_texts(spark):
    rows = [(i, "common words " * 2000 + ("zyxel quokka " if lang == "en" else "fjord brygge ") * 300, lang) for i, lang in enumerate(["en", "no"] * 100)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(table)
    end = spark.createDataFrame([(1, "zyxel quokka"), (2, "fjord brygge")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.identify(end, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2)] == ["en", "no"] and all(got[i]["score"] > 0.99 for i in (1, 2))
    # Limits are set on whole texts too: they are what prediction measures on the same documents.
    h = language_id.identify(table, model).groupBy("lang").agg(F.avg("cross_entropy").alias("h")).collect()
    assert all(model.limit[r["lang"]][0] == pytest.approx(r["h"], abs=0.01) for r in h)


def test_rejection_follows_the_spread_for_a_length():
    rng = np.random.default_rng(5)
    n = rng.integers(2, 3000, 2000).astype(float)
    h = 1.5 + rng.normal(size=2000) * np.sqrt(0.03**2 + 1.2 / n)
    h[:10] += 3  # a few are of no language
    mean, a, b, z = language_id.calibrated(h, n)
    assert abs(mean - 1.5) < 0.05 and 0.5 < b < 2 and a < 0.05**2 and 5 < z < 12
    limit = mean + z * np.sqrt(a + b / n)
    assert (h[10:] > limit[10:]).sum() == 0 and (h[:10] > limit[:10])[n[:10] > 30].all()


def test_pii_base_spans_are_the_patterns():
    email, ip, card, phone = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))
    rng = random.Random(3)
    digits = lambda s: re.sub("[^0-9]", "", s)
    for _ in range(6000):
        t = "".join(rng.choices(["@", "a", ".", "-", "+", "1", "2", "25", "4111111111111111", " ", "(", ")", "é", "x.y", "@b.c", "\n", "%", "_", "0"], k=rng.randint(0, 25)))
        want = [(m.start(), 0, m.end()) for m in email.finditer(t)] + [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [(m.start(), 2, m.end()) for m in card.finditer(t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        want += [(m.start(), 3, m.end()) for m in phone.finditer(t) if 10 <= len(digits(m[0])) <= 15]
        assert pii.base_spans(t) == sorted(want)


def test_pii_field(spark, docs):
    phones = [f"call +1 (555) 010-{1000 + i} today, order 555010{i}" for i in range(60)]
    train = spark.createDataFrame([(i, t) for i, t in enumerate(phones)], "doc_id long, text string")
    model = pii.fit(train)
    text = "call +1 (555) 010-4321 now. Again: 1 (555) 010-4321, other 99 123456789"
    base = pii.base_spans(text)
    more = pii.added_spans(text, base, model)
    assert [(text[a:b], pii.KINDS[k]) for a, k, b in more] == [("1 (555) 010-4321", "phone")]
    assert pii.redact_text(text, pii.joined(base + more)) == "call <PHONE> now. Again: <PHONE>, other 99 123456789"
    got = pii.find(docs.withColumn("spans", F.lit(1)), model)
    assert got.count() == docs.count() and got.filter("text is null and base_sha256 != sha2('', 256)").count() == 0
    out = pii.redact(docs, model)
    assert out.columns == docs.columns and out.filter("text like '%@%'").count() == 0
    assert pii.redact(docs.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [1, 40])
def test_pii_field_spans_a_long_document(spark, copies):
    phones = [f"call +1 (555) 010-{1000 + i} today, order 555010{i}, again +1 (555) 010-{1000 + i} now" for i in range(60)]
    model = pii.fit(spark.createDataFrame(list(enumerate(phones)), "doc_id long, text string"))
    rest = "".join(f"{i} of {20000000 + i}\n" + "-" * 41 for i in range(25_000 if copies == 1 else 100))
    text = "call +1 (555) 010-4321 now." + (rest + "Again: 15550104321 is it.\n") * copies
    more = pii.added_spans(text, pii.base_spans(text), model)
    assert [text[a:b] for a, _, b in more] == ["15550104321"] * copies


@pytest.fixture(scope="module")
def table_model(spark, sf):
    return pii.fit(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


def test_pii_field_of_the_table_adds_other_writings(table_model):
    """Trained on the documents: a number without its marks and its last seven digits are added, and so is an address of the same name; what is not tied stays, and without edges nothing is added."""
    bare = table_model | {k: np.zeros_like(table_model[k]) for k in ("equal", "similar")}
    for text, want in (
        ("Call +1 (555) 010-4321 now. Then " + "so on " * 20 + "Again: 15550104321 is it", ["15550104321"]),
        ("Call +1 (555) 010-4321 now, or later just 010-4321 and 010-9999", ["010-4321"]),
        ("card 4111 1111 1111 1111 or 4111.1111.1111.1111, not 4222.1111.1111.1113", ["4111.1111.1111.1111"]),
        ("mail john.doe@example.org or john.doe@localhost, not jane.roe@localhost", ["john.doe@localhost"]),
        ("in 1234567 of 15550104321 cases, 20 000 000", []),
    ):
        base = pii.base_spans(text)
        assert [text[a:b] for a, _, b in pii.added_spans(text, base, table_model)] == want
        assert pii.added_spans(text, base, bare) == []


def test_pii_units_of_any_length():
    long = "a" * 5000 + "@" + "b" * 5000
    text = f"{long} and x {long}. 12345678@c or 12345678"
    assert [text[a:b] for a, b, _ in pii.units(text)] == [long, long + ".", "12345678@c", "12345678"]
    assert pii.units(text)[0][2] == pii.units(text)[1][2]
    began = time.process_time()
    pii.units("a" * 300_000 + "1 " * 100_000)
    assert time.process_time() - began < 5


def test_messages_match_enumeration():
    rng = np.random.default_rng(0)
    u, edges = rng.normal(size=(4, 3)), np.array([(0, 1), (1, 2), (1, 3)])  # a tree, where message passing is exact
    pot = rng.normal(size=(3, 3, 3))
    want = np.zeros((4, 3))
    for y in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(u[i, y[i]] for i in range(4)) + sum(pot[k][y[i], y[j]] for k, (i, j) in enumerate(edges)))
        for i in range(4):
            want[i, y[i]] += w
    assert np.allclose(pii.propagate(u, edges, pot, 60), want / want.sum(axis=1, keepdims=True), atol=1e-6)


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[100:300] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1100, [0.0] * 8), (1200, [float("nan")] * 8), (1300, [1.0, None] + [1.0] * 6), (1400, [1.0, 2.0]), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0)).repartition(3)
    got = vectors.search(table).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(700), d))[:10]
        g = g.sort_values("rank")
        hit += len(set(best) & set(g["vec_id"]))
        assert np.allclose(g["score"], d[g["vec_id"]], rtol=0, atol=1e-12) and g["rank"].tolist() == list(range(1, 11))
    assert set(got["query_id"]) == set(range(0, 700, 100)) and hit >= 0.9 * 70
    assert got[got["query_id"] == 200].sort_values("rank")["vec_id"].tolist() == list(range(100, 110))
    assert vectors.search(table.limit(0)).count() == 0
    assert vectors.search(table.filter("vec_id < 4")).count() == 3


@pytest.mark.parametrize("probe_all", [True, False])
def test_nearest_in_a_dense_cluster(spark, monkeypatch, probe_all):
    monkeypatch.setattr(vectors, "SAMPLE", 300)  # the cluster is thin in the sample, as in a large table
    monkeypatch.setattr(vectors, "CODES", 16)
    if probe_all:
        monkeypatch.setattr(vectors.Quantiser, "settle", lambda self, *_: None)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 8))
    x[rng.permutation(4000)[:600]] = x[0] + rng.normal(size=(600, 8)) * 1e-5
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = vectors.search(table, every=40).toPandas()
    hit = n = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(4000), d))[:10]
        assert len(g) == 10
        hit, n = hit + len(set(best) & set(g["vec_id"])), n + 10
    assert n == 1000 and hit >= (1.0 if probe_all else 0.975) * n


class BruteKatz:
    """The same model from plain counts: words, pairs and triples, each text framed by two beginnings and an end."""

    def __init__(self, texts, d2, d3, words):
        seqs = [brute_tokens(t) for t in texts]
        self.c1 = collections.Counter(w for s in seqs for w in s[2:])
        self.c2 = collections.Counter(p for s in seqs for p in zip(s[1:], s[2:], strict=False))
        self.c3 = collections.Counter(p for s in seqs for p in zip(s, s[1:], s[2:], strict=False))
        self.h2, self.h3 = collections.Counter(), collections.Counter()
        for (b, _), c in self.c2.items():
            self.h2[b] += c
        for (a, b, _), c in self.c3.items():
            self.h3[a, b] += c
        self.d2, self.d3, self.w = d2, d3, words
        self.after2, self.after3 = collections.defaultdict(list), collections.defaultdict(list)
        for b, c in self.c2:
            self.after2[b].append(c)
        for a, b, c in self.c3:
            self.after3[a, b].append(c)

    def less(self, c, d):
        return c - language_model.ABOVE if c > language_model.K else c * d[c]

    def p1(self, c):
        n = self.c1[c]
        return (n if n > language_model.K else n * self.w.d1[n]) * self.w.scale if n else self.w.unseen

    def p2(self, b, c):
        if self.c2[b, c]:
            return self.less(self.c2[b, c], self.d2) / self.h2[b]
        after = self.after2[b]
        return (1 - sum(self.p2(b, x) for x in after)) / (1 - sum(self.p1(x) for x in after)) * self.p1(c)

    def p3(self, a, b, c):
        if self.c3[a, b, c]:
            return self.less(self.c3[a, b, c], self.d3) / self.h3[a, b]
        after = self.after3[a, b]
        return (1 - sum(self.p3(a, b, x) for x in after)) / (1 - sum(self.p2(b, x) for x in after)) * self.p2(b, c)


def brute_tokens(t):
    return [b"<", b"<", *re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b""]


@pytest.mark.parametrize("limits", [{}, {"top": 8}, {"top": 3}, {"top": 12, "hot": 60, "shard": 40}, {"hot": 20, "shard": 40}])
def test_katz_is_the_recursion(spark, limits):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(30)], [1 / (k + 1) for k in range(30)], k=rng.randrange(25)))) for i in range(60)]
    rows += [(60, rows[0][1]), (61, rows[1][1].upper()), (62, None), (63, ""), (1, rows[1][1]), (None, "w1 new words"), (64, "only new ones")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x")).repartition(4)
    learns = F.col("doc_id") % 3 != 1
    got, model = language_model.score(table, learns, **limits)
    train = [t for i, t in rows if i is not None and i % 3 != 1]
    brute = BruteKatz(train, model.d2, model.d3, model.words)
    n, v = sum(brute.c1.values()), len(brute.c1)
    assert (model.words.n, model.words.v) == (n, v)
    freq = lambda c, r: sum(x == r for x in c.values())
    assert model.d3 == language_model.discounts({r: freq(brute.c3, r) for r in range(1, 7)}) and model.d2 == language_model.discounts({r: freq(brute.c2, r) for r in range(1, 7)})
    assert not limits.get("hot") or (model.words.split > 1).any()
    got = got.collect()
    text = collections.defaultdict(list)
    for i, t in rows:
        text[i].append(t)
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    for r in got:
        s = brute_tokens(text[r["doc_id"]][0])
        assert r["n_tokens"] == len(s) - 2 and r["n_known"] == sum(brute.c1[w] > 0 for w in s[2:])
        assert r["base_score"] == pytest.approx(sum(np.log10((brute.c1[w] + 0.5) / (n + 0.5 * (v + 1))) for w in s[2:]))
        assert r["score"] == pytest.approx(sum(np.log10(brute.p3(a, b, c)) for a, b, c in zip(s, s[1:], s[2:], strict=False)))
    # Exactly normalised: all words and the one never seen add up to one after any context.
    for a, b in [(b"<", b"<"), (b"<", b"w1"), (b"w0", b"w1"), (b"w1", b"new"), (b"w0", b"w29")]:
        assert sum(brute.p3(a, b, c) for c in brute.c1) + brute.p3(a, b, b"never") == pytest.approx(1.0)


def test_katz_scores_take_a_shard_at_a_time(spark, monkeypatch):
    """Rows of shards are many MB: while they are scored, an Arrow batch holds one, and other steps keep their batches."""
    key, seen, store = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, language_model.store

    def watched(df, name):
        seen[name] = spark.conf.get(key)
        return store(df, name)

    monkeypatch.setattr(language_model, "store", watched)
    table = spark.createDataFrame([(1, "a b c"), (2, "a b d")], "doc_id long, text string")
    assert language_model.score(table, F.lit(True))[0].count() == 2
    assert seen["scores"] == "1" != seen["ngrams"] and spark.conf.get(key) != "1"


def test_katz_tasks_hold_a_run_once():
    batches = [pd.DataFrame({"key": range(i * 50, i * 50 + 50), "learns": True, "text": [f"w{i} w{j} " * 200 for j in range(50)]}) for i in range(20)]
    language_model.tokens(["a"])  # tables of the hash, which are kept
    tracemalloc.start()
    runs = language_model.runs(batches, 10**9)
    tok, first, _, _ = next(runs)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(first) == 1001 and held < 1.5 * tok.nbytes


def test_katz_words_are_few_bytes_each(spark):
    table = spark.range(1000).select(F.xxhash64("id").alias("key"), (F.col("id") + 1).alias("c"))
    words = language_model.Words(table, 1000, 900)
    assert sum(x.nbytes for x in vars(words).values() if isinstance(x, np.ndarray)) <= 20 * 1001
    assert (words.split > 1).any() and words.count[: words.begin].tolist() == list(range(1000, 0, -1))
    assert words.numbers(words.key_of()[[5, 999, 1000]]).tolist() == [5, 999, words.begin] and words.begin == 1000


def test_katz_texts_of_a_shard_take_a_byte_or_two(spark):
    """Texts go with every piece and stay with every shard: as places in their run, whose keys are sent once."""
    table = spark.createDataFrame([(i, f"the w{i % 7} end") for i in range(7)] * 3 + [(90 + i, f"the same x{i}") for i in range(3000)], "doc_id long, text string").repartition(3)
    model = language_model.Model(table, F.lit(True), shard=4000)
    kept = model.shards.select(F.sum(F.length("places")).alias("places"), F.sum(F.size("runs")).alias("runs")).head()
    assert kept["runs"] == 3 and kept["places"] < 4 * 3000
    got = language_model.score(table, F.lit(True), shard=4000)[0].select("doc_id", "n_tokens", "n_known").collect()
    assert len(got) == 3021 and {(r["n_tokens"], r["n_known"]) for r in got} == {(4, 4)}


def test_katz_of_odd_tables(spark, docs):
    got, model = language_model.score(docs, F.col("doc_id") % 2 == 0)
    assert got.count() == docs.count() and got.filter("score > 0 or score is null or n_tokens < 1").count() == 0
    got, model = language_model.score(docs, F.lit(False))
    assert got.count() == docs.count() and model.words.n == 0
    assert all(r["score"] == pytest.approx(r["n_tokens"] * np.log10(model.words.unseen)) for r in got.collect())
    assert language_model.score(docs.limit(0), F.lit(True))[0].count() == 0


def test_warc(spark):
    pages = [(i, f"http://a/{i} b", h) for i, h in enumerate(["<p>é</p>", "x", "x", None, "", "WARC/1.1\r\n\r\n\nfiledesc://", "x", "y" * 100000])]
    pages += [(3, None, "x"), (None, "u", "x"), (None, "u", "alone"), pages[0]]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(0)).repartition(3)
    got = warc.round_trip(df).collect()
    most = collections.defaultdict(lambda: -1)
    for i, _, h in pages:
        most[h or ""] = max(most[h or ""], -1 if i is None else i)
    want = []
    for i, _, h in pages:
        b, keep = (h or "").encode(), most[h or ""]
        again = keep != (-1 if i is None else i)
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", keep if again else None))
    key = lambda r: str(r)
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=key) == sorted(want, key=key)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_arc_versions():
    for version in (1, 2):
        data = warc.version_block(version, "f") + b"".join(warc.arc_record(version, "http://x y", k, b"a\nb", "f") + b"\n" for k in (1, None))
        rows = warc.parse_arc(data)
        assert [r["URL"] for r in rows] == ["http://x%20y"] * 2 and warc.http_parts(rows[0]["block"])[2] == b"a\nb"
        with pytest.raises(ValueError):
            warc.parse_arc(data[:-5])


def test_quality(spark, docs):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(VOCAB, k=50)) if i % 2 else "### " + " ".join(w + "$$$" for w in rng.choices(VOCAB, k=50))) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = table.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")).filter("doc_id % 5 != 0")
    measured = quality.measure(table)
    model = quality.fit(measured, labels)
    got = quality.score(measured, model).filter("doc_id % 5 = 0").collect()
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.3) == (r["doc_id"] % 2 == 1) for r in got)
    m = quality.measure(docs)
    assert quality.fit(m, labels.limit(0)) is None and quality.score(m, None).count() == docs.count()
    assert quality.score(m, model).filter("score is null or score < 0 or score > 1").count() == 0


def test_isotonic():
    _, value = quality.isotonic(np.arange(6.0), np.array([0, 2, 1, 0, 3, 4.0]), np.array([1, 2, 2, 1, 4, 4.0]))
    assert (np.diff(value) > 0).all() and value[0] == 0


def test_shingles_of_short_texts():
    a, b, c, d = shingle_sets(["one two", "ONE  two", "one", None])
    assert a.tolist() == b.tolist() and len(a) == len(c) == 1 and a[0] != c[0] and not len(d)


def test_quality_weights_are_those_of_the_whole_table(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(VOCAB, k=rng.randrange(5, 60))) + ("!!! 111 " * rng.randrange(4) if i % 2 else "")) for i in range(200)]
    measured = quality.measure(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    labels = spark.createDataFrame([(i, int(rng.random() < (0.9 if i % 2 else 0.2))) for i in range(160)], "doc_id long, quality int")
    model = quality.fit(measured, labels)
    x = {r["doc_id"]: np.frombuffer(r["x"]) for r in measured.collect()}
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    table = np.stack([x[i] for i in y])
    assert np.allclose(model.features.mean, table.mean(axis=0)) and np.allclose(model.features.scale, table.std(axis=0) + 1e-3, atol=1e-6)
    z, t = model.features(table), np.array([y[i] for i in y], float)
    # The weights solve the ridge equations of all rows for one of the penalties.
    d = z.shape[1]
    solved = [np.linalg.solve(z.T @ z + p * len(z) * np.eye(d) / d, z.T @ t) for p in quality.PENALTIES]
    assert min(np.abs(model.weights - w).max() for w in solved) < 1e-6
    # Features approximate the Gaussian kernel: of equal points 1, and falling with the distance.
    k = z[:, :-1] @ z[:, :-1].T
    near = ((table[:, None] - table[None]) / model.features.scale) ** 2
    assert np.abs(np.diag(k) - 1).max() < 0.3 and np.corrcoef(k.ravel(), -near.sum(axis=2).ravel())[0, 1] > 0.5
    assert (np.diff(model.value) > 0).all() and (np.diff(model.ends) > 0).all()


def test_isotonic_is_the_closest_rising_fit():
    rng = np.random.default_rng(3)
    for _ in range(40):
        w = rng.integers(1, 5, 12).astype(float)
        g = np.minimum(w, rng.integers(0, 5, 12))
        s = np.sort(rng.random(12))
        ends, value = quality.isotonic(s, g, w)
        got = value[np.searchsorted(ends, s)]
        # The largest over what begins here or before of the smallest mean over what ends here or after.
        mean = lambda i, j: g[i : j + 1].sum() / w[i : j + 1].sum()
        assert np.allclose(got, [max(min(mean(i, j) for j in range(k, 12)) for i in range(k + 1)) for k in range(12)])


def test_language_models_are_interpolated_kneser_ney():
    words = collections.Counter({"haus": 3, "maus": 2, "hauses": 1, "aus": 4, "ums": 1, "häusle": 2})
    other = collections.Counter({"house": 3, "mouse": 1, "us": 2, "sum": 5})
    order = language_id.ORDER
    model = language_id.Model(["a", "b"], {"a": language_id.fit_language(words), "b": language_id.fit_language(other)})

    def grams(bag, n):
        out = collections.Counter()
        for w, c in bag.items():
            s = "^" * (n - 1) + w + "$"
            for i in range(len(w) + 1):
                out[s[i : i + n].replace("^", "$")] += c
        return out

    def brute(bag):
        count = {order: grams(bag, order)}
        for n in range(order - 1, 0, -1):
            count[n] = collections.Counter(g[1:] for g in grams(bag, n + 1))
        level = {}
        for n, c in count.items():
            n1, n2 = (sum(v == k for v in c.values()) for k in (1, 2))
            d = n1 / (n1 + 2 * n2) if n1 and n1 + 2 * n2 else 0.5
            total, kinds = collections.Counter(), collections.Counter()
            for g, v in c.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            level[n] = (c, d, total, kinds)

        def p(g, n):
            if n == 0:
                return 1 / model.alphabet
            c, d, total, kinds = level[n]
            g = g[-n:]
            h = g[:-1]
            lower = p(g, n - 1)
            return max(c[g] - d, 0) / total[h] + d * kinds[h] / total[h] * lower if total[h] else lower

        return p

    seen = ["haus", "sum", "xyz", "a", "mausoleum"]
    got = model.score(seen)
    for i, bag in enumerate((words, other)):
        p = brute(bag)
        for w, row in zip(seen, got, strict=True):
            s = "$" * (order - 1) + w + "$"
            assert row[i] == pytest.approx(sum(np.log(p(s[k : k + order], order)) for k in range(len(w) + 1)), rel=1e-5)
