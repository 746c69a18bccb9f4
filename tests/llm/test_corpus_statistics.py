"""Divergence audit, importance resampling and Order MinHash against brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from matchlake.llm import divergence, order_minhash, resample

WORDS = "the of and to in is river stone cloud lamp green seven apple house Träume für niño señor été déjà 漢字".split()


def prose(seed, n, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) + ("" if r.random() < 0.6 else str(r.randrange(9))) for _ in range(n))


SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n int, id int, next string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    made = [(i, prose(i, r.randrange(1, 90), WORDS[: 6 + i % 14]), r.choice(["en", "de"]), f"s{min(r.randrange(9), r.randrange(9))}") for i in range(300)]
    made += [(400 + i, t, lang, s) for i, (t, lang, s) in enumerate([(None, "en", "void"), ("", "en", "void"), ("12 .. 34", "xx", "s1"), ("word", "xx", "s2"), ("word", None, None), (None, None, "é"), ("A_b[C`d@E{f", "en", "s0")])]
    made += [made[3], made[3], (None, None, None, None), (None, "x y " * 30, "en", "s0"), (7, prose(9, 40), "en", "s1"), (500, prose(77, 30_000), "en", "s5"), (501, "é" * 3000 + " tail", "de", "s6")]
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, "n") for r in rows], SCHEMA).repartition(5).cache()


def brute_audit(rows, min_docs=30):
    lower = lambda s: re.sub("[A-Z]", lambda m: m.group().lower(), s)
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        n[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, source in groups:
        terms = [t for t, k in docs[lang].items() if k >= min_docs]
        others = [s for x, s in groups if x == lang]

        def share(counts, terms=terms):
            total = sum(counts[t] for t in terms)
            return {t: 1 + (10**9 * (counts[t] + 5)) // (total + 5 * len(terms)) for t in terms}

        p, q = share(n[lang, source]), share(sum((n[lang, s] for s in others), Counter()))
        pairs = []
        for s in others:
            if s != source:
                o = share(n[lang, s])
                pairs.append((-sum(abs(p[t] - o[t]) for t in terms), s.encode()))
        named = [(q[t] - p[t], t.encode()) for t in terms if n[lang, source][t] and p[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", named, 50)):
            out += [(lang, source, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(sorted(items)[:most])]
    return sorted(out)


@pytest.mark.parametrize("tile,opened", [(256, 1 << 16), (5, 3)])
def test_divergence(docs, rows, tile, opened, monkeypatch):
    monkeypatch.setattr(divergence, "OPENED", opened)
    for least in (30, 2):
        got = sorted(map(tuple, divergence.audit(docs, min_docs=least, tile_terms=tile).select("lang", "source", "part", "item", "value", "rank").collect()))
        assert got == brute_audit(rows, least) and len(got) > 100
    assert divergence.audit(docs.where("false")).count() == 0


def test_divergence_of_rows_beyond_a_block():
    """Trees over sparse random blocks, with rows and columns that don't fill the square, against a dense matrix."""
    r = np.random.default_rng(2)
    for n_a, n_b, n_cols, fill in ((8, 8, 8, 0.2), (5, 7, 6, 0.5), (1, 3, 1, 1.0), (16, 2, 11, 0.05), (4, 4, 4, 0.0), (3, 5, 9, 0.0)):
        levels = max(1, max(n_a, n_b, n_cols) - 1).bit_length()
        dense = [np.where(r.random((n, n_cols)) < fill, r.integers(1, 10**9, (n, n_cols)), 0) for n in (n_a, n_b)]
        none = [r.integers(1, 10**6, n) for n in (n_a, n_b)]
        tree = [divergence.Tree(*np.nonzero(x), x[np.nonzero(x)], levels) for x in dense]
        full = [np.where(x > 0, x, e[:, None]) for x, e in zip(dense, none)]
        want = np.abs(full[0][:, None, :] - full[1][None, :, :]).sum(2)
        assert (divergence.joint(*tree, *none, n_cols, levels, False) == want).all()
        own = np.abs(full[0][:, None, :] - full[0][None, :, :]).sum(2)
        upper = np.triu_indices(n_a, 1)
        assert (divergence.joint(tree[0], tree[0], none[0], none[0], n_cols, levels, True)[upper] == own[upper]).all()


def test_shares_are_exact():
    big = np.array([3 * 10**12, 0])
    assert divergence.shares(big, np.array([7 * 10**12, 7])).tolist() == [1 + 10**9 * (3 * 10**12 + 5) // (7 * 10**12), 1 + 5 * 10**9 // 7]


def brute_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))


def brute_buckets(text):
    w = brute_words(text)
    return [zlib.crc32(b" ".join(w[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("spans", [1 << 20, 7])
def test_features(monkeypatch, spans):
    monkeypatch.setattr(resample, "SPANS", spans)
    scan = resample.scanner()
    r = random.Random(3)
    texts = ["", "a", "A b", "a b c", " ,a;; B\n\nc\t", "x" * 64, "x" * 65 + " y", "p " + "x" * 300 + " q r " + "y" * 70, "é" * 40 + " ñ 9", *(prose(i, i) for i in range(40)), " ".join("w" * r.randrange(1, 90) for _ in range(500))]
    for t in texts:
        n, buckets = scan(t.encode())
        assert n == len(brute_words(t)) and buckets.tolist() == sorted(brute_buckets(t)), t


def brute_resampled(rows, target, percent=5):
    features = [brute_buckets(r[1]) for r in rows]
    s, t = Counter(x for f in features for x in f), Counter(x for y in target for x in brute_buckets(y))
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000.0) / ((s[b] + 1.0) * (all_t + 10_000.0)))) for b in range(10_000)]
    out = []
    for r, f in zip(rows, features):
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(brute_words(r[1]))])
    fit = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0], x[1]))
    for i, x in enumerate(fit[: percent * len(fit) // 100]):
        x[4] = i + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


def test_resampling(spark, docs, rows):
    target = [prose(900 + i, 30, WORDS[:9]) for i in range(20)] + [None, ""]
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(target)], "item_id bigint, text string, _none int")
    for percent in (5, 60):
        got = sorted(map(tuple, resample.resampled(docs, bench, percent).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
        assert got == brute_resampled(rows, target, percent)
    assert sorted(map(tuple, resample.resampled(docs, bench.where("false")).collect()), key=repr) == brute_resampled(rows, [])
    assert resample.resampled(docs.where("false"), bench).count() == 0


def brute_entries(text):
    """The fingerprint by sorting all k-mers anew for each point of the circle."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    long = lambda x, seed: xxhash.xxh64_intdigest((x % (1 << 64)).to_bytes(8, "little"), seed)
    token = re.findall(r"[^\x20\x09-\x0D]{1,16}", text)
    seen, mers = Counter(), []
    low = (1 << 30) - 1
    hashes = []
    for i, t in enumerate(token):
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        if i + 1 < len(token):
            h = xxhash.xxh64_intdigest(token[i + 1].encode(), h)
        hashes.append(signed(h) >> 30)
    for i, h in enumerate(hashes):
        n = seen[h]
        seen[h] += 1
        g = signed(xxhash.xxh64_intdigest(n.to_bytes(4, "little"), long(h, 42)))
        mers.append((g >> 30, i))
    out = []
    for point in order_minhash.POINTS:
        first = sorted(mers, key=lambda m: (((m[0] << 30 | m[1]) - point) % (1 << 64)))[:2]
        h = 0
        for g, _ in sorted(first, key=lambda m: m[1]):
            h = signed(long(g, long(h, 42)))
        out.append(h % (1 << 32))
    return out


def brute_fingerprints(rows):
    mark = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    texts = sorted(((r[0] is None, -(r[0] or 0), -signed(mark(r[1] or "")), r[1] or "", r[0]) for r in rows), key=lambda x: x[:4])
    out = []
    for i, (*_, text, doc) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][3]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = brute_entries(text), brute_entries(edited), brute_entries(after)
        like = lambda x, y: sum(u == v for u, v in zip(x, y)) / 64
        hexed = lambda x: "".join(f"{e:08x}" for e in x)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), like(a, b), like(a, c)))
    return sorted(out, key=repr)


def test_order_minhash(docs, rows):
    got = sorted(map(tuple, order_minhash.digests(docs).collect()), key=repr)
    assert got == brute_fingerprints(rows)
    assert order_minhash.digests(docs.where("false")).count() == 0
    one = order_minhash.digests(docs.where("doc_id = 4")).first()
    assert one.near_next == 1.0


def test_order_minhash_follows_edits(spark):
    """Likeness falls with edits, and words in another order are another text."""
    words = [f"w{i}" for i in range(400)]
    r = random.Random(1)
    shuffled = r.sample(words, len(words))
    few, many = list(words), list(words)
    for i in r.sample(range(400), 8):
        few[i] = "x"
    for i in r.sample(range(400), 120):
        many[i] = f"y{i}"
    made = [" ".join(x) for x in (words, words, few, many, shuffled)]
    e = order_minhash.entries(spark.createDataFrame([(i, t) for i, t in enumerate(made)], "i int, t string"), "t", "e").orderBy("i").collect()
    like = [sum(a == b for a, b in zip(e[0].e, x.e)) / 64 for x in e]
    assert like[1] == 1 and 0.75 < like[2] < 1 and 0.05 < like[3] < like[2] and like[4] < 0.1
