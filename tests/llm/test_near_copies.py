"""The pipeline's near-dedup stage against all pairs by brute force."""

import random
from collections import Counter

import corpus_pipeline
from test_operators import prose


def grams(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def alike(a, b):
    return a == b or 5 * (a & b).total() >= 4 * (a | b).total()


def brute(rows):
    """One of each class that links reach: the least id, a null one last."""
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return sorted(min((rows[i][0] is None, rows[i][0] or 0) for i in g) for g in groups.values())


def changed(seed, text, n):
    r, w = random.Random(seed), text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"new{seed}x{i}"
    return " ".join(w)


def test_near_dedup_stage(spark):
    texts = [prose(i, 150) for i in range(25)]
    # from far above 0.8 to far below it
    texts += [changed(100 + i, texts[i % 12], i % 6) for i in range(60)]
    # a chain, each step above 0.8, and a large group of near copies of a text that isn't there
    texts += [" ".join(f"c{i}" for i in range(8 * j, 8 * j + 160)) for j in range(12)]
    gone = prose(77, 200)
    texts += [changed(300 + i, gone, 2) for i in range(80)]
    texts += [None, "", "  ", "one two", "One  two", "one two three", "again and again " * 30, "again and again " * 29, texts[3].upper()]
    rows = list(enumerate(texts)) + [(None, texts[5]), (None, prose(500, 60)), (7, prose(501, 60))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    want = brute(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == want
    assert 30 < len(want) < 90
