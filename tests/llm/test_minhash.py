import random
from itertools import combinations

import numpy as np
import pytest
from test_textbytes import plain_sets

from sparkreel.llm import minhash
from sparkreel.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls string, sig string"


def brute(rows, width, percent=80):
    """component_id of each row by all pairs."""
    sets = plain_sets([t for _, t in rows], width)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= percent * len(sets[a] | sets[b]):
            parent[find(b)] = find(a)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), d), d)
    return {(d, t): (len(sets[k]), least[find(k)]) for k, (d, t) in enumerate(rows)}


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 0, "x", "y") for d, t in rows], SCHEMA)


def corpus(seed, groups=12, size=9):
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(60)}" for _ in range(rng.randrange(3, 90))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(0, max(1, len(words) // 9))):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += ["", "   ", "one", "One", "one two", "one  two\n", "two one"]
    rng.shuffle(texts)
    return list(enumerate(texts, 5))


@pytest.mark.parametrize("width,seed", [(2, 1), (2, 2), (5, 3)])
def test_components_agree_with_all_pairs(spark, width, seed):
    rows = corpus(seed)
    got = {(r.doc_id, t): (r.n_shingles, r.component_id) for r, t in ((r, dict(rows)[r.doc_id]) for r in minhash.near_duplicates(spark, frame(spark, rows), width, 80).collect())}
    assert got == brute(rows, width)


def test_large_group_of_near_copies_and_exact_copies(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(100)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[7][1]) for i in range(200)]
    old, minhash.BLOCK = minhash.BLOCK, 64
    try:
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark, frame(spark, rows), 2, 80).collect()}
    finally:
        minhash.BLOCK = old
    assert got == {d: c for (d, _), (_, c) in brute(rows, 2).items()}


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "A b\tc"), (None, "a b c"), (None, "z z z")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in minhash.near_duplicates(spark, frame(spark, rows), 2, 80).collect())
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False), (-1, 2, 3, False), (-1, 1, -1, True)])
    assert minhash.near_duplicates(spark, frame(spark, []), 2, 80).collect() == []


def test_one_of_each_keeps_columns_and_one_row(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words are here now"), (4, None)]
    out = minhash.one_of_each(spark, frame(spark, rows))
    assert out.columns == SCHEMA.replace(",", "").split()[::2]
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]


def test_sketch_bounds_the_symmetric_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, rng.integers(1, 40), dtype=np.uint64)]))
        i = len(np.intersect1d(a, b))
        similar = 100 * i >= 80 * (len(a) + len(b) - i)
        ok = minhash.bounded([minhash.odd_sketch(a)], [minhash.odd_sketch(b)], np.array([len(a)]), np.array([len(b)]), 80)[0]
        assert ok or not similar


def test_keys_guarantee_the_signature_distance():
    rng = np.random.default_rng(4)
    sig = rng.integers(0, 2**16, (300, minhash.K)).astype(np.uint16)
    other = sig.copy()
    most = minhash.CHUNKS * (minhash.ERRORS + 1) - 1
    for r in other:
        r[rng.permutation(minhash.K)[:most]] ^= 1
    same = minhash.bucket_keys(sig) == minhash.bucket_keys(other)
    assert same.any(1).all()
    assert (same.argmax(1) == minhash.first_slot(sig == other)).all()


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000, 2000 + i) for i in range(300)] + [(i, i + 1) for i in range(5000, 5060)] + [(None, 1), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_rows_go_for_themselves_and_not_for_their_id(spark):
    t, u = "a b c d e f g", "other words are here now and then"
    rows = [(0, t), (1, t), (1, u), (None, u), (None, "one more text of several words"), (None, "one more text of several words"), (5, ""), (5, ""), (None, ""), (None, None)]
    left = sorted(((r.doc_id, r.text) for r in minhash.one_of_each(spark, frame(spark, rows)).collect()), key=str)
    assert left == sorted([(0, t), (1, u), (None, "one more text of several words"), (5, ""), (None, ""), (None, None)], key=str)
    near = [(7, " ".join(f"w{k}" for k in range(60))), (7, " ".join(f"w{k}" for k in range(1, 61))), (7, "nothing like it at all, that is")]
    assert len(minhash.one_of_each(spark, frame(spark, near)).collect()) == 2


def test_very_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(400_000))
    rows = [(1, long), (2, long + " end"), (3, long.replace("w7 ", "x ")), (4, long[: len(long) // 2])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark, frame(spark, rows), 2, 80).collect()}
    assert got == {1: (399_999, 1), 2: (400_000, 1), 3: (399_999, 1), 4: (len(rows[3][1].split()) - 1, 4)}
