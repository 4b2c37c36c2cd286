import random

import numpy as np
import pytest

from quotelake.llm.components import Forest
from quotelake.llm.minhash import MinMax, Shingler, intersections, near_duplicates

SCHEMA = "doc_id long, text string, kept string"
LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text, k):
    words = [w.decode() for w in (text or "").encode().split()]
    words = [w.translate(LOWER) for w in words]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, percent=80):
    sets = [(i, shingle_set(t, k)) for i, t, _ in rows]
    forest = Forest()
    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                forest.link(i, j)
    return sorted((i, len(s), forest.root(i) if i is not None else None) for i, s in sets if i is not None)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(25):
        base = rng.choices(vocab, k=rng.choice([3, 12, 60, 200, 900]))
        for _ in range(rng.choice([1, 2, 5, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((rng.randrange(10**6), " ".join(copy).upper() if rng.random() < 0.3 else "\t".join(copy), "x"))
    return rows


@pytest.mark.parametrize("k,block", [(4, 128), (5, 3)])
def test_against_all_pairs(spark, k, block):
    rows = corpus(k) + [(7, None, ""), (8, "", ""), (9, " \n", ""), (10, "É a", ""), (11, "é a", ""), (None, "w1 w2", ""), (12, "w1 w2", ""), (13, "W1 w2", ""), (13, "W1 w2", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = near_duplicates(df, shingle_words=k, block=block, pair_block=2 * block).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [(r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None] == [(1, None, True)]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_min_max_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    minmax, pairs = MinMax(), []
    for _ in range(60):
        x = rng.integers(0, 1 << 64, 300, np.uint64)
        y = np.concatenate([x[:240], rng.integers(0, 1 << 64, 60, np.uint64)])
        pairs.append(minmax.estimate(minmax.signature(x), minmax.signature(y)) - 240 / 360)
    assert abs(np.mean(pairs)) < 0.02 and np.std(pairs) < 0.06


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 50, n).astype(np.uint64)) for n in (1, 5, 30, 30, 200)]
    assert intersections(sets).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]


def test_shingler_counts_short_texts_as_one():
    s = Shingler(4)
    assert len(s(b"")) == 0 and len(s(b"a b c")) == 1 and len(s(b"a b c d")) == 1 and len(s(b"a b c d e")) == 2
    assert s(b"A b")[0] == s(b" a  b ")[0]
