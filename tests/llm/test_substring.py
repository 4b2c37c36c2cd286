import hashlib
import random

import pytest

from quotelake.llm.substring import SuffixAutomaton, digest, remove_repeats

SCHEMA = "doc_id long, text string, spans string, n_chars long"


def brute(rows, window):
    docs = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    first = {}
    for i, w in docs:
        if i is not None:
            for a in range(len(w) - window + 1):
                key = tuple(w[a : a + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in docs:
        keep = [True] * len(w)
        for a in range(len(w) - window + 1):
            if i is not None and first[tuple(w[a : a + window])] < i:
                keep[a : a + window] = [False] * window
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "c", "é", "dd", "E", "e f", *(f"v{i}" for i in range(25))]
    passages = [rng.choices(vocab, k=rng.choice([6, 9, 20, 45])) for _ in range(8)]
    rows = []
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(5)):
            words += rng.choice(passages)[rng.randrange(3) :] if rng.random() < 0.6 else rng.choices(vocab, k=rng.randrange(30))
        rows.append((rng.randrange(10**5), rng.choice([" ", "\n", " \t"]).join(words), "x", 1))
    return rows + [(i + 10**6, t, s, n) for i, t, s, n in rows[:12]]


@pytest.mark.parametrize("window,bounds", [(6, {}), (8, {"shard_words": 7, "probe_words": 30}), (1, {}), (50, {})])
def test_against_brute_force(spark, window, bounds):
    rows = corpus(window) + [(1, None, "", 0), (2, "", "", 0), (None, "a b c dd a b c dd", "", 0), (3, "a b c dd a b c dd", "", 0), (3, "a b c dd a b c dd", "", 0), (3, "b c dd a b c dd E x", "", 0), (99_999_999, "z " * 3000, "", 0), (99_999_998, "z " * 900, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, digest(df, window=window, **bounds).collect()), key=str)
    assert got == brute(rows, window)


def test_remove_repeats_keeps_columns_and_other_texts(spark):
    words = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, words, "s", 5), (2, "x  y " + words + " z", "s", 5), (3, "p\n q", "s", 4), (4, words, "s", 1)], SCHEMA)
    out = remove_repeats(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, words, "s", len(words)), (2, "x y z", "s", 5), (3, "p\n q", "s", 4), (4, "", "s", 0)]


def test_empty_table(spark):
    assert digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_automaton_against_all_substrings():
    rng = random.Random(2)
    for _ in range(60):
        refs = [rng.choices("abc", k=rng.randrange(1, 14)) for _ in range(4)]
        probe = rng.choices("abcd", k=30)
        auto = SuffixAutomaton()
        for r in refs:
            auto.add(r)
        runs = {tuple(r[i:j]) for r in refs for i in range(len(r)) for j in range(i, len(r) + 1)}
        want = [max(n for n in range(e + 1) if tuple(probe[e - n : e]) in runs or n == 0) for e in range(1, len(probe) + 1)]
        assert list(auto.feed(probe)) == want
