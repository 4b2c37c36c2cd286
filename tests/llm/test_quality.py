import random

import numpy as np

from quotelake.llm import quality
from quotelake.llm.quality import Ordinal, classify, features

SCHEMA = "doc_id long, text string, selected string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randrange(20, 200))
        kind = rng.choices([0, 1, 2], [2, 2, 6])[0]
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        if kind == 1:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vileen", "vilest", "nasty"]))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(kind > 0), int(kind == 1)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(1, 1200)
    df, rated = spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(labels[:800], LABELS)
    got = {r.doc_id: r for r in classify(df, rated).collect()}
    held = labels[800:]
    right = [got[i].selected == (q == 1 and t == 0) for i, q, t in held]
    assert np.mean(right) > 0.97
    by = {k: np.mean([got[i].expected_grade for i, q, t in held if (2 if q and not t else q) == k]) for k in (0, 1, 2)}
    assert by[0] < by[1] < by[2]
    assert all(r.p_sound >= r.p_clean and abs(r.p_sound + r.p_clean - r.expected_grade) < 1e-9 for r in got.values())
    assert classify(df, rated).columns == ["doc_id", "text", "expected_grade", "p_sound", "p_clean", "selected"]


def test_nulls_ties_and_missing_ratings(spark):
    rows, labels = corpus(2, 200)
    odd = [(None, "word1 word2", ""), (900, None, ""), (901, "", ""), (902, "word3 " * 50_000, ""), (1, rows[1][1], "")]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    rated = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 1), (4, 1, None), labels[5], labels[5]], LABELS)
    got = classify(df, rated).collect()
    assert len(got) == len(rows) + len(odd) and all(r.selected is not None for r in got)
    assert len({r.p_clean for r in got if r.doc_id == 1}) == 1
    none = classify(df, spark.createDataFrame([], LABELS)).collect()
    assert all(r.selected and r.p_clean is None and r.expected_grade is None for r in none) and len(none) == len(got)
    assert classify(spark.createDataFrame([], SCHEMA), rated).collect() == []


def test_the_sample_is_bounded(spark):
    rows, labels = corpus(3, 120)
    df = spark.createDataFrame(rows + rows, SCHEMA)
    model = quality.train(df, spark.createDataFrame(labels, LABELS), sample_rows=50)
    assert model.fitted and len(model.thresholds) == 2


def test_gradient_steps_reach_the_likelihood_of_a_known_model():
    rng = np.random.default_rng(0)
    quality_rows = rng.random((3000, 3)) < 0.5
    score = quality_rows @ np.array([2.0, -1.5, 0.0])
    tails = quality.sigmoid(score[:, None] - np.array([-0.5, 1.0]))
    grades = np.array([sum(u < t for t in row) for u, row in zip(rng.random(3000), tails, strict=True)])
    index = [np.flatnonzero(r) for r in quality_rows]
    model = Ordinal.fit(index, [np.ones(len(i)) for i in index], grades, 3)
    assert np.allclose(model.thresholds, [-0.5, 1.0], atol=0.2) and np.allclose(model.weights[:3], [2.0, -1.5, 0.0], atol=0.25)


def test_features_of_an_empty_text():
    index, value = features([], quality.Words())
    assert len(index) == len(value) == 0
