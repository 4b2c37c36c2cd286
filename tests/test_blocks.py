"""Candidates of quotations by blocks, held against joins of n-grams and against overlaps of texts."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quotelake.functions import text as X
from quotelake.operators import fusion, retrieval

WORDS = ["Éternel", "berger", "manquerai", "rien", "l'amour", "d'un", "et", "dieux", "monde", "paix", "été", "œuvre"]


def texts(rng, n, most):
    return [" ".join(rng.choices(WORDS, k=rng.randrange(most))) for _ in range(n)]


def test_most_grams_against_the_join_of_all(spark, monkeypatch):
    rng = random.Random(5)
    documents = spark.createDataFrame([(i - 30, rng.choice(["", "Jn|3"]), t) for i, t in enumerate(texts(rng, 70, 40))], "doc_id long, scope string, text string")
    items = spark.createDataFrame([(i, rng.choice(["", "Jn|3", "Ps|1"]), t) for i, t in enumerate(texts(rng, 50, 12))], "item_id long, scope string, text string")
    hits = retrieval.gram_hits(items, documents, 3).join(items.select("item_id", "scope"), "item_id").join(documents.select("doc_id", "scope"), ["doc_id", "scope"])
    want = sorted(map(tuple, fusion.ranked(hits, "coverage", 4).select("item_id", "doc_id", "score").collect()))
    words = lambda df: df.withColumn("words", X.fragment(F.col("text"))).drop("text")
    for chars, some in ((1 << 22, 1 << 16), (300, 7)):
        monkeypatch.setattr(retrieval, "BLOCK_CHARS", chars)
        monkeypatch.setattr(retrieval, "BLOCK_ITEMS", some)
        got = retrieval.most_grams(words(items), words(documents), 3, 4)
        assert sorted(map(tuple, got.select("item_id", "doc_id", "coverage").collect())) == want
    assert len(want) > 50


def test_most_shared_is_the_same_however_few_counts_are_held(monkeypatch):
    rng = random.Random(6)
    side = lambda name, n, most: pa.table({name: pa.array(rng.sample(range(1000), n)), "words": ["".join(rng.choices("ab ", k=rng.randrange(most))).strip() for _ in range(n)]})
    a, b = side("id", 60, 80), side("query_id", 30, 30)
    want = [x.tolist() for x in retrieval._most_shared(a, b, 2, 3)]
    for counts in (1, 40, 1000):
        monkeypatch.setattr(retrieval, "COUNTS", counts)
        assert [x.tolist() for x in retrieval._most_shared(a, b, 2, 3)] == want
    nothing = pa.table({"query_id": [1, 2], "words": ["", "c"]})
    assert all(len(x) == 0 for x in retrieval._most_shared(a, nothing, 3, 3))
    assert np.bincount(want[0]).max() == 3


def test_most_stems_against_overlaps_of_texts(spark, monkeypatch):
    rng = random.Random(7)
    documents = spark.createDataFrame([(i, texts(rng, rng.randrange(4), 9)) for i in range(25)], "doc_id long, texts array<string>")
    pairs = spark.createDataFrame([(i, d, t) for i, t in enumerate(texts(rng, 30, 9)) for d in rng.sample(range(25), 6)], "item_id long, doc_id long, text string")
    want = pairs.join(documents, "doc_id").select("item_id", "doc_id", X.best_overlap(F.col("text"), F.col("texts")))
    own, stems = pairs.withColumn("stems", X.content_stems(F.col("text"))), documents.select("doc_id", F.transform("texts", X.content_stems).alias("stems"))
    for n in (1 << 16, 11):
        monkeypatch.setattr(retrieval, "BLOCK_ITEMS", n)
        got = retrieval.most_stems(own, stems).select("item_id", "doc_id", F.when(F.col("stems") > 0, F.col("shared") / F.col("stems")).otherwise(0.0))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stems_leave_marks_out_of_whole_texts_as_of_words(spark):
    from quotelake.functions import words as W

    rows = ["«Grâce», l'abîme-profond…  lumière éternelle!!! (œuvre)", " - ' ", "", "a grand°e lum!ière mońtagne 12345x² ١٢٣٤", "Paul Pauline dans lumière lumières", "!!! ab-cdef !!!"]
    word = lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")
    parted = F.split(F.trim(F.regexp_replace(F.regexp_replace(X.fold(F.col("text")), "['-]", " "), r"(?U)\s+", " ")), " ")
    kept = F.filter(F.transform(parted, word), lambda w: (F.length(w) >= 4) & ~w.isin(*sorted(W.STEM_STOP)))
    one_by_one = F.array_distinct(F.filter(F.transform(kept, lambda w: F.substring(w, 1, 5)), lambda w: ~w.isin(*sorted(W.WEAK_STEMS))))
    df = spark.createDataFrame([(r,) for r in rows], "text string")
    found = df.select(X.content_stems(F.col("text")).alias("got"), one_by_one.alias("want"))
    assert all(r.got == r.want for r in found.collect())
    # one pattern for a text, none for each of its words
    assert found.select("got")._jdf.queryExecution().optimizedPlan().toString().count("lambda") < found.select("want")._jdf.queryExecution().optimizedPlan().toString().count("lambda")


def test_hashed_vectors_are_those_of_features_added_one_by_one(monkeypatch):
    import re
    import zlib

    from quotelake.functions.books import plain
    from quotelake.operators import encoders

    monkeypatch.setattr(encoders.Hashed, "MEMO_WORDS", 5)
    rng = random.Random(8)
    said = [*texts(rng, 40, 60), "", "Grace and peace", "Été ÉTÉ"]
    want = np.zeros((len(said), 64), np.float32)
    for row, text in zip(want, said, strict=True):
        for word in re.findall(r"\w+", plain(text)):
            padded = f"^{word}$"
            for feature, weight in ((word, 1.0), *((padded[i : i + 3], 0.3) for i in range(len(padded) - 2))):
                h = zlib.crc32(feature.encode())
                row[h % 64] += weight if h >> 16 & 1 else -weight
    encoder = encoders.Hashed(64)
    got = encoder.embed(said)
    assert np.array_equal(got, want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12))
    assert 0 < len(encoder.memo) <= 5
