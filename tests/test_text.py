import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quotelake.functions import text as X


def values(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", column.alias("x")).collect()
    return [r.x for r in sorted(rows)]


def test_fold_strips_marks_of_many_scripts(spark):
    texts = ["Ésaïe", "Čeština ő ș", "ΆΈ Ёж", "Việt Nam", "á", "œuf ß", "", None]
    want = ["".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn") if t is not None else None for t in texts]
    assert values(spark, texts, X.fold(F.col("text"))) == want


def coverage(asked, words):
    at = found = 0
    for w in asked:
        if w not in words[at:]:
            break
        at, found = words.index(w, at) + 1, found + 1
    return found / len(asked) if asked else 0.0


def test_ordered_coverage_against_a_fold(spark):
    rng = random.Random(2)
    pairs = [([rng.choice("abc") for _ in range(rng.randrange(6))], [rng.choice("abcd") for _ in range(rng.randrange(9))]) for _ in range(200)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, q array<string>, w array<string>")
    got = {r.i: r.c for r in rows.select("i", X.ordered_coverage(F.col("q"), F.col("w")).alias("c")).collect()}
    assert got == {i: coverage(*p) for i, p in enumerate(pairs)}


@pytest.mark.parametrize(
    "text, want",
    [("Paul dit que la grâce suffit", "que la grâce suffit"), ("L'apôtre Jean nous rappelle : aimez", "aimez"), ("comme il est écrit, le juste vivra", "le juste vivra"), ("David marchait", "David marchait")],
)
def test_attribution(spark, text, want):
    assert values(spark, [text], X.without_attribution(F.col("text"))) == [want]


def test_stems_confirm_what_is_quoted(spark):
    passage = "Car Dieu a tant aimé le monde qu'il a donné son Fils unique"
    said = ["il a tellement aimé ce monde et donné un fils unique", "la réunion de lundi soir est reportée", ""]
    got = values(spark, said, X.overlap(X.content_stems(F.col("text")), X.content_stems(F.lit(passage))))
    assert got[0] >= 0.6 and got[1] < 0.34 and got[2] == 0
