import hashlib
import random

import numpy as np
import pytest

from pyspark.sql import functions as F
from quotelake.llm.fingerprints import bin_values, densified, fingerprint, fingerprints, likeness, shingle_hashes

SCHEMA = "doc_id long, text string, key string, n_chars string"


def test_edits_and_hashes(spark):
    rng = random.Random(4)
    rows = [(i * 7 % 101, " ".join(rng.choices(["aé", "b", "cc", "日本", "e\n"], k=rng.randrange(40)))) for i in range(60)] + [(200, None), (201, ""), (202, "   "), (203, "x")]
    df = spark.createDataFrame([(i, t, "k", "n") for i, t in rows], SCHEMA).repartition(5)
    got = {r.doc_id: r for r in fingerprints(df).collect()}
    line = sorted(((i, t or "") for i, t in rows), reverse=True)
    for (i, t), (j, after) in zip(line, line[1:] + line[:1]):
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    by_text = {}
    for i, t in rows:
        by_text.setdefault(tuple((t or "").encode().split()), set()).add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert got[201].fingerprint == "" and len(got[203].fingerprint) == 512 and got[201].near_edited == 1.0


def test_repeated_rows_null_ids_single_rows_and_empty_tables(spark):
    def run(rows):
        return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_next) for r in fingerprints(spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)).collect()), key=str)

    assert run([]) == []
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert run([(5, "abcdef")]) == [(5, 6, sha("abcdab"), 1.0)]
    got = run([(5, "abcdef"), (5, "abcdef"), (None, "uvwxyz"), (3, "klmnop")])
    assert got == sorted([(5, 6, sha("abcdkl"), 0.0)] * 2 + [(3, 6, sha("klmnuv"), 0.0), (None, 6, sha("uvwxab"), 0.0)], key=str)


@pytest.mark.parametrize("n,common", [(600, 0.8), (600, 0.3), (40, 0.5), (6, 0.5)])
def test_likeness_is_unbiased(spark, n, common):
    rng = np.random.default_rng(1)
    pairs, true = [], []
    for _ in range(60):
        k = int(n * common)
        a = rng.integers(-(1 << 63), 1 << 63, n).tolist()
        b = a[:k] + rng.integers(-(1 << 63), 1 << 63, n - k).tolist()
        pairs.append((a, b))
        true.append(k / (2 * n - k))
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    low = lambda c: densified(bin_values(F.col(c)))
    got = [r[0] for r in df.select(likeness(low("a"), low("b"))).collect()]
    assert abs(np.mean(got) - true[0]) < (0.02 if n > 100 else 0.12)


def test_shingles(spark):
    def n(t):
        return spark.createDataFrame([(t,)], "t string").select(F.size(F.array_distinct(shingle_hashes(F.col("t"))))).first()[0]

    assert [n(t) for t in (None, "", " ", "a", "a b c d e", "a b c d e f", " a b\tc d e f\n")] == [0, 0, 0, 1, 1, 2, 2]
    df = spark.createDataFrame([("a b c d",), ("a  b c\nd ",), ("a b c e",)], "t string")
    x, y, z = (r[0] for r in df.select(fingerprint(F.col("t"))).collect())
    assert x == y != z
