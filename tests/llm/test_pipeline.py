import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quotelake.llm.components import Forest
from quotelake.llm.packing import WordIds
from quotelake.llm.quality import classify
from quotelake.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    vocab = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    shared = [" ".join(rng.choices(vocab, k=70)) for _ in range(3)]
    rows, labels = [], []
    for i in range(0, 600, 2):
        words = rng.choices(vocab, k=rng.randrange(30, 160))
        kind = rng.choices([0, 1, 2], [1, 1, 5])[0]
        text = " ".join(w.upper() + "!!" for w in words) if kind == 0 else " ".join(words)
        if kind == 1:
            text = "nastyword vileword " + text + " nastyword vileword"
        if kind == 2 and rng.random() < 0.3:
            text += "\n" + rng.choice(shared)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(kind > 0), int(kind == 1)))
        if kind == 2 and rng.random() < 0.3:
            copy = text + (" ending" if rng.random() < 0.5 else "")
            rows.append((i + 1, copy, "en", "s", len(copy)))
    long = " ".join(rng.choices(vocab, k=60_000))
    rows += [(9003, long, "en", "s", len(long)), (9001, None, "en", "s", None), (9002, "", "en", "s", 0), (None, "some words without a number", "en", "s", 1), rows[0], rows[0]]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def near(docs, k=5):
    sets = []
    for i, t in docs:
        w = [x.lower() for x in (t or "").encode().split()]
        sets.append((i, {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()))
    forest = Forest()
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                forest.link(i, j)
    return [(i, t) for i, t in dict.fromkeys(docs) if i is None or forest.root(i) == i]


def without_repeats(docs, n=50):
    first = {}
    words = [(i, t, (t or "").encode().split()) for i, t in docs]
    for i, _, w in words:
        for a in range(len(w) - n + 1 if i is not None else 0):
            key = tuple(w[a : a + n])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t, w in words:
        gone = set()
        for a in range(len(w) - n + 1 if i is not None else 0):
            if first[tuple(w[a : a + n])] < i:
                gone |= set(range(a, a + n))
        out.append((i, t if not gone else b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def test_run_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    chosen = [(r.doc_id, r.text) for r in classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("selected").collect()]
    assert 150 < len(chosen) < docs.count()
    want = without_repeats(near(chosen))
    assert len(want) < len(set(chosen))
    encode, got = WordIds(tokenizer_file("word_bpe_49k.json")), {}
    for r in corpus_pipeline.run(spark, folder).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert set(got) == {i for i, _ in want}
    for i, t in want:
        ids = encode.of((t or "").encode()) + np.array([2], "<u4").tobytes()
        at = 0
        for start, n, crc, total in sorted(got[i]):
            assert start == at and total == len(ids) // 4 and crc == zlib.crc32(ids[4 * at : 4 * (at + n)])
            at += n
        assert at == len(ids) // 4


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["selected", "p_clean", "kept", "component_id", "kept_id", "spans", "seq", "gone_id", "kept_text", "length", "sequence_id"]
    docs = docs.select("*", *(F.lit("mine").alias(n) for n in names))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        assert docs.select(*names).distinct().collect() == [("mine",) * len(names)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= docs.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == []
