import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quotelake.llm import token_counts as tc
from quotelake.llm.queries import QUERIES, tokenizer_file

FILE = tokenizer_file("word_bpe_49k.json")
WHOLE, COUNTER = Tokenizer.from_file(FILE), tc.Counter(FILE)
SCHEMA = "doc_id long, text string, n_tokens string"
ODD = ["<|endoftext|>", "a<|startoftext|>b <|endof text|>", "it's they'LL we 've don’t", "é ñ Å 가", "x y z", "12ab34 ½ ٣ 7⃣", "漢字かな。、12", "\x1c a\x85b \x00 c", "İstanbul ǅ ß ẞ", "🙂🙂 👩‍👩‍👧"]


def whole(text):
    return len(WHOLE.encode(text or "", add_special_tokens=False))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.sampled_from(ODD)), max_size=6))
def test_counts_are_those_of_whole_texts(rows):
    assert COUNTER.counts([r.encode("utf-8", "ignore") for r in rows]) == [whole(r.encode("utf-8", "ignore").decode()) for r in rows]

def test_long_texts_in_small_parts(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(tc, "PART_BYTES", 50)
    monkeypatch.setattr(tc, "BATCH_BYTES", 64)
    monkeypatch.setattr(tc, "MEMO", 20)
    rows = ["".join(rng.choice(ODD + ["word", " ", "\n", "7", "ab" * 90, "9é" * 70]) for _ in range(rng.randrange(60))) for _ in range(60)]
    assert tc.Counter(FILE).counts([r.encode() for r in rows]) == list(map(whole, rows))


def test_batches_have_like_bytes():
    rng = random.Random(1)
    stretches = [bytes(rng.randrange(1, 40)) for _ in range(3000)]
    loads = [sum(map(len, b)) for b in tc.balanced(stretches, 1000)]
    assert sum(loads) == sum(map(len, stretches)) and max(loads) - min(loads) <= 40 and max(loads) <= 1040
    assert list(tc.balanced([], 10)) == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_tokenizers_that_keep_white_space_get_whole_texts(name):
    rows = ["  two  spaces\n\nhere 12", "", "x" * 300, *ODD]
    if name.endswith(".model"):
        import sentencepiece

        want = [len(sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(name)).encode(r)) for r in rows]
    else:
        own = Tokenizer.from_file(tokenizer_file(name))
        want = [len(own.encode(r, add_special_tokens=False)) for r in rows]
    assert tc.Counter(tokenizer_file(name)).counts([r.encode() for r in rows]) == want


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "same words", "x"), (3, "same words", "x"), (4, "Word 12 " * 40_000, "x"), (5, "q" * 100_000, "x"), *((10 + i, t, "x") for i, t in enumerate(ODD))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = tc.token_counts(df.repartition(3), FILE, limit=10).collect()
    want = [(i, len((t or "").encode()), whole(t), whole(t) > 10) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert tc.token_counts(df.limit(0), FILE).collect() == []


def test_query_against_whole_texts(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_token_counts"](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert got == {r.doc_id: (r.doc_id, len((r.text or "").encode()), whole(r.text), whole(r.text) > 2048) for r in rows}
