import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from quotelake.llm.pieces import BPE, BYTE, CONTROL, NORMAL, PROBES, UNIGRAM, UNKNOWN, USER_DEFINED, Model, Pieces, decode, differences, digest, encode

with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
    MODEL = f.read()


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def model_file(pieces, kind, one_space, prefix=1):
    parts = [(1, message((1, p.encode()), (2, float(s)), (3, k))) for p, s, k in pieces]
    trainer = message((3, kind), (4, len(pieces)), (35, 1))
    rules = message((1, b"identity"), (2, b""), (3, prefix), (4, one_space), (5, 1))
    return message(*parts, (2, trainer), (3, rules))


def unigram():
    rng = random.Random(5)
    pieces = [("<unk>", 0, UNKNOWN), ("<s>", 0, CONTROL), ("</s>", 0, CONTROL)] + [(f"<0x{i:02X}>", 0, BYTE) for i in range(256)]
    words = {"".join(rng.choices("abcde▁", k=1)[0] if i == 0 else rng.choice("abcde") for i in range(rng.randrange(1, 6))) for _ in range(400)} | set("abcde▁")
    return pieces + [(w, -rng.uniform(2, 12), NORMAL) for w in sorted(words)]


def sample(n=300, alphabet="aabbccddee  \n▁é🙂<"):
    rng = random.Random(2)
    return ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(n)]


def test_parity_of_the_bpe_model():
    rng = random.Random(1)
    words = ["the", "Hello,", "naïve", "日本語", "  ", "\t", "\n\n", "x" * 40, "thereaon", "🙂🙂", "1234", "▁", "<s>", "ﬁ"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(30))) for _ in range(400)]
    assert differences(MODEL, texts + list(PROBES) + sample()) == []


@pytest.mark.parametrize("one_space, prefix", [(0, 1), (1, 1), (0, 0)])
def test_parity_of_unigram_models(one_space, prefix):
    data = model_file(unigram(), UNIGRAM, one_space, prefix)
    assert differences(data, sample(alphabet="aabbccddee  é🙂")) == []


def test_models_that_are_refused():
    for data in (model_file(unigram(), 3, 0), model_file(unigram(), 4, 0), model_file([*unigram(), ("<tag>", 0, USER_DEFINED)], UNIGRAM, 0)):
        with pytest.raises(NotImplementedError):
            Model.parse(data)
    assert Model.parse(MODEL).kind == BPE


def test_memo_keeps_results_when_it_is_cleared(monkeypatch):
    import quotelake.llm.pieces as module

    whole = [x.tolist() for x in Pieces(MODEL).encode(sample())]
    monkeypatch.setattr(module, "MEMO_STRETCHES", 20)
    small = Pieces(MODEL)
    assert [small.encode([t])[0].tolist() for t in sample()] == whole


def test_decode_of_ids_that_are_no_text():
    plain, own = sentencepiece.SentencePieceProcessor(model_proto=MODEL), Pieces(MODEL)
    ids = [[200, 259, 230, 261], [259], [3 + 0xC3], [], [0, 1, 264, 2, 0, 300], [264, 3 + 0xC3, 3 + 0xA9, 3 + 0xA9]]
    for row in ids:
        assert own.decode([row])[0].rstrip("\ufffd") == plain.decode(row).rstrip("\ufffd")
    texts = sample()
    assert own.decode([x.tolist() for x in own.encode(texts)]) == own.tokenizer.decode_batch([x.tolist() for x in own.encode(texts)], skip_special_tokens=False)


SCHEMA = "doc_id long, text string, pieces string"


def test_digest_against_the_sentencepiece_library(spark):
    rows = [(1, "Hello, World"), (2, None), (3, ""), (4, "long 日本 " * 30000), (5, " x\n"), (5, " x\n"), (None, "y")]
    df = spark.createDataFrame([(a, b, "c") for a, b in rows], SCHEMA).repartition(2)
    plain = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    want = []
    for i, t in rows:
        ids = plain.encode(t or "")
        want.append((i, len(ids), sum(3 <= x < 259 for x in ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256((t or "").encode()).hexdigest()))
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in digest(df, MODEL).collect()), key=order) == sorted(want, key=order)
    texts = {r.doc_id: r.text for r in decode(encode(df, MODEL), MODEL).collect()}
    assert texts == {i: t or "" for i, t in rows}
    assert digest(df.limit(0), MODEL).collect() == []
