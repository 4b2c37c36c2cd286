import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from quotelake.llm.packing import Packer, WordIds, pack

FILE = public_tokenizers.path("word_bpe_49k.json")


def unpacked(rows, size=4096):
    """Checks that sequences are gapless and hold at most `size` ids; gives each document's pieces in order."""
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    padding = 0
    for seq in by_sequence.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return {d: sorted(p, key=lambda r: r.start) for d, p in by_doc.items()}, padding


@pytest.mark.parametrize("size", [8, 64, 4096])
def test_packer_places_each_id_once_without_padding(size):
    random.seed(size)
    packer = Packer(size, 0)
    docs = {i: np.arange(random.choice([1, 3, size // 2, size, 3 * size + 1, random.randrange(1, 2 * size)]), dtype="<u4") for i in range(300)}
    for i, ids in docs.items():
        packer.add(i, ids.tobytes())
    packer.finish()
    got = {}
    used = {}
    for doc, start, n, crc, total, seq, offset in packer.rows:
        assert total == len(docs[doc]) and zlib.crc32(docs[doc][start : start + n].tobytes()) == crc
        got.setdefault(doc, []).append((start, n))
        used.setdefault(seq, []).append((offset, n))
    for doc, parts in got.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(docs[doc])
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == size or at & (at - 1) == 0
    assert sum(size for _ in used) < sum(map(len, docs.values())) + size * 14


def test_level_minimises_the_sum_of_squares():
    random.seed(1)
    packer = Packer(16, 0)
    for _ in range(200):
        packer.levels[1:16] = [random.randrange(4) for _ in range(15)]
        n = random.randrange(1, 16)

        def cost(at):
            after = packer.levels.copy()
            if at:
                after[at] -= 1
            if at + n < 16:
                after[at + n] += 1
            return int((after[1:16] ** 2).sum())

        allowed = [0] + [a for a in range(1, 17 - n) if packer.levels[a]]
        best = min(cost(a) for a in allowed)
        assert packer.level(n) == max(a for a in allowed if cost(a) == best)


def test_pack_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    rows = [(1, "Hello, World's end"), (2, None), (3, ""), (4, "word " * 9000), (5, "Ünḯcode x<|endoftext|>y\x1cz"), (6, "a\tb\n c"), (6, "again"), (None, "x y")]
    df = spark.createDataFrame([(a, b, 1, "s") for a, b in rows], "doc_id long, text string, length long, sequence_id string").coalesce(1)
    got, padding = unpacked(pack(df, FILE).collect())
    assert padding == 0
    plain = Tokenizer.from_file(FILE)
    for doc, text in rows:
        if doc == 6:
            assert len([p for p in got[6] if p.start == 0]) == 2
            continue
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in got[doc]:
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_only_the_emptiest_windows_are_cut_at_the_end():
    rng = random.Random(4)
    for _ in range(30):
        packer = Packer(64, 0)
        for doc in range(rng.randrange(1, 60)):
            packer.add(doc, bytes(4 * rng.randrange(1, 50)))
        placed = [(at, [(p[0], p[1]) for p in w]) for at, ws in packer.open.items() for w in ws]
        closed = len({r[5] for r in packer.rows})
        packer.finish()
        windows = {}
        for doc, start, n, _, _, seq, offset in packer.rows:
            assert offset == sum(x[2] for x in windows.get(seq, []))
            windows.setdefault(seq, []).append((doc, start, n))
        sizes = [sum(x[2] for x in w) for s, w in windows.items() if s >= closed]
        assert all(n == 64 or n & (n - 1) == 0 for n in sizes) and sum(sizes) == sum(at for at, _ in placed)
        heads = [[(d, s) for d, s, _ in w] for q, w in windows.items() if q >= closed]
        kept = [at for at, w in placed if any(h[: len(w)] == w for h in heads)]
        cut = [at for at, w in placed if not any(h[: len(w)] == w for h in heads)]
        assert sum(cut[1:]) <= sum(64 - at for at in kept) + 64


def test_pack_of_an_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), FILE).collect() == []


def test_word_ids_against_the_tokenizer():
    from tokenizers import Tokenizer

    random.seed(9)
    plain, words = Tokenizer.from_file(FILE), WordIds(FILE)
    assert words.cuts
    alphabet = ["a", "B", "s", "'", "'s", "'Re", "9", "0", "!", "<|endoftext|>", "<", "|", "é", "E\u0301", "ΑΣ", "İ", "ß", "\x1c", "\x7f", "\x00", "\xa0", " ", "\t", "\u2003", "日本", "the", "🙂", "ÉÇ", "ñá", "ÿŸ", "×", "÷", "Ā", "Į", "į", "ŉ", "ﬁ"]
    for _ in range(3000):
        text = "".join(random.choices(alphabet, k=random.randrange(12)))
        assert words.of(text.encode()) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
