import random
import re
from collections import Counter, defaultdict

import pytest

from quotelake.llm.phrases import Chunk, collocations, parts

SCHEMA = "doc_id long, text string, lang string, phrase string, n string"


def brute(rows, max_words, least, percent, top):
    counts = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for n in range(1, max_words + 1):
                counts["und" if lang is None else lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        found = []
        for g, a in f.items():
            if len(g) < 2 or a < least:
                continue
            if any(len(h) > len(g) and 100 * c >= percent * a and c >= least and any(h[i : i + len(g)] == g for i in range(len(h))) for h, c in f.items()):
                continue
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["a", "B", "b", "É", "é", "zu", "über", "𝒳", "x'y", "\xa0"]
    rows = []
    for i in range(300):
        words = [rng.choice(vocab) if rng.random() < 0.6 else "new York city hall" for _ in range(rng.randrange(30))]
        rows.append((i, "".join(w + rng.choice([" ", "  ", "\t", ", ", ".\r\n", " ", " "]) for w in words), rng.choice(["en", "en", "de", None, "und"]), "x", "y"))
    return rows


@pytest.mark.parametrize("seed,least,top,size", [(1, 5, 2000, 1 << 20), (2, 2, 7, 40), (3, 1, 2000, 3)])
def test_against_all_ngrams(spark, seed, least, top, size):
    rows = corpus(seed) + [(1, None, "en", "", ""), (2, "", None, "", ""), (3, " \t", "xx", "", ""), (None, "one two", "yy", "", "")]
    rows += rows[:40] + [(4, "Very long piece " * 3000, "en", "", ""), (5, "w" * 5000 + " tail end", "long", "", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = collocations(df, least=least, top=top, part_bytes=size)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.select(columns).collect())) == brute(rows, 4, least, 80, top)


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("size", [1, 2, 7, 30])
@pytest.mark.parametrize("text", ["a b c d e f g h", "a,b c  d e\tf. g", "aaaaaaaaaaaaaaaaaaaa b cccccccccccccccccc d", " ,, ", "", "a b c,d e f g h i j"])
def test_parts_count_each_ngram_once(size, text):
    want, got = Counter(), Counter()
    for piece in re.split("[.,]", text):
        words = piece.split()
        want.update(tuple(words[i : i + n]) for n in range(1, 5) for i in range(len(words) - n + 1))
    chunk = Chunk(b"")
    for part, again in parts(text.encode(), 4, size):
        chunk.add(part, again)
    left, shortest = chunk.arrays()
    for i in range(len(chunk.words)):
        got.update(tuple(w.decode() for w in chunk.words[i : i + n]) for n in range(shortest[i], min(4, left[i]) + 1))
    assert got == want
