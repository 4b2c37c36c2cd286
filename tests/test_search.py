import math
import random
import zlib
from collections import Counter
from difflib import SequenceMatcher

import pytest

from quotelake.functions import words as W
from quotelake.operators import retrieval, typed, vectors

PASSAGE = "version string, book string, chapter long, verse long, text string"


def features(text):
    for w in text.split():
        if w not in W.HASH_STOP and len(w) >= 3:
            yield "w:" + w, w
        p = f"^{w}$"
        for i in range(len(p) - 2):
            yield "g:" + p[i : i + 3], None


def vector(text, idf, unknown):
    v = [0.0] * 512
    for f, w in features(text):
        h = zlib.crc32(f.encode())
        weight = 0.6 if w is None else 1 + math.sqrt(max(0, idf.get(w, unknown)))
        v[h % 512] += weight if h >> 16 & 1 else -weight
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else None


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdelmnorst", k=rng.randrange(2, 9))) for _ in range(120)] + ["dans", "pour", "les"]
    return [(i, " ".join(rng.choices(vocab, k=rng.randrange(1, 14)))) for i in range(n)], rng, vocab


def test_hashed_search_against_brute_force(spark):
    rows, rng, vocab = corpus(5, 200)
    asked = [(i, t) for i, (_, t) in enumerate(rng.sample(rows, 25))] + [(100, ""), (101, None), (102, "les dans pour")]
    texts = [(i, t) for i, t in rows if len(t) >= 15]
    significant = lambda t: [w for w in (t or "").split() if w not in W.HASH_STOP and len(w) >= 3]
    df = Counter(w for _, t in texts for w in set(significant(t)))
    idf, unknown = {w: math.log((len(texts) + 1) / (c + 1)) for w, c in df.items()}, 0.6 * math.log(len(texts) + 1)
    want = set()
    for q, t in asked:
        if len(significant(t)) >= 4:
            a = vector(t, idf, unknown)
            scored = sorted(((-round(sum(x * y for x, y in zip(a, vector(p, idf, unknown), strict=True)), 6), i) for i, p in texts))[:3]
            want |= {(q, i, round(-s, 3)) for s, i in scored if round(-s, 3) >= 0.45}
    got = vectors.hashed_search(spark.createDataFrame(asked, "id long, text string"), spark.createDataFrame(rows, "id long, text string"), 3, 0.45).collect()
    assert {(r.query_id, r.id, r.score) for r in got} == want and want


def test_hashed_search_in_blocks_shuffles_texts_only(spark, monkeypatch):
    rows, rng, _ = corpus(6, 120)
    texts, asked = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(rng.sample(rows, 30), "id long, text string")
    whole = vectors.hashed_search(asked, texts, 4, 0.3)
    want = sorted(map(tuple, whole.collect()))
    for name, n in (("BLOCK_TEXTS", 17), ("BLOCK_ITEMS", 7), ("TEXTS_AT_ONCE", 5), ("AT_ONCE", 3)):
        monkeypatch.setattr(vectors, name, n)
    cut = vectors.hashed_search(asked, texts, 4, 0.3)
    assert sorted(map(tuple, cut.collect())) == want and want
    plan = whole._jdf.queryExecution().executedPlan().toString()
    # neither features nor vectors of passages are rows of a shuffle
    assert "dim" not in plan and "array<double>" not in plan


def test_similar_words_compares_few_pairs(spark):
    rng = random.Random(3)
    word = lambda: "abc" + "".join(rng.choices("aeioulnrst", k=rng.randrange(0, 16)))
    known, asked = {word() for _ in range(300)}, {word() for _ in range(150)}
    for w in list(known)[:100]:
        i = rng.randrange(3, len(w) + 1)
        asked.add(w[:i] + rng.choice("xyz") + w[i + rng.randrange(2) :])

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for least in (0.72, 0.6, 0.2):
        want = set()
        for a in asked - known:
            scored = sorted((-round(1 - edits(a, b) / max(len(a), len(b)), 6), b) for b in known) if len(a) >= 4 else []
            want |= {(a, b, -s, n) for n, (s, b) in enumerate((x for x in scored if -x[0] >= least), 1) if n <= 4}
        frame = lambda ws: spark.createDataFrame([(w,) for w in sorted(ws)], "word string")
        found = retrieval.similar_words(frame(asked), frame(known), least, 4)
        assert {tuple(r) for r in found.collect()} == want and want
    # no row is made for a pair of words that are not similar
    plan = retrieval.similar_words(frame(asked), frame(known), 0.72, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan


def test_top_k_in_blocks_against_sorting(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 7)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 3)
    rng = random.Random(1)
    rows = [(i, i % 3, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, scope int, v array<double>")
    got = {}
    for r in vectors.top_k(df, df.where("id % 5 = 0").withColumnRenamed("id", "query_id"), 4).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.id, r.score)
    for q, s, v in rows[::5]:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, t, w in rows if t == s and i != q)[:4]
        assert got[q] == {n: (i, -x) for n, (x, i) in enumerate(best, 1)}
    assert vectors.top_k(df.limit(0), df.withColumnRenamed("id", "query_id"), 4).collect() == []


def brute_search(query, passages, active):
    """The search passage by passage, with the rule for candidates by sets."""
    asked = list(dict.fromkeys(w for w in query.split() if len(w) >= 2))
    docs = {}
    for v, b, c, n, t in passages:
        docs.setdefault((b, c, n), {})[v] = t
    posts = {}
    for k, texts in docs.items():
        for t in texts.values():
            for w in set(t.split()):
                if len(w) >= 2:
                    posts.setdefault(w, set()).add(k)
    limit = max(400, int(len(docs) * 0.08))
    known = [w for w in asked if w in posts]
    rare = [w for w in known if len(posts[w]) <= limit] or sorted(known, key=lambda w: (len(posts[w]), w))[:3]
    sets = {w: posts[w] for w in rare}
    for w in asked:
        if w not in posts and len(w) >= 4:
            near = sorted(((round(SequenceMatcher(None, m, w).ratio(), 6), m) for m in posts if len(m) >= 3 and m[:3] == w[:3]), reverse=True)[:4]
            if found := set().union(*(posts[m] for r, m in near if r >= 0.72)):
                sets[w] = found
    if not sets:
        return []
    chosen = set.intersection(*sets.values()) or set().union(*(found for _, found in sorted(sets.items(), key=lambda x: (len(x[1]), x[0]))[:4]))
    hits = []
    for exact in (True, False):
        for b, c, n in chosen:
            best = {}
            for v, t in docs[b, c, n].items():
                after = docs.get((b, c, n + 1), {}).get(v)
                if exact:
                    end = None if f" {query} " in f" {t} " else n + 1 if after and f" {query} " in f" {t} {after} " else 0
                    s, m = 1.0, "manual_exact" if end is None else "manual_cross_verse"
                    if end == 0:
                        continue
                else:
                    s, end, m = typed.score(query, t), None, "manual_approx"
                    if after and (j := typed.score(query, f"{t} {after}")) > s + 0.005:
                        s, end = j, n + 1
                    if s < (0.98 if len(query.split()) == 1 else 0.64):
                        continue
                key = (round(s, 4), v == active, -ord(v[0]))
                if end not in best or best[end][0] < key:
                    best[end] = (key, v, m)
            hits += [(-k[0], not k[1], c, b, n, end or 0, m) for end, (k, v, m) in best.items()]
        if hits:
            break
    return [(c, n, e or None, -s, m) for s, _, c, b, n, e, m in sorted(hits)[:12]]


def test_typed_search_against_brute_force(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("aeilmnrst", k=rng.randrange(1, 8))) for _ in range(60)] + ["de", "la"]
    rows = [(v, "b", c, n, " ".join(rng.choices(vocab, k=rng.randrange(3, 12)))) for v in "xy" for c in range(8) for n in range(1, 8)]
    asked = []
    for _ in range(60):
        v, b, c, n, t = rng.choice(rows)
        w = t.split()
        a = rng.randrange(len(w))
        part = w[a : a + rng.randrange(1, 6)]
        if rng.random() < 0.4:
            i = rng.randrange(len(part))
            part[i] = part[i] + rng.choice("qz")
        if rng.random() < 0.2:
            part += rng.choices(vocab, k=2)
        asked.append(" ".join(part))
    asked += [rows[0][4].split()[-1] + " " + rows[1][4].split()[0], "rien du tout", "", "De La"]
    passages = spark.createDataFrame(rows, PASSAGE)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    got = {}
    for r in sorted(typed.search(queries, passages, "y").collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.chapter, r.verse, r.verse_end, r.score, r.method))
    for i, q in enumerate(asked):
        assert got.get(i, []) == brute_search(q.lower(), rows, "y"), q
    assert len(got) > 40 and {m for h in got.values() for *_, m in h} == {"manual_exact", "manual_cross_verse", "manual_approx"}


def test_window_ratios_against_all_windows():
    rng = random.Random(6)
    vocab = ["".join(rng.choices("aeilmnrst0 "[:10], k=rng.randrange(1, 7))) for _ in range(12)]
    for _ in range(400):
        words, asked = rng.choices(vocab, k=rng.randrange(1, 14)), rng.choices(vocab, k=rng.randrange(1, 5))
        if rng.random() < 0.5:
            asked[0] += "x"
        query, n = " ".join(asked), len(asked)
        found = [SequenceMatcher(None, query, " ".join(words[i : i + k])).ratio() for k in range(max(1, n - 1), min(len(words), n + 2) + 1) for i in range(len(words) - k + 1)]
        want = next((r for r in found if r >= 0.995), max(found, default=0.0))
        assert typed.window_ratio(query, n, words) == want
        least = rng.random()
        assert typed.window_ratio(query, n, words, least) == want or want < least


@pytest.mark.parametrize("query, text, low, high", [("lion rugisant", "comme un lion rugissant", 0.64, 0.999), ("un", "comme un", 0.98, 1), ("x y z", "a b c", 0, 0), ("a b", "", 0, 0), ("b c", "a b c", 1, 1)])
def test_scores(query, text, low, high):
    assert low <= typed.score(query, text) <= high


def test_empty_tables(spark):
    none = spark.createDataFrame([], PASSAGE)
    queries = spark.createDataFrame([(1, "some words")], "query_id long, text string")
    assert typed.search(queries, none, "x").collect() == [] and typed.search(queries.limit(0), none, "x").collect() == []


def test_typed_search_reads_passages_once(spark):
    from pyspark.sql import functions as F

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    rows = [("x", "a", 1, n, f"word{n} and some more words of verse {n % 7}") for n in range(60)]
    passages = spark.createDataFrame(rows, "version string, book string, chapter long, verse long, text string").withColumn("text", counted("text"))
    queries = spark.createDataFrame([(1, "more words of verse"), (2, "word12"), (3, "sime more wordz of verse 3")], "query_id long, text string")
    assert {r.query_id for r in typed.search(queries, passages, "x").collect()} == {1, 2, 3}
    assert read.value == len(rows)


def test_gram_hits_count_each_row_once_however_often_its_words_repeat(spark):
    documents = [(1, "a b c a b c a b"), (1, "a b c"), (2, "a b"), (3, "b"), (4, None), (5, ""), (None, "É b c x"), (6, "b a")]
    items = [(7, "A b C a b"), (8, "e b"), (8, "e b"), (9, None), (10, "c")]
    words = lambda t: [w for w in (t or "").lower().replace("é", "e").split() if w]
    grams = lambda t, n: {tuple(words(t)[i : i + n]) for i in range(len(words(t)) - n + 1)}
    want = Counter()
    for i, a in items:
        for d, b in documents:
            for n in (2, 3):
                if shared := len(grams(a, n) & grams(b, n)):
                    want[i, d, n, len(grams(a, n))] += shared
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string").repartition(3)
    got = retrieval.gram_hits_of(frame(items, "item_id"), frame(documents, "doc_id"), (2, 3)).collect()
    assert {(r.item_id, r.doc_id, r.n, r.hits, r.coverage) for r in got} == {(i, d, n, c, round(c / size, 6)) for (i, d, n, size), c in want.items()}
    assert len(got) == len(want) > 4


def test_candidates_of_a_decision_are_found_once(spark):
    """n-grams of all documents are made for the candidates only; what goes on from these makes none."""
    from quotelake import registry

    plan = registry.QUERIES["fusion_decision"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
