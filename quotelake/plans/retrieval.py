"""Queries over passages, postings and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.operators import passages as P
from quotelake.operators import retrieval as R
from quotelake.plans.tables import table


def _passages(s, d):
    return P.from_documents(table(s, d, "documents"))


def _postings(s, d):
    return R.postings(table(s, d, "documents"))


def _n(s, d):
    return table(s, d, "documents").agg(F.count("*").alias("n"))


def _vocabulary(s, d):
    return _postings(s, d).select("word").distinct()


def _turn_words(s, d):
    return R.postings(table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), "text")).select("word").distinct()


def fragment_sql(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    return f"list_filter(string_split({fragment_sql(x)}, ' '), lambda w: w <> '')"


def grams_sql(x: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, len({x}) - {n - 2}), lambda i: array_to_string(list_slice({x}, i, i + {n - 1}), ' ')))"


def _md5(df, *keys, text="text"):
    return df.select(*keys, F.md5(F.col(text).cast("binary")).alias("md5"))


QUERIES = {
    "passages": lambda s, d: _md5(_passages(s, d), "version", "book", "chapter", "verse"),
    "passage_ranges": lambda s, d: _md5(P.in_range(_passages(s, d), 2, 4), "chapter"),
    "translations": lambda s, d: P.translations(_passages(s, d)).select("book", "verse", F.size("texts").cast("long").alias("versions"), F.md5(F.array_join(F.map_values("texts"), "|").cast("binary")).alias("md5")),
    "passage_neighbours": lambda s, d: P.neighbours(_passages(s, d)).select("chapter", "verse", F.length("next_text").cast("long").alias("next_length"), F.length("previous_text").cast("long").alias("previous_length")),
    "joined_pairs": lambda s, d: _md5(P.joined_pairs(_passages(s, d)), "chapter", "verse"),
    "neighbour_numbers": lambda s, d: P.neighbour_numbers(_passages(s, d), 5),
    "import_validation": lambda s, d: P.validated(table(s, d, "documents")),
    "sigil_check": lambda s, d: P.valid_sigils(table(s, d, "documents"), "source", ("SRC0", "SRC1")),
    "corpus_counts": lambda s, d: P.counts(_passages(s, d)),
    "word_weights": lambda s, d: R.weights(_postings(s, d), _n(s, d)),
    "posting_intersection": lambda s, d: R.intersection(table(s, d, "benchmark"), _postings(s, d), 4),
    "posting_union": lambda s, d: R.union_ranked(table(s, d, "benchmark"), _postings(s, d), 4, 3000),
    "gram_hits": lambda s, d: R.gram_hits(table(s, d, "benchmark"), table(s, d, "documents"), 3),
    "quotation_detection": lambda s, d: R.quotations(table(s, d, "benchmark"), table(s, d, "documents")),
    "contained_items": lambda s, d: R.contained(table(s, d, "benchmark"), table(s, d, "documents")),
    "similar_words": lambda s, d: R.similar_words(_turn_words(s, d), _vocabulary(s, d), 0.72, 4),
    "vector_topk": lambda s, d: R.nearest(table(s, d, "embeddings"), 5).select("query_id", "vec_id", "score", "rank"),
    "vector_scoped_topk": lambda s, d: R.nearest(table(s, d, "embeddings"), 5, scoped=True).select("query_id", "vec_id", "score", "rank"),
    "vector_gap_and_lag": lambda s, d: R.gap_and_lag(table(s, d, "embeddings")),
}

PASSAGES = """p AS (SELECT lang AS version, source AS book, doc_id AS chapter, CAST(i AS BIGINT) AS verse, trim(line) AS text
 FROM (SELECT *, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line) <> '')"""
POSTS = f"posts AS (SELECT doc_id, unnest(list_distinct({tokens_sql('text')})) AS word FROM documents)"
RARE = f"""{POSTS}, w AS (SELECT item_id, unnest(list_distinct({tokens_sql('text')})) AS word FROM benchmark),
k AS (SELECT word, count(*) AS df FROM posts WHERE word IN (SELECT word FROM w) GROUP BY word),
rare AS (SELECT item_id, word FROM (SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY df, word) AS r FROM w JOIN k USING (word)) WHERE r <= 4),
hits AS (SELECT item_id, doc_id, count(*) AS hits FROM posts JOIN rare USING (word) GROUP BY ALL)"""


def hits_sql(n: int, name: str = "hits") -> str:
    return f"""{name}_k AS (SELECT item_id, {grams_sql('t', n)} AS g FROM (SELECT item_id, {tokens_sql('text')} AS t FROM benchmark)),
{name}_d AS (SELECT doc_id, unnest({grams_sql('t', n)}) AS gram FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)),
{name} AS (SELECT item_id, doc_id, count(*) AS hits, round(count(*) / any_value(size), 6) AS coverage
 FROM {name}_d JOIN (SELECT item_id, len(g) AS size, unnest(g) AS gram FROM {name}_k) USING (gram) GROUP BY item_id, doc_id)"""


UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings)"
SCORED = f"""{UNIT}, s AS (SELECT q.vec_id AS query_id, u.vec_id, q.label = u.label AS own, round(list_dot_product(u.v, q.v), 6) AS score FROM u JOIN u AS q ON q.vec_id % 100 = 0 AND q.vec_id <> u.vec_id)"""

ORACLE_SQL = {
    "passages": f"WITH {PASSAGES} SELECT version, book, chapter, verse, md5(text) AS md5 FROM p",
    "passage_ranges": f"WITH {PASSAGES} SELECT chapter, md5(string_agg(text, ' ' ORDER BY verse)) AS md5 FROM p WHERE verse BETWEEN 2 AND 4 GROUP BY chapter",
    "translations": f"""WITH {PASSAGES}, f AS (SELECT book, verse, version, arg_min(text, chapter) AS text FROM p GROUP BY ALL)
SELECT book, verse, count(*) AS versions, md5(string_agg(text, '|' ORDER BY version)) AS md5 FROM f GROUP BY book, verse""",
    "passage_neighbours": f"""WITH {PASSAGES} SELECT a.chapter, a.verse, CAST(length(n.text) AS BIGINT) AS next_length, CAST(length(b.text) AS BIGINT) AS previous_length FROM p a
LEFT JOIN p n ON n.chapter = a.chapter AND n.verse = a.verse + 1 LEFT JOIN p b ON b.chapter = a.chapter AND b.verse = a.verse - 1""",
    "joined_pairs": f"WITH {PASSAGES} SELECT a.chapter, a.verse, md5(a.text || ' ' || n.text) AS md5 FROM p a JOIN p n ON n.chapter = a.chapter AND n.verse = a.verse + 1",
    "neighbour_numbers": f"""WITH {PASSAGES}, m AS (SELECT chapter, max(verse) AS last FROM p GROUP BY chapter),
r AS (SELECT chapter, verse, last, greatest(1, least(verse - 5, last - 10)) AS low FROM p JOIN m USING (chapter))
SELECT chapter, verse, array_to_string(list_filter(range(low, least(last, low + 10) + 1), lambda x: x <> verse), ',') AS numbers FROM r""",
    "import_validation": """WITH l AS (SELECT *, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS lines FROM documents)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS verses, CASE WHEN text IS NULL THEN 'no text' WHEN len(lines) = 0 THEN 'no passage' WHEN trim(coalesce(source, '')) = '' THEN 'no name' ELSE '' END AS reason FROM l""",
    "sigil_check": """WITH g AS (SELECT DISTINCT source, upper(regexp_replace(source, '[^A-Za-z0-9]', '', 'g')) AS sigil FROM documents)
SELECT source, sigil, regexp_full_match(sigil, '[A-Z0-9]{2,8}') AND sigil NOT IN ('SRC0', 'SRC1') AS valid FROM g""",
    "corpus_counts": f"""WITH {PASSAGES}, c AS (SELECT version, count(DISTINCT book) AS books, count(DISTINCT chapter) AS chapters, count(*) AS verses FROM p GROUP BY version)
SELECT *, substring(sha256(concat_ws(':', version, books, chapters, verses)), 1, 16) AS fingerprint FROM c""",
    "word_weights": f"""WITH {POSTS}, c AS (SELECT word, count(*) AS df FROM posts GROUP BY word), n AS (SELECT count(*) AS n FROM documents)
SELECT word, df, round(ln((n + 1) / (df + 1)), 6) AS idf, round(1 + sqrt(greatest(0.0, ln((n + 1) / (df + 1)))), 6) AS weight FROM c, n""",
    "posting_intersection": f"WITH {RARE}, need AS (SELECT item_id, count(*) AS need FROM rare GROUP BY item_id) SELECT item_id, doc_id, hits FROM hits JOIN need USING (item_id) WHERE hits = need",
    "posting_union": f"WITH {RARE} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS rank FROM hits) WHERE rank <= 3000",
    "gram_hits": f"WITH {hits_sql(3)} SELECT item_id, doc_id, hits, coverage FROM hits",
    "quotation_detection": f"""WITH {hits_sql(5)}, b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coverage DESC, hits DESC, item_id) AS r FROM hits WHERE coverage >= 0.55)
SELECT doc_id, item_id, hits, coverage, CASE WHEN coverage >= 1 THEN 'exact' ELSE 'partial' END AS method FROM b WHERE r = 1""",
    "contained_items": f"""SELECT item_id, doc_id FROM (SELECT item_id, {fragment_sql('text')} AS part FROM benchmark) JOIN (SELECT doc_id, {fragment_sql('text')} AS whole FROM documents)
ON contains(' ' || whole || ' ', ' ' || part || ' ') AND len(string_split(part, ' ')) >= 5""",
    "similar_words": f"""WITH {POSTS}, v AS (SELECT DISTINCT word FROM posts), t AS (SELECT DISTINCT unnest({tokens_sql('text')}) AS word FROM conversations),
u AS (SELECT word FROM t WHERE length(word) >= 4 AND word NOT IN (SELECT word FROM v)),
s AS (SELECT u.word, v.word AS match, round(1 - levenshtein(u.word, v.word) / greatest(length(u.word), length(v.word)), 6) AS score FROM u JOIN v ON substring(u.word, 1, 3) = substring(v.word, 1, 3))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, match) AS rank FROM s WHERE score >= 0.72) WHERE rank <= 4""",
    "vector_topk": f"WITH {SCORED} SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5",
    "vector_scoped_topk": f"WITH {SCORED} SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE own) WHERE rank <= 5",
    "vector_gap_and_lag": f"""WITH {SCORED}, o AS (SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS r FROM s WHERE own),
b AS (SELECT query_id, max(score) AS best, min(score) FILTER (r = 2) AS second FROM o WHERE r <= 2 GROUP BY query_id), t AS (SELECT query_id, max(score) AS top FROM s GROUP BY query_id)
SELECT query_id, best, round(best - second, 5) AS gap, round(top - best, 5) AS behind FROM b JOIN t USING (query_id)""",
}
