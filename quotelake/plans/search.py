"""Queries of search and decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.functions import text as X
from quotelake.functions import words as W
from quotelake.operators import decisions as D
from quotelake.operators import encoders as N
from quotelake.operators import passages as P
from quotelake.operators import retrieval as R
from quotelake.operators import typed as T
from quotelake.operators import vectors as V
from quotelake.plans.retrieval import PASSAGES, fragment_sql
from quotelake.plans.retrieval import ORACLE_SQL as RETRIEVAL
from quotelake.plans.speech import confirming
from quotelake.plans.tables import table
from quotelake.sources.files import shared_folder


def _mod(c, n):
    return F.pmod(F.col(c), F.lit(n))


def _passages(s, d):
    return P.from_documents(table(s, d, "documents"))


def _numbered(s, d):
    """Passages with one number each."""
    return _passages(s, d).select((F.col("chapter") * 100_000 + F.col("verse")).alias("id"), "text")


def _items(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text")


def _typed(s, d):
    """Fragments of items: some words from the middle, a third with a letter too many, a third a single word."""
    w = X.tokens(F.col("text"))
    part = F.slice(w, 3, 6)
    kind = _mod("item_id", 3)
    wrong = F.concat(F.substring(F.get(part, F.lit(0)), 1, 2), F.lit("q"), F.expr("substring(get(p, 0), 3)"))
    rows = table(s, d, "benchmark").withColumn("p", part)
    text = F.when(kind == 0, F.array_join("p", " ")).when(kind == 1, F.concat(wrong, F.lit(" "), F.array_join(F.slice("p", 2, 5), " "))).otherwise(F.get("p", F.lit(1)))
    return rows.select(F.col("item_id").alias("query_id"), text.alias("text"))


def _quotes(s, d):
    """A part of the second line of each rated document, to be found in it."""
    second = F.col("verse") == 2
    rows = _passages(s, d).where(second).join(table(s, d, "labels").select(F.col("doc_id").alias("chapter")).distinct(), "chapter")
    return rows.select(F.col("chapter").alias("quote_id"), "book", "chapter", F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 2, 7), " ").alias("text"))


def _lists(s, d):
    """Candidates of users from three sources of `events`."""
    k = F.get_json_object("props", "$.k").cast("long")
    tier = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "error", 1).otherwise(2)
    return table(s, d, "events").select("user_id", tier.alias("tier"), F.round("value", 3).alias("score"), F.col("event_id").alias("place"), F.concat(F.lit("r"), (k % 25).cast("string")).alias("reference"))


def _suggested(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.min("event_id").alias("place")).select("user_id", F.lit(0.9).alias("score"), "place", F.lit("s").alias("reference"))


def _unified(s, d):
    lists = _lists(s, d).withColumn("score", F.round(F.col("score") / 200, 6))
    return D.merged(D.with_scorer(lists, _suggested(s, d), "user_id"), "user_id", 12).select("user_id", "rank", "reference", "tier", "score")


def _cascades(s, d):
    stage = F.element_at(F.array(*map(F.lit, ("explicit", "conflict", "chapter", "anchored", "hybrid", "contextual", "last"))), (_mod("event_id", 7) + 1).cast("int"))
    rows = table(s, d, "events").select("user_id", F.to_date("ts").alias("day"), stage.alias("stage"), F.col("event_type").alias("reference"))
    return D.cascade(rows.select(F.struct("user_id", "day").alias("u"), "stage", "reference"), "u").select("u.*", "stage", "reference")


def _windows(s, d):
    rows = table(s, d, "events").select("user_id", (_mod("event_id", 3) == 0).alias("agreement"), (_mod("event_id", 5) / 5).alias("overlap"), F.round("value", 2).alias("confidence"), F.col("event_id").alias("place"))
    return D.best_window(rows, "user_id")


def _conflicts(s, d):
    e = table(s, d, "events")
    part = lambda n: _mod("event_id", n) / n
    found = D.conflicts(part(11), part(5), _mod("event_id", 3) == 0, part(7), 0.9 + part(13) / 10, _mod("event_id", 9), _mod("event_id", 2) == 0, floor=0.8385)
    return e.select("event_id", found.alias("conflict"))


def _anchored(s, d):
    found = R.gap_and_lag(table(s, d, "embeddings"))
    return found.select("query_id", "best", ((F.col("best") >= 0.3) & (F.col("gap") >= 0.012) & (F.col("behind") <= 0.02)).alias("accepted"))


class Vowels:
    """An encoder that counts vowels; any model with `embed` can stand here."""

    def embed(self, texts, kind):
        return [[t.lower().count(c) for c in "aei"] for t in texts]


def _stored_vectors(s, d):
    """Encoded on the first call, read on the second."""
    root = shared_folder(s, "vectors")
    texts = table(s, d, "conversations").select((F.col("conv_id") * 1_000 + F.col("turn")).alias("id"), "text")
    N.stored(texts, Vowels(), "all", "vowels", root)
    return N.stored(texts, None, "all", "vowels", root).select("id", *(F.get("v", F.lit(i)).cast("long").alias(c) for i, c in enumerate("aei")))


def _slices(s, d):
    """The chapters of rated documents, by the row map alone."""
    p = _passages(s, d).where("book is not null")
    rows = P.chapter_rows(p)
    asked = table(s, d, "labels").join(rows.select("book", "chapter"), F.col("doc_id") == F.col("chapter")).select("book", "chapter")
    return P.sliced(P.numbered_rows(p, rows).select("row", "verse"), rows, asked).select("book", "chapter", "verse", "row")


QUERIES = {
    "chapter_rows": lambda s, d: P.chapter_rows(_passages(s, d).where("book is not null")),
    "chapter_slices": _slices,
    "stored_vectors": _stored_vectors,
    "hashed_search": lambda s, d: V.hashed_search(_items(s, d), _numbered(s, d), 5, 0.45).withColumnRenamed("id", "passage_id"),
    "typed_search": lambda s, d: T.search(_typed(s, d), _passages(s, d), "fr").select("query_id", "rank", "chapter", "verse", "verse_end", "score", "method"),
    "close_words": lambda s, d: T.close_words(R.postings(table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), "text")).select("word").distinct(), R.postings(table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")).select("word").distinct()),
    "verse_of_chapter": lambda s, d: D.verse_of_chapter(_quotes(s, d), _passages(s, d)),
    "first_words_index": lambda s, d: D.first_words(_passages(s, d)),
    "first_words_search": lambda s, d: D.by_first_words(_items(s, d), D.first_words(_passages(s, d))),
    "first_contained": lambda s, d: R.contained(table(s, d, "benchmark"), table(s, d, "documents")).groupBy("doc_id").agg(F.min("item_id").alias("item_id")),
    "unified_search": _unified,
    "candidate_palette": lambda s, d: D.merged(_lists(s, d).withColumn("score", F.lit(0.0)), "user_id", 6).select("user_id", "rank", "reference", "tier"),
    "decision_cascade": _cascades,
    "window_decisions": _windows,
    "explicit_conflicts": _conflicts,
    "anchored_decisions": _anchored,
    "following_verses": lambda s, d: D.following(_passages(s, d), table(s, d, "labels").join(_passages(s, d).select("book", "chapter").distinct(), F.col("doc_id") == F.col("chapter")).select(F.col("doc_id").alias("ask_id"), "book", "chapter", F.lit(2).cast("long").alias("verse")).distinct()).select("ask_id", "place", "verse", F.md5(F.col("text").cast("binary")).alias("md5")),
    "vector_over_floor": lambda s, d: R.nearest(table(s, d, "embeddings"), 5).where(F.col("score") >= 0.5).select("query_id", "vec_id", "score", "rank"),
    "vector_pair_search": lambda s, d: R.nearest(table(s, d, "embeddings"), 2).select("query_id", "vec_id", "rank"),
    "unknown_word_weights": lambda s, d: R.with_unknown(R.weights(R.postings(table(s, d, "documents")), table(s, d, "documents").agg(F.count("*").alias("n"))), table(s, d, "documents").agg(F.count("*").alias("n")), R.postings(table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), "text")).select("word").distinct()),
}

INDEX = "trim(regexp_replace(regexp_replace(strip_accents(lower({0})), '[^\\p{{L}}\\p{{N}}_\\s'']', ' ', 'g'), '\\s+', ' ', 'g'))"
WORDS = "list_filter(string_split_regex(replace(" + INDEX + ", '''', ' '), '\\s+'), lambda w: w <> '')"
GRAMS = "list_distinct(list_transform(range(1, len({0}) - {2}), lambda i: array_to_string(list_slice({0}, i, i + {1}), ' ')))"
STOP = ", ".join(f"'{w}'" for w in sorted(W.INDEX_STOP))
FIRST = f"""{PASSAGES}, w AS (SELECT version, book, chapter, verse, string_split({INDEX.format('text')}, ' ') AS w FROM p),
k AS (SELECT version, book, chapter, verse, w[1:5] AS k FROM w WHERE len(w) >= 5 UNION ALL SELECT version, book, chapter, verse, w[2:6] FROM w WHERE len(w) >= 6 AND w[1] IN ({', '.join(f"'{c}'" for c in W.CONJUNCTIONS)})),
x AS (SELECT array_to_string(k, ' ') AS key, min(struct_pack(version := version, book := book, chapter := chapter, verse := verse)) AS p FROM k WHERE len(list_filter(k, lambda w: length(w) >= 3 AND w NOT IN ({STOP}))) >= 2 GROUP BY 1)"""
TIERS = "l AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS tier, round(value, 3) AS score, event_id AS place, 'r' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 25) AS reference FROM events)"
CONTAINED = RETRIEVAL["contained_items"]

ORACLE_SQL = {
    "chapter_rows": f"""WITH {PASSAGES}, c AS (SELECT book, chapter, count(DISTINCT verse) AS n FROM p WHERE book IS NOT NULL GROUP BY book, chapter)
SELECT book, chapter, CAST(sum(n) OVER (ORDER BY book, chapter) - n AS BIGINT) AS first, n FROM c""",
    "chapter_slices": f"""WITH {PASSAGES}, v AS (SELECT DISTINCT book, chapter, verse FROM p WHERE book IS NOT NULL), r AS (SELECT *, row_number() OVER (ORDER BY book, chapter, verse) - 1 AS row FROM v)
SELECT * FROM r WHERE chapter IN (SELECT doc_id FROM labels)""",
    "stored_vectors": "SELECT conv_id * 1000 + turn AS id, " + ", ".join(f"length(text) - length(replace(lower(text), '{c}', '')) AS {c}" for c in "aei") + " FROM conversations",
    "verse_of_chapter": f"""WITH {PASSAGES}, q AS (SELECT chapter AS quote_id, book, chapter, array_to_string(list_slice(string_split_regex(trim(text), '\\s+'), 2, 8), ' ') AS t FROM p WHERE verse = 2 AND chapter IN (SELECT doc_id FROM labels)),
r AS (SELECT quote_id, book, chapter, {WORDS.format('t')} AS w, {confirming('t')} AS s FROM q), v AS (SELECT book, chapter, verse, {WORDS.format('text')} AS w, {confirming('text')} AS s FROM p),
h AS (SELECT quote_id, book, chapter, verse, len(list_intersect({GRAMS.format('r.w', 2, 1)}, {GRAMS.format('v.w', 2, 1)})) AS three, len(list_intersect({GRAMS.format('r.w', 1, 0)}, {GRAMS.format('v.w', 1, 0)})) AS two,
 len(list_intersect(r.s, v.s)) AS stems, CASE WHEN len(r.s) > 0 THEN len(list_intersect(r.s, v.s)) / len(r.s) ELSE 0.0 END AS cover FROM r JOIN v USING (book, chapter)),
e AS (SELECT * FROM h WHERE three >= 1 OR (two >= 2 AND stems >= 1) OR (stems >= 2 AND cover >= 0.45) QUALIFY row_number() OVER (PARTITION BY quote_id ORDER BY three DESC, stems DESC, cover DESC, two DESC, verse) = 1)
SELECT quote_id, book, chapter, verse, round(least(0.98, greatest(0.85, 0.80 + (three + two) * 0.03 + cover * 0.12)), 4) AS confidence FROM e""",
    "first_words_index": f"WITH {FIRST} SELECT key, x.p.version AS version, x.p.book AS book, x.p.chapter AS chapter, x.p.verse AS verse FROM x",
    "first_words_search": f"""WITH {FIRST}, i AS (SELECT item_id AS id, string_split({INDEX.format('text')}, ' ') AS w FROM benchmark), g AS (SELECT id, CAST(unnest(range(0, len(w) - 4)) AS BIGINT) AS pos, w FROM i),
f AS (SELECT id, pos, x.p AS q FROM g JOIN x ON key = array_to_string(w[pos + 1:pos + 5], ' ') QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos DESC) = 1)
SELECT id, f.q.version AS version, f.q.book AS book, f.q.chapter AS chapter, f.q.verse AS verse, pos AS "at" FROM f""",
    "first_contained": f"WITH c AS ({CONTAINED}) SELECT doc_id, min(item_id) AS item_id FROM c GROUP BY doc_id",
    "unified_search": f"""WITH {TIERS}, n AS (SELECT user_id, tier, round(score / 200, 6) AS score, place, reference FROM l), b AS (SELECT user_id, max(score) FILTER (tier = 2) AS best, min(place) AS place FROM n GROUP BY user_id),
a AS (SELECT * FROM n UNION ALL SELECT user_id, CASE WHEN coalesce(best, 0) < 0.75 THEN -1 ELSE 3 END, 0.9, place, 's' FROM b),
f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY user_id, reference ORDER BY tier, score DESC, place) = 1)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY tier, score DESC, place) AS rank, reference, tier, score FROM f QUALIFY rank <= 12""",
    "candidate_palette": f"""WITH {TIERS}, f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY user_id, reference ORDER BY tier, place) = 1)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY tier, place) AS rank, reference, tier FROM f QUALIFY rank <= 6""",
    "decision_cascade": """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, ['explicit', 'conflict', 'chapter', 'anchored', 'hybrid', 'contextual', 'last'][event_id % 7 + 1] AS stage, event_type AS reference FROM events)
SELECT user_id, day, stage, reference FROM s QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY list_position(['conflict', 'explicit', 'anchored', 'hybrid', 'contextual', 'last', 'chapter'], stage), reference) = 1""",
    "window_decisions": """SELECT user_id, event_id % 3 = 0 AS agreement, (event_id % 5) / 5 AS overlap, round(value, 2) AS confidence, event_id AS place FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 = 0 DESC, event_id % 5 DESC, round(value, 2) DESC, event_id) = 1""",
    "explicit_conflicts": """SELECT event_id, event_id % 2 <> 0 AND event_id % 9 >= 4 AND (event_id % 3 = 0 OR ((event_id % 11) / 11 >= 0.9 AND (event_id % 7) / 7 >= 0.8385)) AND (event_id % 11) / 11 >= 0.72 AND 0.9 + (event_id % 13) / 13 / 10 >= 0.94 AND (event_id % 5) / 5 <= 0.2 AS conflict FROM events""",
    "anchored_decisions": f"WITH g AS ({RETRIEVAL['vector_gap_and_lag']}) SELECT query_id, best, best >= 0.3 AND gap >= 0.012 AND behind <= 0.02 AS accepted FROM g",
    "following_verses": f"WITH {PASSAGES} SELECT chapter AS ask_id, verse - 2 AS place, verse, md5(text) AS md5 FROM p WHERE verse BETWEEN 2 AND 4 AND chapter IN (SELECT doc_id FROM labels)",
    "vector_over_floor": f"WITH t AS ({RETRIEVAL['vector_topk']}) SELECT * FROM t WHERE score >= 0.5",
    "vector_pair_search": f"WITH t AS ({RETRIEVAL['vector_topk']}) SELECT query_id, vec_id, rank FROM t WHERE rank <= 2",
    "unknown_word_weights": f"""WITH c AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split({fragment_sql('text')}, ' '), lambda w: w <> ''))) AS word FROM documents), k AS (SELECT word, count(*) AS df FROM c GROUP BY word),
t AS (SELECT DISTINCT unnest(list_filter(string_split({fragment_sql('text')}, ' '), lambda w: w <> '')) AS word FROM conversations), n AS (SELECT count(*) AS n FROM documents)
SELECT word, round(CASE WHEN df IS NULL THEN 1 + sqrt(0.6 * ln(n.n + 1)) ELSE 1 + sqrt(greatest(0.0, ln((n.n + 1) / (df + 1)))) END, 6) AS weight FROM t LEFT JOIN k USING (word), n""",
}
