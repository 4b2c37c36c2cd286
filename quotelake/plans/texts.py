"""Queries of the text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quotelake.functions import text as X
from quotelake.plans.retrieval import fragment_sql, tokens_sql
from quotelake.plans.tables import table


def _turns(s, d):
    return table(s, d, "conversations")


def _with_previous(s, d):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return _turns(s, d).withColumn("before", before).where("before is not null")


def _sorted_md5(c):
    return F.md5(F.array_join(F.sort_array(c), " ").cast("binary"))


STOP = ("this", "that", "with", "from", "dans", "avec", "pour")


def retrieval_views(s, d):
    """The last words, more of them, and the last sentence of each turn, at least four words each, distinct, in order."""
    t = F.coalesce("text", F.lit(""))
    views = F.array_distinct(F.filter(F.array(X.last_words(t, 32), X.last_words(t, 46), X.last_sentence(t, 32)), lambda v: F.size(F.split(v, " ")) >= 4))
    return _turns(s, d).select("conv_id", "turn", F.posexplode(views).alias("no", "view")).select("conv_id", "turn", F.col("no").cast("long").alias("no"), F.md5(F.col("view").cast("binary")).alias("md5"))


def overlaps(s, d):
    own, before = X.stems(F.col("text"), 4, STOP), X.stems(F.col("before"), 4, STOP)
    return _with_previous(s, d).select("conv_id", "turn", F.size(own).cast("long").alias("stems"), F.round(X.overlap(own, before), 6).alias("overlap"))


def gram_overlaps(s, d):
    def shared(n):
        return F.size(F.array_intersect(X.ngrams(X.tokens(F.col("text")), n), X.ngrams(X.tokens(F.col("before")), n))).cast("long")

    return _with_previous(s, d).select("conv_id", "turn", shared(2).alias("bigrams"), shared(3).alias("trigrams"))


def coverages(s, d):
    return _with_previous(s, d).select("conv_id", "turn", F.round(X.ordered_coverage(X.tokens(F.col("text")), X.tokens(F.col("before"))), 6).alias("coverage"))


def versions(s, d):
    """Dotted numbers of parts against one of them, by their parts."""
    v = F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"))
    return table(s, d, "part").select("p_partkey", v.alias("version"), (X.version_parts(v) > X.version_parts(F.lit("25.5"))).alias("newer"))


def display_references(s, d):
    """Book, chapter and verse as one reference; a verse of 0 means the chapter."""
    e = table(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    verse = F.col("event_id") % 4
    return e.select("event_id", F.when(verse == 0, F.concat_ws(" ", "event_type", k)).otherwise(F.concat(F.concat_ws(" ", "event_type", k), F.lit(":"), verse.cast("string"))).alias("reference"))


def payloads(s, d):
    """The number in the first braces of a text around it."""
    e = table(s, d, "events").withColumn("noisy", F.concat(F.lit("answer: "), "props", F.lit(" end")))
    inner = F.regexp_extract("noisy", r"(?s)\{.*\}", 0)
    return e.select("event_id", F.get_json_object(inner, "$.k").cast("long").alias("k"))


QUERIES = {
    "fold_text": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(X.fragment(F.col("text")).cast("binary")).alias("fragment_md5"), F.length(X.reference_key(F.col("text"))).cast("long").alias("key_length")),
    "content_stems": lambda s, d: table(s, d, "documents").select("doc_id", F.size(X.stems(F.col("text"), 4, STOP)).cast("long").alias("n"), _sorted_md5(X.stems(F.col("text"), 4, STOP)).alias("md5")),
    "usable_segments": lambda s, d: _turns(s, d).select("conv_id", "turn", F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")).cast("long").alias("n_words")).withColumn("usable", F.col("n_words") >= 6),
    "retrieval_views": retrieval_views,
    "stem_overlap": overlaps,
    "gram_overlap": gram_overlaps,
    "ordered_coverage": coverages,
    "safe_names": lambda s, d: table(s, d, "part").select("p_partkey", X.safe_name(F.col("p_name"), "-2024.md").alias("name")),
    "version_compare": versions,
    "display_references": display_references,
    "json_payload": payloads,
}

PREVIOUS = "b AS (SELECT * FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL)"
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)


def _stems(x: str) -> str:
    return f"list_distinct(list_transform(list_filter({tokens_sql(x)}, lambda w: length(w) >= 4 AND w NOT IN ({STOP_SQL})), lambda w: substring(w, 1, 5)))"


def _grams(x: str, n: int) -> str:
    return f"list_transform(range(1, len({x}) - {n - 2}), lambda i: array_to_string(list_slice({x}, i, i + {n - 1}), ' '))"


def _last(x: str, n: int) -> str:
    words = f"list_filter(string_split_regex(trim({x}), '\\s+'), lambda w: w <> '')"
    return f"array_to_string(list_slice({words}, greatest(len({words}) - {n - 1}, 1), len({words})), ' ')"


ORACLE_SQL = {
    "fold_text": f"SELECT doc_id, md5({fragment_sql('text')}) AS fragment_md5, CAST(length(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]', '', 'g')) AS BIGINT) AS key_length FROM documents",
    "content_stems": f"SELECT doc_id, CAST(len({_stems('text')}) AS BIGINT) AS n, md5(array_to_string(list_sort({_stems('text')}), ' ')) AS md5 FROM documents",
    "usable_segments": "WITH c AS (SELECT conv_id, turn, CAST(len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) AS BIGINT) AS n_words FROM conversations) SELECT *, n_words >= 6 AS usable FROM c",
    "retrieval_views": f"""WITH p AS (SELECT conv_id, turn, text, list_filter(list_transform(string_split_regex(text, '[.!?;\\n]+'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM conversations),
q AS (SELECT *, coalesce(parts[len(parts)], '') AS last FROM p),
v AS (SELECT conv_id, turn, {_last('text', 32)} AS a, {_last('text', 46)} AS b,
 {_last("CASE WHEN len(string_split_regex(last, '\\s+')) < 4 AND len(parts) > 1 THEN parts[len(parts) - 1] || ' ' || last ELSE last END", 32)} AS c FROM q),
w AS (SELECT conv_id, turn, list_filter([a, b, c], lambda x, i: len(string_split(x, ' ')) >= 4 AND list_position([a, b, c], x) = i) AS views FROM v)
SELECT conv_id, turn, CAST(unnest(range(0, len(views))) AS BIGINT) AS no, md5(unnest(views)) AS md5 FROM w""",
    "stem_overlap": f"""WITH {PREVIOUS}, s AS (SELECT conv_id, turn, {_stems('text')} AS a, {_stems('before')} AS p FROM b)
SELECT conv_id, turn, CAST(len(a) AS BIGINT) AS stems, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, p)) / len(a), 6) ELSE 0.0 END AS overlap FROM s""",
    "gram_overlap": f"""WITH {PREVIOUS}, t AS (SELECT conv_id, turn, {tokens_sql('text')} AS a, {tokens_sql('before')} AS p FROM b)
SELECT conv_id, turn, CAST(len(list_distinct(list_intersect({_grams('a', 2)}, {_grams('p', 2)}))) AS BIGINT) AS bigrams, CAST(len(list_distinct(list_intersect({_grams('a', 3)}, {_grams('p', 3)}))) AS BIGINT) AS trigrams FROM t""",
    "safe_names": """WITH n AS (SELECT p_partkey, regexp_replace(regexp_replace(strip_accents(lower(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS c FROM part)
SELECT p_partkey, CASE WHEN c = '' THEN 'session' ELSE c END || '-2024.md' AS name FROM n""",
    "version_compare": "SELECT p_partkey, 'v' || p_size || '.' || (p_partkey % 10) AS version, p_size > 25 OR (p_size = 25 AND p_partkey % 10 > 5) AS newer FROM part",
    "display_references": "SELECT event_id, event_type || ' ' || json_extract_string(props, '$.k') || CASE WHEN event_id % 4 = 0 THEN '' ELSE ':' || (event_id % 4) END AS reference FROM events",
    "json_payload": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
}
