"""Queries of what is said: normal forms, gates, reading along, growing transcripts, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quotelake.functions import text as X
from quotelake.functions import words as W
from quotelake.operators import fusion as U
from quotelake.operators import sessions as S
from quotelake.plans.retrieval import fragment_sql, tokens_sql
from quotelake.plans.tables import table

def _order():
    return Window.partitionBy("conv_id").orderBy("turn")



LEADS = ["Comme il est écrit : ", "l'apôtre Paul nous dit ", "La Bible dit ", ""]


def _turns(s, d):
    return table(s, d, "conversations")


def _before(s, d):
    rows = _turns(s, d).withColumn("before", F.lag("text").over(_order())).withColumn("earlier", F.lag("text", 2).over(_order()))
    return rows.where("before is not null")


def _md5(c):
    return F.md5(c.cast("binary"))


def _joined(c):
    return _md5(F.array_join(c, " "))


def _set(c):
    return _md5(F.array_join(F.sort_array(c), " "))


def _long(c):
    return c.cast("long")


def gates(s, d):
    """Which searches a turn is long enough for."""
    n, significant = F.size(X.tokens(F.col("text"))), F.size(X.significant(F.col("text")))
    return _turns(s, d).select("conv_id", "turn", (n >= 4).alias("live"), (n >= 2).alias("typed"), (significant >= 4).alias("hashed"), (n >= 5).alias("anchored"), (F.length("text") >= 12).alias("semantic_passage"), (F.length("text") >= 15).alias("hashed_passage"))


def attributed(s, d):
    lead = F.element_at(F.array(*map(F.lit, LEADS)), _mod("turn", 4) + 1)
    return _turns(s, d).select("conv_id", "turn", _md5(X.without_attribution(F.concat(lead, "text"))).alias("md5"))


def _mod(c, n):
    return F.pmod(F.col(c), F.lit(n)).cast("int")


def subject(s, d):
    context = [F.lag("text", i).over(_order()) for i in (1, 2, 3)]
    return _turns(s, d).select("conv_id", "turn", X.on_subject(F.col("text"), *context).alias("on_subject"))


def matches(s, d):
    t = X.tokens(F.col("text"))
    pairs = X.bound(t, lambda w: F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: (i < F.size(w)) & X.words_match(F.get(w, i - 1), F.get(w, i)))))
    return _turns(s, d).select("conv_id", "turn", _long(pairs).alias("matches"))


def highlights(s, d):
    marked = X.highlighted(F.col("text"), F.col("before"))
    return _before(s, d).select("conv_id", "turn", _md5(F.array_join(F.transform(F.filter(marked, lambda m: m["hit"]), lambda m: m["word"]), " ")).alias("md5"))


def readings(s, d):
    r = X.reading(X.tokens(F.col("text")), X.tokens(F.col("before")))
    return _before(s, d).withColumn("r", r).select("conv_id", "turn", F.round("r.ratio", 6).alias("ratio"), F.col("r.tail").alias("tail"))


def growing(s, d):
    """The turn's text after a first part of it, or after something else."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    before = F.when(_mod("turn", 3) == 0, F.lit("Anything else")).otherwise(F.array_join(F.slice(words, 1, 1 + _mod("turn", 7)), " "))
    return _turns(s, d).select("conv_id", "turn", _md5(X.new_words(before, F.col("text"))).alias("md5"))


def clocks(s, d):
    iso, spaced = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    kind = _mod("event_id", 4)
    return table(s, d, "events").select("event_id", X.clock(F.when(kind == 0, iso).when(kind == 1, spaced).when(kind == 2, "soon")).alias("clock"))


def calibration(s, d):
    """Threshold, margin and floor of the model that a row names; others have the defaults."""
    model = F.element_at(F.array(*map(F.lit, ("e5-base", "e5-small", "other"))), _mod("event_id", 3) + 1)
    return U.calibration(table(s, d, "events").select("event_id", model.alias("model")), "model").select("event_id", "threshold", "margin", "floor")


def best_overlaps(s, d):
    return _before(s, d).select("conv_id", "turn", F.round(X.best_overlap(F.col("text"), F.array("before", F.coalesce("earlier", F.lit("")))), 6).alias("overlap"))


QUERIES = {
    "index_text": lambda s, d: _turns(s, d).select("conv_id", "turn", _md5(X.indexed(F.col("text"))).alias("md5")),
    "significant_words": lambda s, d: _turns(s, d).select("conv_id", "turn", _long(F.size(X.significant(F.col("text")))).alias("n"), _joined(X.significant(F.col("text"))).alias("md5")),
    "cache_keys": lambda s, d: table(s, d, "documents").select("doc_id", _md5(X.cache_key(F.col("text"))).alias("md5")),
    "confirming_stems": lambda s, d: _turns(s, d).select("conv_id", "turn", _long(F.size(X.content_stems(F.col("text")))).alias("n"), _set(X.content_stems(F.col("text"))).alias("md5")),
    "attribution_stripping": attributed,
    "subject_gate": subject,
    "length_gates": gates,
    "reading_tokens": lambda s, d: _turns(s, d).select("conv_id", "turn", _joined(X.shown_tokens(F.col("text"))).alias("shown_md5"), _joined(X.spoken_tokens(F.concat(F.lit("l ' a b "), "text"))).alias("spoken_md5")),
    "word_matches": matches,
    "highlights": highlights,
    "reading_coverage": readings,
    "safe_ends": lambda s, d: _turns(s, d).select("conv_id", "turn", _long(X.safe_end(F.col("text"), 300)).alias("final"), _long(X.safe_end(F.regexp_replace("text", "[.!?…]", ""), 60)).alias("without_ends")),
    "new_words": growing,
    "clock_texts": clocks,
    "recent_windows": lambda s, d: _turns(s, d).select("conv_id", "turn", _md5(X.last_sentence(F.col("text"), 22)).alias("md5")),
    "word_buffer": lambda s, d: S.buffered(_turns(s, d), 40).select("conv_id", "turn", _md5(F.col("buffer")).alias("md5")),
    "first_windows": lambda s, d: S.first_seen(S.word_windows(_turns(s, d)).withColumn("word", F.lower(F.regexp_extract("window", r"(\S+)$", 1))), ["conv_id", "word"], ["turn", "end"]).select("conv_id", "word", "turn", "end"),
    "model_calibration": calibration,
    "hashed_confidence": lambda s, d: table(s, d, "events").select("event_id", U.hashed_confidence(F.round(F.col("value") / 1000, 4)).alias("confidence")),
    "best_overlaps": best_overlaps,
}


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


WS = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"
BEFORE = "b AS (SELECT * FROM (SELECT conv_id, turn, text, lag(text) OVER o AS before, lag(text, 2) OVER o AS earlier FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)) WHERE before IS NOT NULL)"
CLEAN = "regexp_replace(strip_accents(lower({0})), '[^A-Za-z0-9_\\s]', '', 'g')"


def confirming(x: str) -> str:
    words = f"string_split(trim(regexp_replace(regexp_replace(strip_accents(lower({x})), '[''-]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')"
    bare = f"list_transform({words}, lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
    kept = f"list_filter({bare}, lambda w: length(w) >= 4 AND w NOT IN ({_in(W.STEM_STOP)}))"
    return f"list_distinct(list_filter(list_transform({kept}, lambda w: substring(w, 1, 5)), lambda w: w NOT IN ({_in(W.WEAK_STEMS)})))"


SIGNIFICANT = f"list_filter({tokens_sql('text')}, lambda w: length(w) >= 3 AND w NOT IN ({_in(W.HASH_STOP)}))"


def _shown(x: str) -> str:
    return f"list_transform({WS.format(x)}, lambda w: regexp_replace(strip_accents(lower(w)), '[^a-z0-9]', '', 'g'))"


ORACLE_SQL = {
    "index_text": "SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}_\\s'']', ' ', 'g'), '\\s+', ' ', 'g'))) AS md5 FROM conversations",
    "significant_words": f"SELECT conv_id, turn, CAST(len({SIGNIFICANT}) AS BIGINT) AS n, md5(array_to_string({SIGNIFICANT}, ' ')) AS md5 FROM conversations",
    "cache_keys": "SELECT doc_id, md5(substring(trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g')), 1, 1200)) AS md5 FROM documents",
    "confirming_stems": f"SELECT conv_id, turn, CAST(len({confirming('text')}) AS BIGINT) AS n, md5(array_to_string(list_sort({confirming('text')}), ' ')) AS md5 FROM conversations",
    "attribution_stripping": "SELECT conv_id, turn, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS md5 FROM conversations",
    "subject_gate": f"""SELECT conv_id, turn, regexp_matches(lower(concat_ws(' ', text, lag(text) OVER o, lag(text, 2) OVER o, lag(text, 3) OVER o)), '{'|'.join(W.SUBJECT_WORDS)}') AS on_subject
FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)""",
    "length_gates": f"""WITH c AS (SELECT *, len({tokens_sql('text')}) AS n FROM conversations)
SELECT conv_id, turn, n >= 4 AS live, n >= 2 AS typed, len({SIGNIFICANT}) >= 4 AS hashed, n >= 5 AS anchored, length(text) >= 12 AS semantic_passage, length(text) >= 15 AS hashed_passage FROM c""",
    "reading_tokens": f"""SELECT conv_id, turn, md5(array_to_string({_shown('text')}, ' ')) AS shown_md5,
 md5(regexp_replace('l a b ' || array_to_string(list_filter({_shown('text')}, lambda w: w <> ''), ' '), '(^| )(\\S) (\\S+)', '\\1\\2\\3', 'g')) AS spoken_md5 FROM conversations""",
    "word_matches": f"""WITH t AS (SELECT conv_id, turn, {tokens_sql('text')} AS t FROM conversations)
SELECT conv_id, turn, CAST(len(list_filter(range(1, len(t)), lambda i: t[i] = t[i + 1] OR (length(t[i]) >= 4 AND length(t[i + 1]) >= 4 AND substring(t[i], 1, 4) = substring(t[i + 1], 1, 4)))) AS BIGINT) AS matches FROM t""",
    "highlights": f"""WITH {BEFORE}, c AS (SELECT conv_id, turn, {WS.format('text')} AS shown, list_filter(string_split_regex({CLEAN.format('before')}, '\\s+'), lambda w: length(w) > 2 AND w NOT IN ({_in(X.MARK_STOP)})) AS said FROM b)
SELECT conv_id, turn, md5(array_to_string(list_filter(shown, lambda w: length({CLEAN.format('w')}) > 2 AND list_contains(said, {CLEAN.format('w')})), ' ')) AS md5 FROM c""",
    "reading_coverage": f"""WITH {BEFORE}, t AS (SELECT conv_id, turn, {tokens_sql('text')} AS v, {tokens_sql('before')} AS p FROM b), c AS (SELECT *, list_slice(p, greatest(len(p) - 59, 1), len(p)) AS said, list_slice(v, greatest(len(v) - 4, 1), len(v)) AS tail FROM t)
SELECT conv_id, turn, CASE WHEN len(v) >= 4 THEN round(len(list_filter(v, lambda w: list_contains(said, w))) / len(v), 6) END AS ratio,
 CASE WHEN len(v) >= 4 THEN len(list_filter(tail, lambda w: list_contains(said, w))) >= least(4, len(tail)) END AS tail FROM c""",
    "safe_ends": """WITH c AS (SELECT conv_id, turn, text, length(regexp_extract(text, '(?s)^(.*[.!?…])', 1)) AS e, regexp_replace(text, '[.!?…]', '', 'g') AS bare FROM conversations)
SELECT conv_id, turn, CAST(CASE WHEN e > 0 AND trim(substring(text, e + 1)) <> '' THEN e WHEN e = 0 AND length(text) > 300 THEN length(regexp_extract(substring(text, 1, 300), '(?s)^(.*) [^ ]*$', 1)) ELSE 0 END AS BIGINT) AS final,
 CAST(CASE WHEN length(bare) > 60 THEN length(regexp_extract(substring(bare, 1, 60), '(?s)^(.*) [^ ]*$', 1)) ELSE 0 END AS BIGINT) AS without_ends FROM c""",
    "new_words": f"""WITH c AS (SELECT conv_id, turn, {WS.format('text')} AS w FROM conversations)
SELECT conv_id, turn, md5(array_to_string(CASE WHEN turn % 3 = 0 THEN w ELSE list_slice(w, 2 + turn % 7, len(w)) END, ' ')) AS md5 FROM c""",
    "clock_texts": "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN strftime(ts, '%H:%M') ELSE '' END AS clock FROM events",
    "recent_windows": """WITH p AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(text, '[.!?;\\n]+'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM conversations),
q AS (SELECT *, coalesce(parts[len(parts)], '') AS last FROM p),
w AS (SELECT conv_id, turn, list_filter(string_split_regex(CASE WHEN len(string_split_regex(last, '\\s+')) < 4 AND len(parts) > 1 THEN parts[len(parts) - 1] || ' ' || last ELSE last END, '\\s+'), lambda x: x <> '') AS w FROM q)
SELECT conv_id, turn, md5(array_to_string(list_slice(w, greatest(1, len(w) - 21), len(w)), ' ')) AS md5 FROM w""",
    "word_buffer": f"""WITH c AS (SELECT conv_id, turn, {WS.format('text')} AS w FROM conversations), u AS (SELECT conv_id, turn, flatten(list(w) OVER (PARTITION BY conv_id ORDER BY turn)) AS w, len(w) AS n FROM c)
SELECT conv_id, turn, md5(array_to_string(list_slice(w, greatest(1, len(w) - 39), len(w)), ' ')) AS md5 FROM u WHERE n > 0""",
    "first_windows": f"""WITH w AS (SELECT conv_id, turn, {WS.format('trim(text)')} AS w FROM conversations), e AS (SELECT *, CAST(unnest(range(6, len(w) + 1, 3)) AS BIGINT) AS "end" FROM w)
SELECT conv_id, lower(w["end"]) AS word, turn, "end" FROM e QUALIFY row_number() OVER (PARTITION BY conv_id, lower(w["end"]) ORDER BY turn, "end") = 1""",
    "model_calibration": """SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 0.865 ELSE 0.8385 END AS threshold, CASE WHEN event_id % 3 = 1 THEN 0.012 ELSE 0.005 END AS margin, CASE WHEN event_id % 3 = 1 THEN 0.835 ELSE 0.8085 END AS floor FROM events""",
    "hashed_confidence": "SELECT event_id, round(least(0.9, 0.55 + 0.35 * round(value / 1000, 4)), 2) AS confidence FROM events",
    "best_overlaps": f"""WITH {BEFORE}, c AS (SELECT conv_id, turn, {confirming('text')} AS a, {confirming('before')} AS p, {confirming("coalesce(earlier, '')")} AS q FROM b)
SELECT conv_id, turn, CASE WHEN len(a) > 0 THEN round(greatest(len(list_intersect(a, p)), len(list_intersect(a, q))) / len(a), 6) ELSE 0.0 END AS overlap FROM c""",
}
