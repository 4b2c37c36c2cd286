"""Queries of live operators: the stream of a table's files, replayed, with the SQL of its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.plans.sessions import ORACLE_SQL as SESSIONS
from quotelake.plans.tables import table
from quotelake.sources.files import shared_folder
from quotelake.operators import engine as E
from quotelake.streaming import live as L
from quotelake.streaming import timed as T

DAY = 86_400


def _stream(s, d, name, time=None):
    rows = table(s, d, name)
    path = f"{d}/{name}.parquet*"  # a pattern takes a file as well as a folder
    if time:
        return L.source(s, path, rows.schema)
    return s.readStream.schema(rows.schema).parquet(path)


def _events(s, d):
    return _stream(s, d, "events", "ts")


def _run(s, stream, mode="append"):
    return L.replay(stream, shared_folder(s, "stream"), mode)


def _words():
    return F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")).cast("long")


def _segments(s, d):
    return _stream(s, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), _words().alias("n_words"), (F.col("turn") % 5 == 0).alias("opens"))


def _read(rows):
    """Even turns are shown, odd ones said."""
    return rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("shown"), F.when(F.col("turn") % 2 == 1, F.col("text")).otherwise(F.expr("substring(text, 1, 60)")).alias("said"))


def _partials(s, d):
    rows = table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "text", (F.col("turn") % 3 == 0).alias("is_final"))
    return L.current(rows).select("session_id", "seq", "is_final")


def _shown(s, d):
    """Events as references to verses, against plans that customers have with the numbers of users."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = _events(s, d).select("ts", "event_id", F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.lit(1).cast("long").alias("place"), F.col("event_type").alias("book_abbr"), (k % 25).alias("chapter"), (F.col("event_id") % 4).alias("verse_start"), F.lit(None).cast("long").alias("verse_end"))
    verses = F.collect_set(F.col("c_custkey") % 4)
    plan = table(s, d, "customer").groupBy((F.col("c_custkey") % 150).alias("session_id"), F.lit("purchase").alias("book_abbr"), F.col("c_nationkey").cast("long").alias("chapter")).agg(verses.alias("verses"), F.lit(False).alias("whole"))
    shown, _ = T.replay(T.live(E.with_plan(rows, plan), T.shown_once(10 * DAY, 5 * DAY), key="session_id"), shared_folder(s, "stream"))
    return shown.select("session_id", "seq", "disputed")


def _utterances(s, d):
    """Transcripts that grow by five words a second, with a pause of two seconds after every twenty."""
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    rows = _stream(s, d, "conversations").where("conv_id is not null and turn is not null").select((F.col("conv_id") * 1_000 + F.col("turn")).alias("session_id"), "conv_id", "turn", words.alias("w")).where("size(w) > 0")
    rows = rows.select("session_id", "conv_id", "turn", "w", F.explode(F.sequence(F.lit(1).cast("long"), F.size("w").cast("long"), F.lit(5).cast("long"))).alias("seq"))
    at = F.lit(1_704_067_200) + F.col("conv_id") * 3_600 + F.col("turn") * 60 + F.col("seq") * 0.2 + F.floor(F.col("seq") / 20) * 2
    grown = rows.select("session_id", "seq", F.array_join(F.slice("w", 1, F.col("seq").cast("int")), " ").alias("text"), F.timestamp_seconds(at).alias("ts")).withWatermark("ts", L.LATE)
    return T.replay(T.live(grown, T.utterances(), key="session_id", row_id="seq"), shared_folder(s, "stream"))[0]


def _queue(s, d):
    rows = _stream(s, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "text", (F.col("turn") % 3 == 0).alias("is_final"), F.timestamp_seconds(F.col("conv_id")).alias("ts"))
    with T.stored_in(s):
        return _run(s, T.queued(rows.withWatermark("ts", L.LATE), most=3)).select("session_id", "seq", "is_final", F.md5(F.col("text").cast("binary")).alias("md5"))


QUERIES = {
    "live_shown": _shown,
    "live_utterances": _utterances,
    "live_queue": _queue,
    "live_dedup": lambda s, d: _run(s, L.emitted(_events(s, d), "user_id", "event_type", DAY)),
    "live_dedup_last": lambda s, d: _run(s, L.emitted(_events(s, d), "user_id", "event_type", DAY, only_last=True)),
    "live_contradictions": lambda s, d: _run(s, L.contradicted(_events(s, d), "user_id", "event_type", 3_600)),
    "live_anchors": lambda s, d: _run(s, L.anchored(_events(s, d), "user_id", "event_type", "purchase", DAY)),
    "live_health": lambda s, d: _run(s, L.health(_segments(s, d), window=3, mean=80, warm_up=2)),
    "live_latest": lambda s, d: _run(s, L.latest(_events(s, d), "user_id", "event_type")),
    "live_reading": lambda s, d: _run(s, L.reading(_read(_stream(s, d, "conversations")))).select("session_id", "seq", "matched", "total"),
    "reading_positions": lambda s, d: L.reading_positions(_read(table(s, d, "conversations"))),
    "live_partials": _partials,
}

ORACLE_SQL = {
    # rows that the watermark hasn't passed wait in the state
    "live_shown": """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, event_type AS book, CAST(json_extract_string(props, '$.k') AS BIGINT) % 25 AS chapter, event_id % 4 AS verse FROM events WHERE epoch_us(ts) < (SELECT epoch_ms(max(ts)) - 60000 FROM events) * 1000),
p AS (SELECT c_custkey % 150 AS user_id, 'purchase' AS book, c_nationkey AS chapter, list(DISTINCT c_custkey % 4) AS verses FROM customer GROUP BY ALL),
o AS (SELECT e.*, list_contains(verses, verse) AS in_plan, len(verses) > 0 AND NOT list_contains(verses, verse) AS off_plan, row_number() OVER (PARTITION BY e.user_id, e.book, e.chapter, verse ORDER BY ts, event_id) AS r FROM e LEFT JOIN p ON p.user_id = e.user_id AND p.book = e.book AND p.chapter = e.chapter),
f AS (SELECT *, ts AS last, true AS kept FROM o WHERE r = 1
 UNION ALL SELECT o.*, CASE WHEN o.ts - f.last >= INTERVAL 10 DAY THEN o.ts ELSE f.last END, o.ts - f.last >= INTERVAL 10 DAY FROM f JOIN o ON o.user_id = f.user_id AND o.book = f.book AND o.chapter = f.chapter AND o.verse = f.verse AND o.r = f.r + 1),
k AS (SELECT * FROM f WHERE kept), c AS (SELECT DISTINCT a.event_id FROM k a JOIN k b ON a.user_id = b.user_id AND a.book = b.book AND a.chapter = b.chapter AND a.verse <> b.verse AND (b.ts, b.event_id) < (a.ts, a.event_id) AND a.ts - b.ts < INTERVAL 5 DAY)
SELECT user_id AS session_id, event_id AS seq, (event_id IN (SELECT event_id FROM c) OR coalesce(off_plan, false)) AND NOT coalesce(in_plan, false) AS disputed FROM k""",
    "live_queue": """WITH w AS (SELECT *, turn % 3 = 0 AS is_final, count(*) FILTER (turn % 3 = 0) OVER (PARTITION BY conv_id) AS finals, max(turn) OVER (PARTITION BY conv_id) AS top, row_number() OVER (PARTITION BY conv_id, turn % 3 = 0 ORDER BY turn DESC) AS r FROM conversations)
SELECT conv_id AS session_id, turn AS seq, is_final, md5(text) AS md5 FROM w WHERE is_final OR r <= greatest(3 - finals, CASE WHEN top % 3 <> 0 THEN 1 ELSE 0 END)""",
    "live_dedup": """WITH RECURSIVE o AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
f AS (SELECT user_id, event_type, event_id, r, ts AS last, true AS kept FROM o WHERE r = 1
 UNION ALL SELECT o.user_id, o.event_type, o.event_id, o.r, CASE WHEN o.ts - f.last >= INTERVAL 86400 SECOND THEN o.ts ELSE f.last END, o.ts - f.last >= INTERVAL 86400 SECOND FROM f JOIN o ON o.user_id = f.user_id AND o.event_type = f.event_type AND o.r = f.r + 1)
SELECT user_id, event_id FROM f WHERE kept""",
    "live_dedup_last": """WITH RECURSIVE o AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
f AS (SELECT user_id, event_id, r, ts AS last, event_type AS ref, true AS kept FROM o WHERE r = 1
 UNION ALL SELECT o.user_id, o.event_id, o.r, CASE WHEN o.event_type = f.ref AND o.ts - f.last < INTERVAL 86400 SECOND THEN f.last ELSE o.ts END, CASE WHEN o.event_type = f.ref AND o.ts - f.last < INTERVAL 86400 SECOND THEN f.ref ELSE o.event_type END,
  NOT (o.event_type = f.ref AND o.ts - f.last < INTERVAL 86400 SECOND) FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1)
SELECT user_id, event_id FROM f WHERE kept""",
    "live_contradictions": SESSIONS["contradictions"],
    "live_anchors": SESSIONS["asof_anchor"],
    "live_health": """WITH n AS (SELECT conv_id AS session_id, turn AS seq, turn // 5 AS part, len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) AS n_words FROM conversations),
h AS (SELECT session_id, seq, part, round(avg(n_words) OVER w, 4) AS mean_words, count(*) OVER w < 2 OR avg(n_words) OVER w >= 80 AS reliable FROM n WHERE n_words > 0 WINDOW w AS (PARTITION BY session_id, part ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT session_id, seq, mean_words, reliable, reliable <> lag(reliable, 1, true) OVER (PARTITION BY session_id, part ORDER BY seq) AS flipped FROM h""",
    "live_latest": SESSIONS["latest_wins"],
    "live_partials": "SELECT conv_id AS session_id, turn AS seq, turn % 3 = 0 AS is_final FROM conversations QUALIFY turn % 3 = 0 OR turn = max(turn) OVER (PARTITION BY conv_id)",
}
