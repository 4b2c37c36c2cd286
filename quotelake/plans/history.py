"""Queries over the history of detections, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.operators import history as H
from quotelake.plans.tables import table

ANCHOR = "2024-01-31"
HIST = """WITH h AS (SELECT event_id AS id, ts AS detected_at, user_id AS session_id, concat_ws(' ', event_type, json_extract_string(props, '$.k')) AS reference,
 event_type AS book, CAST(json_extract_string(props, '$.k') AS BIGINT) AS chapter, value, props FROM events)"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.from_events(table(spark, sf_dir, "events"))


def _anchor():
    return F.lit(ANCHOR).cast("timestamp_ntz")


QUERIES = {
    "recent_activity": lambda s, d: H.recent(_history(s, d), 50).select("id", "reference", "detected_at"),
    "recent_of_session": lambda s, d: H.recent(_history(s, d), 20, 7).select("id", "reference", "detected_at"),
    "window_totals": lambda s, d: H.totals(_history(s, d), _anchor(), 29),
    "top_books": lambda s, d: H.top(_history(s, d), ["book"], 5),
    "top_references": lambda s, d: H.top(_history(s, d), ["reference"], 10),
    "daily_counts": lambda s, d: H.per_day(_history(s, d)),
    "daily_book_counts": lambda s, d: H.per_day(_history(s, d), ("book",)),
    "book_stats": lambda s, d: H.per_book(_history(s, d)),
    "day_stats": lambda s, d: H.day(_history(s, d), "2024-01-15"),
    "share_of_largest": lambda s, d: H.share_of_largest(_history(s, d)),
    "daily_rollup": lambda s, d: H.daily_rollup(_history(s, d)),
    "mark_latest": lambda s, d: H.mark_latest(_history(s, d)),
    "session_summary": lambda s, d: H.sessions(_history(s, d)),
    "last_values": lambda s, d: H.last_values(_history(s, d), "session_id", "reference", ["detected_at", "id"]),
    "retention": lambda s, d: H.retained(_history(s, d), _anchor(), 14),
    "stored_defaults": lambda s, d: H.defaults(_history(s, d), "props", 5),
    "projected_page": lambda s, d: H.projected_page(_history(s, d), 1000),
    "restored_queue": lambda s, d: H.queue(_history(s, d), 10, 30),
    "transcripts": lambda s, d: H.transcripts(table(s, d, "conversations")),
    "oscillations": lambda s, d: H.oscillations(_history(s, d), "session_id", ["detected_at", "id"], "book"),
}

ORACLE_SQL = {
    "recent_activity": f"{HIST} SELECT id, reference, detected_at FROM h ORDER BY detected_at DESC, id DESC LIMIT 50",
    "recent_of_session": f"{HIST} SELECT id, reference, detected_at FROM h WHERE session_id = 7 ORDER BY detected_at DESC, id DESC LIMIT 20",
    "window_totals": f"""{HIST}, w AS (SELECT count(*) AS total, count(DISTINCT reference) AS unique_references FROM h WHERE detected_at >= TIMESTAMP '{ANCHOR}' - INTERVAL 29 DAY),
n AS (SELECT count(*) AS sessions FROM (SELECT session_id, min(detected_at) AS m FROM h GROUP BY session_id) WHERE m >= TIMESTAMP '{ANCHOR}' - INTERVAL 29 DAY)
SELECT total, unique_references, sessions, CASE WHEN sessions > 0 THEN round(total / sessions, 4) ELSE 0.0 END AS avg_per_session FROM w, n""",
    "top_books": f"{HIST} SELECT book, count(*) AS n FROM h GROUP BY book ORDER BY n DESC, book LIMIT 5",
    "top_references": f"{HIST} SELECT reference, count(*) AS n FROM h GROUP BY reference ORDER BY n DESC, reference LIMIT 10",
    "daily_counts": f"{HIST} SELECT CAST(detected_at AS DATE) AS day, count(*) AS n FROM h GROUP BY 1",
    "daily_book_counts": f"{HIST} SELECT CAST(detected_at AS DATE) AS day, book, count(*) AS n FROM h GROUP BY 1, 2",
    "book_stats": f"{HIST} SELECT book, count(*) AS n, count(DISTINCT chapter) AS chapters, min(detected_at) AS first_at, max(detected_at) AS last_at FROM h GROUP BY book",
    "day_stats": f"{HIST} SELECT count(*) AS n, count(DISTINCT reference) AS unique_references, count(DISTINCT session_id) AS sessions FROM h WHERE CAST(detected_at AS DATE) = DATE '2024-01-15'",
    "share_of_largest": f"{HIST}, c AS (SELECT book, count(*) AS n FROM h GROUP BY book) SELECT book, n, round(n / max(n) OVER (), 6) AS ratio FROM c",
    "daily_rollup": f"""{HIST}, d AS (SELECT *, CAST(detected_at AS DATE) AS day FROM h),
b AS (SELECT day, book, row_number() OVER (PARTITION BY day ORDER BY count(*) DESC, book) AS r FROM d GROUP BY day, book),
f AS (SELECT day, reference, row_number() OVER (PARTITION BY day ORDER BY count(*) DESC, reference) AS r FROM d GROUP BY day, reference)
SELECT d.day, count(*) AS total, count(DISTINCT d.reference) AS unique_references, round(count(*) / count(DISTINCT session_id), 4) AS avg_per_session,
 any_value(b.book) AS most_cited_book, any_value(f.reference) AS most_cited_reference
FROM d JOIN b ON b.day = d.day AND b.r = 1 JOIN f ON f.day = d.day AND f.r = 1 GROUP BY d.day""",
    "mark_latest": f"{HIST} SELECT id, reference, row_number() OVER (PARTITION BY reference ORDER BY detected_at DESC, id DESC) = 1 AS projected FROM h",
    "session_summary": f"""{HIST} SELECT session_id, min(detected_at) AS started_at, max(detected_at) AS ended_at, count(*) AS n,
 CAST(floor(date_sub('second', min(detected_at), max(detected_at)) / 60) AS BIGINT) AS minutes FROM h GROUP BY session_id""",
    "last_values": f"{HIST} SELECT session_id, arg_max(reference, (detected_at, id)) AS reference FROM h GROUP BY session_id",
    "retention": f"""{HIST} SELECT book, count(*) FILTER (detected_at >= TIMESTAMP '{ANCHOR}' - INTERVAL 14 DAY) AS kept,
 count(*) FILTER (detected_at < TIMESTAMP '{ANCHOR}' - INTERVAL 14 DAY) AS dropped FROM h GROUP BY book""",
    "stored_defaults": f"{HIST} SELECT id, coalesce(chapter, 0) AS verse_start, CAST(floor(value * 100) AS BIGINT) AS confidence, substring(props, 1, 5) AS context_text FROM h",
    "projected_page": f"""{HIST}, p AS (SELECT * FROM h ORDER BY detected_at DESC, id DESC LIMIT 1000)
SELECT count(*) AS n, count(*) FILTER (value >= 50) AS projected, count(DISTINCT reference) AS unique_references FROM p""",
    "restored_queue": f"""{HIST}, p AS (SELECT * FROM h ORDER BY detected_at DESC, id DESC LIMIT 10)
SELECT id, reference, detected_at FROM p WHERE detected_at >= (SELECT max(detected_at) FROM p) - INTERVAL 30 MINUTE""",
    "transcripts": "SELECT conv_id, coalesce(string_agg(trim(text), ' ' ORDER BY turn, trim(text)) FILTER (trim(text) <> ''), '') AS transcript FROM conversations GROUP BY conv_id",
    "oscillations": f"""{HIST}, c AS (SELECT session_id, coalesce(CAST(lag(book) OVER (PARTITION BY session_id ORDER BY detected_at, id) <> book AS BIGINT), 0) AS changed FROM h)
SELECT session_id, count(*) AS n, CAST(sum(changed) AS BIGINT) AS changes FROM c GROUP BY session_id""",
}
