"""Queries of ordered state over sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.operators import sessions as S
from quotelake.plans.tables import table


def _segments(s, d):
    words = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")).cast("long")
    return table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), words.alias("n_words"))


def _health(s, d):
    return S.health(_segments(s, d), window=3, mean=80, warm_up=2)


def _md5(df, column):
    return df.withColumn("md5", F.md5(F.col(column).cast("binary"))).drop(column)


QUERIES = {
    "rolling_health": _health,
    "health_flips": lambda s, d: S.flips(_health(s, d)),
    "context_last3": lambda s, d: _md5(S.context(table(s, d, "conversations")), "context"),
    "word_windows": lambda s, d: _md5(S.word_windows(table(s, d, "conversations")), "window"),
    "asof_anchor": lambda s, d: S.anchored(table(s, d, "events"), anchor="purchase", seconds=86_400),
    "greedy_dedup": lambda s, d: S.emitted(table(s, d, "events"), "user_id", 86_400),
    "contradictions": lambda s, d: S.contradicted(table(s, d, "events"), 3_600),
    "pause_sessions": lambda s, d: S.pauses(table(s, d, "events"), "6 hours"),
    "latest_wins": lambda s, d: S.latest(table(s, d, "events")),
}

HEALTH = """n AS (SELECT conv_id AS session_id, turn AS seq, len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) AS n_words FROM conversations),
h AS (SELECT session_id, seq, round(avg(n_words) OVER w, 4) AS mean_words, count(*) OVER w < 2 OR avg(n_words) OVER w >= 80 AS reliable FROM n WHERE n_words > 0
 WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""

ORACLE_SQL = {
    "rolling_health": f"WITH {HEALTH} SELECT * FROM h",
    "health_flips": f"WITH {HEALTH} SELECT * FROM h QUALIFY reliable <> lag(reliable, 1, true) OVER (PARTITION BY session_id ORDER BY seq)",
    "context_last3": """WITH d AS (SELECT * FROM conversations QUALIFY lag(text) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL OR lag(text) OVER (PARTITION BY conv_id ORDER BY turn) <> text)
SELECT conv_id, turn, md5(coalesce(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ' '), '')) AS md5 FROM d""",
    "word_windows": """WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '') AS w FROM conversations),
e AS (SELECT *, CAST(unnest(range(6, len(w) + 1, 3)) AS BIGINT) AS "end" FROM w)
SELECT conv_id, turn, "end", md5(array_to_string(list_slice(w, greatest(1, "end" - 39), "end"), ' ')) AS md5 FROM e""",
    "asof_anchor": """WITH a AS (SELECT e.event_id, e.ts, arg_max(p.event_id, (p.ts, p.event_id)) AS anchor_id, max(p.ts) AS anchor_ts FROM events e
 LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts, p.event_id) <= (e.ts, e.event_id) GROUP BY e.event_id, e.ts)
SELECT event_id, CASE WHEN anchor_ts >= ts - INTERVAL 86400 SECOND THEN anchor_id END AS anchor_id FROM a""",
    "greedy_dedup": """WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
f AS (SELECT user_id, event_id, ts, r, ts AS last, true AS kept FROM o WHERE r = 1
 UNION ALL SELECT o.user_id, o.event_id, o.ts, o.r, CASE WHEN o.ts - f.last >= INTERVAL 86400 SECOND THEN o.ts ELSE f.last END, o.ts - f.last >= INTERVAL 86400 SECOND FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1)
SELECT user_id, event_id FROM f WHERE kept""",
    "contradictions": """SELECT e.event_id, bool_or(o.event_id IS NOT NULL) AS contradicted FROM events e LEFT JOIN events o
ON o.user_id = e.user_id AND o.event_type <> e.event_type AND (o.ts, o.event_id) < (e.ts, e.event_id) AND o.ts > e.ts - INTERVAL 3600 SECOND GROUP BY e.event_id""",
    "pause_sessions": """WITH g AS (SELECT *, coalesce(CAST(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR AS INT), 1) AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, count(*) AS n, min(ts) AS started_at, max(ts) AS last_at FROM s GROUP BY user_id, no""",
    "latest_wins": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
}
