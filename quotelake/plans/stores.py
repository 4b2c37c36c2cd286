"""Queries of a written history: what a store holds after a run of commits, with the SQL of its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.operators import passages as P
from quotelake.plans.history import ANCHOR, HIST, _history
from quotelake.plans.tables import table
from quotelake.sources import store as S
from quotelake.sources.files import shared_folder


def _detections(s, d):
    """Two arrivals, the second of which comes twice; then errors are judged, purchases projected, old rows dropped."""
    store = S.opened(s, shared_folder(s, "store"))
    rows = _history(s, d).select("id", "session_id", "reference", "book", F.col("detected_at").cast("timestamp").alias("detected_at"), "value", F.lit(False).alias("validated"), F.lit(False).alias("projected"))
    for part in (0, 1, 1):
        S.record(store, rows.where(F.pmod("id", F.lit(2)) == part))
    errors = store.read("detections").where("book = 'error'")
    S.edit(store, errors.select("id", F.when(F.col("value") < 5, "delete").otherwise("validate").alias("action")))
    S.mark_projected(store, store.read("detections").where("book = 'purchase'").select("reference"))
    S.retain(store, F.lit(ANCHOR).cast("timestamp") - F.expr("interval 14 days"))
    store.compact()
    return store.read("detections").select("id", "reference", "validated", "projected")


def _corpus(s, d):
    """Each language's passages are installed, then the shorter ones of them again: counts and passages of one version."""
    store = S.opened(s, shared_folder(s, "store"))
    rows = P.from_documents(table(s, d, "documents")).where("version is not null and book is not null")
    S.install(store, rows)
    S.install(store, rows.where("version in ('fr', 'de')").where(F.length("text") < 200))
    now = store.snapshot()
    found = now.read("passages").groupBy("version").agg(F.count("*").alias("held"), F.sum(F.length("text")).alias("letters"))
    return found.join(now.read("counts"), "version").select("version", "books", "chapters", "verses", "held", "letters")


QUERIES = {"stored_history": _detections, "stored_corpus": _corpus}
ORACLE_SQL = {
    "stored_history": f"""{HIST}, k AS (SELECT * FROM h WHERE NOT (book = 'error' AND value < 5)), n AS (SELECT arg_max(id, (detected_at, id)) AS id FROM k WHERE reference IN (SELECT reference FROM k WHERE book = 'purchase') GROUP BY reference)
SELECT id, reference, book = 'error' AS validated, id IN (SELECT id FROM n) AS projected FROM k WHERE detected_at >= TIMESTAMP '{ANCHOR}' - INTERVAL 14 DAY""",
    "stored_corpus": """WITH l AS (SELECT lang AS version, source AS book, doc_id AS chapter, trim(unnest(string_split(text, chr(10)))) AS text FROM documents),
p AS (SELECT * FROM l WHERE text <> '' AND (version NOT IN ('fr', 'de') OR length(text) < 200))
SELECT version, count(DISTINCT book) AS books, count(DISTINCT (book, chapter)) AS chapters, count(*) AS verses, count(*) AS held, CAST(sum(length(text)) AS BIGINT) AS letters FROM p GROUP BY version""",
}
