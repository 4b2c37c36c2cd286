"""Queries of the queue, exports, reports and cases, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.operators import evaluation as E
from quotelake.operators import fusion as U
from quotelake.operators import history as H
from quotelake.operators import passages as P
from quotelake.operators import queue as Q
from quotelake.operators import references as R
from quotelake.operators import reports as T
from quotelake.plans import references as RP
from quotelake.plans.history import HIST
from quotelake.plans.tables import table
from quotelake.sources import files


def _history(s, d):
    return H.from_events(table(s, d, "events"))


def _mod(c, n):
    return F.pmod(F.col(c), F.lit(n))


def _additions(s, d):
    """Every reference twice, in other letters, some shown at once, some without a confidence."""
    h = _history(s, d)
    written = F.when(_mod("id", 2) == 0, F.upper("reference")).otherwise(F.concat(F.lit(" "), "reference"))
    return h.select("session_id", "id", F.col("detected_at").alias("at"), written.alias("reference"), F.when(_mod("id", 4) != 0, F.col("value")).alias("confidence"), (_mod("id", 3) == 0).alias("shown"))


def _displayed(s, d):
    h = _history(s, d)
    status = F.element_at(F.array(*map(F.lit, ("pending", "projected", "rejected"))), (_mod("id", 3) + 1).cast("int"))
    queue = h.select("session_id", F.col("id").alias("entry"), F.col("book").alias("reference"), status.alias("status"))
    on_air = h.groupBy("session_id").agg(F.max_by("book", F.struct("detected_at", "id")).alias("book")).select("session_id", F.when(_mod("session_id", 2) == 0, F.col("book")).when(_mod("session_id", 5) == 0, "by hand").alias("reference"))
    return Q.displayed(queue, on_air, "session_id")


def _changed(s, d):
    action = F.when(_mod("event_id", 7) == 0, "delete").otherwise("validate")
    changes = table(s, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), action.alias("action"))
    return Q.changed(_history(s, d), changes).select("id", "reference", "validated")


def _settings(s, d):
    return Q.settings(table(s, d, "events").select(F.col("event_id").alias("seq"), F.concat("event_type", _mod("user_id", 9).cast("string")).alias("key"), F.col("value"), (_mod("event_id", 3) == 0).alias("deleted")))


def _csv(s, d):
    path = files.shared_folder(s, "csv")
    rows = _history(s, d).select("id", "detected_at", "session_id", "reference", "value")
    if not files.export_csv(rows, path):
        return rows.drop("detected_at")
    return s.read.option("header", True).schema("id long, detected_at string, session_id long, reference string, value double").csv(path).drop("detected_at")


def _json(s, d):
    path = files.shared_folder(s, "json")
    files.export_json(_history(s, d).select("id", "detected_at", "session_id", "reference"), path)
    rows = s.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<struct<id: long, session_id: long, reference: string>>")).alias("place", "r"))
    return rows.select(F.col("place").cast("long").alias("place"), "r.id", "r.session_id", "r.reference")


def _installed(s, d):
    """All versions are installed, then one of them again: nothing doubles."""
    path = files.shared_folder(s, "corpora")
    passages = P.from_documents(table(s, d, "documents"))
    files.install(passages, path)
    files.install(passages.where("version = 'fr'"), path)
    both = files.installed(s, path).groupBy("version").agg(F.count("*").alias("stored"))
    return files.installed(s, path, "counts").select(F.col("version").cast("string"), "books", "chapters", "verses").join(both.select(F.col("version").cast("string"), "stored"), "version")


def _captured(s, d):
    path = files.shared_folder(s, "cases")
    item = table(s, d, "benchmark")
    none = F.lit(None).cast("string")
    cases = item.select(F.format_string("incident %03d", "item_id").alias("id"), "text", F.when(_mod("item_id", 2) == 0, F.lit("Jean 3:16")).alias("expected"), F.lit("incident").alias("kind"), F.create_map(F.lit("noise"), F.lit("high")).alias("conditions"), none.alias("anchor"), F.lit("captured").alias("origin"), none.alias("note"))
    files.capture(cases, path)
    return files.cases_of(s, path).select("id", F.md5(F.col("text").cast("binary")).alias("md5"), "expected", "kind", F.col("conditions")["noise"].alias("noise"))


def _flat(s, d):
    path = files.shared_folder(s, "flat")
    item = table(s, d, "benchmark")
    rows = F.transform(F.sort_array(F.collect_list(F.struct("item_id", "text"))), lambda r: F.struct(r["text"].alias("text"), F.lit("paraphrase").alias("kind")))
    item.agg(F.to_json(rows).alias("value")).coalesce(1).write.text(path)
    return files.flat_cases(s, path, "cases").select("id", F.md5(F.col("text").cast("binary")).alias("md5"), "expected", "kind")


def _reports(s, d):
    h = _history(s, d)
    sessions = H.sessions(h).select("session_id", F.when(_mod("session_id", 3) != 0, F.format_string("Evening %d", "session_id")).alias("name"), "started_at", "minutes", F.when(_mod("session_id", 2) == 0, F.lit(" all went well ")).alias("summary"))
    said = H.transcripts(table(s, d, "conversations")).withColumnRenamed("conv_id", "session_id")
    return T.session_reports(sessions.join(said, "session_id", "left"), h.select("session_id", "detected_at", "id", "reference", F.when(_mod("id", 2) == 0, F.col("props")).alias("text"))).select("session_id", F.md5(F.col("report").cast("binary")).alias("md5"))


def _sections(s, d):
    text = F.concat(F.lit("intro line\n# Topic **A**\n- first **bold**\n* second\n#\n"), "text", F.lit("\n## Last\n"))
    rows = table(s, d, "conversations").select(F.struct("conv_id", "turn").alias("key"), text.alias("text"), F.lit("Evening").alias("title"))
    return T.sections(rows, "key", "text", "title").select("key.*", "no", "heading", F.md5(F.col("text").cast("binary")).alias("md5"))


def _recordings(s, d):
    rows = table(s, d, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("at"), F.when(F.col("value") > 20, F.col("event_type")).alias("reference"), _mod("event_id", 9).alias("n_words"), F.round("value", 2).alias("took"), (F.round("value", 2) * 2 + 1).alias("lasts"))
    return T.recordings(rows, "user_id")


def _offsets(s, d):
    rows = table(s, d, "events").select("user_id", F.col("event_id").alias("seq"), (1 + _mod("event_id", 5)).alias("lasts"))
    return T.offsets(rows, "user_id").select("user_id", "seq", "starts", "ends")


def _utterance_meaning(s, d):
    found = R.parse_all(RP._pairs(s, d), "event_id", "text").withColumn("is_final", _mod("event_id", 2) == 0)
    return Q.one_per_utterance(found, "event_id").select("event_id", "reference", "review")


def _policies(s, d):
    from quotelake.plans.detection import _detections

    rows = _detections(s, d).withColumns({"direct": U.may_project_first(*(F.col(c) for c in ("method", "confidence", "verse", "review"))), "several": _mod("event_id", 11) == 0})
    live = U.may_project(*(F.col(c) for c in ("method", "confidence", "verse", "review", "in_plan"))) & ~F.col("several")
    on = lambda **k: U.policy_first(F.col("direct"), **k)
    return rows.select("event_id", "direct", live.alias("live"), on(autopilot=True, shadow=False, safe=True).alias("shown"), on(autopilot=True, shadow=True, safe=False).alias("shadowed"), on(autopilot=False, shadow=False, safe=True).alias("safe"))


def _explained(s, d):
    method = F.element_at(F.array(*map(F.lit, ("explicit", "semantic_conflict", "semantic_local", "chapter_candidate", "ai_semantic"))), (_mod("event_id", 5) + 1).cast("int"))
    rows = table(s, d, "events").select("event_id", method.alias("method"), F.lit("Jean 3:16").alias("reference"), F.lit("Jean 3:17").alias("said"), (_mod("event_id", 7) / 10).alias("overlap"))
    return rows.select("event_id", U.explanation(*(F.col(c) for c in ("method", "reference", "said", "overlap"))).alias("explanation"))


def _grounded(s, d):
    """Suggestions for each item against the items that stand in its list."""
    item = table(s, d, "benchmark").select("item_id", F.concat(F.lit("Élie "), F.col("item_id").cast("string")).alias("reference"))
    candidates = item.select("item_id", "reference", (_mod("item_id", 10) / 10).alias("score"))
    suggested = F.when(_mod("item_id", 4) == 0, F.lit("nothing")).otherwise(F.concat(F.lit("ELIE-"), F.col("item_id").cast("string")))
    return E.grounded(item.select("item_id", suggested.alias("suggestion"), (_mod("item_id", 13) * 10).alias("raw")), candidates, "item_id")


QUERIES = {
    "queue_updates": lambda s, d: Q.queued(_additions(s, d), "session_id"),
    "displayed_queue": _displayed,
    "changed_history": _changed,
    "settings_log": _settings,
    "ordered_page": lambda s, d: Q.in_order(_history(s, d), 1000).select("place", "id", "reference"),
    "point_lookup": lambda s, d: H.with_id(_history(s, d), 42).select("id", "session_id", "reference", "detected_at"),
    "csv_export": _csv,
    "json_export": _json,
    "installed_corpus": _installed,
    "captured_cases": _captured,
    "flat_cases": _flat,
    "session_reports": _reports,
    "summary_sections": _sections,
    "recording_measures": _recordings,
    "segment_offsets": _offsets,
    "segment_confidence": lambda s, d: H.certainty(_history(s, d), ["session_id", "book"]),
    "stage_counts": lambda s, d: R.parse(RP.utterances(s, d), "event_id", "text").groupBy("method").agg(F.count("*").alias("n")),
    "utterance_meaning": _utterance_meaning,
    "stored_detections": lambda s, d: Q.stored(R.parse(RP.utterances(s, d), "event_id", "text")).select("event_id", "reference"),
    "policy_variants": _policies,
    "explanations": _explained,
    "grounded_suggestions": _grounded,
}

ADDED = """a AS (SELECT user_id AS session_id, event_id AS id, ts AS "at", CASE WHEN event_id % 2 = 0 THEN upper(reference) ELSE ' ' || reference END AS reference, lower(trim(reference)) AS key,
 CASE WHEN event_id % 4 <> 0 AND value <> 0 THEN value END AS confidence, event_id % 3 = 0 AS shown FROM (SELECT *, concat_ws(' ', event_type, json_extract_string(props, '$.k')) AS reference FROM events))"""
LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"

ORACLE_SQL = {
    "queue_updates": f"""WITH {ADDED}, f AS (SELECT session_id, key, arg_min(id, ("at", id)) AS first FROM a WHERE NOT shown GROUP BY ALL),
r AS (SELECT a.*, CASE WHEN f.first IS NOT NULL AND ("at", id) >= ((SELECT "at" FROM a b WHERE b.id = f.first), f.first) THEN f.first ELSE id END AS entry FROM a LEFT JOIN f USING (session_id, key))
SELECT session_id, entry, arg_min(reference, ("at", id)) AS reference, max("at") AS "at", arg_max(confidence, ("at", id)) FILTER (confidence IS NOT NULL) AS confidence, CASE WHEN arg_min(shown, ("at", id)) THEN 'projected' ELSE 'pending' END AS status FROM r GROUP BY session_id, entry""",
    "displayed_queue": f"""{HIST}, q AS (SELECT session_id, id AS entry, book AS reference, ['pending', 'projected', 'rejected'][id % 3 + 1] AS status FROM h),
o AS (SELECT session_id, CASE WHEN session_id % 2 = 0 THEN arg_max(book, (detected_at, id)) WHEN session_id % 5 = 0 THEN 'by hand' END AS air FROM h GROUP BY session_id),
s AS (SELECT session_id, max(entry) AS entry FROM q JOIN o USING (session_id) WHERE status = 'projected' AND (air IS NULL OR air = reference) GROUP BY session_id),
act AS (SELECT o.session_id, s.entry, coalesce(q.reference, air) AS reference FROM o LEFT JOIN s USING (session_id) LEFT JOIN q ON q.entry = s.entry WHERE s.entry IS NOT NULL OR air IS NOT NULL),
b AS (SELECT q.session_id, q.entry, q.reference, false AS on_air FROM q LEFT JOIN act USING (session_id) WHERE status = 'pending' AND (act.reference IS NULL OR act.reference <> q.reference) UNION ALL SELECT *, true FROM act)
SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY on_air, entry) AS place FROM b""",
    "changed_history": f"{HIST} SELECT id, reference, book = 'error' AS validated FROM h WHERE NOT (book = 'error' AND id % 7 = 0)",
    "settings_log": "WITH l AS (SELECT event_type || (user_id % 9) AS key, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events GROUP BY 1) SELECT key, value FROM l WHERE seq % 3 <> 0",
    "ordered_page": f"{HIST}, p AS (SELECT * FROM h ORDER BY detected_at DESC, id DESC LIMIT 1000) SELECT row_number() OVER (ORDER BY detected_at, id) AS place, id, reference FROM p",
    "point_lookup": f"{HIST} SELECT id, session_id, reference, detected_at FROM h WHERE id = 42",
    "csv_export": f"{HIST} SELECT id, session_id, reference, value FROM h",
    "json_export": f"{HIST}, p AS (SELECT * FROM h ORDER BY detected_at DESC, id DESC LIMIT 10000) SELECT row_number() OVER (ORDER BY detected_at DESC, id DESC) - 1 AS place, id, session_id, reference FROM p",
    "installed_corpus": """WITH l AS (SELECT lang AS version, source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT version, count(DISTINCT source) AS books, count(DISTINCT (source, doc_id)) AS chapters, count(*) AS verses, count(*) AS stored FROM l WHERE trim(line) <> '' GROUP BY version""",
    "captured_cases": "SELECT format('incident {:03d}', item_id) AS id, md5(text) AS md5, CASE WHEN item_id % 2 = 0 THEN 'Jean 3:16' END AS expected, 'incident' AS kind, 'high' AS noise FROM benchmark",
    "flat_cases": "SELECT format('cases-{:03d}', row_number() OVER (ORDER BY item_id) - 1) AS id, md5(text) AS md5, CAST(NULL AS VARCHAR) AS expected, 'paraphrase' AS kind FROM benchmark",
    "session_reports": f"""{HIST}, p AS (SELECT session_id, string_agg('### ' || reference || strftime(detected_at, '  ·  %H:%M') || chr(10) || CASE WHEN id % 2 = 0 THEN chr(10) || '> ' || props || chr(10) ELSE '' END, chr(10) ORDER BY detected_at, id) AS listed,
 count(*) AS n, min(detected_at) AS started_at, CAST(floor(date_diff('microsecond', min(detected_at), max(detected_at)) / 60e6) AS BIGINT) AS minutes FROM h GROUP BY session_id),
t AS (SELECT conv_id, string_agg(trim(text), ' ' ORDER BY turn) AS said FROM conversations WHERE trim(coalesce(text, '')) <> '' GROUP BY conv_id)
SELECT session_id, md5(concat_ws(chr(10), '# ' || CASE WHEN session_id % 3 <> 0 THEN 'Evening ' || session_id ELSE 'Session' END || chr(10), strftime(started_at, '*%Y-%m-%d*') || chr(10),
 CASE WHEN minutes > 0 THEN minutes || ' min · ' || n || ' passages' || chr(10) END, CASE WHEN session_id % 2 = 0 THEN '## Summary' || chr(10) || chr(10) || 'all went well' || chr(10) END,
 '## Passages' || chr(10) || chr(10) || listed, '## Transcript' || chr(10) || chr(10) || said || chr(10))) AS md5 FROM p LEFT JOIN t ON conv_id = session_id""",
    "summary_sections": f"""WITH k AS (SELECT conv_id, turn, 1 AS no, 'Evening' AS heading, 'intro line' AS t FROM conversations UNION ALL SELECT conv_id, turn, 2, 'Topic **A**', 'first bold second' FROM conversations
 UNION ALL SELECT conv_id, turn, 3, 'Evening', array_to_string({LINES}, ' ') FROM conversations WHERE len({LINES}) > 0) SELECT conv_id, turn, CAST(no AS BIGINT) AS no, heading, md5(t) AS md5 FROM k""",
    "recording_measures": """WITH r AS (SELECT user_id, event_id, ts, CASE WHEN value > 20 THEN event_type END AS reference, event_id % 9 AS n_words, round(value, 2) AS took FROM events),
s AS (SELECT user_id, count(*) AS detections, min(ts) AS first_at, max(ts) AS stable_at, CAST(sum(CAST(reference <> before AS INT)) AS BIGINT) AS oscillations, arg_max(reference, (ts, event_id)) AS final_reference
 FROM (SELECT *, lag(reference) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM r WHERE reference IS NOT NULL) GROUP BY user_id)
SELECT user_id, CAST(sum(n_words) AS BIGINT) AS words, round(sum(took) / sum(took * 2 + 1), 6) AS real_time_factor, coalesce(any_value(detections), 0) AS detections, any_value(first_at) AS first_at, any_value(stable_at) AS stable_at,
 coalesce(any_value(oscillations), 0) AS oscillations, any_value(final_reference) AS final_reference FROM r LEFT JOIN s USING (user_id) GROUP BY user_id""",
    "segment_offsets": "SELECT user_id, event_id AS seq, CAST(sum(1 + event_id % 5) OVER w AS BIGINT) - (1 + event_id % 5) AS starts, CAST(sum(1 + event_id % 5) OVER w AS BIGINT) AS ends FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "segment_confidence": f"{HIST} SELECT session_id, book, round(avg(value), 8) AS mean, min(value) AS least FROM h GROUP BY ALL",
    "stage_counts": f"WITH x AS ({RP.ORACLE_SQL['reference_parse']}) SELECT method, count(*) AS n FROM x GROUP BY method",
    "utterance_meaning": f"""WITH x AS ({RP.ORACLE_SQL['reference_parse_all']}), f AS (SELECT *, contains(reference, ':') AS verse, event_id % 2 = 0 AS final FROM x),
g AS (SELECT *, max(position) OVER e AS last, min(position) OVER e AS first, min(CASE WHEN verse THEN position END) OVER e AS fv FROM f WINDOW e AS (PARTITION BY event_id)),
m AS (SELECT *, CASE WHEN final THEN position = coalesce(fv, first) ELSE position = last END AS main FROM g)
SELECT event_id, reference, NOT main AS review FROM m WHERE main OR (final AND verse)""",
    "stored_detections": f"WITH x AS ({RP.ORACLE_SQL['reference_parse']}) SELECT event_id, reference FROM x WHERE method = 'explicit'",
    "policy_variants": """WITH d AS (SELECT event_id, event_id % 5 AS m, round(value / 100, 6) AS conf, event_id % 7 <> 0 AND event_id % 3 <> 0 AS open, event_id % 2 = 0 AS in_plan FROM events),
p AS (SELECT event_id, open AND m <= 2 AND conf >= CASE WHEN m = 2 THEN 0.90 ELSE 0.95 END AS direct, open AND event_id % 11 <> 0 AND coalesce(conf >= CASE WHEN m = 2 THEN 0.90 WHEN m IN (0, 1) THEN 0.95 WHEN m = 3 AND in_plan THEN 0.75 END, false) AS live FROM d)
SELECT event_id, direct, live, CASE WHEN direct THEN 'autopilot_projected' ELSE 'safe_manual_review' END AS shown, 'shadow_only' AS shadowed, 'safe_manual_review' AS safe FROM p""",
    "explanations": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'The reference was said and is in the corpus.' WHEN 1 THEN 'The text is that of Jean 3:16, but Jean 3:17 was said. To be reviewed.'
 WHEN 2 THEN format('Words and meaning agree. Overlap: {:.2f}.', (event_id % 7) / 10) WHEN 3 THEN 'A chapter was said; its verse is still looked for.' ELSE 'Picked from a closed list of passages. To be reviewed.' END AS explanation FROM events""",
    "grounded_suggestions": """SELECT item_id, 'Élie ' || item_id AS reference, least(100, (item_id % 13) * 10) AS raw, (item_id % 10) / 10 AS score, CAST(round(least(least(100, (item_id % 13) * 10), 70 + 30 * ((item_id % 10) / 10))) AS BIGINT) AS confidence FROM benchmark WHERE item_id % 4 <> 0""",
}
