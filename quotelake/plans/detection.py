"""Queries of fusion, decisions and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.operators import evaluation as E
from quotelake.operators import fusion as U
from quotelake.operators import retrieval as R
from quotelake.operators.engine import Tables
from quotelake.plans.retrieval import hits_sql
from quotelake.plans.tables import table
from quotelake.sources.files import shared_folder


def fused(s, d):
    hits = R.gram_hits_of(table(s, d, "benchmark"), table(s, d, "documents"), (2, 5))
    return U.fused(U.ranked(hits, "coverage", 24, ("n",)), 2, 5)


def decided(s, d):
    """The best candidate of each item with the rule that accepts it and its confidence; overlaps are of single words. The
    candidates, a few of each item, are kept: they choose the documents and meet them, and are found once for both."""
    found = Tables(shared_folder(s, "fusion")).save(fused(s, d), "candidates")
    best = U.best_of(R.word_overlap(found, table(s, d, "benchmark"), table(s, d, "documents")))
    args = [F.col(c) for c in ("sem", "lex", "agreement", "overlap", "stems")]
    return best.select("item_id", "doc_id", "rrf", U.decision(*args, threshold=0.8385, least=0.34).alias("rule"), U.confidence(*args).alias("confidence"))


def _detections(s, d):
    e = table(s, d, "events")
    n = F.col("event_id") % 5
    method = F.element_at(F.array(*map(F.lit, ("explicit", "text_phrase", "text_index", "chapter_text", "fuzzy"))), (n + 1).cast("int"))
    return e.select("event_id", method.alias("method"), F.round(F.col("value") / 100, 6).alias("confidence"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 30).alias("verse"), (F.col("event_id") % 3 == 0).alias("review"), (F.col("event_id") % 2 == 0).alias("in_plan"))


def policies(s, d):
    cols = [F.col(c) for c in ("method", "confidence", "verse", "review", "in_plan")]
    rows = _detections(s, d).withColumn("direct", U.may_project(*cols))
    on = U.policy(F.col("direct"), F.col("review"), autopilot=True, shadow=False, safe=False)
    safe = U.policy(F.col("direct"), F.col("review"), autopilot=False, shadow=False, safe=True)
    return rows.select("event_id", "direct", on.alias("policy_autopilot"), safe.alias("policy_safe"))


def calibrations(s, d):
    score = (F.col("event_id") % 11) / 10
    return table(s, d, "events").select("event_id", F.round(U.calibrated(F.col("value"), score, F.col("event_id") % 2 == 0), 4).alias("confidence"))


def confusions(s, d):
    rows = table(s, d, "labels").select(F.when(F.col("toxic") == 1, F.lit("x")).alias("e"), F.when(F.col("quality") == 0, F.when(F.col("doc_id") % 5 == 0, F.lit("y")).otherwise(F.lit("x"))).alias("p"))
    return E.confusion(rows, "e", "p")


def compared(s, d):
    """Rated documents before, vectors of the same numbers after."""
    before = table(s, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("ok"))
    return E.compared(before, table(s, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") < 5).alias("ok")))


def catalogues(s, d):
    """Sizes of parts are the catalogue, nations are imported, labels of vectors installed."""
    known = table(s, d, "part").groupBy(F.col("p_size").alias("key")).agg(F.min("p_brand").alias("name"))
    return E.catalogue(known, table(s, d, "nation").select(F.col("n_nationkey").alias("key")), table(s, d, "embeddings").select(F.col("label").alias("key")))


def planned(s, d):
    """Orders are planned by their status: one line of them, or all, or none."""
    rows = table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").cast("long").alias("verse"))
    plan = table(s, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("chapter"), F.when(F.col("o_orderstatus") == "F", F.lit(2)).cast("long").alias("verse"))
    return E.planned(rows, plan)


QUERIES = {
    "rrf_fusion": fused,
    "fusion_decision": decided,
    "projection_policy": policies,
    "calibrated_confidence": calibrations,
    "confusion_metrics": confusions,
    "latency_percentiles": lambda s, d: E.nearest_rank(table(s, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}),
    "run_compare": compared,
    "catalogue_outer": catalogues,
    "plan_membership": planned,
}


def _list(hits: str, name: str) -> str:
    return f"{name} AS (SELECT item_id, doc_id, coverage AS score, row_number() OVER (PARTITION BY item_id ORDER BY coverage DESC, doc_id) - 1 AS rank FROM {hits} QUALIFY rank < 24)"


FUSED = f"""{hits_sql(2, 'h2')}, {hits_sql(5, 'h5')}, {_list('h2', 'a')}, {_list('h5', 'b')},
f AS (SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.score, 0.0) AS sem, coalesce(b.score, 0.0) AS lex,
 round(coalesce(1 / (60 + a.rank), 0.0) + coalesce(1 / (60 + b.rank), 0.0), 6) AS rrf, a.score IS NOT NULL AND b.score IS NOT NULL AS agreement
 FROM a FULL JOIN b ON a.item_id = b.item_id AND a.doc_id = b.doc_id)"""

ORACLE_SQL = {
    "rrf_fusion": f"WITH {FUSED} SELECT item_id, doc_id, sem, lex, rrf, agreement FROM f",
    "fusion_decision": f"""WITH {FUSED}, {hits_sql(1, 'h1')},
c AS (SELECT f.*, h1.coverage AS overlap, h1.hits AS stems, row_number() OVER (PARTITION BY f.item_id ORDER BY agreement DESC, round(h1.coverage, 2) DESC, rrf DESC, f.doc_id) AS r FROM f JOIN h1 USING (item_id, doc_id))
SELECT item_id, doc_id, rrf, CASE WHEN agreement AND overlap >= 0.6 * 0.34 THEN 'agreement' WHEN lex >= 0.95 THEN 'curated' WHEN sem >= 0.8385 AND overlap >= 0.34 THEN 'semantic'
 WHEN sem >= 0.8085 AND overlap >= 0.9 AND stems >= 4 THEN 'near_threshold' WHEN lex > 0 AND overlap >= 0.55 AND stems >= 4 THEN 'lexical_overlap' WHEN lex >= 0.8 AND overlap >= 0.34 THEN 'lexical' ELSE 'none' END AS rule,
 round(CASE WHEN agreement THEN least(0.99, greatest(sem, lex, CASE WHEN stems >= 4 THEN overlap ELSE 0.0 END) + 0.08) ELSE greatest(sem, lex, CASE WHEN stems >= 4 THEN overlap ELSE 0.0 END) END, 4) AS confidence
FROM c WHERE r = 1""",
    "projection_policy": """WITH d AS (SELECT event_id, event_id % 5 AS m, round(value / 100, 6) AS conf, event_id % 7 <> 0 AS has_verse, event_id % 3 = 0 AS review, event_id % 2 = 0 AS in_plan FROM events),
p AS (SELECT event_id, review, has_verse AND NOT review AND coalesce(conf >= CASE WHEN m = 2 THEN 0.90 WHEN m IN (0, 1) THEN 0.95 WHEN m = 3 AND in_plan THEN 0.75 END, false) AS direct FROM d)
SELECT event_id, direct, CASE WHEN direct THEN 'autopilot_projected' ELSE 'manual_review' END AS policy_autopilot,
 CASE WHEN NOT review THEN 'safe_manual_review' WHEN direct THEN 'autopilot_direct' ELSE 'manual_review' END AS policy_safe FROM p""",
    "calibrated_confidence": "SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN least(value, 70 + 30 * ((event_id % 11) / 10)) ELSE least(value, 85.0) END, 4) AS confidence FROM events",
    "confusion_metrics": """WITH r AS (SELECT CASE WHEN toxic = 1 THEN 'x' END AS e, CASE WHEN quality = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'y' ELSE 'x' END END AS p FROM labels),
c AS (SELECT count(*) FILTER (e = p) AS tp, count(*) FILTER (e IS NULL AND p IS NOT NULL OR e <> p) AS fp, count(*) FILTER (e IS NOT NULL AND p IS NULL OR e <> p) AS fn, count(*) FILTER (e IS NULL AND p IS NULL) AS tn FROM r)
SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 1.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 1.0 END AS recall,
 CASE WHEN fp + tn > 0 THEN round(fp / (fp + tn), 6) ELSE 0.0 END AS fpr, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0.0 END AS f1 FROM c""",
    "latency_percentiles": """WITH g AS (SELECT event_type, list_sort(list(value)) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, v[CAST(round_even((n - 1) * 0.5, 0) AS BIGINT) + 1] AS p50, v[CAST(round_even((n - 1) * 0.95, 0) AS BIGINT) + 1] AS p95, v[CAST(round_even((n - 1) * 0.99, 0) AS BIGINT) + 1] AS p99, v[n] AS largest FROM g""",
    "run_compare": """WITH b AS (SELECT doc_id AS id, quality = 1 AS was FROM labels), a AS (SELECT vec_id AS id, label < 5 AS is_ok FROM embeddings)
SELECT CASE WHEN is_ok IS NULL THEN 'disappeared' WHEN was IS NULL THEN 'new' WHEN was AND NOT is_ok THEN 'regression' WHEN NOT was AND is_ok THEN 'gain' ELSE 'unchanged' END AS kind, count(*) AS n FROM b FULL JOIN a USING (id) GROUP BY 1""",
    "catalogue_outer": """SELECT k.key, coalesce((SELECT min(p_brand) FROM part WHERE p_size = k.key), '') AS name, k.key IN (SELECT n_nationkey FROM nation) AS imported, k.key IN (SELECT label FROM embeddings) AS installed
FROM (SELECT p_size AS key FROM part UNION SELECT n_nationkey FROM nation UNION SELECT label FROM embeddings) k""",
    "plan_membership": """WITH p AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 2 END AS verse FROM orders WHERE o_orderstatus <> 'P')
SELECT l_orderkey * 10 + l_linenumber AS id, o_orderkey IS NOT NULL AND (verse IS NULL OR verse = l_linenumber) AS in_plan, o_orderkey IS NOT NULL AND verse IS NOT NULL AND verse <> l_linenumber AS contradicts
FROM lineitem LEFT JOIN p ON o_orderkey = l_orderkey""",
}
