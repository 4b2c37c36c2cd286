"""The queue of detections that wait for a person, and the settings and flags of stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def queued(additions: DataFrame, session: str) -> DataFrame:
    """The queue that additions (id, at, reference, confidence, shown) leave in each session. A reference that waits is
    brought up to date instead of waiting twice, letter case and outer spaces aside; what was shown at once stands for
    itself as long as its reference doesn't wait. A missing or zero confidence changes nothing."""
    key = F.lower(F.trim("reference"))
    first = F.min(F.when(~F.col("shown"), F.struct("at", "id"))).over(Window.partitionBy(session, "key"))
    rows = additions.where("reference is not null").withColumn("key", key).withColumn("first", first)
    waits = F.col("first").isNotNull() & (F.struct("at", "id") >= F.col("first"))
    rows = rows.withColumn("entry", F.when(waits, F.col("first.id")).otherwise(F.col("id")))
    sure = F.max_by(F.when(F.coalesce("confidence", F.lit(0.0)) != 0, F.col("confidence")), F.when(F.coalesce("confidence", F.lit(0.0)) != 0, F.struct("at", "id")))
    out = rows.groupBy(session, "entry").agg(F.min_by("reference", F.struct("at", "id")).alias("reference"), F.max("at").alias("at"), sure.alias("confidence"), F.min_by("shown", F.struct("at", "id")).alias("s"))
    return out.select(session, "entry", "reference", "at", "confidence", F.when(F.col("s"), "projected").otherwise("pending").alias("status"))


def displayed(queue: DataFrame, on_air: DataFrame, session: str) -> DataFrame:
    """What waits in each session without what is on air, then the entry on air, last: the newest shown entry (of the
    reference on air, if one is given), or a card for a reference that was shown without an entry."""
    air = on_air.select(F.col(session).alias("air_session"), F.col("reference").alias("air"))
    rows = queue.join(air, F.col(session) == F.col("air_session"), "left").drop("air_session")
    shown = rows.where((F.col("status") == "projected") & (F.col("air").isNull() | (F.col("air") == F.col("reference"))))
    active = shown.groupBy(session).agg(F.max_by(F.struct("entry", "reference"), "entry").alias("e")).select(F.col(session).alias("s"), "e.*")
    cards = on_air.where("reference is not null").join(active, F.col(session) == F.col("s"), "left_anti").select(F.col(session).alias("s"), F.lit(None).cast("long").alias("entry"), "reference")
    active = active.unionByName(cards)
    known = active.select("s", F.col("reference").alias("active"))
    waiting = queue.where("status = 'pending'").join(known, F.col(session) == F.col("s"), "left").where("active is null or active <> reference")
    both = waiting.select(session, "entry", "reference", F.lit(False).alias("on_air")).unionByName(active.select(F.col("s").alias(session), "entry", "reference", F.lit(True).alias("on_air")))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy("on_air", "entry")).cast("long"))


def changed(history: DataFrame, changes: DataFrame) -> DataFrame:
    """A history after changes (id, action): rows of a 'delete' are gone, rows of a 'validate' are flagged."""
    did = changes.groupBy(F.col("id").alias("changed_id")).agg(F.bool_or(F.col("action") == "delete").alias("gone"), F.bool_or(F.col("action") == "validate").alias("v"))
    rows = history.join(did, history["id"] == did["changed_id"], "left").where("gone is null or not gone")
    return rows.withColumn("validated", F.coalesce("v", F.lit(False))).drop("changed_id", "gone", "v")


def settings(log: DataFrame) -> DataFrame:
    """Settings after a log of sets and deletes (seq, key, value, deleted): the last entry of a key counts."""
    last = log.groupBy("key").agg(F.max(F.struct("seq", "value", "deleted")).alias("l"))
    return last.where("not l.deleted").select("key", "l.value")


def in_order(history: DataFrame, most: int) -> DataFrame:
    """The newest `most` rows, oldest first, numbered."""
    page = history.orderBy(F.desc("detected_at"), F.desc("id")).limit(most)
    return page.withColumn("place", F.row_number().over(Window.orderBy("detected_at", "id")).cast("long"))


def stored(detections: DataFrame) -> DataFrame:
    """Detections that are kept: a chapter alone is shown, not stored."""
    return detections.where("method <> 'chapter_candidate'")


def one_per_utterance(references: DataFrame, key: str) -> DataFrame:
    """Of the references of each utterance (position, verse_start, is_final) what it means: an unfinished one has the last
    said; a finished one has the first with a verse, and the others with a verse as extra ones to be reviewed. A finished
    one without verses has its first chapter."""
    final, verse = F.col("is_final"), F.col("verse_start").isNotNull()
    w = Window.partitionBy(key)
    rows = references.withColumns({"last": F.max("position").over(w), "first": F.min("position").over(w), "first_verse": F.min(F.when(verse, F.col("position"))).over(w)})
    main = F.when(~final, F.col("position") == F.col("last")).otherwise(F.col("position") == F.coalesce("first_verse", "first"))
    kept = rows.withColumn("main", main).where(F.col("main") | (final & verse))
    return kept.withColumn("review", ~F.col("main")).drop("last", "first", "first_verse", "main")
