"""Reports over a history of detections: id, detected_at, session_id, reference, book, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def from_events(events: DataFrame) -> DataFrame:
    """A history from an event log: the reference is the event's type with the number in its props."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(F.col("event_id").alias("id"), F.col("ts").alias("detected_at"), F.col("user_id").alias("session_id"), F.concat_ws(" ", "event_type", k.cast("string")).alias("reference"), F.col("event_type").alias("book"), k.alias("chapter"), "value", F.col("props"))


def since(history: DataFrame, anchor: Column, days: int) -> DataFrame:
    return history.where(F.col("detected_at") >= anchor - F.expr(f"interval {days} days"))


def recent(history: DataFrame, limit: int = 50, session_id: int | None = None) -> DataFrame:
    """The newest rows; a session id of 0 or none means all sessions."""
    rows = history.where(F.col("session_id") == session_id) if session_id else history
    return rows.orderBy(F.desc("detected_at"), F.desc("id")).limit(limit)


def totals(history: DataFrame, anchor: Column, days: int) -> DataFrame:
    """Counts of the rows and references of the last days, of the sessions that began in them, and rows per such session
    (0 without)."""
    sums = since(history, anchor, days).agg(F.count("*").alias("total"), F.countDistinct("reference").alias("unique_references"))
    starts = history.groupBy("session_id").agg(F.min("detected_at").alias("detected_at"))
    out = sums.crossJoin(F.broadcast(since(starts, anchor, days).agg(F.count("*").alias("sessions"))))
    return out.withColumn("avg_per_session", F.when(F.col("sessions") > 0, F.round(F.col("total") / F.col("sessions"), 4)).otherwise(0.0))


def top(history: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The most frequent values of `by`, ties in their order."""
    return history.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by).limit(limit)


def per_day(history: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return history.groupBy(F.to_date("detected_at").alias("day"), *by).agg(F.count("*").alias("n"))


def per_book(history: DataFrame) -> DataFrame:
    return history.groupBy("book").agg(F.count("*").alias("n"), F.countDistinct("chapter").alias("chapters"), F.min("detected_at").alias("first_at"), F.max("detected_at").alias("last_at"))


def day(history: DataFrame, date: str) -> DataFrame:
    rows = history.where((F.col("detected_at") >= F.lit(date).cast("timestamp_ntz")) & (F.col("detected_at") < F.lit(date).cast("timestamp_ntz") + F.expr("interval 1 day")))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("reference").alias("unique_references"), F.countDistinct("session_id").alias("sessions"))


def share_of_largest(history: DataFrame) -> DataFrame:
    """Counts by book over the largest count. Books are few: counts meet in one row first."""
    counts = history.groupBy("book").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    return counts.crossJoin(F.broadcast(most)).select("book", "n", F.round(F.col("n") / F.col("most"), 6).alias("ratio"))


def _most(counts: DataFrame, name: str, alias: str) -> DataFrame:
    """The most frequent value of a day, the first in order on ties."""
    return counts.groupBy("day").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(name).alias("v")))["v"].alias(alias))


def daily_rollup(history: DataFrame) -> DataFrame:
    """Per day: rows, references, the most cited book and reference, rows per session."""
    rows = history.withColumn("day", F.to_date("detected_at"))
    sums = rows.groupBy("day").agg(F.count("*").alias("total"), F.countDistinct("reference").alias("unique_references"), F.round(F.count("*") / F.countDistinct("session_id"), 4).alias("avg_per_session"))
    book = _most(rows.groupBy("day", "book").agg(F.count("*").alias("n")), "book", "most_cited_book")
    reference = _most(rows.groupBy("day", "reference").agg(F.count("*").alias("n")), "reference", "most_cited_reference")
    return sums.join(book, "day").join(reference, "day")


def mark_latest(history: DataFrame) -> DataFrame:
    """`projected` on the newest row of each reference. The newest row comes from an aggregate, as one reference can hold
    a large share of the rows."""
    newest = history.groupBy("reference").agg(F.max(F.struct("detected_at", "id"))["id"].alias("newest"))
    return history.join(newest, "reference").select("id", "reference", (F.col("id") == F.col("newest")).alias("projected"))


def sessions(history: DataFrame) -> DataFrame:
    """Start, end, rows and whole minutes of each session."""
    out = history.groupBy("session_id").agg(F.min("detected_at").alias("started_at"), F.max("detected_at").alias("ended_at"), F.count("*").alias("n"))
    seconds = F.expr("timestampdiff(SECOND, started_at, ended_at)")
    return out.withColumn("minutes", F.floor(seconds / 60).cast("long"))


def last_values(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The last value of each key."""
    return rows.groupBy(key).agg(F.max(F.struct(*order, value))[value].alias(value))


def retained(history: DataFrame, anchor: Column, days: int) -> DataFrame:
    """What a clean-up of rows older than `days` keeps and drops, by book."""
    old = F.col("detected_at") < anchor - F.expr(f"interval {days} days")
    return history.groupBy("book").agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("dropped"))


def defaults(history: DataFrame, context: str, most: int) -> DataFrame:
    """Rows as a history stores them: chapter 0 for none, confidence in whole per cent, a cut context."""
    return history.select("id", F.coalesce("chapter", F.lit(0)).cast("long").alias("verse_start"), F.floor(F.col("value") * 100).cast("long").alias("confidence"), F.substring(context, 1, most).alias("context_text"))


def projected_page(history: DataFrame, limit: int) -> DataFrame:
    """Counts over the newest `limit` rows."""
    page = recent(history, limit)
    return page.agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 50).alias("projected"), F.countDistinct("reference").alias("unique_references"))


def queue(history: DataFrame, limit: int, minutes: int) -> DataFrame:
    """Of the newest `limit` rows those within `minutes` of the newest; the limit comes first."""
    page = recent(history, limit)
    newest = page.agg(F.max("detected_at").alias("newest"))
    return page.crossJoin(F.broadcast(newest)).where(F.col("detected_at") >= F.col("newest") - F.expr(f"interval {minutes} minutes")).select("id", "reference", "detected_at")


def transcripts(turns: DataFrame) -> DataFrame:
    """The non-empty texts of each conversation in order, joined by a space."""
    text = F.trim(F.coalesce("text", F.lit("")))
    parts = F.sort_array(F.collect_list(F.when(text != "", F.struct("turn", text.alias("t")))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("transcript"))


def with_id(history: DataFrame, row_id: int) -> DataFrame:
    return history.where(F.col("id") == row_id)


def certainty(history: DataFrame, by: list[str]) -> DataFrame:
    """The mean and the least confidence of each group."""
    return history.groupBy(*by).agg(F.round(F.avg("value"), 8).alias("mean"), F.min("value").alias("least"))


def oscillations(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows of each key, and how often the value differs from the row before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    marked = rows.withColumn("changed", F.coalesce((before != F.col(value)).cast("long"), F.lit(0)))
    return marked.groupBy(key).agg(F.count("*").alias("n"), F.sum("changed").alias("changes"))
