"""Reports of sessions: documents, summaries in sections, measures of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def session_reports(sessions: DataFrame, passages: DataFrame) -> DataFrame:
    """A Markdown document for each session (session_id, name, started_at, minutes, summary, transcript): title, date,
    length and count, summary, its passages (session_id, detected_at, id, reference, text) with their times, and the
    transcript last. Parts that are missing are left out."""
    head = F.concat(F.lit("### "), F.coalesce("reference", F.lit("?")), F.coalesce(F.date_format("detected_at", "'  ·  'HH:mm"), F.lit("")))
    quote = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.concat(F.lit("\n> "), F.trim("text"), F.lit("\n"))).otherwise("")
    block = F.concat(head, F.lit("\n"), quote)
    blocks = F.sort_array(F.collect_list(F.struct("detected_at", "id", block.alias("b"))))
    listed = passages.groupBy("session_id").agg(F.array_join(F.transform(blocks, lambda r: r["b"]), "\n").alias("listed"), F.count("*").alias("n"))
    rows = sessions.join(listed, "session_id", "left")
    given = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c))
    parts = [
        F.concat(F.lit("# "), F.coalesce(given("name"), F.lit("Session")), F.lit("\n")),
        F.date_format("started_at", "'*'yyyy-MM-dd'*\n'"),
        F.when(F.col("minutes") > 0, F.format_string("%d min · %d passages\n", "minutes", F.coalesce("n", F.lit(0)))),
        F.concat(F.lit("## Summary\n\n"), given("summary"), F.lit("\n")),
        F.concat(F.lit("## Passages\n\n"), F.col("listed")),
        F.concat(F.lit("## Transcript\n\n"), given("transcript"), F.lit("\n")),
    ]
    return rows.select("session_id", F.concat_ws("\n", *parts).alias("report"))


def sections(summaries: DataFrame, key: str, text: str, title: str, most: int = 12) -> DataFrame:
    """The sections of a Markdown summary: a heading starts one, lines without bullets and bold marks join to its text. A
    section without text goes unless it is the only one; the first `most` stay (a deck is short)."""
    lines = summaries.select(key, F.col(title).alias("title"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    heading = F.col("line").startswith("#")
    running = F.sum(heading.cast("long")).over(Window.partitionBy(key).orderBy("pos"))
    body = F.trim(F.regexp_replace(F.regexp_replace("line", r"^[-* ]+", ""), r"\*\*", ""))
    marked = lines.withColumns({"section": running, "head": F.when(heading, F.regexp_replace("line", "^[# ]+", "")), "body": F.when((F.col("line") != "") & ~heading, body)})
    texts = F.sort_array(F.collect_list(F.when(F.col("body") != "", F.struct("pos", "body"))))
    found = marked.groupBy(key, "section", "title").agg(F.max("head").alias("head"), F.array_join(F.transform(texts, lambda t: t["body"]), " ").alias("text"))
    w = Window.partitionBy(key)
    any_text = F.max((F.col("text") != "").cast("int")).over(w)
    last = F.max("section").over(w)
    kept = found.withColumns({"some": any_text, "last": last}).where((F.col("text") != "") | ((F.col("some") == 0) & (F.col("section") == F.col("last"))))
    numbered = kept.withColumn("no", F.row_number().over(w.orderBy("section")).cast("long")).where(F.col("no") <= most)
    name = F.when(F.coalesce("head", F.lit("")) != "", F.col("head")).otherwise(F.col("title"))
    return numbered.select(key, "no", name.alias("heading"), "text")


def recordings(rows: DataFrame, key: str) -> DataFrame:
    """Of each recording its rows (at, reference, n_words, took, lasts in seconds): real-time factor, words, detections,
    when the first and the last one came, changes of the reference, and the last reference."""
    order = Window.partitionBy(key).orderBy("at", "id")
    seen = rows.where("reference is not null").withColumn("change", F.coalesce((F.lag("reference").over(order) != F.col("reference")).cast("long"), F.lit(0)))
    found = seen.groupBy(key).agg(F.count("*").alias("detections"), F.min("at").alias("first_at"), F.max("at").alias("stable_at"), F.sum("change").alias("oscillations"), F.max_by("reference", F.struct("at", "id")).alias("final_reference"))
    sums = rows.groupBy(key).agg(F.sum("n_words").alias("words"), F.when(F.sum("lasts") > 0, F.round(F.sum("took") / F.sum("lasts"), 6)).alias("real_time_factor"))
    return sums.join(found, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("detections", "oscillations")})


def offsets(segments: DataFrame, key: str) -> DataFrame:
    """Where each segment of a recording starts and ends, from the lengths of those before it."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumn("ends", F.sum("lasts").over(w)).withColumn("starts", F.col("ends") - F.col("lasts"))
