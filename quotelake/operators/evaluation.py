"""Measures of runs: confusion, latency, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelake.functions.text import reference_key


def confusion(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Counts and rates of nullable expected and predicted values; a wrong value counts as false positive and as false
    negative. Precision and recall are 1 where nothing could go wrong."""
    e, p = F.col(expected), F.col(predicted)
    wrong = e.isNotNull() & p.isNotNull() & (e != p)
    out = rows.agg(
        F.count_if(e.isNotNull() & p.isNotNull() & (e == p)).alias("tp"),
        F.count_if((e.isNull() & p.isNotNull()) | wrong).alias("fp"),
        F.count_if((e.isNotNull() & p.isNull()) | wrong).alias("fn"),
        F.count_if(e.isNull() & p.isNull()).alias("tn"),
    )
    ratio = lambda a, b, none: F.when(b > 0, F.round(a / b, 6)).otherwise(none)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rated = out.withColumns({"precision": ratio(tp, tp + fp, 1.0), "recall": ratio(tp, tp + fn, 1.0), "fpr": ratio(fp, fp + tn, 0.0)})
    return rated.withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn, 0.0))


def nearest_rank(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Values at the ranks round((n - 1) * share), half to even, of each group. Equal values are counted before they are
    ordered, so a group is as large as its distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(value)
    upto = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(by)))
    at = lambda r: F.min(F.when(F.col("upto") > F.bround((F.col("total") - 1) * r), F.col(value)))
    return upto.groupBy(by).agg(*(at(r).alias(name) for name, r in shares.items()), F.max(value).alias("largest"))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cases (id, ok) of two runs: regressions, gains, unchanged, disappeared and new ones, with counts."""
    both = before.select("id", F.col("ok").alias("was")).join(after.select("id", F.col("ok").alias("is")), "id", "full_outer")
    kind = F.when(F.col("is").isNull(), "disappeared").when(F.col("was").isNull(), "new").when(F.col("was") & ~F.col("is"), "regression").when(~F.col("was") & F.col("is"), "gain").otherwise("unchanged")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def catalogue(known: DataFrame, imported: DataFrame, installed: DataFrame) -> DataFrame:
    """All entries of a catalogue, of imports and of installations by key, and where each stands."""
    flag = lambda df, name: df.select("key").distinct().withColumn(name, F.lit(True))
    out = known.join(flag(imported, "i"), "key", "full_outer").join(flag(installed, "s"), "key", "full_outer")
    return out.select("key", F.coalesce("name", F.lit("")).alias("name"), F.col("i").isNotNull().alias("imported"), F.col("s").isNotNull().alias("installed"))


def planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Whether a row's passage is planned, and whether the plan has another passage of the same chapter instead. Plan
    rows without a verse plan the whole chapter."""
    verses = plan.where("verse is not null").select("chapter", "verse").distinct().withColumn("p", F.lit(True))
    whole = plan.where("verse is null").select("chapter").distinct().withColumn("w", F.lit(True))
    others = plan.where("verse is not null").groupBy("chapter").agg(F.count("*").alias("verses"))
    joined = rows.join(verses, ["chapter", "verse"], "left").join(whole, "chapter", "left").join(others, "chapter", "left")
    inside = F.col("p").isNotNull() | F.col("w").isNotNull()
    return joined.select("id", inside.alias("in_plan"), (~inside & F.coalesce(F.col("verses") > 0, F.lit(False))).alias("contradicts"))


def grounded(suggestions: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Suggestions (suggestion, raw in per cent) that name a candidate (reference, score) of their list, letters with and
    without marks and everything between words alike, with a confidence that the candidate's score allows. Others go."""
    said = suggestions.withColumn("said", reference_key(F.col("suggestion")))
    listed = candidates.withColumn("said", reference_key(F.col("reference"))).groupBy(key, "said").agg(F.max(F.struct("score", "reference")).alias("c"))
    raw = F.greatest(F.lit(0), F.least(F.lit(100), F.col("raw")))
    return said.join(listed, [key, "said"]).select(key, "c.reference", raw.alias("raw"), "c.score", F.round(F.least(raw, 70 + 30 * F.col("c.score"))).cast("long").alias("confidence"))
