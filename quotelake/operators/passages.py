"""Passages: numbered lines of documents, and joins over their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelake.functions.text import fragment


def from_documents(documents: DataFrame) -> DataFrame:
    """version, book, chapter and verse of each non-empty line; verses count from 1 as they stand in the text."""
    lines = documents.select(F.col("lang").alias("version"), F.col("source").alias("book"), F.col("doc_id").alias("chapter"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.trim("line") != "").select("version", "book", "chapter", (F.col("pos") + 1).cast("long").alias("verse"), F.trim("line").alias("text"))


def in_range(passages: DataFrame, first: int, last: int) -> DataFrame:
    """The text of a range of verses of each chapter, missing verses skipped."""
    parts = F.sort_array(F.collect_list(F.struct("verse", "text")))
    return passages.where(F.col("verse").between(first, last)).groupBy("chapter").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def translations(passages: DataFrame) -> DataFrame:
    """For each book and verse number the text of every version, from its first chapter."""
    first = passages.where("version is not null").groupBy("book", "verse", "version").agg(F.min(F.struct("chapter", "text"))["text"].alias("text"))
    return first.groupBy("book", "verse").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("version", "text")))).alias("texts"))


def neighbours(passages: DataFrame) -> DataFrame:
    """The verses right before and after, in the same chapter only."""
    w = Window.partitionBy("chapter").orderBy("verse")
    after, before = F.lead(F.struct("verse", "text")).over(w), F.lag(F.struct("verse", "text")).over(w)
    rows = passages.withColumn("after", after).withColumn("before", before)
    return rows.select("chapter", "verse", F.when(F.col("after.verse") == F.col("verse") + 1, F.col("after.text")).alias("next_text"), F.when(F.col("before.verse") == F.col("verse") - 1, F.col("before.text")).alias("previous_text"), "text")


def joined_pairs(passages: DataFrame) -> DataFrame:
    """A verse with the next one, as one text."""
    return neighbours(passages).where("next_text is not null").select("chapter", "verse", F.concat_ws(" ", "text", "next_text").alias("text"))


def neighbour_numbers(passages: DataFrame, each_side: int) -> DataFrame:
    """Up to twice `each_side` verse numbers around a verse, shifted at both ends of the chapter, without its own."""
    last = passages.groupBy("chapter").agg(F.max("verse").alias("last"))
    rows = passages.select("chapter", "verse").join(last, "chapter")
    low = F.greatest(F.lit(1), F.least(F.col("verse") - each_side, F.col("last") - 2 * each_side))
    high = F.least(F.col("last"), low + 2 * each_side)
    return rows.select("chapter", "verse", F.array_join(F.array_remove(F.sequence(low, high), F.col("verse")).cast("array<string>"), ",").alias("numbers"))


def validated(documents: DataFrame) -> DataFrame:
    """Counts of lines and the first reason against an import, if there is one."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    reason = F.when(F.col("text").isNull(), "no text").when(F.size(lines) == 0, "no passage").when(F.trim(F.coalesce("source", F.lit(""))) == "", "no name")
    return documents.select("doc_id", F.size(lines).cast("long").alias("verses"), F.coalesce(reason, F.lit("")).alias("reason"))


def valid_sigils(documents: DataFrame, column: str, reserved: tuple[str, ...]) -> DataFrame:
    """Whether the upper-cased name is two to eight letters and digits and not reserved."""
    sigil = F.upper(F.regexp_replace(F.col(column), r"[^A-Za-z0-9]", ""))
    return documents.select(column).distinct().select(column, sigil.alias("sigil"), (sigil.rlike("^[A-Z0-9]{2,8}$") & ~sigil.isin(*reserved)).alias("valid"))


def counts(passages: DataFrame) -> DataFrame:
    """Counts of a corpus and a short fingerprint of them."""
    sums = passages.groupBy("version").agg(F.countDistinct("book").alias("books"), F.countDistinct("chapter").alias("chapters"), F.count("*").alias("verses"))
    return sums.withColumn("fingerprint", F.substring(F.sha2(F.concat_ws(":", "version", "books", "chapters", "verses"), 256), 1, 16))


def words(passages: DataFrame) -> DataFrame:
    """chapter and word, once for each word of a chapter."""
    return passages.select("chapter", F.explode(F.split(fragment(F.col("text")), " ")).alias("word")).where("word <> ''").distinct()


def chapter_rows(passages: DataFrame) -> DataFrame:
    """book, chapter, first, n: where the verses of each chapter stand if all (book, chapter, verse) are numbered from 0 in
    their order. Each book is summed first, so that only books, then the chapters of one book, come together."""
    chapters = passages.select("book", "chapter", "verse").distinct().groupBy("book", "chapter").agg(F.count("*").alias("n"))
    books = chapters.groupBy("book").agg(F.sum("n").alias("size"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    books = books.select("book", before(Window.orderBy("book"), "size").alias("start"))
    return chapters.join(books, "book").select("book", "chapter", (F.col("start") + before(Window.partitionBy("book").orderBy("chapter"), "n")).alias("first"), "n")


def numbered_rows(passages: DataFrame, rows: DataFrame) -> DataFrame:
    """book, chapter, verse, row: the number of each verse in that order, by its place in its chapter (`rows` is the map)."""
    place = F.row_number().over(Window.partitionBy("book", "chapter").orderBy("verse")) - 1
    verses = passages.select("book", "chapter", "verse").distinct().withColumn("place", place)
    return verses.join(rows.select("book", "chapter", "first"), ["book", "chapter"]).select("book", "chapter", "verse", (F.col("first") + F.col("place")).alias("row"))


def sliced(values: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """What `values` (row, ...) have in the chapters that are asked for (book, chapter): only the rows of their slices."""
    wanted = rows.join(asked.select("book", "chapter").distinct(), ["book", "chapter"])
    numbers = wanted.select("book", "chapter", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("row"))
    return values.join(numbers, "row")
