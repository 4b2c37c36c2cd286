"""Importers of corpus files: JSON in several shapes, XML and marked-up text, as passages (version, book, chapter, verse,
text).

Files come as rows (name, content), each file one value, as Spark's text source reads them with `wholetext`. Nested JSON is
read level by level with from_json over arrays and maps of JSON text, so other members of an object do no harm.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotelake.functions import books
from quotelake.functions.text import bound, fold

# Versions that go by other names in file names, and versions that are no imports.
ALIASES = {"SEMEUR": "SEM", "OECUMENIQUE": "TOB", "FRANCAIS_COURANT": "FC", "NOUVELLE_SEGOND": "NBS"}
RESERVED = ("LSG", "KJF")
PASSAGE = ["version", "book", "chapter", "verse"]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def read_files(spark: SparkSession, *folders: str) -> DataFrame:
    """version, place (of the folder) and content of the .json files in folders, but not of .meta.json files. A version is
    named by its file; of two files of one version that of the later folder counts."""
    parts = [spark.read.text(f, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.lit(i).alias("place"), F.col("value").alias("content")) for i, f in enumerate(folders)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return versions_of(rows.withColumn("file", F.url_decode("file")))


def versions_of(rows: DataFrame) -> DataFrame:
    """name and content of the versions among files (file, place, content)."""
    rows = rows.where("file like '%.json' and file not like '%.meta.json'")
    named = F.upper(F.regexp_replace("file", r"\.json$", ""))
    version = F.coalesce(*(F.when(named == a, b) for a, b in ALIASES.items()), named)
    return rows.withColumn("name", version).groupBy("name").agg(F.max_by("content", F.struct("place", "file")).alias("content"))


def _members(text: Column) -> Column:
    """The JSON texts of an array's members, null for what is no array."""
    return F.from_json(F.when(F.ltrim(text).startswith("["), text), "array<string>")


def _get(obj: Column, *names: str, number: bool = False) -> Column:
    """The first member of these names that is there, not empty (nor 0, for numbers)."""
    there = lambda f: F.when((f != "") & ~((f == "0") & F.lit(number)), f)
    return F.coalesce(*(bound(F.get_json_object(obj, f"$['{n}']"), there) for n in names))


def _books(files: DataFrame, array: Column) -> DataFrame:
    return files.select(F.col("name").alias("version"), F.posexplode(array).alias("b_no", "b"))


def _inside(rows: DataFrame, outer: str, inner: str, names: tuple[str, ...], more: dict[str, Column]) -> DataFrame:
    """A row for each member of an object's array, with columns `more` of the object. These are made before the members
    are apart and the object stays behind: no member carries the text of all of them."""
    members = rows.select(*(c for c in rows.columns if c != outer), *(c.alias(n) for n, c in more.items()), _members(_get(F.col(outer), *names)).alias("members"))
    return members.select(*(c for c in members.columns if c != "members"), F.posexplode("members").alias(f"{inner}_no", inner))


def _chapters(rows: DataFrame, *names: str, **more: Column) -> DataFrame:
    return _inside(rows, "b", "c", names, more)


def _verses(rows: DataFrame, *names: str, **more: Column) -> DataFrame:
    return _inside(rows, "c", "v", names, more)


def _last(rows: DataFrame) -> DataFrame:
    """One row for each passage: of several of one number the last in the file."""
    place = F.struct("b_no", "c_no", "v_no")
    return rows.groupBy(*PASSAGE).agg(F.max_by("text", place).alias("text"))


def _standard(rows: DataFrame, name: str, fallback: Column) -> DataFrame:
    """rows with book, the lower-case abbreviation of the book that `name` names in full; rows without one or the other
    go."""
    dim = rows.sparkSession.createDataFrame(books.names(), "standard string, book_abbr string")
    key = F.regexp_replace(F.regexp_replace(strip(fold(F.col(name))), "[’`]", "'"), r"\s+", " ")
    out = rows.withColumn("standard", key).join(F.broadcast(dim), "standard", "left")
    return out.withColumn("book", F.lower(F.coalesce("book_abbr", F.when(strip(fallback) != "", strip(fallback))))).drop("standard", "book_abbr").where("book is not null")


def from_books(files: DataFrame) -> DataFrame:
    """{"books": [{name, abbreviation, chapters: [{chapter, verses: [{verse, text}]}]}]}. Books are known by their names,
    then by the abbreviation they bring; number 0 means 1."""
    number = lambda c, n: F.greatest(F.coalesce(_get(F.col(c), n).try_cast("long"), F.lit(0)), F.lit(0))
    one = lambda x: F.when(x == 0, 1).otherwise(x)
    found = _books(files, _members(F.get_json_object("content", "$.books")))
    rows = _verses(_chapters(found, "chapters", n=_get(F.col("b"), "name"), other=F.coalesce(_get(F.col("b"), "abbreviation"), F.lit(""))), "verses", chapter=one(number("c", "chapter")))
    rows = rows.withColumns({"verse": one(number("v", "verse")), "text": strip(F.coalesce(_get(F.col("v"), "text"), F.lit("")))})
    return _last(_standard(rows, "n", F.col("other")))


def from_testaments(files: DataFrame) -> DataFrame:
    """{"Testaments": [{"Books": [{Text, Chapters: [{ID, Verses: [{ID, Text}]}]}]}]}; numbers are IDs or places."""
    groups = files.select("name", F.posexplode(_members(F.get_json_object("content", "$.Testaments"))).alias("t_no", "t"))
    found = groups.select(F.col("name").alias("version"), "t_no", F.posexplode(_members(_get(F.col("t"), "Books"))).alias("no", "b")).withColumn("b_no", F.struct("t_no", "no"))
    number = lambda c, no: F.coalesce(F.get_json_object(c, "$.ID").try_cast("long"), F.col(no).cast("long") + 1)
    rows = _verses(_chapters(found, "Chapters", n=_get(F.col("b"), "Text")), "Verses", chapter=number("c", "c_no"))
    rows = rows.withColumns({"verse": number("v", "v_no"), "text": strip(F.coalesce(_get(F.col("v"), "Text"), F.lit("")))})
    return _last(_standard(rows, "n", F.lit("")))


def _numbered(files: DataFrame) -> DataFrame:
    """b, c, v (numbers as text) and text of {"1": {"1": {"1": text}}}; keys that are no numbers are left out."""
    maps = "map<string, string>"
    digits = lambda c: F.col(c).rlike("^[0-9]+$")
    rows = files.select(F.col("name").alias("version"), F.explode(F.from_json("content", maps)).alias("b", "x")).where(digits("b") & F.col("x").startswith("{"))
    rows = rows.select("version", "b", F.explode(F.from_json("x", maps)).alias("c", "y")).where(digits("c") & F.col("y").startswith("{"))
    return rows.select("version", "b", "c", F.explode(F.from_json("y", maps)).alias("v", "text")).where(digits("v"))


def from_numbers(files: DataFrame) -> DataFrame:
    """{"1": {"1": {"1": text}}}: books by their place among the known ones."""
    dim = books.books(files.sparkSession).select(F.col("book_no").alias("no"), F.lower("book_abbr").alias("book"))
    rows = _numbered(files).withColumn("no", F.col("b").cast("int")).join(F.broadcast(dim), "no")
    return rows.select("version", "book", F.col("c").cast("long").alias("chapter"), F.col("v").cast("long").alias("verse"), strip(F.col("text")).alias("text"))


def normalised(files: DataFrame) -> DataFrame:
    """version, book_no, book, chapter, verse, text of any of the JSON shapes: under a member bible, data or corpus, in
    testaments, as a list or under several names, with verses as objects or texts, or numbered. Empty texts, and chapters
    and books without any, go. A book without a name has that of its place."""
    nested = lambda x: F.when(x.rlike(r"^\s*[\[{]"), x)
    # each text is read once for each name that it may have, not once more for each time that it stands in an expression
    unwrapped = lambda t: F.coalesce(*(bound(F.get_json_object(t, f"$.{k}"), nested) for k in ("bible", "data", "corpus")), t)
    files = files.select("name", bound(bound(F.col("content"), unwrapped), unwrapped).alias("content"))
    testaments = F.filter(F.transform(_members(_get(F.col("content"), "Testaments", "testaments", "TESTAMENTS")), lambda t: _members(_get(t, "Books", "books", "LIVRES", "livres"))), lambda x: x.isNotNull())
    listed = F.coalesce(_members(F.col("content")), F.flatten(testaments), _members(_get(F.col("content"), "books", "livres", "book", "LIVRES", "books_list")))
    titles = F.array(*(F.lit(d) for _, _, d, _ in books.BOOKS))
    named = lambda no: F.coalesce(F.get(titles, no), F.concat(F.lit("Book "), (no + 1).cast("string")))
    obj = F.col("v").startswith("{")
    number = lambda c, no, *names: F.coalesce(_get(F.col(c), *names, number=True).try_cast("long"), F.col(no).cast("long") + 1)
    name = strip(F.coalesce(_get(F.col("b"), "name", "Text", "title", "bname", "nom", "abbreviation"), named(F.col("b_no"))))
    rows = _chapters(_books(files, listed), "chapters", "Chapters", "chapitres", book=name)
    rows = _verses(rows, "verses", "Verses", "versets", chapter=number("c", "c_no", "chapter", "num", "ID", "c"))
    text = strip(F.when(obj, _get(F.col("v"), "text", "Text", "texte", "content")).otherwise(F.col("v")))
    verse = F.when(obj, number("v", "v_no", "verse", "num", "ID", "v")).otherwise(F.col("v_no").cast("long") + 1)
    nested = rows.select("version", (F.col("b_no") + 1).cast("int").alias("book_no"), "book", "chapter", verse.alias("verse"), text.alias("text"))
    keyed = _numbered(files.where(listed.isNull())).select("version", F.col("b").cast("int").alias("book_no"), named(F.col("b").cast("int") - 1).alias("book"), F.col("c").cast("long").alias("chapter"), F.col("v").cast("long").alias("verse"), strip(F.col("text")).alias("text"))
    return nested.unionByName(keyed).where("text <> ''")


def _attribute(node: ET.Element, *names: str) -> str | None:
    return next((node.attrib[n] for n in names if node.attrib.get(n)), None)


def _first(node: ET.Element, *paths: str) -> list[ET.Element]:
    return next((found for p in paths if (found := node.findall(p))), [])


def _xml_verses(content: str) -> Iterator[tuple]:
    root = ET.fromstring(content)
    own = any(t in root.tag.upper() for t in ("BOOK", "LIVRE")) and root.tag.upper() != "XMLBIBLE"
    found = [root] if own else _first(root, ".//BIBLEBOOK", ".//book", ".//Book", ".//livre", ".//Livre", ".//div[@type='book']")
    for i, book in enumerate(found):
        name = _attribute(book, "bname", "name", "n") or (books.BOOKS[i][2] if i < len(books.BOOKS) else f"Book {i + 1}")
        for j, chapter in enumerate(_first(book, ".//CHAPTER", ".//chapter", ".//c")):
            for k, verse in enumerate(_first(chapter, ".//VERS", ".//verse", ".//v")):
                yield i + 1, name, int(_attribute(chapter, "cnumber", "n") or j + 1), int(_attribute(verse, "vnumber", "n") or k + 1), "".join(verse.itertext()).strip()


#: Verses that the importer of XML hands on at once.
XML_ROWS = 10_000


def _xml_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The verses of files, XML_ROWS or more at once: a frame for each file costs more than its verses."""
    frame = lambda: pd.DataFrame(rows, columns=["version", "book_no", "book", "chapter", "verse", "text"])
    rows: list[tuple] = []
    for batch in batches:
        for version, content in zip(batch["name"], batch["content"], strict=True):
            try:
                rows += [(version, *v) for v in _xml_verses((content or "").strip())]
            except (ET.ParseError, ValueError):
                continue
            if len(rows) >= XML_ROWS:
                yield frame()
                rows = []
    yield frame()


def from_xml(files: DataFrame) -> DataFrame:
    """version, book_no, book, chapter, verse, text of XML files whose books, chapters and verses are elements; text of
    elements inside a verse is part of it, numbers are attributes or places. A file that is no XML gives no rows."""
    rows = files.select("name", "content").mapInPandas(_xml_frames, "version string, book_no int, book string, chapter long, verse long, text string")
    return rows.where("text <> ''")


def clean_markup(text: Column) -> Column:
    """Text without notes, references and markers, with single spaces."""
    text = F.regexp_replace(text, r"(?s)\\f\s+.*?(?:\\f\*|$)", "")
    text = F.regexp_replace(text, r"(?s)\\x\s+.*?(?:\\x\*|$)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\\[a-z0-9+*]+", ""), r"(?U) \s+|[^\S ]\s*", " "))


def from_marked_text(files: DataFrame) -> DataFrame:
    """Passages of text with backslash markers: \\c starts a chapter, \\v a verse (or a range, by its first), other lines
    belong to the verse before them, without their leading marker. The book's name is that of \\toc2 or \\h, the file's
    otherwise. A verse that a chapter has twice is kept twice. Lines are numbered in their file, so running sums find the
    chapter and the verse of each."""
    title = lambda m: bound(F.regexp_extract("content", rf"\\{m}\s+(.*)", 1), lambda t: F.when(t != "", strip(t)))
    # titles are looked for once in a file, before its lines are apart
    titled = files.select("name", F.coalesce(title("toc2"), title("h"), "name").alias("book"), "content")
    lines = titled.select("name", "book", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("no", "line"))
    spaced = F.concat(F.substring("line", 1, 1), F.substring("line", -1, 1)).rlike(r"(?U)\s")
    lines = lines.withColumn("line", F.when(spaced, strip(F.col("line"))).otherwise(F.col("line"))).where("line <> ''")
    number = lambda m: bound(F.when(F.col("line").startswith(f"\\{m}"), F.regexp_extract("line", rf"^\\{m}\s+(\d+)", 1)), lambda n: F.when(n != "", n))
    lines = lines.select("name", "book", "no", "line", number("c").alias("c"), number("v").alias("v"))
    w = Window.partitionBy("name").orderBy("no")
    lines = lines.withColumns({"chapter": F.last("c", ignorenulls=True).over(w), "part": F.sum((F.col("c").isNotNull() | F.col("v").isNotNull()).cast("long")).over(w)})
    # one pattern in each place: one that changes from line to line is compiled for each
    bare = F.when(F.col("v").isNotNull(), F.regexp_replace("line", r"^\\v\s+\d+(?:-\d+)?\s*", "")).when(F.col("line").startswith("\\"), F.regexp_replace("line", r"^\\[a-z0-9+]+\s*", ""))
    text = F.when(F.col("c").isNull(), bare.otherwise(F.col("line")))
    parts = lines.withColumn("t", text).groupBy("name", "book", "part").agg(F.max("chapter").alias("chapter"), F.max("v").alias("verse"), F.sort_array(F.collect_list(F.when(F.col("t") != "", F.struct("no", "t")))).alias("lines"))
    rows = parts.where("verse is not null and chapter is not null").withColumn("text", clean_markup(F.array_join(F.transform("lines", lambda x: x["t"]), " ")))
    return rows.where("text <> ''").select(F.col("name").alias("version"), "book", F.col("chapter").cast("long").alias("chapter"), F.col("verse").cast("long").alias("verse"), "text")


def validated(files: DataFrame, most_bytes: int = 80 << 20) -> DataFrame:
    """name, reason, books, chapters, verses, language, version of each file of the shape of `from_books` (or a list of
    books): the first reason against it, or none, and what it holds."""
    text = F.coalesce(F.col("content"), F.lit(""))
    root = F.when(F.ltrim(text).startswith("["), text).otherwise(F.get_json_object(text, "$.books"))
    books_of = _members(root)
    # what is no object, has no name, no chapters, a chapter that is none or has no verses, a verse without text
    name_of = lambda b: F.coalesce(_get(b, "name"), _get(b, "abbreviation"), F.lit(""))
    chapters_of = lambda b: F.coalesce(_members(F.get_json_object(b, "$.chapters")), F.array().cast("array<string>"))
    verses_of = lambda c: _members(F.get_json_object(c, "$.verses"))
    is_object = lambda x: F.ltrim(x).startswith("{")

    def against(b: Column) -> Column:
        name, chapters = name_of(b), chapters_of(b)
        bad_chapter = F.exists(chapters, lambda c: ~is_object(c))
        no_list = F.exists(chapters, lambda c: is_object(c) & verses_of(c).isNull())
        no_text = F.exists(chapters, lambda c: F.exists(F.coalesce(verses_of(c), F.array().cast("array<string>")), lambda v: ~is_object(v) | F.get_json_object(v, "$.text").isNull()))
        found = F.when(F.size(chapters) == 0, "has no chapters").when(bad_chapter, "has a chapter that is no object").when(no_list, "has a chapter without verses").when(no_text, "has a verse without text")
        return F.when(~is_object(b), "a book is no object").when(strip(name) != "", F.concat(strip(name), F.lit(" "), found))

    named = F.filter(books_of, lambda b: strip(name_of(b)) != "")
    counted = F.filter(F.flatten(F.transform(named, chapters_of)), is_object)
    n_verses = F.aggregate(counted, F.lit(0), lambda n, c: n + F.coalesce(F.size(verses_of(c)), F.lit(0)))
    unnamed = F.size(F.filter(books_of, lambda b: is_object(b) & (strip(name_of(b)) == "")))
    json = F.try_parse_json(text)
    first = F.get(F.filter(F.transform(books_of, against), lambda r: r.isNotNull()), F.lit(0))
    reason = (
        F.when(F.octet_length(text) > most_bytes, "too large")
        .when(json.isNull() | (text == ""), "not readable as JSON")
        .when(books_of.isNull() | (F.size(books_of) < 1), "no book")
        .otherwise(F.coalesce(first, F.when(unnamed > 0, F.concat(unnamed.cast("string"), F.lit(" books without name"))), F.when(n_verses == 0, "no passage"), F.lit("")))
    )
    counts = {"books": F.size(books_of), "chapters": F.size(counted), "verses": n_verses}
    ok = F.col("reason") == ""
    out = files.select("name", reason.alias("reason"), *(c.cast("long").alias(n) for n, c in counts.items()), F.coalesce(_get(text, "language"), F.lit("fr")).alias("language"), F.upper(strip(F.coalesce(_get(text, "version"), F.lit("")))).alias("version"))
    return out.select("name", "reason", *(F.when(ok, F.col(c)).alias(c) for c in ("books", "chapters", "verses", "language", "version")))


def sigil(proposed: Column, version: Column) -> Column:
    """The short name of an import: the proposed one or that of the file, two to eight letters or digits, not reserved;
    null otherwise."""
    name = F.upper(strip(F.coalesce(F.when(proposed != "", proposed), version, F.lit(""))))
    return F.when(name.rlike("^[A-Z0-9]{2,8}$") & ~name.isin(*RESERVED), name)


def chapter(passages: DataFrame, asked: DataFrame, active: str) -> DataFrame:
    """All verses of the chapters that are asked for (ask_id, version, book, chapter), in their order with their number;
    of a version that isn't there those of the active one."""
    there = passages.select("version").distinct().withColumn("there", F.lit(True))
    chosen = asked.join(F.broadcast(there), "version", "left").withColumn("version", F.when(F.col("there"), F.col("version")).otherwise(active)).drop("there")
    rows = passages.join(chosen, ["version", "book", "chapter"])
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("ask_id"))).select("ask_id", "version", "verse", "text", "n")


def priority_union(passages: DataFrame, active: str) -> DataFrame:
    """One row per passage over all versions, with the version that leads it: the active one, then by name."""
    order = F.struct((F.col("version") != active).cast("int").alias("other"), F.col("version").alias("version"))
    return passages.where("text <> ''").groupBy("book", "chapter", "verse").agg(F.min_by("version", order).alias("lead"), F.min_by("text", order).alias("text"), F.countDistinct("version").alias("versions"))
