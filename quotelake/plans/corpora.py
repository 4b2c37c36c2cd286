"""Queries of corpus importers over files that are built from `documents` and `pages`, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.functions import books
from quotelake.operators import passages as P
from quotelake.plans.references import SQL_BOOKS
from quotelake.plans.tables import table
from quotelake.sources import corpora as C
from quotelake.sources import files

N = len(books.BOOKS)


def _docs(s, d):
    """Documents with the book of their number and their lines."""
    dim = books.books(s).select((F.col("book_no") - 1).alias("no"), "book_no", "book", "book_abbr")
    return table(s, d, "documents").select("doc_id", F.pmod("doc_id", F.lit(N)).cast("int").alias("no"), F.split("text", "\n").alias("lines"), "text").join(F.broadcast(dim), "no")


def _file(rows, content):
    return rows.select(F.concat(F.lit("V"), F.col("doc_id").cast("string")).alias("name"), F.to_json(content).alias("content"))


def _verses(number, text, base=0):
    return F.transform("lines", lambda line, i: F.struct((i + base).alias(number), line.alias(text)))


def _md5(df, *keys):
    return df.select(*keys, F.md5(F.col("text").cast("binary")).alias("md5"))


def _json_books(s, d):
    """A third of the books are known by their abbreviation only, a third of these by none."""
    known = F.pmod("doc_id", F.lit(3)) > 0
    abbr = F.when(known | (F.pmod("doc_id", F.lit(9)) > 0), F.col("book_abbr")).otherwise("")
    chapters = F.array(F.struct(F.lit(0).alias("chapter"), _verses("verse", "text").alias("verses")))
    return _file(_docs(s, d), F.struct(F.lit("V").alias("version"), F.array(F.struct(F.when(known, F.upper("book")).otherwise("Unheard of").alias("name"), abbr.alias("abbreviation"), chapters.alias("chapters"))).alias("books")))


def _json_testaments(s, d):
    own = F.array(F.struct(F.when(F.pmod("doc_id", F.lit(2)) == 0, F.lit(7)).alias("ID"), _verses("ID", "Text", 10).alias("Verses")))
    books_of = F.array(F.struct(F.col("book").alias("Text"), own.alias("Chapters")))
    return _file(_docs(s, d), F.struct(F.array(F.struct(F.filter(books_of, lambda _: F.lit(False)).alias("Books")), F.struct(books_of.alias("Books"))).alias("Testaments")))


def _json_numbers(s, d):
    """Book numbers run past the known ones, and one key is no number."""
    verses = F.map_from_entries(F.transform("lines", lambda line, i: F.struct((i + 1).cast("string"), line)))
    chapter = F.create_map(F.lit("3"), verses, F.lit("note"), F.create_map(F.lit("1"), F.lit("x")))
    return _file(_docs(s, d), F.create_map((F.pmod("doc_id", F.lit(N + 4)) + 1).cast("string"), chapter))


def _json_lenient(s, d):
    """Four shapes: wrapped, a list with texts as verses, other names, numbered."""
    docs = _docs(s, d)
    kind = F.pmod("doc_id", F.lit(4))
    chapters = lambda key, verses: F.array(F.struct(F.lit(2).alias(key), verses))
    wrapped = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("book").alias("nom"), chapters("num", _verses("v", "content", 1).alias("versets")).alias("chapitres"))).alias("livres")).alias("bible")))
    listed = F.to_json(F.array(F.struct(chapters("ID", F.col("lines").alias("Verses")).alias("Chapters"))))
    named = F.to_json(F.struct(F.array(F.struct(F.col("book").alias("title"), chapters("c", _verses("ID", "Text", 1).alias("verses")).alias("chapters"))).alias("books_list")))
    verses = F.map_from_entries(F.transform("lines", lambda line, i: F.struct((i + 1).cast("string"), line)))
    numbered = F.to_json(F.create_map(F.lit("1"), F.create_map(F.lit("2"), verses)))
    content = F.when(kind == 0, wrapped).when(kind == 1, listed).when(kind == 2, named).otherwise(numbered)
    return docs.select(F.concat(F.lit("V"), F.col("doc_id").cast("string")).alias("name"), content.alias("content"))


def _xml(s, d):
    """Two vocabularies; parts of a verse's text stand in an element of their own."""
    safe = lambda c: F.replace(F.replace(F.regexp_replace(c, "[\x00-\x08\x0b-\x1f]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    upper = F.transform("lines", lambda line, i: F.concat(F.lit('<VERS vnumber="'), (i + 5).cast("string"), F.lit('"><i>'), safe(F.substring(line, 1, 3)), F.lit("</i>"), safe(F.substring(line, 4, 1 << 30)), F.lit("</VERS>")))
    lower = F.transform("lines", lambda line: F.concat(F.lit("<v>"), safe(line), F.lit("</v>")))
    big = F.concat(F.lit('<XMLBIBLE><BIBLEBOOK bname="'), "book", F.lit('"><CHAPTER cnumber="4">'), F.array_join(upper, ""), F.lit("</CHAPTER></BIBLEBOOK></XMLBIBLE>"))
    small = F.concat(F.lit("<bible><book><c>"), F.array_join(lower, "\n"), F.lit("</c></book></bible>"))
    kind = F.pmod("doc_id", F.lit(3))
    return _docs(s, d).select(F.concat(F.lit("V"), F.col("doc_id").cast("string")).alias("name"), F.when(kind == 0, big).when(kind == 1, small).otherwise("<open>").alias("content"))


def _marked(s, d):
    """A verse for each line, a note in it, and a second line with a marker."""
    lines = F.transform("lines", lambda line, i: F.concat(F.when(i == 0, F.lit("\\c 2\n\\p\n")).otherwise(""), F.lit("\\v "), (i + 1).cast("string"), F.when(i == 1, F.lit("-3")).otherwise(""), F.lit(" "), F.replace(line, F.lit("\\"), F.lit("")), F.lit(" \\f + \\ft a note\\f*\n\\q1 and \\nd more\\nd*")))
    head = F.concat(F.lit("\\id XXX\n\\h Short\n"), F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.lit("\\toc2 "), "book", F.lit("\n"))).otherwise(""))
    return _docs(s, d).select(F.concat(F.lit("V"), F.col("doc_id").cast("string")).alias("name"), F.concat(head, F.array_join(lines, "\n")).alias("content"))


def _validated(s, d):
    """Files with one fault each, by number."""
    lines = F.slice("lines", 1, 3)
    good = F.transform(lines, lambda x: F.struct(x.alias("text")))
    book = lambda name, chapters: F.to_json(F.struct(F.array(F.struct(name.alias("name"), chapters.alias("chapters"))).alias("books"), F.lit("de").alias("language")))
    chapters = F.array(F.struct(F.lit(1).alias("chapter"), good.alias("verses")))
    cases = [
        book(F.lit("Jean"), chapters),
        F.lit('{"books": []}'),
        book(F.lit("Jean"), F.array().cast("array<string>")),
        F.lit('{"books": [{"name": "Jean", "chapters": [{"chapter": 1, "verses": [{"verse": 1}]}]}]}'),
        book(F.lit(""), chapters),
        F.lit("{this is no json"),
        F.lit('{"books": [{"abbreviation": "Jn", "chapters": [{"chapter": 1}]}]}'),
        F.lit('{"books": [{"name": "Jean", "chapters": [{"chapter": 1, "verses": []}]}], "version": " sem "}'),
        F.lit('[{"name": "Jean", "chapters": [{"chapter": 1, "verses": [{"verse": 1, "text": "x"}]}]}]'),
    ]
    kind = F.pmod("doc_id", F.lit(len(cases)))
    rows = _docs(s, d).select(F.concat(F.lit("V"), F.col("doc_id").cast("string")).alias("name"), F.coalesce(*(F.when(kind == i, c) for i, c in enumerate(cases))).alias("content"))
    return C.validated(rows)


def _folders(s, d):
    """Items in files of two folders; the second replaces versions of the first, notes are left out."""
    root = files.shared_folder(s, "versions")
    item = table(s, d, "benchmark").select(F.format_string("name%d", F.pmod("item_id", F.lit(4))).alias("v"), "item_id", "text")
    texts = item.groupBy("v").agg(F.min_by("text", "item_id").alias("first"), F.max_by("text", "item_id").alias("last"))
    named = F.element_at(F.create_map(*(F.lit(x) for x in ("name0", "semeur", "name1", "oecumenique", "name2", "kjf", "name3", "note.meta"))), F.col("v"))
    rows = texts.select(named.alias("file"), "first", "last")
    write = lambda df, column, folder: [df.where(F.col("file") == f).select(column).coalesce(1).write.text(f"{root}/{folder}/{f}.json") for f in ("semeur", "oecumenique", "kjf", "note.meta")]
    write(rows, "first", "a")
    write(rows.where("file <> 'kjf'"), "last", "b")
    return _read_written(s, root)


def _read_written(s, root):
    parts = [s.read.text(f"{root}/{f}", wholetext=True, recursiveFileLookup=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("file"), F.lit(i).alias("place"), F.col("value").alias("content")) for i, f in enumerate("ab")]
    return C.versions_of(parts[0].unionByName(parts[1])).select("name", F.md5(F.rtrim(F.regexp_replace("content", r"\n\z", "")).cast("binary")).alias("md5"))


def _chapter_readings(s, d):
    passages = P.from_documents(table(s, d, "documents"))
    asked = table(s, d, "labels").select(F.col("doc_id").alias("ask_id"), F.when(F.pmod("doc_id", F.lit(2)) == 0, F.lit("xx")).otherwise("en").alias("version"), F.col("doc_id").alias("chapter")).distinct()
    sources = passages.select("book", "chapter").distinct()
    return _md5(C.chapter(passages, asked.join(sources, "chapter"), "fr"), "ask_id", "version", "verse", "n")


QUERIES = {
    "import_books": lambda s, d: _md5(C.from_books(_json_books(s, d)), "version", "book", "chapter", "verse"),
    "import_testaments": lambda s, d: _md5(C.from_testaments(_json_testaments(s, d)), "version", "book", "chapter", "verse"),
    "import_numbers": lambda s, d: _md5(C.from_numbers(_json_numbers(s, d)), "version", "book", "chapter", "verse"),
    "import_lenient": lambda s, d: _md5(C.normalised(_json_lenient(s, d)), "version", "book_no", "book", "chapter", "verse"),
    "import_xml": lambda s, d: _md5(C.from_xml(_xml(s, d)), "version", "book_no", "book", "chapter", "verse"),
    "import_marked_text": lambda s, d: _md5(C.from_marked_text(_marked(s, d)), "version", "book", "chapter", "verse"),
    "import_reasons": _validated,
    "version_files": _folders,
    "import_sigils": lambda s, d: table(s, d, "documents").select("doc_id", C.sigil(F.element_at(F.array(*map(F.lit, ("", "nbs21", "A", "trop-long-vraiment", "AB CD", "lsg"))), (F.pmod("doc_id", F.lit(6)) + 1).cast("int")), F.lit("sem")).alias("sigil")),
    "chapter_readings": _chapter_readings,
    "leading_versions": lambda s, d: _md5(C.priority_union(P.from_documents(table(s, d, "documents")).withColumn("chapter", F.lit(1)).groupBy("version", "book", "chapter", "verse").agg(F.min("text").alias("text")), "fr"), "book", "verse", "lead", "versions"),
}

DOCS = f"""{SQL_BOOKS}, l AS (SELECT doc_id, lang, source, no, abbr, book, unnest(string_split(text, chr(10))) AS raw, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS i FROM documents JOIN b ON no = doc_id % {N}),
d AS (SELECT *, 'V' || doc_id AS version, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS t FROM l)"""

ORACLE_SQL = {
    "import_books": f"""WITH {DOCS}, n AS (SELECT *, greatest(i - 1, 1) AS verse FROM d WHERE doc_id % 9 <> 0)
SELECT version, lower(abbr) AS book, CAST(1 AS BIGINT) AS chapter, verse, md5(arg_max(t, i)) AS md5 FROM n GROUP BY ALL""",
    "import_testaments": f"WITH {DOCS} SELECT version, lower(abbr) AS book, CAST(CASE WHEN doc_id % 2 = 0 THEN 7 ELSE 1 END AS BIGINT) AS chapter, i + 9 AS verse, md5(t) AS md5 FROM d",
    "import_numbers": f"WITH {DOCS} SELECT version, lower(k.abbr) AS book, CAST(3 AS BIGINT) AS chapter, i AS verse, md5(t) AS md5 FROM d JOIN b k ON k.no = doc_id % {N + 4}",
    "import_lenient": f"""WITH {DOCS} SELECT version, 1 AS book_no, CASE WHEN doc_id % 2 = 1 THEN 'Genèse' ELSE book END AS book, CAST(2 AS BIGINT) AS chapter, i AS verse, md5(t) AS md5 FROM d WHERE t <> ''""",
    "import_xml": f"""WITH {DOCS} SELECT version, 1 AS book_no, CASE WHEN doc_id % 3 = 0 THEN book ELSE 'Genèse' END AS book, CAST(CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 1 END AS BIGINT) AS chapter, CASE WHEN doc_id % 3 = 0 THEN i + 4 ELSE i END AS verse, md5(t) AS md5
FROM d WHERE doc_id % 3 < 2 AND t <> ''""",
    "import_marked_text": f"""WITH {DOCS} SELECT version, CASE WHEN doc_id % 2 = 0 THEN book ELSE 'Short' END AS book, CAST(2 AS BIGINT) AS chapter, i AS verse, md5(trim(regexp_replace(t || ' and more', '\\s+', ' ', 'g'))) AS md5 FROM d""",
    "import_reasons": """WITH d AS (SELECT 'V' || doc_id AS name, doc_id % 9 AS k, least(3, len(string_split(text, chr(10)))) AS n FROM documents)
SELECT name, ['', 'no book', 'Jean has no chapters', 'Jean has a verse without text', '1 books without name', 'not readable as JSON', 'Jn has a chapter without verses', 'no passage', ''][k + 1] AS reason,
 CASE WHEN k IN (0, 8) THEN 1 END AS books, CASE WHEN k IN (0, 8) THEN 1 END AS chapters, CASE k WHEN 0 THEN n WHEN 8 THEN 1 END AS verses, CASE k WHEN 0 THEN 'de' WHEN 8 THEN 'fr' END AS language, CASE WHEN k IN (0, 8) THEN '' END AS version FROM d""",
    "version_files": """SELECT ['SEM', 'TOB', 'KJF'][item_id % 4 + 1] AS name, md5(rtrim(CASE WHEN item_id % 4 = 2 THEN arg_min(text, item_id) ELSE arg_max(text, item_id) END)) AS md5 FROM benchmark WHERE item_id % 4 < 3 GROUP BY item_id % 4""",
    "import_sigils": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'SEM' WHEN 1 THEN 'NBS21' END AS sigil FROM documents",
    "chapter_readings": """WITH p AS (SELECT lang, source, doc_id, CAST(i AS BIGINT) AS verse, trim(line) AS text FROM (SELECT *, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line) <> '')
SELECT doc_id AS ask_id, lang AS version, verse, count(*) OVER (PARTITION BY doc_id) AS n, md5(text) AS md5 FROM p WHERE doc_id IN (SELECT doc_id FROM labels) AND lang = CASE WHEN doc_id % 2 = 0 THEN 'fr' ELSE 'en' END""",
    "leading_versions": """WITH p AS (SELECT lang, source, CAST(i AS BIGINT) AS verse, min(trim(line)) AS text FROM (SELECT *, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line) <> '' GROUP BY ALL)
SELECT source AS book, verse, arg_min(lang, (lang <> 'fr', lang)) AS lead, count(DISTINCT lang) AS versions, md5(arg_min(text, (lang <> 'fr', lang))) AS md5 FROM p GROUP BY source, verse""",
}
