"""Typed search: fragments of passages anywhere in them, with small mistakes."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelake.functions.text import bound, fragment, tokens
from quotelake.functions.words import TYPED_STOP
from quotelake.operators.engine import Tables
from quotelake.sources.files import shared_folder

#: Words in more passages than this share (and than LEAST_COMMON) don't choose candidates.
COMMON_SHARE, LEAST_COMMON = 0.08, 400
CLOSE, CLOSEST = 0.72, 4
LEAST_SCORE = 0.64
#: Under this no score matters: not even beside one that counts from LEAST_SCORE on and has to be better by 0.005.
MATTERS = 0.63
#: A window this near ends the search for a better one.
NEARLY = 0.995


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of two words' letters in their longest common blocks."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _letters(text: str) -> np.ndarray:
    """How often each character of a normal text came before each place."""
    codes = np.frombuffer(text.encode(), np.uint8) & 127
    ones = np.zeros((len(codes) + 1, 128), np.int16)
    ones[np.arange(1, len(codes) + 1), codes] = 1
    return ones[:, LETTERS].cumsum(axis=0, dtype=np.int16)


#: The characters of normal texts.
LETTERS = [ord(c) for c in " 0123456789abcdefghijklmnopqrstuvwxyz"]


def window_ratio(query: str, size: int, words: list[str], least: float = 0.0) -> float:
    """The best ratio of a query of `size` words with one word less to two words more of a text in a row; the first of
    NEARLY or more, if there is one. No ratio is over what the letters that two texts share allow, so windows are
    compared from the largest such bound down, until none can win; a best ratio under `least` may come out as any
    number under it."""
    text = " ".join(words)
    starts = np.r_[0, np.cumsum([len(w) + 1 for w in words])[:-1]]
    ends = starts + [len(w) for w in words]
    spans = [(starts[: len(words) - n + 1], ends[n - 1 :]) for n in range(max(1, size - 1), min(len(words), size + 2) + 1)]
    if not spans:
        return 0.0
    a, b = (np.concatenate(x) for x in zip(*spans, strict=True))
    seen = _letters(text)
    shared = np.minimum(seen[b] - seen[a], _letters(query)[-1]).sum(axis=1)
    bound = 2 * shared / (len(query) + b - a)
    best = 0.0
    compared = lambda i: SequenceMatcher(None, query, text[a[i] : b[i]]).ratio()
    for i in np.argsort(-bound, kind="stable"):
        if bound[i] <= best or bound[i] < least:
            break
        best = max(best, compared(i))
        if best >= NEARLY:
            return next(r for j in np.flatnonzero(bound >= NEARLY - 1e-9) if (r := compared(j)) >= NEARLY)
    return best


def score(query: str, text: str, least: float = MATTERS) -> float:
    """1 for a text that has the query whole; for one word 0.98 or nothing; otherwise half for the best window, the rest
    for the words that carry meaning and for their order. Texts that share too few of these words are not looked at. A
    score under `least` may come out as any number under it."""
    asked, words = query.split(), text.split()
    if not asked or not words:
        return 0.0
    if f" {query} " in f" {text} ":
        return 1.0
    if len(asked) == 1:
        return 0.98 if asked[0] in words else 0.0
    carrying = {w for w in asked if w not in TYPED_STOP} or set(asked)
    share = len(carrying.intersection(words)) / len(carrying)
    if share < 0.5 if len(asked) >= 3 else not share:
        return 0.0
    at = hits = 0
    for w in asked:
        if w not in words[at:]:
            break
        at = words.index(w, at) + 1
        hits += 1
    rest = 0.32 * share + 0.18 * hits / len(asked)
    return 0.5 * window_ratio(query, len(asked), words, 2 * (least - rest)) + rest


def close_words(unknown: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, match, score: for each word of four letters or more the CLOSEST words of a vocabulary with its first three
    letters and a ratio of at least CLOSE. Words whose lengths rule that out never meet."""
    left = unknown.where(F.length("word") >= 4).select("word", F.substring("word", 1, 3).alias("prefix")).distinct()
    right = vocabulary.where(F.length("word") >= 3).select(F.col("word").alias("match"), F.substring("word", 1, 3).alias("prefix"))
    a, b = F.length("word"), F.length("match")
    pairs = left.join(right, "prefix").where(2 * F.least(a, b) >= CLOSE * (a + b)).withColumn("score", F.round(ratio("match", "word"), 6)).where(F.col("score") >= CLOSE)
    order = Window.partitionBy("word").orderBy(F.desc("score"), F.desc("match"))
    return pairs.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= CLOSEST).select("word", "match", "score", "rank")


def candidates(queries: DataFrame, passages: DataFrame, tables: Tables) -> DataFrame:
    """query_id, id: the passages that have all words of a query that choose (rare ones, or the three rarest; words close to
    one that no passage has stand for it), or, where there are none, any of the four that fewest have. Passages have an id
    and t, their fragment; what comes of a pass over them is kept in `tables`."""
    posts = passages.select("id", F.explode(F.array_distinct(F.split("t", " "))).alias("word")).where(F.length("word") >= 2)
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word")).where(F.length("word") >= 2)
    n = passages.select("id").distinct().count()
    df = tables.save(posts.groupBy("word").agg(F.count("*").alias("df")), "words")
    known = asked.join(df, "word")
    rare = F.col("df") <= max(LEAST_COMMON, int(n * COMMON_SHARE))
    w = Window.partitionBy("query_id")
    ranked = known.withColumns({"rare": rare, "any_rare": F.max(rare.cast("int")).over(w), "r": F.row_number().over(w.orderBy("df", "word"))})
    chosen = ranked.where("rare or (any_rare = 0 and r <= 3)").select("query_id", "word", F.col("word").alias("match"))
    lost = asked.join(df, "word", "left_anti")
    close = lost.join(close_words(lost, df.select("word")).select("word", "match"), "word").select("query_id", "word", "match")
    looked = tables.save(chosen.unionByName(close), "looked")
    hits = tables.save(posts.withColumnRenamed("word", "match").join(looked, "match").select("query_id", "word", "id").distinct(), "hits")
    sizes = hits.groupBy("query_id", "word").agg(F.count("*").alias("size"))
    sizes = sizes.withColumns({"words": F.count("*").over(w), "place": F.row_number().over(w.orderBy("size", "word"))})
    rows = hits.join(sizes, ["query_id", "word"]).groupBy("query_id", "id").agg(F.count("*").alias("n"), F.max("words").alias("words"), F.count_if(F.col("place") <= 4).alias("few"))
    rows = tables.save(rows, "rows")
    whole = rows.where("n = words").select("query_id").distinct().withColumn("whole", F.lit(True))
    marked = rows.join(whole, "query_id", "left")
    return tables.save(marked.where(F.when(F.col("whole"), F.col("n") == F.col("words")).otherwise(F.col("few") > 0)).select("query_id", "id"), "candidates")


def _shares_enough(q: Column, text: Column) -> Column:
    """Whether a text has as many of a query's words that carry meaning as a score over 0 needs. A text that has a query
    whole has all of them."""
    words = F.array_distinct(F.split(q, " "))
    carrying = bound(F.filter(words, lambda x: ~x.isin(*TYPED_STOP)), lambda c: F.when(F.size(c) > 0, c).otherwise(words))
    shared = bound(carrying, lambda c: F.size(F.array_intersect(c, F.split(text, " "))) / F.size(c))
    return F.when(F.size(F.split(q, " ")) >= 3, shared >= 0.5).otherwise(shared > 0)


def search(queries: DataFrame, passages: DataFrame, active: str, k: int = 12) -> DataFrame:
    """The k best passages (version, book, chapter, verse, text) of each query (query_id, text): rank, book, chapter, verse,
    verse_end, version, score, method. Queries that stand whole in a passage, or across it and the next verse, get these;
    only the others are compared by score."""
    place, tables = ["book", "chapter", "verse"], Tables(shared_folder(queries.sparkSession, "typed"))
    keyed = tables.save(passages.select(F.xxhash64(*place).alias("id"), "version", *place, fragment(F.col("text")).alias("t")), "texts")
    asked = queries.select("query_id", "text", fragment(F.col("text")).alias("q")).where("q <> ''")
    found = candidates(asked, keyed, tables)
    ids = tables.save(found.select("id").distinct(), "ids")
    texts = keyed.where("t <> ''")
    # the verses after candidates, by the number of the one before
    before = (F.col("verse") - 1).cast(passages.schema["verse"].dataType)
    after = texts.withColumn("verse", before).withColumn("id", F.xxhash64(*place)).join(ids, "id", "left_semi").select("version", *place, F.col("t").alias("after"))
    both = texts.join(ids, "id", "left_semi").join(after, ["version", *place], "left").withColumn("both", F.concat_ws(" ", "t", "after"))
    # a passage's texts meet its queries once, not once for each of them
    of_id = found.groupBy("id").agg(F.collect_list("query_id").alias("query_ids"))
    pairs = both.join(of_id, "id").withColumns({c: F.concat(F.lit(" "), F.col(c), F.lit(" ")) for c in ("t", "both")})
    pairs = pairs.withColumn("query_id", F.explode("query_ids")).drop("query_ids").join(asked.select("query_id", "q"), "query_id")
    inside = lambda text: F.col(text).contains(F.concat(F.lit(" "), F.col("q"), F.lit(" ")))
    method = F.when(inside("t"), "manual_exact").when(F.col("after").isNotNull() & inside("both"), "manual_cross_verse")
    pairs = pairs.withColumn("method", method).where(F.col("method").isNotNull() | _shares_enough(F.col("q"), F.col("both")))
    near = lambda c: F.when(F.col("method").isNull(), c)
    pairs = tables.save(pairs.select("query_id", "version", *place, "method", *(near(c).alias(n) for n, c in (("q", F.col("q")), ("t", F.trim("t")), ("after", F.col("after"))))), "pairs")
    exact = pairs.where("method is not null").withColumn("score", F.lit(1.0))
    rest = pairs.where("method is null").join(exact.select("query_id").distinct(), "query_id", "left_anti")
    # few bytes and much work: the pairs of a query are dealt to all tasks
    rest = rest.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id", "version", *place)
    names = ["query_id", "version", *place, "score", "method"]
    schema = T.StructType([queries.schema["query_id"], *(passages.schema[c] for c in ("version", *place)), T.StructField("score", T.DoubleType()), T.StructField("method", T.StringType())])

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [score(q, t) for q, t in zip(batch["q"], batch["t"], strict=True)]
            # what isn't better by more than 0.005 doesn't matter
            joined = [score(q, f"{t} {a}", max(MATTERS, o + 0.005 - 1e-9)) if isinstance(a, str) and o < 0.995 else 0.0 for q, t, a, o in zip(batch["q"], batch["t"], batch["after"], own, strict=True)]
            cross = [b > a + 0.005 for a, b in zip(own, joined, strict=True)]
            batch["score"] = [b if c else a for a, b, c in zip(own, joined, cross, strict=True)]
            batch["method"] = ["manual_approx_cross" if c else "manual_approx" for c in cross]
            batch["n"] = batch["q"].str.split().str.len()
            yield batch[batch["score"] >= [0.98 if n == 1 else LEAST_SCORE for n in batch["n"]]][names]

    near = rest.select("query_id", "q", "version", *place, "t", "after").mapInPandas(scored, schema)
    found = exact.select(*names).unionByName(near)
    crosses = F.col("method").isin("manual_cross_verse", "manual_approx_cross")
    rows = found.select("query_id", "version", *place, F.when(crosses, F.col("verse") + 1).alias("verse_end"), F.round("score", 4).alias("score"), F.regexp_replace("method", "_cross$", "").alias("method"))
    # of the versions of one passage the best, the active one on ties
    order = F.struct(F.col("score"), (F.col("version") == active).alias("own"), (-F.ascii(F.col("version"))).alias("v"))
    best = rows.groupBy("query_id", *place, "verse_end").agg(F.max_by(F.struct("version", "score", "method"), order).alias("b")).select("query_id", *place, "verse_end", "b.*")
    ranking = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.col("version") == active), "chapter", "book", "verse", F.col("verse_end").asc_nulls_first())
    return best.withColumn("rank", F.row_number().over(ranking).cast("long")).where(F.col("rank") <= k)
