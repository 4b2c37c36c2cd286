"""Document fingerprints by one-permutation MinHash with optimal densification, in DataFrame functions only.

Each word shingle is hashed once; the high bits of the hash pick one of BINS bins and each bin keeps its least hash. An
empty bin borrows the value of a bin that has one, picked by hashes, so each non-empty bin is as likely and equal sets
borrow alike. The low BITS bits of each bin are packed; their chance agreements are corrected for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelake.llm.common import Workspace

BINS = 256
BITS = 8
SHINGLE_WORDS = 5
PROBES = 8


def shingle_hashes(text: Column, k: int = SHINGLE_WORDS) -> Column:
    """One hash per run of k words (what ASCII white space separates); a shorter text is one shingle, one without words
    none."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))
        return F.when(n >= k, many).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    # an expression that is used more than once is bound as a lambda's variable, else it would be evaluated each time
    return F.get(F.transform(F.array(hashes), shingles), F.lit(0))


def bin_values(hashes: Column, bins: int = BINS) -> Column:
    """The least hash of each non-empty bin, in order of bins: after sorting, the first hash with its high bits."""
    shift = 64 - int(math.log2(bins))

    def firsts(h: Column) -> Column:
        return F.filter(h, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(h, i - 1), shift)))

    return F.get(F.transform(F.array(F.sort_array(hashes)), firsts), F.lit(0))


def densified(values: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """The low bits of each of the bins (less half their range, to fit a byte), empty ones borrowing; an empty array
    where all bins are empty.

    An empty bin tries PROBES bins picked by hashes of its number and the attempt, and takes the first that has a value;
    if none has, the non-empty bin whose number hashes lowest together with its own.
    """
    shift, mask = 64 - int(math.log2(bins)), (1 << bits) - 1
    low = lambda x: (x.bitwiseAND(F.lit(mask)) - (mask + 1) // 2).cast("tinyint")
    place = lambda x: F.shiftright(x, shift).cast("int") + bins // 2

    def spread(v: Column) -> Column:
        # one array cell per bin up to the last non-empty one: gaps are filled with nulls
        before = lambda i: F.when(i > 0, place(F.get(v, i - 1))).otherwise(F.lit(-1))
        cells = F.flatten(F.transform(v, lambda x, i: F.concat(F.array_repeat(F.lit(None).cast("tinyint"), place(x) - before(i) - 1), F.array(low(x)))))

        def pick(c: Column) -> Column:
            def one(b: Column) -> Column:
                tries = [F.get(c, F.pmod(F.hash(b, F.lit(t)), F.lit(bins))) for t in range(PROBES)]
                rest = F.array_min(F.transform(v, lambda x: F.struct(F.hash(b, place(x)).alias("order"), low(x).alias("low"))))["low"]
                return F.coalesce(F.get(c, b), *tries, rest)

            return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), one)

        return F.get(F.transform(F.array(cells), pick), F.lit(0))

    return F.when(F.size(values) > 0, F.get(F.transform(F.array(values), spread), F.lit(0))).otherwise(F.array().cast("array<tinyint>"))


def packed(low: Column, bits: int = BITS) -> Column:
    """The low bits of all bins as hexadecimal digits, `bits` being a multiple of 4."""
    half = 1 << (bits - 1)
    return F.array_join(F.transform(low, lambda x: F.lower(F.lpad(F.hex(x.cast("int") + half), bits // 4, "0"))), "")


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two fingerprints' low bits, 0 to 1: the share of equal bins,
    corrected for those that agree by chance. Two empty sets are alike, an empty and another set are not."""
    chance = 2.0**-bits
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    share = same.cast("double") / F.size(a)
    corrected = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (share - chance) / (1 - chance)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(corrected)


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """The low bits of a text's bins."""
    return densified(bin_values(shingle_hashes(text), bins), bins, bits)


def successors(ids: DataFrame, work: Workspace) -> DataFrame:
    """(key, n_chars, next_key, next_before, n_before): the next row by descending doc_id (the first for the last), and
    the row whose next this one is, with its n_chars.

    Rows are dealt by ranges of doc_id and the dealing is written, so a lost executor can't change it. Within a range
    a window finds the neighbours; a window over the ranges' ends, one row for a range, finds those across.
    """
    order = [F.desc_nulls_last("doc_id"), F.asc("key")]
    ranged = work.save(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    row = F.struct("key", "n_chars")
    inside = Window.partitionBy("part").orderBy(*order)
    near = ranged.withColumn("after", F.lead(row).over(inside)).withColumn("before", F.lag(row).over(inside))
    ends = near.where("before is null").select("part", row.alias("head")).join(near.where("after is null").select("part", row.alias("tail")), "part")
    line = Window.orderBy("part")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lead("head").over(line), F.first("head").over(whole)).alias("next_head"), F.coalesce(F.lag("tail").over(line), F.last("tail").over(whole)).alias("last_tail"))
    found = near.join(F.broadcast(ends), "part")
    after, before = F.coalesce("after", "next_head"), F.coalesce("before", "last_tail")
    return found.select("key", "doc_id", "n_chars", "copies", after["key"].alias("next_key"), before["key"].alias("key_before"), before["n_chars"].alias("n_before"))


def fingerprints(documents: DataFrame, *, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of documents
    (doc_id, text).

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as many (or all) of
    the next document by descending doc_id, after the last one the first. near_edited and near_next are the likeness of
    the fingerprint to the edited text's and to the next document's.

    Null text counts as empty; rows with a null doc_id come last in the order; rows of one doc_id follow one another in
    a fixed order; rows that agree in doc_id and text are one document of the order and come back as often as they came;
    a single document is its own next; a text without words has an empty fingerprint; an empty table gives no rows;
    other columns are ignored.
    """
    work = Workspace(documents.sparkSession, "fingerprints")
    text = F.coalesce("text", F.lit(""))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(F.xxhash64(text)), F.hex(F.hash(text)))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), text.alias("text"))
    ids = rows.select("key", "doc_id", F.length("text").alias("n_chars")).groupBy("key", "doc_id", "n_chars").agg(F.count("*").cast("int").alias("copies"))
    places = work.save(successors(ids, work), "places")
    # one exchange of the texts by key serves both what a row keeps and what it lends to the row before it
    placed = rows.select("key", "text").join(places, "key")
    if not places.where("copies > 1").isEmpty():
        placed = placed.dropDuplicates(["key"])
    third = F.floor(F.col("n_chars") / 3).cast("int")
    lent = placed.select(F.col("key_before").alias("key"), F.substring("text", F.lit(1), F.floor(F.col("n_before") / 3).cast("int")).alias("lent"))
    edited = placed.join(lent, "key").withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - third), "lent"))
    made = edited.select("key", "doc_id", "n_chars", "copies", "next_key", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("text"), bins, bits).alias("own"), fingerprint(F.col("edited"), bins, bits).alias("other"))
    made = work.save(made, "made")
    after = made.select(F.col("key").alias("next_key"), F.col("own").alias("after"))
    out = made.join(after, "next_key").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        packed(F.col("own"), bits).alias("fingerprint"),
        packed(F.col("other"), bits).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other"), bits).alias("near_edited"),
        likeness(F.col("own"), F.col("after"), bits).alias("near_next"),
    )
