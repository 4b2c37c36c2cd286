"""Phrases whose words keep together, mined per language from all n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.llm.common import Powers, WordHashes, Workspace, rolling, signed, texts

#: One pass over the bytes: A-Z in lower case, all that ends a piece as a line end.
PLAIN = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
GAP = re.compile(rb"[ \t\n]")
#: A long text is read in parts of about so many bytes, n-grams are combined over about so many words before they leave a task.
PART_BYTES, CHUNK_WORDS = 1 << 20, 400_000
#: Pairs are counted by hashes of so many bits; pairs that share one only count for more in the screen.
HASH_BITS = 40
#: The screen has 2 ** SCREEN_BITS bits (8 MB), whatever the corpus.
SCREEN_BITS = 26
#: Ranks are taken in so many parts of a language first.
PARTS = 64


def parts(text: bytes, most: int, size: int) -> Iterator[tuple[bytes, int]]:
    """A text in parts of about `size` bytes, each with how many of its first words the part before it holds too: none
    where the cut is at a piece's end; inside a piece `most` - 1 words come again, so that each n-gram of up to `most`
    words is whole in one part, and in just one of them longer than those words."""
    text = text.translate(PLAIN)
    start, carried = 0, []
    while start < len(text):
        cut = len(text)
        if cut - start > size:
            cut = text.rfind(b"\n", start, start + size) + 1
            if cut <= start:
                gap = GAP.search(text, start + size)
                cut = gap.start() if gap else len(text)
        part = b" ".join([*carried, text[start:cut]])
        yield part, len(carried)
        carried = [] if cut == len(text) or text[cut - 1 : cut] == b"\n" else part.split()[1 - most :]
        start = cut


class Chunk:
    """Words of one language: all in a row, with the number of words from each to its piece's end, and the shortest n-gram
    to count there (longer than 1 where a part before has counted)."""

    def __init__(self, seed: bytes):
        self.seed = np.uint64(xxhash.xxh64_intdigest(seed))
        self.words: list[bytes] = []
        self.lengths: list[int] = []
        self.again: list[tuple[int, int]] = []

    def add(self, part: bytes, again: int) -> None:
        if again:
            self.again.append((len(self.words), again))
        for piece in part.split(b"\n"):
            words = piece.split()
            self.words += words
            self.lengths.append(len(words))

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array(self.lengths, np.int64)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(self.words))
        shortest = np.ones(len(self.words), np.int64)
        for at, n in self.again:
            shortest[at : at + n] = np.arange(n, 0, -1) + 1
        return left, shortest

    def pairs(self, hashes: WordHashes, powers: Powers) -> np.ndarray:
        """A hash of each word and the one after it."""
        return (rolling(hashes.of(self.words), 2, powers) ^ self.seed) & np.uint64((1 << HASH_BITS) - 1)


def chunks(batches: Iterator[pa.RecordBatch], most: int, part_bytes: int) -> Iterator[tuple[str, Chunk]]:
    """Chunks of the batches' (lang, text) rows."""
    held: dict[str, Chunk] = {}
    count = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            for part, again in parts(text, most, part_bytes):
                if lang not in held:
                    held[lang] = Chunk(lang.encode())
                chunk = held[lang]
                before = len(chunk.words)
                chunk.add(part, again)
                count += len(chunk.words) - before
                if count >= CHUNK_WORDS:
                    yield from held.items()
                    held, count = {}, 0
    yield from held.items()


def pair_counts(documents: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(h, n): how often each pair of neighbouring words comes, by its hash, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHashes(), Powers()
        for _, chunk in chunks(batches, 2, part_bytes):
            left, shortest = chunk.arrays()
            found, n = np.unique(chunk.pairs(hashes, powers)[((left >= 2) & (shortest <= 2))[:-1]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(n, pa.int64())], ["h", "n"])

    return documents.mapInArrow(run, "h long, n long")


def screen_of(documents: DataFrame, least: int, part_bytes: int = PART_BYTES) -> np.ndarray:
    """One bit for each hash of two neighbouring words that come `least` times or more: 8 MB, however many they are."""
    often = pair_counts(documents, part_bytes).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    slot = F.shiftright(F.col("h").bitwiseAND((1 << SCREEN_BITS) - 1), 6).cast("int")
    bits = often.groupBy(slot.alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    rows = bits.toArrow()
    screen = np.zeros(1 << (SCREEN_BITS - 6), np.uint64)
    screen[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return screen


def explode_ngrams(documents: DataFrame, screen: np.ndarray, max_words: int, part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, f): lang, a line end and the n-grams of one to `max_words` words in (lang, text) rows, f of them in one row: all of
    one word, and every longer one all of whose neighbouring pairs are in the screen.

    An n-gram comes no more often than any pair of neighbours in it, so none that reaches the screen's least count is
    missing. The others would be most rows of the shuffle; a full screen only lets more of them through.
    """
    shared = documents.sparkSession.sparkContext.broadcast(screen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers, bits = WordHashes(), Powers(), shared.value
        for lang, chunk in chunks(batches, max_words, part_bytes):
            words = chunk.words
            left, shortest = chunk.arrays()
            pairs = chunk.pairs(hashes, powers)
            known = (bits[(pairs & np.uint64((1 << SCREEN_BITS) - 1)) >> np.uint64(6)] >> (pairs & np.uint64(63))) & np.uint64(1) == 1
            grows = np.append(known, False)[: len(words)] & (left >= 2)
            fits = np.ones(len(words), bool)
            prefix = f"{lang}\n".encode()
            for n in range(1, max_words + 1):
                if n > 1:  # word n of a run belongs to it if the pair that it ends does
                    fits[: len(words) - n + 2] &= grows[n - 2 :]
                    fits[len(words) - n + 2 :] = False
                starts = np.flatnonzero(fits & (shortest <= n)).tolist()
                found = Counter([words[a] for a in starts] if n == 1 else [b" ".join(words[a : a + n]) for a in starts])
                keys, f = [prefix + p for p in found], list(found.values())
                for a in range(0, len(found), 50_000):
                    columns = [pa.array(keys[a : a + 50_000], pa.binary()).cast(pa.string()), pa.array(f[a : a + 50_000], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "f"])

    return documents.mapInArrow(run, "key string, f long")


def collocations(documents: DataFrame, *, max_words: int = 4, least: int = 30, covered_percent: int = 80, top: int = 2000, part_bytes: int = PART_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, words: the `top` phrases of two to `max_words` words in each language.

    Words are what stands between spaces and tabs in pieces between `.,;:!?` and line ends, A-Z in lower case. a is how
    often a phrase comes, overlaps included, at least `least` times; n how many words the language has; l and r how
    often the two parts come of the cut with the lowest score floor(2000000 * a / (l + r)), a tie: the earliest cut.
    Phrases inside a longer one that comes in at least `covered_percent` of 100 of its places are left out; a phrase
    one word longer tells, since those between come no less often. Order is by score, a, then bytes of the phrase.

    A null text is empty, a null lang is `und`, repeated rows count as often as they come, other columns are ignored, an
    empty table gives no rows, and texts and pieces may have any length. Ranks come from parts of a language first, so
    no task holds a language; products are Decimals of 38 digits. Counts that are read more than once are tables in the
    shared folder.
    """
    work = Workspace(documents.sparkSession, "phrases")
    docs = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    ngrams = explode_ngrams(docs, screen_of(docs, least, part_bytes), max_words, part_bytes)
    counts = ngrams.groupBy("key").agg(F.sum("f").alias("f")).withColumn("phrase", F.substring_index("key", "\n", -1))
    counts = counts.select(F.expr("substring(key, 1, length(key) - length(phrase) - 1)").alias("lang"), "phrase", "f")
    counts = counts.withColumn("words", (F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1).cast("long"))
    counts = work.save(counts.where((F.col("words") == 1) | (F.col("f") >= least)), "counts")
    often = counts.where(F.col("f") >= least)
    candidates = often.where("words > 1")
    total = counts.where("words = 1").groupBy("lang").agg(F.sum("f").alias("n"))

    word = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), (F.col("words") - 1).cast("int"))).alias("k")
    cuts = candidates.select("lang", "phrase", "words", F.col("f").alias("a"), cut)
    cuts = cuts.withColumn("head", F.array_join(F.slice(word, 1, F.col("k")), " "))
    cuts = cuts.withColumn("rest", F.array_join(F.slice(word, F.col("k") + 1, F.col("words").cast("int")), " "))
    heads = often.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = often.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr("cast((cast(a as decimal(20, 0)) * cast(2000000 as decimal(7, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as long)")
    scored = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).withColumn("score", score)
    scored = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    ends = F.explode(F.array(F.array_join(F.slice(word, 1, F.col("words").cast("int") - 1), " "), F.array_join(F.slice(word, 2, F.col("words").cast("int") - 1), " ")))
    longer = often.where("words > 2").select("lang", ends.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    covered = (scored["lang"] == longer["lang"]) & (scored["phrase"] == longer["phrase"]) & (F.expr("cast(longer as decimal(20, 0)) * 100") >= F.expr(f"cast(a as decimal(20, 0)) * {covered_percent}"))
    whole = scored.join(longer, covered, "left_anti").select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")

    order = "order by score desc, a desc, phrase"
    part = whole.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = part.withColumn("rank", F.expr(f"row_number() over (partition by lang, part {order})")).where(F.col("rank") <= top).drop("part")
    ranked = first.withColumn("rank", F.expr(f"cast(row_number() over (partition by lang {order}) as long)")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "words")
