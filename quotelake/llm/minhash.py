"""MinHash near-dedup by min-max hashing: each permutation gives the least and the greatest value of a shingle set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.llm.common import ODD, Powers, WordHashes, Workspace, block_pairs, mix, rolling, runs, signed, texts
from quotelake.llm.components import Forest, components

PERMUTATIONS = 60
BAND_ROWS = 5
BLOCK_MEMBERS = 128
PAIR_MEMBERS = 512
BLOCK_SHINGLES = 1_500_000
MATRIX_COLUMNS = 16_384
SEED = 20_240


class Shingler:
    """Sets of k-word shingles as sorted 64-bit hashes; words are lower-cased in A-Z only and split at ASCII white space.
    With fewer than k words the whole sequence is the one shingle; without words the set is empty."""

    def __init__(self, k: int):
        self.k, self.hashes, self.powers = k, WordHashes(), Powers()

    def __call__(self, text: bytes) -> np.ndarray:
        words = self.hashes.of(text.lower().split())
        if len(words) >= self.k:
            return np.unique(rolling(words, self.k, self.powers))
        return mix(rolling(words, len(words), self.powers) ^ np.uint64(len(words))) if len(words) else words


class MinMax:
    """Signatures of 2 * permutations values from as many hash evaluations as permutations."""

    def __init__(self, permutations: int = PERMUTATIONS, rows: int = BAND_ROWS):
        rng = np.random.default_rng(SEED)
        self.flip = rng.integers(0, 1 << 64, (permutations, 1), np.uint64)
        self.times = rng.integers(0, 1 << 64, (permutations, 1), np.uint64) | np.uint64(1)
        self.rows = rows
        self.weights = np.multiply.accumulate(np.full(rows, ODD, np.uint64))

    def signature(self, shingles: np.ndarray, step: int = 2048) -> np.ndarray:
        least = greatest = None
        for a in range(0, len(shingles), step):
            values = (shingles[a : a + step] ^ self.flip) * self.times
            lo, hi = values.min(axis=1), values.max(axis=1)
            least = lo if least is None else np.minimum(least, lo)
            greatest = hi if greatest is None else np.maximum(greatest, hi)
        return np.concatenate([least, greatest])

    def bands(self, signature: np.ndarray) -> np.ndarray:
        half = len(signature) // 2
        per = half // self.rows
        parts = np.concatenate([signature[: per * self.rows], signature[half : half + per * self.rows]]).reshape(2 * per, self.rows)
        return mix((mix(parts) * self.weights).sum(axis=1, dtype=np.uint64) + np.arange(2 * per, dtype=np.uint64))

    @staticmethod
    def estimate(a: np.ndarray, b: np.ndarray) -> float:
        """Unbiased: both the minimum and the maximum agree with the probability of the Jaccard similarity."""
        return float((a == b).mean())


def sketch(documents: DataFrame, k: int, permutations: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set, and its band keys (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, minmax = Shingler(k), MinMax(permutations, rows)
        for batch in batches:
            out = []
            for text in texts(batch.column(1)):
                s = shingler(text)
                h = np.array([s.sum(dtype=np.uint64), mix(s ^ np.uint64(SEED)).sum(dtype=np.uint64)])
                out.append((len(s), *signed(h).tolist(), signed(minmax.bands(minmax.signature(s))) if len(s) else []))
            n, h1, h2, bands = zip(*out, strict=True) if out else ([],) * 4
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "h1", "h2", "bands"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of membership matrices of a bounded number of columns."""
    n = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.r_[True, values[1:] != values[:-1]] if len(values) else np.empty(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    if len(column):
        column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
    total = np.zeros((n, n))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, MATRIX_COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + MATRIX_COLUMNS])
        member = np.zeros((n, int(column[hi - 1]) - a + 1), np.float32)
        member[owner[lo:hi], column[lo:hi] - a] = 1
        total += member @ member.T
    np.fill_diagonal(total, [len(s) for s in sets])
    return total


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Pairs (i, j), i < j, with 100 * intersection >= percent * union."""
    size = np.array([len(s) for s in sets], np.float64)
    common = np.zeros((2, 2)) if len(sets) == 2 else intersections(sets)
    if len(sets) == 2:
        common[0, 1] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    union = size[:, None] + size[None, :] - common
    return np.argwhere(np.triu((100 * common >= percent * union) & (union > 0), 1))


def _verify(rows: DataFrame, keys: list[str], k: int, percent: int) -> DataFrame:
    """Links (a, b) among the rows that agree on `keys`, confirmed on full sets; a spanning forest of them is returned.
    Pairs of one `comp` are taken as linked already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        out: list[tuple[int, int]] = []
        for group in runs(batches, keys):
            ids, comp = group.column("doc_id").to_pylist(), group.column("comp").to_pylist()
            if len(set(comp)) < 2:
                continue
            forest = Forest()
            for x, c in zip(ids, comp, strict=True):
                forest.link(x, c)
            sets = [shingler(t) for t in texts(group.column("text").combine_chunks())]
            for i, j in linked(sets, percent).tolist():
                if forest.link(ids[i], ids[j]):
                    out.append((ids[i], ids[j]))
            if len(out) > 20_000:
                yield _links(out)
                out = []
        yield _links(out)

    ready = rows.select(*keys, "doc_id", "comp", "text").repartition(*keys).sortWithinPartitions(*keys)
    return ready.mapInArrow(run, "a long, b long")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_duplicates(documents: DataFrame, *, shingle_words: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, band_rows: int = BAND_ROWS, block: int = BLOCK_MEMBERS, pair_block: int = PAIR_MEMBERS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of documents (doc_id, text).

    Equal sets are one class, led by its smallest doc_id. Leaders that share a band key are candidates; candidates that
    hang together form a family, and the texts of a family meet once, in blocks of bounded size, where all pairs are
    confirmed on full sets. A family of many blocks has its smallest member in every block; pairs of such a family that
    share a band key and are not linked by then are confirmed in pairs of blocks. Only links of a spanning forest leave
    a task.

    Null text counts as empty, an empty set is linked with nothing, rows of one doc_id are one document to link, a null
    doc_id has a null component and is kept, repeated rows come back as often as they came, an empty table gives no
    rows, and other columns are ignored.
    """
    spark = documents.sparkSession
    work = Workspace(spark, "minhash")
    sketches = work.save(sketch(documents, shingle_words, permutations, band_rows), "sketches")
    full = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = work.save(full.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("leader")), "classes")
    leaders = full.join(classes, ["h1", "h2", "n_shingles"]).where("doc_id = leader").dropDuplicates(["doc_id", "h1", "h2"])
    leaders = work.save(leaders.select("doc_id", "n_shingles", "bands"), "leaders")
    banded = leaders.select("doc_id", F.explode("bands").alias("band"))
    pivots = banded.groupBy("band").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("top")).where("pivot < top").drop("top")
    families = work.save(components(spark, banded.join(pivots.hint("merge"), "band").where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))).toDF("doc_id", "family"), "families")
    sizes = leaders.join(families, "doc_id").groupBy("family").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("shingles"))
    chunks = F.ceil(F.greatest(F.col("members") / block, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    placed = work.save(families.join(sizes.select("family", chunks.alias("chunks")), "family"), "placed")
    # the text of the rows that lead their class: other rows of the same doc_id add nothing that their leader lacks;
    # texts are shuffled once, by the same plan at every size, and those of families are kept
    wanted = work.save(documents.select(F.col("doc_id").cast("long"), "text").join(placed.hint("merge"), "doc_id"), "wanted")
    own = F.array(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("chunks")).cast("int"))
    dealt = wanted.withColumn("chunk", F.explode(F.when(F.col("doc_id") == F.col("family"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(own)))
    links = work.save(_verify(dealt.withColumn("comp", F.col("doc_id")), ["family", "chunk"], shingle_words, percent), "links")
    found = components(spark, links).toDF("doc_id", "comp")
    large = placed.where("chunks > 1")
    if not large.isEmpty():
        at = large.join(found, "doc_id", "left").select("doc_id", F.coalesce("comp", "doc_id").alias("comp"))
        open_bands = work.save(leaders.join(at, "doc_id").select("doc_id", "comp", "n_shingles", F.explode("bands").alias("band")), "open")
        split = open_bands.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
        pairs = block_pairs(open_bands.join(split, "band"), ["band"], "doc_id", pair_block, "n_shingles", BLOCK_SHINGLES).select("band", "left", "right", "doc_id", "comp")
        with_text = pairs.join(wanted.select("doc_id", "text").hint("merge"), "doc_id")
        more = work.save(_verify(with_text, ["band", "left", "right"], shingle_words, percent), "more")
        if not more.isEmpty():
            found = components(spark, links.union(more)).toDF("doc_id", "comp")
    led = sketches.join(classes, ["h1", "h2", "n_shingles"], "left").select(sketches["doc_id"], "n_shingles", F.when(sketches["doc_id"].isNotNull(), F.coalesce("leader", sketches["doc_id"])).alias("leader"))
    out = led.join(found.select(F.col("doc_id").alias("leader"), "comp"), "leader", "left")
    component = F.coalesce("comp", "leader")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
