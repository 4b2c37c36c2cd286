"""Helpers that the operators of this subpackage share: words, shared tables, skew-safe blocks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMO_WORDS = 300_000
ODD = 0x9E3779B97F4A7C15
ODD_INVERSE = pow(ODD, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where the setting is missing on a local master (as in
    tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        path = "file://" + tempfile.mkdtemp(prefix="quotelake-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


class Workspace:
    """Tables of one run in the shared folder; a written table cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete a table nobody reads any more (or all of them)."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class WordHashes(dict):
    """word bytes -> 64-bit hash; forgets all when full, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", ODD), ("down", ODD_INVERSE)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def rolling(hashes: np.ndarray, k: int, powers: Powers) -> np.ndarray:
    """Hash of each run of k values, by differences of one running sum."""
    n = len(hashes)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = powers.to(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def block_pairs(df: DataFrame, key: list[str], row_id: str, size: int, weight: str | None = None, most: int = 1) -> DataFrame:
    """Deal each group of `key` into blocks of about `size` rows, and of about `most` of the sum of `weight`, and pair
    the blocks, so that no task holds a group.

    Adds block, left and right: the rows of a group with the same (left, right) meet, and each pair of rows of a group
    meets in exactly one (left, right) where it counts: rows of different blocks in their pair, rows of one block in
    (block, block). Groups of one row are left out. Groups that fit one block stay whole and are copied once.
    """
    load = F.greatest(F.count("*") / size, F.sum(weight) / most) if weight else F.count("*") / size
    counts = df.groupBy(*key).agg(F.count("*").alias("rows_of_group"), F.ceil(load).cast("int").alias("blocks"))
    counts = counts.where("rows_of_group > 1").drop("rows_of_group")
    dealt = df.join(counts, key).withColumn("block", F.pmod(F.xxhash64(F.col(row_id), F.lit(7)), F.col("blocks")).cast("int"))
    return (
        dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("left", F.least("block", "other"))
        .withColumn("right", F.greatest("block", "other"))
        .drop("other", "blocks")
    )


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (consecutive rows that agree on `keys`; rows must come sorted by them), of about `rows`
    rows each or one larger group, with the bounds of their groups."""
    held: list[pa.RecordBatch] = []
    count = 0

    def starts(table: pa.Table) -> np.ndarray:
        ks = [table.column(k).to_numpy() for k in keys]
        return np.r_[0, np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in ks])) + 1]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held)
            at = starts(table)
            last = int(at[-1])
            a = 0
            for b in at[1:].tolist():
                if b - a >= rows or b == last:
                    yield table.slice(a, b - a), np.r_[at[(at >= a) & (at < b)], b] - a
                    a = b
            held = table.slice(last).to_batches()
            count = len(table) - last
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.r_[starts(table), len(table)]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the consecutive rows that agree on `keys`, across batch bounds; rows must come sorted by them."""
    for table, bounds in grouped(batches, keys, 1):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield table.slice(a, b - a)
