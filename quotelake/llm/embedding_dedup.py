"""Embedding near-dedup by binary codes of randomly rotated vectors, with correction factors and confidence bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelake.llm.common import Workspace, block_pairs, grouped
from quotelake.llm.components import Forest, components

THRESHOLD = 0.93
CODE_BITS = 256
#: The bound of an estimate is this many times its standard error.
SIGMAS = 6.0
BLOCK_ROWS = 1024
SMALL_GROUP = 24
PAIR_SLAB = 20_000
CHUNK_ROWS = 4_096
SEED = 7_919


class Rotation:
    """A random rotation of vectors padded with zeros to at least `bits` dimensions; its signs are the code.

    For a unit vector o with code x (+-1/sqrt(bits)), <x, q> / <x, o> estimates <o, q> without bias, with standard error
    sqrt(1 - <x, o>**2) / (<x, o> * sqrt(bits - 1)); <x, o> is the correction factor stored with the code.
    """

    def __init__(self, dims: int, bits: int = CODE_BITS):
        rng = np.random.default_rng(SEED)
        self.bits = max(bits, dims)
        self.basis = np.linalg.qr(rng.standard_normal((self.bits, dims)))[0].astype(np.float32).T

    def rotate(self, unit: np.ndarray) -> np.ndarray:
        return unit.astype(np.float32) @ self.basis

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed codes, correction factors, and signs of unit vectors."""
        turned = self.rotate(unit)
        sign = turned > 0
        factor = np.abs(turned).sum(axis=1, dtype=np.float64) / np.sqrt(self.bits)
        return np.packbits(sign, axis=1), factor, sign

    def signs(self, codes: np.ndarray) -> np.ndarray:
        return (np.unpackbits(codes, axis=1, count=self.bits).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(self.bits))

    def error(self, factor: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 1 - factor**2)) / (factor * np.sqrt(self.bits - 1))


def usable(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the non-empty vectors of finite numbers that are not zero, and these vectors."""
    kept, rows = [], []
    for i, v in enumerate(vectors.to_pylist()):
        if not v or None in v:
            continue
        x = np.array(v, np.float64)
        if np.isfinite(x).all() and x.any():
            kept.append(i)
            rows.append(x)
    return np.array(kept, np.int64), rows


def _codes(dims_of: dict, rows: list[np.ndarray]) -> list[tuple]:
    out: list[tuple] = [()] * len(rows)
    by_dims: dict[int, list[int]] = {}
    for i, x in enumerate(rows):
        by_dims.setdefault(len(x), []).append(i)
    for dims, at in by_dims.items():
        turn = dims_of.setdefault(dims, Rotation(dims))
        x = np.stack([rows[i] for i in at])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        codes, factor, _ = turn.encode(unit)
        for j, i in enumerate(at):
            out[i] = (codes[j].tobytes(), float(factor[j]))
    return out


def encode(vectors: DataFrame, label_type: T.DataType) -> DataFrame:
    """vec_id, label, embedding as doubles, code and factor of the vectors that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims_of: dict[int, Rotation] = {}
        for batch in batches:
            at, rows = usable(batch.column("embedding"))
            coded = _codes(dims_of, rows)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(take), batch.column("label").take(take), pa.array([x.tobytes() for x in rows], pa.binary()), pa.array([c[0] for c in coded], pa.binary()), pa.array([c[1] for c in coded], pa.float64())],
                ["vec_id", "label", "vector", "code", "factor"],
            )

    schema = T.StructType().add("vec_id", "long").add("label", label_type).add("vector", "binary").add("code", "binary").add("factor", "double")
    return vectors.mapInArrow(run, schema)


class Chunk:
    """Rows of several groups of one vector length, as matrices."""

    def __init__(self, table: pa.Table, dims: int, turn: Rotation):
        n = len(table)
        self.ids, self.copies = table.column("vec_id").to_numpy(), table.column("copies").to_numpy()
        x = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(n, dims)
        self.scaled = x / np.abs(x).max(axis=1, keepdims=True)
        self.norm = np.linalg.norm(self.scaled, axis=1)
        self.signs = turn.signs(np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(n, -1))
        self.turned = turn.rotate(self.scaled / self.norm[:, None])
        self.factor = table.column("factor").to_numpy()
        self.slack = SIGMAS * turn.error(self.factor)
        self.block = table.column("block").to_numpy()
        self.cross = table.column("left").to_numpy() != table.column("right").to_numpy()

    def confirm(self, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that link, by exact cosines."""
        exact = np.einsum("nd,nd->n", self.scaled[i], self.scaled[j]) / (self.norm[i] * self.norm[j])
        return i[exact >= threshold], j[exact >= threshold]

    def small(self, group: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links within small groups, all groups at once."""
        for d in range(1, SMALL_GROUP):
            i = np.flatnonzero((group[d:] == group[:-d]) & (group[d:] >= 0))
            if not len(i):
                return
            i = i[~self.cross[i] | (self.block[i] != self.block[i + d])]
            for s in range(0, len(i), PAIR_SLAB):
                p = i[s : s + PAIR_SLAB]
                q = p + d
                upper = np.einsum("nd,nd->n", self.signs[p], self.turned[q]) / self.factor[p] + self.slack[p]
                yield self.confirm(p[upper >= threshold], q[upper >= threshold], threshold)

    def large(self, a: int, b: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links within the group of rows a..b-1 (or between its two blocks)."""
        rows = cols = np.arange(a, b)
        if self.cross[a]:
            rows, cols = rows[self.block[a:b] == self.block[a]], rows[self.block[a:b] != self.block[a]]
        for s in range(0, len(rows), 256):
            r = rows[s : s + 256]
            upper = (self.signs[r] @ self.turned[cols].T) / self.factor[r, None] + self.slack[r, None]
            i, j = np.nonzero(upper >= threshold)
            i, j = r[i], cols[j]
            if not self.cross[a]:
                i, j = i[i < j], j[i < j]
            for t in range(0, len(i), PAIR_SLAB):
                yield self.confirm(i[t : t + PAIR_SLAB], j[t : t + PAIR_SLAB], threshold)


def _link(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): links of a spanning forest of each group with n null, and n more links of vector a with b null."""
    keys = ["group_no", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, Rotation] = {}
        for table, bounds in grouped(batches, keys, CHUNK_ROWS):
            size = np.diff(bounds)
            group = np.repeat(np.where(size <= SMALL_GROUP, np.arange(len(size)), -1), size)
            lengths = np.array([len(v) // 8 for v in table.column("vector").to_pylist()])
            for dims in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dims)
                part = Chunk(table if len(at) == len(table) else table.take(pa.array(at)), dims, turns.setdefault(dims, Rotation(dims)))
                place = np.searchsorted(at, bounds)
                pairs = [*part.small(group[at], threshold)]
                for g in np.flatnonzero((size > SMALL_GROUP) & (lengths[bounds[:-1]] == dims)).tolist():
                    pairs += part.large(int(place[g]), int(place[g + 1]), threshold)
                if pairs and len(i := np.concatenate([p[0] for p in pairs])):
                    j = np.concatenate([p[1] for p in pairs])
                    count = np.zeros(len(part.ids), np.int64)
                    np.add.at(count, i, part.copies[j])
                    np.add.at(count, j, part.copies[i])
                    forest = Forest()
                    links = [(p, q) for p, q in zip(part.ids[i].tolist(), part.ids[j].tolist(), strict=True) if forest.link(p, q)]
                    more = np.flatnonzero(count)
                    ids, sums = np.unique(part.ids[more], return_inverse=True)
                    sums = np.bincount(sums, count[more]).astype(np.int64)
                    none = [None] * max(len(links), len(ids))
                    yield _out([p for p, _ in links] + ids.tolist(), [q for _, q in links] + none[: len(ids)], none[: len(links)] + sums.tolist())

    ready = rows.repartition(*keys).sortWithinPartitions(*keys)
    return ready.mapInArrow(run, "a long, b long, n long")


def _out(*columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "n"])


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label).

    Vectors link when their labels are equal and not null and their cosine, in double precision, is at least
    `threshold`. Equal vectors of one label are one class, led by the smallest vec_id and counted with its copies. A
    pair of leaders of a label and a length is looked at once: the bound of its estimate, SIGMAS standard errors above it,
    dismisses it or has it computed again. Groups are dealt into pairs of blocks, so the work grows with the square of a
    label's distinct vectors. Counts and the links of a spanning forest are all that leaves a task.

    Vectors that are null, empty, zero, or hold null or non-finite numbers link with nothing, as do rows with a null
    label; vectors of different lengths never link. A null vec_id links with nothing, has a null component and is kept.
    Repeated rows are copies that link with each other. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "embeddings")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    label_type = rows.schema["label"].dataType
    usable_rows = rows.where("vec_id is not null and label is not null")
    coded = work.save(encode(usable_rows, label_type), "coded")
    classes = work.save(coded.groupBy("label", "vector").agg(F.min("vec_id").alias("leader"), F.count("*").alias("copies")), "classes")
    # the group of an id and a label, as a number, keeps the keys of a block short
    leaders = coded.join(classes, ["label", "vector"]).where("vec_id = leader").dropDuplicates(["vec_id", "label", "vector"])
    leaders = work.save(leaders.select(F.xxhash64("label", F.length("vector")).alias("group_no"), "vec_id", "copies", "vector", "code", "factor"), "leaders")
    ready = block_pairs(leaders, ["group_no"], "vec_id", BLOCK_ROWS)
    links = work.save(_link(ready, threshold), "links")
    found = components(spark, links.where("n is null").select("a", "b"))
    counts = links.where("n is not null").groupBy("a").agg(F.sum("n").alias("n"))
    members = coded.select("vec_id", "label", "vector").join(classes, ["label", "vector"]).select("vec_id", "leader", "copies")
    linked = members.join(found, F.col("leader") == F.col("node"), "left").join(counts, F.col("leader") == F.col("a"), "left")
    linked = linked.groupBy("vec_id").agg(F.max(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.min(F.coalesce("component", "leader")).alias("component"))
    out = rows.select("vec_id").join(linked, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
