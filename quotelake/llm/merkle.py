"""Merkle manifests: one hash that vouches for a dataset, and a proof for each of its rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.common import Workspace

#: Leaves are built up in aligned blocks of 2 ** BLOCK_LEVELS, the nodes above in windows of 2 ** WINDOW_LEVELS.
BLOCK_LEVELS, WINDOW_LEVELS = 10, 10

#: A node: its number among those of its block or window and level, its digest, whether it holds its group's last leaf.
Node = tuple[int, str, bool]


def row_hash(values: list[Column]) -> Column:
    """sha256 (hex) of values in turn: `-` for null, else the length in bytes, a colon, the value."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def digest(*children: str) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def climb(nodes: dict[int, list[Node]], top: int, sole: bool) -> list[dict[int, tuple[str, bool]]]:
    """All nodes of a block or window by level, from those at hand (level -> nodes): pairs become a parent, and so does the
    group's last node alone. It ends at level `top`, in a group's only block (`sole`) where one node is left."""
    levels: list[dict[int, tuple[str, bool]]] = []
    for level in range(top + 1):
        now = {i: (d, last) for i, d, last in nodes.get(level, ())}
        if level:
            below = levels[-1]
            for i, (d, last) in below.items():
                if not i & 1:
                    if other := below.get(i + 1):
                        now[i >> 1] = digest(d, other[0]), other[1]
                    elif last:
                        now[i >> 1] = digest(d), True
        levels.append(now)
        if sole and len(now) == 1 and now.get(0, ("", False))[1]:
            break
    return levels


def complete(levels: list[dict[int, tuple[str, bool]]], top: int) -> bool:
    """Whether these levels came to the block's only node."""
    return 0 in levels[-1] and (len(levels) == top + 1 or levels[-1][0][1])


def ragged(levels: list[dict[int, tuple[str, bool]]]) -> Iterator[tuple[int, int, str, bool]]:
    """The nodes without a parent: the roots of what is complete."""
    for level, now in enumerate(levels):
        above = levels[level + 1] if level + 1 < len(levels) else {}
        yield from ((level, i, d, last) for i, (d, last) in now.items() if i >> 1 not in above)


def siblings(levels: list[dict[int, tuple[str, bool]]], i: int) -> list[str]:
    """For each level up to the top: `L` or `R` and the digest of the node's sibling, nothing where it has none."""
    path = []
    for level in levels[:-1]:
        found = level.get(i ^ 1)
        path.append(("L" if i & 1 else "R") + found[0] if found else "")
        i >>= 1
    return path


class Trees:
    """One tree for each group of rows (key, group, leaf, value): leaves in the order of the keys, which differ and sort by
    group first.

    The rows are sorted into ranges. Each task tells the driver how many rows of its first and of its last group it holds,
    which is all that places its leaves (two numbers a partition, however many groups there are). Then tasks build the
    complete subtrees of their rows block by block; roots of blocks that partitions cut go to one another by block, and
    roots of whole blocks by window, round after round until each group has one root. Blocks and windows are bounded, so
    no task holds a group.
    """

    def __init__(self, work: Workspace, name: str, rows: RDD, partitions: int, block: int, window: int):
        self.work, self.name, self.partitions, self.block, self.window = work, name, partitions, block, window
        self.sorted = rows.map(lambda r: (r[0], r[1:])).sortByKey(numPartitions=partitions).values()
        self.leaves = self.sorted.mapPartitionsWithIndex(_numbered(_offsets(self.sorted.mapPartitionsWithIndex(_edges).collect()), block))
        self.results = [self._blocks()]
        while not (rest := self.results[-1].where("not is_root")).isEmpty():
            self.results.append(self._windows(rest, len(self.results)))

    def _save(self, rows: RDD, name: str) -> DataFrame:
        schema = "grp string, number long, digest string, last boolean, is_root boolean"
        return self.work.save(self.work.spark.createDataFrame(rows, schema, verifySchema=False), f"{self.name}-{name}")

    def _blocks(self) -> DataFrame:
        size = self.block
        schema = "grp string, block long, level int, i long, digest string, last boolean, whole boolean"
        local = self.leaves.mapPartitions(lambda rows: _local(rows, size))
        local = self.work.save(self.work.spark.createDataFrame(local, schema, verifySchema=False), f"{self.name}-local")
        whole = local.where("whole").select("grp", F.col("block").alias("number"), "digest", "last", F.expr("last and block = 0").alias("is_root"))
        cut = local.where("not whole").rdd.map(lambda r: ((r.grp, r.block), (r.level, r.i, r.digest, r.last)))

        def finish(found):
            (group, block), nodes = found
            levels: dict[int, list[Node]] = {}
            for level, *node in nodes:
                levels.setdefault(level, []).append(tuple(node))
            d, last = climb(levels, size, block == 0)[-1][0]
            return group, block, d, last, last and block == 0

        return whole.unionByName(self._save(cut.groupByKey(self.partitions).map(finish), "cut"))

    def _members(self, rows: DataFrame) -> RDD:
        """(group, window) -> its nodes, at most 2 ** window."""
        size = self.window
        return rows.rdd.map(lambda r: ((r.grp, r.number >> size), (r.number & (1 << size) - 1, r.digest, r.last))).groupByKey(self.partitions)

    def _windows(self, rest: DataFrame, stage: int) -> DataFrame:
        size = self.window

        def one(found):
            (group, number), nodes = found
            d, last = climb({0: list(nodes)}, size, number == 0)[-1][0]
            return group, number, d, last, last and number == 0

        return self._save(self._members(rest).map(one), f"windows{stage}")

    def roots(self) -> RDD:
        """(group, root digest)."""
        found = self.results[0]
        for more in self.results[1:]:
            found = found.unionByName(more)
        return found.where("is_root").rdd.map(lambda r: (r.grp, r.digest))

    def proofs(self, above: RDD) -> RDD:
        """(leaf, value, proof, extra) for each row, from (group, (path above its root, extra)): its siblings, leaf to top."""
        window, block = self.window, self.block
        paths = None
        for stage in range(len(self.results) - 1, -1, -1):
            own = self.results[stage].where("is_root").rdd.map(lambda r: (r.grp, r.number)).join(above, self.partitions)
            own = own.map(lambda x: ((x[0], x[1][0]), x[1][1]))
            if paths is not None:
                members = self._members(self.results[stage].where("not is_root")).join(paths, self.partitions)

                def down(found):
                    (group, number), (nodes, (path, extra)) = found
                    nodes = list(nodes)
                    levels = climb({0: nodes}, window, number == 0)
                    return [((group, number << window | i), (siblings(levels, i) + path, extra)) for i, _, _ in nodes]

                own = own.union(members.flatMap(down))
            paths = own
        leaves = self.leaves.map(lambda r: ((r[0], r[1] >> block), (r[1] & (1 << block) - 1, *r[2:])))

        def in_block(found):
            (_, number), (rows, known) = found
            rows, (path, extra) = list(rows), next(iter(known))
            levels = climb({0: [r[:3] for r in rows]}, block, number == 0)
            return [(leaf, value, siblings(levels, i) + path, extra) for i, leaf, _, value in rows]

        return leaves.cogroup(paths, numPartitions=self.partitions).flatMap(in_block)


def _edges(at: int, rows: Iterable[tuple]) -> Iterator[tuple]:
    """(partition, first group, its rows, last group, its rows) of a range; nothing of an empty one."""
    first = last = None
    for group, part in groupby(rows, key=lambda r: r[0]):
        last = group, sum(1 for _ in part)
        first = first or last
    if first and last:
        yield at, *first, *last


def _offsets(edges: list[tuple]) -> dict[int, tuple[int, bool]]:
    """partition -> (number of rows of its first group before it, whether its last group ends in it)."""
    found, before, group = {}, 0, None
    for (at, first, _, last, n), after in zip(edges, [*edges, None][1:], strict=True):
        before = before if first == group else 0
        found[at] = before, after is None or after[1] != last
        before = before + n if first == last else n
        group = last
    return found


def _numbered(offsets: dict[int, tuple[int, bool]], block: int):
    """(group, number, leaf, whether it is the last, value) of a range's rows."""

    def run(at: int, rows: Iterable[tuple]) -> Iterator[tuple]:
        start, ends = offsets.get(at, (0, True))
        held = None
        for group, leaf, value in rows:
            if held is not None:
                if held[0] == group:
                    start += 1
                    yield (*held, False, value_held)
                else:
                    yield (*held, True, value_held)
                    start = 0
            held, value_held = (group, start, leaf), value
        if held is not None:
            yield (*held, ends, value_held)

    return run


def _local(rows: Iterable[tuple], block: int) -> Iterator[tuple]:
    """The roots of the complete subtrees in each block of a range's rows."""
    for (group, number), part in groupby(rows, key=lambda r: (r[0], r[1] >> block)):
        levels = climb({0: [(r[1] & (1 << block) - 1, r[2], r[3]) for r in part]}, block, number == 0)
        if complete(levels, block):
            yield group, number, len(levels) - 1, 0, *levels[-1][0], True
        else:
            yield from ((group, number, level, i, d, last, False) for level, i, d, last in ragged(levels))


def manifest(rows: DataFrame, *, order: str = "doc_id", group: str = "lang", leaf: str = "leaf", carry: list[str] | None = None, block_levels: int = BLOCK_LEVELS, window_levels: int = WINDOW_LEVELS) -> DataFrame:
    """order, the carried columns, leaf, subroot, root, proof (array of strings, see `siblings`) for each row.

    Leaves (hex digests) of a group ascend by `order`, then by leaf; two neighbours become the digest of both, a last one
    without a neighbour the digest of itself, until one is left, the group's subroot. The subroots, by group in the order
    of bytes, become the root in the same way. A proof leads from leaf to root.

    Null groups are a group that comes first, null orders come first in theirs, repeated rows are leaves each, an empty
    table gives no rows. Texts don't travel, only their digests; see `Trees` for how no task holds a group.
    """
    spark, carry = rows.sparkSession, carry or []
    work = Workspace(spark, "merkle")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = rows.select(F.col(group).alias("grp"), F.col(order).alias("ord"), F.col(leaf).alias("leaf"), *(F.col(c).alias(f"carry{i}") for i, c in enumerate(carry)), F.monotonically_increasing_id().alias("seq"))
    saved = work.save(named, "leaves")
    width = len(carry)

    def keyed(r):
        group = "-" if r.grp is None else f"={r.grp}"
        return (group, r.ord is not None, r.ord or 0, r.leaf, r.seq), group, r.leaf, (r.ord, *r[3 : 3 + width])

    trees = Trees(work, "rows", saved.rdd.map(keyed), partitions, block_levels, window_levels)
    upper = Trees(work, "groups", trees.roots().map(lambda x: (x[0], "", x[1], x[0])), partitions, block_levels, window_levels)
    above = upper.proofs(upper.roots().map(lambda x: (x[0], ([], x[1])))).map(lambda x: (x[1], (x[2], (x[0], x[3]))))
    proofs = trees.proofs(above).map(lambda x: (*x[1], x[0], *x[3], x[2]))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"`{c}` {types[c]}" for c in [order, *carry]] + ["leaf string, subroot string, root string, proof array<string>"])
    return spark.createDataFrame(proofs, schema, verifySchema=False)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    other = lambda p: F.substring(p, 2, 64)
    return F.aggregate(proof, leaf, lambda x, p: F.sha2(F.when(p == "", x).when(p.startswith("L"), F.concat(other(p), x)).otherwise(F.concat(x, other(p))), 256))


def proof_hash(proof: Column) -> Column:
    """sha256 (hex) of a proof's siblings."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.substring(p, 2, 64)), ""), 256)


def tampered_manifest(documents: DataFrame, **how) -> DataFrame:
    """The manifest of documents (doc_id, source, lang, n_chars, text), and what its proofs make of rows whose n_chars is
    one more where 7 divides the crc32 of the doc_id as text: doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    more = [F.col(c).cast("decimal(20, 0)") + 1 if c == "n_chars" else F.col(c) for c in fields]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    leaves = documents.select("doc_id", "lang", row_hash([F.col(c) for c in fields]).alias("leaf"), F.when(chosen, row_hash(more)).alias("tampered"))
    found = manifest(leaves, carry=["tampered"], **how)
    found = found.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("proof")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
