"""Sharding by size-tiered compaction: small immutable shards, merged runs of similar size, versioned manifests.

A store is a folder of shard files and manifests. A manifest is one small JSON file that says what a version adds to the
one before and what it takes away; every FULL_EVERY-th names all live shards, so a commit writes about as much as it
changes. Version n is committed by renaming a finished temporary file to its name, which fails where that version exists
already, so of two writers one wins and readers see a whole version or none. Shards are never changed; those that
versions have let go are removed by `vacuum`.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from dataclasses import asdict, dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelake.llm.common import Workspace

TARGET_BYTES = 64 << 20
#: A tier holds sizes up to this many times the tier below.
TIER_STEP = 4
#: So many shards of one tier make a run that is merged.
RUN_SHARDS = 4
#: Versions of this multiple have a manifest of all shards, those between of their changes.
FULL_EVERY = 16
#: Shards that no manifest ever named are another writer's unfinished work until they are so old.
GRACE_SECONDS = 24 * 3600


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    arrival: int
    tier: int


class Conflict(Exception):
    """Another writer has committed the version."""


class ShardStore:
    """Appends, compacts and reads the shards under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, *, target_bytes: int = TARGET_BYTES, run_shards: int = RUN_SHARDS):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target, self.run = target_bytes, run_shards
        self.files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def _list(self, name: str) -> list:
        path = self._path(name)
        return list(self.files.listStatus(path)) if self.files.exists(path) else []

    def tier(self, size: int) -> int:
        """0 for shards of more than half the target size, as no two of them fit into one; 1 for those up to TIER_STEP
        times smaller, and so on."""
        tier = 0
        while size <= self.target // 2 // TIER_STEP**tier and tier < 12:
            tier += 1
        return tier

    def _versions(self) -> list[int]:
        found = [s.getPath().getName() for s in self._list("manifests")]
        return sorted(int(x[1:-5]) for x in found if x.startswith("v") and x.endswith(".json"))

    def version(self) -> int:
        """The latest committed version, 0 for none."""
        return max(self._versions(), default=0)

    def _manifest(self, version: int) -> dict:
        stream = self.files.open(self._path(f"manifests/v{version:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def shards(self, version: int | None = None) -> list[Shard]:
        """The shards of a version: those of the last full manifest up to it, with the changes since."""
        version = self.version() if version is None else version
        if not version:
            return []
        chain = [self._manifest(version)]
        while not chain[-1]["full"]:
            chain.append(self._manifest(chain[-1]["version"] - 1))
        live: dict[str, Shard] = {}
        for m in reversed(chain):
            for path in m["removed"]:
                live.pop(path, None)
            live |= {s["path"]: Shard(**s) for s in m["added"]}
        return list(live.values())

    def current(self) -> tuple[int, list[Shard]]:
        """The latest version with its shards, whatever other writers commit and vacuum meanwhile."""
        while True:
            version = self.version()
            try:
                return version, self.shards(version)
            except Py4JJavaError:
                if self.version() == version:
                    raise

    def commit(self, version: int, before: list[Shard], added: list[Shard], removed: set[str] = frozenset()) -> None:
        """Makes `before` with the changes version `version`; Conflict if there is one."""
        full = version == 1 or version % FULL_EVERY == 0
        rows = [s for s in before if s.path not in removed] + added if full else added
        text = json.dumps({"version": version, "full": full, "added": [asdict(s) for s in rows], "removed": [] if full else sorted(removed), "gone": sorted(removed)}, indent=1)
        temporary, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/v{version:010d}.json")
        out = self.files.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(temporary, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            self.files.delete(temporary, False)
            if not self.files.exists(final):
                raise
            raise Conflict(f"version {version} exists") from e

    def _write(self, df: DataFrame, arrival: int) -> list[Shard]:
        """Writes rows as shards of their own folder; a folder without manifest entry is invisible."""
        folder = f"shards/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        parts = sorted((s.getPath().getName(), s.getLen()) for s in self._list(folder) if s.getPath().getName().startswith("part-"))
        return [Shard(f"{folder}/{name}", size, arrival, self.tier(size)) for name, size in parts]

    def append(self, rows: DataFrame) -> int:
        """Commits the rows of one arrival as small shards, as its tasks write them; the new version. A writer that
        comes second commits the same shards to the next version."""
        new = self._write(rows.select(*self.schema.fieldNames()), 0)
        while True:
            version, live = self.current()
            try:
                self.commit(version + 1, live, [replace(s, arrival=version + 1) for s in new])
                return version + 1
            except Conflict:
                continue

    def read(self, shards: list[Shard] | None = None) -> DataFrame:
        shards = self.current()[1] if shards is None else shards
        if not shards:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{s.path}" for s in shards))

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """The shards of each tier below the target size that has at least run_shards of them, oldest first."""
        tiers = sorted({s.tier for s in shards if s.tier}, reverse=True)
        lines = ([s for s in shards if s.tier == t] for t in tiers)
        return [sorted(x, key=lambda s: (s.arrival, s.path)) for x in lines if len(x) >= self.run]

    @contextlib.contextmanager
    def _packed_reads(self):
        """Spark's readers then pack small files to partitions of the target size: a merge needs no shuffle."""
        wanted = {"spark.sql.files.maxPartitionBytes": str(self.target), "spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "0"}
        before = {k: self.spark.conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def bins(self, sizes: list[int]) -> int:
        """How many shards a merge of shards of these sizes writes: readers fill a partition, largest shard first, until
        the next would exceed the target."""
        count = fill = 0
        for size in sorted(sizes, reverse=True):
            if not count or fill + size > self.target:
                count, fill = count + 1, 0
            fill += size
        return count

    def compact(self) -> int:
        """Merges runs of similarly sized shards into target-sized ones, one job for a run, as long as that makes fewer
        shards; the version then. Nothing is written for a run whose sizes say that it would not."""
        while True:
            version, now = self.current()
            gone: set[str] = set()
            merged: list[Shard] = []
            for run in self.runs(now):
                if self.bins([s.bytes for s in run]) >= len(run):
                    continue
                with self._packed_reads():
                    new = self._write(self.read(run), run[0].arrival)
                if len(new) < len(run):
                    gone |= {s.path for s in run}
                    merged += new
                else:
                    self._remove(new)
            if not gone:
                return version
            try:
                self.commit(version + 1, now, merged, gone)
            except Conflict:
                self._remove(merged)
            else:
                self.vacuum()

    def _remove(self, shards: list[Shard]) -> None:
        for s in shards:
            self.files.delete(self._path(s.path), False)

    def vacuum(self, keep: int = 1, grace_seconds: int = GRACE_SECONDS) -> None:
        """Removes the manifests that the last `keep` versions don't need, the shards that versions before these had and
        they have not, and shards that no version ever had once they are `grace_seconds` older than the last commit: a
        writer may still commit younger ones."""
        latest = self.version()
        oldest = max(1, latest - keep + 1)
        kept = {s.path for v in range(oldest, latest + 1) for s in self.shards(v)}
        manifests = [self._manifest(v) for v in self._versions() if v <= latest]
        base = max((m["version"] for m in manifests if m["full"] and m["version"] <= oldest), default=1)
        for path in {p for m in manifests for p in m["gone"]} - kept:
            self.files.delete(self._path(path), False)
        for m in manifests:
            if m["version"] < base:
                self.files.delete(self._path(f"manifests/v{m['version']:010d}.json"), False)
        if latest:
            committed = self.files.getFileStatus(self._path(f"manifests/v{latest:010d}.json")).getModificationTime()
            for folder in self._list("shards"):
                name = folder.getPath().getName()
                live = any(p.startswith(f"shards/{name}/") for p in kept)
                if not live and folder.getModificationTime() < committed - 1000 * grace_seconds:
                    self.files.delete(folder.getPath(), True)

    def placement(self, *columns: str) -> DataFrame:
        """The given columns of every row of the latest version with shard (its path in the store), shard_bytes, tier,
        arrival and version."""
        version, shards = self.current()
        table = self.spark.createDataFrame([(s.path, s.bytes, s.tier, s.arrival) for s in shards], "shard string, shard_bytes long, tier int, arrival long")
        path = F.regexp_extract(F.col("_metadata.file_path"), r"(shards/[^/]+/[^/]+)$", 1) if shards else F.lit(None).cast("string")
        rows = self.read(shards).select(*columns, path.alias("shard")).join(table, "shard")
        return rows.select(*columns, "shard", "shard_bytes", "tier", "arrival", F.lit(version).cast("long").alias("version"))


def compacted(arrivals: list[DataFrame], *, target_bytes: int = TARGET_BYTES) -> ShardStore:
    """A store in the shared folder with the arrivals appended in turn, compacted.

    Null values, repeated rows, long texts and any columns are stored as they are; empty arrivals add no rows, and a
    store without rows reads as an empty table of the arrivals' schema.
    """
    spark = arrivals[0].sparkSession
    store = ShardStore(spark, Workspace(spark, "shards").root, arrivals[0].schema, target_bytes=target_bytes)
    for rows in arrivals:
        store.append(rows)
    store.compact()
    return store
