"""A history that is written: several tables under one version, changes that merge on read, and what an application does with
them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is folded into one set of files when it has more than so many sets of changes.
MOST_CHANGES = 32
ATTEMPTS = 20
#: Rows of about so many bytes of files go to one task; more bytes mean more tasks.
PART_BYTES = 32 << 20


@dataclass(frozen=True)
class Table:
    """A table of a store: its columns, and those that tell its rows apart."""

    schema: str
    key: tuple[str, ...]

    @property
    def stored(self) -> str:
        return f"{self.schema}, _version long, _gone boolean"


class Snapshot:
    """All tables as one version has them. What comes later doesn't change it."""

    def __init__(self, store: Store, version: int, changes: dict[str, list[str]]):
        self.store, self.version, self.changes = store, version, changes

    def read(self, name: str, *, gone: bool = False, among: DataFrame | None = None) -> DataFrame:
        """The rows of a table: of each key the newest change, unless it says that the row is gone. `among`: only rows that
        have these few values of key columns; others are left before rows are dealt."""
        table, spark = self.store.tables[name], self.store.spark
        paths = [f"{self.store.root}/changes/{c}/{name}" for c in self.changes.get(name, [])]
        if not paths:
            return spark.createDataFrame([], table.stored if gone else table.schema)
        rows = spark.read.schema(table.stored).parquet(*paths)
        if among is not None:
            rows = rows.join(F.broadcast(among), among.columns, "left_semi").select(*rows.columns)
        rows = self.store.dealt(rows, table.key, paths)
        rest = [c for c in rows.columns if c not in table.key and c != "_version"]
        newest = rows.groupBy(*table.key).agg(F.max(F.struct("_version", *rest)).alias("r")).select(*table.key, "r.*")
        newest = newest.select(*rows.columns)
        return newest if gone else newest.where("not _gone").drop("_version", "_gone")


class Store:
    """Tables under a folder that driver and executors share.

    A commit writes its changes as new files and then makes the next version visible by one rename that fails where that
    version exists: readers see all tables of a version or none of it, and of two writers the second does its work again on
    what the first has left. Files of a commit that failed are never read.
    """

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables
        self.jvm = spark._jvm
        self.files = self._path("versions").getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(self._path("versions"))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def dealt(self, rows: DataFrame, key: tuple[str, ...], paths: list[str]) -> DataFrame:
        """The rows of these files by their key, in parts of about PART_BYTES where the set number of partitions would make
        larger ones: what one task reads doesn't grow with a table."""
        size = sum(self.files.getContentSummary(self.jvm.org.apache.hadoop.fs.Path(p)).getLength() for p in paths)
        parts = -(-size // PART_BYTES)
        return rows.repartition(parts, *key) if parts > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else rows

    def versions(self) -> list[int]:
        found = (s.getPath().getName() for s in self.files.listStatus(self._path("versions")))
        return sorted(int(n[1:-5]) for n in found if n.startswith("v") and n.endswith(".json"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The tables as the newest version, or a given one, has them."""
        known = self.versions()
        if version is None and not known:
            return Snapshot(self, 0, {})
        version = known[-1] if version is None else version
        stream = self.files.open(self._path(f"versions/v{version:012d}.json"))
        try:
            return Snapshot(self, version, json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        return self.snapshot().read(name)

    def _publish(self, version: int, changes: dict[str, list[str]]) -> bool:
        temporary, final = self._path(f"versions/.{uuid.uuid4().hex}"), self._path(f"versions/v{version:012d}.json")
        out = self.files.create(temporary, True)
        out.write(json.dumps(changes).encode())
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(temporary, final, self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
                raise
            self.files.delete(temporary, False)
            return False
        return True

    def commit(self, change: Callable[[Snapshot], dict[str, DataFrame]]) -> int:
        """Commits the changes that `change` makes of a snapshot, to any number of tables at once, and gives the version.
        Changes are whole rows, with `_gone` true for rows to be removed. If another writer comes first, `change` is called
        again on what that one left. No changes, no version."""
        for _ in range(ATTEMPTS):
            base, name = self.snapshot(), uuid.uuid4().hex
            made = dict(base.changes)
            for table, rows in change(base).items():
                stored = self._as_stored(table, rows, base.version + 1)
                path = f"{self.root}/changes/{name}/{table}"
                stored.write.parquet(path)
                if not self.spark.read.schema(self.tables[table].stored).parquet(path).isEmpty():
                    made[table] = [*made.get(table, []), name]
            if made == base.changes:
                return base.version
            if self._publish(base.version + 1, made):
                full = [t for t, sets in made.items() if len(sets) > MOST_CHANGES]
                return self.compact(full) if full else base.version + 1
        raise RuntimeError(f"{ATTEMPTS} other commits came first")

    def _as_stored(self, table: str, rows: DataFrame, version: int) -> DataFrame:
        if "_gone" not in rows.columns:
            rows = rows.withColumn("_gone", F.lit(False))
        wanted = self.spark.createDataFrame([], self.tables[table].stored).schema
        rows = rows.withColumn("_version", F.lit(version).cast("long"))
        have = set(rows.columns)
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted))
        key = [F.col(k).isNotNull() for k in self.tables[table].key]
        for k in key:
            rows = rows.where(k)
        return rows

    def compact(self, tables: list[str] | None = None) -> int:
        """Folds the changes of tables into one set of files each; what they hold stays the same."""
        for _ in range(ATTEMPTS):
            base, name = self.snapshot(), uuid.uuid4().hex
            made = dict(base.changes)
            for table in tables or sorted(made):
                if len(base.changes.get(table, [])) > 1:
                    base.read(table, gone=True).where("not _gone").write.parquet(f"{self.root}/changes/{name}/{table}")
                    made[table] = [name]
            if made == base.changes or self._publish(base.version + 1, made):
                return base.version + (made != base.changes)
        raise RuntimeError(f"{ATTEMPTS} other commits came first")

    def vacuum(self, keep: int = 10, older_ms: int = 86_400_000) -> None:
        """Removes all but the newest `keep` versions, and files that none of these names and that are older than a day: a
        younger one may belong to a commit under way."""
        known = self.versions()
        named = {c for v in known[-keep:] for sets in self.snapshot(v).changes.values() for c in sets}
        for v in known[:-keep]:
            self.files.delete(self._path(f"versions/v{v:012d}.json"), False)
        if self.files.exists(self._path("changes")):
            oldest = self.jvm.java.lang.System.currentTimeMillis() - older_ms
            for s in self.files.listStatus(self._path("changes")):
                if s.getPath().getName() not in named and s.getModificationTime() < oldest:
                    self.files.delete(s.getPath(), True)


TABLES = {
    "detections": Table("id long, session_id long, reference string, book string, detected_at timestamp, value double, validated boolean, projected boolean", ("id",)),
    "settings": Table("key string, value string", ("key",)),
    "passages": Table("version string, book string, chapter long, verse long, text string", ("version", "book", "chapter", "verse")),
    "counts": Table("version string, books long, chapters long, verses long", ("version",)),
}


def opened(spark: SparkSession, root: str) -> Store:
    """The store of an application: detections, settings, passages and their counts."""
    return Store(spark, root, TABLES)


def record(store: Store, detections: DataFrame) -> int:
    """Adds detections; one whose id is known replaces it, so a call that is made again changes nothing."""
    return store.commit(lambda _: {"detections": detections})


def edit(store: Store, changes: DataFrame) -> int:
    """Applies changes (id, action): 'validate' flags a detection, 'delete' removes it whatever else is asked."""
    did = changes.where("action in ('validate', 'delete')").groupBy("id").agg(F.bool_or(F.col("action") == "delete").alias("_gone"))
    return store.commit(lambda now: {"detections": now.read("detections").join(did, "id").withColumn("validated", F.lit(True))})


def mark_projected(store: Store, references: DataFrame) -> int:
    """Flags the newest detection of each reference (column reference) as projected; older ones keep their flags."""

    def change(now: Snapshot) -> dict[str, DataFrame]:
        rows = now.read("detections").join(references.select("reference").distinct(), "reference", "left_semi")
        newest = rows.groupBy("reference").agg(F.max(F.struct("detected_at", "id"))["id"].alias("id")).select("id")
        return {"detections": rows.join(newest, "id", "left_semi").where("projected is null or not projected").withColumn("projected", F.lit(True))}

    return store.commit(change)


def retain(store: Store, since) -> int:
    """Removes the detections before `since` (a column or a time)."""
    return store.commit(lambda now: {"detections": now.read("detections").where(F.col("detected_at") < since).withColumn("_gone", F.lit(True))})


def put(store: Store, settings: DataFrame) -> int:
    """Sets settings (key, value); a null value removes one."""
    return store.commit(lambda _: {"settings": settings.select("key", "value", F.col("value").isNull().alias("_gone"))})


def install(store: Store, passages: DataFrame) -> int:
    """Replaces the versions that `passages` has, and their counts with them in the same commit; other versions stay.
    The passages are written aside once, so that they are made once and their size is known."""
    key = TABLES["passages"].key
    aside = f"{store.root}/aside/{uuid.uuid4().hex}"

    def change(now: Snapshot) -> dict[str, DataFrame]:
        rows = store.spark.read.schema(TABLES["passages"].schema).parquet(aside)
        given = store.dealt(rows, key, [aside]).groupBy(*key).agg(F.max("text").alias("text"))
        versions = rows.select("version").distinct()
        old = now.read("passages", among=versions).join(rows.select(*key), list(key), "left_anti").withColumn("_gone", F.lit(True))
        known = rows.select(*key).distinct()
        counts = known.groupBy("version").agg(F.countDistinct("book").alias("books"), F.countDistinct("book", "chapter").alias("chapters"), F.count("*").alias("verses"))
        return {"passages": given.withColumn("_gone", F.lit(False)).unionByName(old), "counts": counts}

    wanted = store.spark.createDataFrame([], TABLES["passages"].schema).schema
    try:
        passages.dropna(subset=list(key)).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted)).write.parquet(aside)
        return store.commit(change)
    finally:
        store.files.delete(store._path(aside.removeprefix(f"{store.root}/")), True)
