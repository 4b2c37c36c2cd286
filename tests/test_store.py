"""A written history: versions of several tables, writers that meet, writers that fail, readers in between."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quotelake.sources import store as S

DAY = dt.datetime(2024, 1, 10)
DETECTIONS = S.TABLES["detections"].schema


@pytest.fixture()
def store(spark, tmp_path):
    return S.opened(spark, f"file://{tmp_path}/store")


def detections(spark, *rows):
    """(id, reference, hours)"""
    return spark.createDataFrame([(i, 1, r, None, DAY + dt.timedelta(hours=h), 1.0, False, False) for i, r, h in rows], DETECTIONS)


def held(store):
    return {r.id: (r.reference, r.validated, r.projected) for r in store.read("detections").collect()}


def test_history_of_changes(spark, store):
    assert held(store) == {} and store.versions() == []
    assert S.record(store, detections(spark, (1, "Jean 3:16", 0), (2, "Jean 3:16", 5), (3, "Marc 1:1", 1))) == 1
    first = store.snapshot()
    S.record(store, detections(spark, (3, "Marc 1:1", 1), (4, "Jean 3:16", 5)))
    assert len(held(store)) == 4
    S.mark_projected(store, spark.createDataFrame([("Jean 3:16",), ("Luc 1:1",), (None,)], "reference string"))
    # ties of time end with the larger id, others keep their flags
    assert [i for i, x in held(store).items() if x[2]] == [4]
    version = store.versions()[-1]
    assert S.mark_projected(store, spark.createDataFrame([("Jean 3:16",)], "reference string")) == version
    S.edit(store, spark.createDataFrame([(2, "validate"), (3, "validate"), (3, "delete"), (9, "delete"), (1, "other")], "id long, action string"))
    assert held(store) == {1: ("Jean 3:16", False, False), 2: ("Jean 3:16", True, False), 4: ("Jean 3:16", False, True)}
    S.retain(store, F.lit(DAY + dt.timedelta(hours=2)))
    assert sorted(held(store)) == [2, 4]
    before = held(store)
    store.compact()
    assert held(store) == before and len(store.snapshot().changes["detections"]) == 1
    assert sorted(r.id for r in first.read("detections").collect()) == [1, 2, 3]
    store.vacuum(keep=1, older_ms=-1000)
    assert held(store) == before and len(store.versions()) == 1


def test_the_second_of_two_writers_does_its_work_again(spark, store):
    S.put(store, spark.createDataFrame([("n", "1")], "key string, value string"))
    calls = []

    def add(now):
        calls.append(now.version)
        if len(calls) == 1:  # another writer comes between
            S.put(store, spark.createDataFrame([("n", "10"), ("m", "x")], "key string, value string"))
        return {"settings": now.read("settings").where("key = 'n'").withColumn("value", (F.col("value").cast("int") + 1).cast("string"))}

    assert store.commit(add) == 3 and calls == [1, 2]
    assert {r.key: r.value for r in store.read("settings").collect()} == {"n": "11", "m": "x"}
    S.put(store, spark.createDataFrame([("m", None), (None, "x")], "key string, value string"))
    assert [r.key for r in store.read("settings").collect()] == ["n"]


def test_a_writer_that_fails_leaves_nothing(spark, store):
    passages = lambda n, v="a": spark.createDataFrame([(v, "Jn", 1, i, f"t{n}") for i in range(n)], S.TABLES["passages"].schema)
    S.install(store, passages(3))

    @F.udf("string")
    def fails(x):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        store.commit(lambda _: {"passages": passages(9), "counts": spark.createDataFrame([("a",)], "version string").withColumn("books", fails("version"))})
    assert store.versions() == [1] and store.read("passages").count() == 3
    S.install(store, passages(2))
    S.install(store, passages(5, "b"))
    assert store.read("passages").groupBy("version").count().orderBy("version").collect() == [("a", 2), ("b", 5)]
    # each version has passages and counts that belong together
    for v in store.versions():
        now = store.snapshot(v)
        counted = {r.version: r.verses for r in now.read("counts").collect()}
        assert counted == {r.version: r["count"] for r in now.read("passages").groupBy("version").count().collect()}


def test_many_changes_fold_by_themselves(spark, store, monkeypatch):
    monkeypatch.setattr(S, "MOST_CHANGES", 3)
    rng = random.Random(1)
    want = {}
    for i in range(8):
        part = {str(rng.randrange(5)): rng.choice([None, str(i)]) for _ in range(2)}
        want |= part
        S.put(store, spark.createDataFrame(list(part.items()), "key string, value string"))
        assert {r.key: r.value for r in store.read("settings").collect()} == {k: v for k, v in want.items() if v is not None}
        assert len(store.snapshot().changes.get("settings", [])) <= 3


def test_a_task_reads_no_more_of_a_larger_table(spark, store, monkeypatch):
    monkeypatch.setattr(S, "PART_BYTES", 1 << 11, raising=False)
    key = ["version", "book", "chapter", "verse"]
    rows = spark.range(3_000).selectExpr("if(id % 3 = 0, 'a', 'b') version", "'x' book", "id div 50 chapter", "id verse", "sha2(cast(id as string), 256) text")
    S.install(store, rows.unionByName(rows.withColumn("text", F.lit("0"))))
    S.install(store, rows.where("version = 'a' and verse < 900").withColumn("text", F.lit("new")))
    now = store.read("passages")
    want = rows.where("version = 'b'").unionByName(rows.where("version = 'a' and verse < 900").withColumn("text", F.lit("new")))
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, want.select(*key, "text").collect()))
    assert {r.version: r.verses for r in store.read("counts").collect()} == {"a": 300, "b": 2_000}
    parts = now.groupBy(F.spark_partition_id()).count().agg(F.count("*"), F.max("count")).first()
    assert parts[0] > 16 and parts[1] < 2_300 / 8
    assert not spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(store.root).where("path like '%/aside/%'").count()
