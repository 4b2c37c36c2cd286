from pathlib import Path

import pytest

from quotelake.llm.common import Workspace
from quotelake.llm.sharding import Conflict, Shard, ShardStore, compacted

SCHEMA = "doc_id long, text string, shard string"


def rows(spark, a, b):
    return spark.createDataFrame([(i, f"text {i} " * 20, None) for i in range(a, b)], SCHEMA)


def store(spark, **kw):
    return ShardStore(spark, Workspace(spark, "test-shards").root, rows(spark, 0, 1).schema, **kw)


def test_round_trip_and_compaction(spark, monkeypatch):
    s = store(spark, target_bytes=40_000)
    for k in range(9):
        assert s.append(rows(spark, 100 * k, 100 * k + 100).repartition(2)) == k + 1
    before = s.shards()
    assert len(before) == 18 and all(x.tier for x in before)
    version = s.compact()
    after = s.shards()
    assert version > 9 and len(after) < len(before)
    assert not [t for t in {x.tier for x in after} if t and sum(x.tier == t for x in after) >= 4] or len(after) <= len(before) // 2
    assert sorted(map(tuple, s.read().collect())) == sorted(map(tuple, rows(spark, 0, 900).collect()))
    placed = s.placement("doc_id").collect()
    assert sorted(r.doc_id for r in placed) == list(range(900)) and {r.version for r in placed} == {version}
    assert {r.shard for r in placed} == {x.path for x in after}
    tmp = s.root.removeprefix("file://")
    files = sorted(map(str, Path(tmp).rglob("part-*.parquet")))
    monkeypatch.setattr(s, "_write", None)
    assert s.compact() == version, "a second compaction writes nothing"
    assert files == sorted(map(str, Path(tmp).rglob("part-*.parquet"))) and len(files) == len(after)


def test_deltas_and_full_manifests_read_alike(spark):
    s = store(spark)
    shards = [Shard(f"shards/x/{i}", 10, i, 1) for i in range(40)]
    live = []
    for v in range(1, 36):
        gone = {live[0].path} if v % 3 == 0 else set()
        s.commit(v, live, [shards[v]], gone)
        live = [x for x in live if x.path not in gone] + [shards[v]]
        assert s.shards(v) == live
    s.vacuum()
    assert s.shards() == live and s.current() == (35, live) and min(s._versions()) == 32


def test_shards_of_unfinished_writers_outlive_a_vacuum(spark):
    a = store(spark, target_bytes=40_000)
    for k in range(5):
        a.append(rows(spark, 10 * k, 10 * k + 10).coalesce(1))
    slow = ShardStore(spark, a.root, a.schema, target_bytes=40_000)
    written = slow._write(rows(spark, 900, 905).coalesce(1), 0)
    assert a.compact() == 6
    version, live = slow.current()
    slow.commit(version + 1, live, written)
    assert sorted(r.doc_id for r in a.read().collect()) == [*range(50), *range(900, 905)]
    left = slow._write(rows(spark, 950, 955).coalesce(1), 0)
    a.append(rows(spark, 60, 61))
    a.vacuum(grace_seconds=-60)
    assert not any(a.files.exists(a._path(x.path)) for x in left) and a.read().count() == 56


def test_a_version_is_committed_once(spark):
    s = store(spark)
    s.append(rows(spark, 0, 5))
    with pytest.raises(Conflict):
        s.commit(1, [], [])
    assert s.version() == 1 and s.read().count() == 5


def test_a_writer_that_loses_tries_again(spark, monkeypatch):
    s = store(spark)
    other = ShardStore(spark, s.root, s.schema)
    plain, done = s.commit, []

    def late(version, *shards):
        if not done:
            done.append(other.append(rows(spark, 100, 103)))
        plain(version, *shards)

    monkeypatch.setattr(s, "commit", late)
    assert s.append(rows(spark, 0, 5)) == 2
    assert sorted(r.doc_id for r in s.read().collect()) == [0, 1, 2, 3, 4, 100, 101, 102]


def test_old_versions_can_be_read_until_vacuumed(spark):
    s = store(spark)
    s.append(rows(spark, 0, 5))
    s.append(rows(spark, 5, 9))
    assert s.read(s.shards(1)).count() == 5 and s.read().count() == 9
    s.vacuum()
    assert s.read().count() == 9 and s.version() == 2


def test_empty_tables_nulls_and_repeated_rows(spark):
    empty = compacted([rows(spark, 0, 0)])
    assert empty.read().count() == 0 and empty.placement("doc_id").collect() == []
    odd = spark.createDataFrame([(None, None, None), (1, "", "s"), (1, "", "s"), (2, "x" * 200_000, "s")], SCHEMA)
    full = compacted([odd, rows(spark, 0, 0), odd])
    assert sorted(map(tuple, full.read().collect()), key=str) == sorted(map(tuple, odd.union(odd).collect()), key=str)


def test_a_table_of_one_file_goes_through_appends_and_a_merge(spark, tmp_path):
    from quotelake.llm.queries import op9_sharding

    rows(spark, 0, 400).unionByName(rows(spark, 0, 3)).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = op9_sharding(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted([*range(400), 0, 1, 2])
    assert {r.version for r in got} == {9} and len({r.shard for r in got}) < 8
