import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from quotelake.operators import sessions as S
from quotelake.streaming import live as L

EVENT = "event_id long, ts timestamp, user_id long, event_type string"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def pieces(spark, tmp_path_factory):
    """Events in four files in order of time, and all of them as one table."""
    rng = random.Random(3)
    rows, t = [], 0.0
    for i in range(400):
        t += rng.choice([0, 1, 5, 20])
        rows.append((i, START + dt.timedelta(seconds=t), rng.randrange(4), rng.choice("abc")))
    path = str(tmp_path_factory.mktemp("events") / "events")
    for k in range(4):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], EVENT).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return path, spark.createDataFrame(rows, EVENT)


def run(spark, path, table, build, tmp_path, **more):
    stream = L.source(spark, path, table.schema, files_per_trigger=1)
    return sorted(map(tuple, L.replay(build(stream), str(tmp_path), **more).collect()), key=repr)


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_dedup_in_pieces_is_the_batch_form(spark, pieces, tmp_path):
    path, table = pieces
    got = run(spark, path, table, lambda s: L.emitted(s, "user_id", "event_type", 30), tmp_path)
    keyed = table.withColumn("k", F.concat_ws(" ", "user_id", "event_type"))
    want = S.emitted(keyed, "k", 30).select(F.split("k", " ")[0].cast("long"), "event_id")
    assert got == plain(want) and 0 < len(got) < 400


def test_the_last_emission_alone_is_remembered(spark, pieces, tmp_path):
    path, table = pieces
    got = run(spark, path, table, lambda s: L.emitted(s, "user_id", "event_type", 30, only_last=True), tmp_path)
    last, want = {}, []
    for r in table.orderBy("ts", "event_id").collect():
        ref, at = last.get(r.user_id, (None, None))
        if ref != r.event_type or (r.ts - at).total_seconds() >= 30:
            last[r.user_id] = (r.event_type, r.ts)
            want.append((r.user_id, r.event_id))
    assert got == sorted(want, key=repr)


def test_contradictions_and_anchors_in_pieces(spark, pieces, tmp_path):
    path, table = pieces
    got = run(spark, path, table, lambda s: L.contradicted(s, "user_id", "event_type", 12), tmp_path / "c")
    assert got == plain(S.contradicted(table, 12)) and {c for _, c in got} == {True, False}
    got = run(spark, path, table, lambda s: L.anchored(s, "user_id", "event_type", "a", 40), tmp_path / "a")
    assert got == plain(S.anchored(table, anchor="a", seconds=40).where("true"))


def test_pauses_close_sessions_that_the_watermark_passed(spark, pieces, tmp_path):
    path, table = pieces
    got = run(spark, path, table, lambda s: L.pauses(s, "user_id", "45 seconds"), tmp_path)
    want = plain(S.pauses(table, "45 seconds"))
    assert got and set(got) <= set(want)


def test_latest_never_goes_back(spark, pieces, tmp_path):
    path, table = pieces
    got = run(spark, path, table, lambda s: L.latest(s, "user_id", "event_type"), tmp_path)
    best = {}
    for u, e, _ in got:
        best.setdefault(u, []).append(e)
    assert {u: max(e) for u, e in best.items()} == {r.user_id: r.event_id for r in S.latest(table).collect()}


def feed(spark, tmp_path, rows, schema, build):
    path = str(tmp_path / "in")
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)
    return sorted(map(tuple, L.replay(build(stream), str(tmp_path / "out")).collect()), key=repr)


def test_health_warms_up_recovers_and_starts_anew(spark, tmp_path):
    counts = [40, 40] + [3] * 10 + [0] + [30] * 10 + [2]
    rows = [(1, i, n, False) for i, n in enumerate(counts)] + [(1, 99, 2, True)]
    got = feed(spark, tmp_path, [rows[:5], rows[5:14], rows[14:]], "session_id long, seq long, n_words long, opens boolean", L.health)
    reliable = {seq: ok for _, seq, _, ok, _ in got}
    assert reliable[0] and reliable[4] and not reliable[11] and reliable[23] and reliable[99] and 12 not in reliable
    assert [seq for _, seq, _, _, flip in sorted(got, key=lambda r: r[1]) if flip and seq < 99][0] == min(s for s, ok in reliable.items() if not ok)


VERSE = "Car Dieu a tant aimé le monde qu'il a donné son Fils unique"


@pytest.mark.parametrize(
    "said, want",
    [
        (["car dieu a tant aimé le monde"], 7),
        (["car dieux a temps aimer le monde", "qu'il a donner son fils"], 12),
        (["bonjour à tous les amis"], 0),
        (["il a dit des choses la sans rapport"], 0),
        (["car dieu", "a tant aimé le monde qu'il a donné son fils unique et plus"], 13),
        ([""], 0),
    ],
)
def test_reading_along(spark, tmp_path, said, want):
    rows = [[(1, 0, VERSE, None)], *[[(1, i, None, s)] for i, s in enumerate(said, 1)]]
    schema = "session_id long, seq long, shown string, said string"
    got = feed(spark, tmp_path, rows, schema, L.reading)
    assert max(r[2] for r in got) == want and {r[3] for r in got} == {13}
    flat = spark.createDataFrame([r for part in rows for r in part], schema)
    assert plain(L.reading_positions(flat)) == sorted((r[:4] for r in got), key=repr)


def test_utterances_end_at_sentences_stillness_and_length(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    long = "mot " * 90
    rows = [(1, 0, at(0), "Un début"), (1, 1, at(0.5), "Un début. La suite"), (1, 2, at(1), "Un début. La suite vient"), (1, 3, at(3), "Un début. La suite vient encore"), (2, 0, at(0), "Fin."), (2, 1, at(0.4), "Fin."), (3, 0, at(0), long)]
    got = feed(spark, tmp_path, [rows[:2], rows[2:]], "session_id long, seq long, ts timestamp, text string", L.finished)
    assert [r for r in got if r[0] == 1] == [(1, 1, "Un début."), (1, 3, "La suite vient")]
    assert not [r for r in got if r[0] == 2]
    assert [(s, len(t)) for s, _, t in got if s == 3] == [(3, 299)]


def test_stale_partials_go_finished_ones_stay(spark):
    rows = spark.createDataFrame([(1, 0, "a", False), (1, 1, "b", True), (1, 2, "c", False), (1, 3, "d", False), (2, 0, "e", True), (2, 1, "f", True)], "session_id long, seq long, text string, is_final boolean")
    assert {r.text for r in L.current(rows).collect()} == {"b", "d", "e", "f"}
