"""Live operators with timers against their folds: late, shuffled and split input, and state that ends."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quotelake.operators import engine as E
from quotelake.streaming import live as L
from quotelake.streaming import timed as T

START = dt.datetime(2024, 1, 7, 10)
EPOCH = dt.datetime(1970, 1, 1)


def micros(seconds):
    return int((START - EPOCH).total_seconds() * 1e6) + int(seconds * 1e6)


def stream_of(spark, folder, schema, pieces, per_trigger=1):
    """A stream whose files hold the pieces; each row's first value is its time in seconds."""
    for i, piece in enumerate(pieces):
        rows = [(None if r[0] is None else START + dt.timedelta(seconds=r[0]), *r[1:]) for r in piece]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/p{i:03d}")
        for f in os.listdir(f"{folder}/in/p{i:03d}"):
            if f.endswith(".parquet"):
                os.utime(f"{folder}/in/p{i:03d}/{f}", (1_700_000_000 + 10 * i, 1_700_000_000 + 10 * i))
    schema = spark.read.parquet(f"{folder}/in/p000").schema
    return L.source(spark, f"{folder}/in/*", schema, files_per_trigger=per_trigger)


REFERENCES = "ts timestamp, session_id long, seq long, event_id long, place long, book_abbr string, chapter long, verse_start long, verse_end long, in_plan boolean, off_plan boolean"


def references(rng, n):
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 1, 3, 11, 12, 13, 29, 31, 200])
        session, plan = rng.choice([1, 1, 1, 2, 3]), rng.choice([(False, False), (True, False), (False, True)])
        rows += [(float(t), session, i, 10 * i + place, place, "Jn", 3, rng.choice([None, 1, 2, 3]), None, *plan) for place in range(1, rng.choice([2, 2, 4]))]
    return rows


def pieces_of(rng, rows, late_seconds, n):
    """Rows out of order by less than the watermark's delay, in pieces of any size."""
    mixed = sorted(rows, key=lambda r: r[0] + rng.random() * late_seconds)
    cuts = sorted(rng.sample(range(len(mixed)), n - 1))
    return [mixed[a:b] for a, b in zip([0, *cuts], [*cuts, len(mixed)], strict=True)]


def test_shuffled_and_split_streams_equal_the_fold(spark, tmp_path):
    rng = random.Random(4)
    rows = references(rng, 150)
    end = [(1e6, 99, 10**6, 10**9, 1, "Gn", 1, 1, None, False, False)]
    stream = stream_of(spark, tmp_path, REFERENCES, [*pieces_of(rng, rows, 25, 5), end])
    got, late = T.replay(T.live(stream, T.shown_once(), key="session_id"), f"{tmp_path}/out")
    whole = spark.read.parquet(f"{tmp_path}/in/*")
    want = T.folded(whole.where("session_id < 99"), T.shown_once(), key="session_id")
    assert late.count() == 0
    found = sorted(map(tuple, got.collect()))
    assert found == sorted(map(tuple, want.collect()))
    # the engine's own form over tables, which shares no code with the machine
    decided = whole.where("session_id < 99").withColumn("t", F.unix_micros("ts")).withColumn("uid", F.col("seq"))
    plain = E.shown_once(decided).withColumn("disputed", (F.col("disputed") | F.col("off_plan")) & ~F.col("in_plan") & (F.col("place") == 1))
    assert found == sorted(map(tuple, plain.select("session_id", "seq", "place", "disputed").collect()))


def test_late_rows_change_nothing_and_are_kept(spark, tmp_path):
    a = (0.0, 1, 0, 0, 1, "Jn", 3, 16, None, False, False)
    b = (5.0, 1, 1, 1, 1, "Jn", 3, 17, None, False, False)
    far = (500.0, 2, 2, 2, 1, "Gn", 1, 1, None, False, False)
    late = (20.0, 1, 3, 3, 1, "Jn", 3, 16, None, False, False)
    no_time = (None, 1, 4, 4, 1, "Jn", 3, 16, None, False, False)
    end = (1e6, 9, 5, 5, 1, "Gn", 1, 1, None, False, False)
    stream = stream_of(spark, tmp_path, REFERENCES, [[b, a], [far], [far[:2] + (6, 6) + far[4:]], [late, no_time], [end], [end[:2] + (7, 7) + end[4:]]])
    got, dropped = T.replay(T.live(stream, T.shown_once(), key="session_id"), f"{tmp_path}/out")
    assert sorted((r.seq, r.disputed) for r in got.collect()) == [(0, False), (1, True), (2, False)]
    assert sorted(json.loads(r.late)["seq"] for r in dropped.collect()) == [3, 4]


def test_state_ends(spark, tmp_path):
    rows = [(float(i), i % 5, i, i, 1, "Jn", 3, i, None, False, False) for i in range(40)]
    ends = [[(1e5 * (k + 1), 9, 100 + k, 100 + k, 1, "Gn", 1, k, None, False, False)] for k in range(3)]
    stream = stream_of(spark, tmp_path, REFERENCES, [rows, *ends])
    out = T.live(stream, T.shown_once(), key="session_id")
    with T.stored_in(spark):
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    # of each key its waiting rows and its memory are gone but for the last session's
    state = spark.read.format("statestore").option("stateVarName", "memory").load(f"{tmp_path}/checkpoint")
    assert {r.key["key"] for r in state.select("key").collect()} <= {9}


SPOKEN = "ts timestamp, session_id long, seq long, event_id long, text string"


def test_utterances_end_with_silence_sentences_and_length(spark):
    say = lambda *rows: spark.createDataFrame([(START + dt.timedelta(seconds=t), 1, i, i, x) for i, (t, x) in enumerate(rows)], SPOKEN)
    fold = lambda *rows: [(round((r.closed_at - micros(0)) / 1e6, 3), r.text, r.why) for r in sorted(T.folded(say(*rows), T.utterances(), key="session_id").collect(), key=lambda r: r.closed_at)]
    assert fold((0, "ouvrons"), (1, "ouvrons Jean 3"), (9, "ouvrons Jean 3 car Dieu")) == [(2.3, "ouvrons Jean 3", "silence"), (10.3, "car Dieu", "silence")]
    assert fold((0, "Un."), (1, "Un. Deux"), (1.5, "Un. Deux. Trois")) == [(1, "Un.", "sentence"), (1.5, "Deux.", "sentence"), (2.8, "Trois", "silence")]
    assert fold((0, "a b"), (1, "a c"), (2, "a c"), (2.2, "a c ")) == [(2.3, "a c", "silence")]
    long = " ".join(["mot"] * 100)
    assert fold((0, long)) == [(0, long[:299], "length"), (1.3, long[299:].strip(), "silence")]
    assert [len(x) for _, x, _ in fold((0, "x" * 3100))] == [1500, 1500, 100]
    # opened anew: what was open begins the next one
    assert fold((0, "Première phrase assez longue. Et puis"), (1, "la suite")) == [(0, "Première phrase assez longue.", "sentence"), (2.3, "Et puis la suite", "silence")]
    assert fold((0, ""), (1, None), (700, "x")) == [(701.3, "x", "silence")]


def test_silence_fires_without_a_further_row_of_the_session(spark, tmp_path):
    rng = random.Random(9)
    rows, i = [], 0
    for session in (1, 2, 3):
        text, t = "", 0.0
        for _ in range(60):
            text += rng.choice([" mot", " Jean 3", ".", " oui", " " + "long" * 40])
            t += rng.choice([0.2, 0.9, 1.2, 1.4, 20, 700])
            rows.append((t, session, i, i, text))
            i += 1
    ends = [[(1e5 * (k + 1), 9, 10**6 + k, 10**6 + k, "")] for k in range(2)]
    stream = stream_of(spark, tmp_path, SPOKEN, [*pieces_of(rng, rows, 25, 4), *ends])
    got, late = T.replay(T.live(stream, T.utterances(), key="session_id"), f"{tmp_path}/out")
    want = T.folded(spark.read.parquet(f"{tmp_path}/in/*"), T.utterances(), key="session_id")
    assert late.count() == 0 and got.count() > 60
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


TRANSCRIPTS = "ts timestamp, session_id long, seq long, text string, is_final boolean"


def test_queue_keeps_finished_and_drops_stale_transcripts(spark, tmp_path):
    first = [(0.0, 1, i, f"t{i}", i % 4 == 3) for i in range(12)] + [(0.0, 2, 1, "only", False)]
    then = [(1.0, 1, 2, "stale", False), (1.0, 1, 5, "late final", True), (1.0, 1, 12, "new", False), (1.0, None, 1, "none", True)]
    rng = random.Random(1)
    rng.shuffle(first)
    stream = stream_of(spark, tmp_path, TRANSCRIPTS, [first, then])
    with T.stored_in(spark):
        kept = L.replay(T.queued(stream, most=5), f"{tmp_path}/out")
    assert sorted((r.session_id, r.seq, r.text) for r in kept.collect()) == sorted([(1, i, f"t{i}") for i in (3, 7, 11, 9, 10)] + [(1, 5, "late final"), (1, 12, "new"), (2, 1, "only")])


@pytest.mark.parametrize("most", [1, 3])
def test_queue_keeps_the_newest_of_all(spark, tmp_path, most):
    stream = stream_of(spark, tmp_path, TRANSCRIPTS, [[(0.0, 1, i, "x", i in (1, 2, 3)) for i in range(7)]])
    with T.stored_in(spark):
        kept = L.replay(T.queued(stream, most=most), f"{tmp_path}/out")
    assert sorted(r.seq for r in kept.collect()) == [1, 2, 3, 6]


def test_waiting_rows_of_a_trigger_are_one_entry_of_the_state():
    import json
    from types import SimpleNamespace

    import pandas as pd

    from quotelake.streaming import timed

    class State(list):
        appendList, appendValue, get = list.extend, list.append, list.copy

    handle = SimpleNamespace(getListState=lambda *_: State(), getValueState=lambda *_: None, registerTimer=lambda _: None)
    processor = timed.Ordered(timed.utterances())
    processor.init(handle)
    frames = [pd.DataFrame({"t": [5_000, 3_000], "id": [1, 2], "row": ["{}", "{}"]}), pd.DataFrame({"t": [9_000], "id": [3], "row": ["{}"]})]
    assert list(processor.handleInputRows(None, iter(frames), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))) == []
    # one for each frame that the rows came in
    assert [len(json.loads(x[0])) for x in processor.waiting] == [2, 1]
