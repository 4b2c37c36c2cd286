"""Live forms of the session operators: Structured Streaming with a small state for each session.

A stream has an event time; rows of a session are taken in its order within a micro-batch, and micro-batches in the order
in which they come. Replayed in one piece, or in pieces that are in order, each form gives the rows of its batch form.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quotelake.functions.text import bound, shown_tokens, spoken_tokens

#: Rows that come later than this behind the newest are late.
LATE = "60 seconds"
Step = Callable[[dict, object], tuple[dict, list[tuple]]]


def source(spark: SparkSession, path: str, schema: T.StructType, *, time: str = "ts", files_per_trigger: int | None = None, file_format: str = "parquet") -> DataFrame:
    """A stream of the files that arrive in a folder, with a watermark on their event time. All rows of a file come in one
    micro-batch; a bound on files keeps what a micro-batch holds small."""
    reader = spark.readStream.schema(schema).format(file_format)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, LATE)


def replay(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and reads what it wrote. Each micro-batch is written once, whatever fails."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def stateful(stream: DataFrame, key: str, order: list[str], step: Step, schema: str, *, idle: str | None = None) -> DataFrame:
    """Takes the rows of each key in order through `step`, which gives the next state (plain values) and the rows to emit.
    `idle` (a duration in milliseconds, as text) forgets a key that is silent for so long."""
    names = [c.split()[0] for c in schema.split(", ")]
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat([b for b in batches if len(b)]).sort_values(order, kind="stable")
        out: list[tuple] = []
        for row in rows.itertuples(index=False):
            now, emitted = step(now, row)
            out += emitted
        state.update((json.dumps(now),))
        if idle:
            state.setTimeoutDuration(int(idle))
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", timeout)


def _seconds(row: object) -> float:
    return pd.Timestamp(row.ts).value / 1e9


def emitted(stream: DataFrame, key: str, reference: str, seconds: float, *, only_last: bool = False) -> DataFrame:
    """Rows whose reference was not emitted within `seconds` before them; held back rows don't prolong that. The memory has
    every reference of these seconds, or the last emitted one alone (`only_last`)."""

    def step(memory: dict, row: object) -> tuple[dict, list[tuple]]:
        t, ref = _seconds(row), str(getattr(row, reference))
        if ref in memory and t - memory[ref] < seconds:
            return memory, []
        memory = {} if only_last else {r: x for r, x in memory.items() if t - x < seconds}
        return memory | {ref: t}, [(getattr(row, key), row.event_id)]

    return stateful(stream.select(key, "ts", "event_id", reference), key, ["ts", "event_id"], step, f"{key} long, event_id long")


def contradicted(stream: DataFrame, key: str, value: str, seconds: float) -> DataFrame:
    """Every row, and whether another value of its key came less than `seconds` before. The state has the last time of each
    value within these seconds."""

    def step(seen: dict, row: object) -> tuple[dict, list[tuple]]:
        t, own = _seconds(row), str(getattr(row, value))
        seen = {v: x for v, x in seen.items() if t - x < seconds}
        return seen | {own: t}, [(row.event_id, any(v != own for v in seen))]

    return stateful(stream.select(key, "ts", "event_id", value), key, ["ts", "event_id"], step, "event_id long, contradicted boolean")


def anchored(stream: DataFrame, key: str, value: str, anchor: str, seconds: float) -> DataFrame:
    """Every row with the last anchor of its key within `seconds` before it, or at it."""

    def step(last: dict, row: object) -> tuple[dict, list[tuple]]:
        t = _seconds(row)
        if getattr(row, value) == anchor:
            last = {"id": int(row.event_id), "at": t}
        return last, [(row.event_id, last["id"] if last and t - last["at"] <= seconds else None)]

    return stateful(stream.select(key, "ts", "event_id", value), key, ["ts", "event_id"], step, "event_id long, anchor_id long")


def health(stream: DataFrame, *, window: int = 10, mean: float = 10, warm_up: int = 3) -> DataFrame:
    """session_id, seq, mean_words, reliable, flipped of every segment (session_id, seq, n_words, opens) that has words. A
    segment that opens a session begins anew."""

    def step(state: dict, row: object) -> tuple[dict, list[tuple]]:
        counts, before = ([], True) if row.opens or not state else (state["counts"], state["reliable"])
        if not row.n_words > 0:
            return {"counts": counts, "reliable": before}, []
        counts = [*counts, int(row.n_words)][-window:]
        average = sum(counts) / len(counts)
        reliable = len(counts) < warm_up or average >= mean
        return {"counts": counts, "reliable": reliable}, [(row.session_id, row.seq, round(average, 4), reliable, reliable != before)]

    rows = stream.withColumns({"n_words": F.coalesce("n_words", F.lit(0)), "opens": F.coalesce("opens", F.lit(False))})
    return stateful(rows, "session_id", ["seq"], step, "session_id long, seq long, mean_words double, reliable boolean, flipped boolean")


def latest(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Of each micro-batch the newest row of each key, if it is newer than what came before: older work is dropped."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b for b in batches if len(b)]).sort_values(["ts", "event_id"])
        newest = rows.iloc[-1]
        place = [pd.Timestamp(newest.ts).value, int(newest.event_id)]
        if not state.exists or json.loads(state.get[0]) < place:
            state.update((json.dumps(place),))
            yield pd.DataFrame([(k[0], newest.event_id, newest[value])], columns=[key, "event_id", value])

    rows = stream.select(key, "ts", "event_id", value).where(F.col("ts").isNotNull() & F.col("event_id").isNotNull())
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} long, event_id long, {value} string", "state string", "append", GroupStateTimeout.NoTimeout)


#: How far ahead a spoken word is looked for, and the least letters of a word that may skip.
AHEAD, ANCHOR_LETTERS = 3, 3


def follow(position: int, words: list[str], said: list[str]) -> int:
    """The place in a text after words are said: a word of ANCHOR_LETTERS or more counts where one of the next AHEAD words
    is equal or begins alike (four letters), a shorter one only as the very next word."""
    for word in said:
        if position >= len(words):
            break
        if len(word) < ANCHOR_LETTERS:
            position += word == words[position]
            continue
        near = (i for i, w in enumerate(words[position : position + AHEAD]) if w == word or (len(w) >= 4 and len(word) >= 4 and w[:4] == word[:4]))
        if (found := next(near, None)) is not None:
            position += found + 1
    return position


def reading(stream: DataFrame) -> DataFrame:
    """session_id, seq, matched, total, moved of every row (session_id, seq, shown, said): a row with a shown text begins
    it, what is said moves on in it."""
    rows = stream.select("session_id", "seq", shown_tokens(F.col("shown")).alias("shown"), spoken_tokens(F.coalesce("said", F.lit(""))).alias("said"))

    def step(state: dict, row: object) -> tuple[dict, list[tuple]]:
        words, at = (list(row.shown), 0) if row.shown is not None else (state.get("words", []), state.get("at", 0))
        to = follow(at, words, list(row.said))
        return {"words": words, "at": to}, [(row.session_id, row.seq, to, len(words), to > at)]

    return stateful(rows, "session_id", ["seq"], step, "session_id long, seq long, matched long, total long, moved boolean")


def pauses(stream: DataFrame, key: str, gap: str) -> DataFrame:
    """Sessions of a key closed by a gap without rows, once the watermark has passed them."""
    return stream.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("started_at"), F.max("ts").alias("last_at")).drop("w")


def finished(stream: DataFrame, *, still: float = 1.3, most: int = 300) -> DataFrame:
    """session_id, seq, text of the utterances of growing transcripts (session_id, seq, ts, text, where text is all that was
    heard so far): what a sentence's end closes that other text follows, what stood unchanged for `still` seconds when the
    next row comes, and beyond `most` characters what ends at a space."""

    def step(state: dict, row: object) -> tuple[dict, list[tuple]]:
        done, before, since, t = state.get("done", 0), state.get("text", ""), state.get("since"), _seconds(row)
        out = []
        if since is not None and t - since >= still and before[done:].strip():
            out.append((row.session_id, row.seq, before[done:].strip()))
            done = len(before)
        text = row.text if row.text.startswith(before[:done]) else before[:done] + row.text
        open_text = text[done:]
        end = max(open_text.rfind(c) for c in ".!?…") + 1
        if end and not open_text[end:].strip():
            end = 0
        elif not end and len(open_text) > most:
            end = max(0, open_text.rfind(" ", 0, most))
        if end and open_text[:end].strip():
            out.append((row.session_id, row.seq, open_text[:end].strip()))
            done += end
        changed = text != before
        return {"done": done, "text": text, "since": t if changed or since is None else since}, out

    return stateful(stream, "session_id", ["ts", "seq"], step, "session_id long, seq long, text string")


def current(batch: DataFrame) -> DataFrame:
    """Of a micro-batch of transcripts (session_id, seq, text, is_final) all finished ones, and of the unfinished ones the
    newest of each session that nothing finished follows: stale ones are dropped, finished ones never."""
    w = Window.partitionBy("session_id")
    return batch.withColumn("newest", F.max("seq").over(w)).where("is_final or seq = newest").drop("newest")


def reading_positions(rows: DataFrame) -> DataFrame:
    """The batch form of `reading`: a fold over each session's rows."""
    order = F.sort_array(F.collect_list(F.struct("seq", shown_tokens(F.col("shown")).alias("shown"), spoken_tokens(F.coalesce("said", F.lit(""))).alias("said"))))
    sessions = rows.groupBy("session_id").agg(order.alias("rows"))

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("seq", T.LongType()), T.StructField("matched", T.LongType()), T.StructField("total", T.LongType())])))
    def fold(column: pd.Series) -> pd.Series:
        def one(rows: list) -> list[dict]:
            words, at, out = [], 0, []
            for r in rows:
                if r["shown"] is not None:
                    words, at = list(r["shown"]), 0
                at = follow(at, words, list(r["said"]))
                out.append({"seq": r["seq"], "matched": at, "total": len(words)})
            return out

        return column.map(one)

    return sessions.select("session_id", F.explode(bound(fold("rows"), lambda r: r)).alias("r")).select("session_id", "r.*")
