"""Live operators with timers: rows of a key in event-time order, late rows apart, state that ends.

A `Machine` is a small state machine over the rows of one key. `live` runs it over a stream, `folded` over a table; over the
same rows that aren't late both give the same, however the rows of the stream come mixed and split into micro-batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quotelake.operators.engine import DISPUTE_SECONDS, MICROS, REPEAT_SECONDS

Rows = list[tuple]
#: Timers and states of this kind are kept in the RocksDB store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Machine:
    """What a key remembers (plain values; empty: nothing) and gives.

    step(memory, row) takes the next row, a dict; due(memory) is when (microseconds) something happens by itself, or None;
    wake(memory, at) is what happens then. Whatever isn't empty must have a due time in the end, or its state never ends.
    """

    columns: list[str]
    schema: str
    step: Callable[[dict, dict], tuple[dict, Rows]]
    due: Callable[[dict], int | None]
    wake: Callable[[dict, int], tuple[dict, Rows]]

    @property
    def names(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(", ")]

    def until(self, memory: dict, t: int | None) -> tuple[dict, Rows]:
        """What happens by itself before t (None: all of it)."""
        out: Rows = []
        while memory and (at := self.due(memory)) is not None and (t is None or at < t):
            memory, more = self.wake(memory, at)
            out += more
        return memory, out

    def take(self, memory: dict, row: dict) -> tuple[dict, Rows]:
        memory, out = self.until(memory, row["t"])
        memory, more = self.step(memory, row)
        return memory, out + more


class Ordered(StatefulProcessor):
    """Rows wait in the state until the watermark has passed them, then the machine takes them in order of (t, id). A row
    from before the watermark is late: it changes nothing and comes out as it is, marked late."""

    def __init__(self, machine: Machine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")
        self.memory = handle.getValueState("memory", "memory string")

    def _frame(self, out: Rows, late: list[dict]) -> pd.DataFrame:
        names = self.machine.names
        frame = pd.DataFrame([(*x, None) for x in out] + [(*[None] * len(names), json.dumps(r)) for r in late], columns=[*names, "late"], dtype=object)
        return frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        late: list[dict] = []
        first = None
        for frame in rows:
            held = []
            for t, i, payload in zip(frame["t"], frame["id"], frame["row"], strict=True):
                if pd.isna(t) or t < passed:
                    late.append(json.loads(payload))
                else:
                    held.append((int(t), int(i), payload))
            if held:
                # one entry for all of them: each costs a way to the state and back
                self.waiting.appendValue((json.dumps(held),))
                first = min(x[0] for x in held) if first is None else min(first, *(x[0] for x in held))
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        if late:
            yield self._frame([], late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(x) for (rows,) in self.waiting.get() for x in json.loads(rows)]
        known = self.memory.get()
        memory = json.loads(known[0]) if known else {}
        out: Rows = []
        ready = sorted((x for x in waiting if x[0] < passed), key=lambda x: x[:2])
        for *_, payload in ready:
            memory, more = self.machine.take(memory, json.loads(payload))
            out += more
        memory, more = self.machine.until(memory, passed)
        out += more
        rest = [x for x in waiting if x[0] >= passed]
        if rest:
            if ready:
                self.waiting.put([(json.dumps(rest),)])
        elif waiting:
            self.waiting.clear()
        if memory:
            self.memory.update((json.dumps(memory),))
        elif known:
            self.memory.clear()
        times = [x[0] for x in rest] + [at for at in [self.machine.due(memory) if memory else None] if at is not None]
        if times:
            self.handle.registerTimer(max(min(times), passed) // 1000 + 1)
        if out:
            yield self._frame(out, [])

    def close(self) -> None:
        pass


def _keyed(rows: DataFrame, machine: Machine, key: str, time: str, row_id: str) -> DataFrame:
    """key, t, id and the columns that the machine reads, t in microseconds."""
    # a number, not the event time itself: Spark drops late rows by the latter before an operator sees them
    t = F.unix_micros(F.col(time).cast("timestamp"))
    return rows.select(F.col(key).alias("key"), t.alias("t"), F.col(row_id).cast("long").alias("id"), F.struct(t.alias("t"), *machine.columns).alias("r"))


def live(stream: DataFrame, machine: Machine, *, key: str, time: str = "ts", row_id: str = "event_id") -> DataFrame:
    """The machine's rows over a stream with a watermark on `time`, and its late rows: those have `late`, the columns that
    the machine reads as JSON. Rows without a time are late, rows without a key or an id are left out.

    A key holds the rows that the watermark hasn't passed, and what its machine remembers; timers end both."""
    rows = _keyed(stream, machine, key, time, row_id).where("key is not null and id is not null")
    rows = rows.select("key", "t", "id", F.to_json("r", {"ignoreNullFields": "false"}).alias("row"))
    return rows.groupBy("key").transformWithStateInPandas(Ordered(machine), f"{machine.schema}, late string", "append", "eventtime")


def folded(rows: DataFrame, machine: Machine, *, key: str, time: str = "ts", row_id: str = "event_id") -> DataFrame:
    """The machine's rows over a table: each key's rows stream through a task in order of (time, id), which remembers what
    the machine does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, memory = object(), {}
        out: Rows = []

        def batch() -> pa.RecordBatch:
            nonlocal out
            made = pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=machine.names, dtype=object), schema, preserve_index=False)
            out = []
            return made

        for some in batches:
            for k, payload in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                if k != now:
                    out += machine.until(memory, None)[1]
                    now, memory = k, {}
                memory, more = machine.take(memory, json.loads(payload))
                out += more
            yield batch()
        out += machine.until(memory, None)[1]
        yield batch()

    from pyspark.sql.pandas.types import to_arrow_schema

    spark = rows.sparkSession
    schema = to_arrow_schema(spark.createDataFrame([], machine.schema).schema)
    ready = _keyed(rows, machine, key, time, row_id).where("key is not null and id is not null and t is not null")
    ready = ready.repartition("key").sortWithinPartitions("key", "t", "id")
    return ready.select("key", F.to_json("r", {"ignoreNullFields": "false"}).alias("row")).mapInArrow(run, machine.schema)


def replay(stream: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Runs a stream of `live` over what is there and reads what it wrote: the machine's rows, and the late rows. Each
    micro-batch is written once, whatever fails."""
    spark = stream.sparkSession
    with stored_in(spark):
        query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{path}/rows")
    return rows.where("late is null").drop("late"), rows.where("late is not null").select("late")


class stored_in:  # noqa: N801
    """The session's state store while a query of this module starts."""

    def __init__(self, spark: SparkSession):
        self.spark, self.name = spark, "spark.sql.streaming.stateStore.providerClass"

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.name, None)
        self.spark.conf.set(self.name, STORE)

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(self.name)
        else:
            self.spark.conf.set(self.name, self.before)


def shown_once(repeat: float = REPEAT_SECONDS, dispute: float = DISPUTE_SECONDS) -> Machine:
    """References (session_id, seq, place, book_abbr, chapter, verse_start, verse_end, in_plan, off_plan) that are shown:
    none within `repeat` seconds of when it was last shown, nor what else its utterance names. disputed: another verse of
    the chapter was shown less than `dispute` seconds before, or is planned instead; a planned one never is. A session
    remembers what these seconds had, and nothing once they are over."""
    wait, near = int(repeat * MICROS), int(dispute * MICROS)

    def step(memory: dict, row: dict) -> tuple[dict, Rows]:
        t, place = row["t"], row["place"]
        key = [row[c] for c in ("book_abbr", "chapter", "verse_start", "verse_end")]
        seen = [x for x in memory.get("seen", []) if t - x[1] < wait]
        held = memory.get("held")
        if (place > 1 and held == row["seq"]) or any(k == key for k, _ in seen):
            return {"seen": seen, "held": row["seq"] if place == 1 else held, "t": t}, []
        recent = any(k[:2] == key[:2] and k[2] != key[2] and t - x < near for k, x in seen)
        disputed = place == 1 and (recent or bool(row["off_plan"])) and not row["in_plan"]
        return {"seen": [*seen, [key, t]], "held": held, "t": t}, [(row["session_id"], row["seq"], place, disputed)]

    columns = ["session_id", "seq", "place", "book_abbr", "chapter", "verse_start", "verse_end", "in_plan", "off_plan"]
    return Machine(columns, "session_id long, seq long, place long, disputed boolean", step, lambda m: m["t"] + wait, lambda m, at: ({}, []))


#: What ends a sentence, how many characters may stay open, and how many at most where none of them is a space.
ENDS, LONGEST, REOPEN = ".!?…", 300, 1500


def utterances(still: float = 1.3, forget: float = 600) -> Machine:
    """Utterances of growing transcripts (session_id, seq, text: all that was heard since the transcript was opened), with
    what closed each: a sentence's end that other text follows, more than LONGEST characters (at a space; REOPEN without
    one), or `still` seconds in which nothing changed, whether or not another row ever comes.

    Closed text is closed by its length, so later versions of it change nothing. A text less than half as long was opened
    anew, and what was open before begins it. A session remembers its open text and that length, and nothing after `forget`
    seconds."""
    wait, gone = int(still * MICROS), int(forget * MICROS)

    def end_of(text: str) -> tuple[int, str]:
        end = max(text.rfind(c) for c in ENDS) + 1
        if end:
            return (end, "sentence") if text[end:].strip() else (0, "")
        if len(text) > LONGEST and (space := text.rfind(" ", 0, LONGEST + 1)) > 0:
            return space, "length"
        return (REOPEN, "length") if len(text) > REOPEN else (0, "")

    def close(memory: dict, n: int, at: int, why: str) -> tuple[dict, Rows]:
        text, before = memory["open"][:n], len(memory["before"])
        memory = memory | {"base": memory["base"] + max(0, n - before), "before": memory["before"][n:], "open": memory["open"][n:], "since": at}
        return memory, [(memory["session_id"], memory["seq"], at, text.strip(), why)] if text.strip() else []

    def step(memory: dict, row: dict) -> tuple[dict, Rows]:
        heard, base, before = row["text"] or "", memory.get("base", 0), memory.get("before", "")
        if 2 * len(heard) < base:
            base, before = 0, memory["open"].rstrip() + " " if memory["open"].strip() else ""
        now = before + heard[base:]
        since = memory["since"] if memory and now.strip() == memory["open"].strip() else row["t"]
        memory = {"session_id": row["session_id"], "seq": row["seq"], "base": base, "before": before, "open": now, "since": since}
        out: Rows = []
        while (end := end_of(memory["open"]))[0]:
            memory, more = close(memory, end[0], row["t"], end[1])
            out += more
        return memory, out

    def due(memory: dict) -> int:
        return memory["since"] + (wait if memory["open"].strip() else gone)

    def wake(memory: dict, at: int) -> tuple[dict, Rows]:
        return close(memory, len(memory["open"]), at, "silence") if memory["open"].strip() else ({}, [])

    return Machine(["session_id", "seq", "text"], "session_id long, seq long, closed_at long, text string, why string", step, due, wake)


class Queue(StatefulProcessor):
    """Transcripts of a session on their way to a consumer that takes `most` of them a trigger."""

    def __init__(self, most: int, forget_ms: int):
        self.most, self.forget = most, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.newest = handle, handle.getValueState("newest", "seq long, ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, ms = self.newest.get() if self.newest.exists() else (None, timerValues.getCurrentWatermarkInMs())
        found = pd.concat([f for f in rows if len(f)]).sort_values("seq", kind="stable")
        fresh = found if seq is None else found[found["is_final"] | (found["seq"] > seq)]
        final = fresh[fresh["is_final"]]
        newest_is_open = bool(len(fresh)) and not fresh["is_final"].iloc[-1]
        room = max(self.most - len(final), int(newest_is_open))
        top, last = int(found["seq"].max()), max(ms, int(found["ms"].max()))
        self.newest.update((top if seq is None else max(top, seq), last))
        self.handle.registerTimer(last + self.forget)
        kept = pd.concat([final, fresh[~fresh["is_final"]].tail(room)]).sort_values("seq", kind="stable")
        yield kept[["session_id", "seq", "text", "is_final"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.newest.exists() and self.newest.get()[1] + self.forget <= timerValues.getCurrentWatermarkInMs():
            self.newest.clear()
        return iter([])

    def close(self) -> None:
        pass


def queued(stream: DataFrame, *, most: int = 64, forget: float = 3600) -> DataFrame:
    """session_id, seq, text, is_final of transcripts (with ts) as a consumer gets them. Every finished one is kept. An
    unfinished one is stale, and dropped, if a newer row of its session was handed on before; and where a trigger has more
    than `most` rows of a session, the oldest unfinished ones are dropped as far as need be, all but one that is the newest
    of all. What a session remembers is two numbers, until the watermark is `forget` seconds past its last row."""
    ms = F.coalesce(F.unix_millis(F.col("ts")), F.lit(0)).alias("ms")
    rows = stream.where("session_id is not null and seq is not null").select("session_id", "seq", "text", F.coalesce("is_final", F.lit(False)).alias("is_final"), ms)
    schema = "session_id long, seq long, text string, is_final boolean"
    return rows.groupBy("session_id").transformWithStateInPandas(Queue(most, int(forget * 1000)), schema, "append", "eventtime")
