"""Sessions and profiles as streams with state by key: compression as turns come, expiry by timers, ordered folds.

Stores of state are RocksDB's, which keep what doesn't fit memory on disk and write changes only
(``state_store`` sets it). A processor's state is bounded by its key: the turns after a session's cursor, the
distinct values of a profile. A batch that is run again after a failure starts from the state before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import AFTER, CHUNK, LISTS, RETAIN

CHUNKS = "session string, event string, chunk int, from_turn bigint, to_turn bigint, n_turns bigint, turns array<struct<turn:bigint,request:string,answer:string>>"


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Maintain(StatefulProcessor):
    """Holds the turns from the cursor on. Turn numbers follow each other from 0; one that was there is a replay, one that is ahead waits."""

    def __init__(self, after: int, chunk: int, retain: int, idle_ms: int):
        self.after, self.chunk, self.retain, self.idle_ms = after, chunk, retain, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "next bigint, chunk int, timer bigint")
        self.held = handle.getMapState("held", "turn bigint", "request string, answer string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        next_, chunk, timer = self.counts.get() if self.counts.exists() else (0, 0, -1)
        latest = -1
        for part in rows:
            latest = max(latest, int(part["at"].max().timestamp() * 1000))
            for turn, request, answer in zip(part["turn"].tolist(), part["request"].tolist(), part["answer"].tolist()):
                if turn >= next_:
                    self.held.updateValue((int(turn),), (request, answer))
        while self.held.containsKey((next_,)):
            next_ += 1
        out = []
        while next_ >= self.after and (chunk + 1) * self.chunk + self.retain <= next_:
            turns = range(chunk * self.chunk, (chunk + 1) * self.chunk)
            out.append((key[0], "compressed", chunk, turns[0], turns[-1], len(turns), [dict(zip(("turn", "request", "answer"), (t, *self.held.getValue((t,))))) for t in turns]))
            for t in turns:
                self.held.removeKey((t,))
            chunk += 1
        if latest >= 0:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = max(latest, timer - self.idle_ms) + self.idle_ms
            self.handle.registerTimer(timer)
        self.counts.update((next_, chunk, timer))
        yield _chunks(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        """An idle session leaves its state; its turns after the cursor come out once."""
        next_, chunk, _ = self.counts.get()
        left = sorted((k[0], *v) for k, v in self.held.iterator())
        self.held.clear()
        self.counts.clear()
        yield _chunks([(key[0], "expired", chunk, left[0][0] if left else next_, left[-1][0] if left else next_ - 1, len(left), [dict(zip(("turn", "request", "answer"), x)) for x in left])])

    def close(self) -> None:
        pass


def _chunks(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["session", "event", "chunk", "from_turn", "to_turn", "n_turns", "turns"])


def maintained(turns: DataFrame, after: int = AFTER, chunk: int = CHUNK, retain: int = RETAIN, idle: str = "30 days", late: str = "1 day") -> DataFrame:
    """Stream of the chunks that sessions compress (as ``operators.sessions.chunks``) and of sessions that expire.

    Takes session, turn (from 0), request, answer and at. A session without a turn for ``idle`` of event time expires; turns later than ``late`` after the latest are dropped by the watermark.
    """
    state_store(turns.sparkSession)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    own = turns.select(F.col("session").cast("string").alias("session"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("request", F.lit("")).alias("request"), F.coalesce("answer", F.lit("")).alias("answer"), F.col("at").cast("timestamp").alias("at"))
    own = own.filter("session IS NOT NULL AND turn >= 0 AND at IS NOT NULL").withWatermark("at", late)
    return own.groupBy("session").transformWithStateInPandas(_Maintain(after, chunk, retain, idle_ms), CHUNKS, "Update", "EventTime")


PROFILES = "user string, name string, " + ", ".join(f"{f} array<string>" for f in LISTS) + ", preferences map<string,string>, attributes map<string,string>"


class _Fold(StatefulProcessor):
    """Of each list value its first place, of each other key its last value and place: what rows of any order and any repeats fold to."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.listed = handle.getMapState("listed", "field string, value string", "at string")
        self.last = handle.getMapState("last", "field string, key string", "at string, value string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for part in rows:
            for field, name, value, at in zip(*(part[c].tolist() for c in ("field", "key", "value", "at"))):
                if field in LISTS:
                    if not self.listed.containsKey((field, value)) or at < self.listed.getValue((field, value))[0]:
                        self.listed.updateValue((field, value), (at,))
                elif not self.last.containsKey((field, name)) or at >= self.last.getValue((field, name))[0]:
                    self.last.updateValue((field, name), (at, value))
        lists: dict[str, list] = {f: [] for f in LISTS}
        for (field, value), (at,) in self.listed.iterator():
            lists[field].append((at, value))
        found = [(field, name, value) for (field, name), (_, value) in self.last.iterator()]
        row = {"user": key[0], "name": next((v for f, _, v in found if f == "name"), None)}
        row |= {f: [v for _, v in sorted(x)] for f, x in lists.items()}
        row |= {"preferences": {n: v for f, n, v in sorted(found) if f == "preferences"}, "attributes": {n: v for f, n, v in sorted(found) if f not in ("name", "preferences")}}
        yield pd.DataFrame([row])

    def close(self) -> None:
        pass


def folded(updates: DataFrame, at: str) -> DataFrame:
    """Stream of profiles after each batch, as ``operators.sessions.folded_profiles`` gives them for all updates so far; ``at`` is a string that sorts as updates came."""
    state_store(updates.sparkSession)
    own = updates.filter("user IS NOT NULL AND field IS NOT NULL AND value IS NOT NULL AND trim(value) <> ''")
    key = F.when(F.col("field").isin(*LISTS), F.lit("")).when(F.col("field") == "preferences", F.col("key")).otherwise(F.col("field"))
    own = own.select(F.col("user").cast("string").alias("user"), "field", key.alias("key"), F.trim("value").alias("value"), F.col(at).cast("string").alias("at")).filter("key IS NOT NULL")
    return own.groupBy("user").transformWithStateInPandas(_Fold(), PROFILES, "Update", "None")
