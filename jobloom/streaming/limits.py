"""Event streams: duplicates dropped within the watermark, counts by window, and limits with state.

The limits keep their state in RocksDB, as Spark's processors with state need; each sets that for its session.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each key in tumbling windows; an event_id counts once within the watermark."""
    once = events.withWatermark(ts, late).dropDuplicatesWithinWatermark(["event_id"])
    counts = once.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), key, "n")


def _transformed(events: DataFrame, key: str, processor: StatefulProcessor, schema: str, time_mode: str) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return events.groupBy(key).transformWithStateInPandas(processor, schema, "append", time_mode)


def _rows(batches: Iterator[pd.DataFrame]) -> list[tuple[int, int, int]]:
    """(at, tie, asked) of all rows, in order of time."""
    return sorted(x for part in batches for x in zip(part["at"].tolist(), part["tie"].tolist(), part["asked"].tolist(), strict=True))


class _AtOnce(StatefulProcessor):
    """Hits of a key, each event judged as it comes; what is older than the window is dropped once, and all of it by its TTL."""

    def __init__(self, key: str, tie: str, most: int, seconds: int):
        self.names, self.most, self.seconds = (key, tie), most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hits = handle.getListState("hits", "at long", ttlDurationMs=2000 * self.seconds)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        held = deque(sorted(at for (at,) in self.hits.get()))
        out = []
        for at, tie, _ in _rows(rows):
            while held and held[0] <= at - self.seconds * 1_000_000:
                held.popleft()
            held.append(at)
            out.append((key[0], tie, len(held) <= self.most))
        self.hits.put([(at,) for at in held])
        yield pd.DataFrame(out, columns=[*self.names, "allowed"])

    def close(self) -> None:
        pass


class _InOrder(StatefulProcessor):
    """Holds events until the watermark has passed them, and hands them on in order of time; an event-time timer wakes it.

    State ends by a timer too, a window after the last event, as a TTL is for processing time alone.
    """

    columns: list[str]

    def __init__(self, key: str, tie: str, most: int, seconds: int):
        self.names, self.most, self.span = (key, tie), most, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, tie long, asked long")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        new = _rows(rows)
        self.waiting.appendList(new)
        self.handle.registerTimer(new[0][0] // 1000)
        yield pd.DataFrame([], columns=[*self.names, *self.columns])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.waiting.get())
        ready = [x for x in held if x[0] <= passed]
        out = []
        if ready:
            left = held[len(ready) :]
            self.waiting.put(left) if left else self.waiting.clear()
            if left:
                self.handle.registerTimer(left[0][0] // 1000)
            out = [(key[0], tie, *found) for tie, *found in self.judged(ready)]
            self.last.update((ready[-1][0],))
            self.handle.registerTimer((ready[-1][0] + self.span) // 1000 + 1)
        elif self.last.exists() and self.last.get()[0] + self.span < passed:
            self.forget()
            self.last.clear()
        yield pd.DataFrame(out, columns=[*self.names, *self.columns])

    def judged(self, ready: list[tuple[int, int, int]]) -> Iterator[tuple]:
        """tie and results of events in order."""
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Sliding(_InOrder):
    columns = ["hits", "allowed", "retry_after"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.hits = handle.getListState("hits", "at long")

    def judged(self, ready):
        held = deque(at for (at,) in self.hits.get())
        k = 0
        while k < len(ready):
            at, same = ready[k][0], k
            while same < len(ready) and ready[same][0] == at:
                same += 1
            while held and held[0] <= at - self.span:
                held.popleft()
            held.extend([at] * (same - k))  # events of one time see each other
            wait = -((at - held[0] - self.span) // 1_000_000) if len(held) > self.most else None
            for _, tie, _ in ready[k:same]:
                yield tie, len(held), len(held) <= self.most, wait
            k = same
        self.hits.put([(at,) for at in held])

    def forget(self) -> None:
        self.hits.clear()


class _Budget(_InOrder):
    columns = ["granted"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.window = handle.getValueState("window", "start long, used long")

    def judged(self, ready):
        start, used = self.window.get() if self.window.exists() else (None, 0)
        for at, tie, asked in ready:
            if start is not None and at - start >= self.span:
                start, used = None, 0
            granted = max(0, min(asked, self.most - used))
            if granted and start is None:
                start = at
            used += granted
            yield tie, granted
        self.window.update((start, used)) if start is not None else self.window.clear()

    def forget(self) -> None:
        self.window.clear()


def _prepared(events: DataFrame, key: str, ts: str, tie: str, asked: str | None) -> DataFrame:
    rows = F.coalesce(F.col(asked).cast("long"), F.lit(0)) if asked else F.lit(0).cast("long")
    return events.where(F.col(ts).isNotNull()).select(F.col(key).cast("long").alias(key), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(tie).cast("long").alias("tie"), rows.alias("asked"), ts)


def sliding_limit_stream(events: DataFrame, most: int, seconds: int, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """key, event_id, allowed of each event as it comes, in order of time within a batch; the state of a key is its hits of the last `seconds`."""
    schema = f"{key} long, {tie} long, allowed boolean"
    return _transformed(_prepared(events, key, ts, tie, None).drop(ts), key, _AtOnce(key, tie, most, seconds), schema, "ProcessingTime")


def ordered_sliding_limit(events: DataFrame, most: int, seconds: int, key: str = "user_id", ts: str = "ts", tie: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """key, event_id, hits, allowed, retry_after of each event: rollups.sliding_limit() of a stream, however it is cut into batches.

    An event is judged once the watermark, `late` behind the newest event, has passed it. Defined cases: an event that
    comes when the watermark has passed it is dropped and hits nothing; one without a time is dropped; a null key is a key.
    """
    schema = f"{key} long, {tie} long, hits long, allowed boolean, retry_after long"
    timed = _prepared(events.withWatermark(ts, late), key, ts, tie, None)
    return _transformed(timed, key, _Sliding(key, tie, most, seconds), schema, "EventTime")


def ordered_budget(events: DataFrame, rows: str, most: int, seconds: int, key: str = "user_id", ts: str = "ts", tie: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """key, event_id, granted of each event: rollups.budget_granted() of a stream, however it is cut into batches; cases as of ordered_sliding_limit()."""
    timed = _prepared(events.withWatermark(ts, late), key, ts, tie, rows)
    return _transformed(timed, key, _Budget(key, tie, most, seconds), f"{key} long, {tie} long, granted long", "EventTime")
