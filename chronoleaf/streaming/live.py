"""Live frame streams: windows, gap sessions and runs of a label with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def label_windows(frames: DataFrame, at: str = "ts", label: str = "label", size: str = "30 seconds", stride: str = "15 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts of each label in sliding windows; later frames than the watermark are dropped."""
    return frames.withWatermark(at, late).groupBy(F.window(at, size, stride).alias("w"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "label", "n")


def gap_sessions(frames: DataFrame, key: str, at: str = "ts", gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key that a gap closes."""
    return frames.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n")).select(key, "w.start", "w.end", "n")


RUN = "key string, label string, t0 double, t1 double"
STATE = "label string, t0 double, last double"


def live_runs(frames: DataFrame, timeout_ms: int = 60_000) -> DataFrame:
    """frames (key, t, label) -> a run whenever its label changes or its key goes quiet.

    State is one open run per key, whatever its length. Frames of a batch are put in order; a frame that is earlier than
    one its key had in a batch before is late and dropped, so runs never overlap or end before they start. What is late
    thus depends on where batches end; ``event_runs`` waits for late frames and doesn't.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        if state.hasTimedOut:
            label, t0, last = state.get
            state.remove()
            yield pd.DataFrame([(key[0], label, t0, last + 1.0)], columns=["key", "label", "t0", "t1"])
            return
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        label, t0 = None, 0.0
        if state.exists:
            label, t0, last = state.get
            rows = rows[rows.t >= last]
            if rows.empty:
                return
        before = rows.label.shift(fill_value=label)
        starts = rows[rows.label != before]
        edges = list(zip(starts.label, starts.t, strict=True))
        if label is None:
            (label, t0), edges = edges[0], edges[1:]
        for now, t in edges:
            done.append((key[0], label, t0, t))
            label, t0 = now, t
        state.update((label, float(t0), float(rows.t.iloc[-1])))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(done, columns=["key", "label", "t0", "t1"])

    return frames.groupBy("key").applyInPandasWithState(step, RUN, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


EVENT_RUN = "key string, label string, t0 timestamp, t1 timestamp"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def milliseconds(at: pd.Series) -> list[int]:
    return (pd.to_datetime(at).astype("datetime64[us]").astype("int64") // 1000).tolist()


class Runs(StatefulProcessor):
    """Of one key: frames that the watermark has not passed yet, and the open run of those it has.

    A frame counts once the watermark passes it, when no earlier one can come any more. A timer stands at the least
    waiting frame, and one at the end of the open run's patience, so a key costs two timers and the frames of one delay.
    """

    def __init__(self, gap_ms: int, unit_ms: int):
        self.gap, self.unit = gap_ms, unit_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, label string")
        self.open = handle.getValueState("open", "label string, t0 long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, new = timerValues.getCurrentWatermarkInMs(), []
        for b in rows:
            new += [(a, None if pd.isna(x) else x) for a, x in zip(milliseconds(b.ts), b.label, strict=True) if a > passed]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(a for a, _ in new))
        yield self.table(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, done = timerValues.getCurrentWatermarkInMs(), []
        held = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted(((a, x) for a, x in held if a <= passed), key=lambda f: (f[0], f[1] is not None, f[1] or ""))
        later = [(a, x) for a, x in held if a > passed]
        run = tuple(self.open.get()) if self.open.exists() else None
        for at, label in ready:
            if run and at - run[2] > self.gap:
                done.append((run[0], run[1], run[2] + self.unit))
                run = None
            if run and run[0] != label:
                done.append((run[0], run[1], at))
                run = None
            run = (label, run[1], at) if run else (label, at, at)
        if run and passed - run[2] > self.gap:
            done.append((run[0], run[1], run[2] + self.unit))
            run = None
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        if run:
            self.open.update(run)
            self.handle.registerTimer(run[2] + self.gap + 1)
        elif self.open.exists():
            self.open.clear()
        if later:
            self.handle.registerTimer(min(a for a, _ in later))
        yield self.table(key, [d for d in done if d[0] is not None])

    def close(self) -> None:
        pass

    @staticmethod
    def table(key, done: list) -> pd.DataFrame:
        at = lambda i: pd.to_datetime(pd.Series([d[i] for d in done], dtype="int64"), unit="ms")
        return pd.DataFrame({"key": pd.Series([key[0]] * len(done), dtype=object), "label": pd.Series([d[0] for d in done], dtype=object), "t0": at(1), "t1": at(2)})


def event_runs(frames: DataFrame, late: str = "10 minutes", gap_ms: int = 60_000, unit_ms: int = 1000) -> DataFrame:
    """frames (key, ts, label) -> key, label, t0, t1 of each run, by event time alone.

    A run ends where its key's next label starts, or a unit after its last frame if no frame follows within the gap; null
    labels end runs and are dropped. Frames that come at most ``late`` after the greatest time seen count wherever batches
    end, in whatever order they come, so the runs are the same for any batching; later ones are dropped by the watermark.
    """
    spark = frames.sparkSession
    if "RocksDB" not in (spark.conf.get(STORE, "") or ""):
        spark.conf.set(STORE, ROCKS)  # the one state store that keeps list state and timers
    x = frames.select("key", "ts", "label").withWatermark("ts", late).groupBy("key")
    return x.transformWithStateInPandas(Runs(gap_ms, unit_ms), EVENT_RUN, "append", "eventTime")
