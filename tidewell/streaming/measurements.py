"""Live measurements as Structured Streaming (STR1-6)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.filters import flat_field
from ..sources.sinks import replace_partitions

#: Message types that have a route.
TYPES = ("image", "metadata", "event", "done")


def route(events: DataFrame, handlers: Mapping[str, Callable[[DataFrame, int], None]], dead_letter: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands each micro-batch's rows to their type's handler, unknown types to the dead letter (STR1). Not started."""

    def batch(df: DataFrame, epoch: int) -> None:
        df.persist()
        try:
            for kind, handle in handlers.items():
                handle(df.filter(F.col("type") == kind), epoch)
            dead_letter(df.filter(F.col("type").isNull() | ~F.col("type").isin(*handlers)), epoch)
        finally:
            df.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def shift_to_first_frame(rows: DataFrame, group: str = "fov_num", time: str = "t", value: str = "value") -> DataFrame:
    """Each row's value less that of the first frame its field was seen with, and the latest frame so far (STR2, STR5).

    State is two numbers a field: the first frame's number and value. A field's ``done`` row drops its state, nothing else
    does (``frame_states`` has the rule for newer frames, and timers); a frame before the first is late and dropped. A
    micro-batch's rows of one field are ordered in memory. Works on streams with a ``type`` column.
    """
    kind = rows.schema[group].dataType.simpleString()
    out = f"{group} {kind}, {time} int, shifted double, last_t int"

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, base, last = state.get if state.exists else (None, None, None)
        pdf = pd.concat(list(batches)).sort_values([time, value])  # a field's rows may come in several batches
        keep = []
        for kind, t, x in zip(pdf["type"].tolist(), pdf[time].tolist(), pdf[value].tolist()):
            if kind == "done":
                first = base = last = None
                continue
            if first is None:
                first, base, last = int(t), float(x), int(t)
            if t < first:
                continue
            last = max(last, int(t))
            keep.append((key[0], int(t), float(x) - base, last))
        yield pd.DataFrame(keep, columns=[group, time, "shifted", "last_t"])
        if first is None:
            if state.exists:
                state.remove()
        else:
            state.update((first, base, last))

    return rows.groupBy(group).applyInPandasWithState(run, out, "first int, base double, last int", "append", GroupStateTimeout.NoTimeout)


class FrameStates(StatefulProcessor):
    """State of one field: its first frame, and of its newest frame the number, how many rows are held and when the last
    one came. A newer frame drops what is held of the one before; a done row, or silence, drops all.

    Every call on state or timers is a message to the JVM, so a field's batch takes one read and one write: all stands in
    one variable, and a field has one timer, which is set anew only when it runs out."""

    def __init__(self, key: str, kind: str, time: str, value: str, event_time: str, keep: Sequence[str], order: Sequence[str], idle_ms: int) -> None:
        self.key, self.kind, self.time, self.value, self.event_time = key, kind, time, value, event_time
        self.keep, self.order, self.idle = list(keep), list(order), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "t int, held long, at_ms long, first_t int, base double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held_before = self.newest.get()
        newest, first = (tuple(held_before[:3]), tuple(held_before[3:])) if held_before is not None else (None, None)
        out = []
        parts = list(rows)
        pdf = (pd.concat(parts) if len(parts) > 1 else parts[0]).sort_values(self.order, kind="stable")
        ms = pdf[self.event_time].astype("datetime64[ns]").astype("int64") // 1_000_000
        for kind, t, value, at, *kept in zip(*(pdf[c].tolist() for c in (self.kind, self.time, self.value)), ms.tolist(), *(pdf[c].tolist() for c in self.keep)):
            if newest is not None and at - newest[2] > self.idle:
                first = newest = None
            if kind == "done":
                first = newest = None
                continue
            t, value = int(t), float(value)
            first = first or (t, value)
            held = 0
            if newest is None or t > newest[0]:
                newest, held = (t, 1, at), 1
            elif t == newest[0]:
                held = newest[1] + 1
                newest = (t, held, max(at, newest[2]))
            if t >= first[0]:
                out.append((key[0], *kept, t, value - first[1], newest[0], held))
        if newest is not None:
            self.newest.update((*newest, *first))
            if held_before is None:
                self.handle.registerTimer(newest[2] + self.idle + 1)
        elif held_before is not None:
            self.newest.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        yield pd.DataFrame(out, columns=[self.key, *self.keep, self.time, "shifted", "newest_t", "held"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()
        if newest is not None and newest[2] + self.idle + 1 > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(newest[2] + self.idle + 1)  # rows came since the timer was set
        else:
            self.newest.clear()
        yield pd.DataFrame(columns=[self.key, *self.keep, self.time, "shifted", "newest_t", "held"])

    def close(self) -> None:
        pass


def frame_states(rows: DataFrame, group: str = "fov_num", time: str = "t", value: str = "value", kind: str = "type", event_time: str = "event_time", keep: Sequence[str] = (), order: Sequence[str] = ("event_time",), idle_s: int = 86_400, late: str = "1 hour") -> DataFrame:
    """Each row's value less that of its field's first frame (``shifted``), the field's newest frame, and how many rows of
    the row's own frame are held by then (STR2, STR5).

    Only the newest frame is held: a newer t drops the older one, rows of which then have 0 held. A frame before the first
    is late and has no row. A ``done`` row drops a field's state; so does silence of more than ``idle_s`` of event time, by
    the next row's time or, once the watermark (``late`` behind the newest) has passed, by a timer: a field that never ends
    holds no state for ever. A micro-batch's rows of one field are put in ``order`` in memory. State is kept by RocksDB:
    see ``rocksdb_state``."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = ", ".join([f"`{c}` {fields[c]}" for c in (group, *keep)] + [f"`{time}` int, shifted double, newest_t int, held long"])
    state = FrameStates(group, kind, time, value, event_time, keep, order, idle_s * 1000)
    return rows.withWatermark(event_time, late).groupBy(group).transformWithStateInPandas(state, out, "Append", "EventTime")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """While a stream starts, its state goes to RocksDB, which state variables and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def calibrated(events: DataFrame, calibration: DataFrame) -> DataFrame:
    """A stream of pixels against the static dark and flat fields of their channel (STR3)."""
    return flat_field(events, calibration)


def idempotent_sink(rows: DataFrame, path: str, checkpoint: str, by: tuple[str, ...] = ("fov_num", "t")):
    """Replaces the partitions that each micro-batch touches: a batch run again changes nothing (STR4). Not started."""
    return rows.writeStream.foreachBatch(lambda df, _: replace_partitions(df, path, by)).option("checkpointLocation", checkpoint)


def interval_stats(events: DataFrame, interval: str = "10 minutes", late: str = "30 minutes", threshold: float = 50.0, group: str = "fov_num", value: str = "value", time: str = "event_time") -> DataFrame:
    """Per field and interval: rows, mean, largest, rows at or over the threshold (STR6).

    On a stream, rows later than ``late`` behind the newest are dropped and finished intervals are emitted; on a
    batch it is the same aggregate.
    """
    rows = events.withWatermark(time, late) if events.isStreaming else events
    grouped = rows.groupBy(F.window(time, interval).alias("w"), group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("largest"), F.sum(F.when(F.col(value) >= threshold, 1).otherwise(0)).cast("long").alias("n_over"),
    )
    return grouped.select(F.col("w.start").alias("interval_start"), group, "n", "mean", "largest", "n_over")
