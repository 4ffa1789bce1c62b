"""Change feeds: debounce, quiescence, application, counters and rate limits, as batch expressions and as streams.

Debounce and rate limit are greedy (an event counts from the last *accepted* one), so they keep keyed state.  Their batch forms deal
events by key, sort them and fold them as they stream past: what is held is one key's state and never its events.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.functions import rules


def in_order(events: DataFrame, *, key: str, time: str, ident: str, fresh: Callable[[], Callable[[int], bool]]) -> DataFrame:
    """``events`` with ``accepted``: ``fresh()`` gives a key's function of the next event's time in microseconds."""
    at = "fold_micros"
    rows = events.withColumn(at, F.unix_micros(F.col(time).cast("timestamp"))).repartition(key).sortWithinPartitions(key, at, ident)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)

    def run(batches):
        last, decide = object(), None
        for batch in batches:
            out = []
            for k, t in zip(batch.column(key).to_pylist(), batch.column(at).to_pylist()):
                if k != last:
                    last, decide = k, fresh()
                out.append(decide(t))
            names = [n for n in batch.schema.names if n != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.bool_())], names=[*names, "accepted"])

    return rows.mapInArrow(run, f"{fields}, accepted boolean")


def _after_gap(gap: int) -> Callable[[], Callable[[int], bool]]:
    def fresh():
        last: list[int] = []

        def decide(t: int) -> bool:
            take = not last or t - last[0] >= gap
            if take:
                last[:] = [t]
            return take

        return decide

    return fresh


def _below_rate(most: int, span: int) -> Callable[[], Callable[[int], bool]]:
    def fresh():
        times: deque[int] = deque()

        def decide(t: int) -> bool:
            while times and times[0] <= t - span:
                times.popleft()
            if len(times) < most:
                times.append(t)
                return True
            return False

        return decide

    return fresh


def debounced(events: DataFrame, *, key: str, time: str, ident: str, seconds: float = rules.DEBOUNCE_SECONDS) -> DataFrame:
    """Events at least ``seconds`` after the last accepted one of their key, ties by ``ident``."""
    return in_order(events, key=key, time=time, ident=ident, fresh=_after_gap(int(seconds * 1_000_000))).where("accepted").drop("accepted")


def rate_limited(events: DataFrame, *, key: str, time: str, ident: str, most: int, seconds: int = rules.RATE_SECONDS) -> DataFrame:
    """``events`` with ``accepted``: fewer than ``most`` accepted ones of the key within the last ``seconds``, rejected ones not counting."""
    return in_order(events, key=key, time=time, ident=ident, fresh=_below_rate(most, seconds * 1_000_000))


def rate_limited_stream(events: DataFrame, *, key: str, time: str, most: int, seconds: int = rules.RATE_SECONDS, late: str = "1 minute") -> DataFrame:
    """The stateful form of ``rate_limited`` (``time`` a timestamp): the accepted times of each key within the window, dropped when it has passed."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    span = seconds * 1_000_000

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(batches)).sort_values(time)
        keep = []
        for t in rows[time].astype("datetime64[us]").astype("int64"):
            while times and times[0] <= t - span:
                times.popleft()
            keep.append(len(times) < most)
            if keep[-1]:
                times.append(int(t))
        state.update((list(times),))
        state.setTimeoutTimestamp(max((times[-1] if times else 0) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(accepted=keep)

    return events.withWatermark(time, late).groupBy(key).applyInPandasWithState(run, f"{kinds}, accepted boolean", "times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def debounced_stream(events: DataFrame, *, key: str, time: str, seconds: float = rules.DEBOUNCE_SECONDS, late: str = "1 minute", forget: str = "1 hour") -> DataFrame:
    """The stateful form of ``debounced`` (``time`` a timestamp): the last accepted time of each key.

    A key's state goes when event time has passed its last accepted event by ``forget``; events later than ``late`` are left out.
    """
    gap, millis = pd.Timedelta(seconds=seconds), int(pd.Timedelta(forget).total_seconds() * 1000)
    names, kinds = events.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = pd.concat(list(batches)).sort_values(time)
        keep = []
        for t in rows[time]:
            keep.append(last is None or t - last >= gap)
            last = t if keep[-1] else last
        micros = int((last - pd.Timestamp(0)) / pd.Timedelta(microseconds=1))
        state.update((micros,))
        state.setTimeoutTimestamp(max(micros // 1000 + millis, state.getCurrentWatermarkMs() + 1))
        yield rows[keep][names]

    return events.withWatermark(time, late).groupBy(key).applyInPandasWithState(run, kinds, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def settled(events: DataFrame, *, key: str, time: str, gap: str = f"{rules.SETTLE_SECONDS} seconds") -> DataFrame:
    """(key, started, settled_at, changes): bursts of events that end with ``gap`` of silence; the same for a stream with a watermark."""
    out = events.groupBy(key, F.session_window(F.col(time).cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("changes"))
    return out.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("settled_at"), "changes")


def gave_up(events: DataFrame, *, key: str, time: str, gap: str = f"{rules.SETTLE_SECONDS} seconds", most: float = 30.0) -> DataFrame:
    """``settled`` bursts with ``ready``: false for those that kept changing for ``most`` seconds, which a watcher gives up on."""
    out = settled(events, key=key, time=time, gap=gap)
    return out.withColumn("ready", (F.unix_micros("settled_at") - F.unix_micros("started")) <= int(most * 1_000_000))


def applied(view: DataFrame, events: DataFrame, *, key: str = "path") -> DataFrame:
    """A current view (key, value) after events (key, action, dest, value, seq): the last one of each key counts; a move is a delete and an upsert."""
    plain = events.select(key, "action", "value", "seq")
    gone = events.where("action = 'move'").select(key, F.lit("delete").alias("action"), F.lit(None).cast(dict(events.dtypes)["value"]).alias("value"), "seq")
    come = events.where("action = 'move'").select(F.col("dest").alias(key), F.lit("upsert").alias("action"), "value", "seq")
    last = plain.where("action <> 'move'").unionByName(gone).unionByName(come).groupBy(key).agg(F.max_by(F.struct("action", "value"), "seq").alias("e"))
    stay = view.join(last.select(key), key, "left_anti")
    return stay.unionByName(last.where("e.action = 'upsert'").select(key, F.col("e.value").alias("value")))


def apply_stream(events: DataFrame, read_view: Callable[[], DataFrame], write_view: Callable[[DataFrame, int], None], *, key: str = "path"):
    """A writer that applies each micro-batch to the view; ``write_view`` must publish by batch id, so a repeated batch changes nothing."""
    return events.writeStream.foreachBatch(lambda batch, n: write_view(applied(read_view(), batch, key=key), n))


def counters(events: DataFrame, *, status: str, key: str | None = None) -> DataFrame:
    """Events by status (and key): a running aggregate for a stream in update mode."""
    return events.groupBy(*([key] if key else []), status).agg(F.count("*").alias("n"))


def windowed(events: DataFrame, *, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts by tumbling windows; events later than ``late`` are left out of a stream."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), *by, "n")


def in_window(events: DataFrame, *, key: str, time: str, seconds: int = rules.RATE_SECONDS) -> DataFrame:
    """``events`` with ``recent``: events of the key within the last ``seconds``, itself included."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    return events.withColumn("recent", F.count("*").over(W.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)))


def listing_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(source_path, action) between two listings (source_path, checksum): what a feed of a folder without events would say."""
    a, b = before.select("source_path", F.col("checksum").alias("was")), now.select("source_path", F.col("checksum").alias("is"))
    both = a.join(b, "source_path", "full_outer")
    action = F.when(F.col("was").isNull() | (F.col("was") != F.col("is")), "upsert").when(F.col("is").isNull(), "delete")
    return both.select("source_path", action.alias("action")).where("action is not null")
