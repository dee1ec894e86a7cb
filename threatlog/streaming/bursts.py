"""Throttled burst alerts as a stateful stream.

Rows are added up inside each task before they are shuffled, so a busy address sends one row
per distinct time and Arrow batch.  The state of an address is its recent counts and its peak so far.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.times import wall_clock, wall_micros
from ..operators.rules import counter_flags
from ..operators.windows import _counter_names, _with_texts, default_thresholds

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_OUTPUT = (
    "rule_no int, counter string, ip string, alert_step bigint, count bigint, at_micros bigint, start_micros bigint"
)


def stream_alert_steps(
    entries: DataFrame, thresholds=None, delay: timedelta = timedelta(minutes=10), counters=None,
    idle: timedelta = timedelta(days=1),
) -> DataFrame:
    """Streaming entries to alert steps, the same steps as :func:`threatlog.alert_steps`.

    No row is dropped for its time: an address keeps its counts from one window and ``delay`` before the
    middle of the read times it knows, so neither a line of the future nor one without a time (which all
    count at their stand-in) moves them, and those that rows came for within that span of real time,
    so that lines which lag behind have their bursts.  An address is forgotten when nothing has come from it for
    ``idle`` of real time.  An alert's ``ts`` is the first time whose window reaches the step in the rows
    known by then.  ``counters`` come on top of the built-in ones; a threshold of any other is an error.

    The session's state store has to be RocksDB (:data:`ROCKSDB`), which Spark asks for here.
    """
    spark = entries.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    thresholds = tuple(thresholds or default_thresholds())
    counters = counter_flags() | (counters or {})
    unknown = {r.counter for r in thresholds} - set(counters)
    if unknown:
        raise ValueError(f"no such counter: {sorted(unknown)}")
    counted = (
        entries.select("ip", "ts", "ts_read", F.explode(_counter_names(counters)).alias("counter"))
        .select(
            "counter", "ip", wall_micros(F.col("ts")).alias("at"), F.col("ts_read").alias("read"),
            F.lit(1).cast("bigint").alias("n"),
        )
        .mapInArrow(_add_up, "counter string, ip string, at bigint, read boolean, n bigint")
        # The watermark follows the arrival of rows, so that no row is ever late.
        .withColumn("arrived", F.current_timestamp())
        .withColumn("arrived_ms", F.unix_millis("arrived"))
        .withWatermark("arrived", "1 minute")
    )
    alerts = counted.groupBy("counter", "ip").transformWithStateInPandas(
        statefulProcessor=_Bursts(thresholds, delay, idle), outputStructType=_OUTPUT, outputMode="Append",
        timeMode="EventTime",
    )
    timed = alerts.withColumns(
        {
            "ts": wall_clock(F.col("at_micros")),
            "window_start": wall_clock(F.col("start_micros")),
        }
    )
    return _with_texts(timed, thresholds).select(
        "rule_no", "rule_id", "rule_name", "level", "level_score", "description", "evidence", "ip", "ts", "count",
        "counter", "alert_step",
    )


def _add_up(batches):
    import pyarrow as pa

    names = ["counter", "ip", "at", "read"]
    for batch in batches:
        summed = pa.Table.from_batches([batch]).group_by(names).aggregate([("n", "sum")])
        summed = summed.rename_columns(["n" if c == "n_sum" else c for c in summed.column_names])
        yield from summed.select([*names, "n"]).to_batches()


def _micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


class _Bursts(StatefulProcessor):
    """Counts and peaks of one address and counter."""

    def __init__(self, thresholds, delay, idle):
        self._rules = [
            (no, r.counter, r.threshold, r.step, _micros(r.window)) for no, r in enumerate(thresholds, start=1)
        ]
        self._delay, self._idle = _micros(delay), idle // timedelta(milliseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._recent = handle.getValueState(
            "recent", "at array<bigint>, read array<boolean>, n array<bigint>, came_ms array<bigint>"
        )
        # One peak per rule: rules of one counter may differ in their window.
        self._peaks = handle.getMapState("peaks", "rule_no int", "peak bigint")

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        counter, ip = key
        rules = [r for r in self._rules if r[1] == counter]
        if not rules:
            return
        longest = max(r[4] for r in rules)
        rows = list(rows)
        now = max(int(frame["arrived_ms"].max()) for frame in rows)
        names = ["at", "read", "n", "came_ms"]
        arrived = pd.concat(rows).rename(columns={"arrived_ms": "came_ms"})[names]
        if self._recent.exists():
            before = pd.DataFrame({name: list(kept) for name, kept in zip(names, self._recent.get())})
            arrived = pd.concat([arrived, before])
        known = arrived.groupby(["at", "read"], sort=True, as_index=False).agg({"n": "sum", "came_ms": "max"})
        total = known.groupby("at", sort=True)["n"].sum()
        at, n = total.index.to_numpy(np.int64), total.to_numpy(np.int64)
        upto = np.cumsum(n)
        out = []
        for rule_no, _, threshold, step, window in rules:
            left = np.searchsorted(at, at - window, side="left")
            inside = upto - np.where(left > 0, upto[left - 1], 0)
            before = self._peaks.getValue((rule_no,))[0] if self._peaks.containsKey((rule_no,)) else 0
            peak = int(inside.max())
            for alert_step in range(max(threshold // step, before // step + 1), peak // step + 1):
                first = int(np.argmax(inside >= alert_step * step))
                out.append((rule_no, counter, ip, alert_step, alert_step * step, int(at[first]), int(at[left[first]])))
            if peak > before:
                self._peaks.updateValue((rule_no,), (peak,))
        timed = known[known["read"]]
        if len(timed):
            rank = np.searchsorted(timed["n"].cumsum().to_numpy(), (timed["n"].sum() + 1) // 2)
            span = self._delay + longest
            oldest = int(timed["at"].iloc[rank]) - span
            known = known[~known["read"] | (known["at"] >= oldest) | (known["came_ms"] >= now - span // 1000)]
        self._recent.update(tuple(known[name].tolist() for name in names))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        self._handle.registerTimer(now + self._idle)
        if out:
            yield pd.DataFrame(
                out, columns=["rule_no", "counter", "ip", "alert_step", "count", "at_micros", "start_micros"]
            )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._recent.clear()
        for (rule_no,), _ in list(self._peaks.iterator()):
            self._peaks.removeKey((rule_no,))
        return iter([])

    def close(self) -> None:
        pass
