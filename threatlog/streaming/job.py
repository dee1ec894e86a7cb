"""The live job: alerts, their log, the notifier and the lines around them.

Each micro-batch goes through the batch operators together with a little carried state,
which is written as tables next to the checkpoint, one folder per epoch:

* ``ticks``: counts no older than one window and ``delay`` before the middle of the times known, those that lines
  came for within that span of real time, whatever their times, and those of lines without a readable time,
  which all count at ``as_of``;
* ``peaks``: the highest step of every address that has alerted;
* ``tail``: the last fourteen lines of every source, in runs (:mod:`threatlog.streaming.runs`): an epoch writes those
  of the sources that sent lines, and reads those of the same sources.

Intermediate tables are replaced by the next batch, state older than one epoch is removed.

No line is dropped for its time: a late one counts among what is still known.  As the middle of
the times moves the state on, not the newest, a line dated in the future moves nothing.  A source that
lags behind the others, by hours or days, has its bursts too: its counts stay for as long as its lines come.

A batch that is run again after a failure reads the state of the epoch before it and
overwrites its own output, so every alert and line is written once.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce
from time import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed_values import CONTEXT_LINES
from ..operators.context import context_lines
from ..operators.enrich import alert_text, notable
from ..operators.parse import DROPPED, parse_logs
from ..functions.times import wall_micros
from ..operators.rules import counter_flags, default_rules, rule_hits
from ..operators.windows import alert_rows, alert_steps, default_thresholds, numbered_within, ticks
from ..session import create_marker, folder_names, no_rows, remove_folder, staged
from .layouts import PrefixLayout
from .runs import merged_into, remove_old_runs, run_path, runs_of

ALERT_COLUMNS = (
    "rule_id", "rule_name", "level", "level_score", "description", "ip", "user", "ts", "evidence", "count",
    "source", "line_no",
)


_ALERTS = (
    "rule_id string, rule_name string, level string, level_score int, description string, ip string, user string, "
    "ts timestamp_ntz, evidence string, count bigint, source string, line_no bigint"
)
_TAIL = "source string, line_no bigint, line string, written boolean, epoch bigint"


def _latest(tails: DataFrame) -> DataFrame:
    """Of each source the lines that its last epoch left."""
    last = tails.groupBy("source").agg(F.max("epoch").alias("epoch"))
    return tails.join(last, ["source", "epoch"], "left_semi")


def start_alerts(
    lines: DataFrame,
    as_of: datetime,
    out: str,
    checkpoint: str,
    rules=None,
    thresholds=None,
    delay: timedelta = timedelta(minutes=10),
    on_alert: Callable[[DataFrame, int], None] | None = None,
    trigger: dict | None = None,
    counters: dict | None = None,
    layout_lines: int | None = None,
    **parse_options,
):
    """Start the live job on streaming ``line, source, seq``; returns the streaming query.

    Below ``out`` it writes ``alerts`` (Parquet), ``alert_log`` and ``context`` (text), one
    ``epoch=N`` folder per micro-batch, and when all three are there, a marker in ``commits``;
    :func:`committed_alerts` and :func:`committed_lines` read marked epochs alone.  ``on_alert(frame, epoch)`` gets the HIGH and CRITICAL
    alerts of a batch; how they are sent is the caller's business.  Within a batch the lines of a
    source are in order of ``seq``, or as read where it is NULL.  ``counters`` (name to condition
    over entries) come on top of the built-in ones; a threshold of any other is an error.  With ``layout_lines``
    the layout is found on so many first lines, which wait until all of them came (:class:`PrefixLayout`).
    """
    job = _LiveJob(as_of, out, checkpoint, rules, thresholds, delay, on_alert, counters, parse_options, layout_lines)
    return (
        lines.writeStream.foreachBatch(job.run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _committed(spark: SparkSession, out: str, name: str) -> list[str]:
    return [f"{out}/{name}/epoch={int(epoch)}" for epoch in sorted(folder_names(spark, f"{out}/commits"))]


def committed_alerts(spark: SparkSession, out: str) -> DataFrame:
    """The alerts of all epochs whose every output is written; one that broke off between two sinks shows in none."""
    folders = _committed(spark, out, "alerts")
    return spark.read.schema(_ALERTS).parquet(*folders) if folders else no_rows(spark, _ALERTS)


def committed_lines(spark: SparkSession, out: str, name: str = "alert_log") -> DataFrame:
    """The lines of ``alert_log`` or ``context`` of the same epochs: ``line``."""
    folders = _committed(spark, out, name)
    return spark.read.text(folders).toDF("line") if folders else no_rows(spark, "line string")


class _LiveJob:
    def __init__(
        self, as_of, out, checkpoint, rules, thresholds, delay, on_alert, counters, parse_options, layout_lines=None
    ):
        self.as_of, self.out, self.state = as_of, out, f"{checkpoint}/carried"
        self.rules, self.thresholds = rules, tuple(thresholds or default_thresholds())
        self.delay, self.on_alert, self.parse_options = delay, on_alert, parse_options
        self.prefix = None
        if layout_lines is not None:
            strict = parse_options.get("strict_compat", False)
            self.prefix = PrefixLayout(f"{self.state}/layout", layout_lines, strict)
        self.counters = counter_flags() | (counters or {})
        unknown = {r.counter for r in self.thresholds} - set(self.counters)
        if unknown:
            raise ValueError(f"no such counter: {sorted(unknown)}")

    def run(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rules = self.rules or default_rules()
        options = self.parse_options
        if self.prefix is not None:
            batch, layout = self.prefix.settle(batch, epoch)
            options = options | {"layout": layout}
        tail = self._tail(batch, epoch)
        numbered = self._staged(self._number(batch, tail), "numbered")
        everything = parse_logs(
            numbered.select("line", "source", F.col("line_no").alias("seq")),
            as_of=self.as_of, keep_dropped=True, **options,
        )
        entries = self._staged(everything.where(F.col("format") != DROPPED), "entries")

        row_alerts = rule_hits(entries, rules).withColumn("count", F.lit(1).cast("bigint"))
        burst_alerts = self._bursts(spark, entries, epoch)
        alerts = staged(
            row_alerts.withColumnRenamed("seq", "line_no").select(*ALERT_COLUMNS)
            .unionByName(burst_alerts.select(*ALERT_COLUMNS)),
            path=f"{self.out}/alerts/epoch={epoch}",
        )

        ordered = alerts.orderBy("source", "line_no", "rule_id")
        ordered.select(alert_text().alias("line")).write.mode("overwrite").text(f"{self.out}/alert_log/epoch={epoch}")
        self._context(numbered, tail, alerts, epoch)
        create_marker(spark, f"{self.out}/commits/{epoch:012d}")
        if self.on_alert is not None:
            self.on_alert(notable(alerts), epoch)
        for name in ("ticks", "peaks"):
            remove_folder(spark, f"{self.state}/{name}/epoch={epoch - 2}")
        remove_old_runs(spark, f"{self.state}/tail", epoch)

    def _tail(self, batch, epoch):
        """The last lines of the sources of a batch."""
        sources = batch.select(F.coalesce("source", F.lit("")).alias("source")).distinct()
        known = self._tail_runs(batch.sparkSession, runs_of(epoch)).join(sources, "source", "left_semi")
        return self._staged(_latest(known), "tail")

    def _tail_runs(self, spark, runs):
        found = no_rows(spark, _TAIL)
        for run in runs:
            found = found.unionByName(spark.read.schema(_TAIL).parquet(run_path(f"{self.state}/tail", run)))
        return found

    def _number(self, batch, tail):
        """Lines numbered on from where their source was."""
        last = tail.groupBy("source").agg(F.max("line_no").alias("_last"))
        seq = F.coalesce("seq", F.monotonically_increasing_id()).alias("seq")
        return (
            numbered_within(batch.select("line", F.coalesce("source", F.lit("")).alias("source"), seq), ["source"], "_n")
            .join(last, "source", "left")
            .withColumn("line_no", F.col("_n") + F.coalesce("_last", F.lit(0)))
            .select("source", "line_no", "line")
        )

    def _bursts(self, spark, entries, epoch):
        schema = "counter string, ip string, ts timestamp_ntz, n bigint, first_seq bigint, came_ms bigint"
        now_ms = int(time() * 1000)
        before = self._carried(spark, "ticks", epoch, schema)
        known = self._carried(spark, "peaks", epoch, "counter string, ip string, window bigint, peak bigint")
        fresh = ticks(entries, self.counters).withColumn("came_ms", F.lit(now_ms).cast("bigint"))
        recent = self._staged(
            before.unionByName(fresh).groupBy("counter", "ip", "ts")
            .agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"), F.max("came_ms").alias("came_ms")),
            "recent",
        )
        windows = list(dict.fromkeys(r.window for r in self.thresholds))
        found = []
        for window in windows:
            seconds = F.lit(int(window.total_seconds()))
            rules = [r for r in self.thresholds if r.window == window]
            found.append(alert_steps(recent, rules).withColumn("window", seconds.cast("bigint")))
        steps = self._staged(reduce(DataFrame.unionByName, found), "steps")
        # The highest step that a peak reaches tells as much as the peak: no step lies between them.
        top = steps.groupBy("counter", "ip", "window").agg(F.max("count").alias("peak"))
        # Steps up to the peak so far have alerted before.
        new = steps.join(known, ["counter", "ip", "window"], "left").where(
            F.col("count") > F.coalesce("peak", F.lit(0))
        )
        # A time may have begun in an earlier batch; its rows there come first.
        here = before.select("counter", "ip", "ts", F.col("n").alias("_earlier"))
        new = (
            new.join(here, ["counter", "ip", "ts"], "left")
            .withColumn("nth", F.greatest(F.col("nth") - F.coalesce("_earlier", F.lit(0)), F.lit(1)))
            .drop("_earlier", "peak")
        )

        merged = known.unionByName(top).groupBy("counter", "ip", "window").agg(F.max("peak").alias("peak"))
        self._carry(merged, "peaks", epoch)
        stand_in = F.col("ts") == F.lit(self.as_of).cast("timestamp_ntz")
        read = recent.where(~stand_in).agg(F.percentile(wall_micros(F.col("ts")), 0.5, F.col("n")))
        middle = read.first()[0]
        if middle is None:
            kept = recent
        else:
            span = (self.delay + max(windows)) // timedelta(microseconds=1)
            near = wall_micros(F.col("ts")) >= middle - span
            kept = recent.where(stand_in | near | (F.col("came_ms") >= now_ms - span // 1000))
        self._carry(kept, "ticks", epoch)
        return alert_rows(entries, new, self.counters, folder=f"{self.state}/work/alerting").withColumns(
            {"user": F.lit(None).cast("string"), "line_no": F.col("seq")}
        )

    def _context(self, numbered, tail, alerts, epoch):
        near = tail.drop("epoch").unionByName(numbered.withColumn("written", F.lit(False)))
        placed = alerts.where(F.col("line_no").isNotNull())
        wanted = context_lines(near, placed.select("source", "line_no"), CONTEXT_LINES)
        wanted = self._staged(wanted.where(~F.col("written")), "context")
        wanted.orderBy("source", "line_no").select("line").write.mode("overwrite").text(
            f"{self.out}/context/epoch={epoch}"
        )
        last = W.partitionBy("source").orderBy(F.desc("line_no"))
        kept = (
            near.withColumn("_back", F.row_number().over(last)).where(F.col("_back") < CONTEXT_LINES).drop("_back")
        )
        now = wanted.select("source", "line_no", F.lit(True).alias("_now"))
        kept = kept.join(now, ["source", "line_no"], "left").withColumn(
            "written", F.col("written") | F.coalesce("_now", F.lit(False))
        )
        kept = kept.select("source", "line_no", "line", "written", F.lit(epoch).cast("bigint").alias("epoch"))
        run, older = merged_into(epoch)
        if older:
            kept = _latest(kept.unionByName(self._tail_runs(kept.sparkSession, older)))
        kept.write.mode("overwrite").parquet(run_path(f"{self.state}/tail", run))

    def _staged(self, df, name):
        return staged(df, path=f"{self.state}/work/{name}")

    def _carried(self, spark, name, epoch, schema):
        if epoch == 0:
            return no_rows(spark, schema)
        return spark.read.schema(schema).parquet(f"{self.state}/{name}/epoch={epoch - 1}")

    def _carry(self, df, name, epoch):
        df.write.mode("overwrite").parquet(f"{self.state}/{name}/epoch={epoch}")
