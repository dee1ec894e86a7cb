"""Sliding windows per address: peaks, burst threats and throttled alerts.

Rows are first counted per ``(counter, ip, ts)``; the counting runs before the shuffle, so
an address that sends a third of all lines arrives as at most one row per distinct time.

The sliding count is then a running sum over two kinds of marks, an arrival at ``t`` and a
departure just after ``t + window``.  That costs two rows per time whatever the number of
times inside a window.  Marks are grouped by ``(counter, ip, slot)``, a slot being an hour or
more, and times near the end of a slot are repeated in the next one when their window reaches
into it.  So a busy address is cut into slots and each slot is exact by itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed_values import BURST_RULE_TEXTS, SEVERITY, WINDOW_MINUTES
from ..functions.text import fill
from ..functions.times import hour_number
from ..session import scratch_folder, staged
from .rules import counter_flags

WINDOW = timedelta(minutes=WINDOW_MINUTES)


@dataclass(frozen=True)
class ThresholdRule:
    """A burst rule: at least ``threshold`` rows of a counter from one address within ``window``.

    ``counter`` names a counter of :func:`ticks`; ``step`` is the width of an alert step.  The
    texts may use ``{n}``, ``{ip}``, ``{minutes}`` and ``{start}``.
    """

    rule_id: str
    name: str
    level: str
    counter: str
    threshold: int
    step: int
    description: str
    evidence: str
    window: timedelta = WINDOW

    def __post_init__(self):
        if self.level not in SEVERITY:
            raise ValueError(f"unknown level {self.level!r}")
        if self.threshold < 1 or self.step < 1 or self.threshold % self.step:
            raise ValueError("the threshold must be a multiple of the alert step")


def default_thresholds() -> tuple[ThresholdRule, ...]:
    """The three built-in burst rules."""
    return tuple(ThresholdRule(*values) for values in BURST_RULE_TEXTS)


def ticks(entries: DataFrame, counters: dict[str, Column] | None = None) -> DataFrame:
    """Rows per counter, address and time: ``counter, ip, ts, n, first_seq``."""
    counted = entries.select("ip", "ts", "seq", _counter_names(counters).alias("_counters"))
    return (
        counted.select("ip", "ts", "seq", F.explode_outer("_counters").alias("counter"))
        .where(F.col("counter").isNotNull())
        .groupBy("counter", "ip", "ts")
        .agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    )


def sliding_counts(ticked: DataFrame, window: timedelta = WINDOW) -> DataFrame:
    """For every tick the count in the window that ends with it, both ends included.

    ``counter, ip, slot, ts, n, first_seq, in_window, window_start``.  A slot is as many hours
    as the window needs to reach at most one slot further.
    """
    span = F.lit(window)
    hours = max(1, -(-window // timedelta(hours=1)))

    def slot_of(ts):
        return F.floor(hour_number(ts) / hours)

    home = slot_of(F.col("ts"))
    slots = F.sequence(home, slot_of(F.col("ts") + span))
    group = ("counter", "ip", "slot")
    spread = (
        ticked.withColumn("_home", home)
        .withColumn("slot", F.explode(slots))
        .withColumn("_next", F.lead("ts").over(W.partitionBy(*group).orderBy("ts")))
    )
    arrival = F.struct(
        F.col("ts").alias("at"), F.lit(False).alias("leaves"), F.col("n").alias("change"),
        F.lit(None).cast("timestamp_ntz").alias("next"),
    )
    departure = F.struct(
        (F.col("ts") + span).alias("at"), F.lit(True).alias("leaves"), (-F.col("n")).alias("change"),
        F.col("_next").alias("next"),
    )
    marks = spread.withColumn("mark", F.explode(F.array(arrival, departure))).select(
        *group, "ts", "n", "first_seq", "_home", "mark.*"
    )
    # At equal times arrivals come first: an event exactly one window old still counts.
    so_far = W.partitionBy(*group).orderBy("at", "leaves").rowsBetween(W.unboundedPreceding, 0)
    return (
        marks.withColumn("in_window", F.sum("change").over(so_far))
        .withColumn("_after_left", F.max("next").over(so_far))
        .withColumn("_first", F.min("ts").over(so_far))
        .where(~F.col("leaves") & (F.col("slot") == F.col("_home")))
        .withColumn("window_start", F.coalesce("_after_left", "_first"))
        .select(*group, "ts", "n", "first_seq", "in_window", "window_start")
    )


def peaks(ticked: DataFrame, window: timedelta = WINDOW) -> DataFrame:
    """The largest sliding count per counter and address, with the earliest window that has it.

    ``counter, ip, peak, window_start, window_end, first_seq``.
    """
    best = F.struct((-F.col("in_window")).alias("down"), F.col("ts"), F.col("window_start"))
    return (
        sliding_counts(ticked, window)
        .groupBy("counter", "ip")
        .agg(F.min(best).alias("best"), F.min("first_seq").alias("first_seq"))
        .select(
            "counter", "ip", (-F.col("best.down")).alias("peak"), "best.window_start",
            F.col("best.ts").alias("window_end"), "first_seq",
        )
    )


def peak_windows(entries: DataFrame, counters=None, window: timedelta = WINDOW) -> DataFrame:
    """:func:`peaks` straight from entries."""
    return peaks(ticks(entries, counters), window)


def threshold_hits(ticked: DataFrame, thresholds=None) -> DataFrame:
    """Burst threats, one per rule and address whose peak reaches the threshold."""
    thresholds = thresholds or default_thresholds()
    found = _per_window(ticked, thresholds, peaks)
    return _with_texts(
        found.where(F.col("peak") >= F.col("threshold")).withColumnRenamed("peak", "count"), thresholds
    ).select(
        "rule_no", "rule_id", "rule_name", "level", "level_score", "description", "evidence", "ip",
        F.col("window_end").alias("ts"), "count", "first_seq",
    )


def alert_steps(ticked: DataFrame, thresholds=None) -> DataFrame:
    """Throttled alerts: one per rule, address and step that the running peak enters.

    ``count`` is the step's lowest count, ``ts`` the first time the sliding count reaches it,
    ``nth`` which of that time's rows does so.
    """
    thresholds = thresholds or default_thresholds()
    before = W.partitionBy("counter", "ip", "slot").orderBy("ts").rowsBetween(W.unboundedPreceding, -1)

    def running(ticked, window):
        counts = sliding_counts(ticked, window)
        return counts.withColumn("_so_far", F.coalesce(F.max("in_window").over(before), F.lit(0)))

    low = F.greatest(F.expr("threshold div step - 1"), F.expr("_so_far div step"))
    entered = (
        _per_window(ticked, thresholds, running)
        .withColumn("_low", low)
        .withColumn("_high", F.expr("in_window div step"))
        .where(F.col("_high") > F.col("_low"))
        .withColumn("alert_step", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))))
    )
    # Every slot proposes its own first time per step; the earliest one is the real one.
    first = entered.groupBy("rule_no", "counter", "step", "ip", "alert_step").agg(
        F.min("ts").alias("ts"),
        F.min_by("window_start", "ts").alias("window_start"),
        F.min_by(F.col("in_window") - F.col("n"), F.col("ts")).alias("_before"),
    )
    counted = first.withColumn("count", F.col("alert_step") * F.col("step"))
    return _with_texts(counted, thresholds).select(
        "rule_no", "rule_id", "rule_name", "level", "level_score", "description", "evidence", "ip", "ts",
        "count", "counter", "alert_step", (F.col("count") - F.col("_before")).alias("nth"),
    )


def alert_rows(
    entries: DataFrame, steps: DataFrame, counters: dict[str, Column] | None = None, folder: str | None = None
) -> DataFrame:
    """The entry that set off each alert step: the steps with that row's ``seq`` and ``source``.

    Both are NULL if the row is not among the entries.

    The steps and the few rows at their times are kept in ``folder`` or the scratch folder, so
    the log is read twice in all: once for the steps and once for the rows.
    """
    folder = folder or scratch_folder(entries.sparkSession)
    moment = ["counter", "ip", "ts"]
    steps = staged(steps, path=f"{folder}/steps")
    rows = staged(
        entries.select("seq", "source", "ip", "ts", F.explode_outer(_counter_names(counters)).alias("counter"))
        .where(F.col("counter").isNotNull())
        .join(steps.select(*moment).distinct(), moment, "left_semi"),
        path=f"{folder}/rows",
    )
    return steps.join(numbered_within(rows, moment, "nth"), [*moment, "nth"], "left")


def numbered_within(df: DataFrame, keys, name: str, order: str = "seq", width: int = 1 << 16) -> DataFrame:
    """Rows numbered from 1 within ``keys`` by a long ``order`` column.

    A group is numbered in slices of ``width`` order values, each moved on by the size of the
    slices before it, so a group of any size is spread over many tasks.
    """
    sliced = df.withColumn("_slice", F.expr(f"`{order}` div {width}"))
    group = [*keys, "_slice"]
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*group)
        .agg(F.count("*").alias("_size"))
        .select(*group, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = sliced.withColumn("_row", F.row_number().over(W.partitionBy(*group).orderBy(order)))
    # Keys may be NULL.
    offsets = offsets.toDF(*[f"_of_{c}" for c in group], "_offset")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group])
    return inside.join(offsets, same).withColumn(name, F.col("_row") + F.col("_offset")).select(*df.columns, name)


def _counter_names(counters):
    counters = counters or counter_flags()
    return F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in counters.items()]))


def _per_window(ticked, thresholds, count):
    """``count(ticks, window)`` with the rules of its counter: one pass per distinct window length."""
    out = None
    for window in dict.fromkeys(r.window for r in thresholds):
        rules = [(no, r) for no, r in enumerate(thresholds, start=1) if r.window == window]
        counters = list(dict.fromkeys(r.counter for _, r in rules))
        of_counter = None
        for name in counters:
            these = F.array(
                *[
                    F.struct(
                        F.lit(no).alias("rule_no"),
                        F.lit(r.threshold).cast("bigint").alias("threshold"),
                        F.lit(r.step).cast("bigint").alias("step"),
                    )
                    for no, r in rules
                    if r.counter == name
                ]
            )
            here = F.col("counter") == name
            of_counter = F.when(here, these) if of_counter is None else of_counter.when(here, these)
        counted = count(ticked.where(F.col("counter").isin(*counters)), window)
        part = counted.withColumn("_rule", F.explode(of_counter)).select("*", "_rule.*").drop("_rule")
        out = part if out is None else out.unionByName(part)
    return out


def _with_texts(df, thresholds):
    no = F.col("rule_no")

    def attribute(value):
        return F.get(F.array(*[F.lit(value(r)) for r in thresholds]), no - 1)

    def text(which):
        out = None
        for n, rule in enumerate(thresholds, start=1):
            filled_in = fill(
                getattr(rule, which), n=F.col("count"), ip=F.col("ip"),
                minutes=F.lit(int(rule.window.total_seconds() // 60)),
                start=F.date_format("window_start", "HH:mm:ss"),
            )
            out = F.when(no == n, filled_in) if out is None else out.when(no == n, filled_in)
        return out

    return df.withColumns(
        {
            "rule_id": attribute(lambda r: r.rule_id),
            "rule_name": attribute(lambda r: r.name),
            "level": attribute(lambda r: r.level),
            "level_score": attribute(lambda r: SEVERITY[r.level]),
            "description": text("description"),
            "evidence": text("evidence"),
        }
    )
