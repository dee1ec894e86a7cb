"""The lines around the alerts of a whole log, from files or frames, in one call.

The log's text is read twice and shuffled never but for the lines that are kept.  The first reading parses it and
writes a slim table: of each line its place, address, time, the counters it counts for and whether a rule hits it.
From that come the burst counts, the lines that set off an alert, and line numbers.  Lines of files are numbered by
blocks: a block's lines follow one another, so the sizes of the blocks before it place them all.  The numbers that are
wanted, some lines before each alert, turn into marks, a table of bits of fixed size, and the second reading lets only
marked lines through to the join that decides.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed_values import CONTEXT_LINES
from ..operators.parse import DROPPED, parse_logs
from ..operators.rules import candidate_hits, counter_flags, default_rules, is_hit
from ..operators.windows import alert_rows, alert_steps, default_thresholds, numbered_within, ticks
from ..session import scratch_folder, staged

#: Words of 64 bits of a table of marks: bounds what is broadcast, whatever the input.
MARKS = 1 << 18


def only_marked(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``keys`` are not in ``wanted``, and with all others.

    The marks, a bit per hash of wanted keys, are broadcast: at most :data:`MARKS` rows of two numbers.  Where very
    many keys are wanted more rows pass, up to all of them.
    """
    h = F.xxhash64(*keys)
    word, bit = F.pmod(h, F.lit(MARKS)), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")
    marks = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(
        F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")
    )
    placed = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(marks), "_word")
    return placed.where(F.bit_get("_bits", F.col("_bit")) == 1).select(*rows.columns)


def _joined(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose keys, null or not, are in ``wanted``, with its other columns."""
    other = wanted.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return only_marked(rows, keys, wanted).join(other, same).drop(*[f"_of_{k}" for k in keys])


def _placed(slim: DataFrame) -> DataFrame:
    """Slim lines with ``line_no``, dense from 1 within a source, and ``place``, a long that orders all lines."""
    if "line_no" in slim.columns:
        return slim.withColumn("place", F.col("seq"))
    if "block" not in slim.columns:
        return numbered_within(slim, ["source"], "line_no").withColumn("place", F.col("seq"))
    keys = ["source", "file", "block"]
    sizes = slim.groupBy(*keys).agg(F.min("seq").alias("_first"), F.count("*").alias("_size"))
    # One row per block of the input's files: by far too few for a window over all of them to matter.
    earlier = W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    blocks = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    blocks = staged(blocks.withColumn("_start", F.min("_before").over(W.partitionBy("source"))))
    other = blocks.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    place = F.col("_before") + F.col("seq") - F.col("_first") + 1
    return slim.join(other, same).select(*slim.columns, (place - F.col("_start")).alias("line_no"), place.alias("place"))


def log_context(
    lines: DataFrame, as_of: datetime, rules=None, thresholds=None, counters=None, size: int = CONTEXT_LINES, **parse_options
) -> DataFrame:
    """Every line that sets off an alert, and up to ``size`` lines with it and before it, each once: ``source, line_no, line``.

    ``lines`` has ``line, source, seq``, and either ``line_no`` or, from :func:`read_logs`, ``file`` and ``block``; else
    lines are numbered by ``seq``.  Alerts are the row hits and the throttled burst alerts, as in the live job.
    Blank and comment lines count as lines.  Own ``counters`` come on top of the built-in ones.
    """
    spark = lines.sparkSession
    rules = rules or default_rules()
    thresholds = tuple(thresholds or default_thresholds())
    counters = counter_flags() | (counters or {})
    at = [c for c in ("line_no", "file", "block") if c in lines.columns]
    carried = lines.select("line", "seq", F.struct("source", *at).alias("source"))
    entries = parse_logs(carried, as_of=as_of, keep_dropped=True, **parse_options)
    kept = F.col("format") != DROPPED
    counted = F.array_compact(F.array(*[F.when(kept & flag, F.lit(name)) for name, flag in counters.items()]))
    slim = candidate_hits(entries, rules).select(
        "seq", F.col("source.source").alias("source"), *[F.col(f"source.{c}").alias(c) for c in at], "ip", "ts",
        counted.alias("counted"), is_hit(rules).alias("hit"),
    )
    placed = staged(_placed(staged(slim)))

    known = {name: F.array_contains("counted", name) for name in counters}
    timed = placed.select("source", F.col("place").alias("seq"), "ip", "ts", "counted")
    steps = alert_rows(timed, alert_steps(ticks(timed, known), thresholds), known, folder=scratch_folder(spark))
    bursts = steps.where(F.col("seq").isNotNull()).select(F.col("seq").alias("place")).distinct()
    alerting = placed.where("hit").select("source", "line_no")
    alerting = alerting.unionByName(_joined(placed.select("source", "line_no", "place"), bursts, ["place"]).select("source", "line_no"))
    number = F.sequence(F.greatest(F.col("line_no") - (size - 1), F.lit(1 if "line_no" not in at else None).cast("bigint")), F.col("line_no"))
    wanted = staged(alerting.select("source", F.explode(number).alias("line_no")).distinct())
    rows = staged(_joined(placed.select("source", "line_no", "seq"), wanted, ["source", "line_no"]).select("seq", "line_no"))
    return _joined(lines.select("line", "source", "seq"), rows, ["seq"]).select("source", "line_no", "line")
