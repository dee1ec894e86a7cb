"""Lines around alerts.

An alert keeps its own line and the fourteen before it in the same source.  Turned round, the
kept lines are the numbers ``n-14 .. n`` of the alerting lines, so with dense line numbers
this is one semi join on ``(source, line_no)``: no window over a source, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed_values import CONTEXT_LINES
from .windows import numbered_within


def number_lines(lines: DataFrame) -> DataFrame:
    """Lines with ``line_no``, dense from 1 within a source.

    Lines of :func:`read_logs` know their file block; a block is read in order by one task, so
    its lines need only its first number, and blocks are few.  Other lines are numbered by ``seq``.
    """
    if "line_no" in lines.columns:
        return lines
    if "block" not in lines.columns:
        return numbered_within(lines, ["source"], "line_no")
    earlier = W.partitionBy("source").orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        lines.groupBy("source", "file", "block")
        .agg(F.min("seq").alias("_first"), F.count("*").alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .select(F.col("source").alias("_source"), F.col("file").alias("_file"), F.col("block").alias("_block"), "_first", "_offset")
    )
    number = F.col("seq") - F.col("_first") + F.col("_offset") + 1
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))
    return lines.join(blocks, same).withColumn("line_no", number).select(*lines.columns, "line_no")


def context_lines(numbered: DataFrame, alerts: DataFrame, size: int = CONTEXT_LINES) -> DataFrame:
    """The lines an alert keeps, each once.

    ``numbered`` comes from :func:`number_lines`; ``alerts`` has ``source, line_no`` of the
    alerting lines.  Blank and comment lines count as lines.
    """
    line_no = F.col("line_no")
    wanted = alerts.select(
        "source", F.explode(F.sequence(line_no - (size - 1), line_no)).alias("line_no")
    ).distinct()
    wanted = wanted.toDF("_source", "_line_no")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("line_no") == F.col("_line_no"))
    return numbered.join(wanted, same, "left_semi")
