"""Counts, rankings and scores over entries and threats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed_values import RISK_BANDS, RISK_CAP, SEVERITY, SEVERITY_ORDER
from ..functions.text import filled, line_severity, stripped


def counts_of(entries: DataFrame, column: str) -> DataFrame:
    """Rows per filled value, with the first row it occurs in: ``column, n, first_seq``."""
    return (
        entries.where(filled(F.col(column).cast("string")).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    )


def most_common(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest counts, ties in first-seen order (a per-partition top-k, then one merge)."""
    return counts.orderBy(F.desc("n"), F.asc("first_seq")).limit(k)


def top_ips(entries: DataFrame, k: int = 10) -> DataFrame:
    return most_common(counts_of(entries, "ip"), k)


def top_paths(entries: DataFrame, k: int = 10) -> DataFrame:
    return most_common(counts_of(entries, "path"), k)


def status_counts(entries: DataFrame) -> DataFrame:
    """Rows per status; no status and status 0 do not count."""
    return entries.where(F.col("status") != 0).groupBy("status").agg(F.count("*").alias("n"))


def timeline(entries: DataFrame, by: str = "clock") -> DataFrame:
    """Rows per minute: ``clock`` folds days together (``HH:mm``), ``minute`` keeps the date."""
    pattern = {"clock": "HH:mm", "minute": "yyyy-MM-dd HH:mm"}[by]
    return (
        entries.where(F.col("ts").isNotNull())
        .groupBy(F.date_format("ts", pattern).alias("minute"))
        .agg(F.count("*").alias("n"))
    )


def timeline_stats(minutes: DataFrame) -> DataFrame:
    """One row: total, largest bucket, number of buckets, first bucket of that size."""
    best = F.min(F.struct((-F.col("n")).alias("down"), F.col("minute")))
    return minutes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.max("n"), F.lit(0)).alias("peak"),
        F.count("*").alias("buckets"),
        best["minute"].alias("peak_minute"),
    )


def distinct_counts(entries: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: distinct addresses and paths, exact unless ``approximate``."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return entries.agg(
        count(filled(F.col("ip"))).alias("unique_ips"), count(filled(F.col("path"))).alias("unique_paths")
    )


def shares_of_maximum(counts: DataFrame, k: int = 6) -> DataFrame:
    """The ``k`` largest counts with their share of the largest one in whole percent."""
    top = most_common(counts, k)
    largest = F.max("n").over(W.partitionBy())
    return top.withColumn("percent", F.floor(F.col("n") / largest * 100 + 0.5).cast("bigint"))


def threats_by_level(threats: DataFrame) -> DataFrame:
    return threats.groupBy("level").agg(F.count("*").alias("n"))


def severity_matrix(threats: DataFrame) -> DataFrame:
    """All five severities, worst first, with their threats (0 where there are none)."""
    spark = threats.sparkSession
    levels = spark.createDataFrame(
        [(pos, level, SEVERITY[level]) for pos, level in enumerate(SEVERITY_ORDER)],
        "position int, level string, level_score int",
    )
    counts = threats_by_level(threats)
    full = levels.join(counts, "level", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # Five rows, so one task is enough.
    largest = F.greatest(F.max("n").over(W.partitionBy()), F.lit(1))
    return full.withColumn("percent", F.floor(F.col("n") / largest * 100 + 0.5).cast("bigint"))


def risk_score(threats: DataFrame) -> DataFrame:
    """One row: the summed severity of all hits, at most 100, and its band."""
    total = F.coalesce(F.sum(F.col("level_score") * F.col("count")), F.lit(0))
    return threats.agg(F.least(F.lit(RISK_CAP), total).cast("int").alias("risk_score")).withColumn(
        "band", risk_band(F.col("risk_score"))
    )


def risk_band(score: Column) -> Column:
    """CRITICAL, HIGH, MEDIUM or LOW."""
    out = F
    for lowest, band in RISK_BANDS:
        out = out.when(score >= lowest, band)
    return out.otherwise("LOW")


def gate(threats: DataFrame, level: str = "HIGH") -> DataFrame:
    """One row: whether a pipeline should stop, that is whether any threat is at least ``level``."""
    worst = F.max("level_score")
    return threats.agg(F.coalesce(worst >= SEVERITY[level], F.lit(False)).alias("fail"))


def threat_details(threats: DataFrame, evidences: int = 2, chars: int = 120) -> DataFrame:
    """Threats with their first evidences cut to a length, as a verbose report shows them."""
    return threats.withColumn(
        "evidence", F.transform(F.slice("evidence", 1, evidences), lambda text: F.substring(text, 1, chars))
    )


def line_severities(lines: DataFrame) -> DataFrame:
    """Filled lines with their colouring class: ``seq, line, severity``."""
    return lines.where(stripped(F.col("line")) != "").select("seq", "line", line_severity(F.col("line")).alias("severity"))


def search_lines(lines: DataFrame, text: str = "", limit: int = 100) -> DataFrame:
    """The first filled lines that contain a text, letter case ignored."""
    found = lines.where((stripped(F.col("line")) != "") & F.contains(F.lower("line"), F.lit(text.lower())))
    return found.orderBy("seq").limit(limit)


def line_feed(lines: DataFrame, text: str = "", limit: int = 100) -> DataFrame:
    """The first filled lines that contain a text, with their colouring class and the number of all such lines.

    ``seq, line, severity, total``; letter case ignored.  The colouring patterns run on the lines shown alone.
    """
    found = lines.where((stripped(F.col("line")) != "") & F.contains(F.lower("line"), F.lit(text.lower())))
    total = found.agg(F.count("*").alias("total"))  # one row
    shown = found.select("seq", "line").orderBy("seq").limit(limit)
    return shown.withColumn("severity", line_severity(F.col("line"))).crossJoin(F.broadcast(total))
