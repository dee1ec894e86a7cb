"""The streaming operators, fed with the access log in several files.

Each query writes its input and output below the session's scratch folder, runs until the
input is used up, and returns what came out.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

import threatlog as tl
from threatlog.session import scratch_folder, staged
from threatlog.streaming import (
    ROCKSDB, LiveReport, committed_alerts, committed_lines, live_counts, start_alerts, start_entries, stream_alert_steps,
)

from .logs import AS_OF, YEAR, lines


def _log(spark, sf_dir):
    tl.tune(spark)
    return lines(spark, sf_dir, "access").select("line", "source", "seq")


#: Micro-batches that a log comes in.
PARTS = 4


def _in_parts(log, folder):
    """Write the log in :data:`PARTS` parts, by ``seq``, the earliest first; returns the stream that reads a part at a time.

    Every part has as many files as tasks run at once, so that all of them write it, and read and parse its batch.
    """
    spark, schema = log.sparkSession, log.schema
    log = staged(log)
    last = log.agg(F.max("seq")).first()[0] or 0
    files = spark.sparkContext.defaultParallelism
    for n in range(PARTS):
        part = log.where(F.floor(F.col("seq") * PARTS / (last + 1)) == n)
        part.repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.option("maxFilesPerTrigger", files).schema(schema).parquet(folder)


def _stream(spark, sf_dir):
    """The access log as a stream of files, in several micro-batches."""
    return _in_parts(_log(spark, sf_dir), scratch_folder(spark))


def _entries(spark, sf_dir):
    return tl.parse_logs(_stream(spark, sf_dir), as_of=AS_OF, default_year=YEAR)


def _run(spark, df, mode="append"):
    """Run a stream until its input ends, and read its Parquet output."""
    out, checkpoint = scratch_folder(spark), scratch_folder(spark)
    query = (
        df.writeStream.outputMode(mode).format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def stream_rule_hits(spark, sf_dir):
    return _run(spark, tl.rule_hits(_entries(spark, sf_dir))).select("seq", "rule_id")


@contextmanager
def _state_store(spark):
    """The state store that keyed state needs, for the time of one query."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stream_alert_step_rows(spark, sf_dir):
    with _state_store(spark):
        steps = _run(spark, stream_alert_steps(_entries(spark, sf_dir)))
    return steps.select(
        "rule_id", "ip", "alert_step", "count", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")
    )


def stream_live_counts(spark, sf_dir):
    out = scratch_folder(spark)

    def save(batch, epoch):
        batch.write.mode("overwrite").parquet(out)

    query = (
        live_counts(_entries(spark, sf_dir)).writeStream.outputMode("complete").foreachBatch(save)
        .option("checkpointLocation", scratch_folder(spark)).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)


def _live_job(spark, sf_dir):
    """The live job in two runs: the second starts from the checkpoint when the rest of the log is there."""
    folder, out, checkpoint = (scratch_folder(spark) for _ in range(3))
    log = _log(spark, sf_dir)
    half = log.count() // 2
    for arrived in (F.col("seq") < half, F.col("seq") >= half):
        log.where(arrived).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(log.schema).parquet(folder)
        start_alerts(stream, as_of=AS_OF, default_year=YEAR, out=out, checkpoint=checkpoint).awaitTermination()
    return out


def stream_context_lines(spark, sf_dir):
    return committed_lines(spark, _live_job(spark, sf_dir), "context")


def stream_alerts(spark, sf_dir):
    return committed_alerts(spark, _live_job(spark, sf_dir)).select("rule_id", "ip", "count", "line_no")


def stream_alert_log(spark, sf_dir):
    return committed_lines(spark, _live_job(spark, sf_dir))


def stream_text_hits(spark, sf_dir):
    """Text files that appear in a folder, from lines to hits per rule."""
    folder = scratch_folder(spark)
    _log(spark, sf_dir).select("line").write.text(folder)
    entries = tl.parse_logs(tl.stream_logs(spark, folder), as_of=AS_OF, default_year=YEAR)
    return _run(spark, tl.rule_hits(entries)).groupBy("rule_id").agg(F.count("*").alias("n"))


def stream_delimited(spark, sf_dir):
    """A delimited log whose layout is found on its first third, which takes two micro-batches to come."""
    from .queries import delimited_columns

    tl.tune(spark)
    log = lines(spark, sf_dir, "delimited").select("line", "source", "seq")
    folder, out, checkpoint = (scratch_folder(spark) for _ in range(3))
    query = start_entries(
        _in_parts(log, folder), as_of=AS_OF, out=out, checkpoint=checkpoint, layout_lines=max(1, log.count() // 3),
        select=lambda entries: entries.select(*delimited_columns()),
    )
    query.awaitTermination()
    return spark.read.parquet(out).drop("epoch")


def _live_report(spark, sf_dir):
    """The report of a log that comes in quarters, not in order; each run starts anew from the checkpoint."""
    folder, out, checkpoint = (scratch_folder(spark) for _ in range(3))
    log = staged(_log(spark, sf_dir))
    last = log.agg(F.max("seq")).first()[0] or 0
    for n in (2, 0, 3, 1):
        log.where(F.floor(F.col("seq") * PARTS / (last + 1)) == n).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(log.schema).parquet(folder)
        report = LiveReport(spark, out, as_of=AS_OF, default_year=YEAR, in_order=True)
        report.start(stream, checkpoint).awaitTermination()
    return report.analysis()


def stream_report(spark, sf_dir):
    from .queries import summary_columns

    return tl.summary_report(_live_report(spark, sf_dir)).select(*summary_columns())


def stream_threats(spark, sf_dir):
    from .queries import threat_columns

    return _live_report(spark, sf_dir).threats.select(*threat_columns())


def queries():
    return {
        "stream_report": stream_report,
        "stream_threats": stream_threats,
        "stream_rule_hits": stream_rule_hits,
        "stream_alert_steps": stream_alert_step_rows,
        "stream_live_counts": stream_live_counts,
        "stream_context_lines": stream_context_lines,
        "stream_alerts": stream_alerts,
        "stream_alert_log": stream_alert_log,
        "stream_text_hits": stream_text_hits,
        "stream_delimited": stream_delimited,
    }
