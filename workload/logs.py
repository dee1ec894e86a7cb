"""Logs rendered from the ``events`` table, the same text in Spark and DuckDB.

No given table is a log.  The rendering is a plain projection of every event, so the work of a
query grows with the table.  Times come from ``event_id`` (ten lines per second), as the
events' own times are too far apart for any burst.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlog import spread

AS_OF = datetime(2024, 6, 1)
YEAR = 2024

#: 2024-01-01 00:00:00 UTC.
_EPOCH_SECOND = 1704067200
_SPARK_TIME = "timestampadd(SECOND, CAST(event_id div 10 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')"
_DUCK_TIME = "(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(event_id // 10))"


def _spark(layout):
    return f"date_format({_SPARK_TIME}, '{layout}')"


def _duck(layout):
    return f"strftime({_DUCK_TIME}, '{layout}')"


_ACCESS = """concat('10.0.0.', CAST(user_id % 16 AS VARCHAR(10)), ' - u', CAST(user_id AS VARCHAR(10)), ' [', {clf}, ' +0000] "',
    CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END, ' ',
    CASE WHEN event_id % 97 = 0 THEN '/items?id=1;--'
         WHEN event_id % 89 = 0 THEN '/q?s=<script>x'
         WHEN event_id % 83 = 0 THEN '/../../etc/passwd'
         WHEN event_id % 79 = 0 THEN '/admin'
         WHEN event_id % 73 = 0 THEN '/ping?h=a;whoami'
         WHEN event_id % 71 = 0 THEN '/up/shell.php'
         WHEN event_id % 67 = 0 THEN '/.env'
         ELSE concat('/', event_type, '/', CAST(user_id % 7 AS VARCHAR(10))) END,
    ' HTTP/1.1" ',
    CASE WHEN event_type = 'error'
         THEN CASE event_id % 3 WHEN 0 THEN '401' WHEN 1 THEN '404' ELSE '500' END
         ELSE '200' END,
    ' 512', CASE WHEN event_id % 61 = 0 THEN ' "-" "sqlmap/1.7"' ELSE '' END)"""

_MIXED = """CASE event_id % 8
    WHEN 0 THEN concat('10.1.0.', {u}, ' - - [', {clf}, ' +0000] "GET /', event_type, ' HTTP/1.1" ',
                       CASE WHEN event_type = 'error' THEN '403' ELSE '200' END, ' 10')
    WHEN 1 THEN concat({short}, ' host sshd[7]: ',
                       CASE WHEN event_type = 'error' THEN 'Failed password for invalid user u' ELSE 'Accepted password for u' END,
                       {u}, ' from 10.1.0.', {u}, ' port 22 ssh2')
    WHEN 2 THEN concat({short}, ' host cron[9]: job ', event_type, ' done')
    WHEN 3 THEN concat({long}, ' worker 10.1.0.', {u}, ' ', event_type)
    WHEN 4 THEN concat('{{"client_ip": "10.1.0.', {u}, '", "uri": "/', event_type, '", "status": "',
                       CASE WHEN event_type = 'error' THEN '503 Down' ELSE '200' END, '", "time": "', {iso}, 'Z"}}')
    WHEN 5 THEN concat('# comment ', event_type)
    WHEN 6 THEN ''
    ELSE concat('free text about 10.1.0.', {u}) END"""

_DELIMITED = """concat({long}, '|10.2.0.', {u}, '|', CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END, '|/',
    event_type, '|', CASE WHEN event_type = 'error' THEN '404' ELSE '200' END, '|note ', CAST(event_id % 7 AS VARCHAR(10)))"""


_EPOCH = """concat('{{"client_ip": "10.1.0.', {u}, '", "uri": "/', event_type, '", "time": ', {epoch},
    CASE event_id % 3 WHEN 0 THEN '000' WHEN 1 THEN '' ELSE '.5' END, '}}')"""


def _parts(engine):
    text = _spark if engine == "spark" else _duck
    spark = engine == "spark"
    return {
        "u": "CAST(user_id % 16 AS VARCHAR(10))",
        "clf": text("dd/MMM/yyyy:HH:mm:ss" if spark else "%d/%b/%Y:%H:%M:%S"),
        "short": text("MMM dd HH:mm:ss" if spark else "%b %d %H:%M:%S"),
        "long": text("yyyy-MM-dd HH:mm:ss" if spark else "%Y-%m-%d %H:%M:%S"),
        "epoch": f"CAST({_EPOCH_SECOND} + {'event_id div 10' if spark else 'event_id // 10'} AS VARCHAR(10))",
        "iso": text("yyyy-MM-dd\\'T\\'HH:mm:ss" if spark else "%Y-%m-%dT%H:%M:%S"),
    }


_KINDS = {"access": _ACCESS, "mixed": _MIXED, "delimited": _DELIMITED, "epoch": _EPOCH}


def duck_lines(kind: str) -> str:
    """The log as a DuckDB query: ``line_no, line``."""
    return f"SELECT event_id AS line_no, {_KINDS[kind].format(**_parts('duck'))} AS line FROM events"


def lines(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The log as lines: ``line, source, seq, line_no``."""
    expression = _KINDS[kind].format(**_parts("spark")).replace("AS VARCHAR(10)", "AS STRING")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    return spread(events, "event_id").select(
        F.expr(expression).alias("line"),
        F.lit(kind).alias("source"),
        F.col("event_id").alias("seq"),
        F.col("event_id").alias("line_no"),
    )
