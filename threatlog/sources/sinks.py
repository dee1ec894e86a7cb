"""Writing alerts, context and lines of any kind as text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.enrich import alert_lines


def write_alert_log(alerts: DataFrame, path: str) -> None:
    """Append one line per alert to a folder of text files."""
    alert_lines(alerts).select("line").write.mode("append").text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Append the ``line`` column to a folder of text files."""
    lines.select("line").write.mode("append").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """Entries, threats or report tables as JSON lines."""
    df.write.mode("overwrite").json(path)
