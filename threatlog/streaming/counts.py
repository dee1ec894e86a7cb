"""A report's counts while lines keep coming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled


def live_counts(entries: DataFrame) -> DataFrame:
    """Rows per address, path, status and minute: ``kind, name, n``.

    One aggregation that only touches the groups of new lines; use output mode ``update`` or
    ``complete``.
    """
    options = {
        "ip": filled(F.col("ip")),
        "path": filled(F.col("path")),
        "status": F.when(F.col("status") != 0, F.col("status").cast("string")),
        "minute": F.date_format("ts", "HH:mm"),
    }
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), name.alias("name")) for kind, name in options.items()])
    return (
        entries.select(F.explode(pairs).alias("p")).select("p.*")
        .where(F.col("name").isNotNull())
        .groupBy("kind", "name").agg(F.count("*").alias("n"))
    )
