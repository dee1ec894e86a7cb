"""Batch and streaming lines.

A line has ``line``, ``source`` and ``seq``, a long that orders the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_logs(spark: SparkSession, paths, source: str | None = None, **options) -> DataFrame:
    """Text files, one row per line; paths may be globs and files may be compressed.

    Undecodable bytes become replacement characters.  ``source`` is the file unless named.
    ``seq`` grows along the lines of a file block, and ``block`` is the block's place in its
    file; :func:`threatlog.number_lines` turns the two into line numbers.
    """
    lines = spark.read.options(**options).text(paths)
    return lines.select(
        F.col("value").alias("line"),
        F.lit(source).alias("source") if source else F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )


def from_lines(df: DataFrame, column: str = "value", source: str = "upload", order_by: str | None = None) -> DataFrame:
    """Any frame with a text column.  ``order_by`` is a long column with the lines' order; without
    one it is the order in which the rows are read."""
    seq = F.col(order_by).cast("bigint") if order_by else F.monotonically_increasing_id()
    return df.select(F.col(column).alias("line"), F.lit(source).alias("source"), seq.alias("seq"))


def from_text(spark: SparkSession, text: str, source: str = "upload") -> DataFrame:
    """A pasted text, such as a request body."""
    rows = list(enumerate(text.splitlines(), start=1))
    df = spark.createDataFrame(rows, "line_no bigint, line string")
    return from_lines(df, "line", source, "line_no")


def spread(lines: DataFrame, by: str = "seq") -> DataFrame:
    """Batch rows dealt out by a hash of ``by``, whatever their number.

    For input that only one task can read, such as a compressed file: parsing costs far more than
    moving the lines.  Input that Spark can split needs no such step.
    """
    spark = lines.sparkSession
    pieces = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return lines.repartition(pieces, by)


def stream_logs(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Text files that appear in a folder, as a stream of lines.

    A stream cannot number its rows, so ``seq`` is NULL; the live job numbers them per batch.
    """
    return (
        spark.readStream.options(**options)
        .text(folder)
        .select(
            F.col("value").alias("line"),
            F.col("_metadata.file_path").alias("source"),
            F.lit(None).cast("bigint").alias("seq"),
        )
    )
