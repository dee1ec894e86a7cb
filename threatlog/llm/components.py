"""Connected components of links in a table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove_folder, scratch_folder


def components(links: DataFrame) -> DataFrame:
    """Links (``a``, ``b``, bigint) to rows ``node``, ``root``: the smallest node it is connected with.

    Only nodes that are not their own root have a row.  Links with a null end or to itself say nothing;
    repeated ones count once.  Each round is a table in the shared folder, so a lost executor costs no
    earlier round; groups are only ever reduced to their minimum, never gathered.
    """
    spark = links.sparkSession
    edges = links.where("a is not null and b is not null and a <> b")
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    table, path = _written(edges, spark)
    before = _state(table)
    while before[0]:
        both = table.union(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        table, written = _written(small.union(least).distinct(), spark)
        remove_folder(spark, path)
        path, now = written, _state(table)
        if now == before:
            break
        before = now
    return table.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _written(df: DataFrame, spark):
    path = scratch_folder(spark)
    df.write.parquet(path)
    return spark.read.schema("u bigint, v bigint").parquet(path), path


def _state(table: DataFrame) -> tuple:
    return tuple(table.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
