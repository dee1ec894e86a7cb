"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def tune(spark: SparkSession) -> SparkSession:
    """Settings the operators like; all can be changed at run time and none changes a result.

    Parsing is a long row of expressions.  Fused into one generated method it passes the 8000
    bytes up to which the JVM compiles a method, so longer ones are left to Spark's split
    projections.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


@contextmanager
def at_most(spark: SparkSession, setting: str, value: int):
    """While this lasts, the session's whole number ``setting`` is at most ``value``; a lower one stays."""
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(before), value)))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def scratch_folder(spark: SparkSession) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which all executors share.

    Where the session names none, a local master gets a local temporary folder; on a cluster, whose
    executors would not see one another's files there, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="threatlog-")
    return f"{root.rstrip('/')}/threatlog-{uuid.uuid4().hex}"


def staged(df: DataFrame, *partition_by: str, path: str | None = None, block_bytes: int | None = None) -> DataFrame:
    """The frame written once as a table in the scratch folder, and read from there.

    For results that several later steps read: they are not computed again, and losing an
    executor loses nothing.  With ``path`` the table there is replaced; ``block_bytes`` bounds what a
    task gathers of its file before it writes it.
    """
    path = path or scratch_folder(df.sparkSession)
    options = {} if block_bytes is None else {"parquet.block.size": block_bytes}
    df.write.options(**options).mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty frame that the optimizer drops from a union; one made from an empty list starts Python workers for it."""
    types = [(f.name, f.dataType) for f in StructType.fromDDL(schema)]
    return spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(kind).alias(name) for name, kind in types])


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder on whatever file system it is; none where there is no folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(target)] if files.exists(target) else []


def create_marker(spark: SparkSession, path: str) -> None:
    """An empty file, which is there at once or not at all."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True).close()
