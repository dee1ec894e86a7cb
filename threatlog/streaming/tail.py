"""Following files that grow.

Spark's file stream takes whole new files.  This Python source remembers a byte offset per
file instead and reads what was appended since, up to the last line break or the end.
"""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_SCHEMA = "line string, source string, seq bigint"
_CHUNK = 64 * 1024 * 1024


class _Piece(InputPartition):
    def __init__(self, path, start, end):
        self.path, self.start, self.end = path, start, end


class TailSource(DataSource):
    """``spark.readStream.format("tail").load(path)``; the path may be a glob on storage all nodes see.

    Option ``start``: ``beginning`` (default) or ``end``.  Option ``unfinished``: with ``true`` a last
    line without a line break is delivered too, as it stands.  A file that got shorter is read again
    from its beginning; one that gets shorter between planning and reading fails the batch, which Spark
    plans again.  ``seq`` is the byte offset of the line.
    """

    @classmethod
    def name(cls):
        return "tail"

    def schema(self):
        return _SCHEMA

    def streamReader(self, schema):
        return _TailReader(self.options)


class _TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self._pattern = options["path"].removeprefix("file:")
        self._start = options.get("start", "beginning")
        if self._start not in ("beginning", "end"):
            raise ValueError("start has to be 'beginning' or 'end'")
        self._unfinished = str(options.get("unfinished", "false")).lower() == "true"

    def _sizes(self):
        return {path: os.path.getsize(path) for path in sorted(glob.glob(self._pattern)) if os.path.isfile(path)}

    def initialOffset(self):
        if self._start == "beginning":
            return {}
        return {path: _last_break(path, 0, size) for path, size in self._sizes().items()}

    def latestOffset(self):
        """Each file's size, cut back to its last line break unless unfinished lines are wanted."""
        if self._unfinished:
            return self._sizes()
        return {path: _last_break(path, 0, size) for path, size in self._sizes().items()}

    def partitions(self, start, end):
        pieces = []
        for path, size in end.items():
            begin = start.get(path, 0)
            if size < begin:
                begin = 0
            # A large growth is cut at line breaks, so that several tasks share it.
            while begin < size:
                stop = size if size - begin <= _CHUNK else _next_break(path, begin + _CHUNK, size)
                pieces.append(_Piece(path, begin, stop))
                begin = stop
        return pieces

    def read(self, partition):
        with open(partition.path, "rb") as file:
            file.seek(partition.start)
            at = partition.start
            while at < partition.end:
                data = file.readline()
                if not data:
                    raise OSError(f"{partition.path} became shorter while it was read")
                data = data[: partition.end - at]
                yield data.decode("utf-8", errors="replace").rstrip("\r\n"), partition.path, at
                at += len(data)


def _last_break(path, start, end, block=65536):
    """The offset after the last line break in ``start..end``, or ``start`` without one."""
    with open(path, "rb") as file:
        at = end
        while at > start:
            low = max(start, at - block)
            file.seek(low)
            found = file.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return start


def _next_break(path, start, end, block=65536):
    """The offset after the first line break from ``start`` on, or ``end`` without one."""
    with open(path, "rb") as file:
        file.seek(start)
        at = start
        while at < end:
            found = file.read(min(block, end - at))
            if not found:
                break
            if b"\n" in found:
                return at + found.index(b"\n") + 1
            at += len(found)
    return end


def tail_logs(spark: SparkSession, path: str, start: str = "beginning", unfinished: bool = False) -> DataFrame:
    """Growing files as a stream of ``line, source, seq``."""
    spark.dataSource.register(TailSource)
    options = {"start": start, "unfinished": str(unfinished).lower()}
    return spark.readStream.format("tail").options(**options).load(path)
