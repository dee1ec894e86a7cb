"""The report while lines keep coming: a view that each micro-batch adds to.

What a report needs of a log are its counted groups (:mod:`threatlog.operators.groups`), and groups of two parts
of a log add up to those of both.  So a micro-batch is counted alone, as a run of groups of its own, and nothing
that older lines gave is counted or rewritten for it.  Every eighth run is written together with the seven
before it, every eighth of such runs again, and so on: after n batches there are at most seven runs of each size,
and a group was rewritten at most once per size, that is log8(n) times.

A report merges the committed runs and goes on as over a log: summary, threats, levels and score are those of one
batch analysis over all lines so far, in whatever order they came.

Below the folder, ``runs/<first>-<last>`` holds the groups of these epochs, ``commits/<epoch>`` says that
the epoch is complete.  Readers see committed epochs alone.  An epoch that is run again after a failure writes the
same runs anew, or nothing if it was committed.  Runs that no longer count are kept for one epoch, for readers.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.groups import bounded, columns, merged, partial_groups
from ..operators.parse import parse_logs
from ..operators.windows import numbered_within
from ..plans.analysis import Analysis
from ..session import create_marker, folder_names, no_rows
from .runs import merged_into, remove_old_runs, run_path, runs_of

class LiveReport:
    """A report in a folder, kept up by a stream; one folder belongs to one checkpoint."""

    def __init__(
        self, spark: SparkSession, folder: str, as_of: datetime, rules=None, thresholds=None, counters=None,
        in_order: bool = False, **parse_options,
    ):
        """``in_order``: ``seq`` orders the lines of the whole stream; else lines count in the order they come.

        ``rules``, ``thresholds``, ``counters`` and ``parse_options`` are those of :class:`Analysis`.
        """
        self.spark, self.folder, self.in_order = spark, folder.rstrip("/"), in_order
        self._options = {"as_of": as_of, "rules": rules, "thresholds": thresholds, "counters": counters}
        self._parse_options = parse_options
        self._plan = Analysis(None, **self._options)

    def start(self, lines: DataFrame, checkpoint: str, trigger: dict | None = None):
        """Start counting streaming ``line, source, seq``; returns the streaming query."""
        return (
            lines.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start()
        )

    def committed(self) -> int:
        """The number of epochs that the report holds."""
        return max((int(name) + 1 for name in folder_names(self.spark, f"{self.folder}/commits")), default=0)

    def update(self, batch: DataFrame, epoch: int) -> None:
        """Add a micro-batch."""
        if epoch < self.committed():
            return
        if not self.in_order:
            batch = self._in_arrival_order(batch, epoch)
        every = parse_logs(batch, as_of=self._options["as_of"], keep_dropped=True, **self._parse_options)
        groups = partial_groups(every, self._plan.rules, self._plan.counters)
        run, older = merged_into(epoch)
        groups = groups.unionByName(self._read(older))
        bounded(merged(groups)).write.mode("overwrite").partitionBy("kind").parquet(self._path(run))
        create_marker(self.spark, f"{self.folder}/commits/{epoch:012d}")
        remove_old_runs(self.spark, f"{self.folder}/runs", epoch)

    def analysis(self) -> Analysis:
        """The analysis of all committed lines; take it anew to see later ones."""
        return Analysis.of_groups(self._read(runs_of(self.committed())), **self._options)

    def _in_arrival_order(self, batch, epoch):
        before = self._read(runs_of(epoch)).where("kind = 'line'").agg(F.sum("n")).first()[0] or 0
        seq = F.coalesce("seq", F.monotonically_increasing_id())
        rows = batch.withColumns({"seq": seq, "_all": F.lit(0)})
        numbered = numbered_within(rows, ["_all"], "_number")
        return numbered.withColumn("seq", F.col("_number") + before).select(*batch.columns)

    def _path(self, run) -> str:
        return run_path(f"{self.folder}/runs", run)

    def _read(self, runs) -> DataFrame:
        types = columns(len(self._plan.counters), self._plan.rules.free_text)
        schema = ", ".join(f"`{name}` {kind}" for name, kind in types.items())
        found = no_rows(self.spark, schema)
        for run in runs:
            found = found.unionByName(self.spark.read.schema(schema).parquet(self._path(run)).select(*types))
        return found
