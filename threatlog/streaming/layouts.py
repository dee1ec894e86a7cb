"""Finding the layout of a log while it streams in.

The first lines are kept back until enough of them came, then the layout is found on them, and they go
on before the lines that follow.  What was found is a state of the checkpoint: later micro-batches, and
later runs, read it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..operators.layout import infer_layout
from ..operators.parse import DelimitedLayout, parse_logs
from ..session import folder_names, remove_folder, staged

#: Filled lines that a layout is found on.
LAYOUT_LINES = 15
_HELD = "line string, source string, seq bigint"


class PrefixLayout:
    """The layout of a stream, found on its first ``sample_lines`` filled lines; state is kept in ``folder``.

    While fewer have come, lines are kept back in a table and no micro-batch delivers any; those still kept
    back when a stream stops wait for the next run.  An epoch that is run again sees the state of the
    epochs before it, so it decides alike.
    """

    def __init__(self, folder: str, sample_lines: int = LAYOUT_LINES, strict_compat: bool = False):
        if sample_lines < 1:
            raise ValueError("at least one line is needed to find a layout")
        self._folder, self._sample, self._strict = folder, sample_lines, strict_compat

    def settle(self, batch: DataFrame, epoch: int) -> tuple[DataFrame, DelimitedLayout | str | None]:
        """The lines that go on in this epoch, as ``line, source, seq``, and their layout."""
        spark = batch.sparkSession
        lines = batch.select("line", "source", F.coalesce("seq", F.monotonically_increasing_id()).alias("seq"))
        earlier = sorted(int(e) for e in folder_names(spark, f"{self._folder}/found") if int(e) < epoch)
        if earlier:
            return lines, self._read(spark, earlier[0])
        held = staged(self._after(self._held(spark, epoch), lines), path=f"{self._folder}/held/{epoch}")
        remove_folder(spark, f"{self._folder}/held/{epoch - 2}")
        raw = stripped(F.col("line"))
        filled = held.where((raw != "") & ~raw.startswith("#"))
        if filled.limit(self._sample).count() < self._sample:
            return held.limit(0), None
        layout = infer_layout(filled, self._sample, self._strict)
        self._write(spark, layout, epoch)
        return held, layout

    def _held(self, spark, epoch):
        if str(epoch - 1) not in folder_names(spark, f"{self._folder}/held"):
            return spark.createDataFrame([], _HELD)
        return spark.read.schema(_HELD).parquet(f"{self._folder}/held/{epoch - 1}")

    def _after(self, held, lines):
        """Lines of a later epoch come after those kept back, whatever their own numbers."""
        last = held.agg(F.max("seq")).first()[0]
        if last is None:
            return lines
        first = lines.agg(F.min("seq")).first()[0] or 0
        return held.unionByName(lines.withColumn("seq", F.col("seq") + F.lit(max(0, last + 1 - first))))

    def _write(self, spark, layout, epoch):
        told = asdict(layout) if isinstance(layout, DelimitedLayout) else layout
        spark.createDataFrame([(json.dumps(told),)], "layout string").coalesce(1).write.mode("overwrite").parquet(
            f"{self._folder}/found/{epoch}"
        )

    def _read(self, spark, epoch):
        told = json.loads(spark.read.schema("layout string").parquet(f"{self._folder}/found/{epoch}").first()[0])
        return DelimitedLayout(**told) if isinstance(told, dict) else told


def start_entries(
    lines: DataFrame,
    as_of: datetime,
    out: str,
    checkpoint: str,
    layout_lines: int = LAYOUT_LINES,
    trigger: dict | None = None,
    select: Callable[[DataFrame], DataFrame] | None = None,
    **parse_options,
):
    """Parse streaming ``line, source, seq`` by the layout of its first lines; returns the streaming query.

    Every micro-batch writes its entries (or what ``select`` makes of them) as Parquet to ``out/epoch=N``,
    and overwrites them when it is run again.  The first lines are in it, with the first batch that is parsed.
    """
    prefix = PrefixLayout(f"{checkpoint}/layout", layout_lines, parse_options.get("strict_compat", False))

    def run(batch: DataFrame, epoch: int) -> None:
        settled, layout = prefix.settle(batch, epoch)
        entries = parse_logs(settled, as_of=as_of, layout=layout, **parse_options)
        (select(entries) if select else entries).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return (
        lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
