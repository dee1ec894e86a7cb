"""Columns made from texts in Python, beside columns that are passed on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch of texts, of which the JVM and a worker hold a few copies each.
BATCH_BYTES = 4 << 20
#: Words of 64 bits of a table of marks: bounds what is broadcast, whatever the input.
MARKS = 1 << 18
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def free_name(name: str, taken) -> str:
    """``name``, with underscores before it until it is none of ``taken``."""
    while name in taken:
        name = "_" + name
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limit for the bytes of an Arrow batch to ``BATCH_BYTES``; Spark's own counts rows, however long
    they are.  A lower limit of the session stays."""
    if int(spark.conf.get(_BATCH_SETTING).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def _place(key: str) -> tuple[Column, Column]:
    """Word and bit of a key in a table of marks."""
    h = F.xxhash64(key)
    return F.pmod(h, F.lit(MARKS)), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")


def with_mark(rows: DataFrame, key: str, keys: DataFrame, mark: str) -> DataFrame:
    """``rows`` with a boolean ``mark``: false if ``key`` is surely not in the column of that name of ``keys``.

    So that of wide rows only those that may have a partner are shuffled to join them with ``keys``, which may be
    many.  The marks, one bit per hash of a key, are broadcast: at most ``MARKS`` rows of two numbers.
    """
    word, bit = _place(key)
    w, b, bits = (free_name(x, rows.columns) for x in ("_word", "_bit", "_bits"))
    ones = F.bit_or(F.expr(f"shiftleft(1L, {b})")).alias(bits)
    marks = keys.select(word.alias(w), bit.alias(b)).groupBy(w).agg(ones)
    placed = rows.withColumns({w: word, b: bit}).join(F.broadcast(marks), w, "left")
    known = F.coalesce(F.bit_get(bits, F.col(b)) == 1, F.lit(False))
    return placed.withColumn(mark, known).select(*rows.columns, mark)


def slices(batches, rows: int = 256):
    """Batches in short slices, so that what is made of few texts is held at a time; unused buffers are given back."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


def with_text_columns(docs: DataFrame, maker, fields: dict, text_col="text", keep=("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and the new ``fields`` (name to type), made a batch of texts at a time.

    ``maker()`` runs once per task; what it returns takes an Arrow array of texts and returns one array
    per field.  Columns go by place, so no name of ``docs`` can be in the way; the text crosses once.
    """
    bounded_batches(docs.sparkSession)
    names, kept = list(fields), [c for c in keep if c != text_col]
    schema = {c: docs.schema[c].dataType.simpleString() for c in (*kept, text_col)}

    def run(batches):
        import pyarrow as pa

        make = maker()
        for batch in batches:
            out = [*batch.columns[1:], *([batch.column(0)] if text_col in keep else []), *make(batch.column(0))]
            yield pa.RecordBatch.from_arrays(out, [f"c{i}" for i in range(len(out))])

    rows = docs.select(F.col(text_col).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)])
    passed = [*kept, *([text_col] if text_col in keep else [])]
    kinds = [*[schema[c] for c in passed], *fields.values()]
    made = rows.mapInArrow(run, ", ".join(f"c{i} {kind}" for i, kind in enumerate(kinds)))
    final = [*passed, *[free_name(n, passed) for n in names]]
    made = made.toDF(*final)
    return made.select(*keep, *final[len(passed) :])
