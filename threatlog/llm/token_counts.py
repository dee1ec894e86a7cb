"""Token counts by a two-tier lookup beside the texts.

Tier one is a compact table, pre-token to number of tokens, of the most frequent pre-tokens; it is
broadcast.  What it lacks is encoded by the library once and kept in the worker's bounded cache.
No pre-token of a text is shuffled.  The table changes only the speed, never a count.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytelevel import BoundedCache, Cutter, kept_in_worker, spelled, vocabulary

#: A task names the pre-tokens that make up one in so many of its own, so at most as many.  One with
#: that share of the corpus has it in at least one task, and is not missed.
SHARE = 4096
#: Entries of the broadcast table and characters of its keys: at most 16384 * 32 characters, about 2 MB.
TABLE, KEY_CHARS = 16_384, 32
CACHED = 1_000_000


class TokenCounter:
    """Counts the tokens of texts; ``table`` is tier one, for pre-tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.cutter, self.table = Cutter(path), {}
        self._model = Tokenizer.from_file(path).model
        self._encoded = BoundedCache(lambda x: len(self._model.tokenize(spelled(x))), CACHED // 4)
        self._chunks = BoundedCache(self._chunk, CACHED)

    def length(self, pretoken: str) -> int:
        """The number of tokens of a pre-token: from the table, or encoded and kept."""
        known = self.table.get(pretoken)
        return self._encoded[pretoken] if known is None else known

    def _chunk(self, chunk: str) -> int:
        return sum(map(self.length, self.cutter.pretokens(chunk)))

    def count(self, text: str) -> int:
        total, first, second = 0, self.table.get, self._chunks.__getitem__
        for stretch, special in self.cutter.stretches(text):
            # Most chunks are one frequent pre-token; the others go to the worker's cache.
            total += sum([n if (n := first(x)) is not None else second(x) for x in self.cutter.chunks(stretch)])
            total += special is not None
        return total


def _counter(path: str) -> TokenCounter:
    return kept_in_worker(("count", path), lambda: TokenCounter(path))


def frequent_pretokens(docs: DataFrame, text_col="text", path: str | None = None) -> DataFrame:
    """The most frequent pre-tokens of all texts: ``pretoken``, ``n_tokens``; at most ``TABLE`` rows.

    Each task counts all its texts and passes on only those with a share of 1/``SHARE`` or more, so
    the rows that are added up are few per task.  Empty or null texts name none.
    """
    path = path or vocabulary("byte_bpe_50k.json")

    def run(batches):
        import pyarrow as pa

        counter, seen, total = _counter(path), Counter(), 0
        for batch in batches:
            for text in batch.column(0):
                for stretch, _ in counter.cutter.stretches(text.as_py() or ""):
                    found = counter.cutter.chunks(stretch)
                    total += len(found)
                    seen.update(found)
            if len(seen) > 40 * SHARE:
                # What is below half the share so far may be counted short; that only leaves it out of the table.
                seen = Counter({k: v for k, v in seen.items() if 2 * SHARE * v >= total})
        whole = (k for k, v in seen.items() if SHARE * v >= total and len(k) <= KEY_CHARS)
        rows = [(k, seen[k]) for k in whole if type(k) is str and counter.cutter.pretokens(k) == [k]]
        if rows:
            words = [k for k, _ in rows]
            columns = [pa.array(words), pa.array([v for _, v in rows]), pa.array([counter.length(x) for x in words])]
            yield pa.RecordBatch.from_arrays(columns, ["pretoken", "n", "n_tokens"])

    named = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "pretoken string, n bigint, n_tokens bigint")
    summed = named.groupBy("pretoken", "n_tokens").agg(F.sum("n").alias("n"))
    return summed.orderBy(F.desc("n"), "pretoken").limit(TABLE).select("pretoken", "n_tokens")


def count_tokens(docs: DataFrame, id_col="doc_id", text_col="text", path: str | None = None, limit=1024) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    A null text counts as empty (0, 0, false).  Special strings in a text are one token each, as the
    library's default has it.  Repeated ids are separate rows; other columns are not read.
    """
    path = path or vocabulary("byte_bpe_50k.json")
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast({r[0]: r[1] for r in frequent_pretokens(docs, text_col, path).collect()})

    def run(batches):
        import pyarrow as pa

        counter = _counter(path)
        counter.table = table.value
        for batch in batches:
            sizes, counts = [], []
            for scalar in batch.column(1):
                text = scalar.as_py() or ""
                sizes.append(len(text.encode("utf-8")))
                counts.append(counter.count(text))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
