"""Packing of tokenised documents into windows, by Karmarkar-Karp multiway differencing.

Full windows are cut from a document where it is tokenised.  What is left of it is cut into pieces of
at most ``PIECE`` ids, and about ``GROUP`` pieces are shared out among k windows: each
piece starts as a partition of k sums with one filled; the two partitions with the largest spread
are merged, the largest sum of one with the smallest of the other, until one is left.  k starts at the
least possible number and rises while a window is over capacity.
"""

from __future__ import annotations

import zlib
from array import array
from heapq import heapify, heappop, heapreplace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .bytelevel import BoundedCache, Cutter, kept_in_worker, spelled, vocabulary
from .texts import bounded_batches, slices

CAPACITY = 4096
#: Longest piece of what is left of a document: at a quarter of a window, differencing levels them well.
PIECE = 1024
#: Pieces of less than a window that are packed together, on average; bounds the task's memory and its k.
GROUP = 2000
#: Chunks and pre-tokens that a worker keeps encoded (about 60 MB).
CACHED = 300_000

_PIECES = "array<struct<start: bigint, length: int, crc: bigint>>"


class Tokens:
    """Ids of texts by the tokenizers library; words seen before come from a bounded cache."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.cutter = Cutter(path)
        # The library has the model.
        self.cutter.model = None
        model = Tokenizer.from_file(path).model
        self._tokenize = model.tokenize
        self._ids = BoundedCache(self._chunk, CACHED)

    def _chunk(self, chunk: str) -> bytes:
        # Most chunks are one pre-token; the pre-tokens of the others are chunks of their own.
        pretokens = self.cutter.pretokens(chunk)
        if len(pretokens) > 1:
            return b"".join(map(self._ids.__getitem__, pretokens))
        return array("I", [t.id for x in pretokens for t in self._tokenize(spelled(x))]).tobytes()

    def encode(self, text: str, end: int) -> bytes:
        """The ids of a text and ``end`` behind them, as unsigned little-endian 32-bit integers."""
        parts, ids = [], self._ids.__getitem__
        for stretch, special in self.cutter.stretches(text):
            parts.extend(map(ids, self.cutter.chunks(stretch)))
            if special is not None:
                parts.append(array("I", [special]).tobytes())
        parts.append(array("I", [end]).tobytes())
        return b"".join(parts)


def cut(ids: bytes, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of one document: full windows, then pieces of the rest."""
    n = len(ids) // 4
    full = n - n % capacity
    starts = [*range(0, full, capacity), *range(full, n, piece)]
    ends = [*starts[1:], n]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(starts, ends)]


def differencing(lengths: list[int], k: int):
    """Window (0 to k-1) of each piece, by Karmarkar-Karp differencing into k windows, and the k sums."""
    import numpy as np

    # A partition is (-spread, number, sums descending, trees): a tree is a piece or a pair of trees.
    queue = []
    for i, length in enumerate(lengths):
        sums, trees = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], trees[0] = length, i
        queue.append((-length, i, sums, trees))
    heapify(queue)
    pairs, n = [], len(lengths)
    while len(queue) > 1:
        _, number, sums, trees = heappop(queue)
        _, _, others, opposite = queue[0]
        sums = sums + others[::-1]
        opposite = opposite[::-1]
        both = np.flatnonzero((trees >= 0) & (opposite >= 0))
        merged = np.maximum(trees, opposite)
        merged[both] = n + len(pairs) + np.arange(len(both))
        pairs.extend(zip(trees[both].tolist(), opposite[both].tolist()))
        order = np.argsort(-sums, kind="stable")
        sums, merged = sums[order], merged[order]
        heapreplace(queue, (-int(sums[0] - sums[-1]), number, sums, merged))
    _, _, sums, trees = queue[0]
    window, todo = [0] * n, [(t, w) for w, t in enumerate(trees.tolist()) if t >= 0]
    while todo:
        tree, w = todo.pop()
        if tree < n:
            window[tree] = w
        else:
            left, right = pairs[tree - n]
            todo += [(left, w), (right, w)]
    return window, sums.tolist()


def windows(lengths: list[int], capacity: int = CAPACITY):
    """The window of each piece, none over capacity; the number of windows rises until that holds."""
    if not lengths:
        return []
    k = -(-sum(lengths) // capacity)
    while True:
        window, sums = differencing(lengths, k)
        if max(sums) <= capacity:
            return window
        k += 1


def pack(
    docs: DataFrame, id_col="doc_id", text_col="text", path: str | None = None, end_id=2, capacity=CAPACITY
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A null or empty text is the end id alone.  Rows with the same id are separate documents.  A null
    id is packed too.  Other columns are not read.  Texts are read once and not shuffled: only the
    lengths of pieces go to the groups, which are dealt by a running number, so that equal rows spread like others.
    """
    bounded_batches(docs.sparkSession)
    path = path or vocabulary("word_bpe_49k.json")
    kind = docs.schema[id_col].dataType.simpleString()

    def tokenise(batches):
        import pyarrow as pa

        tokens = kept_in_worker(("pack", path), lambda: Tokens(path))
        row = pa.struct([("start", pa.int64()), ("length", pa.int32()), ("crc", pa.int64())])
        for batch in slices(batches, 1024):
            pieces, sizes = [], []
            for text in batch.column(1):
                ids = tokens.encode(text.as_py() or "", end_id)
                sizes.append(len(ids) // 4)
                pieces.append([{"start": a, "length": n, "crc": c} for a, n, c in cut(ids, capacity)])
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(pieces, pa.list_(row))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "doc_tokens", "pieces"])

    def share_out(key, table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by([("id", "ascending"), ("first_crc", "ascending")])
        pieces = table.column("pieces").combine_chunks()
        owner = np.repeat(np.arange(table.num_rows), pieces.value_lengths().to_numpy(False))
        flat = pieces.flatten()
        length = flat.field("length").to_numpy(False).astype(np.int64)
        rest = np.flatnonzero(length < capacity)
        window = np.zeros(len(length), np.int64)
        window[rest] = windows(length[rest].tolist(), capacity)
        used = int(window[rest].max()) + 1 if len(rest) else 0
        full = np.flatnonzero(length == capacity)
        window[full] = used + np.arange(len(full))
        order = np.argsort(window, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        _, first = np.unique(window[order], return_index=True)
        offset = np.empty(len(length), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff([*first, len(order)]))
        take = pa.array(owner)
        return pa.table(
            {
                "id": table.column("id").take(take), "start": flat.field("start"), "length": length,
                "ids_crc32": flat.field("crc"), "doc_tokens": table.column("doc_tokens").take(take),
                "sequence_id": key[0].as_py() * 2**32 + window, "offset": offset,
            }
        )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Written once: the groups' number depends on the pieces, and a task that is run again numbers rows as before.
    cut_up = staged(rows.mapInArrow(tokenise, f"id {kind}, doc_tokens bigint, pieces {_PIECES}"))
    # Of a document's pieces those after the full windows.
    rest = F.ceil(F.pmod("doc_tokens", F.lit(capacity)) / PIECE)
    groups = max(1, -(-(cut_up.agg(F.sum(rest)).first()[0] or 0) // GROUP))
    number = F.xxhash64(F.monotonically_increasing_id())
    dealt = cut_up.withColumns({"first_crc": F.col("pieces")[0]["crc"], "packed_with": F.pmod(number, F.lit(groups))})
    packed = dealt.groupBy("packed_with").applyInArrow(
        share_out,
        f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    )
    return packed.withColumnRenamed("id", id_col)
