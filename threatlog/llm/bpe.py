"""Byte-pair encoding and decoding of whole texts.

A pre-token is a doubly linked list of symbols.  A priority queue holds the possible merges by
rank, then place; a popped merge is skipped when one of its symbols has changed since (a stale
entry).  So a pre-token of n bytes costs O(n log n), however long it is.  Decoding looks each id
up and joins the vocabulary strings, with blanks as the file names no decoder.
"""

from __future__ import annotations

import hashlib
from array import array
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytelevel import BoundedCache, Cutter, byte_letters, kept_in_worker, vocabulary

#: Chunks, and a quarter as many pre-tokens, that a worker keeps encoded (about 250 MB).
CACHED = 1_000_000


class BytePairCoder:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        self.cutter = Cutter(path)
        vocab, suffix = self.cutter.model["vocab"], self.cutter.model["end_of_word_suffix"] or ""
        self._merges = {}
        for rank, (left, right) in enumerate(self.cutter.model["merges"]):
            self._merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        letters = byte_letters()
        self._inner = [vocab[x] for x in letters]
        self._last = [vocab[x + suffix] for x in letters]
        size = 1 + max([*vocab.values(), *self.cutter.specials.values()])
        self.strings = [""] * size
        for text, number in [*vocab.items(), *self.cutter.specials.items()]:
            self.strings[number] = text
        self._merged = BoundedCache(lambda word: array("I", self.merge(word)).tobytes(), CACHED // 4)
        self._encoded = BoundedCache(self._chunk, CACHED)

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self._merged.__getitem__, self.cutter.pretokens(chunk)))

    def merge(self, pretoken: str) -> list[int]:
        """The ids of one pre-token."""
        raw = pretoken.encode("utf-8")
        ids = [self._inner[b] for b in raw]
        ids[-1] = self._last[raw[-1]]
        n, merges = len(ids), self._merges
        if n == 1:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapify(queue)
        while queue:
            _, i, left, right, merged = heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get((merged, ids[k]))
                if found:
                    heappush(queue, (found[0], i, merged, ids[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((ids[h], merged))
                if found:
                    heappush(queue, (found[0], h, ids[h], merged, found[1]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of a text as unsigned 32-bit integers of this machine's byte order (little-endian)."""
        parts, encoded = [], self._encoded.__getitem__
        for stretch, special in self.cutter.stretches(text):
            parts.extend(map(encoded, self.cutter.chunks(stretch)))
            if special is not None:
                parts.append(array("I", [special]).tobytes())
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of encoded ids, joined."""
        return " ".join(map(self.strings.__getitem__, array("I", ids)))


def coder(path: str) -> BytePairCoder:
    """The worker's coder of a vocabulary file."""
    return kept_in_worker(("bpe", path), lambda: BytePairCoder(path))


def bpe_encode(docs: DataFrame, id_col="doc_id", text_col="text", path: str | None = None) -> DataFrame:
    """One row per document: its id, ``ids`` (array of int) and ``decoded`` text.

    A null text counts as empty: no ids, empty decoded text.  Rows with the same id are separate
    documents; a null id stays null.  Other columns of ``docs`` are not read.  Nothing is shuffled;
    memory is one Arrow batch of texts and a bounded cache.
    """
    path = path or vocabulary("word_bpe_49k.json")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bpe = coder(path)
        for batch in batches:
            for part in _slices(batch):
                encoded = [bpe.encode(x or "") for x in part.column(1).to_pylist()]
                ends = np.cumsum([0] + [len(x) // 4 for x in encoded], dtype=np.int64)
                values = pa.array(np.frombuffer(b"".join(encoded), np.int32))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                decoded = pa.array([bpe.decode(x) for x in encoded], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, decoded], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def bpe_digests(docs: DataFrame, id_col="doc_id", text_col="text", path: str | None = None) -> DataFrame:
    """The digests of :func:`bpe_encode`, made where the ids are: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    The same rows and rules; ids and decoded texts do not leave the worker.
    """
    path = path or vocabulary("word_bpe_49k.json")

    def run(batches):
        import pyarrow as pa

        bpe = coder(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)]
            columns[2:] = [c.cast(pa.string()) for c in columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def _slices(batch, rows: int = 256):
    """A batch in short slices, so that decoded texts of few rows are held at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
