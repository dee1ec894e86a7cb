"""Byte-level byte-pair encoding by a rank file, with the tiktoken library, and decoding to raw bytes.

The library cuts a text with its pattern and merges each match.  Its pattern engine keeps a stack that a very
long text can exhaust, so long texts are cut first, at places where the pattern surely ends a match:

* between a letter, digit, mark, sign or symbol and the blank behind it: no match goes from one to the other;
* behind a long row of blanks, before the last of them: the pattern leaves that one to what follows, and the row
  before it is one match, given to the library's merging without the pattern.

What follows such a place is matched as in the whole text, as the pattern never looks back.  So ids are those of
the whole text.  Decoding joins the byte strings of the ids; half a character is nothing special there.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytelevel import kept_in_worker, vocabulary
from .texts import bounded_batches, slices

#: Characters of a part that goes to the library at once; longer parts are only rows of letters, digits or signs.
PART = 1 << 16
#: Blanks in a row from which they are cut off by themselves; far below what the pattern engine can hold.
BLANKS = 1 << 12
#: Fixed value: the characters of the Unicode property White_Space, which is what the library's pattern engine calls a blank.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=2)
def _places(part: int, blanks: int):
    import regex

    # Old blanks and the categories of everything printed: no Unicode version calls a member of one the other.
    safe = regex.compile(r"(?<=[\p{L}\p{M}\p{N}\p{P}\p{S}])(?=[ \t\n\r])")
    row = regex.compile("[%s]{%d,}" % (WHITE, blanks))
    return safe, row


def parts(text: str, part: int = PART, blanks: int = BLANKS):
    """Yield (piece of the text, whether it is one match of the pattern); joined, the pieces are the text."""
    if len(text) <= min(part, blanks):
        yield text, False
        return
    safe, row = _places(part, blanks)
    at, n = 0, len(text)
    while at < n:
        found = row.search(text, at)
        until = found.start() if found else n
        while until - at > part:
            place = safe.search(text, at + part, until)
            if place is None:
                break
            yield text[at : place.start()], False
            at = place.start()
        if until > at:
            yield text[at:until], False
        if not found:
            return
        # A row at the text's end is one match; else its last blank belongs to what follows.
        at = found.end() if found.end() == n else found.end() - 1
        yield text[until:at], True


class RankCoder:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        self._library = tiktoken.Encoding(
            path, pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def encode_parts(self, text: str):
        """Yield the ids of a text, a list for each part."""
        for piece, whole in parts(text):
            yield self._library._encode_single_piece(piece) if whole else self._library.encode_ordinary(piece)

    def encode(self, text: str) -> list[int]:
        return [x for ids in self.encode_parts(text) for x in ids]

    def decode(self, ids) -> bytes:
        """The bytes of ids, whether or not they are UTF-8."""
        return self._library.decode_bytes(ids)


def rank_coder(path: str) -> RankCoder:
    """The worker's coder of a rank file."""
    return kept_in_worker(("ranks", path), lambda: RankCoder(path))


def encode_texts(docs: DataFrame, id_col="doc_id", text_col="text", path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: its id and ``ids`` (array of int).

    A null text counts as empty: no ids.  Strings of special tokens are ordinary text.  Repeated rows and ids are
    separate; a null id stays null; a table without rows gives none.  Other columns of ``docs`` are not read, so
    their names don't matter.  Nothing is shuffled; a task holds one Arrow batch bounded by bytes.
    """
    bounded_batches(docs.sparkSession)
    path = path or vocabulary("byte_bpe_multi_50k.tiktoken")

    def run(batches):
        import pyarrow as pa

        coder = rank_coder(path)
        for batch in slices(batches):
            ids = pa.array([coder.encode(text.as_py() or "") for text in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").toDF(id_col, "ids")


def decode_ids(rows: DataFrame, id_col="doc_id", ids_col="ids", path: str | None = None) -> DataFrame:
    """One row per row of ``rows``: its id and ``decoded`` (binary), the joined bytes of its ids.

    Null ids arrays decode to no bytes, as empty ones do; null elements count as no id.  An id that the rank file lacks
    is an error.  Decoded bytes need not be UTF-8.
    """
    bounded_batches(rows.sparkSession)
    path = path or vocabulary("byte_bpe_multi_50k.tiktoken")

    def run(batches):
        import pyarrow as pa

        coder = rank_coder(path)
        for batch in slices(batches):
            decoded = [coder.decode([x for x in ids.as_py() or () if x is not None]) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], ["id", "decoded"])

    kind = rows.schema[id_col].dataType.simpleString()
    narrow = rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return narrow.mapInArrow(run, f"id {kind}, decoded binary").toDF(id_col, "decoded")


def encoding_digests(docs: DataFrame, id_col="doc_id", text_col="text", path: str | None = None) -> DataFrame:
    """``n_tokens``, ``ids_sha256`` (decimal ids joined by commas), ``decoded_sha256`` (decoded bytes) of each text.

    The rows and rules of :func:`encode_texts` and :func:`decode_ids`; a text's ids and bytes are hashed a part at a
    time where they are made, and do not leave the worker.
    """
    bounded_batches(docs.sparkSession)
    path = path or vocabulary("byte_bpe_multi_50k.tiktoken")

    def run(batches):
        import pyarrow as pa

        coder = rank_coder(path)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in batch.column(1):
                n, listed, decoded = 0, hashlib.sha256(), hashlib.sha256()
                for ids in coder.encode_parts(text.as_py() or ""):
                    if ids:
                        listed.update(("," if n else "").encode() + ",".join(map(str, ids)).encode())
                        decoded.update(coder.decode(ids))
                        n += len(ids)
                counts.append(n)
                of_ids.append(listed.hexdigest())
                of_bytes.append(decoded.hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return made.toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")
