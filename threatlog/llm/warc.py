"""WARC archives of pages, and a reader that salvages damaged ones.

Each page is one record: a response, or a revisit of the response with the same payload.  Archives are
plain records written by Spark's text writer, so they go to whatever store Spark writes to; the separator
of its lines is the record's own end.  The reader takes plain archives and such of gzip members.  Where a
record fails its checks, it searches for the next version line or member that holds, goes on there, and
logs the bytes between as a quarantined gap.  In the content of a member, also of what a damaged or cut-off one
still gives, it does the same.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .texts import bounded_batches, slices, with_mark

END = b"\r\n\r\n"
#: Bytes of payloads in an archive file; only a payload above :data:`CLASSES` has a larger one, to itself.
FILE_BYTES = 32 << 20
#: Pages are written by classes of payload bytes, each with as many records a file as the largest ones may fill.
CLASSES = (16 << 10, 256 << 10, 4 << 20)
#: Revisits of a file; a revisit has no payload.
REVISITS = 1 << 15
_DATE = "2026-01-01T00:00:00Z"
_GZIP = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _pages(pages: DataFrame, id_col, body_col) -> DataFrame:
    """``id``, ``payload``, ``sha1`` (20 bytes)."""
    payload = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), payload.alias("payload"))
    return rows.withColumn("sha1", F.unhex(F.sha1("payload")))


def revisits_of(slim: DataFrame) -> DataFrame:
    """``id``, ``sha1``, ``refers_to``: rows with the payload of a row with a larger id, the largest such id.

    A row with a null id is a response and nobody's referent.  Rows repeated with the largest id are all responses.
    """
    named = slim.select("id", "sha1").where(F.col("id").isNotNull()).distinct()
    last = named.groupBy("sha1").agg(F.max("id").alias("refers_to"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return named.join(last, "sha1").where(F.col("id") < F.col("refers_to")).select("id", "sha1", "refers_to")


def record(page_id, payload: bytes | None, payload_digest: str, refers_to=None, uri: str = "", size: int | None = None) -> bytes:
    """One record without its closing line ends; a revisit needs no payload, but the size of its full one."""
    http = _HTTP % (len(payload) if size is None else size)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}",
    ]
    if uri:
        head.insert(4, "WARC-Target-URI: " + re.sub(r"\s+", "%20", uri))
    if refers_to is not None:
        head.insert(4, f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.insert(5, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode("utf-8") + END + block


def write_archives(pages: DataFrame, path: str, id_col="page_id", body_col="html") -> None:
    """Write the pages' records as plain WARC files below ``path``, each of at most about :data:`FILE_BYTES` of payloads.

    A null body is an empty payload.  Ids and digests alone are grouped and joined.  Payloads stay where they are
    read: a table of marks tells rows that are no revisit, a second one those that the first marks without need;
    only rows that both mark are joined by id.  Revisits are written from the table of digests.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = _pages(pages, id_col, body_col)
    size = F.octet_length("payload")
    tag = F.xxhash64("id", "sha1")
    slim = staged(rows.select("id", "sha1", size.alias("bytes"), tag.alias("tag")))
    revisits = staged(revisits_of(slim).withColumn("tag", tag))
    needless = with_mark(slim, "tag", revisits.select("tag"), "marked").where("marked").drop("marked")
    needless = staged(needless.join(revisits.drop("tag", "refers_to"), ["id", "sha1"], "left_anti").select("tag").distinct())

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 64):
            made = []
            for row in batch.to_pylist():
                said = base64.b32encode(row["sha1"]).decode("ascii")
                made.append(record(row["id"], row["payload"], said, row["refers_to"], size=row["bytes"]))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    def write(found, name, per_file):
        columns = [found["id"], found["payload"], found["sha1"], found["bytes"], found["refers_to"]]
        # The cast keeps the bytes as they are.
        lines = found.select(*columns).mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
        writer = lines.write.mode("overwrite").option("maxRecordsPerFile", per_file)
        writer.option("lineSep", END.decode("ascii")).text(f"{path}/{name}")

    bare = slim.drop("tag").join(revisits.drop("tag"), ["id", "sha1"])
    write(bare.withColumn("payload", F.lit(None).cast("binary")), "revisits", REVISITS)
    nobody = F.lit(None).cast(rows.schema["id"].dataType)
    some_open = not needless.isEmpty()
    known = [r["c"] for r in slim.groupBy(_class(F.col("bytes")).alias("c")).count().collect()]
    for number in sorted({0, *known}):
        of_class = rows.withColumns({"bytes": size, "tag": tag}).where(_class(size) == number)
        of_class = with_mark(of_class, "tag", revisits.select("tag"), "maybe")
        of_class = with_mark(of_class, "tag", needless, "open")
        undecided = of_class.where("maybe and open").join(revisits.drop("tag", "refers_to"), ["id", "sha1"], "left_anti")
        responses = of_class.where("not maybe").drop("maybe", "open")
        if some_open:
            responses = responses.unionByName(undecided.drop("maybe", "open"))
        largest = CLASSES[number] if number < len(CLASSES) else FILE_BYTES
        write(responses.withColumn("refers_to", nobody), f"responses-{number}", FILE_BYTES // largest)


def _class(size):
    """The place of a size in :data:`CLASSES`."""
    number = F.lit(len(CLASSES))
    for place in reversed(range(len(CLASSES))):
        number = F.when(size <= CLASSES[place], place).otherwise(number)
    return number


class _Bad(Exception):
    """A record that fails a check."""


def _head(data, at: int):
    """Header fields of the record at ``at`` and where its block starts."""
    if not _VERSION.match(data, at):
        raise _Bad("no version line")
    end = data.find(END, at)
    if end < 0:
        raise _Bad("no end of the header")
    fields = {}
    for line in bytes(data[at:end]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Bad("a header line without a colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return fields, end + len(END)


def _record(data, at: int):
    """Fields, block and end of the record at ``at``; raises :class:`_Bad` where a check fails."""
    fields, start = _head(data, at)
    length = fields.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        raise _Bad("no length")
    end = start + int(length)
    if data[end : end + len(END)] != END:
        raise _Bad("the record does not end where it should")
    block = bytes(data[start:end])
    said = fields.get("warc-block-digest", "").removeprefix("sha1:")
    if said and said != digest(block):
        raise _Bad("block digest")
    return fields, block, end + len(END)


def _member(data, at: int):
    """What the gzip member at ``at`` gives, its end, and what is wrong with it (empty if nothing)."""
    unzip, parts, to, step = zlib.decompressobj(31), [], at, 65_536
    while not unzip.eof and to < len(data):
        before = unzip.copy()
        try:
            parts.append(unzip.decompress(data[to : to + step]))
            to += step
        except zlib.error as error:
            if step == 1:
                return b"".join(parts), None, str(error)
            # What comes before the damage is got in shorter steps.
            unzip, step = before, step // 16
    if not unzip.eof:
        return b"".join(parts), None, "a member without an end"
    return b"".join(parts), min(to, len(data)) - len(unzip.unused_data), ""


def _records(content):
    """Yield ("record", offset, end, fields, block) and ("gap", offset, end, reason) over plain content."""
    at, gap, reason, n = 0, None, "", len(content)
    while at < n:
        try:
            fields, block, end = _record(content, at)
        except _Bad as bad:
            if gap is None:
                gap, reason = at, str(bad)
            line = _VERSION.search(content, at + 1)
            at = line.start() if line else n
            continue
        if gap is not None:
            yield "gap", gap, at, reason
            gap = None
        yield "record", at, end, fields, block
        at = end
    if gap is not None:
        yield "gap", gap, n, reason


def salvage(data: bytes):
    """Yield ("record", offset, fields, block) and ("gap", offset, end, reason) over an archive's bytes.

    Offsets are of the file, for records of a member that of the member.  Every byte lies in exactly one record,
    sound member or gap.  Gaps in the content of a member are ("inner_gap", the member's offset, its end, reason with the
    place in the content); of a damaged member, which is a gap, all records that pass their checks are yielded too.
    """
    at, gap, reason, member = 0, None, "", -1
    n = len(data)
    while at < n:
        if data[at : at + 3] == _GZIP:
            content, end, wrong = _member(data, at)
            found = []
            for kind, a, b, *rest in _records(content):
                if kind == "record":
                    found.append(("record", at, *rest))
                else:
                    found.append(("inner_gap", at, end or n, f"bytes {a} to {b} of the content: {rest[0]}"))
        else:
            try:
                fields, block, end = _record(data, at)
                found, wrong = [("record", at, fields, block)], ""
            except _Bad as bad:
                found, wrong = [], str(bad)
        if wrong:
            if any(x[0] == "record" for x in found):
                yield from found
            if gap is None:
                gap, reason = at, wrong
            line = _VERSION.search(data, at + 1)
            if -1 < member <= at or member == -1:
                member = data.find(_GZIP, at + 1)
                member = n if member < 0 else member
            at = min(line.start() if line else n, member)
            continue
        if gap is not None:
            yield "gap", gap, at, reason
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield "gap", gap, n, reason


def _payload(fields, block: bytes):
    """Digest and length of the full payload, for revisits as their HTTP header says."""
    head, _, body = block.partition(END)
    if fields.get("warc-type") == "revisit":
        said = re.search(rb"(?im)^content-length:[ ]*([0-9]+)", head)
        return fields.get("warc-payload-digest", "").removeprefix("sha1:"), int(said.group(1)) if said else None
    return digest(body), len(body)


def read_archives(spark, path: str, payloads: bool = False) -> DataFrame:
    """One row per record or gap of all archives below ``path``.

    ``kind`` (record, gap, inner_gap), ``file``, ``offset``, ``gap_end``, ``reason`` (gaps), ``record_type``,
    ``record_id``, ``refers_to``, ``payload_digest``, ``payload_bytes`` and, on request, ``payload``.
    A task holds one file and the content of one member, so these bound its memory; Spark reads files of less than 2 GB.
    """
    bounded_batches(spark)
    schema = "kind string, file string, offset bigint, gap_end bigint, reason string, record_type string, record_id string, "
    schema += "refers_to string, payload_digest string, payload_bytes bigint, payload binary"
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def rows(file, data):
        for kind, offset, *rest in salvage(data):
            if kind != "record":
                yield kind, file, offset, rest[0], rest[1], None, None, None, None, None, None
                continue
            fields, block = rest
            hashed, size = _payload(fields, block)
            body = block.partition(END)[2] if payloads and fields.get("warc-type") != "revisit" else None
            ids = [x[1:-1] if x and x[0] == "<" else x for x in map(fields.get, ("warc-record-id", "warc-refers-to"))]
            yield kind, file, offset, None, None, fields.get("warc-type"), *ids, hashed, size, body

    def run(batches):
        import pyarrow as pa

        texts, numbers = pa.string(), pa.int64()
        kinds = [texts, texts, numbers, numbers, texts, texts, texts, texts, texts, numbers, pa.binary()]

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for batch in batches:
            for file, data in zip(batch.column(0), batch.column(1)):
                out, held = [], 0
                for row in rows(file.as_py(), data.as_py()):
                    out.append(row)
                    held += len(row[-1] or b"")
                    if len(out) >= 500 or held > FILE_BYTES:
                        yield batch_of(out)
                        out, held = [], 0
                if out:
                    yield batch_of(out)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, schema)


def archived_pages(pages: DataFrame, path: str, id_col="page_id", body_col="html") -> DataFrame:
    """Write the pages as archives and read them back: id, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``."""
    write_archives(pages, path, id_col, body_col)
    kind = pages.schema[id_col].dataType
    number = lambda c: F.when(F.col(c) != "urn:page:", F.substring(c, 10, 30)).cast(kind)
    read = read_archives(pages.sparkSession, path).where("kind = 'record'")
    return read.select(
        number("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"),
    )
