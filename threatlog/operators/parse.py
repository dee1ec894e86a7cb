"""Lines to entries.

One projection per step, no union per format: a line's format is decided once, then
every field is a ``CASE`` over the format, so only that format's work is done.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    ACCESS_LINE,
    GENERIC_LINE,
    JSON_ALIASES,
    LINE_FLAGS,
    MESSAGE_CHARS,
    SSH_LINE,
    SYSLOG_LINE,
)
from ..functions import times
from ..functions.text import contains_any, first_ip, stripped

ENTRY_COLUMNS = (
    "seq", "source", "format", "raw", "ts", "tz_offset", "ip", "user", "method", "path", "status", "message",
    "ts_read",
)

DROPPED = "dropped"


@dataclass(frozen=True)
class DelimitedLayout:
    """Which column of a delimited log holds what.  A blank delimiter means any run of blanks."""

    delimiter: str
    ip_col: int | None = None
    ts_col: int | None = None
    method_col: int | None = None
    path_col: int | None = None
    status_col: int | None = None
    msg_col: int | None = None


def parse_logs(
    lines: DataFrame,
    as_of: datetime,
    default_year: int | None = None,
    layout: DelimitedLayout | str | None = None,
    strict_compat: bool = False,
    keep_dropped: bool = False,
    columns=None,
) -> DataFrame:
    """``lines(line, source, seq)`` to entries; works on batch and streaming frames.

    ``as_of`` stands in for unreadable times, ``default_year`` (else its year) for missing
    years.  ``layout`` is what :func:`infer_layout` found; only a delimited one changes the
    parsing.  ``strict_compat`` leaves year-less times and delimited date-times with a blank
    unread, as the original tool does.  ``keep_dropped`` keeps blank and comment lines, with
    format ``dropped`` and no fields, for counting and for context.  ``ts_read`` tells whether the
    time is the line's own.  With ``columns`` only these fields are made (next to ``seq`` and
    ``source``), and what no wanted field needs is not computed.
    """
    raw = F.col("raw")
    drop = (raw == "") | raw.startswith("#")
    base = lines.select("seq", "source", stripped(F.col("line")).alias("raw"))
    if not keep_dropped:
        base = base.where(~drop)
    year = default_year or as_of.year
    if isinstance(layout, DelimitedLayout):
        fields = _delimited(base, drop, layout, year, strict_compat)
    else:
        fields = _recognised(base, drop, year, strict_compat)
    read = F.col("ts").isNotNull()
    ts = F.coalesce(F.col("ts"), F.lit(as_of).cast("timestamp_ntz"))
    if keep_dropped:
        ts = F.when(F.col("format") != DROPPED, ts)
    # One record per line, made by a generator: without it the optimizer would copy the whole
    # parsing into every filter or join on a parsed field and push it below, to run twice.
    made = {"ts": ts.alias("ts"), "ts_read": read.alias("ts_read")}
    wanted = ENTRY_COLUMNS[2:] if columns is None else [c for c in ENTRY_COLUMNS[2:] if c in columns]
    named = [made.get(name, F.col(name)) for name in wanted]
    record = F.explode_outer(F.array(F.struct(*named))).alias("record")
    return fields.select("seq", "source", record).select("seq", "source", "record.*")


def parse_quality(lines: DataFrame, **options) -> DataFrame:
    """Lines per format, dropped ones included: ``format, n``."""
    entries = parse_logs(lines, keep_dropped=True, **options)
    return entries.groupBy("format").agg(F.count("*").alias("n"))


# Positions in the array of a line's raw fields.
_TIME, _IP, _USER, _METHOD, _PATH, _STATUS, _MESSAGE = range(7)


def _recognised(base: DataFrame, drop: Column, year: int, strict: bool) -> DataFrame:
    # The steps below are separate projections on purpose (each uses the one before more than
    # once, so they stay apart): as a single one the generated method is too long for the JVM
    # to compile and parsing takes several times as long.
    raw, fmt, fields = F.col("raw"), F.col("format"), F.col("_fields")

    # A JSON line has to be one whole object; inside brackets trailing text is an error too.
    names = [alias for group in JSON_ALIASES.values() for alias in group]
    schema = "array<struct<" + ", ".join(f"`{n}` string" for n in names) + ">>"
    json = F.when(
        raw.startswith("{") & raw.endswith("}"),
        F.from_json(F.concat(F.lit("["), raw, F.lit("]")), schema, {"allowSingleQuotes": "false"}),
    )

    # The leftmost match starts at a word, so looking only there changes nothing but the cost.
    access = F.when(
        F.contains(raw, F.lit('] "')),
        F.regexp_extract(raw, LINE_FLAGS + r"(?<!\S)" + ACCESS_LINE, 0),
    )
    out = base.withColumn("_json", json).withColumn("_access", access)
    out = out.withColumn(
        "format",
        F.when(drop, DROPPED)
        .when(F.size("_json") == 1, "json")
        .when(F.col("_access") != "", "access")
        .when(
            contains_any(raw, ("Failed", "Accepted", "Invalid")) & raw.rlike(LINE_FLAGS + SSH_LINE), "ssh"
        )
        .when(F.contains(raw, F.lit(":")) & raw.rlike(LINE_FLAGS + SYSLOG_LINE), "syslog")
        .when(F.contains(raw, F.lit("-")) & raw.rlike(LINE_FLAGS + GENERIC_LINE), "generic")
        .otherwise("fallback"),
    )

    def group(pattern, number):
        return F.regexp_extract(raw, LINE_FLAGS + pattern, number)

    none = F.lit(None).cast("string")
    out = out.withColumn("_words", F.when(fmt == "access", F.split("_access", " ")))
    words = F.col("_words")
    # The matched access text has no blanks inside its fields: three words before the time, four after.
    bracketed = F.array_join(F.slice(words, F.lit(4), F.size(words) - 7), " ")
    out = out.withColumn(
        "_fields",
        F.when(
            fmt == "access",
            F.array(
                F.substr(bracketed, F.lit(2), F.length(bracketed) - 2), words[0], words[2],
                F.substr(F.element_at(words, -4), F.lit(2)), F.element_at(words, -3), F.element_at(words, -1),
                none,
            ),
        )
        .when(
            fmt == "ssh",
            F.array(none if strict else group(SSH_LINE, 1), group(SSH_LINE, 4), group(SSH_LINE, 3),
                    none, none, none, none),
        )
        .when(
            fmt == "syslog",
            F.array(none if strict else group(SYSLOG_LINE, 1), none, none, none, none, none, group(SYSLOG_LINE, 2)),
        )
        .when(
            fmt == "generic",
            F.array(group(GENERIC_LINE, 1), none, none, none, none, none, group(GENERIC_LINE, 2)),
        ),
    )

    # The first filled alias per field, for JSON lines only.
    first = F.col("_json")[0]
    ordered = ("time", "ip", "user", "method", "path", "status", "message")
    options = F.array(*[F.array(*[first[n] for n in JSON_ALIASES[name]]) for name in ordered])
    chosen = F.transform(options, lambda values: F.get(F.filter(values, lambda v: v != ""), 0))
    out = out.withColumn(
        "_fields", F.when(fmt == "json", chosen).when(F.size(fields) > 0, fields).otherwise(F.array(*[none] * 7))
    )

    text = fields[_TIME]
    out = out.withColumn(
        "ts",
        F.when(fmt == "access", times.access_time(text))
        .when(fmt == "json", times.json_time(text))
        .when(fmt == "generic", times.as_wall_clock(text))
        .when(fmt.isin("ssh", "syslog"), times.yearless_time(text, year)),
    )
    return out.withColumns(
        {
            "tz_offset": F.when(F.col("ts").isNull(), F.lit(None).cast("int"))
            .when(fmt == "access", times.offset_minutes(F.substring_index(text, " ", -1)))
            .when(fmt == "json", times.json_offset_minutes(text)),
            "ip": F.when(fmt != DROPPED, F.coalesce(fields[_IP], first_ip(raw))),
            "user": fields[_USER],
            "method": fields[_METHOD],
            "path": fields[_PATH],
            "status": F.when(fmt == "access", fields[_STATUS].try_cast("int")).when(
                fmt == "json", _status_number(fields[_STATUS])
            ),
            "message": F.when(
                fmt != DROPPED, F.coalesce(fields[_MESSAGE], F.substring(raw, 1, MESSAGE_CHARS))
            ),
        }
    )


def _status_number(text: Column) -> Column:
    """A whole number, a number with a fraction (cut off), or a text whose first word is digits."""
    return F.coalesce(
        text.try_cast("int"),
        F.when(text.rlike(r"^-?\d+\.\d+([eE][+-]?\d+)?$"), text.try_cast("double").try_cast("int")),
        F.regexp_extract(text, r"(?U)^\s*(\d+)(?:\s|$)", 1).try_cast("int"),
    )


def _delimited(base: DataFrame, drop: Column, layout: DelimitedLayout, year: int, strict: bool) -> DataFrame:
    raw = F.col("raw")
    out = base.withColumn("format", F.when(drop, DROPPED).otherwise("delimited"))
    out = out.withColumn("_words", F.when(F.col("format") != DROPPED, split_columns(raw, layout.delimiter)))

    def column(number):
        return F.lit(None).cast("string") if number is None else F.get(F.col("_words"), number)

    token = F.btrim(column(layout.ts_col), F.lit("[]() "))
    word = F.substring_index(token, " ", 1)
    readers = [
        F.when(F.contains(word, F.lit("T")), times.as_wall_clock(word)),
        F.when(F.contains(word, F.lit("/")), times.clock_of_slashed_date(word)),
    ]
    if not strict:
        readers.append(F.when(token.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:"), times.as_wall_clock(token)))
        readers.append(F.when(token.rlike(r"^[A-Za-z]{3}\s"), times.yearless_time(token, year)))
    status = column(layout.status_col)
    return out.withColumns(
        {
            "ts": F.coalesce(*readers),
            "tz_offset": F.lit(None).cast("int"),
            "ip": F.coalesce(first_ip(column(layout.ip_col)), column(layout.ip_col)),
            "user": F.lit(None).cast("string"),
            "method": column(layout.method_col),
            "path": column(layout.path_col),
            "status": F.when(status.rlike(r"^\d+$"), status.try_cast("int")),
            "message": F.when(
                F.col("format") != DROPPED,
                F.coalesce(column(layout.msg_col), F.substring(raw, 1, MESSAGE_CHARS)),
            ),
        }
    )


def split_columns(line: Column, delimiter: str) -> Column:
    """A line's columns, without blanks around them.  A blank delimiter splits at runs of blanks."""
    if delimiter == " ":
        return F.split(line, r"(?U)\s+")
    return F.transform(F.split(line, "\\" + delimiter if delimiter != "\t" else "\t"), stripped)
