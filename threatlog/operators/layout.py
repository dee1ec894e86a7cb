"""Finding out how a log is laid out.

The features of lines and columns are aggregations, so they work on a sample or a whole
table; only the last choice walks over the aggregated columns, one row per column.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed_values import (
    DELIMITERS,
    IP_ADDRESS,
    JSON_SHARE,
    LINE_FLAGS,
    METHOD_TOKEN,
    PATH_TOKEN,
    STATUS_TOKEN,
)
from ..functions.text import stripped
from ..session import staged
from .parse import DelimitedLayout, parse_logs, split_columns

_NAMES = ("pipe", "comma", "tab", "semicolon")
_KNOWN = ("json", "access", "ssh", "syslog", "generic")


def first_lines(lines: DataFrame, sample_lines: int | None = None) -> DataFrame:
    """All lines; or, for a caller that asks for it, the first ones: by file and place in it, else by ``seq``."""
    if sample_lines is None:
        return lines
    order = ["file", "block", "seq"] if "block" in lines.columns else ["seq"]
    return lines.orderBy(*order).limit(sample_lines)


def _filled_lines(lines):
    raw = stripped(F.col("line")).alias("raw")
    return lines.select(raw).where((F.col("raw") != "") & ~F.col("raw").startswith("#"))


def delimiter_stats(lines: DataFrame, known: bool = False) -> DataFrame:
    """One row: filled lines, lines that look like JSON objects, and per delimiter the fewest and
    most occurrences in a line; with ``known`` also ``n_known``, the lines of a built-in format."""
    raw = F.col("raw")
    looks_json = raw.startswith("{") & raw.endswith("}")
    found = [F.count("*").alias("n_lines"), F.count_if(looks_json).alias("n_json")]
    for name, delimiter in zip(_NAMES, DELIMITERS):
        occurs = F.length(raw) - F.length(F.replace(raw, F.lit(delimiter), F.lit("")))
        found += [F.min(occurs).alias(f"min_{name}"), F.max(occurs).alias(f"max_{name}")]
    if not known:
        return _filled_lines(lines).agg(*found)
    found.append(F.count_if(F.col("format").isin(*_KNOWN)).alias("n_known"))
    entries = parse_logs(lines, as_of=datetime(2000, 1, 1), columns=("raw", "format"))
    return entries.agg(*found)


def column_stats(lines: DataFrame, delimiter: str) -> DataFrame:
    """One row per column that every line has: what its values look like.

    ``position, any_ip, any_method, any_digits, all_status, any_path, any_time``; ``all_status``
    is about the all-digit values only.
    """
    words = _filled_lines(lines).select(split_columns(F.col("raw"), delimiter).alias("words"))
    token = F.col("token")
    digits = token.rlike(r"^\d+$")
    # A column that every line has occurs as often as the first one.
    every = W.orderBy("position").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        words.select(F.posexplode("words").alias("position", "token"))
        .groupBy("position")
        .agg(
            F.count("*").alias("_n"),
            F.bool_or(token.rlike(LINE_FLAGS + IP_ADDRESS)).alias("any_ip"),
            F.bool_or(token.rlike("(?i)" + METHOD_TOKEN)).alias("any_method"),
            F.bool_or(digits).alias("any_digits"),
            F.bool_and(~digits | token.rlike(STATUS_TOKEN)).alias("all_status"),
            F.bool_or(token.rlike(PATH_TOKEN)).alias("any_path"),
            F.bool_or(token.rlike(r"[-/:]") & token.rlike(r"\d")).alias("any_time"),
        )
        .withColumn("_lines", F.max("_n").over(every))
        .where(F.col("_n") == F.col("_lines"))
        .drop("_n", "_lines")
    )


def pick_delimiter(stats) -> str:
    """The first delimiter that every line has equally often, else the last that every line has, else a blank."""
    chosen = " "
    for name, delimiter in zip(_NAMES, DELIMITERS):
        fewest, most = stats[f"min_{name}"], stats[f"max_{name}"]
        if fewest and fewest == most:
            return delimiter
        if fewest:
            chosen = delimiter
    return chosen


def pick_columns(columns, delimiter: str, strict_compat: bool = False) -> DelimitedLayout:
    """Give each column, left to right, the first role that is still free and fits it.

    A status column needs an all-digit value, unless ``strict_compat``.
    """
    roles: dict[str, int] = {}
    tests = (
        ("ip_col", lambda c: c["any_ip"]),
        ("method_col", lambda c: c["any_method"]),
        ("status_col", lambda c: c["all_status"] and (strict_compat or c["any_digits"])),
        ("path_col", lambda c: c["any_path"]),
        ("ts_col", lambda c: c["any_time"]),
    )
    ordered = sorted(columns, key=lambda c: c["position"])
    for column in ordered:
        for role, fits in tests:
            if role not in roles and fits(column):
                roles[role] = column["position"]
                break
    left = [c["position"] for c in ordered if c["position"] not in roles.values()]
    return DelimitedLayout(delimiter, msg_col=left[-1] if left else None, **roles)


def infer_layout(
    lines: DataFrame, sample_lines: int | None = None, strict_compat: bool = False
) -> DelimitedLayout | str | None:
    """The layout of a log: ``json``, ``known`` (all lines fit a built-in format), a
    :class:`DelimitedLayout`, or None without any filled line.

    All lines are looked at, in two passes at most; ``sample_lines`` limits it to the first ones.
    ``strict_compat`` never answers ``known``.
    """
    sample = first_lines(lines, sample_lines)
    if sample_lines is not None:
        sample = staged(sample)
    stats = delimiter_stats(sample, known=not strict_compat).first()
    if not stats["n_lines"]:
        return None
    if stats["n_json"] > stats["n_lines"] * JSON_SHARE:
        return "json"
    if not strict_compat and stats["n_known"] == stats["n_lines"]:
        return "known"
    delimiter = pick_delimiter(stats)
    columns = column_stats(sample, delimiter).collect()
    return pick_columns(columns, delimiter, strict_compat) if columns else None
