"""Text columns: searching, cutting, escaping and marking."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    BLANKS,
    COMMAND_INJECTION,
    CONFIG_FILE,
    CROSS_SITE_SCRIPT,
    EVIDENCE_MARKS,
    FILE_INCLUSION,
    IP_ADDRESS,
    LINE_FLAGS,
    LOW_LINE,
    PATH_TRAVERSAL,
    SENSITIVE_PATH,
    SQL_INJECTION,
    THREAT_FLAGS,
    WEB_SHELL,
)


#: For each pattern lower-case literals of which every match in plain ASCII text holds one; a search for them is far
#: cheaper than the pattern.
HINTS = {
    SQL_INJECTION: ("select", "insert", "drop", "--", "'1'='1", "1=1", "exec", "xp_cmdshell"),
    CROSS_SITE_SCRIPT: ("script", "onerror=", "onload=", "eval(", "alert(", "document.cookie"),
    PATH_TRAVERSAL: ("..", "%2"),
    SENSITIVE_PATH: ("admin", "/actuator"),
    FILE_INCLUSION: ("=http", "=ftp:", "/etc/", ".ini"),
    COMMAND_INJECTION: (";", "&", "|", "`", "$("),
    WEB_SHELL: (".php", ".jsp", ".aspx"),
    CONFIG_FILE: (".env", "config", "database.yml", "settings.py", ".bak", ".sql"),
    LOW_LINE: ("failed", "invalid user", "unauthorized"),
}


def stripped(text: Column) -> Column:
    """The text without blanks at both ends (all Unicode blanks, not only spaces)."""
    return F.btrim(text, F.lit(BLANKS))


def filled(text: Column) -> Column:
    """NULL instead of an empty text."""
    return F.nullif(text, F.lit(""))


def joined(*texts: Column) -> Column:
    """The filled texts, separated by one space."""
    return F.concat_ws(" ", *[filled(t) for t in texts])


def contains_any(text: Column, literals) -> Column:
    """Whether the text contains one of the literals."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in literals])


def matches(text: Column, pattern: str) -> Column:
    """Whether a threat pattern occurs anywhere in the text, letter case ignored."""
    return text.rlike(THREAT_FLAGS + pattern)


def fill(template: str, **columns: Column) -> Column:
    """A text with ``{name}`` marks replaced by the columns of these names; NULL shows as None."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece.startswith("{"):
            parts.append(F.coalesce(columns[piece[1:-1]].cast("string"), F.lit("None")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def first_ip(text: Column) -> Column:
    """The first dotted quad in the text, NULL without one.  Ranges are not checked."""
    return F.when(F.contains(text, F.lit(".")), filled(F.regexp_extract(text, LINE_FLAGS + IP_ADDRESS, 0)))


def extract_ips(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row per dotted quad in ``column`` with its position (1-based): ``keep..., position, ip``."""
    found = F.regexp_extract_all(F.col(column), F.lit(LINE_FLAGS + IP_ADDRESS), F.lit(0))
    return df.select(*keep, F.posexplode(found).alias("position", "ip")).withColumn(
        "position", F.col("position") + 1
    )


def escaped_html(text: Column) -> Column:
    """The text with the four HTML characters escaped, empty for NULL."""
    out = F.coalesce(text, F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def marked_evidence(rule_id: Column, text: Column) -> Column:
    """Evidence as HTML, with the parts that made the rule match inside ``<mark>``."""
    safe = escaped_html(text)
    out = None
    for rule, (pattern, ignore_case) in EVIDENCE_MARKS.items():
        marked = F.regexp_replace(safe, ("(?i)" if ignore_case else "") + pattern, "<mark>$1</mark>")
        out = F.when(rule_id == rule, marked) if out is None else out.when(rule_id == rule, marked)
    return out.otherwise(safe)


def line_severity(line: Column) -> Column:
    """HIGH, MEDIUM, LOW or ok for a raw line, from the line alone."""

    def judged(probe):
        # The lambda binds the lower-case text, so that it is made once a line.
        plain = F.octet_length(probe) == F.length(probe)

        def one_of(*patterns):
            found = [(contains_any(probe, HINTS[p]) | ~plain) & matches(line, p) for p in patterns]
            return reduce(lambda a, b: a | b, found)

        return (
            F.when(one_of(SQL_INJECTION, PATH_TRAVERSAL, COMMAND_INJECTION, WEB_SHELL), "HIGH")
            .when(one_of(CROSS_SITE_SCRIPT, SENSITIVE_PATH, CONFIG_FILE, FILE_INCLUSION), "MEDIUM")
            .when(one_of(LOW_LINE), "LOW")
            .otherwise("ok")
        )

    return F.get(F.transform(F.array(F.lower(line)), judged), F.lit(0))
