"""The report: a one-row summary, and the full document as ordered lines.

The threats of a large log do not fit into one row or one task, so the full document is a
sorted frame of text lines: its part files, one after the other, are one JSON document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import iso_text
from ..operators import stats
from ..operators.merge import threat_order
from ..operators.parse import DROPPED
from .analysis import Analysis


def summary_report(analysis: Analysis) -> DataFrame:
    """One row with everything but the threats and statuses themselves.

    Every nested value is small by nature: five levels, ten addresses and paths, 1440 minutes.
    """
    pairs = _pairs(analysis)

    def number(name):
        return F.coalesce(F.max(F.when(F.col("part") == name, F.col("n"))), F.lit(0)).alias(name)

    def listed(part):
        chosen = F.when(F.col("part") == part, F.struct("place", F.col("name"), F.col("n")))
        return F.sort_array(F.collect_list(chosen))

    def mapped(part):
        return F.map_from_entries(F.transform(listed(part), lambda x: F.struct(x["name"], x["n"])))

    def ranked(part, key):
        return F.transform(listed(part), lambda x: F.struct(x["name"].alias(key), x["n"].alias("n")))

    score = number("risk_score").cast("int")
    return pairs.agg(
        F.lit(analysis.as_of).cast("timestamp_ntz").alias("generated_at"),
        number("total_entries"), number("parsed_entries"), number("threat_count"),
        mapped("level").alias("by_level"), number("unique_ips"), number("unique_paths"),
        ranked("ip", "ip").alias("top_ips"), ranked("path", "path").alias("top_paths"),
        mapped("minute").alias("timeline"), score.alias("risk_score"),
    ).withColumn("risk_band", stats.risk_band(F.col("risk_score")))


def stat_tiles(analysis: Analysis) -> DataFrame:
    """One row of headline numbers."""
    level = F.col("by_level")
    tiles = [
        F.coalesce(F.try_element_at(level, F.lit(name)), F.lit(0)).alias(name.lower())
        for name in ("CRITICAL", "HIGH", "MEDIUM")
    ]
    return summary_report(analysis).select(
        F.col("total_entries").alias("lines"), "unique_ips", F.col("threat_count").alias("threats"), *tiles
    )


def _pairs(analysis: Analysis) -> DataFrame:
    """``part, place, name, n``: the parts of the summary as rows, the long lists already cut to ten."""
    none = F.lit(None).cast("string")

    def row(df, part, n, name=none, place=F.lit(0)):
        return df.select(
            F.lit(part).alias("part"), place.cast("int").alias("place"), name.alias("name"),
            n.cast("bigint").alias("n"),
        )

    threats, quality = analysis.threats, analysis.parse_quality
    kept = F.when(F.col("format") != DROPPED, F.col("n"))
    score = stats.risk_score(threats)
    count = F.count("*").alias("n")

    def top(df, key):
        # Only ever over the ten rows of a top-k.
        place = F.row_number().over(W.partitionBy().orderBy(F.desc("n"), F.asc("first_seq")))
        return row(df.withColumn("_place", place), key, F.col("n"), F.col(key), F.col("_place"))

    parts = [
        row(quality.agg(F.sum("n").alias("n")), "total_entries", F.col("n")),
        row(quality.agg(F.sum(kept).alias("n")), "parsed_entries", F.col("n")),
        row(threats.agg(count), "threat_count", F.col("n")),
        row(score, "risk_score", F.col("risk_score")),
        row(analysis.ip_counts.agg(count), "unique_ips", F.col("n")),
        row(analysis.path_counts.agg(count), "unique_paths", F.col("n")),
        row(stats.threats_by_level(threats), "level", F.col("n"), F.col("level")),
        row(analysis.timeline, "minute", F.col("n"), F.col("minute")),
        top(analysis.top_ips(), "ip"),
        top(analysis.top_paths(), "path"),
    ]
    return reduce(DataFrame.unionByName, parts)


def report_lines(analysis: Analysis) -> DataFrame:
    """The whole report as the ordered lines of one JSON document: ``line``."""
    threats, statuses = analysis.threats, analysis.status_counts
    summary = summary_report(analysis)
    # A comma goes before every member but the first, so the first one has to be known.
    first = threats.orderBy(*threat_order()).select("rule_id", "ip", "user").limit(1).collect()
    lowest = statuses.agg(F.min("status")).first()[0]
    is_first = F.lit(False)
    if first:
        is_first = reduce(
            lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(first[0][k])) for k in ("rule_id", "ip", "user")]
        )
    order = [c.alias(f"o{n}") for n, c in enumerate(_keys())]
    empty = [F.lit(None).cast(t).alias(f"o{n}") for n, t in enumerate(("int", "int", "int", "bigint", "int", "string", "string"))]

    def block(df, section, text, keys=empty):
        return df.select(F.lit(section).alias("section"), *keys, text.alias("line"))

    def json(*columns, **options):
        return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", **options})

    comma = F.when(is_first, F.lit("")).otherwise(F.lit(","))
    one_threat = json(
        "rule_id", "rule_name", "level", "description", "ip", "user",
        iso_text(F.col("ts"), F.col("tz_offset")).alias("timestamp"), "evidence", "count",
    )
    status_comma = F.when(F.col("status") == lowest, F.lit("")).otherwise(F.lit(","))
    one_status = F.concat(status_comma, F.lit('"'), F.col("status").cast("string"), F.lit('": '), F.col("n").cast("string"))
    status_keys = [F.col("status").alias("o0"), *empty[1:]]

    def pair_list(name, key):
        pairs = F.transform(name, lambda x: F.concat(
            F.lit("["), _json_text(x[key]), F.lit(", "), x["n"].cast("string"), F.lit("]")))
        return F.concat(F.lit("["), F.array_join(pairs, ", "), F.lit("]"))

    head = F.concat(
        F.lit('{"generated_at": "'), iso_text(F.col("generated_at")), F.lit('", "total_entries": '),
        F.col("total_entries").cast("string"), F.lit(', "parsed_entries": '), F.col("parsed_entries").cast("string"),
        F.lit(', "threats": ['),
    )
    middle = F.concat(F.lit('], "summary": {"by_level": '), F.to_json("by_level"), F.lit(', "status_codes": {'))
    tail = F.concat(
        F.lit('}, "unique_ips": '), F.col("unique_ips").cast("string"), F.lit(', "unique_paths": '),
        F.col("unique_paths").cast("string"), F.lit('}, "top_ips": '), pair_list("top_ips", "ip"),
        F.lit(', "top_paths": '), pair_list("top_paths", "path"), F.lit(', "timeline": '), F.to_json("timeline"),
        F.lit(', "risk_score": '), F.col("risk_score").cast("string"), F.lit("}"),
    )
    # One small row feeds three sections.
    frame = summary.select(
        F.explode(F.array(*[
            F.struct(F.lit(section).alias("section"), text.alias("line"))
            for section, text in ((0, head), (2, middle), (4, tail))
        ])).alias("x")
    ).select("x.section", *empty, "x.line")
    document = (
        frame.unionByName(block(threats, 1, F.concat(comma, one_threat), order))
        .unionByName(block(statuses, 3, one_status, status_keys))
    )
    return document.orderBy("section", *[F.asc(f"o{n}") for n in range(len(empty))]).select("line")


def _keys():
    """The threat order as ascending columns."""
    return [
        -F.col("level_score"), F.col("phase"), F.when(F.col("phase") == 1, F.col("rule_no")), F.col("first_seq"),
        F.col("rule_no"), F.col("ip"), F.col("user"),
    ]


def _json_text(text):
    """A JSON string of a text column."""
    wrapped = F.to_json(F.array(text))
    return F.substr(wrapped, F.lit(2), F.length(wrapped) - 2)


def save_report(analysis: Analysis, path: str) -> None:
    """Write the report as text part files; in name order they make one JSON document."""
    report_lines(analysis).write.mode("overwrite").text(path)
