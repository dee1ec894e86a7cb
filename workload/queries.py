"""One query per operator, over logs rendered from the given tables or over the tables themselves."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import threatlog as tl
from threatlog.session import scratch_folder

from . import live
from .logs import AS_OF, YEAR, lines


def _time(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _joined(column):
    return F.array_join(column, " || ").alias(column)


def _pairs(column, *names):
    first, second = names
    return F.array_join(F.transform(column, lambda x: F.concat_ws("=", x[first], x[second])), ", ").alias(column)


def _map_text(column):
    entries = F.sort_array(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda x: F.concat_ws("=", x["key"], x["value"])), ", ").alias(column)


def _access(spark, sf_dir):
    tl.tune(spark)
    return lines(spark, sf_dir, "access")


def _entries(spark, sf_dir, kind="access", columns=None):
    tl.tune(spark)
    return tl.parse_logs(lines(spark, sf_dir, kind), as_of=AS_OF, default_year=YEAR, columns=columns)


def _hits(spark, sf_dir):
    return tl.rule_hits(_entries(spark, sf_dir))


def _ticks(spark, sf_dir):
    return tl.ticks(_entries(spark, sf_dir))


def _analysis(spark, sf_dir):
    return tl.Analysis(_access(spark, sf_dir), as_of=AS_OF, default_year=YEAR)


def _threats(spark, sf_dir):
    return _analysis(spark, sf_dir).threats


def _composed_threats(spark, sf_dir):
    """The same from the single operators, which read the log twice."""
    entries = _entries(spark, sf_dir)
    return tl.merge_threats(tl.rule_hits(entries), tl.threshold_hits(tl.ticks(entries)))


def _format(spark, sf_dir, name, *columns):
    return _entries(spark, sf_dir, "mixed").where(F.col("format") == name).select("seq", *columns)


def rendered_lines(spark, sf_dir):
    return _access(spark, sf_dir).select("line_no", "line")


def parse_access(spark, sf_dir):
    return _entries(spark, sf_dir).select(
        "seq", "ip", "user", _time("ts"), "tz_offset", "method", "path", "status", "message"
    )


def parse_ssh(spark, sf_dir):
    return _format(spark, sf_dir, "ssh", "ip", "user", _time("ts"))


def parse_syslog(spark, sf_dir):
    return _format(spark, sf_dir, "syslog", "message", _time("ts"))


def parse_generic(spark, sf_dir):
    return _format(spark, sf_dir, "generic", "message", "ip", _time("ts"))


def parse_json(spark, sf_dir):
    return _format(spark, sf_dir, "json", "ip", "path", "status", _time("ts"))


_LAYOUT = tl.DelimitedLayout("|", ip_col=1, ts_col=0, method_col=2, path_col=3, status_col=4, msg_col=5)


def parse_epoch_times(spark, sf_dir):
    return _entries(spark, sf_dir, "epoch").select("seq", "ip", "path", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"))


def delimited_columns():
    return ["seq", _time("ts"), "ip", "method", "path", "status", "message"]


def parse_delimited(spark, sf_dir):
    tl.tune(spark)
    entries = tl.parse_logs(lines(spark, sf_dir, "delimited"), as_of=AS_OF, layout=_LAYOUT)
    return entries.select(*delimited_columns())


def parse_mixed_dispatch(spark, sf_dir):
    return _entries(spark, sf_dir, "mixed").select("seq", "format", _time("ts"), "ip", "status", "message")


def parse_quality(spark, sf_dir):
    tl.tune(spark)
    return tl.parse_quality(lines(spark, sf_dir, "mixed"), as_of=AS_OF, default_year=YEAR)


def rule_hits(spark, sf_dir):
    return _hits(spark, sf_dir).select(
        "seq", "rule_id", "rule_name", "level", "level_score", "description", "evidence", "ip", "user", _time("ts")
    )


def rule_hit_counts(spark, sf_dir):
    return _hits(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("n"))


def mixed_rule_hit_counts(spark, sf_dir):
    hits = tl.rule_hits(_entries(spark, sf_dir, "mixed"))
    return hits.groupBy("rule_id").agg(F.count("*").alias("n"))


def line_severity(spark, sf_dir):
    return tl.line_severities(_access(spark, sf_dir)).select("seq", "severity")


def line_search(spark, sf_dir):
    return tl.search_lines(_access(spark, sf_dir), "SQLMAP").select("seq", "line")


def line_feed(spark, sf_dir):
    return tl.line_feed(_access(spark, sf_dir), "etc").select("seq", "line", "severity", "total")


def peak_windows(spark, sf_dir):
    return tl.peak_windows(_entries(spark, sf_dir)).select(
        "counter", "ip", "peak", _time("window_start"), _time("window_end"), "first_seq"
    )


def threshold_threats(spark, sf_dir):
    return tl.threshold_hits(_ticks(spark, sf_dir)).select(
        "rule_id", "level", "description", "evidence", "ip", _time("ts"), "count"
    )


def throttled_alert_steps(spark, sf_dir):
    return tl.alert_steps(_ticks(spark, sf_dir)).select(
        "rule_id", "ip", "alert_step", "count", _time("ts"), "description", "evidence"
    )


def _triggers(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    return tl.alert_rows(entries, tl.alert_steps(tl.ticks(entries)))


def alert_trigger_rows(spark, sf_dir):
    return _triggers(spark, sf_dir).select("rule_id", "ip", "alert_step", "seq")


def context_lines(spark, sf_dir):
    return tl.log_context(_access(spark, sf_dir), as_of=AS_OF, default_year=YEAR).select("line_no", "line")


def _files(spark, sf_dir):
    """The access log as text files, whose names are in the order of its lines."""
    folder = scratch_folder(spark)
    _access(spark, sf_dir).orderBy("seq").select("line").write.text(folder)
    return tl.read_logs(spark, folder, source="access")


def context_of_files(spark, sf_dir):
    return tl.log_context(_files(spark, sf_dir), as_of=AS_OF, default_year=YEAR).select("line_no", "line")


_THREAT = ("rule_id", "rule_name", "level", "level_score", "description", "ip", "user")


def threat_columns():
    return [*_THREAT, _time("ts"), _joined("evidence"), "count", "first_seq"]


def merged_threats(spark, sf_dir):
    return _threats(spark, sf_dir).select(*threat_columns())


def one_scan_threats(spark, sf_dir):
    return _analysis(spark, sf_dir).threats.select(*threat_columns())


def composed_threats(spark, sf_dir):
    return _composed_threats(spark, sf_dir).select(*threat_columns())


def ranked_threats(spark, sf_dir):
    from pyspark.sql import Window

    top = tl.ranked_threats(_threats(spark, sf_dir)).limit(10)
    place = F.row_number().over(Window.partitionBy().orderBy(F.monotonically_increasing_id()))
    return top.withColumn("place", place).select("place", "rule_id", "ip", "user", "count")


def threats_of_level(spark, sf_dir):
    return tl.threats_of_level(_threats(spark, sf_dir), "MEDIUM").select("rule_id", "ip", "user", "count")


def threats_by_level(spark, sf_dir):
    return tl.threats_by_level(_threats(spark, sf_dir))


def severity_matrix(spark, sf_dir):
    return tl.severity_matrix(_threats(spark, sf_dir)).select("position", "level", "n", "percent")


def risk_score(spark, sf_dir):
    return tl.risk_score(_threats(spark, sf_dir))


def gate(spark, sf_dir):
    return tl.gate(_threats(spark, sf_dir))


def top_ips(spark, sf_dir):
    return tl.top_ips(_entries(spark, sf_dir, columns=("ip",)))


def top_paths(spark, sf_dir):
    return tl.top_paths(_entries(spark, sf_dir, columns=("path",)))


def bar_shares(spark, sf_dir):
    from threatlog.operators.stats import counts_of

    return tl.shares_of_maximum(counts_of(_entries(spark, sf_dir, columns=("path",)), "path")).select("path", "n", "percent")


def status_counts(spark, sf_dir):
    return tl.status_counts(_entries(spark, sf_dir, columns=("status",)))


def timeline_hhmm(spark, sf_dir):
    return tl.timeline(_entries(spark, sf_dir, columns=("ts",)))


def timeline_minute(spark, sf_dir):
    return tl.timeline(_entries(spark, sf_dir, columns=("ts",)), by="minute")


def timeline_stats(spark, sf_dir):
    return tl.timeline_stats(tl.timeline(_entries(spark, sf_dir, columns=("ts",))))


def distinct_counts(spark, sf_dir):
    return tl.distinct_counts(_entries(spark, sf_dir, columns=("ip", "path")))


def summary_columns():
    return [
        _time("generated_at"), "total_entries", "parsed_entries", "threat_count", _map_text("by_level"), "unique_ips",
        "unique_paths", _pairs("top_ips", "ip", "n"), _pairs("top_paths", "path", "n"), _map_text("timeline"),
        "risk_score", "risk_band",
    ]


def summary_report(spark, sf_dir):
    return tl.summary_report(_analysis(spark, sf_dir)).select(*summary_columns())


def stat_tiles(spark, sf_dir):
    return tl.stat_tiles(_analysis(spark, sf_dir))


def report_document(spark, sf_dir):
    return tl.report_lines(_analysis(spark, sf_dir))


def threat_details(spark, sf_dir):
    return tl.threat_details(_threats(spark, sf_dir)).select("rule_id", "ip", "user", _joined("evidence"))


def playbook_join(spark, sf_dir):
    advised = tl.with_playbook(_threats(spark, sf_dir))
    shown = F.when(F.col("rule_id").isin("R001", "R008"), F.col("action")).otherwise("-")
    return advised.groupBy("rule_id", "ip", shown.alias("action")).agg(F.count("*").alias("n"))


def evidence_marked(spark, sf_dir):
    evidences = _hits(spark, sf_dir).select("rule_id", "evidence").distinct()
    return evidences.withColumn("marked", tl.marked_evidence(F.col("rule_id"), F.col("evidence")))


def alert_lines(spark, sf_dir):
    return tl.alert_lines(tl.alert_steps(_ticks(spark, sf_dir))).select("line")


def notable_alerts(spark, sf_dir):
    return tl.notable(_hits(spark, sf_dir)).select("seq", "rule_id")


def ip_extraction(spark, sf_dir):
    return tl.extract_ips(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", "doc_id")


def page_script_scan(spark, sf_dir):
    from threatlog.fixed_values import CROSS_SITE_SCRIPT
    from threatlog.functions.text import matches

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select(F.col("page_id").alias("seq"), matches(F.col("html"), CROSS_SITE_SCRIPT).alias("has_script"))


def conversation_severity(spark, sf_dir):
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return talks.select("conv_id", "turn", tl.line_severity(F.col("text")).alias("severity"))


def delimiter_stats(spark, sf_dir):
    return tl.delimiter_stats(lines(spark, sf_dir, "delimited"))


def column_stats(spark, sf_dir):
    return tl.column_stats(lines(spark, sf_dir, "delimited"), "|")


_ROLES = ("delimiter", "ip_col", "ts_col", "method_col", "path_col", "status_col", "msg_col")
_DELIMITERS = (",", "\t", ";", " ")


def inferred_layout(spark, sf_dir):
    layout = tl.infer_layout(lines(spark, sf_dir, "delimited"), sample_lines=None)
    found = ("delimiter", "ip_col", "ts_col", "method_col", "path_col", "status_col", "msg_col")
    return spark.createDataFrame(
        [("delimited", *[getattr(layout, name) for name in found])],
        "kind string, delimiter string, " + ", ".join(f"{name} int" for name in found[1:]),
    )


def inferred_layouts(spark, sf_dir):
    """The layout of the delimited log, written with each delimiter, by the rules of ``strict_compat``."""
    log, found = lines(spark, sf_dir, "delimited"), []
    for delimiter in ("|", *_DELIMITERS):
        written = log.withColumn("line", F.translate("line", "|", delimiter))
        layout = tl.infer_layout(written, strict_compat=True)
        found.append((delimiter, *[getattr(layout, name) for name in _ROLES]))
    return spark.createDataFrame(found, "written string, " + ", ".join(f"{name} {'string' if name == 'delimiter' else 'int'}" for name in _ROLES))


def custom_rule(spark, sf_dir):
    rule = tl.Rule(
        "C001", "Purchase by form", "INFO",
        predicate=(F.col("method") == "POST") & (F.col("status") >= 200) & F.col("path").startswith("/purchase"),
        evidence=F.col("path"),
        description=F.concat(F.lit("posted to "), F.col("path")),
    )
    rules = tl.default_rules().with_rule(rule)
    merged = tl.merge_threats(tl.rule_hits(_entries(spark, sf_dir), rules), rules=rules)
    return merged.where(F.col("rule_id") == "C001").select("rule_id", "ip", "user", "count", "first_seq")


def custom_threshold(spark, sf_dir):
    rule = tl.ThresholdRule(
        "C010", "Server trouble", "MEDIUM", "error", 4, 2, "{n} errors for {ip}", "from {start}",
        window=timedelta(seconds=60),
    )
    ticked = tl.ticks(_entries(spark, sf_dir), {"error": F.col("status") >= 500})
    return tl.threshold_hits(ticked, [rule]).select("rule_id", "ip", "count")


_QUERIES = (
    rendered_lines, parse_access, parse_ssh, parse_syslog, parse_generic, parse_json, parse_epoch_times, parse_delimited,
    parse_mixed_dispatch, parse_quality, rule_hits, rule_hit_counts, mixed_rule_hit_counts, line_severity, line_search, line_feed,
    peak_windows, threshold_threats, throttled_alert_steps, alert_trigger_rows, context_lines, context_of_files, merged_threats,
    one_scan_threats, composed_threats, ranked_threats, threats_of_level, threats_by_level, severity_matrix, risk_score, gate, top_ips,
    top_paths, bar_shares, status_counts, timeline_hhmm, timeline_minute, timeline_stats, distinct_counts,
    summary_report, stat_tiles, report_document, threat_details, playbook_join, evidence_marked, alert_lines,
    notable_alerts, ip_extraction, page_script_scan, conversation_severity, delimiter_stats, column_stats,
    inferred_layout, inferred_layouts, custom_rule, custom_threshold,
)


def queries():
    return {query.__name__: query for query in _QUERIES} | live.queries()
