"""Threat analytics over log lines, as Spark DataFrame and Structured Streaming jobs."""

from .functions.text import extract_ips, line_severity, marked_evidence
from .operators.context import context_lines, number_lines
from .operators.enrich import alert_lines, notable, playbook, with_level_score, with_marked_evidence, with_playbook
from .operators.layout import column_stats, delimiter_stats, infer_layout
from .operators.merge import merge_threats, ranked_threats, threats_of_level
from .operators.parse import DelimitedLayout, parse_logs, parse_quality
from .operators.rules import Rule, RuleSet, default_rules, rule_hits
from .operators.stats import (
    distinct_counts,
    gate,
    line_feed,
    line_severities,
    most_common,
    risk_band,
    risk_score,
    search_lines,
    severity_matrix,
    shares_of_maximum,
    status_counts,
    threat_details,
    threats_by_level,
    timeline,
    timeline_stats,
    top_ips,
    top_paths,
)
from .operators.windows import (
    ThresholdRule,
    alert_rows,
    alert_steps,
    default_thresholds,
    peak_windows,
    threshold_hits,
    ticks,
)
from .plans.analysis import Analysis
from .plans.context import log_context
from .plans.report import report_lines, save_report, stat_tiles, summary_report
from .session import tune
from .sources.lines import from_lines, from_text, read_logs, spread, stream_logs
from .sources.sinks import write_alert_log, write_json, write_lines
