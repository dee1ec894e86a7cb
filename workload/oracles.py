"""The same results in DuckDB SQL, written from the meaning of each operator and not from its plan."""

from __future__ import annotations

from threatlog import fixed_values as fv

from .logs import duck_lines


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _search(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_text('(?i)' + pattern)})"


# Entries of the access log.
_LOG = f"log AS ({duck_lines('access')})"
_ENTRIES = _LOG + f""",
cut AS (SELECT line_no, line AS raw, regexp_extract(line, {_text(fv.ACCESS_LINE)}, ['ip', 'usr', 'tm', 'method', 'path', 'status']) AS f FROM log),
ent AS (SELECT line_no, raw, f.ip AS ip, f.usr AS "user", strptime(f.tm[1:20], '%d/%b/%Y:%H:%M:%S') AS ts, f.method AS method,
        f.path AS path, CAST(f.status AS INTEGER) AS status, raw[1:200] AS message,
        concat_ws(' ', f.path, raw[1:200], raw) AS pmr, concat_ws(' ', f.path, raw) AS pr FROM cut)"""

_SEARCHES = {
    "R001": ("pmr", fv.SQL_INJECTION, "pmr[1:200]"),
    "R002": ("pmr", fv.CROSS_SITE_SCRIPT, "pmr[1:200]"),
    "R003": ("pr", fv.PATH_TRAVERSAL, "pr[1:200]"),
    "R004": ("pr", fv.SENSITIVE_PATH, "path"),
    "R005": ("raw", fv.SCANNER, "raw[1:200]"),
    "R011": ("pmr", fv.FILE_INCLUSION, "pmr[1:200]"),
    "R012": ("pmr", fv.COMMAND_INJECTION, "pmr[1:200]"),
    "R013": ("pr", fv.WEB_SHELL, "path"),
    "R014": ("pr", fv.CONFIG_FILE, "path"),
}


def _template(text: str) -> str:
    for name, column in (("{ip}", "ip"), ("{user}", '"user"'), ("{status}", "CAST(status AS VARCHAR)")):
        text = text.replace("'", "''") if name == "{ip}" else text
        text = text.replace(name, f"' || {column} || '")
    return f"('{text}')"


def _one_rule(no, rule):
    rule_id, name, level, description, prefix = rule
    if rule_id == "R006":
        words = " OR ".join(f"contains(lower(message), {_text(w)})" for w in fv.AUTH_FAILURE_PHRASES)
        condition, evidence = f"({words} OR status IN (401, 403))", "raw[1:200]"
    elif rule_id == "R007":
        condition, evidence = "status >= 500", "raw[1:100]"
    else:
        text, pattern, evidence = _SEARCHES[rule_id]
        condition = _search(text, pattern)
    return (
        f"SELECT line_no, {no} AS rule_no, '{rule_id}' AS rule_id, {_text(name)} AS rule_name, '{level}' AS level, "
        f"{fv.SEVERITY[level]} AS level_score, {_template(description)} AS description, "
        f'{_template(prefix)} || {evidence} AS evidence, ip, "user", ts FROM ent WHERE {condition}'
    )


_HITS = _ENTRIES + ", hits AS (" + " UNION ALL ".join(
    _one_rule(no, rule) for no, rule in enumerate(fv.ROW_RULE_TEXTS, start=1)
) + ")"

_WORDS = " OR ".join(f"contains(lower(message), '{w}')" for w in fv.FAILURE_WORDS)
_COUNTED = f"""counted AS (
    SELECT 'fail' AS counter, ip, ts, line_no FROM ent WHERE {_WORDS} OR status IN (401, 403)
    UNION ALL SELECT 'not_found', ip, ts, line_no FROM ent WHERE status = 404
    UNION ALL SELECT 'request', ip, ts, line_no FROM ent),
sliding AS (
    SELECT counter, ip, ts, line_no,
        count(*) OVER w AS n, min(ts) OVER w AS window_start,
        count(*) OVER (PARTITION BY counter, ip, ts) AS at_ts,
        row_number() OVER (PARTITION BY counter, ip, ts ORDER BY line_no) AS nth
    FROM counted
    WINDOW w AS (PARTITION BY counter, ip ORDER BY ts RANGE BETWEEN INTERVAL 5 MINUTES PRECEDING AND CURRENT ROW)),
peaks AS (
    SELECT counter, ip, n AS peak, window_start, ts AS window_end,
        (SELECT min(line_no) FROM counted c WHERE c.counter = s.counter AND c.ip = s.ip) AS first_seq
    FROM (SELECT *, row_number() OVER (PARTITION BY counter, ip ORDER BY n DESC, ts, line_no) AS r FROM sliding) s WHERE r = 1)"""


def _burst_values():
    rows = []
    for no, (rule_id, name, level, counter, threshold, step, description, evidence) in enumerate(fv.BURST_RULE_TEXTS, start=1):
        rows.append(
            f"({no}, '{rule_id}', {_text(name)}, '{level}', {fv.SEVERITY[level]}, '{counter}', {threshold}, {step}, "
            f"{_text(description)}, {_text(evidence)})"
        )
    return "burst(rule_no, rule_id, rule_name, level, level_score, counter, threshold, step, d, e) AS (VALUES " + ", ".join(rows) + ")"


def _burst_text(column, n, start):
    return (
        f"replace(replace(replace(replace({column}, '{{n}}', CAST({n} AS VARCHAR)), '{{ip}}', ip), '{{minutes}}', '5'), "
        f"'{{start}}', strftime({start}, '%H:%M:%S'))"
    )


_BURSTS = _ENTRIES + ", " + _COUNTED + ", " + _burst_values() + f""",
bursts AS (SELECT rule_no, rule_id, rule_name, level, level_score, {_burst_text('d', 'peak', 'window_start')} AS description,
    {_burst_text('e', 'peak', 'window_start')} AS evidence, ip, window_end AS ts, peak AS count, first_seq
    FROM peaks JOIN burst USING (counter) WHERE peak >= threshold)"""

# The throttle as a line-by-line run: every row raises the count by one, a new step of the running peak alerts.
_STEPS = _ENTRIES + ", " + _COUNTED + ", " + _burst_values() + f""",
seen AS (SELECT *, n - at_ts + nth AS so_many FROM sliding),
running AS (SELECT *, max(so_many) OVER (PARTITION BY counter, ip ORDER BY ts, line_no) AS top FROM seen),
before AS (SELECT *, coalesce(lag(top) OVER (PARTITION BY counter, ip ORDER BY ts, line_no), 0) AS top_before FROM running),
steps AS (SELECT rule_no, rule_id, rule_name, level, level_score, counter, ip, ts, line_no, top // step AS alert_step,
    (top // step) * step AS count, {_burst_text('d', 'top', 'window_start')} AS description,
    {_burst_text('e', 'top', 'window_start')} AS evidence
    FROM before JOIN burst USING (counter) WHERE top >= threshold AND (top // step > top_before // step OR top_before < threshold))"""


def _with(ctes, query):
    return f"WITH {ctes} {query}"


def _time(expression):
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


_MERGED = _HITS + ", " + _BURSTS[len(_ENTRIES) + 2:] + """,
texts AS (SELECT rule_no, ip, "user", evidence, min(line_no) AS s FROM hits GROUP BY ALL),
five AS (SELECT rule_no, ip, "user", string_agg(evidence, ' || ' ORDER BY s) AS evidence FROM
    (SELECT *, row_number() OVER (PARTITION BY rule_no, ip, "user" ORDER BY s) AS r FROM texts) WHERE r <= 5 GROUP BY ALL),
sums AS (SELECT rule_no, rule_id, rule_name, level, level_score, ip, "user", count(*) AS count, min(line_no) AS first_seq,
    arg_min(description, line_no) AS description, arg_min(ts, line_no) AS ts FROM hits GROUP BY ALL),
threats AS (
    SELECT rule_id, rule_name, level, level_score, description, sums.ip, sums."user", ts, five.evidence, count, 0 AS phase, rule_no, first_seq
    FROM sums JOIN five USING (rule_no, ip, "user")
    UNION ALL
    SELECT rule_id, rule_name, level, level_score, description, ip, NULL, ts, evidence, count, 1, rule_no, first_seq FROM bursts)"""

_ORDER = "level_score DESC, phase, CASE WHEN phase = 1 THEN rule_no END NULLS FIRST, first_seq, rule_no"

_MIXED = f"log AS ({duck_lines('mixed')})"
_LINE_ENDS = f"""mixed AS (SELECT line_no, trim(line) AS raw FROM log),
fmt AS (SELECT line_no, raw, CASE WHEN raw = '' OR starts_with(raw, '#') THEN 'dropped'
    WHEN starts_with(raw, '{{') AND suffix(raw, '}}') AND json_valid(raw) THEN 'json'
    WHEN regexp_matches(raw, {_text(fv.ACCESS_LINE)}) THEN 'access'
    WHEN regexp_matches(raw, {_text(fv.SSH_LINE)}) THEN 'ssh'
    WHEN regexp_matches(raw, {_text(fv.SYSLOG_LINE)}) THEN 'syslog'
    WHEN regexp_matches(raw, {_text(fv.GENERIC_LINE)}) THEN 'generic'
    ELSE 'fallback' END AS format FROM mixed)"""
_FORMATS = _MIXED + ", " + _LINE_ENDS
_IP = _text(fv.IP_ADDRESS)


def _fields(fmt, columns):
    return _with(_FORMATS, f"SELECT line_no AS seq, {columns} FROM fmt WHERE format = '{fmt}'")


def _group(pattern):
    return lambda number: f"regexp_extract(raw, {_text(pattern)}, {number})"


_access, _ssh, _syslog, _generic = (
    _group(p) for p in (fv.ACCESS_LINE, fv.SSH_LINE, fv.SYSLOG_LINE, fv.GENERIC_LINE)
)


def _clock(expression, layout):
    return f"strftime(strptime({expression}, '{layout}'), '%Y-%m-%d %H:%M:%S') AS ts"


_BY_FORMAT = f"""CASE format
    WHEN 'access' THEN strptime({_access(3)}[1:20], '%d/%b/%Y:%H:%M:%S')
    WHEN 'ssh' THEN strptime('2024 ' || {_ssh(1)}, '%Y %b %d %H:%M:%S')
    WHEN 'syslog' THEN strptime('2024 ' || {_syslog(1)}, '%Y %b %d %H:%M:%S')
    WHEN 'generic' THEN strptime({_generic(1)}, '%Y-%m-%d %H:%M:%S')
    WHEN 'json' THEN strptime(raw->>'$.time', '%Y-%m-%dT%H:%M:%SZ')
    ELSE TIMESTAMP '2024-06-01' END"""

_DELIMITED = f"log AS ({duck_lines('delimited')}), parts AS (SELECT line_no, line, string_split(line, '|') AS p FROM log)"

_PAGES = f"SELECT page_id AS seq, {_search('html', fv.CROSS_SITE_SCRIPT)} AS has_script FROM pages"


def _severity(line):
    def any_of(*patterns):
        return " OR ".join(_search(line, p) for p in patterns)

    return (
        f"CASE WHEN {any_of(fv.SQL_INJECTION, fv.PATH_TRAVERSAL, fv.COMMAND_INJECTION, fv.WEB_SHELL)} THEN 'HIGH' "
        f"WHEN {any_of(fv.CROSS_SITE_SCRIPT, fv.SENSITIVE_PATH, fv.CONFIG_FILE, fv.FILE_INCLUSION)} THEN 'MEDIUM' "
        f"WHEN {_search(line, fv.LOW_LINE)} THEN 'LOW' ELSE 'ok' END"
    )


def _marked():
    safe = "replace(replace(replace(replace(e, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    cases = " ".join(
        f"WHEN '{rule}' THEN regexp_replace({safe}, {_text(pattern)}, '<mark>\\1</mark>', '{'gi' if ignore else 'g'}')"
        for rule, (pattern, ignore) in fv.EVIDENCE_MARKS.items()
    )
    return f"CASE rule_id {cases} ELSE {safe} END"


_SUMMARY = _MERGED + """,
top_ip AS (SELECT ip, count(*) AS n, min(line_no) AS s FROM ent GROUP BY ip ORDER BY n DESC, s LIMIT 10),
top_path AS (SELECT path, count(*) AS n, min(line_no) AS s FROM ent GROUP BY path ORDER BY n DESC, s LIMIT 10)"""

_LEVELS = "levels(position, level, level_score) AS (VALUES (0, 'CRITICAL', 4), (1, 'HIGH', 3), (2, 'MEDIUM', 2), (3, 'LOW', 1), (4, 'INFO', 0))"
_SCORE = "CAST(least(100, sum(level_score * count)) AS INTEGER)"
_BAND = "CASE WHEN {0} >= 75 THEN 'CRITICAL' WHEN {0} >= 50 THEN 'HIGH' WHEN {0} >= 25 THEN 'MEDIUM' ELSE 'LOW' END"


def _summary_columns():
    score = f"(SELECT {_SCORE} FROM threats)"
    return f"""SELECT '2024-06-01 00:00:00' AS generated_at, (SELECT count(*) FROM log) AS total_entries, (SELECT count(*) FROM ent) AS parsed_entries,
    (SELECT count(*) FROM threats) AS threat_count,
    (SELECT string_agg(level || '=' || n, ', ' ORDER BY level) FROM (SELECT level, count(*) AS n FROM threats GROUP BY level)) AS by_level,
    (SELECT count(DISTINCT ip) FROM ent) AS unique_ips, (SELECT count(DISTINCT path) FROM ent) AS unique_paths,
    (SELECT string_agg(ip || '=' || n, ', ' ORDER BY n DESC, s) FROM top_ip) AS top_ips,
    (SELECT string_agg(path || '=' || n, ', ' ORDER BY n DESC, s) FROM top_path) AS top_paths,
    (SELECT string_agg(m || '=' || n, ', ' ORDER BY m) FROM (SELECT strftime(ts, '%H:%M') AS m, count(*) AS n FROM ent GROUP BY m)) AS timeline,
    {score} AS risk_score, {_BAND.format(score)} AS risk_band"""


_ALERTING = "SELECT DISTINCT line_no FROM hits UNION SELECT line_no FROM steps"
_CONTEXT = _HITS + ", " + _STEPS[len(_ENTRIES) + 2:] + f""",
marks AS (SELECT log.line_no, line, a.line_no IS NOT NULL AS alerting FROM log LEFT JOIN ({_ALERTING}) a USING (line_no)),
near AS (SELECT line_no, line, max(CAST(alerting AS INTEGER)) OVER (ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS keep FROM marks)"""

_MINUTES = "minutes AS (SELECT strftime(ts, '%H:%M') AS minute, count(*) AS n FROM ent GROUP BY minute)"


def _layouts(status_needs: str) -> str:
    """The layouts of the delimited log, from its lines: features of each column, then roles from left to right.

    ``status_needs``: what a status column needs besides that its all-digit values are statuses.
    """
    fits = (
        ("ip", "any_ip"), ("method", "any_method"), ("status", f"all_status AND {status_needs}"), ("path", "any_path"), ("ts", "any_time"),
    )
    roles = ", ".join(f"CASE WHEN {test} THEN '{role}' END" for role, test in fits)
    column = lambda role: f"CAST(list_position(taken, '{role}') - 1 AS INTEGER) AS {role}_col"
    counts = ", ".join(
        f"min(len(line) - len(replace(line, {d}, ''))) AS lo{i}, max(len(line) - len(replace(line, {d}, ''))) AS hi{i}"
        for i, d in enumerate(("'|'", "','", "chr(9)", "';'"))
    )
    even = " ".join(f"WHEN lo{i} > 0 AND lo{i} = hi{i} THEN {d}" for i, d in enumerate(("'|'", "','", "chr(9)", "';'")))
    some = " ".join(f"WHEN lo{i} > 0 THEN {d}" for i, d in reversed(list(enumerate(("'|'", "','", "chr(9)", "';'")))))
    return f"""WITH RECURSIVE log AS (SELECT w AS written, line_no, replace(line, '|', w) AS line FROM ({duck_lines('delimited')}), unnest(['|', ',', chr(9), ';', ' ']) AS u(w)),
    picked AS (SELECT written, CASE {even} {some} ELSE ' ' END AS delimiter FROM (SELECT written, {counts} FROM log GROUP BY written)),
    parts AS (SELECT written, delimiter, CASE WHEN delimiter = ' ' THEN string_split_regex(trim(line), '\\s+') ELSE string_split(line, delimiter) END AS p FROM log JOIN picked USING (written)),
    tok AS (SELECT written, CAST(i - 1 AS INTEGER) AS position, trim(p[i]) AS t FROM parts, unnest(range(1, len(p) + 1)) AS u(i)),
    cols AS (SELECT written, position, count(*) AS n, bool_or(regexp_matches(t, {_IP})) AS any_ip, bool_or(regexp_matches(t, {_text('(?i)' + fv.METHOD_TOKEN)})) AS any_method,
        bool_or(regexp_matches(t, '^\\d+$')) AS any_digits, bool_and(NOT regexp_matches(t, '^\\d+$') OR regexp_matches(t, {_text(fv.STATUS_TOKEN)})) AS all_status,
        bool_or(regexp_matches(t, {_text(fv.PATH_TOKEN)})) AS any_path, bool_or(regexp_matches(t, '[-/:]') AND regexp_matches(t, '\\d')) AS any_time
        FROM tok GROUP BY written, position QUALIFY n = max(n) OVER (PARTITION BY written)),
    fit AS (SELECT written, position, [x FOR x IN [{roles}] IF x IS NOT NULL] AS fits FROM cols),
    walk AS (SELECT written, CAST(-1 AS INTEGER) AS position, CAST([] AS VARCHAR[]) AS taken FROM picked
        UNION ALL SELECT w.written, f.position, list_append(w.taken, coalesce(([x FOR x IN f.fits IF NOT list_contains(w.taken, x)])[1], '-'))
        FROM walk w JOIN fit f ON f.written = w.written AND f.position = w.position + 1),
    whole AS (SELECT written, taken FROM walk QUALIFY position = max(position) OVER (PARTITION BY written))
    SELECT written, delimiter, {column('ip')}, {column('ts')}, {column('method')}, {column('path')}, {column('status')},
        CAST(nullif(len(taken) - list_position(list_reverse(taken), '-'), len(taken)) AS INTEGER) AS msg_col
    FROM whole JOIN picked USING (written)"""


def oracle_sql() -> dict[str, str]:
    e = _ENTRIES
    mixed_entry = f"""SELECT line_no AS seq, format, {_time(_BY_FORMAT)} AS ts,
        CASE format WHEN 'access' THEN {_access(1)} WHEN 'ssh' THEN {_ssh(4)} WHEN 'json' THEN raw->>'$.client_ip'
             ELSE nullif(regexp_extract(raw, {_IP}), '') END AS ip,
        CASE format WHEN 'access' THEN CAST({_access(6)} AS INTEGER)
             WHEN 'json' THEN CAST(regexp_extract(raw->>'$.status', '^\\d+') AS INTEGER) END AS status,
        CASE format WHEN 'syslog' THEN {_syslog(2)} WHEN 'generic' THEN {_generic(2)} ELSE raw[1:200] END AS message
        FROM fmt WHERE format <> 'dropped'"""
    found = {
        "rendered_lines": _with(_LOG, "SELECT line_no, line FROM log"),
        "parse_access": _with(
            e,
            f"""SELECT line_no AS seq, ip, "user", {_time('ts')} AS ts, 0 AS tz_offset, method, path, status, message FROM ent""",
        ),
        "parse_ssh": _fields(
            "ssh",
            f"""{_ssh(4)} AS ip, {_ssh(3)} AS "user", {_clock("'2024 ' || " + _ssh(1), '%Y %b %d %H:%M:%S')}""",
        ),
        "parse_syslog": _fields(
            "syslog",
            f"""{_syslog(2)} AS message, {_clock("'2024 ' || " + _syslog(1), '%Y %b %d %H:%M:%S')}""",
        ),
        "parse_generic": _fields(
            "generic",
            f"""{_generic(2)} AS message, nullif(regexp_extract(raw, {_IP}), '') AS ip, {_clock(_generic(1), '%Y-%m-%d %H:%M:%S')}""",
        ),
        "parse_json": _fields(
            "json",
            f"""raw->>'$.client_ip' AS ip, raw->>'$.uri' AS path,
            CAST(regexp_extract(raw->>'$.status', '^\\d+') AS INTEGER) AS status, {_clock("raw->>'$.time'", '%Y-%m-%dT%H:%M:%SZ')}""",
        ),
        "parse_delimited": _with(
            _DELIMITED,
            "SELECT line_no AS seq, p[1] AS ts, p[2] AS ip, p[3] AS method, p[4] AS path, CAST(p[5] AS INTEGER) AS status, p[6] AS message FROM parts",
        ),
        "parse_mixed_dispatch": _with(_FORMATS, mixed_entry),
        "parse_quality": _with(_FORMATS, "SELECT format, count(*) AS n FROM fmt GROUP BY format"),
        "rule_hits": _with(
            _HITS,
            f"""SELECT line_no AS seq, rule_id, rule_name, level, level_score, description, evidence, ip, "user", {_time('ts')} AS ts FROM hits""",
        ),
        "rule_hit_counts": _with(_HITS, "SELECT rule_id, count(*) AS n FROM hits GROUP BY rule_id"),
        "mixed_rule_hit_counts": _with(
            _FORMATS + f", m AS ({mixed_entry}) ",
            """SELECT rule_id, count(*) AS n FROM (
            SELECT 'R006' AS rule_id FROM m WHERE regexp_matches(lower(message), 'failed password|authentication failure|invalid user|failed login|unauthorized') OR status IN (401, 403)
            UNION ALL SELECT 'R007' FROM m WHERE status >= 500) GROUP BY rule_id""",
        ),
        "line_severity": _with(_LOG, f"SELECT line_no AS seq, {_severity('line')} AS severity FROM log"),
        "line_search": _with(
            _LOG, "SELECT line_no AS seq, line FROM log WHERE contains(lower(line), 'sqlmap') ORDER BY line_no LIMIT 100"
        ),
        "peak_windows": _with(
            e + ", " + _COUNTED,
            f"SELECT counter, ip, peak, {_time('window_start')} AS window_start, {_time('window_end')} AS window_end, first_seq FROM peaks",
        ),
        "threshold_threats": _with(
            _BURSTS, f"SELECT rule_id, level, description, evidence, ip, {_time('ts')} AS ts, count FROM bursts"
        ),
        "throttled_alert_steps": _with(
            _STEPS, f"SELECT rule_id, ip, alert_step, count, {_time('ts')} AS ts, description, evidence FROM steps"
        ),
        "alert_trigger_rows": _with(_STEPS, "SELECT rule_id, ip, alert_step, line_no AS seq FROM steps"),
        "context_lines": _with(_CONTEXT, "SELECT line_no, line FROM near WHERE keep = 1"),
        "merged_threats": _with(
            _MERGED,
            f"""SELECT rule_id, rule_name, level, level_score, description, ip, "user", {_time('ts')} AS ts, evidence, count, first_seq FROM threats""",
        ),
        "one_scan_threats": _with(
            _MERGED,
            f"""SELECT rule_id, rule_name, level, level_score, description, ip, "user", {_time('ts')} AS ts, evidence, count, first_seq FROM threats""",
        ),
        "ranked_threats": _with(
            _MERGED,
            f"""SELECT row_number() OVER (ORDER BY {_ORDER}) AS place, rule_id, ip, "user", count FROM threats ORDER BY place LIMIT 10""",
        ),
        "threats_of_level": _with(_MERGED, """SELECT rule_id, ip, "user", count FROM threats WHERE level = 'MEDIUM'"""),
        "threats_by_level": _with(_MERGED, "SELECT level, count(*) AS n FROM threats GROUP BY level"),
        "severity_matrix": _with(
            _MERGED + ", " + _LEVELS + ", c AS (SELECT position, level, (SELECT count(*) FROM threats t WHERE t.level = levels.level) AS n FROM levels)",
            "SELECT position, level, n, CAST(floor(n / greatest(max(n) OVER (), 1) * 100 + 0.5) AS BIGINT) AS percent FROM c",
        ),
        "risk_score": _with(_MERGED, f"SELECT risk_score, {_BAND.format('risk_score')} AS band FROM (SELECT {_SCORE} AS risk_score FROM threats)"),
        "gate": _with(_MERGED, "SELECT max(level_score) >= 3 AS fail FROM threats"),
        "top_ips": _with(e, "SELECT ip, count(*) AS n, min(line_no) AS first_seq FROM ent GROUP BY ip ORDER BY n DESC, first_seq LIMIT 10"),
        "top_paths": _with(e, "SELECT path, count(*) AS n, min(line_no) AS first_seq FROM ent GROUP BY path ORDER BY n DESC, first_seq LIMIT 10"),
        "bar_shares": _with(
            e,
            """SELECT path, n, CAST(floor(n / max(n) OVER () * 100 + 0.5) AS BIGINT) AS percent FROM
            (SELECT path, count(*) AS n, min(line_no) AS s FROM ent GROUP BY path ORDER BY n DESC, s LIMIT 6)""",
        ),
        "status_counts": _with(e, "SELECT status, count(*) AS n FROM ent GROUP BY status"),
        "timeline_hhmm": _with(e + ", " + _MINUTES, "SELECT minute, n FROM minutes"),
        "timeline_minute": _with(e, "SELECT strftime(ts, '%Y-%m-%d %H:%M') AS minute, count(*) AS n FROM ent GROUP BY minute"),
        "timeline_stats": _with(
            e + ", " + _MINUTES,
            "SELECT CAST(sum(n) AS BIGINT) AS total, max(n) AS peak, count(*) AS buckets, (SELECT min(minute) FROM minutes WHERE n = (SELECT max(n) FROM minutes)) AS peak_minute FROM minutes",
        ),
        "distinct_counts": _with(e, "SELECT count(DISTINCT ip) AS unique_ips, count(DISTINCT path) AS unique_paths FROM ent"),
        "summary_report": _with(_SUMMARY, _summary_columns()),
        "stat_tiles": _with(
            _MERGED,
            """SELECT (SELECT count(*) FROM log) AS lines, (SELECT count(DISTINCT ip) FROM ent) AS unique_ips, count(*) AS threats,
            count(*) FILTER (level = 'CRITICAL') AS critical, count(*) FILTER (level = 'HIGH') AS high, count(*) FILTER (level = 'MEDIUM') AS medium FROM threats""",
        ),
        "threat_details": _with(
            _HITS + ", " + _BURSTS[len(_ENTRIES) + 2:] + """, texts AS (SELECT rule_no, rule_id, ip, "user", evidence, min(line_no) AS s FROM hits GROUP BY ALL),
            two AS (SELECT *, row_number() OVER (PARTITION BY rule_no, ip, "user" ORDER BY s) AS r FROM texts)""",
            """SELECT rule_id, ip, "user", string_agg(evidence[1:120], ' || ' ORDER BY s) AS evidence FROM two WHERE r <= 2 GROUP BY rule_id, ip, "user"
            UNION ALL SELECT rule_id, ip, NULL, evidence[1:120] FROM bursts""",
        ),
        "playbook_join": _with(
            _MERGED,
            """SELECT rule_id, ip, count(*) AS n, CASE rule_id WHEN 'R008' THEN 'Drop all traffic from ' || ip WHEN 'R001' THEN 'Block ' || ip || ' at the web application firewall' ELSE '-' END AS action FROM threats GROUP BY rule_id, ip""",
        ),
        "evidence_marked": _with(
            _HITS + ", one AS (SELECT DISTINCT rule_id, evidence AS e FROM hits)",
            f"SELECT rule_id, e AS evidence, {_marked()} AS marked FROM one",
        ),
        "alert_lines": _with(
            _STEPS,
            """SELECT '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] [' || level || '] ' || rule_name || ' - IP: ' || ip || ' - ' || description AS line FROM steps""",
        ),
        "notable_alerts": _with(_HITS, "SELECT line_no AS seq, rule_id FROM hits WHERE level_score >= 3"),
        "ip_extraction": f"""SELECT doc_id, CAST(i AS INTEGER) AS position, ips[i] AS ip FROM
            (SELECT doc_id, regexp_extract_all(text, {_IP}) AS ips FROM documents), unnest(range(1, len(ips) + 1)) AS u(i)""",
        "page_script_scan": _PAGES,
        "conversation_severity": f"SELECT conv_id, turn, {_severity('text')} AS severity FROM conversations",
        "delimiter_stats": _with(
            f"log AS ({duck_lines('delimited')})",
            "SELECT count(*) AS n_lines, CAST(0 AS BIGINT) AS n_json, "
            + ", ".join(
                f"CAST({f}(len(line) - len(replace(line, {d}, ''))) AS INTEGER) AS {f}_{name}"
                for name, d in (("pipe", "'|'"), ("comma", "','"), ("tab", "chr(9)"), ("semicolon", "';'"))
                for f in ("min", "max")
            )
            + " FROM log",
        ),
        "column_stats": _with(
            _DELIMITED + ", tok AS (SELECT CAST(i - 1 AS INTEGER) AS position, p[i] AS t FROM parts, unnest(range(1, len(p) + 1)) AS u(i))",
            f"""SELECT position, bool_or(regexp_matches(t, {_IP})) AS any_ip, bool_or(regexp_matches(t, {_text('(?i)' + fv.METHOD_TOKEN)})) AS any_method,
            bool_or(regexp_matches(t, '^\\d+$')) AS any_digits, bool_and(NOT regexp_matches(t, '^\\d+$') OR regexp_matches(t, {_text(fv.STATUS_TOKEN)})) AS all_status,
            bool_or(regexp_matches(t, {_text(fv.PATH_TOKEN)})) AS any_path, bool_or(regexp_matches(t, '[-/:]') AND regexp_matches(t, '\\d')) AS any_time
            FROM tok GROUP BY position""",
        ),
        "custom_rule": _with(
            e, """SELECT 'C001' AS rule_id, ip, "user", count(*) AS count, min(line_no) AS first_seq FROM ent WHERE method = 'POST' AND status >= 200 AND path LIKE '/purchase%' GROUP BY ip, "user" """
        ),
        "custom_threshold": _with(
            e + f""", c AS (SELECT ip, ts, count(*) OVER (PARTITION BY ip ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS n FROM ent WHERE status >= 500)""",
            "SELECT 'C010' AS rule_id, ip, max(n) AS count FROM c GROUP BY ip HAVING max(n) >= 4",
        ),
        "stream_rule_hits": _with(_HITS, "SELECT line_no AS seq, rule_id FROM hits"),
        "stream_alert_steps": _with(_STEPS, f"SELECT rule_id, ip, alert_step, count, {_time('ts')} AS ts FROM steps"),
        "stream_live_counts": _with(
            e + ", " + _MINUTES,
            """SELECT 'ip' AS kind, ip AS name, count(*) AS n FROM ent GROUP BY ip UNION ALL SELECT 'path', path, count(*) FROM ent GROUP BY path
            UNION ALL SELECT 'status', CAST(status AS VARCHAR), count(*) FROM ent GROUP BY status UNION ALL SELECT 'minute', minute, n FROM minutes""",
        ),
        "stream_context_lines": _with(_CONTEXT, "SELECT line FROM near WHERE keep = 1"),
    }
    found["context_of_files"] = _with(
        _CONTEXT, "SELECT n AS line_no, line FROM (SELECT *, row_number() OVER (ORDER BY line_no) AS n FROM near) WHERE keep = 1"
    )
    alert = "'[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] [' || level || '] ' || rule_name || ' - IP: ' || ip || ' - ' || description"
    place = "line_no - (SELECT min(line_no) FROM log) + 1 AS line_no"
    found["stream_alerts"] = _with(
        _HITS + ", " + _STEPS[len(_ENTRIES) + 2:],
        f"SELECT rule_id, ip, CAST(1 AS BIGINT) AS count, {place} FROM hits UNION ALL SELECT rule_id, ip, count, {place} FROM steps",
    )
    found["stream_alert_log"] = _with(
        _HITS + ", " + _STEPS[len(_ENTRIES) + 2:], f"SELECT {alert} AS line FROM hits UNION ALL SELECT {alert} FROM steps"
    )
    found["stream_text_hits"] = found["rule_hit_counts"]
    found["stream_delimited"] = found["parse_delimited"]
    found["inferred_layouts"] = _layouts("true")
    found["inferred_layout"] = f"SELECT 'delimited' AS kind, * EXCLUDE (written) FROM ({_layouts('any_digits')}) WHERE written = '|'"
    found["parse_epoch_times"] = _with(
        f"log AS ({duck_lines('epoch')})",
        """SELECT line_no AS seq, line->>'$.client_ip' AS ip, line->>'$.uri' AS path,
        strftime(make_timestamp(1704067200000000 + (line_no // 10) * 1000000 + CASE line_no % 3 WHEN 2 THEN 500000 ELSE 0 END), '%Y-%m-%d %H:%M:%S.%g') AS ts FROM log""",
    )
    found["line_feed"] = _with(
        _LOG, f"SELECT line_no AS seq, line, {_severity('line')} AS severity, count(*) OVER () AS total FROM log WHERE contains(lower(line), 'etc') ORDER BY line_no LIMIT 100"
    )
    # The same rows by another way.
    same = {"composed_threats": "merged_threats", "stream_threats": "merged_threats", "stream_report": "summary_report"}
    return found | {name: found[of] for name, of in same.items()}
