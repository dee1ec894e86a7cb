import re
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import threatlog as tl
from threatlog import fixed_values as fv

AS_OF = datetime(2026, 6, 1)


def access(path, status=200, agent="", ip="192.168.1.45", user="-", at="17:00:00"):
    return f'{ip} - {user} [20/May/2026:{at} +0000] "GET {path} HTTP/1.1" {status} 512{agent}'


def hits(log, texts):
    found = tl.rule_hits(tl.parse_logs(log(texts), as_of=AS_OF)).collect()
    by_line = {n: [] for n in range(1, len(texts) + 1)}
    for row in sorted(found, key=lambda r: (r["seq"], r["rule_no"])):
        by_line[row["seq"]].append(row)
    return by_line


def test_each_rule_and_its_near_misses(log):
    cases = [
        (access("/p?q=1'union+select"), ["R001"]),
        (access("/products?id=1' UNION SELECT a FROM users--"), ["R001"]),
        (access("/x?drop=table"), []),
        (access("/p?id=1'or'1'='1"), []),
        (access("/q?s=<script>x"), ["R002"]),
        (access("/q?JavaScript:go"), ["R002"]),
        (access("/q?evaluate(1)"), []),
        (access("/../../etc/passwd", 403), ["R003", "R006", "R011"]),
        (access("/a/%2E%2e/b"), ["R003"]),
        (access("/a/%252E"), ["R003"]),
        (access("/a..b"), []),
        (access("/API/v12/Admin"), ["R004"]),
        (access("/actuator/health"), ["R004"]),
        (access("/myadmin"), []),
        (access("/", agent=' "-" "Nikto/2"'), ["R005"]),
        (access("/login", 401), ["R006"]),
        ("May 20 17:00:00 s app[1]: UNAUTHORIZED", ["R006"]),
        ("May 20 17:00:00 s app[1]: failed job", []),
        (access("/boom", 503), ["R007"]),
        (access("/boom", 499), []),
        (access("/index.php?file=http://evil/shell.txt"), ["R011"]),
        (access("/run?cmd=;whoami"), ["R012"]),
        (access("/run?cmd=$(x)"), ["R012"]),
        (access("/run?a=1&idle=2"), []),
        (access("/uploads/shell.php"), ["R013"]),
        (access("/shell.phtml"), []),
        (access("/.env"), ["R014"]),
        (access("/data.SQL"), ["R014"]),
        (access("/q?u=un\u0131on+\u017felect+1+FROM"), ["R001"]),
        ('{"path": "\\/admin", "message": "m", "status": 200}', ["R004"]),
    ]
    # The tautology needs blanks, which end the path and make it free text.
    cases.append((access("/p?id=1' or '1'='1"), ["R001"]))
    found = hits(log, [text for text, _ in cases])
    got = [(text, [h["rule_id"] for h in found[n]]) for n, (text, _) in enumerate(cases, start=1)]
    assert got == cases


def test_texts_of_a_hit(log):
    line = access("/boom?x=;id", 500, ip="h", user="bob")
    by_rule = {h["rule_id"]: h for h in hits(log, [line, "x failed login 1=1"])[1]}
    assert by_rule["R007"]["description"] == "HTTP 500 response logged"
    assert by_rule["R007"]["evidence"] == "Status 500 message: " + line[:100]
    assert by_rule["R012"]["description"] == "Possible command injection from h"
    assert by_rule["R012"]["evidence"] == ("Matched command injection: " + f"/boom?x=;id {line} {line}"[:200])
    free = {h["rule_id"]: h for h in hits(log, ["x failed login 1=1"])[1]}
    assert free["R006"]["description"] == "Login failure for user 'unknown' from None"
    assert free["R001"]["description"] == "Possible SQLi in request from None"


_PIECES = st.sampled_from(
    [
        "union", "select", " ", "+", "from", "insert", "into", "--", ";", "'", "or", "1=1", "'1'='1'", "exec", "(",
        "<script", ">", "onload=", "alert(", "..", "/", "\\", "%2e", "%252e", "/admin", "nmap", "=http", "s://",
        "/etc/", "passwd", "hosts", "&", "|", "`", "cat", "id", "$(", ")", "shell", ".php", "cmd", ".env", ".sql",
        "config", ".json", "a", "\u00e9", "\u212a", "\u017f", "DROP", "Table", "#",
    ]
)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(_PIECES, min_size=1, max_size=9).map("".join), min_size=150, max_size=250))
def test_hints_never_hide_a_match(log, texts):
    """Free-text lines, all pattern rules, against Python's own regular expressions."""
    patterns = {
        "R001": (fv.SQL_INJECTION, 2), "R002": (fv.CROSS_SITE_SCRIPT, 2), "R003": (fv.PATH_TRAVERSAL, 1),
        "R004": (fv.SENSITIVE_PATH, 1), "R005": (fv.SCANNER, 1), "R011": (fv.FILE_INCLUSION, 2),
        "R012": (fv.COMMAND_INJECTION, 2), "R013": (fv.WEB_SHELL, 1), "R014": (fv.CONFIG_FILE, 1),
    }
    entries = tl.parse_logs(log(texts), as_of=AS_OF).where(F.col("format") == "fallback")
    lines = {r["seq"]: r["raw"] for r in entries.collect()}
    expected = {
        (seq, rule) for seq, raw in lines.items() for rule, (pattern, times) in patterns.items()
        if re.search(pattern, " ".join([raw] * times), re.IGNORECASE)
    }
    found = {(r["seq"], r["rule_id"]) for r in tl.rule_hits(entries).collect() if r["rule_id"] in patterns}
    assert found == expected


def test_merge_keeps_first_texts_and_five_evidences(log):
    texts = [access(f"/a{n % 7}?x=;id", at=f"17:00:{n:02d}") for n in range(20)]
    texts += [access("/z?x=;id", user="eve"), "junk ;id", "junk ;id"]
    entries = tl.parse_logs(log(texts), as_of=AS_OF)
    threats = {(r["ip"], r["user"]): r for r in tl.merge_threats(tl.rule_hits(entries)).collect()}
    assert len(threats) == 3
    main = threats["192.168.1.45", "-"]
    assert (main["count"], main["first_seq"], main["ts"]) == (20, 1, datetime(2026, 5, 20, 17))
    assert [e.split()[3] for e in main["evidence"]] == [f"/a{n}?x=;id" for n in range(5)]
    assert threats[None, None]["count"] == 2 and len(threats[None, None]["evidence"]) == 1
    one_scan = tl.Analysis(log(texts), as_of=AS_OF).threats.where("phase = 0")
    assert sorted(map(str, one_scan.collect())) == sorted(map(str, threats.values()))


def test_custom_rule_with_its_own_text(log):
    rule = tl.Rule("C001", "Big", "INFO", F.col("status") == 201, F.col("path"), F.concat(F.lit("made "), F.col("path")))
    rules = tl.default_rules().with_rule(rule)
    lines = log([access("/b", 201), access("/c", 201), access("/b", 201)])
    for merged in (
        tl.merge_threats(tl.rule_hits(tl.parse_logs(lines, as_of=AS_OF), rules), rules=rules),
        tl.Analysis(lines, as_of=AS_OF, rules=rules).threats,
    ):
        (row,) = merged.collect()
        assert (row["rule_id"], row["description"], row["evidence"], row["count"]) == ("C001", "made /b", ["/b", "/c"], 3)
