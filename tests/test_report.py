import json
from datetime import datetime

import threatlog as tl

AS_OF = datetime(2026, 6, 1, 12)


def line(path, status=200, ip="1.1.1.1", at="17:00:00"):
    return f'{ip} - - [20/May/2026:{at} +0000] "GET {path} HTTP/1.1" {status} 512'


TEXTS = (
    [line("/login", 401, at=f"17:00:{n:02d}") for n in range(6)]
    + [line("/b", 200, "2.2.2.2"), line("/a", 500, "3.3.3.3"), "", "# c", line("/\"q\"", ip="2.2.2.2")]
    + [line("/x?s=<script>", 0, "3.3.3.3", "18:01:00").replace('" 0 ', '" 000 ')]
)


def test_document_is_one_json_report(spark, log, tmp_path):
    analysis = tl.Analysis(log(TEXTS), as_of=AS_OF)
    tl.save_report(analysis, str(tmp_path / "report"))
    parts = sorted((tmp_path / "report").glob("part-*"))
    report = json.loads("".join(p.read_text() for p in parts))
    assert report["generated_at"] == "2026-06-01T12:00:00"
    assert (report["total_entries"], report["parsed_entries"]) == (12, 10)
    ranked = [(t["rule_id"], t["ip"], t["count"]) for t in report["threats"]]
    assert ranked == [("R008", "1.1.1.1", 6), ("R002", "3.3.3.3", 1), ("R006", "1.1.1.1", 6), ("R007", "3.3.3.3", 1)]
    assert report["threats"][2] == {
        "rule_id": "R006", "rule_name": "Authentication Failure", "level": "LOW",
        "description": "Login failure for user '-' from 1.1.1.1", "ip": "1.1.1.1", "user": "-",
        "timestamp": "2026-05-20T17:00:00+00:00",
        "evidence": [f"Failure log: {TEXTS[n]}" for n in range(5)], "count": 6,
    }
    assert report["summary"] == {
        "by_level": {"CRITICAL": 1, "MEDIUM": 1, "LOW": 2}, "status_codes": {"401": 6, "200": 2, "500": 1},
        "unique_ips": 3, "unique_paths": 5,
    }
    assert report["top_ips"] == [["1.1.1.1", 6], ["2.2.2.2", 2], ["3.3.3.3", 2]]
    assert report["top_paths"][0] == ["/login", 6] and ['/"q"', 1] in report["top_paths"]
    assert report["timeline"] == {"17:00": 9, "18:01": 1}
    assert report["risk_score"] == min(100, 4 * 6 + 2 + 6 + 1)
    (row,) = tl.summary_report(analysis).collect()
    assert row["risk_band"] == "MEDIUM" and row["threat_count"] == 4
    (tiles,) = tl.stat_tiles(analysis).collect()
    assert tuple(tiles) == (12, 3, 4, 1, 0, 1)


def test_a_clean_or_empty_log(log):
    for texts, total in (([], 0), (["all quiet"], 1)):
        doc = [r["line"] for r in tl.report_lines(tl.Analysis(log(texts), as_of=AS_OF)).collect()]
        report = json.loads("".join(doc))
        assert (report["threats"], report["risk_score"], report["total_entries"]) == ([], 0, total)
        assert report["summary"]["by_level"] == {} and report["summary"]["status_codes"] == {}


def test_gate_matrix_playbook_and_alert_text(spark, log):
    threats = tl.Analysis(log(TEXTS), as_of=AS_OF).threats
    assert tl.gate(threats).first()["fail"] is True
    assert tl.gate(threats.where("level = 'LOW'")).first()["fail"] is False
    assert tl.gate(threats.limit(0)).first()["fail"] is False
    matrix = tl.severity_matrix(threats).orderBy("position").collect()
    assert [(r["level"], r["n"], r["percent"]) for r in matrix] == [
        ("CRITICAL", 1, 50), ("HIGH", 0, 0), ("MEDIUM", 1, 50), ("LOW", 2, 100), ("INFO", 0, 0),
    ]
    advised = {r["rule_id"]: r for r in tl.with_playbook(threats).collect()}
    assert advised["R008"]["action"] == "Drop all traffic from 1.1.1.1" and len(advised["R008"]["steps"]) >= 3
    other = spark.createDataFrame([("X", "Odd", "what", None)], "rule_id string, rule_name string, description string, ip string")
    (general,) = tl.with_playbook(other).collect()
    assert (general["title"], general["meaning"]) == ("Odd", "what") and general["action"]
    texts = {r["line"] for r in tl.alert_lines(threats.where("rule_id = 'R006'")).collect()}
    assert texts == {
        "[2026-05-20T17:00:00+00:00] [LOW] Authentication Failure - IP: 1.1.1.1 - Login failure for user '-' from 1.1.1.1"
    }
    (score,) = tl.with_level_score(spark.createDataFrame([("HIGH",)], "level string")).collect()
    assert score["level_score"] == 3


def test_search_and_colours(log):
    lines = log(["GET /ADMIN", "", "plain", "Failed x", "/../etc"])
    assert [r["line"] for r in tl.search_lines(lines, "admin").collect()] == ["GET /ADMIN"]
    assert len(tl.search_lines(lines).collect()) == 4
    assert [r["severity"] for r in tl.line_severities(lines).orderBy("seq").collect()] == ["MEDIUM", "ok", "LOW", "HIGH"]
