import random
import re

from pyspark.sql import functions as F

import threatlog as tl
from threatlog import fixed_values as fv
from threatlog.functions.text import HINTS

PARTS = [
    "union select", "' or '1'='1", "1=1", "; --", "--", "drop table", "insert into", "exec(", "xp_cmdshell", "../", "..\\", "%2e%2e/", "%252E", "; cat x",
    "| id", "`whoami`", "$(x)", "&& ls", "shell.php", "CMD.JSP", "c99.php", "<ScRipt>", "JAVASCRIPT:", "onerror=", "eval(", "alert(1)", "document.cookie", "/admin",
    "/phpMyAdmin", "/actuator", ".env", ".git/config", "wp-config.php", "settings.py", "dump.sql", ".bak", "=http://x", "=ftp://", "/etc/hosts", "boot.ini",
    "Failed", "INVALID USER", "unauthorized", "faıled", "ſelect", "unauthoriſed", "K", "plain", "words", "/a/b?c=d", "200", "é", "日本",
]
GROUPS = (
    ("HIGH", (fv.SQL_INJECTION, fv.PATH_TRAVERSAL, fv.COMMAND_INJECTION, fv.WEB_SHELL)),
    ("MEDIUM", (fv.CROSS_SITE_SCRIPT, fv.SENSITIVE_PATH, fv.CONFIG_FILE, fv.FILE_INCLUSION)),
    ("LOW", (fv.LOW_LINE,)),
)


def test_hints_change_no_class(spark):
    """The class by literals and patterns is that by the patterns alone."""
    make = random.Random(8)
    texts = ["".join(make.choice(PARTS) + make.choice(["", " ", "  "]) for _ in range(make.randint(0, 5))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "line string")
    plain = F.lit("ok")
    for name, patterns in reversed(GROUPS):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | F.col("line").rlike(fv.THREAT_FLAGS + p)
        plain = F.when(hit, name).otherwise(plain)
    rows = df.select("line", tl.line_severity(F.col("line")).alias("found"), plain.alias("plain")).collect()
    assert [r["line"] for r in rows if r["found"] != r["plain"]] == []
    assert {r["found"] for r in rows} == {"HIGH", "MEDIUM", "LOW", "ok"}


def test_every_match_in_plain_text_holds_a_hint():
    make = random.Random(4)
    for _ in range(20_000):
        text = "".join(make.choice(PARTS) for _ in range(make.randint(1, 4)))
        if text.isascii():
            for pattern, hints in HINTS.items():
                if re.search(pattern, text, re.IGNORECASE):
                    assert any(h in text.lower() for h in hints), (pattern, text)


def test_line_feed(spark, log):
    lines = log(["", "An attack ../ here", "calm", "ATTACK again"] + [f"attack {n}" for n in range(200)] + ["  "])
    rows = tl.line_feed(lines, "Attack", limit=5).collect()
    assert sorted((r["seq"], r["severity"]) for r in rows) == [(2, "HIGH"), (4, "ok"), (5, "ok"), (6, "ok"), (7, "ok")]
    assert {r["total"] for r in rows} == {202}
    assert {r["total"] for r in tl.line_feed(lines, limit=3).collect()} == {203}
    assert tl.line_feed(lines, "nowhere").count() == 0
