import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import threatlog as tl
from threatlog.plans import context

AS_OF = datetime(2026, 6, 1)


def _texts(n, seed, attacks=0.01):
    make = random.Random(seed)
    for i in range(n):
        second = i // 4
        at = f"20/May/2026:10:{second // 60:02d}:{second % 60:02d} +0000"
        path = "/../../etc/passwd" if make.random() < attacks else f"/p{i}"
        status = 401 if make.random() < 0.08 else 200
        yield make.choice([f'10.0.0.{make.randrange(2)} - - [{at}] "GET {path} HTTP/1.1" {status} 5'] * 12 + ["# note", ""])


def _brute(spark, numbered):
    """From the single operators: hits and triggers, and the 14 lines before each."""
    entries = tl.parse_logs(numbered, as_of=AS_OF)
    alerting = {(r["source"], r["seq"]) for r in tl.rule_hits(entries).collect()}
    alerting |= {(r["source"], r["seq"]) for r in tl.alert_rows(entries, tl.alert_steps(tl.ticks(entries))).collect()}
    of_seq = {r["seq"]: (r["source"], r["line_no"]) for r in numbered.collect()}
    keep = {(s, n - back) for s, n in (of_seq[q] for _, q in alerting) for back in range(15)}
    return sorted((r["source"] or "", r["line_no"], r["line"]) for r in numbered.collect() if (r["source"], r["line_no"]) in keep)


def _found(df):
    return sorted((r["source"] or "", r["line_no"], r["line"]) for r in df.collect())


@pytest.mark.parametrize("numbered", [True, False])
def test_frames(spark, log, numbered):
    lines = log(list(_texts(500, 1)), "a").union(log(list(_texts(300, 2)), None).withColumn("seq", F.col("seq") + 1000))
    with_numbers = tl.number_lines(lines)
    expected = _brute(spark, with_numbers)
    assert 30 < len(expected) < 780
    assert _found(tl.log_context(with_numbers if numbered else lines, as_of=AS_OF)) == expected


@pytest.mark.parametrize("source", [None, "all"])
def test_files_in_many_blocks(spark, tmp_path, source):
    texts = {name: list(_texts(n, len(name) + n)) for name, n in (("a.log", 700), ("b.log", 3), ("c.log", 300), ("d.log", 5))}
    for name, rows in texts.items():
        (tmp_path / name).write_text("".join(f"{x}\n" for x in rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        lines = tl.read_logs(spark, str(tmp_path), source=source)
        assert lines.select("file", "block").distinct().count() > 10
        found = _found(tl.log_context(lines, as_of=AS_OF))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows, number = [], 0
    for name in sorted(texts):
        of = source or lines.where(F.col("file").endswith(name)).first()["source"]
        number = number if source else 0
        for text in texts[name]:
            number += 1
            rows.append((len(rows) + 1, of, text, number))
    plain = spark.createDataFrame(rows, "seq bigint, source string, line string, line_no bigint")
    assert found == _brute(spark, plain)


def test_no_alert_and_no_line(spark, log):
    assert tl.log_context(log(["calm"] * 5), as_of=AS_OF).count() == tl.log_context(log([]), as_of=AS_OF).count() == 0


def test_own_rules(spark, log):
    rules = tl.default_rules().with_rule(tl.Rule("C001", "Own", "LOW", predicate=F.col("raw").startswith("stop"), evidence=F.col("raw"), description=F.lit("x")))
    found = tl.log_context(log([f"line {n}" for n in range(20)] + ["stop here", "after"]), as_of=AS_OF, rules=rules, size=4)
    assert sorted(r["line_no"] for r in found.collect()) == [18, 19, 20, 21]


def test_only_lines_that_may_be_kept_are_shuffled(spark, log, monkeypatch):
    seen = []
    kept = context.only_marked
    monkeypatch.setattr(context, "only_marked", lambda rows, keys, wanted: seen.append((rows.columns, found := kept(rows, keys, wanted))) or found)
    lines = log([f"calm {n}" for n in range(3000)] + ["GET /../../etc/passwd"])
    assert tl.log_context(lines, as_of=AS_OF).count() == 15
    texts = [found for columns, found in seen if "line" in columns]
    assert len(texts) == 1 and texts[0].count() < 30
    # No other frame that is joined has the text.
    plan = texts[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_marks_may_be_full(spark, log, monkeypatch):
    monkeypatch.setattr(context, "MARKS", 1)
    lines = tl.number_lines(log(list(_texts(400, 5, attacks=0.2)), "a"))
    assert _found(tl.log_context(lines, as_of=AS_OF)) == _brute(spark, lines)
