import random
from datetime import datetime

import pytest

import threatlog as tl
from threatlog.session import folder_names
from threatlog.streaming import LiveReport
from threatlog.streaming import report as module
from threatlog.streaming import runs
from threatlog.streaming.runs import runs_of

AS_OF = datetime(2026, 6, 1)
OPTIONS = {"as_of": AS_OF, "default_year": 2026}


def _texts(n, seed=1):
    make = random.Random(seed)
    for i in range(n):
        second = make.randrange(1200)
        at = f"20/May/2026:10:{second // 60:02d}:{second % 60:02d} +0000"
        path = make.choice(["/a", "/b", "/../../etc/passwd", f"/q?id={i};--", "/admin"])
        yield f'10.0.0.{make.randrange(3)} - - [{at}] "GET {path} HTTP/1.1" {make.choice([200, 404, 401, 500])} 5'


def _rows(df):
    return sorted(map(repr, df.collect()))


def _same(analysis, lines):
    with tl.Analysis(lines, **OPTIONS) as batch:
        assert _rows(analysis.threats) == _rows(batch.threats)
        assert _rows(tl.summary_report(analysis).drop("generated_at")) == _rows(tl.summary_report(batch).drop("generated_at"))
        assert _rows(analysis.status_counts) == _rows(batch.status_counts)
        # The document names threats and statuses, and no order but the report's.
        assert [r[0] for r in tl.report_lines(analysis).collect()] == [r[0] for r in tl.report_lines(batch).collect()]


def test_runs_hold_every_epoch_once():
    for epochs in range(0, 300):
        found = runs_of(epochs)
        assert [e for a, b in found for e in range(a, b + 1)] == list(range(epochs))
        sizes = [b - a + 1 for a, b in found]
        assert all(sizes.count(s) < runs.FAN for s in sizes) and sizes == sorted(sizes, reverse=True)
        # The last run is made of the batch and of whole runs before it.
        if epochs:
            before = runs_of(epochs - 1)
            assert [r for r in before if r[0] < found[-1][0]] == found[:-1]
            assert runs.merged_into(epochs - 1) == (found[-1], [r for r in before if r[0] >= found[-1][0]])


def test_equals_the_batch_report(spark, log, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "FAN", 2)
    lines = log(list(_texts(300)) + ["# note", "", "free text"])
    folder, source, checkpoint = (str(tmp_path / x) for x in ("out", "in", "checkpoint"))
    schema = lines.schema
    for n, part in enumerate((3, 0, 4, 1, 2)):  # not in order; each start goes on from the checkpoint
        lines.where(f"seq % 5 = {part}").write.mode("append").parquet(source)
        report = LiveReport(spark, folder, in_order=True, **OPTIONS)
        report.start(spark.readStream.schema(schema).parquet(source), checkpoint).awaitTermination()
        assert report.committed() == n + 1
        if n in (0, 4):
            seen = [3] if n == 0 else range(5)
            with report.analysis() as analysis:
                _same(analysis, lines.where(f"seq % 5 in ({', '.join(map(str, seen))})"))
    assert {tuple(map(int, x.split("-"))) for x in folder_names(spark, f"{folder}/runs")} == {r for n in (4, 5) for r in runs_of(n)}


def test_an_epoch_that_is_run_again_counts_once(spark, log, tmp_path, monkeypatch):
    lines = log(list(_texts(120, 2)))
    report = LiveReport(spark, str(tmp_path / "out"), in_order=True, **OPTIONS)
    report.update(lines.where("seq <= 50"), 0)

    def fail(*_):
        raise RuntimeError("lost")

    # The run is written, but the epoch is not committed.
    with monkeypatch.context() as patched:
        patched.setattr(module, "create_marker", fail)
        with pytest.raises(RuntimeError):
            report.update(lines.where("seq > 50"), 1)
    with report.analysis() as analysis:
        _same(analysis, lines.where("seq <= 50"))
    report.update(lines.where("seq > 50"), 1)
    report.update(lines.where("seq > 50"), 1)  # committed before Spark noted it
    with report.analysis() as analysis:
        _same(analysis, lines)


def test_lines_without_order_count_as_they_come(spark, log, tmp_path):
    texts = list(_texts(60, 3))
    report = LiveReport(spark, str(tmp_path / "out"), **OPTIONS)
    assert report.committed() == 0 and report.analysis().threats.count() == 0
    nameless = "line", "source", "cast(null as bigint) as seq"
    report.update(log(texts[:30]).coalesce(1).selectExpr(*nameless), 0)
    report.update(log([]).selectExpr(*nameless), 1)
    report.update(log(texts[30:]).coalesce(1).selectExpr(*nameless), 2)
    with report.analysis() as analysis:
        _same(analysis, log(texts))


def test_own_rules_and_counters(spark, log, tmp_path):
    from pyspark.sql import functions as F

    rules = tl.default_rules().with_rule(
        tl.Rule("C001", "Own", "HIGH", predicate=F.col("status") == 200, evidence=F.col("path"), description=F.concat(F.lit("saw "), F.col("path")))
    )
    own = {"error": F.col("status") >= 500}
    threshold = tl.ThresholdRule("C010", "Trouble", "MEDIUM", "error", 2, 1, "{n} errors for {ip}", "from {start}")
    options = {"rules": rules, "counters": own, "thresholds": [threshold]}
    lines = log(list(_texts(80, 4)))
    report = LiveReport(spark, str(tmp_path / "out"), in_order=True, **options, **OPTIONS)
    report.update(lines.where("seq > 30"), 0)
    report.update(lines.where("seq <= 30"), 1)
    with report.analysis() as analysis, tl.Analysis(lines, **options, **OPTIONS) as batch:
        assert _rows(analysis.threats) == _rows(batch.threats)
        assert {"C001", "C010"} <= {r["rule_id"] for r in analysis.threats.collect()}
