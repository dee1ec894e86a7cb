import gzip
import os
from datetime import datetime

import pytest

import threatlog as tl
from threatlog.session import scratch_folder
from threatlog.streaming import start_alerts

AS_OF = datetime(2026, 6, 1)
ATTACK = '1.1.1.1 - - [20/May/2026:17:00:00 +0000] "GET /x?c=;id HTTP/1.1" 200 1'


def test_frames_texts_and_compressed_files(spark, tmp_path):
    pasted = tl.from_text(spark, "one\n\ntwo\x0bthree\r\n", source="paste").orderBy("seq").collect()
    assert [r["line"] for r in pasted] == ["one", "", "two", "three"]
    assert {r["source"] for r in pasted} == {"paste"}
    frame = tl.from_lines(spark.createDataFrame([("b", 2), ("a", 1)], "value string, n int"), order_by="n")
    assert [r["line"] for r in frame.orderBy("seq").collect()] == ["a", "b"]
    with gzip.open(tmp_path / "x.log.gz", "wt") as file:
        file.write("first\nsecond\n")
    lines = tl.read_logs(spark, str(tmp_path / "*.gz"), source="web")
    assert lines.rdd.getNumPartitions() == 1
    dealt = tl.spread(lines)
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert [r["line"] for r in dealt.orderBy("seq").collect()] == ["first", "second"]
    assert {r["source"] for r in dealt.collect()} == {"web"}


def test_sinks(spark, log, tmp_path):
    threats = tl.merge_threats(tl.rule_hits(tl.parse_logs(log([ATTACK]), as_of=AS_OF)))
    for _ in range(2):
        tl.write_alert_log(threats, str(tmp_path / "alerts"))
        tl.write_lines(log(["x", "y"]), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "alerts")).count() == 2
    assert spark.read.text(str(tmp_path / "lines")).count() == 4
    tl.write_json(threats, str(tmp_path / "threats"))
    (row,) = spark.read.json(str(tmp_path / "threats")).collect()
    assert (row["rule_id"], row["ip"], row["count"]) == ("R012", "1.1.1.1", 1)


def test_streamed_folder_through_the_live_job(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("\n".join([f"calm {n}" for n in range(30)] + [ATTACK, "calm again"]) + "\n")
    start_alerts(
        tl.stream_logs(spark, str(folder)), as_of=AS_OF, out=str(tmp_path / "out"), checkpoint=str(tmp_path / "c")
    ).awaitTermination()
    (alert,) = spark.read.parquet(str(tmp_path / "out/alerts")).collect()
    assert (alert["rule_id"], alert["line_no"]) == ("R012", 31)
    kept = [r["value"] for r in spark.read.text(str(tmp_path / "out/context")).collect()]
    assert kept == [f"calm {n}" for n in range(16, 30)] + [ATTACK]


def test_null_sources_keep_their_lines(spark):
    rows = [(1, None, "a"), (2, None, "b"), (3, "s", "c")]
    lines = spark.createDataFrame(rows, "seq bigint, source string, line string")
    numbered = tl.number_lines(lines)
    assert sorted((r["line"], r["line_no"]) for r in numbered.collect()) == [("a", 1), ("b", 2), ("c", 1)]
    alerts = spark.createDataFrame([(None, 2)], "source string, line_no bigint")
    assert sorted(r["line"] for r in tl.context_lines(numbered, alerts).collect()) == ["a", "b"]


def test_layout_of_several_files_is_that_of_all_lines(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.log").write_text("".join(f"10.0.0.{i};GET;/p/{i};200;note {i}\n" for i in range(40)))
    (tmp_path / "3.log").write_text("10.0.0.1;GET;/p;200\n")
    lines = tl.read_logs(spark, str(tmp_path))
    layout = tl.infer_layout(lines)
    assert (layout.delimiter, layout.ip_col, layout.method_col, layout.path_col, layout.status_col) == (";", 0, 1, 2, 3)
    assert tl.infer_layout(lines, sample_lines=15).msg_col == 4 and layout.msg_col is None


def test_scratch_needs_a_shared_folder_off_local():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError):
        scratch_folder(Session)
    Context.master = "local[2]"
    assert "/threatlog-" in scratch_folder(Session)


def test_closing_an_analysis_removes_its_tables(spark, log):
    analysis = tl.Analysis(log(["plain text 1.1.1.1"]), as_of=datetime(2026, 1, 1))
    assert analysis.threats.count() == 0
    folders = [f.removeprefix("file:") for f in analysis._folders]
    assert len(folders) == 2 and all(os.path.isdir(f) for f in folders)
    analysis.close()
    assert not any(os.path.exists(f) for f in folders)


def test_unused_fields_are_not_parsed(spark, log):
    entries = tl.parse_logs(log(["x"]), as_of=datetime(2026, 1, 1), columns=("path", "format"))
    plan = entries.groupBy("path").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "timestamp_ntz" not in plan.lower() and "make_dt_interval" not in plan
