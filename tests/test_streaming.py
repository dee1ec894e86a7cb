import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import threatlog as tl
from threatlog.streaming import ROCKSDB, live_counts, start_alerts, stream_alert_steps, tail_logs

START = datetime(2026, 5, 20, 23, 57)


def line(second, ip, status=401, path="/login"):
    at = START + timedelta(seconds=second)
    return f'{ip} - - [{at:%d/%b/%Y:%H:%M:%S} +0000] "POST {path} HTTP/1.1" {status} 512'


def burst_lines():
    rng = random.Random(5)
    texts = [line(rng.randrange(600), f"10.0.0.{rng.randrange(2)}", rng.choice((401, 404, 404, 200))) for _ in range(420)]
    return sorted(texts, key=lambda t: t.split("[")[1])


def write_file(folder, name, rows, when):
    """One file of ``source<TAB>seq<TAB>line`` rows, with a modification time that orders the files."""
    path = folder / name
    path.write_text("".join(f"s\t{seq}\t{text}\n" for seq, text in rows))
    os.utime(path, (when, when))


def stream_of(spark, folder):
    parts = F.split("value", "\t", 3)
    return (
        spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder))
        .select(parts[2].alias("line"), parts[0].alias("source"), parts[1].cast("bigint").alias("seq"))
    )


def drain(df, out, checkpoint, mode="append"):
    query = (
        df.writeStream.outputMode(mode).format("parquet").option("path", str(out))
        .option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    )
    query.awaitTermination()


@pytest.fixture
def keyed_state(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    yield
    spark.conf.set(key, before)


def test_times_that_are_none_or_far_ahead_lose_no_alert(spark, log, tmp_path, keyed_state):
    ahead = '9.9.9.9 - - [01/Jan/2099:00:00:00 +0000] "GET / HTTP/1.1" 200 1'
    texts = ["free text about 9.9.9.9", ahead] + [line(n, "9.9.9.9") for n in range(6)]
    folder = tmp_path / "in"
    folder.mkdir()
    write_file(folder, "0.txt", [(1, texts[0]), (2, texts[1])], 1_700_000_000)
    for n in (1, 2):
        rows = list(enumerate(texts, start=1))
        write_file(folder, f"{n}.txt", rows[3 * n - 1 : 3 * n + 2], 1_700_000_000 + n)
    late = datetime(2026, 6, 1)
    batch = tl.alert_steps(tl.ticks(tl.parse_logs(log(texts), as_of=late))).where("rule_id = 'R008'").count()
    assert batch == 1
    start_alerts(stream_of(spark, folder), as_of=late, out=str(tmp_path / "out"), checkpoint=str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/alerts")).where("rule_id = 'R008'").count() == 1
    drain(stream_alert_steps(tl.parse_logs(stream_of(spark, folder), as_of=late)), tmp_path / "steps", tmp_path / "c2")
    assert spark.read.parquet(str(tmp_path / "steps")).where("rule_id = 'R008'").count() == 1


def test_own_counters_on_a_stream(spark, log, tmp_path):
    own = {"deleted": F.col("method") == "DELETE"}
    rule = tl.ThresholdRule("X1", "deletions", "HIGH", "deleted", 3, 3, "{n} by {ip}", "{n}")
    texts = [line(n, "8.8.8.8").replace("POST", "DELETE") for n in range(4)]
    folder = tmp_path / "in"
    folder.mkdir()
    write_file(folder, "0.txt", list(enumerate(texts, start=1)), 1_700_000_000)
    options = {"as_of": START, "thresholds": (rule,)}
    start_alerts(stream_of(spark, folder), out=str(tmp_path / "out"), checkpoint=str(tmp_path / "c"), counters=own, **options).awaitTermination()
    assert [(r["rule_id"], r["count"]) for r in spark.read.parquet(str(tmp_path / "out/alerts")).where("rule_id = 'X1'").collect()] == [("X1", 3)]
    with tl.Analysis(log(texts), counters=own, **options) as analysis:
        assert [r["rule_id"] for r in analysis.threats.where("phase = 1").collect()] == ["X1"]
    with pytest.raises(ValueError):
        start_alerts(stream_of(spark, folder), out=str(tmp_path / "o"), checkpoint=str(tmp_path / "d"), **options)
    with pytest.raises(ValueError):
        tl.Analysis(log(texts), **options)


def test_alert_stream_in_any_order_equals_batch(spark, log, tmp_path, keyed_state):
    texts = burst_lines()
    expected = {
        (r["rule_id"], r["ip"], r["alert_step"], r["count"])
        for r in tl.alert_steps(tl.ticks(tl.parse_logs(log(texts), as_of=START))).collect()
    }
    assert len(expected) > 10
    folder = tmp_path / "in"
    folder.mkdir()
    rows = list(enumerate(texts, start=1))
    random.Random(1).shuffle(rows)
    entries = tl.parse_logs(stream_of(spark, folder), as_of=START)
    alerts = stream_alert_steps(entries, delay=timedelta(minutes=30))
    # Two runs from one checkpoint, two files each.
    for n in range(4):
        write_file(folder, f"{n}.txt", rows[n::4], 1_700_000_000 + n)
        if n % 2:
            drain(alerts, tmp_path / "out", tmp_path / "checkpoint")
    found = spark.read.parquet(str(tmp_path / "out")).select("rule_id", "ip", "alert_step", "count").collect()
    assert len(found) == len(expected) and {tuple(r) for r in found} == expected


def test_live_job_equals_batch(spark, log, tmp_path):
    texts = burst_lines()[:120] + ["# note", ""] + [line(1000, "7.7.7.7", 200, "/x?c=;id")] + ["calm"] * 40
    folder = tmp_path / "in"
    folder.mkdir()
    rows = list(enumerate(texts, start=1))
    told = []
    for n, part in enumerate((rows[:50], rows[50:53], rows[53:])):
        write_file(folder, f"{n}.txt", part, 1_700_000_000 + n)
    query = start_alerts(
        stream_of(spark, folder), as_of=START, out=str(tmp_path / "out"), checkpoint=str(tmp_path / "checkpoint"),
        on_alert=lambda alerts, epoch: told.extend((epoch, r["rule_id"]) for r in alerts.collect()),
    )
    query.awaitTermination()

    lines = log(texts)
    entries = tl.parse_logs(lines, as_of=START)
    steps = tl.alert_rows(entries, tl.alert_steps(tl.ticks(entries))).select("rule_id", "source", "seq")
    flagged = tl.rule_hits(entries).select("rule_id", "source", "seq").union(steps)
    expected = sorted((r["rule_id"], r["seq"]) for r in flagged.collect())
    alerts = spark.read.parquet(str(tmp_path / "out/alerts"))
    assert sorted((r["rule_id"], r["line_no"]) for r in alerts.collect()) == expected

    near = tl.context_lines(tl.number_lines(lines), flagged.select("source", F.col("seq").alias("line_no")))
    kept = sorted(r["line"] for r in near.collect())
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out/context")).collect()) == kept
    assert spark.read.text(str(tmp_path / "out/alert_log")).count() == len(expected)
    assert {rule for _, rule in told} == {"R008", "R009", "R012"} and {0, 2} <= {epoch for epoch, _ in told}


def test_live_job_with_late_lines_raises_the_same_alerts(spark, log, tmp_path):
    texts = burst_lines()
    rows = list(enumerate(texts, start=1))
    random.Random(2).shuffle(rows)
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(2):
        write_file(folder, f"{n}.txt", [(i, text) for i, (_, text) in enumerate(rows[n::2])], 1_700_000_000 + n)
    start_alerts(
        stream_of(spark, folder), as_of=START, out=str(tmp_path / "out"), checkpoint=str(tmp_path / "c"),
        delay=timedelta(minutes=30),
    ).awaitTermination()
    steps = tl.alert_steps(tl.ticks(tl.parse_logs(log(texts), as_of=START)))
    expected = sorted((r["rule_id"], r["ip"], r["count"]) for r in steps.collect())
    found = spark.read.parquet(str(tmp_path / "out/alerts")).where("rule_id in ('R008', 'R009', 'R010')").collect()
    assert sorted((r["rule_id"], r["ip"], r["count"]) for r in found) == expected


def test_live_counts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_file(folder, "0.txt", [(1, line(0, "1.1.1.1")), (2, line(200, "1.1.1.1", 404, "/a"))], 1_700_000_000)
    write_file(folder, "1.txt", [(3, line(0, "2.2.2.2"))], 1_700_000_001)
    seen = []
    query = (
        live_counts(tl.parse_logs(stream_of(spark, folder), as_of=START)).writeStream.outputMode("complete")
        .foreachBatch(lambda df, epoch: seen.append({(r["kind"], r["name"]): r["n"] for r in df.collect()}))
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert seen[0]["ip", "1.1.1.1"] == 2 and ("ip", "2.2.2.2") not in seen[0]
    assert seen[-1] == {
        ("ip", "1.1.1.1"): 2, ("ip", "2.2.2.2"): 1, ("path", "/login"): 2, ("path", "/a"): 1,
        ("status", "401"): 2, ("status", "404"): 1, ("minute", "23:57"): 2, ("minute", "00:00"): 1,
    }


def test_tail_follows_appends_and_truncation(spark, tmp_path):
    path = tmp_path / "app.log"
    path.write_bytes(b"one\ntw\xc3\xb6\nhalf")

    def run(name, start="beginning", unfinished=False):
        drain(tail_logs(spark, str(tmp_path / "*.log"), start, unfinished), tmp_path / f"out-{name}", tmp_path / f"ck-{name}")
        rows = spark.read.schema("line string, source string, seq bigint").parquet(str(tmp_path / f"out-{name}"))
        return [(r["line"], r["seq"]) for r in rows.orderBy("seq").collect()]

    assert run("a") == [("one", 0), ("twö", 4)]
    assert run("whole", unfinished=True) == [("one", 0), ("twö", 4), ("half", 9)]
    with path.open("ab") as file:
        file.write(b" done\r\n\nlast\n")
    assert run("a") == [("one", 0), ("twö", 4), ("half done", 9), ("", 20), ("last", 21)]
    path.write_bytes(b"new\n")
    assert ("new", 0) in run("a")
    assert run("end", "end") == []
    with path.open("ab") as file:
        file.write(b"more\n")
    assert run("end", "end") == [("more", 4)]


def test_idle_sources_cost_nothing(spark, tmp_path, monkeypatch):
    """What an epoch writes of the last lines depends on the sources that sent some; none is forgotten."""
    from threatlog.streaming import runs
    from threatlog.streaming.job import _LiveJob

    monkeypatch.setattr(runs, "FAN", 3)
    idle = spark.range(10_000).selectExpr("concat('idle', id) as source", "'calm line' as line", "1L as seq")
    job = _LiveJob(START, str(tmp_path / "out"), str(tmp_path / "check"), None, None, timedelta(minutes=10), None, None, {})
    rows = lambda source, texts: spark.createDataFrame([(source, t, n) for n, t in enumerate(texts)], "source string, line string, seq bigint")
    job.run(idle.unionByName(rows("busy", [f"calm {n}" for n in range(20)])), 0)
    written = lambda run: spark.read.parquet(runs.run_path(f"{job.state}/tail", run))
    assert written((0, 0)).count() == 10_014
    job.run(rows("busy", ["more"]), 1)
    assert written((1, 1)).select("source").distinct().collect()[0][0] == "busy" and written((1, 1)).count() == 14
    # The third epoch makes one run of all; then an idle source goes on with its numbers and its lines.
    job.run(rows("busy", ["still more"]), 2)
    assert written((0, 2)).count() == 10_014
    job.run(rows("idle7", ["GET /../../etc/passwd from 1.1.1.1"]), 3)
    assert {r["line_no"] for r in spark.read.parquet(f"{job.out}/alerts/epoch=3").collect()} == {2}
    assert [r["value"] for r in spark.read.text(f"{job.out}/context/epoch=3").collect()] == ["calm line", "GET /../../etc/passwd from 1.1.1.1"]
    assert written((3, 3)).count() == 2


def test_an_epoch_that_breaks_off_between_sinks_shows_once(spark, log, tmp_path, monkeypatch):
    from threatlog.streaming import committed_alerts, committed_lines
    from threatlog.streaming.job import _LiveJob

    attack = "GET /../x from 1.1.1.1"
    job = _LiveJob(START, str(tmp_path / "out"), str(tmp_path / "check"), None, None, timedelta(minutes=10), None, None, {})
    assert committed_alerts(spark, job.out).count() == committed_lines(spark, job.out).count() == 0
    job.run(log(["calm", attack]), 0)
    with monkeypatch.context() as patched:
        # Alerts and their log are written, the context is not.
        patched.setattr(job, "_context", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            job.run(log([attack, attack]), 1)
    assert spark.read.parquet(f"{job.out}/alerts").count() == 3
    assert committed_alerts(spark, job.out).count() == committed_lines(spark, job.out).count() == 1
    assert [r[0] for r in committed_lines(spark, job.out, "context").collect()] == ["calm", attack]
    for _ in range(2):  # also when Spark had not noted that it was done
        job.run(log([attack, attack]), 1)
        assert sorted(r["line_no"] for r in committed_alerts(spark, job.out).collect()) == [2, 3, 4]
        assert committed_lines(spark, job.out).count() == 3
    assert committed_lines(spark, job.out, "context").count() == 4


@pytest.mark.parametrize("way", ["live job", "keyed state"])
def test_a_source_that_lags_behind_has_its_bursts(spark, log, tmp_path, keyed_state, way):
    """Over three batches: failures of a day ago beside many current ones, of another address and of the same."""
    day = 86_400
    texts = []
    for n in range(3):
        texts += [line(30 * n + k, "1.1.1.1") for k in range(20)]
        texts += [line(30 * n + k - day, ip) for ip in ("2.2.2.2", "3.3.3.3") for k in range(2)]
        texts += [line(30 * n + k, "3.3.3.3", 200, "/") for k in range(20)]
    rows = list(enumerate(texts, start=1))
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(3):
        write_file(folder, f"{n}.txt", rows[n * len(rows) // 3 : (n + 1) * len(rows) // 3], 1_700_000_000 + n)
    steps = tl.alert_steps(tl.ticks(tl.parse_logs(log(texts), as_of=START))).collect()
    expected = sorted((r["rule_id"], r["ip"], r["count"]) for r in steps)
    assert {("R008", "2.2.2.2", 5), ("R008", "3.3.3.3", 5)} < set(expected)
    if way == "live job":
        start_alerts(stream_of(spark, folder), as_of=START, out=str(tmp_path / "out"), checkpoint=str(tmp_path / "c")).awaitTermination()
        found = spark.read.parquet(str(tmp_path / "out/alerts")).where("rule_id in ('R008', 'R009', 'R010')").collect()
    else:
        drain(stream_alert_steps(tl.parse_logs(stream_of(spark, folder), as_of=START)), tmp_path / "steps", tmp_path / "c2")
        found = spark.read.parquet(str(tmp_path / "steps")).collect()
    assert sorted((r["rule_id"], r["ip"], r["count"]) for r in found) == expected


def test_counts_of_lagging_lines_go_when_none_come(spark, tmp_path, monkeypatch):
    from threatlog.streaming import job as module

    now = [1_000_000.0]
    monkeypatch.setattr(module, "time", lambda: now[0])
    job = module._LiveJob(START, str(tmp_path / "out"), str(tmp_path / "check"), None, None, timedelta(minutes=10), None, None, {})
    frame = lambda texts: spark.createDataFrame([(t, "s", n) for n, t in enumerate(texts)], "line string, source string, seq bigint")
    current = [line(n, "1.1.1.1") for n in range(9)]
    kept = lambda epoch: {r["ip"] for r in spark.read.parquet(f"{job.state}/ticks/epoch={epoch}").collect()}
    job.run(frame([line(-86_400, "2.2.2.2"), *current]), 0)
    assert kept(0) == {"1.1.1.1", "2.2.2.2"}
    now[0] += 14 * 60
    job.run(frame(current), 1)
    assert kept(1) == {"1.1.1.1", "2.2.2.2"}
    now[0] += 2 * 60
    job.run(frame(current), 2)
    assert kept(2) == {"1.1.1.1"}


def delimited_lines(count, by="|"):
    return [by.join([f"2026-05-20T10:00:{n % 60:02d}", f"10.2.0.{n % 3}", "POST", "/login", "401", f"note {n}"]) for n in range(count)]


def test_layout_found_on_the_first_lines(spark, log, tmp_path):
    from threatlog.streaming import PrefixLayout

    texts = ["# a comment", "", *delimited_lines(12, ";")]
    prefix = PrefixLayout(str(tmp_path / "state"), 5)
    # Numbers begin anew in each batch; what waits stays before what follows.
    batches = [texts[:4], [], texts[4:9], texts[9:]]
    sent = []
    for epoch, part in enumerate(batches):
        for _ in range(1 + (epoch == 2)):  # the batch that decides is run again
            lines, layout = prefix.settle(log(part), epoch)
            got = [r["line"] for r in lines.orderBy("seq").collect()]
        sent.append(got)
        assert (layout is None) == (epoch < 2)
    assert sent == [[], [], texts[:9], texts[9:]]
    assert layout == tl.DelimitedLayout(";", ip_col=1, ts_col=0, method_col=2, path_col=3, status_col=4, msg_col=5)
    # A new object goes on with what the folder holds.
    lines, again = PrefixLayout(str(tmp_path / "state"), 5).settle(log([texts[2]]), 4)
    assert again == layout and lines.count() == 1


def test_layouts_that_change_nothing(spark, log, tmp_path):
    from threatlog.streaming import PrefixLayout

    access, odd = [line(n, "1.1.1.1") for n in range(3)], ['{"ip": "1.1.1.1"}'] * 3
    assert PrefixLayout(str(tmp_path / "a"), 2).settle(log(access), 0)[1] == "known"
    assert PrefixLayout(str(tmp_path / "b"), 2).settle(log(odd), 0)[1] == "json"
    lines, layout = PrefixLayout(str(tmp_path / "c"), 2).settle(log([]), 0)
    assert lines.count() == 0 and layout is None
    with pytest.raises(ValueError):
        PrefixLayout(str(tmp_path / "d"), 0)


def test_live_job_finds_a_layout_and_loses_no_line(spark, log, tmp_path):
    texts = delimited_lines(24)
    folder = tmp_path / "in"
    folder.mkdir()
    rows = list(enumerate(texts, start=1))
    for n, part in enumerate((rows[:7], rows[7:20], rows[20:])):
        write_file(folder, f"{n}.txt", part, 1_700_000_000 + n)
    start_alerts(
        stream_of(spark, folder), as_of=START, out=str(tmp_path / "out"), checkpoint=str(tmp_path / "c"), layout_lines=15,
    ).awaitTermination()
    layout = tl.infer_layout(log(texts))
    entries = tl.parse_logs(log(texts), as_of=START, layout=layout)
    steps = tl.alert_rows(entries, tl.alert_steps(tl.ticks(entries))).select("rule_id", "seq")
    expected = sorted(tuple(r) for r in tl.rule_hits(entries).select("rule_id", "seq").union(steps).collect())
    assert any(rule == "R008" for rule, _ in expected)
    found = spark.read.parquet(str(tmp_path / "out/alerts")).collect()
    assert sorted((r["rule_id"], r["line_no"]) for r in found) == expected


def test_carried_steps_alert_once_and_count_each_window_once(spark, tmp_path, monkeypatch):
    """Two rules of one counter, and one of another window, over four batches: the batch's steps, each once."""
    from threatlog.operators import windows
    from threatlog.streaming.job import _LiveJob

    rule = lambda no, threshold, step, minutes: tl.ThresholdRule(
        no, no, "HIGH", "request", threshold, step, "{n} of {ip}", "{n}", timedelta(minutes=minutes)
    )
    rules = (rule("X1", 6, 3, 5), rule("X2", 10, 5, 5), rule("X3", 8, 4, 2))
    job = _LiveJob(START, str(tmp_path / "out"), str(tmp_path / "check"), None, rules, timedelta(minutes=10), None, None, {})
    frame = lambda texts, first: spark.createDataFrame(
        [(t, "s", n) for n, t in enumerate(texts, start=first)], "line string, source string, seq bigint"
    )
    texts = [line(10 * n + (n % 3), f"1.1.1.{n % 2}", 200, "/") for n in range(48)]
    counted = []
    sliding = windows.sliding_counts
    monkeypatch.setattr(windows, "sliding_counts", lambda *given: counted.append(1) or sliding(*given))
    for epoch in range(4):
        job.run(frame(texts[epoch * 12 : epoch * 12 + 12], epoch * 12 + 1), epoch)
    assert len(counted) == 4 * 2
    entries = tl.parse_logs(frame(texts, 1), as_of=START)
    expected = sorted((r["rule_id"], r["ip"], r["count"]) for r in tl.alert_steps(tl.ticks(entries), rules).collect())
    found = spark.read.parquet(f"{job.out}/alerts").where("rule_id like 'X%'").collect()
    assert sorted((r["rule_id"], r["ip"], r["count"]) for r in found) == expected and len(expected) > 8
