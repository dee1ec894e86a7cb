from collections import deque
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import threatlog as tl
from threatlog.operators.windows import numbered_within

START = datetime(2026, 5, 20, 23, 50)
SCHEMA = "counter string, ip string, ts timestamp_ntz, seq bigint"


def ticked(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.groupBy("counter", "ip", "ts").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def peak_of(times, window=timedelta(minutes=5)):
    """Largest trailing count and the first window that has it, by looking at every pair."""
    best = (0, None, None)
    for end in sorted(times):
        inside = [t for t in times if end - window <= t <= end]
        if len(inside) > best[0]:
            best = (len(inside), min(inside), end)
    return best


_OFFSETS = st.lists(st.integers(0, 1500) | st.sampled_from([0, 300, 301, 600, 601, 3599, 3600, 3900]), min_size=1, max_size=40)


@settings(max_examples=4, deadline=None)
@given(st.lists(_OFFSETS, min_size=6, max_size=6), st.booleans())
def test_peaks_match_brute_force(spark, groups, fractions):
    unit = timedelta(milliseconds=250) if fractions else timedelta(seconds=1)
    scale = 4 if fractions else 1
    rows, expected = [], {}
    for g, offsets in enumerate(groups):
        times = [START + unit * (o * scale + (i % scale)) for i, o in enumerate(offsets)]
        rows += [("request", f"ip{g}", t, g * 1000 + i) for i, t in enumerate(times)]
        expected[f"ip{g}"] = peak_of(times)
    from threatlog.operators.windows import peaks

    found = {r["ip"]: (r["peak"], r["window_start"], r["window_end"]) for r in peaks(ticked(spark, rows)).collect()}
    assert found == expected


def test_a_window_longer_than_an_hour(spark):
    from threatlog.operators.windows import peaks

    times = [START + timedelta(minutes=m) for m in (0, 50, 100, 150, 151, 180, 181, 400, 500, 579, 580)]
    rows = [("request", "x", t, i) for i, t in enumerate(times)]
    for window in (timedelta(hours=3), timedelta(minutes=61), timedelta(seconds=30)):
        (found,) = peaks(ticked(spark, rows), window).collect()
        assert (found["peak"], found["window_start"], found["window_end"]) == peak_of(times, window)


def test_both_ends_of_the_window_count(spark):
    from threatlog.operators.windows import peaks

    at = lambda s: START + timedelta(seconds=s)
    rows = [("request", "in", at(0), 1), ("request", "in", at(300), 2)]
    rows += [("request", "out", at(0), 1), ("request", "out", at(301), 2)]
    assert {r["ip"]: r["peak"] for r in peaks(ticked(spark, rows)).collect()} == {"in": 2, "out": 1}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.integers(0, 900), min_size=20, max_size=80), min_size=3, max_size=3))
def test_alert_steps_match_a_line_by_line_run(spark, groups):
    rows, expected = [], set()
    for g, offsets in enumerate(groups):
        times = sorted(START + timedelta(seconds=o) for o in offsets)
        emitted, peak = set(), 0
        for i, t in enumerate(times):
            rows.append(("fail", f"ip{g}", t, g * 1000 + i))
            peak = max(peak, sum(t - timedelta(minutes=5) <= x for x in times[: i + 1]))
            if peak >= 5 and peak // 5 not in emitted:
                emitted.add(peak // 5)
                expected.add((f"ip{g}", peak // 5, peak, t, g * 1000 + i))
    steps = tl.alert_steps(ticked(spark, rows)).where("rule_id = 'R008'")
    df = spark.createDataFrame(rows, SCHEMA).withColumn("source", F.lit("s"))
    flagged = tl.alert_rows(df, steps, {"fail": F.lit(True)})
    found = {(r["ip"], r["alert_step"], r["count"], r["ts"], r["seq"]) for r in flagged.collect()}
    assert found == expected


def test_burst_threats_of_the_known_cases(log):
    def line(ip, second, path, status):
        at = START + timedelta(seconds=second)
        return f'{ip} - - [{at:%d/%b/%Y:%H:%M:%S} +0000] "POST {path} HTTP/1.1" {status} 512'

    texts = [line("91.108.4.1", 10 * i, "/login", 401) for i in range(6)]
    texts += [line("172.16.0.9", i, "/api/heavy", 200) for i in range(210)]
    texts += [line("10.9.9.9", i, f"/{i}", 404) for i in range(19)]
    entries = tl.parse_logs(log(texts), as_of=START)
    found = {(r["rule_id"], r["ip"]): r for r in tl.threshold_hits(tl.ticks(entries)).collect()}
    assert set(found) == {("R008", "91.108.4.1"), ("R010", "172.16.0.9")}
    flood = found["R010", "172.16.0.9"]
    assert (flood["count"], flood["description"], flood["evidence"]) == (
        210, "High request rate: 210 reqs from 172.16.0.9 in 5min",
        "210 requests in 5 minutes starting at 23:50:00",
    )


def test_numbering_crosses_slices(spark):
    df = spark.range(0, 1000, 7).select(F.lit("k").alias("k"), F.col("id").alias("seq"))
    rows = numbered_within(df, ["k"], "n", width=10).orderBy("seq").collect()
    assert [r["n"] for r in rows] == list(range(1, len(rows) + 1))


@settings(max_examples=3, deadline=None)
@given(st.sets(st.integers(1, 120), max_size=6), st.sets(st.integers(1, 120), max_size=4))
def test_context_matches_a_ring_buffer(spark, first, second):
    alerts, expected = [], set()
    for source, numbers in (("a", first), ("b", second)):
        buffer, written = deque(maxlen=15), 0
        for n in range(1, 121):
            buffer.append(n)
            if n in numbers:
                expected |= {(source, x) for x in buffer if x > written}
                written = n
                alerts.append((source, n))
    lines = spark.createDataFrame(
        [(s, n, "x") for s in "ab" for n in range(1, 121)], "source string, line_no bigint, line string"
    )
    flagged = spark.createDataFrame(alerts, "source string, line_no bigint")
    kept = tl.context_lines(lines, flagged).collect()
    assert {(r["source"], r["line_no"]) for r in kept} == expected
    assert len(kept) == len(expected)


def test_plans_shuffle_counts_and_limits_not_raw_rows(log):
    entries = tl.parse_logs(log(["x"]), as_of=START)
    plan = tl.peak_windows(entries)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Python" not in plan
    assert plan.index("partial_count") > plan.index("Exchange")
    merged = tl.merge_threats(tl.rule_hits(entries))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in merged and "row_number(), 6, Partial" in merged
    assert merged.count("Scan ExistingRDD") == 1


def test_numbering_one_source_is_spread_over_tasks(spark):
    """A source's lines are numbered, and what follows is done, by as many tasks as there are."""
    lines = spark.range(400_000).select(F.lit("s").alias("source"), (F.col("id") * 2).alias("seq"), F.lit("text").alias("line"))
    fixed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in fixed}
    try:
        for name, value in fixed.items():
            spark.conf.set(name, value)
        numbered = tl.number_lines(lines).withColumn("task", F.spark_partition_id())
        tasks = {r["task"]: r["n"] for r in numbered.groupBy("task").agg(F.count("*").alias("n")).collect()}
        wrong = numbered.where(F.col("line_no") != F.expr("seq div 2 + 1")).count()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert wrong == 0 and sum(tasks.values()) == 400_000 and max(tasks.values()) < 300_000
