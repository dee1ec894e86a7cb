from datetime import datetime, timedelta

import threatlog as tl

AS_OF = datetime(2026, 6, 1)


def parse(log, texts, **options):
    rows = tl.parse_logs(log(texts), as_of=AS_OF, **options).orderBy("seq").collect()
    return [r.asDict() for r in rows]


def pick(row, *names):
    return tuple(row[n] for n in names)


def test_formats(log):
    texts = [
        '203.0.113.17 - kim [03/Feb/2025:04:05:06 +0000] "GET /shop/cart HTTP/1.1" 204 77',
        "Mar  9 23:59:58 gate sshd[88]: Failed password for invalid user oracle from 198.51.100.7 port 4711 ssh2",
        "May  2 07:00:00 host cron[9]: job done for 1.2.3.4",
        "2026-05-20 17:00:00 worker 10.0.0.1 started",
        "2026-05-20T17:00:00 no address here",
        "free text about 9.9.9.9 and 8.8.8.8",
        "# comment",
        " \t ",
        '1.2.3.4 - - [20/May/2026:17:00:00 +0000] "GET /a b HTTP/1.1" 200 1',
        'host.example x bob [1/Jun/2026:07:00:00 -0530] "PUT /x HTTP/2" 404 -',
        "Accepted publickey for root from nowhere",
        "May 20 17:00:00 s sshd[1]: Accepted publickey for root from 5.6.7.8 port 1",
    ]
    rows = {r["seq"]: r for r in parse(log, texts)}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6, 9, 10, 11, 12]
    assert [rows[n]["format"] for n in sorted(rows)] == [
        "access", "ssh", "syslog", "generic", "generic", "fallback", "fallback", "access", "fallback", "ssh",
    ]
    assert pick(rows[1], "ip", "user", "method", "path", "status", "ts", "tz_offset") == (
        "203.0.113.17", "kim", "GET", "/shop/cart", 204, datetime(2025, 2, 3, 4, 5, 6), 0,
    )
    assert pick(rows[2], "ip", "user", "status", "ts", "message") == (
        "198.51.100.7", "oracle", None, datetime(2026, 3, 9, 23, 59, 58), texts[1],
    )
    assert pick(rows[3], "ip", "message", "ts") == ("1.2.3.4", "job done for 1.2.3.4", datetime(2026, 5, 2, 7))
    assert pick(rows[4], "ip", "message", "ts") == ("10.0.0.1", "worker 10.0.0.1 started", datetime(2026, 5, 20, 17))
    assert pick(rows[5], "ip", "ts") == (None, datetime(2026, 5, 20, 17))
    assert pick(rows[6], "ip", "ts", "message", "user") == ("9.9.9.9", AS_OF, texts[5], None)
    assert pick(rows[9], "ip", "path", "ts") == ("1.2.3.4", None, AS_OF)
    assert pick(rows[10], "ip", "user", "status", "ts", "tz_offset") == (
        "host.example", "bob", 404, datetime(2026, 6, 1, 7), -330,
    )
    assert pick(rows[12], "ip", "user") == ("5.6.7.8", "root")


def test_json(log):
    texts = [
        '{"ip": "198.51.100.3", "user": "lee", "path": "/orders/9", "method": "PUT", "status": 409,'
        ' "message": "version conflict", "timestamp": "2025-11-02T08:09:10Z"}',
        '{"client_ip": "203.0.113.200", "path": "/img/logo.svg", "status": "304 same", "timestamp": 1735700645}',
        '{"ip": "", "host": "web", "msg": "m", "time": 1779384600000, "status": 404.9}',
        '{"status": "404abc", "@timestamp": "2026-05-20T17:30:00.25Z", "note": "7.7.7.7"}',
        '{"a": 1} {"b": 2}',
        "{broken 1.1.1.1}",
        '{"time": "2026-05-20T17:30:00+02:00", "url": "/u\\/v", "path": null}',
        '{"time": "yesterday"}',
    ]
    rows = parse(log, texts)
    assert [r["format"] for r in rows] == ["json"] * 4 + ["fallback"] * 2 + ["json"] * 2
    assert pick(rows[0], "ip", "user", "path", "method", "status", "message", "ts") == (
        "198.51.100.3", "lee", "/orders/9", "PUT", 409, "version conflict", datetime(2025, 11, 2, 8, 9, 10),
    )
    assert pick(rows[1], "ip", "status", "ts", "message") == (
        "203.0.113.200", 304, datetime(2025, 1, 1, 3, 4, 5), texts[1],
    )
    assert pick(rows[2], "ip", "message", "ts", "status") == ("web", "m", datetime(2026, 5, 21, 17, 30), 404)
    assert pick(rows[3], "ip", "status", "ts") == ("7.7.7.7", None, datetime(2026, 5, 20, 17, 30, 0, 250000))
    assert rows[5]["ip"] == "1.1.1.1"
    assert pick(rows[6], "path", "tz_offset", "ts") == ("/u/v", 120, datetime(2026, 5, 20, 17, 30))
    assert rows[7]["ts"] == AS_OF


def test_strict_compat_leaves_yearless_times_unread(log):
    rows = parse(log, ["May 20 17:00:00 host cron[9]: x", "Feb 30 17:00:00 host cron[9]: x"], strict_compat=True)
    assert [r["ts"] for r in rows] == [AS_OF, AS_OF]
    assert parse(log, ["Feb 30 17:00:00 host cron[9]: x"])[0]["ts"] == AS_OF


def test_delimited(log):
    layout = tl.DelimitedLayout("|", 1, 0, 2, 3, 4, 5)
    texts = [
        "2026-05-20 10:00:00 | host 10.0.0.1 |GET|/x|200|fine",
        "[20/May/2026:10:00:00 +0000]|somewhere|POST|/y|4x4|",
        "2026-05-20T10:00:00|10.0.0.2",
        "May 20 10:00:00|10.0.0.3|GET|/z|500|bad|more",
    ]
    rows = parse(log, texts, layout=layout)
    names = ("ip", "method", "path", "status", "message", "ts", "user")
    at = datetime(2026, 5, 20, 10)
    assert pick(rows[0], *names) == ("10.0.0.1", "GET", "/x", 200, "fine", at, None)
    assert pick(rows[1], *names) == ("somewhere", "POST", "/y", None, "", at, None)
    assert pick(rows[2], *names) == ("10.0.0.2", None, None, None, texts[2], at, None)
    assert pick(rows[3], *names) == ("10.0.0.3", "GET", "/z", 500, "bad", at, None)
    strict = parse(log, texts, layout=layout, strict_compat=True)
    assert [r["ts"] for r in strict] == [AS_OF, at, at, AS_OF]


def test_quality_counts_every_line(log):
    found = {r["format"]: r["n"] for r in tl.parse_quality(log(["", "# x", "text", "{}"]), as_of=AS_OF).collect()}
    assert found == {"dropped": 2, "fallback": 1, "json": 1}


def test_filters_on_parsed_fields_stay_above_the_parsing(log):
    entries = tl.parse_logs(log(["x"]), as_of=AS_OF).where("status >= 500 and ip = '1'")
    plan = entries._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")
    assert plan.count("from_json") == 1


def test_layouts(log):
    columns = [
        "2026-05-20 10:00:00,10.0.0.1,GET,/a,200,hello",
        "2026-05-20 10:00:01,10.0.0.2,POST,/b,404,there",
    ]
    found = tl.infer_layout(log(columns))
    assert found == tl.DelimitedLayout(",", ip_col=1, ts_col=0, method_col=2, path_col=3, status_col=4, msg_col=5)
    assert tl.infer_layout(log(columns), strict_compat=True).status_col == 0
    assert tl.infer_layout(log(['{"a": 1}'] * 3 + ["x"])) == "json"
    assert tl.infer_layout(log(["# only", " "])) is None
    assert tl.infer_layout(log(["May 20 17:00:00 host cron[9]: x"])) == "known"
    assert tl.infer_layout(log(["10.0.0.1 GET /a 200 x", "10.0.0.1 PUT /b 301"])).delimiter == " "
    uneven = tl.infer_layout(log(["1.1.1.1;a;b", "1.1.1.1;a"]))
    assert (uneven.delimiter, uneven.ip_col, uneven.msg_col) == (";", 0, 1)


def test_line_numbers_across_file_blocks(spark, tmp_path):
    texts = [f"line {n} " + "x" * (n % 50) for n in range(2000)]
    (tmp_path / "a.log").write_bytes("\n".join(texts).encode() + b"\n\xff\xfe bad bytes\n")
    (tmp_path / "b.log").write_text("only\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        lines = tl.read_logs(spark, str(tmp_path / "*.log"))
        assert lines.rdd.getNumPartitions() > 3
        rows = tl.number_lines(lines).orderBy("source", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first = [r for r in rows if r["source"].endswith("a.log")]
    assert [r["line"] for r in first[:-1]] == texts
    assert "\ufffd" in first[-1]["line"]
    assert [r["line_no"] for r in first] == list(range(1, 2002))
    assert [r["line_no"] for r in rows if r["source"].endswith("b.log")] == [1]
    by_seq = [r["line"] for r in sorted(first, key=lambda r: r["seq"])]
    assert by_seq[:-1] == texts


def test_wall_clock_micros_do_not_depend_on_the_zone(spark):
    from pyspark.sql import functions as F

    from threatlog.functions.times import wall_clock, wall_micros

    times = [datetime(2026, 5, 20, 17, 1, 2, 345678), datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(2026, 3, 29, 2, 30)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        rows = df.select("ts", wall_micros(F.col("ts")).alias("m")).withColumn("back", wall_clock(F.col("m"))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for row in rows:
        assert row["back"] == row["ts"]
        assert row["m"] == (row["ts"] - datetime(1970, 1, 1)) // timedelta(microseconds=1)
