import random
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import threatlog as tl
from threatlog.operators import groups
from threatlog.operators.groups import as_grouped, bounded, columns, merged, partial_groups, partial_hit_groups
from threatlog.operators.parse import DROPPED
from threatlog.operators.rules import counter_flags, default_rules

AS_OF = datetime(2026, 6, 1)


def _texts(n, seed=1):
    make = random.Random(seed)
    for i in range(n):
        ip, second = f"10.0.0.{make.randrange(4)}", make.randrange(3600)
        at = f"20/May/2026:10:{second // 60:02d}:{second % 60:02d} +0000"
        path = make.choice(["/a", "/b", "/../../etc/passwd", f"/q?id=1;-- {i}".replace(" ", ""), "/admin", ""])
        yield make.choice(
            [f'{ip} - u{make.randrange(2)} [{at}] "GET {path} HTTP/1.1" {make.choice([200, 404, 401, 500])} 5'] * 6
            + ["# note", "", "free text"]
        )


def _plain(spark, lines):
    """Groups by single aggregations, evidences not limited."""
    entries = tl.parse_logs(lines, as_of=AS_OF, keep_dropped=True)
    kept = entries.where(F.col("format") != DROPPED)
    hits = tl.rule_hits(tl.parse_logs(lines, as_of=AS_OF))
    return {
        "line": {(r[0],): r[1] for r in entries.groupBy("format").count().collect()},
        "tick": {(r[0], r[1]): r[2] for r in kept.groupBy("ip", "ts").count().collect()},
        "path": {(r["path"],): r["n"] for r in tl.top_paths(kept, 10**6).collect()},
        "status": {(r["status"],): r["n"] for r in tl.status_counts(kept).collect()},
        "threat": {tuple(r)[:3]: r[3] for r in hits.groupBy("rule_no", "ip", "user").count().collect()},
    }


def test_groups_are_those_of_single_aggregations(spark, log):
    lines = log(list(_texts(800))).repartition(4)
    found = merged(partial_groups(tl.parse_logs(lines, as_of=AS_OF, keep_dropped=True), default_rules(), counter_flags())).collect()
    keys = {"line": ["text"], "tick": ["ip", "at"], "path": ["text"], "status": ["text"], "threat": ["rule_no", "ip", "user"]}
    plain = _plain(spark, lines)
    for kind, names in keys.items():
        have = {tuple(int(r[c]) if kind == "status" else r[c] for c in names): r["n"] for r in found if r["kind"] == kind}
        assert have == plain[kind], kind


def test_tasks_send_five_evidences_a_threat(spark, log):
    texts = [f'9.9.9.9 - - [20/May/2026:10:00:00 +0000] "GET /q?id={i};-- HTTP/1.1" 200 5' for i in range(2000)]
    random.Random(3).shuffle(texts)
    hits = tl.rule_hits(tl.parse_logs(log(texts).repartition(4), as_of=AS_OF))
    assert hits.count() >= 2000
    partial = partial_hit_groups(hits, False)
    sent = {r[0]: r[1] for r in partial.groupBy("kind").count().collect()}
    threats = hits.select("rule_no").distinct().count()
    assert sent["evidence"] <= 4 * 5 * threats and sent["threat"] <= 4 * threats
    # They cross the first shuffle as they are, and the limit leaves the true first five.
    plan = merged(partial)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") > plan.index("Exchange")
    first = {}
    for r in sorted(hits.collect(), key=lambda r: r["seq"]):
        seen = first.setdefault(r["rule_id"], [])
        if r["evidence"] not in seen and len(seen) < 5:
            seen.append(r["evidence"])
    assert {r["rule_id"]: r["evidence"] for r in tl.merge_threats(hits).collect()} == first


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_parts_merge_to_the_whole(parts, monkeypatch):
    """However groups are cut into batches and tasks, sums, minima and first evidences are those of all rows."""
    monkeypatch.setattr(groups, "WAITING", 30)
    monkeypatch.setattr(groups, "HELD", 60)
    make, types = random.Random(parts), columns(1, False)
    rows = []
    for seq in make.sample(range(10_000), 400):
        rows.append((make.randrange(3), make.choice(["a", None]), None, f"e{make.randrange(30)}", seq, make.choice([0, 1])))
    held, sent = [groups._Groups(types) for _ in range(parts)], []
    for i, (no, ip, user, text, seq, flag) in enumerate(rows):
        g = held[i % parts]
        given = {"rule_no": [no], "ip": [ip], "user": [user], "n": [1], "first_seq": [seq]}
        arrays = {k: pa.array(v, g.schema.field(k).type) for k, v in given.items()}
        extra = {"n_counter0": pa.array([flag], pa.int64()), "first_counter0": pa.array([seq if flag else None], pa.int64())}
        for kind, more in (("threat", {}), ("evidence", {"text": pa.array([text])})):
            sent += list(g.add(g.table(1, kind=pa.array([kind]), **arrays, **extra, **more)))
    for g in held:
        sent += list(g.flush())
    last = groups._Groups(types)
    last.waiting = [pa.Table.from_batches(sent)]
    last.combine()
    found = last.waiting[0].to_pylist()
    for no in range(3):
        for ip in ("a", None):
            own = [r for r in rows if r[:2] == (no, ip)]
            (total,) = [r for r in found if (r["kind"], r["rule_no"], r["ip"]) == ("threat", no, ip)]
            assert (total["n"], total["first_seq"], total["n_counter0"]) == (len(own), min(r[4] for r in own), sum(r[5] for r in own))
            assert total["first_counter0"] == min((r[4] for r in own if r[5]), default=None)
            first = {}
            for r in own:
                first[r[3]] = min(r[4], first.get(r[3], r[4]))
            evidences = sorted((r["first_seq"], r["text"]) for r in found if (r["kind"], r["rule_no"], r["ip"]) == ("evidence", no, ip))
            assert evidences == sorted((s, t) for t, s in first.items())[:5]


def test_bounded_leaves_other_groups(spark):
    names = list(columns(0, False))
    base = dict.fromkeys(names)
    rows = [{**base, "kind": "evidence", "rule_no": 1, "ip": "a", "text": f"e{i}", "n": 1, "first_seq": i} for i in range(9)]
    rows += [{**base, "kind": "path", "text": f"p{i}", "n": 1, "first_seq": i} for i in range(20)]
    rows += [{**base, "kind": "tick", "at": datetime(2026, 1, 1, 0, i), "n": 1, "first_seq": i} for i in range(20)]
    schema = ", ".join(f"{k} {t}" for k, t in columns(0, False).items())
    found = bounded(spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema))
    assert {r[0]: r[1] for r in found.groupBy("kind").count().collect()} == {"evidence": 5, "path": 20, "tick": 20}
    assert found.where("kind = 'evidence'").agg(F.max("first_seq")).first()[0] == 4
    assert as_grouped(found, False).count() == 5


def test_a_task_holds_groups_by_rows_and_bytes(monkeypatch):
    """Long paths, each once, and short ones: what waits and what is held stay small whatever a task reads."""
    types = columns(0, False)
    for path, rows in (("x" * 20_000, 60), ("x", 4000)):
        held = groups._Groups(types)
        monkeypatch.setattr(groups, "WAITING_BYTES", 1 << 20)
        monkeypatch.setattr(groups, "HELD_BYTES", 1 << 21)
        most, sent = 0, 0
        for n in range(40):
            first = pa.array(range(n * rows, (n + 1) * rows), pa.int64())
            given = {"kind": pa.array(["path"] * rows), "text": pa.array([f"{path}{i}" for i in first.to_pylist()])}
            sent += sum(b.num_rows for b in held.add(held.table(rows, n=pa.array([1] * rows, pa.int64()), first_seq=first, **given)))
            most = max(most, sum(t.nbytes for t in held.waiting))
        sent += sum(b.num_rows for b in held.flush())
        assert sent == 40 * rows and not held.waiting
        assert most <= (1 << 20) + (1 << 21) + 2 * rows * (len(path) + 200)


def test_no_rows_start_no_python(spark):
    from threatlog.session import no_rows

    types = columns(3, True)
    empty = no_rows(spark, ", ".join(f"`{name}` {kind}" for name, kind in types.items()))
    assert dict(empty.dtypes) == types and empty.count() == 0
    both = spark.range(3).select(F.col("id").alias("n")).unionByName(empty.select("n"))
    assert "Union" not in both._jdf.queryExecution().optimizedPlan().toString() and both.count() == 3
