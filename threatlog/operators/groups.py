"""Counted groups of a log, combined in the task that parses its lines.

A line belongs to a few groups: its format, its address and time, its path, its status, and for each rule it
hits the threat and the threat's evidence.  A task counts them a batch at a time and keeps, of every threat, the
**five first distinct evidences**: whatever is among the first five of the whole log is among the first five of
each task that has it, so nothing else needs to be sent.  What leaves a task are its distinct groups, with at
most five evidences a threat; partial groups of tasks, of logs and of micro-batches are merged by the same sums
and minima (:func:`merged`).

======== ================================ =====================
kind     group                            ``text``, ``at``
======== ================================ =====================
line     format                           format
tick     address, time                    time in ``at``
path     path                             path
status   status                           status
threat   rule, address, user
evidence rule, address, user, evidence    evidence
======== ================================ =====================
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed_values import EVIDENCE_CAP
from ..functions.text import filled
from .parse import DROPPED
from .rules import RuleSet, candidate_hits, sure_hits

KEYS = ("kind", "rule_no", "ip", "user", "text", "at")
#: Rows that wait before they are combined, and combined groups that a task holds at most.
WAITING, HELD = 1 << 14, 1 << 15
#: The same in bytes, whichever comes first: paths may be long.
WAITING_BYTES, HELD_BYTES = 1 << 23, 1 << 24

_FIRST = {"first_ts": "timestamp_ntz", "first_tz_offset": "int", "first_status": "int"}


def columns(counters: int, free_text: bool) -> dict[str, str]:
    """The columns of groups, with their types."""
    found = {
        "kind": "string", "rule_no": "int", "ip": "string", "user": "string", "text": "string", "at": "timestamp_ntz",
        "n": "bigint", "first_seq": "bigint",
    }
    found |= {f"n_counter{i}": "bigint" for i in range(counters)} | {f"first_counter{i}": "bigint" for i in range(counters)}
    return found | _FIRST | ({"first_description": "string"} if free_text else {})


def _arrow(types: dict[str, str]):
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "timestamp_ntz": pa.timestamp("us")}
    return pa.schema([(name, kinds[kind]) for name, kind in types.items()])


class _Groups:
    """The groups that one task holds."""

    def __init__(self, types: dict[str, str]):
        self.schema = _arrow(types)
        self.first = [name for name in types if name in (*_FIRST, "first_description")]
        self.sums = [name for name in types if name == "n" or name.startswith("n_counter")]
        self.least = [name for name in types if name == "first_seq" or name.startswith("first_counter")]
        # Combined groups come first in what waits; rows and bytes are those that came after them.
        self.waiting, self.rows, self.bytes = [], 0, 0

    def table(self, rows: int, /, **given):
        """Rows of one kind; what is not given is null."""
        import pyarrow as pa

        return pa.table([given[f.name] if f.name in given else pa.nulls(rows, f.type) for f in self.schema], schema=self.schema)

    def add(self, table):
        if table.num_rows:
            self.waiting.append(table)
            self.rows += table.num_rows
            self.bytes += table.nbytes
        if self.rows > WAITING or self.bytes > WAITING_BYTES:
            self.combine()
            if self.waiting[0].num_rows > HELD or self.waiting[0].nbytes > HELD_BYTES:
                yield from self.flush()

    def flush(self):
        import pyarrow as pa

        if self.rows:
            self.combine()
        if self.waiting:
            yield from self.waiting.pop().to_batches()
        # An idle worker keeps nothing that the task had.
        pa.default_memory_pool().release_unused()

    def combine(self):
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = pa.concat_tables(self.waiting)
        self.waiting = []
        rows = rows.sort_by("first_seq")
        as_is = pc.ScalarAggregateOptions(skip_nulls=False)
        wanted = [(c, "sum") for c in self.sums] + [(c, "min") for c in self.least] + [(c, "first", as_is) for c in self.first]
        found = rows.group_by(list(KEYS), use_threads=False).aggregate(wanted)
        del rows
        back = {f"{c}_{how[0]}": c for c, *how in wanted}
        found = found.rename_columns([back.get(c, c) for c in found.column_names]).select(self.schema.names).cast(self.schema)
        found = found.filter(self._wanted(found))
        self.waiting, self.rows, self.bytes = [found.combine_chunks()], 0, 0

    def _wanted(self, found):
        """All groups but evidences beyond the first of their threat."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        keep = np.ones(found.num_rows, bool)
        places = np.flatnonzero(pc.equal(found.column("kind"), "evidence").to_numpy())
        if len(places):
            some = found.take(pa.array(places))
            number = lambda c: pc.fill_null(some.column(c).combine_chunks().dictionary_encode().indices, -1).to_numpy(False)
            keys = [number(c) for c in ("user", "ip", "rule_no")]
            order = np.lexsort([some.column("first_seq").to_numpy(), *keys])
            new = np.ones(len(order), bool)
            new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
            start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            keep[places[order]] = np.arange(len(order)) - start < EVIDENCE_CAP
        return pa.array(keep)


def _hit_tables(groups: _Groups, hits):
    """Threat and evidence rows of a table of hits: no, ip, user, evidence, seq, ts, tz_offset, status, description."""
    import pyarrow as pa

    n = hits.num_rows
    ones = pa.array([1] * n, pa.int64())
    given = {"n": ones, "rule_no": hits["no"], "ip": hits["ip"], "user": hits["user"], "first_seq": hits["seq"]}
    for name in groups.first:
        given[name] = hits[name.removeprefix("first_")]
    yield groups.table(n, kind=pa.array(["threat"] * n), **given)
    yield groups.table(n, kind=pa.array(["evidence"] * n), text=hits["evidence"], **given)


def partial_groups(entries: DataFrame, rules: RuleSet, counters: dict) -> DataFrame:
    """The groups of each task over parsed lines, dropped lines included; rows of one group are merged by :func:`merged`."""
    types = columns(len(counters), rules.free_text)
    kept = F.col("format") != DROPPED
    found = []
    for number, (rule, sure) in enumerate(zip(rules.rules, sure_hits(rules)), start=1):
        fields = [F.lit(number).alias("no"), rule.evidence.alias("evidence")]
        if rules.free_text:
            fields.append(rule.describe(F.col("ip"), F.col("user"), F.col("status")).alias("description"))
        found.append(F.when(sure, F.struct(*fields)))
    marked = candidate_hits(entries, rules)
    rows = marked.select(
        "format", "ip", "user", "ts", "tz_offset", "status", filled(F.col("path")).alias("path"), "seq", kept.alias("kept"),
        *[F.coalesce(kept & flag, F.lit(False)).alias(f"flag{i}") for i, flag in enumerate(counters.values())],
        # No line hits most rules, most lines none.
        F.when(F.size("candidates") > 0, F.array_compact(F.array(*found))).alias("hits"),
    )
    names = [f"flag{i}" for i in range(len(counters))]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        groups = _Groups(types)

        def tables(rows):
            n = rows.num_rows
            ones = pa.array([1] * n, pa.int64())
            same = lambda kind, n: pa.array([kind] * n, pa.string())
            yield groups.table(n, kind=same("line", n), text=rows["format"], n=ones, first_seq=rows["seq"])
            timed = rows.filter(rows["kept"])
            m = timed.num_rows
            counts = {}
            for i, name in enumerate(names):
                counts[f"n_counter{i}"] = timed[name].cast(pa.int64())
                counts[f"first_counter{i}"] = pc.if_else(timed[name], timed["seq"], pa.scalar(None, pa.int64()))
            yield groups.table(m, kind=same("tick", m), ip=timed["ip"], at=timed["ts"], n=ones[:m], first_seq=timed["seq"], **counts)
            pathed = rows.filter(pc.is_valid(rows["path"]))
            m = pathed.num_rows
            yield groups.table(m, kind=same("path", m), text=pathed["path"], n=ones[:m], first_seq=pathed["seq"])
            known = rows.filter(pc.fill_null(pc.not_equal(rows["status"], 0), False))
            m = known.num_rows
            yield groups.table(m, kind=same("status", m), text=known["status"].cast(pa.string()), n=ones[:m], first_seq=known["seq"])
            lists = rows["hits"].combine_chunks()
            flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
            if len(flat):
                hits = rows.drop_columns(["hits"]).take(owner)
                for field, values in zip(flat.type, flat.flatten()):
                    hits = hits.append_column(field.name, values)
                yield from _hit_tables(groups, hits)

        for batch in batches:
            for table in tables(pa.Table.from_batches([batch])):
                yield from groups.add(table)
        yield from groups.flush()

    return rows.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in types.items()))


def partial_hit_groups(hits: DataFrame, free_text: bool) -> DataFrame:
    """The threat and evidence groups of each task over rows of hits."""
    types = columns(0, free_text)
    names = ["no", "ip", "user", "evidence", "seq", "ts", "tz_offset", "status"] + (["description"] if free_text else [])

    def run(batches):
        import pyarrow as pa

        groups = _Groups(types)
        for batch in batches:
            for table in _hit_tables(groups, pa.Table.from_batches([batch])):
                yield from groups.add(table)
        yield from groups.flush()

    rows = hits.select(F.col("rule_no").alias("no"), *names[1:])
    return rows.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in types.items()))


def merged(partial: DataFrame) -> DataFrame:
    """Partial groups, of any number of tasks, logs or micro-batches, to one row a group."""
    names = [c for c in partial.columns if c not in KEYS]
    how = {}
    for name in names:
        if name == "n" or name.startswith("n_counter"):
            how[name] = F.sum(name)
        elif name == "first_seq" or name.startswith("first_counter"):
            how[name] = F.min(name)
        else:
            how[name] = F.min_by(name, "first_seq")
    return partial.groupBy(*KEYS).agg(*[column.alias(name) for name, column in how.items()])


def bounded(groups: DataFrame) -> DataFrame:
    """Merged groups without the evidences beyond the first five of a threat.

    Every other group is alone in its window, and a ranked limit is applied before the shuffle too.
    """
    text = F.when(F.col("kind") != "evidence", F.col("text"))
    order = W.partitionBy("kind", "rule_no", "ip", "user", text, "at").orderBy("first_seq")
    ranked = groups.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= EVIDENCE_CAP)
    return ranked.drop("_rank")


def as_grouped(groups: DataFrame, free_text: bool) -> DataFrame:
    """Threat and evidence groups in the shape that :func:`threatlog.operators.merge.merge_grouped` takes."""
    return groups.where(F.col("kind").isin("threat", "evidence")).select(
        "rule_no", "ip", "user", F.col("text").alias("evidence"),
        F.when(F.col("kind") == "threat", 1).otherwise(0).alias("is_total"),
        F.col("n").alias("count"), "first_seq", F.col("first_ts").alias("ts"),
        F.col("first_tz_offset").alias("tz_offset"), F.col("first_status").alias("status"),
        *([F.col("first_description").alias("description")] if free_text else []),
    )
