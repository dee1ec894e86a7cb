"""The whole analysis of a log with one scan of it.

Reading and parsing is what costs, so everything a report needs is counted in the one pass
that does it (:mod:`threatlog.operators.groups`): each task counts the groups its lines belong to,
with the five first evidences of a threat, and one aggregation merges them.  What is shuffled
and written is the distinct groups.
The table is written once to the shared scratch folder, by kind, and every result reads it.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled
from ..operators import stats
from ..operators.groups import as_grouped, merged, partial_groups
from ..operators.merge import burst_threats, merge_grouped, ranked_threats
from ..operators.parse import parse_logs
from ..operators.rules import RuleSet, counter_flags, default_rules
from ..operators.windows import default_thresholds, threshold_hits
from ..session import remove_folder, scratch_folder, staged

class Analysis:
    """Results over one log.  Nothing runs before a result is asked for."""

    def __init__(
        self,
        lines: DataFrame,
        as_of: datetime,
        rules: RuleSet | None = None,
        thresholds=None,
        counters=None,
        **parse_options,
    ):
        """``counters`` (name to condition over entries) come on top of the three built-in ones."""
        self.lines = lines
        self.as_of = as_of
        self.rules = rules or default_rules()
        self.thresholds = tuple(thresholds or default_thresholds())
        self._parse_options, self._folders = parse_options, []
        self._partial = None
        self.counters = counter_flags() | (counters or {})
        unknown = {r.counter for r in self.thresholds} - set(self.counters)
        if unknown:
            raise ValueError(f"no such counter: {sorted(unknown)}")

    @classmethod
    def of_groups(cls, groups: DataFrame, as_of: datetime, rules=None, thresholds=None, counters=None) -> Analysis:
        """The analysis of a log whose groups, merged or in parts, are known; ``rules`` and ``counters`` are those they were
        counted with.  It has no lines."""
        found = cls(None, as_of, rules, thresholds, counters)
        found._partial = groups
        return found

    @cached_property
    def entries(self) -> DataFrame:
        return parse_logs(self.lines, as_of=self.as_of, **self._parse_options)

    @cached_property
    def groups(self) -> DataFrame:
        """The counted groups, written to the scratch folder."""
        return self._kept(self._count_groups(), "kind")

    def _kept(self, df, *partition_by):
        self._folders.append(scratch_folder(df.sparkSession))
        return staged(df, *partition_by, path=self._folders[-1])

    def close(self) -> None:
        """Remove the tables that were written; results asked for before cannot be read after."""
        for name in ("groups", "threats", "ranked"):
            self.__dict__.pop(name, None)
        while self._folders:
            remove_folder((self.lines if self._partial is None else self._partial).sparkSession, self._folders.pop())

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def _count_groups(self) -> DataFrame:
        if self._partial is not None:
            return merged(self._partial)
        every = parse_logs(self.lines, as_of=self.as_of, keep_dropped=True, **self._parse_options)
        return merged(partial_groups(every, self.rules, self.counters))

    def _kind(self, *kinds: str) -> DataFrame:
        return self.groups.where(F.col("kind").isin(*kinds))

    # Lines

    @cached_property
    def parse_quality(self) -> DataFrame:
        """``format, n``, dropped lines included."""
        return self._kind("line").select(F.col("text").alias("format"), "n")

    # Threats

    @cached_property
    def ticks(self) -> DataFrame:
        """``counter, ip, ts, n, first_seq`` of the counters."""
        sources = {name: (f"n_counter{i}", f"first_counter{i}") for i, name in enumerate(self.counters)}
        options = F.array(
            *[
                F.struct(F.lit(name).alias("counter"), F.col(n).alias("n"), F.col(seq).alias("first_seq"))
                for name, (n, seq) in sources.items()
            ]
        )
        return (
            self._kind("tick").where(filled(F.col("ip")).isNotNull())
            .select("ip", F.col("at").alias("ts"), F.explode(options).alias("c"))
            .select("c.counter", "ip", "ts", "c.n", "c.first_seq")
            .where(F.col("n") > 0)
        )

    @cached_property
    def threats(self) -> DataFrame:
        """Merged threats, written to the scratch folder."""
        grouped = as_grouped(self._kind("threat", "evidence"), self.rules.free_text)
        bursts = threshold_hits(self.ticks, self.thresholds)
        return self._kept(merge_grouped(grouped, self.rules).unionByName(burst_threats(bursts)))

    @cached_property
    def ranked(self) -> DataFrame:
        return ranked_threats(self.threats)

    # Statistics

    @cached_property
    def ip_counts(self) -> DataFrame:
        return (
            self._kind("tick").where(filled(F.col("ip")).isNotNull())
            .groupBy("ip").agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"))
        )

    @cached_property
    def path_counts(self) -> DataFrame:
        return self._kind("path").select(F.col("text").alias("path"), "n", "first_seq")

    @cached_property
    def status_counts(self) -> DataFrame:
        return self._kind("status").select(F.col("text").cast("int").alias("status"), "n", "first_seq")

    @cached_property
    def timeline(self) -> DataFrame:
        return (
            self._kind("tick").groupBy(F.date_format("at", "HH:mm").alias("minute")).agg(F.sum("n").alias("n"))
        )

    def top_ips(self, k: int = 10) -> DataFrame:
        return stats.most_common(self.ip_counts, k)

    def top_paths(self, k: int = 10) -> DataFrame:
        return stats.most_common(self.path_counts, k)
