"""Hits to threats: one row per rule, address and user.

A task counts its hits per threat and per distinct evidence and keeps the five first evidences of each threat
(:mod:`threatlog.operators.groups`), so a threat with millions of evidences sends five per task through the first
shuffle.  Merged over the tasks, the totals give the counts and the first hit, and a ranked limit the five evidences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed_values import EVIDENCE_CAP
from .groups import as_grouped, merged, partial_hit_groups
from .rules import RuleSet, default_rules

THREAT_COLUMNS = (
    "rule_id", "rule_name", "level", "level_score", "description", "ip", "user", "ts", "tz_offset", "evidence",
    "count", "phase", "rule_no", "first_seq",
)

_FIRST_FIELDS = ("ts", "tz_offset", "status")


def merge_threats(hits: DataFrame, bursts: DataFrame | None = None, rules: RuleSet | None = None) -> DataFrame:
    """Row hits merged, followed by the burst threats (of which there is one per rule and address).

    The text of a threat is that of its first hit.  ``evidence`` holds up to five distinct texts
    in first-seen order, ``count`` the sum.
    """
    rules = rules or default_rules()
    groups = merged(partial_hit_groups(hits, rules.free_text))
    threats = merge_grouped(as_grouped(groups, rules.free_text), rules)
    return threats if bursts is None else threats.unionByName(burst_threats(bursts))


def merge_grouped(grouped: DataFrame, rules: RuleSet) -> DataFrame:
    """Threats from hits counted per threat (``is_total`` 1) and per evidence (``is_total`` 0)."""
    order = W.partitionBy("rule_no", "ip", "user").orderBy(F.desc("is_total"), "first_seq")
    ranked = grouped.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= EVIDENCE_CAP + 1)
    total = F.col("is_total") == 1
    texts = F.sort_array(
        F.collect_list(F.when(~total, F.struct(F.col("_rank"), F.col("evidence").alias("text"))))
    )
    kept = [*_FIRST_FIELDS, "count", "first_seq"] + (["description"] if rules.free_text else [])
    no = F.col("rule_no")
    merged = ranked.groupBy("rule_no", "ip", "user").agg(
        F.transform(texts, lambda t: t["text"]).alias("evidence"),
        *[F.max(F.when(total, F.col(name))).alias(name) for name in kept],
    )
    return merged.withColumns(
        {
            "rule_id": rules.attribute(no, "rule_id"),
            "rule_name": rules.attribute(no, "name"),
            "level": rules.attribute(no, "level"),
            "level_score": rules.level_score(no),
            "description": rules.by_number(
                no,
                lambda r: F.col("description") if r.free_text
                else r.describe(F.col("ip"), F.col("user"), F.col("status")),
            ),
            "phase": F.lit(0),
        }
    ).select(*THREAT_COLUMNS)


def burst_threats(bursts: DataFrame) -> DataFrame:
    """Burst hits in the shape of threats: no user, one evidence."""
    return bursts.withColumns(
        {
            "user": F.lit(None).cast("string"),
            "tz_offset": F.lit(None).cast("int"),
            "evidence": F.array("evidence"),
            "phase": F.lit(1),
        }
    ).select(*THREAT_COLUMNS)


def threat_order():
    """Worst first; equals in the order a line-by-line run would have raised them."""
    return [
        F.desc("level_score"), F.asc("phase"), F.when(F.col("phase") == 1, F.col("rule_no")),
        F.asc("first_seq"), F.asc("rule_no"), F.asc("ip"), F.asc("user"),
    ]


def ranked_threats(threats: DataFrame) -> DataFrame:
    """Threats in report order (a range-partitioned sort)."""
    return threats.orderBy(*threat_order())


def threats_of_level(threats: DataFrame, level: str = "ALL") -> DataFrame:
    """Threats of one severity, or all of them."""
    return threats if level == "ALL" else threats.where(F.col("level") == level)
