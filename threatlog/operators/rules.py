"""Row rules: which lines look like an attack, and the rows that count for the burst rules.

All rules are tried in one pass.  First each row gets the numbers of the rules it may hit,
then only those pairs are fanned out, checked and given their texts.

A rule with ``hints`` may only match where one of them occurs: hints are lower-case texts of
which every match holds at least one.  They change the cost and not the result, since most
lines hold none and never reach a regular expression.  Lines with letters outside ASCII count
as holding every hint, as such a letter may stand for an ASCII one when case is ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    AUTH_FAILURE_PHRASES,
    COMMAND_INJECTION,
    CONFIG_FILE,
    CROSS_SITE_SCRIPT,
    DENIED_STATUSES,
    EVIDENCE_CHARS,
    FAILURE_WORDS,
    FILE_INCLUSION,
    PATH_TRAVERSAL,
    ROW_RULE_TEXTS,
    SCANNER,
    SENSITIVE_PATH,
    SEVERITY,
    SHORT_EVIDENCE_CHARS,
    SQL_INJECTION,
    WEB_SHELL,
)
from ..functions.text import HINTS, contains_any, fill, filled, joined, matches

HIT_COLUMNS = (
    "seq", "source", "rule_no", "rule_id", "rule_name", "level", "level_score", "description", "evidence",
    "ip", "user", "ts", "tz_offset", "status",
)


@dataclass(frozen=True)
class Rule:
    """A row rule.

    ``predicate`` and ``evidence`` are columns over entries, ``description`` is a text with
    ``{ip}``, ``{user}``, ``{status}``, or a column.  ``hints`` are optional, see above; they
    may be used when the predicate searches path, message and raw line.
    """

    rule_id: str
    name: str
    level: str
    predicate: Column
    evidence: Column
    description: str | Column
    hints: tuple[str, ...] = ()

    def __post_init__(self):
        if self.level not in SEVERITY:
            raise ValueError(f"unknown level {self.level!r}")

    @property
    def free_text(self) -> bool:
        return not isinstance(self.description, str)

    def describe(self, ip: Column, user: Column, status: Column) -> Column:
        """The description as a column."""
        if self.free_text:
            return self.description
        return fill(
            self.description, ip=ip, user=F.coalesce(filled(user), F.lit("unknown")), status=status
        )


@dataclass(frozen=True)
class RuleSet:
    """An ordered set of rules; their order is the order of a line's hits."""

    rules: tuple[Rule, ...]

    def __post_init__(self):
        ids = [r.rule_id for r in self.rules]
        if len(set(ids)) != len(ids):
            raise ValueError("rule ids must be unique")

    def with_rule(self, rule: Rule) -> "RuleSet":
        """The set with one more rule at its end."""
        return replace(self, rules=self.rules + (rule,))

    @property
    def free_text(self) -> bool:
        return any(r.free_text for r in self.rules)

    def by_number(self, number: Column, value) -> Column:
        """``value(rule)`` of the rule with this 1-based number."""
        out = None
        for n, rule in enumerate(self.rules, start=1):
            out = F.when(number == n, value(rule)) if out is None else out.when(number == n, value(rule))
        return out

    def attribute(self, number: Column, name: str) -> Column:
        """A literal attribute (id, name, level) of the rule with this number."""
        return F.get(F.array(*[F.lit(getattr(r, name)) for r in self.rules]), number - 1)

    def level_score(self, number: Column) -> Column:
        return F.get(F.array(*[F.lit(SEVERITY[r.level]) for r in self.rules]), number - 1)

    def candidates(self) -> Column:
        """The numbers of the rules a row may hit, in order: hints checked, other predicates decided."""
        probe = F.col("probe")
        flags = []
        for n, rule in enumerate(self.rules, start=1):
            may = contains_any(probe, rule.hints) | ~F.col("plain") if rule.hints else rule.predicate
            flags.append(F.when(may, F.lit(n)).otherwise(F.lit(0)))
        return F.array_remove(F.array(*flags), 0)

    def confirmed(self, number: Column) -> Column:
        """Whether a candidate is a hit."""
        out = F
        for n, rule in enumerate(self.rules, start=1):
            if rule.hints:
                out = out.when(number == n, rule.predicate)
        return F.lit(True) if out is F else out.otherwise(True)


def candidate_hits(entries: DataFrame, rules: RuleSet) -> DataFrame:
    """Entries with ``candidates``, the numbers of the rules each may hit.

    ``probe`` is lower-case text holding all that a rule searches.  Path and message are cut
    from the line itself except in JSON, where they are unescaped.
    """
    whole = F.when(F.col("format") == "json", joined(F.col("path"), F.col("message"), F.col("raw")))
    probe = F.col("probe")
    return (
        entries.withColumn("probe", F.lower(whole.otherwise(F.col("raw"))))
        .withColumn("plain", F.octet_length(probe) == F.length(probe))
        .withColumn("candidates", rules.candidates())
        .drop("probe", "plain")
    )


def sure_hits(rules: RuleSet) -> list[Column]:
    """For each rule whether a row with ``candidates`` is a hit."""
    found = []
    for number, rule in enumerate(rules.rules, start=1):
        may = F.array_contains("candidates", number)
        found.append(may & rule.predicate if rule.hints else may)
    return found


def is_hit(rules: RuleSet) -> Column:
    """Whether any rule hits a row with ``candidates``; rules are tried until one does."""
    return F.coalesce(F.when(F.size("candidates") > 0, reduce(or_, sure_hits(rules))), F.lit(False))


def default_rules() -> RuleSet:
    """The eleven built-in row rules."""
    raw, path, message, status = F.col("raw"), F.col("path"), F.col("message"), F.col("status")
    everything = joined(path, message, raw)
    request = joined(path, raw)

    def search(text, pattern):
        return matches(text, pattern), HINTS[pattern]

    def cut(text, size=EVIDENCE_CHARS):
        return F.substring(text, 1, size)

    path_or_line = F.coalesce(filled(path), cut(raw, SHORT_EVIDENCE_CHARS))
    spoken = F.lower(F.coalesce(filled(message), raw))
    parts = {
        "R001": (search(everything, SQL_INJECTION), cut(everything)),
        "R002": (search(everything, CROSS_SITE_SCRIPT), cut(everything)),
        "R003": (search(request, PATH_TRAVERSAL), cut(request)),
        "R004": (search(request, SENSITIVE_PATH), path_or_line),
        "R005": (
            (matches(raw, SCANNER), ("nikto", "map", "masscan", "zgrab", "nuclei", "buster")),
            cut(raw),
        ),
        "R006": ((contains_any(spoken, AUTH_FAILURE_PHRASES) | status.isin(*DENIED_STATUSES), ()), cut(raw)),
        "R007": ((status >= 500, ()), cut(raw, SHORT_EVIDENCE_CHARS)),
        "R011": (search(everything, FILE_INCLUSION), cut(everything)),
        "R012": (search(everything, COMMAND_INJECTION), cut(everything)),
        "R013": (search(request, WEB_SHELL), path_or_line),
        "R014": (search(request, CONFIG_FILE), path_or_line),
    }

    return RuleSet(
        tuple(
            Rule(
                rule_id, name, level, parts[rule_id][0][0],
                F.concat(fill(prefix, status=status), parts[rule_id][1]), description, parts[rule_id][0][1],
            )
            for rule_id, name, level, description, prefix in ROW_RULE_TEXTS
        )
    )


def rule_hits(entries: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """One row per line and rule it hits; batch and streaming."""
    rules = rules or default_rules()
    # explode_outer + filter, not explode: for explode the optimizer adds a size() > 0 filter
    # below, which would look for all hints a second time.
    fanned = (
        candidate_hits(entries, rules)
        .withColumn("rule_no", F.explode_outer("candidates"))
        .where(F.col("rule_no").isNotNull())
        .where(rules.confirmed(F.col("rule_no")))
    )
    no = F.col("rule_no")
    return fanned.withColumns(
        {
            "rule_id": rules.attribute(no, "rule_id"),
            "rule_name": rules.attribute(no, "name"),
            "level": rules.attribute(no, "level"),
            "level_score": rules.level_score(no),
            "description": rules.by_number(
                no, lambda r: r.describe(F.col("ip"), F.col("user"), F.col("status"))
            ),
            "evidence": rules.by_number(no, lambda r: r.evidence),
        }
    ).select(*HIT_COLUMNS)


def counter_flags() -> dict[str, Column]:
    """The three counters of the burst rules as conditions over entries; all need an address."""
    has_ip = filled(F.col("ip")).isNotNull()
    spoken = F.lower(F.col("message"))
    denied = F.coalesce(F.col("status").isin(*DENIED_STATUSES), F.lit(False))
    failed = F.coalesce(contains_any(spoken, FAILURE_WORDS), F.lit(False))
    return {
        "fail": has_ip & (failed | denied),
        "not_found": has_ip & F.coalesce(F.col("status") == 404, F.lit(False)),
        "request": has_ip,
    }
