"""Findings: the one row shape every audit emits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = (
    "struct<category:string,rule_id:string,passed:boolean,weight:int,severity:string,n:bigint,info:string>"
)

# Severities from worst to best.
SEVERITIES = ("critical", "high", "medium", "low", "informational", "good")


def severity_of(weight: Column) -> Column:
    return (
        F.when(weight >= 14, "critical").when(weight >= 9, "high").when(weight >= 5, "medium")
        .when(weight >= 2, "low").otherwise("informational")
    )


def severity_rank(severity: Column) -> Column:
    """critical 5 ... good 0"""
    out = F.when(severity == SEVERITIES[0], F.lit(5))
    for i, s in enumerate(SEVERITIES[1:], 1):
        out = out.when(severity == s, F.lit(5 - i))
    return out.otherwise(F.lit(0))


def _fixed_severity(weight: int) -> str:
    """:func:`severity_of` for a weight that is known when the plan is built."""
    return next((s for least, s in ((14, "critical"), (9, "high"), (5, "medium"), (2, "low")) if weight >= least), "informational")


def _sql(x) -> str:
    if x is None or isinstance(x, (bool, int)):
        return "NULL" if x is None else str(x)
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _field(name: str, kind: str, x) -> Column:
    return x.cast(kind).alias(name) if isinstance(x, Column) else F.expr(f"CAST({_sql(x)} AS {kind}) AS {name}")


class Checks:
    """Collects the checks of one family and turns them into one array column."""

    def __init__(self, category: str):
        self.category = category
        self.entries: list[tuple[Column, Column]] = []

    def _struct(self, rule_id, passed: bool, weight, severity, n, info) -> Column:
        """One row of :data:`FINDING`. What is fixed reaches the JVM as text, in one piece if all of it is: there are hundreds."""
        fields = {
            "category": ("string", self.category), "rule_id": ("string", rule_id), "passed": ("boolean", passed), "weight": ("int", weight),
            "severity": ("string", severity), "n": ("bigint", n), "info": ("string", info),
        }
        if any(isinstance(x, Column) for _, x in fields.values()):
            return F.struct(*[_field(name, kind, x) for name, (kind, x) in fields.items()])
        return F.expr("named_struct(" + ", ".join(f"'{name}', CAST({_sql(x)} AS {kind})" for name, (kind, x) in fields.items()) + ")")

    def issue(self, rule_id, weight, when: Column, n=None, info=None, severity: str | None = None) -> "Checks":
        sev = severity or (severity_of(weight) if isinstance(weight, Column) else _fixed_severity(weight))
        self.entries.append((when, self._struct(rule_id, False, weight, sev, n, info)))
        return self

    def ok(self, rule_id, when: Column, n=None, info=None) -> "Checks":
        self.entries.append((when, self._struct(rule_id, True, 0, "good", n, info)))
        return self

    def either(self, rule_id, weight, bad: Column, pass_id=None, n=None, info=None, severity: str | None = None) -> "Checks":
        """An issue when ``bad``, else its passed check."""
        self.issue(rule_id, weight, bad, n, info, severity)
        return self.ok(pass_id or rule_id, ~F.coalesce(bad, F.lit(False)), n)

    def column(self) -> Column:
        none = F.array().cast(f"array<{FINDING}>")
        return F.concat(*[F.when(when, F.array(found.cast(FINDING))).otherwise(none) for when, found in self.entries])


def explode_findings(df: DataFrame, keys: list[str], findings: Column) -> DataFrame:
    """Findings array to rows. ``inline_outer`` keeps Spark from adding a size filter that would
    compute the array twice."""
    return (
        df.select(*keys, findings.alias("_f"))
        .select(*keys, F.inline_outer("_f"))
        .filter(F.col("rule_id").isNotNull())
    )


def rule_title(rule_id: Column) -> Column:
    """Readable name of a rule, made from its id."""
    words = F.regexp_replace(rule_id, "-", " ")
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))
