"""User rules: build, compile, and report the ones that do not apply."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from tablevet.functions.settings import held_setting
from tablevet.functions.values import as_number, is_numeric, quote_name, sql_double, sql_text
from tablevet.operators.fused import Check

OPERATORS = (">", ">=", "<", "<=", "==", "!=")
SEVERITIES = ("low", "medium", "high")
NULL_POLICIES = ("violation", "ignore")


@dataclass(frozen=True)
class Rule:
    """A condition every row must meet.

    ``condition`` is a Spark SQL expression.  With ``operator`` and ``value`` the rule compares
    ``column`` with a constant and needs no SQL at all.
    """

    name: str
    condition: str = ""
    column: str = ""
    severity: str = "medium"
    operator: str = ""
    value: str = ""

    def __post_init__(self) -> None:
        if self.severity not in SEVERITIES:
            raise ValueError(f"severity must be one of {SEVERITIES}: {self.severity!r}")

    @staticmethod
    def of(rule: Rule | dict) -> Rule:
        """Accept a mapping with the same keys; unknown keys are display data and dropped."""
        if isinstance(rule, Rule):
            return rule
        known = {k: v for k, v in rule.items() if k in Rule.__dataclass_fields__}
        return Rule(**known)


def build_rule(
    name: str, column_name: str, operator: str, value: str, severity: str = "medium"
) -> Rule:
    """Rule from its parts; a value that reads as a number is compared as one."""
    if operator not in OPERATORS:
        raise ValueError(f"operator must be one of {OPERATORS}: {operator!r}")
    shown = value if _as_float(value) is not None else sql_text(value)
    condition = f"{quote_name(column_name)} {operator} {shown}"
    return Rule(name, condition, column_name, severity, operator, value)


def add_rule(rules: list[Rule], rule: Rule) -> list[Rule]:
    return [*rules, rule]


def remove_rule(rules: list[Rule], name: str) -> list[Rule]:
    return [r for r in rules if r.name != name]


@dataclass(frozen=True)
class CompiledRules:
    """``df`` carries one boolean column per applicable rule, true where a row violates it."""

    df: DataFrame
    checks: list[Check]
    rejected: list[tuple[Rule, str]]  # with the reason


def compile_rules(
    df: DataFrame, rules: list[Rule | dict], null_policy: str = "violation"
) -> CompiledRules:
    """Turn rules into checks.

    A row whose condition is null (some operand is missing) violates the rule, except for
    ``!=`` rules, which a missing value satisfies.  ``null_policy="ignore"`` lets every null
    condition pass.  Rules that cannot be analysed against ``df`` are rejected, never dropped.
    """
    if null_policy not in NULL_POLICIES:
        raise ValueError(f"null_policy must be one of {NULL_POLICIES}: {null_policy!r}")
    violations: list[tuple[Rule, str]] = []
    rejected: list[tuple[Rule, str]] = []
    with _lenient_casts(df.sparkSession):
        for rule in map(Rule.of, rules):
            try:
                condition = _condition(df, rule)
                df.filter(condition).schema  # must be a row predicate over these columns
            except (AnalysisException, ParseException, ValueError) as e:
                rejected.append((rule, str(e).splitlines()[0]))
                continue
            passes_on_null = null_policy == "ignore" or (
                rule.operator == "!=" and rule.column in df.columns
            )
            met = f"coalesce({condition}, {str(passes_on_null).lower()})"
            violations.append((rule, f"NOT {met}"))
        names = [f"__rule_{i}" for i in range(len(violations))]
        checked_df = df.selectExpr("*", *[f"{v} AS {n}" for n, (_, v) in zip(names, violations)])
        checked_df.schema  # analysed here, under lenient casts
    checks = [
        Check(
            "consistency",
            "rule",
            rule.column or "custom",
            n,
            "true",
            rule.severity,
            rule.name,
        )
        for n, (rule, _) in zip(names, violations)
    ]
    return CompiledRules(checked_df, checks, rejected)


def _condition(df: DataFrame, rule: Rule) -> str:
    field = next((f for f in df.schema.fields if f.name == rule.column), None)
    if rule.operator not in OPERATORS or field is None:
        return f"({rule.condition}\n)"  # the line break ends a trailing comment
    c = quote_name(rule.column)
    number = _as_float(rule.value)
    if number is not None:
        # Text against a number: what does not read as a number counts as missing.
        left = c if is_numeric(field.dataType) else as_number(c, field.dataType)
        literal = str(number) if isinstance(number, int) else sql_double(number)
        return f"{left} {rule.operator} {literal}"
    if is_numeric(field.dataType):
        raise ValueError(f"{rule.value!r} is not a number")
    return f"{c} {rule.operator} {sql_text(rule.value)}"


def _as_float(text: str) -> int | float | None:
    for kind in (int, float):
        try:
            number = kind(text)
        except ValueError:
            continue
        return None if math.isnan(number) else number
    return None


@contextmanager
def _lenient_casts(spark: SparkSession) -> Iterator[None]:
    """Analyse rule conditions so that a bad cast gives null and not a failed job.

    Under ANSI rules ``status > 5`` on a text column would end the whole fused scan at its
    first word.  The setting takes effect while the condition is analysed and is put back.
    """
    with held_setting(spark, "spark.sql.ansi.enabled", "false"):
        yield
