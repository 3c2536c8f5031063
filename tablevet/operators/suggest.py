"""Rules worth having, read off the names, types and values of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from tablevet.functions.values import is_string, normalize, quote_name, sql_text
from tablevet.operators.checks import numeric_columns, string_columns
from tablevet.operators import sampling
from tablevet.operators.distinct import distinct_counts, short_lists
from tablevet.operators.fused import FusedScan
from tablevet.operators.roles import ColumnRoles, NameLists, detect_roles, name_has
from tablevet.operators.rules import Rule

# Name parts that tell what a number means.
MONEY_NAMES = ("price", "prix", "amount", "montant", "cost", "coût", "revenue", "ca", "chiffre")
RATE_NAMES = ("discount", "taux", "rate", "pct", "pourcent", "ratio")
COUNT_NAMES = ("qty", "quantity", "quantite", "nb_", "count", "nombre", "nbr")
AGE_NAMES = ("age",)
MONEY_CAP_BELOW = 100_000  # columns that stay under it get a cap of three times their maximum
MAX_RATE = 1.05  # largest maximum still read as a share of one
SUSPECT_NEGATIVE_SHARE = 0.05
MAX_ALLOWED_VALUES = 6
MIN_VALUES_FOR_LIST = 20


@dataclass(frozen=True)
class Suggestion:
    name: str
    condition: str
    column: str
    severity: str
    tag: str

    def as_rule(self) -> Rule:
        return Rule(self.name, self.condition, self.column, self.severity)


def suggest_rules(
    df: DataFrame,
    roles: ColumnRoles | None = None,
    active: list[Rule] | None = None,
    names: NameLists = NameLists(),
    sample_rows: int | None = None,
) -> list[Suggestion]:
    """Suggested rules as Spark SQL conditions, without those whose name is already active.

    Whole columns are profiled; ``sample_rows`` looks at that many instead, the same in every run.  Value
    lists are read only for columns known to hold at most ``MAX_ALLOWED_VALUES`` values.
    """
    df = normalize(sampling.sample_rows(df, sample_rows) if sample_rows else df)
    roles = roles or detect_roles(df, names)
    texts = string_columns(df)

    scan = FusedScan()
    scan.want("rows", "count(1)")
    for c in numeric_columns(df):
        q = quote_name(c)
        scan.want((c, "filled"), f"count({q})")
        scan.want((c, "max"), f"CAST(max({q}) AS DOUBLE)")
        scan.want((c, "negative"), f"count_if({q} < 0)")
    for c in texts:
        scan.want((c, "filled"), f"count({quote_name(c)})")
    found = scan.run(df)

    cells = {f"raw {c}": (quote_name(c), T.StringType()) for c in texts}
    cells |= {f"lower {c}": (f"lower({quote_name(c)})", T.StringType()) for c in texts}
    distinct = distinct_counts(df, cells, rows=found["rows"])
    raw = {c: distinct[f"raw {c}"] for c in texts}
    lower = {c: distinct[f"lower {c}"] for c in texts}
    listed = [c for c in texts if _has_value_list(found[c, "filled"], raw[c])]
    lists = short_lists(df, listed).groupBy("i").agg(F.expr("sort_array(collect_list(v)) AS v"))
    values = {listed[r["i"]]: r["v"] for r in lists.collect()}

    out = [_email(c) for c in roles.emails]
    for c in numeric_columns(df):
        if found[c, "filled"]:
            share = found[c, "negative"] / found[c, "filled"]
            out += _numeric(c, found[c, "max"], share)
    for c in texts:
        if c in values:
            out.append(_value_list(c, values[c]))
        if lower[c] < raw[c]:
            out.append(_lower_case(c))
    for pair in roles.pairs:
        condition = f"{quote_name(pair.col_a)} <= {quote_name(pair.col_b)}"
        name = f"{pair.col_a} < {pair.col_b} (order)"
        out.append(Suggestion(name, condition, pair.col_a, pair.severity, "consistency"))
    taken = {r.name for r in active or []}
    return [s for s in out if s.name not in taken]


def _has_value_list(filled: int, distinct: int) -> bool:
    return 2 <= distinct <= MAX_ALLOWED_VALUES and filled >= MIN_VALUES_FOR_LIST


def _email(c: str) -> Suggestion:
    condition = f"contains({quote_name(c)}, '@')"
    return Suggestion(f"{c}: valid e-mail", condition, c, "high", "email")


def _numeric(c: str, largest: float, negative_share: float) -> list[Suggestion]:
    """The first meaning that fits the name decides."""
    q = quote_name(c)
    if name_has(c, MONEY_NAMES):
        found = [Suggestion(f"{c}: not negative", f"{q} >= 0", c, "high", "validity")]
        if largest < MONEY_CAP_BELOW:
            cap = int(largest * 3)
            name = f"{c}: no extreme value (<= {cap:,})"
            found.append(Suggestion(name, f"{q} <= {cap}", c, "medium", "distribution"))
        return found
    if name_has(c, AGE_NAMES):
        condition = f"{q} >= 0 AND {q} <= 120"
        return [Suggestion(f"{c}: age from 0 to 120", condition, c, "high", "validity")]
    if name_has(c, RATE_NAMES):
        top, kind = (1, "rate") if largest <= MAX_RATE else (100, "percentage")
        condition = f"{q} >= 0 AND {q} <= {top}"
        return [Suggestion(f"{c}: {kind} from 0 to {top}", condition, c, "high", "validity")]
    if name_has(c, COUNT_NAMES):
        return [Suggestion(f"{c}: not a negative quantity", f"{q} >= 0", c, "medium", "validity")]
    if negative_share > SUSPECT_NEGATIVE_SHARE:
        return [Suggestion(f"{c}: no negative value", f"{q} >= 0", c, "medium", "consistency")]
    return []


def _value_list(c: str, values: list[str]) -> Suggestion:
    listed = ", ".join(sql_text(v) for v in values)
    condition = f"{quote_name(c)} IN ({listed})"
    return Suggestion(f"{c}: allowed value", condition, c, "medium", "validity")


def _lower_case(c: str) -> Suggestion:
    q = quote_name(c)
    return Suggestion(f"{c}: lower case", f"{q} = lower({q})", c, "low", "standardization")


def suggestions_table(df: DataFrame, suggestions: list[Suggestion]) -> DataFrame:
    """(name, condition, column, severity, tag)"""
    rows = [(s.name, s.condition, s.column, s.severity, s.tag) for s in suggestions]
    return df.sparkSession.createDataFrame(
        rows, "name string, condition string, column string, severity string, tag string"
    )


def without_active(suggestions: DataFrame, active: DataFrame) -> DataFrame:
    """Suggestions whose name no active rule bears."""
    return suggestions.join(active.select("name"), "name", "left_anti")


def allowed_values(df: DataFrame) -> DataFrame:
    """(column, n_values, allowed_values) of the string columns with a short value list.

    The values come sorted and joined by commas.  Columns are first counted, then only those
    known to hold a short list are collected.
    """
    texts = [f.name for f in df.schema.fields if is_string(f.dataType)]
    scan = FusedScan()
    for c in texts:
        scan.want(c, f"count({quote_name(c)})")
    filled = scan.run(df)
    distinct = distinct_counts(df, {c: (quote_name(c), T.StringType()) for c in texts})
    listed = [c for c in texts if _has_value_list(filled[c], distinct[c])]
    names = ", ".join(map(sql_text, listed)) or "''"
    return (
        short_lists(df, listed)
        .groupBy("i")
        .agg(F.expr("sort_array(collect_list(v)) AS v"))
        .selectExpr(
            f"element_at(array({names}), i + 1) AS column",
            "size(v) AS n_values",
            "array_join(v, ',') AS allowed_values",
        )
    )
