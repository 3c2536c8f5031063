"""The row checks of the quality dimensions, one builder per check."""

from __future__ import annotations

import math
from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame

from tablevet.functions.text import is_email, is_fake_null, is_padded, is_phone
from tablevet.functions.values import (
    as_number,
    as_wall_time,
    is_numeric,
    is_string,
    quote_name,
    round1_sql,
    sql_double,
    sql_text,
)
from tablevet.operators.fused import Check, rows_of
from tablevet.operators.roles import ColumnRoles, Pair, name_has

# Names whose numbers must not be negative.
NON_NEGATIVE_NAMES = ("price", "prix", "amount", "montant", "age", "qty", "quantity", "stock")

_NEGATED = {"<": ">=", "<=": ">", ">": "<=", ">=": "<", "==": "<>", "!=": "="}


def null_profile(df: DataFrame) -> DataFrame:
    """(column, null_count, row_count, completeness) per column; lazy, one scan."""
    records = []
    for name in df.columns:
        nulls = f"count_if({quote_name(name)} IS NULL)"
        score = round1_sql(f"(1 - {nulls} / count(1)) * 100")
        records.append(
            {
                "column": sql_text(name),
                "null_count": nulls,
                "row_count": "count(1)",
                "completeness": f"CASE WHEN count(1) = 0 THEN 0e0 ELSE {score} END",
            }
        )
    return rows_of(
        df,
        records,
        "column:string, null_count:bigint, row_count:bigint, completeness:double",
    )


def completeness(df: DataFrame) -> DataFrame:
    """(score, nulls, cells) over all cells of the table; lazy, one scan."""
    nulls = " + ".join(f"count_if({quote_name(c)} IS NULL)" for c in df.columns)
    score = round1_sql("(1 - nulls / cells) * 100")
    return df.selectExpr(f"{nulls} AS nulls", f"count(1) * {len(df.columns)} AS cells").selectExpr(
        f"CASE WHEN cells = 0 THEN 0e0 ELSE {score} END AS score", "nulls", "cells"
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_string(f.dataType)]


def numeric_profile(df: DataFrame) -> DataFrame:
    """(column, min, max, neg_share) of every numeric column; lazy, one scan."""
    records = [
        {
            "column": sql_text(name),
            "min": f"CAST(min({quote_name(name)}) AS DOUBLE)",
            "max": f"CAST(max({quote_name(name)}) AS DOUBLE)",
            "neg_share": f"try_divide(count_if({quote_name(name)} < 0), count({quote_name(name)}))",
        }
        for name in numeric_columns(df)
    ]
    return rows_of(df, records, "column:string, min:double, max:double, neg_share:double")


def negative_checks(df: DataFrame, names: tuple[str, ...] = NON_NEGATIVE_NAMES) -> list[Check]:
    return [
        Check("consistency", "negative", c, f"{quote_name(c)} < 0", "true", "high")
        for c in numeric_columns(df)
        if name_has(c, names)
    ]


def email_checks(df: DataFrame, roles: ColumnRoles) -> list[Check]:
    return [_format_check("email", c, is_email(quote_name(c))) for c in _present(df, roles.emails)]


def phone_checks(df: DataFrame, roles: ColumnRoles) -> list[Check]:
    return [_format_check("phone", c, is_phone(quote_name(c))) for c in _present(df, roles.phones)]


def _format_check(kind: str, name: str, valid: str) -> Check:
    filled = f"{quote_name(name)} IS NOT NULL"
    return Check("validity", kind, name, f"{filled} AND NOT ({valid})", filled)


def pair_checks(
    df: DataFrame, pairs: list[Pair], day_first: Collection[str] = (), written: Mapping[str, str] = {}
) -> list[Check]:
    """Sides are compared as numbers if one is a number, else as times.

    ``day_first`` names the text columns whose dates have the day before the month, ``written`` where
    the times of text columns are found (see ``with_written_times``).
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    checks = []
    for pair in pairs:
        if pair.col_a not in types or pair.col_b not in types:
            continue
        if pair.operator not in _NEGATED:
            raise ValueError(f"operator must be one of {tuple(_NEGATED)}: {pair.operator!r}")
        sides = [(quote_name(c), types[c]) for c in (pair.col_a, pair.col_b)]
        if any(is_numeric(t) for _, t in sides):
            a, b = (as_number(c, t) for c, t in sides)
        else:
            names = (pair.col_a, pair.col_b)
            a, b = (
                f"{written[n]}.{'day_first' if n in day_first else 'month_first'}" if n in written else as_wall_time(c, t, n in day_first)
                for n, (c, t) in zip(names, sides)
            )
        checks.append(
            Check(
                "correlation",
                "pair",
                f"{pair.col_a}/{pair.col_b}",
                f"{a} {_NEGATED[pair.operator]} {b}",
                f"{a} IS NOT NULL AND {b} IS NOT NULL",
                pair.severity,
                pair.name,
            )
        )
    return checks


def padding_checks(df: DataFrame) -> list[Check]:
    return [_text_check("padding", c, is_padded(quote_name(c)), "low") for c in string_columns(df)]


def fake_null_checks(df: DataFrame) -> list[Check]:
    return [
        _text_check("fake_null", c, is_fake_null(quote_name(c)), "medium") for c in string_columns(df)
    ]


def _text_check(kind: str, name: str, flawed: str, severity: str) -> Check:
    filled = f"{quote_name(name)} IS NOT NULL"
    return Check("standardization", kind, name, f"{filled} AND {flawed}", filled, severity)


def outlier_checks(
    df: DataFrame, quartiles: dict[str, tuple[float, float]], reach: float = 3.0
) -> list[Check]:
    """Values beyond ``reach`` interquartile ranges; constant columns have no fences."""
    checks = []
    for name, (q1, q3) in quartiles.items():
        spread = q3 - q1
        if spread == 0:
            continue
        x = f"CAST({quote_name(name)} AS DOUBLE)"
        fences = ((x, "<", q1 - reach * spread), (x, ">", q3 + reach * spread))
        # infinite quartiles leave a fence that is no number: nothing lies beyond it
        tests = [f"{x} {sign} {sql_double(at)}" for x, sign, at in fences if not math.isnan(at)]
        beyond = " OR ".join(tests) or "false"
        checks.append(
            Check("distribution", "outlier", name, beyond, f"{quote_name(name)} IS NOT NULL")
        )
    return checks


def _present(df: DataFrame, names: list[str]) -> list[str]:
    return [c for c in names if c in df.columns]
