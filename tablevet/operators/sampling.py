"""Samples that are the same rows whatever the order or the partitioning of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tablevet.functions.values import quote_name


def sample_rows(df: DataFrame, n: int, by: Sequence[str] | None = None) -> DataFrame:
    """The ``n`` rows whose key has the least hash; lazy.

    The hash is the MD5 of the columns ``by`` (default: all) as text, null as an empty text under a flag.
    Each task keeps its ``n`` least rows and only those are merged, so ``n`` bounds what moves.
    Equal rows have equal hashes and are taken together while there is room; other rows of one key
    are put in order by a hash of the whole row.
    """
    if n <= 0:
        return df.limit(0)
    order = [f"md5({_text(df, by)})"] if by else []
    order.append(f"md5({_text(df, df.columns)})")
    names = [f"__order_{i}" for i in range(len(order))]
    keyed = df.selectExpr("*", *[f"{key} AS {name}" for key, name in zip(order, names)])
    return keyed.orderBy(*names).limit(n).drop(*names)


def _text(df: DataFrame, columns: Sequence[str]) -> str:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns to sample by: {missing}")
    cells = (f"IF({q} IS NULL, 'n', concat('v', CAST({q} AS STRING)))" for q in map(quote_name, columns))
    return f"concat_ws('\\u001F', {', '.join(cells)})"
