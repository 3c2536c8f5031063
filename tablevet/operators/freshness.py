"""Age of the latest value of each date column."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from tablevet.functions.values import is_string, is_temporal, of_times, quote_name, sql_double, sql_text, with_written_times
from tablevet.operators.fused import rows_of


def freshness(
    df: DataFrame, dates: list[str], as_of: datetime, threshold_hours: float = 24
) -> DataFrame:
    """(column, max_ts, unparsable, lag_hours, score) per date column; lazy, one scan.

    A latest value after ``as_of`` scores 100, never more.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    now = f"TIMESTAMP_NTZ'{as_of.isoformat(' ')}'"
    records = []
    timed, written = with_written_times(df, dates)
    for name in dates:
        if name in types and (is_string(types[name]) or is_temporal(types[name])):
            column = quote_name(name)
            latest = of_times("max({0})", column, types[name], written.get(name))
            lag = f"timestampdiff(MICROSECOND, {latest}, {now}) / 3.6e9"
            score = f"least(100e0, greatest(0e0, 100 - {lag} / {sql_double(float(threshold_hours))} * 100))"
            records.append(
                {
                    "column": sql_text(name),
                    "max_ts": latest,
                    "unparsable": f"count({column}) - {of_times('count({0})', column, types[name], written.get(name))}",
                    "lag_hours": lag,
                    "score": f"CASE WHEN {latest} IS NOT NULL THEN {score} END",
                }
            )
    return rows_of(
        timed,
        records,
        "column:string, max_ts:timestamp_ntz, unparsable:bigint, lag_hours:double, score:double",
    )
