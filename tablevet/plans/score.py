"""``score(df)``: nine quality dimensions, issues and column scores of one table.

The number of Spark actions does not grow with the number of columns:

1. counts    one fused aggregate: nulls, formats, rules, negatives, dates, text flaws
2. distinct  distinct rows and distinct values of every column, one shuffle
   quartiles a few scans of the numeric columns beside it (see ``operators.quartiles``)
3. fences    one fused aggregate: outliers, ordered pairs, and the normalised values of short
             value lists

Only per-column scalars reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from tablevet.functions.text import folded
from tablevet.functions.values import (
    day_comes_first,
    digest,
    is_numeric,
    is_string,
    is_temporal,
    normalize,
    of_times,
    quote_name,
    round1,
    with_written_times,
)
from tablevet.operators.checks import (
    email_checks,
    fake_null_checks,
    negative_checks,
    numeric_columns,
    outlier_checks,
    padding_checks,
    pair_checks,
    phone_checks,
    string_columns,
)
from tablevet.operators.distinct import ROW, distinct_counts, sketched_rows, typed_columns
from tablevet.operators.fused import Check, FusedScan, together
from tablevet.operators.quartiles import approximate_quartiles, quartiles
from tablevet.operators.roles import (
    ColumnRoles,
    NameLists,
    assemble_roles,
    content_counts,
    role_by_content,
    undecided,
)
from tablevet.operators.rules import Rule, compile_rules
from tablevet.sources.scratch import booked, give_back, staged

# The weight of each dimension in the global score, in adding order.
WEIGHTS = {
    "completeness": 0.20,
    "consistency": 0.15,
    "validity": 0.15,
    "uniqueness": 0.12,
    "freshness": 0.10,
    "distribution": 0.08,
    "correlation": 0.08,
    "volumetry": 0.07,
    "standardization": 0.05,
}
NEUTRAL = 90.0  # score of a dimension with nothing to check
NEUTRAL_FRESHNESS = 75.0
VOLUMETRY = 80.0  # one table alone has no volume history
HISTORY_RUNS = 7  # earlier runs that count for volumetry
LEAST_HISTORY = 3  # with fewer there is no history to speak of
MIN_VALUES_FOR_OUTLIERS = 10
MAX_SPELLINGS = 50  # distinct values up to which case variants are looked for
SPELLING_PENALTY = 10


@dataclass(frozen=True)
class Issue:
    dimension: str
    severity: str
    column: str
    check: str
    violations: int
    checked: int
    message: str

    @property
    def pct(self) -> float:
        return self.violations / self.checked * 100 if self.checked else 0.0


@dataclass(frozen=True)
class ColumnScore:
    name: str
    completeness: float
    uniqueness: float
    overall: float


@dataclass
class ScoreResult:
    spark: SparkSession
    table_name: str
    row_count: int
    col_count: int
    scores: dict[str, float]
    global_score: float
    issues: list[Issue]
    columns: list[ColumnScore]
    rules: list[Rule]
    roles: ColumnRoles
    as_of: datetime
    freshness: dict[str, tuple[datetime, float, float]] = field(default_factory=dict)


@dataclass
class Measured:
    """Everything the scans found out about the table."""

    rows: int
    found: dict
    roles: ColumnRoles
    distinct: dict[str, int]
    rule_checks: list[Check]
    rejected: list[tuple[Rule, str]]
    outliers: list[Check] = field(default_factory=list)
    day_first: set[str] = field(default_factory=set)
    written: dict[str, str] = field(default_factory=dict)
    as_of: datetime | None = None


def score(
    df: DataFrame,
    table_name: str = "dataset",
    rules: list[Rule | dict] | None = None,
    freshness_threshold_hours: float = 24,
    as_of: datetime | None = None,
    roles: ColumnRoles | None = None,
    exact: bool = True,
    null_policy: str = "violation",
    names: NameLists = NameLists(),
    stage: bool = False,
    earlier_row_counts: Sequence[int] = (),
) -> ScoreResult:
    """Score one table.

    ``as_of`` is the wall-clock time freshness counts from (default: now, in the session time
    zone).  ``roles`` replaces role detection.  ``exact=False`` estimates quartiles and
    distinct values and rows by sketches, without any shuffle of rows (see ``sketched_rows`` for the error).
    ``stage`` writes the table once as Parquet to the shared scratch folder and scans that copy:
    for CSV, database queries and long plans, which every scan would read again; its space is given back.
    ``earlier_row_counts``, oldest first, say how large the table was in earlier runs (see
    ``plans.history``); without at least three of them volumetry is a neutral constant.
    """
    if not 1 <= freshness_threshold_hours <= 720:
        raise ValueError("freshness_threshold_hours must lie between 1 and 720")
    all_rules = [Rule.of(r) for r in rules or []]
    with booked() as paths:
        df = staged(normalize(df)) if stage else normalize(df)
        m = _measure(df, all_rules, as_of, roles, exact, null_policy, names)
    give_back(df.sparkSession, paths)
    return scored(df, m, table_name, all_rules, freshness_threshold_hours, earlier_row_counts)


def scored(
    df: DataFrame,
    m: Measured,
    table_name: str,
    rules: list[Rule],
    freshness_threshold_hours: float,
    earlier_row_counts: Sequence[int] = (),
) -> ScoreResult:
    """The result of what was measured; of ``df`` only the schema is looked at."""
    issues: list[Issue] = []
    freshness = _freshness_by_column(m, freshness_threshold_hours)
    scores = {
        "completeness": _completeness(df, m, issues),
        "uniqueness": _uniqueness(m, issues),
        "freshness": _freshness(freshness, freshness_threshold_hours, issues),
        "consistency": _consistency(df, m, issues),
        "distribution": _distribution(m, issues),
        "validity": _validity(df, m, issues),
        "correlation": _correlation(df, m, issues),
        "volumetry": _volumetry(m, earlier_row_counts, issues),
        "standardization": _standardization(df, m, issues),
    }
    weighted = 0.0
    for dimension, weight in WEIGHTS.items():
        weighted += scores[dimension] * weight
    return ScoreResult(
        df.sparkSession,
        table_name,
        m.rows,
        len(df.columns),
        {d: scores[d] for d in WEIGHTS},
        round1(weighted),
        issues,
        _column_scores(df, m),
        rules,
        m.roles,
        m.as_of,
        freshness,
    )


# ------------------------------------------------------------------ scans


def _measure(df, rules, as_of, roles, exact, null_policy, names) -> Measured:
    schema = df.schema
    compiled = compile_rules(df, rules, null_policy)
    open_columns = [] if roles else undecided(schema, names)
    by_schema = roles or assemble_roles(schema, {}, names)

    scan = FusedScan()
    timed, written = with_written_times(compiled.df, [*open_columns, *by_schema.dates])
    scan.want("rows", "count(1)")
    scan.want("now", "max(localtimestamp())")
    for f in schema.fields:
        c = quote_name(f.name)
        scan.want((f.name, "nulls"), f"count_if({c} IS NULL)", group=f.name)
        if f.name in open_columns:
            for part, agg in content_counts(c, written[f.name]).items():
                scan.want((f.name, part), agg, group=f.name)
        if f.name in open_columns or f.name in by_schema.dates:
            if is_string(f.dataType) or is_temporal(f.dataType):
                scan.want((f.name, "latest"), of_times("max({0})", c, f.dataType, written.get(f.name)), group=f.name)
                if f.name in written:
                    scan.want((f.name, "day first"), day_comes_first(written[f.name]), group=f.name)
    for check in [
        *negative_checks(df),
        *email_checks(df, by_schema),
        *phone_checks(df, by_schema),
        *padding_checks(df),
        *fake_null_checks(df),
        *compiled.checks,
    ]:
        check.add_to(scan)
    # Sketches are no part of whole-stage code: apart, they do not slow the counts down.
    found, sketched = together(
        lambda: scan.run(timed), lambda: {} if exact else _sketches(df).run(df)
    )
    rows = found["rows"]
    if roles is None:
        content = {
            c: role_by_content(*(found[c, part] for part in ("filled", "dates", "emails")))
            for c in open_columns
        }
        roles = assemble_roles(schema, content, names)

    filled = {c: rows - found[c, "nulls"] for c in numeric_columns(df)}
    measurable = {c: n for c, n in filled.items() if n >= MIN_VALUES_FOR_OUTLIERS}
    if exact:
        numbers = df.selectExpr(
            *[f"CAST({quote_name(c)} AS DOUBLE) AS x{i}" for i, c in enumerate(measurable)]
        )
        wanted = {c: (f"x{i}", n) for i, (c, n) in enumerate(measurable.items())}
        # The one shuffle runs beside the scans that look for quartiles.
        fences, distinct = together(
            lambda: quartiles(numbers, wanted),
            lambda: distinct_counts(df, typed_columns(df), whole_rows=True, rows=rows),
        )
    else:
        fences = {c: tuple(sketched[c, "quartiles"]) for c in measurable}
        distinct = {f.name: sketched[f.name, "distinct"] for f in schema.fields}
        distinct[ROW] = min(rows, sketched[ROW, "distinct"])

    short = [c for c in string_columns(df) if 2 <= distinct[c] <= MAX_SPELLINGS]
    outliers = outlier_checks(df, fences)
    scan = FusedScan()
    day_first = {f.name for f in schema.fields if found.get((f.name, "day first"))}
    timed, written = with_written_times(df, [c for p in roles.pairs for c in (p.col_a, p.col_b)])
    for check in [*outliers, *pair_checks(df, roles.pairs, day_first, written)]:
        check.add_to(scan)
    for c in short:  # few spellings, so a buffer of their hashes is small
        hashed = f"IF({quote_name(c)} IS NOT NULL, xxhash64({folded(quote_name(c))}), NULL)"
        scan.want((c, "values"), f"CAST(size(collect_set({hashed})) AS BIGINT)", group=c)
    found |= scan.run(timed)
    return Measured(
        rows,
        found,
        roles,
        distinct,
        compiled.checks,
        compiled.rejected,
        outliers,
        day_first,
        written,
        as_of or found["now"] or datetime.now(),
    )


def _sketches(df: DataFrame) -> FusedScan:
    scan = FusedScan()
    scan.want((ROW, "distinct"), sketched_rows(df))
    for f in df.schema.fields:
        c = quote_name(f.name)
        key = f"IF({c} IS NOT NULL, {digest(c, f.dataType)[0]}, NULL)"
        scan.want((f.name, "distinct"), f"approx_count_distinct({key})")
        if is_numeric(f.dataType):
            scan.want((f.name, "quartiles"), approximate_quartiles(f"CAST({c} AS DOUBLE)"))
    return scan


# ------------------------------------------------------------------ dimensions


def _share_score(violations: float, checked: int) -> float:
    if checked == 0:
        return NEUTRAL
    return round1(min(100.0, max(0.0, (1 - violations / checked) * 100)))


def _tally(checks: list[Check], m: Measured) -> list[tuple[Check, int, int]]:
    return [(c, *c.counts(m.found)) for c in checks]


def _completeness(df: DataFrame, m: Measured, issues: list[Issue]) -> float:
    cells = m.rows * len(df.columns)
    if cells == 0:
        return 0.0
    total = 0
    for name in df.columns:
        nulls = m.found[name, "nulls"]
        total += nulls
        pct = nulls / m.rows * 100
        if pct > 20:
            severity = "high" if pct > 50 else "medium"
            issues.append(
                Issue("completeness", severity, name, "null", nulls, m.rows, f"{pct:.1f}% null values")
            )
    return round1((1 - total / cells) * 100)


def _uniqueness(m: Measured, issues: list[Issue]) -> float:
    if m.rows < 2:
        return 100.0
    copies = m.rows - m.distinct[ROW]
    pct = copies / m.rows * 100
    if pct > 5:
        severity = "high" if pct > 20 else "medium"
        message = f"{copies:,} duplicate rows ({pct:.1f}%)"
        issues.append(Issue("uniqueness", severity, "all", "duplicate", copies, m.rows, message))
    return round1(max(0.0, 100 - pct * 2))


def _volumetry(m: Measured, earlier: Sequence[int], issues: list[Issue]) -> float:
    """100 less the deviation, in percent, from the mean of the last runs; a constant without history."""
    last = list(earlier)[-HISTORY_RUNS:]
    if len(last) < LEAST_HISTORY:
        return VOLUMETRY
    expected = sum(last) / len(last)
    deviation = abs(m.rows - expected) / expected if expected else float(m.rows > 0)
    if deviation > 0.5:
        severity = "high" if deviation > 1 or m.rows == 0 else "medium"
        message = f"{m.rows:,} rows where {expected:,.0f} are usual"
        issues.append(Issue("volumetry", severity, "all", "volume", 1, 1, message))
    return round1(max(0.0, 100 - deviation * 100))


def _freshness_by_column(
    m: Measured, threshold: float
) -> dict[str, tuple[datetime, float, float]]:
    """Latest time, lag in hours and unrounded score of every date column that has one."""
    out = {}
    for name in m.roles.dates:
        latest = m.found.get((name, "latest"))
        if latest is not None:
            lag = (m.as_of - latest) / timedelta(microseconds=1) / 3.6e9
            out[name] = (latest, lag, min(100.0, max(0.0, 100 - lag / threshold * 100)))
    return out


def _freshness(by_column: dict, threshold: float, issues: list[Issue]) -> float:
    if not by_column:
        return NEUTRAL_FRESHNESS
    for name, (_, lag, _) in by_column.items():
        if lag > threshold:
            severity = "high" if lag > threshold * 3 else "medium"
            message = f"latest value is {lag:.0f} h old"
            issues.append(Issue("freshness", severity, name, "stale", 1, 1, message))
        elif lag < 0:
            message = f"latest value lies {-lag:.0f} h in the future"
            issues.append(Issue("freshness", "low", name, "future", 1, 1, message))
    return round1(sum(s for _, _, s in by_column.values()) / len(by_column))


def _consistency(df: DataFrame, m: Measured, issues: list[Issue]) -> float:
    violations = checked = 0
    for check, v, c in _tally(negative_checks(df), m):
        violations, checked = violations + v, checked + c
        if v:
            issues.append(_issue(check, v, c, f"{v:,} negative values"))
    for check, v, c in _tally(m.rule_checks, m):
        violations, checked = violations + v, checked + c
        if v:
            issues.append(_issue(check, v, c, f"rule {check.name}: {v:,} violations"))
    for rule, reason in m.rejected:
        message = f"rule {rule.name} does not apply to this table: {reason}"
        issues.append(
            Issue("consistency", "low", rule.column or "?", "rule_not_applicable", 0, 0, message)
        )
    return _share_score(violations, checked)


def _distribution(m: Measured, issues: list[Issue]) -> float:
    ratios = []
    for check, v, c in _tally(m.outliers, m):
        ratios.append(v / c)
        if v / c > 0.05:
            issues.append(_issue(check, v, c, f"{v:,} extreme outliers ({v / c * 100:.1f}%)"))
    if not ratios:
        return NEUTRAL
    return round1(max(0.0, 100 - sum(ratios) / len(ratios) * 500))


def _validity(df: DataFrame, m: Measured, issues: list[Issue]) -> float:
    violations = checked = 0
    for name in m.roles.emails:
        if (name, "emails") in m.found:  # e-mail by content: counted while detecting
            c = m.found[name, "filled"]
            v = c - m.found[name, "emails"]
        else:
            tallied = _tally(email_checks(df, ColumnRoles(emails=[name])), m)
            if not tallied:
                continue
            _, v, c = tallied[0]
        violations, checked = violations + v, checked + c
        if v:
            pct = v / c * 100
            severity = "high" if pct > 20 else "medium"
            message = f"{v:,} invalid e-mail addresses ({pct:.1f}%)"
            issues.append(Issue("validity", severity, name, "email", v, c, message))
    for check, v, c in _tally(phone_checks(df, m.roles), m):
        violations, checked = violations + v, checked + c
        if v:
            issues.append(_issue(check, v, c, f"{v:,} invalid phone numbers"))
    return _share_score(violations, checked)


def _correlation(df: DataFrame, m: Measured, issues: list[Issue]) -> float:
    violations = checked = 0
    for check, v, c in _tally(pair_checks(df, m.roles.pairs, m.day_first, m.written), m):
        violations, checked = violations + v, checked + c
        if v:
            issues.append(_issue(check, v, c, f"{v:,} violations of '{check.name}'"))
    return _share_score(violations, checked)


def _standardization(df: DataFrame, m: Measured, issues: list[Issue]) -> float:
    violations = checked = 0
    fakes = {c.column: (c, v) for c, v, _ in _tally(fake_null_checks(df), m)}
    for check, padded, filled in _tally(padding_checks(df), m):
        name = check.column
        checked += filled
        violations += padded
        if padded:
            issues.append(_issue(check, padded, filled, f"{padded:,} values with outer white space"))
        fake_check, fake = fakes[name]
        violations += fake
        if fake:
            issues.append(_issue(fake_check, fake, filled, f"{fake:,} stand-ins for null"))
        spellings, values = m.distinct.get(name, 0), m.found.get((name, "values"))
        if values is not None and values < spellings:
            violations += (spellings - values) * SPELLING_PENALTY
            message = f"{spellings} spellings of {values} values"
            issues.append(
                Issue(
                    "standardization", "medium", name, "case_variant",
                    spellings - values, spellings, message,
                )
            )
    return _share_score(violations, checked)


def _issue(check: Check, violations: int, checked: int, message: str) -> Issue:
    return Issue(
        check.dimension, check.severity, check.column, check.kind, violations, checked, message
    )


def column_score(name: str, rows: int, nulls: int, distinct: int) -> ColumnScore:
    if rows == 0:
        return ColumnScore(name, 0.0, 0.0, 0.0)
    filled = round1((1 - nulls / rows) * 100)
    unique = round1(min(100.0, distinct / rows * 100))  # a sketch may overshoot
    overall = min(100.0, round1(filled * 0.6 + min(unique * 1.5, 100.0) * 0.4))
    return ColumnScore(name, filled, unique, overall)


def _column_scores(df: DataFrame, m: Measured) -> list[ColumnScore]:
    return [
        column_score(c, m.rows, m.found[c, "nulls"], m.distinct.get(c, 0)) for c in df.columns
    ]
