"""Many measurements, one scan."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame

from tablevet.functions.values import sql_text

# Wider aggregates than this are cut into several scans; with a columnar source each scan
# reads only its own columns.
MAX_AGGREGATES = 400


class FusedScan:
    """Collects named SQL aggregates over one frame and evaluates them together.

    One row of scalars reaches the driver, whatever the table size.
    """

    def __init__(self) -> None:
        self._wanted: dict[Hashable, tuple[str, str]] = {}
        self._groups: dict[str, list[Hashable]] = {}

    def want(
        self, key: Hashable, aggregate: str, finish: str = "{0}", group: str = ""
    ) -> None:
        """Ask for an aggregate; ``finish`` derives the answer from its one final value.

        Aggregates of one ``group`` (a column) stay together when a wide scan is cut.
        """
        if key not in self._wanted:
            self._wanted[key] = (aggregate, finish)
            self._groups.setdefault(group, []).append(key)
        elif self._wanted[key] != (aggregate, finish):
            raise ValueError(f"two different aggregates are asked for as {key!r}")

    def run(self, df: DataFrame) -> dict:
        items = [(k, self._wanted[k]) for keys in self._groups.values() for k in keys]
        found: dict = {}
        for start in range(0, len(items), MAX_AGGREGATES):
            part = items[start : start + MAX_AGGREGATES]
            measured = df.selectExpr(*[f"{agg} AS m{i}" for i, (_, (agg, _)) in enumerate(part)])
            if any(finish != "{0}" for _, (_, finish) in part):
                measured = measured.selectExpr(
                    *[f"{fin.format(f'm{i}')} AS m{i}" for i, (_, (_, fin)) in enumerate(part)]
                )
            row = measured.collect()[0]
            found.update((key, row[i]) for i, (key, _) in enumerate(part))
        return found


def together(*actions: Callable[[], dict]) -> list[dict]:
    """Submit independent Spark actions side by side and wait for all of them."""
    outcomes: list[dict | BaseException] = [{} for _ in actions]

    def run(i: int) -> None:
        try:
            outcomes[i] = actions[i]()
        except BaseException as e:  # raised below, in the calling thread
            outcomes[i] = e

    threads = [InheritableThread(target=run, args=(i,)) for i in range(1, len(actions))]
    for thread in threads:
        thread.start()
    run(0)
    for thread in threads:
        thread.join()
    for outcome in outcomes:
        if isinstance(outcome, BaseException):
            raise outcome
    return outcomes


@dataclass(frozen=True)
class Check:
    """A row predicate with the rows it applies to.

    ``violation`` and ``checked`` are SQL predicates; ``column`` labels the result.
    """

    dimension: str
    kind: str
    column: str
    violation: str
    checked: str
    severity: str = "medium"
    name: str = ""

    @property
    def key(self) -> tuple[str, str, str, str, str]:
        """Checks with one name and column are told apart by what they test."""
        return (self.kind, self.column, self.name, self.violation, self.checked)

    @property
    def violations_agg(self) -> str:
        return f"count_if({self.violation})"

    @property
    def checked_agg(self) -> str:
        return "count(1)" if self.checked == "true" else f"count_if({self.checked})"

    def add_to(self, scan: FusedScan) -> None:
        scan.want((*self.key, "violations"), self.violations_agg, group=self.column)
        scan.want((*self.key, "checked"), self.checked_agg, group=self.column)

    def counts(self, found: dict) -> tuple[int, int]:
        return found[(*self.key, "violations")], found[(*self.key, "checked")]


def rows_of(df: DataFrame, records: Iterable[dict[str, str]], schema: str) -> DataFrame:
    """One aggregate over ``df`` turned into one output row per record; lazy.

    Every record maps the column names of ``schema`` (``name:type, …``) to SQL literals or
    aggregates.
    """
    structs = [
        "named_struct(" + ", ".join(f"'{n}', {sql}" for n, sql in r.items()) + ")"
        for r in records
    ]
    if not structs:
        columns = schema.replace(":", " ")
        return df.sparkSession.createDataFrame([], columns)
    measured = f"CAST(array({', '.join(structs)}) AS array<struct<{schema}>>) AS r"
    return df.selectExpr("count(1) AS n", measured).selectExpr("inline(r)")


def count_checks(df: DataFrame, checks: Iterable[Check]) -> DataFrame:
    """(column, name, severity, violations, checked) per check, from one scan; lazy."""
    return rows_of(
        df,
        [
            {
                "column": sql_text(c.column),
                "name": sql_text(c.name),
                "severity": sql_text(c.severity),
                "violations": c.violations_agg,
                "checked": c.checked_agg,
            }
            for c in checks
        ],
        "column:string, name:string, severity:string, violations:bigint, checked:bigint",
    )
