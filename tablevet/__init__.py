"""Data-quality scoring of Spark tables."""

from tablevet.operators.roles import ColumnRoles, NameLists, Pair, detect_roles
from tablevet.operators.rules import Rule, add_rule, build_rule, remove_rule
from tablevet.operators.suggest import Suggestion, suggest_rules
from tablevet.plans.score import ScoreResult, score
from tablevet.sources.files import read_csv, read_source
from tablevet.sources.reports import write_report
from tablevet.sources.scratch import staged
from tablevet.sources.tables import list_tables, preview, read_table

__all__ = [
    "ColumnRoles",
    "NameLists",
    "Pair",
    "Rule",
    "ScoreResult",
    "Suggestion",
    "add_rule",
    "build_rule",
    "detect_roles",
    "list_tables",
    "preview",
    "read_csv",
    "read_source",
    "read_table",
    "remove_rule",
    "score",
    "staged",
    "suggest_rules",
    "write_report",
]
