"""Table and column access rules over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from ..errors import INPUT, EngineError

if TYPE_CHECKING:
    from ..lineage import Lineage, Mentioned


@dataclass(frozen=True)
class Rules:
    """Allowed and denied tables and fields: "field", "table.field", "table.*" or "*". Denial wins; nothing allowed means all is."""

    allow_tables: tuple[str, ...] = ()
    deny_tables: tuple[str, ...] = ()
    allow_fields: tuple[str, ...] = ()
    deny_fields: tuple[str, ...] = ()

    def table(self, name: str) -> bool:
        """Whether a table, by its qualified name or its last part, may be used."""
        forms = _forms(name)
        return not forms & _lower(self.deny_tables) and (not self.allow_tables or bool(forms & _lower(self.allow_tables)))

    def column(self, table: str, name: str) -> bool:
        forms = {name.lower(), "*"} | {f"{t}.{n}" for t in _forms(table) for n in (name.lower(), "*")}
        return not forms & _lower(self.deny_fields) and (not self.allow_fields or bool(forms & _lower(self.allow_fields)))

    @property
    def columns_ruled(self) -> bool:
        return bool(self.allow_fields or self.deny_fields)

    def check_write(self, table: str, columns: Iterable[str]) -> None:
        """An error unless a table and all of the columns may be written."""
        if not self.table(table):
            raise EngineError(INPUT, f"table {table!r} may not be written")
        if lost := sorted(c for c in columns if not self.column(table, c)):
            raise EngineError(INPUT, f"columns {lost} of {table!r} may not be written")


def _lower(names: Iterable[str]) -> set[str]:
    return {n.lower() for n in names}


def _forms(name: str) -> set[str]:
    return {name.lower(), name.lower().rsplit(".", 1)[-1]}


def restrict(df: DataFrame, table: str, rules: Rules) -> DataFrame:
    """The columns of a table that may be read; pruned before the scan. A table that may not be read is an error."""
    if not rules.table(table):
        raise EngineError(INPUT, f"table {table!r} may not be read")
    names = [c for c in df.columns if rules.column(table, c)]
    if not names:
        raise EngineError(INPUT, f"no column of {table!r} may be read")
    return df.select(*(f"`{c}`" for c in names))


def visible(found: Lineage, rules: Callable[[str], tuple[str, Rules]]) -> list[int]:
    """The places of the columns of a result that may be shown: those not made of a column that may not be read.

    rules: from a label of the lineage to the table's name and its rules. A
    column may decide on rows (WHERE, JOIN, ORDER BY) without being shown. A table that may not be read
    is an error, and so is a result of which nothing may be shown.
    """
    for label in found.tables:
        table, rule = rules(label)
        if not rule.table(table):
            raise EngineError(INPUT, f"table {table!r} may not be read")

    def good(base: Iterable[tuple[str, str]]) -> bool:
        return all(rule.column(table, c) for label, c in base for table, rule in [rules(label)])

    out = [i for i, (_, base) in enumerate(found.columns) if good(base)]
    if not out:
        raise EngineError(INPUT, "no column of the result may be read")
    return out


def at_places(df: DataFrame, places: list[int]) -> DataFrame:
    """Columns by position, whatever their names."""
    if len(places) == len(df.columns):
        return df
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names).select(*(names[i] for i in places)).toDF(*(df.columns[i] for i in places))


def check_statement(found: Mentioned, rules: Rules) -> None:
    """An error unless a statement keeps to the rules. A column counts as one of every table that the statement names."""
    tables = [name for name, _, _ in found.relations]
    for t in tables:
        if not rules.table(t):
            raise EngineError(INPUT, f"table {t!r} may not be used")
    if not rules.columns_ruled:
        return
    if found.open:
        raise EngineError(INPUT, "a statement under column rules must name its columns")
    for c in found.columns:
        if any(not Rules(deny_fields=rules.deny_fields).column(t, c) for t in tables) or not any(rules.column(t, c) for t in tables):
            raise EngineError(INPUT, f"column {c!r} may not be used")
