"""What differs between databases: quotes, upserts, the n-th value of a key."""

from __future__ import annotations

import datetime
from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    """upsert_by: conflict (PostgreSQL, SQLite), duplicate (MySQL, MariaDB) or merge; limit: LIMIT … OFFSET, else OFFSET … FETCH."""

    sign: str = '"'
    upsert_by: str = "merge"
    limit: bool = False

    def quote(self, name: str) -> str:
        return self.sign + name.replace(self.sign, self.sign * 2) + self.sign

    def literal(self, value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return "TRUE" if value else "FALSE"
        if isinstance(value, datetime.datetime):
            return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'" if self.limit else f"{{ts '{value:%Y-%m-%d %H:%M:%S.%f}'}}"
        if isinstance(value, datetime.date):
            return f"DATE '{value:%Y-%m-%d}'" if self.limit else f"{{d '{value:%Y-%m-%d}'}}"
        if isinstance(value, str):
            text = value.replace("\\", "\\\\") if self.sign == "`" else value
            return "'" + text.replace("'", "''") + "'"
        return str(value)

    def like(self, staged: str, table: str, columns: list[str]) -> str:
        """An empty table with some of another's columns."""
        chosen = f"SELECT {', '.join(map(self.quote, columns))} FROM {table}"
        return f"CREATE TABLE {staged} AS {chosen} WHERE 1 = 0" if self.limit else f"CREATE TABLE {staged} AS {chosen} WITH NO DATA"

    def upsert(self, table: str, staged: str, key: str, rest: list[str]) -> str:
        """Rows of a staged table, one a key, replaced or added in a table."""
        q = self.quote
        every = [key, *rest]
        names, own = ", ".join(map(q, every)), ", ".join(f"s.{q(c)}" for c in every)
        if self.upsert_by == "conflict":
            then = f"DO UPDATE SET {', '.join(f'{q(c)} = EXCLUDED.{q(c)}' for c in rest)}" if rest else "DO NOTHING"
            return f"INSERT INTO {table} ({names}) SELECT {own} FROM {staged} s WHERE true ON CONFLICT ({q(key)}) {then}"
        if self.upsert_by == "duplicate":
            then = ", ".join(f"{q(c)} = VALUES({q(c)})" for c in rest or [key])
            return f"INSERT INTO {table} ({names}) SELECT {own} FROM {staged} s ON DUPLICATE KEY UPDATE {then}"
        update = f"WHEN MATCHED THEN UPDATE SET {', '.join(f'{q(c)} = s.{q(c)}' for c in rest)} " if rest else ""
        return f"MERGE INTO {table} t USING {staged} s ON t.{q(key)} = s.{q(key)} {update}WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({own})"

    def nth(self, table: str, column: str, n: int) -> str:
        """The n-th value (from 0) of a column that is not null."""
        end = f"LIMIT 1 OFFSET {n}" if self.limit else f"OFFSET {n} ROWS FETCH NEXT 1 ROWS ONLY"
        return f"SELECT {column} FROM {table} WHERE {column} IS NOT NULL ORDER BY {column} {end}"

    def ranges(self, column: str, bounds: list) -> list[str]:
        """Disjoint conditions that together hold for every row, nulls in the first."""
        if not bounds:
            return ["1 = 1"]
        b = [self.literal(x) for x in bounds]
        inner = [f"{column} >= {x} AND {column} < {y}" for x, y in zip(b, b[1:])]
        return [f"{column} < {b[0]} OR {column} IS NULL", *inner, f"{column} >= {b[-1]}"]


def dialect(url: str) -> Dialect:
    """The dialect of a JDBC address."""
    kind = url.split(":")[1].lower() if url.count(":") > 1 else ""
    if kind in ("mysql", "mariadb"):
        return Dialect("`", "duplicate", True)
    if kind in ("postgresql", "sqlite"):
        return Dialect('"', "conflict", True)
    return Dialect()
