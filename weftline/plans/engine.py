"""Queries over function-style sources with limits, and their errors.

The text is Spark SQL, in which the dialect's own spellings (``functions.dialect``) are
replaced: Catalyst parses and plans it. ``read_file('path')``,
``read_service('name.table')`` and sources registered under other names
(``read_x('…')``) in it stand for views that are made for them, and a first
comment ``-- integration: name`` sends the rest to that database. Within a query
a division by 0 or a cast that can't be done gives null.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

from ..errors import CANCELED, EXECUTION, INPUT, PARSE, TIMEOUT, EngineError
from ..functions import dialect
from ..functions.registry import FunctionRegistry
from ..operators.access import Rules, at_places, visible
from ..sources.files import read_file
from ..sources.services import Services
from ..lineage import lineage

#: A source in a text whose quoted parts are marks.
_SOURCE = re.compile(r"\bread_(\w+)\s*\(\s*\x02(\d+)\x03\s*\)")
_DIRECTIVE = re.compile(r"^\s*--\s*integration\s*:\s*([\w-]+)\s*(?:\n|\\n)", re.I)

#: The dialect's functions that Spark lacks or means otherwise, as SQL functions: name, parameters, type, body.
EXPRESSIONS = (
    ("CONTAINS_ALL", "a ARRAY<STRING>, b ARRAY<STRING>", "BOOLEAN", "coalesce(size(b) > 0 AND forall(b, x -> array_contains(a, x)), false)"),
    ("OVERLAPS_ANY", "a ARRAY<STRING>, b ARRAY<STRING>", "BOOLEAN", "coalesce(arrays_overlap(a, b), false)"),
    ("TO_NUM", "s STRING", "DOUBLE", "try_cast(s AS DOUBLE)"),
    ("COALESCE_TEXT", "a STRING, b STRING", "STRING", "coalesce(nullif(a, ''), nullif(b, ''))"),
    ("SUBSTR_TEXT", "s STRING, n INT, k INT", "STRING", "CASE WHEN n < 1 THEN '' ELSE substr(s, n, k) END"),
)


@dataclass(frozen=True)
class Limits:
    """Seconds a result may take and rows it may have; null for no limit."""

    timeout_s: float | None = 30.0
    max_rows: int | None = 10_000


class Rows(list):
    """Rows of a result; ``truncated`` tells that it has more than the limit."""

    truncated = False


class Engine:
    """One session's sources, functions and limits."""

    def __init__(self, spark: SparkSession, limits: Limits = Limits()):
        self.spark, self.limits = spark, limits
        self.services, self.functions = Services(spark), FunctionRegistry(spark)
        self.tables: Rules | None = None
        self.sources: dict[str, Callable[[str], DataFrame]] = {"file": lambda at: read_file(spark, at), "service": self.services.read}
        for name, parameters, kind, body in EXPRESSIONS:
            self.functions.register_expression(name, parameters, kind, body, override=True)

    def register_source(self, name: str, reader: Callable[[str], DataFrame]) -> None:
        """``read_<name>('text')`` in a query reads reader(text)."""
        if not name.isidentifier():
            raise EngineError(INPUT, f"{name!r} is no source name")
        self.sources[name.lower()] = reader

    @contextmanager
    def using(self, **changes):
        """Other limits for a while."""
        before, self.limits = self.limits, replace(self.limits, **changes)
        try:
            yield self
        finally:
            self.limits = before

    def protect_tables(self, rules: Rules) -> None:
        """Rules for the tables and views of the session's catalog that queries name."""
        self.tables = rules

    def query(self, text: str, args: dict | list | None = None) -> DataFrame:
        """The DataFrame of a query; parameters (:name or ?) are bound, not pasted.

        Where access rules hold, they are checked on the analysed plan: columns of the result that are made of a
        column that may not be read are left out (it may decide on rows), a table that may not be read is an error.
        """
        if m := _DIRECTIVE.match(text):
            return self.services.query(m[1], text[m.end() :].strip())
        before = self.spark.conf.get("spark.sql.ansi.enabled")
        views: dict[str, tuple[str, str]] = {}
        try:
            self.spark.conf.set("spark.sql.ansi.enabled", "false")  # as the query is analysed
            plain, parts = dialect.masked(text)
            plain = dialect.unmasked(_SOURCE.sub(lambda x: self._view(x, parts, views), plain), parts)
            return self._guarded(self.spark.sql(self._typed(plain, args), args=args), views)
        except ParseException as e:
            raise EngineError(PARSE, str(e)) from e
        except AnalysisException as e:
            raise EngineError(INPUT, str(e)) from e
        finally:
            self.spark.conf.set("spark.sql.ansi.enabled", before)
            for view in views:  # the plan is analysed and needs them no more
                self.spark.catalog.dropTempView(view)

    def _typed(self, text: str, args: dict | list | None) -> str:
        """The text as Spark SQL. Where calls go by the types of their arguments, a first analysis tells these; what it can't analyse is left to the second to report."""
        asked = dialect.Types(asking=True)
        asking = dialect.spark_sql(text, asked)
        if not asked.met:
            return asking
        try:
            known = dialect.told(self.spark.sql(asking, args=args)._jdf.queryExecution().analyzed())
        except (AnalysisException, ParseException):
            known = {}
        return dialect.spark_sql(text, dialect.Types(known=known))

    def _guarded(self, df: DataFrame, views: dict[str, tuple[str, str]]) -> DataFrame:
        """The columns that may be shown, if any rules hold for what is read."""
        ruled = {v: (table, self.services.rules[kind]) for v, (kind, table) in views.items() if kind in self.services.rules}
        if not ruled and not self.tables:
            return df

        def known(name: str) -> str | None:
            last = name.lower().rsplit(".", 1)[-1]
            return last if last in ruled else None if last in views or not self.tables else name.lower().removeprefix("spark_catalog.")

        return at_places(df, visible(lineage(df, known), lambda label: ruled.get(label) or (label, self.tables)))

    def _view(self, m: re.Match, parts: list[str], views: dict[str, tuple[str, str]]) -> str:
        """A view for a source, under a name of its own."""
        kind, at = m[1].lower(), parts[int(m[2])][1:-1]
        if kind not in self.sources:
            raise EngineError(INPUT, f"no source read_{m[1]}")
        name = f"_source_{uuid.uuid4().hex}"
        service, _, table = at.partition(".")
        df = self.services.whole(at) if kind == "service" else self.sources[kind](at)
        df.createOrReplaceTempView(name)
        views[name] = (service, table) if kind == "service" else ("", "")
        return name

    def iterate(self, query: str | DataFrame, args: dict | list | None = None) -> Iterator[Row]:
        """All rows of a result, a partition at a time; for results beyond the limit."""
        return (self.query(query, args) if isinstance(query, str) else query).toLocalIterator()

    def rows(self, query: str | DataFrame, args: dict | list | None = None) -> Rows:
        """The rows of a result within the limits: a longer one is cut and marked ``truncated``, a slower one is cancelled."""
        df = self.query(query, args) if isinstance(query, str) else query
        most = self.limits.max_rows
        df = df.limit(most + 1) if most else df
        group, late, sc = f"weftline-{uuid.uuid4().hex}", threading.Event(), self.spark.sparkContext
        timer = threading.Timer(self.limits.timeout_s, lambda: (late.set(), sc.cancelJobGroup(group))) if self.limits.timeout_s else None
        outer = {k: sc.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
        sc.setJobGroup(group, "a query with a time limit", interruptOnCancel=True)
        try:
            if timer:
                timer.start()
            out = Rows(df.collect())
            out.truncated = bool(most) and len(out) > most
            del out[most or len(out) :]
            return out
        except PySparkException as e:
            raise self._failed(e, late) from e
        except Exception as e:
            if "cancel" in str(e).lower() or late.is_set():
                raise self._failed(e, late) from e
            raise EngineError(EXECUTION, str(e)) from e
        finally:
            for k, v in outer.items():
                sc.setLocalProperty(k, v)
            if timer:
                timer.cancel()

    @staticmethod
    def _failed(e: Exception, late: threading.Event) -> EngineError:
        if late.is_set():
            return EngineError(TIMEOUT, "the time limit passed")
        return EngineError(CANCELED if "cancel" in str(e).lower() else EXECUTION, str(e))
