"""Named services: DataFrames, databases by JDBC, REST by a Python data source."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from urllib.parse import urljoin

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

from ..errors import EXECUTION, INPUT, EngineError
from ..lineage import Mentioned, lineage, mentioned
from ..operators import etl
from ..operators.access import Rules, at_places, check_statement, restrict, visible

from . import jdbc

_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_-]*$")
_TABLE = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$")


class Services:
    """A registry from names to what reads their tables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.readers: dict[str, Callable[[str | None], DataFrame]] = {}
        self.writers: dict[str, Callable[[DataFrame, str, str], None]] = {}
        self.rules: dict[str, Rules] = {}
        self.listed: dict[str, dict[str, DataFrame]] = {}
        self.databases: dict[str, tuple[str, dict[str, str]]] = {}

    def register(self, name: str, reader: Callable[[str | None], DataFrame]) -> None:
        """reader: from a table's name (or null) to a DataFrame."""
        if not _NAME.match(name):
            raise EngineError(INPUT, f"{name!r} is no service name")
        self.readers[name] = reader

    def register_tables(self, name: str, tables: dict[str, DataFrame]) -> None:
        self.listed[name] = tables
        self.writers[name] = lambda df, table, mode: tables.__setitem__(table, df if mode == "overwrite" or table not in tables else tables[table].unionByName(df, allowMissingColumns=True))
        self.register(name, lambda table: tables[table] if table in tables else _missing(name, table))

    def register_jdbc(self, name: str, url: str, **options: str) -> None:
        """Tables of a database; filters and columns are pushed down. Options such as partitionColumn deal out the read."""
        self.register(name, lambda table: self.spark.read.format("jdbc").options(url=url, dbtable=table, **options).load())
        self.databases[name] = (url, options)
        self.writers[name] = lambda df, table, mode: df.write.format("jdbc").options(url=url, dbtable=table, truncate="true", **options).mode(mode).save()
        self.readers[f"{name}?"] = lambda query: self.spark.read.format("jdbc").options(url=url, query=query, **options).load()

    def register_rest(
        self, name: str, url: str, schema: str, data_path: str = "", method: str = "GET", headers: dict[str, str] | None = None, body: str = "", retries: int = 2, pages: int = 1, page_param: str = "page", next_path: str = "",
    ) -> None:
        """JSON objects of an answer, at the root or at a dotted path; ``pages`` numbered pages are read side by side, and where
        each answer names the next page's address (at ``next_path``), pages are read one after the other however many there are.

        headers carry what the service asks for (Authorization: Bearer …); an answer of 429 or 5xx and a lost
        connection are tried again, after Retry-After if the service says so. A GraphQL service is a POST whose body holds the query and whose path starts at data.
        """
        self.spark.dataSource.register(RestSource)
        fixed = {"data_path": data_path, "method": method, "headers": json.dumps(headers or {}), "body": body, "retries": str(retries), "next_path": next_path}

        def at(table: str | None) -> str:
            whole = url + (f"/{table}" if table else "")
            return whole if pages <= 1 else ",".join(f"{whole}{'&' if '?' in whole else '?'}{page_param}={k + 1}" for k in range(pages))

        self.register(name, lambda table: self.spark.read.format("weftline_rest").schema(schema).options(url=at(table), **fixed).load())

    def read(self, text: str) -> DataFrame:
        """service or service.table, as far as rules allow."""
        name, _, table = text.partition(".")
        df = self.whole(text)
        return restrict(df, table, self.rules[name]) if name in self.rules else df

    def whole(self, text: str) -> DataFrame:
        """service or service.table, for what checks the rules itself."""
        name, _, table = text.partition(".")
        if name not in self.readers:
            raise EngineError(INPUT, f"no service {name!r}")
        if table and not _TABLE.match(table):
            raise EngineError(INPUT, f"{table!r} is no table name")
        return self.readers[name](table or None)

    def protect(self, name: str, rules: Rules) -> None:
        """From now on a service is read, written, queried and changed as the rules allow."""
        self.rules[name] = rules

    def write(self, df: DataFrame, text: str, mode: str = "append") -> None:
        """Write to service.table: append makes the table where it is missing, overwrite truncates it."""
        name, _, table = text.partition(".")
        if name not in self.writers:
            raise EngineError(INPUT, f"service {name!r} takes no rows")
        if not _TABLE.match(table):
            raise EngineError(INPUT, f"{table!r} is no table name")
        if name in self.rules:
            self.rules[name].check_write(table, df.columns)
        self.writers[name](df, table, mode)

    def execute(self, name: str, *statements: str) -> int:
        """Run statements in a database, in one transaction; the rows that they change.

        Under rules each must be one that Spark's parser reads, so that its tables and columns can be told.
        """
        if name not in self.databases:
            raise EngineError(INPUT, f"service {name!r} is no database")
        if name in self.rules:
            for x in statements:
                check_statement(self._mentioned(x), self.rules[name])
        return sum(self._execute(name, *statements))

    def _mentioned(self, text: str) -> Mentioned:
        try:
            return mentioned(self._reading(), text)
        except ParseException as e:
            raise EngineError(INPUT, "under access rules only statements that Spark's parser reads are taken") from e

    def _reading(self) -> SparkSession:
        """A session of its own for the analysis of a database's text: its names in double quotes, its views apart from the user's."""
        s = self.spark.newSession()
        for k in ("spark.sql.ansi.enabled", "spark.sql.ansi.doubleQuotedIdentifiers"):
            s.conf.set(k, "true")
        return s

    def _execute(self, name: str, *statements: str) -> list[int]:
        """The rows that each statement changes, in one transaction."""
        with self._connection(name) as link:
            link.setAutoCommit(False)
            try:
                changed = [link.createStatement().executeUpdate(x) for x in statements]
                link.commit()
            except BaseException:
                link.rollback()
                raise
        return changed

    @contextmanager
    def _connection(self, name: str):
        if name not in self.databases:
            raise EngineError(INPUT, f"service {name!r} is no database")
        url, options = self.databases[name]
        if "driver" in options:
            self.spark._jvm.java.lang.Class.forName(options["driver"])
        link = self.spark._jvm.java.sql.DriverManager.getConnection(url, *(options[k] for k in ("user", "password") if k in options))
        try:
            yield link
        finally:
            link.close()

    def _columns(self, name: str, table: str | None = None) -> list[tuple[str, str, str]]:
        """(table, column, type) as the database's catalogue lists them, system tables left out."""
        out, like = [], None
        with self._connection(name) as link:
            about = link.getMetaData()
            if table:
                like = table.rsplit(".", 1)[-1]
                like = like.upper() if about.storesUpperCaseIdentifiers() else like.lower() if about.storesLowerCaseIdentifiers() else like
            found = about.getColumns(link.getCatalog(), None, like, None)
            while found.next():
                schema = (found.getString("TABLE_SCHEM") or "").lower()
                if schema not in ("sys", "information_schema", "pg_catalog", "sysibm"):
                    out.append((found.getString("TABLE_NAME"), found.getString("COLUMN_NAME"), found.getString("TYPE_NAME")))
        return out

    def _staged(self, df: DataFrame, text: str, key: str, statements: Callable[[jdbc.Dialect, str, str], list[str]]) -> int:
        """Write df to a table of its own, run statements over both tables in one transaction, drop it again; the rows that the last one changes."""
        name, _, table = text.partition(".")
        if name not in self.databases:
            raise EngineError(INPUT, f"service {name!r} is no database")
        if not _TABLE.match(table):
            raise EngineError(INPUT, f"{table!r} is no table name")
        if name in self.rules:
            self.rules[name].check_write(table, df.columns)
        staged = f"staged_{uuid.uuid4().hex[:12]}"
        try:
            d = jdbc.dialect(self.databases[name][0])
            self._execute(name, d.like(staged, table, df.columns))  # of the table's own types
            self.writers[name](df.filter(F.col(key).isNotNull()), staged, "append")
            return self._execute(name, *statements(d, table, staged))[-1]
        finally:
            self._drop(name, staged)

    def _drop(self, name: str, table: str) -> None:
        """Drop a staged table if it came to be."""
        if table.lower() in (t.lower() for t, _, _ in self._columns(name, table)):
            self._execute(name, f"DROP TABLE {table}")

    def merge(self, df: DataFrame, text: str, key: str) -> int:
        """Rows replaced or added by key in service.table, by the upsert of the database's dialect; the rows that it changes. Of rows of one key the greatest counts, a null key none.

        Where the dialect's upsert goes by a unique index (PostgreSQL, SQLite, MySQL), the table needs one on the key.
        """
        rest = [c for c in df.columns if c != key]
        return self._staged(etl.greatest_by_key(df, key), text, key, lambda d, table, staged: [d.upsert(table, staged, key, rest)])

    def delete(self, keys: DataFrame, text: str, key: str) -> int:
        """Delete the rows of service.table whose key is among the keys; how many they are."""
        return self._staged(keys.select(key).distinct(), text, key, lambda d, table, staged: [f"DELETE FROM {table} WHERE {d.quote(key)} IN (SELECT {d.quote(key)} FROM {staged})"])

    def merge_once(self, df: DataFrame, text: str, key: str, stream: str, batch: int, ledger: str = "weftline_batches") -> bool:
        """``merge`` for the batch of a stream, which has an effect only once however often it is run; whether it had one now.

        The batch's number and its rows are committed in one transaction. A batch that runs again, after a failure at any
        point, finds its number in the ledger (a table of stream and batch, made where it is missing) and changes nothing.
        """
        name = text.partition(".")[0]
        if name not in self.databases:
            raise EngineError(INPUT, f"service {name!r} is no database")
        if name in self.rules:
            self.rules[name].check_write(text.partition(".")[2], df.columns)
        d = jdbc.dialect(self.databases[name][0])
        if not self._columns(name, ledger):
            self._execute(name, f"CREATE TABLE {ledger} (stream VARCHAR(200) NOT NULL, batch BIGINT NOT NULL, PRIMARY KEY (stream, batch))")
        known = f"SELECT count(*) AS n FROM {ledger} WHERE stream = {d.literal(stream)} AND batch = {int(batch)}"
        if self.readers[f"{name}?"](known).first()[0]:
            return False
        rest = [c for c in df.columns if c != key]
        note = f"INSERT INTO {ledger} (stream, batch) VALUES ({d.literal(stream)}, {int(batch)})"  # of two that run at once the second fails here, whole
        self._staged(etl.greatest_by_key(df, key), text, key, lambda d, table, staged: [note, d.upsert(table, staged, key, rest)])
        return True

    def read_in_parts(self, text: str, key: str, parts: int) -> DataFrame:
        """service.table by disjoint ranges of a key with about equally many rows each, a task a range, however skewed its values are; nulls are in the first."""
        name, _, table = text.partition(".")
        if name not in self.databases:
            raise EngineError(INPUT, f"service {name!r} is no database")
        if not _TABLE.match(table):
            raise EngineError(INPUT, f"{table!r} is no table name")
        url, options = self.databases[name]
        d, ask = jdbc.dialect(url), self.readers[f"{name}?"]
        column = d.quote(key)
        n = ask(f"SELECT count({column}) AS n FROM {table}").first()[0]
        bounds: list = []
        for k in range(1, parts if n else 1):  # one row each, by the key's index where there is one
            value = ask(d.nth(table, column, n * k // parts)).first()[0]
            if not bounds or value != bounds[-1]:
                bounds.append(value)
        df = self.spark.read.jdbc(url, table, predicates=d.ranges(column, bounds), properties=dict(options))
        return restrict(df, table, self.rules[name]) if name in self.rules else df

    def create_key_value(self, text: str, extra: dict[str, str], key: str = "key", value: str = "value") -> None:
        """A table for rows of ``etl.key_value``: the extra columns (name to SQL type), key, value, value_type."""
        name, _, table = text.partition(".")
        if not _TABLE.match(table):
            raise EngineError(INPUT, f"{table!r} is no table name")
        columns = extra | {key: "VARCHAR(255)", value: "VARCHAR(4000)", "value_type": "VARCHAR(32)"}
        if name in self.rules:
            self.rules[name].check_write(table, columns)
        quote = jdbc.dialect(self.databases[name][0]).quote if name in self.databases else str
        self._execute(name, f"CREATE TABLE {table} (" + ", ".join(f"{quote(c)} {kind}" for c, kind in columns.items()) + ")")

    def tables(self, name: str) -> DataFrame:
        """table, column, type of what a service's registered tables or its database hold, as far as its rules allow."""
        if name in self.listed:
            found = [(t, f.name, f.dataType.simpleString()) for t, df in self.listed[name].items() for f in df.schema]
        elif name in self.databases:
            found = self._columns(name)
        else:
            raise EngineError(INPUT, f"service {name!r} lists no tables")
        rules = self.rules.get(name, Rules())
        return self.spark.createDataFrame([x for x in found if rules.table(x[0]) and rules.column(x[0], x[1])], "table string, column string, type string")

    def query(self, name: str, text: str) -> DataFrame:
        """A database's own query; under rules, what of its result may be shown."""
        if f"{name}?" not in self.readers:
            raise EngineError(INPUT, f"service {name!r} takes no queries")
        if name not in self.rules:
            return self.readers[f"{name}?"](text)
        places, width = self._shown(name, text)
        df = self.readers[f"{name}?"](text)
        if len(df.columns) != width:
            raise EngineError(INPUT, "the query's columns can't be told")
        return at_places(df, places)

    def _shown(self, name: str, text: str) -> tuple[list[int], int]:
        """The places of the columns of a database's query that may be shown, and how many it has: Spark analyses the text over the database's tables, and the database runs it."""
        reading, rules = self._reading(), self.rules[name]
        url, options = self.databases[name]
        found = self._mentioned(text)
        tables = {t: t.rsplit(".", 1)[-1].lower() for t, _, _ in found.relations}
        if len(set(tables.values())) < len(tables):
            raise EngineError(INPUT, "under access rules a query's tables must differ in their last names")
        for t, last in tables.items():
            if not rules.table(t):
                raise EngineError(INPUT, f"table {t!r} may not be read")
            reading.read.format("jdbc").options(url=url, dbtable=t, **options).load().createOrReplaceTempView(last)
        for t, first, last in sorted(found.relations, key=lambda r: -r[1]):
            text = f"{text[:first]}`{tables[t]}`{text[last + 1 :]}"
        try:
            df = reading.sql(text)
        except (AnalysisException, ParseException) as e:
            raise EngineError(INPUT, "under access rules only queries that Spark can analyse are taken") from e
        names = {last: t for t, last in tables.items()}
        return visible(lineage(df, lambda view: view.lower() if view.lower() in names else None), lambda label: (names[label], rules)), len(df.columns)


def _missing(name: str, table: str | None) -> DataFrame:
    raise EngineError(INPUT, f"service {name!r} has no table {table!r}")


class RestSource(DataSource):
    """Rows of JSON objects of one or several comma-separated addresses, a partition each.

    As a stream each address is a queue: it takes the number of rows seen so far as the parameter ``offset_param``
    (offset) and answers with those after it. With ``latest_path``, the answer's number of rows there are in all (asked for with
    ``limit_param`` 0), the driver reads nothing but these numbers: executors fetch the rows of a batch, at most ``task_rows`` (10000) a task, and the
    same ones again if the batch runs again. ``commit_url`` (with {queue} and {offset}) is called when a batch is done. Without
    ``latest_path`` the driver itself polls one address, which is for small services.
    """

    @classmethod
    def name(cls) -> str:
        return "weftline_rest"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema):
        return _RestReader(self.options, schema)

    def streamReader(self, schema):
        if "latest_path" not in self.options:
            return super().streamReader(schema)  # which tells Spark to take the simple one
        return _RestQueues(self.options, schema)

    def simpleStreamReader(self, schema):
        return _RestPoll(self.options, schema)


class _Address(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)


class _RestReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.urls, self.data_path, self.fields = options["url"].split(","), options.get("data_path", ""), [f.name for f in schema.fields]
        self.method, self.headers, self.body = options.get("method", "GET"), json.loads(options.get("headers", "{}")), options.get("body", "")
        self.retries, self.next_path = int(options.get("retries", "2")), options.get("next_path", "")

    def partitions(self):
        return [_Address(u) for u in self.urls]

    def read(self, partition):
        url, seen = partition.value, set()
        while url and url not in seen:  # a service whose pages go round is read once round
            seen.add(url)
            data = self._answer(url)
            for row in self._rows(data):
                yield tuple(row.get(f) for f in self.fields)
            url = self._next(url, data) if self.next_path else None

    def _next(self, url: str, data) -> str | None:
        """The address of the next page, relative ones from this one's; None at the end."""
        for key in self.next_path.split("."):
            data = data.get(key) if isinstance(data, dict) else None
        return urljoin(url, str(data)) if data else None

    def _answer(self, url: str):
        kind = {"Content-Type": "application/json"} if self.body else {}
        request = urllib.request.Request(url, self.body.encode() or None, kind | self.headers, method=self.method)
        for turn in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=30) as r:
                    return json.load(r)
            except urllib.error.URLError as e:
                wait = e.headers.get("Retry-After", "") if isinstance(e, urllib.error.HTTPError) else ""
                passing = not isinstance(e, urllib.error.HTTPError) or e.code == 429 or e.code >= 500
                if not passing or turn == self.retries:
                    raise
            time.sleep(min(float(wait), 300) if wait.isdigit() else 0.2 * 2**turn)

    def _rows(self, data) -> list[dict]:
        for key in filter(None, self.data_path.split(".")):
            data = data[int(key)] if isinstance(data, list) else data[key]
        return data if isinstance(data, list) else [data]


class _RestPoll(SimpleDataSourceStreamReader):
    def __init__(self, options: dict, schema):
        self.source, self.url, self.param = _RestReader(options, schema), options["url"], options.get("offset_param", "offset")

    def initialOffset(self) -> dict:
        return {"seen": 0}

    def _after(self, seen: int) -> list[tuple]:
        rows = self.source._rows(self.source._answer(f"{self.url}{'&' if '?' in self.url else '?'}{self.param}={seen}"))
        return [tuple(row.get(f) for f in self.source.fields) for row in rows]

    def read(self, start: dict):
        rows = self._after(start["seen"])
        return iter(rows), {"seen": start["seen"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict):
        """The rows of a batch that runs again."""
        return iter(self._after(start["seen"])[: end["seen"] - start["seen"]])


class _Range(InputPartition):
    def __init__(self, url: str, start: int, end: int):
        super().__init__((url, start, end))


class _RestQueues(DataSourceStreamReader):
    """Queues side by side: offsets by queue, ranges of rows as partitions."""

    def __init__(self, options: dict, schema):
        self.source = _RestReader(options, schema)
        self.param, self.limit = options.get("offset_param", "offset"), options.get("limit_param", "limit")
        self.latest_path, self.task_rows, self.commit_url = options["latest_path"], int(options.get("task_rows", "10000")), options.get("commit_url")

    def _at(self, url: str, offset: int, limit: int):
        return self.source._answer(f"{url}{'&' if '?' in url else '?'}{self.param}={offset}&{self.limit}={limit}")

    def initialOffset(self) -> dict:
        return {str(k): 0 for k in range(len(self.source.urls))}

    def latestOffset(self) -> dict:
        out = {}
        for k, url in enumerate(self.source.urls):
            data = self._at(url, 0, 0)
            for key in self.latest_path.split("."):
                data = data[key]
            out[str(k)] = int(data)
        return out

    def partitions(self, start: dict, end: dict):
        return [
            _Range(url, at, min(at + self.task_rows, end[str(k)])) for k, url in enumerate(self.source.urls) for at in range(start.get(str(k), 0), end[str(k)], self.task_rows)
        ]

    def read(self, partition):
        url, at, end = partition.value
        while at < end:
            rows = self.source._rows(self._at(url, at, end - at))[: end - at]
            if not rows:
                raise EngineError(EXECUTION, f"{url} no longer has its rows from {at} on")
            for row in rows:
                yield tuple(row.get(f) for f in self.source.fields)
            at += len(rows)

    def commit(self, end: dict) -> None:
        if self.commit_url:
            for k in end:
                self.source._answer(self.commit_url.replace("{queue}", k).replace("{offset}", str(end[k])))
