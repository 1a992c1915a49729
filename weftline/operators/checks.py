"""Data-quality rules, validation, error rates, schema detection and drift."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import INPUT, EngineError

#: Fixed value: the e-mail rule's pattern.
EMAIL = r"^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,4}$"


@dataclass(frozen=True)
class Rule:
    """kind: not_null, unique, range (low, high), regex (pattern), email."""

    field: str
    kind: str
    low: float | None = None
    high: float | None = None
    pattern: str | None = None


def passes(rule: Rule) -> Column:
    """Whether a row passes; never null."""
    c = F.col(rule.field)
    if rule.kind == "not_null":
        good = c.isNotNull() & (c.cast("string") != "")
    elif rule.kind == "unique":
        good = F.count(F.lit(1)).over(Window.partitionBy(rule.field)) == 1
    elif rule.kind == "range":
        good = c.try_cast("double").between(rule.low, rule.high)
    elif rule.kind == "regex":
        good = c.cast("string").rlike(rule.pattern)
    elif rule.kind == "email":
        good = c.cast("string").rlike(EMAIL)
    else:
        raise EngineError(INPUT, f"no rule {rule.kind!r}")
    return F.coalesce(good, F.lit(False))


def validate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with errors: the "field: kind" of every rule that a row fails.

    Unique values are counted first (in part on each side of the shuffle) and only those that repeat are joined
    back, so that a value of very many rows is no single task's window.
    """
    columns, failed = df.columns, []
    for k, r in enumerate(rules):
        bad = F.lit(f"{r.field}: {r.kind}")
        if r.kind == "unique":
            again = df.groupBy(F.col(r.field).alias(f"_value{k}")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(f"_value{k}", F.lit(True).alias(f"_again{k}"))
            df = df.join(again, F.col(r.field).eqNullSafe(F.col(f"_value{k}")), "left")
            failed.append(F.when(F.col(f"_again{k}"), bad))
        else:
            failed.append(F.when(~passes(r), bad))
    return df.select(*(f"`{c}`" for c in columns), F.array_compact(F.array(*failed)).alias("errors"))


def split_valid(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(rows without errors, rows with their errors)."""
    v = validate(df, rules)
    return v.filter(F.size("errors") == 0).drop("errors"), v.filter(F.size("errors") > 0)


def error_rate(validated: DataFrame, threshold: float, least: int) -> DataFrame:
    """total, failed, rate in percent, and whether it trips a breaker: at least ``least`` rows and a rate above the threshold."""
    counts = validated.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("errors") > 0).alias("failed"))
    rate = F.coalesce(F.try_divide(F.col("failed") * 100.0, F.col("total")), F.lit(0.0))
    return counts.withColumn("rate", rate).withColumn("tripped", (F.col("total") >= least) & (F.col("rate") > threshold))


#: Detected kinds in the order in which they are tried, and their patterns.
KINDS = (
    ("bool", r"(?i)^(true|false|yes|no|0|1)$"), ("uuid", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), ("int", r"^[+-]?\d+$"),
    ("float", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), ("date", r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?.*)?$"), ("json", r"^\s*[\[{][\s\S]*[\]}]\s*$"),
    ("email", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), ("url", r"^https?://\S+$"),
)
#: Column types by database.
DDL_TYPES = {
    "mysql": {"bool": "BOOLEAN", "uuid": "CHAR(36)", "int": "BIGINT", "float": "DOUBLE", "date": "DATETIME", "json": "JSON"},
    "postgres": {"bool": "BOOLEAN", "uuid": "UUID", "int": "BIGINT", "float": "DOUBLE PRECISION", "date": "TIMESTAMP", "json": "JSONB"},
    "sqlite": {"bool": "INTEGER", "uuid": "TEXT", "int": "INTEGER", "float": "REAL", "date": "TEXT", "json": "TEXT"},
}


def detect_kinds(df: DataFrame) -> DataFrame:
    """column_name, kind, nullable, max_length of every column's text, in one pass over all rows."""
    parts = []
    for c in df.columns:
        t = F.col(f"`{c}`").cast("string")
        filled = F.when(t != "", t)
        every = [F.every(F.coalesce(filled.rlike(p), F.lit(True))) for _, p in KINDS]
        found = F.coalesce(*(F.when(e & (F.count(filled) > 0), F.lit(k)) for e, (k, _) in zip(every, KINDS)), F.lit("string"))
        parts.append(F.struct(F.lit(c).alias("column_name"), found.alias("kind"), (F.count(filled) < F.count(F.lit(1))).alias("nullable"), F.max(F.length(t)).alias("max_length")))
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def create_table(name: str, kinds: DataFrame, driver: str) -> str:
    """A CREATE TABLE statement from detected kinds; a column id is the key."""
    types = DDL_TYPES[driver]
    lines = []
    for r in kinds.collect():
        column = "".join(ch if ch.isalnum() else "_" for ch in r.column_name.lower()).strip("_")
        kind = types.get(r.kind, "TEXT")
        lines.append(f"  {column} {kind}{' PRIMARY KEY' if column == 'id' else '' if r.nullable else ' NOT NULL'}")
    return f"CREATE TABLE {name} (\n" + ",\n".join(lines) + "\n)"


def schema_hash(df: DataFrame) -> str:
    """SHA-256 over the sorted name:type; pairs of a schema."""
    return hashlib.sha256("".join(sorted(f"{f.name}:{f.dataType.simpleString()};" for f in df.schema)).encode()).hexdigest()


class SchemaRegistry:
    """Versions of named schemas; registering a changed one is a new version. With a folder they are kept there, as JSON lines that Spark writes."""

    def __init__(self, spark: SparkSession | None = None, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder
        self.versions: dict[str, list[str]] = {}
        if folder:
            try:
                rows = spark.read.schema("name string, version int, hash string").json(folder).orderBy("version").collect()  # a row for each version
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                rows = []
            for r in rows:
                self.versions.setdefault(r.name, []).append(r.hash)

    def register(self, name: str, df: DataFrame) -> int:
        known = self.versions.setdefault(name, [])
        if not known or known[-1] != schema_hash(df):
            known.append(schema_hash(df))
            if self.folder:
                self.spark.createDataFrame([(name, len(known), known[-1])], "name string, version int, hash string").coalesce(1).write.mode("append").json(self.folder)
        return len(known)

    def drifted(self, name: str, df: DataFrame) -> bool:
        return bool(self.versions.get(name)) and self.versions[name][-1] != schema_hash(df)


#: Types that hold every value of the types before them in a row; text holds every simple value.
WIDER = (("tinyint", "smallint", "int", "bigint", "decimal(20,0)", "decimal(38,0)"), ("smallint", "float", "double"), ("int", "double"), ("date", "timestamp"))


def widens(old: T.DataType, new: T.DataType) -> bool:
    """Whether every value of a simple type is one of another."""
    a, b = old.simpleString(), new.simpleString()
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
    nested = (T.StructType, T.ArrayType, T.MapType, T.BinaryType, T.VariantType)
    if isinstance(new, T.StringType):
        return not isinstance(old, nested)
    return any(a in row and b in row and row.index(a) < row.index(b) for row in WIDER)


def changes(old: T.StructType, new: T.StructType) -> list[tuple[str, str, str | None, str | None]]:
    """(path, change, old type, new type) by path through structs, array elements ([]) and map values ({}): added, removed, widened, narrowed (a wider type became one of
    those that it holds), retyped, nullable and required."""
    out: list[tuple[str, str, str | None, str | None]] = []

    def of_types(path: str, a: T.DataType, b: T.DataType) -> None:
        if isinstance(a, T.StructType) and isinstance(b, T.StructType):
            of_fields(f"{path}.", a, b)
        elif isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
            of_types(f"{path}[]", a.elementType, b.elementType)
        elif isinstance(a, T.MapType) and isinstance(b, T.MapType):
            if a.keyType != b.keyType:
                out.append((f"{path}{{}}", "retyped", a.keyType.simpleString(), b.keyType.simpleString()))
            of_types(f"{path}{{}}", a.valueType, b.valueType)
        elif a.simpleString() != b.simpleString():
            out.append((path, "widened" if widens(a, b) else "narrowed" if widens(b, a) else "retyped", a.simpleString(), b.simpleString()))

    def of_fields(prefix: str, a: T.StructType, b: T.StructType) -> None:
        was, now = ({f.name: f for f in s} for s in (a, b))
        for n in (*was, *(n for n in now if n not in was)):
            path = prefix + n
            if n not in now:
                out.append((path, "removed", was[n].dataType.simpleString(), None))
            elif n not in was:
                out.append((path, "added", None, now[n].dataType.simpleString()))
            else:
                of_types(path, was[n].dataType, now[n].dataType)
                if was[n].nullable != now[n].nullable:
                    out.append((path, "nullable" if now[n].nullable else "required", *[now[n].dataType.simpleString()] * 2))

    of_fields("", old, new)
    return out


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change, old_type, new_type: how the second's schema differs from the first's."""
    rows = changes(old.schema, new.schema)
    return new.sparkSession.createDataFrame(rows, "path string, change string, old_type string, new_type string")


def joint(a: T.DataType, b: T.DataType, path: str = "") -> T.DataType:
    """The least type that holds the values of both without loss; an error where there is none."""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        now = {f.name: f for f in b}
        fields = [T.StructField(f.name, joint(f.dataType, now[f.name].dataType, f"{path}.{f.name}".strip(".")) if f.name in now else f.dataType) for f in a]
        return T.StructType(fields + [T.StructField(f.name, f.dataType) for f in b if f.name not in a.names])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(joint(a.elementType, b.elementType, f"{path}[]"))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType) and a.keyType == b.keyType:
        return T.MapType(a.keyType, joint(a.valueType, b.valueType, f"{path}{{}}"))
    if a.simpleString() == b.simpleString() or widens(b, a):
        return a
    if widens(a, b):
        return b
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        whole = max(a.precision - a.scale, b.precision - b.scale)
        if scale + whole <= 38:
            return T.DecimalType(scale + whole, scale)
    simple = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, simple) and isinstance(b, simple):
        return T.StringType()
    raise EngineError(INPUT, f"{path}: {a.simpleString()} and {b.simpleString()} have no common type")


def fitted(c: Column, old: T.DataType, new: T.DataType) -> Column:
    """A value as a type of ``joint``; fields that it lacks are null."""
    if old == new:
        return c
    if isinstance(new, T.StructType):
        have = {f.name: f.dataType for f in old}
        made = F.struct(*((fitted(c.getField(f.name), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in new))
        return F.when(c.isNotNull(), made)
    if isinstance(new, T.ArrayType):
        return F.transform(c, lambda x: fitted(x, old.elementType, new.elementType))
    if isinstance(new, T.MapType):
        return F.transform_values(c, lambda k, v: fitted(v, old.valueType, new.valueType))
    return c.cast(new)


def evolved(*frames: DataFrame) -> DataFrame:
    """All rows of frames under one schema that holds them without loss: columns and fields of either (null where they lack), the wider types."""
    kind = frames[0].schema
    for f in frames[1:]:
        kind = joint(kind, f.schema)
    out = None
    for f in frames:
        have = {x.name: x.dataType for x in f.schema}
        row = f.select(*((fitted(F.col(f"`{x.name}`"), have[x.name], x.dataType) if x.name in have else F.lit(None).cast(x.dataType)).alias(x.name) for x in kind))
        out = row if out is None else out.unionByName(row)
    return out
