"""Record-level steps of a job: DataFrame to DataFrame, or to (good, rejects).

A reject keeps the row as JSON with the step and the reason, so rejects of all
steps share one schema and can be read back and run again (``retry``).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import INPUT, EngineError
from ..functions.dialect import arguments, masked, unmasked

#: Type names of normalize and Spark's types; a length in brackets is dropped first.
NORMALIZE_TYPES = {
    "int": "bigint", "integer": "bigint", "year": "bigint", "serial": "bigint", "int8": "tinyint", "tinyint": "tinyint", "int16": "smallint", "smallint": "smallint",
    "smallserial": "smallint", "int32": "int", "mediumint": "int", "int64": "bigint", "bigint": "bigint", "bigserial": "bigint", "uint8": "smallint", "byte": "smallint",
    "uint16": "int", "uint32": "bigint", "uint": "decimal(20,0)", "uint64": "decimal(20,0)", "bool": "boolean", "boolean": "boolean", "float": "float", "float32": "float",
    "real": "float", "float64": "double", "double": "double", "double precision": "double", "decimal": "double", "numeric": "double", "string": "string", "text": "string",
    "varchar": "string", "char": "string", "json": "string", "jsonb": "string", "uuid": "string", "enum": "string", "date": "timestamp", "datetime": "timestamp",
    "timestamp": "timestamp", "time": "timestamp", "blob": "binary", "bytea": "binary",
}
#: The layouts that a date is tried by where none is given.
_LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "dd-MM-yyyy")
REJECT = T.StructType([T.StructField("step", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("record", T.StringType())])


def rejects(df: DataFrame, step: str, reason: Column) -> DataFrame:
    """step, reason and the whole row as JSON."""
    return df.select(F.lit(step).alias("step"), reason.cast("string").alias("reason"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))


def retry(dead: DataFrame, schema: T.StructType, step: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Run a step again over rejected rows, read back from their JSON."""
    return step(dead.select(F.from_json("record", schema).alias("r")).select("r.*"))


def normalize_value(c: Column, name: str) -> Column:
    """A value as the named type, null if it can't be."""
    kind = NORMALIZE_TYPES.get(re.sub(r"\s*\(.*\)", "", name.lower()).strip())
    if kind is None:
        raise EngineError(INPUT, f"no type {name!r}")
    if kind == "timestamp":
        return F.coalesce(*(F.try_to_timestamp(c.cast("string"), F.lit(x)) for x in _LAYOUTS))
    return c.cast(kind) if kind in ("string", "binary") else F.trim(c.cast("string")).try_cast(kind)


def normalize(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Named columns as types; a row with a value that can't be is a reject."""
    made = {f: normalize_value(F.col(f), t) for f, t in types.items() if f in df.columns}
    failed = [f for f in made]
    bad = F.array_compact(F.array(*(F.when(F.col(f).isNotNull() & made[f].isNull(), F.lit(f)) for f in failed))) if made else F.array().cast("array<string>")
    marked = df.withColumn("_bad", bad)
    good = marked.filter(F.size("_bad") == 0).withColumns(made).drop("_bad")
    lost = marked.filter(F.size("_bad") > 0)
    return good, rejects(lost, "normalize", F.concat(F.lit("not of its type: "), F.array_join("_bad", ","))).select(*REJECT.names)


def expression(text: str) -> str:
    """A mapping's eval text as Spark SQL: c ? a : b (nested too), ==, &&, ||, now() and double-quoted text; what is quoted stays as it is."""
    t, parts = masked(text.strip())
    parts = ["'" + p[1:-1].replace("'", "''") + "'" if p.startswith('"') else p for p in parts]
    t = t.replace("&&", " AND ").replace("||", " OR ").replace("==", "=").replace("now()", "date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss')")
    return unmasked(_choice(t), parts)


def _choice(t: str) -> str:
    """c ? a : b as CASE, from the outermost question mark in; brackets keep what is in them together."""
    depth, asked, open_ = 0, -1, 0
    for i, ch in enumerate(t):
        depth += (ch in "([{") - (ch in ")]}")
        if depth:
            continue
        if ch == "?":
            if asked < 0:
                asked = i
            open_ += 1
        elif ch == ":" and asked >= 0 and t[i - 1 : i + 1] != "::" and t[i : i + 2] != "::":
            open_ -= 1
            if not open_:
                return f"CASE WHEN {_choice(t[:asked].strip())} THEN {_choice(t[asked + 1 : i].strip())} ELSE {_choice(t[i + 1 :].strip())} END"
    if asked >= 0:
        raise EngineError(INPUT, f"a choice without its second part: {t!r}")
    return re.sub(r"\(([^()]*\?[^()]*)\)", lambda m: f"({_choice(m[1])})", t)


#: What a mapping may take from beside the row: a prefix and the dotted name of a value.
CONTEXTS = ("consts", "body", "param", "query", "enums")


def _from_context(rule: str, constants: dict | None) -> Column | None:
    """The value of consts.x, or of body.x, param.x, query.x, enums.a.x, whose values are constants under the prefix's own name; null for a miss."""
    prefix, _, name = rule.partition(".")
    if prefix not in CONTEXTS or not name:
        return None
    found: object = constants or {}
    for key in name.split(".") if prefix == "consts" else rule.split("."):
        found = found.get(key) if isinstance(found, dict) else None
    return F.lit(found) if not isinstance(found, dict) else F.lit(None)


def mapped_value(df: DataFrame, rule: str, constants: dict[str, object] | None = None) -> Column:
    """A mapping's value: a (dotted) field, consts.x (or body., param., query., enums.), eval.{{...}}, parts joined by +, or *_suffix; a miss is null."""
    from ..functions import path

    rule = rule.strip()
    if m := re.fullmatch(r"eval(?:_raw)?\.\{\{(.*)\}\}", rule, re.S):
        return F.expr(expression(m[1]))
    if " + " in rule:
        return F.concat(*(F.coalesce(mapped_value(df, p, constants).cast("string"), F.lit("")) for p in rule.split(" + ")))
    if m := re.fullmatch(r"'([^']*)'", rule):
        return F.lit(m[1])
    if (found := _from_context(rule, constants)) is not None and rule.partition(".")[0] not in df.columns:
        return found
    if rule.startswith("*"):
        found = [c for c in df.columns if c.endswith(rule[1:])]
        return F.coalesce(*(F.col(c) for c in found)) if found else F.lit(None)
    try:
        return path(df, rule)
    except EngineError:
        return F.lit(None)


def map_fields(df: DataFrame, mapping: dict[str, str], constants: dict[str, object] | None = None) -> DataFrame:
    """A row of the mapped fields only."""
    return df.select(*(mapped_value(df, rule, constants).alias(name) for name, rule in mapping.items()))


_LOOKUP = re.compile(r"\blookupIn\s*\(")


def map_with_lookups(df: DataFrame, mapping: dict[str, str], constants: dict[str, object] | None, lookups: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Mapped rows and rejects. ``lookupIn('data', 'key field', value, 'target field')`` in an eval is the target of the row of a lookup whose key is the value; a row with a miss is a reject."""
    from .relational import lookup_join

    columns, out, misses = df.columns, dict(mapping), []
    for name, rule in mapping.items():
        text, parts = masked(rule)
        while m := _LOOKUP.search(text):
            args, end = arguments(text, m.end())
            if len(args) != 4:
                raise EngineError(INPUT, "lookupIn takes four arguments")
            data, key, value, target = (unmasked(x, parts).strip() for x in args)
            data, key, target = (x.strip("'\"") for x in (data, key, target))
            if data not in lookups:
                raise EngineError(INPUT, f"no lookup {data!r}")
            k = len(misses)
            df = df.withColumn(f"_asked{k}", F.expr(expression(value)).cast("string"))
            df = lookup_join(df, lookups[data].filter(F.col(target).isNotNull()), key, f"_asked{k}", target, f"_found{k}")
            misses.append(F.when(F.col(f"_found{k}").isNull(), F.concat(F.lit(f"{data}.{key} = "), F.coalesce(f"_asked{k}", F.lit("null")))))
            text = text[: m.start()] + f"_found{k}" + text[end:]
        out[name] = unmasked(text, parts)
    if not misses:
        return map_fields(df, mapping, constants), df.sparkSession.createDataFrame([], REJECT)
    df = df.withColumn("_missed", F.array_join(F.array_compact(F.array(*misses)), ", "))
    good = df.filter("_missed = ''")
    lost = df.filter("_missed <> ''")
    dead = lost.select(F.lit("lookup").alias("step"), F.concat(F.lit("no row with "), "_missed").alias("reason"), F.to_json(F.struct(*(f"`{c}`" for c in columns)), {"ignoreNullFields": "false"}).alias("record"))
    return map_fields(good, out, constants), dead


def lowercase_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.lower() for c in df.columns))


def filter_rows(df: DataFrame, condition: str) -> DataFrame:
    """Rows of which the condition is true."""
    return df.filter(F.coalesce(F.expr(expression(condition)), F.lit(False)))


#: Tokens of date layouts, and Spark's.
DATE_TOKENS = (("YYYY", "yyyy"), ("YY", "yy"), ("MMMM", "MMMM"), ("MMM", "MMM"), ("MM", "MM"), ("M", "M"), ("DD", "dd"), ("D", "d"), ("HH", "HH"), ("H", "H"), ("hh", "hh"), ("h", "h"), ("mm", "mm"), ("m", "m"), ("ss", "ss"), ("s", "s"), ("SSS", "SSS"), ("A", "a"), ("a", "a"), ("ZZ", "xx"), ("Z", "xxx"))


def date_layout(text: str) -> str:
    """A layout of YYYY, MM, DD, ... as Spark's; quoted parts stay."""
    out, at = "", 0
    tokens = sorted(DATE_TOKENS, key=lambda x: -len(x[0]))
    while at < len(text):
        if text[at] == "'":
            end = text.find("'", at + 1)
            end = len(text) - 1 if end < 0 else end
            out, at = out + text[at : end + 1], end + 1
            continue
        for token, java in tokens:
            if text.startswith(token, at):
                out, at = out + java, at + len(token)
                break
        else:
            out, at = out + (f"'{text[at]}'" if text[at].isalpha() else text[at]), at + 1
    return out


_CALL = re.compile(r"\s*(\w+)\s*\(((?:[^()'\"]|'[^']*'|\"[^\"]*\")*)\)\s*(?:\||$)")


def format_steps(text: str) -> list[tuple[str, list[str]]]:
    """The calls of "op(a, b)|op(c)" with their arguments, quotes taken off."""
    out, at = [], 0
    while at < len(text):
        m = _CALL.match(text, at)
        if not m:
            raise EngineError(INPUT, f"no format step at {text[at:]!r}")
        at, name, inner = m.end(), m[1], m[2]
        args = [a.strip().strip("'\"") for a in re.findall(r"'[^']*'|\"[^\"]*\"|[^,]+", inner)]
        out.append((name.lower(), [a for a in args if a or inner.strip()]))
    if not out:
        raise EngineError(INPUT, f"no format steps in {text!r}")
    return out


def format_fields(df: DataFrame, fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Fields rewritten by steps; a date that fits no layout makes its row a reject."""
    df = df.withColumn("_bad", F.lit(False))
    for field, text in fields.items():
        value = F.col(field) if field in df.columns else F.lit(None).cast("string")
        for op, args in format_steps(text):
            if op == "transform":
                source = value if args[0] in ("current", "self", "this", "_") else F.col(args[0])
                layouts = [date_layout(a) for a in args[2:]] or list(_LAYOUTS)
                parsed = F.coalesce(*(F.try_to_timestamp(source.cast("string"), F.lit(x)) for x in layouts))
                unfit = source.isNull() | ((F.trim(source.cast("string")) != "") & parsed.isNull())
                df = df.withColumn("_bad", F.col("_bad") | F.coalesce(unfit, F.lit(True)))
                value = F.when(F.trim(source.cast("string")) == "", F.lit("")).otherwise(F.date_format(parsed, date_layout(args[1])))
            elif op == "copy":
                value = F.col(args[0])
            elif op == "set":
                value = F.lit(args[0] if args else "")
            elif op == "default":
                value = F.when(value.isNull() | (F.trim(value.cast("string")) == ""), F.lit(args[0])).otherwise(value.cast("string"))
            elif op in ("upper", "uppercase"):
                value = F.upper(value)
            elif op in ("lower", "lowercase"):
                value = F.lower(value)
            elif op == "trim":
                value = F.trim(value)
            elif op == "prefix":
                value = F.concat(F.lit(args[0]), F.coalesce(value.cast("string"), F.lit("")))
            elif op == "suffix":
                value = F.concat(F.coalesce(value.cast("string"), F.lit("")), F.lit(args[0]))
            elif op == "replace":
                value = F.replace(value, F.lit(args[0]), F.lit(args[1] if len(args) > 1 else ""))
            else:
                raise EngineError(INPUT, f"no format step {op!r}")
        df = df.withColumn(field, value)
    return df.filter("not _bad").drop("_bad"), rejects(df.filter("_bad").drop("_bad"), "format", F.lit("a date fits no layout"))


def key_value(df: DataFrame, key: str = "key", value: str = "value", extra: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Each candidate column as a row: the extra columns, key, value as text, value_type."""
    extra = extra or []
    names = [c for c in (include or df.columns) if c not in extra and c not in (exclude or [])]
    if not names:
        raise EngineError(INPUT, "no column to turn into key and value")
    kind = lambda c: {"double": "float", "float": "float", "boolean": "bool", "string": "string"}.get(df.schema[c].dataType.typeName(), "int" if isinstance(df.schema[c].dataType, T.IntegralType) else "unknown")
    items = F.array(*(F.struct(F.lit(c.lower()).alias("k"), F.col(c).cast("string").alias("v"), F.lit(kind(c)).alias("t")) for c in names))
    rows = df.select(*extra, F.explode(items).alias("i"))
    return rows.select(*extra, F.col("i.k").alias(key), F.col("i.v").alias(value), F.col("i.t").alias("value_type"))


def aggregate(df: DataFrame, group_by: list[str], measures: list[tuple[str, str] | tuple[str, str, str]]) -> DataFrame:
    """count, sum, avg (rounded half up to a whole), min, max by groups, whose values come as text; nothing numeric gives 0."""
    out = []
    for m in measures:
        f, field, name = (*m, f"{m[0]}_{m[1]}")[:3] if len(m) == 2 else m
        x = F.col(field).try_cast("double") if f != "count" else None
        if f == "count":
            c = F.count(F.lit(1))
        elif f == "avg":
            mean = F.coalesce(F.avg(x), F.lit(0.0))
            c = F.when(mean >= 0, F.floor(mean + 0.5)).otherwise(F.ceil(mean + 0.5)).cast("bigint")
        elif f in ("sum", "min", "max"):
            c = F.coalesce(getattr(F, f)(x), F.lit(0.0))
        else:
            raise EngineError(INPUT, f"no aggregate {f!r}")
        out.append(c.alias(name))
    return df.groupBy(*(F.col(g).cast("string").alias(g) for g in group_by)).agg(*out)


def multi_source(*frames: DataFrame) -> DataFrame:
    """All rows of several sources, columns by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def record_key(*fields: str) -> Column:
    """The idempotency key of a row: MD5 of the fields, nulls told from empty text."""
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in fields)).cast("binary"))


def not_yet_done(df: DataFrame, done: DataFrame, fields: list[str], now: Column | None = None, lives_s: int | None = None) -> DataFrame:
    """Rows whose key is not among the completed keys (column key): where there are columns state and at, those completed less than ``lives_s`` ago."""
    if "state" in done.columns:
        done = done.filter("state = 'completed'")
    if lives_s is not None:
        done = done.filter(F.col("at") + F.make_dt_interval(secs=F.lit(lives_s)) > (F.current_timestamp() if now is None else now))
    return df.withColumn("key", record_key(*fields)).join(done.select("key").distinct(), "key", "left_anti").drop("key")


def deduplicate(df: DataFrame, field: str | None, *order: Column) -> DataFrame:
    """One row for each value of the field, the first by an order; without a field, whole rows once."""
    from .relational import first_per_key

    return first_per_key(df, [field], *order) if field in df.columns else df.distinct()


class Checkpoint:
    """The greatest value of a field that was loaded, kept as a one-row JSON table in a folder that Spark writes."""

    def __init__(self, spark: SparkSession, folder: str, field: str):
        self.spark, self.folder, self.field = spark, folder, field

    def last(self) -> str | None:
        try:
            rows = self.spark.read.schema("field string, value string").json(self.folder).filter(F.col("field") == self.field).agg(F.max("value")).first()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return rows[0] if rows else None

    def new_rows(self, df: DataFrame) -> DataFrame:
        last = self.last()
        return df if last is None else df.filter(F.col(self.field) > F.lit(last).cast(df.schema[self.field].dataType))

    def save(self, df: DataFrame) -> str | None:
        value = df.agg(F.max(self.field).cast("string").alias("value")).first()[0]
        if value is not None:
            self.spark.createDataFrame([(self.field, value)], "field string, value string").coalesce(1).write.mode("append").json(self.folder)
        return value


def dead_letters(dead: DataFrame, now: Column | None = None, attempts: int = 0, wait_s: int = 60, most: int = 3) -> DataFrame:
    """Rejects as letters: id, failed_at, attempts, next_retry (the wait doubles with each attempt), state pending or, after ``most`` attempts, exhausted."""
    at = F.current_timestamp() if now is None else now
    tried = F.lit(attempts + 1)
    return dead.select(
        F.md5(F.concat_ws("\x1f", "step", "record").cast("binary")).alias("id"), "step", "reason", "record", at.alias("failed_at"), tried.alias("attempts"),
        F.when(tried < most, at + F.make_dt_interval(secs=F.lit(wait_s * 2**attempts))).alias("next_retry"), F.when(tried < most, "pending").otherwise("exhausted").alias("state"),
    )


def due(letters: DataFrame, now: Column | None = None) -> DataFrame:
    """The letters whose time to be tried again has come."""
    return letters.filter((F.col("state") == "pending") & (F.col("next_retry") <= (F.current_timestamp() if now is None else now)))


def letter_counts(letters: DataFrame) -> DataFrame:
    """step, state, n, and the most attempts of any."""
    return letters.groupBy("step", "state").agg(F.count(F.lit(1)).alias("n"), F.max("attempts").alias("attempts"))


def greatest_by_key(df: DataFrame, key: str) -> DataFrame:
    """Of the rows of each key the greatest; those with a null key are left out. Maps and variants are compared as JSON text."""
    rest = [c for c in df.columns if c != key]
    df = df.filter(F.col(key).isNotNull())
    if not rest:
        return df.distinct()
    plain = lambda f: any(x in f.dataType.simpleString() for x in ("map<", "variant"))
    order = F.struct(*((F.to_json(F.struct(f"`{f.name}`")) if plain(f) else F.col(f"`{f.name}`")).alias(f"o{i}") for i, f in enumerate(df.schema) if f.name != key))
    one = df.groupBy(key).agg(F.max_by(F.struct(*(f"`{c}`" for c in rest)), order).alias("_row"))
    return one.select(key, "_row.*").select(*(f"`{c}`" for c in df.columns))


def upsert(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The target with rows replaced or added by key; of changes of one key the greatest row counts, and those with a null key are added."""
    one = greatest_by_key(changes, key).unionByName(changes.filter(F.col(key).isNull()))
    return target.join(one.select(key), key, "left_anti").unionByName(one, allowMissingColumns=True)


def delete_keys(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return target.join(keys.select(key).distinct(), key, "left_anti")
