"""Column functions with the dialect's meaning, all built from Spark's own.

Comparison is by type: columns that are both numeric, dates or plain text take
Spark's operator, so that filters still reach the scan; only text against a
number pays for a cast. Casts never fail: what can't be cast is null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import INPUT, EngineError
from .dialect import DATE_LAYOUTS

__all__ = [
    "arith", "array_compare", "avg_numeric", "cast_to", "coalesce_text", "compare", "concat_text", "contains_all", "count_rows", "date_minus", "diff", "first_by_text",
    "if_true", "ilike_text", "json_exists", "json_extract", "json_value", "last_by_text", "length_bytes", "matches_all", "matches_any", "max_numeric", "min_numeric",
    "month_of", "overlaps", "parse_date", "path", "substr_text", "sum_numeric", "to_date_text", "to_number", "today_text", "year_of", "first_item", "last_item",
]

C = Column | str
_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b,
    ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
}
#: The names a cast may use, and Spark's types; other names give null.
CASTS = {
    "int": "int", "integer": "int", "int32": "int", "int64": "bigint", "bigint": "bigint", "float": "double", "float64": "double", "double": "double",
    "decimal": "double", "numeric": "double", "bool": "boolean", "boolean": "boolean", "string": "string", "text": "string", "varchar": "string",
}


def _col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _op(op: str) -> Callable[[Column, Column], Column]:
    if op not in _OPS:
        raise EngineError(INPUT, f"no comparison {op!r}")
    return _OPS[op]


def compare(df: DataFrame, a: C, op: str, b: C) -> Column:
    """a op b, where text meets a number: as numbers if both can be numbers, else as text."""
    f, a, b = _op(op), _col(a), _col(b)
    kinds = [df.select(x).schema[0].dataType for x in (a, b)]
    text = [isinstance(k, T.StringType) for k in kinds]
    if text[0] == text[1] or not any(isinstance(k, T.NumericType) for k in kinds):
        return f(a, b)
    return F.coalesce(f(a.try_cast("double"), b.try_cast("double")), f(a.cast("string"), b.cast("string")))


def array_compare(array: C, op: str, value: Column | object) -> Column:
    """Whether some element stands in the relation to the value (all six operators)."""
    f, v = _op(op), value if isinstance(value, Column) else F.lit(value)
    return F.coalesce(F.exists(_col(array), lambda x: f(x, v)), F.lit(False))


def matches_any(value: Column | object, op: str, array: C) -> Column:
    """value op ANY(array); false for a null or empty array."""
    f, v = _op(op), value if isinstance(value, Column) else F.lit(value)
    return F.coalesce(F.exists(_col(array), lambda x: f(v, x)), F.lit(False))


def matches_all(value: Column | object, op: str, array: C) -> Column:
    """value op ALL(array); true for a null or empty array."""
    f, v = _op(op), value if isinstance(value, Column) else F.lit(value)
    return F.coalesce(F.forall(_col(array), lambda x: f(v, x)), F.lit(True))


def contains_all(array: C, *values: object) -> Column:
    """Whether the array holds every value; false without values or for a null array."""
    if not values:
        return F.lit(False)
    return reduce(lambda p, v: p & F.coalesce(F.array_contains(_col(array), v), F.lit(False)), values, F.lit(True))


def overlaps(array: C, *values: object) -> Column:
    """Whether the array holds one of the values, or shares an element with another array."""
    other = values[0] if len(values) == 1 and isinstance(values[0], Column) else F.array(*map(F.lit, values))
    return F.coalesce(F.arrays_overlap(_col(array), other), F.lit(False))


def ilike_text(c: C, pattern: str) -> Column:
    """Case-insensitive match: of the whole with % or _, else of a part."""
    if "%" in pattern or "_" in pattern:
        return F.ilike(_col(c), F.lit(pattern))
    return F.contains(F.lower(_col(c)), F.lit(pattern.lower()))


def arith(a: C, op: str, b: C) -> Column:
    """Arithmetic as double; null where an operand is no number or the divisor is 0."""
    x, y = _col(a).try_cast("double"), _col(b).try_cast("double")
    if op == "/":
        return F.try_divide(x, y)
    return {"+": x + y, "-": x - y, "*": x * y}[op]


def date_minus(a: C, b: C) -> Column:
    """Days from b to a, both text yyyy-MM-dd or dates; null otherwise."""
    return F.datediff(parse_date(a, "yyyy-MM-dd"), parse_date(b, "yyyy-MM-dd"))


def parse_date(c: C, *layouts: str) -> Column:
    """A timestamp by the first layout that fits, else null."""
    x = _col(c).cast("string")
    return F.coalesce(*(F.try_to_timestamp(x, F.lit(layout)) for layout in layouts))


def year_of(c: C) -> Column:
    return F.year(F.coalesce(parse_date(c, *DATE_LAYOUTS), _col(c).try_cast("timestamp")))


def month_of(c: C) -> Column:
    return F.month(F.coalesce(parse_date(c, *DATE_LAYOUTS), _col(c).try_cast("timestamp")))


def to_date_text(c: C, layout: str) -> Column:
    """Text by a layout of YYYY, MM, DD as yyyy-MM-dd; null if it does not fit."""
    return F.date_format(parse_date(c, layout.replace("YYYY", "yyyy").replace("DD", "dd")), "yyyy-MM-dd")


def today_text() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def cast_to(c: C, name: str) -> Column:
    """A cast by the dialect's type names; null where it can't be done."""
    kind = CASTS.get(name.lower())
    return _col(c).try_cast(kind) if kind else F.lit(None)


def to_number(c: C) -> Column:
    return _col(c).try_cast("double")


def concat_text(*cs: C) -> Column:
    """Texts joined, null as empty."""
    return F.concat(*(F.coalesce(_col(c).cast("string"), F.lit("")) for c in cs))


def coalesce_text(*cs: C) -> Column:
    """The first that is neither null nor empty text."""
    return F.coalesce(*(F.when(_col(c).cast("string") != "", _col(c)) for c in cs))


def if_true(condition: Column, a: Column | object, b: Column | object) -> Column:
    wrap = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(F.coalesce(condition, F.lit(False)), wrap(a)).otherwise(wrap(b))


def substr_text(c: C, start: int, length: int | None = None) -> Column:
    """From a place counted from 1; empty for a start below 1."""
    if start < 1:
        return F.when(_col(c).isNotNull(), F.lit(""))
    return F.substring(_col(c), start, length if length is not None else 2**31 - 1)


def length_bytes(c: C) -> Column:
    return F.octet_length(_col(c))


def first_item(array: C) -> Column:
    return F.get(_col(array), F.lit(0))


def last_item(array: C) -> Column:
    return F.try_element_at(_col(array), F.lit(-1))


# --- aggregates


def count_rows() -> Column:
    """Rows, nulls among them."""
    return F.count(F.lit(1))


def sum_numeric(c: C) -> Column:
    """The sum of what is numeric; 0 of nothing."""
    return F.coalesce(F.sum(to_number(c)), F.lit(0.0))


def avg_numeric(c: C) -> Column:
    return F.avg(to_number(c))


def min_numeric(c: C) -> Column:
    return F.min(to_number(c))


def max_numeric(c: C) -> Column:
    return F.max(to_number(c))


def diff(c: C) -> Column:
    """The greatest less the least number."""
    return F.max(to_number(c)) - F.min(to_number(c))


def _row_text(df: DataFrame) -> Column:
    return F.to_json(F.struct(*sorted(df.columns)))


def first_by_text(df: DataFrame, c: C) -> Column:
    """The value of the row whose JSON text (names sorted) is least: an order that does not depend on how rows arrive."""
    return F.min_by(_col(c), _row_text(df))


def last_by_text(df: DataFrame, c: C) -> Column:
    return F.max_by(_col(c), _row_text(df))


# --- paths and JSON

_STEP = re.compile(r'"([^"]*)"|\[(-?\d+)\]|([^.\[\]">-]+)')


def path(df: DataFrame, text: str) -> Column:
    """A path such as a.b, a->b, a."odd key" or a[0].b, resolved against the schema.

    A key steps into a struct or map, or into each struct of an array (misses
    left out, one level flattened; nothing found is null); an index out of range
    is null. A column whose name is the longest prefix wins.
    """
    steps = [int(i) if i else quoted or bare for quoted, i, bare in _STEP.findall(text.replace("->", "."))]
    names = {c.lower(): c for c in df.columns}
    for n in range(len(steps), 0, -1):
        head = ".".join(map(str, steps[:n]))
        if head.lower() in names:
            name = names[head.lower()]
            return _walk(F.col(f"`{name}`"), df.schema[name].dataType, steps[n:])
    raise EngineError(INPUT, f"no column for the path {text!r}")


def _walk(c: Column, kind: T.DataType, steps: list) -> Column:
    if not steps:
        return c
    step, rest = steps[0], steps[1:]
    if isinstance(step, int):
        if not isinstance(kind, T.ArrayType):
            return F.lit(None)
        return _walk(F.get(c, F.lit(step)) if step >= 0 else F.lit(None).cast(kind.elementType), kind.elementType, rest)
    if isinstance(kind, T.StructType):
        found = next((f for f in kind.fields if f.name.lower() == step.lower()), None)
        return _walk(c.getField(found.name), found.dataType, rest) if found else F.lit(None)
    if isinstance(kind, T.MapType):
        return _walk(F.try_element_at(c, F.lit(step)), kind.valueType, rest)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        found = next((f for f in kind.elementType.fields if f.name.lower() == step.lower()), None)
        if not found:
            return F.lit(None)
        items = F.filter(F.transform(c, lambda x: x.getField(found.name)), lambda x: x.isNotNull())
        inner = found.dataType
        if isinstance(inner, T.ArrayType):
            items, inner = F.flatten(items), inner.elementType
        return _walk(F.when(F.size(items) > 0, items), T.ArrayType(inner), rest)
    return F.lit(None)


def _json_path(text: str) -> str:
    return text if text.startswith("$") else f"$.{text}"


def json_extract(c: C, text: str) -> Column:
    """What a path finds in JSON text, as text."""
    return F.get_json_object(_col(c), _json_path(text))


def json_exists(c: C, text: str) -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(_col(c)), _json_path(text), "variant").isNotNull(), F.lit(False))


def json_value(c: C, text: str) -> Column:
    """A scalar; of an array, its first element that is not null."""
    found = F.get_json_object(_col(c), _json_path(text))
    items = F.filter(F.from_json(found, "array<string>"), lambda x: x.isNotNull())
    return F.when(F.startswith(F.trim(found), F.lit("[")), F.get(items, F.lit(0))).otherwise(found)
