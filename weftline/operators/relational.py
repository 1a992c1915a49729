"""Relational operators that stock Spark spells differently or leaves open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all common columns, each once; without any the result is empty, never a cross product."""
    common = [c for c in a.columns if c in b.columns]
    if common:
        return a.join(b, common, how)
    return a.join(b, F.lit(False), "inner")


def band_join(a: DataFrame, b: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of a with the rows of b whose [low, high) holds a's value, by an equi-join on bins of the width.

    b's intervals are copied to the bins that they meet; choose a width near
    their length. Shuffles by bin, so neither side must be small.
    """
    left = a.withColumn("_bin", F.floor(F.col(value) / width))
    right = b.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return left.join(right, "_bin").filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_bin")


def unnest(df: DataFrame, array: str | Column, alias: str, outer: bool = False, on=None) -> DataFrame:
    """Each row with each element of an array: fields of objects as alias.field columns, scalars as alias.value.

    ``on``: a function from the element to a condition; others are left out.
    outer keeps rows of which no element remains.
    """
    a = F.col(array) if isinstance(array, str) else array
    kind = df.select(a).schema[0].dataType.elementType
    items = F.filter(a, on) if on else a
    rows = df.select("*", (F.explode_outer(items) if outer else F.explode(items)).alias("_item"))
    if isinstance(kind, T.StructType):
        parts = [F.col(f"_item.`{f.name}`").alias(f"{alias}.{f.name}") for f in kind.fields]
    else:
        parts = [F.col("_item").alias(f"{alias}.value")]
    return rows.select(*df.columns, *parts)


def lookup_join(df: DataFrame, data: DataFrame, key: str, value: str, target: str, name: str | None = None) -> DataFrame:
    """df with the target field of the first (least) row of data whose key equals df's value; null where there is none.

    Spark broadcasts the lookup where its size in bytes allows it and shuffles otherwise.
    """
    one = data.groupBy(F.col(key).cast("string").alias("_key")).agg(F.min(target).alias(name or target))
    return df.join(one, F.col(value).cast("string") == F.col("_key"), "left").drop("_key")


def union_by_name(*frames: DataFrame, distinct: bool = True) -> DataFrame:
    """Union that lines columns up by name; a missing one is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.distinct() if distinct else out


def intersect_rows(a: DataFrame, b: DataFrame, bag: bool = False) -> DataFrame:
    """Rows of both; as a bag, b's rows that occur in a with their repeats."""
    if not bag:
        return a.intersect(b.select(*a.columns))
    keys = a.distinct()
    return _on_all(b.select(*a.columns), keys, "left_semi")


def except_rows(a: DataFrame, b: DataFrame, bag: bool = False) -> DataFrame:
    """Rows of a that are not in b; as a bag, with their repeats."""
    return _on_all(a, b.select(*a.columns), "left_anti") if bag else a.subtract(b.select(*a.columns))


def _on_all(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    left, right = a.alias("l"), b.alias("r")
    on = F.lit(True)
    for c in a.columns:
        on = on & F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    return left.join(right, on, how)


def limit_rows(df: DataFrame, n: int | None = None, offset: int = 0) -> DataFrame:
    """Rows from an offset on, at most n; n of null or 0 is no limit."""
    out = df.offset(offset) if offset else df
    return out.limit(n) if n else out


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by an order; what is kept does not depend on how rows arrive."""
    turn = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_turn", F.row_number().over(turn)).filter("_turn = 1").drop("_turn")


def not_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose value is not among the values; nulls among these do not matter."""
    v = values.toDF("_value").distinct()
    return df.join(v, df[column] == v["_value"], "left_anti")
