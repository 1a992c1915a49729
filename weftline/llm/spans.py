"""Places of regular-expression matches and folds over arrays, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string,left:string,right:string>"
_LEFT, _RIGHT = 32, 8


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value taken once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(array: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, finish: Callable[[Column, Column], Column] = lambda state, out: out) -> Column:
    """Fold over an array with step(state, x) -> (state, array of what x adds to the result, of type ``kind``).

    Appending to an array copies it. So the fold goes by blocks of about the
    square root of the length and joins their results at the end: n elements
    cost n ** 1.5 small copies.
    """
    n = F.size(array)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    blocks = F.transform(F.when(n > 0, F.sequence(F.lit(1), n, width)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(array, i, width))
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        new, more = step(acc["state"], x)
        return F.struct(new.alias("state"), F.concat(acc["out"], more).alias("out"))

    def of_block(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return bound(done, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(blocks, start, of_block, lambda acc: finish(acc["state"], F.flatten(acc["out"])))


def distinct_sorted(array: Column) -> Column:
    """The different elements in ascending order; unlike ``array_distinct``, which compares every two of an array of structs."""
    return bound(F.array_sort(array), lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))


def find_all(text: Column, pattern: str | Column) -> Column:
    """Leftmost non-overlapping matches in order: array of (start, end, text, left, right).

    Places count code points from 0, the end exclusive; left and right are up to
    32 and 8 characters between the match and its neighbours. The pieces between
    matches and the matches themselves give each place by a running sum.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern

    def joined(found: Column, pieces: Column) -> Column:
        """Each match with the pieces beside it."""
        n = F.size(found)
        beside = F.zip_with(F.slice(pieces, F.lit(1), n), F.slice(pieces, F.lit(2), n), lambda a, b: F.struct(F.length(a).alias("gap"), F.right(a, F.lit(_LEFT)).alias("left"), F.left(b, F.lit(_RIGHT)).alias("right")))
        return F.zip_with(beside, found, lambda g, m: F.struct(g["gap"].alias("gap"), g["left"].alias("left"), g["right"].alias("right"), m.alias("text"), F.length(m).alias("n")))

    none = F.array().cast("array<struct<gap:int,left:string,right:string,text:string,n:int>>")
    pairs = bound(F.regexp_extract_all(text, p, F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(bound(F.split(text, p, F.lit(-1)), lambda pieces: joined(found, pieces))))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        end = at + x["gap"] + x["n"]
        return end, F.array(F.struct((at + x["gap"]).alias("start"), end.alias("end"), x["text"].alias("text"), x["left"].alias("left"), x["right"].alias("right")))

    return bound(pairs, lambda p: fold(p, F.lit(0), step, SPAN))
