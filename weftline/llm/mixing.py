"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled (by a hash), joined end to end and cut
into blocks of equal size in words. The mix is a row of slots. Slot i takes the
point (i * g) mod N of the golden-ratio lattice (g next to N / golden ratio and
prime to N), which visits each of N points once and spreads any stretch of slots evenly;
the sources' cumulative slot counts cut the points among the sources. Slots are
ranked within their source and rank r takes block r mod blocks, so a source
that is taken more than once repeats in whole passes.

Targets share the size of all documents by weight, but a source takes at most
``most`` times its own size; the excess goes to the others by weight, until none
is above. That fill is solved in one sorted pass over the sources.

Only built-in functions. Running sums are taken in two steps (hash buckets of a
source, then rows of a bucket), so a source with a third of all rows is no
single task's work. One row per source is ordered in one task.

Defined cases: a null text has size 0; a document of size 0 is never taken; null
is a source of its own, after the others; rows that repeat a doc_id are separate
documents; ties in the shuffle go by id and size; a text of any length is counted
whole; other columns are ignored, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 1024
_BINS = 1024
_CHUNK = 65536
_GOLDEN = 0.6180339887498949


def words(text: Column) -> Column:
    """The number of runs of characters that are not ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def digests(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """What the mix needs of each document, written once: doc_id, source, size and its place in the shuffle."""
    h = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(text_or_empty(text_col)).alias("size"), h.alias("h"))
    return written(rows.withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int")), "mix-digests")


def source_targets(base: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: idx (from 0 in code point order, null last), source_size, target."""
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") % len(weights) + 1).cast("int"))
    s = sources.withColumn("idx", (F.row_number().over(by_name) - 1).cast("int")).withColumn("w", w)
    # sources reach their limit in the order of size / weight: lam is the share per weight if exactly those before have
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("source_size") / F.col("w"))
    upto = Window.orderBy("ratio", "idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy("ratio", "idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lam = (F.sum("source_size").over(every) - F.sum("cap").over(upto) + F.col("cap")) / (F.sum("w").over(every) - F.sum("w").over(upto) + F.col("w"))
    s = s.withColumn("lam", lam).withColumn("fits", F.col("lam") * F.col("w") <= F.col("cap"))
    share = F.first(F.when(F.col("fits"), F.col("lam")), ignorenulls=True).over(every)
    return s.select("source", "idx", "source_size", F.least(F.col("cap").cast("double"), share * F.col("w")).alias("target"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(schedule, documents).

    schedule: what the mix takes, ordered by slot and start: slot, rank (of the
    slot in its source), source, doc_id, start (word in the document), n_words.
    documents: per document doc_id, source, size, source_size, target, taken.
    """
    spark = docs.sparkSession
    base = digests(docs, seed, id_col, text_col, source_col)
    sources = written(source_targets(base, weights, most), "mix-sources")
    b = F.lit(block_words)
    size, whole = F.col("source_size"), F.floor("target")
    plan = sources.filter("source_size > 0").withColumns({"passes": F.floor(whole / size), "rest": F.pmod(whole, size), "blocks": F.ceil(size / b)})
    plan = plan.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / b))
    plan = plan.withColumn("first_point", F.sum("slots").over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)) - F.col("slots"))
    n = plan.agg(F.sum("slots")).first()[0] or 0

    # the schedule: points of the lattice, cut among the sources by joining on bins of points
    g = next((x for d in range(max(n, 1)) for x in (round(n * _GOLDEN) + d, round(n * _GOLDEN) - d) if x > 0 and gcd(x, n) == 1), 1)
    width = max(1, -(-n // _BINS))
    point = (F.col("id").cast("decimal(19,0)") * F.lit(g).cast("decimal(18,0)") % F.lit(max(n, 1)).cast("decimal(19,0)")).cast("long")
    slots = spark.range(n).select(F.col("id").alias("slot"), point.alias("point")).withColumn("bin", F.floor(F.col("point") / width))
    bins = F.explode(F.sequence(F.floor(F.col("first_point") / width), F.floor((F.col("first_point") + F.col("slots") - 1) / width)))
    cuts = plan.filter("slots > 0").select("idx", "blocks", "passes", "rest", "first_point", (F.col("first_point") + F.col("slots")).alias("end_point"), bins.alias("bin"))
    slots = slots.join(cuts, "bin").filter("point >= first_point and point < end_point").select("slot", "idx", "blocks", "passes", "rest")

    # ranks within a source: slots of earlier chunks, then of the same chunk
    slots = slots.withColumn("chunk", F.floor(F.col("slot") / _CHUNK))
    counts = slots.groupBy("idx", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("idx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    ranked = slots.join(counts.select("idx", "chunk", before.alias("before")), ["idx", "chunk"])
    rank = F.col("before") + F.row_number().over(Window.partitionBy("idx", "chunk").orderBy("slot")) - 1
    ranked = ranked.withColumn("rank", rank).withColumn("block", F.pmod("rank", "blocks"))
    limit = F.when(F.floor(F.col("rank") / F.col("blocks")) < F.col("passes"), F.lit(None).cast("long")).otherwise(F.col("rest"))
    ranked = ranked.select("slot", "rank", "idx", "block", limit.alias("limit"))

    # the shuffled documents of a source, end to end, cut at block borders
    docs_idx = base.join(sources.select(F.col("source").alias("s"), "idx"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    buckets = docs_idx.groupBy("idx", "bucket").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("idx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    in_bucket = F.sum("size").over(Window.partitionBy("idx", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = docs_idx.join(buckets.select("idx", "bucket", before.alias("before")), ["idx", "bucket"])
    placed = placed.withColumn("at", F.col("before") + in_bucket).select("doc_id", "idx", "size", "at")
    placed = written(placed, "mix-placed")
    end = F.col("at") + F.col("size")
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((end - 1) / b))))
    pieces = pieces.withColumns({"lo": F.greatest("at", F.col("block") * b), "hi": F.least(end, (F.col("block") + 1) * b)})

    taken = pieces.join(ranked, ["idx", "block"]).withColumn("hi", F.least("hi", F.coalesce("limit", "hi"))).filter("hi > lo")
    taken = taken.withColumns({"start": F.col("lo") - F.col("at"), "n_words": F.col("hi") - F.col("lo")})
    schedule = taken.join(sources.select("idx", "source"), "idx").select("slot", "rank", "source", "doc_id", "start", "n_words")
    sums = taken.groupBy("idx", "at", "doc_id").agg(F.sum("n_words").alias("taken"))
    rows = placed.filter("size > 0").join(sums.select("idx", "at", "taken"), ["idx", "at"], "left")
    rows = rows.select("doc_id", "idx", "size", "taken").unionByName(placed.filter("size = 0").select("doc_id", "idx", "size", F.lit(None).cast("long").alias("taken")))
    rows = rows.join(sources, "idx").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return schedule, rows


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs, each as often as the mix takes it, in whole documents: taken / size, rounded.

    Only the documents at the end of a source's last pass are taken in part. Rows
    that repeat an id are taken equally often.
    """
    _, rows = mix(docs, id_col=id_col, **options)
    times = rows.groupBy("doc_id").agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("x"))
    times = times.select(F.col("doc_id").alias("id"), F.round("x").cast("int").alias("times")).filter("times > 0")
    whole = docs.select(F.col(f"`{id_col}`").alias("own_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = whole.join(times, F.col("own_id").eqNullSafe(F.col("id")))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
