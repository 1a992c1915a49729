"""Importance resampling towards a target's distribution of hashed words.

Each document's features are its runs of 1 to ``most`` words, repeats counted; a
feature's bucket is the crc32 of its bytes modulo ``buckets``. Higher-order
functions make each document's array of buckets, which is written once. What is
exploded is only counted: at most ``buckets`` totals leave each task. The gain of
a bucket is the logarithm of its share among the target texts over its share
among the documents, both smoothed by one, and the weight of a document is the
mean gain of its features: an ``aggregate`` over the array with ``element_at`` of
one literal array of gains. Gumbel noise from a hash of the id turns weights into
a draw without replacement: the rows of the highest scores.

The draw needs no global order. Scores are integers, so counts by score (some
100,000 different ones at most, as gains and noise are bounded) say which score
is the last that is drawn and how many rows stand above each score. Only the rows
from that score on are shuffled, and ranked within their score.

Defined cases: a null or empty text has no features and weight 0; a text of any
length is read whole; ties go to the smaller id; rows that repeat an id are
documents of their own and, where equal, take consecutive ranks; a null id
counts in the totals but has no score and is not drawn; no rows give no rows; no
target texts give every bucket the target's smoothed share; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, text_or_empty, written
from .spans import bound

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Words in order, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _UPPER.lower()), F.lit(WORD), F.lit(0))


def bucketed(found: Column, most: int = 1, buckets: int = BUCKETS) -> Column:
    """The bucket of every run of 1 to ``most`` words."""

    def bucket(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % buckets).cast("int")

    def runs(w: Column, n: int) -> Column:
        if n == 1:
            return F.transform(w, bucket)
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(w, i, F.lit(n)), " ")))

    return bound(found, lambda w: F.concat(*(runs(w, n) for n in range(1, most + 1))))


def featured(docs: DataFrame, most: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, buckets of every row."""
    found = words(text_or_empty(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), found.alias("found"))
    return rows.select("doc_id", F.size("found").cast("long").alias("n_words"), bucketed(F.col("found"), most, buckets).alias("buckets"))


def totals(rows: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How many features fall into each bucket: at most ``buckets`` rows reach the driver."""
    out = [0] * buckets
    for bucket, n in rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect():
        out[bucket] = n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 * ln(target share / corpus share)) of each bucket."""
    n, s, t = len(corpus), float(sum(corpus) + len(corpus)), float(sum(target) + len(target))
    return [math.floor(1000 * math.log((target[i] + 1.0) * s / ((corpus[i] + 1.0) * t))) for i in range(n)]


def literal(values: list[int]) -> Column:
    """An array that the optimizer folds into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def weight(found: Column, gain: Column) -> Column:
    """The floored mean gain of an array of buckets, 0 of an empty one."""
    total = F.aggregate(found, F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(gain, b + 1))
    n = F.size(found).cast("long")
    return bound(total, lambda x: F.when(n > 0, ((x - F.pmod(x, n)) / n).cast("long")).otherwise(F.lit(0).cast("long")))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """floor(1000 * Gumbel noise), from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scores(
    docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row; written. target: any table of texts like those wanted."""
    rows = written(featured(docs, most, buckets, id_col, text_col), "resample-buckets")
    wanted = target.select(bucketed(words(text_or_empty(target_text)), most, buckets).alias("buckets"))
    gain = literal(gains(totals(rows, buckets), totals(wanted, buckets)))
    found = rows.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight(F.col("buckets"), gain).alias("weight"))
    out = written(found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resample-scores")
    discard(docs.sparkSession, rows)
    return out


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored with rank: from 1 by falling score among the floor(percent * N / 100) drawn of N rows of enough words, else null."""
    enough = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    counts = sorted(scored.filter(enough).groupBy("score").count().collect(), reverse=True)  # one row for each different integer
    want, above, last, before = percent * sum(n for _, n in counts) // 100, 0, None, []
    for score, n in counts:
        if above >= want:
            break
        before.append((score, above))
        last, above = score, above + n
    if last is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    high = F.coalesce(enough & (F.col("score") >= last), F.lit(False))
    rest = scored.filter(~high).withColumn("rank", F.lit(None).cast("long"))
    # equal rows are one row with a count until they have their ranks
    kinds = scored.filter(high).groupBy(*scored.columns).agg(F.count(F.lit(1)).alias("_copies"))
    offsets = scored.sparkSession.createDataFrame(before, "score long, _above long")
    order = Window.partitionBy("score").orderBy("doc_id", "n_words", "n_features").rowsBetween(Window.unboundedPreceding, 0)
    ranked = kinds.join(F.broadcast(offsets), "score").withColumn("_end", F.col("_above") + F.sum("_copies").over(order))
    ranked = ranked.withColumn("rank", F.explode(F.sequence(F.col("_end") - F.col("_copies") + 1, F.col("_end"))))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= want, F.col("rank")))
    return rest.unionByName(ranked.select(*rest.columns))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that are drawn; of an id of several rows all stay if one is drawn."""
    ranks = drawn(scores(docs, target, id_col=id_col, **options), percent, least_words)
    ids = ranks.filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col(id_col).cast("long") == F.col("_drawn"), "left_semi")
