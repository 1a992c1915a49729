"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features gives a latent score f; ordered
thresholds t_0 < t_1 < ... cut it into grades: P(grade <= k) = s(t_k - f) with
the logistic function s. The expected grade and the probability of the highest
grades (the tail) serve selection.

Features are the text's distinct words, their beginnings and its levels of a dozen shares (upper
case, digits, signs, repeated and adjacent equal words, lengths), each hashed to
one of ``dims`` places.

Fitting takes a bounded sample of rated texts: of each grade as large a share,
by a hash of the id, as gives ``per_grade`` texts on average; a text weighs its
grade's share to the power of -1/2, between the corpus's proportions and equal ones.
Only features whose share of texts differs between two grades by ``least_z``
standard errors have a weight, so that the many rare words add no noise. Each
round, the partitions of the sample run an epoch of AdaGrad from the same weights
and their results are averaged (iterative parameter mixing): the numbers of the
features that have a weight, per partition and round, reach the driver.

Defined cases: a null text is an empty one; ratings without a text and texts
without a rating are not learned from; a null grade is no rating; without two
different grades every text has the highest expected grade and tail 1; other
columns are ignored, whatever their names; equal texts score alike; a text of any
length is read whole; no rows give no rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Kept, slices, worker_cache, written

DIMS = 1 << 17
PER_GRADE = 5000
ROUNDS = 10
PARTS = 6
LEAST_Z = 4.0
#: Places of words that a worker keeps, twice.
MOST_WORDS = 150_000
_WORD = re.compile(r"\w+")
_CLASS = np.zeros(256, np.int64)  # of a UTF-8 byte: 0 lower-case letter, 1 upper, 2 digit, 3 white space, 4 sign, 5 part of a longer character
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4
_CLASS[128:] = 5


def _place(word: str) -> int:
    return zlib.crc32(word.encode()) & 0x7FFFFFFF


def features(text: str, dims: int = DIMS) -> np.ndarray:
    """Distinct places of a text's features, ascending."""
    words = _WORD.findall(text.lower())
    different = set(words)
    raw = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(_CLASS[raw], minlength=6) / max(1, len(raw))
    n = max(1, len(words))
    equal = sum(map(eq, words, words[1:])) / n
    lines = text.split("\n")
    shares = (*counts, len(different) / n, equal, sum(map(len, words)) / n / 20, len(set(lines)) / len(lines), min(1.0, len(lines) / n))
    levels = [f"#{k}:{int(24 * x**0.5)}" for k, x in enumerate(shares)] + [f"#n:{len(words).bit_length()}"]
    places = worker_cache("quality", lambda: Kept(_place, MOST_WORDS))
    stems = {w[:4] + "-" for w in different if len(w) > 5}
    return np.unique(np.array([places[w] for w in (*different, *stems, *levels)], np.int64) & (dims - 1))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, f: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... for each latent score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - f[:, None], -60, 60)))


def _sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-min(60.0, max(-60.0, x))))


def epoch(w: np.ndarray, squares: np.ndarray, t: np.ndarray, docs: list[tuple[np.ndarray, int, float]], rate: float) -> None:
    """One pass of AdaGrad over (places, grade, weight), in place."""
    last = len(t)
    t_squares = np.full(last, 1.0)
    for x, y, weight in docs:
        f = float(w[x].sum())
        a = _sigmoid(t[y] - f) if y < last else 1.0
        b = _sigmoid(t[y - 1] - f) if y else 0.0
        p = max(a - b, 1e-9)
        g = weight * (1 - a - b)
        squares[x] += g * g
        w[x] -= rate * g / np.sqrt(squares[x])
        for k, slope in ((y, -a * (1 - a) / p), (y - 1, b * (1 - b) / p)):
            if 0 <= k < last:
                t_squares[k] += (weight * slope) ** 2
                t[k] -= rate * weight * slope / np.sqrt(t_squares[k])
        np.maximum.accumulate(t, out=t)


def fit(
    docs: DataFrame, ratings: DataFrame, grades: int, per_grade: int = PER_GRADE, dims: int = DIMS, rounds: int = ROUNDS, parts: int = PARTS, rate: float = 0.5, least_z: float = LEAST_Z,
    id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade",
) -> Model:
    """The model of texts (docs: id, text) rated 0 to grades - 1 (ratings: id, grade)."""
    t = np.linspace(-1.0, 1.0, grades - 1)
    few = _sample(docs, ratings, per_grade, id_col, text_col, grade_col)

    def prepare(batches):
        for b in batches:
            found = [features(x, dims).astype(np.int32) for part in slices(b, 0) for x in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), b.column(1), b.column(2), b.column(3)], names=["x", "grade", "weight", "place"])

    ready = few.select(F.col(text_col).alias("text"), "grade", "weight", "place").mapInArrow(prepare, "x array<int>, grade int, weight double, place long")
    ready = written(ready.repartition(parts, "place").sortWithinPartitions("place"), "quality-sample")
    sizes = {r.grade: r.texts for r in ready.groupBy("grade").agg(F.count(F.lit(1)).alias("texts")).collect()}
    if len(sizes) < 2:
        return Model(np.zeros(dims, np.float32), np.full(grades - 1, -60.0))
    ready = ready.coalesce(parts)
    telling = _telling_places(ready, [sizes.get(k, 0) for k in range(grades)], least_z)
    w, squares = np.zeros(len(telling)), np.ones(len(telling))  # no other place ever has a weight
    number = np.full(dims, -1, np.int32)
    number[telling] = np.arange(len(telling))
    sc = docs.sparkSession.sparkContext
    numbers = sc.broadcast(number)
    for _ in range(rounds):
        shared = sc.broadcast((w, squares, t))

        def run(batches, shared=shared):
            own, own_squares, own_t = (x.copy() for x in shared.value)
            docs = []
            for b in batches:
                xs = (numbers.value[x.values.to_numpy()] for x in b.column(0))
                docs += [(x[x >= 0], y, z) for x, y, z in zip(xs, b.column(1).to_pylist(), b.column(2).to_pylist())]
            if docs:
                epoch(own, own_squares, own_t, docs, rate)
                data = np.concatenate([own - shared.value[0], own_squares - shared.value[1], own_t]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([len(docs)], pa.int64()), pa.array([data.tobytes()], pa.binary())], names=["n", "data"])

        found = ready.select("x", "grade", "weight").mapInArrow(run, "n long, data binary").collect()
        total = sum(x.n for x in found)
        moved = [(x.n / total, np.frombuffer(x.data)) for x in found]
        w, squares = (x + sum(s * d[k * len(telling) : (k + 1) * len(telling)] for s, d in moved) for k, x in enumerate((w, squares)))
        t = sum(s * d[2 * len(telling) :] for s, d in moved)
        shared.unpersist()
    numbers.unpersist()
    weights = np.zeros(dims, np.float32)
    weights[telling] = w
    return Model(weights, t)


def _telling_places(rows: DataFrame, sizes: list[int], least_z: float) -> np.ndarray:
    """The telling places of texts (x, grade), ascending. sizes: texts of each grade."""
    counts = rows.select("grade", F.explode("x").alias("at")).groupBy("at").agg(*(F.count_if(F.col("grade") == k).alias(f"n{k}") for k in range(len(sizes))))

    def run(batches):
        for b in batches:
            telling = _telling(np.array([c.to_numpy() for c in b.columns[1:]], np.float64), np.array(sizes, np.float64), least_z)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(telling))], names=["at"])

    return np.array(sorted(r.at for r in counts.mapInArrow(run, "at int").collect()), np.int64)


def _telling(counts: np.ndarray, sizes: np.ndarray, least_z: float) -> np.ndarray:
    """Places whose share of texts differs between two grades by least_z standard errors."""
    out = np.zeros(counts.shape[1], bool)
    for k in range(len(sizes)):
        for j in range(k):
            both = sizes[k] + sizes[j]
            if sizes[k] and sizes[j]:
                p = (counts[k] + counts[j]) / both
                error = np.sqrt(p * (1 - p) * (1 / sizes[k] + 1 / sizes[j])) + 1e-9
                out |= np.abs(counts[k] / sizes[k] - counts[j] / sizes[j]) >= least_z * error
    return out


def _sample(docs: DataFrame, ratings: DataFrame, per_grade: int, id_col: str, text_col: str, grade_col: str) -> DataFrame:
    """text, grade, weight, place: the sampled share of each grade.

    The sample is drawn from the ratings alone, whose rows then number about
    ``per_grade`` for each grade and are broadcast to find their texts.
    """
    rows = ratings.filter(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(grade_col).cast("int").alias("grade"))
    rates = rows.groupBy("grade").agg(F.least(F.lit(1.0), per_grade / F.count(F.lit(1))).alias("rate"))  # a row for each grade
    place = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    few = rows.join(F.broadcast(rates), "grade").filter(place < F.col("rate"))
    turn = F.xxhash64(F.col("_id").cast("string"), F.lit("order"))  # the sampled share differs by grade, so its hash gives no fair order
    few = few.select("_id", "grade", (1 / F.sqrt("rate")).alias("weight"), turn.alias("place"))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    return texts.join(F.broadcast(few), "_id").drop("_id")


def score(docs: DataFrame, model: Model, tail: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade and tail_prob (of a grade of at least ``tail``) of every document."""
    return _scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, tail).select("row.doc_id", "expected_grade", "tail_prob")


def select(docs: DataFrame, model: Model, tail: int, least: float, text_col: str = "text") -> DataFrame:
    """The documents, with their columns, whose probability of a grade of at least ``tail`` is ``least`` or more."""
    return _scored(docs, model, tail, text_col).filter(F.col("tail_prob") >= least).select("row.*")


def _scored(docs: DataFrame, model: Model, tail: int, text_col: str = "text") -> DataFrame:
    """row (the document, whatever its columns are called), expected_grade, tail_prob."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)
    src = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_prob", T.DoubleType())])

    def run(batches):
        m = shared.value
        dims = len(m.weights)
        for b in batches:
            for part in slices(b, b.column(0).field(at)):
                f = np.array([m.weights[features(x or "", dims)].sum() for x in part.column(0).field(at).to_pylist()], np.float64)
                p = m.probabilities(f)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p.sum(1)), pa.array(p[:, tail - 1])], names=schema.names)

    return src.mapInArrow(run, schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id, grade of the rated documents: 0 for poor quality, 1 for toxic ones of good quality, 2 for the rest; of several ratings the least."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.filter("quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))


#: A document is kept if its probability of the highest grade is at least this.
KEEP = 0.5
