"""Hard negatives of anchors by a table of pivot distances.

The score is the integer inner product of quantised vectors. With M the greatest
norm, a vector x becomes x' = (x, sqrt(M^2 - |x|^2)) and an anchor q becomes
q' = (q, 0): then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so that inner products are
Euclidean distances. The pivot table stores each row's distances to a few pivots.
By the triangle inequality a distance d(q', x') lies between the greatest
|d(q', p) - d(x', p)| and the least d(q', p) + d(x', p): each stored row gives a
bracket [low, high] of its score without its vector being touched.

Rows of one label that are near the same pivot form blocks, whose ranges of
distances give brackets for all of their rows at once; blocks that no anchor of a
few needs are left out whole. Where more than half of a shard's rows stay (vectors without any
structure), the brackets of single rows are skipped: their exact scores cost less.

Anchors are dealt into groups and rows into shards of bounded size, both by a
hash; a task holds one (group, shard) tile. Per anchor it takes

* positives: among rows of the anchor's label those whose high reaches the k-th
  greatest low; and then, with the anchors' positives known,
* negatives: for each positive, among rows of other labels those whose bracket
  meets the positive's window and whose high reaches the n-th greatest low of the
  rows that lie in the window for certain.

The survivors' exact scores decide. The lists of the shards are merged in a tree
of bounded fan-in. Pivots come from a bounded sample (``SAMPLE`` rows of least
hash); they only steer how many rows survive, never the result.

Defined cases: rows whose id, label or vector is null, whose vector is empty or
holds a null or non-finite component (once scaled as well), take no part;
only vectors of one length are compared; scores beyond 64 bits are held at the nearest such number; rows
that repeat an id, a label and a vector count once; an id of several vectors has
lists for each, and rows of the anchor's own id are not its partners; ties go to
the smaller id; fewer partners give shorter lists; a positive without a negative in
its window gives no row; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .exact_topk import FAN_IN, SCALE, TILE_ROWS, quantised, usable

PIVOTS = 16
SAMPLE = 1024
POSITIVES = 5
NEGATIVES = 3
#: Rows in a block of a shard.
BLOCK = 128
#: Anchors that are compared together.
_TOGETHER = 32
WINDOW = (50, 95)
_LISTS = "anchor long, row long, at int, shard int, vec_id long, score long"
_SCHEMA = pa.schema([("anchor", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("shard", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The integer inner products of rows q with rows c, held within 64 bits: in floating point where every partial sum is exact there, else in Python's integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        kind = np.float32 if bound < 2**24 else np.float64
        return (q.astype(kind) @ c.astype(kind).T).astype(np.int64)
    a, b = ([[int(x) for x in row] for row in m] for m in (q, c))
    return np.array([[min(max(sum(x * y for x, y in zip(u, v)), -(2**63)), 2**63 - 1) for v in b] for u in a], np.int64).reshape(len(q), len(c))


def raised(x: np.ndarray, norm2: float) -> np.ndarray:
    """Rows with the coordinate that gives all of them the squared norm ``norm2``."""
    rest = np.maximum(norm2 - np.einsum("ij,ij->i", x, x), 0)
    return np.concatenate([x, np.sqrt(rest)[:, None]], 1)


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances, rows of points by pivots."""
    if not len(pivots):
        return np.zeros((len(points), 0))
    return np.stack([np.sqrt(np.square(points - p).sum(1)) for p in pivots], 1)


def chosen_pivots(sample: np.ndarray, norm2: float, most: int = PIVOTS) -> np.ndarray:
    """Farthest-first points of a sample, raised; none where norms are too great for floating point."""
    if not len(sample) or norm2 > 1e300:
        return np.zeros((0, sample.shape[1] + 1 if sample.ndim == 2 else 1))
    points = raised(sample, norm2)
    at = [0]
    near = distances(points, points[:1])[:, 0]
    while len(at) < most and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, distances(points, points[at[-1] :][:1])[:, 0])
    return points[at]


def bounds(q2: float, norm2: float, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers (low, high) as doubles around the scores at distances from least to most."""
    slack = 1e-9 * (q2 + norm2) + 1e-6  # far more than the rounding of distances
    return np.ceil((q2 + norm2 - most**2) / 2 - slack), np.floor((q2 + norm2 - least**2) / 2 + slack)


def brackets(q2: float, norm2: float, to_q: np.ndarray, to_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of each row's score, from the distances of the anchor and of the rows to the pivots."""
    if not len(to_q):
        return np.full(len(to_rows), -np.inf), np.full(len(to_rows), np.inf)
    return bounds(q2, norm2, np.abs(to_rows - to_q).max(1), (to_rows + to_q).min(1))


class Blocks:
    """Rows of a shard in an order by label, nearest pivot and distance to it, in blocks of one label with the range of their distances to each pivot."""

    def __init__(self, labels: np.ndarray, dist: np.ndarray):
        near = dist.argmin(1) if dist.shape[1] else np.zeros(len(dist), np.int64)
        self.order = np.lexsort((dist.min(1) if dist.shape[1] else near, near, labels))
        labels = labels[self.order]
        new = np.flatnonzero(np.append(True, labels[1:] != labels[:-1])) if len(labels) else np.zeros(0, np.int64)
        ends = np.append(new[1:], len(labels))
        starts = [np.arange(a, b, BLOCK) for a, b in zip(new, ends)]
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.ends = np.append(self.starts[1:], len(labels))[: len(self.starts)]
        self.labels = labels[self.starts]
        self.dist = dist[self.order]
        self.least, self.most = (f.reduceat(self.dist, self.starts) if dist.size else np.zeros((len(self.starts), dist.shape[1])) for f in (np.minimum, np.maximum))

    def brackets(self, q2: float, norm2: float, to_q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) around the scores of all rows of each block."""
        if not len(to_q):
            return np.full(len(self.starts), -np.inf), np.full(len(self.starts), np.inf)
        return bounds(q2, norm2, np.maximum(np.maximum(self.least - to_q, to_q - self.most).max(1), 0), (self.most + to_q).min(1))

    def rows(self, which: np.ndarray) -> np.ndarray:
        """Places in the order of the rows of some blocks."""
        spans = [np.arange(self.starts[i], self.ends[i]) for i in which]
        return np.concatenate(spans) if spans else np.zeros(0, np.int64)

    def kth(self, low: np.ndarray, which: np.ndarray, k: int) -> float:
        """A score that k rows of some blocks reach for certain, one of the anchor's own id set aside."""
        turn = which[np.argsort(-low[which], kind="stable")]
        full = np.flatnonzero(np.cumsum(self.ends[turn] - self.starts[turn]) > k)
        return float(low[turn[full[0]]]) if len(full) else -np.inf


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: the greatest score, then the smallest id."""
    if len(ids) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= edge)
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.lexsort((ids, -score))


def window(score: int, part: tuple[int, int] = WINDOW) -> tuple[int, int]:
    """The least and the greatest score from part[0] to part[1] hundredths of a positive's."""
    return -((-part[0] * score) // 100), part[1] * score // 100


def kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def pivot_table(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int, pivots: int) -> tuple[DataFrame, dict[int, np.ndarray], float]:
    """The stored table (vec_id, label, row, dim, vector, dist), the pivots of each length of vectors, and M squared."""
    kept = rows.filter(usable(vector_col, scale) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    kept = kept.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.transform(vector_col, lambda x: x.cast("double")).alias("vector"))
    kept = written(kept.distinct().withColumn("row", F.xxhash64("vec_id", "label", "vector")).withColumn("dim", F.size("vector")), "pivot-rows")
    norm = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + F.pow(F.abs(x * scale) + 1, F.lit(2.0)))  # no less than that of the floors
    norm2 = kept.agg(F.max(norm)).head()[0] or 0.0
    sample: dict[int, list] = {}
    for r in kept.select("dim", "vector", F.xxhash64("row").alias("h")).orderBy("h").limit(SAMPLE).collect():
        sample.setdefault(r.dim, []).append(r.vector)
    chosen = {dim: chosen_pivots(quantised(np.array(v), scale), norm2, pivots) for dim, v in sample.items()}

    def measured(batches):
        for b in batches:
            dims = b.column(b.schema.get_field_index("dim")).to_numpy()
            vectors = b.column(b.schema.get_field_index("vector"))
            found: list = [[] for _ in range(len(dims))]
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if dim in chosen and len(chosen[dim]):
                    codes = quantised(vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim), scale)
                    for i, d in zip(at, distances(raised(codes, norm2), chosen[dim])):
                        found[i] = d
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.float64()))], names=[*b.schema.names, "dist"])

    schema = T.StructType([*kept.schema.fields, T.StructField("dist", T.ArrayType(T.DoubleType()))])
    return written(kept.mapInArrow(measured, schema), "pivot-table"), chosen, norm2


def tiles(anchors: DataFrame, table: DataFrame, tile_rows: int) -> tuple[DataFrame, int]:
    """Anchors (with their positives) and rows, copied to the tiles that compare them, and the number of shards."""
    groups, shards = (max(1, -(-df.count() // tile_rows)) for df in (anchors, table))
    wanted = "array<struct<at:int,score:bigint>>"

    def side(df: DataFrame, anchor: bool, own: int, copies: int) -> DataFrame:
        mine, other = ("group", "shard") if anchor else ("shard", "group")
        more = F.col("wanted") if anchor and "wanted" in df.columns else F.lit(None).cast(wanted)
        return df.select(
            F.lit(anchor).alias("anchor"), F.pmod(F.xxhash64("row", F.lit(7)), F.lit(own)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other),
            "dim", "vec_id", "row", "label", "vector", "dist", more.alias("wanted"),
        )

    return side(anchors, True, groups, shards).unionByName(side(table, False, shards, groups)), shards


def compared(both: DataFrame, chosen: dict[int, np.ndarray], norm2: float, scale: int, k: int, part: tuple[int, int] | None) -> DataFrame:
    """Each tile's best lists: of the same label without ``part``, else of other labels within each positive's window."""

    def tile(key, t):
        t = t.combine_chunks()
        dim, shard = key[2].as_py(), key[1].as_py()
        is_anchor = t["anchor"].to_numpy()
        codes = quantised(t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), dim), scale)
        ids, nodes = t["vec_id"].to_numpy(), t["row"].to_numpy()
        labels = t["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        pivots = chosen.get(dim, np.zeros((0, dim + 1)))
        dist = t["dist"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), len(pivots))
        wanted = t["wanted"].combine_chunks()
        at = np.flatnonzero(~is_anchor)
        blocks = Blocks(labels[at], dist[at])
        at = at[blocks.order]
        c_ids, c_labels, c_codes, c_dist = ids[at], labels[at], codes[at], blocks.dist
        out: list[tuple] = []

        def keep(a: int, place: int, rows: np.ndarray, score: np.ndarray) -> None:
            for i in best(c_ids[rows], score, k):
                out.append((ids[a], nodes[a], place, shard, c_ids[rows[i]], score[i]))

        anchors = np.flatnonzero(is_anchor)
        if part is not None:
            windows = [[(w["at"], *window(w["score"], part)) for w in x.as_py() or ()] for x in wanted.take(pa.array(anchors))]
            windows = [[w for w in x if w[1] <= w[2]] for x in windows]
        anchors = anchors[np.argsort(labels[anchors], kind="stable")] if part is None else anchors
        to_pivots = distances(np.concatenate([codes[anchors], np.zeros((len(anchors), 1))], 1), pivots)
        for start in range(0, len(anchors), _TOGETHER):
            some = range(start, min(start + _TOGETHER, len(anchors)))
            q = codes[anchors[some]]
            q2 = np.einsum("ij,ij->i", q, q)
            kept = np.zeros(len(blocks.starts), bool)  # blocks that any of these anchors needs
            for i, n in enumerate(some):
                low, high = blocks.brackets(q2[i], norm2, to_pivots[n])
                same = blocks.labels == labels[anchors[n]]
                if part is None:
                    mine = np.flatnonzero(same)
                    kept[mine[high[mine] >= blocks.kth(low, mine, k)]] = True
                elif windows[n]:
                    kept |= ~same & (high >= min(w[1] for w in windows[n])) & (low <= max(w[2] for w in windows[n]))
            rows = blocks.rows(np.flatnonzero(kept))
            if len(rows) < len(at) / 2 and len(rows):  # where most rows stay, their own brackets cost more than their scores
                need = np.zeros(len(rows), bool)
                for i, n in enumerate(some):
                    low, high = brackets(q2[i], norm2, to_pivots[n], c_dist[rows])
                    fit = (c_labels[rows] == labels[anchors[n]]) == (part is None)
                    if part is None:
                        other = fit & (c_ids[rows] != ids[anchors[n]])
                        need |= other & (high >= kth(low[other], k))
                    else:
                        for _, least, most in windows[n]:
                            sure = fit & (low >= least) & (high <= most) & (c_ids[rows] != ids[anchors[n]])
                            need |= fit & (high >= max(least, kth(low[sure], k))) & (low <= most)
                rows = rows[need]
            found = exact_scores(q, c_codes[rows])
            for i, n in enumerate(some):
                a = anchors[n]
                fit = ((c_labels[rows] == labels[a]) == (part is None)) & (c_ids[rows] != ids[a])
                if part is None:
                    keep(a, 0, rows[fit], found[i][fit])
                    continue
                mine, score = rows[fit], found[i][fit]
                for place, least, most in windows[n]:
                    good = (score >= least) & (score <= most)
                    keep(a, place, mine[good], score[good])
        columns = list(zip(*out)) if out else [()] * 6
        return pa.table([pa.array(np.array(c, f.type.to_pandas_dtype())) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)

    return both.groupBy("group", "shard", "dim").applyInArrow(tile, _LISTS)


def merged(lists: DataFrame, shards: int, k: int) -> DataFrame:
    """anchor, row, at, pos (from 0), vec_id, score: the k best of all shards, by a tree of merges of at most FAN_IN lists."""
    keys, entry = ["anchor", "row", "at"], F.struct((-F.col("score")).alias("low"), F.col("vec_id").alias("vec_id"))
    level, width = lists.select(*keys, F.col("shard").alias("node"), entry.alias("entry")), shards
    while True:
        width = -(-width // FAN_IN)
        top = level.groupBy(*keys, F.floor(F.col("node") / FAN_IN).cast("int").alias("node")).agg(F.slice(F.sort_array(F.collect_list("entry")), 1, k).alias("best"))
        if width == 1:
            break
        level = top.select(*keys, "node", F.explode("best").alias("entry"))
    ranked = top.select(*keys, F.posexplode("best").alias("pos", "entry"))
    return ranked.select(*keys, "pos", F.col("entry.vec_id").alias("vec_id"), (-F.col("entry.low")).alias("score"))


def mine(
    rows: DataFrame, anchors: str, positives: int = POSITIVES, negatives: int = NEGATIVES, part: tuple[int, int] = WINDOW, scale: int = SCALE, pivots: int = PIVOTS,
    tile_rows: int = TILE_ROWS, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: a condition on vec_id that says which rows are anchors; a null label takes no part.
    """
    table, chosen, norm2 = pivot_table(rows, id_col, label_col, vector_col, scale, pivots)
    asked = table.filter(anchors)
    both, shards = tiles(asked, table, tile_rows)
    found = written(merged(compared(both, chosen, norm2, scale, positives, None), shards, positives).withColumn("at", F.col("pos").cast("int")).drop("pos"), "pivot-positives")
    wanted = found.groupBy("anchor", "row").agg(F.collect_list(F.struct("at", "score")).alias("wanted"))  # at most ``positives`` entries
    asked = asked.join(wanted, (F.col("vec_id") == F.col("anchor")) & (asked["row"] == wanted["row"])).select(*(asked[c] for c in table.columns), "wanted")
    both, _ = tiles(written(asked, "pivot-asked"), table, tile_rows)
    hard = merged(compared(both, chosen, norm2, scale, negatives, part), shards, negatives)
    hard = hard.select("anchor", "row", "at", (F.col("pos") + 1).cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = found.select("anchor", "row", "at", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(hard, ["anchor", "row", "at"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
