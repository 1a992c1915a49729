"""Exact top-k search by tiled integer matrix products.

Queries are dealt into groups and corpus vectors into shards, both by a hash and
of bounded size. Each (group, shard) tile is one task's matrix
product, whose k best per query survive; the lists of a query are then merged
in a tree of bounded fan-in. Work is queries x vectors, as an exact search
needs; what moves is vectors x groups + queries x shards, least when groups and
shards are of one size. Tiles hold a fixed number of rows at any input size.

Defined cases: a vector that is null or empty, or holds a null, a non-finite
component or one that is not finite once scaled, takes no part; a score beyond 64
bits is held at the nearest 64-bit number; only vectors of one length are compared; rows that
repeat an id and a vector count once, as a query and as a candidate; an id of several vectors is
one query, whose list may hold a candidate once for each of them; rows of a query's own id are not its
candidates; ties go to the smaller id; a null id takes no part; other columns
are ignored; fewer than k candidates give a shorter list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 256
TILE_ROWS = 16384
FAN_IN = 16
_SUB = 256
_TILE = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def quantised(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component, x as double."""
    return np.floor(scale * vectors.astype(np.float64))


def best_in_tile(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of each query's k best; ties to the smaller id.

    Products are taken in floating point where every partial sum is an exact
    integer there, else in Python's integers, held within 64 bits.
    """
    order = np.argsort(ids, kind="stable")
    ids, c = ids[order], c[order]
    n = len(ids)
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    kind = np.float32 if bound < 2**24 else np.float64 if bound * max(n, 1) < 2**52 else object
    if kind is object:
        q, c = (np.array([[int(x) for x in row] for row in m], dtype=object) for m in (q, c))
    else:
        q, c = q.astype(kind), c.astype(kind)
    out: list[tuple] = []
    for at in range(0, len(q_ids), _SUB):
        own = q_ids[at : at + _SUB]
        score = q[at : at + _SUB] @ c.T
        if kind is object:
            score = np.clip(score, -(2**63), 2**63 - 1)
            for i, row in enumerate(score):
                best = sorted((-s, j) for j, s in enumerate(row) if ids[j] != own[i])[:k]
                out += [(own[i], ids[j], -s) for s, j in best]
            continue
        key = score.astype(np.float64) * n + np.arange(n - 1, -1, -1)  # unique: the score, then the smaller id
        key[own[:, None] == ids[None, :]] = -np.inf
        best = np.argpartition(key, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), key.shape)
        rows = np.repeat(np.arange(len(own)), best.shape[1])
        cols = best.ravel()
        good = np.isfinite(key[rows, cols])
        rows, cols = rows[good], cols[good]
        out += zip(own[rows], ids[cols], score[rows, cols].astype(np.int64))
    a, b, s = zip(*out) if out else ((), (), ())
    return np.array(a, np.int64), np.array(b, np.int64), np.array([int(x) for x in s], np.int64)


def usable(vector: str | Column, scale: int = SCALE) -> Column:
    """Whether a vector takes part."""
    v = F.col(vector) if isinstance(vector, str) else vector
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(good, F.lit(False))


def top_k(
    corpus: DataFrame, queries: DataFrame, k: int = 5, scale: int = SCALE, tile_rows: int = TILE_ROWS, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Each query's k best rows of the corpus: query_id, rank (from 1), vec_id, score."""

    def side(df: DataFrame, query: bool, groups: int, copies: int) -> DataFrame:
        """Rows with the tile's two numbers; each row is copied to the tiles of the other side."""
        kept = df.filter(usable(vector_col, scale) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).distinct()
        own = F.pmod(F.xxhash64("id", "vector"), F.lit(groups)).cast("int")  # by both, so that an id of many vectors is spread
        other = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        return kept.select(F.lit(query).alias("query"), own.alias("group" if query else "shard"), other.alias("shard" if query else "group"), F.size("vector").alias("dim"), "id", "vector")

    groups, shards = (max(1, -(-df.select(id_col).count() // tile_rows)) for df in (queries, corpus))
    both = side(queries, True, groups, shards).unionByName(side(corpus, False, shards, groups))

    def tile(key, t):
        t = t.combine_chunks()
        dim = key[2].as_py()
        is_query = t["query"].to_numpy()
        ids = t["id"].to_numpy()
        codes = quantised(t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim), scale)
        sides = [x for mask in (is_query, ~is_query) for x in (ids[mask], codes[mask])]
        a, b, s = best_in_tile(*sides, k)
        return pa.table({"query_id": a, "shard": np.full(len(a), key[1].as_py(), np.int32), "vec_id": b, "score": s}, schema=pa.schema([("query_id", pa.int64()), ("shard", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())]))

    lists = both.groupBy("group", "shard", "dim").applyInArrow(tile, _TILE)
    entry = F.struct((-F.col("score")).alias("low"), F.col("vec_id").alias("vec_id"))
    merged, width = lists.select("query_id", F.col("shard").alias("node"), entry.alias("entry")), shards
    while True:  # each level merges at most FAN_IN lists of at most k entries
        width = -(-width // FAN_IN)
        level = merged.groupBy("query_id", F.floor(F.col("node") / FAN_IN).cast("int").alias("node")).agg(F.slice(F.sort_array(F.collect_list("entry")), 1, k).alias("best"))
        if width == 1:
            break
        merged = level.select("query_id", "node", F.explode("best").alias("entry"))
    ranked = level.select("query_id", F.posexplode("best").alias("pos", "entry"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("entry.vec_id").alias("vec_id"), (-F.col("entry.low")).alias("score"))
