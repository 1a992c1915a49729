"""Near duplicates by Order MinHash and banded alignment.

Words are lower-cased runs of letters and digits; a text's k-mers are its runs
of k words, each labelled with its occurrence number, so that no label repeats
in a text. For each of ``bands`` hash functions a sketch takes the ``minima``
labels of least hash and keeps them in text order: two texts share a sketch with
probability about s ** minima, where s is the Jaccard similarity of their labels
and the order agrees. A text of at most ``SHORT`` labels has more keys: all its
labels, and all but each one, so that short texts that differ in one label meet
for certain. Texts of one key form a bucket.

First each member of a bucket is paired with the bucket's anchor, the member
whose id comes first in an order that is the same in every bucket. Verified pairs
join their texts to classes. Then the buckets that still hold several classes are
compared whole, in tiles of bounded size: a tile holds two blocks of a bucket and
takes the exact number of differing parity bits of every two members (a text's
parity has a bit for each residue of its labels, so that two parities differ in
no more bits than the label sets differ in labels). Only pairs of two classes whose lengths
and parities allow the similarity leave the tile, in the first band that they
share, and are verified too. What moves is a bucket's members, not its pairs.

A pair is verified by alignment, on 64-bit labels made anew from the words
themselves, which are stored compressed. As labels are unique, the longest common
subsequence of two texts is the longest increasing run of matched places, taken
within the band that an alignment of the wanted similarity can't leave. The
similarity is m / (a + b - m) for m aligned k-mers: the Jaccard similarity of
k-mers, less what is out of order. Verified pairs are links; classes are their
connected components.

At similarity 0.8, three minima and 16 bands miss a pair's buckets about once in
100,000, with 10 labels once in 20,000; every pair that does share a bucket is
compared or already of one class.

Equal texts are one text throughout, and their copies are expanded only at the
end. Links, components and sketches stay in Spark.

Defined cases: a null text differs from every other text; a text without words is
linked only to its equals; one of fewer than k words is a single k-mer; a row with a
null doc_id takes no part and gets a null class; rows that repeat a doc_id are
one document, whose texts (null too) are of one class; very long texts are
compared whole; ties have no say in links, and other columns are ignored,
whatever their names; no rows give no rows. A class is named by its least doc_id.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Kept, held, part_of, slices, spread, worker_cache, written
from .parity_join import components

WORDS = 5
BANDS = 16
MINIMA = 3
SIMILARITY = 0.8
#: Longs of a parity, a power of two.
PARITY = 16
#: Texts of at most so many labels have keys of all their labels but one.
SHORT = 9
#: Members in a block of a bucket; a tile compares two blocks.
BLOCK = 1024
#: Parts into which the texts of a class are dealt when they get its size.
_SALTS = 256
#: Hashes of words that a worker keeps, twice.
MOST_WORDS = 150_000
#: Labels that a verifying task keeps.
MOST_LABELS = 2_000_000
_WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _word_hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def hashes(words: list[str]) -> np.ndarray:
    """64 bits for each word."""
    known = worker_cache("near_dups", lambda: Kept(_word_hash, MOST_WORDS))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def word_hashes(text: str) -> np.ndarray:
    """64 bits for each word of a text."""
    return hashes(words_of(text))


def packed(words: Iterable[str]) -> bytes:
    """The words themselves, compressed."""
    return zlib.compress(" ".join(words).encode(), 1)


def unpacked(data: bytes) -> list[str]:
    return zlib.decompress(data).decode().split()


def labels(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """The occurrence-labelled k-mers of a word sequence, in text order, as 64-bit hashes."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = (h + words[j : n - k + 1 + j].astype(np.uint64) + np.uint64(1)) * _ODD
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    if first.all():
        return mix(h)
    place = np.arange(len(s))
    number = np.empty(len(s), np.uint64)
    number[order] = (place - np.maximum.accumulate(np.where(first, place, 0))).astype(np.uint64)
    return mix(h + number * np.uint64(0xD6E8FEB86659FD93))


def _folded(seed: int, found: np.ndarray) -> np.uint64:
    """One key for some labels in their order."""
    key = np.uint64(seed)
    for x in found:
        key = (key ^ x) * _ODD
        key ^= key >> np.uint64(32)
    return key


def sketches(found: np.ndarray, bands: int = BANDS, minima: int = MINIMA) -> np.ndarray:
    """One 64-bit key for each band and, of a short text, those of all its labels and of all but one; none for a text without words."""
    n = len(found)
    if not n:
        return np.zeros(0, np.int64)
    out = []
    for b in range(bands):
        h = mix(found ^ mix(np.array([b + 1], np.uint64) * _ODD))
        low = np.sort(np.argpartition(h, minima)[:minima]) if n > minima else np.arange(n)
        out.append(_folded(b, h[low]))
    if n <= SHORT:
        out.append(_folded(bands, found))
        out += [_folded(bands, np.delete(found, i)) for i in range(n) if n > 1]
    return np.array(out, np.uint64).view(np.int64)


def parity(found: np.ndarray) -> np.ndarray:
    """PARITY longs: for each residue, whether an odd number of labels has it."""
    odd = np.bincount((found & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> float:
    """m / (len(a) + len(b) - m) for the m labels on the longest common subsequence within the band; 0 if that can't reach ``similarity``."""
    total = len(a) + len(b)
    least = similarity / (1 + similarity) * total
    if min(len(a), len(b)) < least - 1e-9:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= total - 2 * least + 1
    i, j = i[near], j[near]
    if len(i) < least - 1e-9:
        return 0.0
    j = j[np.argsort(i)]
    m = len(j)
    if not (np.diff(j) > 0).all():
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            if at == len(tails):
                tails.append(x)
            else:
                tails[at] = x
        m = len(tails)
    return m / (total - m)


def signatures(docs: DataFrame, k: int, bands: int, minima: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, a, b (128 bits of the text's hash), keys, n (k-mers), bits (their parity), words (packed) of every document; written."""
    text = F.col(text_col)
    src = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.when(text.isNull(), F.xxhash64(F.lit(2), id_col)).otherwise(F.xxhash64(text)).alias("a"),
        F.when(text.isNull(), F.xxhash64(F.lit(3), id_col)).otherwise(F.xxhash64(F.lit(1), text)).alias("b"),
        F.coalesce(text, F.lit("")).alias("text"),
    )
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([src.schema["doc_id"], src.schema["a"], src.schema["b"], T.StructField("keys", longs), T.StructField("n", T.LongType()), T.StructField("bits", longs), T.StructField("words", T.BinaryType())])

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch, 3):
                    words = [words_of(t) for t in part.column(3).to_pylist()]
                    found = [labels(hashes(w), k) for w in words]
                    keys = [sketches(x, bands, minima) for x in found]
                    cols = [part.column(0), part.column(1), part.column(2), pa.array(keys, pa.list_(pa.int64())), pa.array(map(len, found), pa.int64()), pa.array(map(parity, found), pa.list_(pa.int64())), pa.array(map(packed, words), pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return written(src.mapInArrow(run, schema), "near-signatures")


def _members(texts: DataFrame, bands: int, *more: str) -> DataFrame:
    """band, key, rep and more columns for every key of every text; the additional keys of short texts share a band of their own."""
    return texts.select("rep", *more, F.posexplode("keys").alias("at", "key")).select(F.least("at", F.lit(bands)).alias("band"), "key", "rep", *more)


def candidates(texts: DataFrame, bands: int = BANDS) -> DataFrame:
    """Distinct pairs (p, q), p < q, of each bucket's anchor with its members."""
    members = _members(texts, bands).withColumn("_part", part_of("rep"))
    turn = F.struct(F.xxhash64("rep").alias("h"), F.col("rep").alias("rep"))
    buckets = members.groupBy("band", "key").agg(F.min(turn).alias("anchor"), F.count(F.lit(1)).alias("size"), held()).filter("size > 1")
    anchors = spread(buckets.select("band", "key", F.col("anchor.rep").alias("anchor"), "_held"))
    met = members.join(anchors, ["band", "key", "_part"]).filter("rep <> anchor")
    return met.select(F.least("rep", "anchor").alias("p"), F.greatest("rep", "anchor").alias("q")).distinct()


def tile_pairs(rep: np.ndarray, own: np.ndarray, n: np.ndarray, bits: np.ndarray, earlier: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (p, q), p < q, of a left and a right row whose classes differ, whose lengths and parities allow the similarity and that share no earlier key."""
    at, to = np.flatnonzero(left), np.flatnonzero(right)
    out: list[np.ndarray] = []
    for start in range(0, len(at), 256):
        i = at[start : start + 256]
        total = n[i][:, None] + n[to][None, :]
        good = (own[i][:, None] != own[to][None, :]) & (np.minimum(n[i][:, None], n[to][None, :]) >= similarity * np.maximum(n[i][:, None], n[to][None, :]) - 1e-9)
        differ = np.zeros(total.shape, np.uint16)
        for k in range(bits.shape[1]):
            differ += np.bitwise_count(bits[i, k][:, None] ^ bits[to, k][None, :])
        x, y = np.nonzero(good & (differ <= total * ((1 - similarity) / (1 + similarity)) + 1e-9))
        out.append(np.stack([i[x], to[y]]))
    x, y = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
    fresh = (rep[x] != rep[y]) & ~(earlier[x] == earlier[y]).any(1)
    p, q = rep[x[fresh]], rep[y[fresh]]
    return np.minimum(p, q), np.maximum(p, q)


def open_pairs(texts: DataFrame, classes: DataFrame, similarity: float, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (p, q), p < q, of one bucket and two classes whose lengths and parities allow the similarity.

    classes: node, class; a text without one is its own. A bucket of m members is
    cut into m / block blocks by a hash; a member goes to the tiles of its block
    with every block, so that a large bucket is many tasks' work and a task holds
    two blocks.
    """
    own = texts.join(classes.withColumnRenamed("node", "rep"), "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    members = _members(own, bands, "class").withColumn("_part", part_of("rep"))
    buckets = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.min("class").alias("lo"), F.max("class").alias("hi"), held())
    buckets = buckets.filter("lo <> hi and size > 2").select("band", "key", F.ceil(F.col("size") / block).cast("int").alias("blocks"), "_held")  # of two members one is the anchor
    met = members.join(spread(buckets), ["band", "key", "_part"]).select("band", "key", "rep", "class", "blocks")
    met = met.join(texts.select("rep", "n", "bits", F.slice("keys", 1, bands).alias("keys")), "rep")
    met = met.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    one = met.filter("blocks = 1").withColumn("other", F.lit(0))
    met = one.unionByName(met.filter("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    met = met.select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "class", "n", "bits", "keys")

    def tile(key, t):
        band, _, i, j = (x.as_py() for x in key)
        t = t.combine_chunks()
        rep, own, n, at = (t[c].to_numpy() for c in ("rep", "class", "n", "block"))
        bits, keys = (t[c].combine_chunks().flatten().to_numpy().reshape(len(rep), -1) for c in ("bits", "keys"))
        p, q = tile_pairs(rep, own, n, bits.view(np.uint64), keys[:, :band], at == i, at == j, similarity)
        if i == j:  # every pair was met from both sides
            p, q = np.unique(np.stack([p, q]), axis=1)
        return pa.table({"p": p, "q": q}, schema=pa.schema([("p", pa.int64()), ("q", pa.int64())]))

    return met.groupBy("band", "key", "i", "j").applyInArrow(tile, "p long, q long").distinct()


def verify(pairs: DataFrame, sequences: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs whose alignment reaches the similarity: p, q, similarity. sequences: rep, n, bits, words."""
    one, two = (sequences.select(F.col("rep").alias(e), F.col("n").alias(f"{e}_n"), F.col("bits").alias(f"{e}_bits"), F.col("words").alias(f"{e}_words")) for e in "pq")
    both = pairs.join(one, "p").join(two, "q")
    fits = F.least("p_n", "q_n") >= similarity * F.greatest("p_n", "q_n") - 1e-9
    differ = reduce(lambda a, b: a + b, (F.bit_count(F.get("p_bits", F.lit(i)).bitwiseXOR(F.get("q_bits", F.lit(i)))) for i in range(PARITY)))
    fits &= differ <= (F.col("p_n") + F.col("q_n")) * ((1 - similarity) / (1 + similarity)) + 1e-9

    def run(batches):
        known: dict[bytes, np.ndarray] = {}  # a text has many pairs in a row, and a group's texts have them with one another
        held = 0

        def labels_of(words: pa.BinaryScalar) -> np.ndarray:
            nonlocal held
            data = words.as_py()
            if data not in known:
                if held > MOST_LABELS:
                    known.clear()
                    held = 0
                known[data] = labels(hashes(unpacked(data)), k)
                held += len(known[data]) + len(data) // 8
            return known[data]

        with np.errstate(over="ignore"):
            for b in batches:
                found = [aligned(labels_of(x), labels_of(y), similarity) for x, y in zip(b.column(2), b.column(3))]
                good = pa.array([s >= similarity - 1e-9 for s in found], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.float64())], names=["p", "q", "similarity"]).filter(good)

    return both.filter(fits).select("p", "q", "p_words", "q_words").mapInArrow(run, "p long, q long, similarity double")


def near_duplicates(
    docs: DataFrame, k: int = WORDS, bands: int = BANDS, minima: int = MINIMA, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, class_id, class_size, kept (whether it is its class's least doc_id) of every row; class_size counts rows."""
    found = signatures(docs, k, bands, minima, id_col, text_col)
    texts = found.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("copies"))
    texts = written(texts, "near-texts")  # grouped once: each later plan is smaller by this step
    reps = texts.select("a", "b", "rep", "copies")
    repeated = found.groupBy("doc_id").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).filter("lo <> hi").select("doc_id")  # ids of several texts
    own = found.select("doc_id", "a", "b").join(repeated, "doc_id", "left_semi").join(reps, ["a", "b"]).select(F.col("doc_id").alias("p"), F.col("rep").alias("q")).filter("p <> q")
    sequences = found.select(F.col("doc_id").alias("rep"), "n", "bits", "words")
    links = written(verify(candidates(texts, bands), sequences, k, similarity).select("p", "q").unionByName(own), "near-links")
    classes = components(links)
    more = written(verify(open_pairs(texts, classes, similarity, bands), sequences, k, similarity).select("p", "q"), "near-links")
    if not more.isEmpty():
        classes = components(more, classes)
    named = reps.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("a", "b", "copies", F.coalesce("class", "rep").alias("class_id"), F.pmod(F.xxhash64("a"), F.lit(_SALTS)).alias("salt"))
    parts = named.groupBy("class_id", "salt").agg(F.sum("copies").alias("copies"))  # at most _SALTS rows for each class
    sizes = parts.groupBy("class_id").agg(F.sum("copies").alias("class_size"), F.collect_list("salt").alias("salts"))
    named = named.join(sizes.select("class_id", "class_size", F.explode("salts").alias("salt")), ["class_id", "salt"])
    named = written(named.select("a", "b", "class_id", "class_size"), "near-classes")  # the rest of the plan is one join, whatever classes took
    of_text = found.select("doc_id", "a", "b").join(named, ["a", "b"]).select("doc_id", "class_id", "class_size")
    rest = docs.filter(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return of_text.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each class, its least doc_id; rows with a null doc_id stay, of rows that repeat one the least by a hash of the row stays (columns of maps and variants have no say)."""
    kept = near_duplicates(docs, id_col=id_col, **options).filter("kept and doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    plain = [f.name for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    row, order = F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct(F.xxhash64(*(F.col(f"`{c}`") for c in plain)), F.xxhash64(F.lit(1), *(F.col(f"`{c}`") for c in plain)))
    one = docs.join(kept, id_col, "left_semi").groupBy(id_col).agg(F.min_by(row, order).alias("row")).select("row.*")
    return one.unionByName(docs.filter(F.col(id_col).isNull()))
