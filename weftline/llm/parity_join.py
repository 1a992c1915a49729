"""Set-similarity classes of documents by parity sketches.

A document's set is its distinct runs of k words, as 64-bit tokens. Two sets of
sizes a and b link when 100 * intersection >= percent * union; then they differ
in at most floor((a + b) * (100 - percent) / (100 + percent)) tokens.

Sizes fall into bands that grow by ``RATIO``. Within a band all sketches have the
same m segments of 64 bits: a token is hashed into one segment by exclusive or, so two
sketches differ in no more segments than their sets differ in
tokens. With D the most that two sets of the band may differ in, m is D + 1 and
a fifth as many more. A set's key for a segment is the segment's whole value. Linked
sets share at least m - D keys. Keys have one order for all sets, those of the most
tokens first (equal keys are of equal tokens); a set gives its first D + 1 keys only. The first key that two linked
sets share is among those of both, else one of them would have D + 1 earlier keys
that the other lacks. So no link is lost, and empty or nearly empty segments,
which unlike sets share, make no keys. A set is in its own band, and in the next
one as well if that may hold greater partners.

Sets of one key form a bucket. Each member is first paired with the bucket's
least member; verified pairs join sets into classes. Buckets that still hold
several classes are compared whole, in tiles of two blocks of bounded size: a tile takes
the Hamming distance of wider parities (which bounds the difference from
below in the same way) of all its pairs, and only pairs of two classes whose sizes and
distance allow a link leave it, to be verified too. Verification intersects the
tokens themselves, made anew from the stored words.

Equal sets are one set throughout. Links, classes and keys stay in Spark, joins
on keys that many rows may share are spread, and nothing is sampled or capped.

Defined cases: a null text is an empty one; a text without words has the empty set, which
is linked with nothing, not even another; one of fewer than k words is a single run; texts
of any length are taken whole; rows that repeat a doc_id are documents of their own (the class of
one may differ from the other's); a row with a null doc_id links nothing, its component_id is
null; ties have no say; no rows give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Kept, copies_for, discard, part_of, slices, spread_join, worker_cache, written

WORDS = 4
PERCENT = 85
#: Growth of the bands of sizes.
RATIO = 1.35
#: One more segment for so many that are needed.
SPARE = 5
#: Members in a block of a bucket; a tile compares two blocks.
BLOCK = 1024
#: Longs of the least and the widest parity, powers of two.
LEAST_PARITY, MOST_PARITY = 2, 512
#: Hashes of words that a worker keeps, twice.
MOST_WORDS = 150_000
#: Tokens that a verifying task keeps.
MOST_TOKENS = 2_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _word_hash(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


def words_of(text: bytes) -> list[bytes]:
    """Runs of what is not ASCII white space, A-Z lower-cased (both of which bytes do by themselves)."""
    return text.lower().split()


def tokens(words: list[bytes], k: int = WORDS) -> np.ndarray:
    """The distinct runs of k words as sorted 64-bit hashes; all words as one run if they are fewer."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    known = worker_cache("parity_join", lambda: Kept(_word_hash, MOST_WORDS))
    w = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    k = min(k, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = (h + w[j : n - k + 1 + j]) * _ODD
        h ^= h >> _U(29)
    return np.unique(mix(h))


def most_different(total: int, percent: int) -> int:
    """How many tokens two linked sets of ``total`` tokens together may differ in."""
    return total * (100 - percent) // (100 + percent)


def bands(percent: int, ratio: float = RATIO):
    """The bands' least sizes, without end."""
    low = 1
    while True:
        yield low
        low = max(100 * low // percent + 1, int(low * ratio))


class Bands:
    """Least sizes of the bands as far as they were asked for."""

    def __init__(self, percent: int):
        self.percent, self.lows, self.more = percent, [], bands(percent)

    def of(self, size: int) -> list[tuple[int, int]]:
        """(band, its D) for each band in which a set of a size looks for partners of that band's sizes."""
        while len(self.lows) < 3 or self.lows[-2] <= size:
            self.lows.append(next(self.more))
        band = int(np.searchsorted(self.lows, size, side="right")) - 1
        while len(self.lows) < band + 3:
            self.lows.append(next(self.more))
        found = [band] + [band + 1] * (100 * size // self.percent >= self.lows[band + 1])
        return [(b, most_different(2 * (self.lows[b + 1] - 1), self.percent)) for b in found]


def segments(found: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, number of tokens) of the m segments of a sketch: a segment is the exclusive or of its tokens' 64 random bits."""
    at = (((found >> _U(32)) * _U(m)) >> _U(32)).astype(np.intp)
    out = np.zeros(m, np.uint64)
    np.bitwise_xor.at(out, at, mix(found ^ _ODD))
    return out, np.bincount(at, minlength=m)


def keys_of(found: np.ndarray, at: Bands) -> np.ndarray:
    """The keys under which a set meets its partners; none for a set that only equal ones can link with."""
    out = [np.zeros(0, np.uint64)]
    if len(found):
        for band, most in at.of(len(found)):
            if not most:
                continue
            m = most + 1 + -(-(most + 1) // SPARE)
            value, size = segments(found, m)
            key = mix(value + mix(np.arange(m, dtype=np.uint64) + _U(band << 32)))
            order = np.lexsort((key, -size))
            out.append(key[order[: most + 1]])
    return np.concatenate(out).view(np.int64)


def parity(found: np.ndarray) -> np.ndarray:
    """Longs with, for each residue of the tokens, whether an odd number of tokens has it; at least a bit a token."""
    longs = LEAST_PARITY
    while longs * 64 < len(found) and longs < MOST_PARITY:
        longs *= 2
    odd = np.bincount((found & _U(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def folded(bits: list[np.ndarray]) -> np.ndarray:
    """Parities of several widths at the least of them: residues fold by exclusive or."""
    least = min(map(len, bits))
    return np.stack([np.bitwise_xor.reduce(b.reshape(-1, least), 0) for b in bits]).view(np.uint64)


def described(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """row (a number of its own), doc_id, a, b (128 bits of the set), n, keys, bits, words of every row; written."""
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    longs = T.ArrayType(T.LongType())
    made = [("a", T.LongType()), ("b", T.LongType()), ("n", T.LongType()), ("keys", longs), ("bits", longs), ("words", T.BinaryType())]
    schema = T.StructType([src.schema["row"], src.schema["doc_id"], *(T.StructField(*f) for f in made)])

    def run(batches):
        at = Bands(percent)
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch, 2):
                    words = [words_of(t) for t in part.column(2).to_pylist()]
                    found = [tokens(w, k) for w in words]
                    names = np.array([np.frombuffer(blake2b(x.tobytes(), digest_size=16).digest(), np.int64) for x in found]).reshape(-1, 2)
                    longs = pa.list_(pa.int64())
                    cols = [part.column(0), part.column(1), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(map(len, found), pa.int64()), pa.array([keys_of(x, at) for x in found], longs)]
                    cols += [pa.array(map(parity, found), longs), pa.array([zlib.compress(b" ".join(w), 1) for w in words], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return written(src.mapInArrow(run, schema), "parity-sets")


def tile_pairs(rep: np.ndarray, own: np.ndarray, n: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (p, q), p < q, of a left and a right set of two classes whose sizes and parities allow a link."""
    at, to = np.flatnonzero(left), np.flatnonzero(right)
    out: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
    for start in range(0, len(at), 256):
        i = at[start : start + 256]
        a, b = n[i][:, None], n[to][None, :]
        good = (own[i][:, None] != own[to][None, :]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
        x, y = np.nonzero(good)
        step = (1 << 20) // bits.shape[1]
        for some in range(0, len(x), step):
            u, v = i[x[some : some + step]], to[y[some : some + step]]
            differ = np.bitwise_count(bits[u] ^ bits[v]).sum(1, dtype=np.int64)
            near = differ * (100 + percent) <= (n[u] + n[v]) * (100 - percent)
            out.append(np.stack([rep[u[near]], rep[v[near]]]))
    p, q = np.concatenate(out, 1)
    return np.minimum(p, q), np.maximum(p, q)


def open_pairs(met: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (p, q), p < q, of one bucket and two classes whose sizes and parities allow a link. met: key, rep; sets: rep, n, bits."""
    own = met.join(classes.withColumnRenamed("node", "rep"), "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    buckets = own.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("class").alias("lo"), F.max("class").alias("hi"))
    buckets = buckets.filter("lo <> hi and size > 2").select("key", F.ceil(F.col("size") / block).cast("int").alias("blocks"))  # of two members one is the anchor
    own = written(spread_join(own, buckets, "key", "rep"), "parity-open")
    own = own.join(sets, "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "class", "n", "bits")

    def tile(key, t):
        _, i, j = (x.as_py() for x in key)
        t = t.combine_chunks()
        rep, own, n, at = (t[c].to_numpy() for c in ("rep", "class", "n", "block"))
        p, q = tile_pairs(rep, own, n, folded(t["bits"].to_numpy()), at == i, at == j, percent)
        if i == j:  # every pair was met from both sides
            p, q = np.unique(np.stack([p, q]), axis=1)
        return pa.table({"p": p, "q": q}, schema=pa.schema([("p", pa.int64()), ("q", pa.int64())]))

    return own.groupBy("key", "i", "j").applyInArrow(tile, "p long, q long").distinct()


def meetings(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, rep of every member of a bucket of several; distinct pairs p, q of each bucket's anchor and its members). members: rep, key.

    Members are ranged by key and then by rep, so a key of many members is several partitions' work, and read in order: the
    first of a key is its anchor. A key may go on in the next partition: each partition tells its first and its last key, with their
    anchors, and the anchors of one key are paired as well.
    """
    kind = "key long, rep long, anchor long, n long, edge boolean"
    schema = pa.schema([("key", pa.int64()), ("rep", pa.int64()), ("anchor", pa.int64()), ("n", pa.int64()), ("edge", pa.bool_())])

    def rows(key, rep, anchor, n, edge):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(rep, pa.int64()), pa.array(anchor, pa.int64()), pa.array(n, pa.int64()), pa.array(np.full(len(key), edge))], schema=schema)

    def run(batches):
        first = last = None  # the partition's first key with its anchor and size, and the one that is going on
        for b in batches:
            if not b.num_rows:
                continue
            key, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.flatnonzero(np.append(last is None or key[0] != last[0], key[1:] != key[:-1]))
            if last and first is None and len(new):
                first = last
            size = np.diff(np.append(new, len(key)))
            head = new[0] if len(new) else len(key)  # rows that go on with the last batch's key
            if head:
                own = rep[:head] if last[2] > 1 else np.append(last[1], rep[:head])
                yield rows(np.full(len(own), last[0]), own, np.full(len(own), last[1]), np.zeros(len(own), np.int64), False)
                last = (last[0], last[1], last[2] + int(head))
                first = last if first and first[0] == last[0] else first
            if len(new):
                several = np.repeat(size > 1, size)
                yield rows(key[head:][several], rep[head:][several], np.repeat(rep[new], size)[several], np.zeros(int(several.sum()), np.int64), False)
                if first is None and len(new) > 1:
                    first = (int(key[new[0]]), int(rep[new[0]]), int(size[0]))
                last = (int(key[new[-1]]), int(rep[new[-1]]), int(size[-1]))
        ends = [x for x in ((first, last) if first else (last,)) if x]
        if ends:
            yield rows([x[0] for x in ends], [x[1] for x in ends], [x[1] for x in ends], [x[2] for x in ends], True)

    ordered = members.select("key", "rep").repartitionByRange("key", "rep").sortWithinPartitions("key", "rep")
    found = written(ordered.mapInArrow(run, kind), "parity-met")
    inner, edges = found.filter("not edge"), found.filter("edge")
    cut = edges.groupBy("key").agg(F.min("rep").alias("whole"), F.count(F.lit(1)).alias("pieces")).filter("pieces > 1").drop("pieces")
    cut = edges.join(cut, "key")  # two rows a partition at most
    met = inner.select("key", "rep").unionByName(cut.filter("n = 1").select("key", "rep"))
    pairs = inner.select("anchor", "rep").union(cut.select("whole", "rep")).filter("anchor <> rep").distinct()
    return met, pairs.select(F.col("anchor").alias("p"), F.col("rep").alias("q"))


def plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and parities allow a link. sets: rep, n, bits."""
    pairs = written(pairs.withColumn("p_part", part_of("q")).withColumn("q_part", part_of("p")), "parity-candidates")
    one, two = (copies_for(pairs, sets.select(F.col("rep").alias(e), F.col("n").alias(f"{e}_n"), F.col("bits").alias(f"{e}_bits")), [e], f"{e}_part") for e in "pq")
    both = pairs.join(two, ["q", "q_part"]).join(one, ["p", "p_part"]).filter(100 * F.least("p_n", "q_n") >= percent * F.greatest("p_n", "q_n"))

    def run(batches):
        for b in batches:
            a, c = (x.to_numpy(zero_copy_only=False) for x in (b.column(2), b.column(3)))
            bits = [folded([x, y]) for x, y in zip(a, c)]
            differ = np.array([int(np.bitwise_count(x[0] ^ x[1]).sum()) for x in bits], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["p", "q"]).filter(pa.array(differ * (100 + percent) <= b.column(4).to_numpy() * (100 - percent)))

    return both.select("p", "q", "p_bits", "q_bits", (F.col("p_n") + F.col("q_n")).alias("total")).mapInArrow(run, "p long, q long")


def verify(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (p, q) that link, with their intersection; written. sets: rep, words."""
    pairs = written(pairs.withColumn("p_part", part_of("q")).withColumn("q_part", part_of("p")), "parity-pairs")
    wanted = pairs.select(F.explode(F.array("p", "q")).alias("rep")).distinct()
    sets = written(sets.join(wanted, "rep", "left_semi"), "parity-asked")
    one, two = (copies_for(pairs, sets.select(F.col("rep").alias(e), F.col("words").alias(f"{e}_words")), [e], f"{e}_part") for e in "pq")
    both = pairs.join(two, ["q", "q_part"]).join(one, ["p", "p_part"])  # the parts are known from the pairs alone: no text is read to find them

    def run(batches):
        known: dict[bytes, np.ndarray] = {}  # a text has many pairs in a row
        held = 0

        def tokens_of(words: pa.BinaryScalar) -> np.ndarray:
            nonlocal held
            data = words.as_py()
            if data not in known:
                if held > MOST_TOKENS:
                    known.clear()
                    held = 0
                known[data] = tokens(zlib.decompress(data).split(), k)
                held += len(known[data]) + len(data) // 8
            return known[data]

        with np.errstate(over="ignore"):
            for b in batches:
                sides = [(tokens_of(x), tokens_of(y)) for x, y in zip(b.column(2), b.column(3))]
                common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in sides], np.int64)
                total = np.array([len(x) + len(y) for x, y in sides], np.int64)
                good = pa.array(100 * common >= percent * (total - common), pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(common)], names=["p", "q", "common"]).filter(good)

    out = written(both.select("p", "q", "p_words", "q_words").mapInArrow(run, "p long, q long, common long"), "parity-links")
    for table in (pairs, sets):
        discard(out.sparkSession, table)
    return out


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, class: the least node reachable by links p, q, from classes that are known.

    Each round a node takes the least class of its neighbours, and then that class's own class. Rounds are written.
    With known classes, links become the few different pairs of classes first.
    """
    spark = links.sparkSession
    if known is not None:
        ends = links.select("p", "q")
        for end in ("p", "q"):
            ends = ends.join(known.select(F.col("node").alias(end), F.col("class").alias(f"{end}_class")), end, "left")
        ends = ends.select(F.coalesce("p_class", "p").alias("p"), F.coalesce("q_class", "q").alias("q")).filter("p <> q")
        over = components(ends.distinct()).select(F.col("node").alias("class"), F.col("class").alias("new"))
        nodes = known.select("node", "class").union(over.select("class", "class")).distinct()  # texts that had no class are their own
        return written(spread_join(nodes, over, "class", "node", "left").select("node", F.coalesce("new", "class").alias("class")), "parity-classes")
    edges = written(links.select("p", "q").union(links.select("q", "p")).distinct(), "parity-edges")
    old = written(edges.groupBy(F.col("p").alias("node")).agg(F.least(F.min("q"), F.col("node")).alias("class")), "parity-labels")
    while True:
        label = old.select("node", "class")
        near = spread_join(edges, label.select(F.col("node").alias("q"), F.col("class").alias("near")), "q", "p").groupBy(F.col("p").alias("node")).agg(F.min("near").alias("near"))
        lower = label.join(near, "node").select("node", F.col("class").alias("old"), F.least("class", "near").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("class").alias("lowest"))
        new = written(spread_join(lower, jump, "low", "node").select("node", "old", F.least("low", "lowest").alias("class")), "parity-labels")
        done = new.filter("old <> class").isEmpty()
        discard(spark, old)
        old = new
        if done:
            discard(spark, edges)
            return new.select("node", "class")


def similarity_classes(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles (the set's size), component_id (the least doc_id reachable by links), copies (rows of an equal set) of every row."""
    found = described(docs, k, percent, id_col, text_col)
    takes_part = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    some = found.filter(takes_part).select("row", "doc_id", "n", "a", "b")
    groups = some.groupBy("a", "b").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    alone = found.filter(~takes_part).select("row", "doc_id", "n", F.col("row").alias("rep"), F.col("doc_id").alias("least"), F.lit(1).cast("long").alias("copies"))
    owner = written(spread_join(some, groups, ["a", "b"], "row").select(*alone.columns).unionByName(alone), "parity-owners")
    members = found.filter(takes_part).select("row", "keys").join(owner.filter("row <> rep").select("row"), "row", "left_anti")
    met, pairs = meetings(members.select(F.col("row").alias("rep"), F.explode("keys").alias("key")))
    sequences = found.select(F.col("row").alias("rep"), "words")
    sketches = found.select(F.col("row").alias("rep"), "n", "bits")
    pairs = plausible(pairs, sketches, percent)
    links = verify(pairs, sequences, k, percent)
    classes = components(links)
    more = verify(open_pairs(met, classes, sketches, percent, block), sequences, k, percent)
    if not more.isEmpty():
        classes = components(more, classes)
    named = classes.join(owner.filter("row = rep").select(F.col("rep").alias("node"), "least"), "node")
    lowest = named.groupBy("class").agg(F.min("least").alias("component_id"))
    named = written(spread_join(classes, lowest, "class", "node").select(F.col("node").alias("rep"), "component_id"), "parity-classes")
    return spread_join(owner, named, "rep", "row", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "least").alias("component_id"), "copies")
