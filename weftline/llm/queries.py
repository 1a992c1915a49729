"""The registered queries ``opN_<name>`` over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_ids, exact_topk, hard_negatives, language, licences, matroska, mixing, near_dups, packing, parity_join, pii, quality, resampling
from .common import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL if there is one."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 byte-level ids; one row per piece."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


@query("op4_binary_ids")
def op4_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as Elias-Fano segments in doc_id order and read back."""
    segments = binary_ids.write_segments(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return binary_ids.read_documents(segments, with_ids=False)


@query(
    "op1_exact_topk",
    """WITH q AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
      FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
)
def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows by integer inner product of every row whose vec_id is divisible by 50; rows that repeat one count once."""
    corpus = table(spark, sf_dir, "embeddings")
    return exact_topk.top_k(corpus, corpus.filter("vec_id % 50 = 0"))


@query(
    "op10_mixing",
    r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix') AS h FROM documents),
    s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM d GROUP BY source),
    s1 AS (SELECT *, CASE idx % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM s0),
    s2 AS (SELECT *, (sum(source_size) OVER () - sum(cap) OVER p + cap) / CAST(sum(w) OVER () - sum(w) OVER p + w AS DOUBLE) AS lam,
        source_size / CAST(w AS DOUBLE) AS ratio FROM s1 WINDOW p AS (ORDER BY source_size / CAST(w AS DOUBLE), idx ROWS UNBOUNDED PRECEDING)),
    s3 AS (SELECT *, least(CAST(cap AS DOUBLE), w * (SELECT arg_min(lam, (ratio, idx)) FROM s2 WHERE lam * w <= cap)) AS target FROM s2),
    s AS (SELECT source, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) // source_size END AS passes,
        CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) % source_size END AS rest FROM s3),
    p AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS pos FROM d)
    SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(passes * size + greatest(0, least(pos + size, rest) - pos) AS BIGINT) AS taken
    FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source""",
)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all documents takes of each."""
    _, rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("op3_matroska")
def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as 8-bit samples in a Matroska file, a column of a Parquet table, whose bytes are read back from there and parsed."""
    return matroska.read_media(written(matroska.text_media(table(spark, sf_dir, "documents")), "media"))


@query("op8_licences")
def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License words and labels of every whole text."""
    return licences.labelled(licences.scan(table(spark, sf_dir, "documents")))


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: base spans by count and hash, and all spans."""
    found = pii.find(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == pii.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *map(n, pii.BASE), F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from two of three folds."""
    docs = table(spark, sf_dir, "documents")
    tables = language.fit(docs.filter(~language.held_out(F.col("doc_id"))))
    found = language.predict(docs, tables, with_spans=False)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op9_near_dups")
def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document: five-word k-mers, similarity 0.8."""
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document, and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.grades_of(table(spark, sf_dir, "labels")), grades=3)
    return quality.score(docs, model, tail=2).withColumn("keep", F.col("tail_prob") >= quality.KEEP)


_CRC = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT)) AS t),
    d AS (SELECT 1 AS kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    n AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT unnest(w) AS w FROM d UNION SELECT DISTINCT unnest(w) FROM b)),
    k AS (SELECT w, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
        lambda c, x: xor(c >> 8, list_extract(t, xor(c & 255, x) + 1)), 4294967295), 4294967295) % 10000 AS bucket FROM n, crc)"""


@query(
    "op13_resampling",
    f"""WITH {_CRC},
    dw AS (SELECT doc_id, unnest(w) AS w FROM d), bw AS (SELECT unnest(w) AS w FROM b),
    s AS (SELECT bucket, count(*) AS s FROM dw JOIN k USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN k USING (w) GROUP BY bucket),
    tot AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS ss, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS tt),
    g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000)))) AS gain FROM s LEFT JOIN t ON s.bucket = t.bucket, tot),
    m AS (SELECT doc_id, floor(sum(gain) / count(*)) AS weight FROM dw JOIN k USING (w) JOIN g USING (bucket) GROUP BY doc_id),
    r AS (SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
        FROM d LEFT JOIN m ON d.doc_id = m.doc_id),
    o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS pos, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM r)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND pos <= 10 * n // 100 THEN pos END AS rank FROM o""",
)
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents of 20 words at least, drawn towards the benchmark's words."""
    scored = resampling.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return resampling.drawn(scored).select("doc_id", "n_features", "weight", "score", "rank")


@query(
    "op12_hard_negatives",
    """WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
    n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
        CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three hardest negatives below each of the five nearest of its label, for every row whose vec_id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), "vec_id % 50 = 0")


@query(
    "op11_ngram_join",
    r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w),
    n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s), t AS (SELECT doc_id, unnest(s) AS x FROM s),
    c AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS common FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT p, q FROM c JOIN n a ON p = a.doc_id JOIN n b ON q = b.doc_id WHERE 100 * common >= 85 * (a.n + b.n - common)),
    e AS (SELECT p, q FROM l UNION ALL SELECT q, p FROM l),
    r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.q, r.c FROM r JOIN e ON r.doc_id = e.p AND r.c < e.q)
    SELECT n.doc_id, n.n AS n_shingles, min(c) AS component_id FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY 1, 2""",
)
def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document under links of four-word shingles at Jaccard 0.85."""
    return parity_join.similarity_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
