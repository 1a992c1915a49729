"""The pipeline's stages on a small table, each against what it must do."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from weftline.llm import mixing, near_dups, pii

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    before = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    after = corpus_pipeline.quality_stage(spark, before, SF.replace("0.001", "0.01")).cache()
    assert 0 < after.count() < before.count() and after.join(before, columns, "left_anti").count() == 0
    rated = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet").join(before, "doc_id")
    clean = rated.filter("quality = 1 and toxic = 0")
    assert clean.join(after, "doc_id", "left_semi").count() > 0.9 * clean.count()
    poor = rated.filter("quality = 0")
    assert poor.join(after, "doc_id", "left_semi").count() < 0.2 * poor.count()

    before, after = seen["near_dups"]
    classes = {r.doc_id: r.class_id for r in near_dups.near_duplicates(before).collect()}
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(set(classes.values()))

    before, after = seen["pii"]
    assert after.count() == before.count() and pii.find(after).filter(F.size("base") > 0).count() == 0
    assert after.filter("n_chars <> length(text)").count() == 0

    before, after = seen["mixing"]
    taken = {r.doc_id: round(r.taken / r.size) if r.size else 0 for r in mixing.mix(before)[1].collect()}
    times = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert times == {i: n for i, n in taken.items() if n}

    before, after = seen["packing"]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    want = sum(len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect())
    rows = after.collect()
    assert sum(r.length for r in rows) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in rows)


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", None, 0), (2, "", None, "s", 0), (2, "", None, "s", 0), (None, "no id at all", "en", "s", 12), (3, "x " * 40_000, "en", "t", 80_000), (4, "the same text again", "en", "t", 19), (5, "the same text again", "en", "t", 19)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for k, some in enumerate((rows, [])):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{k}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}{name}"))
        assert (docs.count() > 0) == (k == 0)


def test_clashing_names_and_reruns(spark, tmp_path):
    """Columns named like those that the operators make, nulls, ties and repeated rows: each stage keeps the columns and gives its result twice alike."""
    names = ["row", "base", "candidates", "_text", "tail_prob", "expected_grade", "times", "id", "own_id", "class_id", "a", "b"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(1_000_001, None, "en", None, 0), (1_000_002, "", None, "s", 0), (1_000_002, "", None, "s", 0), (None, "mail me at a.b@c.org now", "en", "s", 24), (1_000_003, "x " * 40_000 + "a.b@c.org", "en", "t", 80_009)], docs.schema)
    docs = docs.unionByName(odd)
    for k, c in enumerate(names):
        docs = docs.withColumn(c, F.lit(k))
    docs.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    key = lambda df: sorted(map(str, df.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        one, two = stage(spark, docs, SF), stage(spark, docs.repartition(3), SF)
        assert one.columns == docs.columns and key(one) == key(two), name
        assert one.filter(" or ".join(f"{c} <> {k}" for k, c in enumerate(names))).count() == 0
    redacted = {r.doc_id: r.text for r in corpus_pipeline.pii_stage(spark, docs, SF).filter("doc_id is null or doc_id > 1000000").collect()}
    assert redacted[1_000_001] is None and redacted[1_000_002] == "" and redacted[None] == "mail me at [EMAIL] now" and redacted[1_000_003].endswith("x [EMAIL]")
    kept = [r.doc_id for r in corpus_pipeline.near_dups_stage(spark, docs, SF).collect()]
    assert None in kept and kept.count(1_000_002) == 1 and 1_000_001 in kept
    mixed = {r.doc_id for r in corpus_pipeline.mixing_stage(spark, docs, SF).collect()}
    assert mixed and not mixed & {1_000_001, 1_000_002}
    packed = corpus_pipeline.packing_stage(spark, docs, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed}[1_000_001] == 1 and {r.doc_id: r.n for r in packed}[1_000_002] == 2


def test_run_leaves_only_its_result(spark, tmp_path, monkeypatch):
    import os

    from weftline.llm import common

    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    left = [d for d, _, files in os.walk(tmp_path) if any(f.endswith(".parquet") for f in files)]
    assert len(left) == 1 and left[0].endswith("4-packing")


def test_driver_gets_few_numbers(spark, monkeypatch):
    """The fit sends and takes back the numbers of telling features only, not a vector of all places per round."""
    from weftline.llm import quality

    rows = [(i, ("good words stand here " if i % 2 else "bad words lie there ") + f"w{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sent, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(x) or send(x))
    model = quality.fit(docs, docs.selectExpr("doc_id", "int(doc_id % 2) as grade"), grades=2, rounds=3)
    telling = np.flatnonzero(model.weights)
    assert model.weights.shape == (quality.DIMS,) and 4 <= len(telling) < 100
    rounds = [x for x in sent if isinstance(x, tuple)]
    assert len(rounds) == 3 and all(np.size(part) < 200 for x in rounds for part in x)
    score = {r.doc_id: r.tail_prob for r in quality.score(docs, model, tail=1).collect()}
    assert all((score[i] > 0.5) == bool(i % 2) for i, _ in rows)


def test_plan_of_classes_is_short(spark):
    """What is left to run after the classes are found is a join, not the whole way to them."""
    docs = spark.createDataFrame([(i, f"{'one two three four five six seven eight nine ' * 3}{'x' * (i % 3)}") for i in range(60)], "doc_id long, text string")
    found = near_dups.near_duplicates(docs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 1
    assert {(r.class_id, r.class_size) for r in found.collect()} == {(0, 60)}
