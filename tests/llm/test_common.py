"""The shared folder, in sessions with and without the setting."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from weftline.llm import common

UNSET = """
from pyspark.sql import SparkSession
from weftline.llm import common
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
first = common.shared_dir(spark)
assert first == common.shared_dir(spark) == spark.sparkContext.getCheckpointDir()
assert common.written(spark.range(3), "unset").count() == 3
print("passed")
"""


def test_the_setting_names_the_folder(spark):
    assert common.shared_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def test_a_local_session_without_the_setting(tmp_path):
    env = dict(os.environ, SPARK_CONF_DIR=str(tmp_path), TMPDIR=str(tmp_path), PYTHONPATH=str(Path(__file__).resolve().parents[2]))
    got = subprocess.run([sys.executable, "-c", UNSET], env=env, capture_output=True, text=True, timeout=120)
    assert got.stdout.strip().endswith("passed"), got.stderr[-2000:]


class _Cluster:
    """Stands for a session on a cluster without the setting."""

    master = "spark://host:7077"
    conf = {}

    @property
    def sparkContext(self):  # noqa: N802
        return self

    def getCheckpointDir(self):  # noqa: N802
        return None


def test_a_cluster_must_name_a_folder():
    with pytest.raises(ValueError, match="shared folder"):
        common.shared_dir(_Cluster())


def test_bounded_cache():
    made = []
    kept = common.Kept(lambda k: made.append(k) or k * 2, 3)
    assert [kept[k] for k in (1, 2, 3, 4, 1, 1, 2)] == [2, 4, 6, 8, 2, 2, 4] and made == [1, 2, 3, 4]
    assert [kept[k] for k in range(100)] == [2 * k for k in range(100)] and len(kept) <= 3 and len(kept.older) <= 3
    one = common.worker_cache("one", dict)
    assert common.worker_cache("one", dict) is one
    common.worker_cache("two", dict)
    assert common.worker_cache("one", dict) is not one


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    texts = ["x" * n for n in (10, 0, 900, 5, 5000, 1, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = [p.column(0).to_pylist() for p in common.slices(batch, 0, most_bytes=1000)]
    assert [x for p in parts for x in p] == texts and all(len(p) == 1 or sum(len(x or "") for x in p) <= 1000 for p in parts)


def test_spans_of_many_matches(spark):
    from pyspark.sql import functions as F

    from weftline.llm import spans

    n = 40_000
    df = spark.createDataFrame([(1, "é1 22 " * n), (2, ""), (3, "none")], "i int, text string")
    got = {r.i: r.s for r in df.select("i", spans.find_all(F.col("text"), "[0-9]+").alias("s")).collect()}
    assert len(got[1]) == 2 * n and [(s.start, s.end, s.text) for s in got[1][-2:]] == [(6 * n - 5, 6 * n - 4, "1"), (6 * n - 3, 6 * n - 1, "22")]
    assert got[2] == [] and got[3] == []
    df = spark.range(1).select(spans.distinct_sorted(F.expr("transform(array(3, 1, 3, 2, 1), x -> struct(x as x))")).alias("a"))
    assert [r.x for r in df.first().a] == [1, 2, 3]


def test_runs_side_by_side_keep_their_own_tables(spark):
    """What one run deletes at its end is its own, whatever another thread writes or discards meanwhile."""
    import threading

    inside, over, got = threading.Event(), threading.Event(), []

    def other():
        with common.work(spark):
            mine = common.written(spark.range(7), "other")
            inside.set()
            over.wait(60)
            got.append(mine.count())

    t = threading.Thread(target=other)
    before = common.written(spark.range(2), "before")
    with common.work(spark) as at:
        first = common.written(spark.range(3), "first")
        t.start()
        assert inside.wait(60)
        common.discard(spark, before)
        kept = common.written(spark.range(4), "kept")
        assert first.count() == 3 and kept.count() == 4
    fs = spark._jvm.org.apache.hadoop.fs.Path(at)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
    over.set()
    t.join(60)
    assert got == [7]
