"""Shared helpers: the shared work folder, written tables, text columns."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent a temporary folder serves, but only for a
    session within one process: on a cluster that would lose data, so it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    # a running session doesn't take the setting, but its context takes a folder
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='weftline-')}")
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back.

    This cuts the lineage and makes one pass over the input serve several
    later plans; a lost executor costs nothing that was written.
    """
    spark = df.sparkSession
    path = f"{_WORK.get() or shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


#: The folder of the run that is under way in this thread, and the path of each written DataFrame.
_WORK: ContextVar[str | None] = ContextVar("work", default=None)
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder by the Hadoop file system that it is on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(spark: SparkSession, table: DataFrame) -> None:
    """Delete a table that ``written`` returned; no DataFrame may read it any more."""
    delete(spark, _PATHS.pop(table))


@contextmanager
def work(spark: SparkSession):
    """A folder for all that ``written`` writes within it (in this thread), deleted at its end: by then, results must be written elsewhere.

    Runs side by side have folders of their own, so none deletes what another reads.
    """
    path = f"{shared_dir(spark)}/weftline-work-{uuid.uuid4().hex}"
    before = _WORK.set(path)
    try:
        yield path
    finally:
        _WORK.reset(before)
        delete(spark, path)


def part_of(*by: str) -> Column:
    """One of 64 parts by a hash of columns."""
    return F.pmod(F.xxhash64(*by, F.lit(11)), F.lit(64)).cast("int")


def copies_for(many: DataFrame, one: DataFrame, keys: list[str], part: str) -> DataFrame:
    """The rows of one (a row a key), each copied to those parts of its key that hold rows of many: a partial aggregate into a mask of 64 bits says which."""
    return spread(one.join(many.groupBy(*keys).agg(held(part)), keys), part)


def held(part: str = "_part") -> Column:
    """An aggregate: a bit for each part that holds rows."""
    return F.bit_or(F.expr(f"shiftleft(1L, {part})")).alias("_held")


def spread(one: DataFrame, part: str = "_part") -> DataFrame:
    """Rows with the bits of ``held``, each copied to the parts that they name."""
    parts = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("_held", i) == 1)
    return one.withColumn(part, F.explode(parts)).drop("_held")


def spread_join(many: DataFrame, one: DataFrame, on: str | list[str], by: str | list[str], how: str = "inner") -> DataFrame:
    """many joined with one, which has a row a key, so that a key of any share of many's rows is not one task's work.

    Rows of many are dealt by a hash of their columns ``by`` into 64 parts of their key. many is read twice.
    """
    keys = [on] if isinstance(on, str) else on
    rows = many.withColumn("_part", part_of(*([by] if isinstance(by, str) else by)))
    return rows.join(copies_for(rows, one, keys, "_part"), [*keys, "_part"], how).drop("_part")


def slices(batch: pa.RecordBatch, text: int | pa.Array, most_bytes: int = 4 << 20, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch of about ``most_bytes`` of text (one row at least) and at most ``most_rows`` rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text) if isinstance(text, int) else text), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        to = min(max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right"))), at + most_rows)
        yield batch.slice(at, to - at)
        at = to


def text_or_empty(col: str | Column = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


class Kept(dict):
    """Values of a function, kept in a Python worker: those used last, at most ``2 * most``."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:  # a full generation becomes the older one; what is used of it comes back
            self.older = dict(self)
            self.clear()
        value = self.older[key] if key in self.older else self.make(key)
        self[key] = value
        return value


_KEPT: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], object]):
    """What this Python worker keeps between tasks under a name. Workers are reused by later stages, so what another operator kept is let go."""
    found = _KEPT.get(name)
    if found is None:
        _KEPT.clear()
        found = _KEPT[name] = make()
    return found
