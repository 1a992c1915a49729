"""State that lapses and timers: idempotency keys, rejects that are tried again when their wait is over.

Both are ``transformWithState`` processors over RocksDB state, a key at a time; state is kept
by the checkpoint, so a stream that starts again goes on where it was.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..errors import EXECUTION, EngineError

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start within it keep their state in RocksDB, which these processors need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def await_rows(q: StreamingQuery, written: Callable[[], int], want: int) -> None:
    """Stop a stream of timers, which has no end of its own, once its sink holds so many rows, however long that takes; a stream that fails or is stopped before is an error.

    Rows are counted anew only after another batch.
    """
    seen = None
    try:
        while True:
            active, last = q.isActive, q.lastProgress  # in this order: what a stream has done before its end is counted
            if last and last["batchId"] != seen:
                seen = last["batchId"]
                if written() >= want:
                    return
            if not active:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    if q.exception():
        raise q.exception()
    if written() < want:
        raise EngineError(EXECUTION, f"the stream ended before its {want} rows")


class _Once(StatefulProcessor):
    def __init__(self, lives_ms: int):
        self.lives_ms = lives_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "known boolean", self.lives_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.exists()
        for part in rows:
            if not known and len(part):
                known = True
                yield part.head(1)
                self.seen.update((True,))  # it lives from now on

    def close(self) -> None:
        pass


def once(df: DataFrame, keys: list[str], lives_s: float) -> DataFrame:
    """The first row of each key; a key is forgotten ``lives_s`` seconds after its row, and then may come again."""
    return df.groupBy(*keys).transformWithStateInPandas(_Once(int(lives_s * 1000)), df.schema, "Append", "ProcessingTime")


class _Retry(StatefulProcessor):
    def __init__(self, step: Callable[[pd.DataFrame, int], pd.Series], wait_ms: int, most: int, columns: list[str], kinds: T.StructType):
        self.step, self.wait_ms, self.most, self.columns, self.kinds = step, wait_ms, most, columns, kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.letters = handle.getListState("letters", self.kinds)
        self.tried = handle.getValueState("tried", "n int")

    def _out(self, part: pd.DataFrame, attempts: int, state: str) -> pd.DataFrame:
        return part.assign(attempts=attempts, state=state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            good = self.step(part, 1).astype(bool)
            if good.any():
                yield self._out(part[good], 1, "done")
            lost = part[~good]
            if not len(lost):
                continue
            if self.most <= 1:
                yield self._out(lost, 1, "exhausted")
                continue
            self.letters.appendList([tuple(r) for r in lost[self.columns].itertuples(index=False, name=None)])
            if not self.tried.exists():
                self.tried.update((1,))
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempt = self.tried.get()[0] + 1
        part = pd.DataFrame([tuple(r) for r in self.letters.get()], columns=self.columns)
        good = self.step(part, attempt).astype(bool)
        if good.any():
            yield self._out(part[good], attempt, "done")
        lost = part[~good]
        if len(lost) and attempt < self.most:
            self.letters.put([tuple(r) for r in lost[self.columns].itertuples(index=False, name=None)])
            self.tried.update((attempt,))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms * 2 ** (attempt - 1))
            return
        if len(lost):
            yield self._out(lost, attempt, "exhausted")
        self.letters.clear()
        self.tried.clear()

    def close(self) -> None:
        pass


def retried(df: DataFrame, keys: list[str], step: Callable[[pd.DataFrame, int], pd.Series], wait_s: float = 60, most: int = 3) -> DataFrame:
    """df's columns with attempts and state (done, or exhausted after ``most``). step: from rows and the attempt (from 1) to whether each row passes.

    Rows that don't pass wait in the state of their key and come back by a timer; the wait doubles with each attempt. Rows
    that join a key whose letters wait are tried again with them.
    """
    out = T.StructType([*df.schema.fields, T.StructField("attempts", T.IntegerType()), T.StructField("state", T.StringType())])
    return df.groupBy(*keys).transformWithStateInPandas(_Retry(step, int(wait_s * 1000), most, df.columns, df.schema), out, "Append", "ProcessingTime")
