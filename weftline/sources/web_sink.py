"""Rows posted to a web service by the executors, with retries; what the service does not take are rejects."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.etl import REJECT


@dataclass(frozen=True)
class Target:
    """payload: the column whose text is the body; without it a row's JSON is, or with ``many`` > 1 an array of so many rows' JSON. wait_s doubles with each retry, unless the
    service says Retry-After."""

    url: str
    method: str = "POST"
    headers: dict[str, str] = field(default_factory=dict)
    payload: str | None = None
    many: int = 1
    retries: int = 3
    wait_s: float = 0.2
    timeout_s: float = 30


def send(target: Target, body: bytes, key: str) -> tuple[int, int, str | None]:
    """(attempts, last status or 0, reason of failure). The key tells the service what it has had already."""
    headers = {"Content-Type": "application/json", "Idempotency-Key": key} | target.headers
    status, reason = 0, None
    for attempt in range(1, target.retries + 2):
        wait = target.wait_s * 2 ** (attempt - 1)
        try:
            with urllib.request.urlopen(urllib.request.Request(target.url, body, headers, method=target.method), timeout=target.timeout_s) as answer:
                answer.read()
                return attempt, answer.status, None
        except urllib.error.HTTPError as e:
            status, reason = e.code, f"{e.code} {e.reason}"
            if e.code != 429 and e.code < 500:
                break
            later = e.headers.get("Retry-After", "")
            wait = float(later) if later.isdigit() else wait
        except OSError as e:  # the connection
            status, reason = 0, str(e)
        if attempt <= target.retries:
            time.sleep(wait)
    return attempt, status, reason


def post(df: DataFrame, target: Target, outcomes_to: str) -> tuple[int, DataFrame]:
    """Send every row of df; (rows that the service took, rejects of the rest).

    Partitions post side by side. Each outcome is written to ``outcomes_to`` (Parquet: key, record, attempts, status, reason) as it is known, so
    the rejects are a table however many they are, and reading them sends nothing again. A task that Spark runs again sends its
    rows again under the same Idempotency-Key, a hash of the row.
    """
    columns = [f"`{c}`" for c in df.columns]
    record = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    body = F.coalesce(F.col(f"`{target.payload}`").cast("string"), F.lit("")) if target.payload else record
    rows = df.select(F.sha2(record, 256).alias("key"), record.alias("record"), body.alias("body"))
    schema = pa.schema([("key", pa.string()), ("record", pa.string()), ("attempts", pa.int32()), ("status", pa.int32()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, target.many):
                keys, records, bodies = (batch.column(i).slice(k, target.many).to_pylist() for i in range(3))
                text = bodies[0] if target.many == 1 else f"[{','.join(bodies)}]"
                key = keys[0] if target.many == 1 else uuid.uuid5(uuid.NAMESPACE_URL, "".join(keys)).hex
                attempts, status, reason = send(target, text.encode(), key)
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(records), pa.array([attempts] * n, pa.int32()), pa.array([status] * n, pa.int32()), pa.array([reason] * n, pa.string())], schema=schema)

    rows.mapInArrow(run, "key string, record string, attempts int, status int, reason string").write.mode("overwrite").parquet(outcomes_to)
    found = df.sparkSession.read.parquet(outcomes_to)
    return found.filter("reason is null").count(), found.filter("reason is not null").select(F.lit("post").alias("step"), "reason", "record").select(*REJECT.names)
