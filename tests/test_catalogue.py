"""Every registered query with SQL against DuckDB on the same tables."""

import datetime
import decimal
import json
import math
from pathlib import Path

import duckdb
import pytest

from weftline.errors import EngineError
from weftline.operators import hl7_structures
from weftline.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.10g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((repr([plain(r[c]) for c in cols]) for r in df.collect()))
    out = duck.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in out.description]
    want = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in out.fetchall())
    assert sorted(names) == cols
    assert got == want


def test_no_python_in_relational_plans(spark):
    for name in ("join_multiway", "agg_group", "lateral_unnest", "win_rank", "etl_normalize", "array_any"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "BatchEval" not in plan


def test_hl7_work_is_dealt_out(spark):
    """A small file is one task's rows, not one task's work, and the rows of an order meet in one exchange."""
    assert catalogue._messages(spark, SF).rdd.getNumPartitions() >= 4
    plan = catalogue.QUERIES["hl7_results"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("collect_list(") == plan.count("partial_collect_list(") + 1 <= 3
    only = hl7_structures.structured(spark.createDataFrame([("MSH|^~\\&|A|B|||1||ACK|9|P\rMSA|AA|1",)], "raw_message string"), xml=False).first()
    assert only.xml is None and json.loads(only.json)["msa"] == {"acknowledgment_code": "AA", "message_control_id": "1"}


def test_a_job_beyond_its_limit_says_so(spark, monkeypatch):
    """20 of the 200 parts are rejects: at that limit nothing is loaded, which is no missing path."""
    monkeypatch.setattr(catalogue, "_JOB", catalogue._JOB.replace('"max_errors": 100000', '"max_errors": 20'))
    with pytest.raises(EngineError, match="20 rejects reach its max_errors"):
        catalogue.QUERIES["job_from_config"](spark, SF)
