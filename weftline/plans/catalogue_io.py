"""More registered queries: access rules, databases, nested messages, jobs that resume, state with timers, schemas that change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, checks, etl, hl7_structures
from ..streaming import state, windows
from .catalogue import _database, _events, _messages, _scratch, dealt, query, table
from .engine import Engine
from .jobs import Job, run


def _crm(spark: SparkSession, d: str) -> Engine:
    """customer and orders as a service that hides balances and total prices."""
    e = Engine(spark)
    e.services.register_tables("crm", {"customer": table(spark, d, "customer"), "orders": table(spark, d, "orders")})
    e.services.protect("crm", access.Rules(allow_tables=("customer", "orders"), deny_fields=("customer.c_acctbal", "o_totalprice")))
    return e


@query("access_alias", "SELECT c_custkey, c_name AS who FROM {customer} WHERE c_acctbal > 0")
def access_alias(spark: SparkSession, d: str) -> DataFrame:
    """A hidden column may decide on rows; neither it nor what is made of it, under any name, is shown."""
    return _crm(spark, d).query("SELECT u.c_custkey, u.c_name AS who, u.c_acctbal AS b, u.c_acctbal * 2 AS twice FROM read_service('crm.customer') u WHERE u.c_acctbal > 0")


@query("access_subquery", "SELECT c_custkey, (SELECT count(*) FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 100000) AS n FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders})")
def access_subquery(spark: SparkSession, d: str) -> DataFrame:
    return _crm(spark, d).query(
        """WITH o AS (SELECT o_custkey AS k, o_totalprice AS p FROM read_service('crm.orders'))
        SELECT c.c_custkey, (SELECT count(*) FROM o WHERE o.k = c.c_custkey AND o.p > 100000) AS n, (SELECT max(p) FROM o WHERE o.k = c.c_custkey) AS top
        FROM read_service('crm.customer') c WHERE c.c_custkey IN (SELECT k FROM o)"""
    ).drop("top")


@query("access_star_join", "SELECT o_orderkey, o_orderstatus, c_name, c_mktsegment FROM {orders} JOIN {customer} ON c_custkey = o_custkey")
def access_star_join(spark: SparkSession, d: str) -> DataFrame:
    found = _crm(spark, d).query("SELECT o.*, c.* FROM read_service('crm.orders') o JOIN read_service('crm.customer') c ON c.c_custkey = o.o_custkey")
    assert not {"c_acctbal", "o_totalprice"} & set(found.columns)
    return found.select("o_orderkey", "o_orderstatus", "c_name", "c_mktsegment")


@query("access_database", "SELECT n_nationkey AS k, n_regionkey AS r FROM {nation} WHERE n_regionkey <> 1")
def access_database(spark: SparkSession, d: str) -> DataFrame:
    """A database's own query under rules: analysed by Spark, run by the database."""
    e = _database(spark, d)
    e.services.protect("db", access.Rules(deny_fields=("nation.n_name",)))
    return e.query('-- integration: db\nSELECT n."n_nationkey" AS "k", n."n_name" AS "name", n."n_regionkey" AS "r" FROM nation n WHERE n."n_regionkey" <> 1')


@query("jdbc_parts", "SELECT c_custkey, c_nationkey FROM {customer}")
def jdbc_parts(spark: SparkSession, d: str) -> DataFrame:
    """A table of a database by even ranges of a key that repeats."""
    e = _database(spark, d)
    e.services.write(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "db.customer")
    return e.services.read_in_parts("db.customer", "c_nationkey", 4)


@query("jdbc_tables", """SELECT 'NATION' AS "table", unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS "column" FROM (SELECT count(*) FROM {nation})""")
def jdbc_tables(spark: SparkSession, d: str) -> DataFrame:
    return _database(spark, d).services.tables("db").select("table", "column")


@query("jdbc_batches_once", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM {events} GROUP BY event_type")
def jdbc_batches_once(spark: SparkSession, d: str) -> DataFrame:
    """Each batch of a stream merged into a database twice, as after a failure; it counts once."""
    s = _database(spark, d).services
    s.execute("db", 'CREATE TABLE totals ("event_type" VARCHAR(40), "n" BIGINT)')

    def put(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
        for factor in (1, 100):  # a second time with other values: nothing of it may be seen
            s.merge_once(counts.withColumn("n", F.col("n") * factor), "db.totals", "event_type", "events", number)

    _events(spark, d).writeStream.foreachBatch(put).option("checkpointLocation", _scratch(spark, "once")).trigger(availableNow=True).start().awaitTermination()
    return s.read("db.totals")


@query("hl7_admissions", "SELECT c_custkey AS id, 'ADT_A01' AS structure, CAST(c_custkey AS VARCHAR) AS patient, CAST(c_nationkey AS VARCHAR) AS second, 'W' AS ward, '' AS missing FROM {customer}")
def hl7_admissions(spark: SparkSession, d: str) -> DataFrame:
    """Admissions nested by their structure, with repetitions and named components, whatever a message's signs."""
    messages = _messages(spark, d).withColumn("raw_message", F.replace("raw_message", F.lit("\rPID"), F.concat(F.lit("\rEVN"), F.substring("raw_message", 4, 1), F.lit("A01\rPID"))))
    at = lambda p: F.get_json_object("json", p)
    return hl7_structures.structured(messages, xml=False).select(
        "id", "structure", at("$.pid.patient_id[0].id").alias("patient"), at("$.pid.patient_id[1].id").alias("second"), at("$.pv1.assigned_location.point_of_care").alias("ward"), F.array_join("missing", ",").alias("missing"),
    )


@query("hl7_results", "SELECT l_orderkey AS id, CAST(count(*) AS BIGINT) AS observations, CAST(sum(l_quantity) AS DOUBLE) AS total, CAST(count(DISTINCT l_returnflag) AS INTEGER) AS orders FROM {lineitem} GROUP BY l_orderkey")
def hl7_results(spark: SparkSession, d: str) -> DataFrame:
    """Results: per order a group for each return flag, which holds its observations and their notes."""
    line = F.concat(F.lit("OBX|1|NM|Q^Quantity||"), F.col("l_quantity").cast("double").cast("string"), F.lit("|kg\rNTE|1||line "), F.col("l_linenumber"))
    rows = dealt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), "l_orderkey")  # an order's rows meet once, before any text is made
    of_order = rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_returnflag").alias("flag"), line.alias("line")))).alias("lines"))
    begins = lambda x, i: (i == 0) | ~x["flag"].eqNullSafe(F.get("lines", i - 1)["flag"])
    text = F.array_join(F.transform("lines", lambda x, i: F.when(begins(x, i), F.concat(F.lit("OBR|1|||"), x["flag"], F.lit("\r"), x["line"])).otherwise(x["line"])), "\r")
    messages = of_order.select("id", F.concat(F.lit("MSH|^~\\&|LAB|H|E|H|2024||ORU^R01|"), "id", F.lit("|P|2.5\rPID|1||"), "id", F.lit("\r"), text).alias("raw_message"))
    kind = "struct<patient_result:array<struct<order_observation:array<struct<observation:array<struct<obx:struct<value:string>, nte:array<struct<comment:string>>>>>>>>>"
    found = hl7_structures.structured(messages, xml=False).select("id", F.from_json("json", kind)["patient_result"][0]["order_observation"].alias("o"))
    values = F.flatten(F.transform("o", lambda x: F.filter(x["observation"], lambda y: F.size(y["nte"]) == 1)))
    return found.select(
        "id", F.size(values).cast("long").alias("observations"), F.aggregate(values, F.lit(0.0), lambda acc, y: acc + y["obx"]["value"].cast("double")).alias("total"), F.size("o").alias("orders"),
    )


@query(
    "job_resumed",
    """SELECT 'all' AS at, count(*) AS n FROM {part} WHERE p_partkey % 10 <> 9 UNION ALL SELECT 'large', count(*) FROM {part} WHERE p_partkey % 10 <> 9 AND p_size > 25
    UNION ALL SELECT 'dead', count(*) FROM {part} WHERE p_partkey % 10 = 9 UNION ALL SELECT 'loaded', count(*) + count(*) FILTER (WHERE p_size > 25) FROM {part} WHERE p_partkey % 10 <> 9""",
)
def job_resumed(spark: SparkSession, d: str) -> DataFrame:
    """A run with two destinations, started three times under one id: its rows are there once."""
    at = _scratch(spark, "resumed")
    job = Job([table(spark, d, "part")], destinations=[f"{at}/all", {"path": f"{at}/large", "filter": "p_size > 25"}], rules=[checks.Rule("p_partkey", "regex", pattern="[0-8]$")], max_errors=0)
    for _ in range(3):
        s = run(spark, job, f"{at}/dead", f"{at}/state", "r1")
    one = lambda name: spark.read.parquet(f"{at}/{name}").agg(F.lit(name).alias("at"), F.count(F.lit(1)).alias("n"))
    return one("all").union(one("large")).union(one("dead")).union(spark.createDataFrame([("loaded", s.loaded)], "at string, n long"))


@query("stream_breaker_holds", "SELECT 'good' AS at, count(*) AS n FROM {events} WHERE event_id % 5 <> 0 UNION ALL SELECT 'dead', count(*) FROM {events} WHERE event_id % 5 = 0")
def stream_breaker_holds(spark: SparkSession, d: str) -> DataFrame:
    """A load whose rate of rejects stays below its breaker's."""
    at = _scratch(spark, "breaker")
    events = _events(spark, d).select(F.when(F.col("event_id") % 5 == 0, "none").otherwise(F.col("event_id").cast("string")).alias("x"))
    windows.load(events, lambda b: etl.normalize(b, {"x": "int"}), f"{at}/good", f"{at}/dead", f"{at}/state", breaker=(25.0, 10)).awaitTermination()
    return spark.read.parquet(f"{at}/good").agg(F.lit("good").alias("at"), F.count(F.lit(1)).alias("n")).union(spark.read.parquet(f"{at}/dead").agg(F.lit("dead"), F.count(F.lit(1))))


@query("stream_retried", "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, CAST(least(s_suppkey % 4 + 1, 3) AS INTEGER) AS attempts, CASE WHEN s_suppkey % 4 < 3 THEN 'done' ELSE 'exhausted' END AS state FROM {supplier}")
def stream_retried(spark: SparkSession, d: str) -> DataFrame:
    """Rejects that wait in state and come back by timers until they pass or their attempts are used up."""
    suppliers = table(spark, d, "supplier").schema
    arriving = windows.arriving(spark, d, suppliers, pattern="supplier.parquet").select(F.col("s_suppkey").cast("long").alias("s_suppkey"))
    # many rows wait under one key, with one timer: a key for each would be calls of its own for every row
    arriving = arriving.withColumn("part", F.pmod(F.xxhash64("s_suppkey"), F.lit(1024)).cast("int"))
    out = state.retried(arriving, ["part"], lambda rows, attempt: rows["s_suppkey"] % 4 < attempt, wait_s=0.1, most=3).drop("part")
    to = _scratch(spark, "out")
    with state.rocksdb(spark):
        q = out.writeStream.format("parquet").option("path", to).option("checkpointLocation", _scratch(spark, "state")).start()
    state.await_rows(q, lambda: spark.read.schema(out.schema).parquet(to).count(), table(spark, d, "supplier").count())
    return spark.read.schema(out.schema).parquet(to)


@query("schema_evolved", "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, NULL AS p_size, CAST(NULL AS DOUBLE) AS weight FROM {part} WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, NULL, CAST(p_size AS VARCHAR), p_size / 2.0 FROM {part} WHERE p_partkey % 2 = 1")
def schema_evolved(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two versions of a table under one schema without loss: added, removed and widened columns."""
    part = table(spark, d, "part")
    old = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").cast("int").alias("p_partkey"), "p_name")
    new = part.filter("p_partkey % 2 = 1").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_size").cast("string").alias("p_size"), (F.col("p_size") / 2.0).alias("weight"))
    return checks.evolved(old, new).select("p_partkey", "p_name", "p_size", "weight")


@query("schema_changes", "SELECT path, change, CAST(rows AS BIGINT) AS rows FROM (VALUES ('p_partkey', 'widened'), ('p_name', 'removed'), ('weight', 'added')) v(path, change), (SELECT count(*) AS rows FROM {part})")
def schema_changes(spark: SparkSession, d: str) -> DataFrame:
    """What a new version of a table changes, and how many rows it has."""
    part = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("p_partkey"), "p_name")
    new = part.select(F.col("p_partkey").cast("long").alias("p_partkey"), F.lit(1.5).alias("weight"))
    return checks.difference(part, new).filter("change not in ('nullable', 'required')").select("path", "change").crossJoin(F.broadcast(new.agg(F.count(F.lit(1)).alias("rows"))))


def _text(name: str, spark_sql: str, sql: str) -> None:
    from .catalogue import text

    text(name, spark_sql, sql)


_text(
    "sql_numbers_in_text",
    "SELECT c_mktsegment, SUM(x) AS t, MIN(x) AS lo, MAX(x) AS hi, SUM(c_name) AS none, MAX(c_name) AS nil FROM (SELECT c_mktsegment, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'no number' ELSE CAST(c_custkey AS STRING) END AS x FROM {customer}) v GROUP BY c_mktsegment",
    "SELECT c_mktsegment, sum(c_custkey)::DOUBLE AS t, min(c_custkey)::DOUBLE AS lo, max(c_custkey)::DOUBLE AS hi, 0.0::DOUBLE AS none, NULL::DOUBLE AS nil FROM {customer} WHERE c_custkey % 3 <> 0 GROUP BY c_mktsegment",
)
_text(
    "sql_dates_in_text",
    "SELECT o_orderkey, YEAR(t) AS y, MONTH(t) AS m -- it's text\nFROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN date_format(o_orderdate, 'yyyy/MM/dd') WHEN o_orderkey % 3 = 1 THEN date_format(o_orderdate, 'MM/dd/yyyy') ELSE date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') END AS t FROM {orders}) v",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m FROM {orders}",
)
_text(
    "sql_json_of_objects",
    "SELECT n_nationkey, JSON_EXTRACT(o, '$.a.b') AS b, JSON_EXISTS(o, '$.tags[1]') AS has, JSON_EXISTS(o, 'none') AS lacks, JSON_VALUE(o, 'tags') AS first, CONCAT(tags, tags) AS twice FROM (SELECT n_nationkey, array(n_name, 'x') AS tags, named_struct('a', named_struct('b', n_name), 'tags', array(NULL, n_name)) AS o FROM {nation}) v",
    "SELECT n_nationkey, n_name AS b, true AS has, false AS lacks, n_name AS first, [n_name, 'x', n_name, 'x'] AS twice FROM {nation}",
)
_text(
    "sql_now_as_text",
    "SELECT n_nationkey, length(NOW()) AS n, length(CURRENT_TIMESTAMP()) AS t, substr(CURRENT_DATE, 1, 10) = substr(NOW(), 1, 10) AS same, substr(NOW(), 11, 1) AS gap FROM {nation}",
    "SELECT n_nationkey, 19 AS n, 19 AS t, true AS same, ' ' AS gap FROM {nation}",
)
