"""The registered queries of the library's own operators, with their SQL.

In a query's text, {table} is a table of the folder: a source for the engine, a
view for DuckDB.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import EXECUTION, EngineError
from ..functions import columns as fn
from ..operators import access, checks, etl, hl7, relational
from ..sources import files, html
from ..streaming import windows
from .engine import Engine
from .jobs import Job, layers, run

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by columns to as many tasks as the session has shuffle partitions or cores: few bytes can be much work, and a small file is one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def query(name: str, sql: str | None = None):
    """Register a query built from operators, and its SQL if there is one."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = re.sub(r"\{(\w+)\}", r"\1", sql)
        return f

    return put


def text(name: str, spark_sql: str, oracle: str | None = None) -> None:
    """Register a query of the engine; its SQL is the same text unless given."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return Engine(spark).query(re.sub(r"\{(\w+)\}", lambda m: f"read_file('{d}/{m[1]}.parquet')", spark_sql))

    query(name, oracle or spark_sql)(run)


# --- scans and projection

text("scan_file", "SELECT n_nationkey, n_name, n_regionkey FROM {nation}")
text("project_alias", "SELECT p_partkey AS id, p_name AS label, p_retailprice * 2 AS twice FROM {part}")
text("qualified_star", "SELECT r.* FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey")
text("dual_constant", "SELECT n_nationkey, 1 AS one, 'x' AS letter FROM {nation}")
text("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}")


@query("service_scan", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0")
def service_scan(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(spark)
    e.services.register("crm", lambda t: table(spark, d, t))
    return e.query("SELECT c_custkey, c_name FROM read_service('crm.customer') WHERE c_acctbal > 0")


# --- predicates

text("filter_compare", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_quantity >= 45 AND l_discount < 0.03")
text("filter_and_or_not", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE (l_returnflag = 'R' OR l_linestatus = 'O') AND NOT l_quantity > 10")
text("filter_between", "SELECT p_partkey, p_size FROM {part} WHERE p_size BETWEEN 10 AND 15")
text("filter_in_list", "SELECT p_partkey, p_brand FROM {part} WHERE p_size IN (1, 7, 23)")
text("filter_not_in", "SELECT p_partkey FROM {part} WHERE p_size NOT IN (1, 7, 23)")
text("filter_like", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%e%' AND p_name NOT LIKE 'a%'")
text("filter_is_null", "SELECT c.c_custkey FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey AND o.o_orderkey % 7 = 0 WHERE o.o_orderkey IS NULL")


@query("filter_ilike_prefix", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%re%'")
def filter_ilike_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(fn.ilike_text("p_name", "RE")).select("p_partkey")


@query("filter_string_numeric_coercion", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50")
def filter_string_numeric_coercion(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events").withColumn("k", fn.json_extract("props", "k"))
    return df.filter(fn.compare(df, "k", ">", F.lit(50))).select("event_id", "k")


# --- arithmetic and conditions

text("arith_revenue", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM {lineitem}")
text("div_by_zero_null", "SELECT p_partkey, try_divide(p_retailprice, p_size - 10) AS x FROM {part}", "SELECT p_partkey, p_retailprice / nullif(p_size - 10, 0) AS x FROM {part}")
text("case_bucket", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS bucket FROM {part}")
text("if_function", "SELECT o_orderkey, if(o_totalprice > 100000, 'big', 'rest') AS kind FROM {orders}", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'rest' END AS kind FROM {orders}")
text("unary_minus", "SELECT c_custkey, -c_acctbal AS debt FROM {customer}")
text("concat_operator", "SELECT n_nationkey, n_name || '-' || CAST(n_regionkey AS STRING) AS tag FROM {nation}", "SELECT n_nationkey, n_name || '-' || CAST(n_regionkey AS VARCHAR) AS tag FROM {nation}")

# --- joins

text("join_inner", "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 200000")
text("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_custkey")
text("join_right", "SELECT c.c_custkey, o.o_orderkey FROM {orders} o RIGHT JOIN {customer} c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 250000")
text("join_full", "SELECT n.n_name, s.s_name FROM {nation} n FULL JOIN {supplier} s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000")
text("join_cross", "SELECT n_name, r_name FROM {nation} CROSS JOIN {region}")
text("exists_correlated", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
text("semi_in_subquery", "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity = 50)")


@query(
    "join_multiway",
    """SELECT r_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
    JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY r_name""",
)
def join_multiway(spark: SparkSession, d: str) -> DataFrame:
    t = {n: table(spark, d, n) for n in ("region", "nation", "customer", "orders")}
    # orders meet customers' nations only; names join the few sums
    by_nation = t["orders"].filter("o_totalprice > 1000").join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    named = by_nation.join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("r_name").agg(F.sum("n").alias("n_orders"), F.round(F.sum("s"), 2).alias("revenue"))


@query("join_natural", "SELECT l.k, l.a, r.b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) l JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier) r ON l.k = r.k")
def join_natural(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a"))
    return relational.natural_join(left, table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("b"))).select("k", "a", "b")


@query(
    "join_theta",
    "SELECT p_partkey, b.low FROM part JOIN (SELECT CAST(100 * i AS DOUBLE) AS low, CAST(100 * i + 60 AS DOUBLE) AS high FROM range(0, 30) t(i)) b ON p_retailprice >= b.low AND p_retailprice < b.high",
)
def join_theta(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.range(30).select((F.col("id") * 100).cast("double").alias("low"), (F.col("id") * 100 + 60).cast("double").alias("high"))
    return relational.band_join(table(spark, d, "part"), bands, "p_retailprice", "low", "high", 100.0).select("p_partkey", "low")


@query("anti_not_in", "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_orderkey % 997 = 0)")
def anti_not_in(spark: SparkSession, d: str) -> DataFrame:
    return relational.not_in(table(spark, d, "supplier"), "s_suppkey", table(spark, d, "lineitem").filter("l_orderkey % 997 = 0").select("l_suppkey")).select("s_suppkey")


@query("lateral_unnest", "SELECT p_partkey, w AS word FROM part, unnest(string_split(p_name, ' ')) t(w)")
def lateral_unnest(spark: SparkSession, d: str) -> DataFrame:
    return relational.unnest(table(spark, d, "part"), F.split("p_name", " "), "w").select("p_partkey", F.col("`w.value`").alias("word"))


@query("lateral_unnest_left_filtered", "SELECT p_partkey, w AS word FROM part LEFT JOIN LATERAL (SELECT w FROM unnest(string_split(p_name, ' ')) t(w) WHERE w LIKE 'b%') ON true")
def lateral_unnest_left_filtered(spark: SparkSession, d: str) -> DataFrame:
    out = relational.unnest(table(spark, d, "part"), F.split("p_name", " "), "w", outer=True, on=lambda x: x.startswith("b"))
    return out.select("p_partkey", F.col("`w.value`").alias("word"))


# --- aggregation


@query("agg_global", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem")
def agg_global(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(
        fn.count_rows().alias("n"), F.round(fn.sum_numeric("l_quantity"), 2).alias("q"), F.round(fn.avg_numeric("l_discount"), 6).alias("d"), fn.min_numeric("l_tax").alias("lo"), fn.max_numeric("l_tax").alias("hi")
    )


text(
    "agg_group",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
    round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
text("agg_having_alias", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING n > 12")
text("agg_having_call", "SELECT o_custkey, round(max(o_totalprice), 2) AS top FROM {orders} GROUP BY o_custkey HAVING count(*) > 10 AND sum(o_totalprice) > 1500000")
text("agg_count_rows_vs_distinct", "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM {orders} GROUP BY o_orderstatus")
text("agg_on_expression", "SELECT l_returnflag, round(sum(l_quantity) + 1, 2) AS s, round(sum(l_extendedprice) / sum(l_quantity), 6) AS r FROM {lineitem} GROUP BY l_returnflag")
text("group_by_expression", "SELECT year(o_orderdate) AS y, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM {orders} GROUP BY year(o_orderdate)")


@query("agg_diff", "SELECT p_brand, round(max(p_retailprice) - min(p_retailprice), 6) AS spread FROM part GROUP BY p_brand")
def agg_diff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(fn.diff("p_retailprice"), 6).alias("spread"))


@query("agg_first_last", "SELECT n_regionkey, arg_min(n_name, n_name) AS f, arg_max(n_name, n_name) AS l FROM nation GROUP BY n_regionkey")
def agg_first_last(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "nation").select("n_name", "n_regionkey")
    return df.groupBy("n_regionkey").agg(fn.first_by_text(df, "n_name").alias("f"), fn.last_by_text(df, "n_name").alias("l"))


@query("agg_min_max_numeric", "SELECT event_type, min(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS lo, max(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS hi FROM events GROUP BY event_type")
def agg_min_max_numeric(spark: SparkSession, d: str) -> DataFrame:
    k = fn.json_extract("props", "k")
    return table(spark, d, "events").groupBy("event_type").agg(fn.min_numeric(k).alias("lo"), fn.max_numeric(k).alias("hi"))


# --- windows

text("win_count_partition", "SELECT n_nationkey, count(*) OVER (PARTITION BY n_regionkey) AS n FROM {nation}")
text("win_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}")
text("win_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM {part}")
text("win_dense_rank", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM {part}")
text("win_sum_running", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS s FROM {orders}")
text("win_lag_lead", "SELECT event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")

# --- order, limits, set operations

text("order_multi_dir", "SELECT p_brand, p_size, p_partkey FROM {part} ORDER BY p_brand, p_size DESC, p_partkey")
text("limit_offset", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
text("limit_all", "SELECT r_name FROM {region} ORDER BY r_name LIMIT ALL", "SELECT r_name FROM {region}")
text("topk_customers", "SELECT c_custkey, round(sum(o_totalprice), 2) AS spent FROM {customer} JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY spent DESC, c_custkey LIMIT 20")
text("union_all", "SELECT n_regionkey AS k FROM {nation} UNION ALL SELECT r_regionkey FROM {region}")
text("union_distinct", "SELECT n_regionkey AS k FROM {nation} UNION SELECT r_regionkey FROM {region}")
text("intersect", "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM {supplier}")
text("except", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_orderkey % 7 = 0")
text("set_chain", "SELECT n_nationkey AS k FROM {nation} UNION SELECT r_regionkey FROM {region} UNION SELECT s_nationkey + 100 FROM {supplier}")


@query("limit_comma", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 7 OFFSET 3")
def limit_comma(spark: SparkSession, d: str) -> DataFrame:
    return relational.limit_rows(table(spark, d, "part").select("p_partkey").orderBy("p_partkey"), 7, 3)


@query("union_by_name", "SELECT n_name AS name, n_nationkey AS key, NULL AS extra FROM nation UNION SELECT r_name, r_regionkey, 'r' FROM region")
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))
    return relational.union_by_name(a, table(spark, d, "region").select(F.lit("r").alias("extra"), F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))


@query("intersect_bag", "SELECT s_nationkey AS k FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0)")
def intersect_bag(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("k"))
    return relational.intersect_rows(a, table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), bag=True)


@query("except_bag", "SELECT c_nationkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def except_bag(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    return relational.except_rows(a, table(spark, d, "supplier").filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("k")), bag=True)


# --- more aggregates and windows

text("agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS dear FROM {orders} GROUP BY o_orderstatus")
text("agg_grouping_sets", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM {customer} GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())")
text("agg_rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {customer} GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
text("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
text("agg_percentile", "SELECT c_mktsegment, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY c_acctbal), 3) AS q FROM {customer} GROUP BY c_mktsegment")
text("win_ntile", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS q FROM {customer}", "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS INTEGER) AS q FROM {customer}")
text("win_first_last_value", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
text("win_range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS n FROM {orders}")
text("join_full_theta", "SELECT r.r_regionkey, n.n_nationkey FROM {region} r FULL JOIN {nation} n ON r.r_regionkey = n.n_regionkey AND n.n_nationkey > r.r_regionkey * 5")

# --- subqueries

text("cte_single", "WITH big AS (SELECT o_custkey, o_totalprice FROM {orders} WHERE o_totalprice > 200000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey")
text("cte_multi_union", "WITH a AS (SELECT n_name AS x FROM {nation} UNION SELECT r_name FROM {region}), b AS (SELECT x FROM a WHERE x LIKE 'A%') SELECT x FROM b UNION SELECT s_name FROM {supplier}")
text("derived_join", "SELECT s.o_custkey, s.n, c.c_name FROM (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) s JOIN {customer} c ON c.c_custkey = s.o_custkey WHERE s.n > 8")
text("scalar_subquery", "SELECT p_partkey FROM {part} WHERE p_retailprice > (SELECT avg(p_retailprice) FROM {part})")
text("scalar_correlated", "SELECT c_custkey, (SELECT max(o_totalprice) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS top FROM {customer} c")

text("derived_set_op", "SELECT t.k, count(*) AS n FROM (SELECT n_regionkey AS k FROM {nation} UNION ALL SELECT r_regionkey FROM {region}) t GROUP BY t.k")

# --- what the dialect spells its own way, in a query's text

text("sql_dual", "SELECT n_nationkey, 1 AS one, (SELECT dual.dummy FROM dual) AS two FROM {nation}", "SELECT n_nationkey, 1 AS one, 1 AS two FROM {nation}")
text("sql_limit_comma", "SELECT c_custkey FROM {customer} ORDER BY c_custkey LIMIT 5, 10", "SELECT c_custkey FROM {customer} ORDER BY c_custkey LIMIT 10 OFFSET 5")
text("sql_like_i", "SELECT c_custkey FROM {customer} WHERE c_mktsegment LIKE 'i:build' OR c_name LIKE 'i:%7'", "SELECT c_custkey FROM {customer} WHERE c_mktsegment ILIKE '%build%' OR c_name ILIKE '%7'")
text("sql_div_by_zero", "SELECT o_orderkey, o_totalprice / (o_orderkey % 2) AS x FROM {orders}", "SELECT o_orderkey, o_totalprice / nullif(o_orderkey % 2, 0) AS x FROM {orders}")
text("sql_cast_null", "SELECT c_custkey, c_name::int AS x, CAST(c_mktsegment AS DOUBLE) AS y FROM {customer}", "SELECT c_custkey, TRY_CAST(c_name AS INTEGER) AS x, TRY_CAST(c_mktsegment AS DOUBLE) AS y FROM {customer}")
text(
    "sql_json",
    """SELECT n_nationkey, JSON_EXTRACT(j, 'a.b') AS b, JSON_EXISTS(j, 'a.z') AS z, json_exists(j, '$.a') AS a, JSON_VALUE(j, 'l') AS l
    FROM (SELECT n_nationkey, CONCAT('{"a": {"b": ', n_nationkey, '}, "l": [', n_regionkey, ', 2]}') AS j FROM {nation}) t""",
    "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS b, false AS z, true AS a, CAST(n_regionkey AS VARCHAR) AS l FROM {nation}",
)
text(
    "sql_to_number_diff",
    "SELECT c_mktsegment, round(DIFF(c_acctbal), 2) AS d, max(TO_NUMBER(SUBSTR(c_name, 10, 9))) AS m FROM {customer} GROUP BY c_mktsegment",
    "SELECT c_mktsegment, round(max(c_acctbal) - min(c_acctbal), 2) AS d, max(TRY_CAST(substr(c_name, 10, 9) AS DOUBLE)) AS m FROM {customer} GROUP BY c_mktsegment",
)
text("sql_to_date", "SELECT o_orderkey, TO_DATE(date_format(o_orderdate, 'dd/MM/yyyy'), 'DD/MM/YYYY') AS t, TO_DATE('none', 'YYYY-MM-DD') AS u FROM {orders}", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS t, CAST(NULL AS VARCHAR) AS u FROM {orders}")
text("sql_first_last", "SELECT n_regionkey, FIRST(n_name) AS f, LAST(n_name) AS l, FIRST(n_nationkey) AS k FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, arg_min(n_name, n_name || '\"') AS f, arg_max(n_name, n_name || '\"') AS l, arg_min(n_nationkey, n_name || '\"') AS k FROM {nation} GROUP BY n_regionkey")
text("sql_text_functions", "SELECT c_custkey, COALESCE('', c_name) AS x, SUBSTR(c_name, 0, 3) AS y, LENGTH(c_name) AS n, DATEDIFF('2024-01-05', '2024-01-01') AS days FROM {customer}", "SELECT c_custkey, c_name AS x, '' AS y, CAST(strlen(c_name) AS INTEGER) AS n, 4 AS days FROM {customer}")


@query("sql_read_plugin", "SELECT n_name FROM nation WHERE n_regionkey = 1")
def sql_read_plugin(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(spark)
    e.register_source("folder", lambda name: table(spark, d, name))
    return e.query("SELECT n_name FROM read_folder('nation') WHERE n_regionkey = ?", [1])


# --- functions

text("fn_upper_lower", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l FROM {part}")
text("fn_round", "SELECT p_partkey, round(p_retailprice, 1) AS r FROM {part}", "SELECT p_partkey, round(p_retailprice, 1) AS r FROM {part}")


@query("fn_substr", "SELECT p_partkey, substr(p_name, 2, 4) AS a, '' AS b FROM part")
def fn_substr(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fn.substr_text("p_name", 2, 4).alias("a"), fn.substr_text("p_name", 0, 4).alias("b"))


@query("fn_length_bytes", "SELECT doc_id, CAST(strlen(text) AS INTEGER) AS n FROM documents")
def fn_length_bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fn.length_bytes("text").alias("n"))


@query("fn_concat", "SELECT c_custkey, concat(c_name, '/', c_mktsegment) AS t FROM customer")
def fn_concat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", fn.concat_text("c_name", F.lit("/"), F.lit(None), "c_mktsegment").alias("t"))


@query("fn_coalesce_empty", "SELECT doc_id, coalesce(nullif(CASE WHEN lang = 'en' THEN '' ELSE lang END, ''), source) AS x FROM documents")
def fn_coalesce_empty(spark: SparkSession, d: str) -> DataFrame:
    lang = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", fn.coalesce_text(lang, "source").alias("x"))


@query("fn_year_month", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m FROM orders")
def fn_year_month(spark: SparkSession, d: str) -> DataFrame:
    t = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").select("o_orderkey", fn.year_of(t).alias("y"), fn.month_of(t).alias("m"))


@query("fn_datediff", "SELECT o_orderkey, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders")
def fn_datediff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", fn.date_minus(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("1995-01-01")).alias("days"))


@query("fn_to_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS t FROM orders")
def fn_to_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", fn.to_date_text(F.date_format("o_orderdate", "dd/MM/yyyy"), "DD/MM/YYYY").alias("t"))


@query("date_minus_date", "SELECT l_orderkey, l_linenumber, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS wait FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def date_minus_date(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", "l_linenumber", F.datediff("l_shipdate", "o_orderdate").alias("wait"))


@query("fn_to_number", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x FROM events")
def fn_to_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", fn.to_number(fn.json_extract("props", "k")).alias("x"))


@query("cast_function", "SELECT c_custkey, CAST(trunc(c_acctbal) AS INTEGER) AS i, CAST(c_nationkey AS VARCHAR) AS s FROM customer")
def cast_function(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", fn.cast_to("c_acctbal", "integer").alias("i"), fn.cast_to("c_nationkey", "text").alias("s"))


text("cast_operator", "SELECT p_partkey, p_size::double / 2 AS half, p_size::string AS s FROM {part}", "SELECT p_partkey, p_size::DOUBLE / 2 AS half, p_size::VARCHAR AS s FROM {part}")
text("cast_invalid_null", "SELECT p_partkey, try_cast(p_name AS int) AS x FROM {part}", "SELECT p_partkey, TRY_CAST(p_name AS INTEGER) AS x FROM {part}")


# --- nested values


@query("path_struct", "SELECT c_custkey, c_mktsegment AS segment, c_name AS name FROM customer")
def path_struct(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer").select("c_custkey", F.struct(F.struct("c_mktsegment").alias("inner"), F.col("c_name").alias("odd-key")).alias("o"))
    return df.select("c_custkey", fn.path(df, "o->inner.c_mktsegment").alias("segment"), fn.path(df, 'o."odd-key"').alias("name"))


@query("path_array_fanout", "SELECT p_partkey, string_split(p_name, ' ') AS words, string_split(p_name, ' ')[1] AS first FROM part")
def path_array_fanout(spark: SparkSession, d: str) -> DataFrame:
    items = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("word")))
    df = table(spark, d, "part").select("p_partkey", items.alias("items"))
    return df.select("p_partkey", fn.path(df, "items.word").alias("words"), fn.path(df, "items[0].word").alias("first"))


@query("array_index_oob", "SELECT vec_id, embedding[1] AS a, CAST(NULL AS FLOAT) AS b FROM embeddings")
def array_index_oob(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "embeddings")
    return df.select("vec_id", fn.path(df, "embedding[0]").alias("a"), fn.path(df, "embedding[9999]").alias("b"))


@query("array_any", "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.3)) > 0")
def array_any(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter(fn.matches_any(F.lit(0.3), "<", "embedding")).select("vec_id")


@query("array_all", "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x >= 0.25)) = 0")
def array_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter(fn.matches_all(F.lit(0.25), ">", "embedding")).select("vec_id")


@query("array_contains_all", "SELECT p_partkey FROM part WHERE list_has_all(string_split(p_name, ' '), string_split((SELECT min(p_name) FROM part), ' '))")
def array_contains_all(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part")
    least = df.agg(F.split(F.min("p_name"), " ").alias("wanted"))  # one row
    return df.join(F.broadcast(least)).filter(F.forall("wanted", lambda w: F.array_contains(F.split("p_name", " "), w))).select("p_partkey")


@query("array_overlaps", "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['blue', 'red', 'green', 'small'])")
def array_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(fn.overlaps(F.split("p_name", " "), "blue", "red", "green", "small")).select("p_partkey")


@query("array_in_list", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'blue') OR list_contains(string_split(p_name, ' '), 'large')")
def array_in_list(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("p_name", " ")
    return table(spark, d, "part").filter(fn.array_compare(words, "=", "blue") | fn.array_compare(words, "=", "large")).select("p_partkey")


@query("json_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", fn.json_extract("props", "k").alias("k"))


@query("json_exists", "SELECT event_id, json_extract(props, '$.k') IS NOT NULL AS a, json_extract(props, '$.none') IS NOT NULL AS b FROM events")
def json_exists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", fn.json_exists("props", "k").alias("a"), fn.json_exists("props", "none").alias("b"))


@query("json_value", "SELECT event_id, json_extract_string(props, '$.k') AS v FROM events")
def json_value(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", fn.json_value("props", "k").alias("v"))


# --- user functions


@query("udf_reverse", "SELECT n_nationkey, reverse(n_name) AS r FROM nation")
def udf_reverse(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(spark)
    e.functions.register_expression("REVERSE_TEXT", "s STRING", "STRING", "reverse(s)")
    return e.query(f"SELECT n_nationkey, reverse_text(n_name) AS r FROM read_file('{d}/nation.parquet')")


@query("udaf_median", "SELECT p_brand, median(p_retailprice) AS m FROM part GROUP BY p_brand")
def udaf_median(spark: SparkSession, d: str) -> DataFrame:
    def middle(x: pd.Series) -> float:
        return float(x.median())

    e = Engine(spark)
    middle.__annotations__ = {"x": pd.Series, "return": float}
    e.functions.register_aggregate("MIDDLE", middle, "double")
    return e.query(f"SELECT p_brand, middle(p_retailprice) AS m FROM read_file('{d}/part.parquet') GROUP BY p_brand")


# --- jobs


@query("etl_normalize", "SELECT c_custkey, CAST(c_acctbal AS VARCHAR) AS t, TRY_CAST(c_acctbal AS DOUBLE) AS x FROM customer")
def etl_normalize(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("string").alias("t"), F.col("c_acctbal").cast("string").alias("x"))
    return etl.normalize(df, {"x": "decimal(10,2)", "c_custkey": "bigint"})[0]


@query("etl_mapping", "SELECT c_custkey AS id, c_name || ' ' || c_mktsegment AS label, 'crm' AS origin, CAST(NULL AS VARCHAR) AS missing FROM customer")
def etl_mapping(spark: SparkSession, d: str) -> DataFrame:
    rules = {"id": "c_custkey", "label": "c_name + ' ' + c_mktsegment", "origin": "consts.origin", "missing": "no_such_field"}
    return etl.map_fields(table(spark, d, "customer"), rules, {"origin": "crm"}).withColumn("missing", F.col("missing").cast("string"))


@query("etl_eval_ternary", "SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 AND c_mktsegment = 'BUILDING' THEN 'a' ELSE 'b' END AS kind FROM customer")
def etl_eval_ternary(spark: SparkSession, d: str) -> DataFrame:
    return etl.map_fields(table(spark, d, "customer"), {"id": "c_custkey", "kind": 'eval.{{c_acctbal > 0 && c_mktsegment == "BUILDING" ? "a" : "b"}}'})


@query("etl_filter", "SELECT c_custkey FROM customer WHERE c_acctbal > 100 AND c_mktsegment <> 'BUILDING'")
def etl_filter(spark: SparkSession, d: str) -> DataFrame:
    return etl.filter_rows(table(spark, d, "customer"), 'c_acctbal > 100 && c_mktsegment != "BUILDING"').select("c_custkey")


@query("etl_formatter_date", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders")
def etl_formatter_date(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "ddMMyyyy").alias("day"))
    return etl.format_fields(df, {"day": "transform(day, 'DD/MM/YYYY', 'DDMMYYYY')"})[0]


@query("etl_formatter_chain", "SELECT p_partkey, 'p:' || replace(upper(trim(p_name)), ' ', '_') || '!' AS p_name FROM part")
def etl_formatter_chain(spark: SparkSession, d: str) -> DataFrame:
    return etl.format_fields(table(spark, d, "part").select("p_partkey", "p_name"), {"p_name": "trim()|upper()|replace(' ', '_')|prefix('p:')|suffix('!')"})[0]


@query("etl_formatter_default", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'unknown' ELSE lang END AS lang FROM documents")
def etl_formatter_default(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") != "en", F.col("lang")).alias("lang"))
    return etl.format_fields(df, {"lang": "default('unknown')"})[0]


@query(
    "etl_key_value",
    """SELECT c_custkey, 'c_name' AS key, c_name AS value, 'string' AS value_type FROM customer UNION ALL
    SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR), 'int' FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment, 'string' FROM customer""",
)
def etl_key_value(spark: SparkSession, d: str) -> DataFrame:
    return etl.key_value(table(spark, d, "customer"), extra=["c_custkey"], exclude=["c_acctbal"])


@query("etl_aggregator", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, CAST(floor(avg(value) + 0.5) AS BIGINT) AS mean, max(value) AS top FROM events GROUP BY event_type")
def etl_aggregator(spark: SparkSession, d: str) -> DataFrame:
    out = etl.aggregate(table(spark, d, "events"), ["event_type"], [("count", "value", "n"), ("sum", "value", "total"), ("avg", "value", "mean"), ("max", "value", "top")])
    return out.withColumn("total", F.round("total", 4))


@query("etl_lookup", "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def etl_lookup(spark: SparkSession, d: str) -> DataFrame:
    return relational.lookup_join(table(spark, d, "customer"), table(spark, d, "nation"), "n_nationkey", "c_nationkey", "n_name", "nation").select("c_custkey", "nation")


@query("etl_dedup", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def etl_dedup(spark: SparkSession, d: str) -> DataFrame:
    return etl.deduplicate(table(spark, d, "events"), "user_id", F.col("ts"), F.col("event_id")).select("event_id", "user_id")


@query("etl_multi_source", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def etl_multi_source(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return etl.multi_source(a, table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")))


@query("etl_incremental_checkpoint", "SELECT event_id FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE event_id < 500)")
def etl_incremental_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    c = etl.Checkpoint(spark, _scratch(spark, "checkpoint"), "event_id")
    events = table(spark, d, "events")
    c.save(events.filter("event_id < 500"))
    return c.new_rows(events).select("event_id")


@query("etl_dead_letter", "SELECT 'normalize' AS step, count(*) AS n FROM part WHERE TRY_CAST(CASE WHEN p_size % 2 = 0 THEN p_name ELSE '7' END AS BIGINT) IS NULL")
def etl_dead_letter(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("7").alias("x"))
    return etl.normalize(df, {"x": "int"})[1].groupBy("step").agg(F.count(F.lit(1)).alias("n"))


@query("etl_idempotent_anti", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def etl_idempotent_anti(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    done = orders.filter("o_orderkey % 3 = 0").select(etl.record_key("o_orderkey", "o_custkey").alias("key"))
    return etl.not_yet_done(orders, done, ["o_orderkey", "o_custkey"]).select("o_orderkey")


@query("etl_delete", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 2")
def etl_delete(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return etl.delete_keys(n, n.filter("n_regionkey = 2").unionByName(n.filter("n_regionkey = 2")).select("n_nationkey"), "n_nationkey").select("n_nationkey")


@query("etl_upsert_repeated", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'z' ELSE n_name END AS n_name FROM nation")
def etl_upsert_repeated(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    changes = n.filter("n_regionkey = 1").select("n_nationkey", F.explode(F.array(F.lit("a"), F.lit("z"))).alias("n_name"))
    return etl.upsert(n.select("n_nationkey", "n_name"), changes, "n_nationkey")


@query("etl_lookup_in", "SELECT 'row' AS kind, c_custkey AS id, upper(n_name) AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 3 UNION ALL SELECT 'lookup', c_custkey, NULL FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 3")
def etl_lookup_in(spark: SparkSession, d: str) -> DataFrame:
    rule = "eval.{{upper(lookupIn('nations', 'n_nationkey', c_nationkey, 'n_name'))}}"
    good, dead = etl.map_with_lookups(table(spark, d, "customer"), {"id": "c_custkey", "nation": rule}, None, {"nations": table(spark, d, "nation").filter("n_regionkey <> 3")})
    lost = dead.select("step", F.get_json_object("record", "$.c_custkey").cast("long"), F.lit(None).cast("string"))
    return good.select(F.lit("row").alias("kind"), F.col("id").cast("long").alias("id"), "nation").union(lost)


@query("etl_fanout", "SELECT 'all' AS at, count(*) AS n, CAST(max(c_custkey) AS BIGINT) AS top FROM customer UNION ALL SELECT 'rich', count(*), CAST(max(c_custkey) AS BIGINT) FROM customer WHERE c_acctbal > 5000")
def etl_fanout(spark: SparkSession, d: str) -> DataFrame:
    at = _scratch(spark, "fanout")
    run(spark, Job([table(spark, d, "customer")], destinations=[f"{at}/all", {"path": f"{at}/rich", "filter": "c_acctbal > 5000", "mapping": {"id": "c_custkey"}}]))
    one = lambda name, c: spark.read.parquet(f"{at}/{name}").agg(F.lit(name).alias("at"), F.count(F.lit(1)).alias("n"), F.max(c).cast("long").alias("top"))
    return one("all", "c_custkey").union(one("rich", "id"))


@query("etl_dead_letter_queue", "SELECT state, count(*) AS n, CAST(attempts AS INTEGER) AS attempts, count_if(due) AS due FROM (SELECT CASE WHEN p_size % 2 = 0 THEN 'pending' ELSE 'exhausted' END AS state, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 3 END AS attempts, p_size % 2 = 0 AS due FROM part) GROUP BY state, attempts")
def etl_dead_letter_queue(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    lost = lambda df: etl.rejects(df, "normalize", F.lit("no number"))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    letters = etl.dead_letters(lost(part.filter("p_size % 2 = 0")), at, attempts=1).union(etl.dead_letters(lost(part.filter("p_size % 2 <> 0")), at, attempts=2))
    due = etl.due(letters, at + F.make_dt_interval(secs=F.lit(120))).select("id", F.lit(1).alias("due")).distinct()
    return letters.join(due, "id", "left").groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.max("attempts").alias("attempts"), F.count("due").alias("due"))


@query("etl_upsert", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'new' ELSE n_name END AS n_name FROM nation")
def etl_upsert(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    changes = n.filter("n_regionkey = 1").select("n_nationkey", F.lit("new").alias("n_name"))
    return etl.upsert(n.select("n_nationkey", "n_name"), changes, "n_nationkey")


# --- data quality


def _failing(rule: checks.Rule, name: str, key: str):
    return lambda spark, d: table(spark, d, name).filter(~checks.passes(rule)).select(key)


@query("dq_not_null", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 2 OR lang IS NULL OR lang = ''")
def dq_not_null(spark: SparkSession, d: str) -> DataFrame:
    """Nulls, empty texts and others."""
    docs = table(spark, d, "documents").withColumn("lang", F.when(F.col("doc_id") % 3 == 2, F.col("lang")).when(F.col("doc_id") % 3 == 1, ""))
    return docs.filter(~checks.passes(checks.Rule("lang", "not_null"))).select("doc_id")



query("dq_range", "SELECT p_partkey FROM part WHERE NOT p_retailprice BETWEEN 950 AND 1500")(_failing(checks.Rule("p_retailprice", "range", 950, 1500), "part", "p_partkey"))
query("dq_regex", "SELECT c_custkey FROM customer WHERE NOT regexp_matches(c_name, '[02468]$')")(_failing(checks.Rule("c_name", "regex", pattern="[02468]$"), "customer", "c_custkey"))


@query("dq_email", r"SELECT c_custkey, regexp_matches(CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) || '@x.' ELSE 'c' || c_custkey || '@mail.org' END, '^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,4}$') AS good FROM customer")
def dq_email(spark: SparkSession, d: str) -> DataFrame:
    address = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lower("c_mktsegment"), F.lit("@x."))).otherwise(F.concat(F.lit("c"), "c_custkey", F.lit("@mail.org")))
    return table(spark, d, "customer").select("c_custkey", address.alias("address")).select("c_custkey", checks.passes(checks.Rule("address", "email")).alias("good"))


@query("dq_unique", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1)")
def dq_unique(spark: SparkSession, d: str) -> DataFrame:
    v = checks.validate(table(spark, d, "orders"), [checks.Rule("o_custkey", "unique")])
    return v.filter(F.size("errors") > 0).select("o_orderkey")


@query("dq_error_rate", "SELECT count(*) AS total, count_if(c_acctbal < 0) AS failed, round(100.0 * count_if(c_acctbal < 0) / count(*), 6) AS rate, 100.0 * count_if(c_acctbal < 0) / count(*) > 5 AS tripped FROM customer")
def dq_error_rate(spark: SparkSession, d: str) -> DataFrame:
    v = checks.validate(table(spark, d, "customer"), [checks.Rule("c_acctbal", "range", 0, 1e9)])
    return checks.error_rate(v, 5.0, 10).withColumn("rate", F.round("rate", 6))


@query(
    "schema_detect",
    """SELECT * FROM (VALUES ('c_custkey', 'int'), ('c_name', 'string'), ('c_nationkey', 'int'), ('c_acctbal', 'float'), ('c_mktsegment', 'string')) v(column_name, kind)
    JOIN (SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS column_name,
        unnest([max(length(CAST(c_custkey AS VARCHAR))), max(length(c_name)), max(length(CAST(c_nationkey AS VARCHAR))), max(length(CAST(c_acctbal AS VARCHAR))), max(length(c_mktsegment))])::INTEGER AS max_length,
        unnest([count(c_custkey) < count(*), count(c_name) < count(*), count(c_nationkey) < count(*), count(c_acctbal) < count(*), count(c_mktsegment) < count(*)]) AS nullable FROM customer) USING (column_name)""",
)
def schema_detect(spark: SparkSession, d: str) -> DataFrame:
    return checks.detect_kinds(table(spark, d, "customer"))


@query("schema_drift", "SELECT 1 AS version, true AS drifted")
def schema_drift(spark: SparkSession, d: str) -> DataFrame:
    r, df = checks.SchemaRegistry(), table(spark, d, "nation")
    first, drifted = r.register("nation", df), r.drifted("nation", df.withColumn("more", F.lit(1)))
    return spark.createDataFrame([(first, drifted)], "version int, drifted boolean")


@query("schema_versions", "SELECT 2 AS version, true AS drifted, false AS same")
def schema_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions outlive the registry that made them."""
    folder, df = _scratch(spark, "schemas"), table(spark, d, "nation")
    more = df.withColumn("more", F.lit(1))
    first = checks.SchemaRegistry(spark, folder)
    first.register("nation", df)
    first.register("nation", more)
    later = checks.SchemaRegistry(spark, folder)
    return spark.createDataFrame([(later.register("nation", more), later.drifted("nation", df), later.drifted("nation", more))], "version int, drifted boolean, same boolean")


# --- files written and read back, jobs as configured


def _round_trip(kind: str, read_as: str | None = None):
    def run_(spark: SparkSession, d: str) -> DataFrame:
        at = _scratch(spark, f"files-{kind}")
        files.write_file(table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), at, kind)
        return files.read_file(spark, at, read_as or kind).select("p_partkey", "p_name", F.col("p_retailprice").cast("double").alias("p_retailprice"))

    return run_


query("file_csv", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_retailprice FROM part")(_round_trip("csv"))
for _kind, _read in (("json", "ndjson"), ("json_array", "json"), ("orc", "orc"), ("parquet", "parquet")):
    query(f"file_{_kind}", "SELECT p_partkey, p_name, p_retailprice FROM part")(_round_trip(_kind, _read))


@query("file_hl7", "SELECT CAST(c_custkey AS VARCHAR) AS control_id, 4 AS segments, c_custkey % 2 = 0 AS usual FROM customer")
def file_hl7(spark: SparkSession, d: str) -> DataFrame:
    """Messages of many files, of any separator, with MSH within a field."""
    at = _scratch(spark, "files-hl7")
    _messages(spark, d).select(F.regexp_replace(F.concat("raw_message", F.lit("\rNTE|1||see MSH|1 and MSH!2")), "\r", "\n")).write.text(at)
    got = files.read_file(spark, at, "hl7")
    return got.select(hl7.field("raw_message", "MSH", 10).alias("control_id"), F.size(F.split("raw_message", "\r")).alias("segments"), F.col("raw_message").startswith("MSH|").alias("usual"))


@query("sql_parameters", "SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey > 2")
def sql_parameters(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark).query(f"SELECT n_name FROM read_file('{d}/nation.parquet') WHERE n_regionkey = :r AND n_nationkey > :k", {"r": 1, "k": 2})


@query("sql_row_limit", "SELECT 7 AS n, true AS truncated")
def sql_row_limit(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(spark)
    with e.using(max_rows=7):
        rows = e.rows(f"SELECT n_name FROM read_file('{d}/nation.parquet')")
    return spark.createDataFrame([(len(rows), rows.truncated)], "n int, truncated boolean")


_JOB = """{"source": "IN", "destinations": [{"path": "OUT", "filter": "half > 100"}], "normalize": {"p_retailprice": "float64"}, "constants": {"tag": "t"}, "max_errors": 100000,
    "mapping": {"id": "p_partkey", "half": "eval.{{p_retailprice / 2}}", "label": "consts.tag + '-' + p_partkey", "name": "p_name"}, "format": {"name": "trim()|upper()|suffix('!')"},
    "rules": [{"field": "id", "kind": "regex", "pattern": "[0-8]$"}], "dedup_field": "id"}"""


@query("job_from_config", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_retailprice / 2 AS half, 't-' || p_partkey AS label, upper(p_name) || '!' AS name FROM part WHERE p_partkey % 10 <> 9 AND p_retailprice / 2 > 100")
def job_from_config(spark: SparkSession, d: str) -> DataFrame:
    at = _scratch(spark, "job")
    files.write_file(table(spark, d, "part"), f"{at}/in.csv", "csv")
    s = run(spark, Job.from_config(_JOB.replace("IN", f"{at}/in.csv").replace("OUT", f"{at}/out")))
    if s.failed:
        raise EngineError(EXECUTION, f"the job loads nothing: its {s.rejected} rejects reach its max_errors")
    return spark.read.parquet(f"{at}/out")


@query("job_summary", "SELECT 'good' AS job, count(*) FILTER (WHERE p_partkey % 10 <> 9) AS loaded, count(*) FILTER (WHERE p_partkey % 10 = 9) AS rejected, false AS failed FROM part UNION ALL SELECT 'failing', 0, count(*) FILTER (WHERE p_partkey % 10 = 9), true FROM part UNION ALL SELECT 'dry', count(*) FILTER (WHERE p_partkey % 10 <> 9), count(*) FILTER (WHERE p_partkey % 10 = 9), false FROM part")
def job_summary(spark: SparkSession, d: str) -> DataFrame:
    """A job within its limit of rejects, one beyond it, which loads nothing, and a dry run."""
    at, out = _scratch(spark, "summary"), []
    for name, more in (("good", {"max_errors": 10**9}), ("failing", {"max_errors": 1}), ("dry", {"max_errors": 10**9, "dry_run": True})):
        s = run(spark, Job([table(spark, d, "part")], destinations=[f"{at}/{name}"], rules=[checks.Rule("p_partkey", "regex", pattern="[0-8]$")], **more), f"{at}/{name}-dead")
        out.append((name, s.loaded, s.rejected, s.failed))
    return spark.createDataFrame(out, "job string, loaded long, rejected long, failed boolean")


@query("etl_formatter_copy_set", "SELECT c_custkey, c_name AS a, 'fixed' AS b FROM customer")
def etl_formatter_copy_set(spark: SparkSession, d: str) -> DataFrame:
    return etl.format_fields(table(spark, d, "customer").withColumns({"a": F.lit("x"), "b": F.lit("y")}), {"a": "copy(c_name)", "b": "set('fixed')"})[0].select("c_custkey", "a", "b")


@query("etl_lowercase_names", "SELECT n_nationkey, n_name FROM nation")
def etl_lowercase_names(spark: SparkSession, d: str) -> DataFrame:
    return etl.lowercase_names(table(spark, d, "nation").select(F.col("n_nationkey").alias("N_NationKey"), F.col("n_name").alias("N_NAME")))


@query("fn_first_last_item", "SELECT p_partkey, string_split(p_name, ' ')[1] AS f, string_split(p_name, ' ')[-1] AS l FROM part")
def fn_first_last_item(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", fn.first_item(words).alias("f"), fn.last_item(words).alias("l"))


@query("stream_load_rejects", "SELECT 'good' AS at, count(*) AS n FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT 'dead', count(*) FROM events WHERE event_id % 5 = 0")
def stream_load_rejects(spark: SparkSession, d: str) -> DataFrame:
    """What a stream loads and rejects, each batch once."""
    at = _scratch(spark, "load")
    events = _events(spark, d).select(F.when(F.col("event_id") % 5 == 0, "none").otherwise(F.col("event_id").cast("string")).alias("x"))
    windows.load(events, lambda b: etl.normalize(b, {"x": "int"}), f"{at}/good", f"{at}/dead", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/good").agg(F.lit("good").alias("at"), F.count(F.lit(1)).alias("n")).union(spark.read.parquet(f"{at}/dead").agg(F.lit("dead"), F.count(F.lit(1))))


# --- streams: what has arrived, against the same sums in batch


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a query's state, shared where the session names one."""
    import tempfile

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return f"{shared or tempfile.mkdtemp(prefix='weftline-')}/{name}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return windows.arriving(spark, d, table(spark, d, "events").schema, pattern="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(spark: SparkSession, df: DataFrame, mode: str = "complete") -> DataFrame:
    return windows.finished(df, _scratch(spark, "state"), _scratch(spark, "out"), mode)




@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = windows.tumbling(_events(spark, d), "ts", "1 hour", F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), keys=["event_type"])
    return _finished(spark, out).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query(
    "stream_sliding",
    "SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY w",
)
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    out = windows.sliding(_events(spark, d), "ts", "1 hour", "30 minutes", F.count(F.lit(1)).alias("n"))
    return _finished(spark, out).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query(
    "stream_session",
    """SELECT user_id, min(ts) AS window_start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
    (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""",
)
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    out = windows.sessions(_events(spark, d), "ts", "30 minutes", F.count(F.lit(1)).alias("n"), keys=["user_id"])
    return _finished(spark, out).select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("stream_keyed_state", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_keyed_state(spark: SparkSession, d: str) -> DataFrame:
    out = windows.running_totals(_events(spark, d), "user_id", "value")
    return windows.latest(out, _scratch(spark, "state"), _scratch(spark, "out"), "user_id").select("user_id", "n", F.round("total", 4).alias("total"))


@query("stream_dedup", "SELECT DISTINCT user_id FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = windows.deduplicated(_events(spark, d), "ts", ["user_id"], late="10000 days").select("user_id")
    return _finished(spark, out, "append")


# --- others


@query("access_column_filter", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def access_column_filter(spark: SparkSession, d: str) -> DataFrame:
    return access.restrict(table(spark, d, "customer"), "customer", access.Rules(allow_fields=("customer.*",), deny_fields=("c_acctbal", "customer.c_mktsegment")))


@query("access_service", "SELECT c_custkey, c_name FROM customer")
def access_service(spark: SparkSession, d: str) -> DataFrame:
    """A protected service shows every query what its rules allow."""
    e = Engine(spark)
    e.services.register_tables("crm", {"customer": table(spark, d, "customer")})
    e.services.protect("crm", access.Rules(allow_tables=("customer",), deny_fields=("c_acctbal", "customer.c_mktsegment", "c_nationkey")))
    return e.query("SELECT * FROM read_service('crm.customer')")


def _database(spark: SparkSession, d: str) -> Engine:
    """An engine with an embedded database (of this process, so for local sessions) that holds nation."""
    e = Engine(spark)
    e.services.register_jdbc("db", f"jdbc:derby:memory:weftline{uuid.uuid4().hex};create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    e.services.write(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "db.nation")
    return e


@query("jdbc_table", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def jdbc_table(spark: SparkSession, d: str) -> DataFrame:
    """Written to a database, and read back with the filter pushed down."""
    return _database(spark, d).query("SELECT n_nationkey, n_name FROM read_service('db.nation') WHERE n_regionkey = 2")


@query("jdbc_query", "SELECT n_regionkey, CAST(count(*) AS INTEGER) AS n FROM nation GROUP BY n_regionkey")
def jdbc_query(spark: SparkSession, d: str) -> DataFrame:
    """A query that the database runs itself."""
    return _database(spark, d).query('-- integration: db\nSELECT "n_regionkey", count(*) AS "n" FROM nation GROUP BY "n_regionkey"')


@query("jdbc_overwrite", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 0")
def jdbc_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """The table emptied (not dropped) and filled again."""
    e = _database(spark, d)
    e.services.write(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").filter("n_regionkey <> 0"), "db.nation", "overwrite")
    return e.query("SELECT * FROM read_service('db.nation')")


@query(
    "jdbc_merge_delete",
    """SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'new' ELSE n_name END AS n_name FROM nation WHERE n_regionkey <> 3
    UNION ALL SELECT 100 + n_nationkey, 'more' FROM nation WHERE n_regionkey = 1""",
)
def jdbc_merge_delete(spark: SparkSession, d: str) -> DataFrame:
    """Rows replaced, added and deleted by key in the database."""
    e, n = _database(spark, d), table(spark, d, "nation")
    some = n.filter("n_regionkey = 1")
    e.services.merge(some.select("n_nationkey", F.lit("new").alias("n_name")).union(some.select(F.col("n_nationkey") + 100, F.lit("more"))), "db.nation", "n_nationkey")
    e.services.delete(n.filter("n_regionkey = 3"), "db.nation", "n_nationkey")
    return e.query("SELECT n_nationkey, n_name FROM read_service('db.nation')")


@query("jdbc_key_value", "SELECT n_nationkey, 'n_name' AS key, n_name AS value, 'string' AS value_type FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', CAST(n_regionkey AS VARCHAR), 'int' FROM nation")
def jdbc_key_value(spark: SparkSession, d: str) -> DataFrame:
    """A table made for rows of key and value, and filled."""
    e = _database(spark, d)
    e.services.create_key_value("db.details", {"n_nationkey": "INTEGER"})
    e.services.write(etl.key_value(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), extra=["n_nationkey"]), "db.details")
    return e.query("SELECT * FROM read_service('db.details')")


@query("service_tables", """SELECT 'nation' AS "table", 'n_nationkey' AS "column" UNION ALL SELECT 'region', 'r_regionkey' UNION ALL SELECT 'region', 'r_name'""")
def service_tables(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(spark)
    e.services.register_tables("geo", {"nation": table(spark, d, "nation").select("n_nationkey", "n_name"), "region": table(spark, d, "region").select("r_regionkey", "r_name")})
    e.services.protect("geo", access.Rules(deny_fields=("nation.n_name",)))
    return e.services.tables("geo").select("table", "column")


@query("html_extract_title", "SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title\\s*>', 1), '<[^>]*>', '', 'g')), '') AS title FROM pages".replace("\\\\", "\\"))
def html_extract_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", html.tag_text("html", "title").alias("title"))


@query(
    "html_rows",
    """SELECT page_id, CAST(i - 1 AS INTEGER) AS position, nullif(regexp_extract(r, '<a href="([^"]*)"', 1), '') AS href, nullif(trim(regexp_extract(r, '<a [^>]*>(.*?)</a>', 1)), '') AS label
    FROM (SELECT page_id, unnest(items) AS r, unnest(range(1, len(items) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<li>.*?</li>') AS items FROM pages))""",
)
def html_rows(spark: SparkSession, d: str) -> DataFrame:
    return html.rows(table(spark, d, "pages"), "li", {"href": "a@href", "label": "a"})


@query("regex_source", "SELECT regexp_extract(url, '^(.*?)://(.*?)/(.*?)$', 1) AS scheme, regexp_extract(url, '^(.*?)://(.*?)/(.*?)$', 2) AS host, regexp_extract(url, '^(.*?)://(.*?)/(.*?)$', 3) AS rest FROM pages WHERE regexp_matches(url, '^(.*?)://(.*?)/(.*?)$')")
def regex_source(spark: SparkSession, d: str) -> DataFrame:
    return files.regex_lines(table(spark, d, "pages").select(F.col("url").alias("value")), "<scheme>://<host>/<rest>")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """A message for each customer, with signs of its own in every other one."""
    usual = F.concat(
        F.lit("MSH|^~\\&|LAB|HOSP|EHR|HOSP|20240102030405||ADT^A01|"), F.col("c_custkey"), F.lit("|P|2.5\rPID|1||"), F.col("c_custkey"), F.lit("^^^HOSP~"), F.col("c_nationkey"),
        F.lit("^^^STATE||"), F.regexp_replace("c_name", "#", "^"), F.lit("||19800101|X\rPV1|1|I|W^1^2"),
    )
    own = F.translate(usual, "|^~&", "!*%+")
    return dealt(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name"), "c_custkey").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, usual).otherwise(own).alias("raw_message"))


_SIGNS = "SELECT c_custkey AS id, c_custkey % 2 = 0 AS usual, c_custkey, c_nationkey, replace(c_name, '#', '^') AS name FROM customer"


@query(
    "hl7_segments",
    f"""SELECT id, s.position::INTEGER AS position, s.segment AS segment, s.n::INTEGER AS n, s.first AS first FROM (SELECT id, unnest([
        {{'position': 0, 'segment': 'MSH', 'n': 12, 'first': CASE WHEN usual THEN '|' ELSE '!' END}}, {{'position': 1, 'segment': 'PID', 'n': 8, 'first': '1'}},
        {{'position': 2, 'segment': 'PV1', 'n': 3, 'first': '1'}}]) AS s FROM ({_SIGNS}))""".replace("{_SIGNS}", _SIGNS),
)
def hl7_segments(spark: SparkSession, d: str) -> DataFrame:
    return hl7.segments(_messages(spark, d)).select("id", "position", "segment", F.size("fields").alias("n"), F.get("fields", F.lit(0)).alias("first"))


@query("hl7_document", f"SELECT id, 'ADT_A01' AS message_type, CAST(c_custkey AS VARCHAR) AS control_id, '20240102030405' AS timestamp, CASE WHEN usual THEN name ELSE translate(name, '|^~&', '!*%+') END AS patient, c_nationkey || '' AS second FROM ({_SIGNS})")
def hl7_document(spark: SparkSession, d: str) -> DataFrame:
    out = hl7.documents(_messages(spark, d))
    return out.select("id", "message_type", "control_id", "timestamp", F.get_json_object("json", "$.PID[0].patient_name").alias("patient"), hl7.field("raw_message", "PID", 3, component=1, repetition=2).alias("second"))


@query("hl7_repetitions", f"SELECT id, CAST(i AS INTEGER) AS repetition, CASE WHEN i = 0 THEN CAST(c_custkey AS VARCHAR) ELSE CAST(c_nationkey AS VARCHAR) END AS value, 4 AS parts FROM ({_SIGNS}), (SELECT unnest([0, 1]) AS i)")
def hl7_repetitions(spark: SparkSession, d: str) -> DataFrame:
    return hl7.repetitions(_messages(spark, d), "PID", 3).select("id", "repetition", F.get("components", F.lit(0)).alias("value"), F.size("components").alias("parts"))


@query("dag_layers", "SELECT CAST(0 AS INTEGER) AS layer, r_name AS job FROM region UNION ALL SELECT 1, n_name FROM nation UNION ALL SELECT 2, 'of ' || r_name FROM region")
def dag_layers(spark: SparkSession, d: str) -> DataFrame:
    """Jobs in layers: each nation's needs its region's, and a summary for each region needs its nations'. The needs come from the tables."""
    pairs = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    needs: dict[str, list[str]] = {}
    for nation, region in pairs.collect():
        needs.setdefault(region, [])
        needs[nation] = [region]
        needs.setdefault(f"of {region}", []).append(nation)
    return spark.createDataFrame([(i, job) for i, layer in enumerate(layers(needs)) for job in layer], "layer int, job string")


@query("win_top_per_group", "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def win_top_per_group(spark: SparkSession, d: str) -> DataFrame:
    turn = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").withColumn("r", F.row_number().over(turn)).filter("r <= 3").select("c_nationkey", "c_custkey")


from . import catalogue_io  # noqa: E402, F401  (registers its queries)
