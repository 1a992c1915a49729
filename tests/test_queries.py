"""Access rules on any query and the dialect's meaning in a query's text."""

import pytest
from pyspark.sql import functions as F

from weftline import lineage as lin
from weftline.errors import EngineError
from weftline.functions import dialect
from weftline.operators.access import Rules
from weftline.plans.engine import Engine


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, "ann", "p1", "on"), (2, "bob", "p2", "off")], "id int, name string, password string, status string")


@pytest.fixture
def engine(spark, users):
    e = Engine(spark)
    orders = spark.createDataFrame([(1, 10), (2, 20)], "user_id int, total int")
    e.services.register_tables("crm", {"users": users, "orders": orders, "payments": orders})
    e.services.protect("crm", Rules(allow_tables=("users", "orders"), deny_fields=("users.password",)))
    return e


def cols(df):
    return df.columns, sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(
    "text,names,rows",
    [
        ("SELECT * FROM read_service('crm.users') ORDER BY id", ["id", "name", "status"], [(1, "ann", "on"), (2, "bob", "off")]),
        ("SELECT u.password AS p, u.id FROM read_service('crm.users') u", ["id"], [(1,), (2,)]),
        ("SELECT id FROM read_service('crm.users') WHERE password = 'p2'", ["id"], [(2,)]),
        ("WITH c AS (SELECT id, concat(name, password) AS x, upper(name) AS n FROM read_service('crm.users')) SELECT a.x, b.n FROM c a JOIN c b ON a.id = b.id", ["n"], [("ANN",), ("BOB",)]),
        ("SELECT t.* FROM (SELECT id AS k, substr(password, 1, 1) AS s FROM read_service('crm.users')) t", ["k"], [(1,), (2,)]),
        ("SELECT id, (SELECT max(password) FROM read_service('crm.users') v) AS m FROM read_service('crm.users') u", ["id"], [(1,), (2,)]),
        ("SELECT o.total, u.* FROM read_service('crm.orders') o JOIN read_service('crm.users') u ON u.id = o.user_id", ["total", "id", "name", "status"], [(10, 1, "ann", "on"), (20, 2, "bob", "off")]),
        ("SELECT status, count(*) AS n, max(password) AS p FROM read_service('crm.users') GROUP BY ROLLUP(status)", ["status", "n"], [(None, 2), ("off", 1), ("on", 1)]),
        ("SELECT id, e FROM read_service('crm.users') LATERAL VIEW explode(split(password, '')) t AS e WHERE e = 'p'", ["id"], [(1,), (2,)]),
        ("SELECT count(password) AS a, count(*) AS b FROM read_service('crm.users')", ["b"], [(2,)]),
    ],
)
def test_denied_columns_leave_any_result(engine, text, names, rows):
    assert cols(engine.query(text)) == (names, sorted(rows, key=repr))


@pytest.mark.parametrize("text", [
    "SELECT * FROM read_service('crm.payments')", "SELECT 1 FROM read_service('crm.users') WHERE id IN (SELECT user_id FROM read_service('crm.payments'))", "SELECT password FROM read_service('crm.users')",
    "SELECT name FROM read_service('crm.users') UNION SELECT password FROM read_service('crm.users')", "WITH p AS (SELECT * FROM read_service('crm.payments')) SELECT 1 AS one FROM p",
])
def test_queries_that_rules_refuse(engine, text):
    with pytest.raises(EngineError) as e:
        engine.query(text)
    assert e.value.code == "INPUT"


def test_rules_of_the_session_catalog(spark, users):
    users.createOrReplaceTempView("app_users")
    spark.sql("CREATE OR REPLACE TEMP VIEW app_names AS SELECT id, name AS n, password AS w FROM app_users")
    e = Engine(spark)
    e.protect_tables(Rules(deny_tables=("secrets",), deny_fields=("app_users.password",)))
    assert e.query("SELECT * FROM app_names a").columns == ["id", "n"]  # a view shows nothing that its tables hide
    assert e.query("SELECT x.* FROM app_users x").columns == ["id", "name", "status"]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("_source_")]
    for v in ("app_users", "app_names"):
        spark.catalog.dropTempView(v)


def test_lineage_of_used_columns(spark, users):
    users.createOrReplaceTempView("lin_users")
    found = lin.lineage(spark.sql("SELECT name FROM lin_users u WHERE u.password LIKE 'p%' ORDER BY status"), lambda n: n if n == "lin_users" else None)
    assert {c for _, c in found.used} == {"name", "password", "status"} and found.tables == {"lin_users"}
    assert lin.mentioned(spark, "SELECT u.id, o.total FROM public.users u JOIN orders o ON u.id = o.user_id").relations == {("public.users", 26, 37), ("orders", 46, 51)}
    spark.catalog.dropTempView("lin_users")


def test_writes_keep_to_the_rules(engine, users):
    s = engine.services
    for write in (lambda: s.write(users, "crm.users"), lambda: s.write(users.select("id"), "crm.payments")):
        with pytest.raises(EngineError):
            write()
    s.write(users.select("id", "name"), "crm.users")
    assert engine.query("SELECT count(*) AS n FROM read_service('crm.users')").first().n == 4


def test_a_database_under_rules(spark, users):
    import uuid

    e = Engine(spark)
    s = e.services
    s.register_jdbc("db", f"jdbc:derby:memory:rules{uuid.uuid4().hex};create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    s.write(users, "db.users")
    s.write(users, "db.secrets")
    s.protect("db", Rules(deny_tables=("secrets",), deny_fields=("users.password",)))
    q = lambda t: e.query(f"-- integration: db\n{t}")
    assert cols(q('SELECT u."id", u."password" AS "p", upper(CAST(u."name" AS VARCHAR(20))) AS "n" FROM users u WHERE length(u."password") > 0')) == (["id", "n"], [(1, "ANN"), (2, "BOB")])
    assert q("SELECT * FROM users").columns == ["id", "name", "status"]
    assert q('SELECT count(*) AS "n" FROM users').first().n == 2
    for bad in ("SELECT * FROM secrets", 'SELECT "id" FROM users WHERE "id" IN (SELECT "id" FROM secrets)', 'SELECT "password" FROM users', "VALUES (1) ??"):
        with pytest.raises(EngineError):
            q(bad)
    for bad in ("DELETE FROM secrets", "UPDATE users u SET password = 'x' WHERE u.id = 1", "INSERT INTO users VALUES (3, 'c', 'p', 'on')", "DROP TABLE secrets", "not a statement"):
        with pytest.raises(EngineError):
            s.execute("db", bad)
    with pytest.raises(EngineError):
        s.merge(users, "db.users", "id")
    with pytest.raises(EngineError):
        s.create_key_value("db.secrets", {})
    assert s.execute("db", 'UPDATE users SET "status" = \'x\' WHERE "id" = 1') == 1
    assert s.merge(users.select("id", F.lit("new").alias("name")), "db.users", "id") == 2
    assert {(r.table.lower(), r.column) for r in s.tables("db").collect()} == {("users", c) for c in ("id", "name", "status")}


def test_first_and_last_go_by_sorted_names(spark):
    df = spark.createDataFrame([(1, "z"), (2, "a")], "id int, b string")
    e = Engine(spark)
    e.register_source("rows", lambda _: df)
    assert tuple(e.query("SELECT FIRST(b) AS f, LAST(b) AS l FROM read_rows('x')").first()) == ("a", "z")


def test_text_numbers_dates_and_objects_in_a_text(spark):
    df = spark.createDataFrame([("2024/01/05", "7", ["x"], {"tags": ["mysql", "db"], "n": "q"}), ("02/03/2024", "none", ["y"], {"tags": [None, "k"], "n": None})], "d string, s string, a array<string>, p struct<tags: array<string>, n: string>")
    e = Engine(spark)
    e.register_source("rows", lambda _: df)
    q = lambda t: [tuple(r) for r in e.query(t).collect()]
    assert q("SELECT YEAR(d) AS y, MONTH(d) AS m FROM read_rows('x') -- it's a comment") == [(2024, 1), (2024, 2)]
    assert q("SELECT SUM(s) AS t, MIN(s) AS lo, MAX(s) AS hi FROM read_rows('x')") == [(7.0, 7.0, 7.0)]
    assert q("SELECT SUM(d) AS t, MAX(d) AS hi FROM read_rows('x')") == [(0.0, None)]
    assert q("SELECT SUM(n) AS t FROM (SELECT 3 AS n UNION ALL SELECT 4) v") == [(7,)]
    assert q("SELECT CONCAT(a, a) AS c FROM read_rows('x')") == [(["x", "x"],), (["y", "y"],)]
    assert q("SELECT JSON_EXTRACT(p, '$.n') AS n, JSON_EXISTS(p, '$.tags[1]') AS h, JSON_VALUE(p, 'tags') AS f FROM read_rows('x')") == [("q", True, "mysql"), (None, True, "k")]
    now, today, stamp = q("SELECT NOW() AS n, CURRENT_DATE AS d, CURRENT_TIMESTAMP AS t FROM dual")[0]
    assert len(now) == len(stamp) == 19 and now[10] == " " and len(today) == 10 and now.startswith(today)
    assert dialect.spark_sql("SELECT t.current_date FROM t") == "SELECT t.current_date FROM t"
