"""Operators on small literal frames."""

import pytest
from pyspark.sql import functions as F

from weftline.errors import EngineError
from weftline.functions import columns as fn
from weftline.functions.registry import FunctionRegistry
from weftline.operators import access, checks, etl, hl7, relational
from weftline.plans import jobs
from weftline.plans.engine import Engine, Limits
from weftline.sources import files


def one(df):
    return [tuple(r) for r in df.collect()]


def test_paths(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('city', 'x', 'zip-code', '9') AS address, array(named_struct('year', 1, 'tags', array('a')), named_struct('year', null, 'tags', array('b'))) AS education, map('k', 5) AS m")
    got = df.select(*(fn.path(df, p).alias(f"c{i}") for i, p in enumerate(("address.city", 'address."zip-code"', "education->year", "education.tags", "education[1].year", "education[7].year", "m.k", "education[-1]"))))
    assert one(got) == [("x", "9", [1], ["a", "b"], None, None, 5, None)]
    with pytest.raises(EngineError):
        fn.path(df, "none.such")


def test_coercing_comparison(spark):
    df = spark.createDataFrame([("9", 10), ("a", 10), (None, 10)], "s string, n int")
    assert one(df.select(fn.compare(df, "s", "<", "n"))) == [(True,), (False,), (None,)]


def test_quantifiers_on_empty_and_null(spark):
    df = spark.createDataFrame([([],), (None,), ([1, 5],)], "a array<int>")
    assert one(df.select(fn.matches_any(3, "<", "a"), fn.matches_all(3, "<", "a"), fn.contains_all("a", 1, 5), fn.overlaps("a", 5, 9))) == [(False, True, False, False), (False, True, False, False), (True, False, True, True)]


def test_numeric_aggregates_of_text(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "s string")
    assert one(df.agg(fn.count_rows(), fn.sum_numeric("s"), fn.min_numeric("s"), fn.diff("s"))) == [(3, 1.0, 1.0, 0.0)]
    assert one(df.filter("false").agg(fn.sum_numeric("s"), fn.avg_numeric("s"))) == [(0.0, None)]


def test_bad_values_give_null(spark):
    df = spark.createDataFrame([("2024-02-30", "x")], "d string, s string")
    assert one(df.select(fn.year_of("d"), fn.to_number("s"), fn.cast_to("s", "int"), fn.arith(F.lit(1), "/", F.lit(0)), fn.date_minus("d", "d"))) == [(None,) * 5]


def test_years_of_all_layouts(spark):
    texts = ["2024-05-06T07:08:09Z", "2024-05-06T07:08:09.123456+02:00", "2024-05-06 07:08:09", "2024-05-06", "2024/05/06", "05/06/2024"]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    assert one(df.select(fn.year_of("d"), fn.month_of("d"))) == [(2024, 5)] * 6


def test_natural_join_without_common_columns_is_empty(spark):
    assert relational.natural_join(spark.range(3), spark.range(3).toDF("x")).count() == 0


def test_unnest_objects(spark):
    df = spark.sql("SELECT 1 AS id, array(named_struct('y', 1), named_struct('y', 2)) AS e UNION ALL SELECT 2, array()")
    got = relational.unnest(df, "e", "u", outer=True, on=lambda x: x["y"] > 1)
    assert sorted(one(got.select("id", "`u.y`"))) == [(1, 2), (2, None)]


def test_normalize_rejects_and_retry(spark):
    df = spark.createDataFrame([("1", "x"), ("zz", "y"), (None, "z")], "a string, b string")
    good, dead = etl.normalize(df, {"a": "int(11)"})
    assert sorted(one(good), key=str) == [(1, "x"), (None, "z")] and dead.count() == 1
    again, _ = etl.retry(dead, df.schema, lambda d: etl.normalize(d.withColumn("a", F.lit("7")), {"a": "int"}))
    assert one(again) == [(7, "y")]
    with pytest.raises(EngineError):
        etl.normalize(df, {"a": "nonsense"})


def test_formatter(spark):
    df = spark.createDataFrame([("31122024", " u ", None), ("bad", "v", "s"), ("", "w", "")], "d string, u string, s string")
    good, dead = etl.format_fields(df, {"d": "transform(d, 'YYYY-MM-DD', 'DDMMYYYY')", "u": "trim()|prefix('id, ')|upper()", "s": "default('new')"})
    assert sorted(one(good)) == [("", "ID, W", "new"), ("2024-12-31", "ID, U", "new")] and dead.count() == 1


def test_key_value(spark):
    df = spark.createDataFrame([(1, 2.5, True)], "Id int, Score double, ok boolean")
    assert sorted(one(etl.key_value(df, extra=["Id"]))) == [(1, "ok", "true", "bool"), (1, "score", "2.5", "float")]
    with pytest.raises(EngineError):
        etl.key_value(df, extra=df.columns)


def test_aggregate_rounds_half_up(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "x")], "k string, v string")
    assert sorted(one(etl.aggregate(df, ["k"], [("avg", "v"), ("min", "v"), ("count", "v")]))) == [("a", 2, 1.0, 2), ("b", 0, 0.0, 1)]


def test_checkpoint(spark, tmp_path):
    df = spark.range(10).toDF("id")
    c = etl.Checkpoint(spark, str(tmp_path / "c"), "id")
    assert c.last() is None and c.new_rows(df).count() == 10
    c.save(df.filter("id < 4"))
    assert c.new_rows(df).count() == 6


def test_rules_and_breaker(spark):
    df = spark.createDataFrame([(1, "a@b.com", ""), (1, "no", "x"), (2, None, None)], "id int, mail string, t string")
    v = checks.validate(df, [checks.Rule("id", "unique"), checks.Rule("mail", "email"), checks.Rule("t", "not_null"), checks.Rule("id", "range", 0, 1)])
    assert [sorted(r.errors) for r in v.orderBy("id", "mail").collect()] == [["id: unique", "t: not_null"], ["id: unique", "mail: email"], ["id: range", "mail: email", "t: not_null"]]
    assert checks.error_rate(v, 50.0, 3).first().tripped
    with pytest.raises(EngineError):
        checks.passes(checks.Rule("id", "nonsense"))


def test_detected_kinds(spark):
    df = spark.createDataFrame([("1", "2.5", "2024-01-02", "a@b.co", ""), ("0", "3", "2024-01-03", "c@d.co", "x")], "b string, f string, d string, e string, s string")
    kinds = {r.column_name: r.kind for r in checks.detect_kinds(df).collect()}
    assert kinds == {"b": "bool", "f": "float", "d": "date", "e": "email", "s": "string"}
    assert "e TEXT NOT NULL" in checks.create_table("t", checks.detect_kinds(df), "sqlite")


def test_access(spark):
    df = spark.createDataFrame([(1, "x", "p")], "id int, name string, password string")
    assert access.restrict(df, "users", access.Rules(allow_fields=("users.*",), deny_fields=("password",))).columns == ["id", "name"]
    with pytest.raises(EngineError):
        access.restrict(df, "users", access.Rules(deny_tables=("users",)))


def test_hl7(spark, tmp_path):
    m = "MSH|^~\\&|A|B|C|D|20240102||ADT^A01|42|P|2.5\rPID|1||77^^^H||Roe^J<n>\rOBX|1|a\rOBX|2|b"
    (tmp_path / "m.hl7").write_text(m + "\n\n" + m)
    got = files.read_file(spark, str(tmp_path / "m.hl7"))
    assert got.count() == 2
    d = hl7.documents(got).first()
    assert (d.message_type, d.control_id, d.timestamp) == ("ADT_A01", "42", "20240102")
    assert '"patient_id":"77^^^H"' in d.json and len(d.segments["OBX"]) == 2 and "Roe^J&lt;n&gt;" in d.xml
    assert [r.segment for r in hl7.segments(got.limit(1)).orderBy("position").collect()] == ["MSH", "PID", "OBX", "OBX"]


def test_engine(spark, tmp_path):
    (tmp_path / "u.csv").write_text("id,name\n1,a\n2,b\n3,c\n")
    e = Engine(spark, Limits(max_rows=2))
    got = e.rows(f"SELECT name FROM read_file('{tmp_path}/u.csv')")
    assert len(got) == 2 and got.truncated and not e.rows(f"SELECT name FROM read_file('{tmp_path}/u.csv') LIMIT 2").truncated
    assert sum(1 for _ in e.iterate(f"SELECT name FROM read_file('{tmp_path}/u.csv')")) == 3
    with e.using(max_rows=None):
        assert [r.name for r in e.rows(f"SELECT name FROM read_file('{tmp_path}/u.csv') WHERE id = :x AND 'read_file(''q'')' <> ''", {"x": "2"})] == ["b"]
    for text, code in (("SELEC 1", "PARSE"), ("SELECT 1 FROM read_nothing('x')", "INPUT"), ("SELECT nope FROM read_service('x.y')", "INPUT"), ("SELECT zzz", "INPUT")):
        with pytest.raises(EngineError) as err:
            e.query(text)
        assert err.value.code == code
    with e.using(timeout_s=2), pytest.raises(EngineError) as err:
        e.rows("SELECT count(*) FROM range(0, 100000000000, 1, 8) WHERE sha2(cast(id AS STRING), 512) = 'x'")
    assert err.value.code == "TIMEOUT"


def test_registry(spark):
    r = FunctionRegistry(spark)
    r.register_expression("TWICE", "x INT", "INT", "x * 2")
    assert spark.sql("SELECT twice(4)").first()[0] == 8
    for f in (lambda: r.register_expression("twice", "x INT", "INT", "x"), lambda: (r.freeze(), r.unregister("TWICE"))):
        with pytest.raises(EngineError):
            f()
    r.unfreeze()
    r.unregister("TWICE")
    assert r.lookup("TWICE") is None


def test_job(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,name,day\n1, ann ,02012024\n2,bob,bad\nx,cy,03012024\n1, ann ,02012024\n")
    job = jobs.Job.from_config(f'{{"source": "{tmp_path}/in.csv", "destinations": ["{tmp_path}/out"], "normalize": {{"id": "int"}}, "mapping": {{"id": "id", "name": "name", "day": "day"}}, "format": {{"name": "trim()|upper()", "day": "transform(day, \'YYYY-MM-DD\', \'DDMMYYYY\')"}}, "dedup_field": "id"}}')
    s = jobs.run(spark, job, str(tmp_path / "dead"))
    assert (s.loaded, s.rejected, s.failed) == (1, 2, False)
    assert one(spark.read.parquet(str(tmp_path / "out"))) == [(1, "ANN", "2024-01-02")]
    assert {r.step for r in spark.read.parquet(str(tmp_path / "dead")).collect()} == {"normalize", "format"}


def test_layers():
    assert jobs.layers({"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c"]}) == [["a"], ["b", "c"], ["d"]]
    for bad in ({"a": ["z"]}, {"a": ["b"], "b": ["a"]}):
        with pytest.raises(EngineError):
            jobs.layers(bad)


def test_regex_lines(spark):
    df = spark.createDataFrame([("GET /a.b 200",), ("nonsense",)], "value string")
    assert one(files.regex_lines(df, "<verb> /<path> <code>")) == [("GET", "a.b", "200")]


def test_rest_service(spark):
    import http.server
    import json
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = json.dumps({"data": {"rows": [{"id": 1, "n": "a"}, {"id": 2}]}}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    e = Engine(spark)
    e.services.register_rest("api", f"http://127.0.0.1:{server.server_port}", "id long, n string", "data.rows")
    assert one(e.query("SELECT id, n FROM read_service('api') ORDER BY id")) == [(1, "a"), (2, None)]
    server.shutdown()
    with pytest.raises(EngineError):
        e.services.read("nobody.t")


def test_streams_load_good_rows_and_rejects(spark, tmp_path):
    from weftline.streaming import windows

    spark.createDataFrame([("1", "a"), ("x", "b")], "n string, s string").write.parquet(str(tmp_path / "in"))
    stream = windows.arriving(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    for _ in range(2):  # what was loaded is not loaded again
        windows.load(stream, lambda b: etl.normalize(b, {"n": "int"}), str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "state")).awaitTermination()
    assert one(spark.read.parquet(str(tmp_path / "good")).select("n", "s")) == [(1, "a")]
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 1


def test_rows_keep_the_callers_job_group(spark):
    sc = spark.sparkContext
    sc.setJobGroup("mine", "the caller's")
    Engine(spark).rows("SELECT 1")
    assert sc.getLocalProperty("spark.jobGroup.id") == "mine" and sc.getLocalProperty("spark.job.description") == "the caller's"
    sc.setLocalProperty("spark.jobGroup.id", None)


def test_expressions_leave_quoted_text(spark):
    df = spark.createDataFrame([(1, "a")], "x int, s string")
    for text, want in (
        ("x == 1 ? 'a==b && c || now()' : 'q'", "a==b && c || now()"), ("x == 2 ? 'no' : s == \"a\" ? 'is: yes?' : 'none'", "is: yes?"), ("x > 0 ? (x > 5 ? 'big' : 'small') : 'neg'", "small"),
        ("x == 1 && s == 'a' ? upper(s) : 'z'", "A"), ("s::string", "a"),
    ):
        assert df.select(F.expr(etl.expression(text)).alias("y")).first().y == want, text
    with pytest.raises(EngineError):
        etl.expression("x ? 'only'")


def test_format_steps_cover_the_text():
    assert etl.format_steps("trim() | replace('a(b', \"c\")") == [("trim", []), ("replace", ["a(b", "c"])]
    for bad in ("trim() uppr", "|trim()", "trim() upper()", ""):
        with pytest.raises(EngineError):
            etl.format_steps(bad)


def test_hl7_signs_of_the_message(spark, tmp_path):
    m = r"MSH#*!%+#A#B#C#D#2024##ADT*A01#42#P#2.5" + "\rPID#1##77*a%F%b***H!88##Roe*Jo%S%e"
    (tmp_path / "m.hl7").write_text("FHS|^~\\&|x\r\n" + m.replace("#", "|").replace("\r", "\r\n") + "\n\n\n" + m.replace("#", "|") + "\n")
    got = files.read_file(spark, str(tmp_path / "m.hl7"))
    assert [r.raw_message for r in got.collect()] == [m.replace("#", "|")] * 2
    df = spark.createDataFrame([(m,)], "raw_message string")
    d = hl7.documents(df, names={"PID": {5: "who"}}).first()
    assert (d.message_type, d.control_id) == ("ADT_A01", "42") and '"who":"Roe*Jo%S%e"' in d.json
    f = lambda *a, **k: df.select(hl7.field("raw_message", *a, **k).alias("x")).first().x
    assert [f("PID", 3), f("PID", 3, component=2, repetition=1), f("PID", 3, repetition=2), f("PID", 5, component=2), f("PID", 4), f("MSH", 1)] == ["77*a%F%b***H!88", "a#b", "88", "Jo*e", None, "#"]
    assert [r.components[0] for r in hl7.repetitions(df, "PID", 3).orderBy("repetition").collect()] == ["77", "88"]


def test_service_rules(spark):
    e = Engine(spark)
    e.services.register_tables("db", {"users": spark.createDataFrame([(1, "x", "p")], "id int, name string, password string"), "secrets": spark.range(1)})
    e.services.protect("db", access.Rules(deny_tables=("secrets",), deny_fields=("users.password",)))
    assert e.query("SELECT * FROM read_service('db.users')").columns == ["id", "name"]
    for text in ("SELECT * FROM read_service('db.secrets')", "SELECT password FROM read_service('db.users')", "-- integration: db\nSELECT * FROM secrets"):
        with pytest.raises(EngineError) as err:
            e.query(text)
        assert err.value.code == "INPUT"
    row = spark.createDataFrame([(2, "y", "q")], "id int, name string, password string")
    with pytest.raises(EngineError):  # a column that may not be read may not be written
        e.services.write(row, "db.users")
    e.services.write(row.drop("password"), "db.users")
    assert e.query("SELECT count(*) AS n FROM read_service('db.users')").first().n == 2
    with pytest.raises(EngineError):
        e.services.write(spark.range(1), "db.secrets")


def test_job_loads_all_destinations_or_none(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "zz")], "id int, key string")
    names = spark.createDataFrame([("a", "A"), ("b", "B")], "k string, v string")
    settings = dict(mapping={"id": "id", "name": "eval.{{lookupIn('names', 'k', key, 'v')}}"}, lookups={"names": names})
    to = [f"{tmp_path}/all", {"path": f"{tmp_path}/one", "kind": "json", "filter": "id == 1"}]
    s = jobs.run(spark, jobs.Job([df], destinations=to, **settings), str(tmp_path / "dead"))
    assert (s.loaded, s.rejected, s.failed) == (3, 1, False)
    assert one(spark.read.parquet(f"{tmp_path}/all").orderBy("id")) == [(1, "A"), (2, "B")] and spark.read.json(f"{tmp_path}/one").count() == 1
    assert "names.k = zz" in spark.read.parquet(str(tmp_path / "dead")).first().reason
    s = jobs.run(spark, jobs.Job([df], destinations=[f"{tmp_path}/not"], max_errors=1, **settings))
    assert s.failed and s.loaded == 0 and not (tmp_path / "not").exists()
    dry = jobs.run(spark, jobs.Job([df], destinations=[f"{tmp_path}/not"], dry_run=True, **settings))
    assert dry.loaded == 2 and not (tmp_path / "not").exists()


def test_plans_that_must_hold_at_scale(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    big = spark.range(100).withColumn("v", F.col("id") % 7)
    assert "Window" not in plan(checks.validate(big, [checks.Rule("v", "unique")]))
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert "Broadcast" not in plan(relational.lookup_join(big, big, "id", "v", "v", "w"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(k, None if k == 3 else f"n,{k}\"x") for k in range(2500)], "id int, name string")
    for kind in ("csv", "json", "json_array", "orc", "parquet"):
        files.write_file(df, f"{tmp_path}/{kind}", kind, one_file=True)
        got = files.read_file(spark, f"{tmp_path}/{kind}", {"json_array": "json", "json": "ndjson"}.get(kind, kind))
        assert got.count() == 2500 and got.filter("name is null").count() == 1, kind


def test_mapping_contexts(spark):
    df = spark.createDataFrame([(1,)], "x int")
    values = {"a": 5, "param": {"day": "mon"}, "enums": {"state": {"on": 1}}}
    got = etl.map_fields(df, {"p": "consts.a", "q": "param.day", "r": "enums.state.on", "s": "query.none", "t": "x"}, values).first()
    assert tuple(got) == (5, "mon", 1, None, 1)


def test_idempotency_states_expire(spark):
    df = spark.createDataFrame([(k,) for k in range(4)], "id int")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    done = df.select(etl.record_key("id").alias("key"), F.when(F.col("id") == 1, "failed").otherwise("completed").alias("state"), F.when(F.col("id") == 2, at - F.make_dt_interval(days=F.lit(9))).otherwise(at).alias("at")).filter("state is not null")
    left = etl.not_yet_done(df, done.limit(4), ["id"], now=at + F.make_dt_interval(secs=F.lit(10)), lives_s=3600)
    assert sorted(r.id for r in left.collect()) == [1, 2]


def test_rest_retries_posts_and_pages(spark):
    import http.server
    import json
    import threading

    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            asked.append((self.path, self.headers["Authorization"], body))
            fail = len([a for a in asked if a[0] == self.path]) == 1
            out = json.dumps({"data": {"items": [{"id": int(self.path[-1])}]}}).encode()
            self.send_response(503 if fail else 200)
            self.send_header("Content-Length", str(0 if fail else len(out)))
            self.end_headers()
            self.wfile.write(b"" if fail else out)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    e = Engine(spark)
    e.services.register_rest("g", f"http://127.0.0.1:{server.server_port}/graphql", "id long", "data.items", method="POST", headers={"Authorization": "Bearer t"}, body='{"query": "{items {id}}"}', pages=3)
    assert sorted(one(e.query("SELECT id FROM read_service('g')"))) == [(1,), (2,), (3,)]
    assert {a[1] for a in asked} == {"Bearer t"} and len(asked) == 6
    server.shutdown()


def test_entry_without_the_optional_part():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['public_tokenizers'] = None\nimport __spark_entry__ as e\nassert 'join_inner' in e.queries() and 'join_inner' in e.oracle_sql() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)


def test_page_rows(spark):
    from weftline.sources import html

    page = '<div class="card big" id="x"><h2>A <b>b</b></h2><a href="/1">one</a></div><div class="card-no">n</div><div class=\'card\'><p>only</p></div>'
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    got = html.rows(df, "div.card", {"title": "h2", "to": "a@href", "id": "@id", "all": ""}).orderBy("position").collect()
    assert [tuple(r) for r in got] == [(1, 0, "A b", "/1", "x", "A bone"), (1, 1, None, None, None, "only")]


def test_polled_stream(spark, tmp_path):
    import http.server
    import json
    import threading
    from urllib.parse import parse_qs, urlparse

    from weftline.streaming import windows

    items = [{"id": k} for k in range(5)]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen = int(parse_qs(urlparse(self.path).query)["offset"][0])
            out = json.dumps(items[seen : seen + 3]).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    stream = windows.polled(spark, f"http://127.0.0.1:{server.server_port}/items", "id long")
    for _ in range(2):  # what was read is not read again
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
        q.stop()
        items += [{"id": 5}] if len(items) == 5 else []
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(6))
    server.shutdown()
