"""Sources, sinks, jobs and streams: what must neither be lost nor be there twice."""

import http.server
import json
import threading
import time
import uuid
from collections import Counter
from pathlib import Path
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from weftline.errors import EngineError
from weftline.operators import checks, etl, hl7_structures
from weftline.plans import jobs
from weftline.plans.engine import Engine
from weftline.sources import files, html, jdbc, web_sink
from weftline.streaming import state, windows


@pytest.fixture
def serve():
    """Start a web server from a function (method, path, headers, body) -> (status, value or None, headers)."""
    servers = []

    def start(answer):
        class Handler(http.server.BaseHTTPRequestHandler):
            def do(self):
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                status, value, headers = answer(self.command, self.path, self.headers, body)
                out = b"" if value is None else json.dumps(value).encode()
                self.send_response(status)
                for k, v in {**headers, "Content-Length": str(len(out))}.items():
                    self.send_header(k, v)
                self.end_headers()
                self.wfile.write(out)

            do_GET = do_POST = do_PUT = do

            def log_message(self, *a):
                pass

        server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        servers.append(server)
        return f"http://127.0.0.1:{server.server_port}"

    yield start
    for s in servers:
        s.shutdown()


# --- HL7


def plain_messages(text):
    out, held = [], []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") + [""]:
        if not line.strip() or line.startswith(("MSH", "FHS", "BHS", "BTS", "FTS")):
            if held:
                out.append("\r".join(held))
            held = []
        if line.strip() and not line.startswith(("FHS", "BHS", "BTS", "FTS")):
            held.append(line)
    return out


@pytest.mark.parametrize("end", ["\r", "\n", "\r\n"])
@pytest.mark.parametrize("cut", ["4k", "1k", "128m"])
def test_hl7_files_lose_nothing(spark, tmp_path, end, cut):
    messages = [f"MSH{s}^~\\&{s}A{s}{k}{end}PID{s}{k}{end}NTE{s}1{s}{s}see MSH{s}x and MSH|{end}PV1{s}{k}" for k, s in enumerate("|!#" * 40)]
    text = "FHS|x" + end + end.join(m + (end * (1 + (k % 4 == 0))) if k % 3 else m for k, m in enumerate(messages)) + end + end + "PV1|lost its head" + end + "OBX|1" + end + "BTS|1" + end
    (tmp_path / "a.hl7").write_bytes(text.encode())
    (tmp_path / "b.hl7").write_bytes((end * 3 + messages[0]).encode())
    (tmp_path / "c.hl7").write_bytes(b"")
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
    try:
        got = files.hl7_messages(spark, str(tmp_path / "*.hl7")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    want = plain_messages(text)
    assert len(want) == 121
    assert Counter(r.raw_message for r in got if r.source_path.endswith("a.hl7")) == Counter(want)
    assert [r.raw_message for r in got if r.source_path.endswith("b.hl7")] == [messages[0].replace(end, "\r")]


ORU = "MSH|^~\\&|SEND|FAC|RCV|RCV|20220301||ORU^R01|M1|P|2.5\rPID|1||123^^^HOSP^MR~9||DOE^JANE\rPV1|1|I|W^1\rORC|RE\rOBR|1|||GLU^Glucose\rNTE|1||a\rOBX|1|NM|GLU^Glucose||5.5|mmol\rNTE|1||low \\T\\ <ok>\rOBX|2|NM|X||6\rOBR|2|||HB\rOBX|1|NM|HB||12\rZZZ|1"


def test_hl7_nests_by_structure(spark):
    rows = [(ORU,), (None,), (" ",), ("MSH|^~\\&|A|B|||1||ACK|9|P\rMSA|AA|1",), ("MSH!*%+:!A!B!!!1!!ADT*A01!9!P\rEVN!A01\rPID!1!!5*x:y%7\rNK1!1!Roe*Ann\rNK1!2!Roe*Jo\rPV1!1!I",), ("MSH|^~\\&|A|B|||1||QQQ^Z9|9|P\rPID|1\rPID|2",), ("MSH|^~\\&|A|B|||1||ADT^A02|9|P\rPV1|1",)]
    got = hl7_structures.structured(spark.createDataFrame(rows, "raw_message string")).collect()
    assert [r.structure for r in got] == ["ORU_R01", None, None, "ACK", "ADT_A01", "QQQ_Z9", "ADT_A02"]
    oru = json.loads(got[0].json)
    result = oru["patient_result"][0]
    assert result["patient"]["pid"]["patient_id"] == [{"id": "123", "assigning_authority": "HOSP", "identifier_type": "MR"}, {"id": "9"}]
    assert result["patient"]["visit"]["pv1"]["assigned_location"] == {"point_of_care": "W", "room": "1"}
    orders = result["order_observation"]
    assert [[o["obx"]["value"] for o in x["observation"]] for x in orders] == [["5.5", "6"], ["12"]]
    assert orders[0]["nte"] == [{"set_id": "1", "comment": "a"}] and orders[0]["observation"][0]["nte"][0]["comment"] == "low & <ok>"
    assert "orc" in orders[0] and "orc" not in orders[1] and got[0].unplaced == ["ZZZ"] and got[0].missing == []
    assert "<PID><set_id>1</set_id>" in got[0].xml and "low &amp; &lt;ok&gt;" in got[0].xml and got[0].xml.count("<OBX>") == 3
    adt = json.loads(got[4].json)
    assert adt["pid"]["patient_id"] == [{"id": "5", "check_digit": {"subcomponent_1": "x", "subcomponent_2": "y"}}, {"id": "7"}]
    assert [n["name"]["given_name"] for n in adt["nk1"]] == ["Ann", "Jo"] and adt["evn"] == {"event_type": "A01"}
    assert len(json.loads(got[5].json)["pid"]) == 2
    assert got[6].missing == ["message.EVN", "message.PID"]


def test_hl7_structures_are_well_formed():
    for text in hl7_structures.STRUCTURES.values():
        assert hl7_structures.structure(hl7_structures.STRUCTURES.get(text, text)).parts[0].name == "MSH"
    for bad in ("MSH [PID", "MSH PID]", "[PID PV1]"):
        with pytest.raises(EngineError):
            hl7_structures.structure(bad)


# --- pages


def test_rows_nest_as_the_page_does(spark):
    page = """<div class="r a" id=1><a href="/1">one</a><div class="r"><a href="/2">two<br>x</a></div><a href="/3">three</a></div>
      <ul><li>a<li class="z">b <ul><li>inner</ul><li>c</ul><p>open<p>next</i><div class="r"><span><a>no link</a></span>"""
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id int, html string")
    got = lambda row, f: [tuple(r)[1:] for r in html.rows(df, row, f).orderBy("page_id", "position").collect()]
    assert got("div.r", {"to": "a@href", "last": "a[href$='3']", "id": "@id"}) == [(0, "/1", "three", "1"), (1, "/2", None, None), (2, None, None, None)]
    assert got("div.r > a", {"t": ""}) == [(0, "one"), (1, "twox"), (2, "three")]
    assert got("div div.r a, span a", {"t": ""}) == [(0, "twox"), (1, "no link")]
    assert got("li", {"t": ""}) == [(0, "a"), (1, "b inner"), (2, "inner"), (3, "c")]
    assert got("ul ul > li", {"t": ""}) == [(0, "inner")] and got("p", {"t": ""})[0] == (0, "open")
    assert got("[id]", {"t": "@id"}) == [(0, "1")]
    for bad in ("", "a[", "a:hover", "div > > a"):
        with pytest.raises(EngineError):
            html.Selector(bad)


# --- schemas


def test_schema_changes_and_evolution(spark):
    old = spark.createDataFrame([(1, "x", (1, [2]), 5, True)], "a int, b string, s struct<u: int, v: array<int>>, c bigint, d boolean")
    new = spark.createDataFrame([(2, 1.5, (3.5, [2**40], "w"), 7, "t")], "a bigint, e double, s struct<u: double, v: array<bigint>, w: string>, c int, d string")
    assert {tuple(r) for r in checks.difference(old, new).collect()} == {
        ("a", "widened", "int", "bigint"), ("b", "removed", "string", None), ("e", "added", None, "double"), ("s.u", "widened", "int", "double"), ("s.v[]", "widened", "int", "bigint"),
        ("s.w", "added", None, "string"), ("c", "narrowed", "bigint", "int"), ("d", "widened", "boolean", "string"),
    }
    both = checks.evolved(old, new)
    assert both.schema.simpleString() == "struct<a:bigint,b:string,s:struct<u:double,v:array<bigint>,w:string>,c:bigint,d:string,e:double>"
    assert both.filter("a = 1").select("s.u", "s.w", "d", "e").first() == (1.0, None, "true", None) and both.filter("a = 2").first().s.v == [2**40]
    assert checks.changes(old.schema, old.schema) == []
    with pytest.raises(EngineError):
        checks.evolved(old.select("s"), old.select(F.lit(1).alias("s")))
    assert checks.evolved(spark.sql("SELECT 1.25BD AS x"), spark.sql("SELECT 12345.5BD AS x")).schema["x"].dataType.simpleString() == "decimal(7,2)"


# --- jobs


def rows_of(spark, path):
    return sorted(r[0] for r in spark.read.parquet(str(path)).collect())


def test_a_failing_destination_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([(k,) for k in range(10)], "id int")
    bad = jobs.Job([df], destinations=[f"{tmp_path}/a", {"path": f"{tmp_path}/b", "kind": "no such"}])
    with pytest.raises(EngineError):
        jobs.run(spark, bad, str(tmp_path / "dead"))
    assert [p.name for p in tmp_path.iterdir()] == []
    failing = jobs.Job([df], destinations=[f"{tmp_path}/a", {"path": f"{tmp_path}/b", "mapping": {"x": "eval.{{raise_error('no')}}"}}])
    with pytest.raises(Exception, match="no"):
        jobs.run(spark, failing, state=f"{tmp_path}/state", run_id="r")
    assert not (tmp_path / "a").exists() and not (tmp_path / "b").exists()
    assert tuple(jobs.status(spark, f"{tmp_path}/state").first())[:2] == ("r", "staged")


def test_a_run_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(k, "x" if k < 3 else str(k)) for k in range(10)], "id int, v string")
    job = jobs.Job([df], destinations=[f"{tmp_path}/a", {"path": f"{tmp_path}/b", "filter": "id > 5"}, {"path": f"{tmp_path}/c", "mode": "overwrite"}], normalize={"v": "int"})
    df.filter("id < 2").write.parquet(f"{tmp_path}/c")
    run = lambda: jobs.run(spark, job, f"{tmp_path}/dead", f"{tmp_path}/state", "r1")
    whole, calls = jobs._publish, []

    def stops(store, to):
        calls.append(to["path"])
        if to["path"].endswith("/b"):
            raise OSError("the power went")
        whole(store, to)

    monkeypatch.setattr(jobs, "_publish", stops)
    with pytest.raises(OSError):
        run()
    assert tuple(jobs.status(spark, f"{tmp_path}/state").first()) == ("r1", "committed", 4, 2, 18, 3)
    monkeypatch.setattr(jobs, "_publish", whole)
    monkeypatch.setattr(jobs, "_staged", lambda *a: pytest.fail("the plan runs once"))
    for _ in range(2):
        s = run()
        assert (s.loaded, s.rejected, s.failed, s.rate) == (18, 3, False, 30.0) and s.steps["extract"] == 10 and s.steps["normalize"] == 7
        assert (rows_of(spark, tmp_path / "a"), rows_of(spark, tmp_path / "b"), rows_of(spark, tmp_path / "c")) == (list(range(3, 10)), [6, 7, 8, 9], list(range(3, 10)))
        assert spark.read.parquet(f"{tmp_path}/dead").count() == 3
    assert tuple(jobs.status(spark, f"{tmp_path}/state").first())[1] == "done"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b", "c", "dead", "state"]


def test_a_source_is_read_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(k, "x" if k < 3 else str(k)) for k in range(10)], "id int, v string").coalesce(1).mapInArrow(count, "id int, v string")
    jobs.run(spark, jobs.Job([df], destinations=[f"{tmp_path}/a", f"{tmp_path}/b"], normalize={"v": "int"}), f"{tmp_path}/dead")
    assert seen.value == 10


def test_steps_in_an_order_of_their_own_and_letters(spark, tmp_path):
    df = spark.createDataFrame([(k, "x" if k < 3 else str(k)) for k in range(10)], "id int, v string")
    steps = [{"filter": "id > 0"}, {"normalize": {"v": "int"}}, {"filter": "v < 8"}, {"mapping": {"n": "v"}}, {"rules": [{"field": "n", "kind": "range", "low": 4, "high": 9}]}]
    job = jobs.Job([df], destinations=[f"{tmp_path}/a"], steps=steps, letters={"wait_s": 60, "most": 1})
    s = jobs.run(spark, job, f"{tmp_path}/dead")
    assert rows_of(spark, tmp_path / "a") == [4, 5, 6, 7] and s.steps == {"extract": 10, "filter": 9, "normalize": 7, "filter2": 5, "mapping": 5, "rules": 4}
    assert Counter((r.step, r.state, r.attempts) for r in spark.read.parquet(f"{tmp_path}/dead").collect()) == {("normalize", "exhausted", 1): 2, ("checks", "exhausted", 1): 1}
    with pytest.raises(EngineError):
        jobs.run(spark, jobs.Job([df], steps=[{"no": 1}]))


# --- databases


@pytest.fixture
def database(spark):
    e = Engine(spark)
    e.services.register_jdbc("db", f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    return e.services


def test_a_batch_counts_once(spark, database):
    database.write(spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, v double"), "db.t")
    batch = spark.createDataFrame([(2, 5.0), (3, 3.0), (3, 4.0), (None, 9.0)], "id int, v double")
    assert database.merge_once(batch, "db.t", "id", "s", 7)
    database.write(spark.createDataFrame([(9, 9.0)], "id int, v double"), "db.t")
    assert not database.merge_once(batch.withColumn("v", F.lit(0.0)), "db.t", "id", "s", 7)  # runs again: no effect
    assert sorted(map(tuple, database.read("db.t").collect())) == [(1, 1.0), (2, 5.0), (3, 4.0), (9, 9.0)]
    assert database.merge_once(batch.limit(1).withColumn("v", F.lit(6.0)), "db.t", "id", "s", 8)
    with pytest.raises(Exception):
        database.merge_once(batch.withColumn("none", F.lit(1)), "db.t", "id", "s", 9)
    assert database.merge_once(batch, "db.t", "id", "s", 9)  # a batch that failed has left nothing
    assert {r.table for r in database.tables("db").collect()} == {"T", "WEFTLINE_BATCHES"}  # no staged table stays


def test_a_skewed_table_is_read_in_even_parts(spark, database):
    rows = [(k, 7 if k < 600 else k) for k in range(1000)] + [(2000 + k, None) for k in range(20)]
    database.write(spark.createDataFrame(rows, "id int, k int"), "db.t")
    df = database.read_in_parts("db.t", "id", 5)
    sizes = sorted(r[1] for r in df.groupBy(F.spark_partition_id()).count().collect())
    assert df.count() == 1020 and len(sizes) == 5 and sizes[0] >= 200
    skewed = database.read_in_parts("db.t", "k", 5)
    assert sorted(map(repr, skewed.collect())) == sorted(map(repr, database.read("db.t").collect()))
    assert skewed.rdd.getNumPartitions() <= 5 and skewed.filter("k is null").count() == 20
    database.write(spark.createDataFrame([], "id int"), "db.nothing")
    assert database.read_in_parts("db.nothing", "id", 4).count() == 0


def test_statements_of_other_databases():
    my, pg, lite, other = (jdbc.dialect(u) for u in ("jdbc:mysql://h/d", "jdbc:postgresql://h/d", "jdbc:sqlite:f", "jdbc:oracle:thin:@h"))
    assert my.upsert("t", "s", "id", ["v"]) == "INSERT INTO t (`id`, `v`) SELECT s.`id`, s.`v` FROM s s ON DUPLICATE KEY UPDATE `v` = VALUES(`v`)"
    assert pg.upsert("t", "s", "id", ["v"]) == lite.upsert("t", "s", "id", ["v"]) == 'INSERT INTO t ("id", "v") SELECT s."id", s."v" FROM s s WHERE true ON CONFLICT ("id") DO UPDATE SET "v" = EXCLUDED."v"'
    assert pg.upsert("t", "s", "id", []).endswith("DO NOTHING") and other.upsert("t", "s", "id", ["v"]).startswith("MERGE INTO t")
    assert my.quote("a`b") == "`a``b`" and my.literal("a\\'") == "'a\\\\'''" and pg.literal("o'k") == "'o''k'"
    assert pg.nth("t", "k", 5).endswith("LIMIT 1 OFFSET 5") and other.nth("t", "k", 5).endswith("FETCH NEXT 1 ROWS ONLY")
    assert pg.ranges("k", [3, 9]) == ["k < 3 OR k IS NULL", "k >= 3 AND k < 9", "k >= 9"] and pg.ranges("k", []) == ["1 = 1"]


def test_upsert_of_rows_with_maps(spark):
    df = spark.createDataFrame([(1, {"a": 1}), (1, {"b": 2}), (2, None)], "id int, m map<string,int>")
    got = {r.id: r.m for r in etl.upsert(spark.createDataFrame([(3, {"z": 0})], "id int, m map<string,int>"), df, "id").collect()}
    assert got == {1: {"b": 2}, 2: None, 3: {"z": 0}}


# --- web services


def test_rows_are_posted_and_failures_are_rejects(spark, tmp_path, serve):
    got, tries, lock = [], Counter(), threading.Lock()

    def answer(method, path, headers, body):
        row = json.loads(body)
        with lock:
            tries[row["id"]] += 1
            if row["id"] == 3:
                return 400, None, {}
            if row["id"] % 4 == 0 and tries[row["id"]] == 1:
                return 503, None, {"Retry-After": "0"}
            if row["id"] == 5:
                return 500, None, {}
            got.append((row["id"], headers["Idempotency-Key"], headers["X-Own"]))
        return 201, {}, {}

    df = spark.range(12).repartition(3)
    target = web_sink.Target(serve(answer), headers={"X-Own": "y"}, retries=2, wait_s=0.01)
    n, dead = web_sink.post(df, target, f"{tmp_path}/outcomes")
    assert n == 10 and sorted(g[0] for g in got) == [k for k in range(12) if k not in (3, 5)] and len({g[1] for g in got}) == 10 and got[0][2] == "y"
    assert sorted((json.loads(r.record)["id"], r.reason[:3], r.step) for r in dead.collect()) == [(3, "400", "post"), (5, "500", "post")]
    assert tries[3] == 1 and tries[5] == 3 and tries[4] == 2
    bodies = []
    url = serve(lambda m, p, h, b: (bodies.append((m, b.decode())), (200, {}, {}))[1])
    texts = spark.createDataFrame([("<x/>",), (None,)], "payload string").coalesce(1)
    assert web_sink.post(texts, web_sink.Target(url, "PUT", payload="payload"), f"{tmp_path}/o2")[0] == 2 and sorted(bodies) == [("PUT", ""), ("PUT", "<x/>")]
    bodies.clear()
    assert web_sink.post(spark.range(5).coalesce(1), web_sink.Target(url, many=2), f"{tmp_path}/o3")[0] == 5
    assert sorted(len(json.loads(b)) for _, b in bodies) == [1, 2, 2]
    assert web_sink.post(df.limit(1), web_sink.Target("http://127.0.0.1:9/x", retries=0), f"{tmp_path}/o4")[0] == 0


def test_queues_are_read_side_by_side_and_once(spark, tmp_path, serve):
    queues, asked, done = {"a": [{"id": k} for k in range(25)], "b": [{"id": 100 + k} for k in range(7)]}, [], {}

    def answer(method, path, headers, body):
        u = urlparse(path)
        q = {k: v[0] for k, v in parse_qs(u.query).items()}
        if u.path == "/done":
            done[q["queue"]] = int(q["offset"])
            return 200, {}, {}
        rows, at, n = queues[u.path[1:]], int(q["offset"]), int(q["limit"])
        asked.append(n)
        return 200, {"about": {"all": len(rows)}, "items": rows[at : at + min(n, 4)]}, {}  # at most four at once

    url = serve(answer)
    stream = windows.polled(spark, f"{url}/a,{url}/b", "id long", data_path="items", latest_path="about.all", task_rows="10", commit_url=f"{url}/done?queue={{queue}}&offset={{offset}}")
    run = lambda: stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    run()
    assert rows_of(spark, tmp_path / "out") == [*range(25), *range(100, 107)]
    queues["b"] += [{"id": 200}]
    run()
    assert rows_of(spark, tmp_path / "out") == [*range(25), *range(100, 107), 200]
    from weftline.sources.services import RestSource

    reader = RestSource({"url": f"{url}/a,{url}/b", "data_path": "items", "latest_path": "about.all", "task_rows": "10"}).streamReader(spark.range(1).schema)
    parts = reader.partitions(reader.initialOffset(), {"0": 25, "1": 7})
    assert len(parts) == 4
    for _ in range(2):  # a batch that runs again reads the same rows
        assert [r[0] for r in reader.read(parts[2])] == [20, 21, 22, 23, 24]
    queues["a"].clear()
    with pytest.raises(EngineError):
        list(reader.read(parts[0]))


def test_pages_that_name_the_next_one(spark, serve):
    tries = Counter()

    def answer(method, path, headers, body):
        tries[path] += 1
        k = int(path.rsplit("=", 1)[-1]) if "=" in path else 0
        if tries[path] == 1 and k == 1:
            return 429, None, {"Retry-After": "0"}
        return 200, {"items": [{"id": k}], "links": {"next": f"/items?page={k + 1}" if k < 4 else None}}, {}

    e = Engine(spark)
    e.services.register_rest("g", f"{serve(answer)}/items", "id long", "items", next_path="links.next")
    assert sorted(r.id for r in e.query("SELECT id FROM read_service('g')").collect()) == [0, 1, 2, 3, 4]


# --- streams


def test_a_stream_ends_when_too_many_rows_are_bad(spark, tmp_path):
    for k in range(3):
        spark.range(k * 100, k * 100 + 100).select(F.when((F.col("id") >= 100) & (F.col("id") % 2 == 0), "x").otherwise(F.col("id").cast("string")).alias("v")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    stream = windows.arriving(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, per_trigger=1)
    load = lambda: windows.load(stream, lambda b: etl.normalize(b, {"v": "int"}), f"{tmp_path}/good", f"{tmp_path}/dead", f"{tmp_path}/state", breaker=(20.0, 50)).awaitTermination()
    for _ in range(2):  # again after a start: nothing is loaded
        with pytest.raises(Exception, match="EXECUTION: 50 of 200 rows"):
            load()
        assert spark.read.parquet(f"{tmp_path}/good").count() == 100


def test_a_listener_stops_a_stream(spark, tmp_path):
    source = spark.readStream.format("rate").option("rowsPerSecond", 200).load()
    breaker = windows.Breaker(spark, 10.0, 20)
    spark.streams.addListener(breaker)
    try:
        q = windows.watched(source, F.col("value") % 2 == 0).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/s").start()
        assert q.awaitTermination(60)
        assert list(breaker.tripped) == [str(q.runId)]
    finally:
        spark.streams.removeListener(breaker)


def test_rejects_come_back_when_their_wait_is_over(spark, tmp_path):
    spark.range(8).selectExpr("id", "id % 4 AS need").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = windows.arriving(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    with state.rocksdb(spark):
        q = state.retried(stream, ["id"], lambda rows, attempt: rows["need"] < attempt, wait_s=0.1, most=3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/s").start()
    out = lambda: sorted((r.id, r.attempts, r.state) for r in spark.read.schema("id long, need long, attempts int, state string").parquet(f"{tmp_path}/out").collect())
    for _ in range(120):
        if Path(f"{tmp_path}/out").exists() and len(out()) >= 8:
            break
        time.sleep(0.5)
    q.stop()
    assert out() == sorted((k, min(k % 4 + 1, 3), "done" if k % 4 < 3 else "exhausted") for k in range(8))


def test_keys_are_forgotten_after_a_while(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = windows.arriving(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    for lives, want in ((3600, 2), (0.001, 3)):
        def run(lives=lives):
            with state.rocksdb(spark):
                q = state.once(stream, ["k"], lives).writeStream.format("parquet").option("path", f"{tmp_path}/out{lives}").option("checkpointLocation", f"{tmp_path}/s{lives}").start()
            for _ in range(100):  # batches without rows go on for the timers' sake
                if sum(p.numInputRows for p in q.recentProgress):
                    break
                time.sleep(0.3)
            q.stop()
            return spark.read.parquet(f"{tmp_path}/out{lives}").count()

        assert run() == 2
        spark.createDataFrame([(1, "d")], "k int, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.2)
        assert run() == want, lives


def test_a_stream_of_timers_ends_whole_or_by_an_error(spark, tmp_path):
    spark.range(8).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = windows.arriving(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    start = lambda name, rows: rows.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/s-{name}").start()
    written = lambda name: lambda: spark.read.schema("id long").parquet(f"{tmp_path}/{name}").count()
    q = start("good", stream)
    state.await_rows(q, written("good"), 8)
    assert not q.isActive and written("good")() == 8
    with pytest.raises(Exception, match="no such id"):
        state.await_rows(start("bad", stream.select(F.when(F.col("id") < 7, F.col("id")).otherwise(F.raise_error(F.lit("no such id"))).alias("id"))), written("bad"), 8)
