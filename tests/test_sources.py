import json

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as tx
from tracewell.operators import etl, graph, pattern
from tracewell.plans.guard import Registry, guarded, with_prefixes
from tracewell.sources import program, turtle

TTL = '''@prefix x: <http://e.org/> .
x:a a x:C ; x:name "one"@en, "t\\"wo" ; x:n 3 . # note
x:b x:list ( x:a 1.5 ) ; x:anon [ x:p true ] .
x:c x:code """line
"quoted" """^^x:T .
'''


def test_turtle_round_trip(spark, tmp_path):
    found = list(turtle.parse(TTL))
    assert ("http://e.org/a", turtle.RDF + "type", "http://e.org/C", "iri", None, None) in found
    assert ("http://e.org/a", "http://e.org/name", 't"wo', "literal", turtle.XSD + "string", None) in found
    assert ("http://e.org/c", "http://e.org/code", 'line\n"quoted" ', "literal", "http://e.org/T", None) in found
    assert len(found) == 12
    (tmp_path / "g.ttl").write_text(TTL + TTL)
    df = turtle.read_turtle(spark, str(tmp_path / "g.ttl"))
    lines = turtle.ntriples(df.where("not s like '_:%' and not o like '_:%'"))
    lines.coalesce(1).write.text(str(tmp_path / "nt"))
    back = turtle.read_turtle(spark, str(tmp_path / "nt/*.txt"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.where("not s like '_:%' and not o like '_:%'").collect()}
    with pytest.raises(ValueError):
        list(turtle.parse("x:a x:b x:c ."))


def test_plcopen_and_build(spark, tmp_path):
    ns = 'xmlns="http://www.plcopen.org/xml/tc6_0200"'
    pou = lambda name, kind, vars_, code: f'<pou name="{name}" pouType="{kind}"><interface>{vars_}</interface><body><ST><xhtml>{code}</xhtml></ST></body></pou>'
    var = lambda tag, *v: f"<{tag}>" + "".join(f'<variable name="{n}"><type>{t}</type></variable>' for n, t in v) + f"</{tag}>"
    text = f"<project {ns}><types><pous>{pou('Main', 'program', var('localVars', ('pump', '<derived name=&quot;Pump&quot;/>'.replace('&quot;', chr(34))), ('spare', '<BOOL/>')), 'pump(start := Gvl.Go, state => Gvl.Out); IF pump.state THEN x := 1; END_IF')}{pou('Pump', 'functionBlock', var('inputVars', ('start', '<BOOL/>')) + var('outputVars', ('state', '<BOOL/>')), 'state := start;')}</pous></types></project>"
    (tmp_path / "p.xml").write_text(text)
    rows = program.read_plcopen(spark, str(tmp_path / "p.xml")).cache()
    assert {(r["name"], r["kind"], len(r["ports"])) for r in rows.collect()} == {("Main", "program", 2), ("Pump", "functionBlock", 2)}
    rows = spark.createDataFrame([("Main", "program", [("Local", "pump", "Pump"), ("Local", "spare", "BOOL")], "pump(start := Gvl.Go, state => Gvl.Out); IF pump.state THEN x := 1; END_IF", "VAR a : INT := 3; END_VAR"), ("Pump", "functionBlock", [("Input", "start", "BOOL"), ("Output", "state", "BOOL")], "state := start;", "")], "name string, kind string, ports array<struct<direction:string,name:string,type:string>>, code string, header string")
    gvl = spark.createDataFrame([("Gvl", [("Go", "BOOL", "FALSE", None), ("Out", "BOOL", None, "%Q0.1")])], "name string, globals array<struct<name:string,type:string,init:string,address:string>>")
    io = spark.createDataFrame([("Gvl.Go", "I 3.5", "Box 1", "<x/>")], "plc_var string, address string, io_path string, raw_xml string")
    found = [tuple(r) for r in etl.build(spark, rows.unionByName(rows), gvl, io).collect()]
    first = set(found)
    assert len(found) == len(first)  # a set, though all rows came twice
    assert ("POU_Main", "dp:hasConsistencyReport", "Unit: Main | Calls: Pump | UNUSED variables (1): spare", "literal") in first and ("Var_Main_spare", "dp:isUnusedVar", "true", "literal") in first
    assert ("Var_Main_a", "dp:hasDefault", "3", "literal") in first and ("POU_Pump", "dp:isGEMMAOutputLayer", "true", "literal") in first
    assert ("POU_Main", "op:readsInCondition", "PortInstance_Main_pump_state", "iri") in first and ("Port_TON_PT", "dp:hasPortType", "TIME", "literal") in first
    assert ("Var_Gvl__dot__Go", "op:isBoundToChannel", "IOChannel_Box__leerz__1", "iri") in first
    assert ("Call_Main_pump_0", "op:callsPOU", "POU_Pump", "iri") in first
    assert ("POU_Main", "op:usesVariable", "Var_Gvl_Go", "iri") in first
    assert [tuple(r) for r in etl.unused(rows).collect()] == [("Main", "spare")]
    assert [tuple(r) for r in etl.defaults(rows).collect()] == [("Main", "a", "INT", "3")]
    assert [tuple(r) for r in etl.condition_ports(rows).collect()] == [("Main", "pump", "state")]
    assert [r[0] for r in etl.output_layer(rows, etl.call_bindings(rows), spark.createDataFrame([("gvl.out",)], "name string")).collect()] == ["Pump"]
    attributes = spark.createDataFrame([("G", "a", "OPC.UA.DA", "1"), ("G", "b", "OPC.UA.DA", "1"), ("G", "b", "OPC.UA.Access", "1"), ("G", "c", "x", "1"), ("G", "d", "Access", "ReadWrite")], "owner string, name string, attribute string, value string")
    assert {tuple(r)[1:] for r in etl.access_flags(attributes).collect()} == {("a", True, True), ("b", True, False), ("d", False, True)}


def test_incidents(spark):
    snap = {"rows": [], "vars": [{"id": "ns=4;s=Area.x", "t": "Bool", "v": True}]}
    marked = "==InventorySnapshot==" + json.dumps(snap) + "==InventorySnapshot=="
    raw = [json.dumps({"type": "evD2", "payload": {"correlationId": "c1", "plcSnapshot": snap}}), json.dumps({"corr": "c2", "snapShot": marked}), json.dumps({"correlationId": "c3", "snapshot": {}}), "broken"]
    df = program.incidents(spark.createDataFrame([(r,) for r in raw], "value string"))
    assert {tuple(r) for r in program.snapshot_vars(df).collect()} == {("c1", "Area.x", "bool", "true"), ("c2", "Area.x", "bool", "true")}
    assert program.search_snapshot(program.snapshot_vars(df), "x", exact=True).count() == 2
    assert program.search_snapshot(program.snapshot_vars(df), "rea", exact=True).count() == 0
    assert program.read_json(spark, "/nowhere/at/all.json", "a int").count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("Unit_1.Part.Go.A12", "BOOL#TRUE", ' {"jobId": ab12, "n": 1}', "%IX3.5", "3.7")], "n string, b string, j string, h string, i string")
    r = df.select(tx.scope("n").alias("scope"), tx.state_alias("n").alias("state"), tx.bool_text("b").alias("bool"), tx.quote_job_id("j").alias("j"), tx.hardware_address("h").alias("h"), tx.safe_int("i").alias("i"), tx.aliases("n").alias("a"), tx.unescape_iri(tx.escape_iri("n")).alias("back")).first()
    assert (r["scope"], r["state"], r["bool"], r["i"], r["back"]) == ("Unit", "A12", "TRUE", 3, "Unit_1.Part.Go.A12")
    assert json.loads(r["j"])["jobId"] == "ab12" and tuple(r["h"]) == ("I", 3, 5)
    assert [tuple(x) for x in r["a"]] == [("unit_1.part.go.a12", 100), ("part.go.a12", 92), ("go.a12", 88), ("a12", 55)]


READS = [
    "SELECT * FROM t WHERE b = 'drop'", "SELECT a FROM t WHERE b LIKE '%insert%' UNION ALL SELECT a FROM t ORDER BY a LIMIT 3", "WITH c AS (SELECT a FROM t), d AS (SELECT * FROM c) SELECT count(*) FROM d",
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r", "SELECT a, row_number() OVER (PARTITION BY b ORDER BY a) AS r FROM t", "SELECT * FROM t x JOIN T y USING (a)",
    "SELECT * FROM t LATERAL VIEW explode(array(1, 2)) z AS q", "SELECT a FROM t WHERE a = (SELECT max(a) FROM t) AND EXISTS (SELECT 1 FROM t)", "SELECT transform(array(1, 2), x -> x + 1)", "SELECT a FROM t WHERE a IN (SELECT a FROM t) EXCEPT SELECT 1",
]
REFUSED = [
    "DROP TABLE t", "CREATE TABLE z (a INT) USING parquet", "INSERT INTO t VALUES (1, 'x')", "SET x = 1", "SELECT TRANSFORM(a) USING 'cat' AS (x) FROM t", "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT system.builtin.reflect('a', 'b')",
    "SELECT * FROM parquet.`/any/path`", "SELECT * FROM other", "SELECT a FROM t WHERE a IN (SELECT a FROM other)", "SELECT (SELECT max(a) FROM other)", "SELECT 1 FROM t WHERE EXISTS (SELECT 1 FROM t x WHERE x.b = reflect('a', 'b'))",
    "WITH other AS (SELECT * FROM other) SELECT * FROM other", "WITH c AS (SELECT TRANSFORM(a) USING 'cat' AS (x) FROM t) SELECT * FROM c", "SELECT * FROM t UNION SELECT * FROM csv.`/x`", "SELECT mine(a) FROM t", "SELECT * FROM range(10)", "SELECT * FROM t, LATERAL (SELECT reflect('a', 'b'))", "EXPLAIN SELECT 1", "SHOW TABLES",
]


def test_guard_and_registry(spark):
    t = spark.createDataFrame([(i, "drop") for i in range(300)], "a int, b string")
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("other")
    spark.udf.register("mine", lambda x: x)
    assert guarded(spark, READS[0], {"t": t}).count() == 200
    for good in READS[1:]:
        guarded(spark, good, {"t": t}).collect()
    for bad in REFUSED:
        with pytest.raises(PermissionError):
            guarded(spark, bad, {"t": t})
    assert with_prefixes("SELECT s FROM t WHERE p = 'dp:hasName' AND o <> 'http://x' AND b = 'zz:y'", {"dp": "http://e.org/dp_", "http": "no"}) == "SELECT s FROM t WHERE p = 'http://e.org/dp_hasName' AND o <> 'http://x' AND b = 'zz:y'"
    r = Registry()
    r.register(lambda x: [x], "echo")
    r.register(lambda: 1 / 0, "fail")
    assert r.execute("none") == {"error": "unknown tool none"} and "error" in r.execute("fail")
    assert r.run_plan([("fail", {})], lambda results: [("echo", {"x": 1})]) == {"step_1:echo": [1]}


def test_graph_properties(spark):
    import random

    random.seed(3)
    edges = {(random.randrange(20), random.randrange(20)) for _ in range(30)}
    e = spark.createDataFrame(sorted(edges), "src int, dst int")
    got = {tuple(r)[:2] for r in graph.reachable(e, spark.createDataFrame([(i,) for i in range(20)], "root int")).collect()}
    want = set()
    for i in range(20):
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            todo += [b for a, b in edges if a == x and b not in seen and not seen.add(b)]
        want |= {(i, x) for x in seen}
    assert got == want
    t = spark.createDataFrame([("a", "p", "b", "iri"), ("a", "p", "b", "iri"), ("b", "q", "c", "literal")], "s string, p string, o string, o_kind string")
    assert [tuple(r) for r in pattern.bgp(t.distinct(), ("?x", "p", "?y"), ("?y", "q", "?z")).select("x", "y", "z").collect()] == [("a", "b", "c")]
    with pytest.raises(ValueError):
        pattern.bgp(t, ("?x", "p", "?y"), ("?u", "q", "?v"))
    assert pattern.overwrite(t, spark.createDataFrame([("a", "p", "z", "iri")], t.schema)).where(F.col("s") == "a").count() == 1


def test_files_round_trip(spark, tmp_path):
    from test_logic import EXPORT

    from tracewell.sources import plcopen

    (tmp_path / "a.xml").write_text(EXPORT)
    rows = {r["name"]: r for r in plcopen.read_exports(spark, str(tmp_path / "a.xml")).collect()}
    assert rows["Main"]["calls"][0]["inputs"] == {"go": "Gvl.Go", "speed": "localId:9", "idle": None} and rows["Main"]["nodes"]["1"] == "Gvl.Go" and rows["Mover"]["methods"][0]["rpc_enabled"]
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None), (3, "x\r\ny")], "n int, corrrelID string")
    program.write_json(df, str(tmp_path / "j"))
    assert {tuple(r) for r in program.read_json_lines(spark, str(tmp_path / "j"), "n int, corrrelID string").collect()} == {tuple(r) for r in df.collect()}
    for _ in range(2):
        program.write_csv(df.repartition(3), str(tmp_path / "c"))
    files = sorted(p for p in (tmp_path / "c").glob("*.csv"))
    whole = b"".join(p.read_bytes() for p in files)
    assert len(files) > 2 and whole.startswith(b"n,corrrelID\r\n") and whole.count(b"corrrelID") == 1 and whole.count(b'"a ""b"", c"') == 2
    lines = ['<http://e/s> <http://e/p> "a\\"b\\\\n\\u00e9"@en .', "# note", "", '_:b1 <http://e/p> <http://e/o> .', '<http://e/s> <http://e/q> "1"^^<http://e/T> . # end']
    (tmp_path / "x.nt").write_text("\n".join(lines))
    got = {tuple(r) for r in turtle.read_ntriples(spark, str(tmp_path / "x.nt")).collect()}
    assert got == {("http://e/s", "http://e/p", 'a"b\\n\u00e9', "literal", None, "en"), ("_:b1", "http://e/p", "http://e/o", "iri", None, None), ("http://e/s", "http://e/q", "1", "literal", "http://e/T", None)}
    (tmp_path / "y.nt").write_text("no triple")
    with pytest.raises(Exception, match="no triple"):
        turtle.read_ntriples(spark, str(tmp_path / "y.nt")).collect()


def test_ntriples_with_long_literals(spark, tmp_path):
    """Patterns that recurse once per character end the JVM at a few thousand."""
    texts = ["x" * 1_000_000, "a\"\\\n" * 200_000, "é" * 5000]
    df = spark.createDataFrame([(f"http://e/{i}", "http://e/p", t, "literal", turtle.XSD + "string", None) for i, t in enumerate(texts)], turtle.SCHEMA)
    turtle.ntriples(df).write.text(str(tmp_path / "long"))
    assert {r["s"]: r["o"] for r in turtle.read_ntriples(spark, str(tmp_path / "long")).collect()} == {f"http://e/{i}": t for i, t in enumerate(texts)}


def test_typed_snapshot(spark):
    rows = [("c", "a", "bool", "true"), ("c", "b", "uint64", "18446744073709551615"), ("c", "d", "int16", "70000"), ("c", "e", "uint16", "65535"), ("c", "f", "float", "1.5"), ("c", "g", "other", "x")]
    r = program.typed_snapshot(spark.createDataFrame(rows, "corr string, id string, t string, v string")).first()
    assert r["bools"] == {"a": True} and int(r["uint64s"]["b"]) == 2**64 - 1 and r["int16s"] == {"d": None} and r["uint16s"] == {"e": 65535} and r["floats"] == {"f": 1.5}


def test_deeper_snapshots_are_told(spark):
    def wrapped(n):
        snap = {"vars": [{"id": "x", "t": "bool", "v": True}]}
        for _ in range(n):
            snap = {"snapshot": snap}
        return json.dumps({"corr": f"c{n}", "snapshot": snap})

    df = program.incidents(spark.createDataFrame([(wrapped(n),) for n in (0, 4, 5, 9)] + [('{"corr": "none"}',)], "value string"))
    assert {r["corr"]: r["unread"] for r in df.collect()} == {"c0": False, "c4": False, "c5": True, "c9": True, "none": False}
    assert {r["corr"] for r in program.snapshot_vars(df).collect()} == {"c0", "c4"}


def test_long_pair_streams():
    text = "".join(f'urn:{i}\n{{"v": "}}{{", "n": {{"i": {i}}}}}\n' for i in range(20_000))
    got = program.pair_stream(text)
    assert len(got) == 20_000 and got[-1] == ("urn:19999", '{"v": "}{", "n": {"i": 19999}}')
