from pyspark.sql import functions as F

from tracewell.functions.text import scope_score
from tracewell.operators import diagnosis, etl, trace
from tracewell.plans.tools import Knowledge, registry
from tracewell.sources import project

CODE = """toggle := NOT toggle;
edge(CLK := sensor);
IF toggle AND edge.Q THEN
  lastSkill := 'Lift';
END_IF
IF other OR NOT spare THEN
  lastSkill := 'Drop';
END_IF
"""


def test_phase_requirements(spark):
    got = {(p, s): v for p, s, v, _ in diagnosis.phase_requirements(CODE, "Lift", "lastSkill")}
    assert got == {("t-1", "toggle"): True, ("t-1", "edge.Q"): True, ("t-2", "toggle"): False, ("t-1", "sensor"): True, ("t-1", "other"): False}
    assert diagnosis.phase_requirements(CODE, "None", "lastSkill") == []
    risky = "IF a THEN\n x := 'S';\nEND_IF\nIF a THEN\n x := 'T';\nEND_IF"
    assert [r[:2] for r in diagnosis.phase_requirements(risky, "S", "x")] == [("risk", "x"), ("t-1", "a")]
    df = spark.createDataFrame([(1, CODE, "Lift"), (2, None, "Lift"), (3, "", "Lift")], "k long, code string, skill string")
    assert diagnosis.skill_requirements(df, "k", "skill", "lastSkill").count() == 5


def test_setters(spark):
    units = spark.createDataFrame([(1, "A", "x := NOT x;"), (1, "B", "r(CLK := x); Proc1"), (1, "C", "none"), (2, "A", "none"), (2, "B", "none"), (3, "A", None)], "k int, pou string, code string")
    assert {tuple(r) for r in diagnosis.skill_setter(units, "k", ["C"], "Proc1").collect()} >= {(1, "C", 4), (2, "B", 0)}
    setters = spark.createDataFrame([(1, 0, "Unit_9", 0), (1, 1, "Area_1", 1), (1, 2, "Area_1", 1)], "k int, idx int, pou string, n_true int")
    assert [tuple(r) for r in diagnosis.trigger_setter(setters, "k", ["Area_2"], ["unit"]).collect()] == [(1, "Area_1", 110)]
    names = spark.createDataFrame([("Area_1",), ("unit_x",), ("myunit",), ("zzz",)], "n string")
    assert [r[0] for r in names.select(scope_score("n", ["Area_2"], ["unit"])).collect()] == [60, 50, 20, 0]


def test_compact_paths(spark):
    cols = "path string, token string, value string, kind string, reason string, source string, assignment string, fb_type string, depth int"
    rows = spark.createDataFrame([
        ("1", "a", "TRUE", "internal_variable", "", "token", "", "", 0), ("1", "a", "TRUE", "terminal", "", "", "", "", 0), ("1", "b", "FALSE", "local_port", "", "", "", "", 1),
        ("1", "t.Q", "TRUE", "std_fb_dependency", "", "", "t(IN := off, PT := d)", "TON", 2), ("1", "t.PT", "elapsed", "elapsed", "", "", "", "TON", 3), ("1", "c", "TRUE", "loop", "", "", "", "", 1), ("1", "d", "TRUE", "terminal", "", "default", "x", "", 1),
    ], cols)
    limits = spark.createDataFrame([("1", "t0", "b", "TRUE"), ("1", "t0", "off", "FALSE"), ("1", "t-1", "d", "TRUE"), ("1", "t-2", "d", "FALSE")], "path string, phase string, token string, value string")
    got = [(r["place"], r["token"], r["phase"], r["score"]) for r in diagnosis.compact_paths(rows, limits).orderBy("place").collect()]
    assert got == [(1, "a", "t0", 120), (2, "d", "t-1", 100 - 2 - 8 + 4 + 2)]
    assert diagnosis.compact_paths(rows, limits.where("token <> 'off'")).count() == 4
    assert diagnosis.compact_paths(rows.limit(0), limits).count() == 0


def test_anchor_chain_and_evidence(spark):
    cols = "k int, row_no int, token string, pou string, value string, assignment string, source string, reason string, kind string, phase string"
    rows = spark.createDataFrame([
        (1, 1, "start", "M", "TRUE", "a <= b [1]", "job_method", "", "job_method_input", ""), (1, 2, "GVL_a.x", "M", "TRUE", "a <= b [2]", "global", "%IX1.0", "global_variable", "t0"),
        (1, 3, "Timer.Q", "", "TRUE", "timer(IN := x)", "", "", "", ""), (2, 1, None, None, None, None, None, None, None, None),
    ], cols)
    assert {tuple(r) for r in diagnosis.root_anchor(rows, "k").collect()} == {(1, 2, "GVL_a.x", 180 + 50 + 25 + 8 + 2), (2, 1, None, 1)}
    assert [tuple(r) for r in diagnosis.bridges(rows, "k").collect()] == [(1, 1, "M", "a <= b")]
    chain = diagnosis.causal_chain(rows.where("k = 1"), "k", ["timer.q", "start"], "End").orderBy("place").collect()
    assert [r["token"] for r in chain] == ["GVL_a.x", "Timer.Q", "start", "End"]
    lines = diagnosis.evidence_lines(rows, "k", [], ["timer("], [])
    assert [r["line"] for r in lines.collect()] == ["token=Timer.Q | value=TRUE | assignment=timer(IN := x)"]


def test_symbols_suggestions_context(spark):
    a = spark.createDataFrame([(1, "b", "a AND c", "A"), (1, "d", "NOT b", "A"), (1, "e", "ab", "A"), (2, "d", "b", "a")], "unit int, target string, value string, start string")
    assert {tuple(r) for r in diagnosis.dependent_symbols(a, "unit", "start").collect()} == {("1", "a"), ("1", "b"), ("1", "d"), ("2", "a")}
    implemented = spark.createDataFrame([("P1", "LiftBox", None, 0.5), ("P2", "LiftBox", "Lift", None)], "pou string, skill string, label string, confidence double")
    called = spark.createDataFrame([("P3", "goHome", None, None), ("P4", "rDrop", "Drop", "Drop it")], "pou string, runtime string, mapped string, label string")
    (one,) = diagnosis.skill_suggestions(implemented, called).collect()
    assert (one["function"], one["label"], one["confidence"], one["pous"]) == ("LiftBox", "Lift", 1.0, ["P1", "P2"])
    other = {r["function"]: (r["label"], r["confidence"], r["runtime_names"]) for r in diagnosis.skill_suggestions(implemented.limit(0), called).collect()}
    assert other == {"goHome": ("go Home", 0.7, ["P3", "goHome"]), "Drop": ("Drop it", 0.85, ["P4", "rDrop"])}
    t = spark.createDataFrame([("v", "dp:hasVariableName", "G.s_aussen"), ("v", "dp:hasVariableType", "BOOL"), ("v", "dp:hasHardwareAddress", "I 3.5"), ("a", "op:assignsToVariable", "v"), ("a", "op:assignsFrom", "w"), ("w", "dp:hasVariableName", "G_Sim.s")], "s string, p string, o string")
    got = diagnosis.variable_context(spark.createDataFrame([("G.s_aussen",), ("none",)], "token string"), t, spark.createDataFrame([("G.s_aussen", "true")], "id string, v string"))
    r = {x["token"]: x.asDict() for x in got.collect()}
    assert r["G.s_aussen"]["is_sensor"] and r["G.s_aussen"]["is_simulated"] and r["G.s_aussen"]["counterpart"] == "s_innen" and r["G.s_aussen"]["snapshot_value"] == "true"
    assert (r["none"]["mode"], r["none"]["addresses"], r["none"]["is_actor"]) == ("software", [], False)


def test_etl_steps(spark):
    links = spark.createDataFrame([("TIPC^x", "TIID^d", "PlcTask Inputs^G.a", "Ch^Input"), ("TIID^d", "y", "Ch^Output", "PlcTask Outputs^G.b"), ("p", "q", "r", "s")], "owner_a string, owner_b string, var_a string, var_b string")
    assert {tuple(r) for r in etl.link_sides(links).collect()} == {("PlcTask Inputs^G.a", "Ch^Input", "TIID^d"), ("PlcTask Outputs^G.b", "Ch^Output", "TIID^d")}
    ch = spark.createDataFrame([("x", "Ch^Input", 1, 29), ("PlcTask Outputs^v", "Ch", 0, 8), ("x", "Ch", 1, 3), ("x", "Ch", None, 3)], "plc string, ch string, io int, bits int")
    assert [r[0] for r in ch.select(etl.io_address("plc", "ch", "io", "bits")).collect()] == ["I 3.5", "Q 1.0", "Q 0.3", "? 0.3"]
    e = spark.createDataFrame([("G.a", "I 3.5", "d^Ch", None), (None, "I 1.1", None, None)], "plc_var string, address string, io_path string, raw_xml string")
    assert etl.io_mapping(e).count() == 5
    m = etl.mapped_variables(spark.createDataFrame([("v1", "G.a"), ("v2", "G.a"), ("v3", "zz")], "var string, external string"), spark.createDataFrame([("G.a", "v2")], "name string, var string"))
    assert [tuple(r)[:3] for r in m.collect()] == [("v1", "op:isMappedToVariable", "v2")]
    h = etl.declaration_headers(spark.createDataFrame([("A", "VAR a"), ("B", " ")], "name string, header string"), spark.createDataFrame([("a", "old"), ("b", "VAR b")], "name string, header string"))
    assert {tuple(r) for r in h.collect()} == {("a", "VAR a"), ("b", "VAR b")}
    rows = spark.createDataFrame([("M", "program", "G.x := inst.port;\n// y := a.b;\nz := 1;\n w := i2 . p2 ;"), ("F", "functionBlock", "x := a.b;")], "name string, kind string, code string")
    assert [tuple(r) for r in etl.flow_edges(rows).orderBy("idx").collect()] == [("M", 1, "G.x", "inst", "port"), ("M", 2, "w", "i2", "p2")]
    assert etl.flow_triples(etl.flow_edges(rows)).count() == 8
    s = spark.createDataFrame([("u", "o1", False, "a", None), ("u", "o2", None, "q", "z"), ("u", "o3", True, None, None)], "unit string, output string, hardware boolean, variable string, address string")
    assert {tuple(r)[1:] for r in etl.hardware_marks(s, spark.createDataFrame([("G.a",)], "name string")).collect()} == {("o1", True), ("o2", False), ("o3", True)}
    t = spark.createDataFrame([("f", "dp:hasRuntimeSkillName", "old", "literal"), ("k", "p", "o", "iri")], "s string, p string, o string, o_kind string")
    c = etl.couple_functions(t, spark.createDataFrame([("f", "F")], "function string, label string"), spark.createDataFrame([("f", "new"), ("g", "no")], "function string, name string"), spark.createDataFrame([("f", "e1"), ("g", "e2")], "function string, element string"))
    assert {tuple(r)[:3] for r in c.collect()} == {("k", "p", "o"), ("f", "rdf:type", "ProcessFunction"), ("f", "rdfs:label", "F"), ("f", "dp:hasRuntimeSkillName", "new"), ("e1", "op:hasFunction", "f")}


def test_project(spark, tmp_path):
    put = lambda p, text: (p.parent.mkdir(parents=True, exist_ok=True), p.write_text(text))
    put(tmp_path / "a.sln", 'Project("{1}") = "sys", "sys\\sys.tsproj", "{2}"\n')
    put(tmp_path / "sys/plc/p.plcproj", '<Project xmlns="urn:x"><ItemGroup><Compile Include="POUs\\Main.TcPOU"/><Compile Include="G.TcGVL"/><Compile Include="gone.TcPOU"/></ItemGroup></Project>')
    put(tmp_path / "other/q.plcproj", '<Project><ItemGroup><Compile Include="No.TcPOU"/></ItemGroup></Project>')
    put(tmp_path / "other/No.TcPOU", "<TcPlcObject/>")
    put(tmp_path / "sys/plc/POUs/Main.TcPOU", '<TcPlcObject xmlns="urn:y"><POU Name="Main"><Declaration><![CDATA[FUNCTION_BLOCK Main\nVAR a : INT; END_VAR]]></Declaration><Implementation><ST><![CDATA[a := 1;]]></ST></Implementation><Method Name="Go"><Declaration><![CDATA[{attribute \'TcRpcEnable\'}\nMETHOD Go]]></Declaration><Implementation><ST>b := 2;</ST></Implementation></Method></POU></TcPlcObject>')
    put(tmp_path / "sys/plc/G.TcGVL", '<TcPlcObject><GVL Name="G"><Declaration>VAR_GLOBAL x : BOOL; END_VAR</Declaration></GVL></TcPlcObject>')
    got = {r["name"]: r for r in project.read_project(spark, str(tmp_path)).collect()}
    assert set(got) == {"Main", "G"}
    main = got["Main"]
    assert (main["kind"], main["type"], main["language"], main["code"]) == ("POU", "functionblock", "ST", "a := 1;")
    assert [(m["name"], m["code"], m["rpc_enabled"]) for m in main["methods"]] == [("Go", "b := 2;", True)]
    assert got["G"]["kind"] == "GVL" and got["G"]["methods"] is None


def test_tools(spark):
    rows = spark.createDataFrame([("Main", "program", [("Local", "pump", "Pump")], "pump(start := Gvl.Go);"), ("Pump", "functionBlock", [("Input", "start", "BOOL"), ("Output", "state", "BOOL")], "state := start;")], "name string, kind string, ports array<struct<direction:string,name:string,type:string>>, code string")
    gvl = spark.createDataFrame([("Gvl", [("Go", "BOOL", "FALSE", "%I0.1")])], "name string, globals array<struct<name:string,type:string,init:string,address:string>>")
    triples = etl.build(spark, rows, gvl).coalesce(1).cache()
    machine = "V_1 = AND(D1, go)\nV_2 = AND(A5, stop)\nV_3 = OR(V_1, V_2)\nV_4 = RS(V_3, x)\nD2 = V_4"
    program = trace.Program({"Main": trace.Pou("Main", "m(go := Gvl.Go);"), "M": trace.Pou("M", machine, "FBD", inputs={"go": None, "stop": None})}, {"Gvl.Go": "%I0.1"}, {("M", "go"): [("Main", "Gvl.Go")]})
    r = registry(Knowledge(triples, program, routines=spark.createDataFrame([("A", ["%I1"], [], []), ("B", ["%I1"], [], [])], "pou_name string, hardware_addresses array<string>, used_variable_names array<string>, called_pou_names array<string>")))
    assert len(r.describe()) == 18
    first = lambda tool, **a: [x[0] for x in r.execute(tool, **a).collect()]
    assert first("list_programs") == ["Main"] and first("called_pous", name="main") == ["Pump"] and first("pou_callers", name="pump") == ["Main"]
    assert r.execute("variable_trace", name="gvl.go").first().asDict() | {"var": ""} == {"name": "Gvl.Go", "var": "", "address": "%I0.1", "pou_name": "Main", "how": "op:usesVariable"}
    assert first("general_search", needle="star") == ["port"]
    assert r.execute("exception_prep", pou_name="A").first()["score"] == 0.55
    assert r.execute("text2sparql_select", query="SELECT * FROM triples LIMIT 2").count() == 2 and "error" in r.execute("text2sparql_select", query="DROP TABLE triples")
    assert "error" in r.execute("semantic_search", vec_id=1) and "error" in r.execute("deterministic_path_search", preset="x")
    assert ("node", "POU_Pump") in r.execute("graph_investigate", node="POU_Main")["visited"]
    found = r.execute("deterministic_path_search", preset="bootstrap", machine="M", state="D2", last_state="D1")
    assert found["step_1:evd2_diagnoseplan"] == [{"port": "go", "has_hw": True, "has_default": False, "has_loop": False, "has_stop": False, "has_unknown": False, "verdict": "hardware"}]
    assert {x["port"] for x in found["step_2:unified_trace"]} == {"go"}
    rows = r.execute("path_tracing", pou="M", condition="go AND NOT stop")["rows"]
    assert [x["kind"] for x in rows] == ["port_mapping", "guard_false", "terminal", "global_variable"] and {x["path_id"] for x in rows} == {"1"}


def test_delayed(spark, tmp_path):
    from tracewell.streaming import incidents

    rows = [(1, "go", "2024-01-01 00:00:00"), (1, "go", "2024-01-01 00:00:05"), (2, "no", "2024-01-01 00:00:01"), (3, "go", "2024-01-01 01:00:00")]
    df = spark.createDataFrame(rows, "corr long, type string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = incidents.delayed(stream, "go", "10 seconds", "0 seconds").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["corr"]: r["due"] for r in spark.table("late").collect()}
    at = df.where("corr = 1").agg(F.max(F.unix_millis("ts"))).first()[0]
    assert got == {1: at + 10_000}


def test_each_sign_of_an_anchor(spark):
    from tracewell.operators import diagnosis

    row = dict.fromkeys(("token", "pou", "value", "assignment", "source", "reason", "kind"), "x")
    alone = {
        "hardware": {"reason": "at %IX0.1"}, "wired": {"source": "wiring"}, "default": {"assignment": "default 3"}, "end": {"kind": "terminal"}, "global_name": {"token": "GVL_a"}, "running_job": {"token": "jobRunning1"},
        "method_word": {"token": "Abort"}, "method_call": {"token": "fooMethodCall"}, "job_method": {"kind": "job_method_input"},
    }
    rows = [row | change | {"row_no": 0, "want": diagnosis.ANCHOR_POINTS[name]} for name, change in alone.items()]
    rows += [row | {"reason": "%QW3", "source": "global", "row_no": 99, "want": 180 + 50 + 10}, row | {"row_no": 4, "want": 4}, row | {"token": None, "row_no": None, "want": 0}]
    got = spark.createDataFrame(rows, ", ".join(f"{k} {'int' if k in ('row_no', 'want') else 'string'}" for k in rows[0])).select("want", diagnosis.anchor_score().alias("score")).collect()
    assert [r["score"] for r in got] == [r["want"] for r in got]
