import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.functions import logic

names = st.sampled_from(["A", "B", "C", "NotAus", "Order1"])
trees = st.recursive(names, lambda x: st.one_of(st.builds(lambda a: f"NOT ({a})", x), st.builds(lambda a, o, b: f"({a}) {o} ({b})", x, st.sampled_from(["AND", "OR", "XOR"]), x)), max_leaves=6)


@settings(max_examples=150, deadline=None)
@given(trees, st.booleans())
def test_dnf_is_the_truth_table(text, value):
    tree = logic.parse(text)
    rows, cut = logic.dnf(tree if value else ("not", tree))
    assert not cut
    tokens = sorted({t.upper() for t in logic.tokens(tree)})
    for bits in itertools.product([False, True], repeat=len(tokens)):
        env = dict(zip(tokens, bits, strict=True))
        assert (logic.evaluate(tree, env) == value) == any(all(env[k] == v for k, (_, v) in r.items()) for r in rows)


def test_names_that_begin_like_operators_stay_whole():
    assert logic.lex("NotAus AND Order1") == ["NotAus", "AND", "Order1"]
    assert logic.truth_paths("state = D2 AND NOT x") == ([[("state = D2", True), ("x", False)]], False)
    assert logic.truth_paths("B AND NOT B") == ([[("B", True)]], False)
    with pytest.raises(ValueError):
        logic.parse("A AND")


def test_no_truth_path_is_cut():
    text = " AND ".join(f"(a{i} OR b{i})" for i in range(10))
    rows = logic.truth_paths(text)[0]
    assert len(rows) == len({tuple(r) for r in rows}) == 1024
    # the first 512 ways all hold a0
    assert {tuple(r) for r in logic.truth_paths(f"{text} AND NOT a0")[0]} == {(*r, ("a0", False)) for r in map(tuple, rows) if r[0] == ("b0", True)}
    assert len(logic.truth_paths(f"{text} AND (NOT a0 OR NOT a0 AND c)")[0]) == 1024
    wide = " AND ".join(f"(a{i} OR b{i})" for i in range(60))
    assert next(logic.ways(wide)) == [(f"a{i}", True) for i in range(60)]
    assert logic.truth_paths(f"{wide} AND x AND NOT x")[0][0][0] == ("a0", True)
    assert len(logic.truth_paths(" AND ".join(["(a OR b)"] * 40))[0]) == 3


CODE = """
(* x := FALSE; *)
IF a THEN
  x := TRUE; // y := TRUE;
ELSIF b THEN
  x := c;
ELSE
  IF d THEN x := FALSE; END_IF
END_IF
timer(IN := NOT timer.Q,
      PT := T#5s, Q => done);
timer(IN := x);
"""


def test_assignments_negate_earlier_branches():
    found = [(a.value, a.line, a.conditions) for a in logic.assignments(CODE) if a.target == "x"]
    assert found == [("TRUE", 4, ["a"]), ("c", 6, ["NOT (a)", "b"]), ("FALSE", 8, ["NOT (a)", "NOT (b)", "d"])]
    assert logic.calls(CODE) == [("timer", 0, {"IN": "NOT timer.Q", "PT": "T#5s"}, {"Q": "done"}), ("timer", 1, {"IN": "x"}, {})]


def test_diagram_and_declarations():
    blocks, outputs = logic.fbd_lines("V_9 = NOT_1(B)\nV_10 = OR_7(A, V_9)\nV_17 = RS(V_10, Stop)\nD2 = V_17\nV_20 = OR_1(Mod.A1, Mod.D3)")
    tree = logic.fbd_tree("D2", blocks, outputs)
    assert logic.leaves(tree, True) == [("A", True), ("B", False)]
    assert logic.leaves(tree, False) == [("Stop", True)]
    assert logic.pick_or_branch(logic.fbd_tree("V_20", blocks, outputs), None) == 0
    assert logic.pick_or_branch(logic.fbd_tree("V_20", blocks, outputs), "D3") == 1
    assert logic.parse_declaration("VAR a, b : BOOL := TRUE; t AT %IX0.1 : TIME; END_VAR") == [("a", "BOOL", "TRUE"), ("b", "BOOL", "TRUE"), ("t", "TIME", None)]
    assert logic.split_args("f(a, b), 'x,y', z") == ["f(a, b)", "'x,y'", "z"]


def test_trace():
    from tracewell.operators.trace import Pou, Program, requirements, terminal_summary

    main = Pou("Main", "IF start AND NOT stop THEN run := TRUE; END_IF\nrun := loop;\nloop := loop;\nt1(IN := sensor, PT := T#1s);\nready := t1.Q;", variables={"run": None, "loop": None, "ready": None, "start": "FALSE"}, instances={"t1": "TON"})
    rows = requirements(Program({"Main": main}, globals={"sensor": "%I1.0", "stop": None}), "Main", "run")
    assert [(r["token"], r["value"], r["kind"]) for r in rows] == [("run", True, "internal_variable"), ("run", True, "internal_assignment"), ("start", True, "internal_variable"), ("start", True, "terminal"), ("stop", False, "global_variable")]
    rows = requirements(Program({"Main": main}, globals={"sensor": "%I1.0"}), "Main", "ready")
    assert [r["kind"] for r in rows][-2:] == ["std_fb_dependency", "global_variable"]
    assert terminal_summary(rows)["verdict"] == "hardware"
    assert [r["kind"] for r in requirements(Program({"Main": main}), "Main", "loop")][-1] == "loop"


def test_trace_chooses_and_branches():
    from tracewell.operators.trace import Pou, Program, assignment_points, requirements

    assert assignment_points(True, True, True, "") == 160 and assignment_points(None, True, False, "start") == 125 and assignment_points(True, False, False, "abort") == 65 and assignment_points(False, False, False, "CheckState") == 145
    kinds = lambda rows: [(r["token"], r["kind"], r["reason"]) for r in rows]
    # of local and method assignments the one of most points counts: a computed local one loses to a start method's literal
    unit = Pou("U", "run := busy;", variables={"run": None, "busy": None}, methods={"Start": "IF go THEN run := TRUE; END_IF", "Abort": "run := FALSE;"})
    got = requirements(Program({"U": unit}, {"go": "%I1.0"}), "U", "run")
    assert kinds(got) == [("run", "internal_variable", "variable"), ("run", "job_method_assignment", "line 1 of Start"), ("go", "global_variable", "%I1.0")]
    assert requirements(Program({"U": unit}), "U", "run", False)[1]["reason"] == "line 1 of Abort"
    # the first of several callers is traced, unless a hint says otherwise
    inner = Pou("In", "", inputs={"x": None})
    program = Program({"In": inner, "A": Pou("A"), "B": Pou("B")}, {"g": "%I1.0", "h": None}, {("In", "x"): [("A", "g"), ("B", "h")]})
    assert kinds(requirements(program, "In", "x")) == [("x", "port_mapping", "called by A, B"), ("g", "global_variable", "%I1.0")]
    program.hints["In", "x"] = "h OR NOT g"
    got = requirements(program, "In", "x")
    assert [(r["path_id"], r["token"], r["value"], r["kind"]) for r in got] == [("1", "x", True, "port_mapping"), ("1", "x", True, "branch_hint"), ("1.1", "h", True, "global_variable"), ("1.2", "g", False, "global_variable")]
    # a method sees its owner's instances, ports and variables after its own names
    owner = Pou("FB", "t(IN := s);\nready := t.Q;", inputs={"s": "FALSE"}, variables={"ready": None}, instances={"t": "TON"})
    method = Pou("FB.M", "done := ready AND t.Q;", variables={"done": None}, owner="FB")
    got = requirements(Program({"FB": owner, "FB.M": method}), "FB.M", "done")
    assert [(r["token"], r["pou"], r["kind"]) for r in got if r["depth"] == 2] == [("ready", "FB", "internal_variable"), ("t.Q", "FB", "std_fb_dependency")]
    # a latch in a diagram: what resets it must be TRUE
    flip = Pou("F", "V_1 = RS_2(a, b)\nq = V_1", "FBD", inputs={"a": None, "b": None}, outputs={"q": None})
    assert [(r["token"], r["value"]) for r in requirements(Program({"F": flip}), "F", "q", False) if r["depth"]] == [("b", True)]


EXPORT = """<project xmlns="http://www.plcopen.org/xml/tc6_0200"><types><pous>
<pou name="Main" pouType="program"><interface><localVars><variable name="m"><type><derived name="Mover"/></type></variable></localVars><tempVars><variable name="n"><type><INT/></type><initialValue><simpleValue value="3"/></initialValue></variable></tempVars></interface>
<body><FBD><inVariable localId="1"><expression>Gvl.Go</expression></inVariable><inVariable localId="2"><expression>Other.speed</expression></inVariable><outVariable localId="3"><expression>Gvl.Out</expression></outVariable>
<block localId="4" typeName="Mover" instanceName="m"><inputVariables><variable formalParameter="go"><connectionPointIn><connection refLocalId="1"/></connectionPointIn></variable><variable formalParameter="speed"><connectionPointIn><connection refLocalId="9"/></connectionPointIn></variable><variable formalParameter="idle"><connectionPointIn/></variable></inputVariables>
<outputVariables><variable formalParameter="done"><connectionPointOut><expression>Gvl.Done</expression></connectionPointOut></variable></outputVariables></block><block localId="5" typeName="AND"/></FBD></body></pou>
<pou name="Mover" pouType="functionBlock"><interface><inputVars><variable name="go"><type><BOOL/></type></variable><variable name="speed"><type><INT/></type></variable></inputVars><outputVars><variable name="done"><type><BOOL/></type></variable></outputVars><inOutVars><variable name="both"><type><INT/></type></variable></inOutVars>
<addData><data><InterfaceAsPlainText><xhtml xmlns="http://www.w3.org/1999/xhtml">{attribute 'OPC.UA.DA.JobMethod' := 'Move'}
FUNCTION_BLOCK Mover</xhtml></InterfaceAsPlainText></data></addData></interface><body><ST><xhtml xmlns="http://www.w3.org/1999/xhtml">done := go; (* go := 1; *) // x</xhtml></ST></body>
<addData><data name="method"><Method name="Start"><interface><returnType><BOOL/></returnType><inputVars><variable name="p"><type><derived name="Params"/></type></variable></inputVars></interface><body><ST>go := TRUE;</ST></body><addData><data><Attributes><Attribute Name="TcRpcEnable" Value="1"/></Attributes></data></addData></Method></data></addData></pou>
</pous></types></project>"""


def test_plcopen_export():
    from tracewell.sources import plcopen

    main, mover = plcopen.units(EXPORT)
    assert (main["language"], main["job_method"], main["nodes"]) == ("FBD", None, {"1": "Gvl.Go", "2": "Other.speed", "3": "Gvl.Out"})
    assert main["ports"] == [{"direction": "Local", "name": "m", "type": "Mover", "init": None}, {"direction": "Local", "name": "n", "type": "INT", "init": "3"}]
    assert main["calls"] == [{"callee": "Mover", "instance": "m", "inputs": {"go": "Gvl.Go", "speed": "localId:9", "idle": None}, "outputs": {"done": "Gvl.Done"}}]
    assert (mover["language"], mover["code"], mover["job_method"]) == ("ST", "done := go;", "Move") and [p["direction"] for p in mover["ports"]] == ["Input", "Input", "Output", "InOut"]
    (start,) = mover["methods"]
    assert (start["name"], start["code"], start["return_type"], start["rpc_enabled"], start["language"]) == ("Start", "go := TRUE;", "BOOL", True, "ST")
    assert start["header"] == "METHOD Start\nVAR\n    p : Params;\nEND_VAR"
    assert plcopen.external_names("Mover", mover["ports"], main["nodes"]) == {"speed": "Other.speed"}
    with pytest.raises(ValueError):
        list(plcopen.units("<no"))
    assert [c[:3] for c in plcopen.chunks(EXPORT, 1200, 100)][:2] == [("project:project-part1", "PROJECT", "project"), ("project:project-part2", "PROJECT", "project")]
    assert {c[2] for c in plcopen.chunks(EXPORT)} == {"project", "Main", "Mover"} and plcopen.chunks("x" * 4000)[1][0] == "xml-window-2" and plcopen.chunks("") == []
