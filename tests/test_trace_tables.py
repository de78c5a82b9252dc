"""The trace over tables gives what the trace in memory gives, on random programs."""

import random
from collections import Counter

from tracewell.operators import trace_tables
from tracewell.operators.trace import COLUMNS, Pou, Program, requirements

WIRING = "program string, pou string, port string, place int, caller string, expression string"
GLOBALS = "program string, name string, address string"
STARTS = "trace long, program string, pou string, token string, value boolean"
HINTS = "program string, pou string, port string, expression string"


def made(rng):
    """A program of units that call each other, with blocks, diagrams, methods, owners and wiring."""
    names = [f"U{i}" for i in range(rng.randint(2, 6))]
    tokens = ["a", "b", "run", "Done", "D1", "D2", "x", "y", "Gvl.Go", "stop", "t1.Q", "t2.Q1", "sub.out", "sub.OUT2", "sub.in1", "nowhere"]
    pick = lambda: rng.choice(tokens)
    text = lambda: rng.choice([pick(), f"NOT {pick()}", f"{pick()} AND {pick()}", f"{pick()} OR NOT {pick()}", f"({pick()} OR {pick()}) AND {pick()}", f"{pick()} = 3", f"{pick()} XOR {pick()}", "a +", f"f({pick()}) AND {pick()}"])

    def code():
        out = []
        for _ in range(rng.randint(2, 7)):
            target, value = rng.choice(["run", "Done", "x", "y", "b", "out", "OUT2", "D1"]), rng.choice(["TRUE", "FALSE", text(), text()])
            out.append(rng.choice([f"{target} := {value};", f"IF {text()} THEN {target} := {value}; ELSE {target} := {text()}; END_IF", f"CASE s OF 1: {target} := {value}; END_CASE"]))
        out += rng.sample([f"t1(IN := {text()}, PT := delay);", f"t1(IN := NOT t1.Q, PT := T#1s);", f"t2(S1 := {text()});", f"sub(in1 := {text()}, out => y);", "sub();", f"clk(CLK := {text()});"], rng.randint(0, 4))
        return "\n".join(out)

    def diagram():
        return f"V_1 = AND_1({rng.choice('abxy')}, sub.out)\nV_2 = NOT_1({rng.choice(['in1', 'stop'])})\nV_3 = {rng.choice(['RS_1', 'OR_1', 'SR', 'TON_1'])}(V_1, V_2)\nout = V_3\nOUT2 = V_2\nD1 = V_1"

    some = lambda xs: {x: rng.choice([None, "TRUE", "5"]) for x in xs if rng.random() < 0.85}
    pous = {}
    for n in names:
        fbd = rng.random() < 0.3
        pous[n] = Pou(n, rng.choice([diagram() if fbd else code(), ""]) if rng.random() < 0.2 else diagram() if fbd else code(), "FBD" if fbd else "ST", some(["a", "in1", "Stop"]), some(["out", "OUT2", "D1", "done"]), some(["run", "x", "Y", "b"]), {k: v for k, v in (("t1", rng.choice(["TON", "F_TRIG", "tp"])), ("t2", "SR"), ("sub", rng.choice([*names, "Foreign"]))) if rng.random() < 0.7}, rng.random() < 0.2, {m: code() for m in ("Start", "Abort", "CheckState") if rng.random() < 0.3}, rng.choice([None, None, *names, "Gone"]))
    wiring = {(n, p): [(rng.choice(names), text()) for _ in range(rng.randint(1, 2))] for n in names for p in pous[n].inputs if rng.random() < 0.6}
    hints = {k: text() for k in wiring if rng.random() < 0.2}
    return Program(pous, {g: rng.choice([None, "%IX0.1"]) for g in ("Gvl.Go", "stop", "s")}, wiring, hints), tokens


def tables(spark, programs):
    pairs = lambda d: dict(d)
    units = [(p, u.name, u.code, u.language, pairs(u.inputs), pairs(u.outputs), pairs(u.variables), pairs(u.instances), u.is_job_method, pairs(u.methods), u.owner) for p, prog in programs.items() for u in prog.pous.values()]
    wiring = [(p, n, port, i, c, x) for p, prog in programs.items() for (n, port), ws in prog.wiring.items() for i, (c, x) in enumerate(ws)]
    names = [(p, n, a) for p, prog in programs.items() for n, a in prog.globals.items()]
    hints = [(p, n, port, x) for p, prog in programs.items() for (n, port), x in prog.hints.items()]
    return spark.createDataFrame(units, trace_tables.UNITS), spark.createDataFrame(wiring, WIRING), spark.createDataFrame(names, GLOBALS), spark.createDataFrame(hints, HINTS)


def test_random_programs(spark):
    rng = random.Random(7)
    programs, starts, want = {}, [], Counter()
    for i in range(60):
        program, tokens = made(rng)
        programs[f"P{i}"] = program
        for _ in range(9):
            unit, token, value = rng.choice(list(program.pous)), rng.choice([*tokens, "OUT", "t1.q"]), rng.random() < 0.7
            rows = requirements(program, unit, token, value, frozenset({"D2"}), 5)
            if len(rows) > 3000:  # ways multiply; a few large ones are enough
                continue
            starts.append((len(starts), f"P{i}", unit, token, value))
            want.update((len(starts) - 1, *(r[c] for c in COLUMNS)) for r in rows)
    starts.append((9999, "P0", "Gone", "a", True))
    units, wiring, names, hints = tables(spark, programs)
    got = trace_tables.requirement_paths(units, wiring, names, spark.createDataFrame(starts, STARTS), hints, ("D2",), 5)
    have = Counter(map(tuple, got.collect()))
    assert sum(want.values()) > 1000
    assert {r[6] for r in want} >= {"loop", "stop", "assumed_false", "port_mapping", "branch_hint", "std_fb_dependency", "temporal_note", "elapsed", "instance_port", "output_assignment", "job_method_assignment", "terminal", "unknown", "global_variable"}
    assert have == want, ((have - want).most_common(3), (want - have).most_common(3))


def test_nothing_to_trace(spark):
    units, wiring, names, _ = tables(spark, {"P": Program({"U": Pou("U")})})
    none = spark.createDataFrame([], STARTS)
    assert trace_tables.requirement_paths(units, wiring, names, none).collect() == []
    gone = spark.createDataFrame([("P", "U", "a", 0, "Elsewhere", "x")], WIRING)
    unit = spark.createDataFrame([("P", "U", None, None, {"a": None}, None, None, None, None, None, None)], trace_tables.UNITS)
    got = trace_tables.requirement_paths(unit, gone, names, spark.createDataFrame([(1, "P", "U", "A", True)], STARTS)).collect()
    assert [(r["token"], r["kind"], r["reason"]) for r in sorted(got, key=lambda r: r["depth"])] == [("A", "port_mapping", "called by Elsewhere"), ("x", "unknown", "no such unit")]


def test_rows_alike_are_worked_out_twice_at_most(spark):
    """Rows that differ by their program alone: what follows from the first two holds for all, each under its own program."""
    from tracewell.operators.trace_tables import _rows

    calls = spark.sparkContext.accumulator(0)

    def f(r):
        calls.add(1)
        yield {"k": r["t"]}
        yield {"k": None}

    df = spark.range(0, 1000, 1, 1).selectExpr("'x' AS t", "concat('P', id) AS program")
    found = [(r.program, r.k) for r in _rows(df, f, "program string, k string").collect()]
    assert len(found) == 2000 and set(found) == {(f"P{i}", k) for i in range(1000) for k in ("x", None)} and calls.value == 2


def test_steps_are_worked_out_once_a_shape(spark, monkeypatch):
    """program_traces has four shapes of programs, whatever the number of parts: its steps don't grow with the parts."""
    from tracewell.plans import catalogue

    sizes, make = [], trace_tables.trace_steps

    def spy(*args):
        steps = make(*args)
        sizes.append((steps.count(), steps.select("program").distinct().count()))
        return steps

    monkeypatch.setattr(trace_tables, "trace_steps", spy)
    found = catalogue.queries()["program_traces"](spark, "/root/testdata/sf0.001")
    assert found.select("trace").distinct().count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    assert sizes[0][0] < 150 and sizes[0][1] <= 4


def test_shapes(spark):
    """Units in another order are alike; a value that is null and one that isn't there are not, nor is a unit that comes twice."""
    unit = lambda p, n, inputs=None, code="x := a;": (p, n, code, "ST", inputs, {}, {"x": None}, {}, False, {}, None)
    rows = [unit("A", "U"), unit("A", "V"), unit("B", "V"), unit("B", "U"), unit("C", "U"), unit("D", "U", {}), unit("E", "U", {"a": None}), unit("F", "U", {"a": ""}), unit("G", "U"), unit("G", "U"), unit("H", "U", code=None), unit("I", "U", code="")]
    shapes = {r.program: r.shape for r in trace_tables.program_shapes(spark.createDataFrame(rows, trace_tables.UNITS)).collect()}
    assert len(shapes) == 9 and shapes["A"] == shapes["B"] and len(set(shapes.values())) == 8


def test_programs_of_one_shape_differ_in_wiring_and_globals(spark, monkeypatch):
    """Programs with the same units, but wiring, hints, globals and starts of their own; small tables sent to tasks or none."""
    rng = random.Random(11)
    programs, starts, want = {}, [], Counter()
    for i in range(8):
        base, tokens = made(rng)
        for j in range(4):
            wiring = {k: [(c, rng.choice([x, "t1.Q", "sub.out AND a", "NOT run", f"Own{j}"])) for c, x in v] for k, v in base.wiring.items() if rng.random() < 0.8}
            program = Program(base.pous, {g: rng.choice([None, f"%IX{j}.1"]) for g in ("Gvl.Go", "stop", f"Own{j}") if rng.random() < 0.7}, wiring, {k: rng.choice(["a", "sub.in1"]) for k in wiring if rng.random() < 0.2})
            programs[f"P{i}.{j}"] = program
            for _ in range(5):
                unit, token, value = rng.choice(list(program.pous)), rng.choice([*tokens, "t1.PT", "own1"]), rng.random() < 0.7
                rows = requirements(program, unit, token, value, frozenset({"D2"}), 5)
                if len(rows) <= 1000:
                    starts.append((len(starts), f"P{i}.{j}", unit, token, value))
                    want.update((len(starts) - 1, *(r[c] for c in COLUMNS)) for r in rows)
    units, wiring, names, hints = tables(spark, programs)
    for few in (trace_tables.FEW_ROWS, 0):
        monkeypatch.setattr(trace_tables, "FEW_ROWS", few)
        have = Counter(map(tuple, trace_tables.requirement_paths(units, wiring, names, spark.createDataFrame(starts, STARTS), hints, ("D2",), 5).collect()))
        assert have == want, (few, (have - want).most_common(3), (want - have).most_common(3))
    assert {r[6] for r in want} >= {"port_mapping", "branch_hint", "global_variable", "unknown", "terminal"}
