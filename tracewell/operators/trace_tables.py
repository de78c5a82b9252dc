"""Requirement traces over tables: what trace.requirements() finds, without a process that holds a program.

Programs whose units are all the same, in every column, have one shape; units are read and steps worked out once a shape.
What a token's trace does next within its unit, by the value it must take, depends on the unit, the unit that owns it, the
type of an instance and the first call of the unit alone, so it is worked out once for each token that any expression
mentions: a table of steps, keyed by (shape, unit, token, value), with the rows a step gives and the goals that follow. Most
steps follow from the unit and its calls and are worked out as it is parsed; those that need other units, owners or instances'
types, are joined with what these say. What differs within a shape are wiring and globals: an input's wiring is joined
to the goals that ask for it, and tokens without a step, which nothing declares, are looked up among the globals at the end.
A level of the trace is one join of the frontier with the steps: a small table of steps, by count, goes to each
task and the frontier stays where it is; a larger one is dealt and sorted by its key once, and only the frontier moves. Depth,
states taken as inactive and loops are told from a goal's own path.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import logic
from ..tables import big, discard, scratch, spread
from .trace import MOST_DEPTH, STANDARD, assignment_points

UNITS = "program string, name string, code string, language string, inputs map<string,string>, outputs map<string,string>, variables map<string,string>, instances map<string,string>, is_job_method boolean, methods map<string,string>, owner string"
_ASSIGNS = "array<struct<method:string,local:boolean,target:string,value:string,line:int,conditions:array<string>>>"
_LEAVES = "array<struct<token:string,value:boolean>>"
_EMITS = "array<struct<deeper:int,token:string,value:boolean,pou:string,kind:string,reason:string,source:string,assignment:string>>"
_GOALS = "array<struct<way:int,deeper:int,token:string,value:boolean,pou:string>>"
_STEPS = f"program string, pou string, k string, value boolean, emits {_EMITS}, goals {_GOALS}"
#: What a unit gives, by need: facts about its names; steps; tokens whose step is told by other units (rest).
_UNIT = f"program string, pou string, k string, need string, value boolean, emits {_EMITS}, goals {_GOALS}, role string, own_name string, initial string, instance string, type string, assigns {_ASSIGNS}, passed map<string,string>, if_true {_LEAVES}, if_false {_LEAVES}"
#: Bytes of results that a task remembers.
_REMEMBERED = 8 << 20
#: In a row's token: what follows the instance in the asked one.
PORT = "\x02"
#: Steps that a task of a level's join holds, about.
STEPS_A_TASK = 200_000
#: Rows of a table, and bytes of one as JSON, that may be sent to each task; no table with more is.
FEW_ROWS, FEW_BYTES = 20_000, 8 << 20
#: Expressions of the wiring that a task reads for their tokens, about.
TEXTS_A_TASK = 100_000
#: Units that a task parses, and tokens whose steps it works out from joined rows, about.
UNITS_A_TASK = 10_000
SCHEMA = "trace long, path_id string, depth int, token string, value boolean, pou string, kind string, reason string, source string, assignment string"


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _rows(df: DataFrame, f, schema: str) -> DataFrame:
    """f's dicts for each row (a dict) without its program, to which the results belong, in Arrow batches. A row that differs
    from another that the task met a short while ago by its program alone isn't worked out again."""
    kind = _arrow(schema)
    rest = pa.schema(list(kind)[1:])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, pa.RecordBatch | None] = {}  # None: met once
        size = 0
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                new, found, names = [], [], []
                for program, r in zip(part.column(0).to_pylist(), pa.RecordBatch.from_arrays(part.columns[1:], part.schema.names[1:]).to_pylist(), strict=True):
                    if (own := known.get(text := repr(r))) is None:
                        rows = list(f(r))
                        if text not in known:
                            new += [{"program": program, **x} for x in rows]
                            known[text], size = None, size + len(text)
                            continue
                        known[text] = own = pa.RecordBatch.from_pylist(rows, rest)
                        size += own.nbytes
                    found.append(own)
                    names += [program] * own.num_rows
                if size > _REMEMBERED:
                    known, size = {}, 0
                yield pa.RecordBatch.from_pylist(new, kind)
                yield from pa.Table.from_batches(found, rest).add_column(0, kind.field(0), pa.array(names, pa.string())).combine_chunks().cast(kind).to_batches()

    return df.select("program", *[c for c in df.columns if c != "program"]).mapInArrow(run, schema)


def _mentioned(texts: Iterable[str]) -> set[str]:
    """The tokens, in lower case, of all expressions that can be read."""
    out = set()
    for t in texts:
        try:
            out |= {x.lower() for x in logic.tokens(logic.parse(t))}
        except ValueError:
            pass
    return out


def _facts(unit: dict) -> tuple[dict[str, dict], set[str]]:
    """What a unit says about each of its names, and which tokens its expressions mention."""
    facts: dict[str, dict] = {}
    of = lambda name: facts.setdefault(name.lower(), {"pou": unit["name"], "k": name.lower(), "role": None, "own_name": None, "initial": None, "instance": None, "type": None, "assigns": [], "passed": None, "if_true": None, "if_false": None})
    code, texts = unit["code"] or "", []
    for role in ("inputs", "outputs", "variables"):
        for name, initial in unit[role] or []:
            if of(name)["role"] is None:
                of(name).update(role=role, own_name=name, initial=initial)
    for name, kind in unit["instances"] or []:
        if of(name)["instance"] is None:
            of(name).update(type=kind, instance=name)
    for method, text, local in [("", code, not unit["is_job_method"]), *((m, t, False) for m, t in unit["methods"] or [])]:
        for a in logic.assignments(text or ""):
            of(a.target)["assigns"].append({"method": method, "local": local, "target": a.target, "value": a.value, "line": a.line, "conditions": a.conditions})
            texts += [a.value, *a.conditions]
    for name, _, ins, _ in logic.calls(code):
        if of(name)["passed"] is None:
            of(name)["passed"] = [(k.lower(), v) for k, v in ins.items()]
            texts += ins.values()
    mentions = _mentioned(texts)
    if unit["language"] == "FBD":
        blocks, outputs = logic.fbd_lines(code)
        for name in (*outputs, *blocks):
            if of(name)["if_true"] is None:
                found = [[{"token": t, "value": v} for t, v in logic.leaves(logic.fbd_tree(name, blocks, outputs), wanted)] for wanted in (True, False)]
                of(name).update(if_true=found[0], if_false=found[1])
                mentions |= {x["token"].lower() for f in found for x in f}
    return facts, mentions | {k for k, f in facts.items() if f["role"]}


def _expression(text: str, value: bool, deeper: int, pou: str, emits: list, goals: list) -> None:
    try:
        ways, _ = logic.truth_paths(text, value)
    except ValueError:
        emits.append((deeper, text, value, pou, "unknown", "not an expression", "unknown", None))
        return
    for i, way in enumerate(ways, 1):
        goals += [(0 if len(ways) == 1 else i, deeper, t, v, pou) for t, v in way]


_LITERAL = {"TRUE": True, "FALSE": False}


def _assigned(found: list[dict] | None, pou: str, v: bool, follow: bool, emits: list, goals: list) -> bool:
    """A step to the unit's own assignment of an output: the last whose literal fits, else the last that computes, else the last."""
    own = [a for a in found or [] if not a["method"]]
    if not own:
        return False
    literal = lambda a: _LITERAL.get(a["value"].upper())
    best = max(own, key=lambda a: (2 if literal(a) is v else 1 if literal(a) is None else 0, a["line"]))
    emits.append((1, best["asked"], v, pou, "output_assignment", f"line {best['line']}", "assignment", f"{best['target']} := {best['value']}"))
    for c in best["conditions"]:
        _expression(c, True, 2, pou, emits, goals)
    if follow and literal(best) is None:
        _expression(best["value"], v, 2, pou, emits, goals)
    return True


#: Sources that the row of an input has which no call passes; only such rows have them.
UNWIRED = ("default", "job_method")


def _step(r: dict, v: bool) -> tuple[list, list]:
    """The rows and goals of a token that must be v, from what is known of its unit, its owner and its instance: none where
    nothing declares it. An input's are those without wiring. A row without a token is the asked one's."""
    emits: list[tuple] = []
    goals: list[tuple] = []
    pou, k = r["pou"], r["k"]
    emit = lambda deeper, token, value, p, kind, reason, source, text=None: emits.append((deeper, token, value, p, kind, reason, source, text))
    holder, held = (pou, r["inst"]) if r["inst"] and r["inst"]["instance"] else (r["owner"], r["owner_inst"])
    if r["port"] and held and held["instance"]:
        kind, port, passed = held["type"], r["port"], dict(held["passed"] or [])
        if kind.upper() in STANDARD and port.upper() in ("Q", "Q1"):
            source, timed = STANDARD[kind.upper()]
            text = passed.get(source.lower())
            emit(0, None, v, holder, "std_fb_dependency", f"{kind}.{source}", "standard_fb", text)
            if text is None:
                return emits, goals
            if (m := re.fullmatch(r"(?is)NOT\s*\(?\s*(.*?)\s*\)?", text)) and m[1].lower() == k:
                emit(1, None, False, holder, "temporal_note", "FALSE (t-1)", "standard_fb")
                return emits, goals
            _expression(text, kind.upper() != "F_TRIG" and v, 1, holder, emits, goals)
            if timed and (pt := passed.get("pt")) and not re.match(r"(?i)t(ime)?#", pt):
                emit(1, pt, True, holder, "elapsed", f"{kind}.PT", "standard_fb")
            return emits, goals
        callee, at = r["callee"], r["callee_fact"]
        if port in passed or (at and at["role"] == "inputs"):
            if port not in passed:
                emit(0, None, v, holder, "terminal", "no such parameter", "call")
            else:
                emit(0, None, v, holder, "instance_port", "input", "token", passed[port])
                _expression(passed[port], v, 1, holder, emits, goals)
        elif not callee or not callee["has_code"]:
            emit(0, None, v, holder, "terminal", f"{kind} has no code", "callee")
        else:
            emit(0, None, v, holder, "instance_port", f"output of {kind}", "token")
            if callee["language"] == "FBD":
                _leaves(at, port, v, kind, goals)
            elif not _assigned([a | {"asked": PORT} for a in at["assigns"]] if at else None, kind, v, True, emits, goals):
                emit(1, None, v, kind, "terminal", "never assigned", "callee_st")
        return emits, goals
    own, unit = r["fact"], r["unit"]
    role, name = (own["role"], own["own_name"]) if own else (None, None)
    if role == "inputs":
        job = unit["is_job_method"]
        emit(0, None, v, pou, "job_method_input" if job else "terminal", own["initial"] or "no default", UNWIRED[1] if job else UNWIRED[0])
    elif role == "outputs":
        emit(0, None, v, pou, "local_port", "output", "token")
        if unit["language"] == "FBD":
            _leaves(own, k, v, pou, goals)
        else:
            _assigned([a | {"asked": name} for a in own["assigns"]], pou, v, False, emits, goals)
    elif role == "variables":
        emit(0, None, v, pou, "internal_variable", "variable", "token")
        literal = lambda a: _LITERAL.get(a["value"].upper())
        if not own["assigns"]:
            emit(1, None, v, pou, "terminal", own["initial"] or "no assignment", "metadata")
        else:
            best = max(own["assigns"], key=lambda a: (assignment_points(literal(a), v, a["local"], a["method"]), a["line"], a["method"]))
            where = f"line {best['line']}" + (f" of {best['method']}" if best["method"] else "")
            emit(1, name, v, pou, "internal_assignment" if best["local"] else "job_method_assignment", where, "assignment", f"{best['target']} := {best['value']}")
            for c in best["conditions"]:
                _expression(c, True, 2, pou, emits, goals)
            if literal(best) is None:
                _expression(best["value"], v, 2, pou, emits, goals)
    elif r["owner_fact"] and r["owner_fact"]["role"]:
        goals.append((0, 0, None, v, r["owner"]))
    return emits, goals


def _wired(pou: str, v: bool, callers: list[str], text: str, hint: str | None) -> tuple[list, list]:
    """The rows and goals of an input that must be v, by what its first caller passes."""
    emits: list[tuple] = [(0, None, v, pou, "port_mapping", f"called by {', '.join(callers)}", "wiring", text)]
    goals: list[tuple] = []
    if hint is not None:
        emits.append((0, None, v, pou, "branch_hint", "settled before", "hint", hint))
    _expression(text if hint is None else hint, v, 1, callers[0], emits, goals)
    return emits, goals


def _leaves(fact: dict | None, port: str, v: bool, pou: str, goals: list) -> None:
    for x in (fact or {}).get("if_true" if v else "if_false") or []:
        if x["token"].lower() != port.lower():
            goals.append((0, 1, x["token"], x["value"], pou))


def _unit_rows(unit: dict) -> Iterator[dict]:
    """Rows of _UNIT of a unit. All steps of a unit that has an owner or is one (shared) are for the joins."""
    facts, asked = _facts(unit)
    yield from ({**f, "need": "fact"} for f in facts.values())
    own = {"language": unit["language"] or "ST", "is_job_method": bool(unit["is_job_method"])}
    for k in sorted(asked):
        at = {"pou": unit["name"], "k": k}
        first, _, port = k.partition(".")
        fact, inst = facts.get(k), facts.get(first)
        inst = inst if inst and inst["instance"] else None
        by_callee = port and inst and not (inst["type"].upper() in STANDARD and port.upper() in ("Q", "Q1")) and port not in dict(inst["passed"] or [])
        if unit["shared"] or by_callee:
            yield {**at, "need": "rest"}
        elif (port and inst) or (fact and fact["role"]):
            for s in _steps({**at, "port": port, "inst": inst, "owner": None, "owner_inst": None, "callee": None, "callee_fact": None, "fact": fact, "unit": own, "owner_fact": None}):
                yield {**s, "need": "step"}


def _named(emits: list, goals: list) -> dict:
    named = lambda rs, *names: [dict(zip(names, x, strict=True)) for x in rs]
    return {"emits": named(emits, "deeper", "token", "value", "pou", "kind", "reason", "source", "assignment"), "goals": named(goals, "way", "deeper", "token", "value", "pou")}


def _steps(r: dict) -> Iterator[dict]:
    for v in (True, False):
        emits, goals = _step(r, v)
        if emits or goals:
            yield {"pou": r["pou"], "k": r["k"], "value": v, **_named(emits, goals)}


def _read_wiring(df: DataFrame) -> DataFrame:
    """df, which has pou, value, callers, text and hint of inputs, with emits and goals by the wiring; null where callers is."""
    schema = f"{df._jdf.schema().toDDL()}, by_emits {_EMITS}, by_goals {_GOALS}"
    kinds = [_arrow(schema).field(c).type for c in ("by_emits", "by_goals")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_named(*_wired(*x)) if x[2] else {"emits": None, "goals": None} for x in zip(*[b.column(c).to_pylist() for c in ("pou", "value", "callers", "text", "hint")], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x["emits"] for x in found], kinds[0]), pa.array([x["goals"] for x in found], kinds[1])], names=[*b.schema.names, "by_emits", "by_goals"])

    return df.mapInArrow(run, schema)


def _tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(program, pou, k) of the tokens of (program, pou, text)."""
    for b in batches:
        program, pou, text = (c.to_pylist() for c in b.columns)
        rows = [(p, u, k) for p, u, t in zip(program, pou, text, strict=True) for k in _mentioned([t])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["program", "pou", "k"])


def _tasks(df: DataFrame, rows: int) -> int:
    """For a table that is read: a task for so many rows, and no fewer than run at once where there are some rows for each."""
    n = -(-df.count() // rows)
    return max(n, min(df.sparkSession.sparkContext.defaultParallelism, 4 * n), 1)


def _few(df: DataFrame) -> bool:
    """Whether a table that is read is small enough, by its rows and bytes, to be sent to each task."""
    if df.limit(FEW_ROWS + 1).count() > FEW_ROWS:
        return False
    return (df.agg(F.sum(F.length(F.to_json(F.struct(*df.columns))).cast("long"))).first()[0] or 0) <= FEW_BYTES


def _side(df: DataFrame) -> DataFrame:
    """The right side of a join, a table that is read: sent to each task if it is small, merged otherwise."""
    return F.broadcast(df) if _few(df) else big(df)


def program_shapes(units: DataFrame) -> DataFrame:
    """(program, shape): programs have the same shape if their units, in any order, are the same in all columns. A shape is
    a digest of the sums of the four 32-bit parts of the units' digests, so that no program is gathered."""
    rest = [F.col(f"`{x.split()[0]}`") for x in UNITS.split(", ")[1:]]
    digest = units.select("program", F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256).alias("h"))
    digest = digest.select("program", F.xxhash64("h").alias("a"), F.xxhash64(F.lit(1), "h").alias("b"))
    half = [x for c in ("a", "b") for x in (F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(c, 32))]
    found = digest.groupBy("program").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(half)])
    return found.select("program", F.md5(F.concat_ws(",", "n", "s0", "s1", "s2", "s3")).alias("shape"))


def trace_steps(units: DataFrame, more: DataFrame) -> DataFrame:
    """The table of steps (program, pou, k, value, emits, goals) of all tokens that the units' expressions and declarations
    mention and of those of more(program, pou, k); tokens that nothing declares have none, inputs those without wiring.
    units has the columns of UNITS and is a table that is read; see requirement_paths(). Written to the shared folder; the caller discards it."""
    unit = units.select("program", F.col("name").alias("pou"), F.coalesce("language", F.lit("ST")).alias("language"), F.coalesce("is_job_method", F.lit(False)).alias("is_job_method"), "owner", (F.coalesce("code", F.lit("")) != "").alias("has_code"))
    owners = units.where("owner is not null").select("program", F.col("owner").alias("name")).distinct().withColumn("owns", F.lit(True))
    shared = F.col("owner").isNotNull() | F.col("owns").isNotNull()
    each = scratch(units.join(big(owners), ["program", "name"], "left").withColumn("shared", shared).drop("owns", "owner"), "units")
    read = scratch(_rows(spread(each, UNITS_A_TASK), _unit_rows, _UNIT), "facts")

    facts, own = read.where("need = 'fact'"), read.where("need = 'step'").select("program", "pou", "k", "value", "emits", "goals")
    # of more, only what has a declared name or begins with one can have a step
    names = scratch(facts.select("program", F.col("k").alias("name")).distinct(), "names")
    either = more.withColumn("name", F.explode(F.array_distinct(F.array("k", F.substring_index("k", ".", 1)))))
    more = either.join(_side(names), ["program", "name"], "left_semi").select("program", "pou", "k").distinct()
    more = more.join(big(own.select("program", "pou", "k").distinct()), ["program", "pou", "k"], "left_anti")
    asked = read.where("need = 'rest'").select("program", "pou", "k").unionByName(more)
    # a token that is its owner's is asked there, too
    above = asked.join(big(unit.where("owner is not null").select("program", "pou", "owner")), ["program", "pou"]).select("program", F.col("owner").alias("pou"), "k")
    keys = scratch(asked.unionByName(above).distinct(), "keys")

    def record(name: str, df: DataFrame, **on: str) -> DataFrame:
        """df as one struct column, under the names of the columns that it is joined by."""
        rest = [c for c in df.columns if c not in on]
        return df.select(*[F.col(c).alias(to) for c, to in on.items()], F.struct(*rest).alias(name))

    plain = facts.select("program", "pou", "k", "role", "own_name", "initial", "assigns", "if_true", "if_false")
    held = facts.where("instance is not null").select("program", "pou", "k", "instance", "type", "passed")
    rows = keys.join(big(record("unit", unit, program="program", pou="pou")), ["program", "pou"]).withColumn("owner", F.col("unit.owner"))
    rows = rows.withColumn("i", F.substring_index("k", ".", 1)).withColumn("port", F.expr("if(k like '%.%', substring(k, length(i) + 2), '')"))
    rows = rows.join(big(record("fact", plain, program="program", pou="pou", k="k")), ["program", "pou", "k"], "left")
    rows = rows.join(big(record("inst", held, program="program", pou="pou", k="i")), ["program", "pou", "i"], "left")
    rows = rows.join(big(record("owner_inst", held, program="program", pou="owner", k="i")), ["program", "owner", "i"], "left")
    rows = rows.join(big(record("owner_fact", plain.select("program", "pou", "k", "role"), program="program", pou="owner", k="k")), ["program", "owner", "k"], "left")
    rows = rows.withColumn("callee_name", F.coalesce("inst.type", "owner_inst.type"))
    rows = rows.join(big(record("callee", unit, program="program", pou="callee_name")), ["program", "callee_name"], "left")
    rows = rows.join(big(record("callee_fact", plain, program="program", pou="callee_name", k="port")), ["program", "callee_name", "port"], "left")

    rest = _rows(rows.repartition(_tasks(keys, UNITS_A_TASK)), _steps, _STEPS)
    out = scratch(own.unionByName(rest), "steps")
    discard(read, each, names, keys)
    return out


def requirement_paths(units: DataFrame, wiring: DataFrame, globals_: DataFrame, starts: DataFrame, hints: DataFrame | None = None, assumed_false: tuple[str, ...] = (), most_depth: int = MOST_DEPTH) -> DataFrame:
    """The rows of trace.requirements() for each of starts(trace, program, pou, token, value), with the trace they belong to.

    units has the columns of UNITS; wiring(program, pou, port, place, caller, expression) what each call of a unit passes, by place;
    globals_(program, name, address); hints(program, pou, port, expression) instead of a caller's expression. A start in a
    program or unit that isn't there gives no rows; a goal in a unit that isn't there one of kind unknown. Rows of equal starts with different trace numbers are their own. One job
    a level, or two where inputs are met, each written to the shared folder; an empty start table gives no rows.
    """
    shapes = scratch(program_shapes(units), "shapes")
    first = scratch(shapes.groupBy("shape").agg(F.min("program").alias("program")), "first")
    alike = units.join(_side(first), "program").withColumn("program", F.col("shape")).drop("shape")
    one_each = scratch(alike, "alike")  # the units of one program a shape, under the shape's name

    wired = wiring.groupBy("program", "pou", F.lower("port").alias("k")).agg(F.array_sort(F.collect_list(F.struct("place", "caller", "expression"))).alias("w"))
    wired = wired.select("program", "pou", "k", F.col("w.caller").alias("callers"), F.col("w")[0]["expression"].alias("text"))
    if hints is None:
        wired = wired.withColumn("hint", F.lit(None).cast("string"))
    else:
        wired = wired.join(big(hints.select("program", "pou", F.lower("port").alias("k"), F.col("expression").alias("hint"))), ["program", "pou", "k"], "left")
    wired = scratch(wired, "wired")

    begun = scratch(starts.join(big(shapes), "program"), "starts")
    texts = wired.select("program", F.col("callers")[0].alias("pou"), F.coalesce("hint", "text").alias("text")).where("text is not null").join(big(shapes), "program")
    texts = texts.select(F.col("shape").alias("program"), "pou", "text").repartition(_tasks(wired, TEXTS_A_TASK), "program", "pou", "text").distinct()
    asked = texts.mapInArrow(_tokens, "program string, pou string, k string").unionByName(begun.select(F.col("shape").alias("program"), "pou", F.lower("token").alias("k")))
    written = trace_steps(one_each, asked)

    by = ["shape", "pou", "k", "value"]
    steps = written.withColumnRenamed("program", "shape")
    if few := _few(written):
        steps = F.broadcast(steps)
    else:  # dealt and sorted once: in a level's join only the frontier moves, to as many parts by the same key
        parts = _tasks(written, STEPS_A_TASK)
        steps = steps.repartition(parts, *by).sortWithinPartitions(*by).persist(StorageLevel.DISK_ONLY)
    known = scratch(one_each.select(F.col("program").alias("shape"), F.col("name").alias("pou")).distinct(), "known")
    frontier = begun.join(_side(known), ["shape", "pou"], "left_semi").select("trace", "program", "shape", F.lit("1").alias("path"), F.lit(0).alias("depth"), "token", F.col("value").cast("boolean").alias("value"), "pou", F.array().cast("array<string>").alias("active"))
    columns = ["trace", "program", "shape", "path", "depth", "token", "value", "pou", "active", "own", "ended"]

    def stepped(rows: DataFrame) -> DataFrame:
        """With the steps of goals that haven't ended, and whether wiring may tell another one."""
        rows = rows.withColumn("k", F.when(F.col("ended").isNull(), F.lower("token")))
        found = (rows if few else rows.repartition(parts, *by)).join(steps if few else big(steps), by, "left")
        return found.select(*columns, "emits", "goals", F.coalesce(F.get("emits", F.lit(0))["source"].isin(*UNWIRED), F.lit(False)).alias("wirable"))

    levels, by_wiring = [], []
    while True:
        own = F.concat_ws("\x01", "pou", F.upper("token"), F.col("value").cast("string"))
        state = F.regexp_extract("token", r"(?:^|\.)([AFD]\d+)$", 1)
        assumed = F.col("value") & (state != "") & state.isin(*assumed_false) if assumed_false else F.lit(False)
        ended = F.when(F.col("depth") > most_depth, F.lit("stop")).when(assumed, F.lit("assumed_false")).when(F.array_contains("active", own), F.lit("loop"))
        rows = frontier.withColumns({"own": own, "ended": ended}).select(*columns)
        level = scratch(rows if few else stepped(rows), "level")  # where steps are sent to tasks, they are joined again and not stored
        levels.append(level)
        if not (n := level.count()):
            break
        if few and n > 4 * STEPS_A_TASK * level.rdd.getNumPartitions():  # ways multiply
            level = level.repartition(-(-n // STEPS_A_TASK), "trace", "path", "pou", "token")
        goals = seen = stepped(level) if few else level
        if not (inputs := seen.where("wirable")).isEmpty():
            inputs = inputs.withColumn("k", F.lower("token")).join(big(wired), ["program", "pou", "k"], "left").drop("k")
            by_wiring.append(scratch(_read_wiring(inputs).select(*columns, F.coalesce("by_emits", "emits").alias("emits"), F.coalesce("by_goals", "goals").alias("goals"), F.lit(False).alias("wirable")), "level"))
            goals = seen.where("not wirable").unionByName(by_wiring[-1])
        goals = goals.select("trace", "program", "shape", "path", "depth", F.col("token").alias("asked"), F.concat("active", F.array("own")).alias("active"), F.explode("goals").alias("g"))
        frontier = goals.select("trace", "program", "shape", F.when(F.col("g.way") > 0, F.concat_ws(".", "path", F.col("g.way").cast("string"))).otherwise(F.col("path")).alias("path"), (F.col("depth") + F.col("g.deeper")).alias("depth"), F.coalesce("g.token", "asked").alias("token"), F.col("g.value").alias("value"), F.col("g.pou").alias("pou"), "active")

    def together(tables: list[DataFrame]) -> DataFrame:
        return units.sparkSession.read.schema(tables[0].schema).parquet(*[f.rsplit("/", 1)[0] for x in tables for f in x.inputFiles()[:1]])

    every = (stepped(together(levels)) if few else together(levels)).where("not wirable")
    if by_wiring:
        every = every.unionByName(together(by_wiring))
    path: Column = F.col("path").alias("path_id")
    why = F.create_map(*[F.lit(x) for x in ("stop", "depth", "assumed_false", "state is taken as inactive", "loop", "met on this path")])
    none = F.lit(None).cast("string")
    end = F.struct(F.lit(0).alias("deeper"), none.alias("token"), "value", "pou", F.col("ended").alias("kind"), why[F.col("ended")].alias("reason"), F.lit("guard").alias("source"), none.alias("assignment"))
    e = every.select("trace", path, "depth", F.col("token").alias("asked"), F.explode(F.when(F.col("ended").isNotNull(), F.array(end).cast(_EMITS)).otherwise(F.col("emits"))).alias("e"))
    port = F.expr("substring(asked, length(substring_index(asked, '.', 1)) + 2)")
    told = e.select("trace", "path_id", (F.col("depth") + F.col("e.deeper")).alias("depth"), F.when(F.col("e.token") == PORT, port).otherwise(F.coalesce("e.token", "asked")).alias("token"), *[F.col(f"e.{c}").alias(c) for c in ("value", "pou", "kind", "reason", "source", "assignment")])

    # what has no step: a global, or nothing that is declared, or a unit that isn't there
    names = globals_.groupBy("program", F.lower("name").alias("k")).agg(F.min_by("address", "name").alias("address")).withColumn("named", F.lit(True))
    bare = every.where("ended is null and emits is null").select("trace", "program", "shape", path, "depth", "token", "value", "pou", F.lower("token").alias("k"))
    bare = bare.join(_side(known.withColumn("there", F.lit(True))), ["shape", "pou"], "left").join(big(names), ["program", "k"], "left")
    kind = F.when(F.col("there").isNull() | F.col("token").isNull() | F.col("value").isNull(), 0).when(F.col("named"), 1).otherwise(2)
    of = lambda *xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), kind + 1)
    address = F.coalesce(F.nullif("address", F.lit("")), F.lit("no hardware"))
    bare = bare.select("trace", "path_id", "depth", "token", "value", "pou", of("unknown", "global_variable", "unknown").alias("kind"), of("no such unit", address, "not declared").alias("reason"), of("guard", "global", "unknown").alias("source"), none.alias("assignment"))
    done = scratch(told.unionByName(bare), "trace")
    if not few:
        steps.unpersist()
    discard(written, shapes, first, one_each, wired, begun, known, *levels, *by_wiring)
    return done
