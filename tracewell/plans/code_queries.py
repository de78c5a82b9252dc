"""Queries over structured text whose nesting, lists and bounds come from row values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import logic
from ..operators import diagrams, etl, names
from ..sources import plcopen, program
from ..tables import load, scratch, spread
from .function_queries import _each
from .registry import query


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _nested_code() -> Column:
    """As many IF around a CASE as the size says, with loops, strings and indexed targets in its branches."""
    z, k = F.col("p_size"), F.col("p_partkey")
    ifs = F.expr("array_join(transform(filter(sequence(0, p_size % 4), i -> i > 0), i -> concat('IF g', i, ' THEN\\n')), '')")
    ends = F.expr("repeat('END_IF;\\n', p_size % 4)")
    case = _text("CASE mode", z, " OF\n1, ", z, ": x.y := 'p;", k, "'; // y := 1;\n3..", z + 3, ": WHILE NOT (done OR (b AND c", z, ")) DO\narr[i+", z, "] := f(g(a), ", k, "); END_WHILE\nELSE (* ELSE z := 2; *)\nFOR i := ", z, " TO n BY -1 DO p^.v := i; END_FOR\nEND_CASE\n")
    return _text(ifs, case, F.when(z % 4 > 0, _text("ELSIF late THEN\nlast S= q", z, ";\n")).otherwise(""), ends)


@query("""WITH x AS (SELECT p_partkey AS k, p_size AS z, p_size % 4 AS m, list_transform(range(1, p_size % 4 + 1), lambda i: 'g' || i) AS gs FROM part),
    r AS (SELECT k, z, m, gs, unnest([{'t': 'x.y', 'v': '''p;' || k || '''', 'l': 2, 'c': ['mode' || z || ' = 1 OR mode' || z || ' = ' || z]},
        {'t': 'arr[i+' || z || ']', 'v': 'f(g(a), ' || k || ')', 'l': 4, 'c': ['mode' || z || ' >= 3 AND mode' || z || ' <= ' || (z + 3), 'NOT (done OR (b AND c' || z || '))']},
        {'t': 'i', 'v': CAST(z AS VARCHAR), 'l': 6, 'c': ['NOT (mode' || z || ' = 1 OR mode' || z || ' = ' || z || ')', 'NOT (mode' || z || ' >= 3 AND mode' || z || ' <= ' || (z + 3) || ')']},
        {'t': 'p^.v', 'v': 'i', 'l': 6, 'c': ['NOT (mode' || z || ' = 1 OR mode' || z || ' = ' || z || ')', 'NOT (mode' || z || ' >= 3 AND mode' || z || ' <= ' || (z + 3) || ')', 'i >= n AND i <= ' || z]}]) AS s FROM x)
    SELECT k AS p_partkey, s.t AS target, s.v AS value, CAST(s.l + m AS INTEGER) AS line, array_to_string(gs || s.c, ' & ') AS conditions FROM r
    UNION ALL SELECT k, 'last', 'TRUE', CAST(9 + m AS INTEGER), array_to_string(gs[1:m - 1] || ['NOT (g' || m || ')', 'late', 'q' || z], ' & ') FROM x WHERE m > 0""")
def nested_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments of nested code with the guards of all branches and loops around them."""
    rows = lambda t: [(a.target, a.value, a.line, " & ".join(a.conditions)) for a in logic.assignments(t)]
    return _each(spread(load(spark, sf_dir, "part")), "p_partkey", _nested_code(), rows, "target string, value string, line int, conditions string")


# One unit per part that calls blocks in several ways, as rows of a program.
_CALLS = """u AS (SELECT p_partkey AS k, p_size AS z, 'U' || p_partkey AS name, 'B' || p_size AS block FROM part), b AS (SELECT DISTINCT z, block FROM u),
    c AS (SELECT k, z, name, block, unnest([{'i': 't', 'n': 0, 'd': 'Input', 'p': 'a', 'e': 'NOT (x AND (y OR z' || z || '))', 'o': NULL}, {'i': 't', 'n': 0, 'd': 'Output', 'p': 'q', 'e': 'arr[' || z || ']', 'o': NULL},
        {'i': 'fbs[' || (z % 3) || ']', 'n': 0, 'd': 'Input', 'p': NULL, 'e': '''a;b''', 'o': 0}, {'i': 'fbs[' || (z % 3) || ']', 'n': 0, 'd': 'Input', 'p': NULL, 'e': 'f(g(1, ' || k || '), 2)', 'o': 1},
        {'i': 't.Start', 'n': 0, 'd': NULL, 'p': NULL, 'e': NULL, 'o': NULL}, {'i': 't', 'n': 1, 'd': 'Input', 'p': NULL, 'e': 'last', 'o': 0}]) AS c FROM u)"""


def _calling_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(load(spark, sf_dir, "part"))
    z, k = F.col("p_size"), F.col("p_partkey")
    port = lambda d, n, t: F.struct(F.lit(d).alias("direction"), F.lit(n).alias("name"), t.alias("type"))
    code = _text("t(a := NOT (x AND (y OR z", z, ")), q => arr[", z, "]);\nIF go THEN // t(a := 1);\nfbs[", z % 3, "]('a;b', f(g(1, ", k, "), 2)); t.Start(); END_IF\nCASE s OF 1: t(last); END_CASE")
    block = _text("B", z)
    units = part.select(_text("U", k).alias("name"), F.lit("program").alias("kind"), F.array(port("Local", "t", block), port("Local", "fbs", _text("ARRAY[0..2] OF ", block))).alias("ports"), code.alias("code"))
    blocks = part.select("p_size").distinct().select(block.alias("name"), F.lit("functionBlock").alias("kind"), F.array(port("Output", "q", F.lit("BOOL")), port("Input", "a", F.lit("BOOL")), port("Input", "b", F.lit("INT"))).alias("ports"), F.lit("").alias("code"))
    return units.unionByName(blocks)


@query(f"""WITH {_CALLS} SELECT name AS caller, c.i AS instance, CAST(c.n AS INTEGER) AS idx, c.d AS direction, c.p AS port, CAST(c.o AS INTEGER) AS place, c.e AS expression FROM c""")
def nested_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments of calls within branches, with parentheses several deep, strings, indexed instances, methods and places."""
    return etl.call_bindings(_calling_units(spark, sf_dir))


@query(f"""WITH {_CALLS}, f AS (SELECT name, block, 'Call_' || name || '_' || replace(c.i, '.', '__dot__') || '_' || c.n AS call, c.i AS i, c.n AS n, c.e AS e, coalesce(c.p, CASE c.o WHEN 0 THEN 'a' WHEN 1 THEN 'b' END) AS port FROM c),
    a AS (SELECT *, 'Assign' || substring(call, 5) || '_' || port AS assign FROM f WHERE port IS NOT NULL)
    SELECT DISTINCT * FROM (SELECT 'POU_' || name AS s, 'op:containsPOUCall' AS p, call AS o FROM f UNION ALL SELECT call, 'op:callsPOU', 'POU_' || block FROM f UNION ALL SELECT call, 'op:hasAssignment', assign FROM a
    UNION ALL SELECT assign, 'dp:hasExpression', e FROM a UNION ALL SELECT assign, 'op:assignsToPort', 'Port_' || block || '_' || port FROM a)""")
def bound_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call triples: arguments without names at the callee's inputs by order, array elements and methods at their instance."""
    rows = _calling_units(spark, sf_dir)
    return etl.calls(rows, etl.call_bindings(rows)).select("s", "p", "o")


@query("""WITH x AS (SELECT p_partkey AS k, p_size AS z, 'U' || p_partkey AS pou FROM part) SELECT pou, unnest(['a', 's', 'p', 'q', 'r']) AS name,
    unnest(['ARRAY[1..' || z || ', 0..1] OF INT', 'STRING[' || z || ']', 'POINTER TO ARRAY[0..1] OF Lib.Kind', 'STRUCT x : INT := ' || z || '; y : STRING; END_STRUCT', 'INT(0..' || z || ')']) AS type,
    unnest(['[' || z || '(0), ' || k || ']', '''a;' || z || '''', NULL, '(x := ' || k || ', y := '';'')', CAST(z AS VARCHAR)]) AS init FROM x""")
def nested_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults of arrays, strings, pointers and structures from declaration headers."""
    z, k = F.col("p_size"), F.col("p_partkey")
    header = _text("FUNCTION_BLOCK F", k, "\nVAR_INPUT a : ARRAY[1..", z, ", 0..1] OF INT := [", z, "(0), ", k, "]; (* x : INT; *) s : STRING[", z, "] := 'a;", z, "'; END_VAR\nVAR p : POINTER TO ARRAY[0..1] OF Lib.Kind; q : STRUCT x : INT := ", z, "; y : STRING; END_STRUCT := (x := ", k, ", y := ';'); r AT %MW", z, " : INT(0..", z, ") := ", z, "; END_VAR")
    return etl.defaults(spread(load(spark, sf_dir, "part")).select(_text("U", k).alias("name"), header.alias("header")))


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export per part: a diagram of as many operators as the size says, and a block with a method and flags."""
    z, k = F.col("p_size"), F.col("p_partkey")
    link = lambda at, pin="": f'<connectionPointIn><connection refLocalId="{at}"{pin}/></connectionPointIn>'
    pin = lambda name, inner: f'<variable formalParameter="{name}">{inner}</variable>'
    operator = F.expr("""array_join(transform(filter(sequence(0, p_size % 3), i -> i > 0), i -> concat('<block localId="', 100 + i, '" typeName="OR"><inputVariables><variable formalParameter="a"><connectionPointIn><connection refLocalId="', if(i = 1, 1, 99 + i),
        '"/></connectionPointIn></variable><variable formalParameter="b"><connectionPointIn><connection refLocalId="3" formalParameter="Q"/></connectionPointIn></variable></inputVariables></block>')), '')""")
    last = F.when(z % 3 == 0, F.lit(1)).otherwise(z % 3 + 100)
    timer = _text('<block localId="3" typeName="TON" instanceName="t"><inputVariables><variable formalParameter="IN" negated="', F.when(k % 2 == 1, "true").otherwise("false"), '">', link("1"), "</variable></inputVariables></block>")
    mover = _text('<block localId="4" typeName="M', k, '" instanceName="m"><inputVariables><variable formalParameter="go"><connectionPointIn><connection refLocalId="9"/></connectionPointIn></variable>', pin("idle", "<connectionPointIn/>"), "</inputVariables></block>")
    ends = _text('<connector localId="8" name="c"><connectionPointIn><connection refLocalId="', last, '"/></connectionPointIn></connector><continuation localId="9" name="c"/><outVariable localId="2"><expression>Gvl.out', z, "</expression>", link("4", ' formalParameter="done"'), "</outVariable>")
    main = _text('<pou name="P', k, '" pouType="program"><body><FBD><inVariable localId="1"><expression>Gvl.g', z, "</expression></inVariable>", operator, timer, mover, ends, "</FBD></body></pou>")
    block = _text('<pou name="M', k, '" pouType="functionBlock"><interface><inputVars><variable name="go"><type><BOOL/></type><initialValue><simpleValue value="', z, '"/></initialValue></variable></inputVars><addData><data><InterfaceAsPlainText><xhtml>', F.when(k % 3 == 0, _text("{attribute 'OPC.UA.DA.JobMethod' := 'Job", z, "'}")).otherwise(""), " VAR_INPUT {attribute 'OPC.UA.DA' := '1'} go : BOOL; END_VAR</xhtml></InterfaceAsPlainText></data></addData></interface>", '<body><ST>x := 1;</ST></body><addData><data><Method name="Check State"><interface><returnType><BOOL/></returnType></interface><body><ST>go := TRUE;</ST></body></Method></data></addData></pou>')
    return spread(load(spark, sf_dir, "part")).select(_text("<project><types><pous>", main, block, "</pous></types></project>").alias("t"))


@query("""WITH x AS (SELECT p_partkey AS k, p_size AS z, p_size % 3 AS n FROM part)
    SELECT 'P' || k AS pou, 'm.go' AS sink, 'Gvl.g' || z AS source, n = 0 AS direct, false AS negated FROM x UNION ALL SELECT 'P' || k, 'm.go', 't.Q', false, false FROM x WHERE n > 0
    UNION ALL SELECT 'P' || k, 't.IN', 'Gvl.g' || z, true, k % 2 = 1 FROM x UNION ALL SELECT 'P' || k, 'Gvl.out' || z, 'm.done', true, false FROM x""")
def diagram_wires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What feeds the sinks of each export's diagram, through operators and a connector."""
    at = lambda name, pin, text: F.coalesce(F.when(F.col(pin).isNotNull(), F.concat_ws(".", name, pin)), F.col(text))
    found = diagrams.wires(scratch(plcopen.parse_exports(_exports(spark, sf_dir), "t").select("name", "pins"), "exports"))
    return found.select("pou", at("name", "pin", "text").alias("sink"), at("from_name", "from_pin", "from_text").alias("source"), "direct", "negated")


@query("""WITH x AS (SELECT p_partkey AS k, p_size AS z, 'POU_M' || p_partkey AS u, 'Method_Check__leerz__State_M' || p_partkey AS m FROM part)
    SELECT u AS s, 'dp:hasPOULanguage' AS p, 'ST' AS o FROM x UNION ALL SELECT 'POU_P' || k, 'dp:hasPOULanguage', 'FBD' FROM x UNION ALL SELECT u, 'dp:isJobMethod', 'true' FROM x WHERE k % 3 = 0 UNION ALL SELECT u, 'dp:hasJobMethodName', 'Job' || z FROM x WHERE k % 3 = 0
    UNION ALL SELECT u, 'op:hasMethod', m FROM x UNION ALL SELECT u, 'op:hasCheckStateMethod', m FROM x UNION ALL SELECT m, 'op:isMethodOf', u FROM x UNION ALL SELECT m, 'rdf:type', 'Method' FROM x UNION ALL SELECT m, 'dp:hasMethodType', 'Check State' FROM x UNION ALL SELECT m, 'dp:hasCode', 'go := TRUE;' FROM x
    UNION ALL SELECT m, 'dp:hasPOULanguage', 'ST' FROM x UNION ALL SELECT m, 'dp:hasMethodReturnType', 'BOOL' FROM x UNION ALL SELECT m, 'dp:hasTcRpcEnabled', 'false' FROM x UNION ALL SELECT 'Port_M' || k || '_go', 'dp:hasDefault', CAST(z AS VARCHAR) FROM x
    UNION ALL SELECT 'Port_M' || k || '_go', 'dp:hasOPCUADataAccess', 'true' FROM x UNION ALL SELECT 'Port_M' || k || '_go', 'dp:hasOPCUAWriteAccess', 'true' FROM x""")
def export_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages, methods, job methods, initial values and access flags of each export as triples."""
    return etl.export_facts(scratch(plcopen.parse_exports(_exports(spark, sf_dir), "t"), "exports")).select("s", "p", "o")


@query("""WITH x AS (SELECT p_partkey AS k, p_size AS z, p_size % 3 AS n FROM part)
    SELECT 'P' || k AS caller, 'm' AS instance, CAST(0 AS INTEGER) AS idx, 'Input' AS direction, 'go' AS port, CAST(NULL AS INTEGER) AS place, CASE WHEN n = 0 THEN 'Gvl.g' || z END AS expression FROM x
    UNION ALL SELECT 'P' || k, 'm', 0, 'Output', 'done', NULL, 'Gvl.out' || z FROM x UNION ALL SELECT 'P' || k, 't', 0, 'Input', 'IN', NULL, CASE WHEN k % 2 = 1 THEN 'NOT ' ELSE '' END || 'Gvl.g' || z FROM x""")
def diagram_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that diagrams draw, as arguments of their blocks."""
    rows = scratch(plcopen.parse_exports(_exports(spark, sf_dir), "t"), "exports")
    return diagrams.diagram_bindings(rows, diagrams.wires(rows))


# One expression per part, of another kind by its size.
_SOURCES = """x AS (SELECT p_partkey AS k, p_size AS z, 'U' || p_partkey AS pou, CASE p_size % 8 WHEN 0 THEN 'NOT (known.N' || (p_partkey % 25) || ')' WHEN 1 THEN 'T#' || p_size || 's' WHEN 2 THEN 'GvlX.a.v' || p_partkey WHEN 3 THEN 'Inst.Q' || p_size WHEN 4 THEN 'other.x' || p_size
    WHEN 5 THEN '(spare AND NOT GvlX.v' || p_size || ') OR t = T#' || p_size || 's' WHEN 6 THEN 'SPARE' ELSE 'fresh' || p_size END AS e FROM part),
    s AS (SELECT k, z, pou, e AS expression, ['known', 'literal', 'global', 'port', 'member', 'expression', 'local', 'new'][z % 8 + 1] AS tier, CASE z % 8 WHEN 0 THEN 'node:' || (k % 25) WHEN 1 THEN 'Literal_' || e WHEN 2 THEN 'Var_GvlX_a_v' || k WHEN 3 THEN 'PortInstance_' || pou || '_Inst_Q' || z
        WHEN 4 THEN 'Var_' || pou || '_other__dot__x' || z WHEN 5 THEN 'Expression_' || pou || '_' || left(md5(pou || '|' || e), 10) WHEN 6 THEN 'Var_' || pou || '_spare' ELSE 'Var_' || pou || '_fresh' || z END AS target FROM x)"""


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    z, k = F.col("p_size"), F.col("p_partkey")
    forms = [_text("NOT (known.N", k % 25, ")"), _text("T#", z, "s"), _text("GvlX.a.v", k), _text("Inst.Q", z), _text("other.x", z), _text("(spare AND NOT GvlX.v", z, ") OR t = T#", z, "s"), F.lit("SPARE"), _text("fresh", z)]
    local = lambda n, t: F.struct(F.lit("Local").alias("direction"), F.lit(n).alias("name"), F.lit(t).alias("type"))
    part = spread(load(spark, sf_dir, "part"))
    rows = part.select(_text("U", k).alias("name"), F.array(local("inst", "TON"), local("spare", "BOOL")).alias("ports"))
    known = load(spark, sf_dir, "nation").select(_text("Known.n", F.col("n_nationkey")).alias("name"), _text("node:", F.col("n_nationkey")).alias("node"))
    return part.select(_text("U", k).alias("pou"), F.element_at(F.array(*forms), (z % 8 + 1).cast("int")).alias("expression")), rows, known


@query(f"WITH {_SOURCES} SELECT pou, expression, tier, target FROM s")
def name_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each expression comes from, in all tiers."""
    return names.signal_sources(*_sources(spark, sf_dir)).drop("text")


@query(f"""WITH {_SOURCES} SELECT DISTINCT * FROM (SELECT target AS s, 'rdf:type' AS p, CASE tier WHEN 'literal' THEN 'SourceLiteral' WHEN 'expression' THEN 'Expression' WHEN 'port' THEN 'PortInstance' ELSE 'Variable' END AS o FROM s WHERE tier IN ('literal', 'expression', 'port', 'new', 'member')
    UNION ALL SELECT target, 'dp:hasExpressionText', expression FROM s WHERE tier IN ('literal', 'expression') UNION ALL SELECT target, 'dp:hasVariableName', expression FROM s WHERE tier IN ('new', 'member')
    UNION ALL SELECT target, 'op:isExpressionCreatedBy', unnest(['Var_' || pou || '_spare', 'Var_GvlX_v' || z, 'Literal_T#' || z || 's']) FROM s WHERE tier = 'expression')""")
def source_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of literals, expressions with what they are made of, and variables that are new."""
    uses, rows, known = _sources(spark, sf_dir)
    return names.source_triples(names.signal_sources(uses, rows, known), rows).select("s", "p", "o")


@query("""WITH x AS (SELECT p_partkey, p_size AS z, unnest(range(1, p_size % 3 + 2)) AS step FROM part)
    SELECT p_partkey, CAST(step AS INTEGER) AS step, 'call' || step AS name, '0=true,1=' || z AS inputs, CASE WHEN step = 2 THEN '0=n' || z ELSE '' END AS outputs FROM x""")
def plan_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of plans whose parameter rows come in any order: a method, its inputs and outputs by index, for each step."""
    z = F.col("p_size")
    row = lambda step, g, i, v: F.concat(F.lit('{"step": '), step.cast("string"), F.lit(f', "g": "{g}", "k": "x", "i": {i}, "t": "int32", "v": '), v, F.lit("}"))
    quoted = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    rows = lambda s: F.array(row(s, "input", 1, z.cast("string")), row(s, "method", 0, quoted(F.concat(F.lit("call"), s.cast("string")))), row(s, "input", 0, F.lit("true")), F.when(s == 2, row(s, "output", 0, quoted(F.concat(F.lit("n"), z.cast("string"))))))
    each = F.array_compact(F.flatten(F.transform(F.sequence(F.lit(1), z % 3 + 1), rows)))
    plans = load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('{"rows": ['), F.array_join(each, ", "), F.lit("]}")).alias("json"))
    written = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"])), ",")
    return program.operations(plans, "p_partkey").select("p_partkey", "step", "name", written("inputs").alias("inputs"), written("outputs").alias("outputs"))
