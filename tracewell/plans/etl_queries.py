"""Queries that run the graph-building steps on program units made from parts, global lists from nations and the like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnosis as dg
from ..operators import etl
from ..tables import big, load, spread
from .registry import query

# One unit per part, as SQL: its name, kind, ports, code and declarations.
_U = """u AS (SELECT p_partkey AS k, p_size AS z, 'U' || p_partkey AS name, CASE WHEN p_size % 3 = 0 THEN 'program' ELSE 'functionBlock' END AS kind, 'D' || (p_size % 9 + 1) AS state, 'U' || (p_partkey % 50 + 1) AS callee FROM part),
    ports AS (SELECT k, name, kind, unnest([{'d': 'Input', 'n': 'in1', 't': 'BOOL'}, {'d': 'Output', 'n': state, 't': 'INT'}, {'d': 'Local', 'n': 'inst', 't': callee}, {'d': 'Local', 'n': 'spare', 't': 'BOOL'}]
        || CASE WHEN z % 2 = 0 THEN [{'d': 'Output', 'n': 'A1', 't': 'INT'}, {'d': 'Output', 'n': 'f2', 't': 'INT'}] ELSE [] END) AS x FROM u),
    p AS (SELECT k, name, kind, x.d AS d, x.n AS n, x.t AS t FROM ports)"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(load(spark, sf_dir, "part")).select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    text = lambda c: c.cast("string")
    state, callee = F.concat(F.lit("D"), text(F.col("z") % 9 + 1)), F.concat(F.lit("U"), text(F.col("k") % 50 + 1))
    port = lambda d, n, t: F.struct(F.lit(d).alias("direction"), n.alias("name"), t.alias("type"))
    always = F.array(port("Input", F.lit("in1"), F.lit("BOOL")), port("Output", state, F.lit("INT")), port("Local", F.lit("inst"), callee), port("Local", F.lit("spare"), F.lit("BOOL")))
    even = F.array(port("Output", F.lit("A1"), F.lit("INT")), port("Output", F.lit("f2"), F.lit("INT")))
    out = text(F.col("z") % 7)
    code = F.concat(F.lit("inst(in1 := go"), text(F.col("z")), F.lit(", D1 => Gvl.Out"), out, F.lit("); // spare\nIF inst.D1 AND in1 THEN\n"), state, F.lit(" := inst.D2;\nEND_IF\nOut"), out, F.lit(" := inst.D1;\n(* A1 *) x.F2 := 1;\nRun('Skill"), text(F.col("z") % 5), F.lit("');"))
    header = F.concat(F.lit("VAR in1 : BOOL := TRUE; extra : INT := "), text(F.col("z")), F.lit("; SPARE : BOOL; END_VAR"))
    return rows.select(F.concat(F.lit("U"), text(F.col("k"))).alias("name"), F.when(F.col("z") % 3 == 0, "program").otherwise("functionBlock").alias("kind"), F.when(F.col("z") % 2 == 0, F.concat(always, even)).otherwise(always).alias("ports"), code.alias("code"), header.alias("header"))


@query(f"""WITH {_U} SELECT 'POU_' || name AS s, 'rdf:type' AS p, CASE WHEN kind = 'program' THEN 'Program' ELSE 'CustomFBType' END AS o, 'iri' AS o_kind FROM u
    UNION ALL SELECT 'POU_' || name, 'dp:hasPOUName', name, 'literal' FROM u
    UNION ALL SELECT 'POU_' || name, CASE WHEN d = 'Local' THEN 'op:hasVariable' ELSE 'op:hasPort' END, CASE WHEN d = 'Local' THEN 'Var_' ELSE 'Port_' END || name || '_' || n, 'iri' FROM p
    UNION ALL SELECT CASE WHEN d = 'Local' THEN 'Var_' ELSE 'Port_' END || name || '_' || n, CASE WHEN d = 'Local' THEN 'dp:hasVariableName' ELSE 'dp:hasPortName' END, n, 'literal' FROM p
    UNION ALL SELECT CASE WHEN d = 'Local' THEN 'Var_' ELSE 'Port_' END || name || '_' || n, CASE WHEN d = 'Local' THEN 'dp:hasVariableType' ELSE 'dp:hasPortType' END, t, 'literal' FROM p
    UNION ALL SELECT 'Port_' || name || '_' || n, 'dp:hasPortDirection', d, 'literal' FROM p WHERE d <> 'Local'""")
def unit_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, ports and variables as triples; code is left to other queries."""
    return etl.programs(_units(spark, sf_dir)).where("p <> 'dp:hasCode'")


@query("""WITH b AS (SELECT * FROM (VALUES ('SR', 'S1:BOOL R:BOOL', 'Q1:BOOL'), ('RS', 'S:BOOL R1:BOOL', 'Q1:BOOL'), ('R_TRIG', 'CLK:BOOL', 'Q:BOOL'), ('F_TRIG', 'CLK:BOOL', 'Q:BOOL'), ('CTU', 'CU:BOOL R:BOOL PV:INT', 'Q:BOOL CV:INT'),
    ('CTD', 'CD:BOOL LD:BOOL PV:INT', 'Q:BOOL CV:INT'), ('CTUD', 'CU:BOOL CD:BOOL R:BOOL LD:BOOL PV:INT', 'QU:BOOL QD:BOOL CV:INT'), ('TP', 'IN:BOOL PT:TIME', 'Q:BOOL ET:TIME'), ('TON', 'IN:BOOL PT:TIME', 'Q:BOOL ET:TIME'), ('TOF', 'IN:BOOL PT:TIME', 'Q:BOOL ET:TIME')) v(b, i, o)),
    q AS (SELECT b, 'Input' AS d, unnest(string_split(i, ' ')) AS x FROM b UNION ALL SELECT b, 'Output', unnest(string_split(o, ' ')) FROM b), r AS (SELECT b, d, split_part(x, ':', 1) AS n, split_part(x, ':', 2) AS t FROM q)
    SELECT 'U' || p_partkey AS unit, 'FBType_' || x.b AS s, 'rdf:type' AS p, 'StandardFBType' AS o FROM part JOIN b x ON x.b = ['SR', 'RS', 'R_TRIG', 'F_TRIG', 'CTU', 'CTD', 'CTUD', 'TP', 'TON', 'TOF'][p_size % 10 + 1]
    UNION ALL SELECT 'U' || p_partkey, 'FBType_' || r.b, 'op:hasPort', 'Port_' || r.b || '_' || n FROM part JOIN r ON r.b = ['SR', 'RS', 'R_TRIG', 'F_TRIG', 'CTU', 'CTD', 'CTUD', 'TP', 'TON', 'TOF'][p_size % 10 + 1]""")
def standard_block_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of the standard block that each part's unit uses: its type and ports."""
    kinds = F.array(*[F.lit(x) for x in ("SR", "RS", "R_TRIG", "F_TRIG", "CTU", "CTD", "CTUD", "TP", "TON", "TOF")])
    used = load(spark, sf_dir, "part").select(F.concat(F.lit("U"), F.col("p_partkey").cast("string")).alias("unit"), F.concat(F.lit("FBType_"), F.element_at(kinds, (F.col("p_size") % 10 + 1).cast("int"))).alias("s"))
    return used.join(F.broadcast(etl.standard_blocks(spark)), "s").select("unit", "s", "p", "o")  # a fixed table of some dozens of rows


@query(f"""WITH {_U} SELECT 'POU_' || name AS s, 'op:containsPOUCall' AS p, 'Call_' || name || '_inst_0' AS o FROM u UNION ALL SELECT 'Call_' || name || '_inst_0', 'op:callsPOU', 'POU_' || callee FROM u
    UNION ALL SELECT 'Call_' || name || '_inst_0', 'op:hasAssignment', 'Assign_' || name || '_inst_0_' || x FROM u, (VALUES ('in1'), ('D1')) v(x) UNION ALL SELECT 'Assign_' || name || '_inst_0_' || x, 'op:assignsToPort', 'Port_' || callee || '_' || x FROM u, (VALUES ('in1'), ('D1')) v(x)
    UNION ALL SELECT 'Assign_' || name || '_inst_0_in1', 'dp:hasExpression', 'go' || z FROM u UNION ALL SELECT 'Assign_' || name || '_inst_0_D1', 'dp:hasExpression', 'Gvl.Out' || (z % 7) FROM u""")
def call_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _units(spark, sf_dir)
    return etl.calls(rows, etl.call_bindings(rows)).select("s", "p", "o")


@query(f"WITH {_U} SELECT name AS pou, 'inst' AS instance, 'D1' AS port FROM u")
def condition_port_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.condition_ports(_units(spark, sf_dir))


@query(f"""WITH {_U} SELECT 'Port_' || name || '_in1' AS s, 'dp:hasDefault' AS p, 'TRUE' AS o, 'literal' AS o_kind FROM u UNION ALL SELECT 'Var_' || name || '_extra', 'dp:hasDefault', CAST(z AS VARCHAR), 'literal' FROM u
    UNION ALL SELECT 'POU_' || name, 'op:hasVariable', 'Var_' || name || '_extra', 'iri' FROM u UNION ALL SELECT 'Var_' || name || '_extra', 'dp:hasVariableName', 'extra', 'literal' FROM u UNION ALL SELECT 'Var_' || name || '_extra', 'dp:hasVariableType', 'INT', 'literal' FROM u""")
def default_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _units(spark, sf_dir)
    return etl.default_triples(rows, etl.defaults(rows), create=True)


@query(f"WITH {_U} SELECT count(*) AS n_set, count(*) AS n_created, count(*) AS n_missing FROM u")
def default_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _units(spark, sf_dir)
    return etl.default_counts(rows, etl.defaults(rows))


@query(f"""WITH {_U} SELECT name AS pou, n AS name FROM p JOIN u USING (k, name, kind) WHERE n = 'spare' OR n = 'A1' """)
def unused_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What only comments mention is unused; F2 is mentioned as a part of x.F2, whatever its case."""
    return etl.unused(_units(spark, sf_dir))


_HW = "hw AS (SELECT 'out' || n_nationkey AS name FROM nation WHERE n_nationkey % 2 = 0)"


@query(f"""WITH {_U}, {_HW} SELECT DISTINCT callee AS pou FROM u WHERE kind = 'program' AND 'out' || (z % 7) IN (SELECT name FROM hw)""")
def output_layer_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hardware variables are written by flow statements only: calls write Gvl.Out, which isn't hardware here."""
    rows = _units(spark, sf_dir)
    hardware = load(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("OUT"), F.col("n_nationkey").cast("string")).alias("name"))
    return etl.output_layer(rows, etl.call_bindings(rows), hardware, etl.flow_edges(rows))


@query(f"""WITH {_U}, c AS (SELECT k, name, count(*) FILTER (d = 'Output' AND regexp_matches(n, '^[AFDafd][0-9]+$')) AS so, count(*) FILTER (d = 'Output' AND NOT regexp_matches(n, '^[AFDafd][0-9]+$')) AS oo FROM p GROUP BY ALL)
    SELECT name AS pou, so AS n_state_out, CAST(0 AS BIGINT) AS n_state_in, oo AS n_other_out, CAST(1 AS BIGINT) AS n_assigned, so >= 3 AS is_modes, false AS is_outputs FROM c JOIN u USING (k, name) WHERE kind <> 'program'""")
def gemma_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state's assignment counts; one behind a comment on its line doesn't begin the line."""
    return etl.gemma_layers(_units(spark, sf_dir))


@query(f"""WITH {_U} SELECT name AS pou, 'Unit: ' || name || ' | Inputs: in1 (BOOL) | Outputs: ' || CASE WHEN z % 2 = 0 THEN 'A1 (INT), ' || state || ' (INT), f2 (INT)' ELSE state || ' (INT)' END || ' | Calls: ' || callee || ' | UNUSED variables (1): spare'
    || CASE WHEN z % 2 = 0 THEN ' | UNUSED ports (1): A1' ELSE '' END AS report FROM u""")
def unit_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _units(spark, sf_dir)
    return etl.consistency_reports(rows, etl.calls_of(rows, etl.call_bindings(rows)), etl.unused(rows))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global lists by region, with a variable per nation, and for some regions a simulated list of all nations below 20."""
    n = load(spark, sf_dir, "nation")
    text = lambda c: F.col(c).cast("string")
    own = n.select(F.concat(F.lit("R"), text("n_regionkey")).alias("gvl"), F.concat(F.lit("v"), text("n_nationkey")).alias("name"), F.lit("BOOL").alias("type"), F.col("n_name").alias("init"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("%IX"), text("n_nationkey"), F.lit(".0"))).alias("address"))
    sim = n.where("n_regionkey < 3").select(F.concat(F.lit("R"), text("n_regionkey"), F.lit("_Sim")).alias("gvl"), F.when(F.col("n_nationkey") == 3, "bSimMode").otherwise(F.concat(F.lit("v"), (F.col("n_nationkey") + F.when(F.col("n_nationkey") % 5 == 0, 100).otherwise(0)).cast("string"))).alias("name"), F.lit("BOOL").alias("type"), F.lit(None).cast("string").alias("init"), F.lit("%QX9.9").alias("address"))
    return own.unionByName(sim)


def _gvl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).groupBy("gvl").agg(F.collect_list(F.struct("name", "type", "init", "address")).alias("globals")).withColumnRenamed("gvl", "name")


_GVL = "g AS (SELECT 'R' || n_regionkey AS gvl, 'v' || n_nationkey AS n, n_name AS init, CASE WHEN n_nationkey % 2 = 0 THEN '%IX' || n_nationkey || '.0' END AS a, n_nationkey AS k FROM nation)"
_SIM = "s AS (SELECT 'R' || n_regionkey || '_Sim' AS gvl, 'R' || n_regionkey AS src, CASE WHEN n_nationkey = 3 THEN 'bSimMode' ELSE 'v' || (n_nationkey + CASE WHEN n_nationkey % 5 = 0 THEN 100 ELSE 0 END) END AS n FROM nation WHERE n_regionkey < 3)"


@query(f"""WITH {_GVL} SELECT 'Var_' || gvl || '_' || n AS s, 'dp:hasVariableName' AS p, gvl || '.' || n AS o FROM g UNION ALL SELECT 'Var_' || gvl || '_' || n, 'dp:hasVariableName', n FROM g
    UNION ALL SELECT 'Var_' || gvl || '_' || n, 'dp:hasHardwareAddress', a FROM g WHERE a IS NOT NULL UNION ALL SELECT 'Var_' || gvl || '_' || n, 'dp:hasDefault', init FROM g""")
def global_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.globals_(_gvl(spark, sf_dir).where("not name like '%Sim'")).select("s", "p", "o")


@query(f"""WITH {_GVL}, {_SIM}, j AS (SELECT s.gvl, s.n, s.src, g.n AS sn, a FROM s LEFT JOIN g ON g.gvl = s.src AND g.n = s.n)
    SELECT gvl || '.' || n AS name, CASE WHEN n = 'bSimMode' THEN 'skipped' WHEN sn IS NULL THEN 'missing source' WHEN a IS NULL THEN 'source without data' ELSE 'copied' END AS status FROM j""")
def simulation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.simulation_mirror(etl.globals_(_gvl(spark, sf_dir)), _lists(spark, sf_dir).select("gvl", "name"))[1]


@query(f"""WITH {_GVL}, {_SIM}, j AS (SELECT s.gvl, s.n, g.n AS sn, a FROM s LEFT JOIN g ON g.gvl = s.src AND g.n = s.n)
    SELECT 'Var_' || gvl || '_' || n AS s, a AS o FROM g WHERE a IS NOT NULL UNION ALL SELECT 'Var_' || gvl || '_' || n, CASE WHEN sn IS NULL OR n = 'bSimMode' THEN '%QX9.9' ELSE a END FROM j WHERE sn IS NULL OR n = 'bSimMode' OR a IS NOT NULL""")
def simulated_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses after the mirror: copied ones replace the target's own, and go where the source has none."""
    return etl.simulation_mirror(etl.globals_(_gvl(spark, sf_dir)), _lists(spark, sf_dir).select("gvl", "name"))[0].where("p = 'dp:hasHardwareAddress'").select("s", "o")


@query("""WITH e AS (SELECT 'Gvl.v' || s_suppkey AS v, 'I ' || (s_suppkey // 8) || '.' || (s_suppkey % 8) AS a, CASE WHEN s_suppkey % 3 > 0 THEN 'Box ' || s_nationkey END AS c, '<x n="' || s_suppkey || '"/>' AS x FROM supplier WHERE s_suppkey % 4 > 0), k AS (SELECT replace('Var_' || v, '.', '__dot__') AS s, replace('IOChannel_' || c, ' ', '__leerz__') AS ch, * FROM e)
    SELECT s, 'rdf:type' AS p, 'Variable' AS o FROM k UNION ALL SELECT s, 'dp:hasVariableName', v FROM k UNION ALL SELECT s, 'dp:hasHardwareAddress', a FROM k UNION ALL SELECT s, 'dp:ioRawXml', x FROM k UNION ALL SELECT s, 'op:isBoundToChannel', ch FROM k WHERE c IS NOT NULL UNION SELECT ch, 'rdf:type', 'IOChannel' FROM k WHERE c IS NOT NULL""")
def io_mapping_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: c.cast("string")
    k = F.col("s_suppkey")
    var = F.when(k % 4 > 0, F.concat(F.lit("Gvl.v"), text(k))).otherwise("")
    entries = load(spark, sf_dir, "supplier").select(var.alias("plc_var"), F.concat(F.lit("I "), text(F.expr("s_suppkey div 8")), F.lit("."), text(k % 8)).alias("address"), F.when(k % 3 > 0, F.concat(F.lit("Box "), text(F.col("s_nationkey")))).alias("io_path"), F.concat(F.lit('<x n="'), text(k), F.lit('"/>')).alias("raw_xml"))
    return etl.io_mapping(entries).select("s", "p", "o")


@query("SELECT 'V' || c_custkey AS s, 'op:isMappedToVariable' AS p, 'V' || s_suppkey AS o FROM customer JOIN supplier ON s_suppkey = c_custkey % 300 AND s_suppkey <> c_custkey")
def hardware_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables whose external name is a hardware variable's, but for themselves."""
    name = lambda c: F.concat(F.lit("x"), c.cast("string"))
    var = lambda c: F.concat(F.lit("V"), c.cast("string"))
    pending = load(spark, sf_dir, "customer").select(var(F.col("c_custkey")).alias("var"), name(F.col("c_custkey") % 300).alias("external"))
    hardware = load(spark, sf_dir, "supplier").select(name(F.col("s_suppkey")).alias("name"), var(F.col("s_suppkey")).alias("var"))
    return etl.mapped_variables(pending, hardware).select("s", "p", "o")


@query("""WITH a AS (SELECT 'O' || (l_orderkey % 40) AS owner, 'v' || (l_partkey % 30) AS name, l_returnflag AS f, l_linenumber AS n FROM lineitem),
    g AS (SELECT owner, name, bool_or(f = 'R' AND n = 1) AS visible, bool_or(f = 'A' AND n IN (2, 3)) AS w, bool_or(f = 'A') AS acc FROM a GROUP BY ALL)
    SELECT owner, name, visible, w OR (visible AND NOT acc) AS writable FROM g WHERE visible OR w""")
def access_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("l_returnflag") == "R", "OPC.UA.DA").when(F.col("l_returnflag") == "A", "OPC.UA.DA.Access").otherwise("note")
    rows = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("O"), (F.col("l_orderkey") % 40).cast("string")).alias("owner"), F.concat(F.lit("v"), (F.col("l_partkey") % 30).cast("string")).alias("name"), named.alias("attribute"), F.col("l_linenumber").cast("string").alias("value"))
    return etl.access_flags(rows)


@query("""SELECT 'Failure_' || o_orderkey AS s, 'rdf:type' AS p, CASE WHEN o_orderstatus = 'F' THEN 'OccurredKnownFailure' ELSE 'OccurredUnknownFailure' END AS o FROM orders UNION ALL SELECT 'Failure_' || o_orderkey, 'op:isInstanceOf', 'FM_' || o_custkey FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'Failure_' || o_orderkey, 'dp:hasSummary', o_orderpriority FROM orders UNION SELECT 'Failure_' || l_orderkey, 'op:executedAction', 'Act_' || l_suppkey FROM lineitem""")
def failure_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spread(load(spark, sf_dir, "lineitem"), 500_000, "l_orderkey")  # so many to a task, whatever the table's size
    acts = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.concat(F.lit("Act_"), F.col("l_suppkey").cast("string"))).alias("actions"))
    events = load(spark, sf_dir, "orders").join(big(acts), "o_orderkey", "left").select(F.col("o_orderkey").cast("string").alias("corr"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("FM_"), F.col("o_custkey").cast("string"))).alias("failure_mode"), F.col("o_orderpriority").alias("summary"), "actions")
    return etl.failures(events).select("s", "p", "o")


@query("""WITH f AS (SELECT 'F' || n_nationkey AS f, n_name, n_nationkey AS k FROM nation) SELECT f AS s, 'rdf:type' AS p, 'ProcessFunction' AS o FROM f UNION ALL SELECT f, 'rdfs:label', n_name FROM f
    UNION SELECT 'F' || s_nationkey, 'dp:hasRuntimeSkillName', 'skill' || (s_suppkey % 7) FROM supplier UNION SELECT 'E' || s_suppkey, 'op:hasFunction', 'F' || s_nationkey FROM supplier WHERE s_acctbal > 0
    UNION ALL SELECT 'F99', 'dp:hasRuntimeSkillName', 'old' """)
def coupled_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with new runtime names and links; names of other functions stay, links to unknown functions go."""
    text, s = lambda p, c: F.concat(F.lit(p), c.cast("string")), load(spark, sf_dir, "supplier")
    functions = load(spark, sf_dir, "nation").select(text("F", F.col("n_nationkey")).alias("function"), F.col("n_name").alias("label"))
    old = functions.select(F.col("function").alias("s"), F.lit("dp:hasRuntimeSkillName").alias("p"), F.lit("old").alias("o"), F.lit("literal").alias("o_kind")).unionByName(spark.createDataFrame([("F99", "dp:hasRuntimeSkillName", "old", "literal")], "s string, p string, o string, o_kind string"))
    runtime = s.select(text("F", F.col("s_nationkey")).alias("function"), text("skill", F.col("s_suppkey") % 7).alias("name"))
    elements = s.where("s_acctbal > 0").select(text("F", F.col("s_nationkey")).alias("function"), text("E", F.col("s_suppkey")).alias("element")).unionByName(spark.createDataFrame([("F77", "E0")], "function string, element string"))
    return etl.couple_functions(old, functions, runtime, elements).select("s", "p", "o")


@query("""WITH h AS (SELECT 'fn' || p_partkey AS id, p_brand AS src, CAST(p_size / 100.0 AS DOUBLE) AS c, p_name AS d, CASE WHEN p_size % 2 = 0 THEN p_type END AS parent, p_partkey % 3 AS n, p_partkey AS k, p_size % 4 = 0 AS old FROM part), t AS (SELECT 'Hyp_' || id AS s, * FROM h)
    SELECT s, 'rdf:type' AS p, 'SkillImplementationHypothesis' AS o FROM t UNION ALL SELECT s, 'rdfs:label', 'Hyp: ' || id FROM t UNION ALL SELECT s, 'dp:hasSuggestedFunctionID', id FROM t UNION ALL SELECT s, 'dp:hasHypothesisSource', src FROM t
    UNION ALL SELECT s, 'dp:hasHypothesisDescription', d FROM t UNION ALL SELECT s, 'dp:hasSuggestedParentFunctionID', coalesce(parent, CASE WHEN old THEN 'before' END) FROM t WHERE parent IS NOT NULL OR old UNION ALL SELECT s, 'op:hasHypothesisAboutPOU', 'POU_' || x FROM t, range(3) r(x) WHERE x < n""")
def hypotheses_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypotheses replace what an earlier one of the same function said, but for a parent that the new one doesn't give."""
    rows = load(spark, sf_dir, "part")
    empty = F.array().cast("array<string>")
    fn = F.concat(F.lit("fn"), F.col("p_partkey").cast("string"))
    given = rows.select(fn.alias("function_id"), F.col("p_brand").alias("source"), F.lit(None).cast("string").alias("confidence"), F.col("p_name").alias("description"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("parent"), empty.alias("names"), empty.alias("evidence"), F.expr("transform(filter(array(0, 1, 2), x -> x < p_partkey % 3), x -> concat('POU_', x))").alias("pous"), empty.alias("skills"))
    before = rows.where("p_size % 4 = 0").select(F.concat(F.lit("Hyp_"), fn).alias("s"), F.explode(F.array(F.struct(F.lit("dp:hasSuggestedParentFunctionID").alias("p"), F.lit("before").alias("o")), F.struct(F.lit("dp:hasHypothesisSource").alias("p"), F.lit("gone").alias("o")))).alias("x")).select("s", "x.p", "x.o", F.lit("literal").alias("o_kind"))
    return etl.hypothesis_triples(before, given)[0].select("s", "p", "o")


@query(f"""WITH {_U}, i AS (SELECT DISTINCT callee, name FROM u WHERE kind = 'program')
    SELECT name AS fb_type, coalesce((SELECT string_agg('var' || i.name || '>' || i.name, ',' ORDER BY i.name) FROM i WHERE i.callee = u.name), '') AS instances FROM u WHERE z % 5 = 3""")
def skill_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units whose code names 'Skill3', with the variables of their instances in programs and who uses those."""
    rows = _units(spark, sf_dir)
    text = lambda p, c: F.concat(F.lit(p), F.col(c))
    used = rows.where("kind = 'program'").select("name", F.explode("ports").alias("x")).where("x.name = 'inst'").select("name", F.col("x.type").alias("type"))

    def t(s: Column, p: str, o: Column) -> DataFrame:
        return used.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"))

    triples = etl.programs(rows).unionByName(t(text("I", "name"), "op:isInstanceOfFBType", text("POU_", "type"))).unionByName(t(text("V", "name"), "op:representsFBInstance", text("I", "name"))).unionByName(t(text("V", "name"), "dp:hasVariableName", text("var", "name"))).unionByName(t(text("POU_", "name"), "op:usesVariable", text("V", "name")))
    found = etl.skill_callers(triples, "Skill3")
    return found.select("fb_type", F.array_join(F.transform("instances", lambda i: F.concat(i["variable"], F.lit(">"), i["caller"])), ",").alias("instances"))


@query("""WITH RECURSIVE e AS (SELECT l_orderkey AS unit, 'v' || (l_partkey % 9) AS a, 'v' || (l_suppkey % 9) AS b FROM lineitem), r AS (SELECT DISTINCT unit, 'v1' AS symbol FROM e UNION SELECT e.unit, a FROM r JOIN e ON e.unit = r.unit AND b = symbol)
    SELECT CAST(unit AS VARCHAR) AS unit, symbol FROM r""")
def symbol_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbols that depend on v1 within their unit."""
    v = lambda c: F.concat(F.lit("V"), (F.col(c) % 9).cast("string"))
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), v("l_partkey").alias("target"), F.concat(v("l_suppkey"), F.lit(" + 1")).alias("value"), F.lit("v1").alias("start"))
    return dg.dependent_symbols(rows, "unit", "start")
