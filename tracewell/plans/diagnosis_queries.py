"""Queries of the diagnosis operators and graph-building steps, over rows made from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnosis, etl
from ..tables import load, spread
from .registry import query


def _pick(c: str, *texts: str) -> Column:
    """One of the texts by the remainder of a column."""
    out = F.when(F.col(c) % len(texts) == 0, texts[0])
    for i, t in enumerate(texts[1:], 1):
        out = out.when(F.col(c) % len(texts) == i, t)
    return out


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of rows per order, one row per line."""
    token = F.concat(_pick("l_partkey", "GVL_a.", "start", "Timer.Q", "jobRunning", "x."), F.when(F.col("l_partkey") % 5 == 0, F.col("l_linenumber").cast("string")).otherwise(""))
    assignment = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("p"), (F.col("l_suppkey") % 4).cast("string"), F.lit(" <= q [line "), F.col("l_linenumber").cast("string"), F.lit("]"))).otherwise("v := w")
    source, kind = _pick("l_suppkey", "global", "wiring", "default", "job_method"), _pick("l_linenumber", "terminal", "internal_variable", "global_variable")
    reason = F.when(F.col("l_returnflag") == "R", "%IX1.0").otherwise("")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("row_no"), token.alias("token"), F.concat(F.lit("P"), F.col("l_linestatus")).alias("pou"), F.lit("TRUE").alias("value"), assignment.alias("assignment"), source.alias("source"), reason.alias("reason"), kind.alias("kind"), F.lit("t0").alias("phase"))


CHAIN = """WITH c AS (SELECT l_orderkey, l_linenumber AS row_no, 'P' || l_linestatus AS pou,
    CASE l_partkey % 5 WHEN 0 THEN 'GVL_a.' || l_linenumber WHEN 1 THEN 'start' WHEN 2 THEN 'Timer.Q' WHEN 3 THEN 'jobRunning' ELSE 'x.' END AS token,
    CASE WHEN l_partkey % 3 = 0 THEN 'p' || (l_suppkey % 4) || ' <= q [line ' || l_linenumber || ']' ELSE 'v := w' END AS assignment,
    CASE l_suppkey % 4 WHEN 0 THEN 'global' WHEN 1 THEN 'wiring' WHEN 2 THEN 'default' ELSE 'job_method' END AS source,
    CASE l_linenumber % 3 WHEN 0 THEN 'terminal' WHEN 1 THEN 'internal_variable' ELSE 'global_variable' END AS kind, l_returnflag = 'R' AS hw FROM lineitem)"""
ANCHOR = """CAST(least(10, row_no) + CASE WHEN hw THEN 180 ELSE 0 END + CASE WHEN hw AND source = 'global' THEN 50 ELSE 0 END + CASE WHEN source = 'wiring' THEN 70 ELSE 0 END
    + CASE WHEN kind IN ('terminal', 'global_variable') THEN 25 ELSE 0 END + CASE WHEN source = 'default' THEN 30 ELSE 0 END + CASE WHEN token LIKE 'GVL%' THEN 8 ELSE 0 END
    - CASE WHEN source = 'job_method' THEN 220 ELSE 0 END - CASE WHEN token = 'start' THEN 80 WHEN token = 'jobRunning' THEN 40 ELSE 0 END AS INTEGER)"""


@query(CHAIN + f"""SELECT l_orderkey, row_no, token, score FROM (SELECT *, {ANCHOR} AS score FROM c)
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, row_no, token) = 1""")
def root_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most likely root of each order's chain."""
    return diagnosis.root_anchor(_chain(spark, sf_dir), "l_orderkey")


@query(CHAIN + """, b AS (SELECT l_orderkey, pou, trim(split_part(assignment, '[', 1)) AS assignment, min(row_no) AS row_no FROM c WHERE assignment LIKE '%<=%' GROUP BY 1, 2, 3)
    SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY row_no, pou, assignment) AS INTEGER) AS place, pou, assignment FROM b
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY row_no, pou, assignment) <= 3""")
def assignment_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three port mappings of each chain."""
    return diagnosis.bridges(_chain(spark, sf_dir), "l_orderkey", 3)


@query(CHAIN + f""", a AS (SELECT l_orderkey, token FROM (SELECT *, {ANCHOR} AS score FROM c) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, row_no, token) = 1),
    p AS (SELECT l_orderkey, 0 AS pos, token FROM a UNION ALL SELECT l_orderkey, CASE token WHEN 'Timer.Q' THEN 1 ELSE 2 END, token FROM c WHERE token IN ('Timer.Q', 'start') UNION ALL SELECT l_orderkey, 3, 'Trigger' FROM c),
    o AS (SELECT l_orderkey, token, min(pos) AS pos FROM p GROUP BY 1, 2)
    SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY pos, token) AS INTEGER) AS place, token FROM o""")
def causal_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's root, its known tokens in causal order, and the trigger."""
    return diagnosis.causal_chain(_chain(spark, sf_dir), "l_orderkey", ["timer.q", "start"], "Trigger")


@query("""SELECT o_custkey, max_by(pou, k) AS pou, CAST(max(score) AS INTEGER) AS score FROM (SELECT o_custkey, 'U' || o_orderkey AS pou,
    CASE WHEN o_orderkey = 7 THEN 4 ELSE 0 END + CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS score,
    CAST(CASE WHEN o_orderkey = 7 THEN 4 ELSE 0 END + CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS VARCHAR) || '/U' || o_orderkey AS k FROM orders) GROUP BY 1""")
def skill_setter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit that sets a customer's skill: preferred, toggling, clocked or of the process."""
    code = _pick("o_orderkey", "a.b := NOT a.b;", "edge (CLK := x);", "Proc1();", "a := NOT b;")
    units = load(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("U"), F.col("o_orderkey").cast("string")).alias("pou"), code.alias("code"))
    return diagnosis.skill_setter(units, "o_custkey", ["U7"], "Proc1")


@query("""SELECT l_orderkey, arg_min(pou, (-score, l_linenumber, pou)) AS pou, CAST(max(score) AS INTEGER) AS score FROM (SELECT l_orderkey, l_linenumber,
    CASE l_suppkey % 4 WHEN 0 THEN 'Area_1' WHEN 1 THEN 'area_2' WHEN 2 THEN 'Unit_x' ELSE 'myunit' END AS pou,
    CASE WHEN l_returnflag = 'A' THEN 50 ELSE 0 END + CASE l_suppkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 60 WHEN 2 THEN 50 ELSE 20 END AS score FROM lineitem) GROUP BY 1""")
def trigger_setter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit that sets an order's trigger, by its snippets and its name's scope."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("idx"), _pick("l_suppkey", "Area_1", "area_2", "Unit_x", "myunit").alias("pou"), (F.col("l_returnflag") == "A").cast("int").alias("n_true"))
    return diagnosis.trigger_setter(rows, "l_orderkey", ["Area_1"], ["unit"])


@query("""SELECT o_orderkey, unnest(CASE o_orderkey % 3 WHEN 0 THEN ['t-1', 't-1', 't-2'] WHEN 1 THEN ['t-1', 't-1'] ELSE ['t-1', 't-1'] END) AS phase,
    unnest(CASE o_orderkey % 3 WHEN 0 THEN ['go', 'other', 'go'] WHEN 1 THEN ['edge.Q', 'sensor'] ELSE ['a', 'b.Q'] END) AS symbol,
    unnest(CASE o_orderkey % 3 WHEN 0 THEN [true, false, false] WHEN 1 THEN [true, true] ELSE [true, false] END) AS value FROM orders""")
def skill_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must have held, and when, for each order's code to leave its skill: toggles, edges and later assignments."""
    code = _pick(
        "o_orderkey",
        "go := NOT go;\nIF go THEN\n x := 'S';\nEND_IF\nIF go AND other THEN\n x := 'T';\nEND_IF",
        "edge(CLK := sensor);\nIF edge.Q THEN\n x := 'S';\nEND_IF",
        "IF a THEN\n x := 'S';\nELSIF c THEN\n x := 'T';\nEND_IF\nIF long AND b.Q THEN\n x := 'T';\nEND_IF",
    )
    units = spread(load(spark, sf_dir, "orders"), 200_000).select("o_orderkey", code.alias("code"), F.lit("S").alias("skill"))
    return diagnosis.skill_requirements(units, "o_orderkey", "skill", "x").drop("reason")


@query("""WITH r AS (SELECT l_orderkey AS path, 'v' || (l_partkey % 3) AS token, CASE WHEN l_tax > 0.04 THEN 'TRUE' ELSE 'FALSE' END AS value, CASE l_suppkey % 4 WHEN 0 THEN 'internal_variable' WHEN 1 THEN 'terminal' WHEN 2 THEN 'loop' ELSE 'local_port' END AS kind,
    l_linenumber AS depth, 100 - 2 * l_linenumber + CASE l_suppkey % 4 WHEN 0 THEN 20 WHEN 1 THEN -8 ELSE 10 END + CASE WHEN l_returnflag = 'A' THEN 4 ELSE 0 END AS score FROM lineitem),
    k AS (SELECT *, CASE token WHEN 'v1' THEN 't-1' ELSE 't0' END AS phase FROM r WHERE kind <> 'loop' AND NOT (token = 'v0' AND value = 'FALSE') AND NOT (token = 'v1' AND value = 'TRUE')),
    b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY path, token ORDER BY score DESC, depth, value) = 1)
    SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY phase = 't-1', depth, score DESC, token) AS INTEGER) AS place, token, value, kind, phase, depth, CAST(score AS INTEGER) AS score FROM b
    QUALIFY row_number() OVER (PARTITION BY path ORDER BY phase = 't-1', depth, score DESC, token) <= 2""")
def path_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two rows that explain each order's path best, under constraints at t0 and t-1."""
    rows = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("path"), F.concat(F.lit("v"), (F.col("l_partkey") % 3).cast("string")).alias("token"), F.when(F.col("l_tax") > 0.04, "TRUE").otherwise("FALSE").alias("value"),
        _pick("l_suppkey", "internal_variable", "terminal", "loop", "local_port").alias("kind"), F.lit("").alias("reason"), F.lit("token").alias("source"),
        F.when(F.col("l_returnflag") == "A", "v := w").otherwise("").alias("assignment"), F.lit("").alias("fb_type"), F.col("l_linenumber").alias("depth"),
    )
    each = F.explode(F.array(F.struct(F.lit("t0").alias("phase"), F.lit("v0").alias("token"), F.lit("TRUE").alias("value")), F.struct(F.lit("t-1").alias("phase"), F.lit("v1").alias("token"), F.lit("FALSE").alias("value"))))
    limits = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), each.alias("c")).select("path", "c.*")
    return diagnosis.compact_paths(rows, limits, 2)


@query("""SELECT 'Main' || l_orderkey AS program, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'i' || l_suppkey || '.p' || l_linestatus) AS INTEGER) AS idx, 'G.v' || l_linenumber AS variable, 'i' || l_suppkey AS instance, 'p' || l_linestatus AS port FROM lineitem WHERE l_returnflag <> 'N'""")
def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments of instance ports to variables, from a program's text per order."""
    text = lambda *cs: F.concat(*[F.lit(c) if i % 2 == 0 else F.col(c).cast("string") for i, c in enumerate(cs)])
    line = F.when(F.col("l_returnflag") == "N", text("k := ", "l_linenumber", "; // G.x := i.p;")).otherwise(text("G.v", "l_linenumber", " := i", "l_suppkey", ".p", "l_linestatus", ";"))
    code = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("c")))), lambda x: x["c"]), "\n")
    rows = load(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("Main"), F.col("l_orderkey").cast("string")).alias("name")).agg(code.alias("code"))
    return etl.flow_edges(rows.withColumn("kind", F.lit("program")))


@query("""SELECT o_custkey AS unit, o_orderkey AS output, bool_or(l_returnflag = 'R' OR l_partkey BETWEEN 1 AND 20 OR l_suppkey BETWEEN 1 AND 20) AS hardware FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def hardware_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs whose trace meets a bound variable, by its whole name or its last part."""
    steps = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    rows = steps.select(F.col("o_custkey").alias("unit"), F.col("l_orderkey").alias("output"), (F.col("l_returnflag") == "R").alias("hardware"), F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("variable"), F.concat(F.lit("G.v"), F.col("l_suppkey").cast("string")).alias("address"))
    return etl.hardware_marks(rows, spark.range(1, 21).select(F.concat(F.lit("G.v"), F.col("id").cast("string")).alias("name")))


@query("""SELECT lower('U' || s_suppkey) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'VAR a' || s_suppkey ELSE 'old' END AS header FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0""")
def declaration_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of the project, else of the export."""
    s = load(spark, sf_dir, "supplier")
    named = lambda c: s.select("s_suppkey", F.concat(F.lit("U"), F.col("s_suppkey").cast("string")).alias("name"), c.alias("header"))
    scanned = named(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("VAR a"), F.col("s_suppkey").cast("string"))).otherwise(" "))
    return etl.declaration_headers(scanned, named(F.lit("old")).where("s_suppkey % 3 = 0"))


@query("""SELECT 'Task' || CASE WHEN p_size % 3 = 0 THEN 'A' ELSE 'B' END || p_partkey AS plc, CASE WHEN p_size % 3 = 0 THEN 'D' || p_partkey ELSE 'C' || p_partkey END AS io, CASE WHEN p_size % 2 = 0 THEN 'TIID^b' ELSE 'a' END AS owner,
    CASE WHEN p_size % 3 = 0 THEN 'I ' ELSE 'Q ' END || (p_size // 8) || '.' || (p_size % 8) AS address FROM part WHERE p_size % 3 < 2""")
def io_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between program and device: which side is which, and the address that follows."""
    named = lambda prefix: F.concat(F.lit(prefix), F.col("p_partkey").cast("string"))
    third = F.col("p_size") % 3
    links = load(spark, sf_dir, "part").select("p_size", F.lit("a").alias("owner_a"), F.when(F.col("p_size") % 2 == 0, "TIID^b").otherwise("b").alias("owner_b"), F.when(third == 0, named("PlcTask^A")).otherwise(named("C")).alias("var_a"), F.when(third == 1, named("PlcTask^B")).otherwise(named("D")).alias("var_b"))
    sides = etl.link_sides(links).join(load(spark, sf_dir, "part").select("p_size", F.col("p_partkey").cast("string").alias("k")), F.col("k") == F.regexp_extract("plc", r"(\d+)$", 1))
    flagged = sides.withColumn("flag", F.when(F.col("p_size") % 3 == 0, 0).otherwise(1))
    return flagged.select(F.regexp_replace("plc", r"PlcTask\^", "Task").alias("plc"), "io", "owner", etl.io_address("plc", "io", "flag", "p_size").alias("address"))


@query("""SELECT 'S' || n_regionkey AS function, min(n_name) AS label, 'implements' AS source, CAST(max(n_nationkey) / 100.0 AS DOUBLE) AS confidence, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS runtime_names FROM nation GROUP BY n_regionkey""")
def skill_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions from implemented skills, merged; calls count only where no skill is implemented."""
    n = load(spark, sf_dir, "nation")
    implemented = n.select(F.col("n_name").alias("pou"), F.concat(F.lit("S"), F.col("n_regionkey").cast("string")).alias("skill"), F.col("n_name").alias("label"), (F.col("n_nationkey") / 100.0).cast("double").alias("confidence"))
    called = n.select(F.col("n_name").alias("pou"), F.col("n_name").alias("runtime"), F.lit(None).cast("string").alias("mapped"), F.col("n_name").alias("label"))
    return diagnosis.skill_suggestions(implemented, called).withColumn("runtime_names", F.array_join("runtime_names", ",")).drop("pous")
