"""Queries over program text and logic, built from the tables' rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import logic
from ..operators import trace, trace_tables
from ..tables import big, load, scratch, spread
from .registry import query


@query("""WITH x AS (SELECT p_partkey, p_size % 5 + 1 AS n, p_partkey % 4 + 1 AS m, p_size % 3 = 0 AS contra FROM part)
    SELECT p_partkey, CAST(CASE WHEN contra THEN greatest(1, n * m - 1) ELSE n * m END AS INTEGER) AS n_paths, CAST(CASE WHEN contra AND n * m = 1 THEN 1 WHEN contra THEN 2 * (n * m - 1) ELSE 2 * n * m END AS INTEGER) AS n_literals FROM x""")
def dnf_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth paths of an expression per part: (a1 OR ... an) AND NOT (b1 AND ... bm), where b1 may be a1. One that can't
    be true counts as one path on which all tokens are."""
    first = F.expr("array_join(transform(sequence(1, cast(p_size % 5 + 1 as int)), i -> concat('a', i)), ' OR ')")
    second = F.expr("array_join(transform(sequence(1, cast(p_partkey % 4 + 1 as int)), i -> if(i = 1 and p_size % 3 = 0, 'A1', concat('b', i))), ' AND ')")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = lru_cache(256)(logic.truth_paths)
        for b in batches:
            paths = [found(t)[0] for t in b["text"]]
            yield pd.DataFrame({"p_partkey": b["p_partkey"], "n_paths": [len(p) for p in paths], "n_literals": [sum(map(len, p)) for p in paths]}).astype({"n_paths": "int32", "n_literals": "int32"})

    text = F.concat(F.lit("("), first, F.lit(") AND NOT ("), second, F.lit(")"))
    return spread(load(spark, sf_dir, "part"), 100_000).select("p_partkey", text.alias("text")).mapInPandas(run, "p_partkey long, n_paths int, n_literals int")


@query("""WITH c AS (SELECT l_orderkey AS k, l_linenumber AS i, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS line FROM lineitem),
    n AS (SELECT k, i, max(line) AS line, arg_max(f, line) AS f, row_number() OVER (PARTITION BY k ORDER BY i) AS r FROM c GROUP BY k, i), a AS (SELECT * FROM n WHERE r = i),
    z AS (SELECT l_orderkey AS k, coalesce((SELECT max(i) FROM a WHERE a.k = l_orderkey), 0) + 1 AS i FROM lineitem GROUP BY 1), v AS (SELECT k, i FROM a UNION ALL SELECT k, i FROM z),
    rows AS (SELECT k, 2 * (i - 1) AS depth, 'v' || i AS token, 'internal_variable' AS kind, 'variable' AS reason, 'token' AS source, NULL AS assignment FROM v UNION ALL SELECT k, 2 * i - 1, 'v' || i, 'internal_assignment', 'line ' || line, 'assignment', 'v' || i || ' := v' || (i + 1) FROM a
        UNION ALL SELECT k, 2 * i, 'flag' || f, 'global_variable', CASE WHEN f = 'R' THEN '%I1.0' ELSE 'no hardware' END, 'global', NULL FROM a UNION ALL SELECT k, 2 * i - 1, 'v' || i, 'terminal', 'no assignment', 'metadata', NULL FROM z)
    SELECT k AS l_orderkey, '1' AS path_id, CAST(depth AS INTEGER) AS depth, token, true AS value, 'Main' AS pou, kind, reason, source, assignment FROM rows""")
def requirement_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program per order: each line assigns its variable from the next one's, guarded by its flag; the first is traced."""
    lines = load(spark, sf_dir, "lineitem")
    code = F.concat(F.lit("IF flag"), F.col("l_returnflag"), F.lit(" THEN v"), F.col("l_linenumber").cast("string"), F.lit(" := v"), (F.col("l_linenumber") + 1).cast("string"), F.lit("; END_IF"))
    programs = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", code.alias("c")))), lambda x: x["c"]), "\n").alias("code"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def traced(text: str) -> list[dict]:
            program = trace.Program({"Main": trace.Pou("Main", text, variables={f"v{i}": None for i in range(1, text.count("\n") + 3)})}, globals={"flagR": "%I1.0", "flagA": None, "flagN": None})
            return trace.requirements(program, "Main", "v1", True)

        for b in batches:
            yield pd.DataFrame([(text, *(r[c] for c in trace.COLUMNS)) for text in b["code"] for r in traced(text)], columns=["code", *trace.COLUMNS])

    # orders with the same lines have the same program, which is traced once
    found = spread(scratch(programs.select("code").distinct(), "codes"), 5000).mapInPandas(run, "code string, " + trace.SCHEMA)
    return programs.join(big(found), "code").drop("code")


@query("""WITH p AS (SELECT p_partkey AS k, p_size % 4 + 1 AS n FROM part), u AS (SELECT k, n, unnest(range(n)) AS i FROM p),
    r AS (SELECT k, unnest([{'d': 4 * i, 't': 'x', 'v': true, 'u': 'U' || i, 'kind': 'internal_variable', 'why': 'variable', 'a': NULL}, {'d': 4 * i + 1, 't': 'x', 'v': true, 'u': 'U' || i, 'kind': 'internal_assignment', 'why': 'line 2', 'a': 'x := sub.out'},
        {'d': 4 * i + 2, 't': 'g' || i, 'v': true, 'u': 'U' || i, 'kind': 'unknown', 'why': 'not declared', 'a': NULL}, {'d': 4 * i + 2, 't': 'sub.out', 'v': true, 'u': 'U' || i, 'kind': 'instance_port', 'why': 'output of U' || (i + 1), 'a': NULL},
        {'d': 4 * i + 3, 't': 'out', 'v': true, 'u': 'U' || (i + 1), 'kind': 'output_assignment', 'why': CASE WHEN i + 1 < n THEN 'line 3' ELSE 'line 2' END, 'a': 'out := x'}]) AS s FROM u
        UNION ALL SELECT k, unnest([{'d': 4 * n, 't': 'x', 'v': true, 'u': 'U' || n, 'kind': 'internal_variable', 'why': 'variable', 'a': NULL}, {'d': 4 * n + 1, 't': 'x', 'v': true, 'u': 'U' || n, 'kind': 'internal_assignment', 'why': 'line 1', 'a': 'x := in1'},
        {'d': 4 * n + 2, 't': 'in1', 'v': true, 'u': 'U' || n, 'kind': 'port_mapping', 'why': 'called by U0', 'a': 'NOT Start' || k}, {'d': 4 * n + 3, 't': 'Start' || k, 'v': false, 'u': 'U0', 'kind': 'global_variable', 'why': CASE WHEN k % 2 = 0 THEN '%IX' || k || '.0' ELSE 'no hardware' END, 'a': NULL}]) FROM p)
    SELECT k AS trace, '1' AS path_id, CAST(s.d AS INTEGER) AS depth, s.t AS token, s.v AS value, s.u AS pou, s.kind AS kind, s.why AS reason, s.a AS assignment FROM r""")
def program_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace through a chain of units in a program of each part's own, level by level over tables: to a global through
    calls, guards and wiring; as many units as the part's size says."""
    part = spread(load(spark, sf_dir, "part")).select(F.col("p_partkey").alias("k"), (F.col("p_size") % 4 + 1).alias("n"))
    name = lambda i: F.concat(F.lit("U"), i.cast("string"))
    u = part.select("k", "n", F.explode(F.sequence(F.lit(0), "n")).alias("i"))
    last, program = F.col("i") == F.col("n"), F.concat(F.lit("P"), F.col("k").cast("string"))
    code = F.when(last, F.lit("x := in1;\nout := x;")).otherwise(F.concat(F.lit("IF g"), F.col("i").cast("string"), F.lit(" THEN // x := TRUE;\nx := sub.out; END_IF\nout := x; sub();")))
    none, text = F.lit(None).cast("string"), "map<string,string>"
    one = lambda k, v: F.create_map(F.lit(k), v).cast(text)
    empty = F.create_map().cast(text)
    units = u.select(program.alias("program"), name(F.col("i")).alias("name"), code.alias("code"), F.lit("ST").alias("language"), F.when(last, one("in1", none)).otherwise(empty).alias("inputs"), one("out", none).alias("outputs"), one("x", none).alias("variables"), F.when(last, empty).otherwise(one("sub", name(F.col("i") + 1))).alias("instances"), F.lit(False).alias("is_job_method"), empty.alias("methods"), none.alias("owner"))
    start = F.concat(F.lit("Start"), F.col("k").cast("string"))
    wiring = part.select(program.alias("program"), name(F.col("n")).alias("pou"), F.lit("in1").alias("port"), F.lit(0).alias("place"), F.lit("U0").alias("caller"), F.concat(F.lit("NOT "), start).alias("expression"))
    names = part.select(program.alias("program"), start.alias("name"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("%IX"), F.col("k").cast("string"), F.lit(".0"))).alias("address"))
    starts = part.select(F.col("k").alias("trace"), program.alias("program"), F.lit("U0").alias("pou"), F.lit("x").alias("token"), F.lit(True).alias("value"))
    return trace_tables.requirement_paths(units, wiring, names, starts).drop("source")
