"""Queries over scalar functions and text parsers, on texts that rows of the tables make."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import logic
from ..functions import text as tx
from ..operators import trace
from ..sources import plcopen, program, turtle
from ..tables import load, spread
from .guard import guarded, with_prefixes
from .registry import query


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _each(df: DataFrame, key: str, text: Column, f: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """(key, and the columns of schema) of f's rows for each text. A text that a task met a short while ago isn't read again."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = lru_cache(256)(f)
        for b in batches:
            yield pd.DataFrame([(k, *r) for k, t in zip(b["k"], b["t"], strict=True) for r in found(t)], columns=["k", *names])

    return df.select(F.col(key).alias("k"), text.alias("t")).mapInPandas(run, f"k long, {schema}").withColumnRenamed("k", key)


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "part"))


@query(r"""SELECT p_partkey, trim(regexp_replace('  ' || p_name || '   ' || chr(9) || p_type || chr(10), '\s+', ' ', 'g')) AS clean,
    CAST(CASE p_size % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN p_size WHEN 3 THEN p_size WHEN 4 THEN -7 ELSE -7 END AS BIGINT) AS number FROM part""")
def clean_text_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("p_size")
    raw = F.when(z % 6 == 0, " True ").when(z % 6 == 1, "false").when(z % 6 == 2, F.concat(_s(z), F.lit(".7"))).when(z % 6 == 3, F.concat(F.lit(" "), _s(z))).when(z % 6 == 4, "abc")
    text = F.concat(F.lit("  "), F.col("p_name"), F.lit("   \t"), F.col("p_type"), F.lit("\n"))
    return _part(spark, sf_dir).select("p_partkey", tx.normalise_space(text).alias("clean"), tx.safe_int(raw, -7).alias("number"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'St' || p_size WHEN p_size % 3 = 1 THEN 'Gvl' || p_size ELSE '' END AS scope, CASE WHEN p_size % 2 = 0 THEN 'Area.n' || p_partkey ELSE 'OPCUA.n' || p_partkey END AS node,
    CASE WHEN p_size % 4 = 0 THEN 'A' || p_size WHEN p_size % 4 = 1 THEN 'D' || p_size ELSE '' END AS state FROM part""")
def names_taken_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, k = F.col("p_size"), _s("p_partkey")
    name = F.when(z % 3 == 0, F.concat(F.lit("St"), _s(z), F.lit("_x.y"))).when(z % 3 == 1, F.concat(F.lit("Gvl"), _s(z), F.lit(".x_y"))).otherwise(F.concat(F.lit("plain"), _s(z)))
    node = F.when(z % 2 == 0, F.concat(F.lit("ns=4;s=Area.n"), k)).otherwise(F.concat(F.lit("OPCUA.n"), k))
    state = F.when(z % 4 == 0, F.concat(F.lit("Mod.A"), _s(z))).when(z % 4 == 1, F.concat(F.lit("D"), _s(z))).when(z % 4 == 2, F.concat(F.lit("xD"), _s(z))).otherwise("Mod.A1.x")
    return _part(spark, sf_dir).select("p_partkey", tx.scope(name).alias("scope"), tx.node_id(node).alias("node"), tx.state_alias(state).alias("state"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 < 3 THEN ['I', 'Q', 'M'][p_size % 4 + 1] END AS direction, CASE WHEN p_size % 4 < 3 THEN p_size END AS byte, CASE WHEN p_size % 4 < 2 THEN CAST(p_partkey % 8 AS INTEGER) END AS bit FROM part""")
def hardware_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, bit = F.col("p_size"), F.concat(F.lit("."), _s(F.col("p_partkey") % 8))
    text = F.when(z % 4 == 0, F.concat(F.lit("%IX"), _s(z), bit)).when(z % 4 == 1, F.concat(F.lit("at Q "), _s(z), bit)).when(z % 4 == 2, F.concat(F.lit("%MW"), _s(z))).otherwise("none")
    return _part(spark, sf_dir).select("p_partkey", tx.hardware_address(text).alias("a")).select("p_partkey", "a.direction", "a.byte", "a.bit")


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'FALSE' WHEN 2 THEN 'TRUE' WHEN 3 THEN NULL WHEN 4 THEN 'FALSE' END AS value FROM part""")
def tri_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("p_size")
    text = F.when(z % 6 == 0, "BOOL#TRUE").when(z % 6 == 1, "0").when(z % 6 == 2, " true ").when(z % 6 == 3, "TRUE or FALSE").when(z % 6 == 4, "is False").otherwise("7")
    return _part(spark, sf_dir).select("p_partkey", tx.bool_text(text).alias("value"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'job' || p_size WHEN p_size % 3 = 1 THEN CAST(p_size AS VARCHAR) ELSE 'q' || p_size END AS job, CAST(p_partkey AS BIGINT) AS n FROM part""")
def repaired_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON in a Markdown fence whose jobId may lack its quotes."""
    z = F.col("p_size")
    value = F.when(z % 3 == 0, F.concat(F.lit("job"), _s(z))).when(z % 3 == 1, _s(z)).otherwise(F.concat(F.lit('"q'), _s(z), F.lit('"')))
    text = F.concat(F.lit('```json\n{"jobId": '), value, F.lit(', "n": '), _s("p_partkey"), F.lit("}\n```"))
    parsed = F.try_parse_json(tx.quote_job_id(tx.strip_fence(text)))
    return _part(spark, sf_dir).select("p_partkey", F.try_variant_get(parsed, "$.jobId", "string").alias("job"), F.try_variant_get(parsed, "$.n", "long").alias("n"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN substring(text, 1, 40) || '...' ELSE text END AS preview FROM documents")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", tx.preview("text", 40).alias("preview"))


@query("SELECT event_id, event_type || '-' || (epoch_us(ts) * 1000) || '-' || event_id AS corr_id FROM events")
def correlation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..tables import events, micros

    kinds = ["click", "purchase", "error", "signup", "view"]
    rows = events(spark, sf_dir).withColumn("nanos", micros() * 1000)
    made = F.coalesce(*[F.when(F.col("type") == k, tx.correlation_id(k, "nanos", "event_id")) for k in kinds])
    return rows.select("event_id", made.alias("corr_id"))


@query("""WITH s AS (SELECT l_orderkey AS k, list(DISTINCT l_suppkey) AS hw, list(DISTINCT l_partkey) AS vars FROM lineitem GROUP BY 1)
    SELECT o_orderkey, CASE WHEN list_contains(hw, o_custkey % 100) OR list_contains(vars, o_custkey % 100) THEN 'checkable' ELSE 'not_checkable' END AS kind FROM orders JOIN s ON k = o_orderkey""")
def checkable_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("hw"), F.collect_set("l_partkey").alias("vars"))
    rows = load(spark, sf_dir, "orders").join(sets, "o_orderkey")
    return rows.select("o_orderkey", tx.checkable(F.col("o_custkey") % 100, "hw", "vars").alias("kind"))


@query("""WITH q AS (SELECT p_partkey AS k, p_size AS z FROM part) SELECT k AS p_partkey, z % 4 = 0 AS chain, z % 4 IN (1, 3) AS cause, CASE WHEN z % 4 = 0 THEN 'lastSkill' || k || ',Gvl.x' || z WHEN z % 4 = 1 THEN 'TriggerD2,rStep' || z ELSE '' END AS symbols,
    CASE WHEN z % 4 = 0 THEN 'lastSkill' || k WHEN z % 4 = 1 THEN 'rStep' || z ELSE '' END AS asked FROM q""")
def planner_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a question asks for, and which symbols it names; the first turn may be empty."""
    z, k = _s("p_size"), _s("p_partkey")
    n = F.col("p_size") % 4
    text = F.when(n == 0, F.concat(F.lit("Woher kommt lastSkill"), k, F.lit(" und wo steht Gvl.x"), z, F.lit("?"))).when(n == 1, F.concat(F.lit("Warum TriggerD2: root cause bei rStep"), z, F.lit(" = TRUE?"))).when(n == 2, "Bitte sag was die Diagnose ist").otherwise(" ")
    return _part(spark, sf_dir).select("p_partkey", tx.wants_chain(text).alias("chain"), tx.wants_cause(text, True).alias("cause"), F.array_join(tx.focus_symbols(text), ",").alias("symbols"), tx.asked_symbol(text).alias("asked"))


@query("SELECT p_partkey, 'f(' || p_brand || ', g(1, 2))' AS first, '''x, y''' AS second, CAST(p_size AS VARCHAR) AS third FROM part")
def split_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("f("), F.col("p_brand"), F.lit(", g(1, 2)), 'x, y' , "), _s("p_size"))
    return _each(_part(spark, sf_dir), "p_partkey", text, lambda t: [tuple(logic.split_args(t))], "first string, second string, third string")


@query("""SELECT p_partkey, unnest(['a', 'b', 't' || p_size, 'w']) AS name, unnest(['BOOL', 'BOOL', 'TIME', 'INT']) AS type, unnest(['TRUE', 'TRUE', NULL, CAST(p_size AS VARCHAR)]) AS init FROM part""")
def declarations_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _s("p_size")
    text = F.concat(F.lit("VAR_INPUT a, b : BOOL := TRUE; // x : INT := 1;\n t"), z, F.lit(" AT %IX0.1 : TIME; END_VAR\nVAR w : INT := "), z, F.lit("; (* v : INT; *) END_VAR"))
    return _each(_part(spark, sf_dir), "p_partkey", text, logic.parse_declaration, "name string, type string, init string")


@query("""SELECT p_partkey, unnest(CASE WHEN p_size % 3 = 0 THEN ['A' || p_partkey, 'B'] ELSE ['Stop'] END) AS token, unnest(CASE WHEN p_size % 3 = 0 THEN [true, p_size % 2 = 0] ELSE [true] END) AS value FROM part""")
def diagram_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A latch's diagram, focused on what sets it or on what resets it; a lone RS without a number is one, too."""
    z, k = F.col("p_size"), _s("p_partkey")
    second = F.when(z % 2 == 0, F.lit("V_1 = AND_3(B, B)")).otherwise(F.lit("V_1 = NOT_1(B)"))
    latch = F.when(z % 5 == 0, "RS").otherwise("RS_4")
    text = F.concat(second, F.lit("\nV_2 = AND_7(A"), k, F.lit(", V_1)\nV_3 = "), latch, F.lit("(V_2, Stop)\nD2 = V_3\n"), F.when(z % 3 == 0, "TRUE").otherwise("FALSE"))

    def leaves(t: str) -> list[tuple]:
        code, _, value = t.rpartition("\n")
        blocks, outputs = logic.fbd_lines(code)
        wanted = value == "TRUE"
        return logic.leaves(logic.fbd_tree("D2", blocks, outputs), wanted)

    return _each(_part(spark, sf_dir), "p_partkey", text, leaves, "token string, value boolean")


@query("""SELECT p_partkey, CAST(CASE WHEN p_size % 3 = 0 THEN 1 WHEN p_size % 3 = 1 THEN 0 ELSE -1 END AS INTEGER) AS branch FROM part""")
def or_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branch that names the last state; without one an A or F state before a D state; none where none stands out. Names and
    states are each part's own."""
    z, k, n = F.col("p_size"), _s("p_partkey"), _s("p_size")
    two = lambda a, last: F.concat(F.lit("V_1 = OR_1(Mod"), k, F.lit(f".{a}"), n, F.lit(", Mod"), k, F.lit(".D"), k, F.lit(")\nD2 = V_1\n"), last)
    text = F.when(z % 3 == 0, two("A", F.concat(F.lit("D"), k))).when(z % 3 == 1, two("F", F.lit(""))).otherwise(two("D", F.lit("")))

    def pick(t: str) -> list[tuple]:
        code, _, last = t.rpartition("\n")
        try:
            return [(logic.pick_or_branch(logic.fbd_tree("D2", *logic.fbd_lines(code)), last or None),)]
        except ValueError:
            return [(-1,)]

    return _each(_part(spark, sf_dir), "p_partkey", text, pick, "branch int")


@query("""WITH x AS (SELECT p_partkey, p_size AS z FROM part) SELECT p_partkey, unnest(['v', 'v', 'w']) AS target, unnest(['TRUE', 'c' || z, 'v']) AS value, CAST(unnest([2, 4, 6]) AS INTEGER) AS line, unnest(['a' || z, 'NOT (a' || z || ') & b', '']) AS conditions FROM x""")
def assignments_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _s("p_size")
    text = F.concat(F.lit("IF a"), z, F.lit(" THEN // x := 1;\n v := TRUE;\nELSIF b THEN\n v := c"), z, F.lit(";\nEND_IF\nw := v;"))
    return _each(_part(spark, sf_dir), "p_partkey", text, lambda t: [(a.target, a.value, a.line, " & ".join(a.conditions)) for a in logic.assignments(t)], "target string, value string, line int, conditions string")


@query("""SELECT p_partkey, 't' || p_size AS instance, CAST(unnest([0, 0, 0, 1]) AS INTEGER) AS idx, unnest(['IN', 'PT', 'Q', 'IN']) AS port, unnest(['f(a, b)', 'T#' || p_size || 's', 'done', 'x']) AS value FROM part""")
def call_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _s("p_size")
    text = F.concat(F.lit("t"), z, F.lit("(IN := f(a, b),\n  PT := T#"), z, F.lit("s, (* IN := z, *) Q => done);\nt"), z, F.lit("(IN := x);"))
    return _each(_part(spark, sf_dir), "p_partkey", text, lambda t: [(i, n, p, v) for i, n, ins, outs in logic.calls(t) for p, v in [*ins.items(), *outs.items()]], "instance string, idx int, port string, value string")


@query("""SELECT p_partkey, CAST(unnest([1, 2]) AS INTEGER) AS n, unnest(['urn:fm' || p_partkey, 'urn:' || p_brand]) AS iri, unnest(['{"rows": [{"v": "}' || p_size || '"}]}', '{"rows": []}']) AS json FROM part""")
def iri_json_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('"urn:fm'), _s("p_partkey"), F.lit('\n{"rows": [{"v": "}'), _s("p_size"), F.lit('"}]}\r\n\nlost line\n urn:'), F.col("p_brand"), F.lit(' \n {"rows": []} "'))
    return program.pairs(_part(spark, sf_dir).withColumn("t", text), "p_partkey", "t")


@query("""SELECT p_partkey, p_size % 4 IN (0, 1) AS met FROM part""")
def outputs_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed outputs: no expectation is met, nearly equal numbers are, another tag or a missing index isn't."""
    entry = lambda i, t, v: F.struct(F.lit(i), F.struct(F.lit(t).alias("t"), v.alias("v")))
    z, none = F.col("p_size"), F.lit(None)
    made = lambda *e: F.map_from_entries(F.array_compact(F.array(*e)))
    actual = made(entry(0, "float", _s(z + 0.5)), entry(1, "int32", _s(z)))
    expected = made(F.when(z % 4 == 1, entry(0, "float", _s(z + F.lit(0.5000000001)))).otherwise(none), F.when(z % 4 == 2, entry(1, "int16", _s(z))).otherwise(none), F.when(z % 4 == 3, entry(2, "int32", _s(z))).otherwise(none))
    rows = _part(spark, sf_dir).select("p_partkey", actual.alias("a"), expected.alias("e"))
    return rows.select("p_partkey", program.outputs_match("a", "e").alias("met"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS corr, 'Area.x' AS id, 'bool' AS t, CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS v FROM orders WHERE o_orderkey % 5 < 4""")
def incident_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of incidents: bare, nested under other keys, as marked text, or missing."""
    k, value = F.col("o_orderkey"), F.when(F.col("o_orderstatus") == "F", "true").otherwise("false")
    snap = F.concat(F.lit('{"rows": [], "vars": [{"id": "ns=4;s=Area.x", "t": "BOOL", "v": '), value, F.lit("}]}"))
    marked = F.concat(F.lit('"==InventorySnapshot=='), F.replace(snap, F.lit('"'), F.lit('\\"')), F.lit('==InventorySnapshot=="'))
    held = F.when(k % 5 == 0, F.concat(F.lit('"plcSnapshot": '), snap)).when(k % 5 == 1, F.concat(F.lit('"snapShot": {"payload": {"snapshot": '), snap, F.lit("}}"))).when(k % 5 == 2, F.concat(F.lit('"snapshot": '), marked)).when(k % 5 == 3, F.concat(F.lit('"plcSnapshot": {"snapshot": '), marked, F.lit("}"))).otherwise('"snapshot": {}')
    raw = load(spark, sf_dir, "orders").select(F.concat(F.lit('{"type": "evD2", "payload": {"correlationId": "'), _s(k), F.lit('", '), held, F.lit("}}")).alias("value"))
    return program.snapshot_vars(program.incidents(raw))


@query("""SELECT l_orderkey AS corr, list_sort(list(DISTINCT 'v' || l_linenumber || '=' || l_partkey)) AS ints FROM lineitem GROUP BY 1""")
def typed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by type tag, by correlation; here whole numbers of lines, in a column of texts."""
    rows = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("corr"), "l_linenumber", "l_partkey").agg(F.lit("int32").alias("t"))
    rows = rows.select("corr", F.concat(F.lit("v"), _s("l_linenumber"), F.lit("="), _s("l_partkey")).alias("id"), "t", _s("l_partkey").alias("v"))
    found = program.typed_snapshot(rows)
    return found.select("corr", F.array_sort(F.map_keys(F.map_filter("int32s", lambda k, v: F.substring_index(k, "=", -1) == v.cast("string")))).alias("ints"))


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = 'http://e.org/x' OR o_orderstatus = 'F' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")
def guarded_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's query, with short names written out, over given views only and at most 200 rows."""
    text = with_prefixes("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = 'e:x' OR o_orderstatus = :status GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5000", {"e": "http://e.org/"})
    return guarded(spark, text, {"orders": load(spark, sf_dir, "orders")}, args={"status": "F"})


@query("""SELECT 'http://e.org/n' || n_nationkey AS s, 'http://e.org/p' AS p, 'line "' || n_name || '"' || chr(10) || chr(92) || 'n é' AS o, 'literal' AS o_kind, CASE WHEN n_nationkey % 3 > 0 THEN CASE WHEN n_nationkey % 3 = 1 THEN 'http://e.org/T' ELSE 'http://www.w3.org/2001/XMLSchema#string' END END AS o_type, CASE WHEN n_nationkey % 3 = 0 THEN 'en' END AS o_lang FROM nation
    UNION ALL SELECT 'http://e.org/n' || n_nationkey, 'http://e.org/r', 'http://e.org/r' || n_regionkey, 'iri', NULL, NULL FROM nation""")
def ntriples_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples written as lines and read back, quotes, line breaks and backslashes included."""
    from ..tables import scratch_path

    n = load(spark, sf_dir, "nation")
    k, who = F.col("n_nationkey"), F.concat(F.lit("http://e.org/n"), _s("n_nationkey"))
    null = F.lit(None).cast("string")
    text = F.concat(F.lit('line "'), F.col("n_name"), F.lit('"\n\\n é'))
    literals = n.select(who.alias("s"), F.lit("http://e.org/p").alias("p"), text.alias("o"), F.lit("literal").alias("o_kind"), F.when(k % 3 == 1, "http://e.org/T").when(k % 3 == 2, turtle.XSD + "string").alias("o_type"), F.when(k % 3 == 0, "en").alias("o_lang"))
    links = n.select(who.alias("s"), F.lit("http://e.org/r").alias("p"), F.concat(F.lit("http://e.org/r"), _s("n_regionkey")).alias("o"), F.lit("iri").alias("o_kind"), null.alias("o_type"), null.alias("o_lang"))
    turtle.ntriples(literals.unionByName(links)).write.text(path := scratch_path(spark, "lines"))
    return turtle.read_ntriples(spark, path)


@query("""WITH x AS (SELECT p_partkey, '<pou name="P' || p_partkey || '"><body>' || repeat('x', 100 + p_size * 100) || '</body></pou>' AS t FROM part)
    SELECT p_partkey, 'pou:P' || p_partkey || CASE WHEN length(t) > 3200 THEN '-part' || n ELSE '' END AS chunk, 'POU' AS kind, 'P' || p_partkey AS name, CAST(length(substring(t, 1 + (n - 1) * 2960, 3200)) AS INTEGER) AS size FROM x, range(1, 4) r(n) WHERE n = 1 OR length(t) > 240 + (n - 1) * 2960""")
def xml_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of an export as chunks, long ones in windows; the project around them is too short a tag to count."""
    unit = F.concat(F.lit('<pou name="P'), _s("p_partkey"), F.lit('"><body>'), F.expr("repeat('x', 100 + p_size * 100)"), F.lit("</body></pou>"))
    rows = _part(spark, sf_dir).select("p_partkey", F.concat(F.lit("<all>"), unit, F.lit("<task/></all>")).alias("t"))
    return plcopen.chunk_exports(rows, "p_partkey", "t").select("p_partkey", "chunk", "kind", "name", F.length("text").alias("size"))


@query("""SELECT p_partkey, unnest(['t' || p_size, 'In' || p_partkey, 'x' || p_partkey]) AS token, unnest([true, true, p_size % 2 = 0]) AS value, unnest(['internal_variable', 'std_fb_dependency', 'global_variable']) AS kind FROM part""")
def condition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition's trace through a variable and a standard block to a global."""
    text = F.concat_ws(",", _s("p_size"), _s("p_partkey"), F.when(F.col("p_size") % 2 == 0, "").otherwise("NOT "))

    def rows(t: str) -> list[tuple]:
        z, k, no = t.split(",")
        unit = trace.Pou("Main", f"t{z} := In{k}.Q;\nIn{k}(IN := {no}x{k}, PT := T#1s);", variables={f"t{z}": None}, instances={f"In{k}": "TON"})
        found = trace.condition_trace(trace.Program({"Main": unit}, {f"x{k}": "%IX0.1"}), "Main", f"t{z}")
        return [(r["token"].partition(".")[0], r["value"], r["kind"]) for r in found if r["kind"] != "internal_assignment"]

    return _each(_part(spark, sf_dir), "p_partkey", text, rows, "token string, value boolean, kind string")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'go' || p_size ELSE 'halt' || p_size END AS port, CASE WHEN p_size % 2 = 0 THEN '%IX' || p_partkey || '.0' ELSE 'no hardware' END AS hardware FROM part""")
def state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a diagram set a state, by the state before: the branch's input port, and the global that is wired to it."""
    last = F.concat_ws(",", _s("p_size"), _s("p_partkey"), F.when(F.col("p_size") % 2 == 0, "A1").otherwise("F1"))

    def rows(t: str) -> list[tuple]:
        z, k, before = t.split(",")
        code = f"V_1 = AND_1(A1, go{z})\nV_2 = AND_2(F1, halt{z})\nV_3 = OR_1(V_1, V_2)\nD2 = V_3"
        machine = trace.Pou("M", code, "FBD", inputs={f"go{z}": None, f"halt{z}": None}, outputs={"D2": None})
        program_ = trace.Program({"M": machine, "Main": trace.Pou("Main")}, {f"Start{k}": f"%IX{k}.0", "Stop": None}, {("M", f"go{z}"): [("Main", f"Start{k}")], ("M", f"halt{z}"): [("Main", "Stop")]})
        found = trace.state_trace(program_, "M", "D2", before)
        return [(r["port"], r["reason"]) for r in found if r["kind"] == "global_variable"]

    return _each(_part(spark, sf_dir), "p_partkey", last, rows, "port string, hardware string")
