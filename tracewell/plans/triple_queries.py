"""Queries on the triples and their tables: patterns, joins, sets, aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import pattern as pt
from ..operators import windows as w
from ..tables import iri, load, triples
from .registry import query

_T = """t AS (
    SELECT 'customer:' || o_custkey AS s, 'op:ownsOrder' AS p, 'order:' || o_orderkey AS o, 'iri' AS o_kind FROM orders
    UNION ALL SELECT 'order:' || l_orderkey, 'op:containsCall', 'line:' || l_orderkey || '.' || l_linenumber, 'iri' FROM lineitem
    UNION ALL SELECT 'line:' || l_orderkey || '.' || l_linenumber, 'op:callsPOU', 'part:' || l_partkey, 'iri' FROM lineitem
    UNION ALL SELECT 'part:' || p_partkey, 'dp:hasPOUName', p_name, 'literal' FROM part
    UNION ALL SELECT 'nation:' || n_nationkey, 'rdfs:subClassOf', 'region:' || n_regionkey, 'iri' FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'rdf:type', 'nation:' || c_nationkey, 'iri' FROM customer
    UNION ALL SELECT 'customer:' || c_custkey, 'dp:hasName', c_name, 'literal' FROM customer)"""


@query(f"WITH {_T} SELECT s, p, o FROM t WHERE p = 'rdf:type' AND o = 'nation:3'")
def triple_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.match(triples(spark, sf_dir), p="rdf:type", o="nation:3").select("s", "p", "o")


@query("""SELECT 'customer:' || o_custkey AS c, 'line:' || a.l_orderkey || '.' || a.l_linenumber AS call, 'part:' || b.l_partkey AS pou, p_name AS name FROM orders
    JOIN lineitem a ON a.l_orderkey = o_orderkey JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber JOIN part ON p_partkey = b.l_partkey WHERE o_custkey = 7""")
def bgp_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir)
    rows = pt.bgp(t, ("?c", "op:ownsOrder", "?order"), ("?order", "op:containsCall", "?call"), ("?call", "op:callsPOU", "?pou"), ("?pou", "dp:hasPOUName", "?name"))
    return rows.where(F.col("c") == "customer:7").select("c", "call", "pou", "name")


@query(f"WITH {_T} SELECT DISTINCT a.s AS caller, b.o AS pou FROM t a JOIN t b ON a.o = b.s WHERE a.p = 'op:containsCall' AND b.p = 'op:callsPOU' AND b.o = 'part:11'")
def callers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.bgp(triples(spark, sf_dir), ("?call", "op:callsPOU", "part:11"), ("?caller", "op:containsCall", "?call")).select("caller").distinct().withColumn("pou", F.lit("part:11"))


@query("SELECT c_custkey, c_name, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def optional_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return pt.optional(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), right, ["c_custkey"])


@query("""SELECT r_name, n_name, s_name, p_name, l_orderkey, l_linenumber FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey
    JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey WHERE r_name = 'ASIA' AND l_quantity >= 45""")
def five_way_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: load(spark, sf_dir, n)
    geo = t("region").where("r_name = 'ASIA'").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    rows = geo.join(t("supplier"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("lineitem").where("l_quantity >= 45"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.select("r_name", "n_name", "s_name", "p_name", "l_orderkey", "l_linenumber")


_KINDS = "SELECT 'part' AS category, CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name FROM customer UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name FROM nation"


@query(f"SELECT DISTINCT category, id, name FROM ({_KINDS}) WHERE contains(lower(name), 'an')")
def union_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: load(spark, sf_dir, n)
    kinds = {n: (t(n), F.col(f"{n[0]}_{key}"), F.col(f"{n[0]}_name")) for n, key in (("part", "partkey"), ("supplier", "suppkey"), ("customer", "custkey"), ("nation", "nationkey"))}
    return pt.union_search(kinds, "AN")


@query("SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) = 'nation_7'")
def ci_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").where(pt.equals_ci("n_name", "Nation_7")).select("n_nationkey", "n_name")


@query("SELECT iri FROM (SELECT 'http://example.org/parts#' || p_partkey AS iri FROM part) WHERE regexp_matches(iri, '(^|[#/])42$')")
def iri_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select(F.concat(F.lit("http://example.org/parts#"), F.col("p_partkey").cast("string")).alias("iri"))
    return rows.where(pt.iri_ends("iri", "42"))


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size IN (1, 7, 42) AND contains(p_type, 'A')")
def values_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").where(F.col("p_size").isin(1, 7, 42) & F.col("p_type").contains("A")).select("p_partkey", "p_brand", "p_size")


@query(f"WITH {_T} SELECT s, p, o FROM t WHERE contains(lower(s), 'nation') OR contains(lower(p), 'nation') OR contains(lower(o), 'nation') ORDER BY s, p, o LIMIT 30")
def string_triple_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir)
    hit = pt.contains_ci("s", "nation") | pt.contains_ci("p", "nation") | pt.contains_ci("o", "nation")
    return t.where(hit).select("s", "p", "o").orderBy("s", "p", "o").limit(30)


@query(f"WITH {_T} SELECT p, count(*) AS n FROM t GROUP BY p ORDER BY n DESC, p LIMIT 5")
def schema_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(spark, sf_dir).groupBy("p").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p").limit(5)


@query(f"WITH {_T} SELECT o AS class, count(*) AS n FROM t WHERE p = 'rdf:type' GROUP BY o")
def class_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(spark, sf_dir).where("p = 'rdf:type'").groupBy(F.col("o").alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {_T} SELECT DISTINCT s, o FROM t WHERE p IN ('dp:hasName', 'dp:hasPOUName') AND o_kind = 'literal'")
def path_alternative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(spark, sf_dir).where(F.col("p").isin("dp:hasName", "dp:hasPOUName") & (F.col("o_kind") == "literal")).select("s", "o").distinct()


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = load(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf_dir, "customer").join(rich, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000 AND o_custkey IS NOT NULL)")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = load(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf_dir, "customer").join(rich, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(load(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).subtract(load(spark, sf_dir, "supplier").where("s_acctbal > 9000").select("s_nationkey"))


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 47)")
def unused_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = load(spark, sf_dir, "lineitem").where("l_quantity > 47").select(F.col("l_partkey").alias("p_partkey"))
    return load(spark, sf_dir, "part").join(used, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("""WITH y AS (SELECT l_orderkey AS k, l_linenumber AS i, min(l_returnflag) AS v, max(l_quantity) AS q, min(l_linestatus) AS st FROM lineitem GROUP BY ALL),
    c AS (SELECT y.k, bool_and(coalesce(a.v <> 'A', false)) AS ok FROM y LEFT JOIN y a ON a.k = y.k AND a.i = y.i AND a.st = 'F' WHERE y.q > 45 GROUP BY y.k)
    SELECT o_orderkey AS k, coalesce(ok, true) AS met FROM orders LEFT JOIN c ON k = o_orderkey""")
def expectation_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of large quantity expect that their line is finished and wasn't accepted."""
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i")).agg(F.min("l_returnflag").alias("v"), F.max("l_quantity").alias("q"), F.min("l_linestatus").alias("st"))
    expected = lines.where("q > 45").select("k", "i", F.lit(True).alias("fine"))
    actual = lines.where("st = 'F'").select("k", "i", (F.col("v") != "A").alias("fine"))
    return pt.expectations_met(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), expected, actual, "k", "i", "fine")


_STEPS = "f AS (SELECT o_custkey AS k, bool_and(o_orderstatus <> 'F') AS ok FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)"


def _urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_and(F.col("o_orderstatus") != "F").alias("ok"))
    return load(spark, sf_dir, "customer").select("c_custkey").join(steps, "c_custkey", "left")


@query(f"WITH {_STEPS} SELECT c_custkey FROM customer LEFT JOIN f ON k = c_custkey WHERE coalesce(ok, true)")
def monitor_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without any action a failure mode stays."""
    return _urgent(spark, sf_dir).where(F.coalesce("ok", F.lit(True))).select("c_custkey")


@query(f"WITH {_STEPS} SELECT c_custkey FROM customer LEFT JOIN f ON k = c_custkey WHERE coalesce(ok, false)")
def reaction_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a payload a reaction has failed."""
    return _urgent(spark, sf_dir).where(F.coalesce("ok", F.lit(False))).select("c_custkey")


@query("""SELECT o_custkey, 'orders=' || count(*) || ' | open=' || count(*) FILTER (o_orderstatus = 'O') || ' | ' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS report FROM orders GROUP BY o_custkey""")
def consistency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
    n = lambda name, c: F.concat(F.lit(name + "="), c.cast("string"))
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat_ws(" | ", n("orders", F.count("*")), n("open", F.count_if(F.col("o_orderstatus") == "O")), keys).alias("report"))


@query("""SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n_in, count(*) FILTER (l_returnflag = 'N') AS n_out,
    count(*) FILTER (l_returnflag = 'R') >= 3 AND count(*) FILTER (l_returnflag = 'N') < 3 AS is_input, count(*) FILTER (l_returnflag = 'N') >= 3 AS is_output FROM lineitem GROUP BY l_orderkey""")
def gemma_style_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda f: F.count_if(F.col("l_returnflag") == f)
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(n("R").alias("n_in"), n("N").alias("n_out"), ((n("R") >= 3) & (n("N") < 3)).alias("is_input"), (n("N") >= 3).alias("is_output"))


@query("""SELECT l_suppkey, max(l_discount) AS confidence, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, arg_min(l_linestatus, (l_orderkey, l_linenumber)) AS first_status, count(*) AS n FROM lineitem GROUP BY l_suppkey""")
def suggestion_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max("l_discount").alias("confidence"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"), F.min_by("l_linestatus", F.struct("l_orderkey", "l_linenumber")).alias("first_status"), F.count("*").alias("n"))


@query("""SELECT l_orderkey, bool_or(l_returnflag = 'R') AS has_stop, bool_or(l_tax > 0.07) AS has_loop, bool_or(l_quantity < 5) AS has_default, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN max(l_linestatus) END AS mode,
    CASE WHEN bool_or(l_returnflag = 'R') THEN 'stopped' WHEN bool_or(l_tax > 0.07) THEN 'loop' WHEN bool_or(l_quantity < 5) THEN 'default' ELSE 'hardware' END AS verdict FROM lineitem GROUP BY l_orderkey""")
def terminal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop, loop, default = F.col("l_returnflag") == "R", F.col("l_tax") > 0.07, F.col("l_quantity") < 5
    # unanimous: least and greatest are the same, which needs no distinct count
    mode = F.when(F.min("l_linestatus") == F.max("l_linestatus"), F.max("l_linestatus"))
    out = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(stop).alias("has_stop"), F.bool_or(loop).alias("has_loop"), F.bool_or(default).alias("has_default"), mode.alias("mode"))
    return out.withColumn("verdict", F.when(F.col("has_stop"), "stopped").when(F.col("has_loop"), "loop").when(F.col("has_default"), "default").otherwise("hardware"))


_L = "x AS (SELECT l_orderkey AS k, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS line, l_returnflag AS v FROM lineitem)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in a total order: line numbers repeat within an order."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), place.alias("line"), F.col("l_returnflag").alias("v"))


@query(f"""WITH {_L} SELECT k, line, v, lead(line) OVER w IS NOT NULL AS has_later, coalesce(string_agg(CAST(line AS VARCHAR), ',') OVER (PARTITION BY k ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS later FROM x WINDOW w AS (PARTITION BY k ORDER BY line)""")
def later_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.later_assignments(_lines(spark, sf_dir), "k", "line", "v")


@query(f"WITH {_L} SELECT k, max(line) AS dominant_line FROM x WHERE v = 'R' GROUP BY k")
def dominant_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.dominant(_lines(spark, sf_dir), "k", "line", F.col("v") == "R")


@query(f"""WITH {_L}, y AS (SELECT *, CASE WHEN v = 'R' THEN 0 WHEN v = 'A' THEN 1 ELSE 2 END AS tier FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tier, line DESC) AS n FROM y)
    SELECT k, tier, line AS picked_line FROM z WHERE n = 1""")
def pick_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.pick_tiers(_lines(spark, sf_dir), "k", "line", [F.col("v") == "R", F.col("v") == "A"])


@query("SELECT l_orderkey, l_partkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS INTEGER) AS call_index FROM lineitem")
def call_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("l_orderkey", "l_suppkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")) - 1
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", n.alias("call_index"))


@query(f"""WITH {_T}, n AS (SELECT 'customer:' || c_custkey AS s, 'dp:hasName' AS p, 'renamed ' || c_custkey AS o, 'literal' AS o_kind FROM customer WHERE c_nationkey = 3)
    SELECT s, p, o FROM t WHERE p = 'dp:hasName' AND s NOT IN (SELECT s FROM n) UNION SELECT s, p, o FROM n""")
def graph_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove a pattern, then add: names of some customers are replaced."""
    new = load(spark, sf_dir, "customer").where("c_nationkey = 3").select(iri("customer", "c_custkey").alias("s"), F.lit("dp:hasName").alias("p"), F.concat(F.lit("renamed "), F.col("c_custkey").cast("string")).alias("o"), F.lit("literal").alias("o_kind"))
    return pt.overwrite(pt.match(triples(spark, sf_dir), p="dp:hasName"), new).select("s", "p", "o")


@query("""SELECT 'p' || p_partkey AS token, CASE WHEN s.s_suppkey IS NOT NULL THEN 'supplier' WHEN n.n_nationkey IS NOT NULL THEN 'nation' ELSE 'unknown' END AS kind,
    CAST(coalesce(s.s_suppkey, n.n_nationkey) AS VARCHAR) AS target FROM part LEFT JOIN supplier s ON s_suppkey = p_partkey LEFT JOIN nation n ON n_nationkey = p_partkey""")
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens are looked up in one table after the other; the first that knows the name wins."""
    named = lambda n, key: load(spark, sf_dir, n).select(F.concat(F.lit("P"), F.col(key).cast("string")).alias("name"), F.col(key).alias("target_key"))
    tokens = load(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("token"))
    return pt.resolve_names(tokens, "token", ("supplier", named("supplier", "s_suppkey"), "name", "target_key"), ("nation", named("nation", "n_nationkey"), "name", "target_key"))


@query("""WITH f AS (SELECT n_nationkey AS fm, count(*) FILTER (s_acctbal > 5000) AS good FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)
    SELECT n_name, fm, good FROM f JOIN nation ON n_nationkey = fm WHERE n_name <> 'NATION_3' AND good > 0""")
def failure_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure mode to its actions, without the default one."""
    acts = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("fm")).agg(F.count_if(F.col("s_acctbal") > 5000).alias("good"))
    modes = load(spark, sf_dir, "nation").where("n_name <> 'NATION_3'").select("n_name", F.col("n_nationkey").alias("fm"))
    return modes.join(acts, "fm").where("good > 0").select("n_name", "fm", "good")


@query("""SELECT c_custkey AS skill, coalesce(d.o_orderkey, l.o_orderkey) AS function_key FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) d ON d.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) l ON l.o_custkey = c_custkey""")
def skill_function_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A direct mapping, else the older one."""
    orders = load(spark, sf_dir, "orders")
    direct = orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("skill")).agg(F.min("o_orderkey").alias("d"))
    legacy = orders.groupBy(F.col("o_custkey").alias("skill")).agg(F.max("o_orderkey").alias("l"))
    skills = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("skill"))
    return skills.join(direct, "skill", "left").join(legacy, "skill", "left").select("skill", F.coalesce("d", "l").alias("function_key"))


@query("SELECT count(*) FILTER (l_returnflag = 'A') AS n_set, count(*) FILTER (l_returnflag = 'N') AS n_created, count(*) FILTER (l_returnflag = 'R') AS n_missing FROM lineitem")
def etl_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda f: F.count_if(F.col("l_returnflag") == f)
    return load(spark, sf_dir, "lineitem").agg(n("A").alias("n_set"), n("N").alias("n_created"), n("R").alias("n_missing"))


@query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""")
def theta_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    left, right = n.select(F.col("n_nationkey").alias("a"), "n_regionkey"), n.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    return left.join(right, "n_regionkey").where("a <> b").select("a", "b")


@query("""SELECT s.s_suppkey AS target, b.s_acctbal AS inherited, CASE WHEN b.s_suppkey IS NULL THEN 'missing source' WHEN b.s_acctbal < 0 THEN 'source without data' ELSE 'copied' END AS status
    FROM supplier s LEFT JOIN supplier b ON b.s_suppkey = s.s_suppkey * 2""")
def simulation_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target takes the data of the source that its name derives; sources that lack are reported."""
    s = load(spark, sf_dir, "supplier")
    source = s.select(F.col("s_suppkey").alias("source"), F.col("s_acctbal").alias("inherited"))
    rows = s.select(F.col("s_suppkey").alias("target"), (F.col("s_suppkey") * 2).alias("wanted")).join(source, F.col("wanted") == F.col("source"), "left")
    return rows.select("target", "inherited", F.when(F.col("source").isNull(), "missing source").when(F.col("inherited") < 0, "source without data").otherwise("copied").alias("status"))
