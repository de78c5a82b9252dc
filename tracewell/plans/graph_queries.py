"""Queries that walk graphs derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g
from ..tables import iri, load, triples
from .registry import query

_G = """g AS (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation
    UNION SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
    UNION SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: load(spark, sf_dir, n)
    pair = lambda df, a, b: df.select(a.alias("src"), b.alias("dst"))
    return pair(t("nation"), iri("region", "n_regionkey"), iri("nation", "n_nationkey")).unionByName(pair(t("customer"), iri("nation", "c_nationkey"), iri("customer", "c_custkey"))).unionByName(pair(t("orders"), iri("customer", "o_custkey"), iri("order", "o_orderkey")))


@query(f"""WITH RECURSIVE {_G}, r AS (SELECT DISTINCT 'region:' || r_regionkey AS root, 'region:' || r_regionkey AS node, 0 AS depth FROM region
    UNION SELECT root, dst, depth + 1 FROM r JOIN g ON src = node) SELECT root, node, min(depth) AS depth FROM r GROUP BY ALL""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.reachable(_edges(spark, sf_dir), load(spark, sf_dir, "region").select(iri("region", "r_regionkey").alias("root")))


_SUB = "c AS (SELECT 'nation:' || n_nationkey AS sub, 'region:' || n_regionkey AS super FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'place' FROM region)"


@query(f"""WITH RECURSIVE {_SUB}, k AS (SELECT sub, super FROM c UNION SELECT k.sub, c.super FROM k JOIN c ON c.sub = k.super)
    SELECT 'customer:' || c_custkey AS s, super AS type FROM customer JOIN k ON sub = 'nation:' || c_nationkey""")
def type_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    hierarchy = load(spark, sf_dir, "nation").select(iri("nation", "n_nationkey").alias("sub"), iri("region", "n_regionkey").alias("super"))
    hierarchy = hierarchy.unionByName(load(spark, sf_dir, "region").select(iri("region", "r_regionkey").alias("sub"), F.lit("place").alias("super")))
    types = triples(spark, sf_dir).where("p = 'rdf:type'").select("s", F.col("o").alias("type"))
    return g.materialise_types(types, hierarchy).select("s", "type")


_N = """n AS (SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity >= 49)"""


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: load(spark, sf_dir, name)
    rows = t("lineitem").where("l_quantity >= 49").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).distinct()


@query(f"""WITH {_N}, a AS (SELECT src, dst FROM n WHERE src <> dst), s AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1),
    p AS (SELECT [src, dst] AS p, 1 AS length FROM a JOIN s ON k = src UNION ALL SELECT [x.src, x.dst, y.dst], 2 FROM a x JOIN s ON k = x.src JOIN a y ON y.src = x.dst WHERE y.dst <> x.src)
    SELECT array_to_string(p, '>') AS path, length FROM p""")
def simple_paths_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = load(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("start"))
    rows = g.simple_paths(_trade(spark, sf_dir), starts, 2)
    return rows.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "length")


@query(f"""WITH RECURSIVE {_N}, r AS (SELECT n_nationkey AS start, n_nationkey AS node FROM nation WHERE n_regionkey = 2 UNION SELECT start, dst FROM r JOIN n ON src = node)
    SELECT start, 'nation' AS kind, CAST(node AS VARCHAR) AS node FROM r UNION ALL SELECT DISTINCT start, 'region', CAST(n_regionkey AS VARCHAR) FROM r JOIN nation ON n_nationkey = node""")
def hw_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closure over typed states: nations by trade, and the regions that they signal."""
    text = lambda c: F.col(c).cast("string")
    moves = _trade(spark, sf_dir).select(F.lit("nation").alias("src_kind"), text("src").alias("src"), F.lit("nation").alias("dst_kind"), text("dst").alias("dst"))
    nations = load(spark, sf_dir, "nation")
    signals = nations.select(F.lit("nation").alias("src_kind"), text("n_nationkey").alias("src"), F.lit("region").alias("dst_kind"), text("n_regionkey").alias("dst"))
    starts = nations.where("n_regionkey = 2").select(F.col("n_nationkey").alias("start"), F.lit("nation").alias("kind"), text("n_nationkey").alias("node"))
    return g.typed_closure(moves.unionByName(signals), starts)


_INV = """e AS (SELECT 'term' AS kind, 'nation_1' AS node, 'nation' AS to_kind, CAST(n_nationkey AS VARCHAR) AS "to", CAST(50 AS DOUBLE) AS priority FROM nation WHERE contains(lower(n_name), 'nation_1')
    UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 'region', CAST(n_regionkey AS VARCHAR), 30 FROM nation UNION ALL SELECT 'region', CAST(n_regionkey AS VARCHAR), 'nation', CAST(n_nationkey AS VARCHAR), 20 FROM nation
    UNION ALL SELECT 'nation', CAST(s_nationkey AS VARCHAR), 'supplier', CAST(s_suppkey AS VARCHAR), 10 FROM supplier)"""


@query(f"""WITH RECURSIVE {_INV}, r AS (SELECT 0 AS step, [{{'k': 'term', 'n': 'nation_1', 'p': CAST(100 AS DOUBLE), 't': 0}}] AS heap, [{{'k': 'term', 'n': 'nation_1'}}] AS known, CAST(NULL AS STRUCT(k VARCHAR, n VARCHAR)) AS visited
    UNION ALL SELECT step + 1, list_concat(list_filter(heap, lambda h: h <> top), coalesce(new, [])), list_concat(known, list_transform(coalesce(new, []), lambda h: {{'k': h.k, 'n': h.n}})), {{'k': top.k, 'n': top.n}}
        FROM (SELECT step, heap, known, top, (SELECT list({{'k': x.to_kind, 'n': x."to", 'p': x.priority, 't': 100 * (step + 1) + i}} ORDER BY i) FROM (SELECT *, row_number() OVER (ORDER BY priority DESC, to_kind, "to") AS i FROM e WHERE kind = top.k AND node = top.n) x WHERE NOT list_contains(known, {{'k': x.to_kind, 'n': x."to"}})) AS new
            FROM (SELECT *, list_sort(list_transform(heap, lambda h: {{'o': -h.p, 't': h.t, 'h': h}}))[1].h AS top FROM r WHERE step < 16 AND len(heap) > 0)))
    SELECT CAST(step - 1 AS INTEGER) AS step, visited.k AS kind, visited.n AS node FROM r WHERE step > 0""")
def graph_investigate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-first expansion from a search term over nations, regions and suppliers, within a budget of 16 steps."""
    nations, suppliers = load(spark, sf_dir, "nation"), load(spark, sf_dir, "supplier")
    text = lambda c: F.col(c).cast("string")
    edge = lambda df, kind, node, to_kind, to, priority, relation: df.select(F.lit(kind).alias("kind"), node.alias("node"), F.lit(to_kind).alias("to_kind"), to.alias("to"), F.lit(priority).alias("priority"), F.lit(relation).alias("relation"))
    edges = edge(nations.where(F.lower("n_name").contains("nation_1")), "term", F.lit("nation_1"), "nation", text("n_nationkey"), 50.0, "matches")
    edges = edges.unionByName(edge(nations, "nation", text("n_nationkey"), "region", text("n_regionkey"), 30.0, "subClassOf")).unionByName(edge(nations, "region", text("n_regionkey"), "nation", text("n_nationkey"), 20.0, "contains"))
    edges = edges.unionByName(edge(suppliers, "nation", text("s_nationkey"), "supplier", text("s_suppkey"), 10.0, "hosts"))
    found = g.investigate([("term", "nation_1", 100.0)], g.prefetched(edges, [("term", "nation_1")], 16, 1000), max_iters=16, max_nodes=100_000)
    rows = [(i, k, n) for i, (k, n) in enumerate(found["visited"])]
    return spark.createDataFrame(rows, "step int, kind string, node string")
