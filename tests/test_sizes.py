"""Work grows with the rows and not with the bytes of a file: rows are dealt over tasks, and what grows isn't broadcast."""

import pytest
from pyspark.sql import functions as F

from tracewell.plans import catalogue
from tracewell.plans.code_queries import _calling_units
from tracewell.tables import spread

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    """A folder whose part and orders are one file of 50,000 rows each."""
    at = str(tmp_path_factory.mktemp("long"))
    for name, key in (("part", "p_partkey"), ("orders", "o_orderkey")):
        few = spark.read.parquet(f"{DIR}/{name}.parquet")
        many = few.drop(key).limit(100).crossJoin(spark.range(500)).withColumn(key, F.monotonically_increasing_id()).drop("id")
        many.select(few.columns).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


ROW_BY_ROW = "skill_requirements nested_calls nested_declarations nested_assignments condition_rows state_rows assignments_found call_blocks declarations_parsed xml_chunks dnf_paths".split()


@pytest.mark.parametrize("name", ROW_BY_ROW)
def test_rows_are_dealt_over_tasks(spark, long, name):
    df = _calling_units(spark, long) if name == "nested_calls" else catalogue.queries()[name](spark, long)
    assert df.rdd.getNumPartitions() > 2


def test_spread(spark):
    sizes = lambda n, a: [r["count"] for r in spread(spark.range(n).coalesce(1), a).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes(10_000, 1000)) == 10_000 and len(sizes(10_000, 1000)) == 10 and max(sizes(10_000, 1000)) < 1100
    assert not sizes(0, 1000) and sum(sizes(3, 1000)) == 3


@pytest.mark.parametrize("name", ["default_values", "default_value_counts", "bound_arguments", "call_triples", "unused_declarations", "unit_reports"])
def test_units_are_not_broadcast(spark, name):
    plan = catalogue.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_sources_broadcast_known_names_only(spark):
    """Of source_nodes, nations are broadcast; what units declare isn't."""
    plan = catalogue.queries()["source_nodes"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 5 and plan.count("BroadcastExchange") == plan.count("FileScan parquet [n_nationkey")


@pytest.mark.parametrize("name", ["source_nodes", "unit_reports", "bound_arguments"])
def test_running_broadcasts_no_units(spark, name):
    """Nor does Spark turn a join into a broadcast while it runs, when it sees how small a side is: but for the nations."""
    df = catalogue.queries()[name](spark, DIR)
    assert df.collect()
    ran, _, _ = df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")
    assert "isFinalPlan=true" in ran and "SortMergeJoin" in ran and ran.count("BroadcastExchange") == ran.count("FileScan parquet [n_nationkey")


def test_edges_are_worked_out_once(spark):
    """Edges that say how often they were read: once, though the chain takes many rounds."""
    from tracewell.operators.graph import reachable

    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            read.add(len(b))
            yield b

    edges = spark.range(0, 6, 1, 1).selectExpr("cast(id AS string) AS src", "cast(id + 1 AS string) AS dst").mapInPandas(run, "src string, dst string")
    found = reachable(edges, spark.createDataFrame([("0",)], "root string"))
    assert sorted((r.node, r.depth) for r in found.collect()) == [(str(i), i) for i in range(7)] and read.value == 6
