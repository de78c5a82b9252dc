"""Tables and the views derived from them: typed events and triples of the relational tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows_a_task: int = 20_000, *by: str) -> DataFrame:
    """The rows dealt evenly over tasks, so many to each at most, for work that costs more than its bytes say: a file of a few
    MB is one split, however many rows it holds. The tasks grow with the rows, so that the longest one doesn't. Counts df:
    for tables as they are read. With columns by, rows that have them in common share a task."""
    tasks = -(-df.count() // rows_a_task)
    return df.repartition(max(tasks, min(df.sparkSession.sparkContext.defaultParallelism, 4 * tasks), 1), *by)


def big(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: never sent whole through the driver, whatever size its file, which may be
    some MB for a million rows, makes Spark expect."""
    return df.hint("merge")


def micros(ts: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their correlation id (corr), type and time in microseconds (us)."""
    return load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("corr"), F.col("event_type").alias("type"), "value", "props", "ts", micros().alias("us"))


def iri(kind: str, *parts: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.concat_ws(".", *[F.col(p).cast("string") for p in parts]))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o, o_kind) of customers, orders, lines, parts, nations and regions."""
    t = lambda name: load(spark, sf_dir, name)

    def rows(df: DataFrame, s: Column, p: str, o: Column, kind: str = "iri") -> DataFrame:
        return df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))

    parts = [
        rows(t("orders"), iri("customer", "o_custkey"), "op:ownsOrder", iri("order", "o_orderkey")),
        rows(t("lineitem"), iri("order", "l_orderkey"), "op:containsCall", iri("line", "l_orderkey", "l_linenumber")),
        rows(t("lineitem"), iri("line", "l_orderkey", "l_linenumber"), "op:callsPOU", iri("part", "l_partkey")),
        rows(t("part"), iri("part", "p_partkey"), "dp:hasPOUName", F.col("p_name"), "literal"),
        rows(t("nation"), iri("nation", "n_nationkey"), "rdfs:subClassOf", iri("region", "n_regionkey")),
        rows(t("customer"), iri("customer", "c_custkey"), "rdf:type", iri("nation", "c_nationkey")),
        rows(t("customer"), iri("customer", "c_custkey"), "dp:hasName", F.col("c_name"), "literal"),
    ]
    return reduce(DataFrame.unionByName, parts)


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new folder's path below the one that all executors share: spark.checkpoint.dir; where that is unset, as in tests,
    a temporary one, but only for a local master: elsewhere each executor would write to a disk of its own."""
    sc = spark.sparkContext
    if not (at := sc.getConf().get("spark.checkpoint.dir")):
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return f"{at}/{what}-{uuid.uuid4().hex}"


def scratch(df: DataFrame, what: str) -> DataFrame:
    """Writes a table into scratch_path() and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    df.write.parquet(path := scratch_path(spark, what))
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that scratch() wrote, once nothing reads them any more."""
    for df in tables:
        for f in df.inputFiles()[:1]:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(f).getParent()
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
