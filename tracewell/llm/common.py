"""What the operators of this subpackage share: scratch tables, word hashes, skew-proof joins and components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.conf import RuntimeConfig

#: Entries of a worker's word cache; about 180 bytes each.
WORD_CACHE = 120_000
#: Rows of a batch that goes to a Python worker: texts can be long, and both sides hold a batch at a time.
BATCH_ROWS = 2048
BATCH_BYTES = 8 << 20
#: A key with at least this share of the rows counts as hot, so that there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset (tests) a temporary one.

    Only a local master may do without the setting: elsewhere each executor would write to a disk of its own.
    """
    sc = spark.sparkContext
    if not (at := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(at := "file://" + tempfile.mkdtemp(prefix="shared-"))
        at = sc.getCheckpointDir() or at
    return at


#: Folders that new_path() gave out and that are still there, as far as this process knows.
_WRITTEN: list[str] = []


def new_path(spark: SparkSession, what: str) -> str:
    _WRITTEN.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the intermediate tables that were written within it: store results before that."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in [p for p in _WRITTEN if p not in before]:
            delete(spark, path)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: computed once, safe when executors are lost."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, what))
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that materialise() wrote."""
    for df in tables:
        for f in df.inputFiles()[:1]:
            at = f.rsplit("/", 1)[0]
            delete(df.sparkSession, next((p for p in _WRITTEN if p.rsplit("/", 1)[1] == at.rsplit("/", 1)[1]), at))


class WordHash(dict):
    """bytes -> 64-bit hash, with a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_CACHE:
            self[word] = value
        return value


def hash_words(words: list[bytes], cache: WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


#: Odd multiplier of the polynomial hash of word windows (any odd 64-bit number will do).
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Finishes a polynomial hash so that all bits depend on all others."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all windows of so many words; none where there are fewer words."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    n = len(h) - width + 1
    out = h[:n].copy()
    for i in range(1, width):
        out = out * MULTIPLIER + h[i : i + n]
    return mix(out)


def skewed_left_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, spread: list[str]) -> DataFrame:
    """left LEFT JOIN right on keys, for a right side with one row per key and the count of left rows behind it.

    Keys with at least HOT_SHARE of all counted rows are broadcast (at most 1 / HOT_SHARE of them, by arithmetic);
    the others are joined by a shuffle in which the rows of hot keys are dealt out by a hash of the spread columns
    (not by a running number, which a retried task could give out anew). Null keys match nothing.
    The count column isn't returned.
    """
    values = [c for c in right.columns if c not in (*keys, count)]
    total = right.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) >= max(2, total * HOT_SHARE)
    hot = right.where(is_hot).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.struct(*values).alias("__hot"))
    rest = right.where(~is_hot).select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)], F.lit(0).alias("__zero"), F.struct(*values).alias("__rest"))
    out = left.join(F.broadcast(hot), [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)], "left")
    salt = F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*spread), F.lit(100_003))).cast("int")
    out = out.withColumn("__salt", salt)
    out = out.join(rest.hint("merge"), [*[F.col(k) == F.col(f"__r{i}") for i, k in enumerate(keys)], F.col("__salt") == F.col("__zero")], "left")
    return out.select(*[F.col(c) for c in left.columns], *[F.coalesce(F.col(f"__hot.{v}"), F.col(f"__rest.{v}")).alias(v) for v in values])


def bit_filter(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str, bits: int = 23) -> DataFrame:
    """Rows whose key may be among the wanted ones (some others pass, none is lost), by a hashed bitmap.

    The bitmap has 2**bits bits whatever the input, so that its 2**(bits - 6) words can be broadcast.
    """
    spot = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(1 << bits))
    words = wanted.select(spot(wanted_key).alias("s")).select(F.expr("s div 64").alias("__w"), F.expr("shiftleft(1L, cast(s % 64 as int))").alias("m")).groupBy("__w").agg(F.bit_or("m").alias("__m"))
    found = rows.withColumn("__s", spot(key)).withColumn("__w", F.expr("__s div 64")).join(F.broadcast(words), "__w")
    return found.where("shiftrightunsigned(__m, cast(__s % 64 as int)) & 1 = 1").select(*rows.columns)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the undirected edges; component is the smallest node that it reaches.

    Alternating large-star and small-star steps; each step's edges are a table in the shared folder. Where many edges
    meet in one node, both sides of the step's join are plain tables, so that Spark can split that node's rows.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        out = both.join(least.hint("merge"), "u")
        if large:
            out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = out.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        done = materialise(out.where("u <> v").distinct(), "star")
        drop(least)
        return done

    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    e = materialise(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = mark(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        wide = star(e, True)
        small = star(wide, False)
        drop(e, wide)
        e, now = small, mark(small)
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components() did not settle in {max_rounds} rounds")


def arrow_map(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """df.mapInArrow() with batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes, settings that the session keeps."""
    conf = df.sparkSession.conf
    at_most(conf, "spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    at_most(conf, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(f, schema)


def at_most(conf: RuntimeConfig, key: str, most: int) -> None:
    """Lowers a number among the session's settings where it is larger, unset or without a bound."""
    now = str(conf.get(key)).rstrip("bB")
    if not (now.isdigit() and 0 < int(now) <= most):
        conf.set(key, str(most))


def chunks(batches: Iterable, most: int) -> Iterator:
    """Arrow batches of at most so many rows each. At the end, freed memory goes back to the system: Spark keeps its
    Python workers for the tasks of later stages, and what they hold on to adds up."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def share(n: Column, of: Column) -> Column:
    """n / of, 0 where of is 0."""
    return F.when(of == 0, F.lit(0.0)).otherwise(n / of)
