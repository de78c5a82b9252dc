"""Nearest vectors by inverted lists: rows go to their nearest centre, their residuals are kept in a byte a dimension, the
lists near a query are searched by those, and the best are ranked again by their exact distances.

Centres come from a sample of bounded size; every row is in the index. Lists are cut into blocks, so that no list, whatever
its size (a third of all rows may be copies), is one task's. Distances are squared Euclidean; ties go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import discard, scratch

#: Vectors that centres are fitted on, at most about so many.
SAMPLE = 20_000
MOST_LISTS = 1024
#: Rows of a list's block, and queries that are held against one at a time.
BLOCK = 8192


@dataclass
class Centres:
    centres: np.ndarray
    #: A residual is a byte times this, a dimension.
    step: np.ndarray


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]


def fit_centres(vectors: DataFrame, vector: str = "embedding", lists: int | None = None, rounds: int = 12) -> Centres:
    """k-means on at most about SAMPLE rows, chosen by a hash of the vector; lists defaults to the root of the rows' number,
    MOST_LISTS at most. No rows give one centre without dimensions."""
    n = vectors.count()
    chosen = vectors.where(F.pmod(F.xxhash64(vector), F.lit(1 << 30)) < F.lit(min(1.0, SAMPLE / max(n, 1)) * (1 << 30)))
    x = np.array([r[0] for r in chosen.select(vector).orderBy(F.xxhash64(vector)).limit(2 * SAMPLE).collect()], np.float32)
    if not len(x):
        return Centres(np.zeros((1, 0), np.float32), np.ones(0, np.float32))
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(1)
    k = max(1, min(lists or int(n**0.5), MOST_LISTS, len(distinct)))
    c = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        own = _squares(x, c).argmin(1)
        sums = np.zeros_like(c, np.float64)
        np.add.at(sums, own, x)
        size = np.bincount(own, minlength=k)[:, None]
        c = np.where(size > 0, sums / np.maximum(size, 1), c).astype(np.float32)
    residual = np.abs(x - c[_squares(x, c).argmin(1)]).max(0)
    return Centres(c, np.maximum(residual, 1e-12).astype(np.float32) / 127)


def index_vectors(vectors: DataFrame, model: Centres, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(list, block, key, code, vector) of every row; a row whose vector is null has none, repeated rows
    their own. Write it by list to keep it."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    width = model.centres.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x = _matrix(b.column(1), width)
            own = _squares(x, m.centres).argmin(1) if len(x) else np.zeros(0, np.int64)
            code = np.clip(np.rint((x - m.centres[own]) / m.step), -127, 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.astype(np.int32)), pa.array([r.tobytes() for r in code], pa.binary()), b.column(1)], ["key", "list", "code", "vector"])

    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<float>").alias("vector"))
    found = scratch(rows.mapInArrow(run, "key long, list int, code binary, vector array<float>"), "lists")
    sizes = found.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))  # at most MOST_LISTS rows
    return found.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), "key", "code", "vector")


def nearest(index: DataFrame, queries: DataFrame, model: Centres, k: int = 10, probes: int = 8, again: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, neighbour, distance, rank) of the k nearest rows of the index to each of queries(key, vector), itself left out.

    probes lists are searched for each query, and the best again * k by quantised residuals ranked by exact distances. With
    probes as many as there are lists and again as None all rows are ranked exactly. Queries with a null vector have no rows.
    """
    shared = queries.sparkSession.sparkContext.broadcast(model)
    width, lists = model.centres.shape[1], len(model.centres)
    most = None if again is None else again * k

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), width)
            near = np.argsort(_squares(x, shared.value.centres), axis=1, kind="stable")[:, : min(probes, lists)].astype(np.int32) if len(x) else np.zeros((0, 1), np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.tolist(), pa.list_(pa.int32()))], ["query", "q", "lists"])

    names = ["query", "neighbour", "rough", "distance"]

    def exact(x: np.ndarray, q: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Squared distances of rows x[at] and queries q[of], a dimension after the other."""
        out = np.zeros(len(at))
        for begin in range(0, len(at), 65_536):
            a, b, s = x[at[begin : begin + 65_536]], q[of[begin : begin + 65_536]], out[begin : begin + 65_536]
            for i in range(width):
                s += (a[:, i].astype(np.float64) - b[:, i]) ** 2
        return out

    def search(group: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The best of one block's rows for each query that is asked there: by quantised residuals the best again * k, else the
        k nearest. Their vectors are at hand, so that their distances need no join."""
        rows, m, out = right.num_rows, shared.value, []
        keys, x = right["key"].to_numpy(), _matrix(right["vector"], width) if rows else np.zeros((0, width), np.float32)
        near = x.astype(np.float64)
        if most is not None and rows:
            near = (np.frombuffer(b"".join(right["code"].to_pylist()), np.int8).reshape(rows, width) * m.step + m.centres[int(group[0].as_py())]).astype(np.float32)
        for begin in range(0, left.num_rows if rows else 0, 128):
            part = left.slice(begin, 128)
            asking, q = part["query"].to_numpy(), _matrix(part["q"], width)
            d = _squares(q.astype(near.dtype), near)
            d[(asking[:, None] == keys[None, :]) | ~np.isfinite(d)] = np.inf
            few = min(k if most is None else most, rows)
            if most is None:  # all that rounding may have put behind the k-th, then by their exact distances
                cut = np.partition(d, few - 1, axis=1)[:, few - 1] + 1e-9 * ((q.astype(np.float64) ** 2).sum(1) + (near * near).sum(1).max())
                of, at = np.nonzero((d <= cut[:, None]) & np.isfinite(d))
            else:
                at = (np.argpartition(d, few - 1, axis=1)[:, :few] if few < rows else np.tile(np.arange(rows), (len(d), 1))).ravel()
                of = np.repeat(np.arange(len(d)), few)
                ok = np.isfinite(d[of, at])
                of, at = of[ok], at[ok]
            distance = exact(x, q, at, of)
            if most is None:
                order = np.lexsort((keys[at], distance, of))
                of, at, distance = of[order], at[order], distance[order]
                begins = np.searchsorted(of, of)
                ok = np.arange(len(of)) - begins < k
                of, at, distance = of[ok], at[ok], distance[ok]
            out.append(pa.table([pa.array(asking[of]), pa.array(keys[at]), pa.array(d[of, at].astype(np.float64)), pa.array(distance)], names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.float64())], names)

    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("query"), F.col(vector).cast("array<float>").alias("q"))
    asked = scratch(asked.mapInArrow(route, "query long, q array<float>, lists array<int>"), "asked")
    if most is None and probes >= lists:  # every row is asked for: even blocks of all, as lists would only make more of them
        blocks = max(1, -(-index.count() // (2 * BLOCK)))
        index = index.withColumns({"list": F.lit(0), "block": F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")})
        routed = asked.select(F.lit(0).alias("list"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "query", "q")
    else:
        last = index.groupBy("list").agg(F.max("block").alias("last"))  # at most MOST_LISTS rows
        routed = asked.select("query", "q", F.explode("lists").alias("list")).join(F.broadcast(last), "list").select("list", F.explode(F.sequence(F.lit(0), "last")).alias("block"), "query", "q")
    found = routed.groupBy("list", "block").cogroup(index.groupBy("list", "block")).applyInArrow(search, "query long, neighbour long, rough double, distance double")
    best = F.collect_list(F.struct("distance", "neighbour"))
    if most is not None:
        best = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("rough", "neighbour", "distance"))), 1, most), lambda x: F.struct(x["distance"].alias("distance"), x["neighbour"].alias("neighbour")))
    ranked = found.groupBy("query").agg(F.slice(F.sort_array(best), 1, k).alias("best"))
    out = scratch(ranked.select("query", F.posexplode("best").alias("rank", "b")).select("query", F.col("b.neighbour").alias("neighbour"), F.col("b.distance").alias("distance"), (F.col("rank") + 1).cast("int").alias("rank")), "nearest")
    discard(asked)
    return out


def probes_for(index: DataFrame, sample: DataFrame, model: Centres, k: int = 10, least: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> tuple[int, float]:
    """(probes, recall): the fewest lists, of 1, 2, 4, ... and all, with which the k nearest of a sample of queries are found to
    the share least, measured against exact search over all rows. The sample is to be of bounded size."""
    lists = len(model.centres)
    exact = nearest(index, sample, model, k, lists, None, key, vector)
    n, probes = exact.count(), 1
    while True:
        found = nearest(index, sample, model, k, probes, key=key, vector=vector)
        recall = found.join(exact, ["query", "neighbour"], "left_semi").count() / n if n else 1.0
        discard(found)
        if recall >= least or probes >= lists:
            discard(exact)
            return probes, recall
        probes = min(2 * probes, lists)


def save(index: DataFrame, path: str) -> None:
    """The index as a table with a folder per list, so that a search reads the lists it needs."""
    index.write.mode("errorifexists").partitionBy("list").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("block int, key long, code binary, vector array<float>, list int").parquet(path)
