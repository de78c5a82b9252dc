"""Document fingerprints from closed syncmers, for positional matching.

A k-mer of code points is a closed syncmer when its smallest inner s-mer, by hash, is its first or its last one. That
depends on the k-mer alone, so equal passages give equal anchors wherever they stand. A fingerprint keeps the SIZE
anchors of smallest hash with their positions; likeness() estimates the share of anchors that two texts have in
common at one consistent shift.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIER, arrow_map, mix

K, S = 20, 8
SIZE = 64
_STEP = (K - S) // 2

Anchors = tuple[np.ndarray, np.ndarray]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def syncmers(cp: np.ndarray) -> Anchors:
    """Hashes (32 bits, in 64) and positions of all closed syncmers."""
    n = len(cp) - S + 1
    if len(cp) < K:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = cp[:n].astype(np.uint64)
    for i in range(1, S):
        h = h * MULTIPLIER + cp[i : i + n]
    h = mix(h)
    width = K - S + 1
    least, have = h, 1
    while 2 * have <= width:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    m = len(least)
    at = np.flatnonzero((h[:m] == least) | (h[K - S : K - S + m] == least))
    key = mix((h[at] * MULTIPLIER + h[at + _STEP]) * MULTIPLIER + h[at + K - S])
    return key >> np.uint64(32), at


def sketch(text: str, anchors: Anchors) -> Anchors:
    """The SIZE anchors of smallest hash, each at its first position; a text without any stands as one anchor."""
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, at = anchors
    if not len(h):
        return np.array([xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 32], np.uint64), np.zeros(1, np.int64)
    if len(h) > 4 * SIZE:
        keep = h <= np.partition(h, 4 * SIZE)[4 * SIZE]
        if len(np.unique(h[keep])) >= SIZE:
            h, at = h[keep], at[keep]
    h, first = np.unique(h, return_index=True)
    return h[:SIZE], at[first[:SIZE]]


def edited_anchors(own: np.ndarray, mine: Anchors, other: np.ndarray, others: Anchors) -> Anchors:
    """Anchors of the text that has other's beginning in place of its second half: those that lie within either part
    are already known, only the k-mers across the seam are new."""
    keep, take = len(own) - len(own) // 2, min(len(own) // 2, len(other))
    left, right = mine[1] + K <= keep, others[1] + K <= take
    a = max(0, keep - K + 1)
    seam, at = syncmers(np.concatenate([own[a:keep], other[: min(take, K - 1)]]))
    return np.concatenate([mine[0][left], seam, others[0][right]]), np.concatenate([mine[1][left], at + a, others[1][right] + keep])


def to_string(s: Anchors) -> str:
    return ",".join(f"{h:08x}@{p}" for h, p in zip(s[0].tolist(), s[1].tolist(), strict=True))


def from_string(s: str) -> Anchors:
    pairs = [x.split("@") for x in s.split(",")] if s else []
    return np.array([int(h, 16) for h, _ in pairs], np.uint64), np.array([int(p) for _, p in pairs], np.int64)


def likeness(a: Anchors, b: Anchors) -> float:
    """Estimated Jaccard similarity of two texts' anchors, counting those in common whose shift is near the median one.

    From 0 to 1; 1 for equal fingerprints, empty ones included.
    """
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.union1d(a[0], b[0])
    if len(a[0]) >= SIZE or len(b[0]) >= SIZE:  # beyond the last hash of a full sketch the other's hashes can't be judged
        last = min(x[0][-1] for x in (a, b) if len(x[0]) >= SIZE)
        both, i, j = both[both <= last], i[common <= last], j[common <= last]
    if not len(i):
        return 0.0
    shift = a[1][i] - b[1][j]
    spread = np.abs(shift - np.median(shift))
    return float((spread <= 64 + max(a[1].max(), b[1].max()) // 16).sum() / len(both))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text), as SCHEMA has it.

    A text is compared with the next document's, by descending doc_id (null ids last; rows of equal ids by descending
    text; after the last one the first), and with its own edited form: its last floor(n_chars / 2) code points replaced
    by as many of the next one's first, or all of them. A null text counts as empty; an empty text has an empty
    fingerprint, a text without syncmers that of its whole. Other columns are ignored. No rows give no rows.

    Rows are dealt into ranges of doc_id; each range also gets a copy of the row that follows its last one, so that
    texts are shuffled once and no range depends on another.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.coalesce("doc_id", F.lit(lowest)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("k").repartitionByRange(4 * parts, "k")
    ends = sorted(tuple(r) for r in ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("k"), F.max("k")).select("min(k)", "max(k)").collect())
    if not ends:
        return spark.createDataFrame([], SCHEMA)
    lows = [lo for lo, _ in ends]
    # two steps of a search: first among every so many lower ends, then among those between
    wide = max(1, int(len(lows) ** 0.5))
    groups = [lows[i : i + wide] for i in range(0, len(lows), wide)]
    literal = lambda x: "array(" + ",".join(f"{v}L" if v > lowest else f"(-{(1 << 63) - 1}L - 1L)" for v in x) + ")"
    coarse = f"size(filter({literal([g[0] for g in groups])}, x -> x <= k))"
    fine = f"size(filter(element_at(array({','.join(map(literal, groups))}), g), x -> x <= k))"
    placed = docs.withColumn("g", F.expr(coarse)).withColumn("bucket", F.expr(f"(g - 1) * {wide} + {fine} - 1")).drop("g")
    last = F.col("k").isin([hi for _, hi in ends])
    copies = F.when(last, F.array(F.col("bucket"), F.pmod(F.col("bucket") + 1, F.lit(len(lows))))).otherwise(F.array("bucket"))
    rows = placed.select("doc_id", "k", "text", F.posexplode(copies).alias("ghost", "bucket"))
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "ghost", F.desc("k"), F.desc("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, bucket = None, None
        out: list[tuple] = []

        def finish(row: tuple, after: tuple) -> None:
            i, text, cp, anchors, own = row
            keep = len(cp) - len(cp) // 2
            edited = text[:keep] + after[1][: len(cp) // 2]
            new = sketch(edited, edited_anchors(cp, anchors, after[2], after[3]))
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((i, len(cp), digest, to_string(own), to_string(new), likeness(own, new), likeness(own, after[4])))

        def flush() -> pa.RecordBatch:
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            cols = list(zip(*out, strict=True)) or [[]] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for batch in batches:
            for i, text, ghost, b in zip(*batch.columns, strict=True):
                i, text, ghost, b = i.as_py(), text.as_py(), ghost.as_py(), b.as_py()
                if b != bucket:
                    waiting, bucket = None, b
                if ghost and waiting is None:
                    continue  # a second copy: rows of equal ids
                cp = code_points(text)
                anchors = syncmers(cp)
                row = (i, text, cp, anchors, sketch(text, anchors))
                if waiting is not None:
                    finish(waiting, row)
                waiting = None if ghost else row
                if len(out) >= 1000:
                    yield flush()
        yield flush()

    return arrow_map(rows.select("doc_id", "text", "ghost", "bucket"), run, SCHEMA)
