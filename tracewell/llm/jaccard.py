"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact intersection of sorted arrays.

1. Every text becomes a set of 64-bit shingle hashes. Equal sets form a class with a number of its own; one document
   of it goes on.
2. Shingles that many documents share are counted over all texts; they come last in the order in which a set's
   prefix is chosen. Sets of similarity t share a shingle within their prefixes of n - ceil(t * n) + 1 shingles
   whatever the order, so no link is lost.
3. A star pass proposes for each set the smallest document with an equal pair of minimum hashes. Sets that lean on
   the same star are not compared with each other again, which keeps large groups of near copies linear.
4. A tile holds the sets of two neighbouring size bands that share a prefix shingle; large ones are cut into blocks,
   and each pair of blocks is a tile of its own. For a tile's pairs, once each, bit counts of the bitmaps bound the
   overlap from above: a bit that is set in one bitmap only stands for at least one shingle that the other set lacks.
5. Pairs that pass are compared exactly, those with stars included: a star that fails doesn't count.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, arrow_map, bit_filter, chunks, components, drop, hash_words, materialise, mix, window_hashes

#: Shingles that come up so often within a batch of documents are counted for the order of prefixes.
OFTEN = 4
#: The order knows at most so many frequent shingles (8 bytes each in a broadcast); it is a matter of speed only.
FREQUENT = 1 << 17
#: Documents of a tile's block.
BLOCK = 1024
#: Sets behind a shingle from which on its tiles carry bitmaps.
FULL = 8
STARS = 4
_BATCH = 2048

_ODD = np.array([int.from_bytes(bytes([17 * i + 13 & 255, 91 * i + 7 & 255, 43 * i + 101 & 255, 29 * i + 3 & 255, 211 * i + 57 & 255, 5 * i + 199 & 255, 149 * i + 31 & 255, 67 * i + 11 & 255]), "little") | 1 for i in range(1, 2 * STARS + 1)], np.uint64)


def shingles(text: bytes | None, width: int, cache: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles, ASCII letters lower-cased, words split at ASCII space.

    Fewer words than width: the whole sequence as one shingle. No word: empty.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = hash_words(words, cache)
    return np.unique(window_hashes(h, min(width, len(h))))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def bitmap(s: np.ndarray) -> np.ndarray:
    """Bits by hash, as many as the least power of two from 2 n on, 64 to 65,536."""
    bits = min(1 << 16, max(64, 1 << math.ceil(math.log2(2 * max(1, len(s))))))
    out = np.zeros(bits >> 3, np.uint8)
    at = (s >> np.uint64(20)) & np.uint64(bits - 1)
    np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))
    return out


def may_link(n: int, x: bytes, m: int, y: bytes, percent: int) -> bool:
    """Whether sets of n and m shingles with these bitmaps can link: their overlap is bounded by bit counts.

    A bitmap of more bits is folded: bit i of the smaller one is the or of the bits that equal i modulo its size.
    """
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    size, other = 8 * len(x), 8 * len(y)
    while size > other:
        size >>= 1
        a = (a >> size) | (a & ((1 << size) - 1))
    while other > size:
        other >>= 1
        b = (b >> other) | (b & ((1 << other) - 1))
    most = min(n - (a & ~b).bit_count(), m - (b & ~a).bit_count())
    return 100 * most >= percent * (n + m - most)


_SEEN = "h long, n long"


def _frequent(texts: DataFrame, width: int) -> np.ndarray:
    """Hashes that come up often, over all texts, sorted; the most frequent ones if there are more than FREQUENT."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, pending, size = WordHash(), [], 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate(pending)
            pending.clear()
            every.sort()
            at = np.flatnonzero(np.concatenate([[len(every) > 0], every[1:] != every[:-1]]))
            n = np.diff(np.append(at, len(every)))
            keep = n >= OFTEN
            h = every[at]
            return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], ["h", "n"])

        for batch in chunks(batches, _BATCH):
            for t in batch.column(0):
                s = shingles(t.as_py(), width, cache)
                pending.append(s)
                size += len(s)
                if size >= 2_000_000:
                    yield flush()
                    size = 0
        if pending:
            yield flush()

    seen = arrow_map(texts.select(F.col("text").cast("binary")), count, _SEEN)
    top = seen.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= 2 * OFTEN).orderBy(F.desc("n"), "h").limit(FREQUENT)
    return np.sort(np.array([r[0] for r in top.select("h").collect()], np.int64).view(np.uint64))


_PROFILE = "doc_id long, n long, set_hash long, set_hash2 long, stars array<long>, prefix binary, bits binary"


def _profile(docs: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def profile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, often = WordHash(), shared.value
        for batch in chunks(batches, _BATCH):
            out: list[tuple] = []
            for t in batch.column(1):
                s = shingles(t.as_py(), width, cache)
                n = len(s)
                if not n:
                    out.append((0, 0, 0, None, None, None))
                    continue
                least = [int((s * m).min()) for m in _ODD]
                stars = [((least[2 * i] * 31 + least[2 * i + 1]) * 8 + i & (1 << 64) - 1) - (1 << 63) for i in range(STARS)]
                at = np.searchsorted(often, s)
                common = (often[np.minimum(at, len(often) - 1)] == s) if len(often) else np.zeros(n, bool)
                k = prefix_length(n, percent)
                first = np.concatenate([s[~common][:k], s[common][:k]])[:k]
                out.append((n, int(s.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(s * np.uint64(0xC2B2AE3D27D4EB4F))).view(np.int64)), stars, first.tobytes(), bitmap(s).tobytes()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["doc_id", "n", "set_hash", "set_hash2", "stars", "prefix", "bits"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), profile, _PROFILE)


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, words): the sorted set of each wanted (id, doc_id, set_hash), 8 bytes a shingle."""

    def arrays(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in chunks(batches, _BATCH):
            sets = [shingles(t.as_py(), width, cache) for t in batch.column(1)]
            h = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "set_hash", "words"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    found = arrow_map(bit_filter(rows, "doc_id", wanted, "doc_id"), arrays, "doc_id long, set_hash long, words binary")
    return found.join(wanted.hint("merge"), ["doc_id", "set_hash"]).dropDuplicates(["id"]).select("id", "words")


def _exact(pairs: DataFrame, docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link, by intersection of their sorted arrays."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = materialise(ids.join(reps.select("id", "doc_id", "set_hash"), "id"), "wanted")
    sets = materialise(_sets(docs, wanted, width), "sets")
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("words").alias("wa")).hint("merge"), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("words").alias("wb")).hint("merge"), "b")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, wa, wb = batch.columns
            keep = []
            for x, y in zip(wa, wb, strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both_have = int((y[at] == x).sum())
                keep.append(100 * both_have >= percent * (len(x) + len(y) - both_have))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    found = materialise(arrow_map(both.select("a", "b", "wa", "wb"), compare, "a long, b long"), "links")
    drop(pairs, wanted, sets)
    return found


def _tile_pairs(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a tile's rows whose sizes, places in the prefixes and bitmaps (if any) allow a link. Rows come sorted
    by tile.

    If a pair links, then at the first shingle that both prefixes have, no more than what follows it in either set can
    be shared; a pair that fails this at one shingle is left to the others.
    """

    def pairs(r: dict[str, np.ndarray]) -> pa.RecordBatch:
        n, bits = len(r["token"]), r["bits"]
        same = np.ones(max(n - 1, 0), bool)
        for k in _TILE:
            same &= r[k][1:] == r[k][:-1]
        last = np.append(np.flatnonzero(~same), n - 1)  # the last row of each tile
        end = last[np.searchsorted(last, np.arange(n))] if n else last
        out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        i, step = np.arange(n), 0
        while True:
            step += 1
            i = i[i + step <= end[i]]
            if not len(i):
                break
            j = i + step
            size_i, size_j = r["n"][i], r["n"][j]
            most = np.minimum(size_i - r["place"][i], size_j - r["place"][j])
            ok = (r["star"][i] != r["star"][j]) & (r["id"][i] != r["id"][j])
            ok &= (100 * np.minimum(size_i, size_j) >= percent * np.maximum(size_i, size_j)) & (100 * most >= percent * (size_i + size_j - most))
            ok &= np.maximum(r["band"][i], r["band"][j]) == r["tile_band"][i]
            ok &= (r["lo"][i] == r["hi"][i]) | (r["block"][i] != r["block"][j])
            i_ok, j_ok = i[ok], j[ok]
            if len(i_ok):
                keep = [bits[x] is None or may_link(int(r["n"][x]), bits[x], int(r["n"][y]), bits[y], percent) for x, y in zip(i_ok.tolist(), j_ok.tolist(), strict=True)]
                i_ok, j_ok = i_ok[keep], j_ok[keep]
            a, b = r["id"][i_ok], r["id"][j_ok]
            out_a.append(np.minimum(a, b))
            out_b.append(np.maximum(a, b))
        found = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        rows = {k: batch.column(k).to_numpy(zero_copy_only=False).astype(object if k == "bits" else np.int64) for k in batch.schema.names}
        if rest is not None:
            rows = {k: np.concatenate([rest[k], v]) for k, v in rows.items()}
        n = len(rows["token"])
        if not n:
            continue
        own = np.ones(n, bool)
        for k in _TILE:
            own &= rows[k] == rows[k][-1]
        cut = n - int(np.argmin(own[::-1])) if not own.all() else 0
        rest = {k: v[cut:] for k, v in rows.items()}
        if cut:
            yield pairs({k: v[:cut] for k, v in rows.items()})
    if rest is not None:
        yield pairs(rest)


_TILE = ("token", "lo", "hi", "tile_band")


def _candidates(reps: DataFrame, star_of: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) with different stars that share a prefix shingle and pass size, place and bitmap."""
    rows = reps.select("id", "n", "prefix").join(star_of.hint("merge"), "id")
    rows = arrow_map(rows, _explode, "token long, id long, n int, star long, place int")
    # the smaller set of a pair must have room for the overlap behind the shingle; the larger one has it further on
    small = (F.col("n") - F.col("place")) * (100 + percent) >= 2 * percent * F.col("n").cast("long")
    seen = rows.groupBy("token").agg(F.min("star").alias("lo"), F.max("star").alias("hi"), F.count("*").alias("c"), F.max(small).alias("small"))
    shared = materialise(seen.where("lo <> hi and small").select("token", "c"), "tokens")
    growth = math.log(100 / min(percent, 99))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(growth) + F.lit(1e-9)).cast("int")
    rows = bit_filter(rows, "token", shared, "token").join(shared.hint("merge"), "token")
    # bitmaps travel with the rows of well-filled tiles only; the few pairs of the others meet theirs afterwards
    bits = reps.select(F.col("id").alias("of"), "bits").hint("merge")
    rows = rows.join(bits, (F.col("id") == F.col("of")) & (F.col("c") >= FULL), "left").drop("of")
    rows = rows.withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("band", band)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.withColumn("tile_band", F.explode(F.when(small, F.array(F.col("band"), F.col("band") + 1)).otherwise(F.array("band"))))
    rows = rows.select("token", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "tile_band", "id", "n", "star", "block", "place", "band", "bits")
    rows = rows.repartition(*_TILE).sortWithinPartitions(*_TILE)
    found = arrow_map(rows, lambda it: _tile_pairs(it, percent), "a long, b long")
    out = _bounded(found.distinct(), reps, percent)
    drop(shared)
    return out


def _explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, _BATCH // 4):
        tokens = [np.frombuffer(p.as_buffer(), np.int64) for p in batch.column("prefix")]
        count = np.array([len(t) for t in tokens], np.int64)
        if count.sum():
            at = pa.array(np.repeat(np.arange(len(count)), count))
            place = np.concatenate([np.arange(c, dtype=np.int32) for c in count])
            own, n, star = (batch.column(c).take(at) for c in ("id", "n", "star"))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), own, n.cast(pa.int32()), star, pa.array(place)], ["token", "id", "n", "star", "place"])


def ngram_jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles (size of its set), component_id.

    component_id is the smallest doc_id that the document reaches by links, itself included. Two documents link when
    100 * intersection >= percent * union of their sets. A null or empty text, or one without words, has an empty set
    and links with nothing. Equal sets always link. Rows that repeat a doc_id with other texts are texts of one
    document: whatever one of them links with, the others reach. A null doc_id links with nothing and has a null
    component_id. Other columns are ignored. An empty table gives no rows. Sets hold 64-bit hashes of shingles.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = _frequent(docs, width)
    all_rows = materialise(_profile(docs, width, percent, frequent), "profiles")
    linkable = F.expr("n > 0 and doc_id is not null")
    full, key = all_rows.where(linkable), ["set_hash", "set_hash2", "n"]
    # numbers are unique whichever task wrote them, and fixed once the table is written; they rise with doc_id, as the
    # smallest document of a group is its star: copies mostly come after what they were copied from
    classes = full.groupBy(*key).agg(F.min("doc_id").alias("doc_id")).orderBy("doc_id").withColumn("id", F.monotonically_increasing_id())
    classes = materialise(classes, "classes")
    reps = materialise(full.join(classes.hint("merge"), [*key, "doc_id"]).dropDuplicates(["id"]), "reps")

    keys = reps.select("id", F.explode("stars").alias("k"))
    lead = materialise(keys.groupBy("k").agg(F.min("id").alias("a"), F.count("*").alias("c")).where("c > 1").select("k", "a"), "leads")
    leaning = bit_filter(keys, "k", lead, "k").join(lead.hint("merge"), "k").where("a <> id").select("a", F.col("id").alias("b")).distinct()
    leaning = _bounded(leaning, reps, percent)
    drop(lead)
    links = _exact(leaning, docs, reps, width, percent)
    pointer = links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("star"))
    star_of = materialise(reps.select("id").join(pointer.hint("merge"), "id", "left").select("id", F.coalesce("star", "id").alias("star")), "stars")
    hop = star_of.select(F.col("id").alias("star"), F.col("star").alias("next"))
    two_hops = materialise(star_of.join(hop.hint("merge"), "star").select("id", F.col("next").alias("star")), "stars2")
    drop(star_of)
    more = _exact(_candidates(reps, two_hops, percent), docs, reps, width, percent)
    drop(reps, two_hops)

    found = components(links.unionByName(more).unionByName(_same_document(full, classes, key)))
    drop(links, more)
    member = classes.join(found.hint("merge"), F.col("id") == F.col("node"), "left").select(*key, "doc_id", F.coalesce("component", "id").alias("component"))
    least = member.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    chosen = materialise(member.drop("doc_id").join(least.hint("merge"), "component").select(*key, "component_id"), "chosen")
    drop(found, classes)
    linked = full.select("doc_id", *key).join(chosen.hint("merge"), key).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = all_rows.where(~linkable | linkable.isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def _same_document(full: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """Edges between the classes of each doc_id that comes with several rows; mostly none."""
    repeated = materialise(full.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "repeated")
    rows = bit_filter(full.select("doc_id", *key), "doc_id", repeated, "doc_id").join(repeated.hint("merge"), "doc_id").distinct()
    rows = rows.join(classes.select(*key, "id").hint("merge"), key).select("doc_id", "id")
    first = rows.groupBy("doc_id").agg(F.min("id").alias("a"))
    return rows.join(first.hint("merge"), "doc_id").select("a", F.col("id").alias("b")).where("a <> b")


def _bounded(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and bitmaps allow a link."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"m{x}")).hint("merge")

    def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, ma, mb = batch.columns
            keep = []
            for i, j, x, y in zip(na.to_pylist(), nb.to_pylist(), ma.to_pylist(), mb.to_pylist(), strict=True):
                keep.append(100 * min(i, j) >= percent * max(i, j) and may_link(i, x, j, y, percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ma", "mb")
    return materialise(arrow_map(both, test, "a long, b long"), "leaning")
