"""Fill-in-the-middle samples by an index of distinct texts.

Documents of identical texts share one index row, to which they are joined by their text's digest. The byte offsets of the
text's code points are put into an Elias-Fano list once per index row, as its documents follow each other there, and each
document's two seeded cuts are looked up in the list, so that no text is decoded to be cut. A list of m ascending numbers below u keeps each number's low bits as they are
and its high part, plus its place, as a one in a bit string, with the ones before every block counted; the i-th number is read in one block.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, BATCH_ROWS, HOT_SHARE, at_most

#: Bytes of the bit string between counts.
BLOCK = 64
#: Numbers that are put in at a time.
CHUNK = 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def elias_fano(values: Iterator[np.ndarray], m: int, u: int) -> bytes:
    """m ascending numbers from 0 to u, given in arrays."""
    low = max(0, (u // max(m, 1)).bit_length() - 1)
    high = np.zeros((u >> low) + m + 1, np.bool_)
    lows = np.zeros(m * low, np.bool_)
    i = 0
    for v in values:
        high[(v >> low) + np.arange(i, i + len(v))] = True
        for k in range(low):
            lows[np.arange(i, i + len(v)) * low + k] = (v >> k) & 1
        i += len(v)
    bits, rest = np.packbits(high), np.packbits(lows)
    ones = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), np.arange(0, len(bits), BLOCK))
    before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<i8")
    return struct.pack("<qqqq", m, low, len(before), len(bits)) + before.tobytes() + bits.tobytes() + rest.tobytes()


def select(packed: bytes, i: int) -> int:
    """The i-th number (from 0) of an elias_fano() list."""
    m, low, blocks, size = struct.unpack_from("<qqqq", packed)
    if not 0 <= i < m:
        raise IndexError(i)
    before = np.frombuffer(packed, "<i8", blocks, 32)
    b = int(np.searchsorted(before, i, "right")) - 1
    at = 32 + 8 * blocks
    block = np.frombuffer(packed, np.uint8, min(BLOCK, size - b * BLOCK), at + b * BLOCK)
    place = b * BLOCK * 8 + int(np.flatnonzero(np.unpackbits(block))[i - int(before[b])])
    value = (place - i) << low
    for k in range(low):
        bit = i * low + k
        value |= (packed[at + size + bit // 8] >> (7 - bit % 8) & 1) << k
    return value


def length(packed: bytes) -> int:
    return struct.unpack_from("<q", packed)[0]


def boundaries(text: bytes | pa.Buffer) -> bytes:
    """Where the code points of a UTF-8 text begin, and its end."""
    b = np.frombuffer(text, np.uint8)
    starts = lambda at: np.flatnonzero((b[at : at + CHUNK] & 0xC0) != 0x80) + at
    m = sum(int(((b[at : at + CHUNK] & 0xC0) != 0x80).sum()) for at in range(0, len(b), CHUNK)) + 1

    def values() -> Iterator[np.ndarray]:
        for at in range(0, len(b), CHUNK):
            yield starts(at)
        yield np.array([len(b)])

    return elias_fano(values(), m, len(b))


_CUTS = "n long, prefix long, reach long, begin long, end long"


def _cuts(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of each (digest, text, h1, h2): code points, the two cuts in code points, and in bytes. Rows of one digest follow each
    other: their text's list is built once."""
    own, packed = None, b""
    for digests, texts, h1, h2 in parts:
        out = []
        for digest, text, x, y in zip(digests.to_pylist(), texts, h1.to_pylist(), h2.to_pylist(), strict=True):
            if digest != own:
                own, packed = digest, boundaries(text.as_buffer())
            m = length(packed)
            a, b = sorted((x % m, y % m))
            out.append((m - 1, a, b, select(packed, a), select(packed, b)))
        names = [c.split()[0] for c in _CUTS.split(", ")]
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 5, names)


def text_index(docs: DataFrame) -> DataFrame:
    """The distinct texts of docs(digest, salt, text): digest, salt and text.

    A digest stands for one text: its rows have to agree in length and in a second hash, or the job ends in an error.
    """
    same = F.struct(F.length(F.col("text").cast("binary")).alias("bytes"), F.xxhash64("text").alias("hash"))
    found = docs.groupBy("digest", "salt").agg(F.first("text").alias("text"), F.min(same).alias("lo"), F.max(same).alias("hi"))
    checked = F.when(F.col("lo") == F.col("hi"), F.col("text")).otherwise(F.raise_error(F.lit("two texts have one digest")))
    return found.select("digest", "salt", checked.alias("text"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of fill_in_middle() was made from. Its text has no marker, so the first ones found are the
    right ones."""

    def part(first: str, second: str) -> tuple[Column, Column, Column]:
        i = F.position(F.lit(first), output, F.lit(4))
        j = F.position(F.lit(second), output, i + 3)
        return output.substr(F.lit(4), i - 4), output.substr(i + 3, j - i - 3), output.substr(j + 3, F.length(output))

    prefix, suffix, middle = part(SUFFIX, MIDDLE)
    suffix_, prefix_, middle_ = part(PREFIX, MIDDLE)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_share: int = 10, spm_share: int = 20) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null
    if plain) and output.

    Four numbers h1 to h4, the first 8-digit groups of the hex sha256 of `seed:doc_id`, decide: the prefix ends after
    the smaller of h1 % (n + 1) and h2 % (n + 1) code points, the middle after the larger; plain_share percent stay plain, by h3,
    and so do empty texts and those that hold a marker; spm_share percent of the others are spm, by h4. The output is the text, or
    `<P>`prefix`<S>`suffix`<M>`middle (psm), or `<S>`suffix`<P>`prefix`<M>`middle (spm).

    A null text counts as empty; a null doc_id as no digits. Repeated rows give repeated rows, rows of one doc_id and
    different texts each their own. Other columns are ignored; an empty table gives no rows. Texts are shuffled once, each map
    task sending one copy of each; a text with at least HOT_SHARE of all rows has as many index rows as its
    documents have shares, so that no task joins more than about one share of them.
    """
    conf = docs.sparkSession.conf
    at_most(conf, "spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    at_most(conf, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    counts = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"))
    share = max(2.0, (rows.agg(F.count(F.lit(1))).first()[0] or 0) * HOT_SHARE)
    # at most 1 / HOT_SHARE rows, by arithmetic
    hot = counts.where(F.col("copies") >= share).select("hash", F.ceil(F.col("copies") / share).alias("salts"))
    rows = rows.join(F.broadcast(hot), "hash", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit("fim")), F.coalesce("salts", F.lit(1))))
    rows = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), "salt", "text")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(drawn, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    # both sides are dealt out by (digest, salt), and Python comes behind the join: it would lose that and shuffle texts again
    index = text_index(rows.select("digest", "salt", "text")).hint("merge")
    out = rows.select("doc_id", "digest", "salt", *numbers).join(index, ["digest", "salt"])
    out = out.withColumn("cut", F.arrow_udf(_cuts, _CUTS)("digest", F.col("text").cast("binary"), "h1", "h2"))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("cut.n") == 0) | marked | (F.col("h3") % 100 >= 100 - plain_share)
    form = F.when(plain, F.lit("plain")).when(F.col("h4") % 100 < spm_share, F.lit("spm")).otherwise(F.lit("psm"))
    raw, begin, end = F.col("text").cast("binary"), F.col("cut.begin").cast("int"), F.col("cut.end").cast("int")
    cut = lambda at, n: F.substr(raw, at + 1, n).cast("string")
    prefix, middle, suffix = cut(F.lit(0), begin), cut(begin, end - begin), cut(end, F.length(raw))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    output = output.otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    chars = lambda c: F.when(F.col("form") != "plain", c)
    return out.withColumn("form", form).select("doc_id", F.col("cut.n").alias("n"), "form", chars(F.col("cut.prefix")).alias("prefix_chars"), chars(F.col("cut.reach") - F.col("cut.prefix")).alias("middle_chars"), output.alias("output"))
