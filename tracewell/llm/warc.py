"""WARC archives with revisit records: written, read back, resolved.

Writing: payload digests are grouped (headers only) to find, for each payload that occurs more than once, the record
that keeps it. Every page becomes a response record with its payload or a revisit record without one, with fresh
headers either way. Archives are written by Spark's own committed writer, so a lost executor leaves no half a file:
records are valid UTF-8 text, and the writer's line separator is the empty line with which a WARC record ends.

Reading: archives are streams that Spark cuts where a record seems to begin; the pieces are put together again by
Content-Length, so that a payload which looks like a record's beginning stays whole, and a task holds a record at a
time and not a file. Headers are shuffled by payload digest, and revisit records joined to the original response that
they name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, at_most, materialise, new_path, skewed_left_join

CRLF = "\r\n"
#: Payloads below this many bytes are always written in full.
LEAST_BYTES = 100
#: Records of an archive file and, on average, its bytes before compression: one task reads it, as a stream.
FILE_RECORDS = 20_000
FILE_BYTES = 128 << 20
#: Between records: the empty lines that end one and the line that begins the next.
BETWEEN = CRLF * 2 + "WARC/1.1" + CRLF
#: Rows that Spark reads at a time where payloads may be large.
READ_ROWS = 128
#: Bytes of payloads that go back to Spark at a time.
SEND_BYTES = 16 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page: Column, digest: Column) -> Column:
    """A urn:uuid that depends on the page's id and payload alone."""
    h = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("")), digest))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def _clean(c: Column) -> Column:
    """A value without line breaks, as a header needs it."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")


def plan_records(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with payload, payload_bytes, payload_digest and refers_to.

    refers_to: of records with equal payloads of at least LEAST_BYTES, the smallest page_id, for all others; else
    null. A null html is an empty payload. A row with a null page_id keeps its payload. Rows that repeat a page_id and
    its payload are alike: all of them keep it, if it is the smallest.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2(F.col("payload").cast("binary"), 256))
    heads = rows.where((F.col("payload_bytes") >= LEAST_BYTES) & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    first = heads.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    out = skewed_left_join(rows, materialise(first, "first"), ["payload_digest"], "n", ["page_id"])
    return out.withColumn("refers_to", F.when(F.col("first") < F.col("page_id"), F.col("first"))).drop("first")


def file_records(pages: DataFrame) -> int:
    """How many records a file may have, so that files of pages of this average size keep to FILE_BYTES."""
    average = pages.agg(F.avg(F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit(""))))).first()[0] or 0
    return max(1, min(FILE_RECORDS, int(FILE_BYTES // (average + 700))))


def write_archives(pages: DataFrame, path: str, date: str | None = None) -> None:
    """Writes pages(page_id, url, html) as gzip-compressed WARC 1.1 files into the folder path, one gzip member a file;
    date (now, where none is given) is the records' WARC-Date."""
    at_most(pages.sparkSession.conf, "spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = plan_records(pages)
    digest, revisit = F.col("payload_digest"), F.col("refers_to").isNotNull()
    lines = lambda *x: F.concat_ws(CRLF, *x)
    field = lambda name, value: F.concat(F.lit(name + ": "), value)
    http = lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), field("Content-Length", F.col("payload_bytes").cast("string")), F.lit(""), F.lit(""))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    uri = _clean(F.col("url"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    common = [F.lit("WARC/1.1"), field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), field("WARC-Record-ID", _record_id(F.col("page_id"), digest)), field("WARC-Date", F.lit(date)), field("WARC-Target-URI", uri), field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)), field("X-Page-ID", page)]
    first = [F.when(revisit, field("WARC-Profile", F.lit(_PROFILE))), F.when(revisit, field("WARC-Refers-To", _record_id(F.col("refers_to"), digest)))]
    head = lines(*common, *first, F.lit("Content-Type: application/http; msgtype=response"), field("Content-Length", F.octet_length(block).cast("string")), F.lit(""), F.lit(""))
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", file_records(pages)).text(path)


def parse(pieces: Iterable[tuple[object, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of uncompressed archives that were cut at BETWEEN: pieces (file, bytes), those of a
    file in order and one file after the other. Header names come in lower case."""
    between, file, held, size, need = BETWEEN.encode(), None, [], 0, 0

    def ended() -> None:
        if (left := b"".join(held)) not in (b"", b"\r\n\r\n"):
            raise ValueError(f"an archive ends within a record: {left[:80]!r}")

    for of, piece in pieces:
        if of != file:
            ended()
            file, held, size, need = of, [piece], len(piece), 0
        else:
            held += [between, piece]
            size += len(between) + len(piece)
        while size >= need and size > 4:
            data = b"".join(held)
            at = 4 if data.startswith(b"\r\n\r\n") else 0  # the end of the record before
            end = data.find(b"\r\n\r\n", at)
            if end < 0:
                held, need = [data], size + 1
                break
            top, *rest = data[at:end].decode("utf-8", "replace").split(CRLF)
            if not top.startswith("WARC/"):
                raise ValueError(f"no WARC record: {data[at : at + 80]!r}")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}
            stop = end + 4 + int(head["content-length"])
            if size < stop:
                held, need = [data], stop
                break
            yield head, data[end + 4 : stop]
            held, size, need = [data[stop:]], size - stop, 0
    ended()


HEADS = "page_id long, record_type string, record_id string, refers string, payload_digest string, payload_bytes long"


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of all archives in a folder: HEADS, and by payloads the payload (null for revisits).

    payload_digest and payload_bytes of a response are taken from the payload itself; those of a revisit are what its
    header says, and null.
    """
    names, types = [c.split()[0] for c in HEADS.split(", ")], [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
    if payloads:
        names, types = [*names, "payload"], [*types, pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def send() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        pieces = ((f.as_py(), v.as_py()) for batch in batches for f, v in zip(batch.column(0), batch.column(1), strict=True))
        for head, block in parse(pieces):
            body = block[block.index(b"\r\n\r\n") + 4 :]
            full = head["warc-type"] == "response"
            page = head.get("x-page-id")
            row = (int(page) if page else None, head["warc-type"], head["warc-record-id"], head.get("warc-refers-to"), hashlib.sha256(body).hexdigest() if full else head["warc-payload-digest"].removeprefix("sha256:"), len(body) if full else None)
            out.append((*row, body if full else None) if payloads else row)
            size += len(body) if payloads else 0
            if len(out) >= 1000 or size >= SEND_BYTES:
                yield send()
                size = 0
        if out:
            yield send()

    lines = spark.read.option("lineSep", BETWEEN).option("pathGlobFilter", "*.txt*").text(path)
    rows = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return arrow_map(rows, run, HEADS + (", payload binary" if payloads else ""))


def resolve(heads: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Revisits take the size and the page_id of the response that they name; those whose response isn't there keep nulls.
    """
    heads = materialise(heads, "heads")
    revisits = heads.where("record_type = 'revisit'")
    needed = revisits.groupBy("payload_digest", "refers").agg(F.count("*").alias("n"))
    original = heads.where("record_type = 'response'").groupBy("payload_digest", F.col("record_id").alias("refers")).agg(F.min("page_id").alias("original"), F.max("payload_bytes").alias("size"))
    found = materialise(needed.join(original, ["payload_digest", "refers"]), "originals")
    out = skewed_left_join(revisits, found, ["payload_digest", "refers"], "n", ["page_id"])
    out = out.select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", F.col("original").alias("refers_to"))
    full = heads.where("record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return full.unionByName(out)


def warc_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes pages(page_id, url, html) as archives (into path, or a new folder of the shared one), reads them back and
    resolves the revisits: one row per page, as resolve() has it. Payloads may be long: a task holds one at a time, and
    READ_ROWS of them where it reads pages. Null html is an empty payload; a null url an empty
    one; repeated rows give repeated records. An empty table gives no rows. Other columns are ignored."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path)
    return resolve(read_archives(spark, path))
