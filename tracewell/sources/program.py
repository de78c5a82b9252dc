"""Program sources: PLCopen XML, JSON tables, snapshots and incident events, CSV timelines."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import unwrap_snapshot


def read_plcopen(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, ports, code) of each program unit in PLCopen XML; ports are structs (direction, name, type)."""
    schema = """_name string, _pouType string,
        interface struct<inputVars: struct<variable: array<struct<_name: string, type: string>>>, outputVars: struct<variable: array<struct<_name: string, type: string>>>, localVars: struct<variable: array<struct<_name: string, type: string>>>>,
        body struct<ST: string>"""
    rows = spark.read.format("xml").option("rowTag", "pou").option("ignoreNamespace", "true").schema(schema).load(path)
    empty = F.lit(None).cast("array<struct<direction:string,name:string,type:string>>")

    def ports(kind: str, direction: str) -> Column:
        found = F.transform(F.col(f"interface.{kind}.variable"), lambda v: F.struct(F.lit(direction).alias("direction"), v["_name"].alias("name"), F.trim(F.regexp_replace(v["type"], r"<(\w+)[^>]*>|\s+", "$1")).alias("type")))
        return F.coalesce(found, empty, F.array().cast("array<struct<direction:string,name:string,type:string>>"))

    code = F.trim(F.regexp_replace(F.coalesce("body.ST", F.lit("")), r"</?[\w:]+[^>]*>", ""))
    return rows.select(F.col("_name").alias("name"), F.col("_pouType").alias("kind"), F.concat(ports("inputVars", "Input"), ports("outputVars", "Output"), ports("localVars", "Local")).alias("ports"), code.alias("code"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Multi-line JSON objects; a path that isn't there gives no rows, as optional inputs may be missing."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def channels(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, channel, bit_address, byte, bit) of channel elements in XML text, by regular expressions."""
    rows = df.select(key, F.explode(F.regexp_extract_all(xml, F.lit(r'(<Channel\b[^>]*>)'), F.lit(1))).alias("c"))
    at = F.regexp_extract("c", r'bitAddress="(\d+)"', 1)
    return rows.where(at != "").select(key, F.regexp_extract("c", r'name="([^"]*)"', 1).alias("channel"), at.cast("int").alias("bit_address")).withColumn("byte", F.expr("bit_address div 8")).withColumn("bit", F.expr("pmod(bit_address, 8)"))


def incidents(raw: DataFrame, text: str = "value") -> DataFrame:
    """Incident events in one form: bare payloads or wrapped ones, alias keys, snapshots as objects or marked text.

    unread tells whether a snapshot is wrapped more than MOST_NESTED times, so that its variables weren't reached.
    """
    v = F.try_parse_json(text)
    rows = raw.select(v.alias("v"))
    get = lambda path: F.expr(f"try_variant_get(v, '{path}', 'string')")
    either = lambda *names: F.coalesce(*[get(f"$.payload.{n}") for n in names], *[get(f"$.{n}") for n in names])
    rows = rows.select(either("correlationId", "corr").alias("corr"), get("$.type").alias("type"), either("processName", "process").alias("process"), either("summary").alias("summary"), either(*SNAPSHOT_KEYS[:3]).alias("snapshot"))
    for _ in range(MOST_NESTED):  # each round takes one level of wrapping off: marks, or an object below one of the keys
        inner = F.coalesce(F.try_parse_json("snapshot"), F.try_parse_json(unwrap_snapshot("snapshot")))
        rows = rows.withColumn("__v", inner).withColumn("snapshot", F.coalesce(*[F.expr(f"try_variant_get(__v, '$.{k}', 'string')") for k in SNAPSHOT_KEYS], "snapshot")).drop("__v")
    rows = rows.withColumn("snapshot", F.coalesce(F.try_parse_json("snapshot"), F.try_parse_json(unwrap_snapshot("snapshot"))))
    more = F.coalesce(*[F.expr(f"try_variant_get(snapshot, '$.{k}', 'string')") for k in SNAPSHOT_KEYS])
    return rows.withColumn("unread", F.expr("try_variant_get(snapshot, '$.vars', 'string')").isNull() & more.isNotNull())


# Keys under which a snapshot may be nested.
SNAPSHOT_KEYS = ("plcSnapshot", "snapShot", "snapshot", "payload")
MOST_NESTED = 4


def snapshot_vars(events: DataFrame) -> DataFrame:
    """(corr, id, t, v) of the snapshots' variables; values as text, tags in lower case. Missing vars give no rows."""
    rows = events.select("corr", F.explode(F.expr("try_variant_get(snapshot, '$.vars', 'array<struct<id:string,t:string,v:variant>>')")).alias("x"))
    return rows.select("corr", F.regexp_replace("x.id", r"^ns=\d+;s=", "").alias("id"), F.lower("x.t").alias("t"), F.expr("cast(x.v as string)").alias("v"))


def search_snapshot(variables: DataFrame, needle: str, exact: bool = False, most: int = 20) -> DataFrame:
    """Variables whose id is the needle or ends in .needle (exact), or has it anywhere; the first most by id."""
    hit = (F.col("id") == needle) | F.col("id").endswith("." + needle) if exact else F.lower("id").contains(needle.lower())
    return variables.where(hit).orderBy("corr", "id").limit(most)


# Display types are matched by their parts in this order, unsigned ones before signed ones.
TYPE_TAGS = (("bool", "bool"), ("uint16", "uint16"), ("uint32", "uint32"), ("uint64", "uint64"), ("int16", "int16"), ("int32", "int32"), ("int64", "int64"), ("float", "float"), ("double", "float"), ("string", "string"))


def type_tag(c: str) -> Column:
    """The tag of a display type such as "STRING (-> String)"; null where nothing fits."""
    out: Column = F.lit(None).cast("string")
    for part, tag in reversed(TYPE_TAGS):
        out = F.when(F.lower(F.col(c)).contains(part), tag).otherwise(out)
    return out


def snapshot_json(rows: DataFrame, variables: DataFrame) -> DataFrame:
    """(corr, json) with the flat form {"rows": [...], "vars": [...]}, in order of ids."""
    nest = lambda df, name, *cols: df.groupBy("corr").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    both = nest(rows, "rows", "id", "t", "nodeClass").join(nest(variables, "vars", "id", "t", "v"), "corr", "full_outer")
    return both.select("corr", F.to_json(F.struct("rows", "vars")).alias("json"))


def typed_snapshot(variables: DataFrame) -> DataFrame:
    """(corr, and a map from id to value per type tag) of snapshot_vars(): bools, strings, numbers by width, floats.

    Unsigned numbers have the next wider type, those of 64 bits a decimal. Values that don't fit their tag are null;
    tags that aren't known have no map, as what they hold has no type.
    """
    kinds = {"bool": "boolean", "string": "string", "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "bigint", "int64": "bigint", "uint64": "decimal(20,0)", "float": "double"}
    column = lambda tag, kind: F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("t") == tag, F.struct(F.col("id"), F.col("v").try_cast(kind).alias("v")))))).alias(f"{tag}s")
    return variables.groupBy("corr").agg(*[column(t, k) for t, k in kinds.items()])


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object per line, with null fields written out, so that read_json() gives the rows back."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Appends rows, quotes doubled inside quotes, lines ended by CR LF. The header stands in a file of its own, which is
    written with the first rows only and sorts before all others: joined in order of names, the files have it once."""
    spark = df.sparkSession
    head = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/0-header.csv")
    fs = head.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("append").option("quote", '"').option("escape", '"').option("lineSep", "\r\n").csv(path)
    if not fs.exists(head):
        quoted = ['"' + c.replace('"', '""') + '"' if any(x in c for x in '",\r\n') else c for c in df.columns]
        out = fs.create(head, False)
        try:
            out.write(bytearray((",".join(quoted) + "\r\n").encode()))
        finally:
            out.close()


_BRACES = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)


def pair_stream(text: str) -> list[tuple[str, str]]:
    """(iri, json) pairs of a text that has an IRI's line and then a JSON object, again and again; outer quotes go.

    A line that no object follows gives nothing. Braces within strings don't count; an object that doesn't end goes to
    the end of the text.
    """
    if len(text) >= 2 and text[0] == text[-1] == '"':
        text = text[1:-1]
    out, at = [], 0
    while m := re.compile(r"\s*([^\r\n]+)[\r\n]*").match(text, at):
        iri, at = m[1].strip(), m.end()
        at = re.compile(r"\s*").match(text, at).end()
        if not text.startswith("{", at):
            continue
        depth, end = 0, len(text)
        for x in _BRACES.finditer(text, at):
            depth += {"{": 1, "}": -1}.get(x[0], 0)
            if not depth:
                end = x.end()
                break
        out.append((iri, text[at:end]))
        at = end
    return out


def pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, iri, json) of pair_stream() for each row."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, *p) for k, t in zip(b["k"], b["t"], strict=True) for n, p in enumerate(pair_stream(t or ""), 1)]
            yield pd.DataFrame(rows, columns=["k", "n", "iri", "json"])

    found = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {dict(df.dtypes)[key]}, n int, iri string, json string")
    return found.withColumnRenamed("k", key)


def outputs_match(actual: str, expected: str) -> Column:
    """Whether a map of expected outputs(index to (t, v) texts) is met by the actual one: every index there, with the same
    tag, and numbers within a relative 1e-6 or an absolute 1e-9."""
    a, e = F.col(actual), F.col(expected)

    def same(x: Column) -> Column:
        have = a[x["key"]]
        got, want = have["v"].try_cast("double"), x["value"]["v"].try_cast("double")
        near = (F.abs(got - want) <= F.lit(1e-9)) | (F.abs(got - want) <= 1e-6 * F.greatest(F.abs(got), F.abs(want)))
        value = F.when(x["value"]["t"].isin("float", "double"), near).otherwise(have["v"] == x["value"]["v"])
        return F.coalesce((have["t"] == x["value"]["t"]) & value, F.lit(False))

    return F.forall(F.map_entries(e), same)


def operations(plans: DataFrame, corr: str = "corr", text: str = "json") -> DataFrame:
    """(corr, step, name, inputs, outputs) of plans' parameter rows, grouped by step; values stay text."""
    schema = "struct<rows: array<struct<step: int, g: string, k: string, i: int, t: string, v: string>>>"
    rows = plans.select(corr, F.explode(F.from_json(text, schema)["rows"]).alias("r")).select(corr, "r.*")
    values = lambda g: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("g") == g, F.struct("i", "v")))))
    return rows.groupBy(corr, "step").agg(F.max(F.when(F.col("g") == "method", F.col("v"))).alias("name"), values("input").alias("inputs"), values("output").alias("outputs"))
