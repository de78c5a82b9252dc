"""Wiring of block diagrams: what feeds each input, through operators, connectors and jumps, over all units at once.

A diagram's pins are nodes of one graph for all units: an input leads to the outputs that it is linked to, an output of an
operator to that operator's inputs, a continuation to the connector of its name. Outputs of instances and units, and
variables, are where a search ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import big, discard, scratch
from . import graph


def _node(side: str, pou: str | Column, element: str | Column, pin: str | Column) -> Column:
    of = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.concat_ws("\x01", F.lit(side), of(pou), of(element), of(pin))


def links(rows: DataFrame) -> DataFrame:
    """(pou, element, kind, name, type, pin, source, source_pin, negated, text, ends): pins of rows(name, pins); ends where a
    search for sources ends: at variables, instances and blocks of units among the rows."""
    units = rows.select(F.col("name").alias("type"), F.lit(True).alias("unit")).distinct()
    p = rows.select(F.col("name").alias("pou"), F.explode("pins").alias("x")).select("pou", "x.*")
    ends = F.col("kind").isin("in", "inout") | ((F.col("kind") == "block") & ((F.coalesce("name", F.lit("")) != "") | F.col("unit").isNotNull()))
    # elements without a type: one that no unit has, of many, so that they don't go to one task
    p = p.withColumn("t", F.coalesce("type", F.concat(F.lit("\x01"), "pou")))
    return p.join(big(units.withColumnRenamed("type", "t")), "t", "left").drop("t").withColumn("ends", F.coalesce(ends, F.lit(False))).drop("unit")


def wires(rows: DataFrame, most_steps: int = 1000) -> DataFrame:
    """One row per sink and source: (pou, kind, element, name, type, pin, text, negated) of the sink, from_kind, from_element,
    from_name, from_type, from_pin, from_text of the source, and direct: no operator lies between. A sink that nothing
    feeds gives no row.

    Sinks are inputs of instances and of units' blocks (kind block), outgoing variables (out, inout), jumps and returns, and
    outputs that a block assigns by itself (assigned, whose source is the block). negated tells whether a direct source is
    negated on its way. Loops end where they are met again.
    """
    p = scratch(links(rows), "links")
    wired = p.where("source is not null and kind <> 'assigned'")
    inner = p.where("kind = 'block' and not ends")
    edges = wired.select(_node("i", "pou", "element", "pin").alias("src"), _node("o", "pou", "source", "source_pin").alias("dst"))
    asked = wired.select("pou", F.col("source").alias("element"), "source_pin").distinct()
    through = asked.join(big(inner.select("pou", "element", "pin").distinct()), ["pou", "element"]).select(_node("o", "pou", "element", "source_pin").alias("src"), _node("i", "pou", "element", "pin").alias("dst"))
    ends, begins = p.where("kind = 'connector'"), p.where("kind = 'continuation'")
    jumps = asked.join(big(begins.select("pou", "element", "name")), ["pou", "element"]).join(big(ends.select("pou", "name", F.col("element").alias("at"))), ["pou", "name"]).select(_node("o", "pou", "element", "source_pin").alias("src"), _node("i", "pou", "at", F.lit("")).alias("dst"))
    sinks = wired.where("ends and kind = 'block' or kind in ('out', 'inout', 'jump', 'return')")
    sinks = sinks.groupBy("pou", "kind", "element", "name", "type", "pin", "text").agg(F.bool_or("negated").alias("negated"))
    roots = sinks.select(_node("i", "pou", "element", "pin").alias("root")).distinct()
    steps = scratch(edges.unionByName(through).unionByName(jumps), "steps")
    reach = graph.reachable(steps, roots, most_steps).where("node like 'o%'").select("root", "node")
    producers = asked.join(big(p.where("kind in ('in', 'inout', 'block')").select("pou", "element", "ends", *[F.col(c).alias(f"from_{c}") for c in ("kind", "name", "type", "text")]).distinct()), ["pou", "element"])
    flips = p.where("kind in ('in', 'inout')").groupBy("pou", "element").agg(F.bool_or("negated").alias("flips"))
    found = reach.join(big(producers.join(big(flips), ["pou", "element"], "left").select(_node("o", "pou", "element", "source_pin").alias("node"), F.col("element").alias("from_element"), F.col("source_pin").alias("from_pin"), "ends", "flips", "from_kind", "from_name", "from_type", "from_text")), "node")
    plain = found.groupBy("root").agg((~F.bool_or(~F.col("ends")) & (F.count_distinct("node") == 1)).alias("direct"))
    out = sinks.withColumn("root", _node("i", "pou", "element", "pin")).join(big(found.where("ends")), "root").join(big(plain), "root")
    negated = F.col("direct") & (F.col("negated") != F.coalesce("flips", F.lit(False)))
    columns = ["pou", "kind", "element", "name", "type", "pin", "text", negated.alias("negated"), "from_kind", "from_element", "from_name", "from_type", "from_pin", "from_text", "direct"]
    texts = p.where("kind = 'out' and text is not null").select("pou", F.col("element").alias("source"), F.col("text").alias("out_text"))
    own = p.where("kind = 'assigned'").join(big(texts), ["pou", "source"], "left")
    null = F.lit(None).cast("string")
    own = own.select("pou", "kind", "element", null.alias("name"), null.alias("type"), null.alias("pin"), F.coalesce("text", "out_text").alias("text"), "negated", F.lit("block").alias("from_kind"), F.col("element").alias("from_element"), F.col("name").alias("from_name"), F.col("type").alias("from_type"), F.col("pin").alias("from_pin"), null.alias("from_text"), F.lit(True).alias("direct"))
    done = scratch(out.select(*columns).unionByName(own.where("text is not null")), "wires")
    discard(p, steps)
    return done


def diagram_bindings(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Calls of units' blocks in diagrams as rows of etl.call_bindings(): (caller, instance, idx, direction, port, place,
    expression), from the wires() found. A block without an instance goes by its type. An input fed by one source has its
    text, NOT before it where it is negated; one that operators feed has none. idx counts an instance's blocks by their ids."""
    blocks = links(rows).where("kind = 'block' and ends").select("pou", "element", F.coalesce(F.nullif("name", F.lit("")), "type").alias("instance")).distinct()
    numbered = blocks.groupBy("pou", "instance").agg(F.array_sort(F.collect_set(F.struct(F.col("element").try_cast("long").alias("n"), "element"))).alias("all"))
    numbered = numbered.select("pou", "instance", F.posexplode("all").alias("idx", "e")).select("pou", "instance", "idx", F.col("e.element").alias("element"))
    source = F.when(F.col("from_kind") == "block", F.concat_ws(".", F.coalesce(F.nullif("from_name", F.lit("")), "from_type"), "from_pin")).otherwise(F.col("from_text"))
    text = F.when(F.col("direct"), F.concat(F.when(F.col("negated"), "NOT ").otherwise(""), source))
    into = found.where("kind = 'block'").select("pou", "element", F.lit("Input").alias("direction"), F.col("pin").alias("port"), text.alias("expression")).distinct()
    out = found.where("kind in ('out', 'inout', 'assigned') and direct and from_kind = 'block' and not negated").select("pou", F.col("from_element").alias("element"), F.lit("Output").alias("direction"), F.col("from_pin").alias("port"), F.col("text").alias("expression")).distinct()
    calls = numbered.join(big(into.unionByName(out)), ["pou", "element"], "left")
    return calls.select(F.col("pou").alias("caller"), "instance", F.col("idx").cast("int").alias("idx"), "direction", "port", F.lit(None).cast("int").alias("place"), "expression")
