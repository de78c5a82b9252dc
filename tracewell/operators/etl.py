"""From normalised program rows to the program graph: idempotent steps, each a function of tables.

A program row has: name, kind, code, ports array<struct<direction, name, type>>, header (declarations).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import logic
from ..functions.text import escape_iri, identifiers, strip_comments
from ..tables import big, discard, scratch
from . import diagrams

# The ports of the standard function blocks, as (block, direction, port, type).
STANDARD_PORTS = [
    ("SR", "Input", "S1", "BOOL"),
    ("SR", "Input", "R", "BOOL"),
    ("SR", "Output", "Q1", "BOOL"),
    ("RS", "Input", "S", "BOOL"),
    ("RS", "Input", "R1", "BOOL"),
    ("RS", "Output", "Q1", "BOOL"),
    ("R_TRIG", "Input", "CLK", "BOOL"),
    ("R_TRIG", "Output", "Q", "BOOL"),
    ("F_TRIG", "Input", "CLK", "BOOL"),
    ("F_TRIG", "Output", "Q", "BOOL"),
    ("CTU", "Input", "CU", "BOOL"),
    ("CTU", "Input", "R", "BOOL"),
    ("CTU", "Input", "PV", "INT"),
    ("CTU", "Output", "Q", "BOOL"),
    ("CTU", "Output", "CV", "INT"),
    ("CTD", "Input", "CD", "BOOL"),
    ("CTD", "Input", "LD", "BOOL"),
    ("CTD", "Input", "PV", "INT"),
    ("CTD", "Output", "Q", "BOOL"),
    ("CTD", "Output", "CV", "INT"),
    ("CTUD", "Input", "CU", "BOOL"),
    ("CTUD", "Input", "CD", "BOOL"),
    ("CTUD", "Input", "R", "BOOL"),
    ("CTUD", "Input", "LD", "BOOL"),
    ("CTUD", "Input", "PV", "INT"),
    ("CTUD", "Output", "QU", "BOOL"),
    ("CTUD", "Output", "QD", "BOOL"),
    ("CTUD", "Output", "CV", "INT"),
    ("TP", "Input", "IN", "BOOL"),
    ("TP", "Input", "PT", "TIME"),
    ("TP", "Output", "Q", "BOOL"),
    ("TP", "Output", "ET", "TIME"),
    ("TON", "Input", "IN", "BOOL"),
    ("TON", "Input", "PT", "TIME"),
    ("TON", "Output", "Q", "BOOL"),
    ("TON", "Output", "ET", "TIME"),
    ("TOF", "Input", "IN", "BOOL"),
    ("TOF", "Input", "PT", "TIME"),
    ("TOF", "Output", "Q", "BOOL"),
    ("TOF", "Output", "ET", "TIME"),
]


def key(kind: str, *parts: str | Column) -> Column:
    cols = [escape_iri(F.col(p) if isinstance(p, str) else p) for p in parts]
    return F.concat(F.lit(kind + "_"), F.concat_ws("_", *cols))


def _rows(df: DataFrame, s: Column, p: str, o: Column, kind: str = "iri") -> DataFrame:
    return df.select(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"))


def _facts(df: DataFrame, *facts: tuple[Column, str, Column, str]) -> DataFrame:
    """_rows() for each (s, p, o, kind), in one pass over df."""
    one = [F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind")) for s, p, o, kind in facts]
    return df.select(F.explode(F.array(*one)).alias("t")).select("t.*")


def _all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("s is not null and o is not null").dropDuplicates()


def standard_blocks(spark: SparkSession) -> DataFrame:
    """Triples of the standard function blocks and their ports."""
    df = spark.createDataFrame(STANDARD_PORTS, "block string, direction string, port string, type string")
    block, port = key("FBType", "block"), key("Port", "block", "port")
    return _all(
        _rows(df, block, "rdf:type", F.lit("StandardFBType")),
        _rows(df, block, "op:hasPort", port),
        _rows(df, port, "dp:hasPortName", F.col("port"), "literal"),
        _rows(df, port, "dp:hasPortDirection", F.col("direction"), "literal"),
        _rows(df, port, "dp:hasPortType", F.col("type"), "literal"),
    )


def programs(rows: DataFrame) -> DataFrame:
    """Triples of units, ports and variables."""
    pou = key("POU", "name")
    ports = rows.select("name", F.explode("ports").alias("x")).select("name", F.col("x.direction").alias("direction"), F.col("x.name").alias("port"), F.col("x.type").alias("type"))
    public, local = ports.where("direction <> 'Local'"), ports.where("direction = 'Local'")
    port, var = key("Port", "name", "port"), key("Var", "name", "port")
    return _all(
        _facts(rows, (pou, "rdf:type", F.when(F.col("kind") == "program", "Program").otherwise("CustomFBType"), "iri"), (pou, "dp:hasPOUName", F.col("name"), "literal"), (pou, "dp:hasCode", F.col("code"), "literal")),
        _facts(public, (pou, "op:hasPort", port, "iri"), (port, "dp:hasPortName", F.col("port"), "literal"), (port, "dp:hasPortDirection", F.col("direction"), "literal"), (port, "dp:hasPortType", F.col("type"), "literal")),
        _facts(local, (pou, "op:hasVariable", var, "iri"), (var, "dp:hasVariableName", F.col("port"), "literal"), (var, "dp:hasVariableType", F.col("type"), "literal")),
    )


def globals_(rows: DataFrame) -> DataFrame:
    """Triples of global variables gvl(name, globals array<struct<name, type, init, address>>), under both their names."""
    g = rows.select(F.col("name").alias("gvl"), F.explode("globals").alias("x")).select("gvl", "x.name", "x.type", "x.init", "x.address")
    var = key("Var", "gvl", "name")
    return _all(_rows(g, var, "dp:hasVariableName", F.concat_ws(".", "gvl", "name"), "literal"), _rows(g, var, "dp:hasVariableName", F.col("name"), "literal"), _rows(g, var, "dp:hasHardwareAddress", F.col("address"), "literal"), _rows(g, var, "dp:hasDefault", F.col("init"), "literal"))


CALLS = "caller string, instance string, idx int, direction string, port string, place int, expression string"


def call_bindings(rows: DataFrame) -> DataFrame:
    """One row per argument of each call statement in the code, and one without port for a call without arguments. An argument
    without a name has its place (from 0) instead of a port."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = lru_cache(64)(logic.call_statements)  # equal code isn't read again a short while later
        for b in batches:
            out = []
            for name, code in zip(b["name"], b["code"], strict=True):
                for c in found(code or ""):
                    args = [("Input", k, None, v) for k, v in c.inputs.items()] + [("Output", k, None, v) for k, v in c.outputs.items()] + [("Input", None, i, v) for i, v in enumerate(c.placed)]
                    out += [(name, c.name, c.idx, *a) for a in args or [(None,) * 4]]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CALLS.split(", ")]).astype({"place": "Int32"})

    return rows.select("name", "code").mapInPandas(run, CALLS)


def _instances(rows: DataFrame) -> DataFrame:
    """(caller, k, callee): a unit's local names in lower case and their types, of arrays those of their elements; and
    blocks of its diagram that it doesn't declare."""
    own = rows.select(F.col("name").alias("caller"), F.explode("ports").alias("x")).where("x.direction = 'Local'")
    if "pins" in rows.columns:
        drawn = rows.select(F.col("name").alias("caller"), F.explode("pins").alias("x")).where("x.kind = 'block' and x.type is not null")
        drawn = drawn.select("caller", F.lower(F.coalesce(F.nullif("x.name", F.lit("")), "x.type")).alias("k"), F.col("x.type").alias("callee")).distinct()
        declared = _instances(rows.drop("pins"))
        return declared.unionByName(drawn.join(big(declared), ["caller", "k"], "left_anti"))
    return own.select("caller", F.lower("x.name").alias("k"), F.regexp_replace("x.type", r"(?is)^\s*ARRAY\s*\[[^\]]*\]\s*OF\s+", "").alias("callee"))


def _head(c: str) -> Column:
    """The first name of a called one, in lower case: of t.Start and t[1] it is t."""
    return F.lower(F.regexp_extract(c, r"^\w+", 0))


def calls(rows: DataFrame, bindings: DataFrame) -> DataFrame:
    """Call and assignment triples: caller contains call, call calls the type of the instance's declaration. Arguments without a
    name go to the callee's inputs in the order of their declaration."""
    found = bindings.withColumn("k", _head("instance")).join(big(_instances(rows)), ["caller", "k"])
    inputs = F.filter("ports", lambda p: p["direction"] == "Input")
    placed = rows.select(F.col("name").alias("callee"), F.posexplode(inputs).alias("place", "x")).select("callee", "place", F.col("x.name").alias("at"))
    # arguments with a name have no place: a number that none has, of many, so that they don't go to one task per callee
    found = found.withColumn("place", F.coalesce("place", -1 - F.pmod(F.xxhash64("caller", "instance"), F.lit(1000)).cast("int")))
    found = found.join(big(placed), ["callee", "place"], "left").withColumn("port", F.coalesce("port", "at"))
    call = key("Call", "caller", "instance", F.col("idx").cast("string"))
    assign = F.when(F.col("port").isNotNull(), key("Assign", "caller", "instance", F.col("idx").cast("string"), "port"))
    to = F.when(F.col("port").isNotNull(), key("Port", "callee", "port"))
    return _all(_facts(found, (key("POU", "caller"), "op:containsPOUCall", call, "iri"), (call, "op:callsPOU", key("POU", "callee"), "iri"), (call, "op:hasAssignment", assign, "iri"), (assign, "dp:hasExpression", F.col("expression"), "literal"), (assign, "op:assignsToPort", to, "iri")))


def defaults(rows: DataFrame) -> DataFrame:
    """(pou, name, type, init) from declaration headers; rows without such a column have none."""
    rows = rows if "header" in rows.columns else rows.withColumn("header", F.lit(None).cast("string"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = lru_cache(64)(logic.parse_declaration)
        for b in batches:
            out = [(n, *d) for n, h in zip(b["name"], b["header"], strict=True) for d in found(h or "")]
            yield pd.DataFrame(out, columns=["pou", "name", "type", "init"])

    return rows.select("name", "header").mapInPandas(run, "pou string, name string, type string, init string")


def default_triples(rows: DataFrame, found: DataFrame, create: bool = False) -> DataFrame:
    """Default values of defaults(), at the unit's port or variable of that name (case ignored); with create also at
    variables that only the header declares, which it adds."""
    d = found.where("init is not null").withColumn("k", F.lower("name"))
    declared = rows.select(F.col("name").alias("pou"), F.explode("ports").alias("x")).select("pou", F.lower("x.name").alias("k"), F.col("x.name").alias("own"), F.col("x.direction").alias("direction"))
    hit = d.join(big(declared), ["pou", "k"], "left")
    subject = F.when(F.col("direction") == "Local", key("Var", "pou", "own")).when(F.col("direction").isNotNull(), key("Port", "pou", "own"))
    if not create:
        return _all(_rows(hit, subject, "dp:hasDefault", F.col("init"), "literal"))
    var = key("Var", "pou", "name")
    new = F.when(F.col("direction").isNull(), var)
    return _all(_facts(hit, (F.coalesce(subject, var), "dp:hasDefault", F.col("init"), "literal"), (key("POU", "pou"), "op:hasVariable", new, "iri"), (new, "dp:hasVariableName", F.col("name"), "literal"), (new, "dp:hasVariableType", F.col("type"), "literal")))


def default_counts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One row (n_set, n_created, n_missing): defaults of declared names, of names that only headers have, and names without one."""
    declared = rows.select(F.col("name").alias("pou"), F.explode("ports").alias("x")).select("pou", F.lower("x.name").alias("k"), F.lit(True).alias("known"))
    both = found.withColumn("k", F.lower("name")).join(big(declared), ["pou", "k"], "left")
    given = F.col("init").isNotNull()
    return both.agg(F.count_if(given & F.col("known").isNotNull()).alias("n_set"), F.count_if(given & F.col("known").isNull()).alias("n_created"), F.count_if(~given).alias("n_missing"))


def gemma_layers(rows: DataFrame) -> DataFrame:
    """(pou, n_state_out, n_state_in, n_other_out, n_assigned, is_modes, is_outputs) of units that aren't programs.

    A state is a letter A, F or D and digits. A unit with three states or more among its outputs, or named so, is an
    operating-modes machine. One named so, or with three states as inputs and three other outputs, or whose code has
    three or more assignments to outputs, controls outputs.
    """
    units = rows.where("kind <> 'program'")
    ports = units.select(F.col("name").alias("pou"), F.explode_outer("ports").alias("x")).select("pou", F.col("x.direction").alias("direction"), F.col("x.name").alias("port"))
    state = F.trim("port").rlike(r"(?i)^[AFD]\d+$")
    is_out, is_in = F.col("direction") == "Output", F.col("direction") == "Input"
    counted = ports.groupBy("pou").agg(F.count_if(is_out & state).alias("n_state_out"), F.count_if(is_in & state).alias("n_state_in"), F.count_if(is_out & ~state).alias("n_other_out"), F.collect_set(F.when(is_out, F.lower("port"))).alias("outs"))
    targets = F.regexp_extract_all(F.coalesce("code", F.lit("")), F.lit(r"(?m)^\s*([A-Za-z_][A-Za-z0-9_.]*)\s*:="), F.lit(1))
    found = units.select(F.col("name").alias("pou"), F.transform(targets, lambda t: F.lower(F.substring_index(t, ".", -1))).alias("targets")).join(big(counted), "pou")
    found = found.withColumn("n_assigned", F.expr("size(filter(targets, t -> array_contains(outs, t)))").cast("long"))
    named = lambda n: F.lower("pou").contains(n)
    modes = named("operatingmodes") | (F.col("n_state_out") >= 3)
    outputs = named("controlofoutputs") | ((F.col("n_state_in") >= 3) & (F.col("n_other_out") >= 3)) | (F.col("n_assigned") >= 3)
    return found.select("pou", "n_state_out", "n_state_in", "n_other_out", "n_assigned", modes.alias("is_modes"), outputs.alias("is_outputs"))


def consistency_reports(rows: DataFrame, called: DataFrame, unused_names: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """(pou, report): name, description, inputs and outputs with types, called(caller, callee) units, and unused(pou, name)
    variables and ports with their number; parts that are empty are left out, lists are sorted."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    ports = rows.select(F.col("name").alias("pou"), F.explode("ports").alias("x")).select("pou", F.col("x.direction").alias("direction"), F.col("x.name").alias("port"), F.concat("x.name", F.lit(" ("), F.coalesce("x.type", F.lit("")), F.lit(")")).alias("info"))
    faces = ports.groupBy("pou").agg(listed(F.when(F.col("direction") == "Input", F.col("info"))).alias("ins"), listed(F.when(F.col("direction") == "Output", F.col("info"))).alias("outs"))
    calls_ = called.groupBy(F.col("caller").alias("pou")).agg(listed("callee").alias("calls"))
    idle = unused_names.join(big(ports.select("pou", F.col("port").alias("name"), "direction")), ["pou", "name"]).distinct()
    local = F.col("direction") == "Local"
    idle = idle.groupBy("pou").agg(*[e for n, c in (("vars", local), ("ports", ~local)) for e in (F.count_if(c).alias(f"n_{n}"), listed(F.when(c, F.col("name"))).alias(n))])
    out = rows.select(F.col("name").alias("pou")).distinct()
    for part in (faces, calls_, idle):
        out = out.join(big(part), "pou", "left")
    out = out.join(big(descriptions.select("pou", "description")), "pou", "left") if descriptions is not None else out.withColumn("description", F.lit(None).cast("string"))
    part = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(label + ": "), F.col(c)))
    counted = lambda label, n, c: F.when(F.col(n) > 0, F.concat(F.lit(label + " ("), F.col(n).cast("string"), F.lit("): "), F.col(c)))
    report = F.concat_ws(" | ", F.concat(F.lit("Unit: "), F.col("pou")), part("Description", "description"), part("Inputs", "ins"), part("Outputs", "outs"), part("Calls", "calls"), counted("UNUSED variables", "n_vars", "vars"), counted("UNUSED ports", "n_ports", "ports"))
    return out.select("pou", report.alias("report"))


def unused(rows: DataFrame) -> DataFrame:
    """(pou, name) of declared names that the unit's code never mentions; parts of dotted names count as mentions."""
    used = rows.select(F.col("name").alias("pou"), F.explode(identifiers(strip_comments("code"))).alias("t")).select("pou", F.lower("t").alias("t")).distinct()
    declared = rows.select(F.col("name").alias("pou"), F.explode("ports").alias("x")).select("pou", F.col("x.name").alias("name"), F.lower("x.name").alias("t"))
    return declared.join(big(used), ["pou", "t"], "left_anti").select("pou", "name")


def global_uses(rows: DataFrame, names: DataFrame) -> DataFrame:
    """usesVariable triples: code that mentions Gvl.Var, word-bounded and case-sensitive; names(gvl, name)."""
    dotted = F.explode(F.array_distinct(F.regexp_extract_all(strip_comments("code"), F.lit(r"\b([A-Za-z_]\w*\.[A-Za-z_]\w*)"), F.lit(1))))
    found = rows.select("name", dotted.alias("m")).join(names.select(F.concat_ws(".", "gvl", F.col("name")).alias("m"), key("Var", "gvl", "name").alias("var")), "m")
    return _all(_rows(found, key("POU", "name"), "op:usesVariable", F.col("var")))


def condition_ports(rows: DataFrame) -> DataFrame:
    """(pou, instance, port) of instance ports that IF, ELSIF, WHILE and UNTIL conditions read."""
    conditions = F.explode(F.regexp_extract_all(strip_comments("code"), F.lit(r"(?is)\b(?:IF|ELSIF|WHILE|UNTIL)\b(.*?)(?:\bTHEN\b|\bDO\b|\bEND_REPEAT\b)"), F.lit(1)))
    ports = F.explode(F.regexp_extract_all("c", F.lit(r"\b([A-Za-z_]\w*\.[A-Za-z_]\w*)\b"), F.lit(1)))
    found = rows.select("name", conditions.alias("c")).select("name", ports.alias("x")).distinct()
    own = rows.select("name", F.explode("ports").alias("i")).where("i.direction = 'Local'").select("name", F.lower("i.name").alias("k"))
    parts = found.select("name", F.split("x", r"\.").alias("p")).select("name", F.col("p")[0].alias("instance"), F.col("p")[1].alias("port"))
    return parts.withColumn("k", F.lower("instance")).join(big(own), ["name", "k"], "left_semi").select(F.col("name").alias("pou"), "instance", "port")


def output_layer(rows: DataFrame, bindings: DataFrame, hardware: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """(pou) of units called by a program whose call writes a hardware(name) variable, and of those whose instance's port a
    program's flow_edges() row moves to one, where some program calls the unit."""
    programs_ = rows.where("kind = 'program'").select(F.col("name").alias("caller"))
    types = rows.select(F.col("name").alias("caller"), F.explode("ports").alias("x")).where("x.direction = 'Local'").select("caller", F.lower("x.name").alias("i"), F.col("x.type").alias("pou"))
    wired = hardware.select(F.lower("name").alias("k")).distinct()
    in_program = bindings.join(big(programs_), "caller", "left_semi")
    written = in_program.where("direction = 'Output'").select("caller", F.lower("instance").alias("i"), F.lower("expression").alias("k"))
    hits = written.join(wired, "k", "left_semi").join(big(types), ["caller", "i"]).select("pou")
    if flows is not None:
        called = in_program.select("caller", F.lower("instance").alias("i")).join(big(types), ["caller", "i"]).select("pou").distinct()
        moved = flows.select(F.col("program").alias("caller"), F.lower("instance").alias("i"), F.lower("variable").alias("k")).join(wired, "k", "left_semi")
        hits = hits.unionByName(moved.join(big(types), ["caller", "i"]).select("pou").join(big(called), "pou", "left_semi"))
    return hits.distinct()


# What a simulated variable takes over from the real one.
HARDWARE_FACTS = ("dp:hasHardwareAddress", "dp:ioRawXml", "op:isBoundToChannel")


def simulation_mirror(triples: DataFrame, lists: DataFrame, suffix: str = "_Sim", control: tuple[str, ...] = ("bSimMode",)) -> tuple[DataFrame, DataFrame]:
    """The triples with the hardware facts of X.v at X_Sim.v, and a report (name, status) of each variable of a list X_Sim.

    lists(gvl, name). What the target had is replaced. status: copied, skipped (a control variable), missing source,
    missing target, or source without data (whose target then has none either).
    """
    full = triples.where("p = 'dp:hasVariableName' and o like '%.%'").groupBy(F.col("o").alias("name")).agg(F.min("s").alias("var"))
    sims = lists.where(F.col("gvl").endswith(suffix)).select(F.concat_ws(".", "gvl", "name").alias("name"), F.concat_ws(".", F.expr(f"left(gvl, length(gvl) - {len(suffix)})"), F.col("name")).alias("source_name"), F.col("name").isin(*control).alias("control")).distinct()
    pairs = sims.join(full.select(F.col("name").alias("source_name"), F.col("var").alias("source")), "source_name", "left").join(full.select("name", F.col("var").alias("target")), "name", "left")
    facts = triples.where(F.col("p").isin(*HARDWARE_FACTS))
    has = facts.select(F.col("s").alias("source")).distinct().withColumn("has", F.lit(True))
    status = F.when(F.col("control"), "skipped").when(F.col("source").isNull(), "missing source").when(F.col("target").isNull(), "missing target").when(F.col("has").isNull(), "source without data").otherwise("copied")
    judged = pairs.join(has, "source", "left").withColumn("status", status)
    replaced = judged.where("status in ('copied', 'source without data')")
    kept = triples.join(replaced.select(F.col("target").alias("s"), F.explode(F.array(*map(F.lit, HARDWARE_FACTS))).alias("p")), ["s", "p"], "left_anti")
    new = facts.withColumnRenamed("s", "source").join(replaced.select("source", "target"), "source").select(F.col("target").alias("s"), "p", "o", "o_kind")
    return _all(kept.select("s", "p", "o", "o_kind"), new), judged.select("name", "status")


def skill_callers(triples: DataFrame, skill: str) -> DataFrame:
    """(fb_type, instances array<struct<variable, caller>>): units whose code names 'skill' in quotes, their instances'
    variables and the units that use those; units without instances have an empty list."""
    t = lambda p, a, b: triples.where(F.col("p") == p).select(F.col("s").alias(a), F.col("o").alias(b))
    names = t("dp:hasPOUName", "pou", "fb_type")
    units = t("dp:hasCode", "pou", "code").where(F.col("code").contains(f"'{skill}'")).select("pou").distinct().join(names, "pou")
    used = t("op:isInstanceOfFBType", "instance", "pou").join(t("op:representsFBInstance", "var", "instance"), "instance").join(t("dp:hasVariableName", "var", "variable"), "var").join(t("op:usesVariable", "user", "var"), "var").join(names.toDF("user", "caller"), "user")
    listed = units.join(used.select("pou", "variable", "caller").distinct(), "pou", "left").groupBy("fb_type").agg(F.array_sort(F.collect_set(F.when(F.col("variable").isNotNull(), F.struct("variable", "caller")))).alias("instances"))
    return listed


def hypothesis_triples(triples: DataFrame, suggestions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """triples with a hypothesis for each of suggestions(function_id, source, confidence, description, parent, names
    array, evidence array, pous array, skills array), its earlier values replaced; and (function_id, created)."""
    h = F.concat(F.lit("Hyp_"), F.col("function_id"))
    each = lambda c: suggestions.select("function_id", F.explode(c).alias("x"))
    lists = {"dp:hasRuntimeSkillName": ("names", "literal"), "dp:hasEvidenceSnippet": ("evidence", "literal"), "op:hasHypothesisAboutPOU": ("pous", "iri"), "op:hasHypothesisAboutSkill": ("skills", "iri")}
    parts = [_rows(suggestions, h, "rdf:type", F.lit("SkillImplementationHypothesis")), _rows(suggestions, h, "rdfs:label", F.concat(F.lit("Hyp: "), "function_id"), "literal")]
    parts += [_rows(suggestions, h, p, F.col(c), "literal") for p, c in (("dp:hasSuggestedFunctionID", "function_id"), ("dp:hasHypothesisSource", "source"), ("dp:hasConfidence", "confidence"), ("dp:hasHypothesisDescription", "description"), ("dp:hasSuggestedParentFunctionID", "parent"))]
    parts += [_rows(each(c), h, p, F.col("x"), kind) for p, (c, kind) in lists.items()]
    new = _all(*parts)
    # a parent that isn't given keeps the one there is; all other values of the hypothesis are replaced
    replaced = suggestions.select(h.alias("s"), F.col("parent").isNull().alias("keep_parent")).distinct()
    old = triples.select("s", "p", "o", "o_kind").join(replaced, "s", "left")
    stays = F.col("keep_parent").isNull() | ((F.col("p") == "dp:hasSuggestedParentFunctionID") & F.col("keep_parent"))
    known = triples.where("p = 'rdf:type' and o = 'SkillImplementationHypothesis'").select("s").distinct()
    created = suggestions.select("function_id", h.alias("s")).distinct().join(known.withColumn("known", F.lit(True)), "s", "left").select("function_id", F.col("known").isNull().alias("created"))
    return _all(old.where(stays).drop("keep_parent"), new), created


def access_flags(attributes: DataFrame) -> DataFrame:
    """(owner, name, visible, writable) from attribute rows (owner, name, attribute, value); rows with neither go."""
    a, v = F.lower("attribute"), F.lower("value")
    access = a.contains("access")
    flags = attributes.groupBy("owner", "name").agg(F.bool_or((a == "opc.ua.da") & (v == "1")).alias("visible"), F.bool_or(access & (v.contains("write") | v.isin("2", "3"))).alias("w"), F.bool_or(access).alias("a"))
    return flags.select("owner", "name", "visible", (F.col("w") | (F.col("visible") & ~F.col("a"))).alias("writable")).where("visible or writable")


def link_sides(links: DataFrame) -> DataFrame:
    """(plc, io, owner) of links(owner_a, owner_b, var_a, var_b): the side whose path names a PLC task is the program's.

    The first side wins where both do; links without a PLC task go. The owner is the one that is a device (TIID^).
    """
    task = lambda c: F.lower(c).contains("plctask")
    a, b = task("var_a"), task("var_b")
    owner = F.when(F.col("owner_b").startswith("TIID^"), F.col("owner_b")).otherwise(F.col("owner_a"))
    return links.where(a | b).select(F.when(a, F.col("var_a")).otherwise(F.col("var_b")).alias("plc"), F.when(a, F.col("var_b")).otherwise(F.col("var_a")).alias("io"), owner.alias("owner"))


def io_address(plc: str, channel: str, in_out: str, bit_address: str) -> Column:
    """Address such as "I 3.5": the direction by the channel's end, the task's side, or the flag; ? if none tells."""
    path, spec = F.lower(F.col(plc)), F.col(channel)
    letter = F.when(spec.endswith("^Input"), "I").when(spec.endswith("^Output"), "Q").when(path.contains("plctask inputs"), "I").when(path.contains("plctask outputs"), "Q")
    letter = letter.when(F.col(in_out) == 0, "I").when(F.col(in_out) == 1, "Q").otherwise("?")
    return F.format_string("%s %d.%d", letter, F.floor(F.col(bit_address) / 8), F.pmod(F.col(bit_address), F.lit(8)))


def io_mapping(entries: DataFrame) -> DataFrame:
    """Triples of hardware variables: entries(plc_var, address, io_path, raw_xml); rows without a variable go."""
    e = entries.where("plc_var <> ''")
    var, channel = key("Var", "plc_var"), key("IOChannel", "io_path")
    return _all(
        _rows(e, var, "rdf:type", F.lit("Variable")),
        _rows(e, var, "dp:hasVariableName", F.col("plc_var"), "literal"),
        _rows(e, var, "dp:hasHardwareAddress", F.col("address"), "literal"),
        _rows(e.where("io_path is not null"), channel, "rdf:type", F.lit("IOChannel")),
        _rows(e.where("io_path is not null"), var, "op:isBoundToChannel", channel),
        _rows(e, var, "dp:ioRawXml", F.col("raw_xml"), "literal"),
    )


def mapped_variables(pending: DataFrame, hardware: DataFrame) -> DataFrame:
    """isMappedToVariable triples: pending(var, external) whose external name is a hardware(name, var) variable, not itself."""
    hw = hardware.select(F.col("name").alias("external"), F.col("var").alias("hw"))
    return _all(_rows(pending.join(hw, "external").where("var <> hw"), F.col("var"), "op:isMappedToVariable", F.col("hw")))


def declaration_headers(scanned: DataFrame, exported: DataFrame) -> DataFrame:
    """(name, header) by unit name in lower case: the project's header, else the export's; blank ones don't count."""
    one = lambda df, c: df.where(F.trim("header") != "").groupBy(F.lower("name").alias("name")).agg(F.min(F.trim("header")).alias(c))
    return one(scanned, "a").join(one(exported, "b"), "name", "full_outer").select("name", F.coalesce("a", "b").alias("header"))


def flow_edges(rows: DataFrame) -> DataFrame:
    """(program, idx, variable, instance, port) of statements variable := instance.port; in programs, in order of text."""
    part = lambda i: F.regexp_extract("m", r"^\s*([A-Za-z_][\w.]*)\s*:=\s*([A-Za-z_]\w*)\s*\.\s*([A-Za-z_]\w*)", i)
    statements = F.regexp_extract_all(strip_comments("code"), F.lit(r"(?m)^(\s*[A-Za-z_][\w.]*\s*:=\s*[A-Za-z_]\w*\s*\.\s*[A-Za-z_]\w*\s*;)"), F.lit(1))
    found = rows.where("kind = 'program'").select(F.col("name").alias("program"), F.posexplode(statements).alias("idx", "m"))
    return found.select("program", (F.col("idx") + 1).alias("idx"), part(1).alias("variable"), part(2).alias("instance"), part(3).alias("port"))


def flow_triples(edges: DataFrame) -> DataFrame:
    """Assignment triples of flow_edges."""
    a = key("STAssign", "program", "instance", "port", F.col("idx").cast("string"))
    source, target = key("PortInstance", "program", "instance", "port"), key("Var", "variable")
    return _all(_rows(edges, a, "rdf:type", F.lit("ParameterAssignment")), _rows(edges, a, "op:assignsFrom", source), _rows(edges, a, "op:assignsToVariable", target), _rows(edges, source, "dp:hasExpressionText", F.concat_ws(".", "instance", "port"), "literal"))


def hardware_marks(steps: DataFrame, bound: DataFrame) -> DataFrame:
    """(unit, output, hardware) of trace steps(unit, output, hardware, variable, address): true where it was, or where a
    step's variable or address is a bound(name) variable or the last part of one."""
    names = bound.select(F.explode(F.array("name", F.substring_index("name", ".", -1))).alias("n")).distinct()
    each = steps.select("unit", "output", "hardware", F.explode(F.array("variable", "address")).alias("n"))
    hits = each.join(names.withColumn("hit", F.lit(True)), "n", "left")
    return hits.groupBy("unit", "output").agg((F.bool_or(F.coalesce("hardware", F.lit(False))) | F.bool_or(F.coalesce("hit", F.lit(False)))).alias("hardware"))


def couple_functions(triples: DataFrame, functions: DataFrame, runtime: DataFrame, elements: DataFrame) -> DataFrame:
    """triples with the functions(function, label) added, their runtime names replaced by those of runtime(function, name),
    and hasFunction links from elements(function, element). Functions without elements get no link."""
    f = F.col("function")
    added = _all(_rows(functions, f, "rdf:type", F.lit("ProcessFunction")), _rows(functions, f, "rdfs:label", F.col("label"), "literal"))
    known = functions.select("function").distinct()
    names = _rows(runtime.join(known, "function", "left_semi"), f, "dp:hasRuntimeSkillName", F.col("name"), "literal")
    links = _rows(elements.join(known, "function", "left_semi"), F.col("element"), "op:hasFunction", f)
    stale = known.select(F.col("function").alias("s"), F.lit("dp:hasRuntimeSkillName").alias("p"))
    return _all(triples.join(stale, ["s", "p"], "left_anti").select("s", "p", "o", "o_kind"), added, names, links)


def failures(events: DataFrame) -> DataFrame:
    """Triples of occurred failures: events(corr, failure_mode, summary, actions array<string>)."""
    f = F.concat(F.lit("Failure_"), "corr")
    acts = events.select("corr", F.explode("actions").alias("a"))
    known = F.when(F.col("failure_mode").isNotNull(), "OccurredKnownFailure").otherwise("OccurredUnknownFailure")
    return _all(_facts(events, (f, "rdf:type", known, "iri"), (f, "op:isInstanceOf", F.col("failure_mode"), "iri"), (f, "dp:hasSummary", F.col("summary"), "literal")), _rows(acts, F.concat(F.lit("Failure_"), "corr"), "op:executedAction", F.col("a")))


def _declared(rows: DataFrame) -> DataFrame:
    """(pou, k, name, direction, node) of all ports and variables that units declare."""
    d = rows.select(F.col("name").alias("pou"), F.explode("ports").alias("x")).select("pou", F.lower("x.name").alias("k"), F.col("x.name").alias("name"), F.col("x.direction").alias("direction"))
    return d.withColumn("node", F.when(F.col("direction") == "Local", key("Var", "pou", "name")).otherwise(key("Port", "pou", "name")))


def named_node(named: DataFrame, rows: DataFrame) -> DataFrame:
    """named(pou, text, ...) with the node that a diagram's text stands for: the unit's own port or variable, the port of an
    instance of its, a member of a global list, else an expression."""
    own = _declared(rows).groupBy("pou", "k").agg(F.min("node").alias("own"))
    instances = _instances(rows).select(F.col("caller").alias("pou"), F.col("k").alias("i"), F.lit(True).alias("instance")).distinct()
    first, rest = F.substring_index("text", ".", 1), F.expr("substring(text, length(substring_index(text, '.', 1)) + 2)")
    plain = F.col("text").rlike(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)?$")
    found = named.withColumns({"k": F.lower("text"), "i": F.when(plain & F.col("text").contains("."), F.lower(first))})
    found = found.join(big(own), ["pou", "k"], "left").join(big(instances), ["pou", "i"], "left")
    node = F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("instance"), key("PortInstance", "pou", first, rest)).when(F.col("i").isNotNull(), key("Var", first, rest)).otherwise(key("Expression", "pou", "text"))
    return found.withColumn("node", node).drop("k", "i", "own", "instance")


def wire_triples(found: DataFrame, rows: DataFrame) -> DataFrame:
    """isFedBy triples from diagrams.wires(): ports of instances, variables, jumps and returns, and what feeds them."""
    block = lambda n, t: F.coalesce(F.nullif(F.col(n), F.lit("")), F.col(t))
    w = found.withColumns({"to": block("name", "type"), "by": block("from_name", "from_type")})
    texts = named_node(w.select("pou", "text").unionByName(w.select("pou", F.col("from_text").alias("text"))).where("text is not null").distinct(), rows)
    at = lambda c, n: texts.select("pou", F.col("text").alias(c), F.col("node").alias(n))
    w = w.join(big(at("text", "to_node")), ["pou", "text"], "left").join(big(at("from_text", "by_node")), ["pou", "from_text"], "left")
    target = F.when(F.col("kind") == "block", key("PortInstance", "pou", "to", "pin")).when(F.col("kind") == "jump", key("Jump", "pou", "to")).when(F.col("kind") == "return", key("Return", "pou", "element")).otherwise(F.col("to_node"))
    source = F.when(F.col("from_kind") == "block", key("PortInstance", "pou", "by", F.coalesce("from_pin", F.lit("")))).otherwise(F.col("by_node"))
    ports = [(w.where("kind = 'block'"), "to", "pin"), (w.where("from_kind = 'block' and from_pin is not null"), "by", "from_pin")]
    parts = [_rows(w, target, "op:isFedBy", source)]
    for df, i, pin in ports:
        node = key("PortInstance", "pou", i, pin)
        parts += [_rows(df, node, "rdf:type", F.lit("PortInstance")), _rows(df, node, "dp:hasExpressionText", F.concat_ws(".", i, pin), "literal")]
    others = texts.where("node like 'Expression\\_%'")
    return _all(*parts, _rows(others, F.col("node"), "rdf:type", F.lit("Expression")), _rows(others, F.col("node"), "dp:hasExpressionText", F.col("text"), "literal"))


# Relations of methods that have a role of their own, by their names without other signs, in lower case.
METHOD_ROLES = {"start": "op:hasStartMethod", "abort": "op:hasAbortMethod", "checkstate": "op:hasCheckStateMethod"}


def export_facts(rows: DataFrame) -> DataFrame:
    """Languages, job methods, methods with their ports, initial values and access flags of plcopen.read_exports() rows."""
    pou, true = key("POU", "name"), F.lit("true")
    m = rows.select("name", F.explode("methods").alias("m")).select("name", *[F.col(f"m.{c}").alias("method" if c == "name" else c) for c in ("name", "ports", "code", "language", "return_type", "rpc_enabled")])
    node = key("Method", "method", "name")
    role = F.lower(F.regexp_replace("method", "[^A-Za-z0-9]", ""))
    p = m.select("name", "method", F.explode("ports").alias("x")).select("name", "method", F.col("x.name").alias("port"), F.col("x.direction").alias("direction"), F.col("x.type").alias("type"), F.col("x.init").alias("init"))
    public, local = p.where("direction <> 'Local'"), p.where("direction = 'Local'")
    port, var = key("Port", F.concat_ws("_", F.lit("Method"), "method", "name"), "port"), key("Var", F.concat_ws("_", F.lit("Method"), "method", "name"), "port")
    ports = rows.select(F.col("name").alias("pou"), F.explode("ports").alias("x")).select("pou", F.col("x.name").alias("name"), F.col("x.direction").alias("direction"), F.col("x.init").alias("init")).where("init is not null")
    flags = access_flags(rows.select(F.col("name").alias("owner"), F.explode("attributes").alias("a")).select("owner", F.col("a.name").alias("name"), F.col("a.attribute").alias("attribute"), F.coalesce("a.value", F.lit("1")).alias("value")))
    flagged = flags.select(F.col("owner").alias("pou"), F.lower("name").alias("k"), "visible", "writable").join(big(_declared(rows)), ["pou", "k"])
    parts = [
        _rows(rows, pou, "dp:hasPOULanguage", F.col("language"), "literal"),
        _rows(rows.where("job_method is not null"), pou, "dp:isJobMethod", true, "literal"),
        _rows(rows, pou, "dp:hasJobMethodName", F.col("job_method"), "literal"),
        _rows(m, pou, "op:hasMethod", node),
        _rows(m, node, "op:isMethodOf", pou),
        _rows(m, node, "rdf:type", F.lit("Method")),
        _rows(m, node, "dp:hasMethodType", F.col("method"), "literal"),
        _rows(m.where("code <> ''"), node, "dp:hasCode", F.col("code"), "literal"),
        _rows(m, node, "dp:hasPOULanguage", F.col("language"), "literal"),
        _rows(m, node, "dp:hasMethodReturnType", F.col("return_type"), "literal"),
        _rows(m, node, "dp:hasTcRpcEnabled", F.coalesce("rpc_enabled", F.lit(False)), "literal"),
        _rows(ports, F.when(F.col("direction") == "Local", key("Var", "pou", "name")).otherwise(key("Port", "pou", "name")), "dp:hasDefault", F.col("init"), "literal"),
        _rows(flagged.where("visible"), F.col("node"), "dp:hasOPCUADataAccess", true, "literal"),
        _rows(flagged.where("writable"), F.col("node"), "dp:hasOPCUAWriteAccess", true, "literal"),
    ]
    parts += [_rows(m.where(role == r), pou, relation, node) for r, relation in METHOD_ROLES.items()]
    for df, at, relation, what in ((public, port, "op:hasPort", "Port"), (local, var, "op:hasVariable", "Variable")):
        parts += [_rows(df, node, relation, at), _rows(df, at, f"dp:has{what}Name", F.col("port"), "literal"), _rows(df, at, f"dp:has{what}Type", F.col("type"), "literal"), _rows(df, at, "dp:hasDefault", F.col("init"), "literal")]
    return _all(*parts, _rows(public, port, "dp:hasPortDirection", F.col("direction"), "literal"))


def build(spark: SparkSession, rows: DataFrame, gvl: DataFrame | None = None, io: DataFrame | None = None, create_defaults: bool = True) -> DataFrame:
    """The program graph from unit rows, global variable lists and IO entries (plc_var, address, io_path, raw_xml).

    Rows of plcopen.read_exports() also bring their languages, methods and flags, the calls of their diagrams, what feeds
    each pin there, and the hardware variables that their ports stand for.

    In order: standard blocks, units, calls, globals and their uses, defaults, IO mapping with simulated lists, flow
    edges and ports that conditions read, unused names, the layers of states and outputs, and reports. Running it twice
    on its inputs gives the same set. The graph is a table in the folder that all executors share.
    """
    drawn, rows = "pins" in rows.columns, scratch(rows, "units")
    wired = diagrams.wires(rows) if drawn else None
    in_code = call_bindings(rows)
    bindings, found = scratch(in_code.unionByName(diagrams.diagram_bindings(rows, wired)) if drawn else in_code, "bindings"), defaults(rows)
    flows, idle = scratch(flow_edges(rows), "flows"), scratch(unused(rows), "unused")
    parts = [standard_blocks(spark), programs(rows), calls(rows, bindings), default_triples(rows, found, create_defaults), flow_triples(flows)]
    read = condition_ports(rows)
    at = key("PortInstance", "pou", "instance", "port")
    parts += [_rows(read, at, "rdf:type", F.lit("PortInstance")), _rows(read, at, "dp:hasExpressionText", F.concat_ws(".", "instance", "port"), "literal"), _rows(read, key("POU", "pou"), "op:readsInCondition", at)]
    if drawn:
        parts += [export_facts(rows), wire_triples(wired, rows)]
    if gvl is not None:
        names = gvl.select(F.col("name").alias("gvl"), F.explode("globals").alias("x")).select("gvl", F.col("x.name").alias("name"))
        parts += [globals_(gvl), global_uses(rows, names)]
    if io is not None:
        parts.append(io_mapping(io))
    graph = scratch(_all(*parts), "graph")
    if gvl is not None:
        graph = scratch(simulation_mirror(graph, names)[0], "graph")
    hardware = graph.where("p = 'dp:hasHardwareAddress'").select("s").join(graph.where("p = 'dp:hasVariableName'").select("s", F.col("o").alias("name")), "s").distinct()
    named = hardware.select("name").distinct()
    kinds = rows.select(F.col("name").alias("pou"), F.explode("ports").alias("x")).select("pou", F.col("x.name").alias("name"), F.col("x.direction").alias("direction"))
    idle_kinds = idle.join(big(kinds), ["pou", "name"])
    layers = gemma_layers(rows)
    called = calls_of(rows, bindings)
    true = F.lit("true")
    more = [
        _rows(idle_kinds.where("direction = 'Local'"), key("Var", "pou", "name"), "dp:isUnusedVar", true, "literal"),
        _rows(idle_kinds.where("direction <> 'Local'"), key("Port", "pou", "name"), "dp:isUnusedPort", true, "literal"),
        _rows(layers.where("is_modes"), key("POU", "pou"), "dp:isGEMMAStateMachine", true, "literal"),
        _rows(output_layer(rows, bindings, named, flows), key("POU", "pou"), "dp:isGEMMAOutputLayer", true, "literal"),
        _rows(consistency_reports(rows, called, idle), key("POU", "pou"), "dp:hasConsistencyReport", F.col("report"), "literal"),
    ]
    if drawn:
        pending = rows.select(F.col("name").alias("pou"), F.explode("external").alias("k", "external")).withColumn("k", F.lower("k")).join(_declared(rows), ["pou", "k"]).select(F.col("node").alias("var"), "external")
        more.append(mapped_variables(pending, hardware.select("name", F.col("s").alias("var"))))
    done = scratch(_all(graph, *more), "graph")
    discard(rows, bindings, flows, idle, graph, *([wired] if drawn else []))
    return done


def calls_of(rows: DataFrame, bindings: DataFrame) -> DataFrame:
    """(caller, callee) names, once each: the declared types of the instances that code calls."""
    return bindings.select("caller", _head("instance").alias("k")).join(big(_instances(rows)), ["caller", "k"]).select("caller", "callee").distinct()
