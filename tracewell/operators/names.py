"""Where the text of an argument or assignment comes from: one pass of joins, and a tier for each answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_id
from ..tables import big
from .etl import _all, _declared, _facts, _instances, _rows, key

NAME = r"[A-Za-z_]\w*+"
# How names of global lists begin, in lower case.
GLOBAL_PREFIXES = ("gv", "opcua")
# Words of expressions that are no names.
OPERATORS = ("true", "false", "and", "or", "xor", "not", "mod", "div")


def signal_sources(uses: DataFrame, rows: DataFrame, known: DataFrame) -> DataFrame:
    """uses(pou, expression) with tier and target, each distinct pair once.

    The text counts without parentheses and NOT. In order: known, a name of known(name, node), case ignored; literal, a
    number, time, quoted text or truth value; global, a dotted path of a global list; port, instance.port of one of the
    unit's own instances; member, any other name.name, as a variable of the unit; expression, what has operators, by its
    whole text; local, a name that the unit declares, as it declares it; new, any other name, as a variable of the unit.
    A null or blank expression has no row. Units are rows(name, ports); of a name that known has twice the least node counts.
    """
    text = F.trim(F.regexp_replace("expression", r"\bNOT\s+|[()]", ""))
    u = uses.select("pou", "expression").distinct().withColumn("text", text).where("trim(expression) <> ''")
    path, head = F.col("text").rlike(rf"^{NAME}(?:\.{NAME})++$"), F.substring_index("text", ".", 1)
    pair = F.col("text").rlike(rf"^{NAME}\s*\.\s*{NAME}$")
    first, second = F.trim(head), F.trim(F.expr("substring(text, length(substring_index(text, '.', 1)) + 2)"))
    u = u.withColumns({"k": F.lower("text"), "i": F.when(pair, F.lower(first)), "pair": pair, "path": path})
    nodes = known.groupBy(F.lower("name").alias("k")).agg(F.min("node").alias("node"))
    own = _declared(rows).groupBy("pou", "k").agg(F.min_by("node", "name").alias("own"))
    typed = _instances(rows).groupBy(F.col("caller").alias("pou"), F.col("k").alias("i")).agg(F.max("callee").alias("type"))
    u = u.join(nodes, "k", "left").join(big(own), ["pou", "k"], "left").join(big(typed), ["pou", "i"], "left")
    begins = F.lit(False)
    for p in GLOBAL_PREFIXES:
        begins = begins | F.lower(head).startswith(p)
    literal = F.col("text").rlike(r"^[-+]?\d|^'.*'$") | F.col("k").rlike("^(?:t|time)#") | F.col("k").isin("true", "false")
    operators = F.col("expression").rlike(r"[-+*/=<>\s()]")
    tiers = [
        ("known", F.col("node").isNotNull(), F.col("node")),
        ("literal", literal, key("Literal", "text")),
        ("global", F.col("path") & begins, key("Var", F.translate("text", ".", "_"))),
        ("port", F.col("pair") & F.col("type").isNotNull(), key("PortInstance", "pou", first, second)),
        ("member", F.col("pair"), key("Var", "pou", F.concat_ws(".", first, second))),
        ("expression", operators, F.concat_ws("_", F.lit("Expression"), "pou", stable_id(F.col("pou"), F.trim("expression")))),
        ("local", F.col("own").isNotNull(), F.col("own")),
        ("new", F.lit(True), key("Var", "pou", "text")),
    ]
    tier, target = F.lit(None), F.lit(None)
    for name, holds, node in reversed(tiers):
        tier, target = F.when(holds, F.lit(name)).otherwise(tier), F.when(holds, node).otherwise(target)
    return u.select("pou", "expression", "text", tier.alias("tier"), target.alias("target"))


def source_triples(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Triples of the sources that signal_sources() found: literals and expressions with their texts, variables that are new,
    and what an expression is made of: globals, names that the unit declares, and times."""
    e = found.where("tier = 'expression'")
    kind = F.when(F.col("tier") == "literal", "SourceLiteral").when(F.col("tier") == "expression", "Expression").when(F.col("tier") == "port", "PortInstance").when(F.col("tier").isin("new", "member"), "Variable")
    text = F.when(F.col("tier") == "literal", F.col("text")).when(F.col("tier") == "expression", F.trim("expression"))
    name = F.when(F.col("tier").isin("new", "member"), F.col("text"))
    words = e.select("pou", "target", F.explode(F.array_distinct(F.regexp_extract_all("expression", F.lit(rf"({NAME}(?:#[\w.]+|(?:\.{NAME})*+))"), F.lit(1)))).alias("w")).withColumn("k", F.lower("w")).where(~F.col("k").isin(*OPERATORS))
    own = _declared(rows).groupBy("pou", "k").agg(F.min_by("node", "name").alias("own"))
    words = words.join(big(own), ["pou", "k"], "left")
    begins = F.lit(False)
    for p in GLOBAL_PREFIXES:
        begins = begins | F.col("k").startswith(p)
    part = F.when(F.col("k").rlike("^(?:t|time)#"), key("Literal", "w")).when(begins & F.col("w").contains("."), key("Var", F.translate("w", ".", "_"))).otherwise(F.col("own"))
    return _all(
        _facts(found, (F.col("target"), "rdf:type", kind, "iri"), (F.col("target"), "dp:hasExpressionText", text, "literal"), (F.col("target"), "dp:hasVariableName", name, "literal")),
        _rows(words, F.col("target"), "op:isExpressionCreatedBy", part),
    )
