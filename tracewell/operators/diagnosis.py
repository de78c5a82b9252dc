"""From traces to a diagnosis: which unit sets a skill, what must have held when, which rows matter, what they hang on."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from operator import add, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import logic
from ..functions.text import bool_text, scope_score
from .graph import reachable
from .pattern import first_of

NAME = r"[A-Za-z_][A-Za-z0-9_.]*"


def trigger_setter(setters: DataFrame, key: str, preferred: list[str], hints: list[str]) -> DataFrame:
    """Per key the unit that most likely sets its trigger: setters(key, idx, pou, n_true).

    50 for a snippet that sets TRUE, plus how well the unit's name fits; ties go to the smaller idx, then by name.
    """
    score = F.when(F.col("n_true") > 0, 50).otherwise(0) + scope_score("pou", preferred, hints)
    rows = setters.withColumn("score", score)
    return first_of(rows, [key], [-F.col("score"), F.col("idx"), F.col("pou")]).select(key, "pou", "score")


def skill_setter(units: DataFrame, key: str, preferred: list[str], process: str) -> DataFrame:
    """Per key the unit that sets a skill: units(key, pou, code). Ties go to the name that sorts last.

    4 for a preferred name, 3 for a variable that toggles itself, 2 for a call with a clock, 1 for the process's name.
    """
    code = F.col("code")
    toggles = code.rlike(rf"\b({NAME})\s*:=\s*NOT\s+\1\s*;")
    clocked = code.rlike(r"\b[A-Za-z_][A-Za-z0-9_]*\s*\(\s*CLK\s*:=")
    named = code.contains(process) if process else F.lit(False)
    points = lambda c, n: F.when(c, n).otherwise(0)
    rows = units.withColumn("score", points(F.col("pou").isin(*preferred), 4) + points(toggles, 3) + points(clocked, 2) + points(named, 1))
    return rows.groupBy(key).agg(F.max(F.struct("score", "pou")).alias("best")).select(key, "best.pou", "best.score")


REQUIREMENTS = "phase string, symbol string, value boolean, reason string"


def _blocker(literals: list[tuple[str, bool]]) -> tuple[str, bool]:
    """The literal that is easiest to deny: positive ones first, then outputs Q, dotted names, short names."""
    return min(literals, key=lambda x: (not x[1], 0 if x[0].endswith(".Q") else 1 if "." in x[0] else 2, len(x[0]), x[0]))


def phase_requirements(code: str, skill: str, variable: str) -> list[tuple[str, str, bool, str]]:
    """(phase, symbol, value, reason) of what must have held for code to leave skill in variable.

    The last assignment of the skill counts. Its first truth path holds at t-1; a symbol of it that toggled before
    had the other value at t-2; an output Q that must be TRUE needs its block's CLK or IN; and each later
    assignment of another skill has one literal denied, on its first path that is still possible; where a path has no
    literal left to deny, a row of phase risk says so. No assignment of the skill gives no rows.
    """
    literal = lambda a: a.value.strip("'\"").lower()
    found = [a for a in logic.assignments(code) if a.target.lower() == variable.lower()]
    own = [a for a in found if literal(a) == skill.lower()]
    if not own:
        return []
    chosen = own[-1]
    out: dict[tuple[str, str], tuple[bool, str]] = {}
    held: dict[str, bool] = {}

    def paths(conditions: list[str]) -> Iterator[list[tuple[str, bool]]]:
        return logic.ways(" AND ".join(f"({c})" for c in conditions)) if conditions else iter([])

    for token, value in next(paths(chosen.conditions), []):
        held[token] = value
        out["t-1", token] = value, "condition of the skill"
    for a in logic.assignments(code):
        if a.line < chosen.line and a.target in held and re.fullmatch(rf"(?i)NOT\s+{re.escape(a.target)}", a.value):
            out.setdefault(("t-2", a.target), (not held[a.target], "before it toggles"))
    passed = {name: {k.upper(): v for k, v in ins.items()} for name, _, ins, _ in reversed(logic.calls(code))}
    for token in [t for t, value in held.items() if value and re.fullmatch(r"[A-Za-z_]\w*\.Q", t)]:
        ins = passed.get(token[:-2], {})
        driver = ins.get("CLK") or ins.get("IN") or ""
        if re.fullmatch(NAME, driver) and driver not in held:
            held[driver] = True
            out["t-1", driver] = True, f"drives {token}"
    for a in found:
        if a.line <= chosen.line or literal(a) == skill.lower():
            continue
        for path in paths(a.conditions):
            if any(t in held and held[t] != v for t, v in path):
                continue
            free = [(t, v) for t, v in path if t not in held]
            if not free:
                out["risk", a.target] = True, f"line {a.line} overwrites the skill in any case"
                continue
            token, value = _blocker(free)
            held[token] = not value
            out["t-1", token] = not value, f"keeps line {a.line} from overwriting the skill"
            break
    return [(phase, symbol, value, reason) for (phase, symbol), (value, reason) in sorted(out.items())]


def skill_requirements(units: DataFrame, key: str, skill: str, variable: str) -> DataFrame:
    """phase_requirements() of each unit's code: units(key, code, skill) with the column skill naming the skill. Code that a
    task met a short while ago isn't read again."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = lru_cache(64)(phase_requirements)
        for b in batches:
            rows = [(k, *r) for k, code, wanted in zip(b[key], b["code"], b[skill], strict=True) if code and wanted for r in found(code, wanted, variable)]
            yield pd.DataFrame(rows, columns=[key, "phase", "symbol", "value", "reason"])

    return units.select(key, "code", skill).mapInPandas(run, f"{key} {units.schema[key].dataType.simpleString()}, {REQUIREMENTS}")


# What a row's kind adds to its score.
KIND_BONUS = {"job_method_assignment": 26, "internal_variable": 20, "instance_port": 18, "std_fb_dependency": 14, "local_port": 10, "terminal": -8, "job_method_input": -18}
ELAPSED = "elapsed"


def compact_paths(rows: DataFrame, constraints: DataFrame, most: int = 14) -> DataFrame:
    """Per path the rows that explain it: the best of each token, nearest phase first, at most most of them.

    rows(path, token, value, kind, reason, source, assignment, fb_type, depth), constraints(path, phase, token, value)
    with phases t0, t-1 and so on. Rows that stop or loop go, as do rows that contradict the constraint on their token
    and timers whose input is FALSE. Ties go to the shallower row, then by token.
    """
    rank = F.coalesce(F.regexp_extract("phase", r"^t-(\d+)$", 1).try_cast("int"), F.when(F.col("phase") == "t0", 0).otherwise(999))
    limits = constraints.select("path", F.col("phase").alias("c_phase"), rank.alias("c_rank"), F.col("token").alias("c_token"), bool_text("value").alias("c_value"))
    limits = limits.groupBy("path", "c_phase", "c_rank", "c_token").agg(F.max("c_value").alias("c_value"))
    phases = limits.where("c_phase <> 't0'").groupBy("path", F.col("c_token").alias("token")).agg(F.min(F.struct("c_rank", "c_phase")).alias("near"))
    text = F.lower(F.concat_ws(" ", "kind", "reason", "source"))
    kept = rows.where(F.coalesce(F.trim("value"), F.lit("")) != "").where(~F.col("kind").isin("stop", "loop") & ~text.contains("max_depth") & ~text.contains("loop detected"))
    kept = kept.join(phases, ["path", "token"], "left").withColumn("phase", F.coalesce("near.c_phase", F.lit("t0"))).withColumn("phase_rank", F.coalesce("near.c_rank", F.lit(0))).drop("near")

    def required(df: DataFrame, token: Column, name: str) -> DataFrame:
        own = limits.select(F.col("path").alias("l_path"), F.col("c_phase"), F.col("c_token"), F.col("c_value").alias(name))
        on = (F.col("path") == F.col("l_path")) & (F.col("phase") == F.col("c_phase")) & (token == F.col("c_token"))
        return df.join(own, on, "left").drop("l_path", "c_phase", "c_token")

    elapsed, is_true = F.lower("value").contains(ELAPSED), bool_text("value") == "TRUE"
    differs = bool_text("value").isNotNull() & F.col("own").isNotNull() & (bool_text("value") != F.col("own"))
    kept = required(kept, F.col("token"), "own").where(~F.coalesce(differs, F.lit(False))).drop("own")
    timer = F.coalesce(F.upper("fb_type") == "TON", F.lit(False))
    kept = kept.withColumn("inst", F.when(timer & F.col("token").contains("."), F.substring_index("token", ".", 1)))
    passed = F.nullif(F.trim(F.regexp_extract("assignment", r"(?i)\bIN\s*:=\s*([^,)\r\n]+)", 1)), F.lit(""))
    kept = kept.withColumn("in_expr", F.when(timer, passed))
    inputs = kept.where("inst is not null and in_expr is not null").groupBy("path", "inst").agg(F.min_by("in_expr", F.struct("depth", "in_expr")).alias("known"))
    kept = kept.join(inputs, ["path", "inst"], "left").withColumn("in_expr", F.coalesce("in_expr", "known"))
    plain = F.trim(F.regexp_replace("in_expr", r"^\(+|\)+$", ""))
    negated = F.coalesce(plain.rlike(rf"(?i)^NOT\s+{NAME}$"), F.lit(False))
    name = F.regexp_replace(plain, r"(?i)^NOT\s+", "")
    kept = required(kept, name, "in_value")
    kept = required(kept, F.concat("inst", F.lit(".Q")), "q_value")
    known = F.coalesce(F.when(F.upper(name).isin("TRUE", "FALSE"), F.upper(name)), F.col("in_value"))
    off = F.coalesce(F.when(negated, known == "TRUE").otherwise(known == "FALSE"), F.lit(False))
    runs = (F.col("token").endswith(".Q") & F.coalesce(is_true, F.lit(False))) | (F.col("token").endswith(".PT") & elapsed)
    late = F.col("token").endswith(".PT") & elapsed & F.coalesce(F.col("q_value") == "FALSE", F.lit(False))
    kept = kept.where(~(timer & ((runs & off) | late)))
    bonus = F.coalesce(F.create_map(*[F.lit(x) for kv in KIND_BONUS.items() for x in kv])[F.col("kind")], F.lit(0))
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False)).cast("int")
    score = 100 - 2 * F.least("depth", F.lit(999)) + bonus + 6 * elapsed.cast("int") + 4 * has("assignment") + 3 * has("fb_type") + F.when(F.col("source") == "default", 2).otherwise(0)
    best = first_of(kept.withColumn("score", score), ["path", "token"], [-F.col("score"), F.col("depth"), F.col("value")])
    order = Window.partitionBy("path").orderBy("phase_rank", "depth", F.desc("score"), "token")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("path", "place", "token", "value", "kind", "phase", "depth", "score")


# Marks of a hardware address in a row's text, and tokens of job methods, which are no causes.
HARDWARE_MARKS = ("hardware_address", "dp_hashardwareaddress", "%ix", "%iw", "%id", "%qx", "%qw", "%qd", "%mx", "%mw", "%md")
METHOD_TOKENS = ("hdl", "start", "abort", "checkstate")


# Points of what speaks for a row as the root of a chain, and of what speaks against it.
ANCHOR_POINTS = {
    "hardware": 180,
    "wired": 70,
    "hardware_fact": 50,
    "default": 30,
    "end": 25,
    "global_name": 8,
    "running_job": -40,
    "method_word": -80,
    "method_call": -120,
    "job_method": -220,
}
MOST_ROW_POINTS = 10


def anchor_signs() -> dict[str, Column]:
    """The signs of ANCHOR_POINTS as conditions on a row's token, pou, value, assignment, source, reason and kind."""
    c = {n: F.lower(F.trim(F.coalesce(F.col(n), F.lit("")))) for n in ("token", "pou", "value", "assignment", "source", "reason", "kind")}
    anywhere = lambda names, needles: reduce(or_, [c[n].contains(x) for n in names for x in needles])
    hardware = anywhere(("token", "pou", "value", "assignment", "source", "reason"), HARDWARE_MARKS)
    return {
        "job_method": (c["source"] == "job_method") | (c["kind"] == "job_method_input") | c["reason"].contains("job-method input"),
        "method_call": c["token"].contains("methodcall"),
        "method_word": c["token"].isin(*METHOD_TOKENS),
        "running_job": c["token"].contains("jobrunning"),
        "hardware": hardware,
        "hardware_fact": hardware & c["source"].isin("global", "metadata"),
        "wired": c["source"] == "wiring",
        "end": c["kind"].isin("global_variable", "terminal"),
        "default": anywhere(("assignment", "source", "reason"), ("default",)),
        "global_name": c["token"].startswith("gvl_") | c["token"].startswith("opcua."),
    }


def anchor_score(row_no: str = "row_no") -> Column:
    """How likely a row is a chain's root: hardware and wiring first, job methods last, later rows a little more."""
    points = [F.when(sign, ANCHOR_POINTS[name]).otherwise(0) for name, sign in anchor_signs().items()]
    return reduce(add, points, F.least(F.lit(MOST_ROW_POINTS), F.coalesce(F.col(row_no), F.lit(0))))


def root_anchor(rows: DataFrame, key: str) -> DataFrame:
    """Per key the row with the best anchor_score; ties go to the first row, then by token."""
    return first_of(rows.withColumn("score", anchor_score()), [key], [-F.col("score"), F.col("row_no"), F.col("token")]).select(key, "row_no", "token", "score")


def bridges(rows: DataFrame, key: str, most: int = 10) -> DataFrame:
    """Per key the first distinct assignments that map one port to another (<= or =>), without their annotations."""
    text = F.trim(F.substring_index("assignment", "[", 1))
    found = rows.where(F.col("assignment").contains("<=") | F.col("assignment").contains("=>")).groupBy(key, F.coalesce(F.nullif(F.trim("pou"), F.lit("")), F.lit("-")).alias("pou"), text.alias("assignment")).agg(F.min("row_no").alias("row_no"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("row_no", "pou", "assignment"))
    return found.withColumn("place", place).where(F.col("place") <= most).select(key, "place", "pou", "assignment")


def causal_chain(rows: DataFrame, key: str, ordered: list[str], last: str) -> DataFrame:
    """Per key (key, place, token): the root anchor, then those of the ordered tokens that its rows have, then last."""
    at = F.array_position(F.array(*[F.lit(t.lower()) for t in ordered]), F.lower(F.trim("token")))
    known = rows.withColumn("at", at).where("at > 0").groupBy(key, "at").agg(F.min_by("token", F.struct("row_no", "token")).alias("token"))
    ends = rows.select(key).distinct().select(key, F.lit(len(ordered) + 1).alias("at"), F.lit(last).alias("token"))
    parts = root_anchor(rows, key).select(key, F.lit(0).cast("long").alias("at"), "token").unionByName(known).unionByName(ends)
    once = parts.groupBy(key, "token").agg(F.min("at").alias("at"))
    return once.select(key, F.row_number().over(Window.partitionBy(key).orderBy("at", "token")).alias("place"), "token")


def evidence_lines(rows: DataFrame, key: str, tokens: list[str], marks: list[str], defaults: list[str], most: int = 12) -> DataFrame:
    """Per key the first distinct lines of text about rows whose token is listed, whose assignment or source has one of
    the marks, or which give one of the defaults tokens its default."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    both = F.concat_ws("\n", low("assignment"), low("source"))
    keep = F.trim(low("token")).isin(*[t.lower() for t in tokens])
    for m in marks:
        keep = keep | both.contains(m.lower())
    keep = keep | (F.trim(low("token")).isin(*[t.lower() for t in defaults]) & F.concat_ws("\n", both, low("reason")).contains("default"))
    part = lambda c: F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) != "", F.concat(F.lit(f"{c}="), F.trim(F.col(c))))
    line = F.concat_ws(" | ", *[part(c) for c in ("phase", "token", "value", "pou", "assignment", "source")])
    found = rows.where(keep).groupBy(key, line.alias("line")).agg(F.min("row_no").alias("row_no"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("row_no", "line"))).where(F.col("place") <= most).select(key, "place", "line")


def dependent_symbols(assignments: DataFrame, unit: str, start: str, max_depth: int = 50) -> DataFrame:
    """(unit, symbol) that depend on the start symbol of their unit: assignments(unit, target, value), start in every row.

    A symbol depends on another where its value mentions it; case is ignored. More than max_depth steps are an error.
    """
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("value"), F.lit(r"([a-z_][a-z0-9_.]*)"), F.lit(1))))
    node = lambda c: F.concat(F.col(unit).cast("string"), F.lit("\x1f"), c)
    edges = assignments.select(unit, F.lower("target").alias("t"), words.alias("w")).select(node(F.col("w")).alias("src"), node(F.col("t")).alias("dst")).distinct()
    roots = assignments.select(node(F.lower(start)).alias("root")).distinct()
    found = reachable(edges, roots, max_depth)
    parts = F.split("node", "\x1f", 2)
    return found.select(parts[0].alias(unit), parts[1].alias("symbol")).distinct()


def skill_suggestions(implemented: DataFrame, called: DataFrame) -> DataFrame:
    """(function, label, source, confidence, runtime_names, pous): from implemented skills or, if there are none at all,
    from calls of skill sets.

    implemented(pou, skill, label, confidence), called(pou, runtime, mapped, label). Suggestions of one function are
    merged: highest confidence, first label by name, sets of names in order.
    """
    clean = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_]+", "_")
    human = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_\s]+", " "))
    first = implemented.select(clean("skill").alias("function"), F.coalesce("label", human("skill")).alias("label"), F.lit("implements").alias("source"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.array("pou").alias("names"), "pou")
    mapped = F.col("mapped").isNotNull()
    second = called.select(F.coalesce("mapped", clean("runtime")).alias("function"), F.coalesce(F.when(mapped, F.col("label")), human(F.coalesce("mapped", "runtime"))).alias("label"), F.when(mapped, "called, mapped").otherwise("called").alias("source"), F.when(mapped, 0.85).otherwise(0.7).alias("confidence"), F.array("runtime", "pou").alias("names"), "pou")
    # whether the other table has any row is one row, never its size
    none = implemented.agg((F.count("*") == 0).alias("none"))
    rows = first.unionByName(second.join(F.broadcast(none), F.col("none"), "left_semi"))
    return rows.groupBy("function").agg(F.min("label").alias("label"), F.min("source").alias("source"), F.max("confidence").alias("confidence"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("names")))).alias("runtime_names"), F.sort_array(F.collect_set("pou")).alias("pous"))


def counterpart(c: str | Column, pairs: tuple[tuple[str, str], ...] = (("_aussen", "_innen"), ("_innen", "_aussen"))) -> Column:
    """The name of the sensor at the other end, by suffix; null where a name has none. Only the last part counts."""
    short = F.substring_index(F.col(c) if isinstance(c, str) else c, ".", -1)
    out: Column = F.lit(None).cast("string")
    for a, b in reversed(pairs):
        out = F.when(F.lower(short).endswith(a), F.concat(F.substring(short, F.lit(1), F.length(short) - len(a)), F.lit(b))).otherwise(out)
    return out


def variable_context(tokens: DataFrame, triples: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Hardware context of tokens(token): snapshot value, metadata, incoming sources, and what kind of variable it is.

    Triples are (s, p, o) of variables and assignments; snapshot(id, v). mode is hardware where there is an address.
    Names match as a whole; a token without a variable has empty arrays and mode software.
    """
    values = lambda p: triples.where(F.col("p") == p).select("s", "o")
    vars_ = tokens.select("token").distinct().join(values("dp:hasVariableName").select(F.col("s").alias("var"), F.col("o").alias("token")), "token", "left")

    def gather(p: str, name: str) -> DataFrame:
        return values(p).groupBy(F.col("s").alias("var")).agg(F.collect_set("o").alias(name))

    into = values("op:assignsToVariable").select(F.col("s").alias("a"), F.col("o").alias("var"))
    source = values("op:assignsFrom").select(F.col("s").alias("a"), F.col("o").alias("src"))
    named = values("dp:hasVariableName").unionByName(values("dp:hasExpressionText")).select(F.col("s").alias("src"), F.col("o").alias("name"))
    incoming = into.join(source, "a").join(named, "src").groupBy("var").agg(F.collect_set("name").alias("incoming"))
    out = vars_.join(gather("dp:hasVariableType", "types"), "var", "left").join(gather("dp:hasHardwareAddress", "addresses"), "var", "left").join(incoming, "var", "left")
    sets = [F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(c) for c in ("types", "addresses", "incoming")]
    out = out.groupBy("token").agg(*sets)
    seen = snapshot.select(F.col("id").alias("token"), "v").groupBy("token").agg(F.min("v").alias("snapshot_value"))
    starts = lambda d: F.exists("addresses", lambda a: F.upper(a).rlike(rf"^(%{d}|{d}\s*\d)"))
    is_bool = F.exists("types", lambda t: F.upper(t) == "BOOL")
    flags = out.join(seen, "token", "left").withColumn("is_sensor", starts("I") & is_bool).withColumn("is_actor", starts("Q")).withColumn("is_simulated", F.exists("incoming", lambda s: F.upper(s).contains("_SIM")))
    return flags.withColumn("counterpart", counterpart("token")).withColumn("mode", F.when(F.size("addresses") > 0, "hardware").otherwise("software"))
