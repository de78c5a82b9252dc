"""Scalar functions on names, code and addresses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_space(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def safe_int(c: str | Column, default: int = 0) -> Column:
    """An integer from text or a number: true and false are 1 and 0, fractions are cut off, anything else is default."""
    s = F.lower(F.trim(_c(c).cast("string")))
    return F.when(s == "true", 1).when(s == "false", 0).otherwise(F.coalesce(s.try_cast("double").cast("long"), F.lit(default)))


def scope(c: str | Column) -> Column:
    """Letters and digits before the first _ or . of a name; empty if there is neither."""
    return F.regexp_extract(_c(c), r"^([A-Za-z0-9]+)[_.]", 1)


def name_score(name: str | Column, prefix: str) -> Column:
    """How well a name fits a preferred prefix: exact 100, its scope 60, any beginning 40, anywhere 20, else 0."""
    n, p = F.lower(_c(name)), prefix.lower()
    return F.greatest(F.when(n == p, 100).otherwise(0), F.when(F.lower(scope(_c(name))) == p, 60).otherwise(0), F.when(n.startswith(p), 40).otherwise(0), F.when(n.contains(p), 20).otherwise(0))


def scope_score(name: str | Column, preferred: list[str], hints: list[str]) -> Column:
    """The best fit of a name: a preferred name 100, its scope 60; a hint 90, as its scope 50, before _ 40, anywhere 20."""
    n = F.lower(_c(name))
    own = F.lower(scope(_c(name)))
    found = [F.lit(0)]
    for p in preferred:
        ours = p.lower().replace(".", "_").partition("_")[0]
        found.append(F.when(n == p.lower(), 100).when(own == ours, 60).otherwise(0))
    for h in (x.lower() for x in hints):
        found.append(F.when(n == h, 90).when(own == h, 50).when(n.startswith(h + "_"), 40).when(n.contains(h), 20).otherwise(0))
    return F.greatest(*found) if len(found) > 1 else found[0]


def node_id(c: str | Column) -> Column:
    """The identifier of an address such as ns=4;s=Area.x; short forms stay as they are."""
    return F.coalesce(F.nullif(F.regexp_extract(_c(c), r"^ns=\d+;[sigb]=(.*)$", 1), F.lit("")), _c(c))


def aliases(c: str | Column) -> Column:
    """Array of (alias, score) of a name, in lower case: its id 100, the text as it stands 80, the last three parts 92, two
    88, one 55, a method's name in it 94. Of equal aliases the first counts."""
    raw, whole = F.trim(_c(c)), node_id(F.trim(_c(c)))
    parts = F.filter(F.transform(F.split(whole, r"\."), lambda x: F.trim(x)), lambda x: x != "")
    entry = lambda a, s: F.struct(F.lower(a).alias("alias"), F.lit(s).alias("score"))
    tail = lambda n, s: F.when(F.size(parts) >= n, entry(F.array_join(F.slice(parts, -n, n), "."), s))
    method = F.regexp_extract(whole, r"(?i)\b((?:JobMethode|Method)_[A-Za-z0-9_]+)\b", 1)
    found = F.array_compact(F.array(entry(whole, 100), entry(raw, 80), tail(3, 92), tail(2, 88), tail(1, 55), F.when(method != "", entry(method, 94))))
    names = F.transform(found, lambda e: e["alias"])
    return F.filter(found, lambda e, i: (e["alias"] != "") & (F.array_position(names, e["alias"]) == i + 1))


def strip_comments(c: str | Column) -> Column:
    """Structured text without (* *) and // comments."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"(?s)\(\*.*?\*\)", ""), r"//[^\n]*", "")


def identifiers(c: str | Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_c(c), F.lit(f"({IDENTIFIER})"), F.lit(1)))


def escape_iri(c: str | Column) -> Column:
    return F.replace(F.replace(F.replace(_c(c), F.lit("^"), F.lit("__dach__")), F.lit("."), F.lit("__dot__")), F.lit(" "), F.lit("__leerz__"))


def unescape_iri(c: str | Column) -> Column:
    return F.replace(F.replace(F.replace(_c(c), F.lit("__dach__"), F.lit("^")), F.lit("__dot__"), F.lit(".")), F.lit("__leerz__"), F.lit(" "))


def stable_id(*cs: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *cs)), 1, 10)


def state_alias(c: str | Column) -> Column:
    """The state name (A, F or D and digits) at the end of a dotted name; empty if there is none."""
    return F.regexp_extract(_c(c), r"(?:^|\.)([AFD]\d+)$", 1)


def hardware_address(c: str | Column) -> Column:
    """Struct (direction, byte, bit) of %I3.5, %QX0.1 or "I 3.5"; null if there is none."""
    at = lambda i: F.regexp_extract(_c(c), r"%?([IQM])[XWDB]?\s?(\d+)(?:\.(\d+))?", i)
    return F.when(at(1) != "", F.struct(at(1).alias("direction"), at(2).cast("int").alias("byte"), F.when(at(3) != "", at(3).cast("int")).alias("bit")))


def bool_text(c: str | Column) -> Column:
    """TRUE, FALSE or null of "BOOL#TRUE", 1, "false" and texts that hold exactly one of the two words."""
    s = F.upper(F.trim(_c(c).cast("string")))
    t, f = s.contains("TRUE") | (s == "1"), s.contains("FALSE") | (s == "0")
    return F.when(t & ~f, "TRUE").when(f & ~t, "FALSE")


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(_c(a), _c(b)))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / union)


def overlap(a: str | Column, b: str | Column) -> Column:
    return F.size(F.array_intersect(_c(a), _c(b))) / F.greatest(F.lit(1), F.size(_c(b)))


def wrap_snapshot(c: str | Column) -> Column:
    return F.concat(F.lit("==InventorySnapshot=="), _c(c), F.lit("==InventorySnapshot=="))


def unwrap_snapshot(c: str | Column) -> Column:
    """The text between the marks; a text without marks stays."""
    inner = F.regexp_extract(_c(c), r"(?s)==InventorySnapshot==(.*?)==InventorySnapshot==", 1)
    return F.when(inner != "", inner).otherwise(_c(c))


def strip_fence(c: str | Column) -> Column:
    """Text without Markdown code fences around it."""
    return F.trim(F.regexp_replace(_c(c), r"(?m)^```[A-Za-z]*[ \t]*$", ""))


def quote_job_id(c: str | Column) -> Column:
    """JSON whose jobId value lacks its quotes, repaired; numbers, null and quoted values stay."""
    return F.regexp_replace(_c(c), r'("jobId"\s*:\s*)(?!null\b|-?\d+(?:\.\d+)?\s*[,}])([A-Za-z0-9_][^",}\s]*)', r'$1"$2"')


def verdict(c: str | Column) -> Column:
    """A verdict in lower case if it is a known one, else judge_error."""
    v = F.lower(F.trim(_c(c)))
    return F.when(v.isin("correct", "partially_correct", "incorrect", "not_evaluable", "skipped_no_ground_truth"), v).otherwise("judge_error")


def preview(c: str | Column, n: int) -> Column:
    return F.when(F.length(_c(c)) > n, F.concat(F.substring(_c(c), 1, n), F.lit("..."))).otherwise(_c(c))


def correlation_id(prefix: str, nanos: str | Column, counter: str | Column) -> Column:
    """prefix-nanos-counter of a time and a running number that the caller keeps, so that it can be told again."""
    return F.concat_ws("-", F.lit(prefix), _c(nanos).cast("string"), _c(counter).cast("string"))


def checkable(sensor: str | Column, *sets: str | Column) -> Column:
    """checkable where one of the arrays has the sensor, else not_checkable."""
    known = F.lit(False)
    for s in sets:
        known = known | F.coalesce(F.array_contains(_c(s), _c(sensor)), F.lit(False))
    return F.when(known, "checkable").otherwise("not_checkable")


# Words of a question that ask for a chain of origin, and those that ask for a root cause.
CHAIN_WORDS = ("woher", "herkommt", "wo kommt", "wo gesetzt", "gesetzt wird", "ursprung", "origin", "kette", "trace", "call chain")
CAUSE_WORDS = ("root-cause", "root cause", "ursache", "gesamtanalyse", "warum evd2", "warum triggerd2", "triggerd2", "opcua.triggerd2", "gemma")
# What stands before the name in a question for an origin.
ASKING = ("woher kommt", "wo kommt", "ursprung von")
#: A name with members.
DOTTED = "[A-Za-z_][A-Za-z0-9_.]*+"
# Words that are no symbols, whatever they look like.
NO_SYMBOLS = ("ok", "bitte", "wo", "wie", "warum", "was", "und", "oder", "die", "der", "das", "von", "mit", "kette", "komplette", "frage", "user", "diagnose", "trigger", "root", "cause", "false", "true")


def _has_any(c: str | Column, words: tuple[str, ...]) -> Column:
    text = F.lower(F.coalesce(_c(c), F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def wants_chain(question: str | Column) -> Column:
    return _has_any(question, CHAIN_WORDS)


def wants_cause(question: str | Column, first_turn: bool | Column) -> Column:
    """Whether a question asks for a root cause; an empty first one does."""
    first = F.lit(first_turn) if isinstance(first_turn, bool) else first_turn
    return (first & (F.trim(F.coalesce(_c(question), F.lit(""))) == "")) | _has_any(question, CAUSE_WORDS)


def focus_symbols(question: str | Column, most: int = 4) -> Column:
    """The first names of a question that look like symbols: with _, . or a digit, or in camel case; each once."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(_c(question), F.lit("")), F.lit(f"({DOTTED})"), F.lit(1)))
    looks_like_one = lambda t: t.contains("_") | t.contains(".") | t.rlike(r"\d") | t.startswith("OPCUA") | t.startswith("GVL") | t.rlike("[a-z][A-Z]")
    return F.slice(F.filter(found, lambda t: ~F.lower(t).isin(*NO_SYMBOLS) & looks_like_one(t)), 1, most)


def asked_symbol(question: str | Column) -> Column:
    """The name before an =, else the one behind a phrase that asks where something comes from; else empty."""
    q = F.coalesce(_c(question), F.lit(""))
    before = F.regexp_extract(q, rf"({DOTTED})\s*=", 1)
    asks = "|".join(w.replace(" ", r"\s+") for w in ASKING)
    behind = F.regexp_extract(q, rf"(?i)(?:{asks})\s+({DOTTED})", 1)
    return F.when(before != "", before).otherwise(behind)
