"""Turtle and N-Triples: a tokenizer for the subset that program graphs use, and table forms."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "s string, p string, o string, o_kind string, o_type string, o_lang string"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"

_TOKEN = re.compile(
    r'\s+|#[^\n]*|(?P<iri><[^>]*>)|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*""")|(?P<str>"(?:[^"\\\n]|\\.)*")|(?P<prefix>@prefix|@base|PREFIX\b|BASE\b)'
    r"|(?P<lang>@[A-Za-z][\w-]*)|(?P<type>\^\^)|(?P<num>[+-]?\d+\.\d+(?:[eE][+-]?\d+)?|[+-]?\d+(?:[eE][+-]?\d+)?)|(?P<blank>_:[\w.-]+)|(?P<name>[A-Za-z_][\w-]*:[\w.%-]*[\w%-]|:[\w.%-]*[\w%-]|[A-Za-z_][\w-]*:)|(?P<word>[A-Za-z]+)|(?P<mark>[.;,\[\]()])"
)
_ESCAPE = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\", "'": "'", "b": "\b", "f": "\f"}


def _text(s: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPE.get(m[3], m[3]), s, flags=re.S)


def parse(text: str) -> Iterator[tuple[str, str, str, str, str | None, str | None]]:
    """Triples (s, p, o, kind, type, language): prefixes, a, lists by ; and , , literals, blank nodes, collections."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at : at + 20]!r} at {at}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m.group()))
        at = m.end()
    prefixes: dict[str, str] = {}
    base, blanks, i = "", 0, 0
    out: list[tuple] = []

    def peek() -> tuple[str, str]:
        return tokens[i] if i < len(tokens) else ("end", "")

    def take() -> tuple[str, str]:
        nonlocal i
        i += 1
        if i > len(tokens):
            raise ValueError("text ends too early")
        return tokens[i - 1]

    def expect(mark: str) -> None:
        if take()[1] != mark:
            raise ValueError(f"{mark} expected before {tokens[i - 1][1]!r}")

    def fresh() -> str:
        nonlocal blanks
        blanks += 1
        return f"_:b{blanks}"

    def term() -> tuple[str, str, str | None, str | None]:
        kind, t = take()
        if kind == "iri":
            return (t[1:-1] if re.match(r"<[A-Za-z][\w+.-]*:", t) else base + t[1:-1]), "iri", None, None
        if kind == "name":
            p, _, rest = t.partition(":")
            if p not in prefixes:
                raise ValueError(f"unknown prefix {p}:")
            return prefixes[p] + rest, "iri", None, None
        if kind == "blank":
            return t, "iri", None, None
        if kind == "word" and t == "a":
            return RDF + "type", "iri", None, None
        if kind == "word" and t in ("true", "false"):
            return t, "literal", XSD + "boolean", None
        if kind == "num":
            return t, "literal", XSD + ("double" if "e" in t.lower() else "decimal" if "." in t else "integer"), None
        if kind in ("str", "long"):
            value = _text(t[3:-3] if kind == "long" else t[1:-1])
            if peek()[0] == "lang":
                return value, "literal", RDF + "langString", take()[1][1:]
            if peek()[0] == "type":
                take()
                return value, "literal", term()[0], None
            return value, "literal", XSD + "string", None
        if t == "[":
            node = fresh()
            if peek()[1] != "]":
                properties(node)
            expect("]")
            return node, "iri", None, None
        if t == "(":
            items = []
            while peek()[1] != ")":
                items.append(term())
            take()
            head = RDF + "nil"
            for item in reversed(items):
                node = fresh()
                out.append((node, RDF + "first", *item))
                out.append((node, RDF + "rest", head, "iri", None, None))
                head = node
            return head, "iri", None, None
        raise ValueError(f"unexpected {t!r}")

    def properties(s: str) -> None:
        while True:
            p = term()[0]
            while True:
                out.append((s, p, *term()))
                if peek()[1] != ",":
                    break
                take()
            while peek()[1] == ";":
                take()
            if peek()[1] in (".", "]") or i >= len(tokens) or tokens[i - 1][1] != ";":
                return

    while i < len(tokens):
        if peek()[0] == "prefix":
            word = take()[1].lstrip("@").lower()
            if word == "prefix":
                name = take()[1].rstrip(":")
                prefixes[name] = take()[1][1:-1]
            else:
                base = take()[1][1:-1]
            if peek()[1] == ".":
                take()
            continue
        s = term()[0]
        if peek()[1] != ".":
            properties(s)
        expect(".")
    yield from out


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Triples of all files at a path, as a set. A file is parsed as a whole by one task."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                yield pd.DataFrame(list(parse(bytes(content).decode())), columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA).dropDuplicates()


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of N-Triples files, as a set: a triple a line, so that large files are split and no Python is needed.

    Blank lines and comments go; a line of any other form raises an error when it is read.
    """
    # possessive: the JVM's patterns recurse once per repetition of any other group and run out of stack on long literals
    form = r'^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*(?:#.*)?$'
    part = lambda i: F.nullif(F.regexp_extract("value", form, i), F.lit(""))
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    literal = part(4).isNull() & part(5).isNull()
    # the escapes are JSON's, but for long code points and plain quotes
    body = F.regexp_replace(F.regexp_replace(F.regexp_extract("value", form, 6), r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1"), r"\\'", "'")
    text = F.from_json(F.concat(F.lit('["'), body, F.lit('"]')), "array<string>", {"allowUnquotedControlChars": "true"})[0]
    kind = F.when(literal, F.lit("literal")).otherwise(F.lit("iri"))
    type_ = F.when(literal & part(8).isNull(), F.coalesce(part(7), F.lit(XSD + "string")))
    ok = F.col("value").rlike(form)
    s = F.when(ok, F.coalesce(part(1), part(2))).otherwise(F.raise_error(F.concat(F.lit("no triple: "), F.col("value"))))
    return lines.select(s.alias("s"), part(3).alias("p"), F.coalesce(part(4), part(5), text).alias("o"), kind.alias("o_kind"), type_.alias("o_type"), part(8).alias("o_lang")).dropDuplicates()


def ntriples(triples: DataFrame) -> DataFrame:
    """One N-Triples line per triple, for write.text()."""
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), "\r", r"\\r")
    node = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    suffix: Column = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_type").isNotNull() & (F.col("o_type") != XSD + "string"), F.concat(F.lit("^^<"), "o_type", F.lit(">"))).otherwise("")
    o = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), escaped, F.lit('"'), suffix)).otherwise(node("o"))
    return triples.select(F.concat_ws(" ", node("s"), F.concat(F.lit("<"), "p", F.lit(">")), o, F.lit(".")).alias("value"))


def write_store(triples: DataFrame, path: str) -> None:
    """A triple table partitioned by predicate, so that a pattern with a known predicate reads one folder."""
    triples.dropDuplicates().write.mode("overwrite").partitionBy("p").parquet(path)
