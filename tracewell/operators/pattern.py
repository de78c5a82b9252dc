"""Patterns over triples, and the relational operators on their bindings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples with the given terms; None is a variable."""
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            triples = triples.where(F.col(name) == value)
    return triples


def bgp(triples: DataFrame, *patterns: tuple[str, str, str]) -> DataFrame:
    """Bindings of a basic graph pattern: terms that begin with ? are variables, shared ones are joined.

    A variable twice in one pattern must be equal. Patterns that share no variable with the ones before them are
    refused: their product has no bound.
    """
    out: DataFrame | None = None
    for pattern in patterns:
        fixed = {c: t for c, t in zip("spo", pattern, strict=True) if not t.startswith("?")}
        free: dict[str, Column] = {}
        rows = match(triples, **fixed)
        for c, t in zip("spo", pattern, strict=True):
            if t.startswith("?"):
                if t[1:] in free:
                    rows = rows.where(free[t[1:]] == F.col(c))
                free.setdefault(t[1:], F.col(c))
        rows = rows.select(*[v.alias(k) for k, v in free.items()])
        if out is None:
            out = rows
        elif shared := [v for v in free if v in out.columns]:
            out = out.join(rows, shared)
        else:
            raise ValueError(f"{pattern} shares no variable with the patterns before it")
    if out is None:
        raise ValueError("no pattern")
    return out


def optional(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """OPTIONAL: left outer join; a nested one is a left join onto a right side that is joined already."""
    return left.join(right, on, "left")


def contains_ci(c: str | Column, needle: str) -> Column:
    return F.lower(F.col(c) if isinstance(c, str) else c).contains(needle.lower())


def equals_ci(c: str | Column, value: str) -> Column:
    return F.lower(F.col(c) if isinstance(c, str) else c) == value.lower()


def iri_ends(c: str, name: str) -> Column:
    """Whether an IRI's last part, after # or / or from the start, is the name."""
    column = F.col(c)
    return (column == name) | column.endswith("#" + name) | column.endswith("/" + name)


def union_search(kinds: dict[str, tuple[DataFrame, Column, Column]], needle: str) -> DataFrame:
    """(category, id, name) over several kinds of entity whose name contains needle, case ignored."""
    rows = [df.select(F.lit(k).alias("category"), i.cast("string").alias("id"), n.alias("name")) for k, (df, i, n) in kinds.items()]
    return reduce(DataFrame.unionByName, rows).where(contains_ci("name", needle)).distinct()


def expectations_met(candidates: DataFrame, expected: DataFrame, actual: DataFrame, key: str, item: str, value: str) -> DataFrame:
    """candidates(key) with met: whether each of its expected (item, value) is what actual has; a missing item is not.

    A candidate that expects nothing is met.
    """
    have = actual.select(key, item, F.col(value).alias("__actual"))
    checks = expected.join(have, [key, item], "left").select(key, F.coalesce(F.col(value) == F.col("__actual"), F.lit(False)).alias("ok"))
    folded = checks.groupBy(key).agg(F.bool_and("ok").alias("ok"))
    return candidates.join(folded, key, "left").select(*candidates.columns, F.coalesce("ok", F.lit(True)).alias("met"))


def close_to(a: Column, b: Column, rel: float = 1e-6, least: float = 1e-9) -> Column:
    """Equality of doubles with a relative and an absolute tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(least), rel * F.greatest(F.abs(a), F.abs(b)))


def overwrite(triples: DataFrame, new: DataFrame, subject_predicate: bool = True) -> DataFrame:
    """triples without those that new replaces (same subject and predicate, or the same triple), and new itself."""
    on = ["s", "p"] if subject_predicate else ["s", "p", "o"]
    return triples.join(new.select(*on).distinct(), on, "left_anti").unionByName(new).dropDuplicates()


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the first in an explicit total order, by one grouped aggregation (no window)."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("__r")).select(*keys, "__r.*")


def resolve_names(tokens: DataFrame, token: str, *lookups: tuple[str, DataFrame, str, str]) -> DataFrame:
    """tokens with kind and target from the first lookup (kind, table, name column, target column) that knows the name.

    Names compare without case; within a table the least target wins.
    """
    out = tokens.withColumn("__k", F.lower(F.col(token)))
    for i, (_, table, name, target) in enumerate(lookups):
        known = table.groupBy(F.lower(F.col(name)).alias("__k")).agg(F.min(target).alias(f"__t{i}"))
        out = out.join(known, "__k", "left")
    kind = F.coalesce(*[F.when(F.col(f"__t{i}").isNotNull(), F.lit(k)) for i, (k, *_) in enumerate(lookups)], F.lit("unknown"))
    target = F.coalesce(*[F.col(f"__t{i}").cast("string") for i in range(len(lookups))])
    return out.select(*tokens.columns, kind.alias("kind"), target.alias("target"))
