"""Guarded read-only SQL, and the registry of operators with a runner for ordered plans."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Iterator

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession

MOST_ROWS = 200

# The kinds of parsed plan that read tables and compute, and nothing else. All others are refused.
READING = frozenset(
    "Aggregate Deduplicate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project Sample Sort SubqueryAlias Union UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedOrderBy UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTVFAliases UnresolvedTableValuedFunction UnresolvedWith Unpivot WithWindowDefinition".split()
)
# Built-in functions that run code of the caller's choice, read files or tell about the machine.
FORBIDDEN = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_user session_user user version".split())
TABLE_FUNCTIONS = frozenset("explode explode_outer posexplode posexplode_outer inline inline_outer stack".split())


def _seq(s: object) -> Iterator:
    return (s.apply(i) for i in range(s.size()))


def _functions(spark: SparkSession) -> frozenset[str]:
    """Names of Spark's own functions; what a session registered besides isn't among them."""
    registry = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.functionSet()
    found, it = set(), registry.iterator()
    while it.hasNext():
        found.add(it.next().funcName().lower())
    return frozenset(found) - FORBIDDEN


def refusals(spark: SparkSession, query: str, views: set[str]) -> list[str]:
    """What in a statement goes beyond reading the given views with Spark's own functions; empty if nothing does.

    The parsed statement counts, not words in its literals: every plan, every expression and every subquery in it must
    be of a kind that is known to read only. Relations are the views and the WITH names that are in scope.
    """
    known, out = _functions(spark), []

    def expression(e: object, names: set[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            parts = [str(p).lower() for p in _seq(e.nameParts())]
            if parts[-1] not in known or parts[:-1] not in ([], ["builtin"], ["system", "builtin"]):
                out.append(f"function {'.'.join(parts)}")
        if is_instance_of(spark.sparkContext._gateway, e, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
            plan(e.plan(), names)
        for child in _seq(e.children()):
            expression(child, names)

    def plan(p: object, names: set[str]) -> None:
        kind = p.getClass().getSimpleName()
        if kind not in READING:
            out.append(f"statement {kind}")
            return
        if kind == "UnresolvedRelation":
            parts = [str(x) for x in _seq(p.multipartIdentifier())]
            if len(parts) != 1 or parts[0].lower() not in names:
                out.append(f"relation {'.'.join(parts)}")
        elif kind == "UnresolvedTableValuedFunction":
            if (name := ".".join(str(x) for x in _seq(p.name())).lower()) not in TABLE_FUNCTIONS:
                out.append(f"table function {name}")
        elif kind == "UnresolvedWith":
            names = set(names)
            for relation in _seq(p.cteRelations()):  # each sees those before it, and itself where WITH is recursive
                name = str(relation._1()).lower()
                plan(relation._2(), names | {name} if p.allowRecursion() else names)
                names.add(name)
        for e in _seq(p.expressions()):
            expression(e, names)
        for child in _seq(p.children()):
            plan(child, names)

    plan(spark._jsparkSession.sessionState().sqlParser().parsePlan(query), {v.lower() for v in views})
    return out


def is_read_only(spark: SparkSession, query: str, views: set[str] | None = None) -> bool:
    return not refusals(spark, query, views or set())


def guarded(spark: SparkSession, query: str, views: dict[str, DataFrame] | None = None, most: int = MOST_ROWS, args: dict | None = None) -> DataFrame:
    """A query's rows, at most most of them, over the given views and nothing else; anything but a query is refused."""
    if found := refusals(spark, query, set(views or {})):
        raise PermissionError("only queries over the given views are allowed, not " + ", ".join(found))
    # in a session of its own, so that no view of the caller's is replaced
    own = spark.newSession()
    for name, df in (views or {}).items():
        _in_session(df, own).createOrReplaceTempView(name)
    return _in_session(own.sql(query, args=args).limit(most), spark)


def _in_session(df: DataFrame, session: SparkSession) -> DataFrame:
    """The same plan, run by another session of the same application."""
    jvm = session._jvm
    plan = df._jdf.queryExecution().logical()
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan), session)


def with_prefixes(query: str, prefixes: dict[str, str]) -> str:
    """A query whose literals may use short names (dp:hasName): their prefixes are written out, longer names stay."""
    return re.sub(r"'([A-Za-z][\w-]*):([^'/][^']*|)'", lambda m: f"'{prefixes[m[1]]}{m[2]}'" if m[1] in prefixes else m[0], query)


def _useless(result: object) -> bool:
    """Nothing, an empty table or list, or an error."""
    if isinstance(result, DataFrame):
        return result.isEmpty()
    return result in (None, [], {}) or isinstance(result, dict) and "error" in result


class Registry:
    """Operators by name. execute() gives {"error": ...} instead of raising, as callers that plan ahead expect."""

    def __init__(self) -> None:
        self.tools: dict[str, Callable] = {}

    def register(self, f: Callable, name: str | None = None) -> Callable:
        self.tools[name or f.__name__] = f
        return f

    def describe(self) -> dict[str, str]:
        return {n: f"{inspect.signature(f)} {(inspect.getdoc(f) or '').splitlines()[0] if f.__doc__ else ''}".strip() for n, f in sorted(self.tools.items())}

    def execute(self, name: str, /, **args) -> object:
        if name not in self.tools:
            return {"error": f"unknown tool {name}"}
        try:
            return self.tools[name](**args)
        except Exception as e:  # noqa: BLE001  the caller decides what to do about it
            return {"error": f"{type(e).__name__}: {e}"}

    def run_plan(self, steps: list[tuple[str, dict]], replan: Callable[[dict], list[tuple[str, dict]]] | None = None, most: int = 2) -> dict[str, object]:
        """Results by step_i:tool. Where all results are empty or errors, replan may give other steps, most times."""
        results: dict[str, object] = {}
        for _ in range(most + 1):
            results = {f"step_{i}:{tool}": self.execute(tool, **args) for i, (tool, args) in enumerate(steps, 1)}
            if not all(map(_useless, results.values())) or replan is None or not (steps := replan(results)):
                break
        return results
