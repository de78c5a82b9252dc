"""The tools that a planner can call by name, over one program's tables, and its fixed presets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, pattern, retrieval, trace
from ..sources.program import search_snapshot
from .guard import Registry, guarded, with_prefixes

# How alike routines are, by the sets that they share.
ROUTINE_WEIGHTS = {"hardware_addresses": 0.55, "used_variable_names": 0.25, "called_pou_names": 0.20}


@dataclass
class Knowledge:
    """A program graph (s, p, o, o_kind) as operators.etl builds it, and what else is known; None where it isn't."""

    triples: DataFrame
    program: trace.Program | None = None
    snapshot: DataFrame | None = None  # corr, id, t, v
    routines: DataFrame | None = None  # pou_name and its sets
    vectors: DataFrame | None = None  # vec_id, embedding
    views: dict[str, DataFrame] = field(default_factory=dict)
    prefixes: dict[str, str] = field(default_factory=dict)  # of names in queries' literals

    def values(self, p: str, s: str, o: str) -> DataFrame:
        return self.triples.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))

    def need(self, name: str) -> object:
        found = getattr(self, name)
        if found is None:
            raise LookupError(f"no {name} given")
        return found


def registry(k: Knowledge) -> Registry:
    """All tools over k. Tables come in a fixed order and at most the tool's number of rows."""
    r = Registry()
    names = k.values("dp:hasPOUName", "pou", "name")
    code = k.values("dp:hasCode", "pou", "code")
    calls = k.values("op:containsPOUCall", "caller", "call").join(k.values("op:callsPOU", "call", "callee"), "call")
    called = calls.join(names.toDF("caller", "caller_name"), "caller").join(names.toDF("callee", "callee_name"), "callee").select("caller_name", "callee_name").distinct()
    variables = k.values("dp:hasVariableName", "var", "name")

    @r.register
    def list_programs(most: int = 200) -> DataFrame:
        """Names of all programs."""
        return names.join(k.values("rdf:type", "pou", "type").where("type = 'Program'"), "pou").select("name").distinct().orderBy("name").limit(most)

    @r.register
    def called_pous(name: str, most: int = 200) -> DataFrame:
        """Units that a unit calls."""
        return called.where(pattern.equals_ci("caller_name", name)).select("callee_name").distinct().orderBy("callee_name").limit(most)

    @r.register
    def pou_callers(name: str, most: int = 200) -> DataFrame:
        """Units that call a unit."""
        return called.where(pattern.equals_ci("callee_name", name)).select("caller_name").distinct().orderBy("caller_name").limit(most)

    @r.register
    def pou_code(name: str) -> DataFrame:
        """A unit's code."""
        return names.where(pattern.equals_ci("name", name)).join(code, "pou").select("name", "code").orderBy("name", "code")

    @r.register
    def search_variables(needle: str, most: int = 50) -> DataFrame:
        """Variables whose name contains a text, case ignored."""
        return variables.where(pattern.contains_ci("name", needle)).distinct().orderBy("name", "var").limit(most)

    @r.register
    def variable_trace(name: str, most: int = 50) -> DataFrame:
        """A variable's or port's address and the units that use or own it, null where there are none."""
        own = variables.where(pattern.equals_ci("name", name))
        users = k.triples.where(F.col("p").isin("op:usesVariable", "op:hasVariable")).select(F.col("o").alias("var"), F.col("s").alias("pou"), F.col("p").alias("how")).join(names.toDF("pou", "pou_name"), "pou")
        found = own.join(k.values("dp:hasHardwareAddress", "var", "address"), "var", "left").join(users, "var", "left")
        ports = k.values("dp:hasPortName", "var", "name").where(pattern.equals_ci("name", name)).join(k.values("op:hasPort", "pou", "var").withColumn("how", F.lit("op:hasPort")), "var", "left").join(names.toDF("pou", "pou_name"), "pou", "left")
        both = found.select("name", "var", "address", "pou_name", "how").unionByName(ports.select("name", "var", "pou_name", "how"), allowMissingColumns=True)
        return both.distinct().orderBy("var", "how", "pou_name").limit(most)

    @r.register
    def plc_snapshot_search(needle: str, exact: bool = False, most: int = 20) -> DataFrame:
        """Variables of the snapshot by name."""
        return search_snapshot(k.need("snapshot"), needle, exact, most)

    @r.register
    def general_search(needle: str, most: int = 30) -> DataFrame:
        """Units, variables, ports and addresses whose name contains a text."""
        kinds = {"unit": (names, F.col("pou"), F.col("name")), "variable": (variables, F.col("var"), F.col("name"))}
        for kind, p in (("port", "dp:hasPortName"), ("address", "dp:hasHardwareAddress")):
            kinds[kind] = (k.values(p, "s", "name"), F.col("s"), F.col("name"))
        return pattern.union_search(kinds, needle).orderBy("category", "name", "id").limit(most)

    @r.register
    def string_triple_search(term: str, most: int = 30) -> DataFrame:
        """Triples with a text in any part."""
        hit = pattern.contains_ci("s", term) | pattern.contains_ci("p", term) | pattern.contains_ci("o", term)
        return k.triples.where(hit).select("s", "p", "o").orderBy("s", "p", "o").limit(most)

    @r.register
    def graph_investigate(node: str, max_iters: int = 40, max_nodes: int = 240) -> dict:
        """Best-first expansion from a node along triples in both directions; literals aren't expanded."""
        links = k.triples.where("o_kind = 'iri' and p <> 'rdf:type'")
        both = links.select(F.col("s").alias("a"), "p", F.col("o").alias("b")).unionByName(links.select(F.col("o").alias("a"), F.concat(F.lit("^"), "p").alias("p"), F.col("s").alias("b")))

        # one job per set of nodes that aren't fetched yet, not one per node
        priority = F.when(F.col("p").contains("Call") | F.col("p").contains("POU"), 2.0).otherwise(1.0)
        edges = both.select(F.lit("node").alias("kind"), F.col("a").alias("node"), F.lit("node").alias("to_kind"), F.col("b").alias("to"), priority.alias("priority"), F.col("p").alias("relation")).distinct()
        neighbours = graph.prefetched(edges, [("node", node)], max_iters, max_nodes)
        return graph.investigate([("node", node, 1.0)], neighbours, max_iters, max_nodes)

    @r.register
    def exception_prep(pou_name: str, most: int = 5) -> DataFrame:
        """Routines most like a unit's."""
        return retrieval.routine_similarity(k.need("routines"), "pou_name", pou_name, ROUTINE_WEIGHTS, most)

    @r.register
    def text2sparql_select(query: str, most: int = 200) -> DataFrame:
        """A read-only query that a model wrote, over the triples and the given views; short names are written out."""
        return guarded(k.triples.sparkSession, with_prefixes(query, k.prefixes), {"triples": k.triples} | k.views, most)

    @r.register
    def semantic_search(vec_id: int, most: int = 3) -> DataFrame:
        """Nearest vectors to a stored one."""
        return retrieval.vector_top(k.need("vectors"), "vec_id", "embedding", vec_id, most)

    @r.register
    def evd2_diagnoseplan(machine: str, state: str, last_state: str | None = None) -> list[dict]:
        """Input ports that set a state, by kind of end."""
        rows = trace.state_trace(k.need("program"), machine, state, last_state)
        ports = list(dict.fromkeys(x["port"] for x in rows))
        return [{"port": p} | trace.terminal_summary([x for x in rows if x["port"] == p]) for p in ports]

    @r.register
    def unified_trace(machine: str, state: str, last_state: str | None = None, max_depth: int = 12) -> list[dict]:
        """Rows behind a state machine's state."""
        return trace.state_trace(k.need("program"), machine, state, last_state, most_depth=max_depth)

    @r.register
    def requirement_paths(pou: str, token: str, value: bool = True, max_depth: int = trace.MOST_DEPTH) -> list[dict]:
        """What must hold for a token's value, by path and depth."""
        return sorted(trace.requirements(k.need("program"), pou, token, value, most_depth=max_depth), key=lambda x: (x["path_id"], x["depth"]))

    @r.register
    def path_tracing(pou: str, condition: str, max_depth: int = 18) -> dict:
        """A condition's rows and the verdict on their ends."""
        rows = trace.condition_trace(k.need("program"), pou, condition, most_depth=max_depth)
        return {"rows": rows, "summary": trace.terminal_summary(rows)}

    @r.register
    def deterministic_path_search(preset: str, **args) -> object:
        """One of the presets by name, or an error that lists them."""
        ways = PRESETS | {alias: PRESETS[name] for alias, name in ALIASES.items()}
        if preset not in ways:
            raise KeyError(f"{preset}: not one of {sorted(ways)}")
        return ways[preset](r, **args)

    return r


def evd2_bootstrap(r: Registry, machine: str, state: str = "D2", last_state: str | None = None) -> dict:
    """The diagnosis of a state and its whole trace."""
    args = {"machine": machine, "state": state, "last_state": last_state}
    return r.run_plan([("evd2_diagnoseplan", args), ("unified_trace", args)])


def assignment_trace(r: Registry, pou: str, token: str, value: bool = True) -> dict:
    """What a token's value needs, and its unit's code."""
    return r.run_plan([("requirement_paths", {"pou": pou, "token": token, "value": value}), ("pou_code", {"name": pou})])


def condition_trace(r: Registry, pou: str, condition: str) -> dict:
    """A condition's paths, and who calls its unit."""
    return r.run_plan([("path_tracing", {"pou": pou, "condition": condition}), ("pou_callers", {"name": pou})])


PRESETS = {"evd2_bootstrap": evd2_bootstrap, "assignment_trace": assignment_trace, "condition_trace": condition_trace}
ALIASES = {"bootstrap": "evd2_bootstrap", "assignment": "assignment_trace", "condition": "condition_trace"}
