"""Graph operators: reachability, type closure, bounded paths, prioritised expansion."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import big, discard, scratch


def reachable(edges: DataFrame, roots: DataFrame, max_depth: int = 100) -> DataFrame:
    """(root, node, depth): all nodes that each root reaches over edges(src, dst), itself at depth 0; least depth.

    A breadth-first loop over frontiers; each round's new nodes are a table, so plans don't grow with depth. Joins are merged:
    a table of some MB may be ten times that once it is read, and none of it is to go through the driver.
    """
    edges = scratch(edges.select("src", "dst").distinct(), "edges")  # worked out once, not in each round
    seen = scratch(roots.select(F.col("root"), F.col("root").alias("node")).distinct().withColumn("depth", F.lit(0)), "frontier")
    found = frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.join(big(edges), F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        frontier = scratch(step.join(big(found.select("root", "node")), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            discard(edges)
            return found
        found = found.unionByName(frontier)
    raise RuntimeError(f"nodes remain beyond depth {max_depth}")


def superclasses(sub_class_of: DataFrame, max_depth: int = 50) -> DataFrame:
    """(sub, super) closure of (sub, super), without reflexive pairs that no cycle makes."""
    direct = sub_class_of.select("sub", "super").distinct()
    roots = direct.select(F.col("sub").alias("root")).distinct()
    out = reachable(direct.select(F.col("sub").alias("src"), F.col("super").alias("dst")), roots, max_depth)
    return out.where("depth > 0").select(F.col("root").alias("sub"), F.col("node").alias("super"))


def materialise_types(types: DataFrame, sub_class_of: DataFrame) -> DataFrame:
    """types(s, type) that follow from the class hierarchy and aren't stated yet."""
    closure = superclasses(sub_class_of)
    new = types.join(closure, types["type"] == closure["sub"]).select("s", F.col("super").alias("type")).distinct()
    return new.join(types.select("s", "type"), ["s", "type"], "left_anti")


def simple_paths(edges: DataFrame, starts: DataFrame, max_edges: int) -> DataFrame:
    """(path, length) of all paths without repeated nodes from the start nodes, up to max_edges edges.

    Their number can grow as the degree to the power of the length: max_edges bounds it.
    """
    paths = starts.select(F.array(F.col("start")).alias("path"))
    out = None
    for n in range(1, max_edges + 1):
        last = F.element_at("path", -1)
        paths = paths.join(edges, last == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        rows = paths.withColumn("length", F.lit(n))
        out = rows if out is None else out.unionByName(rows)
    return out


def investigate(seeds: list[tuple[str, str, float]], neighbours, max_iters: int = 40, max_nodes: int = 240) -> dict:
    """Prioritised bounded expansion from seeds (kind, node, priority).

    neighbours(kind, node) gives (kind, node, priority, relation). The node of highest priority is expanded next, of
    equal ones the one that came in first; a node is visited once. Returns visited nodes in order, edges and stats.
    The order is inherently sequential, so this loop runs on the driver, over at most max_nodes nodes; prefetched() gives
    neighbours without a job for each node.
    """
    heap: list[tuple[float, int, str, str]] = []
    known: set[tuple[str, str]] = set()
    visited: list[tuple[str, str]] = []
    edges: list[tuple[str, str, str, str, str]] = []
    turn = 0
    for kind, node, priority in seeds:
        if (kind, node) not in known and len(known) < max_nodes:
            known.add((kind, node))
            heapq.heappush(heap, (-priority, turn, kind, node))
            turn += 1
    iters = 0
    while heap and iters < max_iters:
        _, _, kind, node = heapq.heappop(heap)
        visited.append((kind, node))
        iters += 1
        for to_kind, to, priority, relation in neighbours(kind, node):
            edges.append((kind, node, relation, to_kind, to))
            if (to_kind, to) not in known and len(known) < max_nodes:
                known.add((to_kind, to))
                heapq.heappush(heap, (-priority, turn, to_kind, to))
                turn += 1
    return {"visited": visited, "edges": edges, "stats": {"iterations": iters, "known": len(known), "left": len(heap), "truncated": bool(heap)}}


def prefetched(edges: DataFrame, seeds: list[tuple[str, str]], max_iters: int, most: int):
    """A neighbours function for investigate(), from edges(kind, node, to_kind, to, priority, relation): a job fetches the
    edges of all nodes that are known but not fetched yet, when one of them is asked for.

    A node's edges come by priority (highest first), kind and name; beyond most of them a last entry of kind "cut", with
    the number of edges that are left out, says so.
    """
    known, held = set(seeds), {}
    mark = lambda k, n: f"{k}\x1f{n}"
    order = Window.partitionBy("kind", "node").orderBy(F.desc("priority"), "to_kind", "to", "relation")
    size = F.count("*").over(Window.partitionBy("kind", "node"))

    def neighbours(kind: str, node: str) -> list[tuple[str, str, float, str]]:
        if (kind, node) not in held:
            known.add((kind, node))
            new = sorted(x for x in known if x not in held and x[0] != "cut")
            wanted = edges.where(F.concat_ws("\x1f", "kind", "node").isin([mark(*x) for x in new]))
            rows = wanted.withColumn("place", F.row_number().over(order)).withColumn("size", size).where(F.col("place") <= most).orderBy("kind", "node", "place").collect()
            held.update({x: [] for x in new})
            for r in rows:
                held[r["kind"], r["node"]].append((r["to_kind"], r["to"], float(r["priority"]), r["relation"]))
                known.add((r["to_kind"], r["to"]))
                if r["place"] == most < r["size"]:
                    held[r["kind"], r["node"]].append(("cut", f"{r['kind']}:{r['node']}", float("-inf"), f"{r['size'] - most} more"))
        return held.get((kind, node), [])

    return neighbours


def typed_closure(transitions: DataFrame, starts: DataFrame, limit: int = 3000) -> DataFrame:
    """(start, kind, node): nodes reached over transitions(src_kind, src, dst_kind, dst) from starts(start, kind, node).

    A state is a kind and a node. More than limit states of one start raise an error rather than be cut.
    """
    edges = transitions.select(F.concat_ws("|", "src_kind", "src").alias("a"), F.concat_ws("|", "dst_kind", "dst").alias("b")).distinct()
    begin = starts.select("start", F.concat_ws("|", "kind", "node").alias("state"))
    found = frontier = scratch(begin.distinct(), "states")
    while True:  # each round writes its new states only
        step = frontier.join(edges, F.col("state") == F.col("a")).select("start", F.col("b").alias("state")).distinct()
        frontier = scratch(step.join(found, ["start", "state"], "left_anti"), "states")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
        if not found.groupBy("start").count().where(F.col("count") > limit).isEmpty():
            raise RuntimeError(f"a start reaches more than {limit} states")
    parts = F.split("state", r"\|", 2)
    return found.select("start", parts[0].alias("kind"), parts[1].alias("node"))
