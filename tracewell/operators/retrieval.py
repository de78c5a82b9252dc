"""Similarity, retrieval and scores."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import aliases, bool_text, node_id


def routine_similarity(sets: DataFrame, key: str, target: object, weights: dict[str, float], k: int) -> DataFrame:
    """The k rows most like the target's, by weighted Jaccard similarity of their array columns, rounded to 4 digits.

    One row, the target's, is joined to all others; equal scores go by key.
    """
    own = sets.where(F.col(key) == target).select(*[F.col(c).alias(f"t_{c}") for c in weights]).limit(1)
    rows = sets.where(F.col(key) != target).join(F.broadcast(own))
    score = F.lit(0.0)
    for c, w in weights.items():
        union = F.size(F.array_union(c, f"t_{c}"))
        score = score + w * F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(c, f"t_{c}")) / union)
    return rows.select(key, F.round(score, 4).alias("score")).orderBy(F.desc("score"), key).limit(k)


def routine_sets(reached: DataFrame, facts: DataFrame, root: str, unit: str, kinds: list[str]) -> DataFrame:
    """Per root of reached(root, unit) the sorted sets of units and of each kind of the facts(unit, kinds...) in them."""
    rows = reached.select(root, unit).join(facts.select(unit, *kinds), unit)
    return rows.groupBy(root).agg(F.sort_array(F.collect_set(unit)).alias("reached"), *[F.sort_array(F.collect_set(k)).alias(k) for k in kinds])


def term_frequency(docs: DataFrame, key: str, text: str) -> DataFrame:
    tokens = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([a-z0-9_]+)"), F.lit(1)))
    return docs.select(key, tokens.alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


TOKEN = r"([a-z_][a-z0-9_.]*|\d+)"


def lexical_top(docs: DataFrame, key: str, name: str, text: str, question: str, k: int, kind: str | None = None) -> DataFrame:
    """The k documents with the best sum over the question's tokens of min(tf, 5), times 4 for tokens within the name.

    tf counts a document's name and text. 6 more if the question's distinct tokens stand in the text in a row (white space
    collapsed), 2.5 more for kinds that begin with pou where the name has a token. Ties by overlap, length and key.
    """
    q = list(dict.fromkeys(re.findall(TOKEN, question.lower())))
    rows = docs.select(key, F.lower(F.coalesce(F.col(name), F.lit(""))).alias("__n"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__t"), F.length(text).alias("len"), (F.lower(F.col(kind)).startswith("pou") if kind else F.lit(False)).alias("__pou"))
    # tokens of the text that the question has: no explode of whole texts, no shuffle before the top k
    words = F.filter(F.regexp_extract_all(F.concat_ws(" ", "__n", "__t"), F.lit(TOKEN), F.lit(1)), lambda w: w.isin(q))
    rows = rows.withColumn("__w", words)
    tf = lambda t: F.size(F.filter("__w", lambda w: w == t))
    score, hits, named = F.lit(0.0), F.lit(0), F.lit(False)
    for t in q:
        inside = F.col("__n").contains(t)
        score = score + F.least(tf(t), F.lit(5)) * F.when(inside, 4.0).otherwise(1.0)
        hits = hits + F.when(tf(t) > 0, 1).otherwise(0)
        named = named | (inside & (tf(t) > 0))
    score = score + F.when(F.regexp_replace("__t", r"\s+", " ").contains(" ".join(q)), 6.0).otherwise(0.0) + F.when(F.col("__pou") & named, 2.5).otherwise(0.0)
    return rows.select(key, F.round(score, 3).alias("score"), hits.alias("overlap"), "len").where("overlap > 0").orderBy(F.desc("score"), F.desc("overlap"), F.desc("len"), key).limit(k)


def vector_top(vectors: DataFrame, key: str, vector: str, target: object, k: int) -> DataFrame:
    """The k rows with the least squared Euclidean distance to the target's vector, exactly; ties by key."""
    own = vectors.where(F.col(key) == target).select(F.col(vector).alias("__q")).limit(1)
    rows = vectors.where(F.col(key) != target).join(F.broadcast(own))
    square = F.aggregate(F.zip_with(vector, "__q", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return rows.select(key, square.alias("distance")).orderBy("distance", key).limit(k)


def chunk_windows(docs: DataFrame, key: str, text: str, size: int, overlap: int, least: int = 1) -> DataFrame:
    """Windows of size code points that overlap; the last one may be shorter, but not below least unless alone."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - F.lit(overlap) - 1), F.lit(step))
    rows = docs.where(F.length(text) > 0).select(key, F.col(text).alias("__t"), F.posexplode(starts).alias("chunk", "start"))
    rows = rows.withColumn("body", F.expr(f"substring(__t, start + 1, {size})"))
    return rows.where((F.length("body") >= least) | (F.col("chunk") == 0)).select(key, "chunk", "start", "body")


# What a symbol scores besides the aliases' own points.
SAME_ID, SAME_TEXT, OF_VARS, IS_BOOL = 25, 20, 8, 6


def alias_best(tokens: DataFrame, token: str, symbols: DataFrame, symbol: str, source: str | None = None, value: str | None = None) -> DataFrame:
    """For each token the symbol with the best sum of both sides' points for a common alias: equal aliases are joined.

    More for equal ids, for equal texts, for symbols whose source is vars, and for values that are TRUE or FALSE. Ties
    by symbol.
    """
    vars_ = F.coalesce(F.col(source) == "vars", F.lit(False)) if source else F.lit(False)
    is_bool = bool_text(value).isNotNull() if value else F.lit(False)
    left = tokens.select(token, F.lower(node_id(token)).alias("l_id"), F.explode(aliases(token)).alias("a")).select(token, "l_id", F.col("a.alias").alias("alias"), F.col("a.score").alias("ls"))
    right = symbols.select(symbol, F.lower(node_id(symbol)).alias("r_id"), (F.when(vars_, OF_VARS).otherwise(0) + F.when(is_bool, IS_BOOL).otherwise(0)).alias("more"), F.explode(aliases(symbol)).alias("a")).select(symbol, "r_id", "more", F.col("a.alias").alias("alias"), F.col("a.score").alias("rs"))
    score = F.col("ls") + F.col("rs") + F.col("more") + F.when(F.col("l_id") == F.col("r_id"), SAME_ID).otherwise(0) + F.when(F.lower(F.col(token)) == F.lower(F.col(symbol)), SAME_TEXT).otherwise(0)
    best = left.join(right, "alias").groupBy(token, symbol).agg(F.max(score).alias("score"))
    return best.groupBy(token).agg(F.min_by(F.struct(symbol, "score"), F.struct((-F.col("score")).alias("s"), symbol)).alias("r")).select(token, "r.*")


def skill_prefilter(candidates: DataFrame, key: str, tokens: str, wanted: list[str], bonus: Column, k: int) -> DataFrame:
    """The k candidates with the largest share of wanted tokens plus a bonus of 0.25; if none has any, the first k."""
    want = F.array(*[F.lit(w) for w in wanted])
    score = F.size(F.array_intersect(F.col(tokens), want)) / F.greatest(F.lit(1), F.size(want)) + F.when(bonus, 0.25).otherwise(0.0)
    return candidates.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def line_snippets(docs: DataFrame, key: str, text: str, needle: str, radius: int, hits: int) -> DataFrame:
    """The first hits lines that contain needle (case ignored), each with radius lines around it."""
    rows = docs.select(key, F.split(text, "\n").alias("lines")).select(key, "lines", F.posexplode("lines").alias("at", "line"))
    rows = rows.where(F.lower("line").contains(needle.lower()))
    rows = rows.withColumn("hit", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where(F.col("hit") <= hits)
    body = F.expr(f"array_join(slice(lines, greatest(at - {radius}, 0) + 1, at + {radius} + 1 - greatest(at - {radius}, 0)), '\n')")
    return rows.select(key, "hit", F.col("at").alias("line_no"), body.alias("snippet"))


def assignment_score(match: Column, partial: Column, local: Column, job: Column, method: Column | None = None, wanted: Column | None = None) -> Column:
    """120, 70 or 10 by how well a value fits, 40 for a local and 20 for a job method's assignment.

    method: start gains 35 where TRUE is wanted and loses 5 where FALSE is, abort the other way round, checkstate gains 5.
    """
    score = F.when(match, 120).when(partial, 70).otherwise(10) + F.when(local, 40).otherwise(F.when(job, 20).otherwise(0))
    if method is None or wanted is None:
        return score
    kind = F.lower(method)
    return score + F.when(kind == "start", F.when(wanted, 35).otherwise(-5)).when(kind == "abort", F.when(wanted, -5).otherwise(35)).when(kind == "checkstate", 5).otherwise(0)


def path_fit(requirements: DataFrame, evidence: DataFrame, path: str, incident: str | None = None) -> DataFrame:
    """Per path: exact matches 2, soft ones 1, conflicts -4, snapshot matches 6 or 3 and their contradictions back.

    requirements(path, token, value); evidence(token, value, kind in skill or snapshot, soft). A path is possible without
    conflicts. With incident, a column of requirements that each path belongs to, rank orders an incident's paths by
    possible, score and path.
    """
    by = [path, *([incident] if incident else [])]
    both = requirements.join(evidence.select("token", F.col("value").alias("have"), "kind", "soft"), "token", "left")
    same, other = F.col("have") == F.col("value"), F.col("have") != F.col("value")
    snap, soft = F.col("kind") == "snapshot", F.col("soft")
    weight = F.when(snap, F.when(soft, 3).otherwise(6)).otherwise(F.when(soft, 1).otherwise(2))
    score = F.when(same, weight).when(other & snap, -(weight + F.when(soft, 1).otherwise(2))).when(other, -4).otherwise(0)
    out = both.groupBy(*by).agg(F.sum(score).alias("score"), F.count_if(other).alias("conflicts")).withColumn("possible", F.col("conflicts") == 0)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(incident).orderBy(F.desc("possible"), F.desc("score"), path))) if incident else out
