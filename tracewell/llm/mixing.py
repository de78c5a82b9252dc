"""Mixing sources to target weights: temperature, then budgeted block permutations. DataFrame functions only.

Source s has the share p_s of all tokens; its target weight is p_s^a / sum p^a, for one exponent a from 0 (equal
weights) to 1 (as found). The exponent is narrowed down until the weights' entropy meets a target, and raised where
some source would otherwise repeat more often than the limit allows. Each round splits the interval in SPLIT parts
and evaluates all of them in one grouped aggregation over the sources.

A source's budget is its weight times the total. Its documents are dealt into blocks by a hash; passes over all blocks
are made in full while the budget lasts. The last, partial pass takes whole blocks in an order permuted for that pass
while they fit, and of the next block its documents, in permuted order, while they fit. Where that pass ends is found
in two levels: a source's blocks fall into PARTS ranges of the permutation, whose sums are put in order first, and only
the blocks of the one range that holds the end are put in order themselves. So a source needs one row of numbers, which
decides for each of its documents; texts are joined with those rows alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialise, skewed_left_join

SPLIT = 32
ROUNDS = 6
PARTS_BITS = 10
#: Rows of numbers per source are broadcast where all of them have at most so many bytes; else they are joined by a shuffle.
BROADCAST_BYTES = 4 << 20


@dataclass(frozen=True)
class MixPlan:
    exponent: float
    entropy: float
    #: Passes over the source that repeats most, per token of budget and token of all sources.
    repetition: float


def whitespace_tokens(text: str = "text") -> Column:
    """Words of a text, as a stand-in for tokens where none are counted yet; at least 1, so that no text is free."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return F.greatest(words, F.lit(1)).cast("long")


def solve_exponent(totals: DataFrame, target_entropy: float | None, most_repeats: float | None, budget_share: float | None) -> MixPlan:
    """The exponent for totals(source, tokens).

    target_entropy: as a share of the way from the entropy found (0) to that of equal weights (1); None: 1.
    most_repeats: how often a source may be passed over on average; None: any number. budget_share: the budget as a
    share of all tokens; None: as much as gives each source one full pass.
    """
    head = totals.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    total, n = float(head["t"] or 0), int(head["n"])
    if not n or not total:
        return MixPlan(1.0, 0.0, 1.0)

    def at(exponents: list[float]) -> dict[float, tuple[float, float]]:
        grid = totals.select((F.col("tokens") / F.lit(total)).alias("p"), F.explode(F.array(*[F.lit(a) for a in exponents])).alias("a"))
        q = F.pow(F.col("p"), F.col("a"))
        sums = grid.groupBy("a").agg(F.sum(q).alias("z"), F.sum(q * F.log("p")).alias("l"), F.max(q / F.col("p")).alias("most"), F.min(q / F.col("p")).alias("least"))
        out = {}
        for r in sums.collect():  # a row per exponent tried
            entropy = math.log(r["z"]) - r["a"] * r["l"] / r["z"]
            share = budget_share if budget_share is not None else r["z"] / r["least"]
            out[r["a"]] = entropy, r["most"] / r["z"] * share
        return out

    ends = at([0.0, 1.0])
    goal = ends[1.0][0] + (1.0 if target_entropy is None else target_entropy) * (ends[0.0][0] - ends[1.0][0])
    # entropy and repetition both fall as the exponent rises: the least exponent that meets both is wanted
    meets = lambda v: v[0] <= goal + 1e-9 and (most_repeats is None or v[1] <= most_repeats + 1e-9)
    low, high = 0.0, 1.0
    if meets(ends[0.0]):
        return MixPlan(0.0, *ends[0.0])
    best = ends[1.0]
    for _ in range(ROUNDS):
        tried = [low + (high - low) * i / SPLIT for i in range(1, SPLIT)]
        values = at(tried)
        fit = [a for a in tried if meets(values[a])]
        if fit:
            high, best = fit[0], values[fit[0]]
        low = max([low, *[a for a in tried if a < high]])
    return MixPlan(high, *best)


def mix_sources(
    docs: DataFrame, source: str = "source", key: str = "doc_id", tokens: str | None = None, target_entropy: float | None = 0.5, most_repeats: float | None = 4.0, budget_share: float | None = 1.0, block_tokens: int = 1 << 20, seed: int = 7
) -> DataFrame:
    """docs with a row per time that a document is taken, and mix_epoch (0, 1, ...), mix_order and mix_tokens.

    Columns that docs has by these names are replaced. Sorting by mix_epoch and mix_order gives the mixture's order. tokens: the column to count by (null or less than 1
    counts 1); None: words of the column text. A null source is a source like any other. A document is never cut, so a
    source may stay below its budget by less than one document. Repeated rows are taken alike. With no rows, none.
    budget_share None: each source gets one full pass at least, so nothing is left out, and small sources repeat.
    """
    size = whitespace_tokens() if tokens is None else F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(1)), F.lit(1))
    columns = [c for c in docs.columns if c not in ("mix_epoch", "mix_order", "mix_tokens")]
    name = F.coalesce(F.col(source).cast("string"), F.lit("\0null"))
    rows = docs.select(F.struct(*columns).alias("doc"), name.alias("__s"), size.alias("__t"), F.xxhash64(F.lit(seed), F.col(key)).alias("__h"))
    counted = materialise(rows.select("__s", "__t", "__h"), "mix-counted")  # no texts: what follows reads numbers only
    totals = materialise(counted.groupBy(F.col("__s").alias("source")).agg(F.sum("__t").alias("tokens"), F.count("*").alias("rows")), "mix-totals")
    plan = solve_exponent(totals, target_entropy, most_repeats, budget_share)
    head = totals.agg(F.sum("tokens").alias("tokens"), F.sum(F.octet_length("source") + 100).alias("bytes")).first()
    small = (head["bytes"] or 0) <= BROADCAST_BYTES
    q = F.pow(F.col("tokens") / F.lit(total := float(head["tokens"] or 1)), F.lit(plan.exponent))
    norm = totals.agg(F.sum(q).alias("z"), F.min(q / (F.col("tokens") / F.lit(total))).alias("least")).first()
    share = budget_share if budget_share is not None else (norm["z"] or 1.0) / (norm["least"] or 1.0)
    passes = (q / F.lit(norm["z"] or 1.0)) * F.lit(total * share) / F.col("tokens")
    # a hair more, so that a full pass isn't lost to rounding
    budgets = totals.select(F.col("source").alias("__s"), "rows", F.floor(passes + 1e-9).cast("int").alias("full"), F.greatest(F.lit(0), F.floor((passes + 1e-9 - F.floor(passes + 1e-9)) * F.col("tokens"))).cast("long").alias("rest"), F.ceil(F.col("tokens") / block_tokens).cast("int").alias("blocks"))
    budgets = materialise(budgets, "mix-budgets")
    block = F.pmod(F.xxhash64(F.lit(seed + 1), "__h"), F.col("blocks")).cast("int").alias("__b")
    turn = F.xxhash64(F.lit(seed + 2), "__s", "__b")

    sums = _by_source(counted, budgets, small).select("__s", block, "__t").groupBy("__s", "__b").agg(F.sum("__t").alias("size"))
    sums = materialise(sums.withColumn("turn", turn).withColumn("part", F.shiftright("turn", 64 - PARTS_BITS)), "mix-blocks")
    before = Window.partitionBy("__s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("__s", "part").agg(F.sum("size").alias("part_size")).withColumn("part_start", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    ends = parts.join(budgets.select("__s", "rest"), "__s").where("part_start <= rest and rest < part_start + part_size").drop("part_size")
    before = Window.partitionBy("__s").orderBy("turn", "__b").rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.join(ends, ["__s", "part"]).withColumn("start", F.col("part_start") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    cut = cut.where("start <= rest and rest < start + size").select("__s", F.col("__b").alias("cut_b"), F.col("turn").alias("cut_turn"), (F.col("rest") - F.col("start")).alias("room"))
    cut = materialise(budgets.drop("rest").join(cut, "__s"), "mix-cuts")
    # of the one block per source that is cut, the documents that fit, in the order of their hashes
    inside = Window.partitionBy("__s").orderBy("__h").rangeBetween(Window.unboundedPreceding, 0)
    edge = _by_source(counted, cut, small).where(block == F.col("cut_b")).withColumn("sum", F.sum("__t").over(inside)).where("sum <= room").groupBy("__s").agg(F.max("__h").alias("edge"))
    limits = materialise(cut.drop("room").join(edge, "__s", "left"), "mix-limits")

    out = _by_source(rows, limits, small).withColumn("__b", block).withColumn("__o", turn)
    first = (F.col("__o") < F.col("cut_turn")) | (F.col("__o") == F.col("cut_turn")) & ((F.col("__b") < F.col("cut_b")) | (F.col("__b") == F.col("cut_b")) & (F.col("__h") <= F.col("edge")))
    times = F.col("full") + F.when(first, 1).otherwise(0)
    out = out.where(times > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    drop(counted, totals, budgets, sums, cut)
    order = F.xxhash64(F.lit(seed + 3), F.col("mix_epoch"), F.col("__o"), F.col("__h"))
    return out.select("doc.*", "mix_epoch", order.alias("mix_order"), F.col("__t").alias("mix_tokens"))


def _by_source(rows: DataFrame, numbers: DataFrame, small: bool) -> DataFrame:
    """rows with the numbers of their source: broadcast where these are proven small, else by a join that splits hot sources."""
    if small:
        return rows.join(F.broadcast(numbers.drop("rows")), "__s")
    return skewed_left_join(rows, numbers, ["__s"], "rows", ["__h"])
