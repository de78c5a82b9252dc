"""Ordered operators on event rows: timelines, edges, folds, picks. Batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(corr: str = "corr", *order: str):
    return Window.partitionBy(corr).orderBy(*(order or ("us", "event_id")))


def timeline(events: DataFrame) -> DataFrame:
    """Milliseconds since the previous event of the same correlation (first: 0), and their running sum."""
    w = by()
    delta = F.coalesce(F.expr("us div 1000") - F.lag(F.expr("us div 1000")).over(w), F.lit(0))
    return events.withColumn("delta_ms", delta).withColumn("total_ms", F.sum("delta_ms").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def rising_edges(events: DataFrame, on: Column) -> DataFrame:
    """Events at which a condition turns true; the first sample of a correlation never counts."""
    rows = events.withColumn("__on", on)
    return rows.withColumn("__before", F.lag("__on").over(by())).where("__on and not __before").drop("__on", "__before")


def once_only(events: DataFrame, types: list[str]) -> DataFrame:
    """The first event of the given types per correlation."""
    rank = F.struct("us", "event_id")
    return events.where(F.col("type").isin(types)).groupBy("corr").agg(F.min_by(F.struct("event_id", "type", "us"), rank).alias("r")).select("corr", "r.*")


def session_fold(events: DataFrame, start: str, updates: list[str], triggers: list[str]) -> DataFrame:
    """Per correlation: the first trigger, and of each update type the last value since the last start before it.

    Updates without a start before them don't count; a start clears what was gathered. A trigger needs no start.
    """
    first = once_only(events, triggers).select("corr", F.col("type").alias("trigger"), F.col("event_id").alias("t_id"), F.col("us").alias("t_us"))
    before = events.join(first, "corr").where("struct(us, event_id) < struct(t_us, t_id)")
    rank = F.struct("us", "event_id")
    starts = before.groupBy("corr").agg(F.max(F.when(F.col("type") == start, rank)).alias("s"))
    kept = before.join(starts, "corr").where(rank > F.col("s"))
    last = kept.groupBy("corr").agg(*[F.max_by(F.when(F.col("type") == u, F.col("value")), F.when(F.col("type") == u, rank)).alias(f"last_{u}") for u in updates])
    return first.join(starts, "corr", "left").join(last, "corr", "left").select("corr", "trigger", F.col("t_us").alias("trigger_us"), F.col("s").isNotNull().alias("active"), *[f"last_{u}" for u in updates])


def event_pairs(events: DataFrame, a: str, b: str) -> DataFrame:
    """Per correlation with both types of event, once: when the later of the two first came."""
    first = events.where(F.col("type").isin(a, b)).groupBy("corr").agg(F.min(F.when(F.col("type") == a, F.col("us"))).alias("a_us"), F.min(F.when(F.col("type") == b, F.col("us"))).alias("b_us"))
    return first.where("a_us is not null and b_us is not null").select("corr", "a_us", "b_us", F.greatest("a_us", "b_us").alias("ready_us"))


def segment(events: DataFrame, start: str, end: str) -> DataFrame:
    """Per correlation the milliseconds from its last start to its last end; null unless both are there."""
    last = lambda t: F.max(F.when(F.col("type") == t, F.col("us")))
    return events.groupBy("corr").agg(last(start).alias("a"), last(end).alias("b")).select("corr", F.expr("(b - a) div 1000").alias("segment_ms"))


def fallback_outcome(events: DataFrame, plan: str, done: str, failed: list[str]) -> DataFrame:
    """What becomes of each correlation's pending plan: executed at done, dropped at a failure, whichever comes first."""
    plans = events.where(F.col("type") == plan).groupBy("corr").agg(F.min("us").alias("p"))
    ends = events.where(F.col("type").isin([done, *failed])).select("corr", "us", F.col("type").alias("end"), "event_id")
    after = plans.join(ends, "corr").where("us > p").groupBy("corr").agg(F.min_by("end", F.struct("us", "event_id")).alias("end"))
    return plans.join(after, "corr", "left").select("corr", F.when(F.col("end") == done, "executed").when(F.col("end").isNotNull(), "dropped").otherwise("pending").alias("outcome"))


def winners(candidates: DataFrame, key: str, won: str) -> DataFrame:
    """How many candidates of a key hold: none is unknown, one unique, more ambiguous."""
    n = F.count_if(F.col(won))
    return candidates.groupBy(key).agg(n.alias("winners")).withColumn("verdict", F.when(F.col("winners") == 0, "unknown").when(F.col("winners") == 1, "unique").otherwise("ambiguous"))


def sessions(events: DataFrame, gap_us: int) -> DataFrame:
    """Per correlation and session (events with gaps of less than gap_us): start, end, events."""
    w = by()
    new = F.coalesce((F.col("us") - F.lag("us").over(w) >= gap_us).cast("int"), F.lit(1))
    rows = events.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("corr", "session").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n"))


def later_assignments(lines: DataFrame, key: str, line: str, value: str) -> DataFrame:
    """Each assignment with whether later ones follow in its key, and which lines."""
    w = Window.partitionBy(key).orderBy(line)
    later = F.collect_list(line).over(w.rowsBetween(1, Window.unboundedFollowing))
    return lines.select(key, line, value, F.lead(line).over(w).isNotNull().alias("has_later"), F.concat_ws(",", F.transform(later, lambda x: x.cast("string"))).alias("later"))


def dominant(lines: DataFrame, key: str, line: str, holds: Column) -> DataFrame:
    """The last line of each key for which a condition holds."""
    return lines.where(holds).groupBy(key).agg(F.max(line).alias("dominant_line"))


def pick_tiers(lines: DataFrame, key: str, line: str, tiers: list[Column]) -> DataFrame:
    """The last line of the first tier that has any; lines of no tier come last."""
    tier = F.lit(len(tiers))
    for i in range(len(tiers) - 1, -1, -1):
        tier = F.when(tiers[i], F.lit(i)).otherwise(tier)
    rows = lines.withColumn("tier", tier)
    return rows.groupBy(key).agg(F.min(F.struct("tier", (-F.col(line)).alias("m"))).alias("r")).select(key, F.col("r.tier").alias("tier"), (-F.col("r.m")).alias("picked_line"))
