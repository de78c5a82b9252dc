"""Structured Streaming forms of the event operators. Events are (corr, type, value, ts timestamp, event_id).

Event time has a watermark: rows that come later than delay after the latest are dropped. What an operator remembers of
a correlation goes when the watermark passes its last event by keep, or at once where an event closes it; whatever comes
for it afterwards begins anew. Within a micro-batch a correlation's events are taken in order of (ts, event_id).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import stateful

EVENT = "corr long, event_id long, type string, value double, ts timestamp"


def event_source(spark: SparkSession, path: str, schema: str = EVENT, most_files: int | None = None) -> DataFrame:
    """Events from Parquet files as they arrive in a folder; at most most_files of them in a micro-batch, so that a
    backlog is drained in bounded steps."""
    reader = spark.readStream.schema(schema)
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    return reader.parquet(path)


def _ms(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)


def by_corr(events: DataFrame, step: Callable, out: str, state: str, delay: str, keep: str) -> DataFrame:
    """Rows that step(corr, rows, value) gives for a correlation's new events, in order: (list of rows, its new value).

    value is a tuple as state says, or None at first and where the last one has ended. step gives None as the new value
    where the correlation is closed. A value ends when the watermark passes the last event by keep.
    """
    names, wait = [c.split()[0] for c in out.split(", ")], _ms(keep)
    types = {c.split()[0]: {"long": "int64", "double": "float64", "boolean": "bool", "string": "object"}[c.split()[1]] for c in out.split(", ")}

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        if held.hasTimedOut:
            held.remove()
        else:
            new = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            rows, value = step(key[0], new, held.get[:-1] if held.exists else None)
            last = max(int(new["ts"].max().value // 1_000_000), held.get[-1] if held.exists else 0)
            if value is None:
                if held.exists:
                    held.remove()
            else:
                held.update((*value, last))
                held.setTimeoutTimestamp(max(last + wait, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=names).astype(types)

    marked = events.withWatermark("ts", delay)
    return marked.groupBy("corr").applyInPandasWithState(run, out, state + ", last_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def once_only(events: DataFrame, types: list[str], delay: str = "1 hour") -> DataFrame:
    """One trigger per correlation within the watermark: the first that arrives."""
    return events.where(F.col("type").isin(types)).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["corr"])


PAIR = "corr long, a_ms long, b_ms long"


def event_pairs(events: DataFrame, a: str, b: str, delay: str = "1 hour", keep: str = "1 day") -> DataFrame:
    """Once per correlation, when both an a and a b event have come, in either order: the times of the first of each."""

    def step(corr: int, rows: pd.DataFrame, value: tuple | None) -> tuple[list, tuple]:
        first = list(value or (None, None, False))
        out = []
        for r in rows.itertuples():
            at = 0 if r.type == a else 1
            if first[at] is None:
                first[at] = int(r.ts.value // 1_000_000)
            if None not in first[:2] and not first[2]:
                out.append((corr, first[0], first[1]))
                first[2] = True
        return out, tuple(first)

    return by_corr(events.where(F.col("type").isin(a, b)), step, PAIR, "a_ms long, b_ms long, done boolean", delay, keep)


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "type", "n")


EDGE = "corr long, event_id long, value double"


def rising_edges(events: DataFrame, threshold: float, delay: str = "1 hour", keep: str = "1 day") -> DataFrame:
    """Events at which value rises above threshold; a correlation's first sample never counts."""

    def step(corr: int, rows: pd.DataFrame, value: tuple | None) -> tuple[list, tuple]:
        before, out = value[0] if value else None, []
        for r in rows.itertuples():
            on = bool(r.value > threshold)
            if on and before is False:
                out.append((corr, r.event_id, r.value))
            before = on
        return out, (before,)

    return by_corr(events, step, EDGE, "before boolean", delay, keep)


def session_fold(events: DataFrame, start: str, updates: list[str], triggers: list[str], close: str | None = None, delay: str = "1 hour", keep: str = "1 day") -> DataFrame:
    """(corr, trigger, active, updates) per correlation at its first trigger: whether a session was active, and the last value
    of each update in it, as type=value joined by |. A start clears the session; close ends the correlation's state."""
    return stateful.by_corr(events, stateful.Session(start, updates, triggers, close, keep), delay)


def timeline(events: DataFrame, flush: str | None = None, delay: str = "1 hour", keep: str = "1 day") -> DataFrame:
    """(corr, event_id, type, delta_ms, total_ms): milliseconds since the previous event of the correlation, and their sum, for
    events that arrive in order.

    With flush, a correlation's lines are held back until an event of that type comes, which ends its timeline; those
    without one are never written.
    """
    return stateful.by_corr(events, stateful.Timeline(flush, keep), delay)


# Kinds of acknowledgement that the log shows, and what it calls them.
ACKS = {"evSRPlanned": "SRPLANNED", "evSRDone": "SRDONE", "evMonActPlanned": "MonActPLANNED", "evMonActDone": "MonAct_DONE", "evProcessFail": "ProcessFail", "evIngestionPlanned": "INGESTION PLANNED", "evIngestionDone": "INGESTION DONE", "evAgentAbort": "AGENT ABORT", "evAgentFail": "AGENT FAIL"}


def ack_log(events: DataFrame, kinds: dict[str, str] | None = None, details: tuple[str, ...] = ("value",)) -> DataFrame:
    """(corr, line) for each acknowledgement: its name, its correlation and its details that aren't null; other events go."""
    named = kinds or ACKS
    name = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in named.items()])
    parts = [F.when(F.col(d).isNotNull(), F.concat(F.lit(f" {d}="), F.col(d).cast("string"))) for d in details]
    line = F.concat(F.lit("[ack] "), name, F.lit(" corr="), F.col("corr").cast("string"), F.concat_ws("", *parts))
    return events.where(F.col("type").isin(*named)).select("corr", line.alias("line"))


def routed(df: DataFrame, sinks: dict[str, list]) -> object:
    """A foreachBatch function that hands each type's rows, by priority then id, to its subscribers (priority, id, f)."""

    def route(batch: DataFrame, epoch: int) -> None:
        rows = batch.persist()
        for kind, subscribers in sinks.items():
            for _, _, f in sorted(subscribers, key=lambda s: (-s[0], s[1])):
                f(rows.where(F.col("type") == kind), epoch)
        rows.unpersist()

    return df.writeStream.foreachBatch(route)


def delayed(events: DataFrame, kind: str, wait: str, delay: str = "1 minute") -> DataFrame:
    """(corr, due): once event time has passed the last event of a kind by wait, its delayed action; a later one restarts it.

    Pending actions are timers, released by the watermark, so they survive a restart of the query.
    """
    return stateful.by_corr(events.where(F.col("type") == kind), stateful.Delayed(wait), delay)
