"""Processors with named state for each correlation: values, lists and maps of typed columns, and event-time timers.

A correlation's state ends when the watermark passes its last event by keep (a timer of its own), or where an event closes
it. State lives in RocksDB, which spills to disk, and restarts from the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TYPES = {"long": "int64", "double": "float64", "boolean": "bool", "string": "object"}


def millis(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)


def frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    cols = [c.split() for c in schema.split(", ")]
    return pd.DataFrame(rows, columns=[c for c, _ in cols]).astype({c: _TYPES[t] for c, t in cols})


class Correlation(StatefulProcessor):
    """Takes a correlation's new events in order of (ts, event_id). take() gives the output rows and whether state stays."""

    out = ""

    def __init__(self, keep: str) -> None:
        self.keep = millis(keep)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def take(self, corr: int, rows: pd.DataFrame) -> tuple[list[tuple], bool]:
        raise NotImplementedError

    def clear(self) -> None:
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out, stays = self.take(key[0], new)
        last = max(int(new["ts"].max().value // 1_000_000), self.last.get()[0] if self.last.exists() else 0)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if stays:
            self.last.update((last,))
            self.handle.registerTimer(max(last + self.keep, timerValues.getCurrentWatermarkInMs() + 1))
        else:
            self._forget()
        yield frame(out, self.out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self._forget()
        yield frame([], self.out)

    def _forget(self) -> None:
        self.last.clear()
        self.clear()

    def close(self) -> None:
        pass


class Timeline(Correlation):
    """See incidents.timeline()."""

    out = "corr long, event_id long, type string, delta_ms long, total_ms long"

    def __init__(self, flush: str | None, keep: str) -> None:
        super().__init__(keep)
        self.flush = flush

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.total = handle.getValueState("total", "at long, total long")
        self.held = handle.getListState("held", "event_id long, type string, delta_ms long, total_ms long")

    def clear(self) -> None:
        self.total.clear()
        self.held.clear()

    def take(self, corr: int, rows: pd.DataFrame) -> tuple[list[tuple], bool]:
        last, total = self.total.get() if self.total.exists() else (None, 0)
        lines, out = [], []
        for r in rows.itertuples():
            now = int(r.ts.value // 1_000_000)
            delta = 0 if last is None else now - last
            total, last = total + delta, now
            lines.append((int(r.event_id), r.type, delta, total))
            if self.flush is None or r.type == self.flush:
                earlier = [tuple(x) for x in self.held.get()] if self.flush is not None and self.held.exists() else []
                out += [(corr, *x) for x in (*earlier, *lines)]
                lines = []
                if self.flush is not None:
                    last, total = None, 0
                    self.held.clear()
        if last is None:
            return out, False
        if lines:
            self.held.appendList(lines)
        self.total.update((last, total))
        return out, True


class Session(Correlation):
    """See incidents.session_fold()."""

    out = "corr long, trigger string, active boolean, updates string"

    def __init__(self, start: str, updates: list[str], triggers: list[str], close: str | None, keep: str) -> None:
        super().__init__(keep)
        self.start, self.updates, self.triggers, self.end = start, updates, triggers, close

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.mode = handle.getValueState("mode", "active boolean, done boolean")
        self.values = handle.getMapState("values", "type string", "value double")

    def clear(self) -> None:
        self.mode.clear()
        self.values.clear()

    def take(self, corr: int, rows: pd.DataFrame) -> tuple[list[tuple], bool]:
        open_ = self.mode.exists()
        active, done = self.mode.get() if open_ else (False, False)
        out = []
        for r in rows.itertuples():
            if r.type == self.end:
                active, done, open_ = False, False, False
                self.values.clear()
                continue
            open_ = True
            if done:
                continue
            if r.type == self.start:
                active = True
                self.values.clear()
            elif r.type in self.triggers:
                found = sorted((k[0], v[0]) for k, v in self.values.iterator())
                out.append((corr, r.type, bool(active), "|".join(f"{k}={v!r}" for k, v in found)))
                done = True
            elif r.type in self.updates and active:
                self.values.updateValue((r.type,), (float(r.value),))
        if open_:
            self.mode.update((bool(active), bool(done)))
        return out, open_


class Delayed(StatefulProcessor):
    """See incidents.delayed(): one timer per correlation, moved by each later event."""

    out = "corr long, due long"

    def __init__(self, wait: str) -> None:
        self.wait = millis(wait)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        due = int(pd.concat(list(rows))["ts"].max().value // 1_000_000) + self.wait
        if self.due.exists():
            due = max(due, self.due.get()[0])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if due <= timerValues.getCurrentWatermarkInMs():
            # a row that is late, but not late enough to be dropped: its action is due already
            self.due.clear()
            yield frame([(key[0], due)], self.out)
            return
        self.due.update((due,))
        self.handle.registerTimer(due)
        yield frame([], self.out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        due = self.due.get()[0]
        self.due.clear()
        yield frame([(key[0], due)], self.out)

    def close(self) -> None:
        pass


def by_corr(events: DataFrame, processor: StatefulProcessor, delay: str) -> DataFrame:
    """The processor's rows over events with a watermark; sets the session's state store to the one that such state needs."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return events.withWatermark("ts", delay).groupBy("corr").transformWithStateInPandas(processor, processor.out, "Append", "EventTime")
