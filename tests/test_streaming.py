import os

import pytest
from pyspark.sql import functions as F

from tracewell.operators import windows
from tracewell.streaming import incidents as s
from tracewell.tables import events


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        return df.sparkSession.table(name).collect()
    finally:
        q.stop()


def stream(spark, tmp_path, rows):
    at = str(tmp_path / "in")
    rows.select("corr", "event_id", "type", "value", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(at)
    return spark.readStream.schema(spark.read.parquet(at).schema).parquet(at)


def batches(spark, tmp_path, name, rows, every=40):
    """A stream of files, one a micro-batch, in order of time: rows (corr, event_id, type, value, ts in seconds)."""
    at = tmp_path / name
    df = spark.createDataFrame(rows, "corr long, event_id long, type string, value double, s long").select("corr", "event_id", "type", "value", F.timestamp_seconds("s").alias("ts"), "s")
    for i, cut in enumerate(sorted({r[4] // every for r in rows})):
        df.where(f"s div {every} = {cut}").drop("s").coalesce(1).write.parquet(str(at / f"tmp{i}"))
        part = next((at / f"tmp{i}").glob("part-*"))
        part.rename(at / f"{i:03}.parquet")
        os.utime(at / f"{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return s.event_source(spark, str(at / "*.parquet"), most_files=1)


@pytest.fixture
def one_partition(spark):
    """Many micro-batches of few rows: one state store instead of several."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_state_crosses_batches(spark, tmp_path, one_partition):
    """Pairs once per correlation, sessions and timelines over several micro-batches, and state that ends."""
    as_set = lambda x: {tuple(r) for r in x}
    rows = [(1, 1, "a", 0.0, 10), (2, 2, "b", 0.0, 20), (1, 3, "a", 0.0, 50), (1, 4, "b", 0.0, 90), (2, 5, "a", 0.0, 130), (1, 6, "b", 0.0, 140), (2, 7, "b", 0.0, 170), (3, 8, "a", 0.0, 180)]
    src = batches(spark, tmp_path, "pairs", rows)
    assert sorted(tuple(r) for r in run(s.event_pairs(src, "a", "b", "5 minutes", "1 hour"), "pairs")) == [(1, 10_000, 90_000), (2, 130_000, 20_000)]
    # state ends one minute after the last event: the second b finds nothing
    late = [(1, 1, "a", 0.0, 5), (9, 2, "x", 0.0, 100), (8, 3, "a", 0.0, 200), (8, 4, "b", 0.0, 300), (1, 5, "b", 0.0, 400), (7, 6, "a", 0.0, 900)]
    src = batches(spark, tmp_path, "ends", late)
    assert sorted(tuple(r)[0] for r in run(s.event_pairs(src, "a", "b", "1 second", "3 minutes"), "ends")) == [8]
    # a row beyond the watermark is dropped
    gone = [(1, 1, "a", 0.0, 5), (2, 2, "a", 0.0, 1000), (2, 3, "b", 0.0, 1041), (1, 4, "b", 0.0, 1081)]
    at = batches(spark, tmp_path, "gone", gone)
    old = spark.createDataFrame([(5, 9, "a", 0.0), (5, 10, "b", 0.0)], "corr long, event_id long, type string, value double").withColumn("ts", F.timestamp_seconds(F.lit(3)))
    old.coalesce(1).write.parquet(str(tmp_path / "gone" / "old"))
    next((tmp_path / "gone" / "old").glob("part-*")).rename(tmp_path / "gone" / "9.parquet")
    os.utime(tmp_path / "gone" / "9.parquet", (1_700_001_000, 1_700_001_000))
    assert sorted(tuple(r)[0] for r in run(s.event_pairs(at, "a", "b", "1 second", "1 hour"), "gone")) == [1, 2]
    fold = [(1, 1, "start", 0.0, 5), (1, 2, "up", 1.5, 50), (1, 3, "up", 2.5, 90), (1, 4, "fail", 0.0, 130), (1, 5, "fail", 0.0, 140), (1, 6, "done", 0.0, 170), (1, 7, "fail", 0.0, 210), (2, 8, "fail", 0.0, 220)]
    src = batches(spark, tmp_path, "fold", fold)
    assert as_set(run(s.session_fold(src, "start", ["up"], ["fail"], "done", "5 minutes"), "folds")) == {(1, "fail", True, "up=2.5"), (1, "fail", False, ""), (2, "fail", False, "")}
    src = batches(spark, tmp_path, "flush", fold)
    got = sorted(tuple(r) for r in run(s.timeline(src, "done", "5 minutes"), "flushed"))
    assert [(r[1], r[3], r[4]) for r in got] == [(1, 0, 0), (2, 45_000, 45_000), (3, 40_000, 85_000), (4, 40_000, 125_000), (5, 10_000, 135_000), (6, 30_000, 165_000)]
    edges = [(1, 1, "v", 5.0, 5), (1, 2, "v", 1.0, 50), (1, 3, "v", 5.0, 90), (1, 4, "v", 6.0, 130), (1, 5, "v", 1.0, 131), (1, 6, "v", 7.0, 170)]
    assert sorted(r["event_id"] for r in run(s.rising_edges(batches(spark, tmp_path, "edges", edges), 4.0, "5 minutes"), "rises")) == [3, 6]


def test_acks_and_routing(spark, tmp_path):
    rows = [(1, 1, "evSRDone", 2.0, 0), (1, 2, "evD2", 0.0, 50), (2, 3, "evAgentFail", 1.0, 90)]
    src = batches(spark, tmp_path, "acks", rows)
    assert sorted(r["line"] for r in run(s.ack_log(src), "lines")) == ["[ack] AGENT FAIL corr=2 value=1.0", "[ack] SRDONE corr=1 value=2.0"]
    heard = []
    sink = lambda who: lambda df, epoch: heard.append((who, sorted(r["event_id"] for r in df.collect())))
    q = s.routed(batches(spark, tmp_path, "routes", rows), {"evSRDone": [(1, 7, sink("low")), (5, 9, sink("high")), (5, 8, sink("first"))]}).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [w for w, ids in heard if ids] == ["first", "high", "low"]


def test_stream_is_batch(spark, tmp_path):
    rows = events(spark, "/root/testdata/sf0.001").cache()
    src = stream(spark, tmp_path, rows)
    as_set = lambda x: {tuple(r) for r in x}
    assert as_set(run(s.rising_edges(src, 100.0, "400 days"), "edges")) == as_set(windows.rising_edges(rows, F.col("value") > 100).select("corr", "event_id", "value").collect())
    assert as_set(run(s.timeline(src, delay="400 days"), "line")) == as_set(windows.timeline(rows).select("corr", "event_id", "type", "delta_ms", "total_ms").collect())
    fold = windows.session_fold(rows, "signup", ["click", "view"], ["error"]).collect()
    want = {(r["corr"], r["trigger"], r["active"], "|".join(f"{k}={r[f'last_{k}']!r}" for k in ("click", "view") if r[f"last_{k}"] is not None)) for r in fold}
    assert as_set(run(s.session_fold(src, "signup", ["click", "view"], ["error"], delay="400 days"), "fold")) == want
    assert {r["corr"] for r in run(s.once_only(src, ["error"], "40 days"), "once")} == {r["corr"] for r in windows.once_only(rows, ["error"]).collect()}


NAMES = ["a;b", "x,y", "k=v|w", "a;b", "", "日\n"]


def test_any_type_name_survives_batches(spark, tmp_path, one_partition):
    """Held lines and kept values are typed state: no sign in a type's name ends them, and numbers stay as they are."""
    rows = [(1, i, t, float(i) + 0.1, 5 + 40 * i) for i, t in enumerate([*NAMES, "end"])]
    got = sorted(tuple(r) for r in run(s.timeline(batches(spark, tmp_path, "odd", rows), "end", "5 minutes"), "odd_lines"))
    assert [(r[1], r[2], r[3], r[4]) for r in got] == [(i, t, 40_000 * (i > 0), 40_000 * i) for i, t in enumerate([*NAMES, "end"])]
    rows = [(1, 0, "start", 0.0, 5)] + [(1, i + 1, t, i / 3, 45 + 40 * i) for i, t in enumerate(NAMES)] + [(1, 9, "fail", 0.0, 400)]
    got = run(s.session_fold(batches(spark, tmp_path, "odd2", rows), "start", NAMES, ["fail"], delay="5 minutes"), "odd_fold")
    last = {t: i / 3 for i, t in enumerate(NAMES)}
    assert [tuple(r) for r in got] == [(1, "fail", True, "|".join(f"{t}={v!r}" for t, v in sorted(last.items())))]


def test_restart_from_a_checkpoint(spark, tmp_path, one_partition):
    """A query that is stopped after each file and started again gives what one that runs through gives."""
    kinds = ["a;b", "go", "end", "go", "x", "end", "go", "go"]
    rows = [(c, 10 * i + c, t, 1.0, 5 + 40 * i + c) for i, t in enumerate(kinds) for c in ((1, 2) if i < 4 else (1,))]
    src = batches(spark, tmp_path, "again", rows)
    forms = {"line": (lambda e: s.timeline(e, "end", "1 minute", "1 hour"), 9), "late": (lambda e: s.delayed(e, "go", "10 seconds", "1 second"), 1)}
    for name, (form, least) in forms.items():
        want = {tuple(r) for r in run(form(src), f"through_{name}")}
        for i in range(len(kinds) + 2):
            q = form(s.event_source(spark, str(tmp_path / "again" / f"00[0-{min(i, len(kinds) - 1)}].parquet"), most_files=1)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"cp_{name}")).option("path", str(tmp_path / f"out_{name}")).trigger(availableNow=True).start()
            q.awaitTermination(120)
        got = [tuple(r) for r in spark.read.parquet(str(tmp_path / f"out_{name}")).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(got) >= least


def test_state_falls_when_it_ends(spark, tmp_path, one_partition):
    rows = [(c, c, "x", 0.0, 5) for c in range(50)] + [(99, 99, "x", 0.0, 400), (99, 100, "x", 0.0, 800), (99, 101, "x", 0.0, 1200)]
    q = s.timeline(batches(spark, tmp_path, "falls", rows), "end", "1 second", "1 minute").writeStream.format("memory").queryName("falls").start()
    try:
        q.processAllAvailable()
        sizes = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]
    finally:
        q.stop()
    assert max(sizes) >= 50 and sizes[-1] < max(sizes) / 5
