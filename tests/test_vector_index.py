"""The vector index covers every row, its recall is measured against brute force, and it is exact where asked to be."""

import numpy as np
from pyspark.sql import functions as F

from tracewell.operators import vector_index as vi


def brute(rows, queries, k):
    keys, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for q, v in queries:
        d = ((x - np.array(v, np.float64)) ** 2).sum(1)
        order = sorted((float(d[i]), int(keys[i])) for i in range(len(keys)) if keys[i] != q)
        out[q] = order[:k]
    return out


def test_recall_on_the_given_table(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    queries = df.where("vec_id % 20 = 0")
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 10)
    model = vi.fit_centres(df)
    vi.save(vi.index_vectors(df, model), str(tmp_path / "index"))
    index = vi.load(spark, str(tmp_path / "index"))
    assert {r["key"] for r in index.select("key").collect()} == {k for k, _ in rows} and index.count() == len(rows)
    probes, measured = vi.probes_for(index, df.where("vec_id % 20 = 7"), model)
    assert measured >= 0.95 and probes <= len(model.centres)
    got = {}
    for r in vi.nearest(index, queries, model, probes=probes).collect():
        got.setdefault(r["query"], []).append(r["neighbour"])
    assert all(len(v) == 10 for v in got.values()) and got.keys() == want.keys()
    assert np.mean([len({k for _, k in want[q]} & set(got[q])) / 10 for q in want]) >= 0.9
    exact = vi.nearest(index, queries, model, probes=len(model.centres), again=None).collect()
    for q in want:
        mine = sorted((r["rank"], r["neighbour"], r["distance"]) for r in exact if r["query"] == q)
        assert [k for _, k, _ in mine] == [k for _, k in want[q]] and np.allclose([d for *_, d in mine], [d for d, _ in want[q]])


def test_copies_ties_and_blocks(spark, monkeypatch):
    """A third of all rows are copies: their list is cut into blocks, and ties go to the smaller keys."""
    monkeypatch.setattr(vi, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else [float(v) for v in rng.normal(size=4)]) for i in range(300)] + [(500, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("list", "block", "key", "code", "query")})
    full = df.where("embedding is not null")
    model = vi.fit_centres(full, lists=6)
    index = vi.index_vectors(df, model)
    assert index.count() == 300 and index.groupBy("list", "block").count().agg(F.max("count")).first()[0] < 60
    got = vi.nearest(index, df.where("vec_id in (0, 500)"), model, k=5, probes=6, again=None).collect()
    assert sorted((r["rank"], r["neighbour"], r["distance"]) for r in got) == [(1, 3, 0.0), (2, 6, 0.0), (3, 9, 0.0), (4, 12, 0.0), (5, 15, 0.0)]
    none = df.limit(0)
    assert vi.index_vectors(none, vi.fit_centres(none)).collect() == []


def test_exact_ties_go_to_the_smaller_key_and_little_leaves_a_block(spark):
    """Many copies and more rows than a block: the k smallest keys of a copy's own, whatever block they lie in."""
    rows = spark.range(3000).selectExpr("id AS vec_id", "transform(sequence(1, 4), i -> cast(if(id % 3 = 0, 1, id * i % 97) AS float)) AS embedding")
    model = vi.fit_centres(rows)
    index = vi.index_vectors(rows, model)
    found = vi.nearest(index, rows.where("vec_id IN (0, 2997)"), model, 5, len(model.centres), None)
    got = {q: [r.neighbour for r in sorted(found.where(f"query = {q}").collect(), key=lambda r: r.rank)] for q in (0, 2997)}
    x = {r.vec_id: r.embedding for r in rows.collect()}
    want = {q: sorted((k for k in x if k != q), key=lambda k: (sum((a - b) ** 2 for a, b in zip(x[k], x[q], strict=True)), k))[:5] for q in (0, 2997)}
    assert got == want
