"""Fill-in-the-middle samples by slicing strings, and Elias-Fano lists against the numbers they hold."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import fim

SCHEMA = "doc_id long, text string"


def sample(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


key = lambda r: tuple((x is None, x) for x in r)


def test_lists():
    rng = np.random.default_rng(1)
    for m, u in ((1, 0), (1, 5), (3, 1000), (700, 700), (5000, 9000), (20_000, 10_000_000)):
        v = np.sort(rng.integers(0, u + 1, m))
        packed = fim.elias_fano(iter(np.array_split(v, 7)), m, u)
        assert fim.length(packed) == m
        for i in {0, m - 1, m // 2, *rng.integers(0, m, 200).tolist()}:
            assert fim.select(packed, i) == v[i]
        with pytest.raises(IndexError):
            fim.select(packed, m)


def test_boundaries(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(fim, "CHUNK", 50)
    for n in (0, 1, 40, 3000):
        text = "".join(rng.choice("ab é日😀\n") for _ in range(n))
        packed = fim.boundaries(text.encode())
        assert fim.length(packed) == n + 1
        assert all(fim.select(packed, i) == len(text[:i].encode()) for i in range(0, n + 1, max(1, n // 97)))


def test_samples(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice(["a", "é", "日", "😀", "<", ">", "P", "S>", "<P", "M", "<M>", " "]) for _ in range(rng.randint(0, 20)))
    rows = [(i, text()) for i in range(800)] + [(i, "all the same <") for i in range(800, 1300)] + [(None, "null id"), (None, ""), (1, None), (7, "x" * 300_000), (7, "again"), (7, "again")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("hash", "digest", "salt", "salts", "n", "form", "h1", "cut", "boundaries", "output")})
    made = fim.fill_in_middle(df)
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((sample(*r) for r in rows), key=key)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in rows)
    assert fim.fill_in_middle(df.limit(0)).collect() == []


def test_one_list_per_text(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("id AS doc_id", "if(id % 2 = 0, 'hot text', concat('text ', id)) AS text")
    index = fim.text_index(docs.selectExpr("unhex(sha2(text, 256)) AS digest", "0L AS salt", "text")).collect()
    assert len(index) == 2001
    lying = docs.selectExpr("X'00' AS digest", "0L AS salt", "text")
    with pytest.raises(Exception, match="two texts have one digest"):
        fim.text_index(lying).collect()
    built = []
    monkeypatch.setattr(fim, "boundaries", lambda text, f=fim.boundaries: built.append(bytes(text)) or f(text))
    ids = [b"a", b"a", b"b", b"b", b"b"]
    part = [pa.array(ids, pa.binary()), pa.array([x * 3 for x in ids], pa.binary()), pa.array(range(5)), pa.array([7] * 5)]
    found = [x for a in fim._cuts(iter([[p[:3] for p in part], [p[3:] for p in part]])) for x in a.to_pylist()]
    assert built == [b"aaa", b"bbb"] and [(x["n"], x["begin"], x["end"]) for x in found] == [(3, 0, 3), (3, 1, 3), (3, 2, 3), (3, 3, 3), (3, 0, 3)]


def test_texts_are_shuffled_once(spark):
    docs = spark.range(100).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    plan = fim.fill_in_middle(docs)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.split("\n") if "Exchange hashpartitioning(digest" in x]
    assert len(moved) == 2, plan
