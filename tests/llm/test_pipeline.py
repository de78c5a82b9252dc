"""The pipeline's stages, and the queries' SQL, on the smallest tables."""

import re
from collections import Counter

import duckdb
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tracewell.llm import bpe, quality_model, queries, toxicity

DIR = "/root/testdata/sf0.001"


def awkward(spark):
    """Documents with null, empty and long texts, null ids, repeated rows and columns whose names the operators use."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    more = [(10_000, None, None, None, None), (10_001, "", "en", None, 0), (None, "no id at all here", "en", "src1", 17), (10_002, "a" * 50_000, "en", "src2", 50_000), (10_003, "word " * 30_000, None, "src2", 150_000)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    return docs.unionByName(docs.where("doc_id % 9 = 0")).withColumns({c: F.lit(1) for c in ("n", "words", "kept", "toxic", "component_id", "h", "__s", "id")})


def test_stages(spark, tmp_path):
    docs = awkward(spark)
    columns, rows = docs.columns, Counter(r["doc_id"] for r in docs.collect())
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(at := str(tmp_path / name))
        docs = spark.read.parquet(at)
        kept = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        assert set(kept) <= set(rows)
        if name == "mixture":
            assert set(kept) == set(rows) and all(kept[x] >= rows[x] for x in kept)  # every row is taken once at least
        elif name == "tokens":
            assert kept == rows
        else:
            assert all(kept[x] == rows[x] for x in kept) and 0 < len(kept) < len(rows)  # repeated rows stay or go together
            assert None in kept
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        rows = kept
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "mixture")).collect()}
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(open(path, "rb").read()), special_tokens={})
    assert all(list(r["ids"]) == own.encode_ordinary(texts[r["doc_id"]]) for r in docs.limit(60).collect())


def test_stages_against_the_operators(spark, tmp_path):
    """What the first three stages keep, from their operators' rows and a join by hand."""
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    good = {r["doc_id"] for r in quality_model.quality_classifier(docs, labels).collect() if r["kept"]}
    assert ids(stages["quality"](spark, docs, DIR)) == sorted(good)
    calm = {r["doc_id"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect() if not r["toxic"]}
    assert ids(stages["toxicity"](spark, docs, DIR)) == sorted(calm)
    sets = {r["doc_id"]: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (r["text"] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()) else set() for r in docs.collect()}
    least = {i: i for i in sets}
    for _ in range(20):
        for a, x in sets.items():
            for b, y in sets.items():
                if a < b and x and y and least[a] != least[b] and 100 * len(x & y) >= 80 * len(x | y):
                    least[a] = least[b] = min(least[a], least[b])
    assert ids(stages["near_duplicates"](spark, docs, DIR)) == sorted(i for i, x in least.items() if i == x)


def test_empty_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DIR).write.parquet(at := str(tmp_path / name))
        docs = spark.read.parquet(at)
        assert docs.count() == 0


def test_sql(spark):
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, DIR)
        want = duck.sql(sql)
        at = [want.columns.index(c) for c in df.columns]
        assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr), name


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and [m[0] for n in names if (m := re.match(r"op\d+(?=_)", n))] == [f"op{i}" for i in range(1, 14)]
    assert set(__spark_entry__.oracle_sql()) <= set(names)
