"""Every query that has SQL gives the rows that DuckDB gives, on the smallest tables."""

import re

import duckdb
import pytest

from tracewell.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DIR)
    got = df.collect()
    if name not in catalogue.oracle_sql():
        assert got
        return
    want = duck.sql(catalogue.oracle_sql()[name])
    names = sorted(df.columns)
    assert sorted(want.columns) == names
    at = [want.columns.index(n) for n in names]
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_mentions_of_short_names(spark):
    names, docs = ({k: set(re.findall("[A-Za-z_][A-Za-z0-9_]*", t or "")) for k, t in spark.read.parquet(f"{DIR}/{f}.parquet").select(key, "text").collect()} for f, key in (("benchmark", "item_id"), ("documents", "doc_id")))
    known = set().union(*names.values())
    want = {(k, n) for k, ws in docs.items() for n in ws & known}
    got = [tuple(r) for r in catalogue.queries()["code_mentions"](spark, DIR).collect()]
    assert any(len(n) < 9 for _, n in want) and sorted(got) == sorted(want)
