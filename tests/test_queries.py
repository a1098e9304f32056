"""Every query against its SQL on the smallest tables; those without SQL have to run and keep their schema."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from stepweave import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(frame):
    plain = lambda v: None if v is None or v != v else round(v, 9) if isinstance(v, float) else v
    return sorted(repr([plain(v) for v in r]) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir)
    frame = got.toPandas()
    if name in queries.SQL:
        want = duck.execute(queries.SQL[name]).df()
        assert sorted(frame.columns) == sorted(want.columns)
        assert rows(frame) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_results_do_not_depend_on_partitioning(spark, sf_dir):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = {n: rows(queries.QUERIES[n](spark, sf_dir).toPandas()) for n in ("normalized_candidates", "spanning_forests", "matcher_clusters")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert first == {n: rows(queries.QUERIES[n](spark, sf_dir).toPandas()) for n in first}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
