"""Every registered query against its SQL on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from riskloom.plans import registry
from tools.check_oracle import rows_of

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test data")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in sorted(os.listdir(BASE)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{BASE}/{f}'")
    return con


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"train_and_evaluate"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, BASE)
    got = rows_of(df.columns, df.collect())
    con.execute(entry.oracle_sql()[name])
    assert got == rows_of([c[0] for c in con.description], con.fetchall())


def test_exact_lexing(spark):
    from pyspark.sql import functions as F
    from riskloom.functions.lexing import lex_model_tokens, model_tokens
    docs = spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "text")
    got = docs.select("doc_id", lex_model_tokens(F.col("text")).alias("t")).collect()
    assert dict(map(tuple, got)) == {d: model_tokens(t) for d, t in docs.collect()}
