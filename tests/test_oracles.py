"""Every registered query against its SQL oracle."""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


def plain(value):
    return float(value) if isinstance(value, Decimal) else value


def duck(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    return columns, result.fetchall()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_oracle(spark, name):
    sf_dir = SMALL
    df = entry.queries()[name](spark, sf_dir)
    columns, rows = duck(sf_dir, entry.oracle_sql()[name])
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    got = sorted(str(tuple(plain(r[c]) for c in order)) for r in df.collect())
    wanted = sorted(str(tuple(plain(r[columns.index(c)]) for c in order)) for r in rows)
    assert got == wanted
    assert got, "an empty result proves nothing"


def test_queries_without_oracle_return_rows(spark):
    for name in set(entry.queries()) - set(entry.oracle_sql()):
        assert entry.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["shipment_id", "n_items", "fob", "freight", "insurance", "cif"] and df.count() > 0
