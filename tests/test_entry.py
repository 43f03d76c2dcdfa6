import importlib.util

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_statements_name_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["a1_monthly", "d10_rule_score", "d12_price_hike", "f7_cascade", "j1_greedy"])
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(rel.columns)
    ours = __spark_entry__.queries()[name](spark, SF)
    assert sorted(ours.columns) == columns
    tidy = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert tidy(ours.select(*columns).collect()) == tidy(rel.select(", ".join(columns)).fetchall())


def test_library_stands_without_the_optional_part():
    assert importlib.util.find_spec("ledgerline.plans.catalog")
