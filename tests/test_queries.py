"""Every registered query runs; those with a SQL twin give the same rows as DuckDB."""

import pytest

import __spark_entry__ as entry
from harness import duck, duck_rows, spark_rows

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, sf, con):
    cols, rows = spark_rows(QUERIES[name](spark, sf))
    dcols, drows = duck_rows(con, SQL[name])
    assert cols == dcols
    assert rows == drows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [
    "top_pairs_good", "best_rise", "fire_triplets", "order_tiles", "link_sources", "link_by_ids", "join_authors",
    "split_windows"])
def test_hot_keys_give_the_same(name, spark, sf, con):
    """Nothing is broadcast, and adaptive execution splits almost every key."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256"}
    before = {c: spark.conf.get(c) for c in small}
    try:
        for c, v in small.items():
            spark.conf.set(c, v)
        _, rows = spark_rows(QUERIES[name](spark, sf))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert rows == duck_rows(con, SQL[name])[1]
