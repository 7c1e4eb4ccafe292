"""Every query that has SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

import __spark_entry__ as entry
from rostrum.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(pytestconfig):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{pytestconfig.DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, pytestconfig, name):
    df = QUERIES[name](spark, pytestconfig.DATA)
    got = sorted(repr(tuple(r)) for r in df.select(sorted(df.columns)).collect())
    if name not in SQL:
        assert got
        return
    r = duck.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=names.__getitem__)
    assert got == sorted(repr(tuple(x[i] for i in order)) for x in r.fetchall())


@pytest.mark.parametrize("name", ["turn_reconstruction", "systematic_sample", "bin_packing", "asof_previous", "pareto_dominated"])
def test_partitions_do_not_matter(spark, pytestconfig, name):
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, QUERIES[name](spark, pytestconfig.DATA).collect()), key=repr))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
