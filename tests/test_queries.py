"""Every query with SQL gives the same rows in both engines, whatever the number of partitions."""

import duckdb
import pandas as pd
import pytest

from tesselace.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list:
    def plain(v):
        if pd.isna(v):
            return (0, "")
        if isinstance(v, str):
            return (1, v)
        return (2, float(v))

    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(request):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 500


@pytest.mark.parametrize("name", ["gaussian_stencil", "csr_layout", "ordered_fold", "radius_join"])
def test_partitions_do_not_matter(spark, sf, name):
    first = rows(registry.queries()[name](spark, sf).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows(registry.queries()[name](spark, sf).toPandas()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
