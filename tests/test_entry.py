import duckdb
import pytest

import __spark_entry__ as entry
from stepforge.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return c


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "source", "lang", "text_len"] and df.count() > 0


def rows(frame):
    return sorted(map(tuple, frame[sorted(frame.columns)].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    if sql := registry.oracle_sql().get(name):
        want = duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
