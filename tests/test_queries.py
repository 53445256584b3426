"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from lakewright.catalogue_queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def canon(rows):
    return sorted(repr([float(v) if isinstance(v, float) else str(v) if v is not None else None for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    res = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert canon([r[c] for c in cols] for r in df.collect()) == canon([dict(zip(names, r))[c] for c in cols] for r in res.fetchall())
