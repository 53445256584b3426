"""Queries of the operators that SQL can express, against DuckDB."""

import duckdb
import pytest

from lakewright.llm.queries import ORACLE_SQL, QUERIES


def canon(rows):
    return sorted(repr([None if v is None else str(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    res = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert canon([r[c] for c in cols] for r in df.collect()) == canon([dict(zip(names, r))[c] for c in cols] for r in res.fetchall())
