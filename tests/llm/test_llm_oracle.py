"""The queries that SQL can express against their DuckDB twins."""

import pytest

from shardwright.llm.queries import QUERIES
from shardwright.llm.sql import SQL
from test_oracle import canon


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df, rel = QUERIES[name](spark, small), con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(rel.columns, rel.fetchall())


def test_every_operator_is_registered_once():
    from collections import Counter

    n = Counter(int(q[2:].split("_")[0]) for q in QUERIES)
    assert n == Counter(range(1, 14))
