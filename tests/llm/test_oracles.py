import duckdb
import pytest

from trackforge.llm import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df, want = registry.QUERIES[name](spark, DIR), con.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    key = lambda names, rows: sorted((tuple(r[names.index(c)] for c in order) for r in rows), key=repr)
    assert key(df.columns, df.collect()) == key(want.columns, want.fetchall())
