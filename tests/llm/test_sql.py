import duckdb
import pandas as pd
import pytest

from folioscan.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    cell = lambda v: None if pd.isna(v) else v
    plain = lambda df: sorted([tuple(str(cell(v)) for v in r) for r in df[columns].astype(object).values.tolist()])
    assert plain(got) == plain(want)
