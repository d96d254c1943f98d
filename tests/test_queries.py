"""Every query of the registry against its SQL, on the smallest tables; queries without SQL are run."""

import duckdb
import pytest

from linkfold.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, tmp_path, name):
    out = str(tmp_path / "out")
    QUERIES[name](spark, sf_dir).write.parquet(out)
    got = duck.execute(f"SELECT * FROM '{out}/*.parquet'").fetch_df()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = duck.execute(ORACLE_SQL[name]).fetch_df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    sort = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert sort(want).equals(sort(got))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
