"""Queries against their SQL where a share, or a candidate, lies just at a bound."""

import __spark_entry__
import duckdb


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables that DuckDB has made."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    expected = found.fetchall()
    got = [tuple(r[c] for c in columns) for r in __spark_entry__.queries()[name](spark, str(folder)).collect()]
    return sorted(got, key=str), sorted(expected, key=str)


def test_no_reject_is_bypassed_by_an_exact_copy(spark, tmp_path):
    """Copies of a query's vector with a rejected label, whose cosine of 1 passes the bounds of a bypass."""
    rows = "(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 3), (2, [1.0, 0.0], 7), (3, [1.0, 1.0], 2), (100, [0.0, 1.0], 1), (101, [0.0, 1.0], 3)"
    got, expected = both(spark, tmp_path, "resolve_top1", embeddings=f"SELECT v::BIGINT AS vec_id, e::FLOAT[] AS embedding, l::INT AS label FROM (VALUES {rows}) t(v, e, l)")
    assert got == expected
    assert [r[1] for r in got] == [3, 3]


def test_shares_at_the_bounds_of_foreign_cuts(spark, tmp_path):
    """Lines of three orders with shares of a half and a fifth."""
    lines = [
        (25280, 1, 48.0, 0.01, 0.05, 2953), (25280, 1, 3.0, 0.07, 0.07, 15150), (25280, 2, 3.0, 0.06, 0.08, 4557), (25280, 2, 43.0, 0.08, 0.06, 10142), (25280, 4, 49.0, 0.05, 0.03, 4161), (25280, 5, 31.0, 0.01, 0.08, 179), (25280, 6, 18.0, 0.04, 0.05, 1439),
        (25280, 7, 38.0, 0.09, 0.0, 10580), (99029, 2, 14.0, 0.07, 0.05, 4892), (99029, 2, 7.0, 0.0, 0.08, 6273), (99029, 4, 23.0, 0.09, 0.04, 1707), (99029, 4, 9.0, 0.05, 0.04, 2808), (99029, 5, 43.0, 0.03, 0.05, 18876), (99029, 6, 50.0, 0.09, 0.06, 6154),
        (99029, 6, 23.0, 0.02, 0.08, 13967), (142201, 3, 41.0, 0.05, 0.07, 1118), (142201, 4, 2.0, 0.05, 0.0, 10772), (142201, 4, 33.0, 0.06, 0.04, 16190), (142201, 6, 28.0, 0.07, 0.06, 12924), (142201, 6, 14.0, 0.03, 0.04, 13473), (142201, 7, 24.0, 0.03, 0.03, 5877),
    ]
    values = ", ".join(map(str, lines))
    sql = f"SELECT o::BIGINT AS l_orderkey, n::INT AS l_linenumber, q::DOUBLE AS l_quantity, d::DOUBLE AS l_discount, t::DOUBLE AS l_tax, k::BIGINT AS l_partkey, 1.0::DOUBLE AS l_extendedprice FROM (VALUES {values}) v(o, n, q, d, t, k)"
    got, expected = both(spark, tmp_path, "box_foreign_cuts", lineitem=sql)
    assert got == expected
    assert [r[0] for r in got] == [25280, 99029]
