"""Queries and items are compared by what they name and hold, and become pairs only where rows are returned."""

import re

import __spark_entry__
import duckdb
from pyspark.sql import functions as F

from linkfold.operators import lexicon


def test_pairs_of_a_brand_are_not_shuffled(spark, tmp_path, monkeypatch):
    """A brand with more parts of a kind than a block holds, one of a single part and parts without a brand, against the SQL."""
    monkeypatch.setattr(lexicon, "BLOCK", 3, raising=False)
    con = duckdb.connect()
    rows = "SELECT k::BIGINT AS p_partkey, CASE WHEN k % 3 = 0 THEN 'red ring' WHEN k % 3 = 1 THEN 'hot bolt' ELSE 'white bolt' END AS p_name, CASE WHEN k = 60 THEN 'alone' WHEN k % 11 = 7 THEN NULL ELSE 'b' || (k // 10 % 2) END AS p_brand, (abs(k) % 9)::INT AS p_size FROM range(-40, 200) r(k)"
    con.execute(f"COPY ({rows}) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    found = __spark_entry__.queries()["exclusive_evaluation"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Join|Aggregate|Repartition|Window|Sort", plan[: plan.find("Generate")])  # nothing gathers what the explosions return
    columns = ["query_id", "id", "lexicon", "missing"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()['exclusive_evaluation']})").fetchall()
    got = [tuple(r) for r in found.select(columns).collect()]
    assert sorted(got) == sorted(want) and len(want) > 500


def test_candidates_by_a_key_equal_those_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "BLOCK", 2, raising=False)
    texts = ["Каберне Совиньон dry", "каберие совиньон red", "совиньон sweet red", "мерло", None, "", "красное red сухое"]
    queries = spark.createDataFrame([(k, t, k % 2 if k < 6 else None) for k, t in enumerate(texts * 2)], "query_id long, text string, house int")
    items = spark.createDataFrame([(100 + k, t, u, k % 3 if k % 5 else None) for k, (t, u) in enumerate((t, u) for t in texts for u in texts)], "id long, grape string, type string, house int")
    forms = (("каберне совиньон", ("каберне совиньон",)), ("мерло", ("мерло",)), ("совиньон", ("совиньон",)))
    tables = {"grape": lexicon.lexicon_table(spark, "grape", forms), "type": lexicon.lexicon_table(spark, "type", lexicon.TYPE)}
    pairs = queries.join(items.select("id", "house"), "house").select("query_id", "id")
    rows = lambda found: sorted((r["query_id"], r["id"], r["lexicon"], r["missing"]) for r in found.collect())
    want = rows(lexicon.evaluate_exclusive(queries.select("query_id", "text"), items, pairs.unionByName(pairs), tables))
    assert rows(lexicon.evaluate_exclusive(queries, items, ["house"], tables)) == want and {r[2] for r in want} == {"grape", "type"}
    joined = lexicon.evaluate_exclusive(queries, items, ["house"], tables, sep=",").withColumn("missing", F.split("missing", ","))
    assert rows(joined) == want
