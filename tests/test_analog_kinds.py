"""Queries that ask for the same are ranked once, each without the item that it excludes."""

from linkfold.operators import analogs


def test_equal_criteria_meet_the_kinds_once(spark, monkeypatch):
    monkeypatch.setattr(analogs, "BLOCK_QUERIES", 1)
    rows = [(k, f"p{k % 2}", ["merlot"], "red", "dry" if k % 4 else None) for k in range(1, 13)]
    items = spark.createDataFrame(rows, "id long, producer string, grapes array<string>, category string, type string")
    asked = items.filter("id in (1, 3, 5)").selectExpr("id as query_id", "id as exclude_id", "producer", "grapes", "category", "type")
    found = analogs.rank_analogs(asked, items, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 1
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["id"], r["rank"], r["score"], r["hits"]))
    assert got == {q: [(i, k + 1, 1.0, 4) for k, i in enumerate([x for x in (1, 3, 5, 7, 9) if x != q][:3])] for q in (1, 3, 5)}
