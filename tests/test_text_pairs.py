"""The work of comparing texts: dealt out over all cores, and no more comparisons than can change a result."""

import random

import __spark_entry__
from linkfold.functions import similarity
from linkfold.operators import pairs
from pyspark.sql import functions as F


def test_pairs_of_texts_are_dealt_out(spark, tmp_path):
    """A megabyte of texts is compared by all cores, not in one task."""
    rows = [(c, k, f"word{c} other{k}\nline {c * k}") for c in range(40) for k in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    cores = spark.sparkContext.defaultParallelism
    for name in ("line_alignment", "pair_features"):
        found = __spark_entry__.queries()[name](spark, str(tmp_path))
        assert found.rdd.getNumPartitions() >= cores
        assert found.select("conv_id", "turn").distinct().count() == 40 * 3


def test_best_token_likeness_without_a_row_for_each_pair(spark):
    """The arrays' likeness is the largest of all pairs of tokens of half to twice the length."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(3, 9)))
    rows = [(k, sorted({word() for _ in range(rng.randrange(9))}), sorted({word() for _ in range(rng.randrange(9))})) for k in range(60)] + [(60, ["merlot", "brut"], ["merlo", "bruto"]), (61, ["abc"], [])]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>")
    got = {r["id"]: r["s"] for r in df.select("id", similarity.token_similarities(F.col("a"), F.col("b")).alias("s")).collect()}
    each = df.select("id", F.posexplode("a").alias("pos", "x"), "b").select("id", "pos", "x", F.explode("b").alias("y")).filter("2 * least(length(x), length(y)) >= greatest(length(x), length(y))")
    want = {(r["id"], r["pos"]): r["s"] for r in each.groupBy("id", "pos").agg(F.max(F.when(F.col("x") == F.col("y"), 1.0).otherwise(similarity.token_similarity(F.col("x"), F.col("y")))).alias("s")).collect()}
    assert all(got[k] == [want.get((k, i), 0.0) for i in range(len(a))] for k, a, _ in rows)
    idf = spark.createDataFrame([("merlot", 1, 2.0)], "token string, df long, idf double")
    plan = pairs.soft_tfidf(spark.createDataFrame([(1, 1, "merlot brut", "merlo bruto")], "query_id long, id long, q string, r string"), "q", "r", idf, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode_outer" not in plan.lower() and plan.lower().count("generate explode") <= 2


def test_words_are_compared_where_they_can_be_the_best(monkeypatch):
    """Words without enough common letters aren't compared, and those of both directions once."""
    calls = []
    ratio = similarity._ratio
    monkeypatch.setattr(similarity, "_ratio", lambda a, b: (calls.append((a, b)), ratio(a, b))[1])
    similarity._word_ratio.cache_clear()
    a, b = ["merlot", "xyz", "chianti"], ["merlo", "qqqq", "canti", "zx"]
    assert similarity._coverage(a, b) == (sum(max(ratio(w, x) for x in b) for w in a) / 3, max(ratio(w, x) for w in a for x in b), 2 / 3)
    first = len(calls)
    assert first < 8
    similarity._coverage(a, b)
    assert len(calls) == first
    similarity._word_ratio.cache_clear()
