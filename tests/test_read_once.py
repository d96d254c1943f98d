"""Equal texts are read and compared once, and what several steps read is written."""

from linkfold.operators import analogs, channels
from linkfold.plans import scan_queries


def test_equal_names_are_searched_once(spark, monkeypatch):
    seen, torn_hits = [], analogs.torn_hits

    def counted(texts, lexicon):
        seen.append(texts.count())
        return torn_hits(texts, lexicon)

    monkeypatch.setattr(analogs, "torn_hits", counted)
    rows = [(k, "Wine красное сухое", "Estate", None, None, None, "merlot", None) for k in range(6)] + [(9, None, None, None, None, None, None, None)]
    got = analogs.catalog_canons(spark.createDataFrame(rows, "id long, name string, producer string, category string, color string, type string, grapes string, label string")).collect()
    assert seen == [2]  # once for the colour and once for the type
    assert {(r["id"], r["category"], r["type"]) for r in got} == {(k, "red", "dry") for k in range(6)} | {(9, None, None)}


def test_equal_pairs_of_labels_have_their_features_computed_once(spark, monkeypatch):
    seen, features = [], scan_queries.pair_features

    def counted(pairs, *args):
        seen.append(pairs.count())
        return features(pairs, *args)

    monkeypatch.setattr(scan_queries, "pair_features", counted)
    parts = spark.createDataFrame([(0, "hot bolt", 7), (210, "hot bolt", 7), (420, "hot bolt", 7)], "p_partkey long, p_name string, p_size int")
    got = scan_queries._labelled_pairs(lambda name: parts).collect()
    assert seen == [2] and sorted((r["id"], r["y"]) for r in got) == [(k, y) for k in (0, 210, 420) for y in (0, 1)]
    assert {r["lev_similarity"] for r in got if r["y"] == 0} == {1.0}


def test_scores_of_channels_are_computed_once(spark):
    texts = spark.createDataFrame([(1, "a", 0, True, "Estate Bolt\nhot bolt red"), (1, "b", 1, False, "hot bolt")], "query_id long, channel string, pos int, soft boolean, text string")
    near = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.5)], "query_id long, id long, cosine double")
    items = spark.createDataFrame([(10, "hot bolt", "Bolt Estate", "X", None, None, "hot bolt red"), (11, "old ring", "Ring Estate", "X", None, None, "old ring white")], "id long, name string, producer string, region string, category string, grapes string, label string")
    scored = channels.scored_channels(texts, near, items)
    assert scored._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1  # decisions read it several times
    assert scored.count() == 6
