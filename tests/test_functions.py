"""Small cases with values worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from linkfold.functions import boxes, color, scores, similarity, text
from linkfold.operators import decide, history, lexicon, linking
from linkfold.settings import Settings


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(("raw", "want"), [
    ("CYXOE", "сухое"), ("KASEPHE", "каберне"), ("CABERNET", "cabernet"), ("BURNIER", "burnier"), ("MEPRO", "мерло"), ("КРА5НОЕ", "краcное".replace("c", "с")),
    ("2024", "2024"), ("0.75 л", "0.75 л"), ("12,5%", "12,5%"), ("44N", "44n"), ("  Ёлка\tи   Ель\nдом", "елка и ель дом"), (None, ""), ("", ""),
])
def test_canonical(spark, raw, want):
    assert values(spark, [(raw,)], "t string", text.canonical(F.col("t"))) == [want]


def test_entity_form(spark):
    assert values(spark, [("Семейный 12%vol Château, 20l1",)], "t string", text.entity_form(F.col("t"))) == ["семеиныи vol chateau 2011"]


def test_score_band(spark):
    got = values(spark, [(0.11,), (0.1100001,), (0.08,), (0.0799,), (None,)], "s double", scores.score_band(F.col("s"), 0.11, 0.08))
    assert got == ["similar", "match", "similar", "none", "none"]


def test_fin_blend(spark):
    assert values(spark, [(0.5, 0.9), (0.12, 1.0), (0.5, None)], "t double, c double", scores.fin_blend(F.col("t"), F.col("c"))) == [0.663636, 0.48, 0.295455]


def test_bypass_bounds(spark):
    rows = [(0.90, 0.70, True), (0.8999, 0.70, True), (0.95, 0.69, True), (0.95, 0.9, False)]
    assert values(spark, rows, "c double, s double, r boolean", scores.hard_rejects(F.col("c"), F.col("s"), F.col("r"))) == [False, True, True, False]


def test_near_equal(spark):
    rows = [("каберне", "каберие"), ("сира", "сиро"), ("рот", "рит"), ("мускат", "мускатель"), ("рот", "рот")]
    assert values(spark, rows, "a string, b string", similarity.near_equal(F.col("a"), F.col("b"))) == [True, True, False, False, True]


def test_strings(spark):
    rows = [("martha", "marhta"), ("", "x"), (None, None)]
    assert [round(x, 4) for x in values(spark, rows, "a string, b string", similarity.jaro_winkler(F.col("a"), F.col("b")))] == [0.9611, 0.0, 1.0]
    got = values(spark, [("abcd", "xxabcdyy"), ("red wine", "wine red")], "a string, b string", similarity.string_similarities(F.col("a"), F.col("b")))
    assert got[0]["partial"] == 1.0 and got[1]["token_sort"] == 1.0 and got[1]["token_set"] == 1.0


def test_ciede2000(spark):
    # published pairs: (50, 2.6772, -79.7751) and (50, 0, -82.7485) differ by 2.0425; (50, 2.5, 0) and (73, 25, -18) by 27.1492
    rows = [(50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485), (50.0, 2.5, 0.0, 73.0, 25.0, -18.0), (50.0, 0.0, 0.0, 50.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double")
    assert [round(r["delta"], 4) for r in color.with_ciede2000(df).collect()] == [2.0425, 27.1492, 0.0]


def test_classification(spark):
    rows = [(1, 2, 0, 0), (None, 2, 1, 0), (1, 1, 1, 0), (None, None, 0, 1), (1, None, 0, 0), (None, None, 0, 0)]
    got = values(spark, rows, "m int, h int, fp int, fn int", history.classified(F.col("m"), F.col("h"), F.col("fp"), F.col("fn")))
    assert [tuple(x) for x in got] == [
        ("FP", "manual_differs_from_matched"), ("FN", "manual_without_matched"), ("FP", "checkbox_fp"), ("FN", "checkbox_fn"), ("TP", "matched_ok"), ("TN", "no_match_ok"),
    ]


def test_null_order_and_seek(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id int, v int")
    assert [r["v"] for r in df.orderBy(*history.ordered("v", True, "id")).collect()] == [None, 2, 1]
    assert [r["v"] for r in df.orderBy(*history.ordered("v", False, "id")).collect()] == [1, 2, None]
    assert history.seek_offset(df, "v", False, "id", 1, before=1).first()["offset"] == 1
    assert history.seek_offset(df, "v", False, "id", 99).count() == 0


def test_typed_number(spark):
    rows = [('{"a": 0.9}',), ('{"a": "0.9"}',), ("{}",), ("bad",), (None,)]
    assert values(spark, rows, "j string", history.typed_number(F.col("j"), "$.a")) == [0.9, None, None, None, None]


def test_histogram_edges(spark):
    rows = history.score_histogram(spark.createDataFrame([(-0.1,), (0.0,), (0.95,), (1.0,)], "s double"), "s").collect()
    assert len(rows) == 11 and {r["range"]: r["n"] for r in rows if r["n"]} == {"0.0–0.1": 1, "0.9–1.0": 1, "1.0": 1}
    assert {r["pct"] for r in rows} == {0.0, 25.0}


def test_nearest_rank_median(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", 1.0), ("b", 2.0)], "g string, v double")
    got = {r["g"]: (r["nearest"], r["interpolated"]) for r in history.medians(df, "g", "v").collect()}
    assert got == {"a": (3.0, 2.5), "b": (1.0, 1.5)}


def test_quantiles_of_large_groups(spark, monkeypatch):
    """Between sketched values, against sorted ones: an outlier, one value in half the rows, many parts, odd counts, NaN and nulls."""
    monkeypatch.setattr(history, "ACCURACY", 100)
    monkeypatch.setattr(history, "WHOLE", 1_000)
    rng = random.Random(4)
    spread = {"outlier": [1e12, *(rng.random() for _ in range(4_000))], "tied": [7.0] * 2_500 + [rng.expovariate(1) for _ in range(2_502)], "powers": [2.0 ** rng.uniform(-900, 900) for _ in range(3_001)], "small": [3.0, float("inf"), -1.0]}
    rows = [(g, v) for g, vs in spread.items() for v in vs] + [("small", None), ("small", float("nan")), (None, 1.0), ("empty", None)]
    rng.shuffle(rows)
    got = {r["g"]: r for r in history.medians(spark.createDataFrame(rows, "g string, v double").repartition(7), "g", "v").collect()}
    assert set(got) == set(spread)
    for g, vs in spread.items():
        vs, r = sorted(vs), got[g]
        assert (r["n"], r["nearest"]) == (len(vs), vs[round((len(vs) - 1) / 2)])
        for name, p in (("interpolated", 0.5), ("p25", 0.25), ("p75", 0.75)):
            at = (len(vs) - 1) * p
            want = vs[math.floor(at)] + (at - math.floor(at)) * (vs[math.ceil(at)] - vs[math.floor(at)])
            assert r[name] == pytest.approx(want, rel=1e-9, abs=1e-6) or math.isinf(want) and not math.isfinite(r[name])


def test_hard_reject_reasons(spark):
    rows = [(["a"], []), ([], ["a"]), (["a"], ["b"]), (["a"], ["a", "b"]), ([], [])]
    got = values(spark, rows, "a array<string>, b array<string>", decide.hard_reject_reason(F.col("a"), F.col("b")))
    assert got == ["query_text_catalog_empty", "query_empty_catalog_text", "no_shared_words", None, None]


def test_winner_ties_go_to_the_first(spark):
    rows = [(1, 10, 1, 0.5, 0.9, False, None), (1, 11, 2, 0.5, 0.9, False, None), (1, 12, 3, 0.9, 0.9, True, None), (1, 13, 4, 0.09, 0.5, False, None), (2, 10, 1, 0.01, 0.2, False, None)]
    df = spark.createDataFrame(rows, "query_id int, id int, pos int, score double, cosine double, lexicon_reject boolean, text_reason string")
    got = {r["query_id"]: r for r in decide.resolve(decide.final_scores(df, Settings())).collect()}
    # the rejected candidate clears the bypass: cosine 0.9 and score 0.9
    assert got[1]["winner_id"] == 12 and got[1]["match_ids"] == [10, 11, 12] and got[1]["similar_ids"] == [13]
    assert got[2]["winner_id"] is None and got[2]["match_ids"] == []


def test_majority_ties(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 3), ("b", None, 4)], "alias string, target string, pos int")
    got = {r["alias"]: (r["target"], r["n"], r["share"]) for r in decide.majority(df, "alias", "target", 1, 0.5, "pos").collect()}
    assert got == {"a": ("x", 1, 0.5), "b": ("z", 1, 1.0)}


def test_lexicon(spark):
    texts = spark.createDataFrame([(1, "Портвейн красное, red port wine"), (2, "semidry"), (3, None)], "id int, text string")
    table = lexicon.lexicon_table(spark, "type", lexicon.TYPE).unionByName(lexicon.lexicon_table(spark, "category", lexicon.CATEGORY))
    hits = lexicon.lexicon_hits(texts, table)
    assert {(r["id"], r["lexicon"], r["canon"], r["form"]) for r in lexicon.first_hits(hits).collect()} == {(1, "type", "portwine", "port wine"), (1, "category", "red", "красное"), (2, "type", "semi_dry", "semidry")}
    asked = spark.createDataFrame([(9, "category", "red")], "query_id int, lexicon string, canon string")
    rejected = lexicon.exclusive_rejects(asked, hits, spark.createDataFrame([(9, 1), (9, 2)], "query_id int, id int"))
    assert [tuple(r) for r in rejected.collect()] == [(9, 2, "category")]


def test_links(spark):
    names = spark.createDataFrame([("Château Margaux",), ("Margaux estate winery",), ("nothing",), (None,)], "name string")
    known = spark.createDataFrame([(1, "chateau margaux"), (2, "estate winery")], "id int, known_name string")
    assert {r["name"]: (r["id"], r["how"]) for r in linking.link_names(names, known).collect()} == {
        "Château Margaux": (1, "exact"), "Margaux estate winery": (2, "contained"), "nothing": (None, "none"),
    }


def test_boxes(spark):
    df = spark.createDataFrame([((0.0, 0.0, 2.0, 2.0), (1.0, 0.0, 5.0, 2.0))], "a struct<x1:double,y1:double,x2:double,y2:double>, b struct<x1:double,y1:double,x2:double,y2:double>")
    assert df.select(boxes.share_inside(F.col("a"), F.col("b"))).first()[0] == 0.5


def test_settings():
    s = Settings.parse({"top_n": 15, "match_threshold": "0.2", "similar_threshold": 0.9, "reuse_previous": "no", "weight_text": float("nan"), "other": 1})
    assert (s.top_n, s.match_threshold, s.similar_threshold, s.reuse_previous, s.weight_text) == (40, 0.2, 0.2, False, 0.65)


def test_collapse_and_spaced(spark):
    assert values(spark, [("Б Ю Р вино",)], "t string", text.collapse_spaced(F.col("t"))) == ["БЮР вино"]
    assert values(spark, [("a b c word",), ("one two three four",)], "t string", text.looks_spaced(F.col("t"))) == [True, False]
