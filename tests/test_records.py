"""Records, times, lexicons of a catalogue, settings as they are shown, and winners taken over from earlier queries."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from linkfold.functions import classes, records, text
from linkfold.operators import decide, lexicon
from linkfold.settings import public_view


def test_json_records(spark):
    rows = [(1, float("nan"), b"x", dt.date(2024, 1, 2), {"a": 1.0, "_b": 2.0}, (1, "p", b"y"), [float("inf"), 2.0], "h"), (None,) * 8]
    df = spark.createDataFrame(rows, "id int, v double, raw binary, day date, m map<string,double>, s struct<x:int,_y:string,z:binary>, l array<double>, _hidden string")
    one, other = (json.loads(r["json"]) for r in records.json_records(df).collect())
    assert one == {"id": 1, "v": None, "raw": None, "day": "2024-01-02", "m": {"a": 1.0}, "s": {"x": 1, "z": None}, "l": [None, 2.0]}
    assert set(other) == set(one) and not any(v for v in other.values())
    assert records.json_records(df.limit(0)).count() == 0


def test_timings(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [("r", "a", at(1), 250.04, False), ("r", "b", at(2), 0.0, False), ("r", "c", at(3), 90.0, True), ("r", "a", at(4), 10.0, None), ("r", "d", at(5), None, False), (None, "a", at(0), 1.0, False), ("q", "x", None, 1.0, False)]
    got = {(r["run"], r["step"]): (r["start_ms"], r["ms"]) for r in records.timing_records(spark.createDataFrame(rows, "run string, step string, started timestamp, ms double, skipped boolean")).collect()}
    assert got == {("r", "a"): (3000.0, 10.0), ("r", "total"): (0.0, 4000.0)}


def test_grapes_of_lists_and_labels(spark):
    cases = {
        "мерло, каберне и сира; / пино": ["мерло", "каберне", "сира", "пино"], "Каберне-Совиньон • Мерло.": ["Каберне-Совиньон", "Мерло"], "a | b·c": ["a", "b", "c"], "a - b – c — d + e": ["a", "b", "c", "d", "e"],
        " N/A ": [], "—": [], "none": [], "": [], None: [], " .a.\t": ["a"],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", classes.split_grapes(F.col("t")).alias("g")).collect()
    assert {r["t"]: r["g"] for r in rows} == cases
    labels = {'{"cupage": "a, b"}': ["a", "b"], '{"cupage": ["a, b", "c"], "coupage": "d"}': ["a", "b", "c"], '{"cupage": "", "coupage": "d"}': ["d"], '{"cupage": null, "coupage": ["e"]}': ["e"], "{}": [], "bad": [], None: []}
    rows = spark.createDataFrame([(k,) for k in labels], "t string").select("t", classes.cupage(F.col("t")).alias("g")).collect()
    assert {r["t"]: r["g"] for r in rows} == labels


def test_lexicons_of_a_catalogue(spark):
    items = [(1, "Винодельня Бюрнье Бюрнье", '{"producer": "Бюрнье winery"}'), (2, "БЮРНЬЕ", None), (3, "Chateau Дом", '{"producer": ""}'), (4, "Дом Захарьиных", None), (5, None, "bad"), (6, "Дом", None), (7, "winery 78", None)]
    table = spark.createDataFrame(items, "id int, producer string, label_json string")
    got = {r["canon"]: (r["surface"], r["items"]) for r in lexicon.producer_lexicon(table, ("винодельня", "winery", "chateau", "дом")).collect()}
    assert {k: n for k, (_, n) in got.items()} == {"бюрнье": 2, "захарьиных": 1}
    kept = {r["canon"] for r in lexicon.producer_lexicon(table, ("винодельня", "winery", "chateau", "дом"), ("дом",)).collect()}
    assert "дом захарьиных" in kept
    names = spark.createDataFrame([("Шато  Winery x",), ("winery",), (None,)], "n string").select(text.without_stopwords(F.col("n"), ("WINERY", "шато"), ("шато",))).collect()
    assert [r[0] for r in names] == ["Шато x", "", ""]
    grapes = spark.createDataFrame([(1, "Merlot, merlot", '{"cupage": "MERLOT"}'), (2, "Pinot  Noir; ab", None), (3, None, None)], "id int, grapes string, label_json string")
    assert {(r["surface"], r["items"]) for r in lexicon.grape_lexicon(grapes).collect()} == {("MERLOT", 1), ("Pinot  Noir", 1)}


def test_settings_as_shown():
    view = public_view({"match_threshold": 5, "top_n": 20, "gemini_api_key": "abcdefghijkl", "short_token": "abc", "no_secret": None, "other": 1})
    assert view["match_threshold"] == {"value": 1.0, "default": 0.11, "changed": True} and view["top_n"]["value"] == 20 and not view["weight_text"]["changed"]
    assert view["gemini_api_key"] == {"set": True, "value": "***ijkl"} and view["short_token"]["value"] == "***" and not view["no_secret"]["set"] and "other" not in view


def test_reuse_compare(spark):
    rows = [(1, 50, 7, 0.9, "красное сухое 2019", "красное сухое 2019", 0), (1, 50, 8, 0.9, "красное сухое 2019", "другое", 1), (1, 51, 9, None, "красное сухое 2019", "белое сладкое", 2), (1, 52, 9, 0.9, "красное", " ", 3), (2, 50, 7, 0.9, None, "x", 0), (1, None, 7, 0.9, "a", "a", 4)]
    hits = spark.createDataFrame(rows, "query_id int, previous_id int, id int, cosine double, text string, previous_text string, pos int")
    got = decide.reuse_compare(hits, ["lev_similarity"], F.col("lev_similarity"), 2026, 0.5, 0.3).orderBy("pos").collect()
    assert [(r["previous_id"], r["id"], r["pos"]) for r in got] == [(50, 7, 1), (51, 9, 2)]
    assert got[0]["score"] == 1 and got[0]["fin"] == pytest.approx((0.65 + 0.45 * 0.9) / 1.1, abs=1e-6) and got[0]["band"] == "match" and {r["compare_source"] for r in got} == {"previous_search_ocr"}
    assert decide.reuse_compare(hits.limit(0), ["lev_similarity"], F.col("lev_similarity"), 2026, 0.5, 0.3).count() == 0
