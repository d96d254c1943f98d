"""Analogs from texts and found items: criteria, learned aliases, the catalogue's canonical forms, ranking by kinds, the nearest where nothing fits."""

import json
import random

import pytest

from linkfold.operators import analogs, lexicon

_ITEM = "id long, name string, producer string, category string, color string, type string, grapes string, label string, region string, label_json string"


def label(**parts):
    return json.dumps(parts, ensure_ascii=False)


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (1, "Красное полусухое", "Усадьба Дивная Дивная", None, None, None, "Мерло", None, "Кубань", label(cupage="Merlot", producer="Divnaya")),
        (2, "Вино", "Усадьба Дивная", "белое", "red", "brut", "Мерло; Каберне Совиньон", "сладкое", "Кубань", label(cupage=["Merlot"], producer="Divnaya")),
        (3, "Вино rouge", "Новый Берег", None, None, None, "Мерло", "semi-sweet wine", "Крым", label(cupage="Merlot", producer="Крым")),
        (4, None, None, None, None, None, None, None, None, None),
        (5, "Рислинг extra dry", "Новый Берег", None, "розовое", None, "null", None, "Крым", label(coupage="Рислинг Рейнский + Мускат", producer="Берег red")),
    ]
    return spark.createDataFrame(rows, _ITEM)


def test_aliases_are_learned_from_labels(items):
    canon = {r["form"]: r["canon"] for r in analogs.analog_lexicon(items).filter("lexicon = 'producer'").collect()}
    assert set(canon.values()) == {"усадьба дивная", "новый берег"}
    assert len(canon) == 3 and sorted(canon) != sorted(canon.values())  # of the labels only "Divnaya" is a new name: one is a region, one holds a colour
    assert {r["canon"] for r in analogs.grape_aliases(items).collect()} == {"мерло"}


def test_majority_aliases(spark):
    votes = [("a", "x")] * 3 + [("a", "y")] * 2 + [("b", "x"), ("b", "y")] + [("c", "z")] + [("d", "y")] * 2
    votes = spark.createDataFrame(votes, "alias string, canon string")
    got = lambda least, share: sorted(tuple(r) for r in analogs.majority_aliases(votes, least, share).collect())
    assert got(2, 0.6) == [("a", "x"), ("d", "y")]
    assert got(1, 0.5) == [("a", "x"), ("b", "x"), ("c", "z"), ("d", "y")]


def test_catalogue_canons(items):
    got = {r["id"]: (r["producer"], r["grapes"], r["n_grapes"], r["category"], r["type"]) for r in analogs.catalog_canons(items, analogs.grape_aliases(items)).collect()}
    assert got == {
        1: ("усадьба дивная", ["мерло"], 1, "red", "semi_dry"),
        2: ("усадьба дивная", ["каберне совиньон", "мерло"], 2, "white", "brut"),
        3: ("новый берег", ["мерло"], 1, "red", "semi_sweet"),
        4: (None, [], 0, None, None),
        5: ("новый берег", ["мускат", "рислинг рейнский"], 2, "rose", "extra_dry"),
    }
    assert analogs.catalog_canons(items.limit(0)).count() == 0


def test_criteria_of_texts(spark, items):
    texts = [
        (1, "Усадьба Дивная\nК а б е р н е Совиньон\nкрасное, white, semi-dry"),
        (2, "divnaya Merlot Новый Берег brut сухое"),
        (3, None),
        (4, ""),
        (5, "мускат рислинг"),
    ]
    more = lexicon.lexicon_table(spark, "grape", (("совиньон", ("совиньон",)), ("рислинг", ("рислинг",)), ("rose", ("rose",))))
    table = analogs.analog_lexicon(items).unionByName(more)
    found = analogs.text_criteria(spark.createDataFrame(texts, "query_id long, text string"), table, analogs.grape_aliases(items))
    got = {r["query_id"]: (sorted(r["producers"]), sorted(r["grapes"]), r["categories"], r["type"]) for r in found.collect()}
    assert got == {
        1: (["усадьба дивная"], ["каберне совиньон"], ["red", "white"], "semi_dry"),
        2: (["новый берег", "усадьба дивная"], ["мерло"], [], "brut"),
        3: ([], [], [], None),
        4: ([], [], [], None),
        5: ([], ["мускат", "рислинг"], [], None),
    }


def test_producers_are_taken_longest_first(spark):
    forms = (("a", ("alpha bravo charlie", "delta")), ("b", ("bravo charlie", "echo")), ("c", ("charlie",)), ("d", ("foxtrot",)), ("e", ("golf",)))
    texts = spark.createDataFrame([(1, "alpha bravo charlie"), (2, "alpha bravo charlie echo"), (3, "delta echo foxtrot golf charlie")], "query_id long, text string")
    got = {r["query_id"]: r["producers"] for r in analogs.text_criteria(texts, lexicon.lexicon_table(spark, "producer", forms)).collect()}
    assert got == {1: ["a"], 2: ["a", "b"], 3: ["c", "d", "a"]}


def test_kinds_and_cosines_rank_as_all_items_do(spark):
    """Few kinds with many items, ties broken by cosines, and excluded items among the first of their kind."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["p1", "p2", None]), rng.choice([["мерло"], []]), rng.choice(["red", "white", None]), rng.choice(["dry", None])) for i in range(300)]
    asks = [(q, q, ["p1"], ["мерло"], ["red"], "dry") for q in range(6)]
    hits = [(q, i, rng.choice([0.2, 0.5, 0.9])) for q in range(6) for i in rng.sample(range(300), 40)]
    catalog = spark.createDataFrame(rows, "id long, producer string, grapes array<string>, category string, type string")
    criteria = spark.createDataFrame(asks, "query_id long, exclude_id long, producers array<string>, grapes array<string>, categories array<string>, type string")
    cosine = spark.createDataFrame(hits, "query_id long, id long, cosine double")
    near = {(q, i): c for q, i, c in hits}

    def want(q):
        scored = []
        for i, p, g, c, t in rows:
            raw = 0.35 * (p == "p1") + 0.3 * bool(g) + 0.2 * (c == "red") + 0.15 * (1 if t == "dry" else 0.5)
            n = (p == "p1") + bool(g) + (c == "red") + (t == "dry")
            rank = lambda x, order: order.index(x) if x else analogs.RANK_MISSING
            if i != q:
                scored.append((-round(raw * (0.75 if c == "white" else 1), 9), rank(c, analogs.CATEGORY_ORDER), rank(t, analogs.TYPE_ORDER), -near.get((q, i), -1.0), -n, i))
        return [x[-1] for x in sorted(scored)[:10]]

    got = {}
    for r in analogs.rank_analogs(criteria, catalog, 10, cosine).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {q: want(q) for q in range(6)}


def test_dispatch(spark, items):
    """By the winner's fields, by the text, by the nearest; rejected ids stay analogs by criteria, but are no nearest ones."""
    catalog = analogs.catalog_canons(items)
    queries = spark.createDataFrame([(1, "x", 1), (2, "мерло", None), (3, "nothing", None), (4, "мерло", 99)], "query_id long, text string, winner_id long")
    hits = spark.createDataFrame([(3, 1, 0.95), (3, 2, 0.9), (3, 77, 0.99), (3, 3, 0.7), (3, 5, 0.71), (2, 3, 0.8), (4, 1, 0.9)], "query_id long, id long, cosine double")
    rejected = spark.createDataFrame([(3, 1), (2, 3)], "query_id long, id long")
    found = analogs.dispatched(queries, analogs.analog_lexicon(items), catalog, hits, rejected, analogs.grape_aliases(items))
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault((r["query_id"], r["source"]), []).append(r["id"])
    assert got[(3, "embedding_cosine")] == [2, 5]
    assert set(got) == {(1, "matched_item"), (2, "criteria"), (3, "embedding_cosine")}
    assert got[(2, "criteria")] == [1, 3, 2] and 1 not in got[(1, "matched_item")]
    again = analogs.rescored(queries.select("query_id", "text"), analogs.analog_lexicon(items), catalog, hits, rejected)
    assert {r["query_id"] for r in again.filter("source = 'criteria'").collect()} == {2, 4}
