"""Labels, documents and decisions on small fixtures, against plain Python or values worked out by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from linkfold.functions import answers, boxes, classes, similarity, text
from linkfold.operators import analogs, decide, documents, entities, lexicon, linking, pairs, report


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain_partial(a, b):
    a, b = sorted((a, b), key=len)
    runs = [b[max(0, i) : i + len(a)] for i in range(1 - len(a), len(b))]
    return max(2 * plain_common(a, r) / (len(a) + len(r)) for r in runs)


@pytest.mark.parametrize("size", [5, 20, 63, 64, 65, 66, 90])
def test_partial_ratio_is_exact(size):
    rng = random.Random(size)
    for letters in ("ab", "abcdefgh"):
        a = "".join(rng.choice(letters) for _ in range(size))
        b = "".join(rng.choice(letters) for _ in range(size + rng.randrange(40)))
        assert similarity._partial(a, b) == pytest.approx(plain_partial(a, b))
        assert similarity._partial(b, a) == pytest.approx(plain_partial(a, b))


def test_partial_ratio_edges():
    assert similarity._partial("abc" * 22, "acb" * 30) == pytest.approx(plain_partial("abc" * 22, "acb" * 30)) and similarity._partial("abc" * 22, "acb" * 30) > 0.6
    assert (similarity._partial("", ""), similarity._partial("", "x"), similarity._partial("bc", "abcd")) == (1.0, 0.0, 1.0)
    assert similarity._weighted("", "x") == 0 and similarity._weighted("red wine", "wine red") == pytest.approx(0.95)
    assert similarity._ngram_dice("aaaa", "aaa") == pytest.approx(2 / 3) and similarity._ngram_dice("ab", "abc") == 0


def test_token_similarity_thresholds(spark):
    # of seven letters 0.85 is asked for, of eight 0.80
    rows = [("abcdefg", "abcdefg"), ("martha", "marhta"), ("abcdefg", "abcxyzg"), ("сира", "сиро")]
    got = values(spark, rows, "a string, b string", similarity.token_similarity(F.col("a"), F.col("b")))
    assert got[0] == 1 and round(got[1], 4) == 0.9611 and got[2] == 0 and got[3] == 0


def test_forms(spark):
    raw = "Б Ю Р вино 20l9 г.\nСодержит сульфиты 12,5%vol 750 ml CABERNET"
    assert values(spark, [(raw,), (None,)], "t string", text.soft_form(F.col("t"))) == ["бюр вино 2019 г содержит vol cabernet", ""]
    assert values(spark, [("бюр вино 2019 г содержит cabernet",)], "t string", text.soft_terms(F.col("t"))) == [["byup", "2019", "codepzhit", "cabernet"]]
    assert values(spark, [("ﬁne Ⅳ",)], "t string", text.pair_form(F.col("t"))) == ["fine iv"]
    assert values(spark, [("shcherbakov xyz",), ("Чёрный",)], "t string", text.latin_to_cyrillic(F.col("t"))) == ["щербаков ксйз", "чёрный"]
    assert values(spark, [("Anna anna  Maria ANNA",)], "t string", text.distinct_words(F.col("t"))) == ["Anna Maria"]
    assert values(spark, [("a\n\nB", "b \nc")], "s string, t string", text.distinct_lines(F.col("s"), F.col("t"))) == ["a\nB\nc"]
    assert values(spark, [("дом вина",), ("дом",)], "t string", text.stop_key(F.col("t"), ("дом",))) == ["вина", "дом"]
    assert values(spark, [("винодельня 78",), ("винодельня года",), ("бюрнье",), (None,)], "t string", text.is_bad_producer(text.entity_form(F.col("t")))) == [True, True, False, True]


def test_form_matches(spark):
    rows = [("красное", "вино кра с но е 2020"), ("dry", "голодриги"), ("dry", "very DRY wine"), ("abrau dyurso", "абрау-дюрсо"), ("a.b", "axb")]
    assert values(spark, rows, "f string, t string", text.form_matches(F.col("f"), F.col("t"))) == [True, False, True, True, False]
    assert values(spark, rows[:1], "f string, t string", text.form_matches(F.col("f"), F.col("t"), spaced=False)) == [False]
    assert values(spark, [("Абрау-Дюрсо",), ("",)], "f string", text.first_word(F.col("f"))) == ["Абрау", ""]


def test_classes(spark):
    t = "Мерло красное полусухое 2019, 2019 и 1998; 13,5 % 0,75 л 750 ml"
    row = spark.createDataFrame([(t,)], "t string").select(
        classes.color_key(F.col("t")), classes.type_key(F.col("t")), classes.vintage(F.col("t")), classes.alcohol_set(F.col("t")), classes.volume_set(F.col("t")),
        classes.vintage_years(F.col("t"), F.lit(1998), 2026), classes.grape_keys(F.lower("t")), classes.number_set(F.col("t")),
    ).first()
    assert tuple(row) == ("red", "semi_dry", "2019", [13.5], [0.75], [2019], ["мерло"], [13.5, 0.75, 750.0])
    rows = [("black", ["red"]), ("red", ["black"]), ("white", ["red"]), ("white", ["white"])]
    assert values(spark, rows, "a string, b array<string>", classes.colors_compatible(F.col("a"), F.col("b"))) == [True, True, False, True]
    rows = [("рислинг", "рислинг рейнский"), ("пино", "пино нуар"), ("мерло", "мерло")]
    assert values(spark, rows, "a string, b string", classes.grapes_match(F.col("a"), F.col("b"))) == [True, False, True]
    assert values(spark, [("мерло, каберне и сира; / пино",), (None,)], "t string", classes.split_grapes(F.col("t"))) == [["мерло", "каберне", "сира", "пино"], []]


def test_pair_features(spark):
    rows = [("Красное вино 2020 13,5 % 0,75 л MERLO", "MERLO красное сухое 2020 13.5 % 750 ml", 0.9), ("", None, None), (None, "белое", 0.1)]
    df = spark.createDataFrame(rows, "q string, r string, cosine double")
    got = pairs.pair_features(df, "q", "r", 2026, "cosine").drop("q", "r", "cosine")
    assert len(got.columns) == 63
    one, empty, other = got.collect()
    assert (one["siglip_cosine"], one["year_exact_match"], one["year_mismatch"], one["alc_match"], one["vol_match"], one["color_match"], one["sweet_ocr_detected"], one["sparkling_mismatch"]) == (0.9, 1, 0, 1, 1, 1, 0, 0)
    assert one["year_match_recency"] == pytest.approx(1 / 7, abs=1e-6) and one["ref_has_label"] == 1 and 0 < one["fuzz_ratio"] < 1 and one["ocr_lines"] == 1
    assert (empty["ocr_chars"], empty["ref_chars"], empty["ref_has_label"], empty["token_jaccard"], empty["lev_similarity"]) == (0, 0, 0, 0, 1)
    assert other["color_ref_known"] == 1 and other["color_match"] == 0 and other["siglip_cosine"] == 0.1


def test_entities_and_text_score(spark):
    texts = spark.createDataFrame([(1, "Вина Бюрнье\nКрасностоп красное сухое 2019"), (2, "винодельня 78"), (3, None)], "id long, text string")
    items = spark.createDataFrame([
        (10, "Красностоп", "Бюрнье", "Кубань", "красное", "красностоп", "Бюрнье Красностоп красное сухое 2018"), (11, "Шардоне", "Фанагория", "Кубань", "белое", "шардоне", "Фанагория шардоне белое"), (12, None, None, None, None, None, None),
    ], "id long, name string, producer string, region string, category string, grapes string, label string")
    read = entities.entities(texts, items.select("producer"))
    got = {r["id"]: r for r in read.collect()}
    assert (got[1]["producer"], got[1]["vintage"], got[1]["color"], got[1]["type"], got[1]["grapes"]) == ("Бюрнье", "2019", "red", "dry", ["красностоп"])
    assert got[2]["producer"] is None and got[3]["form"] == ""
    pairs_of = spark.createDataFrame([(q, i) for q in (1, 2, 3) for i in (10, 11, 12)], "query_id long, id long")
    scored = {(r["query_id"], r["id"]): r for r in entities.text_scores(read, items, pairs_of).collect()}
    assert len(scored) == 9 and scored[1, 10]["score"] == 0.97 and scored[1, 10]["mismatches"] == [] and scored[1, 10]["f1"] > 0.9
    assert scored[1, 11]["score"] == 0 and {"color", "grape"} <= set(scored[1, 11]["mismatches"])
    merged = entities.merged_entities(read, spark.createDataFrame([(2, "Бюрнье", "Рислинг", "урожай 2020"), (1, "winery", None, None)], "id long, producer string, wine string, vintage string"))
    rows = {r["id"]: r for r in merged.collect()}
    assert (rows[2]["producer"], rows[2]["producer_score"], rows[2]["vintage"]) == ("Бюрнье", 95.0, "2020") and rows[1]["producer"] == "Бюрнье"
    voted = entities.voted_entities(read.withColumns({"scan": F.lit(1), "pos": F.col("id")}), ["scan"], "pos").first()
    assert (voted["producer"], voted["vintage"], voted["color"], voted["vintage_votes"]) == ("Бюрнье", "2019", "red", 1)


def test_token_hits_against_all_pairs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 9))) for _ in range(120)]
    got = {(r["token"], r["known"]) for r in entities.token_hits(spark.createDataFrame([(w,) for w in words[:60]], "token string"), spark.createDataFrame([(w,) for w in words[60:]], "token string")).collect()}
    alike = lambda a, b: 2 * plain_common(a, b) / (len(a) + len(b)) >= 0.78 and bool({a[i : i + 2] for i in range(len(a) - 1)} & {b[i : i + 2] for i in range(len(b) - 1)})
    assert got == {(a, b) for a in set(words[:60]) for b in set(words[60:]) if a in b or b in a or alike(a, b)}


def document(**more):
    return json.dumps(more)


def test_documents(spark):
    scored = {"7": {"xgb_fin": 0.5, "xgb_score": "0.4", "cosine": 0.9}, "8": {"xgb_fin": 0.5, "xgb_score": 0.6}, "x": {"xgb_fin": 1}}
    rows = [
        (1, document(matched_wine_id=7, matched_wine={"id": "7", "slug": " s ", "confidence": 0, "final_score": 0.3, "source": "xgb"}, eval={"false_positive": 1, "false_negative": 1}, steps={"xgb_match": {"by_id": scored}, "ocr": {"text": " "}, "ocr_yandex": {"text": "y"}}, timings_ms={"total": "12.5"}, label_filename="a/b.heic", crops_filename="c.JPG")),
        (2, document(matched_wine={"id": 9, "source": "guess"}, steps={"xgb_match": {"by_id": scored}, "ocr_wine_id": {"final_ranked2": [{"id": 8, "final_score2": 0.7}]}})),
        (3, document(matched_wine={"id": 9, "source": "XGB_dead_new"}, steps={"candidates": {"siglip2": {"items": [{"id": 4, "cosine_similarity": 0.2}, {"name": "none"}]}, "dinov3": {"items": [{"id": 4, "cosine_similarity": 0.8}, {"id": 5, "cosine_similarity": 0.3}]}}})),
        (4, "no json"), (5, None),
    ]
    d = documents.parsed(F.col("doc"))
    got = {r["id"]: r for r in spark.createDataFrame(rows, "id long, doc string").select("id", documents.history_fields(d).alias("f"), documents.shown_text(d).alias("text"), documents.query_file(d).alias("file"), documents.unmatched_top(d).alias("top"), documents.candidate_pool(d).alias("pool"), documents.chosen_text(d)["engine"].alias("engine"), documents.score_card(d, documents.matched_id(d), F.lit(0.3))["xgb"].alias("xgb")).collect()}
    assert tuple(got[1]["f"]) == (7, 0.3, "s", 12.5, 1, 0) and got[1]["text"] == "y" and got[1]["file"] == "c.JPG" and got[1]["engine"] == "yandex" and got[1]["xgb"] == 0.4
    assert got[2]["f"]["matched_id"] is None and got[3]["f"]["matched_id"] == 9 and got[4]["f"]["matched_id"] is None and got[5]["f"]["fp"] == 0
    assert [(x["id"], x["fin2"]) for x in got[2]["top"]] == [(8, 0.7), (7, -1.0)] and [(x["id"], x["cosine"]) for x in got[3]["top"]] == [(4, 0.8), (5, 0.3)]
    assert {x["id"] for x in got[1]["pool"]} == {7, 8}
    flagged = spark.createDataFrame([('{"a": 1, "eval": {"x": 2}}', 1, 1), (None, 0, 1)], "doc string, fp int, fn int").select(documents.with_flags(F.col("doc"), F.col("fp"), F.col("fn"))).collect()
    assert [json.loads(r[0]) for r in flagged] == [{"a": 1, "eval": {"false_positive": 1, "false_negative": 0}}, {"eval": {"false_positive": 0, "false_negative": 1}}]


def test_answers(spark):
    rows = [("```json\n{\"1\": 0.5}\n```",), ("so: {\"1\": 2, \"2\": \"x\", \"b\": 1, \"3\": -1} ok",), ("none",), ("[1]",), (None,)]
    got = values(spark, rows, "t string", answers.score_map(answers.salvaged_json(F.col("t"))))
    assert [[tuple(x) for x in g] if g is not None else None for g in got] == [[(1, 0.5)], [(1, 1.0), (3, 0.0)], None, None, None]
    assert values(spark, [("x",)], "t string", answers.rendered_prompt("a {{ocr_text}} b {{candidates_json}}", F.col("t"), F.lit("[]"))) == ["a x b []"]


def test_boxes(spark):
    box = lambda *x: dict(zip(("x1", "y1", "x2", "y2"), map(float, x)))
    schema = "image int, id int, box struct<x1:double,y1:double,x2:double,y2:double>, conf double"
    labels = spark.createDataFrame([(1, 1, box(10, 40, 50, 80), 0.9), (1, 2, box(10, 5, 50, 15), 0.9), (1, 3, box(100, 0, 140, 40), 0.4), (2, 1, box(10, 5, 50, 15), 0.9), (3, 1, box(0, 0, 10, 10), 0.5), (3, 2, box(0, 0, 10, 9.5), 0.5), (3, 3, box(0, 0, 10, 9), 0.5), (4, 1, box(0, 0, 10, 10), 0.3), (4, 2, box(0, 0, 10, 6), 0.5)], schema)
    bottles = spark.createDataFrame([(1, 1, box(0, 0, 60, 100), 0.9), (2, 1, box(0, 0, 60, 100), 0.9)], "image int, bottle_id int, bottle_box struct<x1:double,y1:double,x2:double,y2:double>, bottle_conf double")
    assert {(r["image"], r["id"]) for r in boxes.drop_orphans(labels, bottles, "image").collect()} == {(r["image"], r["id"]) for r in labels.collect()} - {(1, 3)}
    picked = {r["image"]: (r["id"], r["reason"]) for r in boxes.primary_label(labels, "image").collect()}
    assert picked[3] == (2, "middle_of_three_similar") and picked[4] == (2, "next_by_size_weak_largest")
    crops = {r["image"]: (r["box"].asDict(), r["reason"]) for r in boxes.crop_boxes(labels, bottles, "image").collect()}
    assert crops == {1: (box(10, 40, 50, 80), "largest_on_primary_bottle"), 2: (box(0, 18, 60, 100), "bottle_body_fallback")}
    merged = boxes.merged_by_bottle(labels.filter("image = 1"), bottles, "image").collect()
    assert sorted((r["n"], r["box"]["y1"], r["box"]["y2"]) for r in merged) == [(1, 0.0, 40.0), (2, 5.0, 80.0)]
    turned = spark.createDataFrame([(box(0, 0, 2, 1),)], "b struct<x1:double,y1:double,x2:double,y2:double>").select(boxes.transformed(F.col("b"), F.array(F.array(F.lit(0.0), F.lit(-1.0), F.lit(5.0)), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))))).first()[0]
    assert turned.asDict() == box(4, 0, 5, 2)
    rects = boxes.cut_rects(spark.createDataFrame([(1, box(10, 10, 50, 50))], "image int, box struct<x1:double,y1:double,x2:double,y2:double>"), labels.select("image", "box"), "image").first()["rects"]
    assert [tuple(x) for x in rects] == [(0.0, 0.0, 5.0, 40.0), (30.0, 0.0, 40.0, 40.0)]


def test_analogs_score_unknown_types(spark):
    """Against a loop over all items, with several producers and colours, grape prefixes and unknown types."""
    rng = random.Random(5)
    kinds = [None, "brut", "extra_dry", "dry", "semi_dry", "semi_sweet", "sweet", "portwine"]
    items = [(i, rng.choice(["p1", "p2", "p3", None]), rng.sample(["рислинг рейнский", "мерло", "сира"], rng.randint(0, 2)), rng.choice(["red", "white", None]), rng.choice(kinds)) for i in range(200)]
    asks = [(1, None, ["p1", "p2"], ["рислинг"], ["red"], "dry"), (2, 5, [], [], [], "brut"), (3, None, [], ["мерло", "сира"], ["white", "red"], None)]
    catalog = spark.createDataFrame(items, "id int, producer string, grapes array<string>, category string, type string")
    criteria = spark.createDataFrame(asks, "query_id int, exclude_id int, producers array<string>, grapes array<string>, categories array<string>, type string")
    got = {}
    for r in analogs.rank_analogs(criteria, catalog, 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"], r["hits"]))
    place = lambda x, order: order.index(x) if x in order else analogs.RANK_MISSING
    for q, exclude, producers, grapes, colors, kind in asks:
        scored = []
        for i, p, g, c, t in items:
            raw, hits = 0.0, 0
            if p in producers:
                raw, hits = raw + 0.35, hits + 1
            found = [x for x in grapes if any(x == y or y.startswith(x + " ") for y in g)]
            if found:
                raw, hits = raw + 0.3 * (0.75 * len(found) / len(grapes) + 0.25 * min(1, len(found) / max(1, len(g)))), hits + 1
            if c in colors:
                raw, hits = raw + 0.2, hits + 1
            if kind:
                raw += 0.15 * (0.5 if t is None else 1.0 if t == kind else 0.4 if abs(place(t, analogs.TYPE_ORDER) - place(kind, analogs.TYPE_ORDER)) <= 1 else 0)
                hits += t == kind
            if raw > 0 and i != exclude:
                total = 0.35 * bool(producers) + 0.3 * bool(grapes) + 0.2 * bool(colors) + 0.15 * bool(kind)
                score = raw / total * (0.75 if colors and c and c not in colors else 1)
                scored.append((-round(score, 9), place(c, analogs.CATEGORY_ORDER), place(t, analogs.TYPE_ORDER), -hits, i))
        want = [(k + 1, x[4], round(-x[0], 6), -x[3]) for k, x in enumerate(sorted(scored)[:10])]
        assert [(k, s, h) for k, _, s, h in sorted(got[q])] == [(k, s, h) for k, _, s, h in want]
        assert [i for _, i, _, _ in sorted(got[q])] == [i for _, i, _, _ in want]


def test_exclusive_evaluation(spark):
    queries = spark.createDataFrame([(1, "Каберне Совиньон dry")], "query_id long, text string")
    items = spark.createDataFrame([(10, "каберие совиньон", "dry"), (11, "каберне", "dry"), (12, "каберне совиньон", "sweet")], "id long, grape string, type string")
    tables = {"grape": lexicon.lexicon_table(spark, "grape", (("каберне совиньон", ("каберне совиньон",)), ("каберне", ("каберне",)))), "type": lexicon.lexicon_table(spark, "type", lexicon.TYPE)}
    got = {(r["id"], r["lexicon"]): r["missing"] for r in lexicon.evaluate_exclusive(queries, items, queries.select("query_id").join(items.select("id"), F.lit(True)), tables).collect()}
    assert got == {(11, "grape"): ["каберне совиньон"], (12, "type"): ["dry"]}


def test_links_by_rare_tokens_match_all_pairs(spark):
    rng = random.Random(9)
    names = [" ".join(rng.sample(["the", "house", "of", *(f"w{k}" for k in range(30))], rng.randint(1, 5))) for _ in range(150)]
    known = [" ".join(rng.sample(["the", "house", "of", *(f"w{k}" for k in range(30))], rng.randint(1, 5))) for _ in range(60)]
    got = {r["name"] for r in linking.link_names(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(list(enumerate(known)), "id int, known_name string"), least_contained=1_000).collect() if r["how"] == "tokens"}
    key = lambda n: "".join(n.split())
    words = lambda n: {w for w in n.split() if len(w) >= 2}
    close = lambda n: any(words(n) & words(k) and len(words(n) & words(k)) / max(len(words(n)), len(words(k))) >= 0.5 for k in known)
    assert got == {n for n in set(names) if key(n) not in {key(k) for k in known} and close(n)}


def test_decisions(spark):
    rows = spark.createDataFrame([(1, 10, 0.7, 0.9), (1, 11, 0.7, 0.5), (1, 12, 0.9, 0.99), (1, 13, None, 0.2)], "query_id int, id int, distance double, cosine double")
    got = {r["id"]: (r["colour_rejected"], r["kept_by_cosine"], r["hard_rejected"]) for r in decide.colour_gates(rows, 0.6, 0.8, 0.9).collect()}
    assert got == {10: (False, True, False), 11: (True, False, False), 12: (True, False, True), 13: (False, False, False)}
    rows = [(1, 5, 4, False, 0.9), (4, 5, 4, True, 0.7), (4, 5, 4, True, 0.9), (0, 0, 4, False, 0.1)]
    got = values(spark, rows, "m int, a int, b int, weak boolean, cos double", decide.line_reject(F.col("m"), F.col("a"), F.col("b"), F.col("weak"), F.col("cos")))
    assert got == ["majority_unmatched_lines", "weak_structure_low_cosine", None, None]
    attached = decide.attached(spark.createDataFrame([(1, 1), (1, 2)], "query_id int, id int"), spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.6)], "query_id int, id int, s double"), ["s"], spark.createDataFrame([(1, 2, 0.9)], "query_id int, id int, s double"))
    assert sorted(r["s"] for r in attached.collect()) == [0.5, 0.9]
    named = report.unmatched_names(spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 7), (4, None, None)], "id int, name string, link int"), "name", "link")
    assert [tuple(r) for r in named.collect()] == [("a", 2, [1, 2])]


def test_line_structure(spark):
    rows = [
        ("Красностоп\nБюрнье\nКубань\n2019", "Красностоп\nБюрнье\nКубань\n2019"), ("aaaa\nbbbb\ncccc\ndddd", "xxxx\nyyyy\nzzzz\nwwww"), ("Вино\nab", None), ("абвгд\nежзик\nлмноп", "абвгд\nrstuv"), ("винодельня\nкрасное вино", "красное вино"),
    ]
    got = [tuple(r) for r in pairs.aligned_lines(spark.createDataFrame(rows, "q string, r string"), "q", "r").drop("q", "r").collect()]
    assert got[0] == (4, 4, 4, 1.0, False, False, False, False, False)
    assert got[1] == (4, 4, 0, 0.0, False, True, True, True, True)
    assert got[2] == (0, 0, 0, 0.0, False, False, False, False, False)
    assert got[3][:4] == (3, 2, 1, 0.3333) and got[3][5:8] == (True, True, True) and got[4][:3] == (1, 1, 1)


def test_producers_by_lines_and_regions(spark):
    """A line whose words are all a name's counts fully for it, and of such names the longer wins; regions by likeness to the whole text."""
    texts = spark.createDataFrame([(1, "Дивная\nмерло 2019\nКрасная Горка урожай"), (2, "Кубань"), (3, "Крым"), (4, None), (5, ""), (6, "qqqq")], "id long, text string")
    producers = spark.createDataFrame([("Дивная",), ("Дивная Большая Поляна",), (None,)], "producer string")
    regions = spark.createDataFrame([("Кубань",), ("Крым",), ("Кубань",), ("ab",), (None,), ("Крымм",)], "region string")
    named = {r["id"]: (r["producer"], r["score"]) for r in entities.named_producers(texts, producers).collect()}
    assert named == {1: ("Дивная Большая Поляна", 100.0)}
    found = {r["id"]: (r["region"], r["score"]) for r in entities.named_regions(texts, regions).collect()}
    assert found[2] == ("Кубань", 100.0) and found[3] == ("Крым", 100.0) and not {4, 5, 6} & set(found)
    read = {r["id"]: r for r in entities.entities(texts, producers, regions).collect()}
    assert (read[2]["region"], read[2]["region_score"], read[2]["wine"]) == ("Кубань", 100.0, None)
    assert (read[6]["region"], read[6]["region_score"]) == (None, 0.0) and len(read) == 6
    voted = entities.voted_entities(entities.entities(texts, producers, regions).withColumn("scan", F.lit(1)), ["scan"], "id").first()
    assert (voted["region"], voted["region_score"], voted["producer"]) == ("Кубань", 100.0, "Дивная Большая Поляна")
    assert entities.named_regions(texts, regions.limit(0)).count() == 0
