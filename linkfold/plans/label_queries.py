"""Queries over labels: what their texts say, their boxes, and the decisions that rest on both.

Parts stand for catalogue items, with a label's text made of their columns; lines of orders stand for boxes and candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkfold.functions import answers, boxes, classes, similarity, text
from linkfold.operators import decide, entities, lexicon
from linkfold.operators.pairs import soft_pool
from linkfold.operators.spread import spread
from linkfold.plans.queries import _hits, _TOP, query

_COLORS = ("красное", "белое", "розовое", "сухое red", "полусухой blanc", "")
_TYPES = ("сухое", "полусухое", "полусладкое", "брют", "sweet", "extra brut", "")


def _labels(t, *more: str) -> DataFrame:
    """(id, name, label): the text of each part's label, with ``more`` columns of the part."""
    word = lambda values, by: F.get(F.array(*[F.lit(v) for v in values]), (F.col("p_size") + by) % len(values))
    parts = [F.col("p_name"), word(_COLORS, 0), word(_TYPES, 1), (F.col("p_partkey") % 70 + 1960).cast("string"), F.concat((F.col("p_size") % 30).cast("string"), F.lit(",5 % 0.75 л")), F.concat((F.col("p_size") * 10).cast("string"), F.lit(" ml"))]
    return spread(t("part")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(" ", *parts).alias("label"), *more)


def _sql_words(values: tuple[str, ...], by: int) -> str:
    return f"[{', '.join(f"'{v}'" for v in values)}][(p_size + {by}) % {len(values)} + 1]"


_LABELS = f"""
SELECT p_partkey AS id, p_name AS name, p_name || ' ' || {_sql_words(_COLORS, 0)} || ' ' || {_sql_words(_TYPES, 1)} || ' ' || (p_partkey % 70 + 1960) || ' ' || (p_size % 30) || ',5 % 0.75 л ' || (p_size * 10) || ' ml' AS label FROM part
"""


def _sql_classes(words: dict[str, tuple[str, ...]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN list_has_any(t, [{', '.join(f"'{w}'" for w in forms)}]) THEN '{c}' END" for c, forms in words.items()) + "], lambda x: x IS NOT NULL)"


@query(rf"""
WITH l AS ({_LABELS}), t AS (SELECT *, list_distinct(regexp_extract_all(lower(label), '[\p{{L}}\p{{N}}]+')) AS t FROM l),
  n AS (SELECT *, list_transform(regexp_extract_all(label, '(\d{{1,2}}(?:[.,]\d)?)\s*%', 1), lambda x: replace(x, ',', '.')::DOUBLE) AS a FROM t)
SELECT id, array_to_string({_sql_classes(classes.COLOR_WORDS)}, ',') AS colors, array_to_string({_sql_classes(classes.SWEET_WORDS)}, ',') AS sweetness, list_has_any(t, ['брют', 'brut']) AS sparkling,
  CASE WHEN label LIKE '%полуслад%' THEN 'semi_sweet' WHEN label LIKE '%полусух%' THEN 'semi_dry' WHEN label LIKE '%сухое%' THEN 'dry' WHEN regexp_matches(label, 'brut|брют') THEN 'brut' END AS type,
  (id % 70 + 1960)::VARCHAR AS vintage, len(list_filter(a, lambda x: x BETWEEN 4 AND 25))::INT AS n_alcohol, CASE WHEN (SELECT any_value(p_size * 10) FROM part WHERE p_partkey = id) >= 100 THEN 2 ELSE 1 END AS n_volumes FROM n
""")
def label_facts(t):
    rows = _labels(t).withColumn("t", F.array_distinct(text.tokens(F.col("label"))))
    return rows.select(
        "id", F.array_join(classes.word_classes(F.col("t"), classes.COLOR_WORDS), ",").alias("colors"), F.array_join(classes.word_classes(F.col("t"), classes.SWEET_WORDS), ",").alias("sweetness"),
        classes.is_sparkling(F.col("t")).alias("sparkling"), classes.type_key(F.col("label")).alias("type"), classes.vintage(F.col("label")).alias("vintage"),
        F.size(classes.alcohol_set(F.col("label"))).alias("n_alcohol"), F.size(classes.volume_set(F.col("label"))).alias("n_volumes"),
    )


@query()
def text_score(t):
    """Texts of parts' labels, some letters off, against parts that share a word of their names."""
    items = _labels(t).join(t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("producer"), F.col("p_type").alias("region")), "id")
    items = items.withColumns({"producer": F.concat_ws(" ", F.col("producer"), F.lit("Estate"), F.element_at(F.split("name", " "), 2)), "category": F.lit(None).cast("string"), "grapes": F.lit("мерло, каберне")})
    asked = items.filter("id % 100 = 0").select("id", F.concat_ws("\n", F.translate("producer", "a", "o"), "label").alias("text"))
    read = entities.entities(asked, items.select("producer"))
    near = asked.select(F.col("id").alias("query_id"), F.col("id").alias("id"))
    word = items.select("id", F.element_at(F.split("name", " "), 2).alias("word"))
    pairs = word.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "word").join(word, "word").select("query_id", "id").unionByName(near)
    scored = entities.text_scores(read, items, pairs)
    return scored.withColumn("mismatches", F.array_join("mismatches", ","))


@query(f"SELECT query_id, id, round(greatest(0.0, least(1.0, cosine * 2)), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY greatest(0.0, least(1.0, cosine * 2)) DESC, id) AS pos FROM ({_TOP})")
def answer_scores(t):
    """Scores that a model has given as JSON between other words, with an entry that is no id."""
    entry = F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('": "'), (F.col("cosine") * 2).cast("string"), F.lit('"'))
    raw = _hits(t).groupBy("query_id").agg(F.concat(F.lit('Here it is: {"none": 1, '), F.array_join(F.collect_list(entry), ", "), F.lit("} as asked")).alias("raw"))
    best = raw.select("query_id", F.posexplode(answers.score_map(answers.salvaged_json(F.col("raw")))).alias("pos", "e"))
    return best.select("query_id", "e.id", "e.score", (F.col("pos") + 1).cast("long").alias("pos"))


@query("SELECT conv_id, turn, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::INT AS n, trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]) AS first FROM conversations")
def annotation_lines(t):
    """Recognised documents whose paragraphs are the lines of a text, one word each."""
    symbol = lambda x: F.struct(F.array(F.struct(F.array(F.struct(F.trim(x).alias("text"))).alias("symbols"))).alias("words"))
    paragraphs = F.transform(F.split("text", "\n"), symbol)
    document = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(paragraphs.alias("paragraphs"))).alias("blocks"))).alias("pages")))
    lines = t("conversations").select("conv_id", "turn", answers.annotation_lines(document).alias("lines"))
    return lines.select("conv_id", "turn", F.size("lines").alias("n"), F.get("lines", F.lit(0)).alias("first"))


# Decisions over the neighbours of vectors -------------------------------------------------------------------------------------------------------------


@query(f"""
WITH g AS (SELECT query_id, id, 1 - cosine AS d, cosine FROM ({_TOP}))
SELECT query_id, id, d > 0.62 AND cosine < 0.375 OR d > 0.66 AS colour_rejected, d > 0.62 AND cosine >= 0.375 AND d <= 0.66 AS kept_by_cosine, d > 0.66 AS hard_rejected FROM g
""")
def colour_gates(t):
    rows = _hits(t).withColumn("distance", 1 - F.col("cosine"))
    return decide.colour_gates(rows, 0.62, 0.66, 0.375).select("query_id", "id", "colour_rejected", "kept_by_cosine", "hard_rejected")


@query(f"""
WITH s AS (SELECT query_id, id, cosine, CASE WHEN label % 3 <> 0 THEN label END AS fin FROM ({_TOP})), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(fin, -1) DESC, cosine DESC, id) AS rank FROM s)
SELECT query_id, arg_max(id, (cosine, -id)) AS id, arg_max(rank, (cosine, -id))::INT AS rank FROM r GROUP BY query_id
""")
def visual_winner_rank(t):
    rows = _hits(t).withColumn("fin", F.when(F.col("label") % 3 != 0, F.col("label")))
    return decide.rank_of_visual_winner(rows.select("query_id", "id", "cosine", "fin"))


@query(f"""
WITH s AS (SELECT query_id, id, pos % 2 AS channel, cosine AS final, cosine AS cover, cosine - 0.05 AS soft, pos FROM ({_TOP})),
  b AS (SELECT query_id, arg_max((id, channel, final, cover, soft), (final, -pos, -id)) AS b FROM s GROUP BY query_id),
  d AS (SELECT query_id, b[1] AS id, b[2] AS channel, b[3] AS final, CASE WHEN b[3] < 0.36 THEN 'below_minimum' WHEN b[4] < 0.40 AND b[5] < 0.35 THEN 'soft_veto' WHEN b[3] > 0.41 THEN 'match' ELSE 'similar' END AS reason FROM b)
SELECT query_id, CASE WHEN reason = 'match' THEN id END AS winner_id, channel, round(final, 6) AS final, reason FROM d
""")
def channel_decision(t):
    rows = _hits(t).select("query_id", "id", (F.col("pos") % 2).cast("long").alias("channel"), F.col("cosine").alias("final"), F.col("cosine").alias("soft_cover"), (F.col("cosine") - 0.05).alias("soft_score"), "pos")
    return decide.channel_decision(rows, 0.41, 0.36)


@query(f"""
WITH h AS (SELECT cosine, (label = q_label)::INT AS hit FROM ({_TOP})), c AS (SELECT cosine AS s, sum(hit) AS p, count(*) AS n FROM h GROUP BY 1),
  r AS (SELECT s, p, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS k, sum(p) OVER () AS total FROM c), f AS (SELECT *, 2 * tp / (k + total) AS f1 FROM r)
SELECT round(arg_max(s, (round(f1, 9), s)), 6) AS threshold, round(max(f1), 6) AS f1, round(sum(p / total * tp / k), 6) AS pr_auc FROM f
""")
def best_threshold(t):
    rows = _hits(t).withColumn("hit", (F.col("label") == F.col("q_label")).cast("int"))
    return decide.best_f1_threshold(rows, "hit", "cosine")


@query(f"SELECT query_id, count(*) AS n, coalesce(string_agg(id::VARCHAR, ',' ORDER BY pos) FILTER (k <= 4), '') AS items FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS k FROM ({_TOP}) WHERE cosine < 0.4) GROUP BY query_id")
def reject_preview(t):
    shown = decide.preview(_hits(t).filter("cosine < 0.4"), F.col("id").cast("string"), F.col("pos"), 4)
    return shown.withColumn("items", F.array_join("items", ","))


_LEXICON = (("red", ("the of", "of the")), ("white", ("and", "and the")), ("dry", ("de la", "que")))


@query(rf"""
WITH forms(canon, form) AS (VALUES {", ".join(f"('{c}', '{f}')" for c, fs in _LEXICON for f in fs)}),
  w AS (SELECT conv_id, turn, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), '  ') || ' ' AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS q, b.w AS r FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
  h AS (SELECT conv_id, turn, canon, bool_or(contains(q, ' ' || replace(form, ' ', '  ') || ' ')) AS asked, bool_or(contains(r, ' ' || replace(form, ' ', '  ') || ' ')) AS held FROM p, forms GROUP BY ALL)
SELECT conv_id, turn, array_to_string(list_sort(list(canon)), ',') AS missing FROM h WHERE asked AND NOT held GROUP BY conv_id, turn
""")
def exclusive_reject(t):
    turns = t("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "conv_id", "turn", "text")
    found = lexicon.lexicon_hits(turns.select("id", "text"), lexicon.lexicon_table(turns.sparkSession, "words", _LEXICON))
    pairs = turns.select(F.col("id").alias("query_id"), "conv_id", "turn").join(turns.select(F.col("id").alias("id"), "conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"])
    missing = lexicon.missing_canons(found.select(F.col("id").alias("query_id"), "lexicon", "canon"), found.select("id", "lexicon", "canon"), pairs)
    out = missing.groupBy("query_id", "id").agg(F.array_join(F.array_sort(F.collect_set("canon")), ",").alias("missing"))
    return pairs.join(out, ["query_id", "id"]).select("conv_id", "turn", "missing")


_CLASS_FORMS = {"category": (("red", "(^| )(красное|red|rouge)( |$)"), ("white", "(^| )(белое|white|blanc)( |$)"), ("rose", "(^| )(розовое|rose)( |$)")), "type": (("brut", "(^| )(брют|brut)( |$)"), ("dry", "(^| )(сухое|dry)( |$)"), ("semi_dry", "(^| )полусухое( |$)"), ("semi_sweet", "(^| )полусладкое( |$)"), ("sweet", "(^| )(сладкое|sweet)( |$)"))}


@query(f"""
WITH l AS (SELECT l.*, p_brand FROM ({_LABELS}) l JOIN part ON p_partkey = id), f(lexicon, canon, pattern) AS (VALUES {", ".join(f"('{x}', '{c}', '{p}')" for x, cs in _CLASS_FORMS.items() for c, p in cs)}),
  h AS (SELECT id, lexicon, canon FROM l JOIN f ON regexp_matches(label, pattern)), p AS (SELECT q.id AS query_id, c.id FROM l q JOIN l c ON q.p_brand = c.p_brand AND q.id % 20 = 0 AND q.id <> c.id)
SELECT query_id, p.id, a.lexicon, string_agg(a.canon, ',' ORDER BY a.canon) AS missing FROM p JOIN h a ON a.id = query_id WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.id = p.id AND b.lexicon = a.lexicon AND b.canon = a.canon) GROUP BY ALL
""")
def exclusive_evaluation(t):
    """Colours and types that a label names and those of the same brand's other parts don't."""
    labels = _labels(t, "p_brand")
    asked = labels.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("text"), "p_brand")
    items = labels.select("id", F.col("label").alias("category"), F.col("label").alias("type"), "p_brand")
    tables = {"category": lexicon.lexicon_table(labels.sparkSession, "category", lexicon.CATEGORY), "type": lexicon.lexicon_table(labels.sparkSession, "type", lexicon.TYPE)}
    return lexicon.evaluate_exclusive(asked, items, ["p_brand"], tables, fuzzy=(), sep=",").filter("query_id != id")


@query(f"""
WITH s AS (SELECT query_id, id, cosine, 1.0::DOUBLE - cosine AS cover, CASE WHEN q_label = 3 THEN 1 ELSE 4 END AS q_terms, label % 3 AS r_terms, round(label / 10.0::DOUBLE, 1) AS text, pos % 4 = 0 AS out FROM ({_TOP})),
  x AS (SELECT *, CASE WHEN out THEN 0 WHEN q_terms < 2 THEN text * 0.5 ELSE text END AS score2 FROM s),
  f AS (SELECT *, CASE WHEN out THEN 0 ELSE round(0.65::DOUBLE / 1.1::DOUBLE * score2 + 0.45::DOUBLE / 1.1::DOUBLE * greatest(0, least(1, cosine)), 6) END AS fin2 FROM x)
SELECT query_id, id, round(score2, 6) AS score2, fin2, row_number() OVER (PARTITION BY query_id ORDER BY fin2 DESC, score2 DESC, cover DESC, r_terms DESC, id)::INT AS rank FROM f
""")
def soft_ranking(t):
    """A pool's candidates by the blend of a score and the cosine; every fourth is rejected, and queries of one label have a single term."""
    hits = _hits(t)
    scored = hits.select("query_id", "id", F.round(F.col("label") / 10, 1).alias("score"), (1 - F.col("cosine")).alias("cover"), F.when(F.col("q_label") == 3, 1).otherwise(4).alias("q_terms"), (F.col("label") % 3).alias("r_terms"))
    return soft_pool(scored, hits.select("query_id", "id", "cosine"), hits.filter("pos % 4 = 0").select("query_id", "id"))


@query(f"""
WITH p AS (SELECT query_id, id, list_transform(q.embedding::DOUBLE[], lambda x: abs(x)) AS a, list_transform(c.embedding::DOUBLE[], lambda x: abs(x) + CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END) AS b FROM ({_TOP}) JOIN embeddings q ON q.vec_id = query_id JOIN embeddings c ON c.vec_id = id)
SELECT query_id, id, id % 2 <> 0 AND id % 3 = 0 AS to_store, CASE WHEN id % 2 = 0 OR id % 3 = 0 THEN round(sqrt(greatest(0.0, 1 - list_sum(list_transform(generate_series(1, len(a)), lambda i: sqrt(a[i] * b[i]))) / sqrt(list_sum(a) * list_sum(b)))), 4) END AS distance FROM p
""")
def stored_histograms(t):
    """Distances to histograms that are stored for even ids, computed for every third, and missing for others; to_store marks what has been computed anew."""
    hist = lambda more: F.transform("vector", lambda x: F.abs(x.cast("double")) + more)
    vectors = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    candidates, queries = _hits(t).select("query_id", "id"), vectors.select(F.col("id").alias("query_id"), hist(0).alias("hist"))
    stored, computed = vectors.filter("id % 2 = 0").select("id", hist(0).alias("hist")), vectors.filter("id % 3 = 0").select("id", hist(1).alias("hist"))
    rows, missing = decide.with_distances(candidates, queries, stored, computed, similarity.bhattacharyya)
    marked = rows.join(missing.select("id", F.lit(True).alias("to_store")), "id", "left")
    return marked.select("query_id", "id", F.coalesce("to_store", F.lit(False)).alias("to_store"), "distance")


# Boxes: the lines of an order are labels, and every other one a bottle ----------------------------------------------------------------------------------

_BOX = """
SELECT l_orderkey AS image, l_linenumber * 100 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_extendedprice, l_quantity, l_tax, l_discount) AS id, l_quantity AS x1, l_discount * 100 AS y1, l_quantity + 10 + l_linenumber AS x2,
  l_discount * 100 + 5 + l_tax * 100 AS y2, l_tax * 10 AS conf FROM lineitem
"""


def _numbered(t) -> DataFrame:
    """(image, id, box, conf): boxes with an id of their own within an image."""
    lines = t("lineitem")
    x, y = F.col("l_quantity"), F.col("l_discount") * 100
    box = F.struct(x.alias("x1"), y.alias("y1"), (x + 10 + F.col("l_linenumber")).alias("x2"), (y + 5 + F.col("l_tax") * 100).alias("y2"))
    same = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount")
    return lines.select(F.col("l_orderkey").alias("image"), (F.col("l_linenumber") * 100 + F.row_number().over(same)).cast("long").alias("id"), box.alias("box"), (F.col("l_tax") * 10).alias("conf"))


def _bottles(t) -> DataFrame:
    return _numbered(t).filter("id % 2 = 0").select("image", F.col("id").alias("bottle_id"), F.col("box").alias("bottle_box"), F.col("conf").alias("bottle_conf"))


_SHARES = f"""
SELECT a.image, a.id, any_value(a.conf) AS conf, max(coalesce(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) / ((a.x2 - a.x1) * (a.y2 - a.y1)), 0)) AS best, count(b.id) AS bottles,
  min(CASE WHEN greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) / ((a.x2 - a.x1) * (a.y2 - a.y1)) >= 0.85 THEN b.id END) AS bottle_id
FROM ({_BOX}) a LEFT JOIN (SELECT * FROM ({_BOX}) WHERE id % 2 = 0) b ON a.image = b.image GROUP BY a.image, a.id
"""


@query(f"""
WITH s AS ({_SHARES}), p AS (SELECT *, sum((best >= 0.5)::INT) OVER (PARTITION BY image) - (best >= 0.5)::INT AS others FROM s)
SELECT image, id FROM p WHERE NOT (bottles > 0 AND best <= 0.5 AND conf <= 0.5 AND others > 0)
""")
def box_orphans(t):
    return boxes.drop_orphans(_numbered(t), _bottles(t), "image").select("image", "id")


@query(f"SELECT image, id, bottle_id FROM ({_SHARES})")
def box_bottles(t):
    return boxes.assigned_to_bottles(_numbered(t), _bottles(t), "image").select("image", "id", "bottle_id")


@query(f"""
WITH s AS (SELECT *, (x2 - x1) * (y2 - y1) AS a FROM ({_BOX})), o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY a DESC, id) AS k, count(*) OVER (PARTITION BY image) AS n FROM s),
  p AS (SELECT image, any_value(n) AS n, max(a) FILTER (k = 1) AS a0, max(a) FILTER (k = 2) AS a1, max(a) FILTER (k = 3) AS a2, max(conf) FILTER (k = 1) AS c0, max(conf) FILTER (k = 2) AS c1, max(id) FILTER (k = 1) AS i0, max(id) FILTER (k = 2) AS i1 FROM o GROUP BY image),
  w AS (SELECT *, CASE WHEN n = 3 AND a2 > 0 AND (a0 - a2) / a0 <= 0.12 THEN 'middle_of_three_similar' WHEN n >= 2 AND a0 > 0 AND a1 <= 0.5 * a0 THEN 'largest_vs_half_size' WHEN n >= 2 AND c1 - c0 >= 0.9 THEN 'next_by_size_higher_conf'
    WHEN n >= 2 AND c0 < 0.55 AND c1 - c0 >= 0.15 AND a0 > 0 AND a1 > 0.25 * a0 THEN 'next_by_size_weak_largest' ELSE 'largest' END AS reason FROM p)
SELECT image, CASE WHEN reason LIKE 'largest%' THEN i0 ELSE i1 END AS id, reason FROM w
""")
def box_primary_label(t):
    return boxes.primary_label(_numbered(t), "image").select("image", "id", "reason")


@query()
def box_crops(t):
    crops = boxes.crop_boxes(_numbered(t).filter("id % 2 = 1"), _bottles(t), "image")
    return crops.select("image", *[F.round(F.col("box")[k], 4).alias(k) for k in ("x1", "y1", "x2", "y2")], "reason")
