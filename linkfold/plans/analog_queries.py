"""Queries of analogs: parts stand for catalogue items and the texts of labels, neighbours of vectors for what images find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkfold.operators import analogs
from linkfold.operators.spread import spread
from linkfold.plans.label_queries import _LABELS, _labels
from linkfold.plans.queries import _TOP, _hits, query


def _items(t) -> DataFrame:
    """Parts as items: the first word of a name is the producer's, the second the grape, of which every third item's label gives another name."""
    word = lambda k: F.element_at(F.split("p_name", " "), k)
    named = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("zz"), word(2))).otherwise(word(2))
    read = F.to_json(F.struct(named.alias("cupage"), F.concat(F.lit("Estate "), word(1)).alias("producer")))
    columns = {"producer": F.concat(F.lit("Estate "), word(1)), "grapes": word(2), "region": F.col("p_brand"), "label_json": read, "category": F.lit(None).cast("string"), "color": F.lit(None).cast("string"), "type": F.lit(None).cast("string")}
    parts = spread(t("part")).select(F.col("p_partkey").alias("id"), *[c.alias(n) for n, c in columns.items()])
    return parts.join(_labels(t).select("id", F.col("label").alias("name")), "id").withColumn("label", F.lit(None).cast("string"))


_TYPE_SQL = "CASE WHEN contains(label, 'extra brut') OR contains(label, 'брют') THEN 'brut' WHEN regexp_matches(label, '(^| )сухое') THEN 'dry' WHEN contains(label, 'полусухое') THEN 'semi_dry' WHEN contains(label, 'полусладкое') THEN 'semi_sweet' WHEN contains(label, 'sweet') THEN 'sweet' END"
_COLOR_SQL = "CASE WHEN regexp_matches(label, 'красное|(^| )red( |$)') THEN 'red' WHEN regexp_matches(label, 'белое| blanc') THEN 'white' WHEN contains(label, 'розовое') THEN 'rose' END"


@query(f"""
WITH l AS ({_LABELS})
SELECT id, {_COLOR_SQL} AS category, {_TYPE_SQL} AS type, CASE WHEN id % 3 = 0 AND (SELECT count(*) FROM l b WHERE b.id % 3 = 0 AND split_part(b.name, ' ', 2) = split_part(l.name, ' ', 2)) < 2 THEN 2 ELSE 1 END::INT AS n_canons FROM l
""")
def analog_catalog(t):
    """Canonical colour and type of each item, and how many grapes it has once other names of them are known."""
    items = _items(t)
    canons = analogs.catalog_canons(items, analogs.grape_aliases(items))
    return canons.select("id", "category", "type", F.size("grapes").alias("n_canons"))


@query(f"""
WITH l AS ({_LABELS}), g AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS g FROM part), w AS (SELECT id, unnest(list_distinct(string_split(label, ' '))) AS g FROM l)
SELECT id, {_COLOR_SQL} AS category, CASE WHEN id % 20 = 0 AND contains(label, 'сухое') AND NOT contains(label, 'extra brut') AND NOT contains(label, 'брют') THEN 'dry' ELSE {_TYPE_SQL} END AS type, (SELECT count(*) FROM w JOIN g USING (g) WHERE w.id = l.id)::INT AS n_grapes, 1 AS n_producers FROM l WHERE id % 10 = 0
""")
def analog_criteria(t):
    """What texts of labels ask for, with Cyrillic words torn into letters in every other one, where the end of a word counts as one of its own; producers and grapes by their number."""
    items = _items(t)
    torn = F.regexp_replace("text", r"(?<=[а-я])(?=[а-я])", " ")
    texts = items.filter("id % 10 = 0").select("id", F.concat_ws("\n", "producer", "name").alias("text"))
    texts = texts.select(F.col("id").alias("query_id"), F.when(F.col("id") % 20 == 0, torn).otherwise(F.col("text")).alias("text"))
    asked = analogs.text_criteria(texts, analogs.analog_lexicon(items), analogs.grape_aliases(items))
    return asked.select(F.col("query_id").alias("id"), F.get("categories", F.lit(0)).alias("category"), "type", F.size("grapes").alias("n_grapes"), F.size("producers").alias("n_producers"))


@query(f"""
WITH i AS (SELECT p_partkey AS id, p_brand AS b, split_part(p_name, ' ', 2) AS g, p_size % 4 AS c, CASE WHEN p_size % 11 <> 0 THEN p_size % 7 END AS t FROM part), q AS (SELECT *, id % 300 = 0 AS mute FROM i WHERE id % 100 = 0),
  n AS (SELECT query_id, id, cosine FROM ({_TOP})),
  s AS (SELECT q.id AS query_id, i.id, i.c, i.t, (q.b = i.b)::INT + (q.g = i.g)::INT + (q.c = i.c)::INT + coalesce(q.t = i.t, false)::INT AS hits,
    (0.35 * (q.b = i.b)::INT + 0.3 * (q.g = i.g)::INT + 0.2 * (q.c = i.c)::INT + 0.15 * (CASE WHEN q.t IS NULL THEN 0 WHEN i.t IS NULL THEN 0.5 WHEN q.t = i.t THEN 1.0 WHEN abs(q.t - i.t) <= 1 THEN 0.4 ELSE 0 END))::DOUBLE AS raw,
    CASE WHEN q.t IS NULL THEN 0.85::DOUBLE ELSE 1.0 END AS asked, CASE WHEN q.c = i.c THEN 1.0::DOUBLE ELSE 0.75 END AS factor FROM q JOIN i ON NOT mute AND q.id <> i.id),
  r AS (SELECT s.query_id, s.id, round(raw / asked * factor, 6) AS score, row_number() OVER (PARTITION BY s.query_id ORDER BY round(raw / asked * factor, 9) DESC, c, t NULLS LAST, coalesce(n.cosine, -1) DESC, hits DESC, s.id) AS rank
    FROM s LEFT JOIN n ON s.query_id = n.query_id AND s.id = n.id WHERE raw > 0),
  f AS (SELECT query_id, id, round(cosine, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM n
    WHERE query_id IN (SELECT id FROM q WHERE mute) AND id IN (SELECT id FROM i) AND id % 3 <> 0 AND cosine > 0.3)
SELECT query_id, id, score, rank::INT AS rank, 'criteria' AS source FROM r WHERE rank <= 10 UNION ALL SELECT query_id, id, score, rank::INT, 'embedding_cosine' FROM f WHERE rank <= 5
""")
def analogs_found(t):
    """Analogs by criteria with ties by the cosine, and the nearest, without rejected ones, for queries that ask for nothing."""
    items = t("part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("producer"), F.array(F.element_at(F.split("p_name", " "), 2)).alias("grapes"),
        (F.col("p_size") % 4).cast("string").alias("category"), F.when(F.col("p_size") % 11 != 0, (F.col("p_size") % 7).cast("string")).alias("type"),
    )
    asked = analogs.item_criteria(items.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "id"), items)
    mute = F.col("query_id") % 300 == 0
    asked = asked.select("query_id", "exclude_id", *[F.when(~mute, F.col(c)).alias(c) for c in ("producers", "grapes", "categories", "type")])
    hits = _hits(t).select("query_id", "id", "cosine")
    orders = {"category_order": ("0", "1", "2", "3"), "type_order": ("0", "1", "2", "3", "4", "5", "6")}
    found = analogs.find_analogs(asked, items, hits, hits.filter("id % 3 = 0"), 10, 5, 0.3, **orders)
    return found.withColumn("score", F.round("score", 6))
