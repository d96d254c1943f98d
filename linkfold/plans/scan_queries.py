"""Queries of what reads, counts or learns beyond single expressions: torn lexicon forms, and more below."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from linkfold.functions import boxes, records
from linkfold.functions.pixels import packed
from linkfold.functions.text import latin_to_cyrillic
from linkfold.operators import admission, boosting, channels, key_index, keypoints, lexicon, pixels, tilt, torn_forms
from linkfold.operators.pairs import pair_features
from linkfold.operators.spread import dealt
from linkfold.operators.tables import new_path, written
from linkfold.plans.label_queries import _BOX, _bottles, _labels, _numbered
from linkfold.plans.queries import AS_OF_YEAR, _hits, query
from linkfold.sources import model_cache, versions


@query()
def torn_lexicon(t):
    """Names of parts, whole, torn by blanks or hyphens, or in Cyrillic, and the words of names that stand in them."""
    names = t("part").select("p_partkey", "p_size", "p_name")
    torn = lambda by: F.regexp_replace("p_name", r"(?<=\w)(?=\w)", by)
    text = F.when(F.col("p_size") % 4 == 1, torn(" ")).when(F.col("p_size") % 4 == 2, torn("- ")).when(F.col("p_size") % 4 == 3, latin_to_cyrillic(F.col("p_name"))).otherwise(F.col("p_name"))
    words = names.select(F.explode(F.split("p_name", " ")).alias("form")).groupBy("form").agg(F.count(F.lit(1)).alias("freq"))
    both = words.unionByName(names.groupBy(F.col("p_name").alias("form")).agg(F.count(F.lit(1)).alias("freq")))
    table = both.select(F.lit("part").alias("lexicon"), F.col("form").alias("canon"), F.lit(0).alias("canon_pos"), "form", F.size(F.split("form", " ")).alias("n_words"), "freq")
    hits = torn_forms.torn_hits(names.select(F.col("p_partkey").alias("id"), text.alias("text")), table)
    first = lexicon.first_hits(hits).select("id", F.col("form").alias("first_form"))
    return hits.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("form")), ",").alias("forms")).join(first, "id").withColumnRenamed("id", "p_partkey")


# Vectors as pixels: three entries in turn are red, green and blue, and all vectors of a label are one image ---------------------------------------


def _images(t):
    byte = lambda e: F.least(F.greatest(F.floor(e.cast("double") * 500 + 128), F.lit(0)), F.lit(255)).cast("int")
    entry = lambda k, j: byte(F.get("embedding", 3 * k + j))
    return t("embeddings").select(F.col("label").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: packed(entry(k, 0), entry(k, 1), entry(k, 2))).alias("pixels"))


@query("""
WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS j, unnest(list_transform(embedding, lambda x: least(greatest(floor(x::DOUBLE * 500 + 128), 0), 255)::INT)) AS c, vec_id FROM embeddings),
  p AS (SELECT label, max(CASE WHEN j % 3 = 0 THEN c END) AS r, max(CASE WHEN j % 3 = 1 THEN c END) AS g, max(CASE WHEN j % 3 = 2 THEN c END) AS b FROM e WHERE j < 63 GROUP BY label, vec_id, j // 3),
  s AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM p),
  t AS (SELECT *, CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * d ELSE r - g + 4 * d END AS turn FROM s),
  h AS (SELECT label, CASE WHEN d = 0 THEN 0 ELSE (turn * round_even(180 * 4096.0::DOUBLE / (6 * d), 0)::INT + 2048) >> 12 END AS h,
    CASE WHEN v = 0 THEN 0 ELSE (d * round_even(255 * 4096.0::DOUBLE / v, 0)::INT + 2048) >> 12 END AS s FROM t),
  n AS (SELECT label, (CASE WHEN h < 0 THEN h + 180 ELSE h END) * 30 // 180 AS hue, s * 32 // 256 AS saturation, count(*) AS n FROM h GROUP BY ALL)
SELECT label, hue::BIGINT AS hue, saturation::BIGINT AS saturation, round((n / sqrt(sum(n::DOUBLE * n) OVER (PARTITION BY label)))::FLOAT::DOUBLE, 6) AS weight FROM n
""")
def hsv_histogram(t):
    found = pixels.hsv_histograms(_images(t)).select("id", F.posexplode("hist").alias("bin", "weight")).filter("weight > 0")
    place = [F.floor(F.col("bin") / pixels.SATURATIONS).alias("hue"), (F.col("bin") % pixels.SATURATIONS).cast("long").alias("saturation")]
    return found.select(F.col("id").alias("label"), *place, F.round("weight", 6).alias("weight"))


@query()
def dominant_colour(t):
    found = pixels.dominant_colours(_images(t))
    return found.select(F.col("id").alias("label"), *[F.round(c, 4).alias(c) for c in ("l8", "a8", "b8", "share")], "pixels")


# Vectors as keypoints: those of a label are an image, and its reference is the same one seen at an angle, in other pixels ----------------------------


def _keypoints(t):
    at = lambda k: F.floor(F.element_at("embedding", k).cast("double") * 2_000 + 400)
    return t("embeddings").select(F.col("label").alias("image"), at(1).alias("x"), at(2).alias("y"), F.col("embedding").alias("descriptor"))


@query()
def keypoint_match(t):
    """Each label against itself and the next two, whose references are turned, scaled and tilted."""
    points = _keypoints(t)
    away = 1 + 0.0002 * F.col("x") + 0.0001 * F.col("y")
    seen = points.select("image", ((0.9 * F.col("x") - 0.3 * F.col("y") + 200) / away).alias("x"), ((0.3 * F.col("x") + 0.9 * F.col("y") + 50) / away).alias("y"), "descriptor")
    labels = points.select("image").distinct()
    pairs = labels.select(F.col("image").alias("query_id"), F.explode(F.sequence(F.col("image"), F.col("image") + 2)).alias("id"))
    return keypoints.verified_pairs(pairs, points, seen).withColumnRenamed("query_id", "label").drop("error")


@query()
def image_tilt(t):
    """Edges of two sides a supplier's image has, tilted by its key, and how it is turned."""
    angle = F.radians(F.col("s_suppkey") * 7 % 61 - 30)
    along = F.explode(F.sequence(F.lit(0), F.lit(160)))
    edge = t("supplier").select("s_suppkey", angle.alias("t"), F.explode(F.array(F.lit(0), F.lit(120))).alias("side")).select("*", along.alias("k"))
    points = edge.select("s_suppkey", F.round(300 + F.col("side") * F.cos("t") - F.col("k") * F.sin("t")).alias("x"), F.round(100 + F.col("side") * F.sin("t") + F.col("k") * F.cos("t")).alias("y"))
    return tilt.upright(points, ["s_suppkey"]).select("s_suppkey", F.round("tilt", 3).alias("tilt"), "method", F.round("rotate", 3).alias("rotate"), "part", F.round("rest", 3).alias("rest"), "reason")


# Pairs of recognised texts and labels, and a scorer that is learnt from their features --------------------------------------------------------------


def _labelled_pairs(t):
    """Each part's text with letters lost and its year kept or not, against its own label (1) and that of the next part (0), and the label itself, which is no recognised text (0)."""
    labels = _labels(t)
    lost = F.when(F.col("id") % 3 == 0, F.translate("label", "aeо", "oe")).when(F.col("id") % 3 == 1, F.regexp_replace("label", r"\d{4}", "")).otherwise(F.translate("label", "rn", "m"))
    asked = labels.select("id", lost.alias("query"))
    other = labels.select((F.col("id") - 1).alias("id"), F.col("label").alias("reference"))
    pairs = asked.join(labels.select("id", F.col("label").alias("reference")), "id").withColumn("y", F.lit(1)).unionByName(asked.join(other, "id").withColumn("y", F.lit(0)))
    pairs = pairs.unionByName(labels.select("id", F.col("label").alias("query"), F.col("label").alias("reference"), F.lit(0).alias("y")))
    # equal pairs of texts are compared once, dealt out over all cores
    features = pair_features(dealt(pairs.select("query", "reference").distinct()), "query", "reference", AS_OF_YEAR)
    return pairs.join(features, ["query", "reference"]).select(*pairs.columns, *features.columns[2:])


@query()
def boosted_pairs(t):
    """Fitted on four fifths of the pairs, by id; all pairs with their chance of being a match."""
    rows = written(_labelled_pairs(t), "pairs")  # the features are read again and again, and dear
    features = [c for c in rows.columns if c not in ("id", "query", "reference", "y")]
    model = boosting.fit_boosted(rows.filter("id % 5 > 0"), features, "y", trees=12, depth=3, shrink=0.3)
    return rows.select("id", "y", (F.col("id") % 5 == 0).alias("held_out"), F.round(model.chance(), 6).alias("chance"))


@query("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
  a AS (SELECT x.event_id, x.user_id, any_value(x.t) AS t, max(y.t + 36000000000 * ((x.i - y.i) // 3)) AS admitted FROM e x JOIN e y ON x.user_id = y.user_id AND y.i <= x.i GROUP BY x.event_id, x.user_id)
SELECT event_id, user_id, admitted::BIGINT AS admitted_us, round((admitted - t) / 1000000.0::DOUBLE, 6) AS waited FROM a
""")
def admission_times(t):
    """When each event of a user goes ahead, if three may in any ten hours and the others wait."""
    found = admission.admissions(t("events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3, 36_000)
    return found.select("event_id", "user_id", F.unix_micros("admitted").alias("admitted_us"), F.round("waited", 6).alias("waited"))


# Producers with several spellings, some in common, and customers' names that are looked up among them --------------------------------------------------

_NORM = "trim(regexp_replace(replace(lower({0}), '&', ' and '), '[^0-9a-z]+', ' ', 'g'))"
_PRODUCER = "CASE s_suppkey % 3 WHEN 0 THEN 'Chateau ' || n_name WHEN 1 THEN 'Vinodelnya ' || n_name ELSE n_name || ' & Sons' END || ' ' || (s_suppkey % 4)"


@query(f"""
WITH p AS (SELECT s_suppkey AS id, {_PRODUCER} AS name, replace(lower(n_name), ' ', '-') || '_' || (s_suppkey % 5) AS slug FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  b AS (SELECT id, {_NORM.format("name")} AS k FROM p UNION SELECT id, {_NORM.format("slug")} FROM p),
  v AS (SELECT id, unnest([k, trim(replace(replace(k, 'vinodelnya ', ''), 'usadba ', '')), trim(replace(k, 'chateau ', 'shato ')), trim(replace(k, 'shato ', 'chateau ')), trim(replace(k, ' and ', ' '))]) AS k FROM b),
  i AS (SELECT k, min(id) AS id FROM v WHERE k <> '' GROUP BY k),
  a AS (SELECT {_NORM.format("r_name || ' & House'")} AS k, i.id FROM region JOIN p ON p.id = r_regionkey + 1 JOIN i ON i.k = {_NORM.format("p.name")}),
  x AS (SELECT * FROM i WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT * FROM a UNION ALL SELECT replace(k, ' and ', ' '), id FROM a WHERE replace(k, ' and ', ' ') NOT IN (SELECT k FROM i)),
  n AS (SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN 'SHATO  ' || n_name || ', ' || (c_custkey % 7) WHEN 1 THEN n_name || '-' || (c_custkey % 7) WHEN 2 THEN n_name || ' and sons ' || (c_custkey % 7)
    WHEN 3 THEN r_name || ' House' ELSE n_name || ' Sons, ' || (c_custkey % 7) END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  m AS (SELECT name, {_NORM.format("name")} AS k FROM n)
SELECT name, coalesce(x.id, y.id) AS id FROM m LEFT JOIN x ON x.k = m.k LEFT JOIN x y ON y.k = replace(m.k, ' and ', ' ')
""")
def key_links(t):
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n, of = F.col("n_name"), lambda key, k: (F.col(key) % k).cast("string")
    made = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Chateau "), n)).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("Vinodelnya "), n)).otherwise(F.concat(n, F.lit(" & Sons")))
    url = F.concat(F.lit("https://w.org/wineries/"), F.translate(F.lower(n), " ", "-"), F.lit("_"), of("s_suppkey", 5), F.lit("/"))
    producers = t("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.concat_ws(" ", made, of("s_suppkey", 4)).alias("name"), url.alias("url"), F.col("s_suppkey").alias("pos"))
    aliases = t("region").join(producers, F.col("id") == F.col("r_regionkey") + 1).select(F.concat("r_name", F.lit(" & House")).alias("alias"), F.col("name").alias("target"), F.col("r_regionkey").alias("pos"))
    c, kind = of("c_custkey", 7), F.col("c_custkey") % 5
    name = F.when(kind == 0, F.concat(F.lit("SHATO  "), n, F.lit(", "), c)).when(kind == 1, F.concat(n, F.lit("-"), c)).when(kind == 2, F.concat(n, F.lit(" and sons "), c)).when(kind == 3, F.concat("r_name", F.lit(" House"))).otherwise(F.concat(n, F.lit(" Sons, "), c))
    names = t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(name.alias("name"))
    return key_index.links_by_key(names, key_index.key_index(producers, aliases), aliases)


# Tables that are changed in place, and results that are kept by content ---------------------------------------------------------------------------------


@query("""
WITH c AS (SELECT l_partkey AS k, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) AS price, max(l_orderkey * 10 + l_linenumber) AS turn FROM lineitem WHERE l_partkey % 7 = 0 GROUP BY l_partkey)
SELECT p_partkey AS k, p_retailprice AS price, 0::BIGINT AS turn FROM part WHERE p_partkey NOT IN (SELECT k FROM c) UNION ALL SELECT * FROM c
""")
def versioned_upsert(t):
    """Prices of parts, loaded into a keyed table, and those of every seventh part's lines put in their place, in two batches of which the first comes twice."""
    parts = t("part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("price"), F.lit(0).cast("long").alias("turn"))
    lines = t("lineitem").filter("l_partkey % 7 = 0").select(F.col("l_partkey").alias("k"), F.col("l_extendedprice").alias("price"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("turn"))
    path = new_path(parts.sparkSession, "prices")
    versions.replace(parts, path, keys=["k"], buckets=8)
    middle = lines.agg(F.avg("turn")).first()[0] or 0
    for number, half in ((0, lines.filter(F.col("turn") <= middle)), (0, lines.filter(F.col("turn") <= middle)), (1, lines.filter(F.col("turn") > middle))):
        versions.upsert(half, path, "turn", batch=("lines", number))
    return versions.read(parts.sparkSession, path)


@query("""
SELECT conv_id, turn, length(text)::DOUBLE AS size, length(text) - length(replace(text, ' ', '')) AS blanks FROM conversations
""")
def cached_model(t):
    """A model's two numbers for each turn, by its text; the second half of the turns finds many of its texts in the store."""
    turns = t("conversations").select("conv_id", "turn", "text")
    path = new_path(turns.sparkSession, "model")
    model = lambda texts: pd.Series([[float(len(x)), float(x.count(" "))] for x in texts])
    found = [model_cache.with_model(half, "text", model, "array<double>", path, "e") for half in (turns.filter("turn % 2 = 0"), turns.filter("turn % 2 = 1"))]
    both = found[0].unionByName(found[1])
    return both.select("conv_id", "turn", F.col("e")[0].alias("size"), F.col("e")[1].cast("long").alias("blanks"))


@query()
def channel_evaluation(t):
    """Every hundredth part's label as two recognisers read it, against the ten nearest vectors' parts and itself, and the decision over both."""
    items = _labels(t).join(t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("producer"), F.col("p_type").alias("region")), "id")
    items = items.withColumns({"producer": F.concat_ws(" ", "producer", F.lit("Estate"), F.element_at(F.split("name", " "), 2)), "category": F.lit(None).cast("string"), "grapes": F.lit("мерло, каберне")})
    asked = items.filter("id % 100 = 0")
    text = F.concat_ws("\n", F.translate("producer", "a", "o"), F.col("label"))
    read = [asked.select(F.col("id").alias("query_id"), F.lit("first").alias("channel"), F.lit(0).alias("pos"), F.lit(True).alias("soft"), text.alias("text"))]
    read.append(asked.select(F.col("id").alias("query_id"), F.lit("second").alias("channel"), F.lit(1).alias("pos"), F.lit(False).alias("soft"), F.regexp_replace(F.concat_ws(" ", "producer", "label"), r"\d{4}", "").alias("text")))
    near = _hits(t).select("query_id", "id", "cosine").unionByName(asked.select(F.col("id").alias("query_id"), F.col("id"), F.lit(0.95).alias("cosine")))
    scored = channels.scored_channels(read[0].unionByName(read[1]), near, items)
    return channels.decided(scored, 0.5, 0.3)


@query(f"""
WITH b AS (SELECT image, id, x1 * 20 AS x1, y1 * 20 AS y1, x2 * 20 AS x2, y2 * 20 AS y2, (x2 - x1) * (y2 - y1) * 400 AS a FROM ({_BOX})),
  c AS (SELECT * FROM b WHERE id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY image ORDER BY id) = 1), p AS (SELECT image, arg_max(id, (a, -id)) AS first FROM b WHERE id % 2 = 0 GROUP BY image),
  s AS (SELECT l.image, l.id, t.id AS owner, greatest(least(l.x2, t.x2) - greatest(l.x1, t.x1), 0) * greatest(least(l.y2, t.y2) - greatest(l.y1, t.y1), 0) / l.a AS share
    FROM b l JOIN b t ON l.image = t.image AND l.id % 2 = 1 AND t.id % 2 = 0),
  o AS (SELECT * FROM s WHERE share >= 0.5 QUALIFY row_number() OVER (PARTITION BY image, id ORDER BY share DESC, owner) = 1),
  r AS (SELECT l.image, l.id, o.owner, o.share, greatest(l.x1, c.x1) AS x1, greatest(l.y1, c.y1) AS y1, least(l.x2, c.x2) AS x2, least(l.y2, c.y2) AS y2, l.a, c.a AS ca, coalesce(w.owner, p.first) AS own,
      abs(l.x1 - c.x1) <= 3 AND abs(l.y1 - c.y1) <= 3 AND abs(l.x2 - c.x2) <= 3 AND abs(l.y2 - c.y2) <= 3 AS same, l.x1 >= c.x1 - 1 AND l.y1 >= c.y1 - 1 AND l.x2 <= c.x2 + 1 AND l.y2 <= c.y2 + 1 AS within
    FROM b l JOIN o ON o.image = l.image AND o.id = l.id JOIN c ON c.image = l.image LEFT JOIN o w ON w.image = c.image AND w.id = c.id JOIN p ON p.image = l.image),
  v AS (SELECT *, greatest(x2 - x1, 0) * greatest(y2 - y1, 0) AS cut FROM r)
SELECT image, id, owner, round(share, 6) AS share, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2, round(cut / ca, 6) AS covered FROM v
WHERE owner <> own AND NOT same AND NOT within AND cut / a < 0.98 AND cut / ca <= 0.2 AND cut >= 400 AND x2 - x1 >= 4 AND y2 - y1 >= 4
""")
def box_foreign_cuts(t):
    """Of each order's first label, what labels of bottles other than its own cover."""
    larger = lambda df, name: df.withColumn(name, F.struct(*[(F.col(name)[k] * 20).alias(k) for k in ("x1", "y1", "x2", "y2")]))
    sized = lambda df, name: larger(df.withColumn("area", boxes.area(F.col(name)) * 400), name)
    labels, bottles = sized(_numbered(t).filter("id % 2 = 1"), "box"), sized(_bottles(t), "bottle_box")
    crops = labels.groupBy("image").agg(F.min_by(F.struct("box", "area"), "id").alias("c")).select("image", "c.*")
    large = bottles.groupBy("image").agg(F.max_by("bottle_id", F.struct(F.col("area").alias("a"), (-F.col("bottle_id")).alias("i"))).alias("bottle_id"))
    cuts = boxes.foreign_cuts(crops, labels, bottles, "image", large)
    return cuts.select("image", "id", "owner", F.round("owner_share", 6).alias("share"), *[F.round(F.col("cut")[k], 4).alias(k) for k in ("x1", "y1", "x2", "y2")], F.round("covered", 6).alias("covered"))


# Records and lexicons of a catalogue ---------------------------------------------------------------------------------------------------------------------


@query("""
SELECT '{"event_id":' || event_id || ',"kind":"' || event_type || '","at":{"user":' || user_id || ',"gone":null},"tags":["' || event_type || '",null],"blob":null,"nan":null}' AS json FROM events
""")
def json_events(t):
    """Events as JSON records, with private, binary and not finite values among them."""
    rows = t("events").select(
        "event_id", F.col("event_type").alias("kind"), F.struct(F.col("user_id").alias("user"), F.lit(1).alias("_secret"), F.lit(None).cast("string").alias("gone")).alias("at"), F.array("event_type", F.lit(None)).alias("tags"),
        F.encode("event_type", "UTF-8").alias("blob"), F.lit(float("nan")).alias("nan"), F.lit(5).alias("_private"),
    )
    return records.json_records(rows)


@query("""
WITH u AS (SELECT user_id AS run, event_type AS step, epoch_us(ts) / 1000.0::DOUBLE AS moment, value AS ms, event_id % 5 = 0 AS skipped FROM events),
  f AS (SELECT run, min(moment) AS first, max(moment + coalesce(ms, 0)) AS last FROM u GROUP BY run),
  k AS (SELECT run, step, arg_max(moment, (moment, ms)) AS moment, arg_max(ms, (moment, ms)) AS ms FROM u WHERE NOT skipped AND ms > 0 GROUP BY run, step)
SELECT run AS user_id, step, round(moment - first, 1) AS start_ms, round(ms, 1) AS ms FROM k JOIN f USING (run) UNION ALL SELECT run, 'total', 0.0, round(last - first, 1) FROM f
""")
def step_timings(t):
    steps = t("events").select(F.col("user_id").alias("run"), F.col("event_type").alias("step"), F.col("ts").alias("started"), F.col("value").alias("ms"), (F.col("event_id") % 5 == 0).alias("skipped"))
    return records.timing_records(steps).withColumnRenamed("run", "user_id")


@query("""
SELECT 'brand ' || substr(p_brand, 7) AS canon, p_brand AS surface, count(*) AS items FROM part GROUP BY p_brand
""")
def producer_frequency(t):
    """Brands as producers, with words of the trade before and behind them in the catalogue or on the label."""
    name = F.when(F.col("p_size") % 3 == 0, F.concat_ws(" ", F.lit("Winery"), "p_brand", "p_brand")).when(F.col("p_size") % 3 == 1, F.lit("wine 5"))
    label = F.when(F.col("p_size") % 3 > 0, F.to_json(F.struct(F.concat_ws(" ", "p_brand", F.lit("ESTATE")).alias("producer"))))
    return lexicon.producer_lexicon(t("part").select(F.col("p_partkey").alias("id"), name.alias("producer"), label.alias("label_json")), ("winery", "Estate", "wine", "5"))


@query("""
WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS g FROM part)
SELECT g AS surface, count(*) AS items FROM w WHERE length(g) >= 3 GROUP BY g
""")
def grape_frequency(t):
    """The words of parts' names as grapes, from a text or from the label's JSON, as a list there or not."""
    first, second = F.element_at(F.split("p_name", " "), 1), F.element_at(F.split("p_name", " "), 2)
    grapes = F.when(F.col("p_size") % 2 == 0, F.concat(first, F.lit(" • "), second, F.lit(".")))
    label = F.when(F.col("p_size") % 4 == 1, F.to_json(F.struct(F.lit("").alias("cupage"), F.concat_ws(" - ", first, second).alias("coupage")))).when(F.col("p_size") % 4 == 3, F.to_json(F.struct(F.array(first, second).alias("cupage"))))
    return lexicon.grape_lexicon(t("part").select(F.col("p_partkey").alias("id"), grapes.alias("grapes"), label.alias("label_json"))).select("surface", "items")
