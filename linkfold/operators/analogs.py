"""Analogous items by weighted criteria, with the cosine as a fallback."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkfold.functions.classes import cupage, grapes_match, split_grapes
from linkfold.functions.text import canonical, distinct_words, entity_form, is_bad_producer
from linkfold.operators.lexicon import CATEGORY, TYPE, grape_lexicon, lexicon_table
from linkfold.operators.spread import spread
from linkfold.operators.tables import written
from linkfold.operators.torn_forms import torn_hits

# Weights of the criteria, what a type that is near or unknown, or a conflicting colour, is worth, and the parts of a grape's share.
WEIGHTS = {"producer": 0.35, "grape": 0.30, "category": 0.20, "type": 0.15}
TYPE_NEAR, TYPE_UNKNOWN, COLOR_CONFLICT = 0.4, 0.5, 0.75
GRAPE_RECALL, GRAPE_SHARE = 0.75, 0.25
RANK_MISSING = 10_000
CATEGORY_ORDER = tuple(c for c, _ in CATEGORY)
TYPE_ORDER = tuple(c for c, _ in TYPE)
#: Distinct criteria that are broadcast at most (some 20 MB); more are ranked in blocks.
BLOCK_QUERIES = 50_000
_LIST = "array<string>"


def canon_rank(column: str, order: tuple[str, ...]) -> Column:
    """A canonical form's place in its lexicon; forms that are missing come last."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return F.when(place > 0, place - 1).otherwise(RANK_MISSING)


def _listed(df: DataFrame, name: str, plural: str) -> Column:
    """A column of lists: ``plural``, or the single values of ``name``; null counts as empty."""
    values = F.col(plural) if plural in df.columns else F.filter(F.array(F.col(name)), lambda x: x.isNotNull())
    return F.coalesce(values, F.array().cast(_LIST))


def rank_analogs(criteria: DataFrame, catalog: DataFrame, n: int = 10, cosine: DataFrame | None = None, category_order: tuple[str, ...] = CATEGORY_ORDER, type_order: tuple[str, ...] = TYPE_ORDER) -> DataFrame:
    """(query_id, id, score, hits, rank): the ``n`` best items of ``catalog`` (id, producer, grapes, category, type) for each row of ``criteria`` (query_id,
    producer or producers, grapes, category or categories, type; null or empty where nothing is asked; exclude_id).

    Every item counts, one whose type is unknown too; what scores 0 is left out.  A grape's share is of the item's grapes, or of its n_grapes where there is such a
    column.  Ties go to the category's and the type's order, the cosine (query_id, id,
    cosine), the number of hits and the smaller id.

    Items that agree in producer, grapes, category and type score alike, and so do queries that ask for the same.  So each distinct set of criteria meets each kind of
    items once, by the kind's smallest id; the ``n`` + 1 best kinds hold the ``n`` + 1 best items, of which a query may exclude one.  Items with a cosine are scored beside
    them.  Distinct criteria are broadcast in blocks of bounded size, and each task keeps the best kinds of each before anything is shuffled.
    """
    asked = criteria.select(
        "query_id", "exclude_id", _listed(criteria, "producer", "producers").alias("q_producers"), F.coalesce("grapes", F.array().cast(_LIST)).alias("q_grapes"),
        _listed(criteria, "category", "categories").alias("q_categories"), F.col("type").alias("q_type"), canon_rank("type", type_order).alias("q_rank"),
    )
    asks = lambda c: (F.size(c) > 0).cast("double")
    total = WEIGHTS["producer"] * asks("q_producers") + WEIGHTS["grape"] * asks("q_grapes") + WEIGHTS["category"] * asks("q_categories") + WEIGHTS["type"] * F.col("q_type").isNotNull().cast("double")
    asked = asked.withColumns({"asked": total, "asks": F.to_json(F.struct("q_producers", "q_grapes", "q_categories", "q_type"))})
    same = asked.dropDuplicates(["asks"]).withColumns({"query_id": F.col("asks"), "exclude_id": F.lit(None).cast(catalog.schema["id"].dataType)})
    items = catalog.select("id", "producer", F.array_sort(F.coalesce("grapes", F.array().cast(_LIST))).alias("grapes"), "category", "type", canon_rank("type", type_order).alias("type_rank"), canon_rank("category", category_order).alias("category_rank"), (F.col("n_grapes") if "n_grapes" in catalog.columns else F.size(F.coalesce("grapes", F.array().cast(_LIST)))).alias("n_grapes"))
    kind = [F.col(c) for c in ("producer", "grapes", "n_grapes", "category", "type")]
    alike = Window.partitionBy(*kind).orderBy("id")
    few = items.withColumn("_of_kind", F.row_number().over(alike)).filter(F.col("_of_kind") <= n + 1)
    # a kind has its smallest id, by which it is ranked, and the ids of its first items; its number stays, as it is written
    kinds = few.groupBy(*kind, "type_rank", "category_rank").agg(F.min("id").alias("id"), F.collect_list("id").alias("ids")).withColumn("kind", F.monotonically_increasing_id())
    kinds = spread(written(kinds, "kinds"))
    tied = [F.desc("exact"), "category_rank", "type_rank"]
    blocks = max(1, math.ceil(same.count() / BLOCK_QUERIES))
    best = None
    for b in range(blocks):
        mine = lambda df: df.filter(F.pmod(F.xxhash64("asks"), F.lit(blocks)) == b) if blocks > 1 else df
        block = mine(asked)
        met = _ranked(_scored(kinds.drop("ids").join(F.broadcast(mine(same)), F.lit(True)), "kind"), [*tied, F.desc("hits"), "id"], n + 1)
        met = met.drop("rank", "id").withColumnRenamed("query_id", "asks").join(kinds.select("kind", "ids"), "kind").withColumn("id", F.explode("ids"))
        part = met.join(block.select("query_id", "exclude_id", "asks"), "asks").filter(~F.col("id").eqNullSafe(F.col("exclude_id")))
        part = _ranked(part.select("query_id", "id", "exact", "hits", "category_rank", "type_rank"), [*tied, F.desc("hits"), "id"], n)
        if cosine is not None:
            near = _scored(cosine.select("query_id", "id", "cosine").join(block, "query_id").join(items, "id"), "cosine")
            both = part.drop("rank").withColumn("cosine", F.lit(None).cast("double")).unionByName(near)
            both = both.groupBy("query_id", "id", "exact", "hits", "category_rank", "type_rank").agg(F.max("cosine").alias("cosine"))
            part = _ranked(both, [*tied, F.coalesce("cosine", F.lit(-1.0)).desc(), F.desc("hits"), "id"], n).drop("cosine")
        best = part if best is None else best.unionByName(part)
    return best.select("query_id", "id", F.round("exact", 6).alias("score"), "hits", "rank")


def _ranked(scored: DataFrame, order: list, n: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= n)


def _scored(pairs: DataFrame, *kept: str) -> DataFrame:
    """Pairs of an item and a query's criteria with exact, the score as it is ranked by, and hits; without the excluded item."""
    pairs = pairs.filter(~F.col("id").eqNullSafe(F.col("exclude_id")))
    zero_one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    producer, category = zero_one(F.array_contains("q_producers", F.col("producer"))), zero_one(F.array_contains("q_categories", F.col("category")))
    conflict = (F.size("q_categories") > 0) & F.col("category").isNotNull() & (category == 0)
    pairs = pairs.withColumn("grape_hits", F.size(F.filter("q_grapes", lambda q: F.exists("grapes", lambda g: grapes_match(q, g)))))
    share = F.least(F.lit(1.0), F.col("grape_hits") / F.greatest("n_grapes", F.lit(1)))
    grape = F.when(F.col("grape_hits") > 0, GRAPE_RECALL * F.col("grape_hits") / F.size("q_grapes") + GRAPE_SHARE * share).otherwise(0.0)
    kind = F.when(F.col("q_type").isNull(), 0.0).when(F.col("type").isNull(), TYPE_UNKNOWN).when(F.col("type") == F.col("q_type"), 1.0)
    kind = kind.when(F.abs(F.col("type_rank") - F.col("q_rank")) <= 1, TYPE_NEAR).otherwise(0.0)
    raw = WEIGHTS["producer"] * producer + WEIGHTS["grape"] * grape + WEIGHTS["category"] * category + WEIGHTS["type"] * kind
    hits = producer + (F.col("grape_hits") > 0).cast("double") + category + zero_one(F.col("type") == F.col("q_type"))
    exact = F.col("raw") / F.col("asked") * F.when(conflict, COLOR_CONFLICT).otherwise(1.0)
    scored = pairs.withColumns({"raw": raw, "hits": hits.cast("int")}).filter("raw > 0").withColumn("exact", exact)
    return scored.select("query_id", "id", "exact", "hits", "category_rank", "type_rank", *kept)


def cosine_fallback(hits: DataFrame, rejected: DataFrame, n: int = 5, least: float = 0.70) -> DataFrame:
    """The ``n`` nearest of ``hits`` (query_id, id, cosine) over a cosine, without rejected ones (query_id, id)."""
    left = hits.join(rejected.select("query_id", "id"), ["query_id", "id"], "left_anti").filter(F.col("cosine") > least)
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))).filter(F.col("rank") <= n)


def find_analogs(criteria: DataFrame, catalog: DataFrame, hits: DataFrame, rejected: DataFrame, n: int = 10, fallback: int = 5, least: float = 0.70, **orders: tuple[str, ...]) -> DataFrame:
    """(query_id, id, score, rank, source): the analogs of each query by its criteria, and for queries without any the nearest of ``hits`` (query_id, id, cosine).

    Only the nearest leave out what is rejected (query_id, id), the excluded item and ids that the catalogue doesn't have; a rejected item may still be an analog
    by criteria.  ``orders`` are those of ``rank_analogs``.
    """
    hits = hits.select("query_id", "id", "cosine")
    found = rank_analogs(criteria, catalog, n, hits, **orders).select("query_id", "id", "score", "rank", F.lit("criteria").alias("source"))
    never = rejected.select("query_id", "id").unionByName(criteria.select("query_id", F.col("exclude_id").alias("id")))
    open_hits = hits.join(catalog.select("id").distinct(), "id", "left_semi").join(criteria.select("query_id"), "query_id", "left_semi").join(found.select("query_id").distinct(), "query_id", "left_anti")
    near = cosine_fallback(open_hits, never, fallback, least)
    return found.unionByName(near.select("query_id", "id", F.col("cosine").alias("score"), "rank", F.lit("embedding_cosine").alias("source")))


def item_criteria(winners: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, exclude_id, producers, grapes, categories, type): what the found items (query_id, id) ask for, themselves excluded; none for an id that ``catalog`` lacks."""
    listed = lambda c: F.filter(F.array(F.col(c)), lambda x: x.isNotNull())
    own = winners.select("query_id", "id").join(catalog, "id")
    return own.select("query_id", F.col("id").cast("long").alias("exclude_id"), listed("producer").alias("producers"), F.coalesce("grapes", F.array().cast(_LIST)).alias("grapes"), listed("category").alias("categories"), "type")


def dispatched(queries: DataFrame, lexicon: DataFrame, catalog: DataFrame, hits: DataFrame, rejected: DataFrame, aliases: DataFrame | None = None, n: int = 10, fallback: int = 5, least: float = 0.70) -> DataFrame:
    """(query_id, id, score, rank, source) of queries (query_id, text, winner_id): by the fields of the winner where there is one, else by what the text names.

    source: matched_item, criteria or embedding_cosine.  A winner that the catalogue lacks has no analogs.
    """
    by_text = text_criteria(queries.filter("winner_id is null").select("query_id", "text"), lexicon, aliases)
    by_item = item_criteria(queries.filter("winner_id is not null").select("query_id", F.col("winner_id").alias("id")), catalog)
    found = find_analogs(by_text.unionByName(by_item), catalog, hits, rejected, n, fallback, least)
    known = queries.select("query_id", F.col("winner_id").isNotNull().alias("_won"))
    source = F.when(F.col("_won") & (F.col("source") == "criteria"), "matched_item").otherwise(F.col("source"))
    return found.join(known, "query_id").select("query_id", "id", "score", "rank", source.alias("source"))


def majority_aliases(votes: DataFrame, least: int, share: float) -> DataFrame:
    """(alias, canon) of votes (alias, canon), a row each: the form that most votes give an alias, the first by alphabet of equals, with ``least`` votes and a ``share`` of all."""
    counted = votes.groupBy("alias", "canon").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("alias").agg(F.min_by("canon", F.struct(-F.col("n"), "canon")).alias("canon"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return best.filter((F.col("n") >= least) & (F.col("n") / F.col("total") >= share)).select("alias", "canon")


def grape_aliases(items: DataFrame) -> DataFrame:
    """(alias, canon): other names of grapes, learned from items (grapes, label_json) that name one grape in the catalogue and one on the label."""
    one = lambda c: F.when(F.size(c) == 1, canonical(c[0]))
    votes = items.select(one(cupage(F.col("label_json"))).alias("alias"), one(split_grapes(F.col("grapes"))).alias("canon"))
    return majority_aliases(votes.filter("alias != '' and canon != '' and alias != canon"), 2, 0.6)


def _producers(items: DataFrame) -> DataFrame:
    """items with canon, their producer's canonical form; without those whose producer is no name or shorter than four letters."""
    named = items.withColumn("_name", distinct_words(F.trim(F.coalesce("producer", F.lit("")))))
    return named.withColumn("canon", canonical(F.col("_name"))).filter(~is_bad_producer(entity_form(F.col("_name"))) & (F.length("canon") >= 4)).drop("_name")


def producer_aliases(items: DataFrame) -> DataFrame:
    """(alias, canon): other names of producers, learned from the labels of items (producer, region, label_json).

    A name that is a producer's or a region's, or that holds a word for a colour or a type, is no alias.
    """
    known = _producers(items)
    read = known.withColumn("_read", distinct_words(F.trim(F.coalesce(F.get_json_object("label_json", "$.producer"), F.lit("")))))
    votes = read.filter(~is_bad_producer(entity_form(F.col("_read")))).select(canonical(F.col("_read")).alias("alias"), "canon").filter("alias != canon and length(alias) >= 4")
    taken = known.select(F.col("canon").alias("alias")).unionByName(items.select(canonical(F.col("region")).alias("alias")))
    names = majority_aliases(votes, 1, 0.8).join(taken, "alias", "left_anti")
    worded = torn_hits(names.select(F.col("alias").alias("id"), F.col("alias").alias("text")), _fixed_lexicons(items.sparkSession))
    return names.join(worded.select(F.col("id").alias("alias")), "alias", "left_anti")


def analog_lexicon(items: DataFrame) -> DataFrame:
    """(lexicon, canon, canon_pos, form, n_words): the producers, with their aliases, and the grapes that items (id, producer, grapes, region, label_json) name."""
    canons = _producers(items).select("canon").distinct()
    producers = canons.select("canon", F.col("canon").alias("form")).unionByName(producer_aliases(items).select("canon", F.col("alias").alias("form"))).withColumn("lexicon", F.lit("producer"))
    grapes = grape_lexicon(items.select("id", "grapes", "label_json")).select("canon", F.lower("surface").alias("form"), F.lit("grape").alias("lexicon"))
    return producers.unionByName(grapes).select("lexicon", "canon", F.lit(0).alias("canon_pos"), "form", F.size(F.split("form", "[ -]+")).alias("n_words"))


def _fixed_lexicons(spark: SparkSession) -> DataFrame:
    return lexicon_table(spark, "category", CATEGORY).unionByName(lexicon_table(spark, "type", TYPE))


def _first_canons(texts: DataFrame) -> DataFrame:
    """(id, category, type) of texts (id, lexicon, place, text): of the first text, by place, that names one of a lexicon's canonical forms, the first of these in order."""
    read = texts.select("id", "lexicon", "place", F.when(F.col("lexicon") == "type", _joined(F.col("text"))).otherwise(F.col("text")).alias("text")).filter("text != ''")
    each = written(read.select("lexicon", "text").distinct(), "texts")  # equal texts are read once
    hits = torn_hits(each.select(F.struct("lexicon", "text").alias("id"), "text"), _fixed_lexicons(texts.sparkSession)).filter("lexicon = id.lexicon")
    named = hits.groupBy("lexicon", "id.text").agg(F.min_by("canon", "canon_pos").alias("canon"), F.min("canon_pos").alias("canon_pos"))
    first = lambda x: F.min_by(F.when(F.col("lexicon") == x, F.col("canon")), F.when(F.col("lexicon") == x, F.struct("place", "canon_pos"))).alias(x)
    return read.join(named, ["lexicon", "text"]).groupBy("id").agg(first("category"), first("type"))


def _joined(text: Column) -> Column:
    """A text whose ``semi`` and ``extra`` are one word with the Latin word behind them."""
    return F.regexp_replace(text, r"(?iU)\b(semi|extra)[\s\-]+(?=[a-z])", "$1")


def catalog_canons(catalog: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(id, producer, grapes, n_grapes, category, type) of ``catalog`` (id, name, producer, category, color, type, grapes, label, label_json): canonical criteria.

    The category is the first colour that the category, the recognised colour or the name says; the type the first that the recognised type, the name or the label
    does.  Grapes are those of the catalogue and of the label's JSON (where there is such a column), in canonical forms of three letters or more, each replaced by
    what ``aliases`` (alias, canon; ``grape_aliases``) gives; n_grapes counts those of the catalogue, or of the label where it has none.
    """
    label = F.col("label_json") if "label_json" in catalog.columns else F.lit(None).cast("string")
    sources = [("category", c) for c in ("category", "color", "name")] + [("type", c) for c in ("type", "name", "label")]
    texts = F.array(*[F.struct(F.lit(x).alias("lexicon"), F.lit(k).alias("place"), F.col(c).cast("string").alias("text")) for k, (x, c) in enumerate(sources)])
    canons = _first_canons(catalog.select("id", F.explode(texts).alias("t")).select("id", "t.*"))
    own, read = split_grapes(F.col("grapes")), cupage(label)
    grapes, shown = F.transform(F.concat(own, read), canonical), F.when(F.size(own) > 0, F.size(own)).otherwise(F.size(read))
    rows = catalog.select("id", F.nullif(canonical(distinct_words(F.trim("producer"))), F.lit("")).alias("producer"), grapes.alias("_grapes"), shown.alias("n_grapes"))
    each = rows.select("id", F.explode("_grapes").alias("alias"))
    canon = F.col("alias") if aliases is None else F.coalesce("canon", "alias")
    each = each if aliases is None else each.join(aliases, "alias", "left")
    named = each.select("id", canon.alias("g")).filter("length(g) >= 3").groupBy("id").agg(F.sort_array(F.collect_set("g")).alias("grapes"))
    return rows.drop("_grapes").join(named, "id", "left").join(canons, "id", "left").select("id", "producer", F.coalesce("grapes", F.array().cast(_LIST)).alias("grapes"), "n_grapes", "category", "type")


def text_criteria(texts: DataFrame, lexicon: DataFrame, aliases: DataFrame | None = None, most_producers: int = 3) -> DataFrame:
    """(query_id, exclude_id, producers, grapes, categories, type) of ``texts`` (query_id, text): what a recognised text asks for, torn or in another script too.

    lexicon: the forms of the lexicons ``producer`` and ``grape`` (``analog_lexicon``); aliases: alias, canon of grapes (``grape_aliases``).

    Producers are taken from the longest form down, none within a form taken before, at most ``most_producers``.  A grape that is a word for a colour or a type, that
    stands within another one found, or that begins another one, is left out.  All colours that the text names count, and the first type in the lexicon's order.
    Null and empty texts ask for nothing.
    """
    spark = texts.sparkSession
    fixed = _fixed_lexicons(spark)
    read = texts.select(F.col("query_id").alias("id"), "text")
    table = lexicon.select("lexicon", "canon", "canon_pos", "form", "n_words").filter(F.col("lexicon").isin("producer", "grape"))
    hits = torn_hits(read, table.unionByName(fixed.filter("lexicon = 'category'"))).select("id", "lexicon", "canon", "canon_pos", "form")
    kinds = torn_hits(read.withColumn("text", _joined(F.col("text"))), fixed.filter("lexicon = 'type'")).select("id", "lexicon", "canon", "canon_pos", "form")
    colors = fixed.select(canonical(F.col("form")).alias("canon"))
    hits = hits.filter("lexicon != 'grape'").unionByName(hits.filter("lexicon = 'grape'").join(F.broadcast(colors), "canon", "left_anti").select(hits.columns)).unionByName(kinds)
    if aliases is None:
        hits = hits.withColumn("key", F.col("canon"))
    else:
        hits = hits.join(aliases.select(F.col("alias").alias("canon"), F.col("canon").alias("key"), F.lit("grape").alias("lexicon")), ["lexicon", "canon"], "left").withColumn("key", F.coalesce("key", "canon"))
    of = lambda x, *c: F.sort_array(F.collect_set(F.when(F.col("lexicon") == x, F.struct(*c))))
    found = hits.groupBy("id").agg(
        of("producer", (-F.length("form")).alias("l"), "form", "canon").alias("p"), of("grape", "canon_pos", "canon", "key").alias("g"), of("category", "canon_pos", "canon").alias("c"), of("type", "canon_pos", "canon").alias("t"),
    )
    plain = F.transform("p", lambda x: F.struct(canonical(x["form"]).alias("form"), x["canon"].alias("canon")))
    fits = lambda taken, x: (F.size(taken) < most_producers) & ~F.exists(taken, lambda y: (y["canon"] == x["canon"]) | y["form"].contains(x["form"]))
    taken = F.aggregate(plain, F.array().cast("array<struct<form:string,canon:string>>"), lambda acc, x: F.when(fits(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    around = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    whole = F.filter("g", lambda x: ~F.exists("g", lambda y: (y["canon"] != x["canon"]) & around(y["canon"]).contains(around(x["canon"]))))
    found = found.select("id", F.transform(taken, lambda x: x["canon"]).alias("producers"), F.array_distinct(F.transform(whole, lambda x: x["key"])).alias("keys"), F.transform("c", lambda x: x["canon"]).alias("categories"), F.get("t", F.lit(0))["canon"].alias("type"))
    begun = F.filter("keys", lambda x: ~F.exists("keys", lambda y: (F.length(F.split(x, " ")[0]) >= 5) & y.startswith(F.concat(x, F.lit(" ")))))
    rows = texts.select("query_id").distinct().join(found.withColumnRenamed("id", "query_id"), "query_id", "left")
    none = F.array().cast(_LIST)
    return rows.select("query_id", F.lit(None).cast("long").alias("exclude_id"), F.coalesce("producers", none).alias("producers"), F.coalesce(begun, none).alias("grapes"), F.coalesce("categories", none).alias("categories"), "type")


def rescored(texts: DataFrame, lexicon: DataFrame, catalog: DataFrame, hits: DataFrame, rejected: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The analogs of stored queries from their texts (query_id, text): criteria are read again and ranked against the catalogue as it is now."""
    return find_analogs(text_criteria(texts, lexicon, aliases), catalog, hits, rejected)
