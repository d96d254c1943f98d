"""An index of spellings of names, in which the first producer to claim a key keeps it, with aliases, and links by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkfold.functions.text import unicode_form
from linkfold.operators.linking import link_names

# Words before a name that aren't part of it, Cyrillic letters that are read as Latin ones, and pairs of spellings.
PREFIXES = r"(?iu)^(фото:\s*|команда\s+винодельни\s+|семейная\s+винодельня\s+|винный\s+кооператив\s+|винодельня\s+|вина\s+винодельни\s+|вина\s+|усадьба\s+)"
CYRILLIC, LATIN = "авекмнорстху", "avekmnorsthu"
LEFT_OUT, RESPELLED = ("vinodelnya ", "usadba "), (("chateau ", "shato "), ("shato ", "chateau "))


def plain_name(name: Column) -> Column:
    """A name in lower case with single blanks between its letters and digits, without prefixes and hard and soft signs; empty for null."""
    t = F.lower(F.trim(F.regexp_replace(unicode_form(F.coalesce(name, F.lit("")), "NFKC"), r"(?U)^\s+|\s+$", "")))
    t = F.regexp_replace(F.replace(F.translate(t, "ё—–", "е  "), F.lit("&"), F.lit(" and ")), PREFIXES, "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[ъь]", ""), "[^0-9a-zа-яё]+", " "))


def latin_name(name: Column) -> Column:
    """A plain name with those Cyrillic letters as Latin ones that look or sound like them."""
    return F.translate(plain_name(name), CYRILLIC, LATIN)


def slug_name(url: Column) -> Column:
    """The plain name that the last part of an address spells."""
    return plain_name(F.translate(F.regexp_extract(F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", ""), "[^/]*$", 0), "_-", "  "))


def spellings(name: Column, url: Column) -> Column:
    """Up to fifteen distinct keys of a name and its address, without empty ones."""
    keys = F.array(plain_name(name), latin_name(name), slug_name(url))

    def variants(k: Column) -> Column:
        short = k
        for word in LEFT_OUT:
            short = F.replace(short, F.lit(word), F.lit(""))
        other = [F.replace(k, F.lit(a), F.lit(b)) for a, b in RESPELLED]
        return F.array(k, *[F.trim(v) for v in (short, *other, F.replace(k, F.lit(" and "), F.lit(" ")))])

    return F.array_distinct(F.filter(F.flatten(F.transform(keys, variants)), lambda k: k != ""))


def key_index(producers: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, id) of producers (id, name, url, pos) and aliases (alias, target, pos): one row a key.

    Of producers with a common key the one with the smallest pos, then id, keeps it.  Aliases count in the order of pos: one whose
    target is a key by then, of a producer or of an alias before it, points both its plain and its Latin spelling there, whoever had
    them, and the spelling without " and " if nobody has it; others are without effect.  Rows with a null id, or null names, have no keys.

    Producers' keys are grouped; only aliases, which are written by hand, and the entries that they name go through the driver.
    """
    claims = producers.filter("id is not null").select("id", "pos", F.explode(spellings(F.col("name"), F.col("url"))).alias("key"))
    claimed = claims.groupBy("key").agg(F.min(F.struct("pos", "id")).alias("first")).select("key", "first.id")
    alias, target = F.col("alias"), F.col("target")
    loose = F.trim(F.replace(plain_name(alias), F.lit(" and "), F.lit(" ")))
    named = aliases.filter("alias is not null and target is not null").select("pos", plain_name(alias).alias("plain"), latin_name(alias).alias("latin"), loose.alias("loose"), plain_name(target).alias("target"))
    written = named.orderBy("pos", "plain", "target").collect()
    if not written:
        return claimed
    spark = producers.sparkSession
    asked = spark.createDataFrame([(k,) for k in sorted({k for r in written for k in (r["plain"], r["latin"], r["loose"], r["target"])})], "key string")
    known = {r["key"]: r["id"] for r in claimed.join(F.broadcast(asked), "key").collect()}
    changed = {}
    for r in written:
        if r["target"] in known:
            owner = known[r["target"]]
            for key in (r["plain"], r["latin"]):
                known[key] = changed[key] = owner
            if r["loose"] not in known:
                known[r["loose"]] = changed[r["loose"]] = owner
    changed.pop("", None)
    table = spark.createDataFrame(sorted(changed.items()), f"key string, id {claimed.schema['id'].dataType.simpleString()}")
    return claimed.join(F.broadcast(table.select("key")), "key", "left_anti").unionByName(table)


def links_by_key(names: DataFrame, index: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, id): distinct names (name) with the producer that a spelling of theirs leads to, by the index, or as a raw alias; null without one.

    The plain name is looked up first, then the Latin one, then that without " and "; of each first the key, then the alias.
    """
    name = F.col("name")
    tried = F.array(plain_name(name), latin_name(name), F.replace(plain_name(name), F.lit(" and "), F.lit(" ")))
    asked = names.filter("name is not null").select("name").distinct()
    each = asked.select("name", F.posexplode(tried).alias("turn", "key")).filter("key != ''")
    by_alias = aliases.groupBy(F.col("alias").alias("key")).agg(F.max_by("target", "pos").alias("target")).select("key", plain_name(F.col("target")).alias("to"))
    raw = by_alias.join(index.select(F.col("key").alias("to"), F.col("id").alias("alias_id")), "to").select("key", "alias_id")
    found = each.join(index, "key", "left").join(F.broadcast(raw), "key", "left").withColumn("id", F.coalesce("id", "alias_id")).filter("id is not null")
    best = found.groupBy("name").agg(F.min_by("id", "turn").alias("id"))
    return asked.join(best, "name", "left")


def resolve_names(names: DataFrame, index: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, id, how): links by key first (how = key), and for the other names by containment or shared tokens, see ``linking.link_names``."""
    by_key = links_by_key(names, index, aliases)
    rest = link_names(by_key.filter("id is null").select("name"), index.select("id", F.col("key").alias("known_name")))
    return by_key.filter("id is not null").select("name", "id", F.lit("key").alias("how")).unionByName(rest.select("name", "id", "how"))
