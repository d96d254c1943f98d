"""Catalogue search: filters, pages, facets, lookups and enrichment."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkfold.functions.text import like_substring, word_start


def as_list(value: str | list[str] | None) -> list[str]:
    """A list parameter: split at commas, trimmed, without empties."""
    parts = value if isinstance(value, list) else (value or "").split(",")
    return [p.strip() for x in parts for p in str(x).split(",") if p.strip()]


def apply_filters(df: DataFrame, filters: dict[str, list] | None = None, q: str | None = None, text_columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose columns hold one of the listed values each (an empty list filters nothing) and, if ``q`` is given, a word that starts with it."""
    for column, values in (filters or {}).items():
        if values:
            df = df.filter(F.col(column).isin(*values))
    if q and q.strip():
        df = df.filter(reduce(or_, [F.coalesce(word_start(F.col(c), q.strip()), F.lit(False)) for c in text_columns]))
    return df


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of a total order; ``limit`` is held between 1 and 100."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(100, max(1, limit)))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) for each column's values that aren't null or blank, in one pass over the table."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    rows = df.select(pairs.alias("p")).select("p.*").filter(F.col("value").isNotNull() & (F.trim("value") != ""))
    return rows.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def id_or_substring(df: DataFrame, id_column: str, text_column: str, q: str) -> DataFrame:
    """Digits ask for an id, anything else for a substring in any case."""
    q = q.strip()
    return df.filter(F.col(id_column) == int(q)) if q.isdigit() else df.filter(like_substring(F.col(text_column), q))


def enrich(rows: DataFrame, *dimensions: tuple[DataFrame, str, str]) -> DataFrame:
    """``rows`` with the columns of each (dimension, its key, the rows' key); rows without a match keep nulls.  A dimension's keys are unique."""
    for dimension, key, own in dimensions:
        rows = rows.join(dimension.withColumnRenamed(key, own), own, "left")
    return rows


def latest_by_key(df: DataFrame, key: Column, value: str, order: str) -> DataFrame:
    """(key, value): the value of the last row of each key; rows with a null value don't count."""
    return df.filter(F.col(value).isNotNull()).groupBy(key.alias("key")).agg(F.max_by(value, order).alias("value"))


def deduplicated(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The first row of each distinct tuple of ``columns``, with the count of its rows; nulls are equal."""
    rest = [c for c in df.columns if c not in columns]
    first = F.min_by(F.struct(*rest), order).alias("first")
    return df.groupBy(*columns).agg(first, F.count(F.lit(1)).alias("copies")).select(*columns, "first.*", "copies")


def without_held_out(df: DataFrame, held_out: DataFrame, text: str) -> DataFrame:
    """Rows whose content isn't on the exclusion list, by SHA-256."""
    listed = held_out.select(F.sha2(F.col(text), 256).alias("_sha")).distinct()
    return df.join(listed, F.sha2(df[text], 256) == listed["_sha"], "left_anti")


def cards(catalog: DataFrame, images: DataFrame, id_column: str, name: str, slug: str, photo: str, folder: str = "/media", heavy: str | None = None) -> DataFrame:
    """(id, name, slug, photo_url): catalogue rows as cards; a missing photo is that of ``images`` (key, value) under the slug.

    ``heavy`` adds a large column, which isn't read otherwise.
    """
    known = images.select(F.col("key").alias("_key"), F.col("value").alias("_file"))
    rows = catalog.join(known, F.col(slug) == F.col("_key"), "left")
    file = F.coalesce(F.nullif(F.trim(photo), F.lit("")), F.col("_file"))
    return rows.select(F.col(id_column).alias("id"), F.col(name).alias("name"), F.col(slug).alias("slug"), F.concat(F.lit(f"{folder}/"), file).alias("photo_url"), *([heavy] if heavy else []))


def distinct_names(catalog: DataFrame, column: str, bad: Column | None = None) -> DataFrame:
    """(name): a column's distinct values, trimmed, without empty ones and those that ``bad`` holds for (a column of the name)."""
    names = catalog.select(F.trim(column).alias("name")).filter("name != ''").distinct()
    return names.filter(~F.coalesce(bad, F.lit(False))) if bad is not None else names


def reference_entities(catalog: DataFrame) -> DataFrame:
    """(id, label, color, type, vintage_year, foundation_year) of ``catalog`` (id, label, label_color, label_type, vintage_year, foundation_year, label_json).

    Empty columns are filled from the recognised label's JSON; years from 1950 to 2100 count.
    """
    told = F.from_json("label_json", "struct<color: string, type: string, vintage_year: string, foundation_year: string>")
    filled = lambda own, name: F.coalesce(F.nullif(F.trim(own), F.lit("")), F.nullif(F.trim(told[name]), F.lit("")))
    year = lambda name: F.coalesce(F.col(name).cast("string"), told[name]).try_cast("int")
    between = lambda y: F.when(y.between(1950, 2100), y)
    return catalog.select(
        "id", F.trim(F.coalesce("label", F.lit(""))).alias("label"), filled(F.col("label_color"), "color").alias("color"), filled(F.col("label_type"), "type").alias("type"),
        between(year("vintage_year")).alias("vintage_year"), between(year("foundation_year")).alias("foundation_year"),
    )
