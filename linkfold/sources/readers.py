"""Readers of catalogue files, sitemaps, manifests and stored vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SITEMAP_SCHEMA = T.StructType([
    T.StructField("loc", T.StringType()),
    T.StructField("lastmod", T.StringType()),
    T.StructField("image:image", T.StructType([T.StructField(f"image:{c}", T.StringType()) for c in ("loc", "title", "caption")])),
])


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def read_catalog_csv(spark: SparkSession, path: str, columns: list[str], key: str) -> DataFrame:
    """A CSV with a header, in the given column names: trimmed, empty values null, equal rows once, rows without a key dropped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, multiLine=True, escape='"')
    rows = rows.select(*[blank_to_null(F.translate(c, "﻿", "")).alias(c) for c in columns]).filter(F.col(key).isNotNull())
    return rows.dropDuplicates(columns)


def url_slug(url: Column) -> Column:
    """The last segment of a URL's path, without query, fragment or a slash at the end; null for none."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[^:]*://[^/]*", "")
    return F.nullif(F.regexp_extract(path, r"([^/]+)/*$", 1), F.lit(""))


def url_file(url: Column) -> Column:
    """The decoded file name of a URL."""
    return F.try_url_decode(url_slug(url))


def lenient_timestamp(raw: Column) -> Column:
    """An ISO-8601 time, null where it isn't one."""
    return raw.try_cast("timestamp")


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(loc, slug, lastmod, image_loc, image_file, image_title, image_caption) of a sitemap's entries that have a location."""
    rows = spark.read.format("xml").option("rowTag", "url").schema(SITEMAP_SCHEMA).load(path)
    image = lambda c: blank_to_null(F.col(f"`image:image`.`image:{c}`"))
    rows = rows.select(blank_to_null(F.col("loc")).alias("loc"), lenient_timestamp(F.col("lastmod")).alias("lastmod"), *[image(c).alias(f"image_{c}") for c in ("loc", "title", "caption")])
    return rows.filter("loc is not null").withColumns({"slug": url_slug(F.col("loc")), "image_file": url_file(F.col("image_loc"))})


def producer_name(title: Column, caption: Column, slug: Column) -> Column:
    """A producer's name: title, else caption, else the slug in title case, without a leading word for a winery and quotes."""
    raw = F.coalesce(blank_to_null(title), blank_to_null(caption), F.initcap(F.translate(slug, "-_", "  ")))
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?iu)^(винодельня|винный дом|усадьба|winery)\s+", ""), "[«»\"“”]", ""))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, image_path, problem) of a tab-separated manifest with a header; problem is null for valid rows."""
    schema = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("image_path", T.StringType())])
    rows = spark.read.csv(path, schema=schema, sep="\t", header=True, enforceSchema=False)
    repeated = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(repeated, "query_id", "left")
    problem = F.when(~F.coalesce(F.col("query_id").rlike("^[A-Za-z0-9._-]+$"), F.lit(False)), "bad_id").when(F.col("_n") > 1, "repeated_id")
    return rows.withColumn("problem", problem.when(blank_to_null(F.col("image_path")).isNull(), "no_path")).drop("_n")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query_id string, image_path string, image_sha256 string, predicted_slug string, latency_ms bigint").json(path)


def sniffed_extension(content: Column) -> Column:
    """The extension of an image by its first bytes; null for another kind."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "jpg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.rlike("^47494638(37|39)61"), "gif")
        .when(head.rlike("^52494646.{8}57454250"), "webp").when(head.rlike("^.{8}66747970(68656963|68656978|6D696631)"), "heic").when(head.startswith("424D"), "bmp")
    )


def file_stem(name: Column) -> Column:
    """A file's name in lower case without its extension and a suffix of ten hexadecimal digits."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"\.[a-z0-9]+$", ""), "_[0-9a-f]{10}$", "")


def resolve_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """``wanted`` (image_file) with ``file``: the file of ``files`` (file) of that name, else of that stem, the shortest name first."""
    shortest = F.min(F.struct(F.length("file"), "file"))["file"]
    exact = files.groupBy(F.lower("file").alias("_name")).agg(shortest.alias("_exact"))
    stem = files.groupBy(file_stem(F.col("file")).alias("_stem")).agg(shortest.alias("_by_stem"))
    out = wanted.withColumns({"_name": F.lower("image_file"), "_stem": file_stem(F.col("image_file"))})
    out = out.join(exact, "_name", "left").join(stem, "_stem", "left")
    return out.withColumn("file", F.coalesce("_exact", "_by_stem")).drop("_name", "_stem", "_exact", "_by_stem")


def read_lexicon(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(lexicon, canon, canon_pos, form, n_words) of the list under ``name`` in a JSON file of lexicons, each a list of a canon and its forms, in the file's order."""
    raw = spark.read.schema(f"{name} array<struct<canon: string, forms: array<string>>>").json(path, multiLine=True)
    groups = raw.select(F.posexplode(name).alias("canon_pos", "g")).select("canon_pos", "g.canon", F.explode("g.forms").alias("form"))
    form = F.lower(F.trim("form"))
    return groups.select(F.lit(name).alias("lexicon"), "canon", "canon_pos", form.alias("form"), F.size(F.split(form, " +")).alias("n_words")).filter("form != ''")


def read_replacements(spark: SparkSession, path: str, kinds: tuple[str, ...]) -> DataFrame:
    """(kind, source, target) of a JSON file of maps, such as look-alike letters, digits and whole-token aliases; both sides in lower case."""
    raw = spark.read.schema(", ".join(f"{k} map<string, string>" for k in kinds)).json(path, multiLine=True)
    each = [raw.select(F.lit(k).alias("kind"), F.explode(k).alias("source", "target")) for k in kinds]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out.select("kind", F.lower("source").alias("source"), F.lower("target").alias("target"))
