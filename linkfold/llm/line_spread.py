"""Removal of boilerplate lines by the number of distinct sites that carry them, with DataFrame operations only.

HyperLogLog sketches of the sites are built for every line's hash and merge by aggregation.  Lines whose estimate lies far from
the threshold are decided by it; those near it get exact distinct counts.  A line that reaches the threshold goes from all its carriers, if as
many different texts carry it: equal texts on many sites are copies of one document, which are for near-duplicate removal to settle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkfold.llm.scratch import stored

#: Log2 of a sketch's registers: 1.6 % standard error, and far less at the few sites around a threshold.
LG_REGISTERS = 12
#: Estimates within this factor of the threshold are replaced by exact counts.
NEAR = 1.25
#: Lost lines that are broadcast at most (some 32 MB); beyond, texts are shuffled.
BROADCAST_LINES = 500_000


def _lines(text: Column) -> Column:
    """A text's distinct lines without blanks at the ends."""
    return F.array_distinct(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(x)))  # F.trim itself would take the index for its second argument


def boilerplate_lines(docs: DataFrame, min_sites: int = 10) -> tuple[DataFrame, DataFrame]:
    """Hashes (line) of the boilerplate lines of ``docs`` (text, source), and (doc, line) for the texts, by their hash, that carry them.

    Lines are taken without blanks at the ends; empty lines never count.  A null source is a site of its own.
    """
    # a text is hashed before its lines become rows, not once for each
    places = docs.select(F.xxhash64("source").alias("site"), F.xxhash64("text").alias("doc"), _lines(F.col("text")).alias("lines"))
    places = places.select("site", "doc", F.explode("lines").alias("text")).filter("text != ''").select("doc", "site", F.xxhash64("text").alias("line"))
    places = stored(places, "lines")

    spread = places.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_REGISTERS)).alias("sketch"))
    spread = spread.select("line", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites / NEAR)
    spread = stored(spread.withColumn("near", F.col("sites") <= min_sites * NEAR), "spread")
    carried = stored(places.join(spread, "line"), "carried")

    exact = carried.filter("near").select("line", "site").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("sites"))
    wide = spread.filter("not near").select("line").unionByName(exact.filter(F.col("sites") >= min_sites).select("line"))
    # equal texts are one row from here on
    texts = stored(carried.select("doc", "line").join(stored(wide, "wide"), "line").distinct(), "texts")
    found = stored(texts.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites).select("line"), "boilerplate")
    return found, texts.join(found, "line").select("doc", "line")


def remove_boilerplate(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """The rows and columns of ``docs`` (text, source and any others) without boilerplate lines in ``text``.

    Adds n_lines and n_removed, in place of columns of these names.  A text that loses no line stays as it is; a null text stays null with no
    lines, an empty one has one line that stays.  Rows are judged by their texts, whatever their other columns: repeated rows, and rows without doc_id, are
    treated alike.  The lost lines of each text are broadcast while they are few; a line is held equal to another if their 64-bit hashes are.
    """
    found = stored(boilerplate_lines(docs.select("text", "source"), min_sites)[1], "lost")
    lost = found.groupBy("doc").agg(F.collect_set("line").alias("lost"))
    lost = F.broadcast(lost) if found.count() <= BROADCAST_LINES else lost.hint("shuffle_hash")
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    # names of the rows' own columns are held in a struct, so that none can clash with those used here
    rows = docs.select(F.struct(*rest).alias("rest") if rest else F.lit(None).alias("rest"), F.col("text").alias("text"), F.split("text", "\n", -1).alias("lines"), F.xxhash64("text").alias("doc"))
    rows = rows.join(lost, "doc", "left")
    left = F.filter("lines", lambda x: ~F.array_contains("lost", F.xxhash64(F.trim(x))) | (F.trim(x) == ""))
    rows = rows.withColumn("kept", F.when(F.col("lost").isNotNull(), left))
    text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    removed = F.when(F.col("kept").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long")
    order = [F.col("rest")[c].alias(c) for c in rest]
    order.insert(min([c for c in docs.columns if c not in ("n_lines", "n_removed")].index("text"), len(order)), text)
    return rows.select(*order, n.alias("n_lines"), removed.alias("n_removed"))
