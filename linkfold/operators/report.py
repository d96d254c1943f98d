"""The quality report over a range of the log: classes, errors, scores of right and wrong candidates, and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkfold.functions.text import line_count, text_counts
from linkfold.operators.documents import candidate_pool, matched_id, parsed, total_ms
from linkfold.operators.history import classified, confusion_report, medians, ratio_buckets
from linkfold.operators.tables import written


def id_range(log: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """Rows from the smaller to the larger of two ids, both included."""
    return log.filter(F.col(key).between(min(first, last), max(first, last)))


def target_id(matched: Column, manual: Column, fp: Column) -> Column:
    """The item that was right: the manual label, else the match unless it is marked as a false positive."""
    return F.coalesce(manual, F.when(F.coalesce(fp, F.lit(0)) == 0, matched))


def judged(log: DataFrame, document: str, key: str) -> DataFrame:
    """(key, matched, manual, fp, fn, cls, reason, target, seconds, pool) of each row of ``log`` (key, document, matched_id, manual_id, fp, fn, total_ms).

    The log's own match and time go before the document's.
    """
    rows = log.select(key, "manual_id", "fp", "fn", F.col("matched_id").alias("_matched"), F.col("total_ms").alias("_ms"), parsed(F.col(document)).alias("d"))
    rows = rows.select(key, F.coalesce("_matched", matched_id(F.col("d"))).alias("matched"), F.col("manual_id").alias("manual"), "fp", "fn", (total_ms(F.col("d"), F.col("_ms")) / 1000).alias("seconds"), candidate_pool(F.col("d")).alias("pool"))
    cls = classified(F.col("matched"), F.col("manual"), F.col("fp"), F.col("fn"))
    return rows.select(key, "matched", "manual", "fp", "fn", cls["cls"].alias("cls"), cls["reason"].alias("reason"), target_id(F.col("matched"), F.col("manual"), F.col("fp")).alias("target"), "seconds", "pool")


def error_items(rows: DataFrame) -> DataFrame:
    """The rows of ``judged`` that are false positives or negatives, with the reason."""
    return rows.filter(F.col("cls").isin("FP", "FN")).drop("pool", "seconds", "target")


def candidate_scores(rows: DataFrame) -> DataFrame:
    """(metric, polarity, value): the scores of the right candidates ("plus") and of all others ("minus") of the rows of ``judged``.

    The pools are written first: what asks for their size or reads them again would parse the documents again, once for each place that a pool names.
    """
    rows = written(rows.select("target", "pool"), "pools")
    each = rows.select("target", F.explode("pool").alias("c")).withColumn("polarity", F.when(F.col("c.id") == F.col("target"), "plus").otherwise("minus"))
    pairs = F.explode(F.array(F.struct(F.lit("cosine").alias("metric"), F.col("c.cosine").alias("value")), F.struct(F.lit("score").alias("metric"), F.col("c.score").alias("value"))))
    return each.select("polarity", pairs.alias("m")).select("m.metric", "polarity", "m.value").filter("value is not null")


def distributions(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, low, high, mean, median) of each group: the median is the value of nearest rank, half to even."""
    whole = values.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.avg(value), 6).alias("mean"))
    named = values.withColumn("_key", F.concat_ws("\0", *keys))
    middle = medians(named, "_key", value).select("_key", F.col("nearest").alias("median"))
    return whole.withColumn("_key", F.concat_ws("\0", *keys)).join(middle, "_key", "left").drop("_key")


def summary(rows: DataFrame, key: str) -> DataFrame:
    """One row: the counts and ratios of the rows of ``judged``, their first and last id, the share with a match, and their mean and median time.

    What is counted is written first, as the counts, the sketch and the median each read it, and it comes from documents that are dear to parse.
    """
    rows = written(rows.select(key, "matched", "cls", "seconds"), "judged")
    counts = confusion_report(rows).drop("match_rate")
    more = rows.agg(
        F.min(key).alias("min_id"), F.max(key).alias("max_id"), F.round(F.avg(F.col("matched").isNotNull().cast("double")), 6).alias("match_rate"), F.round(F.avg("seconds"), 3).alias("mean_sec"),
        F.round(F.min("seconds"), 3).alias("min_sec"), F.round(F.max("seconds"), 3).alias("max_sec"), F.count("seconds").alias("n_timed"),
    )
    middle = medians(rows.withColumn("_all", F.lit(1)), "_all", "seconds").select(F.round("interpolated", 3).alias("median_sec"))
    return counts.join(F.broadcast(more), F.lit(True)).join(F.broadcast(middle), F.lit(True), "left")


def unmatched_names(linked: DataFrame, name: str, linked_id: str, examples: int = 5) -> DataFrame:
    """(name, n, examples): the names that no link was found for, how often each occurs, and some of their rows' ids in order."""
    return linked.filter(F.col(linked_id).isNull() & F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("id")), 1, examples).alias("examples"))


def changed_counts(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(scanned, changed, then one count for each column): in how many rows of ``before`` a rewrite changes anything, and each column; nulls are equal."""
    both = before.select(key, *columns).join(after.select(key, *[F.col(c).alias(f"_{c}") for c in columns]), key)
    differs = {c: ~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns}
    any_of = F.greatest(*[d.cast("int") for d in differs.values()]) if len(columns) > 1 else next(iter(differs.values())).cast("int")
    return both.agg(F.count(F.lit(1)).alias("scanned"), F.sum(any_of).alias("changed"), *[F.count_if(d).alias(c) for c, d in differs.items()])


def replaced_reports(saved: DataFrame, new: DataFrame, name: str, order: str, keep: int = 40) -> DataFrame:
    """Saved reports with the new ones in place of those of the same name; the last ``keep`` by ``order`` stay."""
    kept = saved.join(new.select(name).distinct(), name, "left_anti").unionByName(new)
    return kept.orderBy(F.desc(order), name).limit(keep)


def size_ratios(pairs: DataFrame, query: str, reference: str, key: str, top: int = 15) -> tuple[DataFrame, DataFrame]:
    """The study of how much longer one text of a pair is: a summary of (measure, bucket, n, mean) over lines, characters and words, and the ``top`` pairs by lines.

    A pair's ratio is the larger size by the smaller, from ``ratio_buckets``; pairs of which one text is empty have no mean.
    """
    a, b = text_counts(F.col(query)), text_counts(F.col(reference))
    rows = pairs.select(key, a.alias("a"), b.alias("b"))
    each = rows.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"a.{m}").cast("double").alias("a"), F.col(f"b.{m}").cast("double").alias("b")) for m in ("lines", "chars", "words")])).alias("s")).select(key, "s.*")
    each = each.withColumn("ratio", F.when((F.col("a") > 0) & (F.col("b") > 0), F.greatest("a", "b") / F.least("a", "b")))
    summary = each.groupBy("measure", ratio_buckets(F.col("ratio"), F.col("a"), F.col("b")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ratio"), 6).alias("mean"))
    widest = each.filter("measure = 'lines' and ratio is not null").orderBy(F.desc("ratio"), key).limit(top).select(key, F.round("ratio", 6).alias("ratio"))
    return summary, widest


def excess_lines(pairs: DataFrame, query: str, reference: str, key: str, false_positives: DataFrame | None = None) -> DataFrame:
    """(excess, n, mean_ratio): by how many lines the reference exceeds the query, over pairs where it does; without those of ``false_positives`` (key), if given."""
    rows = pairs.select(key, line_count(F.col(query)).alias("a"), line_count(F.col(reference)).alias("b")).filter("b > a")
    rows = rows.join(false_positives.select(key).distinct(), key, "left_anti") if false_positives is not None else rows
    return rows.groupBy((F.col("b") - F.col("a")).alias("excess")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("b") / F.greatest("a", F.lit(1))), 6).alias("mean_ratio"))
