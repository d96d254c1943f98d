"""The log of queries: filters, order, seeking, feedback, and its quality report."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkfold.functions.scores import safe_div


def flag_filter(df: DataFrame, flags: list[str], rules: dict[str, Column]) -> DataFrame:
    """Rows for which any of the named rules holds; no flags, no filter."""
    chosen = [rules[f] for f in flags if f in rules]
    return df.filter(reduce(or_, [F.coalesce(c, F.lit(False)) for c in chosen])) if chosen else df


def ordered(column: str, descending: bool, tie: str) -> list[Column]:
    """Order by a column, nulls as if largest, with an id to break ties the same way."""
    if descending:
        return [F.col(column).desc_nulls_first(), F.col(tie).desc()]
    return [F.col(column).asc_nulls_last(), F.col(tie).asc()]


def seek_offset(df: DataFrame, column: str, descending: bool, tie: str, around_id: int, before: int = 2) -> DataFrame:
    """(offset): where a page that shows ``around_id`` begins, ``before`` rows ahead of it; no row if it isn't there.

    Counting the rows ahead of it needs no order over all rows, so it is one filter and one sum over the table.
    """
    at = df.filter(F.col(tie) == around_id).select(F.col(column).alias("at_value"), F.col(tie).alias("at_id")).limit(1)
    value, key = F.col(column), F.col(tie)
    same = value.eqNullSafe(F.col("at_value"))
    if descending:
        ahead = F.when(same, key > F.col("at_id")).when(F.col("at_value").isNull(), F.lit(False)).otherwise(value.isNull() | (value > F.col("at_value")))
    else:
        ahead = F.when(same, key < F.col("at_id")).when(value.isNull(), F.lit(False)).otherwise(F.col("at_value").isNull() | (value < F.col("at_value")))
    counted = df.select(column, tie).join(F.broadcast(at), F.lit(True)).agg(F.count_if(ahead).alias("ahead"), F.count(F.lit(1)).alias("n"))
    return counted.filter("n > 0").select(F.greatest(F.col("ahead") - before, F.lit(0)).cast("long").alias("offset"))


def typed_number(document: Column, path: str) -> Column:
    """A number at a path of a JSON text, null where the value there is a string or anything else."""
    value = F.variant_get(F.try_parse_json(document), path, "variant")
    kind = F.schema_of_variant(value)
    return F.when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(value, "$", "double"))


def classified(matched: Column, manual: Column, fp: Column, fn: Column) -> Column:
    """A struct of class (TP, FP, TN or FN) and reason; a manual label goes before the check boxes."""
    of = lambda c, why: F.struct(F.lit(c).alias("cls"), F.lit(why).alias("reason"))
    ticked = lambda c: F.coalesce(c, F.lit(0)) != 0
    return (
        F.when(matched.isNotNull() & manual.isNotNull() & (matched != manual), of("FP", "manual_differs_from_matched"))
        .when(matched.isNull() & manual.isNotNull(), of("FN", "manual_without_matched"))
        .when(ticked(fp), of("FP", "checkbox_fp"))
        .when(ticked(fn), of("FN", "checkbox_fn"))
        .when(matched.isNotNull(), of("TP", "matched_ok"))
        .otherwise(of("TN", "no_match_ok"))
    )


def manual_flags(manual: Column, matched: Column) -> Column:
    """A struct of fp and fn that follow from a manual label; both 0 without one."""
    fp = (manual.isNotNull() & matched.isNotNull() & (manual != matched)).cast("int")
    fn = (manual.isNotNull() & matched.isNull()).cast("int")
    return F.struct(fp.alias("fp"), fn.alias("fn"))


def apply_feedback(log: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The log with the flags of ``updates`` (key, fp, fn), where a false positive excludes a false negative."""
    new = updates.select(key, F.col("fp").alias("_fp"), F.when(F.col("fp") != 0, 0).otherwise(F.col("fn")).alias("_fn"))
    out = log.join(new, key, "left").withColumns({"fp": F.coalesce("_fp", "fp"), "fn": F.coalesce("_fn", "fn")})
    return out.drop("_fp", "_fn")


def set_manual_labels(log: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The log (key, matched_id, manual_id, fp, fn) with the manual labels of ``updates`` (key, manual_id; null clears), and the flags that follow from a set one.

    The last of several updates of a key is up to the caller; clearing a label leaves the flags as they are.
    """
    new = updates.select(key, F.col("manual_id").alias("_manual"), F.lit(True).alias("_changed"))
    rows = log.join(new, key, "left")
    found = manual_flags(F.col("_manual"), F.col("matched_id"))
    sets = F.coalesce(F.col("_changed"), F.lit(False)) & F.col("_manual").isNotNull()
    rows = rows.withColumns({"manual_id": F.when(F.col("_changed"), F.col("_manual")).otherwise(F.col("manual_id")), "fp": F.when(sets, found["fp"]).otherwise(F.col("fp")), "fn": F.when(sets, found["fn"]).otherwise(F.col("fn"))})
    return rows.drop("_manual", "_changed")


def confusion_report(rows: DataFrame, cls: str = "cls") -> DataFrame:
    """One row with the four counts and nine ratios of a column of classes; ratios with nothing below the line are null."""
    n = {c: F.count_if(F.col(cls) == c).alias(c.lower()) for c in ("TP", "FP", "TN", "FN")}
    counts = rows.agg(*n.values())
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    ratios = {
        "precision": safe_div(tp, tp + fp), "recall": safe_div(tp, tp + fn), "f1": safe_div(2 * tp, 2 * tp + fp + fn), "specificity": safe_div(tn, tn + fp),
        "npv": safe_div(tn, tn + fn), "accuracy": safe_div(tp + tn, total), "fpr": safe_div(fp, fp + tn), "fnr": safe_div(fn, fn + tp), "match_rate": safe_div(tp + fp, total),
    }
    return counts.select("tp", "fp", "tn", "fn", *[F.round(v, 6).alias(k) for k, v in ratios.items()])


def score_histogram(rows: DataFrame, score: str) -> DataFrame:
    """(bin, n, pct): ten bins of a tenth and one for 1.0 and above; scores below 0 count in the total only."""
    s = F.col(score)
    number = F.when(s < 0, -1).when(s >= 1.0, 10).otherwise(F.floor(F.least(s, F.lit(0.999999)) * 10)).cast("int")
    counted = rows.filter(s.isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = rows.sparkSession.range(11).select(F.col("id").cast("int").alias("bin"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    out = bins.join(counted, "bin", "left").join(F.broadcast(total), F.lit(True))
    n = F.coalesce("n", F.lit(0)).cast("long")
    label = F.when(F.col("bin") == 10, "1.0").otherwise(F.concat(F.format_number(F.col("bin") / 10, 1), F.lit("–"), F.format_number((F.col("bin") + 1) / 10, 1)))
    return out.select(label.alias("range"), n.alias("n"), F.round(F.coalesce(safe_div(100.0 * n, F.col("total")), F.lit(0.0)), 2).alias("pct"))


def timing_histogram(rows: DataFrame, seconds: str) -> DataFrame:
    """(second, n, pct) for each whole second that occurs; negative and missing times don't count."""
    timed = rows.filter(F.col(seconds).isNotNull() & ~F.isnan(seconds) & (F.col(seconds) >= 0))
    counted = timed.groupBy(F.floor(seconds).cast("long").alias("second")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total), F.lit(True)).select("second", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"))


#: A quantile is sketched to one in so many ranks; groups of up to ``WHOLE`` values, ten times as many at least, are put in order as a whole.
ACCURACY, WHOLE = 10_000, 100_000
QUANTILES = (0.25, 0.5, 0.75, 0.95)


def medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """For each group: the nearest-rank median (half to even), the interpolated median, and linear quantiles.

    A sketch gives for each quantile two values that its ranks lie between, three parts in ten thousand of the group on either side at most, however its values
    are spread.  A second pass counts what lies below and puts in order what lies between, equal values as one, so a group with a third of all rows is in no task
    as a whole.  Null and NaN values, and those without a group, don't count.
    """
    rows = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter("g is not null and v is not null and not isnan(v)")
    edges = [min(1.0, max(0.0, p + side * 2 / ACCURACY)) for p in QUANTILES for side in (-1, 1)]
    spans = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", edges, ACCURACY).alias("edges"))
    at = lambda p: (F.col("n") - 1) * F.lit(p)
    part = lambda k, low, high: F.struct(F.lit(k).alias("k"), low.alias("low"), high.alias("high"))
    whole = F.array(part(0, F.lit(float("-inf")), F.lit(float("inf"))))
    parts = F.when(F.col("n") <= WHOLE, whole).otherwise(F.array(*[part(k, F.col("edges")[2 * k], F.col("edges")[2 * k + 1]) for k in range(len(QUANTILES))]))
    rank = lambda what, k, r: F.struct(F.lit(what).alias("what"), F.when(F.col("n") <= WHOLE, 0).otherwise(k).alias("k"), r.cast("long").alias("rank"))
    ranks = [rank("nearest", QUANTILES.index(0.5), F.bround((F.col("n") - 1) / 2, 0))]
    for k, p in enumerate(QUANTILES):
        ranks += [rank(f"a{p}", k, F.floor(at(p))), rank(f"b{p}", k, F.ceil(at(p)))]
    spans = spans.select("g", "n", parts.alias("parts"), F.array(*ranks).alias("ranks"))
    placed = rows.join(spans.select("g", "parts"), "g").select("g", "v", F.explode("parts").alias("p")).filter("v <= p.high")
    # what lies below a part is one row without a value, which comes first
    counts = placed.groupBy("g", F.col("p.k").alias("k"), F.when(F.col("v") >= F.col("p.low"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("g", "k").orderBy(F.asc_nulls_first("v"))))
    here = F.filter("ranks", lambda r: (r["k"] == F.col("k")) & (r["rank"] < F.col("upto")) & (r["rank"] >= F.col("upto") - F.col("c")))
    values = counts.join(spans.select("g", "n", "ranks"), "g").select("g", "n", "v", F.explode(here).alias("r"))
    value_of = lambda what: F.max(F.when(F.col("r.what") == what, F.col("v"))).alias(what)
    values = values.groupBy("g", "n").agg(*[value_of(w) for w in ("nearest", *[f"{s}{p}" for p in QUANTILES for s in "ab"])])
    between = lambda p: F.round(F.col(f"`a{p}`") + (at(p) - F.floor(at(p))) * (F.col(f"`b{p}`") - F.col(f"`a{p}`")), 6)
    return values.select(F.col("g").alias(group), "n", "nearest", between(0.5).alias("interpolated"), between(0.25).alias("p25"), between(0.75).alias("p75"), between(0.95).alias("p95"))


def ratio_buckets(ratio: Column, a: Column, b: Column) -> Column:
    """The bucket of a size ratio (the larger by the smaller)."""
    edges = F.when((a <= 0) & (b <= 0), "both_empty").when((a <= 0) | (b <= 0), "one_empty")
    for edge in (1.25, 1.5, 2.0, 3.0, 5.0):
        edges = edges.when(ratio <= edge, f"<={edge:g}")
    return edges.otherwise(">5")


def rate_limited(rows: DataFrame, key: str, ts: str, limit: int, seconds: int = 60) -> DataFrame:
    """Rows with how many of their key came in the last ``seconds``, and whether that is within the limit.

    All arrivals count, allowed or not; ``admission.admissions`` lets calls wait instead, and counts those that were admitted.

    Time is cut into slices of that length, and each row also goes to the next one, whose rows may look back on it; so a busy key is split by time.
    """
    names, micros = rows.columns, F.unix_micros(F.col(ts).cast("timestamp"))
    slices = rows.withColumns({"_at": micros, "_slice": F.floor(micros / (seconds * 1_000_000))})
    slices = slices.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("_slice", F.when(F.col("_own"), F.col("_slice")).otherwise(F.col("_slice") + 1))
    window = Window.partitionBy(key, "_slice").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    counted = slices.withColumn("recent", F.count(F.lit(1)).over(window)).filter("_own")
    return counted.select(*names, "recent").withColumn("allowed", F.col("recent") <= limit)
