"""From scored candidates to a winner, similar items or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkfold.functions.scores import fin_blend, hard_rejects, score_band
from linkfold.operators.pairs import pair_features
from linkfold.settings import Settings


def final_scores(candidates: DataFrame, settings: Settings, bypass: bool = True) -> DataFrame:
    """``candidates`` (score, cosine, lexicon_reject, text_reason) with band, fin, fin_pre_reject, reason and eligible.

    A text reason or an unbypassed lexicon reject makes fin 0 and the band none; a bypass restores the fin of a lexicon reject but not that of a
    text reason, whose score may win again all the same.  Without ``bypass`` every reject stays, whatever the cosine and score.
    """
    raw = score_band(F.col("score"), settings.match_threshold, settings.similar_threshold)
    blend = F.when(raw == "none", 0.0).otherwise(fin_blend(F.col("score"), F.col("cosine"), settings.weight_text, settings.weight_cosine))
    lexicon = F.coalesce("lexicon_reject", F.lit(False))
    any_reject = lexicon | F.col("text_reason").isNotNull()
    left = lambda rejected: hard_rejects(F.coalesce("cosine", F.lit(0.0)), F.coalesce("score", F.lit(0.0)), rejected, settings.bypass_cosine, settings.bypass_score) if bypass else rejected
    still, lexical = left(any_reject), left(lexicon)
    zero = F.col("text_reason").isNotNull() | lexical
    reason = F.when(F.col("text_reason").isNotNull(), F.concat(F.lit("label_text:"), F.col("text_reason"))).when(lexical, "exclusive_lexicon")
    reason = reason.when(raw == "none", "below_similar").when(raw == "match", "ok").otherwise("similar_band")
    return candidates.withColumns({
        "fin_pre_reject": blend, "fin": F.when(zero, 0.0).otherwise(blend), "band": F.when(zero, "none").otherwise(raw),
        "raw_band": raw, "reason": reason, "eligible": ~still,
    })


def resolve(scored: DataFrame, query: str = "query_id") -> DataFrame:
    """One row for each query of ``scored`` (id, pos, raw_band, fin, eligible): winner_id, winner_fin, match_ids and similar_ids in candidate order.

    The winner is the match-band candidate with the largest fin, the first of equals; without one the query is declined (null).
    """
    match, similar = F.col("eligible") & (F.col("raw_band") == "match"), F.col("eligible") & (F.col("raw_band") == "similar")
    ids = lambda rule: F.transform(F.array_sort(F.collect_list(F.when(rule, F.struct("pos", "id")))), lambda x: x["id"])
    best = F.max_by(F.struct("id", "fin"), F.when(match, F.struct("fin", (-F.col("pos")).alias("p"))))
    return scored.groupBy(query).agg(best.alias("best"), ids(match).alias("match_ids"), ids(similar).alias("similar_ids")).select(
        query, F.col("best.id").alias("winner_id"), F.col("best.fin").alias("winner_fin"), "match_ids", "similar_ids"
    )


def with_dead_fallback(candidates: DataFrame, settings: Settings, fin2_match: float = 0.55, query: str = "query_id") -> DataFrame:
    """(query, source, winner_id) for candidates (id, pos, score, fin2, cosine): where the best score is below the dead threshold, the best
    fin2 match wins, else the best cosine from ``empty_text_cosine`` on; otherwise the best score of the match band."""
    top = lambda value, rule: F.max_by("id", F.when(rule, F.struct(value, (-F.col("pos")).alias("p"))))
    score, fin2, cosine = F.col("score"), F.col("fin2"), F.col("cosine")
    found = candidates.groupBy(query).agg(
        (F.max("score") < settings.dead_threshold).alias("dead"), top(score, score > settings.match_threshold).alias("by_score"),
        top(fin2, fin2 > fin2_match).alias("by_fin2"), top(cosine, cosine >= settings.empty_text_cosine).alias("by_cosine"),
    )
    winner = F.when(F.col("dead"), F.coalesce("by_fin2", "by_cosine")).otherwise(F.col("by_score"))
    source = F.when(~F.col("dead"), F.when(F.col("by_score").isNotNull(), "score")).when(F.col("by_fin2").isNotNull(), "dead_fin2")
    source = source.when(F.col("by_cosine").isNotNull(), "dead_cosine")
    return found.select(query, F.coalesce(source, F.lit("none")).alias("source"), winner.alias("winner_id"))


def ranked(rows: DataFrame, query: str, keys: list[Column]) -> DataFrame:
    """Rows with their rank within the query by a total order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*keys)))


def majority(votes: DataFrame, alias: str, target: str, min_count: int, min_share: float, pos: str) -> DataFrame:
    """(alias, target, n, share): each alias's most common target, the first seen of equals, if it has enough votes and share."""
    counted = votes.filter(F.col(target).isNotNull()).groupBy(alias, target).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    best = counted.groupBy(alias).agg(F.max_by(F.struct(target, "n"), F.struct("n", (-F.col("first")).alias("f"))).alias("best"), F.sum("n").alias("total"))
    out = best.select(alias, F.col(f"best.{target}").alias(target), F.col("best.n").alias("n"), F.round(F.col("best.n") / F.col("total"), 6).alias("share"))
    return out.filter((F.col("n") >= min_count) & (F.col("share") >= min_share))


def hard_reject_reason(query_tokens: Column, reference_tokens: Column) -> Column:
    """Why two token sets rule each other out; null where they share a token or are both empty."""
    q, r = F.size(query_tokens) > 0, F.size(reference_tokens) > 0
    return F.when(q & ~r, "query_text_catalog_empty").when(~q & r, "query_empty_catalog_text").when(q & r & ~F.arrays_overlap(query_tokens, reference_tokens), "no_shared_words")


def ranking_metrics(ranked_rows: DataFrame, query: str, label: str, score: str, threshold: float) -> DataFrame:
    """One row: top-1, 3 and 5 accuracy and mean reciprocal rank over queries with a positive; precision, recall, F1 and false positive rate at
    ``threshold`` (included).  ``roc_auc`` and ``best_f1_threshold`` give the areas and the best threshold."""
    positives = ranked_rows.filter(F.col(label) == 1).groupBy(query).agg(F.min("rank").alias("rank"))
    top = positives.agg(
        F.count(F.lit(1)).alias("queries"), *[F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"top{k}") for k in (1, 3, 5)],
        F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"),
    )
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    n = {"tp": F.count_if(hit & pos), "fp": F.count_if(hit & ~pos), "fn": F.count_if(~hit & pos), "tn": F.count_if(~hit & ~pos)}
    counts = ranked_rows.agg(*[v.alias(k) for k, v in n.items()])
    ratio = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    tp, fp, fn, tn = (F.col(k) for k in n)
    at = counts.select(ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("fpr"))
    return top.join(F.broadcast(at), F.lit(True))


def roc_auc(rows: DataFrame, label: str, score: str, step: float = 1e-6) -> DataFrame:
    """(auc): the area under the ROC curve of scores rounded to ``step``.

    Counts by score are summed within ranges of scores first, so the running sum goes over a bounded number of ranges and then within each range.
    """
    place = F.round(F.col(score) / step).cast("long")
    counts = rows.groupBy(place.alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")).withColumn("range", F.floor(F.col("s") / 1000))
    ranges = counts.groupBy("range").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    below = F.sum("rn").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumn("below_range", F.coalesce(below, F.lit(0)))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = counts.withColumn("inside", inside).join(ranges.select("range", "below_range"), "range")
    area = F.sum(F.col("p") * (F.col("below_range") + F.col("inside") + F.col("n") / 2.0))
    return wins.agg(F.round(F.when(F.sum("p") * F.sum("n") > 0, area / (F.sum("p") * F.sum("n"))), 6).alias("auc"))


def colour_gates(rows: DataFrame, most: float, hard: float | None = None, keep_cosine: float | None = None) -> DataFrame:
    """``rows`` (distance, cosine) with colour_rejected, kept_by_cosine and hard_rejected.

    A colour distance beyond ``most`` rejects, unless the cosine reaches ``keep_cosine``; one beyond ``hard`` rejects whatever the cosine.  Unknown distances reject nothing.
    """
    beyond = F.coalesce(F.col("distance") > most, F.lit(False))
    is_hard = F.coalesce(F.col("distance") > hard, F.lit(False)) if hard is not None else F.lit(False)
    near = F.coalesce(F.col("cosine") >= keep_cosine, F.lit(False)) if keep_cosine is not None else F.lit(False)
    return rows.withColumns({"colour_rejected": (beyond & ~near) | is_hard, "kept_by_cosine": beyond & near & ~is_hard, "hard_rejected": is_hard})


def attached(candidates: DataFrame, scores: DataFrame, columns: list[str], reuse: DataFrame | None = None, query: str = "query_id") -> DataFrame:
    """Candidates with the scores (query, id, columns) of each, or those of its reuse (query, id, columns) where it has them."""
    out = candidates.join(scores.select(query, "id", *columns), [query, "id"], "left")
    if reuse is None:
        return out
    again = reuse.select(query, "id", *[F.col(c).alias(f"_{c}") for c in columns])
    out = out.join(again, [query, "id"], "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def with_distances(candidates: DataFrame, queries: DataFrame, stored: DataFrame, computed: DataFrame, distance) -> tuple[DataFrame, DataFrame]:
    """Candidates (query_id, id) with the distance of the query's histogram (query_id, hist) to the item's, and the histograms (id, hist) that have to be stored.

    An item's histogram is the stored one, else the computed one; ``distance`` is a function of two columns.
    """
    known = stored.select("id", F.col("hist").alias("_stored"))
    made = computed.select("id", F.col("hist").alias("_made"))
    rows = candidates.join(known, "id", "left").join(made, "id", "left").join(queries.select("query_id", F.col("hist").alias("_query")), "query_id", "left")
    missing = rows.filter(F.col("_stored").isNull() & F.col("_made").isNotNull()).select("id", F.col("_made").alias("hist")).dropDuplicates(["id"])
    return rows.withColumn("distance", distance(F.col("_query"), F.coalesce("_stored", "_made"))).drop("_stored", "_made", "_query"), missing


def rank_by(rows: DataFrame, scores: list[str], query: str = "query_id") -> DataFrame:
    """Rows with their rank: by the scores in turn, the largest first, missing ones as -1, then the smaller id."""
    return ranked(rows, query, [*[F.coalesce(F.col(s).cast("double"), F.lit(-1.0)).desc() for s in scores], F.col("id")])


def rank_of_visual_winner(rows: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, id, rank): the place that the candidate with the best cosine takes in the final ranking of rows (id, cosine, fin)."""
    final = rank_by(rows, ["fin", "cosine"], query)
    best = F.max_by(F.struct("id", "rank"), F.struct("cosine", (-F.col("id")).alias("i"))).alias("b")
    return final.filter("cosine is not null").groupBy(query).agg(best).select(query, "b.*")


def line_reject(matched: Column, lines: Column, reference_lines: Column, weak: Column, cosine: Column, most_cosine: float = 0.80) -> Column:
    """Why the lines of two labels say that they are different: most of more than three lines unmatched, or a weak structure at a low cosine; null if they don't."""
    longest = F.greatest(lines, reference_lines)
    majority = (lines > 0) & (reference_lines > 0) & (longest > 3) & (1 - matched / longest > 0.5)
    return F.when(majority, "majority_unmatched_lines").when(weak & (F.coalesce(cosine, F.lit(0.0)) < most_cosine), "weak_structure_low_cosine")


def preview(rows: DataFrame, item: Column, order: Column, limit: int = 40, query: str = "query_id") -> DataFrame:
    """(query, n, items): how many rows each query has, and the first ``limit`` of them in order."""
    numbered = rows.withColumn("_place", F.row_number().over(Window.partitionBy(query).orderBy(order)))
    shown = F.transform(F.array_sort(F.collect_list(F.when(F.col("_place") <= limit, F.struct("_place", item.alias("item"))))), lambda x: x["item"])
    return numbered.groupBy(query).agg(F.count(F.lit(1)).alias("n"), shown.alias("items"))


def channel_decision(scored: DataFrame, match_threshold: float, minimum: float, query: str = "query_id") -> DataFrame:
    """(query, winner_id, channel, final, reason) of rows (channel, id, final, soft_cover, soft_score, pos): the best final score over all channels.

    The winner is declined below ``minimum``, and vetoed where its soft score says that its reference barely holds what the text names.  Ties go to the channels' order and the smaller id.
    """
    best = F.max_by(F.struct("id", "channel", "final", "soft_cover", "soft_score"), F.struct("final", (-F.col("pos")).alias("p"), (-F.col("id")).alias("i"))).alias("b")
    found = scored.filter("final is not null").groupBy(query).agg(best).select(query, "b.*")
    veto = F.coalesce((F.col("soft_cover") < 0.40) & (F.col("soft_score") < 0.35), F.lit(False))
    reason = F.when(F.col("final") < minimum, "below_minimum").when(veto, "soft_veto").when(F.col("final") > match_threshold, "match").otherwise("similar")
    found = found.withColumn("reason", reason)
    return found.select(query, F.when(F.col("reason") == "match", F.col("id")).alias("winner_id"), "channel", F.round("final", 6).alias("final"), "reason")


def best_f1_threshold(rows: DataFrame, label: str, score: str, step: float = 1e-6) -> DataFrame:
    """(threshold, f1, pr_auc): the score from which F1 is best, the highest of equals, and the average precision, of scores rounded to ``step``.

    Counts by score are summed within ranges of scores first, so no task sorts all rows.
    """
    place = F.round(F.col(score) / step).cast("long")
    counts = rows.filter(F.col(score).isNotNull()).groupBy(place.alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count(F.lit(1)).alias("n")).withColumn("range", F.floor(F.col("s") / 1000))
    ranges = counts.groupBy("range").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("p_above"), F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("n_above"))
    inside = Window.partitionBy("range").orderBy(F.desc("s"))
    at = counts.withColumns({"ip": F.sum("p").over(inside), "i": F.sum("n").over(inside)}).join(ranges, "range")
    at = at.select("s", "p", (F.col("ip") + F.col("p_above")).alias("tp"), (F.col("i") + F.col("n_above")).alias("k"))
    total = at.agg(F.sum("p").alias("positives"))
    at = at.join(F.broadcast(total), F.lit(True)).withColumn("f1", 2 * F.col("tp") / (F.col("k") + F.col("positives")))
    best = F.max_by(F.struct("s", "f1"), F.struct(F.round("f1", 9).alias("f"), "s")).alias("b")
    area = F.sum(F.when(F.col("positives") > 0, F.col("p") / F.col("positives") * F.col("tp") / F.col("k")))
    return at.agg(best, F.round(area, 6).alias("pr_auc")).select(F.round(F.col("b.s") * step, 6).alias("threshold"), F.round("b.f1", 6).alias("f1"), "pr_auc")


def reuse_compare(hits: DataFrame, features: list[str], chance: Column, as_of_year: int, match_threshold: float, similar_threshold: float, weight_text: float = 0.65, weight_cosine: float = 0.45) -> DataFrame:
    """(query_id, previous_id, id, score, fin, band, pos, compare_source) of winners taken over from earlier queries, by the likeness of both queries' texts.

    hits: query_id, previous_id, id, cosine, text, previous_text, pos; an earlier query counts once, at its first place, and only if both texts say anything.
    ``features`` names the columns that the scorer ``chance`` reads, of those of ``pair_features``.  No reject applies: the texts are of photographs of one kind.
    """
    said = hits.filter((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.trim(F.coalesce("previous_text", F.lit(""))) != "") & F.col("previous_id").isNotNull())
    first = Window.partitionBy("query_id", "previous_id").orderBy("pos", "id")
    once = said.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("query_id", "previous_id", "id", "cosine", "text", "previous_text")
    scored = pair_features(once, "text", "previous_text", as_of_year, "cosine").select("query_id", "previous_id", "id", "cosine", *features).withColumn("score", chance)
    rows = scored.withColumn("fin", fin_blend(F.col("score"), F.col("cosine"), weight_text, weight_cosine))
    order = Window.partitionBy("query_id").orderBy(F.desc("fin"), F.desc("score"), "id", "previous_id")
    band = score_band(F.col("fin"), match_threshold, similar_threshold)
    return rows.select("query_id", "previous_id", "id", F.round("score", 6).alias("score"), "fin", band.alias("band"), F.row_number().over(order).alias("pos"), F.lit("previous_search_ocr").alias("compare_source"))
