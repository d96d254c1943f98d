"""Queries over the log: its documents, pages, and quality report.

The documents are made of orders and their lines: an order is a query, its customer the matched item, its lines the candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkfold.operators import documents, history, report
from linkfold.plans.queries import query


def _documents(t) -> DataFrame:
    """(id, document, manual_id): the JSON text of each order's query."""
    key, price, customer = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_custkey")
    candidate = (F.col("l_partkey") * 10 + F.col("l_linenumber")).cast("string")
    scored = F.struct(F.col("l_tax").alias("xgb_score"), F.col("l_discount").alias("xgb_fin"), (F.col("l_quantity") / 50).alias("cosine"))
    near = F.struct(candidate.alias("id"), (F.col("l_quantity") / 50).alias("cosine_similarity"))
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(candidate.alias("key"), scored.alias("value")))).alias("scored"), F.collect_list(near).alias("near"))
    source = F.get(F.array(*[F.lit(s) for s in ("XGB", "guess", "xgb_dead_x", "", None)]), (key % 5).cast("int"))
    card = F.struct(customer.cast("string").alias("id"), source.alias("source"), F.format_string(" s-%d ", customer).alias("slug"), (price / 1_000_000).alias("confidence"), F.format_string("W%d", customer).alias("name"))
    even = key % 2 == 0
    items = F.when(~even, F.col("near"))
    # of candidates that an order repeats, the last counts
    last = lambda rows: F.filter(rows, lambda e, i: ~F.coalesce(F.get(rows, i + 1)["key"] == e["key"], F.lit(False)))
    by_id = F.concat(F.lit("{"), F.array_join(F.transform(last(F.col("scored")), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), F.to_json(e["value"]))), ", "), F.lit("}"))
    rest = F.to_json(F.struct(
        F.when(key % 3 == 0, customer).alias("matched_wine_id"), card.alias("matched_wine"), F.struct(F.when(key % 7 == 0, -1.0).otherwise(price).alias("total")).alias("timings_ms"),
        F.struct((key % 11 == 0).cast("int").alias("false_positive"), (key % 4 == 0).cast("int").alias("false_negative")).alias("eval"), items.alias("candidates_siglip2"),
        F.struct(F.struct(F.struct(items.alias("items")).alias("siglip2")).alias("candidates"), F.struct(F.struct(F.lit("@").alias("by_id")).alias("xgb_match")).alias("_")).alias("steps"),
    ))
    document = F.replace(rest, F.lit('"_":{"xgb_match":{"by_id":"@"}}'), F.concat(F.lit('"xgb_match":{"by_id":'), F.when(even, by_id).otherwise("{}"), F.lit("}")))
    return t("orders").join(lines, "o_orderkey").select(key.alias("id"), document.alias("document"), F.when(key % 6 == 0, customer).when(key % 6 == 1, customer + 1).alias("manual_id"))


_LOG = """
SELECT o_orderkey AS id, o_custkey AS cust, o_totalprice AS price, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 IN (0, 2) THEN o_custkey END AS matched_id, (o_orderkey % 11 = 0)::INT AS fp,
  (o_orderkey % 4 = 0 AND o_orderkey % 11 <> 0)::INT AS fn, CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_totalprice END AS ms, CASE o_orderkey % 6 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey + 1 END AS manual_id
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
"""
_CANDIDATES = """
SELECT l_orderkey AS id, l_partkey * 10 + l_linenumber AS candidate_id, CASE WHEN l_orderkey % 2 = 0 THEN l_discount ELSE -1 END AS xgb_fin, CASE WHEN l_orderkey % 2 = 0 THEN l_tax ELSE -1 END AS xgb_score, l_quantity / 50 AS cosine FROM lineitem
"""
# of candidates that repeat, scored ones count with their last scores, others with their best
_POOL = f"""
SELECT id, candidate_id, CASE WHEN id % 2 = 0 THEN arg_max(xgb_fin, (xgb_score, xgb_fin, cosine)) ELSE -1 END AS xgb_fin, max(xgb_score) AS xgb_score,
  CASE WHEN id % 2 = 0 THEN arg_max(cosine, (xgb_score, xgb_fin, cosine)) ELSE max(cosine) END AS cosine FROM ({_CANDIDATES}) GROUP BY id, candidate_id
"""


@query(f"SELECT id, matched_id, CASE WHEN matched_id IS NOT NULL THEN round(price / 1000000, 6) END AS confidence, CASE WHEN matched_id IS NOT NULL THEN 's-' || cust END AS slug, ms AS total_ms, fp, fn FROM ({_LOG})")
def history_fields(t):
    rows = documents.synced(_documents(t), "document")
    return rows.select("id", "matched_id", F.round("confidence", 6).alias("confidence"), "slug", "total_ms", "fp", "fn")


@query(f"""
WITH log AS ({_LOG}), r AS (SELECT p.*, row_number() OVER (PARTITION BY id ORDER BY xgb_fin DESC, xgb_score DESC, cosine DESC, candidate_id) AS pos FROM ({_POOL}) p JOIN log USING (id) WHERE matched_id IS NULL)
SELECT id, pos, candidate_id, xgb_fin, xgb_score, cosine, -1.0::DOUBLE AS fin2 FROM r WHERE pos <= 7
""")
def unmatched_top(t):
    rows = _documents(t).select("id", documents.parsed(F.col("document")).alias("d")).filter(documents.matched_id(F.col("d")).isNull())
    top = rows.select("id", F.posexplode(documents.unmatched_top(F.col("d"))).alias("pos", "c"))
    return top.select("id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("c.id").alias("candidate_id"), "c.xgb_fin", "c.xgb_score", "c.cosine", "c.fin2")


@query(f"""
WITH log AS ({_LOG}), r AS (SELECT p.*, row_number() OVER (PARTITION BY id ORDER BY xgb_fin DESC, xgb_score DESC, cosine DESC, candidate_id) AS pos FROM ({_POOL}) p),
  top AS (SELECT id, string_agg(candidate_id::VARCHAR, ',' ORDER BY pos) AS top FROM r WHERE pos <= 7 GROUP BY id)
SELECT id, matched_id, CASE WHEN matched_id IS NOT NULL THEN round(price / 1000000, 6) END AS confidence, coalesce(CASE WHEN matched_id IS NOT NULL THEN 'W' || cust END, c_name) AS name,
  CASE WHEN matched_id IS NOT NULL THEN 's-' || cust END AS slug, c_mktsegment AS label, CASE WHEN ms >= 0 THEN ms END AS total_ms, fp, fn, CASE WHEN matched_id IS NULL THEN top END AS top
FROM log LEFT JOIN customer ON matched_id = c_custkey LEFT JOIN top USING (id)
""")
def history_page(t):
    catalog = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("slug"), F.col("c_mktsegment").alias("label"))
    page = documents.history_page(_documents(t), "document", catalog, "id")
    top = F.array_join(F.transform("top", lambda x: x["id"].cast("string")), ",")
    return page.select("id", "matched_id", F.round("confidence", 6).alias("confidence"), "name", "slug", "label", "total_ms", "fp", "fn", top.alias("top"))


def _judged(t) -> DataFrame:
    log = documents.synced(_documents(t), "document").withColumn("total_ms", F.lit(None).cast("double"))
    return report.judged(report.id_range(log, "id", 1_000_000_000, 1), "document", "id")


_JUDGED = f"""
SELECT *, CASE WHEN matched_id IS NOT NULL AND manual_id IS NOT NULL AND matched_id <> manual_id THEN 'FP' WHEN matched_id IS NULL AND manual_id IS NOT NULL THEN 'FN'
  WHEN fp = 1 THEN 'FP' WHEN fn = 1 THEN 'FN' WHEN matched_id IS NOT NULL THEN 'TP' ELSE 'TN' END AS cls, coalesce(manual_id, CASE WHEN fp = 0 THEN matched_id END) AS target, CASE WHEN ms >= 0 THEN ms / 1000 END AS seconds FROM ({_LOG}) WHERE id BETWEEN 1 AND 1000000000
"""


@query(f"""
WITH j AS ({_JUDGED}), n AS (SELECT count(*) FILTER (cls = 'TP') AS tp, count(*) FILTER (cls = 'FP') AS fp, count(*) FILTER (cls = 'TN') AS tn, count(*) FILTER (cls = 'FN') AS fn, min(id) AS min_id, max(id) AS max_id,
  round(avg((matched_id IS NOT NULL)::INT), 6) AS match_rate, round(avg(seconds), 3) AS mean_sec, round(min(seconds), 3) AS min_sec, round(max(seconds), 3) AS max_sec, count(seconds) AS n_timed, round(quantile_cont(seconds, 0.5), 3) AS median_sec FROM j)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(tn / nullif(tn + fp, 0), 6) AS specificity,
  round(tn / nullif(tn + fn, 0), 6) AS npv, round((tp + tn) / nullif(tp + fp + tn + fn, 0), 6) AS accuracy, round(fp / nullif(fp + tn, 0), 6) AS fpr, round(fn / nullif(fn + tp, 0), 6) AS fnr FROM n
""")
def quality_report(t):
    return report.summary(_judged(t), "id")


@query(f"""
SELECT id, matched_id AS matched, manual_id AS manual, fp, fn, cls, CASE WHEN matched_id IS NOT NULL AND manual_id IS NOT NULL AND matched_id <> manual_id THEN 'manual_differs_from_matched'
  WHEN matched_id IS NULL AND manual_id IS NOT NULL THEN 'manual_without_matched' WHEN fp = 1 THEN 'checkbox_fp' ELSE 'checkbox_fn' END AS reason FROM ({_JUDGED}) WHERE cls IN ('FP', 'FN')
""")
def quality_errors(t):
    return report.error_items(_judged(t))


@query(f"""
WITH v AS (SELECT CASE WHEN candidate_id = target THEN 'plus' ELSE 'minus' END AS polarity, cosine, CASE WHEN xgb_score >= 0 THEN xgb_score END AS score FROM ({_POOL}) JOIN ({_JUDGED}) USING (id)),
  m AS (SELECT 'cosine' AS metric, polarity, cosine AS value FROM v UNION ALL SELECT 'score', polarity, score FROM v WHERE score IS NOT NULL),
  o AS (SELECT *, row_number() OVER (PARTITION BY metric, polarity ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY metric, polarity) AS k FROM m)
SELECT metric, polarity, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, min(CASE WHEN i = round_even((k - 1) / 2, 0)::BIGINT THEN value END) AS median FROM o GROUP BY metric, polarity
""")
def candidate_distributions(t):
    return report.distributions(report.candidate_scores(_judged(t)), ["metric", "polarity"], "value")


@query("SELECT event_id, (event_id % 2 = 0)::INT AS fp, (event_id % 2 = 1 AND event_id % 3 = 0)::INT AS fn, json_extract(props, '$.k')::BIGINT AS k FROM events")
def flags_in_documents(t):
    rows = t("events").select("event_id", documents.with_flags(F.col("props"), (F.col("event_id") % 2 == 0).cast("int"), (F.col("event_id") % 3 == 0).cast("int")).alias("document"))
    d = documents.flags(documents.parsed(F.col("document")))
    return rows.select("event_id", d["fp"].alias("fp"), d["fn"].alias("fn"), history.typed_number(F.col("document"), "$.k").cast("long").alias("k"))


@query(f"SELECT count(*) AS scanned, count(*) FILTER (fp = 1 OR ms < 0) AS changed, count(*) FILTER (ms < 0) AS total_ms, count(*) FILTER (fp = 1) AS fp FROM ({_LOG})")
def resync_counts(t):
    after = documents.synced(_documents(t), "document").select("id", "total_ms", "fp")
    before = after.select("id", F.when(F.col("total_ms") >= 0, F.col("total_ms")).alias("total_ms"), F.lit(0).alias("fp"))
    return report.changed_counts(before, after, "id", ["total_ms", "fp"])


@query("""
WITH s AS (SELECT event_type AS name, max(event_id) AS saved_at, 'old' AS kind FROM events GROUP BY 1 UNION ALL SELECT event_type || user_id, max(event_id), 'old' FROM events GROUP BY 1),
  n AS (SELECT event_type AS name, max(event_id) + 1000000 AS saved_at, 'new' AS kind FROM events WHERE event_type IN ('error', 'click') GROUP BY 1)
SELECT * FROM (SELECT * FROM s WHERE name NOT IN (SELECT name FROM n) UNION ALL SELECT * FROM n) ORDER BY saved_at DESC, name LIMIT 40
""")
def saved_reports(t):
    of = lambda df, name, kind, more=0: df.groupBy(name.alias("name")).agg((F.max("event_id") + more).alias("saved_at")).withColumn("kind", F.lit(kind))
    saved = of(t("events"), F.col("event_type"), "old").unionByName(of(t("events"), F.concat("event_type", F.col("user_id").cast("string")), "old"))
    return report.replaced_reports(saved, of(t("events").filter("event_type in ('error', 'click')"), F.col("event_type"), "new", 1_000_000), "name", "saved_at")
