"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkfold.llm import chroma, decontaminate, html_template, line_spread, minmax, packing, periodic_runs, quality_pu, seed_extend, sharding, toxicity_fm, url_rules, whitening
from linkfold.llm.scratch import stored
from linkfold.llm.words import split_words

#: Scores from here on count as toxic.
TOXIC_FROM = 0.3
#: Scores from here on count as good.
GOOD_FROM = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.kd_shards(table(spark, sf_dir, "documents"), shards=40)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op2_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    found = chroma.align(chroma.melody_fingerprints(vectors), F.col("id") % 100 == 0)
    return found.withColumnRenamed("id", "vec_id")


def op3_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_template.main_texts(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.remove_boilerplate(table(spark, sf_dir, "documents"), min_sites=10).select("doc_id", "text", "n_lines", "n_removed")


def op5_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def op7_seed_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = seed_extend.remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity_fm.score(docs, toxicity_fm.fit(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted")
    return scored.select(F.col("doc_id").cast("long"), toxicity_fm.held_out().alias("held_out"), "score", predicted)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def op10_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=0.2, indels=True)


def op11_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(quality_pu.measured(table(spark, sf_dir, "documents").select("doc_id", "text")), "measures")
    scored = quality_pu.score(docs, quality_pu.fit(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= GOOD_FROM).cast("int").alias("predicted")
    return scored.select(F.col("doc_id").cast("long"), quality_pu.held_out().alias("held_out"), "score", predicted)


def with_periods(doc_id: int | None, text: str | None) -> str | None:
    """The text of op12's contract: of every tenth document, by hash, the words from one on repeat with a period."""
    if doc_id is None or not text:
        return text
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    words = [] if rest else split_words(text)
    n = len(words)
    if not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)]).decode()


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = F.pandas_udf(lambda ids, texts: pd.Series([with_periods(None if pd.isna(i) else int(i), t) for i, t in zip(ids, texts, strict=True)], dtype=object), "string")
    docs = table(spark, sf_dir, "documents").select("doc_id", planted("doc_id", "text").alias("text"))
    found = periodic_runs.periodic_runs(docs, min_length=24, min_exponent=3)
    best = F.reduce("runs", F.col("runs")[0], lambda a, r: F.when(r.length * a.period > a.length * r.period, r).otherwise(a))
    line = lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))
    digests = [F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")]
    digest = found.select(F.col("doc_id").cast("long"), F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"), *digests)
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return digest.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256")


def op13_digit_slice_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4).withColumn("deviation", F.expr("try_cast(deviation as long)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kd_sharding": op1_kd_sharding,
    "op2_chroma_fingerprints": op2_chroma_fingerprints,
    "op3_html_template": op3_html_template,
    "op4_line_spread": op4_line_spread,
    "op5_minmax_near_duplicates": op5_minmax_near_duplicates,
    "op6_url_rules": op6_url_rules,
    "op7_seed_and_extend": op7_seed_and_extend,
    "op8_toxicity_fm": op8_toxicity_fm,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_cgk_decontamination": op10_cgk_decontamination,
    "op11_pu_quality": op11_pu_quality,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_digit_slice_whitening": op13_digit_slice_whitening,
}

LINE_SPREAD_SQL = r"""
WITH rows AS (
  SELECT doc_id, text, coalesce(source, chr(0)) AS site, string_split(text, chr(10)) AS lines FROM documents
), places AS (
  SELECT DISTINCT text, site, line FROM (SELECT text, site, unnest(list_transform(lines, lambda x: trim(x, ' '))) AS line FROM rows) WHERE line <> ''
), wide AS (
  SELECT line FROM places GROUP BY line HAVING count(DISTINCT site) >= 10 AND count(DISTINCT text) >= 10
), gone AS (
  SELECT list(line) AS gone FROM wide
)
SELECT doc_id,
       CASE WHEN text IS NULL THEN NULL ELSE array_to_string(list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), trim(x, ' '))), chr(10)) END AS text,
       coalesce(len(lines), 0)::BIGINT AS n_lines,
       coalesce(len(list_filter(lines, lambda x: list_contains(coalesce(gone, []), trim(x, ' ')))), 0)::BIGINT AS n_removed
FROM rows, gone
"""

URL_RULES_SQL = r"""
WITH parts AS (
  SELECT page_id, url, coalesce(contains(url, '://'), false) AS ok, substr(url, strpos(url, '://') + 3) AS rest FROM pages
), split AS (
  SELECT page_id, CASE WHEN ok THEN lower(regexp_extract(rest, '^[^/?#]*')) ELSE '' END AS host,
         CASE WHEN ok THEN regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') ELSE '' END AS path
  FROM parts
), rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fits AS (
  SELECT page_id, arg_max(verdict, length(rhost || rpath)) AS verdict, arg_max(rhost || rpath, length(rhost || rpath)) AS rule
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT page_id, host, path, rule,
       CASE WHEN fits.verdict IS NOT NULL THEN fits.verdict
            WHEN regexp_matches(host, '(^|[.-])(LABELS)[.-]') THEN 'block' ELSE 'allow' END AS verdict
FROM split LEFT JOIN fits USING (page_id)
""".replace("LABELS", "|".join(url_rules.BLOCKED_LABELS))

ORACLE_SQL: dict[str, str] = {
    "op4_line_spread": LINE_SPREAD_SQL,
    "op6_url_rules": URL_RULES_SQL,
}
