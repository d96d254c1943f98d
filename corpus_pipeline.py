"""A cleaning pipeline over ``documents``; every stage writes Parquet that the next one reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkfold.llm import decontaminate, line_spread, minmax, packing, toxicity_fm
from linkfold.llm.queries import TOXIC_FROM, table, tokenizer_path
from linkfold.llm.scratch import stored


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` don't have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on the labels that aren't held out, scores below the threshold."""
    score = unused(docs, "score")
    model = toxicity_fm.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity_fm.score(docs, model, score).filter(F.col(score) < TOXIC_FROM).drop(score)


def strip_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more sites carry."""
    held = docs.select("text", "source", F.struct(*docs.columns).alias("row"))  # the operator's own columns can't clash with those of a struct
    stripped = line_spread.remove_boilerplate(held, min_sites=10)
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return stripped.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the first of those with the smallest id, of each group of near-duplicates (five-word shingles, similarity of 0.8 or more).

    Rows are told apart by numbers of their own, so of repeated rows one stays, and rows without doc_id are judged like others.
    """
    row, gone = unused(docs, "row"), unused(docs, "gone")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = minmax.near_duplicates(numbered.select("doc_id", "text", row), percent=80, row=row).filter("not first").select(F.col(row).alias(gone))
    return numbered.join(found, numbered[row] == found[gone], "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, up to a fifth of its words edited."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), share=0.2, indels=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path(), 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_spread", strip_boilerplate),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: Toxicity scores come from a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
