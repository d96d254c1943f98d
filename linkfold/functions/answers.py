"""Answers of language and vision models as columns: JSON within other text, maps of scores, and recognised documents as lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def salvaged_json(raw: Column) -> Column:
    """The JSON object of an answer, as text: what a fence of three backticks holds, else all of it, else what lies between its first and last brace; null for none."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    fenced = F.nullif(F.trim(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)), F.lit(""))
    text = F.coalesce(fenced, text)
    braces = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    is_object = lambda t: F.coalesce(F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT"), F.lit(False))
    return F.when(is_object(text), text).when(is_object(braces), braces)


def score_map(document: Column) -> Column:
    """An array of (id, score), the best first, of a JSON object of scores by id: scores are held between 0 and 1, and what is no id or no number is left out."""
    entries = F.map_entries(F.from_json(document, "map<string, string>"))
    typed = F.transform(entries, lambda e: F.struct(F.trim(e["key"]).try_cast("long").alias("id"), e["value"].try_cast("double").alias("score")))
    known = F.filter(typed, lambda e: e["id"].isNotNull() & e["score"].isNotNull() & ~F.isnan(e["score"]))
    ordered = F.array_sort(F.transform(known, lambda e: F.struct((-F.greatest(F.lit(0.0), F.least(F.lit(1.0), e["score"]))).alias("s"), e["id"].alias("id"))))
    return F.transform(ordered, lambda e: F.struct(e["id"].alias("id"), F.round(-e["s"], 6).alias("score")))


#: A recognised document: pages of blocks of paragraphs of words of symbols.
ANNOTATION = "struct<pages: array<struct<blocks: array<struct<paragraphs: array<struct<words: array<struct<symbols: array<struct<text: string>>>>>>>>>>>"


def annotation_lines(document: Column) -> Column:
    """The paragraphs of a recognised document in JSON as lines: the words' symbols joined, words with a blank between; empty ones are left out."""
    d = F.from_json(document, ANNOTATION)
    word = lambda w: F.trim(F.array_join(F.transform(w["symbols"], lambda s: F.coalesce(s["text"], F.lit(""))), ""))
    line = lambda p: F.array_join(F.filter(F.transform(p["words"], word), lambda w: w != ""), " ")
    blocks = F.flatten(F.transform(d["pages"], lambda p: p["blocks"]))
    paragraphs = F.flatten(F.transform(blocks, lambda b: b["paragraphs"]))
    return F.coalesce(F.filter(F.transform(paragraphs, line), lambda x: x != ""), F.array().cast("array<string>"))


def rendered_prompt(template: str, text: Column, payload: Column) -> Column:
    """A prompt: the template with a recognised text and the candidates' JSON in their places."""
    return F.replace(F.replace(F.lit(template), F.lit("{{ocr_text}}"), F.trim(F.coalesce(text, F.lit("")))), F.lit("{{candidates_json}}"), payload)
