"""Torn lexicon forms against the regular expression of each form."""

import random

from pyspark.sql import functions as F

from linkfold.functions.text import form_matches
from linkfold.operators import torn_forms

FORMS = ["каберне совиньон", "каберне", "Merlot", "merlot blanc", "port", "port wine", "portwine", "пино-нуар", "шато", "chateau", "l'or", "a.b", "сухое", "x", "Ёлка", "brut", "semi dry", "", " - ", "Straße"]


def _lexicon(spark, forms=FORMS):
    return spark.createDataFrame([("l", f.upper(), k, f, len(f.split())) for k, f in enumerate(forms)], "lexicon string, canon string, canon_pos int, form string, n_words int")


def test_torn_forms_are_those_of_the_expression(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["", None, "ка б ер-не", "каберне  -  совиньон", "каберне   -совиньон", "кабернесовиньон", "merlot", "мерло", "М Е Р Л О Т", "m e r l o t b l a n c", "mer   lot", "portwine", "port wine", "p-o-r-t", "sport wine", "port,wine"]
    texts += ["l'or", "l ' or", "a.b", "a b", "елка", "е л ка", "ШАТО", "chateau", "ch a teau", "шатоx", "_port", "port_", "портвейн", "пинонуар", "пино нуар", "Pino-Nuar", "pino n u a r", "semi-dry", "semidry", "port wine", "straße", "STRASSE", "éport", "port́"]
    pool = [c for f in FORMS for c in f] + [" ", "-", " ", "\n", ".", "é", "0"]
    for _ in range(150):
        words = [rng.choice(FORMS) if rng.random() < 0.7 else "".join(rng.choice(pool) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 4))]
        texts.append(rng.choice([" ", "-", "", ", "]).join(w if rng.random() < 0.5 else rng.choice([" ", "-", "  ", "   "]).join(w) for w in words))
    table = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("read", F.lit(1)).repartition(4)
    for transliterated in (True, False):
        every = table.select("id", "text").crossJoin(_lexicon(spark)).filter(form_matches(F.col("form"), F.col("text"), transliterated))
        want = sorted((r["id"], r["form"]) for r in every.select("id", "form").collect())
        got = torn_forms.torn_hits(table, _lexicon(spark), transliterated)
        assert sorted((r["id"], r["form"]) for r in got.collect()) == want
        assert len(want) > 100
    monkeypatch.setattr(torn_forms, "LETTERS", 30)
    assert sorted((r["id"], r["form"]) for r in torn_forms.torn_hits(table, _lexicon(spark), False).collect()) == want
    assert torn_forms.torn_hits(table.limit(0), _lexicon(spark)).count() == 0 == torn_forms.torn_hits(table, _lexicon(spark, [])).count()


def test_torn_query(spark, sf_dir):
    from linkfold.plans.registry import QUERIES

    names = {r["p_partkey"]: (r["p_size"], r["p_name"]) for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    got = {r["p_partkey"]: r for r in QUERIES["torn_lexicon"](spark, sf_dir).collect()}
    whole = {k: name for k, (size, name) in names.items() if size % 4 == 0}
    assert len(whole) > 20 and all(got[k]["first_form"] == name and set(name.split()) <= set(got[k]["forms"].split(",")) for k, name in whole.items())
    assert sum(k in got for k in names) > 0.8 * len(names)
