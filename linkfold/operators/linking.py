"""Links between names: exact keys, containment, shared tokens, and near-equal tokens, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkfold.functions.similarity import near_equal
from linkfold.functions.text import fold_accents, transliterate


def name_key(name: Column) -> Column:
    """Letters and digits of a name in Latin, without accents."""
    return F.regexp_replace(transliterate(fold_accents(F.coalesce(name, F.lit("")))), r"[^a-z0-9]", "")


def name_tokens(name: Column) -> Column:
    found = F.regexp_extract_all(transliterate(fold_accents(F.coalesce(name, F.lit("")))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= 2))


def link_names(names: DataFrame, known: DataFrame, least_share: float = 0.5, least_contained: int = 5) -> DataFrame:
    """(name, id, how): each distinct name of ``names`` linked to one of ``known`` (id, known_name), by the first rule that gives a link.

    Equal keys, then a key of ``least_contained`` characters or more within the other, then shared tokens of at least ``least_share`` of the longer list.
    Ties go to the smallest id.  Candidates for the second rule share the shorter key's run of ``least_contained`` characters that the fewest longer ones have, so a common beginning
    isn't joined on, those for the third a rare token; unlinked names have a null id.
    """
    names = names.filter("name is not null").select("name").distinct().withColumns({"key": name_key(F.col("name")), "tokens": name_tokens(F.col("name"))})
    known = known.select("id", name_key(F.col("known_name")).alias("known_key"), name_tokens(F.col("known_name")).alias("known_tokens"))
    by_key = known.filter("known_key != ''").groupBy(F.col("known_key").alias("key")).agg(F.min("id").alias("id"))
    exact = names.join(by_key, "key").select("name", "id", F.lit(1).alias("rule"), F.lit(0.0).alias("share"))

    left, right = names.select("name", "key"), known.select("id", "known_key")
    grams = lambda k: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(k) - least_contained + 1), lambda i: F.substring(k, i, F.lit(least_contained))))
    places = lambda df, key: df.filter(F.length(key) >= least_contained).select("*", F.explode(grams(F.col(key))).alias("g"))

    def by_rarest(short: DataFrame, key: str, long: DataFrame) -> DataFrame:
        """Each short key with that of its grams which the fewest long ones have; short keys with a gram that none has are in none."""
        held = long.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
        each = places(short.select(key).distinct(), key).join(held, "g", "left")
        chosen = each.groupBy(key).agg(F.min(F.struct("df", "g")).alias("rarest"), F.count_if(F.col("df").isNull()).alias("none")).filter("none = 0")
        return short.join(chosen.select(key, F.col("rarest.g").alias("g")), key)

    names_at, known_at = places(left, "key"), places(right, "known_key")
    inside = names_at.join(by_rarest(right, "known_key", names_at), "g").filter("contains(key, known_key)")
    around = known_at.join(by_rarest(left, "key", known_at), "g").filter("contains(known_key, key)")
    contained = inside.select("name", "id").unionByName(around.select("name", "id")).select("name", "id", F.lit(2).alias("rule"), F.lit(0.0).alias("share"))

    # lists that share ``least_share`` of the longer one have a token in common among the rarest of each that the rest can't make up for, so common
    # tokens are never joined on
    counts = known.select(F.explode("known_tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))

    def rarest(df: DataFrame, key: str, column: str) -> DataFrame:
        size = F.size(column)
        each = df.select(key, size.alias("size"), F.explode(column).alias("token")).join(counts, "token", "left")
        first = F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")))
        ordered = each.groupBy(key, "size").agg(first.alias("by_count"))
        kept = F.slice("by_count", F.lit(1), (F.col("size") - F.ceil(least_share * F.col("size")) + 1).cast("int"))
        return ordered.select(key, F.explode(F.transform(kept, lambda x: x["token"])).alias("token"))

    near = rarest(names, "name", "tokens").join(rarest(known, "id", "known_tokens"), "token").select("name", "id").distinct()
    both = near.join(names.select("name", "tokens"), "name").join(known.select("id", "known_tokens"), "id")
    share = F.size(F.array_intersect("tokens", "known_tokens")) / F.greatest(F.size("tokens"), F.size("known_tokens"))
    alike = both.withColumn("share", share).filter(F.col("share") >= least_share).select("name", "id", F.lit(3).alias("rule"), "share")

    found = exact.unionByName(contained).unionByName(alike)
    best = found.groupBy("name").agg(F.min(F.struct("rule", (-F.col("share")).alias("s"), "id")).alias("best"))
    how = F.element_at(F.array(F.lit("exact"), F.lit("contained"), F.lit("tokens")), F.col("best.rule"))
    return names.select("name").join(best, "name", "left").select("name", F.col("best.id").alias("id"), F.coalesce(F.when(F.col("best.rule").isNotNull(), how), F.lit("none")).alias("how"))


def near_equal_tokens(tokens: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of distinct ``tokens`` (token) that are nearly equal.

    Lengths of nearly equal tokens differ by one at most.  A token is cut into three parts, and two edits leave one of them whole, moved by two places at most; so each
    token looks its possible partners up by length and part, some fifty rows for a token of any length.
    """
    words = tokens.filter(F.length("token") >= 4).select("token").distinct().withColumn("n", F.length("token"))
    # of n letters, part k begins behind n * k // 3 of them
    begin = lambda n, k: F.floor(n * k / 3).cast("int")
    kept = F.array(*[F.struct(F.lit(k).alias("part"), F.expr(f"substring(token, int(floor(n * {k} / 3)) + 1, int(floor(n * {k + 1} / 3)) - int(floor(n * {k} / 3)))").alias("letters")) for k in range(3)])
    own = words.select(F.col("token").alias("b"), "n", F.explode(kept).alias("p")).select("b", "n", "p.part", "p.letters")
    asked = words.select("token", F.explode(F.array(F.col("n") - 1, F.col("n"), F.col("n") + 1)).alias("n"))
    asked = asked.select("token", "n", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("part"), F.col("n").alias("m"))
    low, size = begin(F.col("m"), F.col("part")), begin(F.col("m"), F.col("part") + 1) - begin(F.col("m"), F.col("part"))
    at = F.filter(F.transform(F.lit([-2, -1, 0, 1, 2]), lambda d: low + d), lambda s: (s >= 0) & (s + size <= F.length("token")))
    looked = asked.select("token", "n", "part", F.explode(F.array_distinct(F.transform(at, lambda s: F.substring("token", s + 1, size)))).alias("letters"))
    pairs = looked.withColumnRenamed("token", "a").join(own, ["n", "part", "letters"]).filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.filter(near_equal(F.col("a"), F.col("b")))
