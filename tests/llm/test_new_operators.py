"""Quality by positive-unlabelled learning, periodic runs and whitening: against brute force and plain readings, and on odd rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkfold.llm import periodic_runs, quality_pu, queries, whitening

# --- periodic runs


def plain_runs(word, min_length, min_exponent):
    """All maximal stretches in which letters q apart agree, by trying every q."""
    found = {}
    for q in range(1, len(word) // min_exponent + 1):
        i = 0
        while i + q < len(word):
            j = i
            while j + q < len(word) and word[j] == word[j + q]:
                j += 1
            if j - i and j + q - i >= max(min_length, min_exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("min_length, min_exponent", [(2, 2), (6, 3), (24, 3), (9, 4)])
def test_runs_are_those_of_brute_force(min_length, min_exponent):
    rng = random.Random(min_length)
    for k in range(600):
        n, letters = rng.randrange(90), rng.choice([1, 2, 3, 5])
        word = [rng.randrange(letters) for _ in range(n)]
        for _ in range(k % 4 if n > 4 else 0):  # plant periods, which meet and overlap
            at, p = rng.randrange(n), rng.randrange(1, 9)
            for i in range(at + p, min(n, at + rng.randrange(70))):
                word[i] = word[i - p]
        want = plain_runs(word, min_length, min_exponent)
        assert periodic_runs.runs_of(word, min_length, min_exponent) == want
        assert periodic_runs.runs_of_words([b"w%d" % w for w in word], min_length, min_exponent) == want


def test_lz_factors_are_the_longest_that_start_before():
    rng = random.Random(3)
    for _ in range(200):
        word = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
        at = 0
        for start, end, earlier in periodic_runs.lz_factors(word):
            assert start == at
            longest = max((k for j in range(start) for k in range(len(word) - start + 1) if word[j : j + k] == word[start : start + k]), default=0)
            assert end - start == max(longest, 1) and (earlier < 0) == (longest == 0)
            assert earlier < 0 or word[earlier : earlier + end - start] == word[start:end]
            at = end
        assert at == len(word)


def digest(doc_id, text):
    words = (text or "").encode().split()
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest == 0 and words:
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words, 24, 3)
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    row = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    texts = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode(), b" ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(runs), *row, *(hashlib.sha256(t).hexdigest() for t in texts)


def test_runs_query(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 23, 24, 90, 300]))) for _ in range(300)]
    texts += ["a b " * 40 + "x " * 30, "a b c　d " * 30, "the\x0bthe\n" * 500, None, "", " \n\t", " ".join(["a"] * 23), " ".join(["a"] * 24), "x y " * 26]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(7, texts[7]), (7, "other words")], "doc_id long, text string").withColumns({"runs": F.lit(1), "collapsed": F.lit("x"), "best": F.lit(2)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([digest(i, t) for i, t in enumerate(texts)] + [digest(7, texts[7]), digest(7, "other words")], key=str)
    assert any(r[1] > 1 for r in got) and sum(r[1] > 0 for r in got) > 12


def test_runs_take_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a " * 30), (None, None), (1, "a " * 30)], "doc_id long, text string")
    rows = periodic_runs.periodic_runs(docs).collect()
    assert sorted((str(r[0]), len(r.runs), r.collapsed) for r in rows) == [("1", 1, "a"), ("None", 0, ""), ("None", 1, "a")]
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    assert periodic_runs.runs_of_words([b"a"] * 50_000) == [(0, 50_000, 1)]
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, min_exponent=1)


# --- whitening


def test_digits_are_exact():
    x = np.array([0, 1, -1, 32767, 32768, -32768, -32769, 2**62, -(2**63), 2**63 - 1], dtype=np.int64)
    parts = whitening.digits(x)
    assert [sum(int(d[i]) << (16 * k) for k, d in enumerate(parts)) for i in range(len(x))] == x.tolist()
    assert all(-(2**15) <= d.min() and d.max() < 2**15 for d in parts) and len(whitening.digits(np.array([-3, 5]))) == 1


def test_products_are_exact(spark):
    """Sums and centred products of huge and tiny entries equal those of big integers."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-(2**63), 2**63 - 1, (40, 3)), rng.integers(-5, 5, (40, 3)), np.array([[2**63 - 1, -(2**63), 0]])])
    fit = spark.createDataFrame([(r,) for r in x.tolist()], "x array<long>").repartition(3)
    big = x.astype(object)
    sums = whitening.exact_sums(fit, 3)
    assert sums == big.sum(axis=0).tolist()
    centre = [s // len(x) for s in sums]
    shifted = big - np.array(centre, dtype=object)
    assert whitening.exact_products(fit, 3, centre) == shifted.T.dot(shifted).tolist()


def test_eigenvectors_of_uneven_scales():
    """Small eigenvalues beside large ones keep their digits; rank is that of the integers."""
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 8):
        scale = 10.0 ** -np.arange(n)
        base = rng.normal(size=(30, n))
        square = (base.T @ base / 30) * np.outer(scale, scale)
        values, vectors = whitening.eigen(square)
        assert np.all(np.diff(values) <= 0) and np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-15
        for k in range(n):
            residual = square @ vectors[:, k] - values[k] * vectors[:, k]
            assert np.abs(residual).max() < 1e-15 * values[0] and abs(values[k] / (vectors[:, k] @ square @ vectors[:, k]) - 1) < 1e-6
    assert whitening.rank([[2, 4], [4, 8]]) == 1 and whitening.rank([[0, 0], [0, 0]]) == 0 and whitening.rank([[0, 1], [1, 0]]) == 2


def test_whitening_query(spark, sf_dir, tmp_path):
    """Against numpy on the given table moved far from zero, with copies and unusable rows among it."""
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("embedding", F.transform("embedding", lambda c: c.cast("double") + 1e6))
    odd = spark.createDataFrame([(900_001, None), (900_002, [None] + [0.0] * 63), (900_003, [float("nan")] * 64), (900_004, [float("inf")] * 64), (900_005, [1.0])], "vec_id long, embedding array<double>")
    docs = given.select("vec_id", "embedding").unionByName(given.select("vec_id", "embedding").limit(40)).unionByName(odd).withColumns({"x": F.lit(1), "key": F.lit(2), "component": F.lit(3)})
    docs.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_digit_slice_whitening(spark, str(tmp_path)).toPandas()
    rows = given.toPandas()
    x = np.floor(256 * np.stack(rows["embedding"].to_numpy())).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov((fit - fit[0]).T.astype(float), bias=True))
    want = (x * n - sums) / n @ vectors[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    assert len(got) == 4 * (len(x) + 40) and set(got["n"]) == {n} and set(got["vec_id"]) == set(rows["vec_id"])
    first = got.drop_duplicates(["vec_id", "component"])
    table = first.pivot(index="vec_id", columns="component", values="whitened").loc[rows["vec_id"]].to_numpy()
    signs = np.sign((table * want).sum(axis=0))
    assert np.abs(table * signs - want).max() < 1e-6
    assert np.allclose(first.drop_duplicates("component").sort_values("component")["explained"], values[::-1][:4] / values.sum(), rtol=1e-9)
    deviation = first[first["component"] == 1].set_index("vec_id")["deviation"].loc[rows["vec_id"]].tolist()
    assert deviation == [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    assert set(got["identity_error"] < 1e-9) == {True}


def test_whitening_takes_odd_rows(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (7, [0.0, 0.5]), (7, [0.0, 0.5]), (None, [3.0, 1.0]), (9, []), (8, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(vectors).toPandas()
    assert len(got) == 10 and set(got["n"]) == {4} and not got["whitened"].isin([np.inf, -np.inf]).any()
    assert got[got["component"] == 2]["whitened"].isna().all() and (got[got["component"] == 2]["explained"] == 0).all()  # beside 2**63 it is nothing
    one = whitening.whiten(vectors.filter("vec_id = 7")).toPandas()
    assert len(one) == 4 and one[["whitened", "explained", "identity_error"]].isna().all().all() and set(one["deviation"]) == {0}
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], vectors.schema)).toPandas()
    assert len(flat) == 27 and flat[flat["component"] == 1]["whitened"].notna().all() and flat[flat["component"] > 1]["whitened"].isna().all()
    assert whitening.whiten(vectors.limit(0)).count() == 0
    assert whitening.whiten(vectors.limit(0)).columns == whitening.whiten(vectors).columns


# --- quality


def test_measures_of_small_texts():
    named = lambda text: dict(zip(quality_pu.MEASURES, quality_pu.measures(text), strict=True))
    assert quality_pu.measures(None) == quality_pu.measures("")
    a = named("Ab ab ab ###\nÉ 12")
    assert a["repeated_next"] == pytest.approx(1 / 6) and a["distinct_words"] == pytest.approx(5 / 6) and a["wordless"] == pytest.approx(2 / 6)
    assert a["log_lines"] == pytest.approx(np.log(3)) and a["marks"] == pytest.approx(3 / 17) and a["beyond_ascii"] == pytest.approx(1 / 17)
    assert len(quality_pu.measures("x" * 500_000)) == len(quality_pu.MEASURES)


def test_prior_from_counts():
    """Good texts uniform over the ranges; of all texts, the others lie in the lower half."""
    good = np.full(1_000, 50)
    for share in (0.2, 0.6, 0.9):
        everything = good * 20 * share + np.where(np.arange(1_000) < 500, 2_000 * (1 - share), 0)
        assert quality_pu.prior_of(good, everything) == pytest.approx(share, abs=0.03)
    assert quality_pu.prior_of(np.zeros(5), np.ones(5)) == 0.5


def test_risk_is_that_of_the_labels_without_them():
    """On rows whose bad part is known, the classifier from good and unlabelled rows agrees with it, for any prior."""
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8):
        truth = rng.random(4_000) < share
        others = np.where(truth[:, None], rng.binomial(7, 0.7, (4_000, 6)), rng.binomial(7, 0.3, (4_000, 6))).astype(np.uint8)
        good = rng.binomial(7, 0.7, (1_500, 6)).astype(np.uint8)
        weights, bias = quality_pu.minimise(good, others, 8, share)
        raw = bias + weights[np.arange(6), others].sum(axis=1)
        assert ((raw > 0) == truth).mean() > 0.97


def test_quality_learns_from_good_texts_only(spark):
    """Bad texts have no label at all; held-out labels, were they read, would say the opposite."""
    rng = random.Random(8)
    good = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.choice(['or', 'in', 'el'])}{rng.randrange(9)}".rstrip("0123456789") + "x" * rng.randrange(6) for _ in range(60)) + "."
    bad = lambda: " ".join(f"${rng.randrange(99)}%%%" for _ in range(60))
    kinds = [rng.random() < 0.7 for _ in range(900)]
    docs = spark.createDataFrame([(i, good() if k else bad(), "score") for i, k in enumerate(kinds)], "doc_id long, text string, lang string")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    labels = [(i, 0 if k else 1) for i, k in enumerate(kinds) if held(i)] + [(i, 1) for i, k in enumerate(kinds) if k and not held(i) and i % 2]
    table = quality_pu.measured(docs)
    model = quality_pu.fit(table, spark.createDataFrame(labels, "doc_id long, quality int"))
    share = sum(kinds) / len(kinds)
    assert abs(model.prior - share) < 0.1
    got = {r.doc_id: r.score for r in quality_pu.score(table, model).collect()}
    assert sum((got[i] >= 0.5) == k for i, k in enumerate(kinds)) > 890 and all(0 <= v <= 1 for v in got.values())


def test_quality_takes_odd_rows(spark):
    docs = spark.createDataFrame([(1, "A text of words."), (1, "Another one."), (None, "No id."), (3, None), (4, "")], "doc_id long, text string").withColumns({"quality": F.lit(1), "n": F.lit(2)})
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (None, 1), (5, None)], "doc_id long, quality int")
    table = quality_pu.measured(docs)
    scored = quality_pu.score(table, quality_pu.fit(table, labels)).collect()
    assert len(scored) == 5 and all(0 <= r.score <= 1 for r in scored)
    none = quality_pu.fit(table, labels.limit(0))
    assert {r.score for r in quality_pu.score(table, none).collect()} == {0.5}
    empty = quality_pu.fit(table.limit(0), labels)
    assert quality_pu.score(table.limit(0), empty).count() == 0 and {r.score for r in quality_pu.score(table, empty).collect()} == {0.5}
    with pytest.raises(ValueError):
        quality_pu.measured(docs, "n")
    with pytest.raises(ValueError):
        quality_pu.score(table, none, "quality")


def test_quality_on_held_out_rows(spark):
    """On a given table, without the labels of a third of the rows, these come out right."""
    got = queries.op11_pu_quality(spark, "/root/testdata/sf0.01").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    assert len(got) > 100 and (got["predicted"] == got["quality"]).mean() > 0.96 and got[got["quality"] == 1]["predicted"].mean() > 0.97
