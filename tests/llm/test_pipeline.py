"""The pipeline's stages on the smallest tables."""

import corpus_pipeline
from linkfold.llm.queries import ORACLE_SQL, QUERIES, table
from linkfold.llm.scratch import stored


def test_stages_keep_columns_and_clean_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, n = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns
        assert 0.7 * n < docs.count() <= n
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_stages_take_empty_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_take_nulls_repeats_and_clashing_names(spark, sf_dir):
    """Rows without any id, text or source, repeated rows, and columns with the names that operators use inside."""
    body = " ".join(f"word{k} of the long text" for k in range(40))
    rows = [(None, body, None, None, None), (None, body, None, None, None), (1, body + " end", "en", "s", 5), (2, None, None, None, None), (2, None, None, None, None), (3, "", "en", "s", 0), (3, "x y\n" * 30_000, "en", "s", 0)]
    names = ["score", "row", "first", "gone", "lost", "held", "_row", "kept"]
    docs = spark.createDataFrame([(*r, *names) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'{n} string' for n in names)}").repartition(3)
    columns = docs.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns and docs.select(*names).distinct().collect() == [tuple(names)]
        counts.append((name, docs.count()))
    # of the three long texts one stays, and all rows without words
    assert counts[-1][1] == 5 and counts[0][1] == 7
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.filter("doc_id is null or doc_id < 4").count() == packed.count() > 5


def test_stages_by_brute_force(spark, sf_dir):
    """The rows that each stage keeps of the smallest table, judged by plain Python on the stage's own input."""
    docs = table(spark, sf_dir, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stored(stage(spark, docs, sf_dir), "stage")
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        kept[name] = before, after
    before, after = kept["near_duplicates"]
    sets = {}
    for i, t in before.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in sets:
        for j in sets:
            common = len(sets[i] & sets[j])
            if i < j and common and 100 * common >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    assert set(after) == {i for i in sets if root(i) == i}
    before, after = kept["line_spread"]
    assert set(before) == set(after) and all(set(after[i].split("\n")) <= set(before[i].split("\n")) for i in after if after[i] is not None)
    before, after = kept["decontamination"]
    items = [" ".join(r["text"].lower().split()) for r in table(spark, sf_dir, "benchmark").collect()]
    exact = {i for i, t in before.items() if any(f" {x} " in f" {' '.join((t or '').lower().split())} " for x in items)}
    assert not exact & set(after)


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES} and set(ORACLE_SQL) <= set(QUERIES)
