"""The numbered operators on small tables: against brute force, and on nulls, empty tables, ties, repeated rows and clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkfold.llm import chroma, decontaminate, html_template, line_spread, minmax, packing, seed_extend, sharding, toxicity_fm, url_rules
from linkfold.llm.components import connected_components
from linkfold.llm.queries import tokenizer_path
from linkfold.llm.scratch import stored
from linkfold.llm.words import folded_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos string, size string, node string"


def docs_of(spark, texts, first=0, source=lambda i: f"s{i % 3}"):
    rows = [(i, t, "en" if i % 2 else None, source(i), None, "x", "y", "z") for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def words(n, seed, vocabulary=5_000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(text, edits, seed):
    rng, out = random.Random(seed), list(text)
    for _ in range(edits):
        p = rng.randrange(len(out))
        what = rng.randrange(3)
        if what == 0:
            out[p] = f"new{rng.randrange(10**6)}"
        elif what == 1:
            out.insert(p, f"ins{rng.randrange(10**6)}")
        else:
            del out[p]
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies with one to thirty edits, shared passages, nulls, blanks, very long texts, in all a few hundred rows."""
    bases = [words(random.Random(k).choice([3, 5, 40, 120, 200]), k) for k in range(40)]
    passage = words(70, 999)
    texts = [" ".join(b) for b in bases]
    texts += [" ".join(edited(bases[k % 40], 1 + k % 7, 50 + k)) for k in range(120)]
    texts += [texts[k] for k in (0, 1, 2, 3, 3, 3)]
    texts += [" ".join(words(60, 300 + k) + passage + words(60, 400 + k)) for k in range(12)]
    texts += [" ".join(edited(words(150, 77), k % 4, 600 + k)) for k in range(60)]
    texts += [None, "", "  \n\t ", "One", "one", "ONE two", " ".join(words(20_000, 5)), " ".join(words(20_000, 5)) + " end", "the " * 300, "the " * 200]
    return texts


def test_scratch_refuses_a_cluster_without_a_shared_folder(spark):
    from types import SimpleNamespace

    from linkfold.llm import scratch

    def fake(master, folder=None):
        conf = SimpleNamespace(get=lambda key, default=None: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]", "k8s://h"):
        with pytest.raises(ValueError):
            scratch.shared_dir(fake(master))
    assert scratch.shared_dir(fake("yarn", "hdfs://n/shared/")) == "hdfs://n/shared"
    before = list(scratch._stored)
    scratch._stored.clear()
    table = scratch.stored(spark.range(3), "gone")
    path = scratch._stored[0].removeprefix("file://")
    import os

    assert table.count() == 3 and os.path.isdir(path)
    scratch.release()
    assert not os.path.exists(path) and not scratch._stored
    scratch._stored.extend(before)


def test_shards(spark, corpus):
    docs = docs_of(spark, corpus)
    docs = docs.unionByName(docs.limit(2)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    rows = sharding.kd_shards(docs, shards=7).toPandas()
    assert len(rows) == docs.count() and set(rows["shard"]) == set(range(7))
    text = {i: (t or "").encode() for i, t in enumerate(corpus)}
    known = rows.dropna(subset="doc_id")
    assert all(s == len(text[int(d)]) + 16 and c == zlib.crc32(text[int(d)]) for d, s, c in zip(known["doc_id"], known["size"], known["text_crc32"]))
    assert all(sorted(g) == list(range(len(g))) for _, g in rows.groupby("shard")["slot"])
    # without the two very long texts, which can't be cut, sizes differ by little more than a text
    small = docs.filter("length(text) < 5000 or text is null")
    sizes = sharding.kd_shards(small, shards=7).groupBy("shard").agg(F.sum("size").alias("n")).toPandas()["n"]
    assert sizes.max() - sizes.min() < 4_000 and sizes.min() > 0.8 * sizes.mean()
    assert sharding.kd_shards(docs.limit(0)).count() == 0
    assert sharding.kd_shards(small, None, target_bytes=20_000).agg(F.max("shard")).first()[0] >= 5


def test_shards_keep_groups_of_copies_whole(spark):
    """Groups up to a shard's size stay in one shard, one beyond is cut, and sizes are still near equal; the tree's splits match a plain reading of them."""
    texts = [" ".join(words(30, k)) for k in range(1_500)]
    for k, n in enumerate((5, 20, 60, 100, 140, 900)):
        texts += [" ".join(words(30, 9_000 + k))] * n
    docs = docs_of(spark, texts)
    rows = sharding.kd_shards(docs, shards=9).toPandas()
    where = rows.groupby("text_crc32")["shard"].nunique()
    total, biggest = rows["size"].sum(), zlib.crc32(texts[-1].encode())
    assert (where.drop(biggest) == 1).all() and where[biggest] > 1
    sizes = rows.groupby("shard")["size"].sum()
    assert len(sizes) == 9 and sizes.max() < 1.04 * total / 9 and sizes.min() > 0.96 * total / 9
    # a cut in the tree is the weighted quantile of its dimension, by plain sorting
    units = spark.createDataFrame([(1 + k % 7, int(x) << 32) for k, x in enumerate(np.random.default_rng(1).integers(0, 10**6, 5_000))], "weight long, x long")
    splits, numbers = sharding.split_tree(units, ["x"], [1.0, 1.0, 2.0])
    plain = sorted((r["x"], r["weight"]) for r in units.collect())
    below, whole = sum(w for x, w in plain if x <= splits[1][1]), sum(w for _, w in plain)
    assert set(numbers.values()) == {0, 1, 2} and abs(below / whole - 1 / 4) < 0.005


def test_components(spark):
    chain = [(i + 1, i) for i in range(0, 40)] + [(100, 101), (101, 102), (200, 200), (5, None)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and 200 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_links(texts, percent):
    sets = []
    for t in texts:
        w = t.encode().lower().split() if t else []
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, corpus, percent, monkeypatch):
    monkeypatch.setattr(minmax, "BLOCK", 8)
    docs = docs_of(spark, corpus)
    got = {r["doc_id"]: r for r in minmax.near_duplicates(docs, percent).collect()}
    want = brute_links(corpus, percent)
    assert {i: (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in got} == {i: (n, c, c == i) for i, (n, c) in enumerate(want)}


def test_near_duplicates_edges(spark):
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "A B  C"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"], r["kept"]) for r in minmax.near_duplicates(df).collect())
    assert got == [(False, 1, 1, True), (False, 1, 1, True), (False, 2, 1, False), (False, 3, 3, True), (True, 0, None, True)]
    # one row of each group stays: repeated rows, rows without id, and different texts under one id
    rows = [(0, None, "a b c"), (1, 1, "a b c"), (2, 1, "a b c"), (3, 2, "A B  C"), (4, 3, None), (5, 3, None), (6, 4, "d e f"), (7, 4, "g h i"), (8, 5, "G H I"), (9, None, "k l m"), (10, None, "k l m")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "n long, doc_id long, text string, row string").repartition(3)
    got = {r["n"]: (r["component_id"], r["first"]) for r in minmax.near_duplicates(df, row="n").collect()}
    assert got == {0: (None, False), 1: (1, True), 2: (1, False), 3: (1, False), 4: (3, True), 5: (3, True), 6: (4, True), 7: (4, True), 8: (4, False), 9: (None, True), 10: (None, False)}
    assert minmax.near_duplicates(df.limit(0)).count() == 0


def test_signature_estimates_similarity():
    a, b = np.arange(1_000, dtype=np.uint64), np.arange(200, 1_200, dtype=np.uint64)
    from linkfold.llm.words import mix

    same = (minmax.signature(mix(a)) == minmax.signature(mix(b))).mean()
    assert abs(same - 800 / 1200) < 0.1


def brute_repeats(texts, window):
    first, out = {}, []
    for i, t in enumerate(texts):
        w = t.encode().split() if t else []
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k : k + window]), i) < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(spark, corpus):
    got = {r["doc_id"]: r for r in seed_extend.remove_repeats(docs_of(spark, corpus)).collect()}
    want = brute_repeats(corpus, 50)
    assert sum(n for _, n, _ in want) > 5_000
    assert [(got[i]["n_words"], got[i]["n_removed"], hashlib.sha256(got[i]["kept_text"].encode()).hexdigest()) for i in range(len(corpus))] == want
    # rows that share an id: neither is smaller than the other, and each is judged by its own text, in whatever order they come
    long = words(200, 1)
    for other in ("x y z", " ".join(words(250, 2)), " ".join(long[40:120] + words(30, 3)), " ".join(words(20, 4) + long[:60])):
        rows = [(1, " ".join(long)), (5, " ".join(long[30:160])), (5, other), (5, other), (7, " ".join(words(250, 2))), (-3, None), (7, other)]
        first = {}
        for d, t in rows:
            w = (t or "").split()
            for k in range(len(w) - 49):
                first[tuple(w[k : k + 50])] = min(d, first.get(tuple(w[k : k + 50]), d))
        want = []
        for d, t in rows:
            w = (t or "").split()
            gone = {i for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < d for i in range(k, k + 50)}
            want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
        for order in (rows, rows[::-1]):
            df = spark.createDataFrame(order, "doc_id long, text string").withColumn("copy", F.lit(1))
            assert sorted(map(tuple, seed_extend.remove_repeats(df).collect())) == sorted(want)
    df = spark.createDataFrame([(None, "x " * 90), (None, "x " * 90)], "doc_id long, text string")
    assert [r["n_removed"] for r in seed_extend.remove_repeats(df).collect()] == [0, 0]
    assert seed_extend.remove_repeats(df.limit(0)).count() == 0


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = [*corpus, "no<|endoftext|>blank <|startoftext|>", "<|ENDOFTEXT|> <|endoftext", "what's that's 'tis rock'n'roll!' (\"a\")% b... c-d e_f g's. h'", "Ünïcode ’tis don't I'LL 12,5% 中文字 <|endoftext|> a b c\x1cd\x85e", "x" * 5_000, "İstanbul ΣΑΣ é", "a\x7fb \x01 Straße ŒUVRE ё1ж Привет'S e\u0301 ﬁ \xadx"]
    docs = docs_of(spark, texts)
    rows = packing.pack(stored(packing.token_pieces(docs, tokenizer_path(), 256), "pieces"), 256, partition_items=60).toPandas()
    by_doc = {d: g.sort_values("piece") for d, g in rows.groupby("doc_id")}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = [ids[k : k + 256] for k in range(0, len(ids), 256)]
        g = by_doc[i]
        assert list(g["length"]) == [len(p) for p in pieces] and list(g["start"]) == [256 * k for k in range(len(pieces))]
        assert list(g["ids_crc32"]) == [zlib.crc32(np.array(p, dtype="<u4").tobytes()) for p in pieces]
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 256
    least = -(-rows["length"].sum() // 256)
    assert rows["sequence_id"].nunique() <= 1.02 * least + 2
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0
    nulls = packing.pack_documents(spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string"), tokenizer_path()).collect()
    assert sorted(r["length"] for r in nulls) == [1, 2]


def test_packing_stops_only_when_no_two_meet(spark):
    """Nearly all pieces are over half a sequence; the few short ones of the partitions still find a place."""
    rng = random.Random(2)
    sizes = [rng.randint(140, 170) for _ in range(400)] + [rng.randint(60, 110) for _ in range(9)]
    df = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], packing.PIECE_SCHEMA)
    rows = packing.pack(df, 256, partition_items=50).toPandas()
    rooms = sorted(rows.groupby("sequence_id")["length"].sum())
    assert len(rows) == len(sizes) and rooms[0] + rooms[1] > 256 and rooms[-1] <= 256 and len(rooms) == 400


def test_best_fit_takes_the_tightest():
    assert packing.best_fit([60, 50, 40, 30, 20], 100) == [0, 1, 0, 1, 1]


def test_line_spread(spark):
    boiler, near = "All rights reserved.", "Only on nine sites."
    texts = [f"own text {i}\n{boiler}\n{near if i < 9 else ''}\nmore {i}" for i in range(30)]
    texts += ["copied page with a long first line of its own\nsecond copied line"] * 30
    texts += [None, "", boiler]
    docs = docs_of(spark, texts, source=lambda i: f"site{i % 20}")
    out = {r["doc_id"]: r for r in line_spread.remove_boilerplate(docs, 10).collect()}
    assert all(out[i]["text"] == texts[i].replace(f"{boiler}\n", "") and out[i]["n_removed"] == 1 for i in range(30))
    assert all(out[i]["text"] == texts[i] and out[i]["n_removed"] == 0 for i in range(30, 62))
    assert out[62]["text"] == "" and out[60]["n_lines"] == 0 and out[61]["n_lines"] == 1
    assert line_spread.remove_boilerplate(docs, 10).columns == [*docs.columns, "n_lines", "n_removed"]
    assert line_spread.remove_boilerplate(docs.limit(0)).count() == 0


def test_line_spread_takes_odd_rows(spark):
    """Null ids and sources, repeated rows, long texts, and columns with the names used inside."""
    texts = [f"own {i}\nshared line" for i in range(12)] + ["x y\n" * 200_000 + "shared line"]
    rows = [(None if i < 3 else 7, t, f"s{i}" if i else None, "a", "b", "c", 1, 2) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lost string, lines string, doc string, n_lines int, rest int")
    out = line_spread.remove_boilerplate(df, 10)
    assert out.columns == ["doc_id", "text", "source", "lost", "lines", "doc", "rest", "n_lines", "n_removed"]
    got = out.collect()
    assert len(got) == 26 and all("shared line" not in r["text"] and r["n_removed"] == 1 and r["lost"] == "a" and r["rest"] == 2 for r in got)


def test_line_spread_near_threshold_is_exact(spark):
    texts = [f"a long line of its own in document {i}\n" + "\n".join(f"shared by {k}" for k in range(5, 16) if i < k) for i in range(16)]
    out = line_spread.remove_boilerplate(docs_of(spark, texts, source=lambda i: f"site{i}"), 10).collect()
    left = {line for r in out for line in r["text"].split("\n") if line.startswith("shared")}
    assert left == {f"shared by {k}" for k in range(5, 10)}


def test_line_spread_removes_lines_of_copies_and_blocks(spark):
    footer, block = "A footer of many pages.", ["Terms of use and privacy, long line one", "Imprint and contact, also a long line"]
    page = "\n".join(f"line {k} of a page that was copied to many sites" for k in range(6))
    texts = [f"{page}\n{footer}"] * 60 + [f"own text of page {i}, which is no copy\n{footer}" for i in range(30)]
    texts += ["\n".join([*block, *(f"short {i} {k}" for k in range(6))]) for i in range(30)]
    texts += ["Nothing but this line."] * 20 + [f"{i} other text around it, which is longer\nNothing but this line." for i in range(12)]
    header = "The same header on every site, which is longer than what is below."
    texts += [f"{header}\n{i} short\n{header[::-1]}" for i in range(200)]
    out = {r["doc_id"]: r["text"] for r in line_spread.remove_boilerplate(docs_of(spark, texts, source=lambda i: f"site{i % 20}"), 10).collect()}
    gone = {header, header[::-1]} | {footer, *block, "Nothing but this line."}
    assert out == {i: "\n".join(x for x in t.split("\n") if x not in gone) for i, t in enumerate(texts)}


def test_decontamination_recall(spark):
    items = [(k, " ".join(words(15 + k % 40, 10_000 + k))) for k in range(60)]
    texts, truth = [], set()
    for i in range(300):
        k = i % 60
        w = items[k][1].split()
        texts.append(" ".join(words(80, 20_000 + i) + edited(w, random.Random(i).randint(0, len(w) // 5), i) + words(50, 30_000 + i)))
    texts += [" ".join(words(200, 40_000 + i)) for i in range(100)] + [None, "", "a"]
    hashed = {k: folded_hashes(t) for k, t in items}
    for i in range(300):
        h, item = folded_hashes(texts[i]), hashed[i % 60]
        windows = np.lib.stride_tricks.sliding_window_view(h, len(item))
        if decontaminate.edit_distances(windows, np.broadcast_to(item, windows.shape)).min() <= decontaminate.allowed(len(item), 0.2):
            truth.add((i, i % 60))
    table = spark.createDataFrame([*items, (None, "x"), (99, None), (98, "")], "item_id long, text string")
    found = decontaminate.contaminated(docs_of(spark, texts), table).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert got <= truth and len(got) >= 0.95 * len(truth) and len(truth) > 250
    clean = decontaminate.decontaminate(docs_of(spark, texts), table)
    assert clean.columns == docs_of(spark, texts).columns and clean.count() == len(texts) - len({d for d, _ in got})
    assert decontaminate.contaminated(docs_of(spark, texts), table.limit(0)).count() == 0


def test_decontamination_finds_inserted_and_deleted_words(spark):
    items = [(k, " ".join(words(15 + k % 40, 10_000 + k))) for k in range(60)]
    texts, truth = [], set()
    for i in range(600):
        w = items[i % 60][1].split()
        part = edited(w, random.Random(i).randint(0, len(w) // 5), i)
        # half of the passages are texts of their own
        texts.append(" ".join(words(80, 20_000 + i) + part + words(50, 30_000 + i) if i < 300 else part))
        truth.add((i, i % 60))
    texts += [" ".join(items[0][1].split()[:-1]), " ".join(items[1][1].split()[2:]), " ".join(items[2][1].split()[:9])]
    truth |= {(600, 0), (601, 1)}
    found = decontaminate.contaminated(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"), indels=True).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    print(len(got), len(truth))
    assert got <= truth and len(got) >= 0.97 * len(truth) and {(600, 0), (601, 1)} <= got
    assert all(r["start"] >= 0 and r["distance"] <= len(items[r["item_id"]][1].split()) // 5 for r in found)
    assert {r["doc_id"]: r["distance"] for r in found}[600] == 1


@pytest.mark.parametrize("m, n", [(15, 120), (60, 60), (150, 30), (300, 16)])
def test_decontamination_recall_at_the_limit(m, n):
    """Passages with all the edits that an item of any length allows, substituted or mixed."""
    items = decontaminate.Items([(k, " ".join(words(m, 70_000 + k))) for k in range(n)], 0.2, indels=True)
    found = 0
    for mixed in (False, True):
        docs = []
        for k in range(n):
            part, rng = words(m, 70_000 + k), random.Random(k)
            if mixed:
                part = edited(part, m // 5, k)
            else:
                for p in rng.sample(range(m), m // 5):
                    part[p] = f"new{rng.randrange(10**6)}"
            docs.append((k, folded_hashes(" ".join(words(40, 80_000 + k) + part + words(40, 90_000 + k)))))
        found += sum(d == i for d, i, _, distance in items.find(docs) if distance <= m // 5)
    assert found >= 0.95 * 2 * n


def test_decontamination_of_very_short_items(spark):
    items = [(1, "one"), (2, "two words"), (3, "three short words"), (4, "One!"), (5, "now four short words"), (6, "five words make the limit")]
    texts = ["one", "a One, b", "two words", "words two", "so three short words.", "three words", "now four short words", "five words made the limit", None, ""]
    found = decontaminate.contaminated(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"), indels=True).collect()
    want = [(0, 1, 0, 0), (0, 4, 0, 0), (1, 1, 1, 0), (1, 4, 1, 0), (2, 2, 0, 0), (4, 3, 1, 0), (6, 5, 0, 0), (7, 6, 0, 1)]
    assert sorted((r["doc_id"], r["item_id"], r["start"], r["distance"]) for r in found) == want


def test_decontamination_folds_case_and_marks(spark):
    item = "Éai éonleeau pour an éonqueê aivi ai, éenai éoiré anvitre (èenreré) ouan. La fin"
    texts = [f"avant {item.upper()} après", f"avant {'! '.join(item.split())}!! après", "rien de cela"]
    found = decontaminate.contaminated(docs_of(spark, texts), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["start"], r["distance"]) for r in found) == [(0, 1, 0), (1, 1, 0)]


def test_decontamination_takes_odd_rows_and_many_blocks(spark, monkeypatch):
    items = [(k, " ".join(words(20, 50_000 + k))) for k in range(12)]
    texts = [f"before {items[i % 12][1]} after" if i % 2 else " ".join(words(40, 60_000 + i)) for i in range(48)] + [" ".join(words(120_000, 3)) + " " + items[0][1]]
    rows = [(None if i < 6 else i // 2, t, i, "h", "r") for i, t in enumerate(texts)] + [(99, None, 98, "h", "r"), (99, "", 99, "h", "r")]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string, n int, held string, row string").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    want = sorted([r[2] for r in rows if r[2] % 2 == 0 and r[2] != 48 or r[2] == 99] * 2)
    kept = decontaminate.decontaminate(df, table)
    assert kept.columns == df.columns and sorted(r["n"] for r in kept.collect()) == want
    once = decontaminate.contaminated(df, table).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 60)
    monkeypatch.setattr(decontaminate, "BROADCAST_TEXTS", 1)
    assert sorted(decontaminate.contaminated(df, table).collect()) == sorted(once) and len(once) == 2 * 22
    assert sorted(r["n"] for r in decontaminate.decontaminate(df, table).collect()) == want


def test_edit_distances():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 4, (50, 12)), rng.integers(0, 4, (50, 12))
    assert list(decontaminate.edit_distances(a, b)) == [plain(x, y) for x, y in zip(a.tolist(), b.tolist())]


def test_toxicity_scores_are_a_plain_double_sum():
    rng = np.random.default_rng(9)
    model = toxicity_fm.Model({k: k for k in range(30)}, -0.4, rng.normal(size=30), rng.normal(size=(30, toxicity_fm.FACTORS)) / 3)
    rows = [sorted(rng.choice(30, n, replace=False).tolist()) for n in (0, 1, 2, 9, 30)]
    for row, got in zip(rows, model.scores(rows)):
        raw = model.bias + sum(model.weights[i] for i in row) + sum(float(model.factors[i] @ model.factors[j]) for i in row for j in row if i < j)
        assert abs(got - 1 / (1 + np.exp(-raw))) < 1e-12


def test_toxicity_takes_odd_rows(spark):
    """Labels that contradict each other, repeated rows, null ids, long texts, and a column of the score's name."""
    rows = [(i % 400, ("vermin " if i % 2 else "") + " ".join(words(20, i, 200)), "x") for i in range(800)] + [(None, "vermin", "x"), (1, "vermin " * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(400)] + [(i, 0) for i in range(400)], "doc_id long, toxic int")
    model = toxicity_fm.fit(docs, labels)
    with pytest.raises(ValueError):
        toxicity_fm.score(docs, model)
    got = toxicity_fm.score(docs, model, "found").toPandas()
    assert len(got) == 802 and (got["score"] == "x").all()
    toxic = got["text"].str.startswith("vermin")
    assert got["found"][toxic].min() > 0.5 > got["found"][~toxic].max()


def test_toxicity_learns_pairs(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1_600):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w = words(60, i, 300) + ["vermin"] * insult + ["neighbours"] * group
        rows.append((i, " ".join(w)))
        labels.append((i, int(insult and group)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5_000, None)], "doc_id long, toxic int")
    model = toxicity_fm.fit(docs, marks)
    scored = toxicity_fm.score(docs.unionByName(spark.createDataFrame([(9_998, None), (9_999, "")], "doc_id long, text string")), model)
    got = scored.withColumn("held", toxicity_fm.held_out()).toPandas().set_index("doc_id")
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert set(got.index[got["held"]]) - {9_998, 9_999} == set(held)
    right = np.mean([(got["score"][i] >= 0.3) == truth[i] for i in held])
    assert right > 0.97 and got["score"].between(0, 1).all()
    assert toxicity_fm.score(docs.limit(3), toxicity_fm.fit(docs.limit(0), marks)).count() == 3


@pytest.mark.parametrize(("url", "want"), [
    ("https://Blog.Example.COM/en/77?x", ("blog.example.com", "/en/77", "example.com/en/7", "allow")), ("http://a.com/en/x", ("a.com", "/en/x", "com/en/", "block")),
    ("http://example.net/de/81", ("example.net", "/de/81", "example.net/de/8", "block")), ("http://x.net/de/1", ("x.net", "/de/1", "net/de/", "allow")),
    ("http://w.spam-farm.example.org/fr/1", ("w.spam-farm.example.org", "/fr/1", None, "block")), ("http://notspam-farmer.org#a", ("notspam-farmer.org", "", None, "allow")),
    ("http://myexample.com/en/7", ("myexample.com", "/en/7", "com/en/", "block")), ("no url", ("", "", None, "allow")), (None, ("", "", None, "allow")),
])
def test_url_rules(url, want):
    host, path = url_rules.split_url(url)
    rules = url_rules.HOST_RULES + url_rules.LABEL_RULES
    counts = {t: len(t) for r in rules for t in r.tokens}
    assert (host, path, *url_rules.RuleIndex(rules, counts).judge(host, path)) == want


def test_url_rules_of_a_table_and_odd_rows(spark):
    table = [(3, "host", "allow", "a.com", "/x"), (1, "label", "block", "shop", None), (2, "host", "block", "a.com", "/x"), (4, "host", "allow", "com", "/")]
    rules = url_rules.rules_of(spark.createDataFrame(table, "place int, kind string, verdict string, host string, path string"))
    urls = [(1, "http://a.com/x/1"), (None, "http://shop.b.org/"), (1, "http://a.com/x/1"), (2, "http://b.com/x"), (3, None)]
    df = spark.createDataFrame([(*u, "r", "v") for u in urls], "page_id long, url string, rule string, verdict string")
    got = sorted(((r["page_id"] or 0, r["rule"], r["verdict"]) for r in url_rules.judge_urls(df, rules).collect()), key=str)
    # of two rules alike in strength the first in order decides
    assert got == [(0, None, "block"), (1, "a.com/x", "block"), (1, "a.com/x", "block"), (2, "com/", "allow"), (3, None, "allow")]
    for bad in ((1, "host", "maybe", "a", "/"), (1, "path", "allow", "a", "/"), (1, "host", "allow", None, "/")):
        with pytest.raises(ValueError):
            url_rules.rules_of(spark.createDataFrame([bad], "place int, kind string, verdict string, host string, path string"))


def test_url_index_is_all_rules(spark):
    """Fetching candidates by token judges as trying every rule does."""
    rng = random.Random(8)
    rules = tuple(url_rules.host_rule(rng.choice(["allow", "block"]), f"{rng.choice('abcd')}.{rng.choice(['com', 'net'])}", f"/{rng.choice('xyz')}{rng.randrange(3)}") for _ in range(40)) + url_rules.LABEL_RULES
    urls = [f"http://{rng.choice('abcdw')}.{rng.choice('abcd')}.{rng.choice(['com', 'net', 'org'])}/{rng.choice('xyz')}{rng.randrange(30)}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge_urls(df, rules).collect()}
    import re

    for i, url in enumerate(urls):
        subject = "\0".join(url_rules.split_url(url))
        fits = [r for r in rules if re.match(r.pattern, subject, re.DOTALL)]
        top = max(fits, key=lambda r: r.strength, default=None)
        assert (got[i][0] == top.shown if top else got[i] == (None, "allow"))
    assert url_rules.judge_urls(df.limit(0)).count() == 0


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><div class="cookie-notice">We use cookies</div><header><h2>Site</h2></header>
<nav><ul><li><a href=/>Home</a><li>About</ul></nav><div class="wrap"><{tag}><h1>Title {i}</h1><p>First &amp; <b>bold</b><br>text {i}.<p>Second
 para&eacute; {i}.</p><div class="ad">Buy {i}</div><form><p>Your mail</p></form><section class="comments"><p>Reader {i} says</p></section></{tag}></div>
<aside>Popular {i}</aside><footer>&copy; {i}</footer></body></html>"""


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_main_text(spark, tag):
    rows = [(i, f"http://h.org/{i}", PAGE.replace("{tag}", tag).replace("{i}", str(i))) for i in range(6)] + [(7, None, None), (8, "http://h.org/8", ""), (9, "u", "plain words"), (9, "u", "plain words")]
    got = {r["page_id"]: r["text"] for r in html_template.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\n\nFirst & bold text {i}.\n\nSecond paraé {i}." for i in range(6))
    assert got[7] == "" and got[8] == "" and got[9] == "plain words"
    assert html_template.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', "style='overflow-x: hidden'", 'data-state="hidden"', 'data-id="related" data-role=menu', 'title="a class=nav id=ad"', "data-hidden", "x=1/hidden"])
def test_attributes_are_whole_names(attributes):
    assert html_template.Page.marks(f" {attributes}") == (set(), False)
    for tag in ("body", "article", "div"):
        page = html_template.Page(f"<html><{tag} {attributes}><p>The text of the page.</p></{tag}></html>")
        assert html_template.extract(page, None) == "The text of the page."
    assert html_template.Page.marks(f' {attributes} CLASS = "Nav x" id=ad hidden') == ({"Nav", "x", "ad"}, True)
    assert html_template.Page.marks(" aria-hidden=true") == (set(), True) and html_template.Page.marks(" aria-hidden='false'") == (set(), False)


def texts_of(spark, htmls, host="h.org"):
    df = spark.createDataFrame([(i, f"http://{host}/{i}", h, "clash", 1) for i, h in enumerate(htmls)], "page_id long, url string, html string, text string, packed int").repartition(4)
    return [r["text"] for r in html_template.main_texts(df).orderBy("page_id").collect()]


@pytest.mark.parametrize(
    "inline, want",
    [
        ("<span hidden>secret</span>", ""), ("<span class='advert'>BUY <b>NOW</b> <span>x</span></span>", ""), ("<label>Name</label>", ""), ("<video>No video</video>", ""), ("<ad-slot>buy</ad-slot>", ""),
        ("<b aria-hidden='true'>x</b>", ""), ("<a id='promo' href='/x'>x</a>", ""), ("<span class='price'>5</span>", " 5"), ("<my-word>kept</my-word>", " kept"), ("<a href='?class=ad&id=promo'>kept</a>", " kept"), ("<span data-class='advert'>kept</span>", " kept"),
    ],
)
def test_inline_elements_are_judged(spark, inline, want):
    page = f"<html><body><article><p>First words {inline} of a text.</p><p>Open <span class='advert'>until its block ends</p><p>Last words.</p></article></body></html>"
    rows = html_template.main_texts(spark.createDataFrame([(1, "http://a/1", page)], "page_id long, url string, html string")).collect()
    assert rows[0]["text"] == f"First words{want} of a text.\n\nOpen\n\nLast words."


def test_classes_decide_what_is_template(spark):
    """A notice in a container of its own goes, on a third of the pages too; a passage that as many pages share among their paragraphs stays."""
    notice, passage = '<div class="zq"><p>Our readers choose this tea</p></div>', "<p>A passage that pages quote word by word</p>"
    page = "<html><body><article><h1>Head {i}</h1><p>story {i} is told here at length</p>{a}{b}<p>tail {i} of it</p></article></body></html>"
    htmls = [page.replace("{a}", notice if i % 3 == 0 else "").replace("{b}", passage if i % 3 == 1 else "").replace("{i}", str(i)) for i in range(24)]
    want = [f"Head {i}\n\nstory {i} is told here at length\n\n" + ("A passage that pages quote word by word\n\n" if i % 3 == 1 else "") + f"tail {i} of it" for i in range(24)]
    assert texts_of(spark, htmls) == want
    # with each notice's container under another name, its class is broken up: no template, and the texts stay
    broken = [h.replace("zq", f"zq{i}x") for i, h in enumerate(htmls)]
    assert texts_of(spark, broken)[0] == want[0].replace("tail", "Our readers choose this tea\n\ntail")
    # tokens of equal vectors that come in another order on half of the pages aren't a class
    other = '<div class="b1"><p>One text of the notice</p></div>', '<div class="b2"><p>Another text of the notice</p></div>'
    mixed = [page.replace("{a}", "".join(other[:: 1 if i % 2 else -1])).replace("{b}", "").replace("{i}", str(i)) for i in range(12)]
    assert all("One text of the notice" in t for t in texts_of(spark, mixed))
    assert not any("text of the notice" in t for t in texts_of(spark, [page.replace("{a}", "".join(other)).replace("{b}", "").replace("{i}", str(i)) for i in range(12)]))


def test_copies_of_a_page_keep_their_text(spark):
    page = "<html><body><div><h1>One head</h1><p>The same story on every page of this host</p></div></body></html>"
    assert texts_of(spark, [page] * 8) == ["One head\n\nThe same story on every page of this host"] * 8


@pytest.mark.parametrize(("name", "out"), [("no-sidebar", False), ("layout no-sidebar", False), ("share-price", False), ("cookieBanner", True), ("ad-box", True), ("site-footer", True), ("related_posts", True), ("adaptive", False), ("searchlight", False)])
def test_class_names_count_whole(name, out):
    page = html_template.Page(f'<body><div class="{name}"><p>A price of a share.</p></div><p>Rest.</p></body>')
    assert html_template.extract(page, None) == ("Rest." if out else "A price of a share.\n\nRest.")
    page = html_template.Page(f'<body><article><p class="{name}">A price of a share.</p><p>Rest.</p></article></body>')
    assert html_template.extract(page, None) == ("Rest." if out else "A price of a share.\n\nRest.")


def test_deep_and_long_pages():
    import time

    began = time.perf_counter()
    page = html_template.Page("<div>" * 30_000 + "<p>deep</p>" + "</div>" * 30_000 + "<p>x &lt; y" * 20_000)
    assert len(page.blocks) == 20_001 and html_template.extract(page, None).startswith("deep\n\nx < y")
    assert time.perf_counter() - began < 10


def plain_article(text):
    """The blocks of a page's article by the standard library's parser, for the pages of the tables, which have one each."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        inside, blocks, part = False, (), ""

        def flush(self):
            words = " ".join(self.part.split())
            self.blocks, self.part = (*self.blocks, words) if words and self.inside else self.blocks, ""

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.part += " "
            elif tag in ("article", "p", "h1", "div", "nav", "footer", "ul", "li"):
                self.flush()
                self.inside = self.inside or tag == "article"

        def handle_endtag(self, tag):
            if tag in ("article", "p", "h1", "div", "nav", "footer", "ul", "li"):
                self.flush()
                self.inside = self.inside and tag != "article"

        def handle_data(self, data):
            self.part += data if self.inside else ""

    reader = Reader()
    reader.feed(text or "")
    reader.flush()
    return "\n\n".join(reader.blocks)


def test_main_texts_agree_with_a_plain_reader(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in html_template.main_texts(pages).collect()}
    assert got == {k: plain_article(h) for k, h in html.items()}


def test_equivalence_classes_drop_constant_text(spark):
    page = "<html><body><div><p>Sign in to read more</p><p>story {i} with many words of its own</p><p>tail {i}</p></div></body></html>"
    rows = [(i, "http://h.org/x", page.replace("{i}", str(i))) for i in range(5)]
    got = [r["text"] for r in html_template.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert got == [f"story {i} with many words of its own\n\ntail {i}" for i in range(5)]


def test_chroma(spark):
    rng = np.random.default_rng(5)
    tune = rng.normal(size=64) / 8
    vectors = [tune.tolist(), np.r_[tune[8:], rng.normal(size=8) / 8].tolist(), (rng.normal(size=64) / 8).tolist(), tune.tolist(), None, [], [None, 1.0], (rng.normal(size=64) / 8).tolist()]
    df = spark.createDataFrame([(100 + i, v) for i, v in enumerate(vectors)] + [(None, tune.tolist())], "id long, vector array<double>")
    prints = chroma.melody_fingerprints(df)
    got = {r["id"]: r for r in chroma.align(prints, F.col("id") % 100 == 0).collect()}
    assert got[101]["query_id"] == 100 and abs(got[101]["shift"]) == 8 and got[101]["bit_errors"] < 0.2 and got[101]["common"] >= 32
    assert got[103]["query_id"] == 100 and got[103]["bit_errors"] == 0 and got[103]["class_id"] == 100
    assert got[102]["query_id"] is None and got[107]["query_id"] is None and got[104]["n_prints"] == 0 and got[100]["query_id"] is None
    assert chroma.align(prints.limit(0), F.lit(True)).count() == 0


def brute_alignment(prints, asks, max_errors, least_common):
    """{(recording, query): least bit errors} over all offsets, by plain comparison."""
    found = {}
    for i, x in enumerate(prints):
        for q in asks:
            for shift in range(least_common - len(prints[q]), len(x) - least_common + 1) if i != q else ():
                a, b = x[max(shift, 0) :], prints[q][max(-shift, 0) :]
                n = min(len(a), len(b))
                if n >= least_common:
                    errors = np.bitwise_count(a[:n] ^ b[:n]).sum() / (32 * n)
                    if errors <= max_errors:
                        found[i, q] = min(found.get((i, q), 1), errors)
    return found


def test_chroma_recall_against_brute_force(spark):
    """Noisy, cut and late versions of melodies, with bit errors up to the limit."""
    rng = np.random.default_rng(11)
    edges = np.linspace(-1.5, 1.5, 23)
    time = np.arange(chroma.HOP) / chroma.RATE
    tones = np.stack([9_000 * np.sin(2 * np.pi * 220 * 2 ** (k / 12) * time) for k in range(24)])
    pcms = []
    for _ in range(12):
        tune = tones[np.searchsorted(edges, rng.normal(size=64))].ravel()
        for noise, late in ((0, 0), (1_500, 100), (3_000, 1_500), (4_000, 3_000), (4_800, 40), (4_400, 7_000)):
            pcms.append((tune[late:] + rng.normal(0, noise, len(tune) - late)).clip(-32_768, 32_767).astype("<i2"))
    df = spark.createDataFrame([(i, p.tobytes(), 1, "x") for i, p in enumerate(pcms)], "id long, pcm binary, key int, class_id string").repartition(4)
    prints = chroma.fingerprints(df)
    own = {r["id"]: np.array(r["prints"], dtype=np.uint32) for r in prints.collect()}
    index = chroma.QueryIndex([own[q] for q in range(0, 72, 6)])
    got = index.aligned([own[i] for i in range(72)], 0.25, 16)
    got = {(i, 6 * q): e for i, q, e in zip(got["recording"], got["query"], got["bit_errors"]) if i != 6 * q}
    want = brute_alignment([own[i] for i in range(72)], range(0, 72, 6), 0.25, 16)
    assert len(want) >= 50 and got.keys() <= want.keys() and len(got) >= 0.9 * len(want)
    assert sum(abs(got[k] - want[k]) < 1e-9 for k in got) >= 0.95 * len(got)
    rows = {r["id"]: r for r in chroma.align(prints.withColumn("key", F.lit(1)), F.col("id") % 6 == 0).collect()}
    assert all(rows[i]["n_queries"] == sum(1 for j, _ in got if j == i) for i in range(72))
    assert all(abs(rows[i]["bit_errors"] - min(e for (j, _), e in got.items() if j == i)) < 1e-9 for i in range(72) if rows[i]["query_id"] is not None)


def test_chroma_counts_copies_and_takes_odd_rows(spark):
    rng = np.random.default_rng(5)
    tune = (rng.normal(size=64) / 8).tolist()
    rows = [(0, tune), (0, tune), (100, tune), (7, tune), (None, tune), (8, None)]
    prints = chroma.melody_fingerprints(spark.createDataFrame(rows, "id long, vector array<double>"))
    got = sorted(((r["id"], r["query_id"], r["n_queries"], r["bit_errors"]) for r in chroma.align(prints, F.col("id") % 100 == 0).collect()), key=str)
    assert got == [(0, None, 2, None), (0, None, 2, None), (100, 0, 2, 0.0), (7, 0, 3, 0.0), (8, None, 0, None), (None, None, 0, None)] or got[-1][0] is None
    long = spark.createDataFrame([(1, (np.sin(np.arange(4_000_000) ** 1.2 / 900) * 9_000).astype("<i2").tobytes()), (2, b"ab"), (3, None)], "id long, pcm binary")
    assert {r["id"]: len(r["prints"]) for r in chroma.fingerprints(long).collect()} == {1: (4_000_000 - chroma.FRAME) // chroma.HOP + 2 - chroma.SPAN, 2: 0, 3: 0}


def test_chroma_silence_votes_at_its_ends():
    assert list(chroma.turns(np.array([5, 5, 5, 5, 6, 7, 7, 7, 7]), np.array([0, 7]))) == [True, False, False, True, True, True, True, True, True]


def test_chroma_hears_pitch():
    time = np.arange(4 * chroma.RATE) / chroma.RATE
    for semitone in range(12):
        pcm = (10_000 * np.sin(2 * np.pi * 440 * 2 ** (semitone / 12) * time)).astype(np.int16)
        assert (chroma.chroma_frames(pcm[None])[0].argmax(axis=1) == semitone).all()
