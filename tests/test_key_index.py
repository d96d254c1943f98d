"""The index of spellings against a dictionary filled in turn."""

import re
import unicodedata

from linkfold.operators import key_index, knn, linking


def plain(value):
    value = unicodedata.normalize("NFKC", value or "").strip().lower().replace("ё", "е").replace("&", " and ").replace("—", " ").replace("–", " ")
    value = re.sub(key_index.PREFIXES.removeprefix("(?iu)"), "", value, flags=re.IGNORECASE).replace("ъ", "").replace("ь", "")
    return re.sub(r"\s+", " ", re.sub(r"[^0-9a-zа-яё]+", " ", value)).strip()


def latin(value):
    return plain(value).translate(str.maketrans(key_index.CYRILLIC, key_index.LATIN))


def filled(producers, aliases):
    index = {}
    for i, name, url, _ in sorted(producers, key=lambda p: (p[3], p[0])):
        keys = {plain(name), latin(name), plain(re.sub(r"[_-]", " ", (url or "").rstrip("/").split("/")[-1]))}
        for k in list(keys):
            keys |= {k.replace("vinodelnya ", "").replace("usadba ", "").strip(), k.replace("chateau ", "shato ").strip(), k.replace("shato ", "chateau ").strip(), k.replace(" and ", " ").strip()}
        for k in keys - {""}:
            index.setdefault(k, i)
    for alias, target, _ in sorted(aliases, key=lambda a: a[2]):
        if plain(target) in index:
            index[plain(alias)] = index[latin(alias)] = index[plain(target)]
            index.setdefault(plain(alias).replace(" and ", " ").strip(), index[plain(target)])
    return index


PRODUCERS = [
    (1, "Винодельня Марко", "https://x/vinodelnya-marko/", 1), (2, "Chateau Pino & Sons", "https://x/chateau_pino", 2), (3, "Shato Pino", "https://x/shato-pino", 3), (4, "Усадьба Ёлка—2", None, 4), (5, "Marko", "marko", 5),
    (6, "Кот", "https://x/kot/", 6), (7, None, None, 7), (8, "Объект", "https://x/", 0), (None, "nobody", "x", 1), (9, "  Вина Марко  ", "https://y/marko-2", 9), (10, "Ｐｉｎｏ", "https://x/p", 10),
]
ALIASES = [("марко и ко", "marko", 1), ("Bold & Co", "марко и ко", 2), ("early", "late", 3), ("late", "kot", 4), ("kot", "pino and sons", 5), ("shato pino", "елка 2", 6), ("nowhere", "unknown", 7), ("x—y & z", "early", 8), (None, "kot", 9), ("", "kot", 10)]


def test_index(spark):
    producers = spark.createDataFrame(PRODUCERS, "id long, name string, url string, pos int").repartition(4)
    aliases = spark.createDataFrame(ALIASES, "alias string, target string, pos int")
    want = filled([p for p in PRODUCERS if p[0] is not None], [a for a in ALIASES if a[0]])
    index = key_index.key_index(producers, aliases)
    assert {r["key"]: r["id"] for r in index.collect()} == want and index.count() == len(want)
    assert {r["key"]: r["id"] for r in key_index.key_index(producers, aliases.limit(0)).collect()} == filled([p for p in PRODUCERS if p[0] is not None], [])
    assert key_index.key_index(producers.limit(0), aliases).count() == 0
    names = ["марко", "VINODELNYA MARKO", "Chateau Pino and sons", "chateau pino", "Кот", "kot", "Bold Co", "Bold and Co", "елка 2", "nothing here", "", None, "усадьба елка 2", "early", "late", "Marko-"]
    got = {r["name"]: r["id"] for r in key_index.links_by_key(spark.createDataFrame([(n,) for n in names * 2], "name string"), index, aliases).collect()}

    def lookup(name):
        for cand in (plain(name), latin(name), plain(name).replace(" and ", " ")):
            if cand and cand in want:
                return want[cand]
            target = dict((a, t) for a, t, _ in ALIASES).get(cand)
            if cand and target and plain(target) in want:
                return want[plain(target)]
        return None

    assert got == {n: lookup(n) for n in names if n is not None}
    more = {r["name"]: (r["id"], r["how"]) for r in key_index.resolve_names(spark.createDataFrame([("Marko the great",), ("kot",), ("zzz",)], "name string"), index, aliases).collect()}
    assert more["kot"][1] == "key" and more["Marko the great"][1] == "contained" and more["zzz"] == (None, "none")


def test_links_of_names_with_a_common_beginning(spark):
    """All keys begin alike; containment is found all the same, and as by trying all pairs."""
    known = [(k, f"Chateau {'abcdefghij'[k % 10]}{k} Grand") for k in range(40)] + [(50, "abcd"), (51, "Chateau")]
    names = [f"Old Chateau {'abcdefghij'[k % 10]}{k} Grand Cru" for k in range(0, 40, 3)] + ["a3 Gra", "teau d13", "hatea", "none of them", "abc"]
    rows = linking.link_names(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(known, "id long, known_name string")).collect()
    key = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    for r in rows:
        k = key(r["name"])
        held = [i for i, n in known if min(len(k), len(key(n))) >= 5 and (k in key(n) or key(n) in k) and k != key(n)]
        if held:
            assert (r["id"], r["how"]) == (min(held), "contained"), r
        else:
            assert r["how"] != "contained"


def test_neighbours_in_blocks(spark, monkeypatch):
    table = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(60)], "id long, vector array<double>")
    want = sorted(map(tuple, knn.knn(table.filter("id % 4 = 0"), table, 3).collect()))
    block = next(n for n in dir(knn) if n.isupper() and isinstance(getattr(knn, n), int))
    monkeypatch.setattr(knn, block, 6)
    assert sorted(map(tuple, knn.knn(table.filter("id % 4 = 0"), table, 3).collect())) == want
