from linkfold.sources import readers, writers


def test_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿name,color,slug\n A ,, a \nA,,a\nB,red,\n,red,c\n", encoding="utf-8")
    rows = readers.read_catalog_csv(spark, str(tmp_path / "c.csv"), ["name", "color", "slug"], "name").collect()
    assert sorted((r["name"], r["color"], r["slug"]) for r in rows if r["slug"]) == [("A", None, "a")] and len(rows) == 2


def test_sitemap(spark, tmp_path):
    entry = '<url><loc>https://x.org/wines/abc/</loc><lastmod>2024-01-02T03:04:05Z</lastmod><image:image><image:loc>https://x.org/i/%D0%B0%20b.png</image:loc><image:title>T</image:title></image:image></url>'
    (tmp_path / "s.xml").write_text(f'<urlset xmlns:image="i">{entry}<url><loc>https://x.org/q</loc><lastmod>bad</lastmod></url></urlset>', encoding="utf-8")
    rows = {r["slug"]: r for r in readers.read_sitemap(spark, str(tmp_path / "s.xml")).collect()}
    assert rows["abc"]["image_file"] == "а b.png" and rows["abc"]["lastmod"].year == 2024 and rows["q"]["lastmod"] is None


def test_manifest(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("query_id\timage_path\nq1\ta.png\nq2\ta.png\nq2\tb.png\nbad id\tx\nq3\t\n")
    got = [(r["query_id"], r["problem"]) for r in readers.read_manifest(spark, str(tmp_path / "m.tsv")).collect()]
    assert sorted(got, key=str) == sorted([("q1", None), ("q2", "repeated_id"), ("q2", "repeated_id"), ("bad id", "bad_id"), ("q3", "no_path")], key=str)


def test_predictions_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("q", "p", "s", None, 5)], "query_id string, image_path string, image_sha256 string, predicted_slug string, latency_ms bigint")
    writers.write_predictions(df, str(tmp_path / "p"))
    assert readers.read_predictions(spark, str(tmp_path / "p")).collect() == df.collect()


def test_upsert(spark):
    current = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    changes = spark.createDataFrame([(2, "c", 3), (2, "d", 4), (3, "e", 5)], "k int, v string, n int")
    got = writers.upserted(current, changes, ["k"], "n")
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1), (2, "d", 4), (3, "e", 5)]


def test_files(spark):
    wanted = spark.createDataFrame([("Abc.PNG",), ("x.jpg",), ("none.png",)], "image_file string")
    files = spark.createDataFrame([("abc.png",), ("x_0123456789.png",), ("x_0123456789ab.png",)], "file string")
    got = {r["image_file"]: r["file"] for r in readers.resolve_files(wanted, files).collect()}
    assert got == {"Abc.PNG": "abc.png", "x.jpg": "x_0123456789.png", "none.png": None}


def test_sniff(spark):
    rows = [(bytes.fromhex("FFD8FFE0"),), (bytes.fromhex("89504E470D0A1A0A00"),), (b"RIFF0000WEBP",), (b"text",), (None,)]
    df = spark.createDataFrame(rows, "c binary")
    assert [r[0] for r in df.select(readers.sniffed_extension(df["c"])).collect()] == ["jpg", "png", "webp", None, None]
