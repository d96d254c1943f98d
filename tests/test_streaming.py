import datetime as dt

from linkfold.streaming import log_report

SCHEMA = "ts timestamp, outcome string, seconds double"


def test_windowed_report(spark, tmp_path):
    at = lambda minute: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=minute)
    rows = [(at(1), "match", 1.0), (at(2), "match", 3.0), (at(3), "none", None), (at(12), "match", -1.0), (None, "match", 1.0), (at(600), "none", 1.0)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).write.parquet(source)
    report = log_report.windowed_report(log_report.read_log(spark, source, SCHEMA), "ts", "outcome", "seconds")
    log_report.write_report(report, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted((r["start"].minute, r["outcome"], r["n"], r["mean_seconds"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # the last window stays open: no watermark has passed it
    assert got == [(0, "match", 2, 2.0), (0, "none", 1, None), (10, "match", 1, None)]


def test_windowed_report_of_a_table_is_the_same(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), "match", float("nan"))], SCHEMA)
    assert [(r["n"], r["mean_seconds"]) for r in log_report.windowed_report(df, "ts", "outcome", "seconds").collect()] == [(1, None)]
    assert log_report.windowed_report(df.limit(0), "ts", "outcome", "seconds").count() == 0
