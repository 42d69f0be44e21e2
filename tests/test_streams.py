"""Streams give the batch result, continue where they stopped, and drop late rows."""

import datetime as dt

from pyspark.sql import functions as F

from marketfeat.streaming import streams
from registry.queries import QUERIES

T0 = dt.datetime(2024, 1, 1)
DDL = "id long, ts timestamp, category string, value double"


def rows_of(days):
    return [(100 * d + i, T0 + dt.timedelta(days=d, hours=i), "ab"[i % 2], float(d + i)) for d in days for i in range(10)]


def put(spark, folder, rows):
    spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(folder)


def test_first_seen_continues(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    put(spark, folder, rows_of([0, 1]))
    run = lambda: streams.drain(
        streams.stream_first_seen(streams.read_stream(spark, folder), "id", "ts", "10 days"), out, check)
    assert run().count() == 20
    put(spark, folder, rows_of([1, 2]))
    assert sorted(r["id"] for r in run().collect()) == sorted(r[0] for r in rows_of([0, 1, 2]))


def test_daily_sentiment_equals_batch_and_drops_late_rows(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    put(spark, folder, rows_of(range(6)))
    run = lambda: streams.drain(
        streams.stream_daily_sentiment(streams.read_stream(spark, folder), "value", "category", "ts", "1 day"), out, check)
    first = {(r["date"].day, r["category"]): (r["mean_value"], r["n"]) for r in run().collect()}
    batch = spark.createDataFrame(rows_of(range(4)), DDL).groupBy(F.dayofmonth("ts"), "category").agg(F.avg("value"), F.count("*"))
    assert first == {(r[0], r[1]): (r[2], r[3]) for r in batch.collect()}
    put(spark, folder, [(9999, T0, "a", 1e6), *rows_of(range(6, 9))])
    later = {(r["date"].day, r["category"]): (r["mean_value"], r["n"]) for r in run().collect()}
    assert all(later[k] == v for k, v in first.items()) and len(later) == 14


def test_a_bounded_run_finishes_with_the_open_windows(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    build = lambda df: streams.stream_daily_sentiment(df, "value", "category", "ts", "1 day")
    key = lambda r: (r["date"], r["category"], r["mean_value"], r["n"])
    put(spark, folder, rows_of([0]))
    for days in (1, 6):
        if days > 1:
            put(spark, folder, rows_of(range(1, days)))
        drained = streams.drain(build(streams.read_stream(spark, folder)), out, check)
        rows = spark.read.parquet(folder)
        whole = sorted(map(key, build(rows).collect()))
        assert drained.count() == max(0, 2 * (days - 2))
        assert sorted(map(key, streams.finish(drained, rows, build, "date").collect())) == whole


def test_ohlc(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, rows_of(range(4)))
    sdf = streams.read_stream(spark, folder).withColumn("volume", F.lit(2.0))
    bars = streams.drain(streams.stream_ohlc(sdf, "1 day", "category", "value", "volume", "ts", ["id"]), str(tmp_path / "out"), str(tmp_path / "c"))
    got = {(r["bar_start"].day, r["ticker"]): tuple(r)[2:] for r in bars.collect()}
    assert got == {(d + 1, "ab"[k]): (d + k, d + 8.0 + k, d + k, d + 8.0 + k, 10.0) for d in range(2) for k in (0, 1)}


def test_a_table_is_a_file_or_a_folder_of_files(spark, tmp_path):
    put(spark, str(tmp_path / "other.parquet"), rows_of([7]))
    put(spark, str(tmp_path / "parts.parquet"), rows_of([0]))
    part = next((tmp_path / "parts.parquet").glob("part-*"))
    (tmp_path / "single.parquet").write_bytes(part.read_bytes())
    put(spark, str(tmp_path / "parts.parquet"), rows_of([1]))
    for d in (0, 1):
        put(spark, str(tmp_path / f"keyed.parquet/key={d}"), rows_of([d]))

    def run(name):
        sdf = streams.table_stream(spark, str(tmp_path / name))
        return streams.drain(sdf, str(tmp_path / f"out-{name}"), str(tmp_path / f"check-{name}"))

    for name, days in (("single.parquet", [0]), ("parts.parquet", [0, 1]), ("keyed.parquet", [0, 1])):
        assert sorted(r["id"] for r in run(name).collect()) == [r[0] for r in rows_of(days)]
    assert all(r["id"] // 100 == r["key"] for r in run("keyed.parquet").collect())
    put(spark, str(tmp_path / "parts.parquet"), rows_of([3]))
    assert sorted(r["id"] for r in run("parts.parquet").collect()) == [r[0] for r in rows_of([0, 1, 3])]


def test_the_gate_query_streams_a_table_of_several_files(spark, testdata, tmp_path):
    docs = spark.read.parquet(f"{testdata}/documents.parquet")
    docs.repartition(3, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    run = QUERIES["stream_headline_gate"]
    got = sorted(map(tuple, run(spark, str(tmp_path)).collect()))
    assert got and got == sorted(map(tuple, run(spark, testdata).collect()))
