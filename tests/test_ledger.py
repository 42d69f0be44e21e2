"""The ledger of seen keys: first arrivals over batches, repeated and cut off ones, and what a batch reads."""

import random

import pytest
from pyspark.sql import functions as F

from marketfeat.operators.ledger import SeenLedger
from marketfeat.session import durable_path
from marketfeat.streaming import streams

DDL = "k string, n long, _key string, batch int"


def rows(spark, keys, start=0):
    return spark.createDataFrame([(k, start + i, "x", 1) for i, k in enumerate(keys)], DDL)


@pytest.fixture
def ledger(spark):
    return SeenLedger(spark, durable_path(spark, "ledger"), buckets=16, cells=512, probes=3)


def admitted(df):
    return sorted((str(r["k"]), r["n"]) for r in df.collect())


@pytest.mark.parametrize("cells", [64, 1 << 14])
def test_first_arrivals(spark, cells):
    """A full filter (64 cells a bucket) reads more and decides the same."""
    rng = random.Random(2)
    book = SeenLedger(spark, durable_path(spark, "ledger"), buckets=8, cells=cells)
    seen, at = set(), 0
    for batch in range(4):
        keys = [f"key {rng.randrange(900)}" for _ in range(400)] + [None, None, "", "ключ"]
        want = {}
        for i, k in enumerate(keys):
            if k is not None and k not in seen:
                want.setdefault(k, at + i)
        out = book.admit(rows(spark, keys, at).repartition(3), batch, "k", ["n"])
        assert out.columns == ["k", "n", "_key", "batch"] and {r["_key"] for r in out.collect()} == {"x"}
        assert admitted(out.filter("k IS NOT NULL")) == sorted(want.items()) and out.filter("k IS NULL").count() == 2
        seen |= set(want)
        at += len(keys)
    assert book.keys().count() == len(seen) == book.keys().select("key").distinct().count()


def test_a_repeated_batch_adds_nothing(spark, ledger):
    first = rows(spark, ["a", "b", "b", "c"])
    second = rows(spark, ["c", "d"], 10)
    once = admitted(ledger.admit(first, 1, "k", ["n"])), admitted(ledger.admit(second, 2, "k", ["n"]))
    before = sorted(map(tuple, ledger.keys().collect()))
    again = admitted(ledger.admit(first, 1, "k", ["n"])), admitted(ledger.admit(second, 2, "k", ["n"]))
    assert once == again == ([("a", 0), ("b", 1), ("c", 3)], [("d", 11)])
    assert sorted(map(tuple, ledger.keys().collect())) == before
    assert {(r["batch"], r["n_keys"]) for r in ledger.batches().collect()} == {(1, 3), (2, 1)}


def test_a_batch_cut_off_before_its_filter(spark, ledger):
    """Keys without their filter: running the batch again admits its rows and completes it."""
    hashed = ledger._hashed(rows(spark, ["a", "b"]), F.col("k")).select(
        F.col("_key").alias("key"), F.col("_hash").alias("hash"), F.col("_bucket").alias("bucket"))
    hashed.write.partitionBy("bucket").parquet(f"{ledger.path}/keys/batch=5")
    assert admitted(ledger.admit(rows(spark, ["a", "b"]), 5, "k", ["n"])) == [("a", 0), ("b", 1)]
    assert admitted(ledger.admit(rows(spark, ["b", "e"]), 6, "k", ["n"])) == [("e", 1)]


def test_only_buckets_of_possible_hits_are_read(spark):
    book = SeenLedger(spark, durable_path(spark, "ledger"), buckets=64, cells=1 << 16)
    book.admit(rows(spark, [f"old {i}" for i in range(500)]), 1, "k", ["n"])
    new = book._hashed(rows(spark, [f"new {i}" for i in range(50)] + ["old 7"]), F.col("k"))
    maybe = book.possible(new, 2).collect()
    assert "old 7" in {r["_key"] for r in maybe} and len(maybe) < 4
    buckets = [r["_bucket"] for r in maybe]
    plan = book.keys(buckets).filter("batch < 2")._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in filters and "batch" in filters and book.keys(buckets).count() < 40
    plan = book.seen(new.select("_key", "_hash", "_bucket"), 2)._jdf.queryExecution().toString()
    assert any("bucket" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])


def test_no_key_meets_whole_batches(spark, ledger):
    """One key on a third of the rows, and empty batches."""
    many = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"),
        F.col("id").alias("n"), F.lit("x").alias("_key"), F.lit(1).alias("batch"))
    assert ledger.admit(many, 1, "k", ["n"]).count() == 20_001
    assert ledger.admit(many.filter("false"), 2, "k", ["n"]).count() == 0
    assert ledger.admit(many, 3, "k", ["n"]).count() == 0


def test_bad_sizes(spark):
    with pytest.raises(ValueError):
        SeenLedger(spark, "/tmp/none", cells=100)


def test_stream_equals_one_batch(spark):
    folder = durable_path(spark, "in")
    df = rows(spark, [f"k{i % 40}" for i in range(200)]).drop("_key", "batch")
    df.repartition(5, "k").write.parquet(folder)
    sdf = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    book, out = SeenLedger(spark, durable_path(spark, "ledger"), buckets=4, cells=4096), durable_path(spark, "out")
    got = streams.stream_new_keys(sdf, book, "k", ["n"], out)
    assert admitted(got) == sorted((f"k{i}", i) for i in range(40))
    rows(spark, ["k1", "k99"], 500).drop("_key", "batch").coalesce(1).write.mode("append").parquet(folder)
    assert admitted(streams.stream_new_keys(sdf, book, "k", ["n"], out))[-1] == ("k99", 501) and spark.read.parquet(out).count() == 41
