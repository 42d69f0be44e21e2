"""The incremental side: operators on streaming DataFrames, and how to drain them into a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketfeat.operators.ledger import SeenLedger
from marketfeat.session import durable_path


def event_time(sdf: DataFrame, ts: str) -> DataFrame:
    """A watermark needs TIMESTAMP; other date and time types are cast."""
    if isinstance(sdf.schema[ts].dataType, T.TimestampType):
        return sdf
    return sdf.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_first_seen(sdf: DataFrame, id_col: str = "id", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """First arrival of each id. State of an id is dropped once the watermark has passed it."""
    return event_time(sdf, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])


def stream_daily_sentiment(
    sdf: DataFrame, value: str = "sentiment_compound", category: str = "category", ts: str = "ts", delay: str = "1 day"
) -> DataFrame:
    """Mean and count per day and category. A day comes out when the watermark has passed its end; later rows are dropped."""
    day = F.window(ts, "1 day")
    return (
        event_time(sdf, ts).withWatermark(ts, delay)
        .groupBy(day.alias("_day"), F.col(category).alias("category"))
        .agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n"))
        .select(F.col("_day.start").cast("date").alias("date"), "category", "mean_value", "n")
    )


def stream_ohlc(
    sdf: DataFrame, width: str = "1 day", key: str = "ticker", price: str = "price", volume: str = "volume",
    ts: str = "ts", tie: Sequence[str] = (), delay: str = "1 day",
) -> DataFrame:
    """Open, high, low, close and volume per key and time window. ``tie`` orders trades of one instant."""
    order = F.struct(ts, *tie)
    return (
        event_time(sdf, ts).withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("_bar"), F.col(key).alias("ticker"))
        .agg(
            F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
            F.max_by(price, order).alias("close"), F.sum(volume).alias("volume"),
        )
        .select(F.col("_bar.start").alias("bar_start"), "ticker", "open", "high", "low", "close", "volume")
    )


def read_stream(
    spark: SparkSession, folder: str, files: str = "*", fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """Stream of the files in ``folder`` whose names match ``files``; without a schema, that of the files there now."""
    schema = schema or spark.read.format(fmt).option("pathGlobFilter", files).load(folder).schema
    return spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", files).load(folder)


def table_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Stream of the table at ``path``, one file or a folder of files; without a schema, that of the files there now.

    The path of a stream may not be a file, but a pattern may match one: the braces make it a pattern of one name.
    """
    folder, _, name = path.rstrip("/").rpartition("/")
    schema = schema or spark.read.format(fmt).load(path).schema
    return spark.readStream.format(fmt).schema(schema).option("basePath", folder or "/").load(f"{folder}/{{{name}}}")


def drain(sdf: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process what is there now, append it to a table, and return the table.

    With the same ``path`` and ``checkpoint`` a later call continues where this one stopped.
    """
    spark = sdf.sparkSession
    target = path or durable_path(spark, "stream")
    query = (
        sdf.writeStream.format("parquet").outputMode("append")
        .option("path", target).option("checkpointLocation", checkpoint or f"{target}-checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(target)


def finish(
    drained: DataFrame, rows: DataFrame, build: Callable[[DataFrame], DataFrame], start: str, ts: str = "ts"
) -> DataFrame:
    """The drained table of a bounded run, and the windows that its watermark left open.

    ``build`` is the windowed operator, ``rows`` its whole input as a batch, ``start`` its column with the start of a
    window. Windows leave a stream in the order of their ends, so those after the last drained one are open; only
    their rows are read again. The stream's own table and state stay as they are, so a later ``drain`` continues.
    """
    last = drained.agg(F.max(start)).first()[0]
    rows = event_time(rows, ts)
    if last is None:
        return drained.unionByName(build(rows))
    return drained.unionByName(build(rows.filter(F.col(ts) > F.lit(last))).filter(F.col(start) > F.lit(last)))


def stream_new_keys(
    sdf: DataFrame, ledger: SeenLedger, key: str | Column, order: Sequence[str | Column], path: str, checkpoint: str | None = None
) -> DataFrame:
    """First arrivals of each key over the whole life of ``ledger``, as a table below ``path`` with the ``batch`` each came in.

    Nothing is forgotten, whatever the watermark: what was seen is the ledger's, not the state's. A batch that Spark repeats writes the
    same rows over its own folder. Processes what is there now; a later call continues.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        ledger.admit(batch, batch_id, key, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = sdf.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint or f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return sdf.sparkSession.read.schema(T.StructType([*sdf.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
