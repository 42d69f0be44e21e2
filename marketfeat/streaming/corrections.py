"""Windows that late rows correct instead of being dropped by a watermark.

Each batch of a stream is reduced to one mergeable row per group (sums, counts, extremes, first and last under an order) and written under
its batch id, in place of what an earlier run of the same batch wrote. The value of a group is the merge of its rows over all batches, so rows may
come in any order and at any time, a repeated batch adds nothing, and a batch costs its own rows only. ``compact`` merges the batches so far into one
table, so that a reader merges one row a group and the batches after it. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUM, COUNT, MIN, MAX, FIRST, LAST = "sum", "count", "min", "max", "first", "last"
_MERGE = {SUM: F.sum, COUNT: F.sum, MIN: F.min, MAX: F.max, FIRST: F.min, LAST: F.max}


@dataclass(frozen=True)
class CorrectedWindows:
    """Aggregates per group below ``path``, a shared folder of its own.

    ``groups`` maps a name to a column of the rows, ``values`` a name to (kind, column). ``FIRST`` and ``LAST`` take the value of the row that comes first
    or last under ``order``, which should tell rows apart; rows whose value is null take part in none but ``COUNT`` of a literal.
    """

    spark: SparkSession
    path: str
    groups: Mapping[str, Column]
    values: Mapping[str, tuple[str, Column]]
    order: Sequence[str] = ()

    def __post_init__(self) -> None:
        kinds = {kind for kind, _ in self.values.values()}
        if not kinds <= set(_MERGE):
            raise ValueError(f"unknown kinds: {sorted(kinds - set(_MERGE))}")
        if kinds & {FIRST, LAST} and not self.order:
            raise ValueError("first and last need an order")

    def partials(self, rows: DataFrame) -> DataFrame:
        """One mergeable row per group."""
        order = [F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(self.order)]
        aggregates = []
        for name, (kind, value) in self.values.items():
            if kind in (FIRST, LAST):
                value = F.when(value.isNotNull(), F.struct(*order, value.alias("value")))
            aggregates.append((F.count(value) if kind == COUNT else _MERGE[kind](value)).alias(name))
        return rows.groupBy(*[c.alias(n) for n, c in self.groups.items()]).agg(*aggregates)

    def merged(self, partials: DataFrame) -> DataFrame:
        """Partials of any batches as one row per group, mergeable again."""
        return partials.groupBy(*self.groups).agg(*[_MERGE[kind](name).alias(name) for name, (kind, _) in self.values.items()])

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Write a batch, in place of an earlier run of it. A batch that a compaction has taken in is left alone."""
        if batch_id > self.compacted():
            self.partials(rows).write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch_id}")

    def compacted(self) -> int:
        """The last batch that the compacted table holds, -1 without one."""
        marks = self._read("marks", T.StructType([T.StructField("upto", T.LongType())]))
        last = marks.agg(F.max("upto")).first()[0] if marks is not None else None
        return -1 if last is None else last

    def compact(self, upto: int) -> None:
        """Merge all batches to ``upto`` into one table. It counts only once its mark is there, so one that was cut off half way is done again."""
        if upto <= self.compacted():
            return
        self._stored(upto).write.mode("overwrite").parquet(f"{self.path}/tables/upto={upto}")
        mark = self.spark.range(1).select(F.lit(upto).cast("long").alias("upto"))
        mark.coalesce(1).write.mode("append").parquet(f"{self.path}/marks")

    def table(self) -> DataFrame:
        """The groups and their values over all rows so far."""
        stored = self._stored(None)
        plain = [
            (F.col(f"`{name}`.value") if kind in (FIRST, LAST) else F.col(f"`{name}`")).alias(name)
            for name, (kind, _) in self.values.items()
        ]
        return stored.select(*self.groups, *plain)

    def _stored(self, upto: int | None) -> DataFrame:
        last = self.compacted()
        batches = self._read("batches", None)
        if batches is None and last < 0:
            raise ValueError(f"no batch below {self.path}")
        parts = []
        if batches is not None:
            wanted = F.col("batch") > last
            parts.append(batches.filter(wanted if upto is None else wanted & (F.col("batch") <= upto)).drop("batch"))
        if last >= 0:
            parts.append(self.spark.read.parquet(f"{self.path}/tables/upto={last}"))
        whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return self.merged(whole)

    def _read(self, what: str, schema: T.StructType | None) -> DataFrame | None:
        """The folder as a table, None before its first write."""
        folder = f"{self.path}/{what}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return None
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.option("basePath", folder).parquet(folder)


def daily_sentiment(spark: SparkSession, path: str, value: str = "sentiment_compound", category: str = "category", ts: str = "ts") -> CorrectedWindows:
    """Sum and count per day and category; the mean follows by ``with_mean``."""
    return CorrectedWindows(
        spark, path, {"date": F.to_date(ts), "category": F.col(category)}, {"total": (SUM, F.col(value)), "n_values": (COUNT, F.col(value)), "n": (COUNT, F.lit(1))},
    )


def with_mean(table: DataFrame) -> DataFrame:
    """``date``, ``category``, ``mean_value`` (null where all values are null) and ``n`` of the table of ``daily_sentiment``."""
    mean = F.when(F.col("n_values") > 0, F.col("total") / F.col("n_values"))
    return table.select("date", "category", mean.alias("mean_value"), "n")


def ohlc(
    spark: SparkSession, path: str, width: str = "1 day", key: str = "ticker", price: str = "price", volume: str = "volume",
    ts: str = "ts", tie: Sequence[str] = (),
) -> CorrectedWindows:
    """Bars per key and time window; ``tie`` orders trades of one instant."""
    p = F.col(price)
    values = {"open": (FIRST, p), "high": (MAX, p), "low": (MIN, p), "close": (LAST, p), "volume": (SUM, F.col(volume))}
    return CorrectedWindows(spark, path, {"bar_start": F.window(F.col(ts), width)["start"], "ticker": F.col(key)}, values, (ts, *tie))


def drain_corrected(
    sdf: DataFrame, windows: CorrectedWindows, checkpoint: str | None = None, compact_every: int = 0,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Take in what is there now and return the corrected table; a later call continues. With ``compact_every`` the batches are merged that often."""

    def one(batch: DataFrame, batch_id: int) -> None:
        windows.add(prepare(batch) if prepare else batch, batch_id)
        if compact_every and (batch_id + 1) % compact_every == 0:
            windows.compact(batch_id)

    query = sdf.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint or f"{windows.path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return windows.table()
