"""A growing ledger of keys seen, for feeds that arrive in batches.

A batch is checked against all batches before it without reading all their keys. The ledger holds, for each batch:

* its new keys with their hash, in folders by bucket of the hash, and
* a Bloom filter of each bucket as rows (bucket, 64-bit word, bits); filters of several batches are or-ed when read.

Keys of a batch probe the filters by equi-joins. Only keys whose bits are all set can have been seen; only the buckets of those are
read, and the keys themselves decide. So a batch of new keys reads filters (a few bits a key ever seen) and next to no keys, and
a false hit of a filter costs a read, never a row.

A batch is written under its id, in place of what an earlier run of the same batch wrote, and reads only the batches before it in the order of
ids. A repeated batch therefore admits the same rows and adds nothing, and so does one that was cut off half way. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketfeat.session import checkpointed

_KEYS = "key string, hash long, bucket int, batch long"
_FILTERS = "bucket int, word int, bits long, batch long"


@dataclass(frozen=True)
class SeenLedger:
    """A ledger below ``path``, a shared folder of its own. ``buckets``, ``cells`` (bits of one filter) and ``probes`` must stay the same over its life.

    With ``cells`` at ten times the keys of a bucket about one key in a hundred that was never seen is looked up for nothing; more keys make more of those.
    """

    spark: SparkSession
    path: str
    buckets: int = 256
    cells: int = 1 << 20
    probes: int = 4

    def __post_init__(self) -> None:
        if self.cells % 64 or min(self.buckets, self.cells, self.probes) < 1:
            raise ValueError("cells must be a multiple of 64, and buckets and probes at least 1")
        for what, schema in (("keys", _KEYS), ("filters", _FILTERS)):  # folders that can be read before the first batch
            none = self.spark.createDataFrame([], schema).drop("batch")
            none.write.mode("ignore").partitionBy("bucket").parquet(f"{self.path}/{what}/batch=-1")

    # -- what is stored -----------------------------------------------------------

    def keys(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """``key``, ``hash``, ``bucket``, ``batch`` of what was seen; with ``buckets`` only their folders are read."""
        stored = self._read("keys", _KEYS)
        return stored if buckets is None else stored.filter(F.col("bucket").isin(list(buckets)))

    def filters(self) -> DataFrame:
        """``bucket``, ``word``, ``bits``, ``batch``: one row a batch and word that is not empty."""
        return self._read("filters", _FILTERS)

    def batches(self) -> DataFrame:
        """``batch``, ``n_keys``: how many new keys each batch brought."""
        return self.keys().groupBy("batch").agg(F.count(F.lit(1)).alias("n_keys"))

    def _read(self, what: str, schema: str) -> DataFrame:
        folder = f"{self.path}/{what}"
        return self.spark.read.schema(schema).option("basePath", folder).parquet(folder)

    # -- keys and probes ----------------------------------------------------------

    def _hashed(self, df: DataFrame, key: Column) -> DataFrame:
        keyed = df.withColumn("_key", key.cast("string")).withColumn("_hash", F.xxhash64("_key"))
        return keyed.withColumn("_bucket", F.pmod("_hash", F.lit(self.buckets)).cast("int"))

    def _cells(self) -> Column:
        """The cells of a key in its bucket's filter: probes of two more hashes, so they don't follow from the bucket."""
        first, step = F.xxhash64(F.lit(1), "_key"), F.xxhash64(F.lit(2), "_key")
        return F.array_distinct(F.array(*[
            F.pmod(F.pmod(first, F.lit(1 << 31)) + F.lit(i) * F.pmod(step, F.lit(1 << 31)), F.lit(self.cells)) for i in range(self.probes)
        ]))

    def _probed(self, keys: DataFrame) -> DataFrame:
        """``keys`` (_key, _bucket) with one row for each of its ``cells``: ``word`` and ``bit``."""
        cells = keys.select("_key", "_bucket", F.size(self._cells()).alias("_asked"), F.explode(self._cells()).alias("_cell"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_cell", F.lit(64)).cast("int"))
        return cells.select("_key", "_bucket", "_asked", F.floor(F.col("_cell") / 64).cast("int").alias("word"), bit.alias("bit"))

    def possible(self, keys: DataFrame, batch: int) -> DataFrame:
        """``_key``, ``_bucket`` of those of ``keys`` that a batch before ``batch`` may hold: all their bits are set."""
        asked = [r[0] for r in keys.select("_bucket").distinct().collect()]  # at most `buckets` numbers
        stored = self.filters().filter((F.col("batch") < batch) & F.col("bucket").isin(asked))
        stored = stored.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
        probed = self._probed(keys)
        met = probed.join(stored, (probed["_bucket"] == stored["bucket"]) & (probed["word"] == stored["word"]))
        hits = met.filter(F.col("bits").bitwiseAND(F.col("bit")) != 0).groupBy("_key", "_bucket", "_asked").agg(F.count(F.lit(1)).alias("_set"))
        return hits.filter("_set = _asked").select("_key", "_bucket")

    # -- a batch ------------------------------------------------------------------

    def seen(self, keys: DataFrame, batch: int) -> DataFrame:
        """``_key`` of those of ``keys`` (_key, _hash, _bucket) that a batch before ``batch`` holds. Reads the buckets of possible hits only."""
        maybe = checkpointed(self.possible(keys, batch))
        buckets = [r[0] for r in maybe.select("_bucket").distinct().collect()]  # at most `buckets` numbers
        stored = self.keys(buckets).filter(F.col("batch") < batch).select("key", F.col("bucket").alias("_in"))
        return maybe.join(stored, (maybe["_bucket"] == stored["_in"]) & (maybe["_key"] == stored["key"]), "left_semi").select("_key")

    def admit(self, batch: DataFrame, batch_id: int, key: str | Column, order: Sequence[str | Column]) -> DataFrame:
        """The rows of ``batch`` whose key no batch before ``batch_id`` had, one a key (the first under ``order``), and their keys go into the ledger.

        Rows without a key are always new and never recorded. A key that many rows share is one row before any exchange. The rows come back as a stored
        table with the columns of ``batch``.
        """
        ranks = [(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)]
        row = F.struct(*[F.col(f"`{c}`") for c in batch.columns]).alias("row")
        rows = checkpointed(batch.select(row, (F.col(key) if isinstance(key, str) else key).cast("string").alias("_key"), F.struct(*ranks).alias("rank")))
        first = rows.filter(F.col("_key").isNotNull()).groupBy("_key").agg(F.min_by("row", "rank").alias("row"))
        hashed = self._hashed(first, F.col("_key"))
        known = self.seen(hashed.select("_key", "_hash", "_bucket"), batch_id)
        new = checkpointed(hashed.join(known, "_key", "left_anti"))
        self._record(new.select("_key", "_hash", "_bucket"), batch_id)
        return new.select("row.*").unionByName(rows.filter(F.col("_key").isNull()).select("row.*"))

    def _record(self, new: DataFrame, batch_id: int) -> None:
        """Write a batch's keys and filters in place of an earlier run's."""
        bits = self._probed(new).groupBy("_bucket", "word").agg(F.bit_or("bit").alias("bits"))
        bits = bits.select(F.col("_bucket").alias("bucket"), "word", "bits").repartition("bucket")
        keys = new.select(F.col("_key").alias("key"), F.col("_hash").alias("hash"), F.col("_bucket").alias("bucket")).repartition("bucket")
        # Keys first: a batch cut off between the two is found by running it again, not by its filter.
        keys.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/keys/batch={batch_id}")
        bits.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/filters/batch={batch_id}")
