"""Price bars: typed reads, price pages, sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketfeat.functions.markup import normal_form
from marketfeat.functions.text import plain_text

BAR_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("ticker", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in (
        "ldcp", "open", "high", "low", "close", "change", "change_pct", "volume")],
])
REQUIRED = ("date", "ticker", "open", "high", "low", "close", "volume")
DATE_FORMATS = ("yyyy-MM-dd", "MMM d, yyyy", "d MMM yyyy", "M/d/yyyy")


def reader_format(path: str) -> str:
    return "csv" if path.rstrip("/").endswith((".csv", ".csv.gz", "_csv")) else "parquet"


def read_bars(
    spark: SparkSession,
    path: str,
    schema: T.StructType = BAR_SCHEMA,
    required: Sequence[str] = REQUIRED,
    fmt: str | None = None,
) -> DataFrame:
    """Bars from CSV (with header) or parquet, columns by name and typed by ``schema``.

    A missing required column or an empty table raises. Values that do not parse are NULL.
    """
    kind = fmt or reader_format(path)
    raw = spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.format(kind).load(path)
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    typed = raw.select(*[
        F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields if f.name in raw.columns
    ])
    if typed.isEmpty():
        raise ValueError(f"no rows in {path}")
    return typed


def parse_date(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Date in any of the formats, else NULL."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("date")


def parse_number(text: Column) -> Column:
    """Number with thousands commas, else NULL."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def parse_html_table(
    pages: DataFrame,
    table_id: str = "historicalTable",
    columns: Sequence[str] = ("open", "high", "low", "close", "volume"),
    formats: Sequence[str] = DATE_FORMATS,
) -> DataFrame:
    """Bars from pages ``(symbol, html)``: rows of the table's body with at least date and ``columns``.

    Rows without a date or a close are dropped. A page without the table gives no rows.
    """
    wanted = rf'(?s)<table id="\Q{table_id}\E">.*?<tbody>(.*?)</tbody>'
    body = F.regexp_extract(normal_form(F.col("html"), {"table": "id"}), wanted, 1)
    # The outer form, as Spark tests what the plain one explodes for size first, which would split each page again.
    rows = pages.select("symbol", F.explode_outer(F.regexp_extract_all(body, F.lit(r"(?s)<tr>(.*?)</tr>"), 1)).alias("row")).filter("row IS NOT NULL")
    cells = rows.select(
        "symbol",
        F.transform(F.regexp_extract_all("row", F.lit(r"(?s)<td>(.*?)</td>"), 1), plain_text).alias("cells"),
    ).filter(F.size("cells") >= len(columns) + 1)
    parsed = cells.select(
        parse_date(F.element_at("cells", 1), formats).alias("date"), F.col("symbol").alias("ticker"),
        *[parse_number(F.element_at("cells", i + 2)).alias(c) for i, c in enumerate(columns)],
    )
    return parsed.filter(F.col("date").isNotNull() & F.col("close").isNotNull())


# -- sinks --------------------------------------------------------------------------

def write_partitioned(df: DataFrame, path: str, by: str = "category", sort: Sequence[str] = ("ticker", "date")) -> None:
    """One directory per value of ``by``, rows sorted inside each file.

    Rows are spread over (by, ticker), so a large category is written by many tasks.
    """
    spread = [c for c in (by, "ticker") if c in df.columns]
    order = [c for c in (by, *sort) if c in df.columns]
    df.repartition(*spread).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(by).parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, by: str = "ticker", sort: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """``df`` as table ``table`` below ``path`` in ``buckets`` buckets of ``by``, rows sorted inside each; returns it read back.

    Windows, aggregations and joins by ``by`` over such tables with the same number of buckets need no exchange, in this run and in later ones, and
    joins by ``by`` and more columns neither if the session sets ``spark.sql.requireAllClusterKeysForCoPartition`` to false. All rows of a key lie in one bucket, so this is for series that the calendar bounds (a DATE order, one row a day);
    choose ``buckets`` so that one fits a task. Each bucket is one file.
    """
    order = [c for c in sort if c in df.columns]
    spread = df.repartition(buckets, by)
    spread.write.mode("overwrite").format("parquet").bucketBy(buckets, by).sortBy(*order).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def open_bucketed(
    spark: SparkSession, table: str, path: str, buckets: int, by: str = "ticker", sort: Sequence[str] = ("ticker", "date")
) -> DataFrame:
    """What ``write_bucketed`` wrote below ``path``, in a session whose catalog does not know it. The arguments must be those of the write."""
    found = spark.read.parquet(path).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.fields)
    order = ", ".join(f"`{c}`" for c in sort if c in found.names)
    place = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (`{by}`) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return spark.table(table)


def write_scaler(state: DataFrame, path: str) -> None:
    """Scaler state of all keys as one table."""
    state.write.mode("overwrite").parquet(path)


def read_scaler(spark: SparkSession, path: str, keys: Sequence[str] = (), key: str = "ticker") -> DataFrame:
    """Scaler state; raises if one of the asked keys has none."""
    state = spark.read.parquet(path)
    if keys:
        found = {r[0] for r in state.filter(F.col(key).isin(*keys)).select(key).distinct().collect()}
        missing = sorted(set(keys) - found)
        if missing:
            raise ValueError(f"no scaler for {missing}")
        state = state.filter(F.col(key).isin(*keys))
    return state
