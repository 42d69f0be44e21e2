"""How ordered per-key work is laid out on the cluster.

Every window operator here runs over *series*: the rows of one key in order of
time. Two layouts give the same values:

plain
    One window partition per key. Used when the order column is a DATE: with one
    row per (key, date) a series cannot outgrow the calendar (some 15 000 rows in
    60 years), however large the table is.

blocked
    Used for every other order column, where one key may hold a large share of
    all rows. Rows get their exact position in the series, positions are cut into
    blocks of equal size, and each block also receives the ``back`` rows before
    it and the ``ahead`` rows after it. Windows then run per (key, block), so the
    work of one key spreads over as many tasks as it has blocks.

Positions come from a range partitioning on (key, order): it samples the data, so it
splits a key, an hour or a group of equal times wherever they are many. Rows are sorted
inside their partition and written to durable storage with their place; counts per
(key, partition) then turn places into positions. No task holds a whole series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from marketfeat.session import checkpointed

BLOCK_ROWS = 131_072


@dataclass(frozen=True)
class Layout:
    """What an operator needs to know about the series it runs over."""

    partition: tuple[str, ...]
    window: WindowSpec
    position: Column  # 1-based place in the whole series
    size: Column  # rows in the whole series


Build = Callable[[DataFrame, Layout], DataFrame]

# A layer is a list of stages; a stage names new columns that may use those of earlier stages.
Stage = dict[str, Column]
Layer = Callable[[Layout], list[Stage]]


def run_layers(df: DataFrame, lay: Layout, layers: Sequence[Layer]) -> DataFrame:
    """Add the columns of several layers, stage by stage.

    The k-th stages of all layers go into one step, so layers of like depth share their
    window operators and the plan stays short. Columns whose name starts with ``_`` are
    dropped at the end.
    """
    planned = [layer(lay) for layer in layers]
    helpers: list[str] = []
    for depth in range(max(len(stages) for stages in planned)):
        merged: Stage = {}
        for stages in planned:
            if depth < len(stages):
                merged.update(stages[depth])
        helpers += [c for c in merged if c.startswith("_") and c not in helpers]
        df = df.withColumns(merged)
    return df.drop(*helpers)


def as_keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _drop_null_order(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    for c in cols:
        if df.schema[c].nullable:
            df = df.filter(F.col(c).isNotNull())
    return df


def placed_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows sorted over all partitions, with ``_part`` (range partition) and ``_place`` (rising in it, without gaps), stored."""
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    # The id counts rows inside a partition in its low 33 bits; the partition is above them.
    placed = checkpointed(ranged.withColumn("_place", F.monotonically_increasing_id()))
    return placed.withColumn("_part", F.shiftright("_place", 33))


PLACE = ("_part", "_place")


def place_columns(df: DataFrame) -> list[str]:
    """The columns of ``placed_rows``, if ``df`` still has them: its series are in order without a new sort over partitions."""
    return list(PLACE) if set(PLACE) <= set(df.columns) else []


def renumbered(df: DataFrame, keys: Sequence[str], position: str = "_position", size: str = "_size") -> DataFrame:
    """Position and row count per key of rows that carry their place, some of which may be gone by now.

    Counts per (key, partition) and a window inside each; nothing is sampled, sorted over partitions or written.
    """
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = df.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows")).select(
        *keys, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"), F.sum("_rows").over(whole).alias(size)
    )
    nth = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_place")).cast("long")
    return df.withColumn("_nth", nth).join(runs, [*keys, "_part"]).withColumn(position, F.col("_nth") + F.col("_shift")).select(
        *[F.col(f"`{c}`") for c in df.columns], position, size
    )


def number_rows(
    df: DataFrame,
    key: str | Sequence[str],
    order: Sequence[str],
    position: str = "_position",
    size: str = "_size",
) -> DataFrame:
    """Exact 1-based position and row count per key, whatever share of the rows a key has.

    Rows without a key or without the first order column are left out. The order columns
    should be small (Spark samples them) and tell rows apart. Writes the sorted rows to
    durable storage, so positions stay the same when a later task is repeated.
    """
    keys = as_keys(key)
    order = list(order)
    df = _drop_null_order(df, keys + order[:1])
    placed = placed_rows(df, keys, order)
    runs = placed.groupBy(*keys, "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # One row per key and partition: a key has at most as many as there are partitions.
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select(
        *keys, "_part",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        F.sum("_rows").over(whole).alias(size),
    )
    return placed.join(shifts, [*keys, "_part"]).select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_place") + F.col("_shift")).alias(position), size
    )


def is_bounded(df: DataFrame, ts: str) -> bool:
    return isinstance(df.schema[ts].dataType, T.DateType)


def over_series(
    df: DataFrame,
    build: Build,
    back: int,
    ahead: int = 0,
    key: str | Sequence[str] = "ticker",
    ts: str = "date",
    tie: Sequence[str] = (),
    block_rows: int | None = None,
) -> DataFrame:
    """Run ``build`` over each series in the layout that fits.

    ``back``/``ahead`` are how many rows before and after a row its result depends on.
    ``block_rows`` forces the blocked layout; otherwise the order column's type decides. Rows that carry the place of
    ``placed_rows`` (in this order, by these keys or fewer) keep it through any number of steps, which then number them without a sort.
    """
    keys = as_keys(key)
    if block_rows is None and is_bounded(df, ts):
        df = _drop_null_order(df, keys + [ts])
        window = Window.partitionBy(*keys).orderBy(ts, *tie)
        layout = Layout(
            tuple(keys), window, F.row_number().over(window).cast("long"),
            F.count(F.lit(1)).over(Window.partitionBy(*keys)),
        )
        return build(df, layout)

    rows = block_rows or BLOCK_ROWS
    numbered = renumbered(df, keys) if place_columns(df) else number_rows(df, keys, [ts, *tie])
    at = F.col("_position") - 1
    first = F.greatest(F.floor((at - ahead) / F.lit(rows)), F.lit(0))
    last = F.least(F.floor((at + back) / F.lit(rows)), F.floor((F.col("_size") - 1) / F.lit(rows)))
    spread = numbered.withColumn("_block", F.explode(F.sequence(first, last)))
    layout = Layout(
        (*keys, "_block"), Window.partitionBy(*keys, "_block").orderBy("_position"),
        F.col("_position"), F.col("_size"),
    )
    built = build(spread, layout)
    own = F.floor((F.col("_position") - 1) / F.lit(rows)) == F.col("_block")
    return built.filter(own).drop("_block", "_position", "_size")


def series_layers(df: DataFrame, layers: Sequence[Layer], back: int, ahead: int = 0, **series) -> DataFrame:
    """``over_series`` for a list of layers."""
    return over_series(df, lambda d, lay: run_layers(d, lay, layers), back, ahead, **series)
