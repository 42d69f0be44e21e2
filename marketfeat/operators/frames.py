"""Statistics over long sliding frames in time linear in the rows, whatever the frame's length.

Spark computes a sliding frame anew for each row. Here positions are cut into chunks of the frame's length n. A frame of n rows is the end of
one chunk and the beginning of the next (or one whole chunk), so two growing frames a chunk, one from its start and one from its
end, hold all that is needed: each row adds one value to either, and a lag brings the end of the chunk before to the row.

Extremes are the larger and smaller of the two parts. Mean and deviation merge (count, mean, sum of squared deviations) of the parts; nothing
is subtracted from a running sum, so nothing cancels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from marketfeat.operators.series import Layer, Layout, Stage

#: Relative difference of two means of n equal values that is only their rounding, for each of the n.
_ROUNDING = 2.0 ** -52


def chunk_stage(lay: Layout, n: int) -> Stage:
    """Position and chunk of each row; a stage of its own before ``part_stage``."""
    return {f"_at{n}": lay.position, f"_chunk{n}": F.floor((lay.position - 1) / F.lit(n))}


def part_stage(lay: Layout, col: str, n: int, stats: Sequence[str], name: str) -> Stage:
    """The statistics of ``col`` from the chunk's start to the row, and from the row to the chunk's end."""
    chunk = Window.partitionBy(*lay.partition, f"_chunk{n}")
    grown = {
        "head": chunk.orderBy(f"_at{n}").rowsBetween(Window.unboundedPreceding, 0),
        "tail": chunk.orderBy(F.col(f"_at{n}").desc()).rowsBetween(Window.unboundedPreceding, 0),
    }
    found = {"n": F.count, "max": F.max, "min": F.min, "mean": F.avg, "var": F.var_pop}
    return {f"_{name}_{part}_{s}": found[s](col).over(w) for part, w in grown.items() for s in ("n", *stats)}


def meet_stage(lay: Layout, n: int, stats: Sequence[str], name: str, ends: int = 0) -> Stage:
    """Both parts of the frame that ends ``ends`` rows before each row, on that row."""
    out = {f"_{name}_a_{s}": F.lag(f"_{name}_tail_{s}", n - 1 + ends).over(lay.window) for s in ("n", *stats)}
    if ends:
        out |= {f"_{name}_b_{s}": F.lag(f"_{name}_head_{s}", ends).over(lay.window) for s in ("n", *stats)}
    else:
        out |= {f"_{name}_b_{s}": F.col(f"_{name}_head_{s}") for s in ("n", *stats)}
    return out


def whole(n: int, ends: int = 0) -> Column:
    """The frame is one chunk: its beginning is all of it."""
    return F.pmod(F.col(f"_at{n}") - ends, F.lit(n)) == 0


def frame_count(n: int, name: str, ends: int = 0) -> Column:
    """Values (not null) in a frame of n rows; null if the series has fewer rows."""
    a, b = F.col(f"_{name}_a_n"), F.col(f"_{name}_b_n")
    return F.when(whole(n, ends), b).otherwise(a + b)


def frame_extreme(n: int, stat: str, name: str, ends: int = 0) -> Column:
    a, b = F.col(f"_{name}_a_{stat}"), F.col(f"_{name}_b_{stat}")
    best = F.greatest(a, b) if stat == "max" else F.least(a, b)
    return F.when(whole(n, ends), b).otherwise(best)


def frame_moments(n: int, name: str, ends: int = 0, sample: bool = False) -> tuple[Column, Column]:
    """Mean and deviation (population, or of a sample) of a frame."""
    (na, ma, va), (nb, mb, vb) = ([F.col(f"_{name}_{p}_{s}") for s in ("n", "mean", "var")] for p in "ab")
    alone = whole(n, ends) | (na == 0)
    total = na + nb
    apart = mb - ma
    apart = F.when(F.abs(apart) <= F.abs(mb) * (_ROUNDING * n), F.lit(0.0)).otherwise(apart)
    mean = F.when(alone, mb).when(nb == 0, ma).otherwise(ma + apart * nb / total)
    squares = F.when(alone, vb * nb).when(nb == 0, va * na).otherwise(va * na + vb * nb + apart * apart * na * nb / total)
    size = F.when(whole(n, ends), nb).otherwise(total)
    return mean, F.sqrt(squares / (F.nullif(size - 1, F.lit(0)) if sample else F.nullif(size, F.lit(0))))


def extremes_layer(col: str, n: int, top: str, bottom: str) -> Layer:
    """The largest and smallest ``col`` of the last ``n`` rows; NULL unless all are present."""

    def layer(lay: Layout) -> list[Stage]:
        stats, name = ("max", "min"), f"x{n}_{col}"
        full = frame_count(n, name) == n
        return [
            chunk_stage(lay, n), part_stage(lay, col, n, stats, name), meet_stage(lay, n, stats, name),
            {top: F.when(full, frame_extreme(n, "max", name)), bottom: F.when(full, frame_extreme(n, "min", name))},
        ]

    return layer


def moments_layer(col: str, n: int, mean: str, sd: str, sample: bool = False) -> Layer:
    """Mean and deviation of ``col`` over the last ``n`` rows; NULL unless all are present."""

    def layer(lay: Layout) -> list[Stage]:
        stats, name = ("mean", "var"), f"m{n}_{col}"
        full = frame_count(n, name) == n
        average, deviation = frame_moments(n, name, sample=sample)
        return [
            chunk_stage(lay, n), part_stage(lay, col, n, stats, name), meet_stage(lay, n, stats, name),
            {mean: F.when(full, average), sd: F.when(full, deviation)},
        ]

    return layer
