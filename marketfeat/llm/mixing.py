"""Mixing sources to target weights by entropy balancing.

Each source has a token target. Among all document rates that meet it, entropy balancing takes those nearest to one in relative
entropy; they are exponential in the document's size, ``min(limit, exp(lambda * size / largest size))``, with one
multiplier a source. The multipliers are the optimum of a convex dual, found by Newton steps that a bracket keeps safe; each step is
one aggregation for all sources together. Then rates become whole copies.

Documents of one source and size have one rate, so every step works on the table of (source, size, number of documents):
it has at most (sources x distinct sizes) rows whatever the number of documents, and a source with a third of
all documents is already summed there. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketfeat.llm.common import WORD, boxed, field, ranked, table
from marketfeat.session import checkpointed

#: Newton steps at most; they end when every source is within TOLERANCE of its target.
STEPS, TOLERANCE = 60, 1e-7
#: Corrections of what rounding leaves.
FIXES = 3


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size`` (words; 0 for a null text), ``h`` (a hash of the whole row)."""
    return boxed(docs, **_keys(docs)).drop("row")


def _keys(docs: DataFrame) -> dict[str, Column]:
    hashed = [field(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return {
        "doc_id": field("doc_id").cast("long"), "source": field("source").cast("string"),
        "size": F.coalesce(F.regexp_count(field("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long"), "h": F.xxhash64(*hashed),
    }


def targets(per_source: DataFrame, weights: Sequence[float], total: float, limit: int) -> DataFrame:
    """Adds ``k`` (number of the source by code point, null last) and ``target`` to (source, source_size).

    Shares follow the repeating weights up to ``limit`` times the source's size; the excess is shared again, which is one water
    level over the sources ordered by the level that fills them. The windows hold one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = per_source.withColumn("k", F.row_number().over(by_name) - 1).withColumn(
        "w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("k") % len(weights) + 1)
    ).withColumn("cap", F.lit(float(limit)) * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), "k")
    before, rest = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        F.lit(float(total)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("w").over(rest)
    filled = numbered.withColumn("level", level)
    water = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap") * (1 + 1e-12), F.col("level"))).over(everything)
    return filled.withColumn("target", F.least(F.col("cap"), F.coalesce(water * F.col("w"), F.col("cap")))).select(
        "k", "source", "source_size", "target"
    )


def multipliers(groups: DataFrame, limit: int) -> DataFrame:
    """``k``, ``lam`` that meet the targets of ``groups`` (k, x, n, tokens, target); null where every rate is the limit.

    x is the size over the source's largest. The bracket: all rates are at the limit from log(limit) / min x on, and the
    taken tokens are below the target from log(target / size) / min x on, if the target is below the size.
    """
    state = groups.filter("x > 0 and target > 0").groupBy("k").agg(
        F.first("target").alias("target"), F.sum("tokens").alias("size"), F.min("x").alias("x0"),
        (F.sum(F.col("tokens") * F.col("x")) / F.sum("tokens")).alias("mean"),
    ).filter(F.col("target") < F.col("size") * limit * (1 - 1e-12))
    start = F.log(F.col("target") / F.col("size"))
    state = checkpointed(state.select(
        "k", "target", F.least(F.lit(0.0), start / F.col("x0")).alias("lo"),
        (F.log(F.lit(float(limit))) / F.col("x0")).alias("hi"), (start / F.col("mean")).alias("lam"),
    ).withColumn("lam", F.greatest("lo", F.least("hi", "lam"))))
    for _ in range(STEPS):
        rate = F.exp(F.least(F.col("lam") * F.col("x"), F.log(F.lit(float(limit)))))
        free = F.col("lam") * F.col("x") < F.log(F.lit(float(limit)))
        taken = groups.filter("x > 0").select("k", "x", "tokens").join(state, "k").groupBy("k").agg(
            F.first("target").alias("target"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("lam").alias("lam"),
            F.sum(F.col("tokens") * rate).alias("f"),
            F.sum(F.when(free, F.col("tokens") * F.col("x") * rate).otherwise(0.0)).alias("slope"),
        )
        low = F.when(F.col("f") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        high = F.when(F.col("f") >= F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        done = F.abs(F.col("f") - F.col("target")) <= TOLERANCE * F.col("target")
        newton = F.col("lam") + (F.col("target") - F.col("f")) / F.nullif(F.col("slope"), F.lit(0.0))
        state = checkpointed(
            taken.withColumn("newton", newton).withColumn("lo2", low).withColumn("hi2", high).select(
                "k", "target", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"),
                F.when(done, F.col("lam")).when((F.col("newton") > F.col("lo2")) & (F.col("newton") < F.col("hi2")), F.col("newton"))
                .otherwise((F.col("lo2") + F.col("hi2")) / 2).alias("lam"), done.alias("done"),
            )
        )
        if not state.filter("not done").limit(1).count():
            break
    return state.select("k", "lam")


def copies(groups: DataFrame, limit: int) -> DataFrame:
    """``groups`` with ``total``, the whole copies that their ``n`` documents get together.

    First the running sum of rates, largest sizes first, is rounded: what that leaves is at most one largest size. Then, FIXES times,
    one copy of the size nearest to what is left is added or taken away, where that brings the source nearer.
    """
    down = Window.partitionBy("k").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = F.floor(F.sum(F.col("n") * F.col("rate")).over(down) + 0.5)
    steps = groups.withColumn("run", run)
    last = F.lag("run", 1, 0).over(Window.partitionBy("k").orderBy(F.col("size").desc()))
    most = F.col("n") * limit
    now = checkpointed(steps.withColumn("last", last).withColumn(
        "total", F.greatest(F.lit(0), F.least(F.col("run") - F.col("last"), most)).cast("long")
    ).drop("run", "last"))
    for _ in range(FIXES):
        left = now.groupBy("k").agg((F.first("target") - F.sum(F.col("total") * F.col("size"))).alias("left"))
        open_ = now.join(left, "k").filter(
            F.when(F.col("left") > 0, F.col("total") < most).otherwise(F.col("total") > 0) & (F.col("size") > 0)
            & (F.col("size") < 2 * F.abs("left"))
        )
        best = open_.groupBy("k").agg(
            F.min(F.struct(F.abs(F.abs("left") - F.col("size")), F.col("size"))).alias("best"), F.first("left").alias("left")
        ).select("k", F.col("best.size").alias("size"), F.signum("left").cast("long").alias("one"))
        now = checkpointed(
            now.join(best, ["k", "size"], "left").withColumn("total", F.col("total") + F.coalesce("one", F.lit(0))).drop("one")
        )
    return now


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), total: float = 1.5, limit: int = 2) -> DataFrame:
    """``doc_id``, ``h``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` of each row of ``docs`` (doc_id, text, source).

    Sources by code point, null last, take the weights in turn. A source of size 0 has target 0; a document without words counts as
    one copy and takes nothing. Which documents of a size get the odd copy follows from a hash of doc_id, so reruns
    agree; rows repeated with their id are counted one by one. ``h`` (a hash of the row) tells rows of one id apart. Empty tables give no rows; other columns are ignored.
    """
    rows = checkpointed(sizes(docs))
    counts = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    counts = checkpointed(counts)
    per_source = counts.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.max("size").alias("largest")
    )
    wanted = checkpointed(targets(per_source.select("source", "source_size"), weights, total, limit))
    big = per_source.select(F.col("source").alias("s"), "largest")
    wanted = wanted.join(big, wanted["source"].eqNullSafe(big["s"])).drop("s")
    joined = counts.withColumnRenamed("source", "s")
    groups = checkpointed(joined.join(wanted, joined["s"].eqNullSafe(wanted["source"])).select(
        "k", "size", "n", "source_size", "target", (F.col("size") / F.nullif("largest", F.lit(0))).alias("x"),
        (F.col("n") * F.col("size")).cast("double").alias("tokens"), "source",
    ).withColumn("x", F.coalesce("x", F.lit(0.0))))
    lam = multipliers(groups, limit)
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("target") == 0, 0.0).otherwise(
        F.coalesce(F.exp(F.least(F.col("lam") * F.col("x"), F.log(F.lit(float(limit))))), F.lit(float(limit)))
    )
    rated = copies(groups.join(lam, "k", "left").withColumn("rate", rate), limit).select(
        F.col("source").alias("_source"), F.col("size").alias("_size"), "source_size", "target",
        F.floor(F.col("total") / F.col("n")).alias("each"), (F.col("total") % F.col("n")).alias("odd"),
    )
    placed = ranked(rows, ["source", "size"], ["doc_id", "h"], "rank")
    return placed.join(
        rated, placed["source"].eqNullSafe(rated["_source"]) & (placed["size"] == rated["_size"])
    ).select(
        "doc_id", "h", "source", "size", "source_size", "target",
        (F.col("each") + F.when(F.col("rank") < F.col("odd"), 1).otherwise(0)).cast("long").alias("copies"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns stay as they are, whatever their names.

    Rows that repeat in all columns (maps and variants aside) are one row that comes as often as the mix takes all of them.
    """
    key = ["doc_id", "source", "size", "h"]
    given = checkpointed(mix(docs, **options).groupBy(*key).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("same")))
    here = boxed(docs, **_keys(docs))

    def taken(part: DataFrame) -> DataFrame:
        met = [here[c].eqNullSafe(part[c]) for c in key]
        return here.join(part, met[0] & met[1] & met[2] & met[3]).select(*[here[c] for c in ("row", *key)], "copies")

    single = taken(given.filter("same = 1 AND copies > 0")).select("row", "copies")
    repeated = taken(given.filter("same > 1 AND copies > 0")).groupBy(*key).agg(F.first("row").alias("row"), F.first("copies").alias("copies"))
    out = single.union(repeated.select("row", "copies"))
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def op5_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )
