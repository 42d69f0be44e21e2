"""Article sentiment: scores from logits, pluggable scorers, daily aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketfeat.functions.numeric import array_round
from marketfeat.functions.rules import word_pattern
from marketfeat.functions.text import normalize_title
from marketfeat.operators.series import number_rows

# Order of the three logits, sign of each label, categories of the wide table.
LABELS = ("positive", "negative", "neutral")
SIGNS = {"positive": 1.0, "negative": -1.0, "neutral": 0.0}
CATEGORIES = ("macro", "energy", "banking", "forex", "corporate")


def logits_to_sentiment(a: Column, b: Column, c: Column) -> Column:
    """Struct ``(sentiment_label, sentiment_score, sentiment_compound)`` from three logits.

    Softmax, largest probability (the first on ties), rounded to 6 digits; compound is
    the score with the sign of its label. The arguments are used several times, so they
    should be plain columns.
    """
    top = F.greatest(a, b, c)
    score = array_round(1.0 / (F.exp(a - top) + F.exp(b - top) + F.exp(c - top)), 6)
    label = F.when(a == top, LABELS[0]).when(b == top, LABELS[1]).when(c == top, LABELS[2])
    sign = F.when(a == top, SIGNS[LABELS[0]]).when(b == top, SIGNS[LABELS[1]]).when(c == top, SIGNS[LABELS[2]])
    return F.struct(
        label.alias("sentiment_label"), score.alias("sentiment_score"), (sign * score).alias("sentiment_compound")
    )


def with_sentiment(df: DataFrame, logits: str | Column = "logits") -> DataFrame:
    """Adds the three sentiment columns and drops the logits.

    Each step is a projection of its own, so a costly logits expression runs once per row.
    """
    col = F.col(logits) if isinstance(logits, str) else logits
    kept = [c for c in df.columns if c != logits] if isinstance(logits, str) else df.columns
    names = ("_positive", "_negative", "_neutral")
    three = df.withColumn("_logits", col).withColumns({n: F.get("_logits", i).cast("double") for i, n in enumerate(names)})
    scored = three.withColumn("_s", logits_to_sentiment(*[F.col(n) for n in names]))
    return scored.select(*[F.col(f"`{c}`") for c in kept], "_s.*")


def lexicon_logits(text: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """Logits from word counts: positive hits, negative hits, and a constant 0.5 for neutral."""
    clean = F.coalesce(text, F.lit(""))
    count = lambda words: F.regexp_count(clean, F.lit(word_pattern(words))).cast("double")
    return F.array(count(positive), count(negative), F.lit(0.5))


Scorer = Callable[[list[str]], Sequence[Sequence[float]]]


def score_text(
    df: DataFrame,
    col: str = "title",
    model_factory: Callable[[], Scorer] | None = None,
    batch: int = 64,
    positive: Sequence[str] = (),
    negative: Sequence[str] = (),
) -> DataFrame:
    """Article rows with sentiment columns.

    ``model_factory`` loads a model and returns a function from a list of texts to
    three logits per text. It runs once per task; texts reach the model in batches of
    ``batch``. Without a model the score comes from word counts, as column expressions.
    """
    if model_factory is None:
        return with_sentiment(df, lexicon_logits(F.col(col), positive, negative))

    schema = T.StructType([*df.schema.fields, T.StructField("logits", T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for frame in frames:
            texts = frame[col].fillna("").astype(str).tolist()
            rows: list[list[float]] = []
            for start in range(0, len(texts), batch):
                rows.extend([float(v) for v in row] for row in model(texts[start:start + batch]))
            yield frame.assign(logits=rows)

    return with_sentiment(df.mapInPandas(run, schema), "logits")


# -- daily aggregates ---------------------------------------------------------------

def daily_scores(articles: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """The wide daily table, one row per (date, category): mean compound rounded to 6 digits in the column of its own category, 0 elsewhere.

    Its titles are a table of their own, ``daily_titles``.
    """
    grouped = (
        articles.withColumn("date", F.to_date("date"))
        .filter(F.col("date").isNotNull() & F.col("category").isNotNull())
        .groupBy("date", "category")
        .agg(array_round(F.avg("sentiment_compound"), 6).alias("_mean"))
    )
    return grouped.select("date", "category", *[
        F.when(F.col("category") == c, F.col("_mean")).otherwise(0.0).alias(f"sentiment_{c}") for c in categories
    ])


def daily_titles(articles: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Every title as a row ``(date, category, rank, title)``, ranked from 1 inside its (date, category).

    The order is that of the whole normalized title, then of the columns ``order`` (say, the id; without
    one, a hash of the title). Rows without title, date or category are left out. Titles are numbered
    over range partitions, so a day of any size spreads over tasks and the result has one shape.
    """
    titled = articles.filter(
        F.col("title").isNotNull() & F.to_date("date").isNotNull() & F.col("category").isNotNull()
    )
    ties = {f"_tie{i}": F.col(c) for i, c in enumerate(order)} if order else {"_tie0": F.xxhash64("title")}
    rows = titled.select(
        F.to_date("date").alias("date"), "category", "title", normalize_title(F.col("title")).alias("_lead"),
        *[c.alias(n) for n, c in ties.items()],
    )
    numbered = number_rows(rows, ["date", "category"], ["_lead", *ties])
    return numbered.select("date", "category", F.col("_position").alias("rank"), "title")


def title_cells(titles: DataFrame, per_cell: int) -> DataFrame:
    """``(date, category, part, title)``: the rows of ``daily_titles`` joined by `` | ``, ``per_cell`` to a text, in order.

    A step before a sink that wants one text per day. A task holds one cell at a time, so ``per_cell`` times the
    longest title should fit its memory. ``part`` numbers the cells of a day from 0, at every size.
    """
    part = F.floor((F.col("rank") - 1) / F.lit(per_cell)).cast("int").alias("part")
    rows = F.array_sort(F.collect_list(F.struct("rank", "title")))
    return titles.groupBy("date", "category", part).agg(
        F.array_join(F.transform(rows, lambda x: x["title"]), " | ").alias("title")
    )


def category_sentiment(daily: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Long form ``(date, category, sentiment)`` of the wide table."""
    value = F.coalesce(*[F.when(F.col("category") == c, F.col(f"sentiment_{c}")) for c in categories])
    return daily.filter(F.col("category").isin(*categories)).select("date", "category", value.alias("sentiment"))


def sentiment_lag(daily: DataFrame, n: int = 1) -> DataFrame:
    """Each date gets the value of the ``n``-th news date before it, per category; dates without one go.

    There is one row per (date, category), so a category's series is as long as the calendar.
    """
    by_date = Window.partitionBy("category").orderBy("date")
    lagged = daily.withColumn("sentiment", F.lag("sentiment", n).over(by_date))
    return lagged.filter(F.col("sentiment").isNotNull())
