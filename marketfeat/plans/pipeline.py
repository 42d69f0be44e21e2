"""The pipelines: prices to predictions, headlines to daily sentiment, and their merge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketfeat.functions.rules import HeadlineRules, RelevanceRules
from marketfeat.operators import dataset, dedup, features, gates, indicators, joins, metrics, models, sentiment
from marketfeat.operators.series import placed_rows
from marketfeat.session import checkpointed
from marketfeat.sources.news import dated_titles


@dataclass(frozen=True)
class Parameters:
    """Parameters of the price pipeline."""

    warmup: int = indicators.WARMUP_ROWS
    threshold: float = features.THRESHOLD
    seq_len: int = 20
    train_ratio: float = dataset.TRAIN_RATIO
    val_ratio: float = dataset.VAL_RATIO
    decision: float = models.THRESHOLD
    half_life: float = 3.0


def indicator_bars(raw: DataFrame, warmup: int = indicators.WARMUP_ROWS, **series) -> DataFrame:
    """Raw bars to indicator bars. Changes come from the raw rows, indicators from the cleaned ones."""
    changed = indicators.ldcp_change(raw, **series)
    return indicators.technical_indicators(indicators.clean_bars(changed), warmup, **series)


def features_from_bars(
    raw: DataFrame, news: DataFrame | None = None, params: Parameters = Parameters(), **series
) -> DataFrame:
    """Raw bars to the labelled feature matrix, as one plan.

    In the plain layout both halves run over one exchange of the bars.
    """
    return features.feature_matrix(indicator_bars(raw, params.warmup, **series), news, params.threshold, **series)


def features_with_news(
    raw: DataFrame, articles: DataFrame, dim, mentions, params: Parameters = Parameters(), decay: bool = False, **series
) -> DataFrame:
    """Raw bars and scored articles to the feature matrix, with same-day or decaying news values.

    News joins the finished rows, which are fewer than the bars. The decaying form needs
    their dates as well, so it writes them to durable storage instead of computing them twice.
    """
    rows = features.price_features(indicator_bars(raw, params.warmup, **series), params.threshold, **series)
    if decay:
        joined = joins.join_news_decay(checkpointed(rows), articles, dim, mentions, params.half_life)
    else:
        joined = joins.join_news_flags(rows, articles, dim, mentions)
    return features.with_news(joined)


def scaled_splits(matrix: DataFrame, cols: Sequence[str] = features.FEATURE_COLUMNS, params: Parameters = Parameters(), **series):
    """Feature matrix to scaled rows with ``split``, and the scaler state."""
    names = {k: v for k, v in series.items() if k in ("key", "ts")}
    split = dataset.split_by_order(matrix, params.train_ratio, params.val_ratio, **series)
    state = dataset.scaler_fit(split, cols, **names)
    return dataset.scaler_apply(split, state, cols, **{k: v for k, v in names.items() if k == "key"}), state


def intraday_matrix(
    raw: DataFrame, key: str = "ticker", ts: str = "ts", tie: Sequence[str] = (), params: Parameters = Parameters(), block_rows: int | None = None
) -> DataFrame:
    """Bars at instants to the labelled feature matrix, for keys of any length.

    The rows are sorted over partitions and stored once. Their place goes with them through changes, indicators, features, and on
    through ``scaled_splits`` and ``intraday_samples``: each step numbers what is left by counts, and none sorts over partitions again. Indicator
    bars are stored, since features read them for counts and for rows.
    """
    series = {"key": key, "ts": ts, "tie": tuple(tie), "block_rows": block_rows}
    placed = placed_rows(raw.dropna(subset=[key, ts]), [key], [ts, *tie])
    bars = checkpointed(indicator_bars(placed, params.warmup, **series))
    return features.feature_matrix(bars, None, params.threshold, **series)


def intraday_samples(
    matrix: DataFrame, cols: Sequence[str] = features.FEATURE_COLUMNS, key: str = "ticker", ts: str = "ts", tie: Sequence[str] = (),
    params: Parameters = Parameters(), block_rows: int | None = None,
) -> DataFrame:
    """The result of ``intraday_matrix`` as scaled sequence samples per (key, split)."""
    series = {"key": key, "ts": ts, "tie": tuple(tie), "block_rows": block_rows}
    scaled, _ = scaled_splits(checkpointed(matrix), cols, params, **series)
    return dataset.sequence_windows(checkpointed(scaled), cols, seq_len=params.seq_len, **series)


def train_and_score(
    matrix: DataFrame,
    cols: Sequence[str] = features.FEATURE_COLUMNS,
    params: Parameters = Parameters(),
    stack_sizes: dict | None = None,
    grid: Sequence[float] = (0.0, 0.01, 0.1),
) -> tuple[DataFrame, DataFrame, models.DirectionModel | models.StackedModel]:
    """Feature matrix to predictions, metrics per (ticker, split), and the model. Sequences are pooled as they are met, and only that is stored."""
    scaled, _ = scaled_splits(matrix, cols, params)
    samples = checkpointed(models.pooled_samples(scaled, cols, seq_len=params.seq_len))
    model = models.fit_classifier(samples, params.seq_len, grid)
    if stack_sizes is not None:
        model = models.fit_stack(samples, model, stack_sizes)
    predictions = models.score_splits(model, samples, params.decision)
    return predictions, metrics.metrics_summary(predictions, threshold=params.decision), model


# -- news ---------------------------------------------------------------------------

def process_url_feed(raw: DataFrame, rules: HeadlineRules, order: Sequence[str | Column]) -> DataFrame:
    """Articles of a site with stable URLs: dedup by URL and title first, then the gates, then labels."""
    kept = gates.headline_gate(dedup.dedup_url_title(raw, order), rules)
    return kept.withColumn("category", gates.multi_label(F.col("title"), rules))


def process_title_feed(raw: DataFrame, rules: HeadlineRules, order: Sequence[str | Column]) -> DataFrame:
    """Articles of a site without stable URLs: the gates first, labels, then dedup by title."""
    kept = gates.headline_gate(raw, rules).withColumn("category", gates.multi_label(F.col("title"), rules))
    return dedup.dedup_date_title(kept, order)


def process_id_feed(raw: DataFrame, rules: HeadlineRules, order: Sequence[str | Column]) -> DataFrame:
    """Articles of the JSON feed: dedup by id and title, gates over title and description, then labels."""
    cols = ("title", "description")
    kept = gates.headline_gate(dedup.dedup_id_title(raw, order), rules, cols, anchor=False, feed_col="category")
    return kept.withColumn("subcategory", gates.multi_label(gates.joined_text(cols), rules))


def merged_news(
    sources: Mapping[str, DataFrame],
    categories: Mapping[str, str],
    priority: Mapping[str, int],
    rules: RelevanceRules,
    category_cols: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Processed articles of all sources as one clean table ``(date, source, category, title)``."""
    tables = []
    for source, table in sources.items():
        cols = (category_cols or {}).get(source, ("category",))
        mapped = gates.map_category(table, categories, cols)
        tables.append(mapped.select("date", F.lit(source).alias("source"), "category", "title"))
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table)
    unique = dedup.dedup_cross_source(dated_titles(merged), priority)
    return gates.relevance_cascade(unique, rules).select("date", "source", "category", "title")


def merge_prices(prices: DataFrame, articles: DataFrame, dim) -> DataFrame:
    """Indicator bars and the lagged daily sentiment of their category, for all categories in one plan.

    The daily table is written first: it is small, and both the check for repeated rows and the join read it. The calendar
    of price dates comes from the raw keys of ``prices``, so the wide rows are neither written nor computed twice.
    """
    daily = checkpointed(sentiment.category_sentiment(sentiment.daily_scores(articles)))
    return joins.join_sentiment(joins.ticker_category(prices, dim), daily)
