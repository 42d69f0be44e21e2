"""Rule-based text filters and labels. All of it is column expressions; no row leaves the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketfeat.functions.rules import (
    AnnouncementRules,
    HeadlineRules,
    RelevanceRules,
    has_literal,
    has_pattern,
    has_word,
    word_pattern,
)
from marketfeat.functions.text import primary_label, python_strip


def joined_text(cols: Sequence[str]) -> Column:
    """Columns joined by one blank, missing ones as empty text, trimmed."""
    return python_strip(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols]))


def any_category(text: Column, rules: HeadlineRules) -> Column:
    """Whether at least one category matches: one alternation over the phrases of all of them."""
    return has_word(text, [p for phrases in rules.categories.values() for p in phrases])


def headline_gate(
    df: DataFrame,
    rules: HeadlineRules,
    text_cols: Sequence[str] = ("title",),
    anchor: bool = True,
    feed_col: str | None = None,
) -> DataFrame:
    """Rows whose headline passes every gate.

    The first of ``text_cols`` is the title: it must have ``min_length`` characters. The
    joined text must show no foreign and no excluded phrase, an anchor phrase (if
    ``anchor``), and a phrase of some category. Rows of a rejected feed go too.
    """
    title = F.col(text_cols[0])
    text = title if len(text_cols) == 1 else joined_text(text_cols)
    keep = (F.length(title) >= rules.min_length) & ~has_word(text, rules.foreign) & ~has_word(text, rules.excluded)
    if anchor and rules.anchor:
        keep = keep & has_word(text, rules.anchor)
    if feed_col and rules.rejected_feeds:
        keep = keep & ~F.coalesce(F.col(feed_col).isin(*rules.rejected_feeds), F.lit(False))
    return df.filter(keep & any_category(text, rules))


def multi_label(text: Column, rules: HeadlineRules) -> Column:
    """All matching categories in rule order, joined by ``|``; the default label if there is none."""
    found = [F.when(text.rlike(word_pattern(phrases)), F.lit(label)) for label, phrases in rules.categories.items()]
    return F.regexp_replace(F.concat_ws("|", *found), r"\A\z", rules.default)


def relevant(title: Column, rules: RelevanceRules) -> Column:
    """The relevance cascade: the first rule that matches decides; no match means relevant."""
    text = F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(has_pattern(text, rules.keep), True)
        .when(has_pattern(text, rules.off_topic), False)
        .when(has_pattern(text, rules.price_ticker) & ~has_pattern(text, rules.price_ticker_keep), False)
        .when(has_literal(text, rules.institutions), True)
        .when(has_pattern(text, (rules.amount,)), True)
        .when(has_literal(text, rules.country), True)
        .when(has_pattern(text, rules.foreign), False)
        .otherwise(True)
    )


def relevance_cascade(df: DataFrame, rules: RelevanceRules, title: str = "title") -> DataFrame:
    """Rows with a relevant title."""
    return df.filter(relevant(F.col(title), rules))


# -- announcements ------------------------------------------------------------------

def is_time_cell(text: Column, rules: AnnouncementRules) -> Column:
    return python_strip(text).rlike("(?iU)" + rules.time)


def is_junk(text: Column, rules: AnnouncementRules) -> Column:
    return F.upper(python_strip(text)).isin(*rules.junk) | is_time_cell(text, rules)


def is_bare_company(text: Column, rules: AnnouncementRules) -> Column:
    """A short text that ends like a company name and speaks of no event."""
    trimmed = python_strip(text)
    words = F.size(F.filter(F.split(trimmed, r"(?U)\s+"), lambda w: w != ""))
    suffix = r"(?iuU)\b(?:" + "|".join(rules.company_suffixes) + r")\s*(?:Limited)?\s*$"
    return (words <= rules.max_name_words) & trimmed.rlike(suffix) & ~has_word(trimmed, rules.keywords)


def announcement_clean(df: DataFrame, rules: AnnouncementRules, title: str = "title") -> DataFrame:
    """Announcements with a real title: not junk, not a time, not a bare name, long enough."""
    text = F.col(title)
    return df.filter(
        ~is_junk(text, rules) & ~is_bare_company(text, rules)
        & (F.length(python_strip(text)) >= rules.min_length)
    )


# -- category lookup ----------------------------------------------------------------

def lookup(col: Column, table: Mapping[str, str]) -> Column:
    """Value of a small dictionary that ships with the query, NULL if the key is unknown."""
    if len(table) > 5_000:
        raise ValueError("too many entries for a literal lookup; join a DataFrame instead")
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(entries, col)


def map_category(
    df: DataFrame,
    table: Mapping[str, str] | DataFrame,
    cols: Sequence[str] = ("category",),
    out: str = "category",
) -> DataFrame:
    """Raw label to standard category; rows with an unknown label go.

    The first non-null of ``cols`` counts, trimmed, lower case, its first label only.
    ``table`` is a dictionary, or a DataFrame ``(label, standard)`` for a large one.
    """
    raw = F.coalesce(*[F.col(c) for c in cols])
    key = primary_label(F.lower(python_strip(raw)))
    if isinstance(table, DataFrame):
        named = table.select(F.col("label").alias("_label"), F.col("standard").alias("_standard"))
        found = df.withColumn("_label", key).join(named, "_label").drop("_label")
    else:
        found = df.withColumn("_standard", lookup(key, table)).filter(F.col("_standard").isNotNull())
    return found.withColumn(out, F.col("_standard")).drop("_standard")
