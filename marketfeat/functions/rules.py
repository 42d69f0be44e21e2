"""Rule sets for headlines and announcements, and their compilation to column expressions.

Rules are data: tuples of phrases, each a literal or a small regular expression.
One gate compiles to one alternation, so a row is matched once per gate however
many phrases the gate has.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_pattern(phrases: Iterable[str]) -> str:
    """Any phrase as whole words, whatever the case; letters of all scripts count as word characters.

    When every phrase begins with a letter or digit, a look-ahead on the first characters
    comes first: it is much cheaper than the word boundary and fails almost everywhere.
    """
    phrases = tuple(phrases)
    first = sorted({p[0].lower() for p in phrases})
    plain = all(c.isascii() and c.isalnum() for c in first) and not any(re.match(r".[*?|{]", p) or "|" in p for p in phrases)
    ahead = f"(?=[{''.join(first)}])" if plain else ""
    return rf"(?iuU){ahead}\b(?:" + "|".join(phrases) + r")\b"


def any_pattern(patterns: Iterable[str]) -> str:
    """Any pattern anywhere in the text."""
    return r"(?duU)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def has_word(text: Column, phrases: Iterable[str]) -> Column:
    phrases = tuple(phrases)
    return text.rlike(word_pattern(phrases)) if phrases else F.lit(False)


def has_pattern(text: Column, patterns: Iterable[str]) -> Column:
    patterns = tuple(patterns)
    return text.rlike(any_pattern(patterns)) if patterns else F.lit(False)


def has_literal(text: Column, literals: Iterable[str]) -> Column:
    """Any literal as a part of the text, also inside a word."""
    literals = tuple(literals)
    return text.rlike("|".join(re.escape(x) for x in literals)) if literals else F.lit(False)


@dataclass(frozen=True)
class HeadlineRules:
    """Phrases of the headline gates. An empty ``anchor`` means that gate is open."""

    foreign: tuple[str, ...]
    excluded: tuple[str, ...]
    categories: Mapping[str, tuple[str, ...]]
    anchor: tuple[str, ...] = ()
    default: str = "general_market"
    min_length: int = 15
    rejected_feeds: tuple[str, ...] = ()


@dataclass(frozen=True)
class RelevanceRules:
    """Patterns of the relevance cascade, in the order in which they decide."""

    keep: tuple[str, ...] = ()
    off_topic: tuple[str, ...] = ()
    price_ticker: tuple[str, ...] = ()
    price_ticker_keep: tuple[str, ...] = ()
    institutions: tuple[str, ...] = ()
    amount: str = r"rs\d"
    country: tuple[str, ...] = ()
    foreign: tuple[str, ...] = ()


@dataclass(frozen=True)
class AnnouncementRules:
    """What marks an announcement cell as junk or as a bare company name."""

    junk: tuple[str, ...]
    time: str
    company_suffixes: tuple[str, ...]
    keywords: tuple[str, ...]
    max_name_words: int = 7
    min_length: int = 8


@dataclass
class RuleTable:
    """Rules kept as rows ``(gate, label, priority, pattern)``, for users who store them in a table."""

    rows: list[tuple[str, str, int, str]] = field(default_factory=list)

    @classmethod
    def from_dataframe(cls, df: DataFrame, max_rows: int = 10_000) -> RuleTable:
        """Read a rule table. Rules become part of the query, so the row count is checked."""
        found = df.select("gate", "label", "priority", "pattern").limit(max_rows + 1).collect()
        if len(found) > max_rows:
            raise ValueError(f"more than {max_rows} rules")
        return cls([tuple(r) for r in found])

    def _gate(self, name: str) -> tuple[str, ...]:
        return tuple(p for g, _, _, p in sorted(self.rows, key=lambda r: (r[2], r[3])) if g == name)

    def headline_rules(self, **options) -> HeadlineRules:
        labels: dict[str, list[str]] = {}
        for gate, label, _, pattern in sorted(self.rows, key=lambda r: (r[2], r[3])):
            if gate == "category":
                labels.setdefault(label, []).append(pattern)
        return HeadlineRules(
            foreign=self._gate("foreign"), excluded=self._gate("excluded"), anchor=self._gate("anchor"),
            categories={k: tuple(v) for k, v in labels.items()}, **options,
        )

    def relevance_rules(self) -> RelevanceRules:
        return RelevanceRules(
            keep=self._gate("keep"), off_topic=self._gate("off_topic"),
            price_ticker=self._gate("price_ticker"), price_ticker_keep=self._gate("price_ticker_keep"),
            institutions=self._gate("institution"), country=self._gate("country"),
            foreign=self._gate("foreign_signal"),
        )
