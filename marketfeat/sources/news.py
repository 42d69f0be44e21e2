"""News: article files, link pages, the JSON feed, announcement tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketfeat.functions.markup import decode_entities, normal_form
from marketfeat.functions.rules import AnnouncementRules
from marketfeat.functions.text import canonical_url, plain_text, python_strip
from marketfeat.operators.gates import is_bare_company, is_junk
from marketfeat.sources.bars import parse_date, reader_format


def union_sources(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables, matched by column name; a column a table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_articles(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Article tables of several sources as one, tagged with ``source``; ids stay text.

    A source whose path does not exist is left out; none at all raises.
    """
    tables = []
    for source, path in paths.items():
        if not path_exists(spark, path):
            continue
        if reader_format(path) == "csv":
            raw = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
        else:
            raw = spark.read.parquet(path)
        if "id" in raw.columns:
            raw = raw.withColumn("id", F.col("id").cast("string"))
        tables.append(raw.withColumn("source", F.lit(source)))
    if not tables:
        raise FileNotFoundError(f"none of the sources exists: {sorted(paths)}")
    return union_sources(tables)


def dated_titles(df: DataFrame) -> DataFrame:
    """Rows with a title and a date that parses; ``date`` becomes a DATE."""
    return df.withColumn("date", F.col("date").try_cast("date")).na.drop(subset=["date", "title"])


# -- link pages ---------------------------------------------------------------------

def absolute_url(href: Column, base: Column) -> Column:
    """Link target against the address of its page."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(base, r"[?#].*\z", "")
    folder = F.when(path == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(path, r"[^/]*\z", ""))
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.rlike(r"^[?#]"), F.concat(path, href))
        .otherwise(F.concat(folder, href))
    )


def extract_links(
    pages: DataFrame,
    pattern: str,
    exclude_ids: Sequence[str] = (),
    min_len: int = 10,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Article links of pages ``(url, html)``: one row ``(url, title)`` per link.

    The absolute target must match ``pattern`` and its text must have ``min_len``
    characters. With ``exclude_ids``, the first group of ``pattern`` is an article id and
    pinned articles are left out. The URL comes out without query and trailing slash.
    ``keep`` names page columns to carry along.
    """
    anchor = r'(?s)<a href="([^"]*+)">(.*?)</a>'
    found = F.regexp_extract_all(normal_form(F.col("html"), {"a": "href"}), F.lit(anchor), F.lit(0))
    href, text = (F.regexp_extract("_link", anchor, i) for i in (1, 2))
    # The outer form, as Spark tests what the plain one explodes for size first, which would split each page again.
    linked = pages.select(*keep, F.col("url").alias("_page"), F.explode_outer(found).alias("_link")).filter("_link IS NOT NULL")
    rows = linked.select(
        *keep,
        absolute_url(python_strip(decode_entities(href)), F.col("_page")).alias("_href"),
        plain_text(text).alias("title"),
    )
    wanted = F.col("_href").rlike(pattern) & (F.length("title") >= min_len)
    if exclude_ids:
        wanted = wanted & ~F.regexp_extract("_href", pattern, 1).isin(*exclude_ids)
    return rows.filter(wanted).select(*keep, canonical_url(F.col("_href")).alias("url"), "title")


# -- JSON feed ----------------------------------------------------------------------

# The spellings under which the feed sends each field.
ID_KEYS = ("NewsID", "newsID", "NewsId", "newsId")
LINK_KEYS = ("Link", "link")
CATEGORY_KEYS = ("CategoryName", "categoryName")
TIME_KEYS = ("ModifyDateTime", "modifyDateTime", "PublishedTime", "publishedTime", "CreatedDate")
HEADING_KEYS = (("Headings", "headings"), ("Heading", "heading"))
DESCRIPTION_KEYS = (("Descriptions", "descriptions"), ("Description", "description"))
DESCRIPTION_LENGTH = 300


def _text_at(item: Column, path: str) -> Column:
    return F.nullif(F.try_variant_get(item, path, "string"), F.lit(""))


def _first_of(item: Column, keys: Sequence[str]) -> Column:
    return F.coalesce(*[_text_at(item, f"$.{k}") for k in keys])


def _first_element(item: Column, names: tuple[Sequence[str], Sequence[str]]) -> Column:
    """First element of a list field, or the field itself when it is a scalar."""
    found = []
    for outer in names[0]:
        for inner in names[1]:
            path = f"$.{outer}.{inner}"
            found.append(_text_at(item, f"{path}[0]"))
            is_list = F.try_variant_get(item, path, "array<variant>").isNotNull()
            found.append(F.when(~is_list, _text_at(item, path)))
    return F.coalesce(*found, F.lit(""))


def parse_json_items(
    df: DataFrame, col: str = "payload", base_url: str = "", keep: Sequence[str] = ()
) -> DataFrame:
    """Articles of the JSON lists in ``col``; one row per item with an id and a heading.

    Each field has several spellings, the first non-empty one counts. The date is the first
    10 characters of the time. ``url`` is ``base_url`` plus the link, or plus ``-id``
    without one. Text that is no JSON list gives no rows.
    """
    items = F.from_json(F.when(F.ltrim(F.col(col)).startswith("["), F.col(col)), "array<variant>")
    rows = df.select(*keep, F.explode(items).alias("_item"))
    item = F.col("_item")
    parsed = rows.select(
        *keep,
        _first_of(item, ID_KEYS).alias("id"),
        F.substring(_first_of(item, TIME_KEYS), 1, 10).alias("date"),
        F.coalesce(_first_of(item, CATEGORY_KEYS), F.lit("")).alias("category"),
        _first_element(item, HEADING_KEYS).alias("title"),
        F.substring(_first_element(item, DESCRIPTION_KEYS), 1, DESCRIPTION_LENGTH).alias("description"),
        _first_of(item, LINK_KEYS).alias("_link"),
    ).filter(F.col("id").isNotNull() & (F.col("title") != ""))
    url = F.concat(F.lit(base_url), F.coalesce("_link", F.concat(F.lit("-"), F.col("id"))))
    return parsed.withColumn("url", url).drop("_link")


# -- announcements ------------------------------------------------------------------

MIN_TITLE_CELL = 6
ANNOUNCEMENT_DATE_FORMATS = ("MMM d, yyyy", "yyyy-MM-dd", "d MMM yyyy", "M/d/yyyy")


def without_view_link(cell: Column) -> Column:
    """Cell text without the caption of its document link."""
    return python_strip(F.regexp_replace(F.regexp_replace(cell, r"(?i)View\s*PDF", ""), r"(?i)\bView\b", ""))


def parse_announcement_rows(
    df: DataFrame,
    rules: AnnouncementRules,
    cells: str = "cells",
    year_from: int = 2010,
    year_to: int = 2026,
    keep: Sequence[str] = (),
    formats: Sequence[str] = ANNOUNCEMENT_DATE_FORMATS,
) -> DataFrame:
    """Date and title of table rows given as arrays of cell texts.

    Junk and time cells are skipped. The first cell that is a date of the years 2000 to
    2030 is the date. Among the other cells the longest that is not a bare company name is
    the title (of at least 6 characters), the first one on ties. Rows without date or title,
    with a bare name only, or with a year outside the range give nothing.
    """
    trimmed = F.filter(F.transform(cells, python_strip), lambda c: (c != "") & ~is_junk(c, rules))
    rows = df.filter(F.size(cells) >= 2).withColumn("_cells", trimmed)

    def as_date(c: Column) -> Column:
        d = parse_date(c, formats)
        return F.when(F.year(d).between(2000, 2030), d)

    rows = rows.withColumn("_dates", F.transform("_cells", as_date))
    place = F.array_position(F.transform("_dates", lambda d: d.isNotNull()), True)
    rows = rows.withColumn("_place", place.cast("int")).filter(F.col("_place") > 0)
    rows = rows.withColumns({
        "_date": F.get("_dates", F.col("_place") - 1),
        "_titles": F.transform(F.filter("_cells", lambda c, i: i != F.col("_place") - 1), without_view_link),
    })
    named = F.filter(
        "_titles", lambda c: (F.length(c) >= MIN_TITLE_CELL) & ~is_junk(c, rules) & ~is_bare_company(c, rules)
    )
    best = F.array_max(F.transform(named, lambda c, i: F.struct(F.length(c).alias("n"), (-i).alias("at"), c.alias("title"))))
    parsed = rows.withColumn("_best", best).filter(
        F.col("_best").isNotNull() & F.year("_date").between(year_from, year_to)
    )
    return parsed.select(*keep, F.date_format("_date", "MMM dd, yyyy").alias("date"), F.col("_best.title").alias("title"))


def announcement_date(col: Column) -> Column:
    """DATE of an announcement's date text, NULL if it does not parse."""
    return F.try_to_timestamp(col, F.lit("MMM dd, yyyy")).cast("date")


def sort_announcements(df: DataFrame) -> DataFrame:
    """Symbol ascending, newest first."""
    return df.orderBy(F.col("symbol").asc(), announcement_date(F.col("date")).desc())
