"""How the given tables play the tables of the domain. Whole tables, whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketfeat.functions.rules import AnnouncementRules, HeadlineRules, RelevanceRules
from marketfeat.operators import features, indicators, sentiment


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- prices -------------------------------------------------------------------------

def bars(spark: SparkSession, sf: str, ticker: str = "p_brand") -> DataFrame:
    """Daily bars of a brand: trades are order lines, the price is that of one piece.

    Returned lines do not count as volume, so some days have none.
    """
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
        "l_returnflag", "l_shipdate",
    )
    parts = table(spark, sf, "part").select("p_partkey", F.col(ticker).alias("ticker"))
    trades = lines.join(parts, lines.l_partkey == parts.p_partkey)
    price = F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))
    # Order of trades as one number (order line, then cents, then pieces): a fixed-width key keeps
    # the aggregation in the hash table, a struct would sort every map task's rows.
    line = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("decimal(20,0)") * F.lit(10 ** 12).cast("decimal(13,0)")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long") * 100 + F.round("l_quantity").cast("long")
    order = line + cents.cast("decimal(12,0)")
    traded = F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0)
    return trades.groupBy("ticker", F.col("l_shipdate").cast("date").alias("date")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order).alias("close"), F.sum(traded).alias("volume"),
    )


def clean(spark: SparkSession, sf: str, ticker: str = "p_brand") -> DataFrame:
    return indicators.clean_bars(indicators.ldcp_change(bars(spark, sf, ticker)))


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """Intraday series from the event stream: five keys, any number of rows per key, a TIMESTAMP order."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("ticker"), F.col("ts"), "event_id",
        F.col("value").alias("close"), F.col("value").alias("high"), F.col("value").alias("low"),
    )


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of an hour from the event stream, at instants; prices are above zero."""
    e = table(spark, sf, "events")
    price, order = F.col("value") + F.lit(1.0), F.struct("ts", "event_id")
    return e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("at")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Small labelled feature table: close, volume, range, target."""
    rows = features.noise_filter(clean(spark, sf)).withColumn("target", features.label())
    return rows.select("ticker", "date", "close", "volume", (F.col("high") - F.col("low")).alias("span"), "target")


SMALL_FEATURES = ["close", "volume", "span"]


# -- news ---------------------------------------------------------------------------

RAW_LABELS = ("macro", "Equities|macro", " forex ", "banking", "energy|forex", "weather", "company_analysis")


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles are the documents. Every tenth day has news, several labels occur, two articles share a URL."""
    d = table(spark, sf, "documents")
    labels = F.array(*[F.lit(x) for x in RAW_LABELS])
    return d.select(
        F.col("doc_id").cast("string").alias("id"), "doc_id",
        F.date_add(F.lit("1996-01-01").cast("date"), ((F.col("doc_id") % 250) * 10).cast("int")).alias("date"),
        "source",
        F.element_at(labels, (F.col("doc_id") % len(RAW_LABELS) + 1).cast("int")).alias("category"),
        F.col("text").alias("title"), F.col("lang").alias("description"),
        F.concat(
            F.lit(" https://News.example.org/item/"), F.floor(F.col("doc_id") / 2).cast("string"),
            F.when(F.col("doc_id") % 2 == 0, "/").otherwise(""),
        ).alias("url"),
    )


HEADLINES = HeadlineRules(
    foreign=("nicht", "pour", "thnt.?eriner"),
    excluded=("thanedble", "sich"),
    anchor=("the", "der", "le", "la", "para", "of"),
    categories={
        "equities": ("thnt", "anea", "ertion"),
        "macro": ("eriner", "attion", "que"),
        "forex": ("elle", "tion", "thor"),
        "banking": ("keit", "ment", "thst"),
    },
    rejected_feeds=("weather",),
)

RELEVANCE = RelevanceRules(
    keep=("thanedble.*eriner", "^anea"),
    off_topic=(r"\d+-\d+", "eriner.*attion", "pour.*dans"),
    price_ticker=("attion.{0,40}then", "nicht (sich|keit)"),
    price_ticker_keep=("attion.*thst",),
    institutions=("thst", "onon", "s. a"),
    country=("erat", "keit"),
    foreign=("that", "^la", "sch.*der"),
)

POSITIVE = ("that", "the", "le", "der")
NEGATIVE = ("this", "from", "la", "thanedble")
PRIORITY = {"src1": 0, "src2": 1, "src3": 2}
TICKER_CATEGORIES = {
    "banking": ("Brand#1", "Brand#2", "Brand#3", "Brand#4"),
    "energy": ("Brand#5", "Brand#6", "Brand#7", "Brand#8"),
    "macro": ("Brand#9", "Brand#10", "Brand#11", "Brand#12"),
    "forex": ("Brand#13", "Brand#14", "Brand#15"),
    "corporate": ("Brand#16", "Brand#17", "Brand#18", "Brand#19", "Brand#20"),
}
MENTIONS = {"thnt": "Brand#1", "anea": "Brand#5", "eriner": "Brand#9", "attion": "Brand#13", "elle": "Brand#17", "tion": "Brand#1"}
CATEGORY_TABLE = {
    "macro": "macro", "rates": "macro", "equities": "corporate", "company_analysis": "corporate",
    "energy": "energy", "forex": "forex", "banking": "banking",
}

ANNOUNCEMENTS = AnnouncementRules(
    junk=("VIEW PDF", "VIEW", "PDF", "", "ACK."),
    time=r"^\d{1,2}:\d{2}\s*(AM|PM)$",
    company_suffixes=("Limited", "Bank", "the", "la", "en"),
    keywords=("that", "dans", "of"),
)


def rule_table(spark: SparkSession, sf: str) -> DataFrame:
    """A large rule table: every pair of neighbouring words of the conversations, and every word of 5 letters or more of them.

    Gate, label and priority follow from the md5 of the phrase.
    """
    from marketfeat.operators import rule_index

    said = table(spark, sf, "conversations").select(rule_index.words(F.col("text")).alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice(F.col("w"), i, 2), " "))
    both = F.concat(F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>")), F.filter("w", lambda x: F.length(x) > 4))
    phrases = said.select(F.explode(both).alias("phrase")).distinct().withColumn("m", F.md5("phrase"))
    gate = F.lit("category")
    for below, name in reversed(RULE_GATES):
        gate = F.when(F.col("m") < below, name).otherwise(gate)
    label = F.lit("corporate")
    for below, name in reversed(RULE_LABELS):
        label = F.when(F.substring("m", 3, 1) < below, name).otherwise(label)
    return phrases.select(gate.alias("gate"), label.alias("label"), F.ascii(F.substring("m", 4, 1)).alias("priority"), "phrase")


RULE_GATES = (("008", "foreign"), ("010", "excluded"), ("012", "keep"), ("016", "off_topic"), ("020", "price_ticker"), ("024", "price_ticker_keep"),
              ("026", "institution"), ("028", "country"), ("034", "foreign_signal"), ("060", "anchor"))
RULE_LABELS = (("3", "macro"), ("6", "energy"), ("9", "banking"), ("c", "forex"))


def scored_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles with a standard category and a lexicon score."""
    from marketfeat.operators import gates

    mapped = gates.map_category(articles(spark, sf), CATEGORY_TABLE)
    return sentiment.score_text(mapped, "title", positive=POSITIVE, negative=NEGATIVE)


def announcements(spark: SparkSession, sf: str) -> DataFrame:
    """Announcements are the turns of conversations; the symbol is the role."""
    c = table(spark, sf, "conversations")
    day = F.date_add(F.lit("2019-11-01").cast("date"), (F.col("conv_id") % 900).cast("int"))
    return c.select(
        F.date_format(day, "MMM dd, yyyy").alias("date"), F.col("role").alias("symbol"), F.col("text").alias("title"),
        F.concat(F.lit("T"), (F.col("turn") % 3).cast("string")).alias("type"), "conv_id", "turn",
    )


# -- predictions --------------------------------------------------------------------

def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of document quality from document length, with ties."""
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return joined.select(
        F.col("lang").alias("ticker"), F.when(F.col("doc_id") % 3 == 0, "val").otherwise("test").alias("split"),
        F.col("quality").alias("actual"), ((F.col("n_chars") % 500) / 500.0).alias("prob_up"),
        ((F.col("n_chars") % 37) / 10.0 - 1.8).alias("logit"),
    )


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Training histories: one run per event type, one epoch per event."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_type").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("val_loss"),
        ((F.col("event_id") * 37 % 1009) / 1009.0).alias("val_auc"),
    )
