"""Gates, labels, deduplication."""

import re

import pytest
from pyspark.sql import functions as F

from marketfeat.functions import fixed_values, text
from marketfeat.functions.rules import HeadlineRules, RelevanceRules, RuleTable, has_literal, has_word
from marketfeat.operators import dedup, gates
from marketfeat.plans import pipeline

RULES = HeadlineRules(
    foreign=("wall street", "dollar index"), excluded=("make.?up", "recipe"), anchor=("karachi", "rupee"),
    categories={"forex": ("rupee", "hawala"), "equities": ("shares", "ipo")}, rejected_feeds=("global_business",),
)
TITLES = [
    "Rupee gains ground", "Rupee gains groun", "rupee", "Karachi shares and the rupee rise", "Wall Street drags Karachi shares",
    "Karachi makeup and rupee", "Karachi MAKE-UP shares", "Shares rise in London", "Karachi is very hot today", "",
    None, "Karachi éshares fall again", "Karachi: SHARES fall", "karachi ipo", "Karachi an ipo",
]


def python_gate(title):
    def hit(phrases):
        return re.search(r"\b(" + "|".join(phrases) + r")\b", title, re.I)

    if not title or len(title) < 15:
        return False
    return not hit(RULES.foreign) and not hit(RULES.excluded) and bool(hit(RULES.anchor)) and any(
        hit(p) for p in RULES.categories.values())


def test_headline_gate(spark):
    df = spark.createDataFrame([(t,) for t in TITLES], "title string")
    got = sorted(r[0] for r in gates.headline_gate(df, RULES).collect())
    assert got == sorted(t for t in TITLES if python_gate(t))
    again = gates.headline_gate(gates.headline_gate(df, RULES), RULES)
    assert sorted(r[0] for r in again.collect()) == got


def test_title_length_border(spark):
    df = spark.createDataFrame([("Karachi, rupee",), ("Karachi: rupee!",)], "title string")
    assert [r[0] for r in gates.headline_gate(df, RULES).collect()] == ["Karachi: rupee!"]


def test_gate_over_description(spark):
    rows = [("A title long enough", "about the rupee", "forex"), ("A title long enough", "about the rupee", "global_business"),
            ("A title long enough", "wall street and rupee", "forex"), ("A title long enough", None, "forex")]
    df = spark.createDataFrame(rows, "title string, description string, feed string")
    kept = gates.headline_gate(df, RULES, ("title", "description"), anchor=False, feed_col="feed").collect()
    assert [tuple(r) for r in kept] == [rows[0]]


def test_labels(spark):
    df = spark.createDataFrame([("shares and rupee",), ("nothing here",)], "title string")
    got = df.select(gates.multi_label(F.col("title"), RULES), text.primary_label(gates.multi_label(F.col("title"), RULES))).collect()
    assert [tuple(r) for r in got] == [("forex|equities", "forex"), ("general_market", "general_market")]


CASCADE = RelevanceRules(
    keep=("peace deal.*trade",), off_topic=(r"\d+-\d+", "hockey"), price_ticker=("gold price[s]? (up|down)",),
    price_ticker_keep=("gold prices up.*record",), institutions=("ppl", "sbp"), country=("pakistan",), foreign=("^asia", "nasdaq"),
)


@pytest.mark.parametrize("title,want", [
    ("Peace deal helps hockey trade", True), ("Team wins 3-1", False), ("Gold prices up", False),
    ("Gold prices up to record", True), ("Supply of NASDAQ firms", True), ("Nasdaq pays Rs5", True),
    ("Nasdaq and Pakistan", True), ("Nasdaq falls", False), ("In Asia", True), ("Asia falls", False), (None, True),
])
def test_cascade_first_rule_decides(spark, title, want):
    df = spark.createDataFrame([(title,)], "title string")
    assert df.select(gates.relevant(F.col("title"), CASCADE)).first()[0] is want


def test_literals_match_inside_words(spark):
    df = spark.createDataFrame([("supply (a.b)",)], "t string")
    row = df.select(has_literal(F.col("t"), ["ppl"]), has_literal(F.col("t"), ["a.b"]), has_literal(F.col("t"), ["axb"]),
                    has_word(F.col("t"), ["ppl"]), has_word(F.col("t"), [])).first()
    assert tuple(row) == (True, True, False, False, False)


def test_rule_table(spark):
    rows = [("foreign", None, 1, "nasdaq"), ("category", "forex", 1, "rupee"), ("category", "equities", 2, "shares"),
            ("anchor", None, 1, "karachi"), ("keep", None, 1, "deal")]
    table = RuleTable.from_dataframe(spark.createDataFrame(rows, "gate string, label string, priority int, pattern string"))
    rules = table.headline_rules(min_length=5)
    assert rules.foreign == ("nasdaq",) and list(rules.categories) == ["forex", "equities"] and rules.min_length == 5
    assert table.relevance_rules().keep == ("deal",)
    with pytest.raises(ValueError):
        RuleTable.from_dataframe(spark.createDataFrame(rows, "gate string, label string, priority int, pattern string"), max_rows=2)


@pytest.mark.parametrize("title,bare", [
    ("Lucky Cement Limited", True), ("Habib Bank", True), ("Habib Bank announces", False), ("Annual report of Habib Bank", False),
    ("One two three four five six seven Mills", False), ("Indus Textile Mills  Limited ", True), ("Result: Cement", False),
])
def test_bare_company(spark, title, bare):
    df = spark.createDataFrame([(title,)], "title string")
    assert df.select(gates.is_bare_company(F.col("title"), fixed_values.ANNOUNCEMENT_RULES)).first()[0] is bare


def test_announcement_clean(spark):
    titles = ["View PDF", " 9:30 am ", "Habib Bank", "Seven c", "Board meeting", "  "]
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    assert [r[0] for r in gates.announcement_clean(df, fixed_values.ANNOUNCEMENT_RULES).collect()] == ["Board meeting"]


def test_map_category(spark):
    rows = [("1", "Rates|macro", None), ("2", " Forex ", None), ("3", "sports", None), ("4", "sports", "Banking"), ("5", None, None)]
    df = spark.createDataFrame(rows, "id string, category string, subcategory string")
    want = {"1": "macro", "2": "forex", "4": "banking"}
    got = gates.map_category(df, fixed_values.CATEGORY_MAP, ("subcategory", "category"))
    assert {r["id"]: r["category"] for r in got.collect()} == want
    dim = spark.createDataFrame(list(fixed_values.CATEGORY_MAP.items()), "label string, standard string")
    joined = gates.map_category(df, dim, ("subcategory", "category"))
    assert {r["id"]: r["category"] for r in joined.collect()} == want


@pytest.mark.parametrize("raw,want", [
    ("  Index:  Up 5%!! ", "index up 5"), ("!!!", ""), ("Éa b", "a b"), ("a \tb", "a b"), ("", ""),
])
def test_normalize_title(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(text.normalize_title(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("raw,want", [(" ogdc.ka ", "OGDC"), ("pso.PK", "PSO"), ("a.KA.KA", "A.KA"), ("x.kab", "X.KAB")])
def test_symbol_clean(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(text.symbol_clean(F.col("t"))).first()[0] == want


def test_cross_source_takes_earliest_date_then_best_source(spark):
    rows = [("2024-01-02", "brecorder", "Rupee up!"), ("2024-01-01", "mettis", "rupee UP"), ("2024-01-01", "dawn", "Rupee  up"),
            ("2024-01-03", "other", "!!"), ("2024-01-02", "dawn", "???"), ("2024-01-05", "other", None)]
    df = spark.createDataFrame(rows, "date string, source string, title string")
    got = {tuple(r) for r in dedup.dedup_cross_source(df, fixed_values.SOURCE_PRIORITY).collect()}
    assert got == {("2024-01-01", "dawn", "Rupee  up"), ("2024-01-02", "dawn", "???")}


def test_dedup_order_of_passes(spark):
    rows = [(1, "2024-01-01", "Rupee gains ground", " http://a/B/ "), (2, "2024-01-01", "Rupee gains ground", "http://a/c"),
            (3, "2024-01-02", "Other title, rupee", "http://A/b"), (4, "2024-01-02", "Rupee gains ground", "http://a/d//")]
    df = spark.createDataFrame(rows, "id int, date string, title string, url string")
    assert sorted(r["id"] for r in dedup.dedup_url_title(df, ["id"]).collect()) == [1, 4]
    assert sorted(r["id"] for r in pipeline.process_title_feed(df, RULES, ["id"]).collect()) == [1, 3, 4]
    by_id = df.withColumn("id", F.col("id") % 2).withColumn("ord", F.monotonically_increasing_id())
    assert dedup.dedup_id_title(by_id, ["title", "url"]).count() == 2


def test_dedup_of_a_hot_key_is_combined_before_the_shuffle(spark):
    df = spark.range(100_000).select((F.col("id") % 3).alias("k"), "id", F.repeat(F.lit("x"), 50).alias("body"))
    out = dedup.dedup_first(df, ["k"], ["id"])
    assert {r["id"] for r in out.collect()} == {0, 1, 2}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "partial_min_by" in plan
