"""Headline gates and the relevance cascade by rule tables of any size.

In ``gates`` rules become part of the query, one alternation a gate; that is fastest for some hundred rules. Here they stay a table
``(gate, label, priority, phrase)``, and neither the query nor a task grows with it:

1. A title is known by its digest. Its runs of so many words as some phrase has are hashed, each different run once.
2. A filter of ``runs.BITS_A_RUN`` bits a phrase, and of ``runs.MOST_BITS`` at most, drops most runs that are no phrase. None that is one is lost.
3. Titles go by chunks. Runs and phrases are dealt out by ranges of the hash and by slices of the chunks: a chunk leaves one row a group, with each
   different hash once and the numbers of its titles, and their keys once in all, so that the rows don't grow with the number of groups. Each
   group is matched, and the parts of a chunk are put together again. The work grows with the words and the rules, not with their product.
4. A phrase of more than ``NEAR`` words is filed under the word of it that the fewest titles have, counted over the titles. A phrase with a
   word that no title has can't match. Titles, as one row a different word, meet these phrases by an equi-join on that word; the words
   of a phrase must stand in the title next to each other.
5. What was met is summed to one row a title.

A word is a run of letters, marks, digits and ``_``, in lower case. A phrase matches whole words, whatever stands between two of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketfeat.functions import runs
from marketfeat.session import checkpointed

GATES = (
    "foreign", "excluded", "anchor", "category", "keep", "off_topic", "price_ticker", "price_ticker_keep", "institution", "country", "foreign_signal",
)
#: Words of the phrases that are looked up as runs of words.
NEAR = 8
#: Runs of a group, and ranges of the hash; beyond these, chunks are dealt out by slices.
GROUP_RUNS, MOST_BUCKETS = 8_000_000, 1024


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)[^\w]+"), lambda w: w != "")


def title_key(title: Column) -> Column:
    """Digest of a title: 16 bytes, null for null."""
    return F.substring(F.unhex(F.sha2(title.cast("string"), 256)), 1, runs.KEY)


def phrases_of(rules: DataFrame) -> DataFrame:
    """``gate``, ``label``, ``priority``, ``phrase`` (its words with one blank between), one row each; empty phrases match nothing and go."""
    normal = F.array_join(words(F.col("phrase")), " ")
    return rules.select("gate", "label", F.col("priority").cast("long").alias("priority"), normal.alias("phrase")).filter("phrase != ''").distinct()


def filed(phrases: DataFrame, found: DataFrame) -> DataFrame:
    """``phrase``, ``word`` (its rarest), ``size``: the index. ``found`` is (tid, word) of the titles; ties go to the smaller word."""
    each = phrases.select("phrase", F.size(F.split("phrase", " ")).alias("size"), F.explode(F.array_distinct(F.split("phrase", " "))).alias("word"))
    counts = found.join(each.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("titles"))
    known = each.join(counts, "word", "left").groupBy("phrase", "size").agg(
        F.min(F.struct("titles", "word")).alias("rarest"), F.count_if(F.col("titles").isNull()).alias("unknown")
    )
    return known.filter("unknown = 0").select("phrase", F.col("rarest.word").alias("word"), "size")


def matches(titles: DataFrame, phrases: DataFrame) -> DataFrame:
    """``tid``, ``phrase``: every match of ``phrases`` (phrase) in ``titles`` (tid, words), once."""
    found = titles.select("tid", F.explode(F.array_distinct("words")).alias("word"))
    index = checkpointed(filed(phrases.select("phrase").distinct(), found))
    met = found.join(index, "word").select("tid", "phrase", "size")
    longer = met.filter("size > 1").groupBy("tid").agg(F.collect_list("phrase").alias("phrases"))  # no more than phrases filed under the title's words
    line = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    verified = longer.join(titles.select("tid", line.alias("line")), "tid").select(
        "tid", F.explode(F.filter("phrases", lambda p: F.contains(F.col("line"), F.concat(F.lit(" "), p, F.lit(" "))))).alias("phrase")
    )
    return met.filter("size = 1").select("tid", "phrase").union(verified)


def run_hits(titles: DataFrame, known: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """``key``, ``gate``, ``label``, ``priority``: what the phrases of ``known`` with so many words as ``sizes`` says give to ``titles`` (key, title)."""
    spark = titles.sparkSession
    near = known.filter(F.size(F.split("phrase", " ")).isin(*sizes))
    rules = checkpointed(near.mapInArrow(partial(runs.hash_lines, sizes=sizes), f"hash long, rest int, {_ddl(known)}").drop("phrase"))
    size = runs.filter_bits(rules.count())
    at = F.col("hash").bitwiseAND(F.lit(size - 1))
    page = 1 << 15  # bits of a bitmap
    pages = rules.groupBy(F.shiftright(at, 15).alias("page")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(page - 1))).alias("bits"))
    bits = bytearray(size // 8)
    for row in pages.collect():  # 32 MB at most, whatever the number of rules
        bits[row["page"] * page // 8:(row["page"] + 1) * page // 8] = row["bits"]
    chars = titles.agg(F.sum(F.length("title"))).first()[0] or 0
    groups = max(24, chars // 6 * len(sizes) // GROUP_RUNS + 1)
    buckets = min(groups, MOST_BUCKETS)
    slices = -(-groups // buckets)
    line = F.trim(F.regexp_replace(F.lower("title"), r"(?U)[^\w]+", " "))
    found = titles.select("key", line.alias("line")).mapInArrow(
        partial(runs.grouped_runs, sizes=sizes, known=bytes(bits), buckets=buckets, slices=slices),
        "group int, chunk binary, keys binary, parts int, number binary, count binary, hashes int, hash binary, rest binary")
    bucket = F.shiftrightunsigned(F.shiftrightunsigned("hash", 32) * F.lit(buckets), 32)
    dealt = rules.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn(
        "group", (F.col("slice") * buckets + bucket).cast("int")).drop("slice")
    parts = found.groupBy("group").cogroup(dealt.groupBy("group")).applyInArrow(
        runs.met, "chunk binary, keys binary, parts int, hits int, number binary, gates array<string>, labels array<string>, kind binary, priority binary, none binary")
    hits = parts.groupBy("chunk").applyInArrow(runs.of_chunk, "key binary, hits array<struct<gate: string, label: string, priority: bigint>>")
    return hits.repartition("key").select("key", F.inline("hits"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def title_hits(titles: DataFrame, rules: DataFrame) -> DataFrame:
    """``key``, ``gate``, ``label``, ``priority`` of what the phrases of ``rules`` give to ``titles`` (key, title)."""
    known = checkpointed(phrases_of(rules))
    sizes = sorted(r[0] for r in known.select(F.size(F.split("phrase", " "))).distinct().collect())
    hits = run_hits(titles, known, [n for n in sizes if n <= NEAR] or [1])
    if sizes and sizes[-1] > NEAR:
        long = known.filter(F.size(F.split("phrase", " ")) > NEAR)
        once = checkpointed(titles.distinct().select(F.col("key").alias("tid"), words(F.col("title")).alias("words")))
        hits = hits.union(matches(once, long).join(long, "phrase").select(F.col("tid").alias("key"), "gate", "label", "priority"))
    return hits


def key_gates(titles: DataFrame, rules: DataFrame) -> DataFrame:
    """``key``, a boolean for each of GATES, and ``labels``, as in ``title_gates``, of ``titles`` (key, title)."""
    once = title_hits(titles, rules).groupBy("key", "gate", "label").agg(F.min("priority").alias("priority"))
    flags = [F.bool_or(F.col("gate") == g).alias(g) for g in GATES]
    named = F.when((F.col("gate") == "category") & F.col("label").isNotNull(), F.struct("priority", "label"))
    decided = once.groupBy("key").agg(*flags, F.array_sort(F.collect_list(named)).alias("named"))
    labels = F.nullif(F.array_join(F.col("named.label"), "|"), F.lit(""))
    return decided.withColumn("labels", labels).drop("named")


def _titles(df: DataFrame, title: str) -> DataFrame:
    text = F.col(f"`{title}`").cast("string")
    return df.select(title_key(text).alias("key"), text.alias("title")).filter(F.col("title").isNotNull())


def title_gates(df: DataFrame, rules: DataFrame, title: str = "title") -> DataFrame:
    """``title``, a boolean for each of GATES, and ``labels`` (of the category gate, by priority and name, joined by ``|``): the titles that any rule matches."""
    titles = _titles(df, title)
    return key_gates(titles, rules).join(titles.distinct(), "key").select("title", *GATES, "labels")


def _decided(df: DataFrame, rules: DataFrame, title: str, **more: Column) -> tuple[DataFrame, list[Column]]:
    """Each row of ``df`` with the gates of its title, false where no rule matched, and ``more`` over the column ``text``; and the columns of ``df``.

    The columns of ``df`` have numbers for names, so that none clashes and those that nobody asks for are not read.
    """
    gates = key_gates(_titles(df, title), rules).withColumnRenamed("key", "of")
    named = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(df.columns)]
    rows = df.select(*named, F.col(f"`{title}`").cast("string").alias("text")).withColumns({"key": title_key(F.col("text")), **more}).drop("text")
    met = rows.join(gates, rows["key"] == gates["of"], "left")
    return met.withColumns({g: F.coalesce(g, F.lit(False)) for g in GATES}), [F.col(f"_{i}").alias(c) for i, c in enumerate(df.columns)]


def headline_gate_table(
    df: DataFrame, rules: DataFrame, title: str = "title", min_length: int = 15, anchor: bool = True, out: str = "labels"
) -> DataFrame:
    """Rows whose title passes every gate of a rule table, with the labels of its categories in ``out``.

    A title passes with ``min_length`` characters, no foreign and no excluded phrase, an anchor phrase (if ``anchor``), and a phrase of some
    category. Null titles don't. Equal titles get one decision; an empty rule table lets nothing through.
    """
    met, columns = _decided(df, rules, title, long_enough=F.length("text") >= min_length)
    keep = F.col("long_enough") & ~F.col("foreign") & ~F.col("excluded") & F.col("category")
    if anchor:
        keep = keep & F.col("anchor")
    kept = met.filter(keep)
    return kept.select(*[c for c, name in zip(columns, df.columns, strict=True) if name != out], F.col("labels").alias(out))


def relevance_table(df: DataFrame, rules: DataFrame, title: str = "title", amount: str = r"rs\d", out: str = "relevant") -> DataFrame:
    """``df`` with the decision of the relevance cascade by a rule table in ``out``.

    The order is that of ``gates.relevant``: keep, off topic, price ticker without its exception, institution, an ``amount`` (a pattern), country,
    foreign signal; what no rule decides is relevant, and so is a null title.
    """
    met, columns = _decided(df, rules, title, amount=F.coalesce(F.lower("text").rlike(amount), F.lit(False)))
    decision = (
        F.when(F.col("keep"), True).when(F.col("off_topic"), False)
        .when(F.col("price_ticker") & ~F.col("price_ticker_keep"), False)
        .when(F.col("institution"), True).when(F.col("amount"), True)
        .when(F.col("country"), True).when(F.col("foreign_signal"), False).otherwise(True)
    )
    return met.select(*[c for c, name in zip(columns, df.columns, strict=True) if name != out], decision.alias(out))
