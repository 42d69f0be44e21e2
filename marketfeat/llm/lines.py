"""Line deduplication by a log-template tree.

A line's place in the tree is its number of tokens and its first LEAD tokens, where a token with a digit is a field. Inside a
leaf, a token stays in the template if MIN_LINES lines have it at that position; every other position is a field
``<*>``. A template whose constant share is at least CONSTANT, found in MIN_DOCUMENTS different documents, recurs: its first line (smallest
doc_id, then position) stays and the others go. Documents are different if their whole texts are, so exact copies of one document don't make
its lines recur; those are left to document deduplication. Neighbouring and blank lines don't matter. DataFrame functions only.

Cost: leaves are counted first, so only lines of leaves with MIN_LINES lines are taken apart. Counts are summed before each exchange; no
window or list holds the lines of a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketfeat.llm.common import boxed, field, table
from marketfeat.session import checkpointed

LEAD, MIN_LINES, MIN_DOCUMENTS, CONSTANT = 3, 5, 5, 0.6


def _text() -> Column:
    return F.col("text").cast("string")


def _document() -> list[Column]:
    """A document's key: rows that repeat both id and text are one."""
    return [F.col("doc_id"), F.xxhash64(_text()).alias("_h")]


def parsed(docs: DataFrame, lead: int = LEAD) -> DataFrame:
    """``doc_id``, ``_h``, ``pos``, ``masked``, ``leaf`` of each line that isn't blank."""
    rows = docs.filter(F.col("doc_id").isNotNull()).select(*_document(), F.posexplode(F.split(_text(), "\n")).alias("pos", "line"))
    masked = F.trim(F.regexp_replace(F.regexp_replace("line", r"\s+", " "), r"\S*\d\S*", "<*>"))
    rows = rows.select("doc_id", "_h", "pos", masked.alias("masked")).filter("masked != ''")
    tokens = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    return rows.withColumn("tokens", tokens).withColumn(
        "leaf", F.xxhash64("tokens", F.substring_index("masked", " ", lead))
    )


def templates(docs: DataFrame, lead: int = LEAD, min_lines: int = MIN_LINES) -> DataFrame:
    """``doc_id``, ``_h``, ``pos``, ``leaf``, ``template``, ``share`` of each line in a leaf of ``min_lines`` lines.

    The template is a hash of its constant tokens and their positions.
    """
    lines = checkpointed(parsed(docs, lead))
    leaves = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_lines).select("leaf")
    shared = checkpointed(lines.join(leaves, "leaf"))
    words = shared.select("doc_id", "_h", "pos", "leaf", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    words = words.filter("token != '<*>'")
    kept = words.groupBy("leaf", "at", "token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_lines)
    found = words.join(kept.drop("n"), ["leaf", "at", "token"]).groupBy("doc_id", "_h", "pos").agg(
        F.bit_xor(F.xxhash64("at", "token")).alias("template"), F.count_distinct("at").alias("constants")
    )
    return shared.join(found, ["doc_id", "_h", "pos"]).select(
        "doc_id", "_h", "pos", "leaf", "template", (F.col("constants") / F.col("tokens")).alias("share")
    )


def recurring(
    docs: DataFrame, lead: int = LEAD, min_lines: int = MIN_LINES, min_documents: int = MIN_DOCUMENTS, constant: float = CONSTANT
) -> DataFrame:
    """``doc_id``, ``_h``, ``drop`` (positions): the lines that go. A document's list is no longer than the document."""
    lines = checkpointed(templates(docs, lead, min_lines).filter(F.col("share") >= constant))
    key = ["leaf", "template"]
    often = lines.groupBy(*key, "_h").agg(F.min(F.struct("doc_id", "_h", "pos")).alias("first")).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min("first").alias("first")
    ).filter(F.col("n") >= min_documents)
    again = lines.join(often, key).filter(F.struct("doc_id", "_h", "pos") != F.col("first"))
    return again.groupBy("doc_id", "_h").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text`` (and ``n_chars`` counted anew, if there), and ``n_dropped``.

    Null and empty texts and rows without an id stay as they are, and so does a blank line. A text whose lines all go is empty.
    Repeated rows (same id and text) lose the same lines. Other columns stay, whatever their names; a column ``n_dropped`` of the input is
    replaced. An empty table gives no rows.
    """
    gone = recurring(docs, **options).select(F.col("doc_id").alias("of"), F.col("_h").alias("hash"), "drop")
    here = boxed(docs, id=field("doc_id"), key=F.xxhash64(field("text").cast("string")))
    joined = here.join(gone, (here["id"] == gone["of"]) & (here["key"] == gone["hash"]), "left")
    # One pass over the lines: their positions without the dropped ones, then the lines there.
    lines = F.array(F.split(field("text").cast("string"), "\n"))
    kept = F.transform(lines, lambda all_: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("drop")), lambda i: F.get(all_, i)
    ), "\n"))[0]
    out = joined.select(
        "row", "drop", F.when(F.col("drop").isNull(), field("text").cast("string")).otherwise(kept).alias("left"),
    )
    new = {"text": F.col("left").cast(docs.schema["text"].dataType), "n_dropped": F.coalesce(F.size("drop"), F.lit(0)).cast("long")}
    if "n_chars" in docs.columns:
        length = F.char_length("left").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("drop").isNull(), field("n_chars")).otherwise(length)
    names = [c for c in docs.columns if c != "n_dropped"] + ["n_dropped"]
    return out.select(*[new.get(c, field(c)).alias(c) for c in names])


def op10_log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "text", F.coalesce(F.size(F.split(_text(), "\n")), F.lit(0)).alias("n_lines_kept"), "n_dropped"
    )
