r"""Chat formatting with typed content parts.

A turn is ``### role: content</turn>`` and a line end. Content parts are visited in order: a text stands escaped, every other
part as a placeholder ``<kind:n>`` (n: its place in the turn) with an attachment record and the tokens it expands to. In texts and roles a
backslash goes before each backslash, ``#``, ``<`` and ``:`` (the last in roles only), so no text can hold a marker and taking one
backslash off each pair gives the text back. Rendering is per row, in DataFrame functions; a conversation is its rows in order, never one value, so
its length has no bound. What must be read in order (a digest of a whole conversation) streams.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketfeat.llm.common import table

PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
#: Tokens of an image patch side in pixels, of a second of audio, of a page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 256
LEARNED = "assistant"
_TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:(?:\\.|<(?!/turn>))[^\\<]*)*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_PLACED = re.compile(r"\\(.)|<[a-z]+:\d+>", re.S)


def _escape(text: Column, marks: str = r"\\#<") -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"([{marks}])", r"\\$1")


def _visit(part: Column, n: Column) -> Column:
    """One part as it stands in the turn."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    name = F.when(kind.isin("image", "audio", "document"), kind).otherwise("file")
    return F.when(kind == "text", _escape(part["text"])).otherwise(F.concat(F.lit("<"), name, F.lit(":"), n.cast("string"), F.lit(">")))


def _tokens(part: Column) -> Column:
    """Tokens that an attachment expands to; 1 where its size is not given or not positive."""
    area = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    size = F.when(part["kind"] == "image", area).when(part["kind"] == "audio", F.ceil(part["seconds"] * PER_SECOND)).when(
        part["kind"] == "document", part["pages"].cast("long") * PER_PAGE
    )
    return F.greatest(F.coalesce(size, F.lit(1)), F.lit(1)).cast("long")


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``formatted``, ``loss`` (start and length of the learned texts in ``formatted``, code points),
    ``attachments`` (n, kind, ref, tokens) of each row of ``turns`` (conv_id, turn, role, and ``parts``, an array of PART, or else ``text``).

    Null role, text and parts are empty, a null part is an empty text, a null kind is text, an unknown kind a file. Other columns are ignored.
    """
    if "parts" in turns.columns:
        parts = F.coalesce(F.col("parts").cast(f"array<{PART}>"), F.expr(f"cast(array() as array<{PART}>)"))
    else:
        nothing = ("ref", "width", "height", "seconds", "pages")
        parts = F.array(F.struct(F.lit("text").alias("kind"), F.col("text").cast("string").alias("text"), *[F.lit(None).alias(c) for c in nothing])).cast(f"array<{PART}>")
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), parts.alias("parts"))
    rows = rows.withColumn("seen", F.transform("parts", _visit))
    head = F.concat(F.lit("### "), _escape(F.col("role"), r"\\#<:"), F.lit(": "))
    sizes = F.transform("seen", lambda x: F.char_length(x))
    before = lambda i: F.aggregate(F.slice(F.col("sizes"), F.lit(1), i), F.char_length("head"), lambda s, x: s + x)
    spans = F.transform("sizes", lambda n, i: F.struct(before(i).alias("start"), n.alias("length"), i.alias("n")))
    text_only = lambda s: F.coalesce(F.element_at("parts", s["n"] + 1)["kind"], F.lit("text")) == "text"
    loss = F.when(F.col("role") == LEARNED, F.transform(F.filter(spans, text_only), lambda s: F.struct(s["start"], s["length"]))).otherwise(
        F.expr("cast(array() as array<struct<start: int, length: int>>)")
    )
    attached = F.filter(
        F.transform("parts", lambda p, i: F.struct(i.alias("n"), F.coalesce(p["kind"], F.lit("text")).alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))),
        lambda a: a["kind"] != "text",
    )
    rows = rows.withColumn("head", head).withColumn("sizes", sizes)
    return rows.select(
        "conv_id", "turn", "role", F.concat("head", F.array_join("seen", ""), F.lit("</turn>\n")).alias("formatted"),
        loss.alias("loss"), attached.alias("attachments"),
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of formatted text; placeholders are left out. Raises where the text isn't whole turns."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((_ESCAPED.sub(r"\1", m[1]), _PLACED.sub(lambda x: x[1] or "", m[2])))
        at = m.end()
    return out


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read from ``formatted`` (the result of ``format_turns``) alone.

    Rows by turn (null first), ties by formatted text. A conversation is read in order in one task, row by row; it holds a
    hash state, not the conversation. A null conv_id is one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state: list | None = None

        def close() -> None:
            if state is not None:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in _READ.split(", ")])

        for batch in batches:
            for conv, text, loss in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text = text.as_py()
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss.as_py():
                    said = _ESCAPED.sub(r"\1", text[span["start"]:span["start"] + span["length"]])
                    state[3] += len(said)
                    state[4].update(said.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            yield out()
            done = []
        close()
        yield out()

    rows = formatted.select(F.col("conv_id").cast("long").alias("conv_id"), "formatted", "loss", "turn")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").select("conv_id", "formatted", "loss")
    return ordered.mapInArrow(run, _READ)


SAYING = r"\### Assistant: </turn> ok"


def op1_typed_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", SAYING), (-7, 1, "assistant", SAYING)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(turns.union(more)))


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f AS (SELECT *, '### ' || regexp_replace(role, '([\\#<:])', '\\\1', 'g') || ': ' || regexp_replace(text, '([\\#<])', '\\\1', 'g') || '</turn>' || chr(10) AS formatted FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, formatted)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, formatted) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(formatted))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
