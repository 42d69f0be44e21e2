"""Pages as tokens, inside the JVM: one linear split of a page, from which links and tables are read.

A page is split into comments, elements whose content is no markup (scripts, styles, titles, text areas), tags and texts. Quoted attribute values may hold
``<`` and ``>``. No part of the pattern is tried twice over the same characters, so pages of any length and any broken markup take linear time.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inside of a tag: a quote counts only after an equals sign, and one that is never closed is a character like others.
_INSIDE = r"""(?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)"
    rf"|<(script|style|title|textarea)(?=[\s/>]){_INSIDE}(?:>|\z).*?(?:</\1(?=[\s/>])[^>]*+(?:>|\z)|\z)"
    rf"|</?[a-z]{_INSIDE}(?:>|\z)"
    r"|<[!?][^>]*+(?:>|\z)"
    r"|[^<]++|<"
)
_RAW = r"(?i)^<(?:script|style|title|textarea)(?=[\s/>])"
_ENTITY = r"&(?:#[xX][0-9a-fA-F]++|#[0-9]++|[A-Za-z][A-Za-z0-9]*+);|[^&]++|&"
_NAMED = json.dumps({name: char for name, char in html5.items() if name.endswith(";")} | {"nbsp;": " "})
# What numbers from 128 to 159 stand for in pages, as windows-1252 has them.
_C1 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def tokens(html: Column) -> Column:
    """The tokens of a page in order; joined they are the page again."""
    return F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0))


def has_attribute(tag: Column, name: str) -> Column:
    return tag.rlike(_attribute(name))


def attribute(tag: Column, name: str) -> Column:
    """Value of the first attribute of that name, in double quotes, single quotes or bare; empty without one. Entities stay."""
    return F.concat(*[F.regexp_extract(tag, _attribute(name), i) for i in (1, 2, 3)])


def _attribute(name: str) -> str:
    bare = r"""[^\s>"']*+"""
    other = rf"""[\s/]++(?!{name}\s*+=)[^\s=>/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|{bare}))?+"""
    return rf"""(?is)^<[a-z][^\s/>]*+(?:{other})*+[\s/]++{name}\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|({bare}))"""


def normal_form(html: Column, keep: Mapping[str, str]) -> Column:
    """A page in which every ``<`` and ``>`` belongs to a tag, tag names are lower case, and tags have no attribute but the one that ``keep`` names for them.

    Comments, declarations and elements without markup are gone, as is a tag that the page's end cuts off. Attribute values stand in double quotes. What a browser
    shows is the same, so a simple pattern finds links and tables in it.
    """

    def one(token: Column) -> Column:
        name = F.lower(F.regexp_extract(token, r"^<(/?[a-zA-Z][^\s/>]*+)", 1))
        plain = F.concat(F.lit("<"), name, F.lit(">"))
        tag = plain
        for element, wanted in keep.items():
            value = F.replace(_escaped(attribute(token, wanted)), F.lit('"'), F.lit("&quot;"))
            held = F.concat(F.lit(f'<{element} {wanted}="'), value, F.lit('">'))
            tag = F.when((name == element) & has_attribute(token, wanted), held).otherwise(tag)
        return (
            F.when(~token.startswith("<"), _escaped(token))
            .when(token == "<", F.lit("&lt;"))
            .when(token.startswith("<!") | token.startswith("<?") | token.rlike(_RAW) | ~token.endswith(">"), F.lit(""))
            .otherwise(tag)
        )

    return F.array_join(F.transform(tokens(html), one), "")


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def decode_entities(text: Column) -> Column:
    """Named and numeric character references as characters, each once. A non-breaking space becomes a blank; unknown names stay as they are.

    A number without a character (zero, a surrogate, over 10FFFF) gives U+FFFD. References without a semicolon stay.
    """
    table = F.from_json(F.lit(_NAMED), "map<string,string>")

    def numbered(part: Column) -> Column:
        hexadecimal = F.lower(F.substring(part, 3, 1)) == "x"
        digits = F.regexp_extract(part, r"^&#[xX]?0*+([0-9a-fA-F]*+);", 1)
        number = F.when(F.length(digits) > 8, F.lit(-1)).otherwise(
            F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).try_cast("long"))
        broken = number.isNull() | (number <= 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return (
            F.when(broken, F.lit("�")).when(number == 160, F.lit(" "))
            .when(number.between(128, 159), F.substring(F.lit(_C1), (number - 127).cast("int"), F.lit(1))).otherwise(char)
        )

    def one(part: Column) -> Column:
        named = F.coalesce(F.try_element_at(table, F.substr(part, F.lit(2))), part)
        return (
            F.when(~part.startswith("&") | (F.length(part) < 3), part)
            .when(part == "&amp;", F.lit("&")).when(part == "&lt;", F.lit("<")).when(part == "&gt;", F.lit(">"))
            .when(part.startswith("&#"), numbered(part)).otherwise(named)
        )

    parts = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(text)
