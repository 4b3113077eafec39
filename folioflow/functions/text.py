"""Text expressions: tag stripping, entity decoding, normal forms and bounded windows.

All offsets are code points counted from 0.  ``unescape`` knows every named and numeric entity of HTML and
stays inside code generation: a text is cut at its ampersands and each piece is looked up in one map.
"""

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = r"<[^>]+>"
#: White space that is not one plain blank already.  The printable range is asked first, as nearly all characters are in it.
SPACE = r"(?U)[[^!-~]&&\s](?:[[^!-~]&&\s]+|(?<! ))"
#: Entities of nearly all pages, tried before the long map; ``html5`` of the standard library has the rest.
COMMON = {k: html5[k] for k in ("nbsp;", "amp;", "lt;", "gt;", "quot;", "rsquo;", "lsquo;", "rdquo;", "ldquo;", "ndash;", "mdash;", "copy;", "middot;")}
#: Names that HTML reads without a semicolon too, the longest first.
BARE = "^(?:" + "|".join(sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))) + ")"
#: Both kinds of names as one JSON text each, which the planner folds into one map.
NAMED, UNENDED = (json.dumps({k: v for k, v in html5.items() if k.endswith(";") is ends}) for ends in (True, False))
#: What browsers make of the numbers 128 to 159: the characters of the Windows code page, where it has one.
CONTROLS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)} | {0: "\ufffd", 13: "\r"}


def _char(code: Column) -> Column:
    """The character of a code point (long): outside of Unicode the replacement character, none for non-characters."""
    gone = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    listed = F.try_element_at(F.from_json(F.lit(json.dumps(CONTROLS)), "map<string,string>"), code.cast("string"))
    return F.when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd").otherwise(F.coalesce(listed, F.when(gone, "").otherwise(plain)))


def _entity(piece: Column) -> Column:
    """A piece that stood behind an ampersand, with the entity it begins with decoded."""
    number = F.regexp_extract(piece, r"^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", 0)
    digits = F.regexp_extract(number, "[0-9a-fA-F]+", 0)
    hexed = F.lower(F.substring(number, 2, 1)) == "x"
    value = F.when(F.length(F.ltrim(F.lit("0"), digits)) > 8, F.lit(1 << 40)).when(hexed, F.conv(digits, 16, 10).cast("long")).otherwise(digits.cast("long"))
    name = F.regexp_extract(piece, "^[0-9A-Za-z]{1,32};", 0)
    bare = F.regexp_extract(piece, BARE, 0)
    table = lambda entries: F.from_json(F.lit(entries), "map<string,string>")
    named = F.coalesce(F.try_element_at(table(json.dumps(COMMON)), name), F.when(name != "", F.try_element_at(table(NAMED), name)))
    rest = lambda head: F.substring(piece, F.length(head) + 1, F.length(piece))
    return (
        F.when(number != "", F.concat(_char(value), rest(number)))
        .when(named.isNotNull(), F.concat(named, rest(name)))
        .when(bare != "", F.concat(F.try_element_at(table(UNENDED), bare), rest(bare)))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it: a lambda's argument is never copied into the plan."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unescape(col: Column) -> Column:
    rest = lambda p: F.array_join(F.transform(F.slice(p, 2, F.size(p)), _entity), "")
    return bound(F.split(col, "&"), lambda p: F.when(F.size(p) > 1, F.concat(F.get(p, F.lit(0)), rest(p))).otherwise(F.get(p, F.lit(0))))


def collapse(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, SPACE, " "))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, TAG, " ")


def strip_html(html: Column) -> Column:
    return collapse(F.replace(unescape(strip_tags(html)), F.lit("\u00a0"), F.lit(" ")))


def normalize_text(html: Column) -> Column:
    return F.lower(strip_html(html))


def strip_plain(html: Column) -> Column:
    """The debugging variant: no entities."""
    return collapse(strip_tags(html))


def nearby_text(html: Column, offset: Column) -> Column:
    return F.left(normalize_text(F.substring(html, offset + 1, F.lit(300))), F.lit(200))


def read_text_at(html: Column, position: Column, length: Column) -> Column:
    """A stripped window; the length is cut at 2000 and what is shown at 500."""
    start = F.greatest(F.lit(0), F.least(position, F.length(html) - 1))
    return F.left(strip_html(F.substring(html, start + 1, F.least(length, F.lit(2000)))), F.lit(500))


def back_context(html: Column, offset: Column) -> Column:
    start = F.greatest(F.lit(0), offset - 500)
    return F.right(normalize_text(F.substring(html, start + 1, offset - start)), F.lit(200))


def item_of_key(key: Column) -> Column:
    """The part of ``accession#item`` after the first mark; the whole key without one."""
    at = F.instr(key, "#")
    return F.when(at > 0, F.substring(key, at + 1, F.length(key))).otherwise(key)


def relative_position(offset: Column, length: Column) -> Column:
    return F.when(length > 0, offset / length).otherwise(F.lit(0.0))


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x.cast("double") * 100)


def tool_calls(answer: Column) -> Column:
    """Tool calls in a model's answer: fenced or bare JSON, trailing commas repaired, one object or a list."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.trim(F.when(fenced != "", fenced).otherwise(answer))
    fixed = F.regexp_replace(body, r",\s*([}\]])", "$1")
    shape = "array<struct<tool:string,args:map<string,string>>>"
    listed = F.when(F.left(fixed, F.lit(1)) == "[", fixed).when(F.left(fixed, F.lit(1)) == "{", F.concat(F.lit("["), fixed, F.lit("]")))
    return F.filter(F.from_json(listed, shape), lambda c: c.tool.isNotNull())


def answer_label(answer: Column, labels: list[str]) -> Column:
    """The longest known label that the answer contains."""
    best = sorted(labels, key=lambda x: (-len(x), x))
    return F.coalesce(*(F.when(F.contains(F.lower(answer), F.lit(x.lower())), F.lit(x)) for x in best))
