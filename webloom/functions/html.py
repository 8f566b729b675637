"""HTML text as token arrays, with built-in functions only.

A page is cut into *items* (comments, whole raw-text elements, single start tags) and the *gaps*
between them.  ``gap0 item0 gap1 item1 ... gapN`` is the page again, byte for byte.
Quantifiers are possessive, so the Java matcher neither backtracks nor recurses on long pages.
"""

from __future__ import annotations

import html.entities
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.binding import let, let_sql, sql_text

_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
_ATTRIBUTES = rf"(?:[\s/](?:[\s/]++|[^\s/>=]++|=\s*+{_VALUE})*+)?+"
START_TAG = rf"<[A-Za-z][^\s/>]*+{_ATTRIBUTES}>"
COMMENT = r"<!--.*?(?:-->|\z)"

# Elements whose content is text, not markup.
RAW_TEXT_ELEMENTS = ("script", "style", "textarea", "title")


def element_pattern(name: str) -> str:
    """A whole element; one without an end tag runs to the end of the text."""
    return rf"<{name}{_ATTRIBUTES}>.*?(?:</{name}(?:[\s/][^>]*)?>|\z)"


ITEM = "(?is)" + "|".join(
    [COMMENT, *(element_pattern(name) for name in RAW_TEXT_ELEMENTS), START_TAG]
)


def items(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ITEM), F.lit(0))


def gaps(text: Column) -> Column:
    return F.split(text, ITEM, -1)


def splice(gap_array: Column, item_array: Column) -> Column:
    """Inverse of cutting: interleave gaps and items into one text."""
    return F.array_join(
        F.zip_with(gap_array, item_array, lambda g, i: F.concat(g, F.coalesce(i, F.lit("")))), ""
    )


def map_items(text: Column, pattern: str, edit) -> Column:
    """Replace every match of ``pattern`` by ``edit(match)`` within the row: no shuffle."""

    def edited(whole: Column) -> Column:
        found = F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))
        return splice(F.split(whole, pattern, -1), F.transform(found, edit))

    return let(text, edited)


def outer_spans(item_array: Column, name: str) -> Column:
    """Outermost elements ``name`` among items: array of (a, b), the places of their first and last item.

    A fold with the depth as its state, so an element ends at its own end tag however deep others of its
    name are nested in it.  An end tag without a start tag is passed over; an element that is never closed ends
    behind the last item (b is the number of items).
    """
    opens, closes = rf"(?i)^<{name}[\s/>]", rf"(?i)^</{name}[\s/>]"
    kind = "struct<at:int,depth:int,first:int,spans:array<struct<a:int,b:int>>>"

    def step(state: Column, item: Column) -> Column:
        at, depth, first, spans = (state[x] for x in ("at", "depth", "first", "spans"))
        start, end = item.rlike(opens), item.rlike(closes) & (depth > 0)
        span = F.array(F.struct(first.alias("a"), at.alias("b")))
        return F.struct(
            (at + 1).alias("at"),
            (depth + F.when(start, 1).when(end, -1).otherwise(0)).alias("depth"),
            F.when(start & (depth == 0), at).otherwise(first).alias("first"),
            F.when(end & (depth == 1), F.concat(spans, span)).otherwise(spans).alias("spans"),
        ).cast(kind)

    def done(state: Column) -> Column:
        span = F.array(F.struct(state["first"].alias("a"), state["at"].alias("b")))
        return F.when(state["depth"] > 0, F.concat(state["spans"], span)).otherwise(state["spans"])

    empty = F.struct(F.lit(0), F.lit(0), F.lit(0), F.array().cast("array<struct<a:int,b:int>>")).cast(kind)
    return F.aggregate(item_array, empty, step, done)


def span_text(gap_array: Column, item_array: Column, span: Column) -> Column:
    """The text of a span, from its first item to its last one or, if it is not closed, to the end."""

    def piece(k: Column) -> Column:
        item = F.coalesce(F.get(item_array, k), F.lit(""))
        return F.when(k == span["a"], item).otherwise(F.concat(F.get(gap_array, k), item))

    return F.array_join(F.transform(F.sequence(span["a"], span["b"]), piece), "")


def without_spans(gap_array: Column, item_array: Column, spans: Column) -> Column:
    """The text that gaps and items make, but for the spans."""

    def piece(gap: Column, k: Column) -> Column:
        item = F.coalesce(F.get(item_array, k), F.lit(""))
        inside = F.exists(spans, lambda s: (s["a"] < k) & (k <= s["b"]))
        first = F.exists(spans, lambda s: s["a"] == k)
        return F.when(inside, "").when(first, gap).otherwise(F.concat(gap, item))

    return F.array_join(F.transform(gap_array, piece), "")


def tag_name(item: Column) -> Column:
    return F.lower(F.regexp_extract(item, r"^<([A-Za-z][^\s/>]*)", 1))


def start_tag(item: Column) -> Column:
    return F.regexp_extract(item, "(?is)^" + START_TAG, 0)


def element_body(item: Column, name: str) -> Column:
    """What is between the start and end tag of an element item."""
    return F.regexp_extract(
        item, rf"(?is)^<{name}{_ATTRIBUTES}>(.*?)(?:</{name}(?:[\s/][^>]*)?>)?\z", 1
    )


def _attribute_pattern(name: str) -> str:
    # 1: everything up to the value, 2: the value with its quotes, 3: the rest.
    other = rf"(?!{name}[\s=])[^\s/>=]++(?:\s*+=\s*+{_VALUE})?+"
    return (
        rf"(?is)^(<[A-Za-z][^\s/>]*+(?:[\s/]++|{other})*+{name}\s*+=\s*+)({_VALUE})(.*)$"
    )


def raw_attribute(tag: Column, name: str) -> Column:
    """Value of the first attribute of that name, still encoded; '' if absent."""
    return let_sql(
        F.regexp_extract(tag, _attribute_pattern(name), 2),
        """CASE WHEN v LIKE '"%' OR v LIKE "'%" THEN substr(v, 2, length(v) - 2) ELSE v END""",
    )


def attribute(tag: Column, name: str) -> Column:
    return decode_entities(raw_attribute(tag, name))


def set_attribute(tag: Column, name: str, value: Column) -> Column:
    pattern = _attribute_pattern(name)
    return F.concat(
        F.regexp_extract(tag, pattern, 1),
        F.lit('"'),
        encode_entities(value),
        F.lit('"'),
        F.regexp_extract(tag, pattern, 3),
    )


def drop_attribute(tag: Column, name: str) -> Column:
    """Remove the first attribute of that name when its value is not empty."""
    pattern = _attribute_pattern(name)
    before = F.regexp_replace(F.regexp_extract(tag, pattern, 1), rf"(?i)[\s/]*{name}\s*=\s*$", "")
    return F.when(
        raw_attribute(tag, name) != "", F.concat(before, F.regexp_extract(tag, pattern, 3))
    ).otherwise(tag)


_ENTITY = r"&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"
# White space at the ends of a text, as Unicode has it, and the four separators U+001C to U+001F.
BLANK = r"[\s\x{1C}-\x{1F}]"


def _character_sql(digits: str, base: int) -> str:
    """Character of a code point; U+FFFD for one outside Unicode.  Any number of leading zeros."""
    code = f"""CASE WHEN length(ltrim('0', {digits})) > 7 THEN 1114112
        ELSE CAST(conv(concat('0', ltrim('0', {digits})), {base}, 10) AS BIGINT) END"""
    return f"""transform(array({code}), c -> decode(unhex(lpad(hex(
        CASE WHEN c BETWEEN 1 AND 55295 OR c BETWEEN 57344 AND 1114111 THEN c ELSE 65533 END
        ), 8, '0')), 'UTF-32'))[0]"""


def _decode_sql() -> str:
    names = {**html.entities.name2codepoint, "apos": 39}
    # One text literal that the optimizer folds to a map.
    table = sql_text("\n".join(f"{name}\t{chr(code)}" for name, code in names.items()))
    entity = sql_text(_ENTITY)
    char = f"""CASE
        WHEN r LIKE '#x%' OR r LIKE '#X%'
          THEN {_character_sql("substr(r, 3)", 16)}
        WHEN r LIKE '#%' THEN {_character_sql("substr(r, 2)", 10)}
        ELSE coalesce(element_at(str_to_map({table}, '\n', '\t'), r), concat('&', r, ';')) END"""
    return f"""CASE WHEN contains(v, '&') THEN array_join(zip_with(
        split(v, {entity}, -1),
        transform(regexp_extract_all(v, {entity}, 1), r -> {char}),
        (gap, char) -> concat(gap, coalesce(char, ''))), '') ELSE v END"""


_DECODE = _decode_sql()


def decode_entities(text: Column) -> Column:
    """One pass over named and numeric character references; unknown names stay."""
    return let_sql(text, _DECODE)


def encode_entities(text: Column) -> Column:
    steps = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), steps, text)


def visible_text(markup: Column) -> Column:
    """Text nodes trimmed and joined by blanks; scripts, styles, templates and comments left out."""
    hidden = "(?is)" + "|".join(
        [COMMENT, *(element_pattern(name) for name in ("script", "style", "template"))]
    )
    bare = F.regexp_replace(markup, hidden, "<x>")
    nodes = F.split(bare, rf"(?is){START_TAG}|</[A-Za-z][^>]*>|<[!?][^>]*>", -1)
    trimmed = F.transform(
        nodes,
        lambda n: F.regexp_replace(decode_entities(n), rf"(?U)\A{BLANK}+|{BLANK}+\z", ""),
    )
    return F.array_join(F.filter(trimmed, lambda n: n != ""), " ")
