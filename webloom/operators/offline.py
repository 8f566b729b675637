"""Offline cleaning: remove online-only elements, add fallback styles, clean inline scripts.

All rules are constants and look at one element, so the job is a map over pages: the page is cut
into items, each is kept or dropped, and the rest is joined again.  Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial, reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions.binding import pin


@dataclass(frozen=True)
class RemovalRule:
    """Remove elements ``tag`` whose attributes, script text or nested image match."""

    tag: str
    attributes: tuple[tuple[str, str], ...] = ()
    content: str | None = None
    nested_img_src: str | None = None


def _token(name: str) -> str:
    """One of the blank-separated tokens of an attribute."""
    return rf"(?:^|\s){name}(?:\s|$)"


# Elements that are of no use offline.
REMOVAL_RULES = (
    RemovalRule("link", (("rel", _token("stylesheet")), ("href", r"^https?://.*load\.php"))),
    RemovalRule("script", (("src", r"^https?://.*load\.php"),)),
    RemovalRule("link", (("rel", _token("preconnect")),)),
    RemovalRule("link", (("rel", _token("dns-prefetch")),)),
    RemovalRule("link", (("rel", _token("EditURI")),)),
    RemovalRule("link", (("type", r"application/(atom|rss)\+xml"),)),
    RemovalRule("script", content=r"_paq"),
    RemovalRule("script", (("src", r"(?i)google-analytics\.com"),)),
    RemovalRule("script", content=r"(?i)google-analytics\.com"),
    RemovalRule("noscript", nested_img_src=r"(?i)(matomo|analytics|doubleclick|google-analytics)"),
    RemovalRule("script", (("src", r"9a832b96e0\.js"),)),
    RemovalRule("link", (("href", r"(?i)use\.fontawesome\.com"),)),
    RemovalRule("script", content=r"FontAwesomeCdnConfig"),
    RemovalRule("script", content=r"""ga\(['"]create['"]"""),
    RemovalRule("script", content=r"""ga\(['"]send['"]"""),
    RemovalRule("a", (("href", r"(posting|tradegold|memberlist|search|ucp|mcp)\.php"),)),
)

# Text added to pages and calls taken out of their scripts, in this order.
FALLBACK_STYLE = """<style>/* Minimal fallback CSS for offline browsing */
body { font-family: Arial, sans-serif; line-height: 1.6; margin: 0; padding: 0; }
#content { max-width: 960px; margin: 0 auto; padding: 20px; }
h1, h2, h3 { margin-top: 1.5em; }
a { color: #0645ad; text-decoration: none; }
a:hover { text-decoration: underline; }
.mw-body-content { padding: 1em; }</style>"""
# A page that has a head: its tag, or an element that only a head holds, comes first.
HEAD_START = (
    r"(?is)\A(?:\s++|<!--.*?-->|<!doctype[^>]*+>|<html[^>]*+>)*+"
    r"<(?:head|link|meta|script|style|title|base)[\s/>]"
)
FALLBACK_MARK = "/* Minimal fallback CSS for offline browsing */"
SCRIPT_CALLS = (
    r"""ga\(['"]create['"],\s*[^)]+\);?""",
    r"""ga\(['"]send['"],\s*[^)]+\);?""",
    r"""\.push\(\s*\[?\s*['"]trackPageView['"].*?\);?""",
    r"""\.push\(\s*\[?\s*['"]enableLinkTracking['"].*?\);?""",
    r"""(?s)window\.FontAwesomeCdnConfig\s*=\s*\{[^}]+\}\s*;""",
    r"""(?s)window\.FontAwesomeCdnConfig\s*=\s*\{[^}]+\}\s*;.*?function\s*\([^)]*\)[^{]*"""
    r"""\{[^}]*\}\s*\([^)]*\)\s*;""",
)

# Comments and raw text are cut out whole in every pass, so nothing inside them is taken for markup.
# A link ends at its end tag; one that is not closed before the next link is its start tag only.
_NO_MARKUP = "|".join([H.COMMENT, *(H.element_pattern(n) for n in H.RAW_TEXT_ELEMENTS)])
_TEMPERED_LINK = (
    H.START_TAG.replace("<[A-Za-z][^\\s/>]*+", "<a", 1)
    + rf"(?:(?:[^<]++|{_NO_MARKUP}|<(?!/?a[\s/>]))*+</a(?:[\s/][^>]*)?>)?+"
)
_PATTERNS = {
    ("link", "script"): H.ITEM,
    # Its tags only: which of them belong together is told by their order.
    ("noscript",): rf"(?is){_NO_MARKUP}|{H.START_TAG.replace('<[A-Za-z][^\\s/>]*+', '<noscript(?=[\\s/>])', 1)}|</noscript(?:[\s/][^>]*)?>",
    ("a",): f"(?is){_NO_MARKUP}|{_TEMPERED_LINK}",
}


def _tags_of(rule: RemovalRule) -> tuple[str, ...]:
    return next(tags for tags in _PATTERNS if rule.tag in tags)


def _passes(rules: Sequence[RemovalRule]):
    """(tags, pattern, rules): neighbouring rules that cut a page alike share a pass.

    The order of the rules stays, so what an earlier one removes is not there for a later one.
    """
    return [(tags, _PATTERNS[tags], list(own)) for tags, own in groupby(rules, key=_tags_of)]


def _rules_match(item: Column, tag: str, rules: Sequence[RemovalRule]) -> list[Column]:
    """The rules of a tag on one of its elements, each as a test."""
    names = sorted({name for r in rules for name, _ in r.attributes})
    start = H.start_tag(item) if names else None
    values = {name: H.attribute(start, name) for name in names}
    tests = []
    for rule in rules:
        parts = [values[name].rlike(p) for name, p in rule.attributes]
        if rule.content:
            parts.append(H.element_body(item, tag).rlike(rule.content))
        if rule.nested_img_src:
            images = F.filter(H.items(H.element_body(item, tag)), lambda i: H.tag_name(i) == "img")
            sources = F.transform(images, lambda i: H.attribute(i, "src"))
            parts.append(F.exists(sources, _found(rule.nested_img_src)))
        tests.append(reduce(lambda a, b: a & b, parts))
    return tests


def _found(pattern: str) -> Callable[[Column], Column]:
    return lambda text: text.rlike(pattern)


def is_removable(item: Column, tags: Sequence[str], rules: Sequence[RemovalRule]) -> Column:
    verdict = F.lit(False)
    for tag in tags:
        own = [r for r in rules if r.tag == tag]
        if own:
            fits = reduce(lambda a, b: a | b, _rules_match(item, tag, own))
            verdict = F.when(item.rlike(rf"(?i)^<{tag}[\s/>]"), fits).otherwise(verdict)
    return verdict


def _kept_item(tags: Sequence[str], rules: Sequence[RemovalRule]) -> Callable[[Column], Column]:
    return lambda item: F.when(is_removable(item, tags, rules), F.lit(None)).otherwise(item)


def remove_elements(
    pages: DataFrame, out: str = "new_html", rules: Sequence[RemovalRule] = REMOVAL_RULES
) -> DataFrame:
    """Drop matching elements; adds ``out`` and ``removed`` (number of elements dropped)."""
    pages = pin(pages, **{out: F.col("html"), "removed": F.lit(0)})
    for tags, pattern, own in _passes(rules):
        text = F.col(out)
        if tags == ("noscript",):
            pages = _without_nested(pages, out, pattern, tags, own)
            continue
        pages = pin(
            pages,
            _kept=F.transform(
                F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), _kept_item(tags, own)
            ),
        )
        pages = pin(pages, _dropped=F.size(F.filter("_kept", lambda i: i.isNull())))
        pages = pin(
            pages,
            **{
                out: F.when(
                    F.col("_dropped") > 0, H.splice(F.split(text, pattern, -1), F.col("_kept"))
                ).otherwise(text),
                "removed": F.col("removed") + F.col("_dropped"),
            },
        ).drop("_kept", "_dropped")
    return pages


def _without_nested(
    pages: DataFrame, out: str, pattern: str, tags: Sequence[str], rules: Sequence[RemovalRule]
) -> DataFrame:
    """Drop matching elements that may hold others of their name: the outermost one counts, once."""
    text = F.col(out)
    cut = pin(
        pages,
        _items=F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        _gaps=F.split(text, pattern, -1),
    )
    spans = pin(cut, _spans=H.outer_spans(F.col("_items"), tags[0]))
    gone = pin(
        spans,
        _gone=F.filter(
            "_spans",
            lambda s: is_removable(H.span_text(F.col("_gaps"), F.col("_items"), s), tags, rules),
        ),
    )
    rest = H.without_spans(F.col("_gaps"), F.col("_items"), F.col("_gone"))
    return pin(
        gone,
        **{
            out: F.when(F.size("_gone") > 0, rest).otherwise(text),
            "removed": F.col("removed") + F.size("_gone"),
        },
    ).drop("_items", "_gaps", "_spans", "_gone")


def add_fallback_style(text: Column) -> Column:
    """Put the style before the first end of a head, once.

    Both tags of a head may be left out.  If a head's end tag is, the style goes before the body, or
    to the start of a page without one; a page that begins with its body has no head and gets no style.
    """
    style = FALLBACK_STYLE.replace("$", r"\$")

    def before(tag: str) -> Column:
        return F.regexp_replace(text, rf"(?is)\A(.*?)({tag})", f"$1{style}$2")

    return (
        F.when(text.contains(FALLBACK_MARK), text)
        .when(text.rlike(r"(?i)</head\s*>"), before(r"</head\s*>"))
        .when(~text.rlike(HEAD_START), text)
        .when(text.rlike(r"(?i)<body[\s>]"), before(r"<body[\s>]"))
        .otherwise(F.concat(F.lit(FALLBACK_STYLE), text))
    )


def clean_scripts(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), SCRIPT_CALLS, text)


def clean_pages(pages: DataFrame) -> DataFrame:
    """Remove, add style, clean scripts: adds ``new_html``, ``removed`` and ``changed``."""
    styled = pin(remove_elements(pages), new_html=add_fallback_style(F.col("new_html")))
    cleaned = pin(styled, new_html=clean_scripts(F.col("new_html")))
    return cleaned.withColumn(
        "changed", (F.col("removed") > 0) | (F.col("new_html") != F.col("html"))
    )


def removal_candidates(pages: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """The elements the rules would remove, as rows with the number of the first rule that fits."""
    parts = []
    for tags, pattern in _PATTERNS.items():
        elements = F.regexp_extract_all("html", F.lit(pattern), F.lit(0))
        if tags == ("noscript",):
            gaps = F.split("html", pattern, -1)
            elements = F.transform(
                H.outer_spans(elements, tags[0]), partial(H.span_text, gaps, elements)
            )
        found = pages.select(*keys, F.posexplode(elements).alias("pos", "element")).where(
            H.tag_name(F.col("element")).isin(*tags)
        )
        numbered = [(n, r) for n, r in enumerate(REMOVAL_RULES, 1) if r.tag in tags]
        first = F.least(
            *[
                F.when((H.tag_name(F.col("element")) == tag) & test, n)
                for tag in tags
                for (n, _), test in zip(
                    [x for x in numbered if x[1].tag == tag],
                    _rules_match(
                        F.col("element"), tag, [r for _, r in numbered if r.tag == tag]
                    ),
                    strict=True,
                )
            ],
            F.lit(None).cast("int"),
        )
        parts.append(pin(found, rule_no=first).where("rule_no is not null"))
    return reduce(DataFrame.unionByName, parts)
