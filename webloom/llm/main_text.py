"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into text blocks at block-level tags.  A block is described by its own number of words
and link density, those of the blocks before and after it, and the kind of place it stands in.  A
decision tree, fitted on the small labelled pages below, keeps or drops it.

Nulls: a null page has an empty text.  Empty pages, and pages of markup only, have an empty text.
Pages are rows on their own: repeated rows and ids stay, other input columns are not read.  A page of
any length is scanned once from left to right.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from webloom.llm.common import arrow_map

# Tags that end a text block.
BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol "
    "p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Block-level tags whose end tag may be left out: their class holds until the next block.
OPEN_ENDED = frozenset("p li dt dd tr td th tbody thead tfoot hr body html head".split())
# Elements without text for readers.
SILENT = frozenset(
    "script style title noscript template textarea select button svg iframe object canvas".split()
)
SIDE_TAGS = frozenset("nav footer aside form menu dialog".split())
SIDE_NAMES = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|side-?bar|menu|nav\w*|footer|"
    r"cookies?|consent|notice|alert|popup|modal|overlay|comments?|respond|replies|"
    r"share|social|related|recommended|widget|breadcrumbs?|newsletter|subscri\w*|login|signup|"
    r"search|pagination|pager|copyright|disclaimer)(?![a-z])"
)
# Words about the layout or state of a wrapper, not about what it holds: with-sidebar, has-comments, nav-open.
LAYOUT_NAMES = re.compile(
    r"(?<![\w-])(?:has|with|without|no|is)-[\w-]+|(?<![\w-])[\w-]+-(?:open|opened|closed|collapsed|hidden|visible|active|enabled|disabled)(?![\w-])"
)
# Side elements that no main text inside makes a wrapper.
CLOSED_TAGS = frozenset("nav footer aside menu dialog".split())
FORM_END = re.compile("</form(?=[\\s/>])", re.I)
# A header outside the main text; one inside it holds its title.
TOP_NAMES = re.compile(r"(?<![a-z])(?:header|masthead)(?![a-z])")
MAIN_NAMES = re.compile(r"(?<![a-z])(?:article|post|entry|story|content|main)(?:-?(?:body|text|content))?(?![a-z])")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
LOOSE_TAG = re.compile(r"</?[a-zA-Z][^>]*>?")
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)

FEATURES = (
    "words",
    "link_density",
    "words_before",
    "link_density_before",
    "words_after",
    "link_density_after",
    "in_side",
    "in_main",
    "heading",
)

# Small labelled pages: a block that belongs to the main text starts with "+".
LABELLED = (
    """<nav><ul><li><a href=a>Home</a><li><a href=b>World news</a><li><a href=c>Sport and leisure</a></ul></nav>
    <div class=ad>Buy two of our fine pens today and get one of them free of charge now.</div>
    <article><h1>+ A quiet town by the sea</h1><p>+ The town lies between the hills and the long grey shore and few
    people pass through it in winter when the wind is strong.</p><p>+ Yes.</p><p>+ Some of them stay, and
    those who stay write letters that <a href=x>the museum</a> keeps in a small room.</p></article>
    <footer>&copy; town.example and the many people who wrote these pages over the years of its life.</footer>""",
    """<header><a href=/>Site</a> The best news site that money can buy for you and for your friends</header>
    <div id=content><h2>+ Bread</h2><p>+ Mix flour, water, salt and a little yeast and leave the dough in a warm
    place for an hour.</p><p>+ Bake it.</p><p>+ Eat it while it is warm, with butter or with cheese.</p></div>
    <div class=comments><p>I tried this and it came out far too dry, so I would add more water to it.</p>
    <p>Nice!</p></div><div id=footer>All rights reserved</div>""",
    """<div><a href=a>Start</a> <a href=b>Products</a> <a href=c>Contact us</a></div>
    <p>+ There was no frame around this text and the writer of the page used nothing but plain
    paragraphs for all of it, as was usual then.</p><p>+ The second paragraph has as many words as a second
    paragraph needs and then comes to its end here.</p><div><a href=d>Back to the list of pages</a></div>
    <div>Contact</div>""",
    """<aside><h3>Most read</h3><p>This week our readers liked the story about the old bridge and its
    keeper more than any other story.</p></aside><main><h1>+ Rain</h1><p>+ It rained.</p><p>+ It rained for nine
    days and on the tenth day the river came over the wall and into the lower streets of the town.</p>
    <form><p>Leave your address here and we will send you a letter every week about the weather.</p></form>
    <p>+ Then it stopped.</p><section class="related"><a href=z>Snow in the hills</a></section></main>""",
    """<div class="cookie-notice">We use cookies to make this page work and to count how many readers it has
    each day.</div><article><p>+ <a href=q>A paragraph that is one link</a></p><p>+ Then a normal
    sentence follows, with enough words in it to be read as one.</p><blockquote>+ Quoted.</blockquote>
    <ul><li>+ one</li><li>+ two things</li></ul><div class=share><a href=s>Share</a></div>
    <section id=comments><h3>Comments</h3><p>The first reader writes a long reply here, longer than most of
    the paragraphs above, and says nothing in it at all.</p></section></article>
    <footer><p>Imprint</p><a href=i>Terms and conditions of use</a></footer>""",
    """<table><tr><td><a href=1>one</a><td><a href=2>two</a><td><a href=3>three</a></table>
    <div>Log in</div><div>+ Once more a text that stands in a bare division, long enough to be the main text of a
    page that has little else to show to its readers.</div><div>+ And a further division of this kind, with
    another twenty words or so that tell the reader how all of it came to its end.</div>
    <div><a href=9>next page</a> <a href=8>last page</a></div>""",
    """<nav><a href=a>Start</a><a href=b>Archive</a></nav><article><h1>+ Boats</h1><p>+ All of the boats were
    painted green in the year of the flood, and green they have stayed since.</p><p>+ Why?</p><p>+ <a href=k>An
    older page about boats</a></p><p>+ Nobody knows.</p></article><footer>Boats and more</footer>""",
    """<ul><li><a href=a>Start</a></li><li><a href=b>Archive</a></li></ul><h1>+ On the making of good
    strong rope by hand</h1><p>+ Rope is made of yarn, yarn of fibre, and fibre grows in the fields behind the
    houses of the rope makers.</p><p>+ It is twisted three times over before it is sold to the ships.</p>
    <ul><li><a href=c>About us</a></li><li>Imprint</li></ul>""",
    """+ A page may be nothing but its text, without a single tag around it to show where it starts.""",
    """<h1>+ Keys</h1><p>+ A key opens one lock and no other, or so the man who sold it to us had said, and
    he had sold a great many of them.</p><p>+ He was wrong about this one, as we found out in the same week.</p>""",
    """<article><p>+ Rest.</p></article>""",
    """<div>+ Stones are picked from the field each spring, and each spring there are as many as before.</div>
    <article><p>+ Stones.</p><p>+ More.</p></article>""",
    """<div>Top</div><p>+ The lamp was lit at six and put out at ten by the keeper, who then went to bed and
    slept until the bell rang.</p><div>Send</div>""",
    """<div>Welcome</div><div><a href=j>Start</a></div><p>+ A road leads from the mill to the church and from
    there to the station, where no train stops.</p><p>+ It is four miles long and has no bend in it at all.</p>""",
    """<main><p>+ <a href=u>Nuts</a></p><p>+ Shells.</p><p>+ A nut has a shell that must be broken first if
    one wants to eat it.</p></main><div>Top</div>""",
    """<form action=page.aspx><nav><a href=a>Start</a></nav><div class="site menu"><article class="post has-comments">
    <h1>+ Glass</h1><p>+ Sand is melted in the oven until it runs, and what runs out of it is glass.</p><p>+ Hot.</p></article>
    <div class=comments><p>My own oven was never hot enough for any of this, I am sorry to say.</p></div></div></form>""",
)


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """Texts of the blocks in page order, and their features (one row per block)."""
    texts: list[str] = []
    rows: list[tuple] = []
    places: list[tuple[str, bool, bool]] = []
    side = main = False
    own_side = own_main = False
    heading = False
    parts: list[str] = []
    linked: list[str] = []
    in_link = False
    found_main = False
    form_end = 0

    def close() -> None:
        nonlocal in_link
        if parts:
            words = entities.unescape("".join(parts)).split()
            if words:
                links = len(entities.unescape(" ".join(linked)).split())
                texts.append(" ".join(words))
                rows.append(
                    (len(words), min(1.0, links / len(words)), side or own_side, main or own_main, heading)
                )
            parts.clear()
            linked.clear()
        in_link = False

    def text(piece: str) -> None:
        parts.append(piece)
        if in_link:
            linked.append(piece)

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        if start > at:
            text(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = size if end < 0 else end + 1
            continue
        found = TAG.match(page, start) or LOOSE_TAG.match(page, start)
        if not found:
            text("<")
            at = start + 1
            continue
        at = found.end()
        if found.re is LOOSE_TAG:
            ends, name, rest = found[0].startswith("</"), re.findall(r"[^\s<>/]+", found[0])[0].lower(), ""
        else:
            ends, name, rest = found[1] == "/", found[2].lower(), found[3]
        if name in SILENT:
            if not ends and not rest.endswith("/"):
                end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
                at = size if end is None else end.start()
            continue
        if name == "a":
            in_link = not ends
        elif name in ("br", "img", "wbr", "input"):
            text(" ")
        elif name in BREAKS:
            close()
            heading = not ends and len(name) == 2 and name[0] == "h" and name[1].isdigit()
            own_side = own_main = False
            if ends:
                if name not in OPEN_ENDED and any(p[0] == name for p in places):
                    while places.pop()[0] != name:
                        pass
                    side, main = places[-1][1:] if places else (False, False)
            else:
                names = " ".join(NAMED.findall(rest)).lower() if rest else ""
                chosen = name in ("article", "main") or bool(names and MAIN_NAMES.search(names))
                marked = bool(names and SIDE_NAMES.search(LAYOUT_NAMES.sub(" ", names)))
                if name == "form":
                    # One that spans half of the page is a frame around it.  Forms do not nest.
                    if form_end < at:
                        end = FORM_END.search(page, at)
                        form_end = size if end is None else end.start()
                    marked = marked or 2 * (form_end - at) < size
                else:
                    marked = marked or name in SIDE_TAGS
                if name in ("article", "main") and not marked and (name == "main" or not found_main):
                    if not any(p[0] in CLOSED_TAGS for p in places):
                        # What holds the main text is a wrapper, whatever its names say.
                        found_main = True
                        if side:
                            places = [(tag, False, inner) for tag, _, inner in places]
                            side = False
                if not (main or chosen):
                    marked = marked or name == "header" or bool(names and TOP_NAMES.search(names))
                if name in OPEN_ENDED:
                    own_side, own_main = marked, chosen
                else:
                    side, main = side or marked, main or chosen
                    places.append((name, side, main))
    close()
    if not rows:
        return texts, np.zeros((0, len(FEATURES)))
    own = np.array(rows, float)
    around = np.zeros((len(rows), len(FEATURES)))
    around[:, 0:2] = own[:, 0:2]
    around[1:, 2:4] = own[:-1, 0:2]
    around[:-1, 4:6] = own[1:, 0:2]
    around[:, 6:9] = own[:, 2:5]
    return texts, around


def grown(x: np.ndarray, y: np.ndarray, depth: int = 6):
    """Decision tree by Gini impurity: a share of positives, or (feature, limit, low, high).

    A split must leave two rows on each side; of equal splits the earlier feature wins.
    """
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = (len(y) * share * (1 - share) - 1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = y[x[:, f] < limit]
            high = y[x[:, f] >= limit]
            if min(len(low), len(high)) < 2:
                continue
            cost = sum(len(s) * s.mean() * (1 - s.mean()) for s in (low, high))
            if cost < best[0] - 1e-12:
                best = (cost, f, float(limit))
    if best[1] is None:
        return share
    low = x[:, best[1]] < best[2]
    return best[1], best[2], grown(x[low], y[low], depth - 1), grown(x[~low], y[~low], depth - 1)


@lru_cache(1)
def fitted():
    """The tree of the labelled pages."""
    features, labels = [], []
    for page in LABELLED:
        labels += [t.startswith("+") for t in blocks(page)[0]]
        features.append(blocks(page.replace("+ ", ""))[1])
    return grown(np.concatenate(features), np.array(labels, float))


def kept(tree, x: np.ndarray) -> np.ndarray:
    """For each block whether the tree calls it main text."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree >= 0.5)
    f, limit, low, high = tree
    out = np.zeros(len(x), bool)
    left = x[:, f] < limit
    out[left] = kept(low, x[left])
    out[~left] = kept(high, x[~left])
    return out


def main_text(page: str | None) -> str:
    texts, x = blocks(page or "")
    if not texts:
        return ""
    return "\n\n".join(t for t, k in zip(texts, kept(fitted(), x)) if k)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield {
                    "page_id": part.column("page_id"),
                    "url": part.column("url"),
                    "text": texts,
                    "n_chars": [len(t) for t in texts],
                }

    return arrow_map(
        pages.select("page_id", "url", "html"),
        run,
        "page_id bigint, url string, text string, n_chars bigint",
    )
