import random
import re

import pytest

from webloom.operators import offline

GONE = [
    '<link rel="stylesheet" href="https://w.org/load.php?x">', "<script src='http://w.org/load.php'></script>",
    "<link rel='dns-prefetch' href=//x>", "<link rel='preconnect x'>", "<link rel=EditURI href=x>",
    '<link type="application/atom+xml">', "<script>var _paq = 1;</script>",
    "<script src='//WWW.Google-Analytics.com/a.js'></script>", "<script>x('google-analytics.com')</script>",
    "<noscript><p><img alt='' src='//x/MATOMO.php'></p></noscript>", "<script src='images/9a832b96e0.js'></script>",
    "<link href='https://USE.fontawesome.com/x.css'>", "<script>FontAwesomeCdnConfig</script>",
    "<script>ga('create', 1)</script>", '<script>ga("send", 1)</script>', "<a href='./search.php?x'><b>find</b></a>",
]
KEPT = [
    '<link rel="stylesheet" href="../w/load.php%3Fx">', '<script src="load.php@m=j"></script>',
    "<noscript><img src='logo.png'></noscript>", "<a href='viewtopic.php'>t</a>", "<!-- <link rel=preconnect> -->",
    "<script>var s = '<link rel=preconnect>';</script>", "<a name=search.php>x</a>",
]


@pytest.mark.parametrize("elements", [GONE, KEPT, GONE + KEPT])
def test_rules(page_table, elements):
    df = page_table(("p.html", "<p>" + " ".join(elements) + "</p>"))
    row = offline.remove_elements(df).first()
    assert row.removed == sum(e in GONE for e in elements)
    assert row.new_html == "<p>" + " ".join("" if e in GONE else e for e in elements) + "</p>"


def test_nested_and_unclosed(page_table):
    df = page_table(
        ("a.html", "<noscript><link rel=preconnect>text</noscript>"),
        ("b.html", "<a href=ucp.php>open <a href='/x'>next</a>"),
    )
    rows = offline.remove_elements(df).orderBy("page_id").collect()
    assert [r.new_html for r in rows] == ["<noscript>text</noscript>", "open <a href='/x'>next</a>"]


def test_text_that_is_not_markup_stays(page_table):
    kept = [
        """<script>document.write('<a href="search.php">x</a>');go()</script>""",
        '<!-- <a href="search.php">c</a> <noscript><img src="//matomo.org/x"></noscript> -->',
        '<textarea><noscript><img src="//matomo.org/x"></noscript><a href="ucp.php">t</a></textarea>',
        "<title><a href=mcp.php></title>",
    ]
    gone = '<a href="search.php">a <!-- </a> --><script>"</a>"</script>b</a>'
    rows = offline.remove_elements(page_table(("a.html", "".join(kept)), ("b.html", gone))).orderBy("page_id").collect()
    assert rows[0].new_html == "".join(kept) and rows[0].removed == 0
    assert rows[1].new_html == "" and rows[1].removed == 1
    assert offline.removal_candidates(page_table(("a.html", "".join(kept)))).count() == 0


def test_nested_elements_count_once(page_table):
    nested = "<noscript><link href='https://use.fontawesome.com/a.css'><img src='//matomo.org/x'></noscript>"
    earlier = "<noscript><link rel=preconnect><img src='//matomo.org/x'></noscript>"
    rows = offline.remove_elements(page_table(("a.html", nested), ("b.html", earlier))).orderBy("page_id").collect()
    assert [(r.new_html, r.removed) for r in rows] == [("", 1), ("", 2)]


def test_style_without_an_end_of_head(one):
    style = offline.FALLBACK_STYLE
    cases = {
        "<!DOCTYPE html><html><head><title>t</title><body>x": f"<!DOCTYPE html><html><head><title>t</title>{style}<body>x",
        "<meta charset=utf-8><BODY class=a>x": f"<meta charset=utf-8>{style}<BODY class=a>x",
        "<link rel=icon href=x>": f"{style}<link rel=icon href=x>",
        "<body>x": "<body>x",
        "<p>x</p>": "<p>x</p>",
        "": "",
    }
    assert one(offline.add_fallback_style, list(cases)) == list(cases.values())


def test_each_rule_is_reported(page_table):
    rows = offline.removal_candidates(page_table(("p.html", "".join(GONE)))).collect()
    assert len(rows) == len(GONE) and {r.element for r in rows} == set(GONE)


def test_style_is_added_once(page_table, spark):
    df = page_table(("a.html", "<html><HEAD></HEAD ><body></head></body>"), ("b.html", "<p>no head</p>"))
    once = offline.clean_pages(df)
    texts = [r.new_html for r in once.orderBy("page_id").collect()]
    assert texts[0].count(offline.FALLBACK_MARK) == 1 and texts[0].startswith("<html><HEAD><style>")
    assert texts[1] == "<p>no head</p>"
    again = offline.clean_pages(once.drop("html", "removed", "changed").withColumnRenamed("new_html", "html"))
    assert [r.changed for r in again.collect()] == [False, False]


def test_script_calls(one):
    texts = [
        "a();ga('create', 'U', {x: 1});b()",
        "_q.push(['trackPageView']);x",
        '_q.push(["enableLinkTracking"]);x',
        "1;window.FontAwesomeCdnConfig = {\n a: 1 \n};2",
        "ga('send', 'pageview')",
    ]
    assert one(offline.clean_scripts, texts) == ["a();b()", "_qx", "_qx", "1;2", ""]


def outermost(html):
    """(rest, removed) by a stack over the tags, one after the other."""
    mask = r"<!--.*?(?:-->|$)|<(?:script|style|textarea|title)\b.*?(?:</(?:script|style|textarea|title)>|$)"
    out, depth, start, removed, at = [], 0, 0, 0, 0
    for m in re.finditer(rf"(?is){mask}|<(/?)noscript(?=[\s/>])[^>]*>", html):
        if m[0].lower().startswith("<noscript"):
            if depth == 0:
                out.append(html[at : m.start()])
                start = m.start()
            depth += 1
        elif m[0].lower().startswith("</noscript") and depth:
            depth -= 1
            if depth == 0:
                removed += close(out, html[start : m.end()], mask)
                at = m.end()
    if depth:
        removed += close(out, html[start:], mask)
        at = len(html)
    return "".join(out) + html[at:], removed


def close(out, element, mask):
    plain = re.sub(f"(?is){mask}", "", element)
    if re.search(r"(?i)<img[^>]*src=[^>]*matomo", plain):
        return 1
    out.append(element)
    return 0


def test_nested_elements_against_a_stack(spark, page_table):
    rng = random.Random(5)
    parts = ["<noscript>", "<NOSCRIPT class=x>", "</noscript>", "</noscript >", "<img src='//matomo.org/x'>", "<img src='a.png'>",
             "t", "<b>", "<!-- <noscript> -->", "<textarea></noscript></textarea>", "<noscripts>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(400)]
    texts += ["<noscript><noscript>a</noscript><img src='//matomo.org/x'></noscript>b", "</noscript>" * 50 + "<noscript>" * 50 + "<img src='//matomo.org/x'>"]
    pages = page_table(*((f"{k}.html", t) for k, t in enumerate(texts)))
    rules = (offline.RemovalRule("noscript", nested_img_src="matomo"),)
    got = offline.remove_elements(pages, rules=rules).orderBy("page_id").collect()
    assert [(r.new_html, r.removed) for r in got] == [outermost(t) for t in texts]
    assert sum(r.removed for r in got) > 60
