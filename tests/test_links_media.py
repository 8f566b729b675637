from webloom.operators import links, media


def urls(df, column="norm_url"):
    return sorted(r[column] for r in df.collect())


def test_internal_links(page_table):
    page = page_table(
        ("d/p.html", """<a href="/a#one">1</a><a href="/a#two">2</a><a href="rel.html">3</a>
        <a href="https://EXAMPLE.com/Case">4</a><a href="https://sub.example.com/">no</a><a href="">no</a>
        <a href="javascript:x()">no</a><a href="data:x">no</a><img src="data:x"><img data-src="/l.png">
        <source data-src="s.mp4"><script src="//example.com/j.js"></script><link data-src="/no">
        <a href="/w?action=edit">no</a>""")
    )
    assert urls(links.internal_link_set(page, ["action="])) == [
        "https://EXAMPLE.com/Case", "https://example.com/a", "https://example.com/d/rel.html",
        "https://example.com/d/s.mp4", "https://example.com/j.js", "https://example.com/l.png",
    ]


def test_css_imports(sheet_table):
    sheet = sheet_table(
        ("css/a.css", """@import "b.css"; @import url('sub/c.css'); @import url("//example.com/x.css");
        @import 'no-semicolon.css' @import "https://example.com/no.css"; @import url(unquoted.css);
        @import "../d.css#f"; @import "//other.org/no.css";""")
    )
    assert urls(links.css_edges(sheet), "dst_url") == [
        "https://example.com/css/b.css", "https://example.com/css/sub/c.css",
        "https://example.com/d.css#f", "https://example.com/x.css",
    ]


def test_external_media(page_table, sheet_table):
    page = page_table(
        ("p.html", """<img src="https://cdn.org/a.png?v=1"><img src="https://cdn.org/a.png?v=2">
        <link href="https://cdn.org/s.css"><img href="https://cdn.org/x.gif"><a href="https://cdn.org/no.png">
        <img src="https://example.com/own.png"><img src="/rel.png"><img src="//cdn.org/no.png">
        <video src="https://cdn.org/page.html"><img data-src="https://cdn.org/l.WEBP">""")
    )
    sheet = sheet_table(("a.css", "a{b:url( 'https://cdn.org/q.svg?x' )} c{d:url(https://example.com/o.png)}"))
    assert urls(media.external_media(page, sheet), "url") == [
        "https://cdn.org/a.png", "https://cdn.org/l.WEBP", "https://cdn.org/q.svg",
        "https://cdn.org/s.css", "https://cdn.org/x.gif",
    ]
    row = media.scan_counters(page, sheet).first()
    assert (row.html_urls, row.css_urls, row.unique_media) == (9, 2, 5)


def test_url_map(spark):
    found = spark.createDataFrame(
        [("d", "https://a.org/x.png"), ("d", "https://b.org/x.png"), ("d", "https://a.org/y.png"), ("e", "https://a.org/x.png")],
        "target_domain string, url string",
    )
    files = spark.createDataFrame([("d", "images/x.png", 1), ("d", "other/y.png", 1)], "target_domain string, path string, length int")
    rows = media.url_map(found, files, mark_shared=True).orderBy("url").collect()
    assert [(r.url, r.filename, r.shared) for r in rows] == [
        ("https://a.org/x.png", "x.png", True), ("https://b.org/x.png", "x.png", True),
    ]
