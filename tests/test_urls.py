import os
from urllib.parse import urljoin, urlparse

from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.functions import urls as U

BASES = ["https://h.org/a/b/c.html?q=1#f", "http://h.org", "https://u:p@h.org:80/a/b/", "https://h.org/a//b/c"]
REFS = (
    "|#x|?y=2|?|x|./x|../x|../../../x|/x|//o.org/p/../q|http://h.org/a|https://H.org/a/../b?#|/a/./b/../c|a//b|"
    "/a//b|.|..|./|../|x/./y/|http:g|https:g|mailto:a|  /sp ace|a;p?q#f|;x|///x|g:h|../..|a/..|/..|x?y=/../z|#"
).split("|")


def test_resolve_equals_standard_library(one):
    pairs = [(b, r) for b in BASES for r in REFS]
    assert one(U.resolve, pairs) == [urljoin(b, r) for b, r in pairs]


def test_resolve_generated_references(one):
    pairs = []
    piece = st.sampled_from(["a", "b.c", "..", ".", "", "x;y", "?q=1", "#f", "?"])

    @settings(max_examples=150, database=None, derandomize=True)
    @given(st.sampled_from(BASES[:3]), st.lists(piece, max_size=5), st.booleans())
    def collect(base, pieces, rooted):
        ref = "/".join(pieces)
        pairs.append((base, "/" + ref.lstrip("/") if rooted else ref.lstrip("/")))

    collect()
    assert one(U.resolve, pairs) == [urljoin(b, r) for b, r in pairs]


def test_host(one):
    urls = ["https://Wiki.Example.COM/x", "http://u:p@h.org:81/", "http://h.org?x", "https://[::1]:8/", "/no"]
    assert one(U.host, urls) == [urlparse(u).hostname or "" for u in urls]


def test_default_scheme(one):
    assert one(U.with_default_scheme, ["a.org", "http://a.org", "https://a.org"]) == [
        "https://a.org", "http://a.org", "https://a.org",
    ]


def test_file_path(one):
    cases = {
        "https://h.org": "index.html",
        "https://h.org/": "index.html",
        "https://h.org/wiki/": "wiki/index.html",
        "https://h.org/wiki/Page": "wiki/Page",
        "https://h.org/a?x=1&y=2": "a@x=1&y=2",
        "https://h.org/a?p=/b/c#frag": "a@p=%2Fb%2Fc",
        "https://h.org/?x=1": "index.html@x=1",
        "https://h.org/a/b;p=1?q": "a/b@q",
        "https://h.org//a//b": "a/b",
    }
    assert one(U.file_path, list(cases)) == list(cases.values())


def test_save_path(one):
    cases = {
        "a.css": "a.css", "a.PNG": "a.PNG", "a": "a.html", "a.php": "a.php.html",
        ".hidden": ".hidden.html", "x.": "x..html", "d.css/file": "d.css/file.html",
        "load.php@m=x.css": "load.php@m=x.css",
    }
    assert one(U.save_path, list(cases)) == list(cases.values())


def test_depth(one):
    assert one(U.depth, ["a.html", "x/a.html", "x/y/z/a.html", "../a.html"]) == [0, 1, 3, 0]


def test_relative_path_equals_standard_library(one):
    pairs = [
        ("a.html", "b.html"), ("x/a.html", "b.html"), ("a.html", "x/b.html"), ("x/a.html", "x/b.html"),
        ("x/y/a.html", "x/z/b.html"), ("p/q/r/a.html", "s.html"), ("a", "p/q/r/s"), ("x", "x/y/z"),
    ]
    assert one(U.relative_path, pairs) == [
        os.path.relpath(t, os.path.dirname(f) or ".") for t, f in pairs
    ]


def test_media_and_basename(one):
    urls = ["http://c.org/a.PNG", "http://c.org/a.png?v=1", "http://c.org/a.png#x", "http://c.org/apng", "http://c.org/d/"]
    assert one(lambda u: U.is_media(u, (".png",)), urls) == [True, True, False, False, False]
    assert one(U.basename, urls) == ["a.PNG", "a.png", "a.png", "apng", "d"]


def test_reject_reason(one):
    def reason(url):
        from pyspark.sql import functions as F

        return U.reject_reason(url, F.lit("h.org"), ("action=", "f=[0-9]+&", r"(x)\1"), ("h.",))

    cases = {
        "#a": "prefix", "mailto:a": "prefix", "ftp://h.org/": "scheme", "https://www.h.org/": "host",
        "https://H.org/w?action=edit": "pattern", "https://h.org/?f=12&x": "pattern",
        "https://h.org/xx": "pattern", "https://h.org/Action=": "domain",
    }
    assert one(reason, list(cases)) == list(cases.values())


def test_many_patterns_are_chunked(one):
    patterns = [f"p{n}x" for n in range(250)]
    assert one(lambda u: U.any_pattern(u, patterns), ["p7x", "p249x", "p250x", "q"]) == [
        True, True, False, False,
    ]


def test_combined_regex():
    assert U.combined_reject_regex(["a=", "b"], ["m.", "n."]) == ".*(a=|b|(m.|n.)).*"
    assert U.combined_reject_regex([], []) is None
