import html
from html.parser import HTMLParser

from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.operators import tokens

ODD = [
    '<p title="a>b" class=x>1</p><!-- <a href="no"> --><a href=\'/x\'>y</a>',
    "<script>var a='<a href=\"no\">';</script ><A HREF=/up>z</A>",
    "<p title=don't><a href='/a'>it's</a>",
    '<a data-href="no" hreflang=de href = "/y">t</a><img src=a.png/>',
    "plain < text <3 and <b>bold</b>",
    "<style>p{}</style><title><a href=no></title><textarea><a href=no></textarea>",
    "<!-- never closed <a href='no'>",
    "<script>never closed <a href='no'>",
    "<img src='a' src='b'/><br/><a\nhref\n=\n'/nl'>",
    "",
]


class Tags(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        self.found.append(tag)


def test_tokens_are_lossless(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "page_id bigint, html string")
    rows = tokens.token_table(df).orderBy("page_id", "pos").collect()
    for n, text in enumerate(ODD):
        assert "".join(r.text for r in rows if r.page_id == n) == text


def test_start_tags_equal_standard_parser(spark):
    # That parser takes title and textarea for ordinary elements.
    texts = [t for t in ODD if "never closed" not in t and "<title>" not in t]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id bigint, html string")
    rows = tokens.token_table(df).where("kind in ('tag', 'element')").orderBy("page_id", "pos").collect()
    for n, text in enumerate(texts):
        parser = Tags()
        parser.feed(text)
        assert [r.tag for r in rows if r.page_id == n] == parser.found


def test_attributes(one):
    tags = ODD[3][: ODD[3].index(">") + 1], "<img src='a' src='b'/>", "<a href=x&amp;y>", "<a title=' href=no'>"
    assert one(lambda t: H.attribute(t, "href"), list(tags)) == ["/y", "", "x&y", ""]
    assert one(lambda t: H.attribute(t, "src"), [tags[1]]) == ["a"]


def test_set_and_drop_attribute(one):
    tag = '<img alt="src=no" src=a.png integrity="x" crossorigin>'
    assert one(lambda t: H.set_attribute(t, "src", F.lit('l/"b&c')), [tag]) == [
        '<img alt="src=no" src="l/&quot;b&amp;c" integrity="x" crossorigin>'
    ]
    assert one(lambda t: H.drop_attribute(H.drop_attribute(t, "integrity"), "crossorigin"), [tag]) == [
        '<img alt="src=no" src=a.png crossorigin>'
    ]


def test_entities_equal_standard_library(one):
    texts = ["a&amp;b", "&amp;lt;", "&#65;&#x1F600;&eacute;&nbsp;", "&unknown; & &;", "&quot;&apos;&#39;"]
    assert one(H.decode_entities, texts) == [html.unescape(t) for t in texts]


def test_tag_with_very_many_attributes(one):
    tag = "<a " + " ".join(f'data-{n}="{n}"' for n in range(20000)) + ' href="/x">'
    assert one(lambda t: H.attribute(H.start_tag(t), "href"), [tag]) == ["/x"]
    assert one(lambda t: F.size(H.items(t)), [tag * 2]) == [2]


def test_references_with_any_number_of_digits(one):
    texts = ["&#00000065;&#x0000041;", "&#x110000;&#99999999999999999999;", "&#0;", "&#x" + "0" * 40 + "e9;"]
    assert one(H.decode_entities, texts) == ["AA", "��", "�", "é"]


def test_unicode_blanks_are_no_text(one):
    assert one(H.visible_text, ["<p>　  </p>", "<p>\x1c x \xa0</p>"]) == ["", "x"]
