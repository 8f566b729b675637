from webloom.operators import relink


def html(df, column="new_html"):
    return [r[column] for r in df.orderBy("page_id").collect()]


def mapping(spark):
    return spark.createDataFrame(
        [("example.com", "https://cdn.org/a.png", "a.png"), ("example.com", "https://cdn.org/s.css", "s.css")],
        "target_domain string, url string, filename string",
    )


def test_external(spark, page_table):
    pages = page_table(
        ("p.html", '<img src="https://cdn.org/a.png?v=3" alt=x><a href="https://cdn.org/a.png">keep</a>'),
        ("x/y/z/p.html", "<LINK integrity='i' crossorigin href='https://cdn.org/s.css' src=https://cdn.org/a.png>"),
        ("q.html", "<p>nothing</p><script crossorigin=anonymous>x</script>"),
        ("r.html", "<img src='https://cdn.org/unknown.png'>"),
    )
    done = relink.relink_external(pages, mapping(spark))
    assert html(done) == [
        '<img src="images/a.png" alt=x><a href="https://cdn.org/a.png">keep</a>',
        '<LINK crossorigin href="../../../images/s.css" src="../../../images/a.png">',
        "<p>nothing</p><script>x</script>",
        "<img src='https://cdn.org/unknown.png'>",
    ]
    assert html(done, "changed") == [True, True, True, False]
    assert relink.modified_pages(done).first().modified == 3


def test_internal(spark, page_table):
    pages = page_table(
        ("a/p.html", """<a href="https://example.com/b/q?x=1&amp;y=2#f">1</a><a href="r.html">2</a><a href="/gone">3</a>
<a href="../up">4</a><img src="../up"><img src="/i.png" data-src="/i.png"><a href="https://o.org/b/q">5</a>"""),
    )
    stored = spark.createDataFrame(
        [("example.com", p) for p in ("b/q@x=1&y=2.html", "a/r.html", "up.html", "i.png")],
        "target_domain string, path string",
    )
    expected = """<a href="../b/q@x=1&amp;y=2.html{0}">1</a><a href="r.html">2</a><a href="/gone">3</a>
<a href="../up.html">4</a><img src="../up"><img src="../i.png" data-src="/i.png"><a href="https://o.org/b/q">5</a>"""
    assert html(relink.relink_internal(pages, stored)) == [expected.format("")]
    assert html(relink.relink_internal(pages, stored, keep_fragment=True)) == [expected.format("#f")]


def test_second_run_changes_nothing(spark, page_table):
    pages = page_table(("p.html", '<img src="https://cdn.org/a.png">'))
    once = relink.relink_external(pages, mapping(spark))
    again = relink.relink_external(once.drop("html", "changed").withColumnRenamed("new_html", "html"), mapping(spark))
    assert html(again, "changed") == [False]
