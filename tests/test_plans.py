from webloom.plans.mirror import Mirror, Resumed

PAGE = """<html><head><link crossorigin="x" href="https://cdn.org/a.css"></head><body>some readable text
<a href="{0}">n</a><a href="search.php">s</a></body></html>"""


def files(spark):
    return spark.createDataFrame(
        [("example.com", "images/a.css", 10)], "target_domain string, path string, length int"
    )


def test_mirror(spark, page_table, sheet_table):
    pages = page_table(("a.html", PAGE.format("/b")), ("quiet.org", "q.html", "<head crossorigin=x></head><body><img crossorigin='x'>readable"))
    sheets = sheet_table(("s/a.css", "a{b:url(/x.png)}"))
    done = Mirror(pages, sheets, files(spark))
    assert [r.url for r in done.media.collect()] == ["https://cdn.org/a.css"]
    first, second = done.pages.orderBy("page_id").collect()
    assert '<link href="images/a.css">' in first.new_html and "search.php" not in first.new_html
    assert first.removed == 1 and first.changed and first.html == PAGE.format("/b")
    assert "crossorigin='x'" in second.new_html
    assert "crossorigin='x'" not in Mirror(pages, sheets, files(spark), skip_without_media=False).pages.orderBy("page_id").collect()[1].new_html
    assert done.stylesheets.first().new_css == "a{b:url(../x.png)}"
    totals = {r.target_domain: r.files for r in done.totals.collect()}
    assert totals == {"example.com": 3, "quiet.org": 1}
    assert {r.target_domain: r.all_valid for r in done.verdict.collect()} == {"example.com": True, "quiet.org": True}


def test_stylesheets_of_a_site_without_media_stay(spark, page_table, sheet_table):
    done = Mirror(page_table(("a.html", "<p>x</p>")), sheet_table(("s/a.css", "a{b:url(/x.png)}")), files(spark))
    row = done.stylesheets.first()
    assert row.new_css == "a{b:url(/x.png)}" and row.steps_applied == 0


def test_resume(spark, page_table, sheet_table):
    pages = page_table(("a.html", PAGE.format("/b.html")), ("b.html", PAGE.format("/gone")), ("c.html", PAGE.format("/a.html")))
    seeds = spark.createDataFrame([("example.com", "https://example.com/a.html")], "target_domain string, url string")
    done = Resumed(pages, sheet_table(("x.css", "")), files(spark), seeds, patterns=["search"])
    assert sorted((r.url, r.depth) for r in done.missing.collect()) == [("https://example.com/gone", 2)]
    assert done.status.where("status = 'present'").count() == 2
    first = done.mirror.pages.orderBy("page_id").first()
    assert '<a href="b.html">' in first.new_html and "images/a.css" in first.new_html
